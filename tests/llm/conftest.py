import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size string, weight string, quality string,"
    " found string, shard string, key string, node string, deduped string, n_hit string"
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def document(doc_id, text, lang="en", source="src0", n_chars=0):
    return (doc_id, text, lang, source, n_chars, *["x"] * 9)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing columns."""
    chance = random.Random(7)
    prose = [" ".join(chance.choices(WORDS, k=60)) for _ in range(6)]
    rows = [
        document(1, prose[0]), document(2, prose[0]), document(3, prose[1], "fr", "src1"),
        document(3, prose[1], "fr", "src1"), document(3, prose[2], None, None), document(None, prose[3]),
        document(None, None, None, None, None), document(4, None), document(5, ""), document(6, " \t\n "),
        document(7, "one"), document(8, "one"), document(9, "Three short words."), document(10, "\u00c9t\u00e9 \u4e2d\u6587 \U0001f600 x\x00y"),
        document(11, " ".join(chance.choices(WORDS, k=60_000)), "en", "src2"), document(12, "a" * 50_000, "de", "src1"),
        document(13, prose[4] + "\n" + prose[5] + "\n" + prose[4]), document(14, prose[5] + "\r\n" + prose[4]),
        (15, prose[2], "en", "src3", 5, *[None] * 9),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
