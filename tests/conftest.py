import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from checks.compare import session

    return session("4")


@pytest.fixture(scope="session")
def toy(spark):
    from rankloom.sources.collections import Collection

    corpus = spark.createDataFrame(
        [
            ("d1", None, "gaming laptop for programming are laptop with good performance"),
            ("d2", "  ", "python tutorial for beginners are a great way to learn programming"),
            ("d3", "Weight", "weight loss tips for healthy living are important for overall wellness"),
            ("d4", None, "random blog post about cooking and travel are not relevant to the person "
                         "looking for a peach tree in their backyard"),
        ],
        "doc_id string, title string, text string",
    )
    queries = spark.createDataFrame(
        [("q1", "best laptop"), ("q2", "learn python"), ("q3", "laptop for programming")],
        "qid string, text string",
    )
    qrels = spark.createDataFrame(
        [("q1", "d1", 1), ("q2", "d2", 1)], "qid string, doc_id string, grade int"
    )
    return Collection(corpus, queries, qrels)
