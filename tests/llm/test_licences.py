"""Canonical texts and look-ups."""

import pytest

from rankloom.llm.licence_texts import TEXTS
from rankloom.llm.licences import scan_licences

MIT = TEXTS[0][1]


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(TEXTS, "licence string, text string")


def test_equal_but_for_spelling_case_and_copyright(spark, known):
    variants = [
        MIT, MIT.upper(), "Copyright (c) 2020 Someone\nAll rights reserved.\n" + MIT, MIT.replace("\n\n", "\r\n").replace(",", " ,"),
        MIT.replace("sublicense", "sub-license").replace("License", "Licence"), MIT.replace(" ", "  ").replace('"', "“"),
    ]
    others = [MIT + " extra", MIT.replace("free of charge", "for a fee"), MIT[:-10], "mit"]
    rows = list(enumerate(variants)) + [(100 + i, t) for i, t in enumerate(others)]
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert [got[i].licence for i in range(len(variants))] == ["MIT"] * len(variants)
    assert len({got[i].digest for i in range(len(variants))}) == 1
    assert all(got[100 + i].licence is None for i in range(len(others)))


def test_notices_in_longer_texts(spark, known):
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.\nMore."), (1, "Licenced under the MIT Licence"),
        (2, "We never released under the MIT License. Or so they say."), (3, "(c) 2001 X\nlicensed under the apache license version 2 0"),
    ]
    got = scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
    found = sorted((r.doc_id, r.licence or "", tuple(r.notices), r.found) for r in got)
    assert found == [
        (1, "", ("CC-BY-NC-4.0", "MIT"), True), (1, "MIT", ("MIT",), True), (2, "", (), False), (3, "Apache-2.0", ("Apache-2.0",), True),
    ]


def test_known_texts_differ(spark, known):
    docs = known.selectExpr("monotonically_increasing_id() AS doc_id", "text", "licence AS expected")
    names = {r.doc_id: r.expected for r in docs.collect()}
    assert all(r.licence == names[r.doc_id] for r in scan_licences(docs, known).collect())


def test_titles_and_whole_licences(spark, known):
    body = MIT.split("\n\n", 1)[1]
    whole = {name: text for name, text in TEXTS if len(text) > 6000}
    assert {"Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= set(whole)
    forms = [("MIT", body), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 X\n\n" + body)]
    forms += [(n, t.split("\n\n", 1)[1]) for n, t in TEXTS if n in ("ISC", "BSD-2-Clause") and t.startswith(n[:3] + " ")]
    forms += [(n, t.upper()) for n, t in whole.items()]
    docs = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(forms)], "doc_id long, text string, name string")
    got = {r.doc_id: r.licence for r in scan_licences(docs, known).collect()}
    assert [got[i] for i in range(len(forms))] == [n for n, _ in forms]


def test_edge_cases(spark, known, edge_docs, empty_docs):
    got = scan_licences(edge_docs, known).collect()
    assert len(got) == edge_docs.count() and not any(r.found for r in got)
    assert all(r.digest is None for r in got if r.doc_id in (4, 5, 6))
    assert scan_licences(empty_docs, known).count() == 0
    assert scan_licences(edge_docs, known.limit(0)).count() == edge_docs.count()


def rewrapped(text, width):
    import textwrap

    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n") if p.strip())


def test_whole_licences_found_at_every_wrapping_and_as_one_line(spark, known):
    whole = [(n, t) for n, t in TEXTS if len(t) > 6000]
    forms = [(n, rewrapped(t, w)) for n, t in whole for w in range(50, 121, 7)]
    forms += [(n, " ".join(t.split())) for n, t in whole]
    forms += [("MIT", "Copyright (c) 2020 Jane Doe\n\n" + MIT), ("MIT", "Copyright (c) 2019, 2020 Jane\nDoe. " + MIT)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(forms)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in scan_licences(docs, known).collect()}
    assert [got[i] for i in range(len(forms))] == [n for n, _ in forms]


def test_copyright_statements_go_and_nothing_else(spark, known):
    apache = next(t for n, t in TEXTS if n == "Apache-2.0" and len(t) > 6000)
    clause = "(c) You must retain"
    assert clause in apache
    rows = [
        (1, "Copyright 2020 X. Released under the MIT License."),
        (2, apache.replace(clause, "(c) You need not retain")),
        (3, "Copyright law protects works.\nReleased under the MIT License."),
        (4, "Copyright"),
        (5, "© 2021 Someone. All rights reserved."),
    ]
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got[1].notices == ["MIT"] and got[1].found
    assert got[2].licence is None
    assert got[3].licence is None and got[3].notices == ["MIT"]
    assert got[4].digest is not None and not got[4].found
    assert got[5].digest is None and not got[5].found
