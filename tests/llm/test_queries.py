"""Registered queries next to their SQL twins, and the pipeline next to its parts."""

import collections

import pytest

import corpus_pipeline
from checks.compare import compare, database
from checks.compare import ORACLE as CORE_ORACLE, QUERIES as CORE_QUERIES
from rankloom.llm import packing
from rankloom.llm.queries import QUERIES
from rankloom.llm.sql import ORACLE

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, monkeypatch, name):
    monkeypatch.setitem(CORE_QUERIES, name, QUERIES[name])
    monkeypatch.setitem(CORE_ORACLE, name, ORACLE[name])
    assert compare(spark, database(SMALL), SMALL, name)[0] == "ok"


def test_native_queries_run_no_python(spark):
    for name in ("op6_licence_scan", "op8_source_mixing", "op9_hilbert_sharding"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "InArrow", "ArrowEval"))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, function in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.stage(function(spark, kept[-1], SMALL), "test_stage", "snappy"))
        assert kept[-1].columns == columns, name
    counts = [df.count() for df in kept]
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    rows = lambda df: collections.Counter(map(tuple, df.collect()))
    for before, after in zip(kept[:3], kept[1:4]):
        assert not rows(after) - rows(before)
    mixed = rows(kept[4])
    assert set(mixed) <= set(rows(kept[3])) and max(mixed.values()) == 2
    with open(packing.VOCABULARY, "rb") as file:
        encoding = packing.encoding_of(file.read())
    wanted = collections.Counter({r.doc_id: 0 for r in kept[4].collect()})
    for row in kept[4].collect():
        wanted[row.doc_id] += len(encoding.encode_ordinary(row.text))
    got = collections.Counter()
    for row in corpus_pipeline.STAGES[-1][1](spark, kept[4], SMALL).collect():
        for doc, a, b in zip(row.doc_ids, row.cu_seqlens, row.cu_seqlens[1:]):
            got[doc] += b - a
    assert got == wanted
    assert sum(r.n_tokens for r in corpus_pipeline.run(spark, SMALL).collect()) == sum(wanted.values())
