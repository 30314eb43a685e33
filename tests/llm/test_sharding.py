"""The curve and the cuts."""

import zlib

import pytest
from pyspark.sql import functions as F

from rankloom.llm.sharding import hilbert_index, hilbert_shards, row_facts, write_shards


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 1)])
def test_curve_visits_neighbours(spark, dims, bits):
    side = 1 << bits
    axes = [F.floor(F.col("id") / side**k % side).cast("int").alias(f"x{k}") for k in range(dims)]
    cells = spark.range(side**dims).select(*axes)
    rows = cells.withColumn("h", hilbert_index([F.col(f"x{k}") for k in range(dims)], bits)).collect()
    order = sorted(rows, key=lambda r: r.h)
    assert [r.h for r in order] == list(range(side**dims))
    assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in zip(order, order[1:]))


def facts(docs):
    size, checksum = row_facts()
    return docs.select("doc_id", "source", "lang", size.alias("size"), checksum.alias("text_crc32"))


@pytest.mark.parametrize("rows_per_group", [1000, 2])
def test_runs_are_even_and_gapless(spark, rows_per_group):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(30)).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.lit("hot")).otherwise(F.col("source")))
    rows = hilbert_shards(facts(docs), rows_per_group=rows_per_group).collect()
    shards = {}
    for row in rows:
        shards.setdefault(row.shard, []).append(row.slot)
    assert set(shards) == set(range(24)) and len(rows) == 230
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    spans = lambda column: sum(len({r[column] for r in rows if r.shard == s}) for s in range(24))
    assert spans("source") < 24 * 5 and spans("lang") < 24 * 2.5
    again = hilbert_shards(facts(docs.repartition(5)), rows_per_group=rows_per_group).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_edge_cases(spark, edge_docs, empty_docs):
    rows = hilbert_shards(facts(edge_docs)).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, (r.doc_id for r in edge_docs.collect())))
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    for row in rows:
        if row.doc_id not in (None, 3):
            raw = texts[row.doc_id]
            assert row.size == 8 + len((raw or "").encode())
            assert row.text_crc32 == (None if raw is None else zlib.crc32(raw.encode()))
    assert hilbert_shards(facts(empty_docs)).count() == 0


def test_written_shards_hold_whole_rows(spark, edge_docs, tmp_path):
    write_shards(edge_docs, f"{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.select("_shard").distinct().count() == 4
    plain = lambda df: sorted(map(str, (tuple(r) for r in df.select(edge_docs.columns).collect())))
    assert plain(back) == plain(edge_docs)
