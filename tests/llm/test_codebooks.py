import hashlib
import math

import numpy as np
import pytest

from rankloom.llm import codebooks as C
from rankloom.llm.queries import op12_vector_codes

SMALL = "/root/testdata/sf0.001"


def brute(rows, rounds=C.ROUNDS, entries=C.ENTRIES):
    """The whole contract in plain numpy: every part against every entry."""
    good = [
        (i, lab, [math.floor(float(np.float32(x)) * 1024) for x in v])
        for i, v, lab in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    good.sort(key=lambda r: (r[0], r[2]))
    if not good:
        return {}, None
    d = len(good[0][2])
    good = [r for r in good if len(r[2]) == d]
    q = np.array([r[2] for r in good], dtype=np.int64).reshape(len(good), 4, -1)
    books = q[:entries].transpose(1, 0, 2).copy()

    def nearest():
        gaps = ((q[:, :, None, :] - books.transpose(0, 1, 2)[None]) ** 2).sum(-1)
        return gaps.argmin(-1), gaps.min(-1)

    for _ in range(rounds):
        near, _ = nearest()
        for p in range(4):
            for e in range(books.shape[1]):
                mine = q[near[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    near, gaps = nearest()
    errors = gaps.sum(1)
    by_label = {}
    for r, err in zip(good, errors):
        by_label[r[1]] = by_label.get(r[1], 0) + int(err)
    digest = hashlib.sha256(",".join(str(v) for v in books.reshape(-1).tolist()).encode()).hexdigest()
    out = {}
    for r, n, err in zip(good, near, errors):
        out.setdefault(r[0], []).append(("".join(f"{x:02x}" for x in n), int(err), by_label[r[1]]))
    return out, digest


def spark_result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, []).append((r.code, r.error, r.label_error))
    return {k: sorted(v) for k, v in out.items()}, {r.codebooks_sha256 for r in df.collect()}


def test_equals_brute_force_on_given_vectors(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    want, digest = brute([(r.vec_id, r.embedding, r.label) for r in vectors.collect()])
    got, digests = spark_result(op12_vector_codes(spark, SMALL))
    assert got == {k: sorted(v) for k, v in want.items()} and digests == {digest}


def test_edge_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], int(i % 3) if i % 5 else None) for i in range(40)]
    rows += [(5, rows[5][1], 2), (5, rows[5][1], 2)]  # repeated rows and ids
    rows += [(100, None, 1), (101, [0.1, None, 0.2, 0.3, 0.1, 0.1, 0.1, 0.1], 1), (102, [float("nan")] * 8, 1)]
    rows += [(103, [float("inf")] + [0.0] * 7, None), (104, [0.1] * 4, 1), (-1, [0.0] * 8, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", C.F.lit(1))
    want, digest = brute([(i, v, lab) for i, v, lab in rows if v is None or len(v) == 8], entries=16)
    got, digests = spark_result(C.product_codes(df.drop("code"), entries=16))
    assert got == {k: sorted(v) for k, v in want.items()} and digests == {digest}
    assert 100 not in got and 104 not in got and len(got[5]) == 3


def test_empty_and_memo_is_exact(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert C.product_codes(empty).count() == 0
    rng = np.random.default_rng(5)
    book = rng.integers(-300, 300, (256, 16))
    parts = rng.integers(-300, 300, (3000, 16))
    parts[::7] = parts[0]
    entry, gap = C.assign(parts, book, {}, bits=6)
    full = ((parts[:, None, :] - book[None]) ** 2).sum(-1)
    assert (entry == full.argmin(1)).all() and (gap == full.min(1)).all()
