"""Similarity join on word shingles: MinHash, Bayesian pruning of candidates, exact verification.

1. Documents with equal shingle sets are one class; from here on only classes are compared.
2. A class has 128 MinHash values, in bands; classes that agree in a band are candidates. The band width is
   the largest of 8, 4, 2, 1 for which a pair at the threshold agrees in no band with a probability of at
   most `MISS` (at 0.8: 32 bands of 4, 5e-8 = 0.59^32; at 0.6: 64 of 2; at 0.45: 128 of 1); a threshold that no width
   meets is refused.
3. Candidates of one band bucket are compared 16 MinHash values at a time. With a uniform prior, after m
   agreements of n the posterior probability of similarity t or more is P(Bin(n + 1, t) <= m); a pair goes
   when it falls below the tolerance (1e-9, so that no more than about 1e-8 of true pairs are lost).
   A pair that meets in several bands counts in the first only.
4. Shingle sets are made only for classes with a surviving pair, and the pairs verified exactly on them.

A bucket of any size is cut into blocks (see `links`): a large group of near copies is compared in full,
but no task holds more than two blocks and no pair is ever a row.

Words are those of `text.words_of`; a shingle is five of them as a 64-bit hash. Defined cases: a text of
one to four words has one shingle of all its words; null and wordless texts link with nothing, not even
each other; equal texts are one class; of a component, the row with the smallest (doc_id, text digest) is
kept, null ids last; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.links import LINKED, Tally, block_pairs, connected_components, groups_of, pairs_of
from rankloom.llm.text import prepare_python, text_key, utf8, words_of
from rankloom.plans.joins import broadcast_if_small
from rankloom.llm.tables import stage

WORDS = 5
THRESHOLD = 0.8
TOLERANCE = 1e-9
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
MISS = 1e-7
STEP = 16
BLOCK_ROWS = 2048
BLOCK_BYTES = 32 * 1024 * 1024
BROADCAST_BYTES = 32 * 1024 * 1024

_RANDOM = np.random.default_rng(20240511)
_FACTORS = (_RANDOM.integers(1, 2**31, size=HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 2**32, size=HASHES, dtype=np.uint32)
_PLACES = _RANDOM.integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_set(raw: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words."""
    own = words_of(raw)
    if not own:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=len(own))
    width = min(words, len(own))
    total = np.zeros(len(own) - width + 1, dtype=np.uint64)
    for place in range(width):
        total += hashes[place : len(own) - width + 1 + place] * _PLACES[place]
    return np.unique(mixed(total + np.uint64(width)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a shingle set."""
    halves = (shingles >> np.uint64(32)).astype(np.uint32)
    lowest = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(halves), 512):
        part = halves[at : at + 512, None] * _FACTORS
        part += _SHIFTS
        np.minimum(lowest, part.min(axis=0), out=lowest)
    return lowest


def fewest_agreements(threshold: float, tolerance: float) -> list[int]:
    """For 16, 32, ... compared values: the fewest agreements with which a pair stays a candidate."""
    limits = []
    for seen in range(STEP, HASHES + 1, STEP):
        below, agreements = 0.0, -1
        while below < tolerance:
            agreements += 1
            below += math.comb(seen + 1, agreements) * threshold**agreements * (1 - threshold) ** (seen + 1 - agreements)
        limits.append(agreements)
    return limits


_SKETCH = pa.struct([("set_key", pa.binary()), ("n", pa.int32()), ("signature", pa.binary())])


def _sketch(texts: pa.Array) -> pa.Array:
    rows = []
    for raw in texts.to_pylist():
        own = shingle_set(raw)
        if len(own):
            rows.append({"set_key": xxhash.xxh3_128_digest(own.tobytes()), "n": len(own), "signature": signature(own).tobytes()})
        else:
            rows.append({"set_key": None, "n": 0, "signature": None})
    return pa.array(rows, type=_SKETCH)


_SET = pa.struct([("shingles", pa.binary()), ("signature", pa.binary())])


def _whole_set(texts: pa.Array) -> pa.Array:
    sets = [shingle_set(raw) for raw in texts.to_pylist()]
    return pa.array([{"shingles": s.tobytes(), "signature": signature(s).tobytes()} for s in sets], type=_SET)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def band_width(threshold: float, miss: float = MISS) -> int:
    """Values a band: the widest that misses a pair at the threshold with a probability of at most `miss`."""
    for width in (8, 4, 2, 1):
        if (1.0 - threshold**width) ** (HASHES // width) <= miss:
            return width
    raise ValueError(f"{HASHES} MinHash values cannot find pairs at similarity {threshold} with a miss of at most {miss}")


def surviving(
    first: np.ndarray, second: np.ndarray, signatures: np.ndarray, sizes: np.ndarray, band: int,
    threshold: float, limits: list[int], width: int = ROWS,
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that lengths and posterior leave, without those that already met in an earlier band."""
    small, large = np.minimum(sizes[first], sizes[second]), np.maximum(sizes[first], sizes[second])
    keep = small >= threshold * large - 1e-9
    first, second = first[keep], second[keep]
    agreed = np.zeros(len(first), dtype=np.int64)
    for step, limit in enumerate(limits):
        if not len(first):
            break
        part = slice(step * STEP, (step + 1) * STEP)
        agreed = agreed + (signatures[first, part] == signatures[second, part]).sum(axis=1)
        keep = agreed >= limit
        first, second, agreed = first[keep], second[keep], agreed[keep]
    if band and len(first):
        equal = signatures[first, : band * width] == signatures[second, : band * width]
        met = equal.reshape(len(first), band, width).all(axis=2).any(axis=1)
        first, second = first[~met], second[~met]
    return first, second


def verified(
    first: np.ndarray, second: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, ratio: Fraction
) -> np.ndarray:
    """Which pairs have a Jaccard similarity of `ratio` or more, counted exactly."""
    if len(first) <= 4 * len(sets):
        shared = np.array(
            [len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(first.tolist(), second.tolist())],
            dtype=np.int64,
        )
    else:
        shared = _shared_by_bits(first, second, sets)
    return ratio.denominator * shared >= ratio.numerator * (sizes[first] + sizes[second] - shared)


def _shared_by_bits(first: np.ndarray, second: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections, by bit rows over the shingles that more than one set holds."""
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    width = int((counts > 1).sum())
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = counts[codes] > 1
    columns, owner = place[codes[common]], owner[common]
    shared = np.zeros(len(first), dtype=np.int64)
    span = 1 << 16
    for start in range(0, width, span):
        inside = (columns >= start) & (columns < start + span)
        bits = np.zeros((len(sets), -(-min(span, width - start) // 64)), dtype=np.uint64)
        at = columns[inside] - start
        np.bitwise_or.at(bits, (owner[inside], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        chunk = max(1, (1 << 22) // bits.shape[1])
        for pair in range(0, len(first), chunk):
            part = slice(pair, pair + chunk)
            shared[part] += np.bitwise_count(bits[first[part]] & bits[second[part]]).sum(axis=1, dtype=np.int64)
    return shared


def _bucket_pairs(rows: DataFrame, blocks, columns: list[str], function, schema: str) -> DataFrame:
    placed = block_pairs(rows, blocks, "node")
    keys = ["band", "bucket", "_lo", "_hi"]
    dealt = placed.select(*keys, "_block", *columns).repartition(*keys).sortWithinPartitions(*keys, "node")
    return dealt.mapInArrow(function, schema)


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links), each written to the shared folder.

    documents: doc_id, text_key, set_key. classes: set_key, members, rep (smallest row), n.
    links: node, links (number of documents of other classes), root.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    limits, ratio = fewest_agreements(threshold, tolerance), Fraction(threshold).limit_denominator(10**6)
    width = band_width(threshold)
    sketched = stage(
        docs.select("doc_id", text_key().alias("text_key"), F.arrow_udf(
            _sketch, "struct<set_key: binary, n: int, signature: binary>")(utf8("text")).alias("s")
        ).select("doc_id", "text_key", "s.*"),
        "jaccard_documents",
    )
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = stage(
        sketched.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(
            F.count("*").alias("members"), F.min(row).alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature")
        ),
        "jaccard_classes",
    )
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(HASHES // width - 1)),
        lambda b: F.xxhash64(F.expr("signature").substr(b * (4 * width) + 1, F.lit(4 * width))),
    )
    members = classes.select(F.col("set_key").alias("node"), "n", F.posexplode(bands).alias("band", "bucket"))
    crowded = stage(members.groupBy("band", "bucket").agg(F.count("*").alias("rows")).filter("rows > 1"), "jaccard_buckets")
    candidates = members.join(broadcast_if_small(crowded, BROADCAST_BYTES), ["band", "bucket"])
    signed = candidates.join(classes.select(F.col("set_key").alias("node"), "signature"), "node")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 4):
            band, bucket, low, high = (group.column(i)[0].as_py() for i in range(4))
            own, sizes = _matrix(group.column("signature")), group.column("n").to_numpy()
            seen = np.zeros(group.num_rows, dtype=bool)
            for first, second in pairs_of(group.column("_block").to_numpy(), low != high):
                first, second = surviving(first, second, own, sizes, band, threshold, limits, width)
                seen[first] = seen[second] = True
            if seen.any():
                nodes = group.column("node").take(pa.array(np.flatnonzero(seen))).combine_chunks()
                count = len(nodes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([band] * count, pa.int32()), pa.array([bucket] * count, pa.int64()), nodes],
                    names=["band", "bucket", "node"],
                )

    found = stage(
        _bucket_pairs(
            signed, F.ceil(F.col("rows") / BLOCK_ROWS), ["node", "n", "signature"], find, "band int, bucket long, node binary"
        ).distinct(),
        "jaccard_found",
    )
    needed = classes.select("set_key", "rep", "members", "n").join(
        broadcast_if_small(found.select(F.col("node").alias("set_key")).distinct(), BROADCAST_BYTES), "set_key", "left_semi"
    )
    wanted = stage(
        needed.select("set_key", "members", "n", F.col("rep.doc_id").alias("_rep_id"), F.col("rep.text_key").alias("_rep_key")),
        "jaccard_wanted",
    )
    texts = docs.select("doc_id", "text", text_key().alias("_key")).join(
        broadcast_if_small(wanted, BROADCAST_BYTES),
        (F.col("_key") == F.col("_rep_key")) & F.col("doc_id").eqNullSafe(F.col("_rep_id")),
    )
    sets = stage(
        texts.select("set_key", "members", "n", F.arrow_udf(
            _whole_set, "struct<shingles: binary, signature: binary>")(utf8("text")).alias("s")
        ).select(F.col("set_key").alias("node"), "members", "n", "s.*").dropDuplicates(["node"]),
        "jaccard_sets",
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 4):
            band, low, high = (group.column(i)[0].as_py() for i in (0, 2, 3))
            own, sizes = _matrix(group.column("signature")), group.column("n").to_numpy().astype(np.int64)
            sets = [np.frombuffer(b, dtype=np.uint64) for b in group.column("shingles").to_pylist()]
            tally = Tally(group.column("node").to_pylist(), group.column("members").to_numpy())
            for first, second in pairs_of(group.column("_block").to_numpy(), low != high):
                first, second = surviving(first, second, own, sizes, band, threshold, limits, width)
                if len(first):
                    true = verified(first, second, sets, sizes, ratio)
                    tally.add(first[true], second[true])
            yield from tally.batches()

    weights = stage(
        found.join(sets.select("node", "n"), "node").groupBy("band", "bucket").agg(
            F.count("*").alias("rows"), F.sum(F.col("n").cast("long") * 8).alias("bytes")
        ),
        "jaccard_weights",
    )
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES))
    loaded = found.join(broadcast_if_small(weights, BROADCAST_BYTES), ["band", "bucket"]).join(sets, "node")
    links = stage(
        _bucket_pairs(loaded, blocks, ["node", "n", "members", "signature", "shingles"], verify, LINKED), "jaccard_links"
    )
    return sketched.select("doc_id", "text_key", "set_key"), classes.select("set_key", "members", "rep", "n"), links


def join_documents(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """A row for each document: doc_id, text_key, class_id, n_links, component_id, kept.

    class_id is the smallest id with an equal shingle set; n_links the number of other documents of that
    similarity (equal ones included); component_id the smallest id reached through links.
    """
    documents, classes, links = similar_classes(docs, threshold, tolerance)
    roots = connected_components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy(F.col("node").alias("set_key")).agg(F.sum("links").alias("linked"))
    linked = stage(
        classes.join(counted, "set_key").join(roots.withColumnRenamed("node", "set_key"), "set_key"), "jaccard_linked"
    )
    first = linked.groupBy("root").agg(F.min("rep").alias("first"))
    together = linked.join(first, "root").select("set_key", "members", "rep", "linked", "first")
    copies = classes.filter("members > 1").join(linked.select("set_key"), "set_key", "left_anti").select(
        "set_key", "members", "rep", F.lit(0).cast("long").alias("linked"), F.col("rep").alias("first")
    )
    grouped = stage(together.unionByName(copies), "jaccard_grouped")
    out = documents.join(broadcast_if_small(grouped, BROADCAST_BYTES), "set_key", "left")
    alone = F.col("members").isNull()
    first_row = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return out.select(
        "doc_id", "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("members") - 1 + F.col("linked")).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | first_row).alias("kept"),
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Rows of `docs`, with their own columns: one of each component, wordless texts all.

    Dropped rows are looked up by id and text digest. Rows that repeat both are one row afterwards.
    """
    judged = stage(join_documents(docs, **options), "jaccard_judged")
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), text_key().alias("_key"))
    gone = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key"))
    left = keyed.join(
        broadcast_if_small(gone.distinct(), BROADCAST_BYTES),
        (F.col("_key") == F.col("_gone_key")) & F.col("_id").eqNullSafe(F.col("_gone_id")), "left_anti",
    )
    again = stage(
        judged.filter(F.col("kept") & (F.col("n_links") > 0)).groupBy("doc_id", "text_key").count().filter("count > 1").select(
            F.col("doc_id").alias("_again_id"), F.col("text_key").alias("_again_key")
        ),
        "jaccard_again",
    )
    if again.isEmpty():
        return left.select("_row.*")
    same = (F.col("_key") == F.col("_again_key")) & F.col("_id").eqNullSafe(F.col("_again_id"))
    small = broadcast_if_small(again, BROADCAST_BYTES)
    once = left.join(small, same, "left_semi").groupBy("_id", "_key").agg(F.first("_row").alias("_row"))
    return left.join(small, same, "left_anti").select("_row.*").unionByName(once.select("_row.*"))
