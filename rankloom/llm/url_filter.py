"""URL filter rules looked up in a Bloom filter cascade.

Level 0 of the cascade encodes the listed keys; level 1 encodes those keys of the corpus that level 0
wrongly reports; level 2 the listed keys that level 1 reports; and so on until no key is wrongly
reported. Over the universe it was built for (every key that any url of the corpus can ask for) the
answer is exact, and judging a url needs no join: only the bits are broadcast. Their number follows the
list, not the corpus, and is checked: a list beyond `block_bits` is cut by key hash into several cascades.

A rule is a host and a path prefix. It fits its host and all subdomains if the url's path starts with
its path. The longest fitting rule decides; a key listed both ways is allowed; a url with no fitting rule
is not in the block cascade and so is allowed.

Defined cases: a null url or one without `://` has an empty host and path and fits no rule (unless one is
listed for them); repeated rows are each judged; without rules all is allowed; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.text import prepare_python
from rankloom.plans.joins import broadcast_if_small
from rankloom.llm.tables import stage

BLOCK_BITS = 8 * 32 * 1024 * 1024
WORD_BITS = 32

Level = tuple[int, int, int, np.ndarray]  # salt, hash functions, bits, words


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without `://`."""
    raw = F.coalesce(F.col(url), F.lit(""))
    after = F.expr(f"substring(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")
    rest = F.when(F.instr(raw, "://") > 0, after).otherwise(F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, labels: int, path_lengths: list[int]) -> Column:
    """Every key (host suffix + path prefix) of a url that a rule could have.

    `labels` is the most labels of any rule's host and `path_lengths` are the lengths of the rules' paths,
    so nothing beyond them needs to be asked for.
    """
    parts = F.split(host, r"\.")
    count = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(count, F.lit(labels))), lambda n: F.array_join(F.slice(parts, count - n + 1, n), ".")
    )
    prefixes = F.filter(
        F.transform(
            F.array(*[F.lit(n) for n in path_lengths]),
            lambda n: F.when(F.length(path) >= n, path.substr(F.lit(1), n)),
        ),
        lambda p: p.isNotNull(),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def positions(first: np.ndarray, second: np.ndarray, salt: int, hashes: int, bits: int) -> np.ndarray:
    """Bit numbers of each key: double hashing over a mix of its two hashes and the level's salt."""
    with np.errstate(over="ignore"):
        a = first.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        a ^= a >> np.uint64(31)
        b = (second.view(np.uint64) ^ a) | np.uint64(1)
        steps = np.arange(hashes, dtype=np.uint64)
        return ((a[:, None] + steps * b[:, None]) >> np.uint64(1)) % np.uint64(bits)


def in_level(first: np.ndarray, second: np.ndarray, level: Level) -> np.ndarray:
    salt, hashes, bits, words = level
    at = positions(first, second, salt, hashes, bits)
    return ((words[at // WORD_BITS] >> (at % WORD_BITS).astype(np.uint32)) & 1).all(axis=1)


def in_cascade(first: np.ndarray, second: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Exact membership over the universe: the first level that lacks a key decides by its parity."""
    listed = np.zeros(len(first), dtype=bool)
    left = np.arange(len(first))
    for number, level in enumerate(levels):
        present = in_level(first[left], second[left], level)
        listed[left[~present]] = number % 2 == 1
        left = left[present]
    listed[left] = len(levels) % 2 == 1
    return listed


def _build_level(keys: DataFrame, count: int, rate: float, salt: int) -> Level:
    """Bloom filter over `keys` (h1, h2), summed up in the tasks and then by word of bits."""
    per_key = max(1.0, math.log2(1 / rate))
    hashes, bits = max(1, round(per_key)), max(64, math.ceil(1.4427 * per_key * count))

    def partial(batches):
        for batch in batches:
            if batch.num_rows:
                at = positions(*(batch.column(i).to_numpy() for i in (0, 1)), salt, hashes, bits).ravel()
                places, owner = np.unique(at // WORD_BITS, return_inverse=True)
                words = np.zeros(len(places), dtype=np.uint32)
                np.bitwise_or.at(words, owner, np.uint32(1) << (at % WORD_BITS).astype(np.uint32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places.astype(np.int64)), pa.array(words.astype(np.int64))], names=["place", "word"]
                )

    rows = keys.select("h1", "h2").mapInArrow(partial, "place long, word long").groupBy("place").agg(
        F.bit_or("word").alias("word")
    ).collect()
    words = np.zeros(-(-bits // WORD_BITS), dtype=np.uint32)
    for row in rows:
        words[row["place"]] = row["word"]
    return salt, hashes, bits, words


def _member(levels: list[Level], spark: SparkSession):
    """Function on arrays of h1 and h2 that tells which keys are listed."""
    held = spark.sparkContext.broadcast(levels)

    def nested(first: pa.Array, second: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(first.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
        listed = in_cascade(first.flatten().to_numpy(), second.flatten().to_numpy(), held.value)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(listed))

    return F.arrow_udf(nested, "array<boolean>")


def _in_level_udf(level: Level, spark: SparkSession):
    held = spark.sparkContext.broadcast(level)

    def present(first: pa.Array, second: pa.Array) -> pa.Array:
        return pa.array(in_level(first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False), held.value))

    return F.arrow_udf(present, "boolean")


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 64) -> list[Level]:
    """Levels for the keys of `listed` (key) over those of `universe` (key, may repeat).

    The universe is read twice: to count its distinct keys, and for the false positives of level 0. All
    later levels work on those and on the list.
    """
    spark = listed.sparkSession
    include = stage(_hashed(listed.select("key").distinct()), "cascade_listed")
    count = include.count()
    if count == 0:
        return []
    seen = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    rate = min(0.5, count * math.sqrt(0.5) / max(seen, 1))
    levels = [_build_level(include, count, rate, 0)]
    asked = _hashed(universe.select("key"))
    wrong = asked.filter(_in_level_udf(levels[0], spark)("h1", "h2")).distinct()
    exclude = stage(wrong.join(broadcast_if_small(include.select("key")), "key", "left_anti"), "cascade_wrong")
    while len(levels) < max_levels:
        build_from = exclude if len(levels) % 2 else include
        count = build_from.count()
        if count == 0:
            return levels
        levels.append(_build_level(build_from, count, 0.5, len(levels)))
        present = _in_level_udf(levels[-1], spark)("h1", "h2")
        if len(levels) % 2:
            exclude = stage(exclude.filter(present), "cascade_wrong")
        else:
            include = stage(include.filter(present), "cascade_listed")
    raise ValueError("two keys share both hashes")


def _listed_keys(listed: Column, verdict: str, block: int, blocks: int) -> Column:
    """Of the keys in `_keys`, those flagged in `listed`, as (size, allow, key) structs."""
    own = F.filter(
        F.arrays_zip(F.col("_keys").alias("key"), listed.alias("listed")),
        lambda x: x["listed"] & (F.pmod(F.xxhash64(x["key"], F.lit(7)), F.lit(blocks)) == block),
    )
    allow = F.lit(int(verdict == "allow"))
    return F.transform(
        own, lambda x: F.struct(F.length(x["key"]).alias("size"), allow.alias("allow"), x["key"].alias("key"))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Adds host, path, rule (the key that decides, or null) and verdict.

    `rules` has host, path and verdict (`block` or `allow`). Input columns named like the added ones are
    replaced.
    """
    spark = pages.sparkSession
    prepare_python(spark)
    spaced = rules.select(F.concat("host", "path").alias("key"), "verdict", "host", "path")
    labels = spaced.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"] or 1
    lengths = sorted(r["n"] for r in spaced.select(F.length("path").alias("n")).distinct().collect())
    host, path = url_parts(url)
    placed = pages.withColumns({"_host": host, "_path": path})
    keys = candidate_keys(F.col("_host"), F.col("_path"), labels, lengths or [0])
    asked = placed.select(F.explode(keys).alias("key"))
    size = spaced.select("key").distinct().count()
    blocks = max(1, -(-size * 64 // block_bits))
    out = placed.withColumn("_keys", keys).withColumns({
        "_h1": F.transform("_keys", lambda k: F.xxhash64(k)),
        "_h2": F.transform("_keys", lambda k: F.xxhash64(k, F.lit(1))),
    })
    fits: dict[str, list[Column]] = {"block": [], "allow": []}
    for verdict, found in fits.items():
        for block in range(blocks):
            in_block = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(blocks)) == block
            levels = build_cascade(
                spaced.filter((F.col("verdict") == verdict) & in_block).select("key"), asked.filter(in_block)
            )
            if levels:
                name = f"_{verdict}{block}"
                out = out.withColumn(name, _member(levels, spark)("_h1", "_h2"))
                found.append(_listed_keys(F.col(name), verdict, block, blocks))
    found = fits["block"] + fits["allow"]
    best = F.array_max(F.flatten(F.array(*found))) if found else F.lit(None).cast("struct<size:int,allow:int,key:string>")
    held = [c for c in out.columns if c not in pages.columns]
    return out.withColumn("_best", best).withColumns({
        "host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_best")["key"],
        "verdict": F.when(F.col("_best")["allow"] == 0, "block").otherwise("allow"),
    }).drop(*held, "_best")
