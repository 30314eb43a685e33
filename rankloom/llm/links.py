"""Links between rows: comparing groups block by block, and connected components of what was linked.

A group (a hash bucket, a grid cell) of any size is cut into blocks by a hash of its members. Each pair of
blocks is one small task of its own, so no task holds more than two blocks, and pairs are never rows: a
task returns, for each member with a link, the weight it is linked to and a neighbour for the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import stage

PAIRS_AT_ONCE = 100_000
LINKED = "node binary, links long, root binary"


def block_pairs(rows: DataFrame, blocks: Column, member: str) -> DataFrame:
    """Copies each row to every pair (_lo, _hi) of its group's blocks that holds its own block `_block`."""
    own = F.pmod(F.xxhash64(F.col(member), F.lit(11)), F.col("_blocks")).cast("int")
    numbered = rows.withColumn("_blocks", F.greatest(F.lit(1), blocks).cast("int")).withColumn("_block", own)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return numbered.withColumn("_other", other).withColumns(
        {"_lo": F.least("_block", "_other"), "_hi": F.greatest("_block", "_other")}
    ).drop("_other", "_blocks")


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal values in the first `keys` (integer) columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        starts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        edges = [0, *starts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(values[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def pairs_of(block: np.ndarray, crossing: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a task's members in chunks: all pairs of one block, or those across two."""
    if crossing:
        one, two = np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())
        step = max(1, PAIRS_AT_ONCE // max(1, len(two)))
        for at in range(0, len(one), step):
            part = one[at : at + step]
            yield np.repeat(part, len(two)), np.tile(two, len(part))
        return
    count = len(block)
    at = 0
    while at < count - 1:
        end = min(count - 1, at + max(1, PAIRS_AT_ONCE // (count - 1 - at)))
        sizes = count - 1 - np.arange(at, end)
        first = np.repeat(np.arange(at, end), sizes)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield first, first + 1 + np.arange(len(first)) - starts
        at = end


def local_roots(count: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Smallest index that each of `count` members reaches through the pairs."""
    roots = np.arange(count)
    while True:
        low = np.minimum(roots[first], roots[second])
        new = roots.copy()
        np.minimum.at(new, first, low)
        np.minimum.at(new, second, low)
        new = new[new]
        if np.array_equal(new, roots):
            return roots
        roots = new


class Tally:
    """Links of one task's members, added in chunks of pairs; keeps one root for each member, not the pairs."""

    def __init__(self, nodes: list[bytes], weights: np.ndarray):
        self.nodes, self.weights = nodes, weights.astype(np.float64)
        self.links, self.roots = np.zeros(len(nodes)), np.arange(len(nodes))
        self.seen = np.zeros(len(nodes), dtype=bool)

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        if not len(first):
            return
        count = len(self.nodes)
        self.links += np.bincount(first, weights=self.weights[second], minlength=count)
        self.links += np.bincount(second, weights=self.weights[first], minlength=count)
        self.seen[first] = self.seen[second] = True
        own = np.arange(count)
        self.roots = local_roots(count, np.concatenate([own, first]), np.concatenate([self.roots, second]))

    def batches(self) -> Iterator[pa.RecordBatch]:
        """A row for each member with a link: the weight linked to, and the root of its local component."""
        own = np.flatnonzero(self.seen).tolist()
        if own:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.nodes[i] for i in own], type=pa.binary()),
                    pa.array(self.links[own].astype(np.int64)),
                    pa.array([self.nodes[self.roots[i]] for i in own], type=pa.binary()),
                ],
                names=["node", "links", "root"],
            )


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (u, v); root is the smallest node reached.

    Alternates large-star and small-star steps, each an aggregation of minima and a join, until the edges
    no longer change. Every round is written to the shared folder; only a count and a checksum come back.
    """
    current = stage(edges.filter(F.col("u") != F.col("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        state = _state(current)
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        before = state
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(lowest, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v")
        current = stage(small.filter(F.col("u") != F.col("v")).distinct(), "links")
    raise ValueError(f"components did not settle in {rounds} rounds")
