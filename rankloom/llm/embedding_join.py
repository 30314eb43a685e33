"""Embedding near-duplicates by an exact pigeonhole join over subspaces.

For unit vectors, a cosine of c or more is a squared distance of 2 - 2c or less. Vectors are rotated (a
fixed random rotation, which spreads distance evenly) and split into blocks of a few dimensions. Each block
gets a share of the squared distance in proportion to its dimensions; by the pigeonhole principle, a pair
within the distance keeps within the share in one block at least.

Each block is a range join: a grid over the block's first coordinates, twice the block's radius wide,
sends a vector to its own cell and, as a guest, to the later cells within the radius. In a cell, squared
block distances come from one matrix product for each chunk; pairs within the share are checked by their
cosine over the whole vectors in double precision. A pair counts in its first block only.

Equal vectors are one class before all this. A cell of any size is cut into blocks of members (see
`links`), and pairs are never rows. The join finds every pair; no candidate is capped.

Defined cases: a vector that is null, zero, empty, or holds null or non-finite components links with
nothing; vectors of different dimensions do not link; component_id is the smallest vec_id reached, null ids
last; rows that repeat an id are vectors of their own; an empty table gives no rows; the other columns
(labels too) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.links import LINKED, Tally, block_pairs, connected_components, groups_of
from rankloom.llm.text import prepare_python
from rankloom.plans.joins import broadcast_if_small
from rankloom.llm.tables import stage

THRESHOLD = 0.9
BLOCKS = 4
GRID = 2
SLACK = 1e-9
BLOCK_ROWS = 8192
BLOCK_BYTES = 32 * 1024 * 1024
CHUNK_ROWS = 512
VERIFY_PAIRS = 50_000
BROADCAST_BYTES = 32 * 1024 * 1024
_OFFSET, _RADIX = 1 << 20, 1 << 21


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    values, triangle = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return values * np.sign(np.diag(triangle))


def block_bounds(dims: int, blocks: int) -> list[tuple[int, int]]:
    edges = [round(i * dims / min(blocks, dims)) for i in range(min(blocks, dims) + 1)]
    return list(zip(edges[:-1], edges[1:]))


def share(bound: tuple[int, int], dims: int, threshold: float) -> float:
    """Squared distance that a block may use up, with room for rounding."""
    return (2 - 2 * threshold) * (bound[1] - bound[0]) / dims * (1 + SLACK) + 1e-12


def coordinates(unit: np.ndarray, bound: tuple[int, int]) -> np.ndarray:
    """Rotated coordinates of one block. Summed dimension by dimension: a row's values don't depend on its batch."""
    turned = rotation(unit.shape[1])[:, bound[0] : bound[1]]
    out = np.zeros((len(unit), bound[1] - bound[0]))
    for dim in range(unit.shape[1]):
        out += unit[:, dim, None] * turned[dim]
    return out


def squared(difference: np.ndarray) -> np.ndarray:
    total = np.zeros(len(difference))
    for dim in range(difference.shape[1]):
        total += difference[:, dim] ** 2
    return total


def cells_of(unit: np.ndarray, bound: tuple[int, int], dims: int, threshold: float, grid: int) -> list[list[tuple[int, bool]]]:
    """For each vector its cell and the later cells within the block's radius, as (cell, guest)."""
    radius = np.sqrt(share(bound, dims, threshold))
    width = max(2 * radius, 1e-5)
    places = coordinates(unit, bound)[:, : min(grid, bound[1] - bound[0])] / width
    home = np.floor(places + 0.5).astype(np.int64)
    reach = radius / width + SLACK
    steps = list(product((-1, 0, 1), repeat=places.shape[1]))
    near = {-1: places - home + 0.5 <= reach, 0: np.ones_like(home, dtype=bool), 1: home + 0.5 - places <= reach}

    def number(cell: np.ndarray) -> np.ndarray:
        code = np.zeros(len(cell), dtype=np.int64)
        for axis in range(cell.shape[1]):
            code = code * _RADIX + cell[:, axis] + _OFFSET
        return code

    own = number(home)
    out: list[list[tuple[int, bool]]] = [[(c, False)] for c in own.tolist()]
    for step in steps:
        if step > (0,) * len(step):
            fits = np.logical_and.reduce([near[s][:, axis] for axis, s in enumerate(step)])
            codes = number(home + np.array(step))
            for row in np.flatnonzero(fits).tolist():
                out[row].append((int(codes[row]), True))
    return out


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


_PARSED = pa.struct([("key", pa.binary()), ("dims", pa.int32()), ("raw", pa.binary())])


def _parser(kind: str):
    def parse(vectors: pa.Array) -> pa.Array:
        rows = []
        for own in vectors:
            values = np.array(own.values.to_numpy(zero_copy_only=False), dtype=np.float64) if own.is_valid else np.zeros(0)
            if not len(values) or not np.isfinite(values).all() or not values.any():
                rows.append({"key": None, "dims": None, "raw": None})
                continue
            if kind == "<f8":  # keeps squares of very large or small components in range; the cosine stays
                values = values / 2.0 ** np.floor(np.log2(np.abs(values).max()))
            raw = (values + 0.0).astype(kind).tobytes()
            rows.append({"key": xxhash.xxh3_128_digest(raw), "dims": len(values), "raw": raw})
        return pa.array(rows, type=_PARSED)

    return parse


def _read(column: pa.ChunkedArray, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dims).astype(np.float64)


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, grid: int = GRID,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    prepare_python(spark)
    kind = "<f8" if isinstance(vectors.schema[embedding].dataType.elementType, T.DoubleType) else "<f4"
    parsed = stage(
        vectors.select(F.col(vec_id).alias("vec_id"), F.arrow_udf(
            _parser(kind), "struct<key: binary, dims: int, raw: binary>")(F.col(embedding)).alias("p")
        ).select("vec_id", "p.*"),
        "vectors",
    )
    classes = stage(
        parsed.filter(F.col("key").isNotNull()).groupBy("key").agg(
            F.count("*").alias("members"), F.min("vec_id").alias("first_id"), F.first("dims").alias("dims"), F.first("raw").alias("raw")
        ).withColumnRenamed("key", "node"),
        "vector_classes",
    )

    def place(raws: pa.Array) -> pa.Array:
        values = [np.frombuffer(b, dtype=kind).astype(np.float64) for b in raws.to_pylist()]
        out: list[list[dict]] = [[] for _ in values]
        sizes = np.array([len(v) for v in values])
        for dims in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dims)
            unit = unit_rows(np.stack([values[i] for i in rows]))
            for number, bound in enumerate(block_bounds(dims, blocks)):
                for row, cells in zip(rows.tolist(), cells_of(unit, bound, dims, threshold, grid)):
                    out[row] += [{"block": number, "cell": cell, "guest": guest} for cell, guest in cells]
        return pa.array(out, type=pa.list_(pa.struct([("block", pa.int32()), ("cell", pa.int64()), ("guest", pa.bool_())])))

    placing = F.arrow_udf(place, "array<struct<block: int, cell: bigint, guest: boolean>>")
    spots = stage(
        classes.select("node", "dims", F.explode(placing("raw")).alias("s")).select("node", "dims", "s.*"), "vector_cells"
    )
    crowded = stage(
        spots.groupBy("block", "dims", "cell").agg(
            F.count("*").alias("rows"), F.sum(F.when(F.col("guest"), 0).otherwise(1)).alias("homes")
        ).filter("rows > 1 and homes > 0"),
        "vector_crowded",
    )
    small = broadcast_if_small(crowded, BROADCAST_BYTES)
    held = spots.join(small, ["block", "dims", "cell"]).join(classes.select("node", "members", "raw"), "node")
    parts = F.greatest(
        F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("rows") * F.col("dims") * 8 / BLOCK_BYTES)
    )
    keys = ["block", "dims", "cell", "_lo", "_hi"]
    dealt = block_pairs(held, parts, "node").select(*keys, "_block", "guest", "node", "members", "raw").repartition(
        *keys
    ).sortWithinPartitions(*keys, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 5):
            number, dims, low, high = (group.column(i)[0].as_py() for i in (0, 1, 3, 4))
            vectors = _read(group.column("raw"), kind, dims)
            tally = Tally(group.column("node").to_pylist(), group.column("members").to_numpy())
            guest = group.column("guest").to_numpy()
            own_block = group.column("_block").to_numpy()
            for first, second in linked_pairs(vectors, guest, own_block if low != high else None, number, threshold, blocks):
                tally.add(first, second)
            yield from tally.batches()

    links = stage(dealt.mapInArrow(compare, LINKED), "vector_links")
    roots = connected_components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("node").agg(F.sum("links").alias("linked"))
    linked = stage(classes.select("node", "members", "first_id").join(counted, "node").join(roots, "node"), "vector_linked")
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("component"))
    together = linked.join(lowest, "root").select("node", "members", "linked", "component")
    copies = classes.filter("members > 1").join(linked.select("node"), "node", "left_anti").select(
        "node", "members", F.lit(0).cast("long").alias("linked"), F.col("first_id").alias("component")
    )
    grouped = stage(together.unionByName(copies), "vector_grouped").withColumnRenamed("node", "key")
    out = parsed.select("vec_id", "key").join(broadcast_if_small(grouped, BROADCAST_BYTES), "key", "left")
    alone = F.col("members").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        "vec_id",
        F.when(alone, F.lit(0)).otherwise(F.col("members") - 1 + F.col("linked")).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def linked_pairs(
    vectors: np.ndarray, guest: np.ndarray, crossing: np.ndarray | None, number: int, threshold: float, blocks: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of one task that first keep within the share in block `number`; never two guests.

    `crossing` has the member block of each row if pairs across two blocks are asked for.
    """
    dims = vectors.shape[1]
    bounds = block_bounds(dims, blocks)
    limit = share(bounds[number], dims, threshold)
    unit, norms = unit_rows(vectors), np.sqrt((vectors * vectors).sum(axis=1))
    places = coordinates(unit, bounds[number])
    half = (places * places).sum(axis=1)[:, None] / 2
    ones = np.ones_like(half)
    left = np.hstack([places, -half, ones]).astype(np.float32)
    right = np.hstack([places, ones, -half]).astype(np.float32)
    bar = np.float32(-(limit + 1e-5) / 2)
    homes, guests = np.flatnonzero(~guest), np.flatnonzero(guest)
    if crossing is None:
        sides = [(homes, homes, True), (homes, guests, False)]
    else:
        one, two = crossing == crossing.min(), crossing != crossing.min()
        sides = [(homes[one[homes]], np.flatnonzero(two), False), (guests[one[guests]], homes[two[homes]], False)]
    for rows, others, same in sides:
        for at in range(0, len(rows), CHUNK_ROWS):
            part = rows[at : at + CHUNK_ROWS]
            facing = others[at:] if same else others
            flat = np.flatnonzero((left[part] @ right[facing].T).ravel() >= bar)
            first, second = part[flat // max(1, len(facing))], facing[flat % max(1, len(facing))]
            if same:
                later = first < second
                first, second = first[later], second[later]
            for pair in range(0, len(first), VERIFY_PAIRS):
                a, b = first[pair : pair + VERIFY_PAIRS], second[pair : pair + VERIFY_PAIRS]
                near = squared(places[a] - places[b]) <= limit
                a, b = a[near], b[near]
                cosine = (vectors[a] * vectors[b]).sum(axis=1) / (norms[a] * norms[b])
                a, b = a[cosine >= threshold], b[cosine >= threshold]
                for earlier in range(number):
                    if len(a):
                        own, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                        turned = coordinates(unit[own], bounds[earlier])
                        met = squared(turned[back[: len(a)]] - turned[back[len(a) :]]) <= share(bounds[earlier], dims, threshold)
                        a, b = a[~met], b[~met]
                if len(a):
                    yield a, b
