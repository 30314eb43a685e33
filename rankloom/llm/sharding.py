"""Sharding along a Hilbert curve, with DataFrame functions only.

Source, language and size are quantised to `bits` bits each. Rows are put in the order of their cell's
index on the three-dimensional Hilbert curve and the order is cut into runs of equal counts, so that each
shard spans few sources, languages and sizes, and a filter on any of them skips most shards.

No row is sorted globally. Rows are counted by (cell, slice), where a slice is a hash of the row and the
number of slices follows the row count; running sums of those counts give each group's first position,
and only within a group are rows put in order. A cell with a third of all rows is as many groups as it
needs.

Defined cases: null text has 8 bytes of size and a null checksum; null source or language come last in
their dimension; repeated rows get a slot each; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.plans.joins import broadcast_if_small
from rankloom.plans.ordering import number_rows
from rankloom.llm.tables import stage

SHARDS = 24
BITS = 4
ROW_BYTES = 8
ROWS_PER_GROUP = 1_000
DIMENSIONS = 3


def _gray_entry(w: int) -> int:
    """Entry corner of the w-th sub-cube in curve order."""
    even = 2 * ((w - 1) // 2)
    return even ^ (even >> 1) if w else 0


def _direction(w: int, dims: int) -> int:
    """Axis along which the curve crosses the w-th sub-cube: trailing one bits, by Gray code."""
    if not w:
        return 0
    value, ones = (w if w % 2 else w - 1), 0
    while value & 1:
        value, ones = value >> 1, ones + 1
    return ones % dims


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Position of a grid cell on the Hilbert curve: one step for each bit, carrying (index, entry, axis)."""
    dims = len(coordinates)
    mask = (1 << dims) - 1
    rank_of_gray = {w ^ (w >> 1): w for w in range(1 << dims)}
    ranks = F.array(*[F.lit(rank_of_gray[g]) for g in range(1 << dims)])
    entries = F.array(*[F.lit(_gray_entry(w)) for w in range(1 << dims)])
    axes = F.array(*[F.lit(_direction(w, dims)) for w in range(1 << dims)])

    def rotate(value: Column, by: Column) -> Column:
        """Rotates the low `dims` bits of value left by `by`."""
        doubled = value * (1 << dims) + value
        turned = F.element_at(F.array(*[F.floor(doubled / (1 << (dims - k))).cast("int") for k in range(dims)]), by + 1)
        return turned.bitwiseAND(mask)

    def step(state: Column, level: Column) -> Column:
        corner = F.lit(0)
        for axis, value in enumerate(coordinates):
            corner = corner + F.pmod(F.floor(value / F.pow(F.lit(2), level)), F.lit(2)).cast("int") * (1 << axis)
        turn = F.pmod(state["axis"] + 1, F.lit(dims))
        local = rotate(corner.bitwiseXOR(state["entry"]), F.pmod(dims - turn, F.lit(dims)))
        rank = F.element_at(ranks, local + 1)
        return F.struct(
            (state["index"] * (1 << dims) + rank).cast("long").alias("index"),
            state["entry"].bitwiseXOR(rotate(F.element_at(entries, rank + 1), turn)).cast("int").alias("entry"),
            F.pmod(state["axis"] + F.element_at(axes, rank + 1) + 1, F.lit(dims)).cast("int").alias("axis"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("entry"), F.lit(0).alias("axis"))
    levels = F.array(*[F.lit(level) for level in reversed(range(bits))])
    return F.aggregate(levels, start, step, lambda state: state["index"])


def row_facts(text: str = "text") -> tuple[Column, Column]:
    """(size, text_crc32): UTF-8 bytes plus 8, and the unsigned checksum of the text."""
    raw = F.col(text).cast("binary")
    return (F.coalesce(F.octet_length(raw), F.lit(0)) + ROW_BYTES).cast("long"), F.crc32(raw)


def _quantised(df: DataFrame, column: str, bits: int) -> DataFrame:
    """(column, _q_column): the value's place among the distinct values, cut to 2^bits steps; null last."""
    values = stage(df.select(column).distinct().withColumn("_last", F.col(column).isNull()), f"shard_{column}")
    placed = number_rows(values, ["_last", column], "_place", f"shard_{column}_order")
    return placed.select(
        F.col(column).alias(f"_v_{column}"),
        F.floor((F.col("_place") - 1) * (1 << bits) / F.lit(max(1, values.count()))).cast("int").alias(f"_q_{column}"),
    )


def hilbert_shards(
    docs: DataFrame, shards: int = SHARDS, bits: int = BITS, rows_per_group: int = ROWS_PER_GROUP
) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (0, 1, ... in its shard); shard sizes differ by one row at most.

    `docs` has doc_id, source, lang, size and text_crc32.
    """
    with_cells = docs
    for column in ("source", "lang"):
        codes = broadcast_if_small(_quantised(docs, column, bits), 16 * 1024 * 1024)
        with_cells = with_cells.join(codes, F.col(column).eqNullSafe(F.col(f"_v_{column}"))).drop(f"_v_{column}")
    by_size = F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.col("size").cast("double")) - 3)).cast("int")
    cells = with_cells.withColumn("_q_size", F.greatest(F.lit(0), by_size))
    held = stage(
        cells.withColumn("_cell", hilbert_index([F.col("_q_source"), F.col("_q_lang"), F.col("_q_size")], bits)).drop(
            "_q_source", "_q_lang", "_q_size"
        ),
        "shard_cells",
    )
    total = held.count()
    by_cell = held.groupBy("_cell").agg(F.count("*").alias("_rows"))
    order_cells = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_starts = by_cell.select(
        "_cell", F.coalesce(F.sum("_rows").over(order_cells), F.lit(0)).alias("_cell_start"),
        F.ceil(F.col("_rows") / rows_per_group).alias("_slices"),
    )
    identity = F.xxhash64("doc_id", "text_crc32", "size")
    sliced = stage(
        held.join(F.broadcast(cell_starts), "_cell").withColumn("_slice", F.pmod(identity, F.col("_slices"))), "shard_slices"
    )
    order_slices = Window.partitionBy("_cell").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("_cell", "_slice").agg(F.count("*").alias("_rows")).select(
        "_cell", "_slice", F.coalesce(F.sum("_rows").over(order_slices), F.lit(0)).alias("_slice_start")
    )
    inside = Window.partitionBy("_cell", "_slice").orderBy("doc_id", "text_crc32", "size")
    ranked = sliced.withColumn("_inside", F.row_number().over(inside)).join(
        broadcast_if_small(starts, 16 * 1024 * 1024), ["_cell", "_slice"]
    ).withColumn("_rank", F.col("_cell_start") + F.col("_slice_start") + F.col("_inside") - 1)
    shard = F.expr(f"(_rank * {shards}L) div {max(1, total)}L").cast("int")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first).drop(
        "_cell", "_slice", "_cell_start", "_slices", "_slice_start", "_inside", "_rank"
    )


def write_shards(docs: DataFrame, path: str, text: str = "text", **options) -> None:
    """Writes whole documents as Parquet, one folder for each shard, in slot order."""
    size, crc = row_facts(text)
    rows = docs.select("doc_id", "source", "lang", size.alias("size"), crc.alias("text_crc32"), F.struct("*").alias("_row"))
    placed = hilbert_shards(rows, **options)
    (
        placed.select(F.col("shard").alias("_shard"), "slot", "_row").repartition("_shard")
        .sortWithinPartitions("_shard", "slot").select("_shard", "_row.*").write.partitionBy("_shard").parquet(path)
    )
