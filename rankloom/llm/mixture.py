"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each source gets a token target. Whole epochs of a source come first; what is left of its target is a
fraction of one epoch, filled in the order of exponential keys -ln(u) / weight, so that a document of
higher quality weight tends to come first. u is a hash of the document id: reruns agree.

No source is sorted as a whole. Keys are cut into intervals whose number follows the row count; sums by
(source, interval) say which interval holds the end of the budget, and only its documents are put in
order. A source with a third of all rows is thus spread over as many groups as its rows need.

Defined cases: null text has size 0; a null source is a source, the last one; null ids hash as the empty
string; rows that repeat an id are separate documents with the same key; documents of size 0 are never
taken; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.plans.joins import broadcast_if_small
from rankloom.plans.ordering import number_rows, running_total
from rankloom.llm.tables import stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
ROWS_PER_INTERVAL = 2_000
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}


def word_count(text: str = "text") -> Column:
    """Runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: int, doc_id: str = "doc_id") -> Column:
    """In (0, 1), from the first 13 hexadecimal digits of an md5 of the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS
) -> DataFrame:
    """(source, weight, source_size, target) from (source, size).

    Sources in code-point order, null last, take the weights in turn. The budget is `share` of all sizes.
    A target stops at `most` times its source's size; what it leaves is shared out anew by weight. Sources
    reach their stop in the order of size to weight, so running totals in that order find all that do.
    """
    totals = stage(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull()),
        "mix_sources",
    )
    ordered = number_rows(totals, ["last", "source"], "place", "mix_order").withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                               (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    listed = stage(
        ordered.withColumn("stop", F.col("source_size") * float(most)).withColumn("ratio", F.col("stop") / F.col("weight")),
        "mix_weights",
    )
    whole = listed.agg(F.sum("weight").alias("w"), F.sum("source_size").alias("s")).first()
    all_weight, budget = whole["w"] or 0.0, share * float(whole["s"] or 0)
    order = ["ratio", "place"]
    before = running_total(listed, [], order, "weight", "mix_w").withColumnRenamed("before", "weight_before")
    before = running_total(before, [], order, "stop", "mix_s").withColumnRenamed("before", "stop_before")
    stopped = stage(
        before.withColumn("stopped", F.col("stop") * (all_weight - F.col("weight_before"))
                          <= F.col("weight") * (budget - F.col("stop_before"))),
        "mix_stops",
    )
    rest = stopped.agg(
        F.sum(F.when(F.col("stopped"), F.col("stop")).otherwise(0.0)).alias("stop"),
        F.sum(F.when(~F.col("stopped"), F.col("weight")).otherwise(0.0)).alias("weight"),
    ).first()
    level = max(0.0, budget - (rest["stop"] or 0.0)) / rest["weight"] if rest["weight"] else 0.0
    return stopped.select(
        "source", "weight", "source_size",
        F.when(F.col("stopped"), F.col("stop")).otherwise(F.least(F.col("stop"), F.col("weight") * level)).alias("target"),
    )


def _joined(docs: DataFrame, by_source: DataFrame) -> DataFrame:
    """Null-safe join on the source; the table of sources is broadcast when it is counted to be small."""
    renamed = broadcast_if_small(by_source.withColumnRenamed("source", "_source"), 16 * 1024 * 1024)
    return docs.join(renamed, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(
    docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
    most: float = MOST_EPOCHS, rows_per_interval: int = ROWS_PER_INTERVAL,
) -> DataFrame:
    """Adds source_size, target, times (copies taken) and taken (size x times).

    `docs` has doc_id, source, size and weight (the quality weight, above 0); other columns pass through.
    A document on the edge of its source's budget is taken if that brings the sum nearer to the target.
    Equal keys are put in the order of id and size; rows equal in both are interchangeable.
    """
    held = stage(docs, "mix_docs", "snappy")
    targets = stage(source_targets(held.select("source", "size"), weights, share, most), "mix_targets")
    counted = held.agg(F.count("*").alias("rows"), F.avg("weight").alias("weight")).first()
    intervals, usual = 64, counted["weight"] or 1.0
    while intervals * rows_per_interval < counted["rows"]:
        intervals *= 2
    key = -F.log(uniform(seed)) / F.col("weight")
    keyed = held.withColumn("_key", key).withColumn(
        "_interval", F.least(F.lit(intervals - 1), F.floor((1 - F.exp(-F.col("_key") * usual)) * intervals)).cast("int")
    )
    sums = keyed.groupBy("source", "_interval").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_interval").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    plan = _joined(starts, targets).withColumn(
        "_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0))
    ).withColumn("_left", F.greatest(F.lit(0.0), F.col("target") - F.col("_epochs") * F.col("source_size")))
    edges = stage(
        plan.groupBy("source").agg(
            F.first("source_size").alias("source_size"), F.first("target").alias("target"),
            F.first("_epochs").alias("_epochs"), F.first("_left").alias("_left"),
            F.max(F.when(F.col("_start") <= F.col("_left"), F.struct("_interval", "_start"))).alias("_edge"),
        ),
        "mix_edges",
    )
    placed = _joined(keyed, edges)
    at_edge = F.col("_interval") == F.col("_edge")["_interval"]
    inside = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge_docs = placed.filter(at_edge).withColumn(
        "_before", F.col("_edge")["_start"] + F.coalesce(F.sum("size").over(inside), F.lit(0))
    ).withColumn("_extra", (F.col("_before") + F.col("size") / 2 <= F.col("_left")).cast("int"))
    others = placed.filter(~at_edge).withColumn("_before", F.lit(0).cast("long")).withColumn(
        "_extra", (F.col("_interval") < F.col("_edge")["_interval"]).cast("int")
    )
    both = edge_docs.unionByName(others).withColumn(
        "times", F.when(F.col("size") > 0, F.col("_epochs") + F.col("_extra")).otherwise(0).cast("long")
    )
    return both.withColumn("taken", F.col("times") * F.col("size")).drop(
        "_key", "_interval", "_edge", "_epochs", "_left", "_before", "_extra"
    )


def quality_weights(docs: DataFrame, labels: DataFrame, weights: dict[int, float] = QUALITY_WEIGHTS) -> DataFrame:
    """Adds weight: that of the document's quality label, the lowest of several, or 1 without a label."""
    by_doc = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_labelled")).agg(
        F.min("quality").alias("_quality")
    )
    of_label = F.coalesce(*[F.when(F.col("_quality") == q, F.lit(w)) for q, w in weights.items()], F.lit(1.0))
    labelled = docs.join(broadcast_if_small(by_doc), F.col("doc_id") == F.col("_labelled"), "left")
    return labelled.withColumn("weight", of_label).drop("_labelled", "_quality")


def mixed_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of `docs`, with its own columns, as often as it is taken.

    Rows travel as one struct, so that no column of theirs meets one of the mix.
    """
    rows = docs.select("doc_id", "source", word_count().alias("size"), F.struct("*").alias("_row"))
    taken = mix(quality_weights(rows, labels), **options).filter(F.col("times") > 0)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("_row.*")
