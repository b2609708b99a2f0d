"""Mixing sources to target weights.

Tokens (words) are summed per source, every source gets a target, and the repetition rate of a source is its target over
its size. A document is emitted floor(rate) times, and once more with probability rate - floor(rate), decided by a hash of
a seed and the document's id; reruns agree, whatever the partitioning.

Independent draws miss the target where few long texts hold a source's words. So every source has DRAWS seeds, all of them are
tried in one aggregation, and the source takes the one whose words come nearest its target (the first of equals). Every document's
draw stays a Bernoulli draw by its hash; among DRAWS sums of a spread s, the nearest is some s / DRAWS away.

Targets share the total of all sizes by weight. No target exceeds `max_repeats` times its source's size: the excess is
shared again among the rest by weight until none is above. That fixed point is min(cap, level * weight) with one level for
all sources, found by sorting sources on cap / weight and prefix sums over the table of sources.

Defined results: a null text has size 0; null is a source of its own, and the last; a source without words has target 0 and
its documents are emitted floor(0) = 0 times; repeated rows share the decision of their id, and rows without an id that of their text;
an empty table gives an empty result; columns of the input named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Up to so many sources the table of targets is sent to every executor; beyond, a shuffled join takes its place.
BROADCAST_SOURCES = 50_000

#: Seeds that every source tries.
DRAWS = 64

ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def cyclic_weights(rank: Column, cycle: int = 3) -> Column:
    """1, 2, ... cycle, repeating, by the rank (from 0) of a source."""
    return F.pmod(rank, F.lit(cycle)) + 1


def targets(sizes: DataFrame, max_repeats: int = 3, weights=cyclic_weights) -> DataFrame:
    """sizes(source, source_size) with one row per source -> the same with target."""
    null_last = F.col("source").asc_nulls_last()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(null_last)) - 1)
    ranked = ranked.withColumn("weight", weights(F.col("rank")).cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    # Sources in the order in which a rising level reaches their caps.
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    upto, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.select(
        "source", "source_size", "rank", "weight", "cap",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(upto), F.lit(0)).alias("capped"),
        F.sum("weight").over(after).alias("open"),
    ).withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("open"))
    # The level is the one at the first source that it leaves below its cap.
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)
    return level.withColumn("final", first["level"]).select(
        "source", "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0))
        .otherwise(F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double"))))
        .alias("target"),
    )


def _once_more(seed: int, draw: Column, doc_id: Column, text_key: Column, share: Column) -> Column:
    """1 if the draw emits the document once more."""
    return (common.unit_hash(F.lit(seed), draw, F.coalesce(doc_id.cast("string"), text_key)) < share).cast("int")


def _rate(target: Column, size: Column) -> Column:
    return F.when(size > 0, target / size).otherwise(F.lit(0.0))


def plan(sized: DataFrame, max_repeats: int = 3, seed: int = 7, weights=cyclic_weights) -> DataFrame:
    """sized(source, doc_id, text_key, size) -> source, source_size, target, rate, draw: a row for every source."""
    spark = sized.sparkSession
    wanted = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeats, weights).withColumn("rate", _rate(F.col("target"), F.col("source_size")))
    wanted = common.materialize(wanted, "targets")
    rows = wanted.limit(BROADCAST_SOURCES + 1).collect()
    side = F.broadcast(spark.createDataFrame(rows, wanted.schema)) if len(rows) <= BROADCAST_SOURCES else wanted
    side = side.withColumnRenamed("source", "of")
    drawn = sized.join(side, F.col("source").eqNullSafe(F.col("of")))
    share = F.col("rate") - F.floor("rate")
    sums = drawn.groupBy("of").agg(*[F.sum(F.col("size") * _once_more(seed, F.lit(k), F.col("doc_id"), F.col("text_key"), share)).alias(f"d{k}") for k in range(DRAWS)])
    both = wanted.join(sums, F.col("source").eqNullSafe(F.col("of")))
    rest = F.col("target") - F.floor("rate") * F.col("source_size")
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"d{k}") - rest).alias("off"), F.lit(k).alias("draw")) for k in range(DRAWS)]))
    return both.select("source", "source_size", "target", "rate", nearest["draw"].alias("draw"))


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def copies(docs: DataFrame, max_repeats: int = 3, seed: int = 7, weights=cyclic_weights) -> DataFrame:
    """Every document with size, source_size, target, rate, copies and taken (words that its copies hold)."""
    spark = docs.sparkSession
    base = docs.drop(*ADDED)
    # Text and id are read once for the plan: a narrow table of sizes takes their place.
    narrow = base.select(F.col("source"), F.col("doc_id"), F.when(F.col("doc_id").isNull(), _text_key(F.col("text"))).alias("text_key"), common.words_in(F.col("text")).alias("size"))
    chosen = common.materialize(plan(common.materialize(narrow, "sizes"), max_repeats, seed, weights), "plan")
    rows = chosen.limit(BROADCAST_SOURCES + 1).collect()
    small = len(rows) <= BROADCAST_SOURCES
    side = F.broadcast(spark.createDataFrame(rows, chosen.schema)) if small else chosen
    key, draw = "source_" + "_".join(base.columns), "draw_" + "_".join(base.columns)  # no names of docs
    side = side.withColumnRenamed("source", key).withColumnRenamed("draw", draw)
    joined = base.withColumn("size", common.words_in(F.col("text"))).join(side, F.col("source").eqNullSafe(F.col(key)), "inner")
    again = _once_more(seed, F.col(draw), F.col("doc_id"), _text_key(F.col("text")), F.col("rate") - F.floor("rate"))
    return (
        joined.withColumn("copies", F.floor("rate").cast("int") + again)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*base.columns, *ADDED)
    )


def mix(docs: DataFrame, max_repeats: int = 3, seed: int = 7, weights=cyclic_weights) -> DataFrame:
    """The mixed corpus: the columns of docs, a row for every copy, numbered from 0 in copy_index."""
    numbered = copies(docs, max_repeats, seed, weights).filter("copies > 0")
    kept = [c for c in docs.columns if c != "copy_index"]
    return numbered.select(*kept, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy_index"))
