"""Latency analytics: nearest-rank percentiles, verdicts, marker correlation, running windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: samples in the running window.
RING = 100


def nearest_rank(column: str, q: float) -> Column:
    """The value of rank ceil(q n), at least 1."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def probe_percentile(samples: DataFrame, q: float, by: str = "class", value: str = "value") -> DataFrame:
    """The other rule: the value of index round((n - 1) q), half away from zero.  Ranks are counted per distinct value, so no class is gathered."""
    counts = samples.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_ = F.sum("_n").over(Window.partitionBy(by))
    at = F.round((all_ - 1) * q).cast("long")
    ranked = counts.withColumns({"_before": before, "_at": at}).where("_at >= _before and _at < _before + _n")
    return ranked.select(by, F.col(value).alias(f"p{int(q * 100)}"))


def summary(samples: DataFrame, by: str = "class", value: str = "value") -> DataFrame:
    return samples.groupBy(by).agg(
        F.count("*").alias("n"), F.min(value).alias("least"), *(nearest_rank(value, q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)), F.max(value).alias("most"), F.avg(value).alias("mean")
    )


def verdict(samples: DataFrame, budget: float, by: str = "class", value: str = "value", censored: str = "censored") -> DataFrame:
    """A group passes if its p95 is within the budget and nothing in it was censored."""
    sums = samples.groupBy(by).agg(nearest_rank(value, 0.95).alias("p95"), F.sum(F.col(censored).cast("int")).cast("long").alias("n_censored"))
    return sums.withColumn("verdict", F.when(F.col("n_censored") > 0, "CENSORED").when(F.col("p95") <= budget, "PASS").otherwise("FAIL"))


def correlate(markers: DataFrame) -> DataFrame:
    """Per generation: first final results, the first applied after it, the first present event after that."""
    results = markers.where("name = 'results' and final").groupBy("gen").agg(F.min("ts").alias("results_ts"))
    applied = markers.where("name = 'applied'").select("gen", F.col("ts").alias("a"))
    first = results.join(applied, "gen", "left").groupBy("gen", "results_ts").agg(F.min(F.when(F.col("a") > F.col("results_ts"), F.col("a"))).alias("applied_ts"))
    present = markers.where("name = 'results'").select("gen", F.col("ts").alias("p"))
    return first.join(present, "gen", "left").groupBy("gen", "results_ts", "applied_ts").agg(F.min(F.when(F.col("p") > F.col("applied_ts"), F.col("p"))).alias("present_ts"))


#: Orders to a block when running windows are taken in pieces.
BLOCK_SAMPLES = 100_000


def running(samples: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Mean and greatest of the last RING samples at each sample; order is a number, other for each sample of a class.

    A class is cut into blocks of its order.  A block is also given the earlier
    blocks that hold the RING - 1 samples before it, mostly one, so that no
    class fills a task.
    """
    block = F.floor(F.col(order) / BLOCK_SAMPLES)
    by_block = Window.partitionBy(by).orderBy("_block")
    counts = samples.groupBy(by, block.alias("_block")).agg(F.count("*").alias("_n")).withColumn("_end", F.sum("_n").over(by_block))
    counts = counts.withColumn("_next", F.collect_list(F.struct("_block", (F.col("_end") - F.col("_n")).alias("start"))).over(by_block.rowsBetween(1, RING - 1)))
    wanted = F.transform(F.filter("_next", lambda x: x["start"] - (RING - 1) < F.col("_end")), lambda x: x["_block"])
    dealt = counts.select(by, "_block", F.explode(F.concat(F.array("_block"), wanted)).alias("_to"))
    w = Window.partitionBy(by, "_to").orderBy(order).rowsBetween(-(RING - 1), 0)
    out = samples.withColumn("_block", block).join(dealt, [by, "_block"])
    out = out.withColumn("ring_mean", F.avg(value).over(w)).withColumn("ring_most", F.max(value).over(w)).withColumn("ring_n", F.count("*").over(w))
    return out.where("_to = _block").select(*samples.columns, "ring_mean", "ring_most", "ring_n")


#: Generations to a block when running minima are taken over all of them.
BLOCK_GENERATIONS = 10_000


def one_shot(keydown: DataFrame, applied: DataFrame) -> DataFrame:
    """gen, latency: a keydown meets the first applied of its generation, unless a later generation was applied before.

    The least time of all later generations is taken within blocks of them, and
    over the blocks' own minima.
    """
    block = F.floor(F.col("gen") / BLOCK_GENERATIONS)
    first = applied.groupBy("gen").agg(F.min("ts").alias("applied_ts")).withColumn("_block", block)
    newer = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = first.groupBy("_block").agg(F.min("applied_ts").alias("_least"))  # a row a block
    later = blocks.select("_block", F.min("_least").over(newer(Window.orderBy(F.desc("_block")))).alias("_later"))
    within = F.min("applied_ts").over(newer(Window.partitionBy("_block").orderBy(F.desc("gen"))))
    live = first.withColumn("_within", within).join(later, "_block").withColumn("_before", F.least("_within", "_later"))
    live = live.where("_before is null or _before > applied_ts").select("gen", "applied_ts")
    return keydown.groupBy("gen").agg(F.min("ts").alias("key_ts")).join(live, "gen").select("gen", (F.col("applied_ts") - F.col("key_ts")).alias("latency"))


def frame_gaps(events: DataFrame) -> DataFrame:
    """Per hidden interval that ended in a show: its duration, ticks, longest gap, and how long the first frame took after the show.

    events: source, ts, event ('hide', 'show', 'tick').  A gap runs from the
    last tick, also one from before the hide, and the last one is still open at
    the show; without any tick it is the whole interval.  first_delay is null if
    the next hide came before a frame.
    """
    by = Window.partitionBy("source").orderBy("ts", "event")
    to_here = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_ = lambda kind: F.col("event") == kind
    marked = events.withColumns({
        "interval": F.sum(F.when(is_("hide"), 1).otherwise(0)).over(to_here),
        "_tick": F.last(F.when(is_("tick"), F.col("ts")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)),
    }).where("interval > 0")
    inside = Window.partitionBy("source", "interval")
    whole = marked.withColumns({"_hide": F.min(F.when(is_("hide"), F.col("ts"))).over(inside), "_show": F.min(F.when(is_("show"), F.col("ts"))).over(inside)}).where("_show is not null")
    hidden = (F.col("ts") > F.col("_hide")) & (F.col("ts") <= F.col("_show"))
    gap = F.when(hidden & is_("tick") & (F.col("ts") < F.col("_show")), F.col("ts") - F.col("_tick")).when(is_("show") & (F.col("ts") == F.col("_show")), F.col("ts") - F.coalesce("_tick", "_hide"))
    return whole.groupBy("source", "interval").agg(
        (F.first("_show") - F.first("_hide")).alias("duration"), F.sum(F.when(hidden & is_("tick") & (F.col("ts") < F.col("_show")), 1).otherwise(0)).alias("ticks"), F.max(gap).alias("max_gap"),
        (F.min(F.when(is_("tick") & (F.col("ts") > F.col("_show")), F.col("ts"))) - F.first("_show")).alias("first_delay"),
    )
