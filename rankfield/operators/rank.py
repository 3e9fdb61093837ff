"""Search, top pages, usage boosts, and weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.functions.match import may_match, rank_factor, tier_name, tier_score
from rankfield.functions.scalar import url_for
from rankfield.functions.text import class_mask, fold_text, fold_unicode, mask_of

#: The page a caller may ask for, and how long usage takes to halve.
LEAST_PAGE, MOST_PAGE = 1, 512
USAGE_WEIGHT, USAGE_HALF, USAGE_DAYS = 0.09, 2.0, 7.0
#: Prefixes of paths that weigh 0.6.
LOW_PATHS = ("/windows/winsxs/", "/windows/servicing/", "/windows/assembly/", "/$recycle.bin/", "/system volume information/")
LOW_WEIGHT = 0.6
#: A bound command's lift, the provider's base, the calculator's score.
BAND_LIFT, FALLBACK_BASE, CALCULATOR_SCORE = 0.5, 0.5, 2.0
#: Rows per catalog after re-ranking, out of a pool POOL times as large.
CATALOG_CAPS = {"app": 8, "setting": 4, "command": 3, "window": 5}
POOL = 8


def scored(entries: DataFrame, q: Column | str) -> DataFrame:
    """entries (folded, lane, depth, flags, perhaps mask) with base, tier and score; those that do not match q, already folded, are left out.

    Where entries have a class mask it stands before the tiers, and loses no match.
    """
    if "mask" in entries.columns:
        entries = entries.where(may_match(F.col("mask"), F.lit(mask_of(q)) if isinstance(q, str) else class_mask(q)))
    hit = entries.withColumn("base", tier_score(F.col("folded"), F.col("lane"), q)).where("base is not null")
    return hit.withColumn("tier", tier_name(F.col("base"))).withColumn("score", F.col("base") * rank_factor(F.col("depth"), F.col("flags")))


def page(rows: DataFrame, k: int, *ties: str | Column) -> DataFrame:
    """The k best by score, ties by the given columns; k is brought within LEAST_PAGE and MOST_PAGE."""
    return rows.orderBy(F.desc("score"), *ties).limit(max(LEAST_PAGE, min(MOST_PAGE, k)))


def pages(rows: DataFrame, by: str | list[str], k: int | Column, *order: str | Column) -> DataFrame:
    """The k best of each group, with their place; Spark keeps k rows a group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def search(entries: DataFrame, q: str, k: int = 32) -> DataFrame:
    """The page of one query, in any case and normalisation."""
    return page(scored(entries, fold_text(q)), k, "frn")


def batch_search(entries: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Pages of many queries (qid, q) in one pass over entries.

    The queries are the broadcast side of a loop join over QUERIES_AT_ONCE of
    them; where there are more, blocks of that size go over entries in turn.
    """
    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    own = queries.select("qid", fold_unicode(F.col("q")).alias("q")).withColumns({"_mask": class_mask(F.col("q")), "_block": F.pmod(F.xxhash64("qid"), F.lit(blocks))})
    out = []
    for n in range(blocks):
        asked = F.broadcast(own.where(F.col("_block") == n).drop("_block"))
        crossed = entries.join(asked, (F.col("q") != "") & (may_match(F.col("mask"), F.col("_mask")) if "mask" in entries.columns else F.lit(True)))
        out.append(pages(scored(crossed.drop("mask", "_mask"), F.col("q")), "qid", k, F.desc("score"), "frn"))
    return reduce(DataFrame.unionByName, out)


QUERIES_AT_ONCE = 10_000


def usage(launches: DataFrame) -> DataFrame:
    """id, count, last_ts, kind: launches by id."""
    return launches.groupBy("id").agg(F.count("*").alias("count"), F.max("ts").alias("last_ts"), F.max_by("kind", F.struct("ts", "kind")).alias("kind"))


def usage_bonus(count: Column, last: Column, now: Column | int) -> Column:
    """At most USAGE_WEIGHT; halves every USAGE_DAYS in effect.  last and now are in seconds."""
    now = now if isinstance(now, Column) else F.lit(now)
    f = count * F.pow(F.lit(0.5), F.greatest(F.lit(0), now - last) / (USAGE_DAYS * 86400))
    return F.coalesce(USAGE_WEIGHT * f / (f + USAGE_HALF), F.lit(0.0))


def with_usage(rows: DataFrame, used: DataFrame, now: int, key: str = "id") -> DataFrame:
    """Adds bonus; ids never launched have none."""
    found = used.select(F.col("id").alias(key), F.col("count").alias("_n"), F.col("last_ts").alias("_t"))
    return rows.join(found, key, "left").withColumn("bonus", usage_bonus(F.col("_n"), F.col("_t"), now)).drop("_n", "_t")


def rerank(rows: DataFrame, cap: int, *ties: str | Column) -> DataFrame:
    """Of the POOL * cap best by score and ties, the cap best by score and bonus; equal sums keep their order."""
    first = F.row_number().over(Window.orderBy(F.desc("score"), *ties))
    pool = rows.orderBy(F.desc("score"), *ties).limit(POOL * cap).withColumn("_before", first)
    return pool.withColumn("total", F.col("score") + F.col("bonus")).orderBy(F.desc("total"), "_before").limit(cap).drop("_before")


def path_weight(path: Column) -> Column:
    """LOW_WEIGHT for system folders, told from the path's first slash on."""
    plain = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    tail = F.when(F.instr(plain, "/") > 0, F.substr(plain, F.instr(plain, "/"))).otherwise("")
    low = F.lit(False)
    for p in LOW_PATHS:
        low = low | F.startswith(tail, F.lit(p))
    return F.when(low, LOW_WEIGHT).otherwise(1.0)


def file_key(volume: Column, frn: Column) -> Column:
    """What usage of a file is kept under."""
    return F.concat_ws(":", volume.cast("string"), frn.cast("string"))


def file_batch(page_: DataFrame, used: DataFrame, now: int) -> DataFrame:
    """A page of files (volume_idx, frn, path, score, pos) with usage added to score, best first, equal ones as they stood; and display, what the list sorts by."""
    keyed = page_.withColumn("_key", file_key(F.col("volume_idx"), F.col("frn")))
    own = with_usage(keyed, used, now, "_key").withColumn("score", F.col("score") + F.col("bonus"))
    out = own.withColumn("display", F.col("score") * path_weight(F.col("path"))).drop("_key", "bonus")
    return out.orderBy(F.desc("score"), "pos")


def fallback_rows(names: DataFrame) -> DataFrame:
    """Rows of another program's search, which has no scores of its own; path is what their usage is kept under."""
    return names.withColumns({"score": F.lit(FALLBACK_BASE), "id": F.col("path")})


def calculator_row(display: Column, copy: Column) -> Column:
    """The calculator's answer as a row of the list, above all others."""
    return F.struct(F.lit("calc").alias("kind"), F.lit("calc").alias("key"), display.alias("name"), copy.alias("subtitle"), F.lit(CALCULATOR_SCORE).alias("score"))


#: Kinds and actions that count as a launch.
LAUNCHES = {"app": ("open", "runas"), "command": ("open",), "setting": ("open",), "window": ("open", "switch"), "file": ("open",)}


def counts_as_launch(kind: Column, action: Column) -> Column:
    out = F.lit(False)
    for k, actions in LAUNCHES.items():
        out = out | ((kind == k) & action.isin(*actions))
    return out


def band(base: Column, direct: Column, threshold: float) -> Column:
    """A command's score, lifted if its own name reaches the threshold."""
    return base + F.when(direct >= threshold, BAND_LIFT).otherwise(0.0)


def survivors_by_depth(entries: DataFrame, q: str) -> DataFrame:
    """How many entries hold all of the query's classes of bytes, by depth, and how many up to each depth."""
    found = entries.where(may_match(F.col("mask"), F.lit(mask_of(fold_text(q))))).groupBy("depth").agg(F.count("*").alias("n"))
    return found.withColumn("up_to", F.sum("n").over(Window.orderBy("depth")))  # at most a row a depth


def with_metadata(page_: DataFrame, files: DataFrame) -> DataFrame:
    """A page with size and mtime of each file; null where they are not known."""
    return page_.join(files.select("frn", "size", "mtime"), "frn", "left")


#: Fixed value: topics that can be listened to.
TOPICS = ("index.progress", "index.state", "config.changed")


def delivered(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events (topic, payload, ts) for each subscriber (client, topic, since): those of its topics from then on; unknown topics have none."""
    own = subscriptions.where(F.col("topic").isin(*TOPICS)).distinct()
    return events.join(own, "topic").where("ts >= since").select("client", "topic", "payload", "ts")


def web_rows(queries: DataFrame, best: DataFrame, engines: list[tuple[str, str]], threshold: float) -> DataFrame:
    """Rows that offer a search of the web for queries (qid, q) of which no row (qid, score) reaches the threshold; engines: names and address templates."""
    top = best.groupBy("qid").agg(F.max("score").alias("_top"))
    poor = queries.where(F.trim("q") != "").join(top, "qid", "left").where(F.coalesce("_top", F.lit(0.0)) < threshold).drop("_top")
    offers = F.array(*(F.struct(F.lit(n).alias("engine"), url_for(F.lit(t), F.col("q")).alias("url"), F.lit(k).alias("place")) for k, (n, t) in enumerate(engines)))
    return poor.select("qid", "q", F.explode(offers).alias("o")).select("qid", "q", "o.*")
