"""The clipboard history: capture rules, dedup, retention, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.functions import shellmatch

#: Bytes of a clip, characters of its preview, days and rows kept, rows searched.
MOST_BYTES, PREVIEW, KEEP_DAYS, KEEP_ROWS, SEARCHED = 1 << 20, 200, 30, 10_000, 1000


#: A format that asks not to be remembered by being there, and two that do by being zero.
EXCLUDING, CONSENTS = "ExcludeClipboardContentFromMonitorProcessing", ("CanIncludeInClipboardHistory", "CanUploadToCloudClipboard")


def remembered(formats: Column) -> Column:
    """Whether what was copied may be kept; formats: a map from each format that is there to its number, null where it has none."""
    there = F.coalesce(F.map_contains_key(formats, EXCLUDING), F.lit(False))
    denied = F.lit(False)
    for c in CONSENTS:
        denied = denied | F.coalesce(F.element_at(formats, F.lit(c)) == 0, F.lit(False))
    return ~there & ~denied


def capturable(text: Column) -> Column:
    return (F.trim(text) != "") & (F.octet_length(text) <= MOST_BYTES)


def deduplicated(clips: DataFrame) -> DataFrame:
    """One row a content: first source, newest time, how often; a clip seen again moves to the top."""
    key = F.md5(F.col("text"))
    kept = clips.where(capturable(F.col("text"))).withColumn("hash", key)
    return kept.groupBy("hash").agg(F.max("ts").alias("ts"), F.count("*").alias("times"), F.min_by("source", F.struct("ts", "source")).alias("source"), F.min("text").alias("text"))


def preview(text: Column) -> Column:
    return F.left(text, F.lit(PREVIEW))


def retained(clips: DataFrame, now: int, day: int = 86400, days: int = KEEP_DAYS, rows: int = KEEP_ROWS) -> DataFrame:
    """Clips of the last days, of these the newest rows; ties by hash."""
    return clips.where(F.col("ts") >= now - days * day).orderBy(F.desc("ts"), "hash").limit(rows)


def search(clips: DataFrame, q: str, k: int = 50) -> DataFrame:
    """Matches by score and time among the newest SEARCHED; an empty query lists them by time at score 1."""
    pool = clips.orderBy(F.desc("ts"), "hash").limit(SEARCHED)
    folded = shellmatch.folded_query(q)
    score = shellmatch.score(preview(F.col("text")), folded) if folded else F.lit(1.0)
    return pool.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), F.desc("ts"), "hash").limit(k)


def unseen(stored: DataFrame, held: DataFrame) -> DataFrame:
    """Stored clips whose content is not held already."""
    return stored.join(held.select("hash"), "hash", "left_anti")
