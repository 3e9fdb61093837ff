"""Generations of requests: the newest of a session counts, older ones are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def watermark(requests: DataFrame) -> DataFrame:
    """session, latest: the newest generation, one more where that was cancelled."""
    raised = F.when(F.col("kind") == "cancel", F.col("gen") + 1).otherwise(F.col("gen"))
    return requests.groupBy("session").agg(F.max(raised).alias("latest"))


def newest(requests: DataFrame) -> DataFrame:
    """The one request of each session that is answered: of its newest generation, the last to arrive."""
    live = requests.where("kind = 'query'").join(watermark(requests), "session").where("gen >= latest")
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("gen"), F.desc("arrival")))
    return live.withColumn("_place", place).where("_place = 1").drop("_place", "latest")


def drop_stale(results: DataFrame, marks: DataFrame) -> DataFrame:
    """Results of generations that are still wanted."""
    return results.join(marks, "session").where("gen >= latest").drop("latest")


def superseded(requests: DataFrame) -> DataFrame:
    """Per session how many queries came, were answered, and gave way to newer ones."""
    asked = requests.where("kind = 'query'").groupBy("session").agg(F.count("*").alias("asked"))
    answered = newest(requests).groupBy("session").agg(F.count("*").alias("answered"))
    out = asked.join(answered, "session", "left").withColumn("answered", F.coalesce("answered", F.lit(0)))
    return out.withColumn("superseded", F.col("asked") - F.col("answered"))


def latest_stream(requests: DataFrame) -> DataFrame:
    """The watermark as a stream in update mode."""
    return watermark(requests)
