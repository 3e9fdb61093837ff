"""The driver's tables as the engine's: entries, changes, launches, catalogs, clips, markers, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.functions.match import DIR, HIDDEN, SYSTEM
from rankfield.functions.text import class_mask_ascii, fold_any, initials_any, initials_ascii, is_ascii, mask_any


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frn, parent_frn, name, flags of the tree region, nation, customer, order."""
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("frn"), F.lit(0).cast("long").alias("parent_frn"), F.col("r_name").alias("name"), F.lit(DIR).alias("flags"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2000).cast("long").alias("frn"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_frn"), F.col("n_name").alias("name"), F.lit(DIR).alias("flags"))
    customer = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1_000_000).alias("frn"), (F.col("c_nationkey") + 2000).cast("long").alias("parent_frn"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") < 0, DIR | HIDDEN).otherwise(DIR).alias("flags")
    )
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1_000_000_000).alias("frn"), (F.col("o_custkey") + 1_000_000).alias("parent_frn"),
        F.concat(F.lit("Order-"), F.col("o_orderkey").cast("string"), F.lit("_"), F.col("o_orderpriority"), F.lit(".doc")).alias("name"),
        F.when(F.startswith(F.col("o_orderpriority"), F.lit("5")), SYSTEM).otherwise(0).alias("flags"),
    )
    return region.unionByName(nation).unionByName(customer).unionByName(orders)


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with camel humps, separators and extensions."""
    kind = F.lower(F.regexp_replace("p_type", "[^A-Za-z]+", ""))
    name = F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("-"), F.col("p_brand"), F.lit("."), kind)
    return table(spark, sf_dir, "part").select((F.col("p_partkey") + 5_000_000_000).alias("frn"), F.lit(0).cast("long").alias("parent_frn"), name.alias("name"), F.lit(0).alias("flags"))


def with_derived(entries: DataFrame) -> DataFrame:
    """Adds what is computed once at ingest: folded name, initials and class mask."""
    plain = entries.where(F.coalesce(is_ascii(F.col("name")), F.lit(True))).withColumns({"folded": F.lower("name"), "lane": initials_ascii(F.col("name"))}).withColumn("mask", class_mask_ascii(F.col("folded")))
    other = entries.where(~is_ascii(F.col("name"))).withColumns({"folded": fold_any(F.col("name")), "lane": initials_any(F.col("name"))}).withColumn("mask", mask_any(F.col("folded")))
    return plain.unionByName(other)  # only the others go through Python


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """usn, op, frn, parent_frn, name, flags from the event log: C create, D delete, R rename, S security."""
    e = table(spark, sf_dir, "events")
    return changes_from_events(e)


def changes_from_events(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "click"), "C").when(kind == "purchase", "R").when(kind == "error", "D").otherwise("S")
    return e.select(
        F.col("event_id").alias("usn"), op.alias("op"), F.col("user_id").alias("frn"), F.pmod("event_id", F.lit(7)).cast("long").alias("parent_frn"),
        F.when(F.pmod("event_id", F.lit(11)) == 0, "").otherwise(F.concat(F.lit("Item_"), F.pmod("event_id", F.lit(97)).cast("string"), F.lit(".txt"))).alias("name"),
        F.when(F.pmod("event_id", F.lit(5)) == 0, HIDDEN).otherwise(0).alias("flags"),
    )


def launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return e.select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("ts"), F.col("role").alias("source"), F.col("text"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gen, name, final, ts: the turns of a conversation as the steps of a request."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("gen"), F.when(F.col("role") == "user", "results").otherwise("applied").alias("name"), (F.col("turn") % 2 == 0).alias("final"), F.col("turn").alias("ts"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class, value, id: latency samples."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("class"), F.col("value"), F.col("event_id").alias("id"))
