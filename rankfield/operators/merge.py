"""One list out of many sources: union, collapse, order, caps by kind, frozen rows, selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a kind in the merged list; files in the inline list.
KIND_CAPS = {"calc": 1, "command": 3, "setting": 3, "app": 3, "window": 2, "file": 3}
INLINE_FILES = 5


def union(*sources: DataFrame) -> DataFrame:
    """All rows under one wide schema."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def list_order() -> list[Column]:
    """Score, then commands by their own order, shell kinds before files, and name."""
    return [F.desc("score"), F.when(F.col("kind") == "file", 1).otherwise(0), F.coalesce(F.col("ord"), F.lit(0)), F.col("name"), F.col("key")]


def collapse_names(rows: DataFrame, *arrival: str) -> DataFrame:
    """The best row of each name, letters' case aside; of equals the first to arrive."""
    place = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(F.desc("score"), *arrival))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def cap_kinds(rows: DataFrame, order: list, by: list[str] | None = None, exempt: Column | None = None) -> DataFrame:
    """At most KIND_CAPS rows of a kind (in each group of by); exempt rows always stay, and count.

    Each kind is limited by a constant, so that tasks keep that many rows before
    the shuffle.  Exempt rows stand first in order.
    """
    place = F.row_number().over(Window.partitionBy(*(by or []), "kind").orderBy(*order))
    parts = [_first_rows(rows.where(F.col("kind") == kind), place, cap) for kind, cap in KIND_CAPS.items()]
    rest = rows.where(~F.coalesce(F.col("kind").isin(*KIND_CAPS), F.lit(False)))
    if exempt is not None:  # those beyond a kind's cap
        more = rows.where(exempt & F.col("kind").isin(*KIND_CAPS)).withColumn("_place", place)
        caps = F.create_map(*(F.lit(x) for kv in KIND_CAPS.items() for x in kv))
        parts.append(more.where(F.col("_place") > F.element_at(caps, F.col("kind"))).drop("_place"))
    return reduce(DataFrame.unionByName, [*parts, rest])


def _first_rows(rows: DataFrame, place: Column, n: int) -> DataFrame:
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def inline_files(rows: DataFrame, order: list) -> DataFrame:
    """The files that stand in the root list: after names are collapsed, the first INLINE_FILES."""
    return rows.where(F.col("kind") == "file").orderBy(*order).limit(INLINE_FILES)


def merge(rows: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """Ordered, capped rows with their place (pos, from 0).

    frozen (key, frozen_pos): rows already shown keep their order, with their
    newest content, and stand before new ones.
    """
    if frozen is not None:
        rows = rows.join(frozen.select("key", "frozen_pos"), "key", "left")
        order = [F.col("frozen_pos").isNull(), F.col("frozen_pos"), *list_order()]
        exempt = F.col("frozen_pos").isNotNull()
    else:
        order, exempt = list_order(), None
    kept = cap_kinds(rows, order, exempt=exempt)
    return kept.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)  # a page: at most the caps' sum, and the frozen rows


def selection(merged: DataFrame, sticky: str) -> DataFrame:
    """selected: the place of the sticky key, else 0."""
    return merged.agg(F.coalesce(F.max(F.when(F.col("key") == sticky, F.col("pos"))), F.lit(0)).alias("selected"))
