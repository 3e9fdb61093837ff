"""Depths and paths of a forest of parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.functions.match import DEEPEST
from rankfield.session import materialized

#: Fixed value: links followed at most.
MOST_LINKS = 512


def resolve(entries: DataFrame, root: str = "") -> DataFrame:
    """frn, depth, path and parent_path of each entry.

    Only entries that are the parent of another are followed upwards, by
    doubling: a round joins each one's furthest known ancestor with that
    ancestor's own, so a chain of n links takes log2(n) rounds.  All others are
    joined with their parent once.  A parent that is missing, or the entry
    itself, ends the walk.  Chains that never end have depth DEEPEST, as has all
    that hangs from them.
    """
    text = lambda names: F.array_join(F.concat(F.array(F.lit(root)) if root else F.array().cast("array<string>"), names), "\\")
    return _placed(entries).select(
        "frn", F.when(F.col("up").isNotNull(), DEEPEST).otherwise(F.least("depth", F.lit(DEEPEST))).cast("int").alias("depth"),
        text(F.col("names")).alias("path"), text(F.slice("names", F.lit(1), F.size("names") - 1)).alias("parent_path"),
    )


def _placed(entries: DataFrame) -> DataFrame:
    """frn, up (set where a chain has not ended), top (the last ancestor found, or the entry), depth below it, and names from it on."""
    own = entries.select("frn", "parent_frn", "name")
    parents = own.where("parent_frn <> frn").select(F.col("parent_frn").alias("frn")).distinct()
    inner = materialized(own.join(parents, "frn", "left_semi"), "inner")
    followed = materialized(_follow(inner), "followed")
    above = followed.select(F.col("frn").alias("parent_frn"), *(F.col(c).alias(f"_{c}") for c in ("up", "top", "depth", "names")))
    leaves = own.join(inner.select("frn"), "frn", "left_anti").withColumn("parent_frn", F.when(F.col("parent_frn") != F.col("frn"), F.col("parent_frn")))
    hung = leaves.join(above, "parent_frn", "left").select(
        "frn", F.col("_up").alias("up"), F.coalesce("_top", "frn").alias("top"), F.coalesce(F.col("_depth") + 1, F.lit(0)).alias("depth"),
        F.concat(F.coalesce("_names", F.array().cast("array<string>")), F.array("name")).alias("names"),
    )
    return followed.unionByName(hung)


def _follow(own: DataFrame) -> DataFrame:
    known = own.select(F.col("frn").alias("parent_frn"), F.lit(True).alias("there"))
    linked = F.col("there").isNotNull() & (F.col("parent_frn") != F.col("frn"))
    state = own.join(known, "parent_frn", "left").select(
        "frn", F.when(linked, F.col("parent_frn")).alias("up"), F.when(linked, F.col("parent_frn")).otherwise(F.col("frn")).alias("top"), F.when(linked, 1).otherwise(0).alias("depth"), F.array("name").alias("names")
    )
    state, links = materialized(state, "walk"), 1
    while links < MOST_LINKS and not state.where("up is not null").isEmpty():
        above = state.select(F.col("frn").alias("up"), *(F.col(c).alias(f"_{c}") for c in ("up", "top", "depth", "names")))
        state = state.join(above, "up", "left").select(
            "frn", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            F.concat(F.coalesce("_names", F.array().cast("array<string>")), "names").alias("names"),
        )
        state, links = materialized(state, "walk"), links * 2
    return state


def depths_of_new(snapshot: DataFrame, added: DataFrame) -> DataFrame:
    """frn and depth of added entries, from their parents' depths in the snapshot; without a parent there, 0."""
    above = snapshot.select(F.col("frn").alias("parent_frn"), F.col("depth").alias("_depth"))
    place = F.when(F.col("parent_frn") == F.col("frn"), 0).otherwise(F.least(F.coalesce(F.col("_depth") + 1, F.lit(0)), F.lit(DEEPEST)))
    return added.join(above, "parent_frn", "left").select("frn", place.cast("int").alias("depth"))


def at_or_under(snapshot: DataFrame, tops: DataFrame, top: str) -> DataFrame:
    """Rows of snapshot whose path is one of tops (distinct), or goes on from one after a backslash.

    Each folder's path is taken once, however much it holds, and all its
    beginnings are joined with tops by equality, so the work grows with the rows
    and not with rows times tops.
    """
    last = F.substring_index("path", "\\", -1)
    folder = F.when(F.contains("path", F.lit("\\")), F.left("path", F.length("path") - F.length(last) - 1))
    folders = snapshot.select(folder.alias("_folder")).where("_folder is not null").distinct()
    begins = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("_folder", r"\\", -1))), lambda k: F.call_function("substring_index", F.col("_folder"), F.lit("\\"), k)))
    under = materialized(folders.select("_folder", begins.alias(top)).join(tops, top, "left_semi").select("_folder").distinct(), "under")
    rows = snapshot.withColumn("_folder", folder).join(under.withColumn("_under", F.lit(True)), "_folder", "left")
    return rows.join(tops.select(F.col(top).alias("path"), F.lit(True).alias("_is")), "path", "left").where("_under or _is").select(*snapshot.columns)


def repair(snapshot: DataFrame, moved: DataFrame) -> DataFrame:
    """snapshot with the depth and paths of moved folders (frn, and was: the path before), and of all that hangs from them, worked out again.

    What hangs from a folder still has its old path, and is found by it.  Only that much is
    followed upwards, to where it hangs from the rest, which passes on as it
    stands.
    """
    now = snapshot.join(moved.select("frn").distinct(), "frn", "left_semi").select(F.col("path").alias("_old"))
    tops = materialized(moved.where("was is not null").select(F.col("was").alias("_old")).unionByName(now).distinct(), "tops")
    stale = materialized(at_or_under(snapshot, tops, "_old"), "stale")
    rest = snapshot.join(stale.select("frn"), "frn", "left_anti")
    hooks = stale.select(F.col("frn").alias("top"), F.col("parent_frn").alias("_hook"))
    held = rest.select(F.col("frn").alias("_hook"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
    placed = _placed(stale).join(hooks, "top").join(held, "_hook", "left")
    depth = F.when(F.col("up").isNotNull(), DEEPEST).otherwise(F.least(F.col("depth") + F.coalesce(F.col("_depth") + 1, F.lit(0)), F.lit(DEEPEST))).cast("int")
    path = lambda names: F.concat_ws("\\", F.col("_path"), F.when(F.size(names) > 0, F.array_join(names, "\\")))
    again = placed.select("frn", depth.alias("_d"), path(F.col("names")).alias("_p"), path(F.slice("names", F.lit(1), F.size("names") - 1)).alias("_pp"))
    fresh = stale.join(again, "frn").withColumns({"depth": F.col("_d"), "path": F.col("_p"), "parent_path": F.col("_pp")}).select(*snapshot.columns)
    return rest.select(*snapshot.columns).unionByName(fresh)


def orphans(entries: DataFrame) -> DataFrame:
    """Entries whose parent is not in the table: they stand at depth 0."""
    return entries.join(entries.select(F.col("frn").alias("parent_frn")), "parent_frn", "left_anti").select("frn", "parent_frn", "name")
