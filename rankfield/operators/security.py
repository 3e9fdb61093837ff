"""Pages trimmed to what a user may see, by grants of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trimmed(page: DataFrame, grants: DataFrame, sid: str, folder: str = "parent_frn") -> DataFrame:
    """Rows of a page whose folder is granted to the user: a page is small, so grants are looked up and never gathered."""
    own = grants.where(F.col("sid") == sid).select(F.col("dir").alias(folder))
    return page.join(own, folder, "left_semi")


def still_granted(grants: DataFrame, entries: DataFrame, changed: DataFrame) -> DataFrame:
    """Grants without those of folders at or under one (frn) whose rights changed: they have to be asked for again.

    entries: frn and path of the folders.  changed: those of one batch of changes.
    """
    tops = entries.join(changed.select("frn").distinct(), "frn", "left_semi").select(F.col("path").alias("_top"))
    under = (F.col("path") == F.col("_top")) | F.startswith(F.col("path"), F.concat(F.col("_top"), F.lit("\\")))
    gone = entries.join(F.broadcast(tops), under, "left_semi").select(F.col("frn").alias("dir"))
    return grants.join(gone, "dir", "left_anti").select(*grants.columns)
