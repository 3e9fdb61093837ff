"""Queries over several volumes: which answer, and what is said of those that cannot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of a volume that is offline, being rebuilt, or of a kind that is not indexed.
VOLUME_OFFLINE, INDEX_REBUILDING, SCOPE_UNSUPPORTED = 101, 102, 107


def scope_errors(scopes: DataFrame, volumes: DataFrame) -> DataFrame:
    """volume_idx of each asked volume with code (null where it answers in full) and retry.

    volumes: volume_idx, is_fixed_ntfs, online, rebuilding.  A volume that is not there is offline.
    """
    code = (
        F.when(F.col("online").isNull() | ~F.col("online"), VOLUME_OFFLINE)
        .when(~F.col("is_fixed_ntfs"), SCOPE_UNSUPPORTED)
        .when(F.col("rebuilding"), INDEX_REBUILDING)
    )
    found = scopes.select("volume_idx").distinct().join(volumes, "volume_idx", "left").withColumn("code", code)
    return found.select("volume_idx", "code", (F.col("code") != SCOPE_UNSUPPORTED).alias("retry"))


def in_scopes(entries: DataFrame, errors: DataFrame) -> DataFrame:
    """Entries of the asked volumes that answer, with partial where the volume is being rebuilt."""
    open_ = errors.where(F.col("code").isNull() | (F.col("code") == INDEX_REBUILDING))
    return entries.join(F.broadcast(open_.select("volume_idx", F.col("code").isNotNull().alias("partial"))), "volume_idx")  # a row a volume
