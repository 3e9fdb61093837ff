"""A catalog's snapshot: entries with all that a search reads, derived once and written, then searched many times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.functions.match import DEAD
from rankfield.operators import rank, tree
from rankfield.session import materialized
from rankfield.sources.adapters import with_derived

COLUMNS = ("frn", "parent_frn", "name", "flags", "folded", "lane", "mask", "depth", "path", "parent_path")


def build(entries: DataFrame, name: str = "snapshot") -> DataFrame:
    """entries (frn, parent_frn, name, flags) that are not dead, with folded name, initials, class mask, depth and paths, written to the shared folder."""
    entries = entries.where(F.col("flags").bitwiseAND(DEAD) == 0)
    return materialized(with_derived(entries).join(tree.resolve(entries), "frn").select(*COLUMNS), name)


def search(snapshot: DataFrame, q: str, k: int = 32) -> DataFrame:
    """The page of one query."""
    return rank.search(snapshot, q, k).select("frn", "name", "path", "tier", "score")
