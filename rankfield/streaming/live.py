"""A catalog that lives: a snapshot, the journal read on from a cursor, rebuilds, pauses, and repair of depths.

The state is tables in the shared folder and a small file that names them, so a
driver that restarts goes on from the last snapshot.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.functions.match import DIR
from rankfield.operators import tree
from rankfield.plans import snapshot as snapshots
from rankfield.session import materialized
from rankfield.sources.adapters import with_derived
from rankfield.sources.journal import Cursor, Journal, NeedsRebuild, read_batch
from rankfield.streaming import changes

#: Fixed value: how long after a folder moved its depths are repaired, in seconds.
DEBOUNCE = 0.5
VERSION = 1


def changed_entries(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """snapshot after the changes of log: only entries that log names are folded again, the others pass on as they stand."""
    touched = log.select("frn").distinct()
    base = changes.with_snapshot(snapshot.join(touched, "frn", "left_semi"), log)
    folded = materialized(changes.fold(base).drop("slot"), "folded")
    rest = materialized(snapshot.join(touched, "frn", "left_anti"), "untouched")
    near = tree.depths_of_new(rest, folded)
    above = rest.select(F.col("frn").alias("parent_frn"), F.col("path").alias("_above"))
    placed = folded.join(near, "frn").join(above, "parent_frn", "left")
    path = F.when(F.col("_above").isNull(), F.col("name")).otherwise(F.concat_ws("\\", "_above", "name"))
    new = with_derived(placed.withColumns({"path": path, "parent_path": F.coalesce("_above", F.lit(""))})).select(*snapshots.COLUMNS)
    return rest.select(*snapshots.COLUMNS).unionByName(new)


def moved_folders(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """frn, and was, the path before log: folders of the snapshot that log renames, moves or deletes, and new entries whose parent is as new.

    What hangs from these has to be placed again.
    """
    named = log.where("op in ('R', 'D', 'C')").select("frn").distinct()
    gone = snapshot.where(F.col("flags").bitwiseAND(DIR) != 0).join(named, "frn", "left_semi").select("frn", F.col("path").alias("was"))
    fresh = log.where("op = 'C'").select("frn", "parent_frn").distinct()
    nested = fresh.join(fresh.select(F.col("frn").alias("parent_frn")).distinct(), "parent_frn", "left_semi").select("frn", F.lit(None).cast("string").alias("was"))
    return gone.unionByName(nested).distinct()


@dataclass
class Live:
    """entries: the catalog; enumerate: reads a volume anew, as entries and the cursor taken before."""

    spark: SparkSession
    enumerate: Callable[[], tuple[DataFrame, Cursor]]
    entries: DataFrame | None = None
    cursor: Cursor | None = None
    epoch: int = 0
    paused: bool = False
    rebuilding: bool = False
    reason: str = ""
    armed: float | None = None
    moved: list[DataFrame] = field(default_factory=list)

    def rebuild(self, reason: str) -> None:
        """A new catalog beside the old one, which answers until they are swapped; the epoch grows."""
        self.rebuilding, self.reason = True, reason
        rows, cursor = self.enumerate()
        built = snapshots.build(rows)
        self.entries, self.cursor, self.epoch = built, cursor, self.epoch + 1
        self.rebuilding, self.armed, self.moved = False, None, []

    def step(self, journal: Journal, now: float | None = None) -> bool:
        """Reads on in the journal; false while paused.  A journal that has moved past the cursor means a rebuild."""
        if self.paused:
            return False
        if self.entries is None or self.cursor is None:
            self.rebuild("nothing yet")
            return True
        try:
            log, cursor = read_batch(self.spark, journal, self.cursor)
        except NeedsRebuild as e:
            self.rebuild(str(e))
            return True
        log = materialized(log, "log")
        if not log.isEmpty():
            moved = materialized(moved_folders(self.entries, log), "moved")
            if not moved.isEmpty():
                self.armed = time.time() if now is None else now
                self.moved.append(moved)
            self.entries = materialized(changed_entries(self.entries, log), "entries")
        self.cursor = cursor
        return True

    def repair_due(self, now: float | None = None) -> bool:
        return self.armed is not None and (time.time() if now is None else now) - self.armed >= DEBOUNCE

    def repair(self) -> None:
        """Places what hangs from folders that moved; until then it has its old depth, and is found all the same."""
        if self.moved:
            self.entries = materialized(tree.repair(self.entries, reduce(DataFrame.unionByName, self.moved)), "entries")
        self.armed, self.moved = None, []

    def save(self, to: str) -> None:
        """The catalog as Parquet in ``to``/entries, and last of all what it is a snapshot of."""
        self.entries.write.mode("overwrite").parquet(f"{to}/entries")
        checked = checksum(self.entries)
        state = {"version": VERSION, "journal_id": self.cursor.journal_id, "next_usn": self.cursor.next_usn, "epoch": self.epoch, "checksum": checked}
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{to}/state")

    def load(self, at: str) -> bool:
        """Goes on from a saved catalog; anything wrong with it means a rebuild, and false."""
        try:
            state = json.loads(self.spark.read.text(f"{at}/state").first()[0])
            entries = self.spark.read.parquet(f"{at}/entries")
            if state["version"] != VERSION or checksum(entries) != state["checksum"]:
                raise ValueError("not the snapshot that was saved")
            self.entries, self.epoch, self.cursor = entries, state["epoch"], Cursor(state["journal_id"], state["next_usn"])
        except Exception as e:  # whatever a broken snapshot does, the volume is read anew
            self.rebuild(str(e))
            return False
        return True


def checksum(entries: DataFrame) -> str:
    """Of all rows, whatever their order."""
    row = entries.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(entries.columns)).cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"
