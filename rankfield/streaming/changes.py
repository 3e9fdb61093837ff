"""The change log: parsing events, folding them to the current entries, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.functions.text import usable_name

#: Reason bits of a journal record, and the first ordinary file number.
DATA_DELETE, DATA_CREATE, DATA_RENAME_NEW, DATA_SECURITY = 0x200, 0x100, 0x2000, 0x800
FIRST_FILE = 16
#: Attribute bits of a record.
ATTR_HIDDEN, ATTR_SYSTEM, ATTR_DIRECTORY = 0x2, 0x4, 0x10
#: A rewrite is due at these shares of dead rows when idle, or at the last in any case.
IDLE_WASTE, FORCED_WASTE = 0.25, 0.40


def op_of(reason: Column) -> Column:
    """The event of a record's reasons: delete, create, rename, security, in that order; null for others."""
    has = lambda bit: reason.bitwiseAND(bit) != 0
    return F.when(has(DATA_DELETE), "D").when(has(DATA_CREATE), "C").when(has(DATA_RENAME_NEW), "R").when(has(DATA_SECURITY), "S")


def flags_of(attributes: Column) -> Column:
    bit = lambda a, f: F.when(attributes.bitwiseAND(a) != 0, f).otherwise(0)
    return bit(ATTR_DIRECTORY, 1) + bit(ATTR_HIDDEN, 2) + bit(ATTR_SYSTEM, 4)


def ordinary(frn: Column) -> Column:
    """Not one of a volume's own files."""
    return frn.bitwiseAND(0xFFFFFFFFFFFF) >= FIRST_FILE


def _aggregates() -> list[Column]:
    last = lambda c, ops: F.max_by(c, F.when(F.col("op").isin(*ops), F.col("usn")))
    when = lambda c, ops: F.max_by(F.when(F.col("op").isin(*ops), F.col(c)), F.when(F.col("op").isin(*ops), F.col("usn")))
    return [
        last(F.col("op"), ("C", "D")).alias("last_op"), when("flags", ("C", "D")).alias("flags"),
        when("name", ("C", "R")).alias("name"), when("parent_frn", ("C", "R")).alias("parent_frn"),
        F.min(F.when(F.col("op") == "C", F.col("usn"))).alias("slot"),
    ]


def usable(changes: DataFrame) -> DataFrame:
    """Creates and renames to a name that cannot be kept are as if they had not been."""
    return changes.where(~F.col("op").isin("C", "R") | usable_name(F.col("name")))


def fold(changes: DataFrame) -> DataFrame:
    """The live entries after all changes: frn, parent_frn, name, flags, slot.

    An entry lives if its last create or delete is a create; its flags are that
    create's; its name and parent are of its last create or rename.  Only
    aggregates that merge are used, so parts can be folded ahead of the shuffle.
    """
    folded = usable(changes).groupBy("frn").agg(*_aggregates())
    return folded.where("last_op = 'C'").select("frn", "parent_frn", "name", "flags", "slot")


def with_snapshot(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """A snapshot as creates before all changes, and the changes."""
    base = entries.select(F.lit(-1).cast("long").alias("usn"), F.lit("C").alias("op"), "frn", "parent_frn", "name", "flags")
    return base.unionByName(changes.select("usn", "op", "frn", "parent_frn", "name", "flags"))


def fold_stream(changes: DataFrame, checkpoint: str, publish) -> object:
    """Folds a stream of changes and calls publish(DataFrame, batch id) with the states that each micro-batch changed.

    A state has last_op, and is an entry while that is 'C'; latest() puts the
    states of several batches together.  A batch that is run again has the same
    id and the same states.
    """
    states = usable(changes).groupBy("frn").agg(*_aggregates())
    return states.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(states: DataFrame, batch: str = "batch") -> DataFrame:
    """The live entries, from changed states with the number of their batch."""
    last = states.groupBy("frn").agg(F.max_by(F.struct("last_op", "parent_frn", "name", "flags", "slot"), batch).alias("s")).select("frn", "s.*")
    return last.where("last_op = 'C'").select("frn", "parent_frn", "name", "flags", "slot")


def waste(changes: DataFrame) -> DataFrame:
    """Rows, dead rows and their share, and whether a rewrite is due when idle or at once."""
    folded = usable(changes).where("op in ('C', 'D', 'R')").groupBy("frn").agg(*_aggregates())
    sums = folded.agg(F.count("*").alias("total"), F.sum(F.when(F.col("last_op") == "D", 1).otherwise(0)).alias("dead"))
    share = F.col("dead") / F.greatest(F.col("total"), F.lit(1))
    return sums.select("total", "dead", share.alias("share"), (share >= IDLE_WASTE).alias("due_idle"), (share > FORCED_WASTE).alias("due_now"))


def waste_fractions(entries: DataFrame) -> DataFrame:
    """Of a table of entries (name, dead, superseded: an older record of the same entry): dead bytes to live ones, superseded records and dead rows to all."""
    size = F.octet_length("name").cast("long")
    gone = F.col("dead") | F.col("superseded")
    sums = entries.agg(
        F.coalesce(F.sum(F.when(gone, size)), F.lit(0)).alias("dead_bytes"), F.coalesce(F.sum(F.when(~gone, size)), F.lit(0)).alias("live_bytes"),
        F.count(F.when(F.col("superseded"), 1)).alias("old"), F.count(F.when(F.col("dead"), 1)).alias("dead"), F.count("*").alias("all"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return sums.select(share("dead_bytes", "live_bytes").alias("bytes"), share("old", "all").alias("records"), share("dead", "all").alias("slots"))
