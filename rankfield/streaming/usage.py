"""Usage and the clipboard as streams: states by key in update mode, put together by the newest batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.operators import clips, rank


def usage_stream(launches: DataFrame, checkpoint: str, publish) -> object:
    """Calls publish(DataFrame, batch id) with the usage of ids that each micro-batch launched."""
    return rank.usage(launches).writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_states(states: DataFrame, key: str, batch: str = "batch") -> DataFrame:
    """One row a key, of its newest batch."""
    rest = [c for c in states.columns if c not in (key, batch)]
    return states.groupBy(key).agg(F.max_by(F.struct(*rest), batch).alias("_s")).select(key, "_s.*")


def clips_stream(captures: DataFrame, checkpoint: str, publish) -> object:
    """Captures (text, ts, source, formats) as one row a content: calls publish with the contents that each micro-batch moved to the top."""
    kept = clips.deduplicated(captures.where(clips.remembered(F.col("formats"))))
    return kept.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
