"""Log lines: written as JSON, read back with bad lines counted, filtered, ordered, tailed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "ts string, level string, process string, component string, message string, _bad string"
#: Fixed value: characters of a component that are shown.
COMPONENT = 18


def to_lines(rows: DataFrame) -> DataFrame:
    """raw: one JSON object a row, times in UTC to the millisecond."""
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.select("file_idx", "line_no", F.to_json(F.struct(at.alias("ts"), "level", "process", "component", "message")).alias("raw"))


def parsed(lines: DataFrame) -> DataFrame:
    """file_idx, line_no, fields, and bad for lines that are no such object."""
    x = F.from_json("raw", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = lines.withColumn("x", x)
    bad = F.col("x").isNull() | F.col("x._bad").isNotNull() | F.col("x.ts").isNull()
    return out.select("file_idx", "line_no", "x.ts", "x.level", "x.process", "x.component", "x.message", bad.alias("bad"))


def timeline(rows: DataFrame, levels: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Good lines of the levels whose message has the pattern."""
    out = rows.where("not bad")
    if levels:
        out = out.where(F.col("level").isin(*levels))
    return out.where(F.col("message").rlike(pattern)) if pattern else out


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n by time, file and line, in that order."""
    return rows.orderBy(F.desc("ts"), F.desc("file_idx"), F.desc("line_no")).limit(n).orderBy("ts", "file_idx", "line_no")


def files(named: DataFrame) -> DataFrame:
    """Each folder and file once."""
    return named.select("folder", "file").distinct()


def shown_component(component, prefix: str):
    return F.left(F.regexp_replace(component, f"^{prefix}_?[a-z0-9]*::", ""), F.lit(COMPONENT))
