"""The shell's catalogs: apps, settings, commands, windows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfield.functions import shellmatch
from rankfield.operators.rank import band

#: Least characters of a query by catalog; when a catalog of apps is stale and when it is read again, in minutes.
LEAST_CHARS = {"app": 1, "setting": 2, "command": 2, "window": 2}
STALE_MINUTES, REFRESH_MINUTES, WINDOWS_SECONDS = 5, 30, 5
#: A command's own name lifts it from this score on, one backed by an app from the second.
OWN_BAND, APP_BAND = 0.8, 0.9


def matched(rows: DataFrame, kind: str, q: str) -> DataFrame:
    """Rows of a catalog (name, perhaps synonyms) with score and direct, the score of the name itself."""
    folded = shellmatch.folded_query(q)
    if len(folded) < LEAST_CHARS[kind]:
        return rows.where(F.lit(False)).withColumns({"score": F.lit(0.0), "direct": F.lit(0.0)})
    if "synonyms" in rows.columns:
        best, direct = shellmatch.score_with_synonyms(F.col("name"), F.col("synonyms"), folded)
    else:
        best = direct = shellmatch.score(F.col("name"), folded)
    return rows.withColumns({"score": best, "direct": direct}).where("score is not null")


def catalog_order() -> list[Column]:
    """Score, then the shorter name in bytes, then the name."""
    return [F.desc("score"), F.octet_length("name"), F.col("name")]


def available(rows: DataFrame, build: int, capabilities: list[str]) -> DataFrame:
    """Rows whose gate (min_build, requires) this system passes; an unknown requirement hides a row."""
    caps = F.array(*(F.lit(c) for c in capabilities)).cast("array<string>")
    old = F.coalesce(F.col("min_build"), F.lit(0)) <= build
    return rows.where(old & (F.col("requires").isNull() | F.coalesce(F.array_contains(caps, F.col("requires")), F.lit(False))))


def suppressed(apps: DataFrame, hidden: DataFrame) -> DataFrame:
    """Apps whose id is not hidden, letters' case aside."""
    return apps.join(hidden.select(F.lower("id").alias("_id")), F.lower(apps["id"]) == F.col("_id"), "left_anti")


def backed(commands: DataFrame, apps: DataFrame) -> DataFrame:
    """Commands that need no app, or whose app is there."""
    there = apps.select(F.col("id").alias("requires_app")).distinct().withColumn("_there", F.lit(True))
    return commands.join(there, "requires_app", "left").where("requires_app is null or _there").drop("_there")


def banded(commands: DataFrame) -> DataFrame:
    """Adds the lift of commands whose own name matched well enough."""
    threshold = F.when(F.col("requires_app").isNull(), OWN_BAND).otherwise(APP_BAND)
    return commands.withColumn("score", band(F.col("score"), F.coalesce("direct", F.lit(0.0)), threshold))


def listed_windows(windows: DataFrame) -> DataFrame:
    """Windows that a switcher shows: visible, owned as such, no tool, not cloaked, titled."""
    return windows.where("visible and alt_tab and not tool and not cloaked and trim(title) <> ''")


def fresh(rows: DataFrame, now: int, seconds: int, at: str = "ts") -> DataFrame:
    """Rows not older than so many seconds."""
    return rows.where(F.col(at) > now - seconds)


def windows_due(read_at: Column, now: int) -> Column:
    """Whether the list of windows has to be read again."""
    return F.lit(now) - read_at >= WINDOWS_SECONDS


def volumes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("is_fixed_ntfs", F.col("fixed") & (F.upper("fs") == "NTFS"))


#: Actions of files and windows, the default first.
FILE_ACTIONS = ("open", "reveal", "copy_path", "copy_file", "open_with", "delete")
WINDOW_ACTIONS = (
    "open", "left_half", "right_half", "top_half", "bottom_half", "maximize", "center", "left_third", "center_third", "right_third", "left_two_thirds", "right_two_thirds",
    "top_left", "top_right", "bottom_left", "bottom_right", "next_monitor", "topmost", "untopmost", "minimize", "close",
)


def available_actions(kind: Column, is_win32: Column) -> Column:
    """The actions offered for a row, the default first."""
    lit = lambda *x: F.array(*(F.lit(v) for v in x))
    return (
        F.when(kind == "file", lit(*FILE_ACTIONS))
        .when(kind == "window", lit(*WINDOW_ACTIONS))
        .when(kind == "calc", lit("copy"))
        .when((kind == "app") & is_win32, lit("open", "runas"))
        .otherwise(lit("open"))
    )


def last_good(scans: DataFrame, now: int) -> DataFrame:
    """Apps of the newest scan that succeeded, with is_stale, and due where it is time to scan again in any case.

    scans: scan, ts (seconds), ok, and an app a row (id, name); a failed scan has
    a row without an app.  A scan that fails leaves the last good one standing.
    """
    best = scans.where("ok").agg(F.max_by("scan", "ts").alias("scan"), F.max("ts").alias("_ts"))
    rows = scans.where("ok and id is not null").join(F.broadcast(best), "scan")
    age = F.lit(now) - F.col("_ts")
    return rows.withColumns({"is_stale": age > STALE_MINUTES * 60, "due": age >= REFRESH_MINUTES * 60}).drop("_ts", "ok")


SETTINGS = "settings array<struct<id:string,name:string,uri:string,synonyms:array<string>,gate:struct<min_build:int,requires:string>>>, control_panel array<struct<id:string,name:string,canonical:string,synonyms:array<string>,gate:struct<min_build:int,requires:string>>>"


#: A file of a catalog that is written holds at most 2^SETTINGS_BITS settings, so no task and no driver holds more.
SETTINGS_BITS = 12


def write_settings(settings: DataFrame, control_panel: DataFrame, path: str) -> None:
    """A JSON catalog at path, as a folder of files of the same form; tasks write them, and the driver sees no setting.

    Both have id, name, synonyms and gate, and uri or canonical.  Absent values are left out.
    """
    spark = settings.sparkSession
    entry = lambda rows, target: F.struct("id", "name", target, "synonyms", "gate")
    both = settings.select(entry(settings, "uri").alias("s"), F.lit(None).alias("c")).unionByName(control_panel.select(F.lit(None).alias("s"), entry(control_panel, "canonical").alias("c")))
    block = F.shiftright(F.monotonically_increasing_id(), SETTINGS_BITS)  # of neighbours within a partition
    files = both.groupBy(block.alias("block")).agg(F.collect_list("s").alias("settings"), F.collect_list("c").alias("control_panel"))
    head = spark.range(0, 1, 1, 1).select(F.array().cast(files.schema["settings"].dataType).alias("settings"), F.array().cast(files.schema["control_panel"].dataType).alias("control_panel"))
    text = F.to_json(F.struct(F.array(F.lit("made")).alias("_comment"), "settings", "control_panel"), {"pretty": "true"})
    head.unionByName(files.drop("block")).select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_settings(spark: SparkSession, path: str, built_in: DataFrame, build: int, capabilities: list[str]) -> DataFrame:
    """Settings (id, name, target, synonyms, min_build, requires) of a JSON catalog that this system's gate lets through.

    path: a file, or a folder of files of the same form, which are good only together.  built_in, of the same columns, stands in for a file that is not there or cannot be read.
    """
    try:
        file = spark.read.schema(f"{SETTINGS}, _bad string").options(multiLine=True, columnNameOfCorruptRecord="_bad").json(path).cache()
        whole = not file.isEmpty() and file.where("_bad is not null").isEmpty()
    except AnalysisException:
        whole = False
    if not whole:
        return available(built_in, build, capabilities)

    def rows(list_: str, target: str) -> DataFrame:
        one = file.select(F.explode(list_).alias("x"))
        return one.select("x.id", "x.name", F.col(f"x.{target}").alias("target"), F.coalesce("x.synonyms", F.array().cast("array<string>")).alias("synonyms"), "x.gate.min_build", "x.gate.requires")

    return available(rows("settings", "uri").unionByName(rows("control_panel", "canonical")), build, capabilities)


def named_entries(rows: DataFrame, q: str, kind: str = "command") -> DataFrame:
    """A catalog of plain entries (system commands, emoji with keywords, processes): name and synonyms matched, best first."""
    return matched(rows, kind, q).orderBy(*catalog_order())
