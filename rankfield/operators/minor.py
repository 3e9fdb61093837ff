"""Small data operators around the list: displays, idleness, announcements, action filters, policy events, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Policy events that are counted, and how many are read.
AUDITED, BLOCKED, MOST_EVENTS = 3076, 3077, 5000
#: Names of keys whose code is not their name.
KEY_NAMES = {
    "Space": "space", "Enter": "enter", "NumpadEnter": "enter", "Tab": "tab", "Escape": "esc", "Backspace": "backspace", "Delete": "delete", "Insert": "insert", "Home": "home", "End": "end",
    "PageUp": "pageup", "PageDown": "pagedown", "ArrowLeft": "left", "ArrowRight": "right", "ArrowUp": "up", "ArrowDown": "down",
    "Minus": "minus", "Equal": "plus", "Comma": "comma", "Period": "period", "Semicolon": "semicolon", "Slash": "slash", "Backquote": "grave",
    "BracketLeft": "lbracket", "BracketRight": "rbracket", "Backslash": "backslash", "Quote": "quote", "IntlBackslash": "oem_102",
    "NumpadAdd": "numpad_add", "NumpadSubtract": "numpad_subtract", "NumpadMultiply": "numpad_multiply", "NumpadDivide": "numpad_divide", "NumpadDecimal": "numpad_decimal",
}


def next_display(displays: DataFrame, by: str) -> DataFrame:
    """next_id: the display after each one, from left to right and top to bottom, the first after the last."""
    w = Window.partitionBy(by).orderBy("x", "y", "id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return displays.withColumn("next_id", F.coalesce(F.lead("id").over(w), F.first("id").over(whole)))


def idle(states: DataFrame, by: str) -> DataFrame:
    """Idle if no session's last state is active."""
    last = states.groupBy(by, "session").agg(F.max_by("state", "ts").alias("state"))
    return last.groupBy(by).agg((F.sum((F.col("state") == "active").cast("int")) == 0).alias("idle"))


def sentence(kind: Column, name: Column, subtitle: Column, commands: str = "command") -> Column:
    """One row as it is read out; commands: what commands are called."""
    return (
        F.when(kind == "calc", F.concat(F.lit("Calculator result "), name))
        .when(kind == "app", F.concat(name, F.lit(", application")))
        .when(kind == "setting", F.concat(name, F.lit(", "), subtitle))
        .when(kind == "command", F.concat(name, F.lit(f", {commands}")))
        .when(kind == "window", F.concat(name, F.lit(", open window")))
        .when(kind == "file", F.concat(name, F.lit(", file at "), subtitle))
    )


def announcement(queries: DataFrame, rows: DataFrame, by: str, commands: str = "command") -> DataFrame:
    """What is read out for each query (by, text) once its rows (by, pos, kind, name, subtitle) are settled: nothing for a blank query."""
    said = rows.withColumn("_said", sentence(F.col("kind"), F.col("name"), F.col("subtitle"), commands))
    sums = said.groupBy(by).agg(F.count("*").alias("_n"), F.min_by("_said", "pos").alias("_top"))
    many = F.when(F.col("_n") == 1, "1 result").otherwise(F.concat(F.col("_n").cast("string"), F.lit(" results")))
    text = F.when(F.trim("text") == "", "").when(F.col("_n").isNull(), "No results").otherwise(F.concat(many, F.lit(". "), F.col("_top")))
    return queries.join(sums, by, "left").select(by, text.alias("said"))


def action_matches(title: Column, typed: str) -> Column:
    """Titles with what was typed; nothing typed keeps all."""
    q = typed.strip().lower()
    return F.contains(F.lower(title), F.lit(q)) if q else F.lit(True)


def policy_summary(events: DataFrame, by: str) -> DataFrame:
    """Counts of audited and blocked events among the newest MOST_EVENTS, and of those about this folder."""
    newest = events.where(F.col("event_id").isin(AUDITED, BLOCKED)).orderBy(F.desc("ts"), "key").limit(MOST_EVENTS)
    count = lambda c: F.sum(c.cast("int")).cast("long")
    return newest.groupBy(by).agg(count(F.col("event_id") == AUDITED).alias("audited"), count(F.col("event_id") == BLOCKED).alias("blocked"), count(F.col("here")).alias("here"))


def key_token(code: Column) -> Column:
    """The lower-case name of a key from its code; null for a key that has none."""
    names = F.create_map(*(F.lit(x) for kv in KEY_NAMES.items() for x in kv))
    plain = F.regexp_extract(code, "^(?:Key([A-Z])|Digit([0-9]))$", 0)
    return (
        F.when(plain != "", F.lower(F.right(code, F.lit(1))))
        .when(code.rlike("^F([1-9]|1[0-9]|2[0-4])$"), F.lower(code))
        .when(code.rlike("^Numpad[0-9]$"), F.lower(code))
        .otherwise(F.element_at(names, code))
    )


def key_chord(ctrl: Column, alt: Column, shift: Column, win: Column, code: Column) -> Column:
    """Modifiers and the key's name joined by plus signs; null for a key that has none."""
    key = key_token(code)
    on = lambda c, name: F.when(c, F.lit(name))
    return F.when(key.isNotNull(), F.concat_ws("+", on(ctrl, "ctrl"), on(alt, "alt"), on(shift, "shift"), on(win, "win"), key))


def registrar_action(current_source: Column, next_source: Column, current: Column, wanted: Column, contested: Column) -> Column:
    """What saving a hotkey does.  Sources: 'own', or 'other' for a program that holds it in this one's place."""
    return (
        F.when(next_source == "other", "hand_over")
        .when(current_source == "other", "take_back")
        .when(~current.eqNullSafe(wanted), "replace")
        .when(contested, "retry")
        .otherwise("nothing")
    )


def rotated(files: DataFrame, order: str, keep: int) -> DataFrame:
    """Files that go: all but the newest so many."""
    return files.join(F.broadcast(files.orderBy(F.desc(order)).limit(keep).select(order)), order, "left_anti")


def crash_free(sessions: DataFrame, by: str) -> DataFrame:
    """Share of sessions (crashed: boolean) that did not crash."""
    return sessions.groupBy(by).agg((1 - F.count(F.when(F.col("crashed"), 1)) / F.count("*")).alias("crash_free"))


def volume_status(volumes: DataFrame) -> DataFrame:
    """volumes (paused, rebuilding) with status: paused, else rebuilding, else ready."""
    return volumes.withColumn("status", F.when(F.col("paused"), "paused").when(F.col("rebuilding"), "rebuilding").otherwise("ready"))
