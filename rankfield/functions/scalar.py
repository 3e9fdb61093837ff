"""Scalar functions beside the matchers: hashes, paths, rectangles, hotkeys, units, markers, accents of the shell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rankfield.functions.calc import TEMPERATURES, UNITS

#: Parameters of the 64-bit content hash.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


#: Rows whose bytes are hashed side by side.
_HASHED_AT_ONCE = 2048


def _fnv1a_all(texts: list[bytes]) -> np.ndarray:
    """Hashes of many texts: the n-th byte of all that have one, then the next."""
    size = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    data, first = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
    h = np.full(len(texts), FNV_START, np.uint64)
    longest, at = size[order], first[order]
    for k in range(int(longest[0]) if len(longest) else 0):
        n = int(np.searchsorted(-longest, -k, "left"))  # those with more than k bytes
        h[:n] = (h[:n] ^ data[at[:n] + k]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


@F.pandas_udf(LongType())
def fnv1a_column(s: pd.Series) -> pd.Series:
    out = pd.array([None] * len(s), dtype="Int64")
    known = np.flatnonzero(s.notna().to_numpy())
    for a in range(0, len(known), _HASHED_AT_ONCE):
        part = known[a : a + _HASHED_AT_ONCE]
        out[part] = _fnv1a_all([x.encode() for x in s.iloc[part]]).view(np.int64)
    return pd.Series(out)


def parent_of(path: Column) -> Column:
    """What stands before the last backslash; '' without one."""
    return F.when(F.instr(path, "\\") > 0, F.regexp_extract(path, r"(?s)^(.*)\\[^\\]*$", 1)).otherwise("")


def normalized_root(path: Column) -> Column:
    """Forward slashes turned, one trailing backslash dropped."""
    return F.regexp_replace(F.replace(path, F.lit("/"), F.lit("\\")), r"\\+$", "")


def drive_of(text: Column) -> Column:
    """The letter of c, c: or c:\\, upper case; null for others."""
    return F.nullif(F.upper(F.regexp_extract(text, r"^([A-Za-z]):?\\?$", 1)), F.lit(""))


def marker_field(text: Column, key: str) -> Column:
    """The number of key=number among a marker's words."""
    return F.nullif(F.regexp_extract(text, rf"(?:^|\s){key}=([0-9]+)", 1), F.lit("")).cast("long")


def convert(value: Column, a: str, b: str) -> Column:
    """value in unit b, given in unit a; temperatures by way of kelvin.  Units that measure different things are an error."""
    a, b = a.lower(), b.lower()
    if a in TEMPERATURES and b in TEMPERATURES:
        kelvin = {"c": value + 273.15, "f": (value - 32) * 5 / 9 + 273.15, "k": value}[TEMPERATURES[a]]
        return {"c": kelvin - 273.15, "f": (kelvin - 273.15) * 9 / 5 + 32, "k": kelvin}[TEMPERATURES[b]]
    table = next((t for t in UNITS.values() if a in t and b in t), None)
    if table is None:
        raise ValueError(f"{a} and {b} measure different things")
    return value * table[a] / table[b]


#: Layout presets as left, top, width and height in shares of the work area.
TILES = {
    "left_half": (0, 0, 1 / 2, 1), "right_half": (1 / 2, 0, 1 / 2, 1), "top_half": (0, 0, 1, 1 / 2), "bottom_half": (0, 1 / 2, 1, 1 / 2),
    "left_third": (0, 0, 1 / 3, 1), "center_third": (1 / 3, 0, 1 / 3, 1), "right_third": (2 / 3, 0, 1 / 3, 1), "left_two_thirds": (0, 0, 2 / 3, 1), "right_two_thirds": (1 / 3, 0, 2 / 3, 1),
    "top_left": (0, 0, 1 / 2, 1 / 2), "top_right": (1 / 2, 0, 1 / 2, 1 / 2), "bottom_left": (0, 1 / 2, 1 / 2, 1 / 2), "bottom_right": (1 / 2, 1 / 2, 1 / 2, 1 / 2),
    "maximize": (0, 0, 1, 1), "center": (0.25, 0.125, 0.5, 0.75),
}
#: A window's width and height at 96 dots an inch, its greatest share of the work area's width, and how far down it stands.
WINDOW_WIDTH, WINDOW_HEIGHT, DOTS, WIDEST, DOWN = 680, 480, 96, (9, 10), 5


def _rect(**sides: Column) -> Column:
    return F.struct(*(c.cast("int").alias(k) for k, c in sides.items()))


def tile(x: Column, y: Column, w: Column, h: Column, preset: str) -> Column:
    """The preset's rectangle in a work area: place and size rounded each by itself, and no side under a pixel.  Null for no preset."""
    if preset not in TILES:
        return F.lit(None).cast("struct<x:int,y:int,w:int,h:int>")
    left, top, width, height = TILES[preset]
    part = lambda size, share: F.round(size * F.lit(float(share)))
    return _rect(x=x + part(w, left), y=y + part(h, top), w=F.greatest(part(w, width), F.lit(1)), h=F.greatest(part(h, height), F.lit(1)))


def remap(rect: list[Column], here: list[Column], there: list[Column]) -> Column:
    """A rectangle of one work area at the same shares of another, pushed back inside it; all as left, top, right, bottom."""

    def side(low: Column, high: Column, a0: Column, a1: Column, b0: Column, b1: Column) -> tuple[Column, Column]:
        span = F.greatest(a1 - a0, F.lit(1))
        share = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / span))
        size = F.greatest(F.round((b1 - b0) * share(high - low)), F.lit(1))
        return F.least(b0 + F.round((b1 - b0) * share(low - a0)), b1 - size), size

    x, w = side(rect[0], rect[2], here[0], here[2], there[0], there[2])
    y, h = side(rect[1], rect[3], here[1], here[3], there[1], there[3])
    return _rect(x=x, y=y, w=w, h=h)


def placement(left: Column, top: Column, right: Column, bottom: Column, dpi: Column, height: int = WINDOW_HEIGHT) -> Column:
    """Where a window stands in a work area: in the middle, a fifth down, as wide and high as its dots allow and the area has room for."""
    width, tall = F.greatest(right - left, F.lit(1)), F.greatest(bottom - top, F.lit(1))
    scale = lambda v: F.floor(F.lit(v) * F.when(dpi == 0, DOTS).otherwise(dpi) / DOTS)
    w = F.least(scale(WINDOW_WIDTH), F.floor(width * WIDEST[0] / WIDEST[1]))
    y = top + F.floor(tall / DOWN)
    h = F.least(scale(height), F.greatest(bottom - y, F.lit(1)))
    half = (width - w) / 2
    return _rect(x=left + F.when(half < 0, F.ceil(half)).otherwise(F.floor(half)), y=y, w=F.greatest(w, F.lit(1)), h=F.greatest(h, F.lit(1)))


#: Keys that are modifiers themselves, and owners of chords as ctrl, alt, shift, win and key.
LONE_MODIFIERS = ("ControlLeft", "ControlRight", "AltLeft", "AltRight", "ShiftLeft", "ShiftRight", "MetaLeft", "MetaRight")
OWNERS = {
    (False, True, False, False, "Space"): "PowerToys Run, or Copilot on some Windows 11 builds",
    (False, True, False, True, "Space"): "PowerToys Command Palette",
    (False, False, False, True, "Space"): "the Windows input-language switcher",
}


def accelerator(ctrl: Column, alt: Column, shift: Column, win: Column, key: Column) -> Column:
    """Modifiers, by their system names, and key, joined by plus signs."""
    on = lambda c, name: F.when(c, F.lit(name))
    return F.concat_ws("+", on(ctrl, "Control"), on(alt, "Alt"), on(shift, "Shift"), on(win, "Super"), key)


def hotkey_problem(ctrl: Column, alt: Column, shift: Column, win: Column, key: Column) -> Column:
    """Why a hotkey cannot be taken; null if it can."""
    return (
        F.when(F.coalesce(key, F.lit("")) == "", "key missing")
        .when(key == "F12", "kept for debuggers")
        .when(~(ctrl | alt | shift | win), "no modifier")
        .when(key.isin(*LONE_MODIFIERS), "the key is a modifier")
    )


def hotkey_warning(win: Column) -> Column:
    """What speaks against a hotkey that can be taken; null if nothing does."""
    return F.when(win, "most chords with the system key are taken")


def hotkey_owner(ctrl: Column, alt: Column, shift: Column, win: Column, key: Column) -> Column:
    """Who likely holds a chord that could not be had; null for others."""
    out = F.lit(None).cast("string")
    for (*wanted, k), owner in OWNERS.items():
        same = key == k
        for c, w in zip((ctrl, alt, shift, win), wanted):
            same = same & (c == F.lit(w))
        out = F.when(same, owner).otherwise(out)
    return out


def url_for(template: Column, query: Column) -> Column:
    """A quicklink with the percent-encoded query in place of {query}."""
    return F.replace(template, F.lit("{query}"), F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")))


def snippet(template: Column, clipboard: Column, now: Column) -> tuple[Column, Column]:
    """A snippet's text with {clipboard} and {date:FORMAT} (the first format holds for all) filled in, and where {cursor} stood in it; null without one."""
    given = F.regexp_extract(template, r"\{date:([^}]*)\}", 1)
    dated = F.regexp_replace(template, F.lit(r"\{date:[^}]*\}"), F.when(given != "", F.call_function("date_format", now, given)).otherwise(F.lit("")))
    whole = F.replace(dated, F.lit("{clipboard}"), clipboard)
    at = F.instr(whole, "{cursor}")
    return F.replace(whole, F.lit("{cursor}"), F.lit("")), F.when(at > 0, at - 1)
