"""Normalisation and tokenisation of names: folding, segments, initials, class masks, UTF-16 offsets.

``fold`` and its kin are native for ASCII text; text beyond ASCII goes through
an Arrow UDF, as Spark has no NFC and its ``lower`` differs from a character by
character mapping.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

#: Fixed value: separators of the index matcher.
INDEX_SEPARATORS = "-_. "

#: An initials lane holds this many bytes; names and queries are cut at this many.
LANE_BYTES = 8
MOST_NAME_BYTES = 65535

_JAVA_INDEX = r"[-_. \x01]+"
_HUMP = r"(\p{Ll})(\p{Lu})"


def fold_text(s: str) -> str:
    """NFC, then each character's full lower-case form by itself."""
    return "".join(c.lower() for c in unicodedata.normalize("NFC", s))


@F.pandas_udf(StringType())
def fold_any(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


def segment_starts(name: str) -> list[int]:
    """Places in name where a segment begins: after a separator, or at a camel hump."""
    out, before = [], ""
    for k, c in enumerate(name):
        if c not in INDEX_SEPARATORS and (not before or before in INDEX_SEPARATORS or (before.islower() and c.isupper())):
            out.append(k)
        before = c
    return out


def initials_text(name: str) -> str:
    """Folded first characters of the segments, up to the first that would pass LANE_BYTES bytes."""
    plain, out = unicodedata.normalize("NFC", name), ""
    for k in segment_starts(plain):
        more = out + fold_text(plain[k])
        if len(more.encode()) > LANE_BYTES:
            break
        out = more
    return out


@F.pandas_udf(StringType())
def initials_any(s: pd.Series) -> pd.Series:
    return s.map(initials_text, na_action="ignore")


def is_ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7f]")


def fold_unicode(c: Column) -> Column:
    """fold_text of a column; only text beyond ASCII goes to Python."""
    return F.coalesce(F.when(is_ascii(c), F.lower(c)), fold_any(F.when(~is_ascii(c), c)))


def has_control(c: Column) -> Column:
    return c.rlike(r"[\x00-\x1f]")


def usable_name(c: Column) -> Column:
    """Names that an index keeps: not empty, no control byte."""
    return c.isNotNull() & (c != "") & ~has_control(c)


def cut_to_bytes(c: Column, limit: int = MOST_NAME_BYTES) -> Column:
    """At most limit bytes, on a character boundary; native, as only a rare long text needs the search."""
    n = F.length(c)
    fits = lambda k: F.octet_length(F.left(c, k)) <= limit
    short = F.element_at(F.filter(F.sequence(F.lit(limit), F.lit(limit // 4), F.lit(-1)), lambda k: (k <= n) & fits(k)), 1)
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.left(c, short))


def segments(c: Column) -> Column:
    """Parts of a name between separators and before camel humps, in original case."""
    marked = F.regexp_replace(c, _HUMP, "$1\x01$2")
    return F.filter(F.split(marked, _JAVA_INDEX), lambda x: x != "")


def initials_ascii(c: Column) -> Column:
    """initials_text of names that are ASCII."""
    firsts = F.transform(segments(c), lambda x: F.lower(F.left(x, F.lit(1))))
    return F.left(F.array_join(firsts, ""), F.lit(LANE_BYTES))


def initials(c: Column) -> Column:
    """initials_text of a column; only names beyond ASCII go to Python."""
    return F.coalesce(F.when(is_ascii(c), initials_ascii(c)), initials_any(F.when(~is_ascii(c), c)))


def class_bit(code: Column) -> Column:
    """The bit of one byte: a letter, a digit, a separator, or one of 24 buckets of other bytes.  The numbers are fixed values."""
    return (
        F.when(code.between(97, 122), code - 97)
        .when(code.between(48, 57), code - 48 + 26)
        .when(code == 45, 36)
        .when(code == 95, 37)
        .when(code == 46, 38)
        .when(code == 32, 39)
        .when(code < 128, 40 + code.bitwiseAND(7))
        .otherwise(48 + code.bitwiseAND(15))
    )


def _mask(codes: Column) -> Column:
    bits = F.transform(codes, lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), class_bit(c).cast("int")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def class_mask(folded: Column) -> Column:
    """A long with a bit for each class of byte in folded; a query's mask must be within a name's for any match."""
    pairs = F.filter(F.split(F.hex(folded), "(?<=\\G..)"), lambda x: x != "")
    return _mask(F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int")))


def class_mask_ascii(folded: Column) -> Column:
    """class_mask of text that is ASCII."""
    return _mask(F.transform(F.filter(F.split(folded, ""), lambda x: x != ""), lambda x: F.ascii(x)))


@F.pandas_udf(LongType())
def mask_any(folded: pd.Series) -> pd.Series:
    return folded.map(mask_of, na_action="ignore").astype("Int64")


def mask_of(text: str) -> int:
    """class_mask of a query."""
    bits = 0
    for b in text.encode():
        c = chr(b)
        if "a" <= c <= "z" or "0" <= c <= "9":
            place = b - 97 if c >= "a" else b - 48 + 26
        else:
            place = {45: 36, 95: 37, 46: 38, 32: 39}.get(b, 40 + (b & 7) if b < 128 else 48 + (b & 15))
        bits |= 1 << place
    return bits - (1 << 64) if bits >> 63 else bits


@F.pandas_udf(IntegerType())
def utf16_length(s: pd.Series) -> pd.Series:
    return s.map(lambda x: len(x.encode("utf-16-le")) // 2, na_action="ignore").astype("Int32")


def fold_with_map(s: str) -> tuple[str, list[int]]:
    """Folded text, and for each of its characters the UTF-16 offset of its source character."""
    out, at, place = [], [], 0
    for c in unicodedata.normalize("NFC", s):
        low = c.lower()
        out.append(low)
        at += [place] * len(low)
        place += 2 if ord(c) > 0xFFFF else 1
    return "".join(out), [*at, place]
