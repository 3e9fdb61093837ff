"""Match ranges for a page's rows: which UTF-16 units of a name a query matched."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from rankfield.functions.text import INDEX_SEPARATORS, fold_text, fold_with_map, segment_starts


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hits(text: str, q: str) -> list[int]:
    out, at = [], text.find(q)
    while at >= 0:
        out.append(at)
        at = text.find(q, at + len(q))
    return out


def match_ranges(name: str, query: str, tier: str) -> list[tuple[int, int]]:
    """Half-open ranges of UTF-16 units, touching ones merged."""
    import unicodedata

    folded, at = fold_with_map(name)
    q = fold_text(query)
    unit = lambda a, b: (at[a], at[b])
    if tier == "exact":
        return [unit(0, len(folded))]
    if tier in ("prefix", "substring"):
        k = folded.find(q)
        return [unit(k, k + len(q))] if k >= 0 else []
    if tier == "word":
        k = next((x for x in _hits(folded, q) if x and folded[x - 1] in INDEX_SEPARATORS), -1)
        if k < 0:
            return []
        end = k
        while end < len(folded) and folded[end] not in INDEX_SEPARATORS:
            end += 1
        return [unit(k, max(end, k + len(q)))]
    if tier == "initials":
        plain = unicodedata.normalize("NFC", name)
        starts = segment_starts(plain)
        lane = "".join(fold_text(plain[k]) for k in starts)
        k = lane.find(q)
        if k < 0:
            return []
        offset = [len(plain[:x].encode("utf-16-le")) // 2 for x in starts[k : k + len(q)]]
        return _merged([(x, x + 1) for x in offset])
    out, place = [], 0
    for c in q:
        k = folded.find(c, place)
        if k < 0:
            return []
        out.append(unit(k, k + 1))
        place = k + 1
    return _merged(out)


@F.pandas_udf(ArrayType(StructType([StructField("s", IntegerType()), StructField("e", IntegerType())])))
def ranges_column(name: pd.Series, query: pd.Series, tier: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"s": a, "e": b} for a, b in match_ranges(n, q, t)] for n, q, t in zip(name, query, tier)])
