"""Language identification of pages by Bayesian evidence fusion.

Evidence on a page, each as a likelihood of every language:

* its text: byte trigrams, counted by language over all labelled documents;
* the language its markup declares (in the first ``<html>`` tag, or the first content-language meta);
* its address: a language code as a path segment or host label, or a country suffix;
* its host: the languages of the host's pages, smoothed towards those of its
  domain, these towards those of the suffix, and these towards all pages.

What a declaration or an address says is worth what it proved to be worth:
agreement with the texts' languages is counted over all pages, with add-one
smoothing.  Host counts are sums of the texts' posteriors by grouped
aggregation, less the page's own.

Null html or url is empty: such evidence is neutral, and a page without any has
the priors' language.  Rows with the same page_id get a row each.  Null labels
are left out; with no labelled text lang is null.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.llm.core import LOWER, docs_table, join_known, map_arrow, mix, text_groups, written

#: Trigrams are told apart by so many bits of a hash, less one for each doubling of languages beyond those whose table has MOST_CELLS.
TRIGRAM_BITS = 16
MOST_CELLS = 1 << 24
#: A text is as certain as so many trigrams at most, as neighbouring trigrams say much the same.
CERTAIN_AT = 60
#: Strength of the prior at each level of host, domain and suffix, in pages.
STRENGTH = 4.0

_RAW = re.compile(rb"<(script|style)\b", re.I)
_ENTITY = re.compile(rb"&#?\w+;")


def visible(html: bytes) -> bytes:
    """The text outside tags, comments, scripts and styles, in one pass; what is never closed is text, or a tag of its own."""
    low, out, at, open_ended = html.lower(), [], 0, set()
    while (k := html.find(b"<", at)) >= 0:
        out.append(html[at:k])
        kind = b"!--" if low.startswith(b"<!--", k) else m[1].lower() if (m := _RAW.match(html, k)) else b""
        end = -1
        if kind and kind not in open_ended:
            if kind == b"!--":
                end = html.find(b"-->", k + 4)
                end += 3 if end >= 0 else 0
            else:
                end = low.find(b"</" + kind, k)
                end = html.find(b">", end) + 1 if end >= 0 else -1
            if end <= 0:
                open_ended.add(kind)
        if end <= 0:
            end = html.find(b">", k) + 1
        if end <= 0:
            at = k
            break
        at = end
    out.append(html[at:])
    return _ENTITY.sub(b" ", b" ".join(out))


def trigram_bins(buf: np.ndarray, bits: int = TRIGRAM_BITS) -> np.ndarray:
    """Bins of the trigrams of folded bytes in which white space and marks are one blank; none for digits and runs of blanks."""
    x = PLAIN[buf].astype(np.uint64)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    key = x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:]
    blank = (x == 32).astype(np.int8)
    return np.where(blank[:-2] + blank[1:-1] + blank[2:] < 2, (mix(key) & np.uint64((1 << bits) - 1)).astype(np.int64), -1)


PLAIN = LOWER.copy()
PLAIN[[c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122)]] = 32


def table_bits(languages: int) -> int:
    return max(8, min(TRIGRAM_BITS, (MOST_CELLS // max(languages, 1)).bit_length() - 1))


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log P(trigram bin | language) as a table of bins by languages.  Counts cover all labelled rows."""
    known = docs.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # a row a language
    bits = table_bits(len(langs))
    place = {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            of = batch.column("lang").to_pylist()
            for a, b, buf, off in text_groups(batch.column("text")):
                bins = trigram_bins(buf, bits)
                lang = np.array([place.get(x, -1) for x in of[a:b]])
                at = np.repeat(lang, np.diff(off))[: len(bins)]
                for k in np.unique(lang[lang >= 0]).tolist():
                    mine = bins[(at == k) & (bins >= 0)]
                    if k not in total:
                        total[k] = np.zeros(1 << bits, np.int64)
                    total[k] += np.bincount(mine, minlength=1 << bits)
        for k, v in total.items():
            some = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(some), pa.array(v[some])], ["lang", "bin", "n"])

    rows = map_arrow(known, count, "lang long, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()  # at most MOST_CELLS rows
    table = np.full((1 << bits, len(langs)), 0.5)
    if rows.num_rows:
        table[rows.column("bin").to_numpy(), rows.column("lang").to_numpy()] += rows.column("n").to_numpy()
    return langs, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def _text_likelihoods(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """Adds text: the log-likelihoods of the page's visible text, and drops html."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = [c for c in pages.columns if c != "html"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            plain = [visible((x or "").encode("utf-8")) for x in batch.column("html").to_pylist()]
            out = []
            for text in plain:
                bins = trigram_bins(np.frombuffer(text, np.uint8), table_bits(len(langs)))
                bins = bins[bins >= 0]
                ll = table[bins].mean(axis=0) * min(len(bins), CERTAIN_AT) if len(bins) else np.zeros(table.shape[1])
                out.append(ll.astype(np.float64).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.list_(pa.float64()))], [*names, "text"])

    schema = ", ".join(f"{n} {t}" for n, t in pages.drop("html").dtypes)
    return map_arrow(pages, score, f"{schema}, text array<double>")


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sum_by_place(name: str, n: int) -> Column:
    return F.array(*(F.sum(F.col(name)[k]) for k in range(n)))


def _add(*arrays: Column) -> Column:
    out = arrays[0]
    for x in arrays[1:]:
        out = F.zip_with(out, x, lambda a, b: a + b)
    return out


def _reliability(pages: DataFrame, code: str, langs: list[str]) -> Column:
    """log P(code | language) of column code (a place in langs, or -1 for no or another code), counted over all pages."""
    n = len(langs)
    rows = pages.groupBy(code).agg(_sum_by_place("post", n).alias("w")).collect()  # at most one row a language, and one
    table = np.ones((n + 1, n))
    for r in rows:
        table[r[code] if r[code] >= 0 else n] += r["w"]
    logs = np.log(table / table.sum(axis=0, keepdims=True))
    choices = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in logs))
    return F.element_at(choices, F.when(F.col(code) >= 0, F.col(code) + 1).otherwise(n + 1).cast("int"))


def language_id(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, confidence, and the language by each kind of evidence alone (text_lang, declared, addressed) of each row of pages."""
    langs, model = text_model(docs)
    n = len(langs)
    if not n:
        none = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("long").alias("page_id"), none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), none.alias("declared"), none.alias("addressed"))
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.lower(F.coalesce(F.col("url").cast("string"), F.lit("")))
    names = F.array(*(F.lit(x) for x in langs))
    place = lambda code: (F.array_position(names, F.lower(F.substring(code, 1, 2))) - 1).cast("int")
    some = lambda c: F.nullif(c, F.lit(""))
    meta = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b([^>]*+)"), F.lit(1)), lambda x: x.rlike("(?i)content-language"))
    said = F.coalesce(
        some(F.regexp_extract(F.regexp_extract(html, r"(?i)<html\b([^>]*+)", 1), r"(?i)\blang\s*+=\s*+[\"']?([a-z]{2})\b", 1)),
        some(F.regexp_extract(F.get(meta, F.lit(0)), r"(?i)\bcontent\s*+=\s*+[\"']?([a-z]{2})\b", 1)),
        F.lit("--"),
    )
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)
    label = F.filter(F.split(host, r"\."), lambda x: F.array_contains(names, x))
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/]*/([a-z]{2})(?:[-_][a-z]{2})?(?:[/?#]|$)", 1)
    inside = F.coalesce(F.when(F.array_contains(names, path), path), F.get(F.reverse(label), F.lit(0)), F.lit("--"))
    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"), html.alias("html"), host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"),
        place(said).alias("said"), place(inside).alias("inside"),
    )
    seen = written(_text_likelihoods(plain, langs, model).withColumn("post", _softmax(F.col("text"))), "pages")

    # hosts, domains and suffixes: each level's languages lean on the next
    size = lambda w: F.aggregate(w, F.lit(0.0), lambda a, b: a + b)
    lean = lambda w, up: F.transform(F.arrays_zip(w.alias("w"), up.alias("up")), lambda x: (x["w"] + STRENGTH * x["up"]) / (size(w) + STRENGTH))
    all_ = seen.agg(_sum_by_place("post", n).alias("w")).first()["w"]
    every = np.array([x or 0.0 for x in all_]) + 1
    whole = F.array(*(F.lit(float(x)) for x in every / every.sum()))
    hosts = written(seen.groupBy("host", "domain", "suffix").agg(_sum_by_place("post", n).alias("w"), F.count("*").alias("n")), "hosts")
    suffixes = hosts.groupBy("suffix").agg(_sum_by_place("w", n).alias("w")).select("suffix", lean(F.col("w"), whole).alias("up2"))
    domains = hosts.groupBy("domain", "suffix").agg(_sum_by_place("w", n).alias("w")).join(suffixes, "suffix").select("domain", "suffix", lean(F.col("w"), F.col("up2")).alias("up1"))
    priors = hosts.join(domains, ["domain", "suffix"]).select("host", "n", F.col("w").alias("host_w"), "up1")
    priors = written(priors, "priors")

    declared, addressed = _reliability(seen, "said", langs), _reliability(seen, "inside", langs)
    others = F.zip_with("host_w", "post", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    joined = join_known(seen, priors, "host").withColumn("prior", lean(others, F.col("up1")))
    logs = _add(F.col("text"), F.transform("prior", lambda x: F.ln(F.greatest(x, F.lit(1e-9)))), declared, addressed)
    fused = joined.withColumn("fused", _softmax(logs))
    name = lambda k: F.when(k >= 0, F.get(names, k))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return fused.select(
        "page_id", best(F.col("fused")).alias("lang"), F.array_max("fused").alias("confidence"), best(F.col("text")).alias("text_lang"),
        name(F.col("said")).alias("declared"), name(F.col("inside")).alias("addressed"),
    )


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(docs_table(spark, sf_dir, "pages"), docs_table(spark, sf_dir))
