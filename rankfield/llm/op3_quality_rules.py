"""Quality rules: learned decision lists over whole-text statistics.

Statistics of every text are computed once.  A base rule rejects very short and
very repetitive texts.  For the rest an ordered list of rules is learned by
sequential covering from labelled rows: each rule is a conjunction of
thresholds, grown by information gain on two thirds of the rows still to be
covered and pruned back on the last third; a rule that is not precise enough on
either part ends the list.  The list is then a ``CASE WHEN`` over the
statistics that Spark evaluates for all rows.

Null texts have no words.  Labels that are null, or of documents that are not
there, are left out; of several labels of one document the smallest holds.
With no usable labels the list is empty and only the base rule rejects.  Rows
with the same doc_id are judged one by one.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rankfield.llm.core import WHOLE, Words, docs_table, grouped, map_arrow, mix, span_hashes, unused_name, written

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: The list is learned from at most this many labelled rows, chosen by a hash of doc_id.
MOST_LABELLED = 60_000
#: A rule must reject mostly bad rows, on the rows it was grown on as on those it was pruned on.
PRECISION = 0.95
#: More labels than this are joined by a shuffle of the texts instead of a broadcast.
BROADCAST_LABELS = 1_000_000
MOST_RULES = 16
MOST_CONDITIONS = 4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_digits", "n_marks", "n_distinct")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL = _table(SYMBOLS)
UPPER = _table(bytes(range(65, 91)))
DIGIT = _table(bytes(range(48, 58)))
MARKS = _table(b"!?.,;:")


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[off])


def _again(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, how many of its text have its hash, and whether an earlier one has."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    key = mix(h ^ mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    group = np.cumsum(new) - 1
    count, later = np.empty(len(h), np.int64), np.empty(len(h), bool)
    count[order] = np.bincount(group)[group]
    later[order] = ~new
    return count, later


def text_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    w = Words(buf, off)
    n, doc = len(w), w.doc()
    size = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(WHOLE[buf], out=size[1:])
    h = w.hashes()
    out = {"n_words": w.count, "word_chars": np.bincount(doc, (size[w.end] - size[w.start]).astype(float), n).astype(np.int64)}
    out |= {k: _per_text(t[buf], off) for k, t in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_digits", DIGIT), ("n_marks", MARKS))}
    out["n_chars"] = np.diff(size[off])

    # lines: each text's start, and what follows each \n
    newline = np.flatnonzero(buf == 10)
    start = np.concatenate([off[:-1], newline + 1])
    of = np.concatenate([np.arange(n), np.searchsorted(off, newline, "right") - 1])
    order = np.lexsort((start, of))
    start, of = start[order], of[order]
    end = np.concatenate([start[1:] - 1, [0]])
    last = np.concatenate([of[1:] != of[:-1], [True]])
    end[last] = off[of[last] + 1]
    worded = np.flatnonzero(np.searchsorted(w.start, end) > np.searchsorted(w.start, start))
    _, later = _again(of[worded], span_hashes(buf, start[worded], end[worded]))
    out["n_lines"] = np.bincount(of[worded], minlength=n)
    out["n_dup_lines"] = np.bincount(of[worded[later]], minlength=n)

    at, windows = w.windows(h, WINDOW)
    count, _ = _again(doc[at], windows)
    cover = np.zeros(len(h) + 1, np.int64)
    many = at[count > 1]
    np.add.at(cover, many, 1)
    np.add.at(cover, many + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    _, later = _again(doc, h)
    out["n_distinct"] = np.bincount(doc[~later], minlength=n)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in grouped(batches):
            x = text_counts(buf, off)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), count, STATS)


def base_failed(at: str = "") -> Column:
    return (F.col(at + "n_words") < 10) | (100 * F.col(at + "n_repeat_words") > 20 * F.col(at + "n_words"))


def measures(at: str = "") -> dict[str, Column]:
    """What the learned rules compare: shares and sizes, none of them null.  at: what stands before the counts' names."""
    words, chars = F.greatest(F.col(at + "n_words"), F.lit(1)), F.greatest(F.col(at + "n_chars"), F.lit(1))
    return {
        "words": F.col(at + "n_words").cast("double"),
        "word_size": F.col(at + "word_chars") / words,
        "symbols_a_word": F.col(at + "n_symbols") / words,
        "dup_line_share": F.col(at + "n_dup_lines") / F.greatest(F.col(at + "n_lines"), F.lit(1)),
        "repeat_share": F.col(at + "n_repeat_words") / words,
        "words_a_line": F.col(at + "n_words") / F.greatest(F.col(at + "n_lines"), F.lit(1)),
        "upper_share": F.col(at + "n_upper") / chars,
        "digit_share": F.col(at + "n_digits") / chars,
        "marks_a_word": F.col(at + "n_marks") / words,
        "distinct_share": F.col(at + "n_distinct") / words,
    }


Rule = list[tuple[str, str, float]]


def _covers(x: dict[str, np.ndarray], rule: Rule, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, sign, value in rule:
        out &= x[name] >= value if sign == ">=" else x[name] < value
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the threshold of most information gain until no good row is left."""
    rule: Rule = []
    keep = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS:
        p, n = int((keep & bad).sum()), int((keep & ~bad).sum())
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (0.0, None)
        for name, values in x.items():
            v, b = values[keep], bad[keep]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1  # the first index at or above a threshold
            if not len(cut):
                continue
            below, total = np.cumsum(b)[cut - 1], p
            for sign, pos, size in (("<", below, cut), (">=", total - below, len(v) - cut)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1) / size) - base), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), (name, sign, float((v[cut[k]] + v[cut[k] - 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        keep &= _covers(x, [best[1]], len(bad))
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, order: np.ndarray) -> list[Rule]:
    """An ordered list of rules that reject.  order: an integer a row, which decides its part."""
    rules: list[Rule] = []
    part = order % 3 == 0
    left = np.ones(len(bad), bool)
    while len(rules) < MOST_RULES and (left & bad & ~part).sum() >= 5:
        grow, prune = left & ~part, left & part
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        test, truth = {k: v[prune] for k, v in x.items()}, bad[prune]

        def worth(r: Rule) -> float:
            c = _covers(test, r, len(truth))
            p, n = int((c & truth).sum()), int((c & ~truth).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = _covers(x, rule, len(bad)) & left
        right = [(int((covered & bad & m).sum()), int((covered & m).sum())) for m in (~part, part)]
        if not rule or not covered.any() or any(p < PRECISION * n for p, n in right):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def fit_rules(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """The rules from labelled rows that pass the base rule; bad is quality 0."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    names = list(measures())
    rows = stats.where(~base_failed()).select("doc_id", *(v.alias(k) for k, v in measures().items())).join(known, "doc_id")
    share = max(1, -(-known.count() * 21 // (20 * MOST_LABELLED)))
    if share > 1:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(MOST_LABELLED).toArrow()
    order = found.column("doc_id").to_numpy().astype(np.uint64)
    return learn({k: found.column(k).to_numpy() for k in names}, found.column("quality").to_numpy() == 0, mix(order))


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """False for the first rule that holds, else true."""
    at = measures(prefix)
    out = None
    for rule in rules:
        held = F.lit(True)
        for name, sign, value in rule:
            held = held & (at[name] >= value if sign == ">=" else at[name] < value)
        out = F.when(held, F.lit(False)) if out is None else out.when(held, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row of docs."""
    stats = written(statistics(docs), "statistics")
    rules = fit_rules(stats, labels)
    return stats.select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that no rule rejects, with docs's columns; texts pass through without a shuffle."""
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    few = known.count() <= BROADCAST_LABELS
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known) if few else known, "doc_id", "left_semi")
    rules = fit_rules(written(statistics(labelled), "statistics"), labels)
    column = unused_name("counts", docs)
    schema = StructType([*docs.schema.fields, StructField(column, StructType([StructField(c, LongType()) for c in COUNTS]))])
    names = docs.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in grouped(batches):
            x = text_counts(buf, off)
            counts = pa.StructArray.from_arrays([pa.array(x[c], pa.int64()) for c in COUNTS], list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], [*names, column])

    return map_arrow(docs, count, schema).where(~base_failed(column + ".") & verdict(rules, column + ".")).drop(column)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(docs_table(spark, sf_dir), docs_table(spark, sf_dir, "labels"))
