"""Toxicity by class-conditional Kneser-Ney models.

Two models of the same shape, one of toxic and one of ordinary text, tell the
words of a text (lower-cased, cut from their punctuation).  A word is told in
steps, its first characters up to each length of STEPS and then the whole, each
given the step before, so that unseen forms of a known stem count.  From every
count of a class DISCOUNT is taken, and what that leaves goes to a distribution
that the classes share: for a word's first step by continuation counts (after
how many different words it was seen), for later steps by the discounted counts
of both classes.  Expressions seen less than LEAST times are one symbol of their
context, "other", which is counted and told as any; so each model's
probabilities sum to one.  After a step too rare to be known both models say
the same.

A text's log-likelihoods are compared per word, over the whole text and over its
strongest runs of words; long texts with a few toxic words show in those.  A
logistic curve over these length-normalised differences gives the score.  It is
fitted on one in CURVE_SHARE labelled training rows with models that were not
given them; the models that score are given every labelled training row.

What a word says of the next one is not used: on the held-out rows of 10,000
documents it lowered the area under the curve from 0.92 to 0.87.

The driver and the scorers get at most MOST_FIRST first steps and MOST_PAIRS
pairs of steps as tables, the most frequent ones; what a text holds of the others
is looked up by a join, so every step seen LEAST times is told as the model
tells it, however many there are.  Steps are known by
64-bit hashes.  Labels come from training rows only (crc32 of doc_id modulo 4 is
not 2).

Null texts are empty; a text without words scores as one whose differences are
zero.  Null labels and labels of absent documents are left out; of several
labels of a document the largest holds.  Without both classes every text scores
0.  Rows with the same doc_id get a row each; a null doc_id is not held out.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfield.llm.core import WHOLE, docs_table, grouped, map_arrow, mix, span_hashes, written
from rankfield.llm.tokens import cut_pieces

#: Taken from every count.
DISCOUNT = 0.75
#: Expressions seen less often are told as "other".
LEAST = 8
#: A word's first characters that make its steps.
STEPS = (4, 7)
#: Lengths of the runs of words.
RUNS = (2, 8, 40)
#: The logistic curve is fitted on at most this many labelled rows.
MOST_LABELLED = 40_000
#: One in so many labelled training rows fits the curve.
CURVE_SHARE = 3
THRESHOLD = 0.3
#: Sizes of the models' tables.
MOST_FIRST = 1 << 18
MOST_PAIRS = 1 << 19
#: More labels than this are joined by a shuffle of the texts instead of a broadcast.
BROADCAST_LABELS = 1_000_000
HELD_PAIRS = 1_500_000

MEASURES = len(RUNS) + 2
#: Occurrences in ordinary and toxic text, in all labelled rows and in those that the curve is not fitted on.
COUNTS = ("n0", "n1", "m0", "m1")
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def held_out(buckets: int = 4) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(buckets)) == 2, F.lit(False))


def steps(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words' steps, the word of each step, whether it follows a step of its word; the text of each word."""
    low, start, end, first = cut_pieces(buf, off)
    begins = np.flatnonzero(WHOLE[low])  # of characters
    number = np.searchsorted(begins, start)
    size = np.searchsorted(begins, end) - number
    parts, words = [], []
    for step in STEPS:
        w = np.flatnonzero(size > step)
        parts.append(span_hashes(low, start[w], begins[number[w] + step]))
        words.append(w)
    parts.append(span_hashes(low, start, end))
    words.append(np.arange(len(start)))
    word = np.concatenate(words)
    order = np.argsort(word, kind="stable")
    word = word[order]
    follows = np.zeros(len(word), bool)
    follows[1:] = word[1:] == word[:-1]
    return np.concatenate(parts)[order], word, follows, np.repeat(np.arange(len(off) - 1), np.diff(first))


def pair_keys(before: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR ^ mix(piece))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences (COUNTS) of each step after the one before, summed up to HELD_PAIRS pairs before they are sent.

    before: the step before in the word; for a first step that of the word before, or 0.
    """
    held: list[tuple[np.ndarray, ...]] = []  # key, first, before, piece, and counts

    def merged() -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(x) for x in zip(*held)]
        key, at, which = np.unique(columns[0], return_index=True, return_inverse=True)
        return key, *(c[at] for c in columns[1:4]), *(np.bincount(which, c, len(key)).astype(np.int64) for c in columns[4:])

    def sent(key: np.ndarray, first: np.ndarray, before: np.ndarray, piece: np.ndarray, *counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(first), pa.array(before.view(np.int64)), pa.array(piece.view(np.int64)), *map(pa.array, counts)], ["first", "before", "piece", *COUNTS])

    for batch, buf, off in grouped(batches):
        piece, word, follows, doc = steps(buf, off)
        if not len(piece):
            continue
        before = np.zeros(len(piece), np.uint64)
        before[1:][follows[1:]] = piece[:-1][follows[1:]]
        first = np.flatnonzero(~follows)
        linked = np.flatnonzero(doc[word[first[1:]]] == doc[word[first[:-1]]]) + 1
        before[first[linked]] = piece[first[linked - 1]]
        toxic, kept = (batch.column(c).to_numpy(zero_copy_only=False)[doc[word]] > 0 for c in ("toxic", "fold"))
        key, at, which = np.unique(pair_keys(before, piece) ^ follows, return_index=True, return_inverse=True)
        held.append((key, ~follows[at], before[at], piece[at], *(np.bincount(which[m], minlength=len(key)) for m in (~toxic, toxic, ~toxic & kept, toxic & kept))))
        if sum(len(x[0]) for x in held) > HELD_PAIRS:
            held = [merged()]
            if len(held[0][0]) > HELD_PAIRS // 2:
                yield sent(*held.pop())
    if held:
        yield sent(*merged())


def told(group: np.ndarray, n: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Kneser-Ney probabilities of symbols within their groups: n less DISCOUNT, and what that leaves by base, which sums to one in a group."""
    total = np.bincount(group, n)[group]
    kept = np.maximum(n - DISCOUNT, 0)
    left = total - np.bincount(group, kept)[group]
    return np.where(total > 0, (kept + left * base) / np.maximum(total, 1), base)


def both(group: np.ndarray, n0: np.ndarray, n1: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
    """Probabilities of symbols in ordinary and in toxic text, as two rows; base: shared, by default from the counts of both."""
    if base is None:
        base = told(group, n0 + n1, 1 / np.bincount(group)[group])
    return np.array([told(group, n0, base), told(group, n1, base)])


class Model:
    """Log-likelihood ratios, toxic to ordinary, by the hash of a first step, a pair of steps, and a step before."""

    def __init__(self, firsts: dict[str, np.ndarray], pairs: dict[str, np.ndarray], contexts: dict[str, np.ndarray]):
        """firsts: piece, n0, n1, kinds, the last row "other"; pairs: before, piece, n0, n1; contexts: before, n0, n1 of all that follows."""
        log = lambda p: np.log(p[1] / p[0]).astype(np.float32)
        base = firsts["kinds"] + 1.0
        ratio = log(both(np.zeros(len(base), np.int64), firsts["n0"], firsts["n1"], base / base.sum()))
        self.other = float(ratio[-1])
        self.first = self._sorted(firsts["piece"][:-1].view(np.uint64), ratio[:-1])
        names = contexts["before"].view(np.uint64)
        order = np.argsort(names)
        group = order[np.searchsorted(names[order], pairs["before"].view(np.uint64))] if len(names) else np.zeros(0, np.int64)
        rest = [np.maximum(contexts[c] - np.bincount(group, pairs[c], len(names)), 0) for c in ("n0", "n1")]
        ratio = log(both(np.concatenate([group, np.arange(len(names))]), *(np.concatenate([pairs[c], r]) for c, r in zip(("n0", "n1"), rest)))) if len(names) else np.zeros(0, np.float32)
        self.pair = self._sorted(pair_keys(pairs["before"].view(np.uint64), pairs["piece"].view(np.uint64)), ratio[: len(group)])
        self.context = self._sorted(names, ratio[len(group) :])

    @staticmethod
    def _sorted(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        return np.ascontiguousarray(key[order]), np.ascontiguousarray(value[order])

    @staticmethod
    def _look_up(table: tuple[np.ndarray, np.ndarray], key: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        kinds, which = np.unique(key, return_inverse=True)
        if not len(table[0]) or not len(kinds):
            return np.broadcast_to(np.float64(other), key.shape) if np.isscalar(other) else other
        at = np.minimum(np.searchsorted(table[0], kinds), len(table[0]) - 1)
        known = table[0][at] == kinds
        return np.where(known[which], table[1][at][which], other)

    @classmethod
    def of_tables(cls, other: float, *tables: tuple[np.ndarray, np.ndarray]) -> Model:
        """A model of what is known of it: keys and ratios of first steps, pairs and contexts."""
        out = cls.__new__(cls)
        out.other = other
        out.first, out.pair, out.context = (cls._sorted(*x) for x in tables)
        return out

    def ratios(self, piece: np.ndarray, follows: np.ndarray, more: Model | None = None) -> np.ndarray:
        """Log-likelihood ratio of each step; more: what these texts hold beyond this model's tables."""
        out = np.zeros(len(piece))
        first, later = np.flatnonzero(~follows), np.flatnonzero(follows)
        out[first] = self._look_up(self.first, piece[first], self.other if more is None else self._look_up(more.first, piece[first], self.other))
        rest = self._look_up(self.context, piece[later - 1], 0.0 if more is None else self._look_up(more.context, piece[later - 1], 0.0))
        key = pair_keys(piece[later - 1], piece[later])
        out[later] = self._look_up(self.pair, key, rest if more is None else self._look_up(more.pair, key, rest))
        return out

    def unknown(self, piece: np.ndarray, follows: np.ndarray) -> list[np.ndarray]:
        """By kind, places of steps that the tables do not tell, and their keys."""
        first, later = np.flatnonzero(~follows), np.flatnonzero(follows)
        out = []
        for table, at, key in ((self.first, first, piece[first]), (self.pair, later, pair_keys(piece[later - 1], piece[later])), (self.context, later, piece[later - 1])):
            far = self._look_up((table[0], np.zeros(len(table[0]))), key, 1.0) > 0
            out.append((at[far], key[far]))
        return out


def count_steps(rows: DataFrame) -> DataFrame:
    """first, before, piece and COUNTS of the steps of rows (text, toxic, fold)."""
    counted = map_arrow(rows.select("text", "toxic", "fold"), _count, "first boolean, before long, piece long, " + ", ".join(f"{c} long" for c in COUNTS))
    return written(counted.groupBy("first", "before", "piece").agg(*(F.sum(c).alias(c) for c in COUNTS)), "steps")


def _arrays(df: DataFrame) -> dict[str, np.ndarray]:
    t = df.toArrow()
    return {c: t.column(c).to_numpy() for c in t.column_names}


def fit_model(counts: DataFrame, names: tuple[str, str]) -> Model:
    """The model of two of COUNTS.  The driver gets at most MOST_FIRST and MOST_PAIRS rows, however many texts there are."""
    own = counts.select("first", "before", "piece", F.col(names[0]).alias("n0"), F.col(names[1]).alias("n1")).where("n0 + n1 > 0")
    sums = [F.sum(c).alias(c) for c in ("n0", "n1")]
    firsts = written(own.where("first").groupBy("piece").agg(*sums, F.count("*").alias("kinds")), "first-steps")
    later = own.where("not first").drop("first")
    least = LEAST
    while firsts.where(F.col("n0") + F.col("n1") >= least).count() > MOST_FIRST or later.where(F.col("n0") + F.col("n1") >= least).count() > MOST_PAIRS:
        least *= 2
    often = (F.col("n0") + F.col("n1")) >= least
    known = _arrays(firsts.where(often))
    rest = firsts.where(~often).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1", "kinds"))).first()
    known = {c: np.concatenate([x, np.array([0 if c == "piece" else rest[c]], np.int64)]) for c, x in known.items()}
    contexts = later.groupBy("before").agg(*sums, F.max(F.col("n0") + F.col("n1")).alias("most")).where(F.col("most") >= least).drop("most")
    return Model(known, _arrays(later.where(often)), _arrays(contexts))


def exact_ratios(counts: DataFrame, names: tuple[str, str]) -> tuple[DataFrame, float]:
    """kind (0 first step, 1 pair, 2 context), key, ratio and n of all of a model that fit_model would have on a driver without bounds, and its "other"."""
    own = counts.select("first", "before", "piece", F.col(names[0]).alias("n0"), F.col(names[1]).alias("n1")).where("n0 + n1 > 0")
    n, kept = F.col("n0") + F.col("n1"), lambda c: F.greatest(c - F.lit(DISCOUNT), F.lit(0.0))
    often = n >= LEAST
    sums = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    of_often = lambda c: F.coalesce(F.sum(F.when(often, c)), F.lit(0))
    told_as = lambda x, total, left, base: F.when(total > 0, (kept(x) + left * base) / F.greatest(total, F.lit(1))).otherwise(base)
    log = lambda p0, p1: F.ln(p1 / p0).cast("float")
    stats = lambda: [of_often(kept(F.col("n0"))).alias("s0"), of_often(kept(F.col("n1"))).alias("s1"), of_often(kept(n)).alias("s"), of_often(F.col("n0")).alias("o0"), of_often(F.col("n1")).alias("o1"), F.count(F.when(often, 1)).alias("k"), F.coalesce(F.sum("n0"), F.lit(0)).alias("t0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("t1")]
    firsts = written(own.where("first").groupBy("piece").agg(*sums, F.count("*").alias("kinds")), "first-steps")
    whole = firsts.agg(*stats(), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"), of_often(F.col("kinds")).alias("o"))
    rest = lambda x: [(F.col(f"t{c}") - F.col(f"o{c}")) if x is None else x[c] for c in (0, 1)]
    left = [F.col(f"t{c}") - F.col(f"s{c}") - kept(rest(None)[c]) for c in (0, 1)]
    ratio = lambda x, base: log(*(told_as(x[c], F.col(f"t{c}"), left[c], base) for c in (0, 1)))
    share = lambda kinds: (kinds + 1.0) / (F.col("kinds") + F.col("k") + 1.0)
    other = whole.select(ratio(rest(None), share(F.col("kinds") - F.col("o")))).first()[0]
    one = firsts.where(often).select("piece", F.col("n0").alias("x0"), F.col("n1").alias("x1"), F.col("kinds").alias("x")).crossJoin(F.broadcast(whole))
    x = [F.col("x0"), F.col("x1")]
    first = one.select(F.lit(0).cast("byte").alias("kind"), F.lit(0).cast("long").alias("before"), "piece", ratio(x, share(F.col("x"))).alias("ratio"), (x[0] + x[1]).alias("n"))
    later = own.where("not first")
    contexts = written(later.groupBy("before").agg(*stats(), F.max(n).alias("most")).where(F.col("most") >= LEAST), "contexts")
    both_left = F.col("t0") + F.col("t1") - F.col("s") - kept(rest(None)[0] + rest(None)[1])
    base = lambda x: told_as(x[0] + x[1], F.col("t0") + F.col("t1"), both_left, 1.0 / (F.col("k") + 1))
    pairs = later.where(often).select("before", "piece", F.col("n0").alias("x0"), F.col("n1").alias("x1")).join(contexts, "before")
    pair = pairs.select(F.lit(1).cast("byte").alias("kind"), "before", "piece", ratio(x, base(x)).alias("ratio"), (x[0] + x[1]).alias("n"))
    context = contexts.select(F.lit(2).cast("byte").alias("kind"), "before", F.lit(0).cast("long").alias("piece"), ratio(rest(None), base(rest(None))).alias("ratio"), F.col("most").alias("n"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, before, piece = (batch.column(c).to_numpy() for c in ("kind", "before", "piece"))
            key = np.where(kind == 1, pair_keys(before.view(np.uint64), piece.view(np.uint64)), np.where(kind == 0, piece, before).view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(key.view(np.int64)), batch.column("ratio"), batch.column("n")], ["kind", "key", "ratio", "n"])

    return written(map_arrow(first.unionByName(pair).unionByName(context), named, "kind byte, key long, ratio float, n long"), "ratios"), other


def _table_model(other: float, kind: np.ndarray, key: np.ndarray, ratio: np.ndarray) -> Model:
    return Model.of_tables(other, *((key[kind == k].view(np.uint64), ratio[kind == k]) for k in range(3)))


def whole_model(counts: DataFrame, names: tuple[str, str]) -> tuple[Model, DataFrame | None]:
    """The model of two of COUNTS with LEAST as it is, and what of it is beyond the tables' sizes: kind, key and ratio, to be joined.

    If all of it fits the tables there is no rest.
    """
    n = F.col(names[0]) + F.col(names[1])
    firsts = counts.where("first").groupBy("piece").agg(F.sum(n).alias("n")).where(F.col("n") >= LEAST).count()
    if firsts <= MOST_FIRST and counts.where(~F.col("first") & (n >= LEAST)).count() <= MOST_PAIRS:
        return fit_model(counts, names), None
    table, other = exact_ratios(counts, names)
    size = lambda least: {r["kind"]: r["count"] for r in table.where(F.col("n") >= least).groupBy("kind").count().collect()}
    least = 2 * LEAST
    while (found := size(least)).get(0, 0) > MOST_FIRST or found.get(1, 0) > MOST_PAIRS:
        least *= 2
    known = _arrays(table.where(F.col("n") >= least).drop("n"))
    return _table_model(other, known["kind"], known["key"], known["ratio"]), table.where(F.col("n") < least).drop("n")


def measured(texts: DataFrame, model: Model, rest: DataFrame | None) -> DataFrame:
    """texts (with text) with their features x instead of the text.  What the model's tables do not tell is looked up in rest by a join."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    names = [c for c in texts.columns if c != "text"]
    plain = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names)

    def told_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in grouped(batches):
            more = None
            if "more" in batch.schema.names:
                found = batch.column("more").flatten()
                more = _table_model(0.0, *(found.field(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "ratio"))) if len(found) else None
            x = features(shared.value, buf, off, more)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(list(x), pa.list_(pa.float64()))], [*names, "x"])

    if rest is None:
        return map_arrow(texts, told_by, f"{plain}, x array<double>")

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch, buf, off in grouped(batches):
            piece, word, follows, doc = steps(buf, off)
            keys: list[list[bytes]] = []
            for at, key in shared.value.unknown(piece, follows):
                of = doc[word[at]]
                order = np.lexsort((key, of))
                of, key = of[order], key[order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
                of, key = of[new], key[new]
                cut = np.searchsorted(of, np.arange(batch.num_rows + 1)).tolist()
                keys.append([key[a:b].tobytes() for a, b in zip(cut, cut[1:])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row + np.arange(batch.num_rows)), *(pa.array(k, pa.binary()) for k in keys)], [*batch.schema.names, "_row", "_k0", "_k1", "_k2"])
            row += batch.num_rows

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind in range(3):
                k = [np.frombuffer(x, np.int64) for x in batch.column(f"_k{kind}").to_pylist()]
                if k:
                    key = np.concatenate(k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("_row").to_numpy(), [len(x) for x in k])), pa.array(np.full(len(key), kind, np.int8)), pa.array(key)], ["_row", "kind", "key"])

    asked = written(map_arrow(texts.select(*names, "text"), missed, f"{plain}, text string, _row long, _k0 binary, _k1 binary, _k2 binary"), "asked")
    pieces = map_arrow(asked.select("_row", "_k0", "_k1", "_k2"), apart, "_row long, kind byte, key long")
    more = pieces.join(rest, ["kind", "key"]).groupBy("_row").agg(F.collect_list(F.struct("kind", "key", "ratio")).alias("more"))
    return map_arrow(asked.join(more, "_row", "left").select(*names, "text", "more"), told_by, f"{plain}, x array<double>")


def features(model: Model, buf: np.ndarray, off: np.ndarray, more: Model | None = None) -> np.ndarray:
    """Per text: difference a word over the text, over its strongest runs, and the log of its length."""
    piece, word, follows, doc = steps(buf, off)
    n = len(off) - 1
    out = np.zeros((n, MEASURES))
    if not len(piece):
        return out
    r = np.bincount(word, model.ratios(piece, follows, more), len(doc))
    size = np.bincount(doc, minlength=n)
    out[:, 0] = np.bincount(doc, r, n) / np.maximum(size, 1)
    total = np.concatenate([[0.0], np.cumsum(r)])
    first = np.cumsum(size) - size
    at, some = np.arange(len(r)), np.flatnonzero(size)
    for k, length in enumerate(RUNS):
        run = (total[np.minimum(at + length, (first + size)[doc])] - total[at]) / length
        out[some, 1 + k] = np.maximum.reduceat(run, first[some])
    out[:, -1] = np.log1p(size)
    return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = written(known.where(~held_out()).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(CURVE_SHARE)).cast("int")), "labels")
    few = known.count() <= BROADCAST_LABELS
    train = texts.where("not held_out").join(F.broadcast(known) if few else known, "doc_id")
    counts = count_steps(train)
    rows = measured(train.where("fold = 0").select("doc_id", "text", "toxic"), *whole_model(counts, ("m0", "m1")))
    curve = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(MOST_LABELLED).toArrow()
    y = curve.column("toxic").to_numpy()
    if len(np.unique(y)) < 2:
        return texts.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    w = fit_curve(np.array(curve.column("x").to_pylist()), y.astype(float))
    found = measured(texts, *whole_model(counts, ("n0", "n1")))
    z = sum((F.col("x")[k] * float(w[k]) for k in range(MEASURES)), F.lit(float(w[-1])))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))
    return found.select("doc_id", "held_out", p.alias("score")).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(docs_table(spark, sf_dir), docs_table(spark, sf_dir, "labels"))
