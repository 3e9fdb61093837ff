"""Language-model scores: a word-count baseline, and a causal self-attention model on subword ids.

Word counts cover every training text (crc32 of doc_id modulo 7 is not 2).  The
FREQUENT most common words go to the scorers as one table of fixed size; what a
text holds of other words is looked up by a join on the word.  Words are known
by 64-bit hashes.

Subwords and pairs of neighbouring subwords are counted over every training
text too, and give the model its classes, its groups, and P(subword | class,
group of the subword before).  Every position of every training text teaches
the network once: all windows of the texts that it is scored in, cut anew from
the written ids, so what it learns from is all there is.  It begins with TRAIN_STEPS steps on the driver, on about START_WINDOWS
of them (fewer steps if there are too few windows to tell them apart); then in each of ROUNDS rounds tasks go on from the same weights over
their own windows of that round, a window in one round, and the weights are averaged by the number of
windows.  A text is scored in windows of attention.SPAN subwords that move by
attention.STEP, so each subword is scored once with at least SPAN - STEP before
it; its end is scored as well.

Null texts are empty: one token, the end.  Rows with the same doc_id get a row
each; a null doc_id is not held out.  An empty table gives no rows; with no
training text N is zero and the network stays as it began.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rankfield.llm.attention import GROUPS, SPAN, STEP, Attention, Classes, group_ids, score_texts, window_table, windows
from rankfield.llm.core import LOWER, Words, docs_table, grouped, map_arrow, mix, ranges, written
from rankfield.llm.op6_toxicity import held_out
from rankfield.llm.tokens import encoder, id_type, vocabulary_path

HELD_OUT_OF = 7
FREQUENT = 1 << 19
#: One in so many windows of a training text teaches the network: all.
WINDOW_SHARE = 1
#: The first steps, taken on the driver; how often they see a window if there are few; and about how many windows they draw from.
TRAIN_STEPS = 400
START_PASSES = 6
START_BATCH = 192
START_WINDOWS = 16_384
ROUNDS = 4
#: Of the steps in each round, over the spread of the gradients; it falls with the rounds.
ROUND_RATE = 0.004
#: Ids are told apart by so many buckets of what follows them when groups are made.
BUCKETS = 64
#: Distinct keys that a task holds before it sends counts.
HELD_KEYS = 1_500_000
#: Ids of texts that are cut into windows at once; a longer text is cut alone.
CUT_IDS = 1 << 19
#: Numbers in a row when weights are summed over tasks.
WEIGHT_ROW = 8192
WORD, SUBWORD, PAIR, TEXT = 0, 1, 2, 3
PARTS = "kind byte, key long, n long, n_all long, w binary, doc_id long, held_out boolean, text string"


def with_ends(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at) + 1
    stop = np.cumsum(n)
    out = np.full(int(stop[-1]) if len(n) else 0, end_id, np.int64)
    out[ranges(stop - n, n - 1)] = ids
    return out, np.concatenate([[0], stop])


def _told(ids: np.ndarray, at: np.ndarray, end_id: int, some: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of windows, with -1 for targets that another window tells."""
    before, target, real, _ = window_table(ids, at, end_id, some)
    return before, np.where(real, target, -1)


def taught(ids: np.ndarray, at: np.ndarray, end_id: int) -> list[bytes]:
    """All windows of each text, as they teach the network."""
    return [x.tobytes() for x in np.concatenate(_told(ids, at, end_id), axis=1).astype("<i4")]


def _cut(batches: Iterator[pa.RecordBatch], end_id: int, shift: int, share: int, rest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lots, inputs and targets of the windows of coded texts whose lot, shifted, is rest modulo share."""
    kind = id_type(end_id)
    for batch in batches:
        raw = batch.column("w").to_pylist()
        size = np.cumsum([0] + [len(x) // kind().itemsize for x in raw])
        a = 0
        while a < len(raw):
            b = max(a + 1, int(np.searchsorted(size, size[a] + CUT_IDS, "right")) - 1)
            at = size[a : b + 1] - size[a]
            text, first = windows(np.diff(at))
            own = np.array([xxh64_intdigest(x) for x in raw[a:b]], np.uint64)  # of the text's own ids, wherever it stands
            lot = mix(own[text] + (first // STEP).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            mine = np.flatnonzero((lot >> np.uint64(shift)) % np.uint64(share) == rest)
            lot = lot.view(np.int64)
            mine = mine[np.argsort(lot[mine])]  # else a step of the network sees few texts
            if len(mine):
                yield lot[mine], *_told(np.frombuffer(b"".join(raw[a:b]), kind).astype(np.int64), at, end_id, (text[mine], first[mine]))
            a = b


def text_windows(coded: DataFrame, end_id: int, shift: int, share: int, rest: int) -> DataFrame:
    """lot and w of the windows of coded texts (w: ids) whose lot, shifted, is rest modulo share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, before, target in _cut(batches, end_id, shift, share, rest):
            w = np.concatenate([before, target], axis=1).astype("<i4")
            at = np.arange(len(lot) + 1, dtype=np.int32) * (8 * SPAN)
            yield pa.RecordBatch.from_arrays([pa.array(lot), pa.Array.from_buffers(pa.binary(), len(lot), [None, pa.py_buffer(at), pa.py_buffer(w)])], ["lot", "w"])

    return map_arrow(coded.select("w"), cut, "lot long, w binary")


def corpus_counts(texts: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Counts (kind, key, n in training texts, n_all), and texts with their ids (w).

    Kinds: WORD, SUBWORD and PAIR (the first id in the upper 32 bits).  The end is subword 'vocabulary size', and no word.
    Texts are written with their ids, so that they are told apart into subwords once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        kind_of_id = id_type(code.vocabulary)
        subs = np.zeros(code.vocabulary + 1, np.int64)
        held: dict[int, list[tuple[np.ndarray, ...]]] = {WORD: [], PAIR: []}
        schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64()), ("n_all", pa.int64()), ("w", pa.binary()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())])

        def rows(kind: int, size: int, **columns) -> pa.RecordBatch:
            columns["kind"] = np.full(size, kind, np.int8)
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

        def merged(kind: int) -> dict[str, np.ndarray]:
            key, which = np.unique(np.concatenate([x[0] for x in held[kind]]), return_inverse=True)
            return {"key": key} | {c: np.bincount(which, np.concatenate([x[k] for x in held[kind]]), len(key)).astype(np.int64) for k, c in ((1, "n"), (2, "n_all"))}

        for batch, buf, off in grouped(batches):
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            ids, at = with_ends(*code.encode(buf, off), code.vocabulary)
            size = np.diff(at)
            own = np.repeat(train, size)
            subs += np.bincount(ids[own], minlength=len(subs))
            before = np.concatenate([[code.vocabulary], ids[:-1]])
            before[at[:-1]] = code.vocabulary
            key, n = np.unique(before[own] << 32 | ids[own], return_counts=True)
            held[PAIR].append((key, n, n))
            w = Words(LOWER[buf], off)
            key, which = np.unique(w.hashes(), return_inverse=True)
            held[WORD].append((key.view(np.int64), np.bincount(which, np.repeat(train, w.count), len(key)), np.bincount(which, minlength=len(key))))
            for kind in held:
                if sum(len(x[0]) for x in held[kind]) > HELD_KEYS:
                    one = merged(kind)
                    held[kind] = []
                    if len(one["key"]) > HELD_KEYS // 2:
                        yield rows(kind, len(one["key"]), **one)
                    else:
                        held[kind] = [(one["key"], one["n"], one["n_all"])]
            raw = ids.astype(kind_of_id)
            yield rows(TEXT, batch.num_rows, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), text=batch.column("text"), w=[raw[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
        for kind in held:
            if held[kind]:
                one = merged(kind)
                yield rows(kind, len(one["key"]), **one)
        some = np.flatnonzero(subs)
        yield rows(SUBWORD, len(some), key=some, n=subs[some], n_all=subs[some])

    parts = written(map_arrow(texts, count, PARTS), "parts")
    counts = written(parts.where(F.col("kind") < TEXT).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all")), "counts")
    return counts, parts.where(F.col("kind") == TEXT).select("doc_id", "held_out", "text", "w")


def frequent_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (ascending) and training counts of at most FREQUENT words, and the least n_all among them."""
    words = counts.where(F.col("kind") == WORD)
    least = 1
    while words.where(F.col("n_all") >= least).count() > FREQUENT:
        least *= 2
    t = words.where(F.col("n_all") >= least).select("key", "n").toArrow()
    key, n = t.column("key").to_numpy(), t.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order], least


def fit_classes(counts: DataFrame, subs: np.ndarray) -> Classes:
    """The driver gets sums by id and bucket, and by id and group: a bounded number for a vocabulary, whatever the corpus."""
    pairs = counts.where(F.col("kind") == PAIR).select(F.shiftright("key", 32).alias("a"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("b"), "n")

    def table(rows: DataFrame, key: str, column: str, width: int) -> np.ndarray:
        t = rows.groupBy(key, column).agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros((len(subs), width), np.float32)
        out[t.column(key).to_numpy(), t.column(column).to_numpy()] = t.column("n").to_numpy()
        return out

    group = group_ids(subs, table(pairs.withColumn("k", F.pmod(F.xxhash64("b"), F.lit(BUCKETS)).cast("int")), "a", "k", BUCKETS))
    named = pa.table({"a": pa.array(np.arange(len(subs))), "g": pa.array(group.astype(np.int32))})
    of = F.broadcast(counts.sparkSession.createDataFrame(named))  # a row an id of the vocabulary
    return Classes(subs, group, table(pairs.join(of, "a"), "b", "g", GROUPS))


Taught = tuple[np.ndarray, np.ndarray, np.ndarray]


def _as_taught(before: np.ndarray, target: np.ndarray, classes: Classes) -> Taught:
    """Embedding rows, classes to tell, and which of them count."""
    return classes.row[before], classes.of[np.maximum(target, 0)], target >= 0


def _windows(rows: pa.ChunkedArray | pa.Array, classes: Classes) -> Taught:
    t = np.frombuffer(b"".join(rows.to_pylist()), "<i4").reshape(-1, 2, SPAN)
    return _as_taught(t[:, 0], t[:, 1], classes)


def fit_network(told: DataFrame, classes: Classes) -> Attention:
    """The network taught by all windows (lot, w)."""
    chosen = lambda shift, share, rest: told.where(F.pmod(F.shiftrightunsigned("lot", shift), F.lit(share)) == rest)

    def read(batches: Iterator[pa.RecordBatch], kinds: Classes, k: int) -> Iterator[Taught]:
        for batch in batches:
            if batch.num_rows:
                yield _windows(batch.column("w"), kinds)

    return _taught_by(chosen, lambda k: chosen(20, ROUNDS, k).select("w"), read, told.count(), classes, told.sparkSession)


def fit_network_of_texts(coded: DataFrame, end_id: int, classes: Classes) -> Attention:
    """The network taught by all windows of coded texts, each cut by the task that it teaches when its round comes, so that none is written or sent."""
    size = F.octet_length("w") / id_type(end_id)().itemsize
    many = 1 + F.greatest(F.ceil((size - SPAN) / STEP), F.lit(0))
    total = coded.agg(F.coalesce(F.sum(many), F.lit(0)).cast("long")).first()[0]

    def read(batches: Iterator[pa.RecordBatch], kinds: Classes, k: int) -> Iterator[Taught]:
        for _, before, target in _cut(batches, end_id, 20, ROUNDS, k):
            yield _as_taught(before, target, kinds)

    return _taught_by(lambda *which: text_windows(coded, end_id, *which), lambda k: coded.select("w"), read, total, classes, coded.sparkSession)


def _taught_by(
    chosen: Callable[[int, int, int], DataFrame], source: Callable[[int], DataFrame], read: Callable[[Iterator[pa.RecordBatch], Classes, int], Iterator[Taught]], total: int, classes: Classes, spark: SparkSession
) -> Attention:
    """chosen: windows whose lot, shifted by the first, is the third modulo the second; read: windows of a round from its source."""
    model = Attention()
    some = chosen(0, max(1, total // START_WINDOWS), 0).orderBy("lot", "w").limit(2 * START_WINDOWS).select("w").toArrow()
    if not some.num_rows:
        return model
    model.train(*_windows(some.column("w"), classes), min(TRAIN_STEPS, -(-START_PASSES * some.num_rows // START_BATCH)), START_BATCH)
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, classes))
        rate = ROUND_RATE * (1 - k / ROUNDS)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begun, kinds = shared.value
            own = Attention()
            own.spread = begun.spread
            own.set_flat(begun.flat())
            n = 0
            for some in read(batches, kinds, k):
                own.go_on(*some, rate)
                n += len(some[0])
            if n:
                x = own.flat().astype(np.float64) * n
                cut = [x[a : a + WEIGHT_ROW].tobytes() for a in range(0, len(x), WEIGHT_ROW)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut), dtype=np.int32)), pa.array(cut, pa.binary()), pa.array(np.full(len(cut), n))], ["part", "x", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, tuple[np.ndarray, int]] = {}
            for batch in batches:
                for part, x, n in zip(*(c.to_pylist() for c in batch.columns)):
                    x = np.frombuffer(x)
                    sums[part] = (sums[part][0] + x, sums[part][1] + n) if part in sums else (x, n)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / n).tobytes() for x, n in sums.values()], pa.binary())], ["part", "x"])

        found = map_arrow(map_arrow(source(k), learn, "part int, x binary, n long").repartition("part"), add, "part int, x binary").collect()  # the weights, once
        if found:
            model.set_flat(np.concatenate([np.frombuffer(r["x"]) for r in sorted(found, key=lambda r: r["part"])]))
    return model


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, others binary, times binary"


def lm_scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    path = path or vocabulary_path()
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(HELD_OUT_OF).alias("held_out"))
    counts, coded = corpus_counts(texts, path)
    total = counts.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("v")).first()
    size = encoder(path).vocabulary
    subs = np.zeros(size + 1, np.int64)
    for r in counts.where(F.col("kind") == SUBWORD).collect():  # at most the vocabulary
        subs[r["key"]] = r["n"]
    ends = int(subs[size])  # one a training text
    tokens, distinct = total["n"] + ends, total["v"] + (ends > 0)
    keys, times, least = frequent_words(counts)
    classes = fit_classes(counts, subs)
    shared = spark.sparkContext.broadcast((keys, times, classes, fit_network_of_texts(coded.where("not held_out"), size, classes)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key, n, kinds, model = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch, buf, off in grouped(batches):
            w = Words(LOWER[buf], off)
            h, doc = w.hashes().view(np.int64), w.doc()
            kind, which = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(key, kind), max(len(key) - 1, 0))
            there = key[at] == kind if len(key) else np.zeros(len(kind), bool)
            c = np.where(there, n[at], 0) if len(key) else np.zeros(len(kind), np.int64)
            log = np.where(there, np.log10(c + 1.0), 0.0)
            known = np.bincount(doc, (c > 0)[which], len(w)).astype(np.int64) + (ends > 0)
            logs = np.bincount(doc, log[which], len(w)) + np.log10(ends + 1.0)
            far = np.flatnonzero(~there[which])
            cut = np.searchsorted(doc[far], np.arange(len(w) + 1))
            others, often = [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                k, m = np.unique(h[far[a:b]], return_counts=True)
                others.append(k.tobytes())
                often.append(m.astype("<i4").tobytes())
            raw = batch.column("w").to_pylist()
            ids = np.frombuffer(b"".join(raw), id_type(size)).astype(np.int64)
            value = score_texts(model, kinds, ids, np.concatenate([[0], np.cumsum([len(x) // id_type(size)().itemsize for x in raw])]), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(w))), batch.column("doc_id"), batch.column("held_out"), pa.array(w.count + 1), pa.array(known), pa.array(logs), pa.array(value), pa.array(others, pa.binary()), pa.array(often, pa.binary())],
                [x.split()[0] for x in SCORED.split(", ")],
            )
            row += len(w)

    scored = written(map_arrow(coded, score, SCORED), "scored")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = [np.frombuffer(x, np.int64) for x in batch.column("others").to_pylist()]
            m = [np.frombuffer(x, "<i4") for x in batch.column("times").to_pylist()]
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("row").to_numpy(), [len(x) for x in k])), pa.array(np.concatenate(k)), pa.array(np.concatenate(m).astype(np.int32))], ["row", "key", "times"])

    rest = map_arrow(scored.where("octet_length(others) > 0").select("row", "others", "times"), explode, "row long, key long, times int")
    rare = counts.where((F.col("kind") == WORD) & (F.col("n_all") < least) & (F.col("n") > 0)).select("key", "n")
    found = rest.join(rare, "key").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))
    return scored.drop("others", "times").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(docs_table(spark, sf_dir))
