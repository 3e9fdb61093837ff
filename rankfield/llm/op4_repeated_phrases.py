"""Removal of repeated passages with phrase automata.

A passage that occurs twice shares windows of WINDOW words.  Each window is
represented by one of its phrases of PHRASE words, the one of least hash, so
equal windows have equal phrases at equal places and neighbouring windows
mostly share theirs.  Phrases that represent windows in two places are
confirmed as recurring by their words, in one sort over all documents, and each
shard of documents is sent the words of those that it needs.

A shard compiles the phrases it was sent into Aho-Corasick automata of at most
AUTOMATON phrases, streams all its documents through them and so locates every
occurrence.  Only windows whose phrase was located are candidates; they are
compared over all documents by 96 bits of two independent hashes of their
words, and every occurrence but the first (by doc_id, then by place) is
removed.  Repeats within a shard are settled there, so a passage that a third
of all documents hold sends one row a shard into the comparison.

Shards are of about SHARD_BYTES of text: their number grows with the input and
their size does not.

Null texts have no words.  Rows with the same doc_id count as separate texts in
an order that their texts fix; null doc_ids come first.  Rows alike in doc_id
and text are in one shard.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.core import Words, docs_table, grouped, let_go, map_arrow, ranges, text_groups, written

WINDOW = 20
PHRASE = 6
#: Phrases to an automaton.
AUTOMATON = 100_000
SHARD_BYTES = 3 << 19

NO_ID = -(1 << 63)


def representatives(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each window, start of the phrase that represents it, and the hash of the phrase at each word."""
    at, phrase = w.windows(h, PHRASE)
    full = np.zeros(len(h), np.uint64)
    full[at] = phrase
    windows, _ = w.windows(h, WINDOW)
    if not len(windows):
        return windows, windows, full
    span = np.lib.stride_tricks.sliding_window_view(full, WINDOW - PHRASE + 1)
    return windows, windows + span[windows].argmin(axis=1), full


def lined_up(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words between single blanks, on a line of its own; and where each word starts."""
    size = w.end - w.start
    at = np.cumsum(size + 1) - size + 2 * w.doc()
    out = np.full(int(size.sum()) + len(size) + 2 * len(w), 32, np.uint8)
    out[ranges(at, size)] = w.buf[ranges(w.start, size)]
    last = np.cumsum(np.bincount(w.doc(), size + 1, len(w)).astype(np.int64) + 2) - 1
    out[last] = 10
    return out, at


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """phrase (its words between blanks), and tag: its shard, and whether it occurs more than once among neighbouring rows, in the lowest bit."""
    for batch, buf, off in grouped(batches):
        w = Words(buf, off)
        _, chosen, phrase = representatives(w, w.hashes())
        chosen = np.unique(chosen)
        if not len(chosen):
            continue
        shard = batch.column("shard").to_numpy()[w.doc()[chosen]].astype(np.int64)
        order = np.lexsort((shard, phrase[chosen]))
        chosen, shard = chosen[order], shard[order]
        p = phrase[chosen]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (shard[1:] != shard[:-1])]))
        n = np.diff(np.concatenate([first, [len(p)]]))
        line, at = lined_up(w)
        begin = at[chosen[first]] - 1
        last = chosen[first] + PHRASE - 1
        size = at[last] + w.end[last] - w.start[last] + 1 - begin
        bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(line[ranges(begin, size)])])
        yield pa.RecordBatch.from_arrays([words, pa.array(shard[first] << 1 | (n > 1))], ["phrase", "tag"])


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of phrases that occur more than once; the rows come sorted by phrase and are passed on one behind."""
    held: pa.RecordBatch | None = None  # the last row, not yet known to recur
    before, sent = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        p, tag = t.column("phrase").combine_chunks(), t.column("tag").to_numpy()
        keep = (tag & 1) > 0
        same = pc.equal(p[1:], p[:-1]).to_numpy(zero_copy_only=False)
        keep[1:] |= same
        keep[:-1] |= same
        if sent and before == p[0].as_py():
            keep[: 1 + int(np.argmin(np.concatenate([same, [False]])))] = True
        out = np.flatnonzero(keep[:-1])
        sent, before = (bool(keep[-2]), p[-2].as_py()) if len(p) > 1 else (sent, before)
        sent = sent and before == p[-1].as_py()
        held = pa.RecordBatch.from_arrays([p[-1:], pa.array(tag[-1:] | keep[-1:])], ["phrase", "tag"])
        yield pa.RecordBatch.from_arrays([pa.array((tag[out] >> 1).astype(np.int32)), p.take(pa.array(out))], ["shard", "phrase"])
    if held is not None and (held.column("tag")[0].as_py() & 1 or sent):
        yield pa.RecordBatch.from_arrays([pa.array([held.column("tag")[0].as_py() >> 1], pa.int32()), held.column("phrase")], ["shard", "phrase"])


def locate(w: Words, phrases: list[bytes]) -> np.ndarray:
    """Whether one of the phrases begins at each word, by automata that all texts are streamed through."""
    import ahocorasick

    found = np.zeros(len(w.start), bool)
    line, at = lined_up(w)
    text = line.tobytes().decode("latin-1")  # a character a byte
    stop = at + w.end - w.start  # the blank after each word
    for a in range(0, len(phrases), AUTOMATON):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in phrases[a : a + AUTOMATON]:
            automaton.add_word(p.decode("latin-1"), 1)
        automaton.make_automaton()
        ends = np.fromiter((e for e, _ in automaton.iter(text)), np.int64)
        found[np.searchsorted(stop, ends) - (PHRASE - 1)] = True
    return found


SHARD_OUT = "row long, doc_id long, n_words long, sha string, text string, removed binary, at binary, hashes binary, checks binary"


def _settle(docs: pa.Table, phrases: pa.Table) -> pa.Table:
    """One row a document of a shard.

    A document without candidates has its digest (sha).  Others have their text,
    the starts of windows that repeat within the shard (removed), and the starts
    and hashes of the windows that are the shard's first.
    """
    columns: dict[str, list] = {x.split()[0]: [] for x in SHARD_OUT.split(", ")}
    order = np.lexsort((np.arange(docs.num_rows), docs.column("doc_id").fill_null(NO_ID).to_numpy()))
    ids = docs.column("doc_id").fill_null(NO_ID).to_numpy()[order]
    texts = docs.column("text").combine_chunks()
    if len(np.unique(ids)) < len(ids):  # rows of one doc_id, in the order of their texts
        content = texts.fill_null("").to_pylist()
        order = np.array(sorted(order.tolist(), key=lambda i: (docs.column("doc_id")[i].as_py() is not None, docs.column("doc_id")[i].as_py() or 0, content[i])))
        ids = docs.column("doc_id").fill_null(NO_ID).to_numpy()[order]
    texts = texts.take(pa.array(order))
    shard = int(docs.column("shard")[0].as_py()) if docs.num_rows else 0
    sent = phrases.column("phrase").unique().to_pylist() if phrases.num_rows else []
    pieces = []
    for a, b, buf, off in text_groups(texts, 1 << 62):  # the whole shard
        w = Words(buf, off)
        h = w.hashes()
        windows, chosen, _ = representatives(w, h)
        candidate = windows[locate(w, sent)[chosen]] if sent and len(windows) else np.zeros(0, np.int64)
        place = np.searchsorted(windows, candidate)
        value = w.windows(h, WINDOW)[1][place]
        check = w.windows(w.hashes(1), WINDOW)[1][place].astype(np.uint32)
        rank = np.lexsort((np.arange(len(value)), check, value))  # texts stand in order, so the first of a hash is the earliest
        again = np.zeros(len(candidate), bool)
        again[rank[1:]] = (value[rank[1:]] == value[rank[:-1]]) & (check[rank[1:]] == check[rank[:-1]])
        bound = np.searchsorted(candidate, w.first)
        raw = buf.tobytes()
        for k in range(len(w)):
            x, y, base = bound[k], bound[k + 1], w.first[k]
            text = raw[off[k] : off[k + 1]]
            start, late = (candidate[x:y] - base).astype("<i4"), again[x:y]
            plain = x == y
            pieces.append(
                (
                    shard << 32 | (a + k), None if ids[a + k] == NO_ID else int(ids[a + k]), int(w.count[k]),
                    hashlib.sha256(b" ".join(text.split())).hexdigest() if plain else None, None if plain else text.decode("utf-8"),
                    *([None] * 4 if plain else (start[late].tobytes(), start[~late].tobytes(), value[x:y][~late].tobytes(), check[x:y][~late].tobytes())),
                )
            )
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("text", pa.string()), *((c, pa.binary()) for c in ("removed", "at", "hashes", "checks"))])
    for row in pieces:
        for name, value in zip(columns, row):
            columns[name].append(value)
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash, doc_id, row and place of each window; place: its start in the upper 32 bits, the second hash in the lower."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            at, value, check = ([np.frombuffer(x, kind) for x in part.column(c).to_pylist()] for c, kind in (("at", "<i4"), ("hashes", np.int64), ("checks", "<u4")))
            size = [len(x) for x in at]
            row, doc = (np.repeat(part.column(c).fill_null(NO_ID).to_numpy(zero_copy_only=False), size) for c in ("row", "doc_id"))
            place = np.concatenate(at).astype(np.int64) << 32 | np.concatenate(check).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(value)), pa.array(doc), pa.array(row), pa.array(place)], ["hash", "doc_id", "row", "place"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row and at of all but the first of each pair of hashes; the rows come sorted."""
    before, seen = None, np.zeros(0, np.int64)  # the last hash, and the second hashes met with it
    for batch in batches:
        if not batch.num_rows:
            continue
        h, place = batch.column("hash").to_numpy(), batch.column("place").to_numpy()
        check = place & 0xFFFFFFFF
        run = np.cumsum(np.concatenate([[False], h[1:] != h[:-1]]))
        _, first = np.unique(run << 32 | check, return_index=True)
        again = np.ones(len(h), bool)
        again[first] = False
        if h[0] == before:
            again[(run == 0) & np.isin(check, seen)] = True
        last = np.unique(check[run == run[-1]])
        seen = np.union1d(seen, last) if h[-1] == before else last
        before = h[-1]
        out = pa.array(np.flatnonzero(again))
        yield pa.RecordBatch.from_arrays([batch.column("row").take(out), pa.array((place[again] >> 32).astype(np.int32))], ["row", "at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, digest = [], []
        for n, text, near, far in zip(*(batch.column(c).to_pylist() for c in ("n_words", "text", "removed", "later"))):
            start = np.concatenate([np.frombuffer(near, "<i4"), np.array(far or [], "<i4")]).astype(np.int64)
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + WINDOW, -1)
            gone = np.cumsum(cover[:-1]) > 0
            words = text.encode("utf-8").split()
            removed.append(int(gone.sum()))
            digest.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def recurring_phrases(sharded: DataFrame) -> DataFrame:
    """shard and phrase, of phrases that occur more than once; a phrase gives a row a shard, however often it occurs."""
    phrases = map_arrow(sharded, _phrases, "phrase binary, tag long").repartition("phrase").sortWithinPartitions("phrase")
    return written(map_arrow(phrases, _recurring, "shard int, phrase binary"), "recurring")


def later_windows(settled: DataFrame) -> DataFrame:
    """row and, as a list, the starts of its windows that began earlier in another shard."""
    hashes = map_arrow(settled.select("row", "doc_id", "at", "hashes", "checks"), _windows, "hash long, doc_id long, row long, place long")
    later = map_arrow(hashes.repartition("hash").sortWithinPartitions("hash", "doc_id", "row", "place"), _later, "row long, at int")
    return written(later.groupBy("row").agg(F.collect_list("at").alias("later")), "later")  # at most a document's words


def repeated_phrases(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    shards = max(1, -(-size // SHARD_BYTES))
    sharded = plain.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    recurring = recurring_phrases(sharded)
    let_go(docs.sparkSession)
    settled = written(sharded.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(_settle, SHARD_OUT), "settled")
    let_go(docs.sparkSession)
    open_ = settled.where("text is not null")
    by_row = later_windows(open_)
    let_go(docs.sparkSession)
    cut = map_arrow(open_.select("row", "doc_id", "n_words", "text", "removed").join(by_row, "row", "left").drop("row"), _cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    whole = settled.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return whole.unionByName(cut)


#: Windows as texts; a word is removed if one of the windows that end with it or up to 19 words later began earlier elsewhere.
SQL = f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
s AS (SELECT doc_id, pos, word, CASE WHEN count(*) OVER n = {WINDOW} THEN string_agg(word, ' ') OVER n END AS passage FROM w WINDOW n AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
r AS (SELECT *, passage IS NOT NULL AND row_number() OVER (PARTITION BY passage ORDER BY doc_id, pos) > 1 AS later FROM s),
g AS (SELECT doc_id, pos, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def op4_repeated_phrases(spark, sf_dir: str) -> DataFrame:
    return repeated_phrases(docs_table(spark, sf_dir))
