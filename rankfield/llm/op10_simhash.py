"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits.  Fingerprints that differ in at most 3 bits differ
in at most 1 bit of their low or of their high 32, so each half is searched
with threshold 1.  Anchors are the words of the perfect code of length 31
(parity checks are the bits' numbers 1 to 31; covering radius 1) on the half's
lower 31 bits.  Each fingerprint has one home anchor within the radius and
visits every anchor within radius plus threshold, 2: at most 16 of the 2^26.
If x and y differ in at most one bit of a half, y visits x's home.  Homes and
visitors of an anchor are compared on all 64 bits.

Only distinct fingerprints are compared, so copies cost nothing.  An anchor
with many fingerprints is compared in square blocks, spread over tasks; a block
gives a spanning forest of its links instead of all pairs, which keeps
components whole.  Fingerprints that many documents share, and components of
many fingerprints, are looked up in a broadcast table of those alone.

There are 2^27 anchors, so with many more than 10^10 distinct fingerprints most
anchors are busy and comparisons grow faster than the input.

Null and wordless texts have fingerprint zero and link as any other.  Rows with
the same doc_id get a row each.  Null doc_ids keep their fingerprint, and a
component of nothing but null doc_ids has a null id.  An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.components import components, forest
from rankfield.llm.core import docs_table, join_known, map_arrow, text_groups, written

SEED = 42
SHINGLE = 3
MOST_BITS = 3
#: Rows of an anchor that are compared at once; more are compared in blocks of this size.
BLOCK = 2048
#: More busy anchors than this are joined instead of broadcast.
BROADCAST_ANCHORS = 100_000

BITS_AT_ONCE = 1 << 18
HALF = (1 << 31) - 1


def _shingle_hashes(text: bytes) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    line, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        return np.array([xxh64_intdigest(line, SEED)] * (n > 0), np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], stops[: n - SHINGLE] + 1])
    return np.fromiter((xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts.tolist(), stops[SHINGLE - 1 :].tolist())), np.uint64, len(starts))


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text.  A shingle takes 16 bytes or so, and its bits are counted BITS_AT_ONCE shingles at a time."""
    out = np.zeros(len(texts), np.uint64)
    for a, b, buf, off in text_groups(texts):
        raw, at = buf.tobytes(), off.tolist()
        each = [_shingle_hashes(raw[x:y]) for x, y in zip(at[:-1], at[1:])]
        size = np.array([len(x) for x in each], np.int64)
        values, text = np.concatenate(each), np.repeat(np.arange(b - a), size)
        set_ = np.zeros((b - a, 64), np.int64)
        for k in range(0, len(values), BITS_AT_ONCE):
            bits = np.unpackbits(values[k : k + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            of = text[k : k + BITS_AT_ONCE]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            set_[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        some = size > 0
        out[a:b][some] = np.packbits(2 * set_[some] > size[some, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text")).view(np.int64))], ["doc_id", "fp"])


def syndrome(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x), np.int64)
    for k in range(31):
        s ^= (x >> k & 1) * (k + 1)
    return s


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, fingerprint, home: a row for each anchor within the radius (home) and within the radius plus one."""
    first = np.arange(1, 32)
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for half in (0, 1):
            x = (fp >> (32 * half)) & HALF
            s = syndrome(x)
            home = np.where(s > 0, x ^ (np.int64(1) << np.maximum(s - 1, 0)), x)
            off = np.flatnonzero(s > 0)
            second = first[None, :] ^ s[off, None]  # two flips whose numbers give the syndrome together
            row, col = np.nonzero((second > first[None, :]) & (second > 0))
            far = x[off[row]] ^ (np.int64(1) << (first[col] - 1)) ^ (np.int64(1) << (second[row, col] - 1))
            anchor = np.concatenate([home, far]) | np.int64(half) << 31
            who = np.concatenate([fp, fp[off[row]]])
            is_home = np.arange(len(who)) < len(fp)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(who), pa.array(is_home)], ["anchor", "fp", "home"])


def block_links(home: np.ndarray, guest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between homes and guests."""
    a, b = [], []
    h, g = home.view(np.uint64), guest.view(np.uint64)  # bits of negative numbers are not counted as they stand
    for i in range(0, len(home), 512):
        x, y = np.nonzero(np.bitwise_count(h[i : i + 512, None] ^ g[None, :]) <= MOST_BITS)
        x, y = home[i + x], guest[y]
        differ = x != y
        a.append(x[differ])
        b.append(y[differ])
    a, b = np.concatenate(a), np.concatenate(b)
    return forest(a, b) if len(a) else (a, b)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each cell; the rows come sorted by cell and a cell has at most 2 * BLOCK rows or so."""
    rest = None
    batches = iter(batches)
    while True:
        batch = next(batches, None)
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
        if rest is None:
            return
        cell = rest.column("cell").to_numpy()
        fp = rest.column("fp").to_numpy()
        home = rest.column("home").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        stops = np.concatenate([cuts[1:], [len(cell)]])
        last = len(cuts) - (batch is not None)  # the last cell may go on
        size = stops - cuts
        homes = np.add.reduceat(home.astype(np.int64), cuts)
        a, b = [], []
        busy = np.flatnonzero((size[:last] > 2) | (homes[:last] > 0) & (size[:last] > 1))
        for k in busy.tolist():
            if homes[k]:
                f, h = fp[cuts[k] : stops[k]], home[cuts[k] : stops[k]]
                x, y = block_links(f[h], f)
                if len(x):
                    a.append(x)
                    b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
        if batch is None:
            return
        rest = rest.slice(int(cuts[-1])).combine_chunks()


def links(distinct: DataFrame) -> DataFrame:
    """a, b: links that connect all fingerprints (column fp) of at most MOST_BITS differing bits, as forests of blocks."""
    visits = written(map_arrow(distinct.select("fp"), _visits, "anchor long, fp long, home boolean"), "visits")
    busy = written(visits.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "busy")
    many = busy.count()
    if many:
        side = F.broadcast(busy) if many <= BROADCAST_ANCHORS else busy
        blocks = F.ceil(F.col("n") / BLOCK)
        own = F.pmod(F.xxhash64("fp"), blocks)
        grid = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).when(
            F.col("home"), F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: own * blocks + j)
        )
        # a home meets the guests of all columns of its row; each row, home or not, is a guest in its column of every row
        guest = F.when(F.col("n").isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda i: i * blocks + own))
        joined = visits.join(side, "anchor", "left")
        as_home = joined.where(F.col("n").isNull() | F.col("home")).select("anchor", "fp", "home", F.explode(grid).alias("g"))
        as_guest = joined.where(F.col("n").isNotNull()).select("anchor", "fp", F.lit(False).alias("home"), F.explode(guest).alias("g"))
        quiet = joined.where(F.col("n").isNull() & ~F.col("home")).select("anchor", "fp", "home", F.lit(0).cast("long").alias("g"))
        cells = as_home.where(F.col("home")).unionByName(as_guest).unionByName(quiet)
    else:
        cells = visits.withColumn("g", F.lit(0).cast("long"))
    keyed = cells.select(F.xxhash64("anchor", "g").alias("cell"), "fp", "home")
    dealt = keyed.repartition("cell").sortWithinPartitions("cell")
    return map_arrow(dealt, _compare, "a long, b long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs."""
    rows = written(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _fingerprint, "doc_id long, fp long"), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct))
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    of = written(of, "roots")
    least = written(of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many")), "components")
    named = written(join_known(of, least, "root", "many").select("fp", "n", "component_id"), "named")
    return join_known(rows, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(docs_table(spark, sf_dir))
