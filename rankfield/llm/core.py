"""Shared pieces of the corpus operators: whole-text word spans as numpy arrays, and tables written to the shared folder.

A text is handled as its UTF-8 bytes.  Words are runs of bytes other than
0x20 and 0x09-0x0D, which for UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+`` on
the characters.  Null texts count as empty everywhere.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankfield.session import shared_folder

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
WHOLE = np.ones(256, bool)
WHOLE[128:192] = False  # the later bytes of a character
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Texts are cut into groups of about this many bytes; a longer text is a group of its own.
CHUNK_BYTES = 3 << 18

#: Of an Arrow batch.
BATCH_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240131).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64, kept per process."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + CHUNK_BYTES // 4)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes wherever they stand.  There are two, independent of each other."""
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.take(_BYTES[which], buf, out=total[1:], mode="clip")
    total[1:] *= up[: len(buf)]
    np.cumsum(total, out=total)
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; the caller drops windows that cross a text's end."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + h[k : len(h) - n + 1 + k]
    return mix(out)


class Words:
    """Word spans of a group of texts.

    buf: the texts' bytes one after another; off: where each text starts, and the end;
    start, end: of each word, in buf; first: index of each text's first word, and the number of words.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        word = ~WHITE[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        ends[:-1] &= ~word[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.off) - 1

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end, which)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.count)

    def windows(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of each n-word window that lies in one text."""
        w = window_hashes(h, n)
        if not len(w):
            return np.zeros(0, np.int64), w
        doc = self.doc()
        at = np.flatnonzero(doc[: len(w)] == doc[n - 1 :])
        return at, w[at]


def text_groups(texts: pa.Array, target: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about target bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + target, "right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def grouped(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their texts."""
    for batch in batches:
        for a, b, buf, off in text_groups(batch.column(text)):
            yield batch.slice(a, b - a), buf, off


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... length[0] of them, then those of start[1], and so on."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = start - (np.cumsum(length) - length)
    return np.repeat(shift, length) + np.arange(total)


def shared_path(spark, name: str) -> str:
    """A new path in the folder that driver and executors share, removed when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df, name: str):
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no earlier work."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_known(rows, known, key: str, how_many: str = "n", hot: int = 50_000):
    """rows joined with known, which has one row a key and in how_many how often rows has it.

    Keys of at least hot rows, of which there are at most a share 1/hot of rows,
    are broadcast, so that none of them fills a task; the others are shuffled.
    """
    often = known.where(F.col(how_many) >= hot).drop(how_many)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(known.where(F.col(how_many) < hot).drop(how_many), key)
    return rows.join(F.broadcast(often), key).unionByName(rest)


def sums_before(df, key: str, n: str, out: str, block: int = 4096):
    """df (one row a key, keys from 0) with the sum of n over smaller keys: within blocks of keys, and over the blocks' sums."""
    part = F.floor(F.col(key) / block)
    sums = df.groupBy(part.alias("_block")).agg(F.sum(n).alias("_sum"))
    blocks = sums.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_blocks"))  # a row a block
    within = F.sum(n).over(Window.partitionBy("_block").orderBy(key)) - F.col(n)
    return df.withColumn("_block", part).withColumn("_within", within).join(blocks, "_block").withColumn(out, F.col("_blocks") + F.col("_within")).drop("_block", "_within", "_blocks")


def let_go(spark) -> None:
    """Has Spark delete the shuffle files of earlier steps that nothing refers to any more, instead of whenever the driver collects its garbage.

    What the first collection frees refers to more, which the second one finds.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def unused_name(name: str, df) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def docs_table(spark, sf_dir: str, name: str = "documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df, function, schema: str):
    """mapInArrow with batches of at most BATCH_BYTES or so, unless the session says otherwise, as the default lets one batch of long texts fill a worker."""
    if _BATCHES not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(_BATCHES, BATCH_BYTES)
    return df.mapInArrow(function, schema)
