"""Best-fit packing of documents into sequences, planned over a histogram of lengths.

Documents become pieces of at most ``capacity`` tokens.  The number of pieces
of each length is all that the plan needs: lengths are placed from the longest,
each into the open sequences with the least room that still holds it, many
alike sequences at a time.  The plan's rows are runs of slots of one length;
a piece takes the slot of its rank among the pieces of its length.  The plan
has at most ``capacity`` lengths and a bounded number of runs a length, however
many documents there are.

Null texts are empty: a document always has at least its end id, so each row
gives at least one piece.  Rows with the same doc_id, or none, are packed one
by one.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfield.llm.core import docs_table, grouped, map_arrow, ranges, written
from rankfield.llm.tokens import encoder, vocabulary_path

CAPACITY = 4096
END_ID = 1
#: Ranks are counted within salts of a length of about so many pieces each, or a millionth of all, so that a very common length is spread over tasks.
SALT_PIECES = 500
MOST_SALTS = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and checksum of each document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch, buf, off in grouped(batches):
            ids, at = code.encode(buf, off)
            n = np.diff(at) + 1
            out = np.full(int(n.sum()), end_id, "<u4")
            begin = np.cumsum(n) - n
            out[ranges(begin, n - 1)] = ids
            many = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), many)
            piece = ranges(np.zeros(len(n), np.int64), many)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            a = begin[doc] + start
            view = memoryview(out).cast("B")
            crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, PIECES)


def plan(count: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of slots: length, first rank, how many slots, first sequence, slots that follow each other in one sequence, offset of the first.

    Best fit, longest first.  Open sequences are kept as runs of alike
    sequences by the room they have left.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, how many)
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    for length in sorted(count, reverse=True):
        left, rank = count[length], 0
        for space in sorted(x for x in room if x >= length):
            fit, keep = space // length, []
            for first, many in room.pop(space):
                if not left:
                    keep.append((first, many))
                    continue
                full = min(many, left // fit)
                if full:
                    runs.append((length, rank, full * fit, first, fit, capacity - space))
                    rank, left = rank + full * fit, left - full * fit
                    if space - fit * length:
                        room.setdefault(space - fit * length, []).append((first, full))
                if full < many and 0 < left < fit:
                    runs.append((length, rank, left, first + full, fit, capacity - space))
                    if space - left * length:
                        room.setdefault(space - left * length, []).append((first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < many:
                    keep.append((first + full, many - full))
            if keep:
                room.setdefault(space, []).extend(keep)
            if not left:
                break
        if left:
            fit = capacity // length
            full = left // fit
            if full:
                runs.append((length, rank, full * fit, sequences, fit, 0))
                if capacity - fit * length:
                    room.setdefault(capacity - fit * length, []).append((sequences, full))
                rank, left, sequences = rank + full * fit, left - full * fit, sequences + full
            if left:
                runs.append((length, rank, left, sequences, fit, 0))
                if capacity - left * length:
                    room.setdefault(capacity - left * length, []).append((sequences, 1))
                sequences += 1
    table = np.array(runs, np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "rank", "many", "sequence", "fit", "offset"), table.T))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset.  pieces should be a written table: it is read twice."""
    order = [F.col("doc_id").asc_nulls_first(), "piece", "ids_crc32"]
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if not histogram:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    spark = pieces.sparkSession
    own = max(SALT_PIECES, -(-sum(histogram.values()) // MOST_SALTS))
    salts = spark.createDataFrame([(k, -(-n // own)) for k, n in histogram.items()], "length long, _salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts")).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    slots = spark.sparkContext.broadcast(plan(histogram, capacity))
    names = pieces.columns
    ranked = (
        salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
        .join(F.broadcast(before), ["length", "_salt"])  # at most a row a length, and MOST_SALTS
        .select(*names, (F.col("_before") + F.col("_rank")).cast("long").alias("_rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        step = int(max(s["rank"].max(), (s["rank"] + s["many"]).max())) + 1
        key = s["length"] * step + s["rank"]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "_rank"))
            run = np.searchsorted(key, length * step + rank, "right") - 1
            within = rank - s["rank"][run]
            sequence = s["sequence"][run] + within // s["fit"][run]
            offset = s["offset"][run] + within % s["fit"][run] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return map_arrow(ranked, place, f"{PIECES}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(written(token_pieces(docs, path or vocabulary_path(), capacity, end_id), "pieces"), capacity)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs_table(spark, sf_dir))
