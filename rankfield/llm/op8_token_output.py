"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A token's rank (0 the most frequent; ties by id) takes 1, 2, 3 or 4 bytes.  Two
bits a token say how many; they stand, four to a byte, in a control string of
their own, the low bits first.  A file part holds the documents of a range of
doc_id in ascending order, in blocks of whole documents: a block has its first
token's place in the part, the documents' ids and token counts, the control
bytes and the data bytes.  Blocks are rows of Parquet files, which Spark can
write to and read from any store; the rank table is a file beside them.

Reading looks up each control byte in a table of 256 rows of four lengths, and
gathers the data bytes by the running sum of the lengths.

Null texts are empty and have the end id only.  Rows with the same doc_id keep
separate records, ordered by their ids' checksum.  Null doc_ids come first.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.core import docs_table, grouped, map_arrow, ranges, shared_path, sums_before, written
from rankfield.llm.tokens import encoder, id_type, vocabulary_path

END_ID = 2
#: A block is closed at this many tokens.
BLOCK_TOKENS = 1 << 18
#: A writer holds this much before it writes.
ROW_GROUP_BYTES = 16 << 20
#: Ids are coded about so many bytes at a time.
SLICE_BYTES = 1 << 20
#: Documents to a file part, about.
PART_DOCS = 6_000
#: More parts than this are joined by a shuffle.
BROADCAST_PARTS = 100_000

LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1  # of the four tokens of each control byte
RECORDS = "doc_id long, n_tokens long, ids_crc32 long, control binary, data binary"
BLOCKS = "part int, block int, first long, doc_ids array<long>, counts array<long>, control binary, data binary"
RESULT = "part int, first long, doc_id long, n_tokens long, ids_crc32 long"


def text_column(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def coded(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id and ids of each document (without the end), written so that texts are tokenized once; and how often each id occurs.

    The driver gets one row an id of the vocabulary.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        kind = id_type(code.vocabulary)
        total = np.zeros(code.vocabulary, np.int64)
        for batch, buf, off in grouped(batches):
            ids, at = code.encode(buf, off)
            total += np.bincount(ids, minlength=len(total))
            total[end_id] += batch.num_rows
            raw, n = ids.astype(kind), batch.num_rows
            each = pa.array([raw[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), each, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["doc_id", "ids", "id", "n"])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(some), pa.array(total[some])], ["doc_id", "ids", "id", "n"])

    rows = written(map_arrow(text_column(docs), encode, "doc_id long, ids binary, id long, n long"), "coded")
    out = np.zeros(encoder(path).vocabulary, np.int64)
    for r in rows.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return rows.where("ids is not null").select("doc_id", "ids"), out


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about SLICE_BYTES of ids."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64)) if batch.num_rows else np.zeros(0, np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SLICE_BYTES, "right")))
            yield batch.slice(a, b - a)
            a = b


def write_tokens(docs: DataFrame, to: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes the blocks to ``to``/blocks and the ids in order of rank to ``to``/ranks."""
    path = path or vocabulary_path()
    spark = docs.sparkSession
    texts, counts = coded(docs, path, end_id)
    by_rank = np.lexsort((np.arange(len(counts)), -counts))
    rank_of = np.empty(len(counts), np.uint32)
    rank_of[by_rank] = np.arange(len(counts))
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{to}/ranks")
    ranks = spark.sparkContext.broadcast(rank_of)

    known = docs.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    parts = max(1, -(-known["n"] // PART_DOCS))
    edges = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / parts for k in range(1, parts)], 100 * parts).alias("e")).first()["e"] if parts > 1 else []
    bounds = np.unique(np.array(edges or [], np.int64))
    shared_bounds = spark.sparkContext.broadcast(bounds)

    kind = id_type(len(counts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = batch.column("ids").to_pylist()
            ids = np.frombuffer(b"".join(raw), kind)
            n = np.array([len(x) // kind().itemsize for x in raw], np.int64) + 1
            out = np.full(int(n.sum()), end_id, "<u4")
            begin = np.cumsum(n) - n
            out[ranges(begin, n - 1)] = ids
            view = memoryview(out).cast("B")
            stop = begin + n
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist())]
            rank = ranks.value[out]
            size = 1 + (rank > 0xFF) + (rank > 0xFFFF) + (rank > 0xFFFFFF)
            pad = -n % 4
            cells = np.zeros(int((n + pad).sum()), np.uint8)
            c0 = np.cumsum(n + pad) - (n + pad)
            cells[ranges(c0, n)] = size - 1
            cells = cells.reshape(-1, 4)
            control = (cells[:, 0] | cells[:, 1] << 2 | cells[:, 2] << 4 | cells[:, 3] << 6).astype(np.uint8).tobytes()
            data = rank.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()
            sums = np.concatenate([[0], np.cumsum(size)])
            d0, d1 = sums[begin].tolist(), sums[stop].tolist()
            c0, c1 = (c0 // 4).tolist(), ((c0 + n + pad) // 4).tolist()
            ids_of = batch.column("doc_id")
            where = np.searchsorted(shared_bounds.value, ids_of.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), ids_of, pa.array(n), pa.array(crc, pa.int64()), pa.array([control[a:b] for a, b in zip(c0, c1)], pa.binary()), pa.array([data[a:b] for a, b in zip(d0, d1)], pa.binary())],
                ["part", "doc_id", "n_tokens", "ids_crc32", "control", "data"],
            )

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first, held, tokens = None, 0, 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()),
                    pa.array([[x[0] for x in held]], pa.list_(pa.int64())), pa.array([[x[1] for x in held]], pa.list_(pa.int64())),
                    pa.array([b"".join([x[2] for x in held])], pa.binary()), pa.array([b"".join([x[3] for x in held])], pa.binary()),
                ],
                ["part", "block", "first", "doc_ids", "counts", "control", "data"],
            )

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("part", "doc_id", "n_tokens", "control", "data"))):
                if held and (row[0] != part or tokens >= BLOCK_TOKENS):
                    yield close()
                    number, first = (number + 1, first + tokens) if row[0] == part else (0, 0)
                    held, tokens = [], 0
                part = row[0]
                held.append(row[1:])
                tokens += row[2]
        if held:
            yield close()

    records = map_arrow(texts, encode, f"part int, {RECORDS}")
    dealt = records.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").drop("ids_crc32")
    map_arrow(dealt, block, BLOCKS).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{to}/blocks")


def read_tokens(spark, at: str, emit: str = RESULT, record=None) -> DataFrame:
    """Documents of token files.  By default part, place in the part, doc_id, number and checksum of its ids."""
    ids_by_rank = spark.sparkContext.broadcast(spark.read.schema("ids binary").parquet(f"{at}/ranks").first()["ids"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(ids_by_rank.value, "<u4")
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["counts"], np.int64)
                ids = table[decode(row["control"], row["data"], n)]
                stop = np.cumsum(n)
                view = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = [zlib.crc32(view[4 * (b - k) : 4 * b]) for b, k in zip(stop.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), row["part"], np.int32)), pa.array(row["first"] + stop - n), pa.array(row["doc_ids"], pa.int64()), pa.array(n), pa.array(crc, pa.int64())],
                    ["part", "first", "doc_id", "n_tokens", "ids_crc32"],
                )

    return map_arrow(spark.read.schema(BLOCKS).parquet(f"{at}/blocks"), record or documents, emit)


def decode(control: bytes, data: bytes, n: np.ndarray) -> np.ndarray:
    """Ranks of documents of n tokens; each document begins a new control byte."""
    pad = n + -n % 4
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[ranges(np.cumsum(pad) - pad, n)]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(size) - size
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def token_output(docs: DataFrame, to: str | None = None, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files."""
    spark = docs.sparkSession
    to = to or shared_path(spark, "tokens")
    write_tokens(docs, to, path)
    found = written(read_tokens(spark, to), "read-back")
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = sums_before(parts, "part", "_n", "_before").select("part", "_before")
    few = docs.count() <= BROADCAST_PARTS * PART_DOCS
    return found.join(F.broadcast(before) if few else before, "part").select("doc_id", (F.col("_before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_output(spark, sf_dir: str) -> DataFrame:
    return token_output(docs_table(spark, sf_dir))
