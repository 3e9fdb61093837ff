"""Journal records as bytes, and directories on disk, as entries and changes."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from rankfield.functions.match import DIR
from rankfield.streaming.changes import flags_of, op_of, ordinary

#: Bytes of a version 2 record before its name, and the first number of a walked entry.
HEADER = 60
FIRST_WALKED = 1_000_000

RECORD = StructType(
    [StructField("usn", LongType()), StructField("frn", LongType()), StructField("parent_frn", LongType()), StructField("reason", LongType()), StructField("attributes", LongType()), StructField("name", StringType())]
)


def records(buf: bytes) -> Iterator[tuple[int, int, int, int, int, str]]:
    """usn, frn, parent, reason, attributes and name of each version 2 record.

    A record whose length is no multiple of 8, too small, or beyond the buffer
    ends the scan; other versions and names that are no UTF-16 are left out.
    """
    at = 0
    while at + 8 <= len(buf):
        size, major, _ = struct.unpack_from("<IHH", buf, at)
        if size < HEADER or size % 8 or at + size > len(buf):
            return
        if major == 2:
            frn, parent, usn, _, reason, _, _, attributes, name_size, name_at = struct.unpack_from("<qqqqIIIIHH", buf, at + 8)
            if name_at + name_size <= size and name_size % 2 == 0:
                try:
                    yield usn, frn, parent, reason, attributes, buf[at + name_at : at + name_at + name_size].decode("utf-16-le")
                except UnicodeDecodeError:
                    pass
        at += size


def record(usn: int, frn: int, parent: int, reason: int, attributes: int, name: str) -> bytes:
    """The bytes of one version 2 record."""
    raw = name.encode("utf-16-le")
    size = -(-(HEADER + len(raw)) // 8) * 8
    head = struct.pack("<IHHqqqqIIIIHH", size, 2, 0, frn, parent, usn, 0, reason, 0, 0, attributes, len(raw), HEADER)
    return (head + raw).ljust(size, b"\0")


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame([r for buf in frame["content"] for r in records(bytes(buf))], columns=[f.name for f in RECORD])


#: Fixed value: bytes before the first record of an enumeration's buffer, the number to go on from.
BUFFER_HEADER = 8


def _parse_buffers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame([r for buf in frame["content"] for r in records(bytes(buf)[BUFFER_HEADER:])], columns=[f.name for f in RECORD])


def enumerated(spark: SparkSession, path: str) -> DataFrame:
    """Entries (frn, parent_frn, name, flags) of a volume's enumeration, a buffer a file; the volume's own files are left out.

    The journal's cursor has to be taken before, so that changes during the scan are read afterwards.
    """
    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_parse_buffers, RECORD)
    return raw.where(ordinary(F.col("frn"))).select("frn", "parent_frn", "name", flags_of(F.col("attributes")).alias("flags"))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Changes (usn, op, frn, parent_frn, name, flags) of journal files; records without an event are left out."""
    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_parse, RECORD)
    return journal_changes(raw)


@dataclass(frozen=True)
class Cursor:
    """Where to read on, and in which journal."""

    journal_id: int
    next_usn: int


@dataclass(frozen=True)
class Journal:
    """A journal's files, its number, the first record it still has, where the next will be, and whether it is kept at all."""

    path: str
    journal_id: int
    first_usn: int
    next_usn: int
    active: bool = True
    deleting: bool = False


class NeedsRebuild(Exception):
    """The journal cannot be read on from the cursor; the volume has to be read anew."""


def read_batch(spark: SparkSession, journal: Journal, cursor: Cursor) -> tuple[DataFrame, Cursor]:
    """Changes since the cursor, and the cursor after them."""
    if journal.deleting:
        raise NeedsRebuild("the journal is being deleted")
    if not journal.active:
        raise NeedsRebuild("the journal is not kept")
    if journal.journal_id != cursor.journal_id:
        raise NeedsRebuild("another journal")
    if cursor.next_usn < journal.first_usn:
        raise NeedsRebuild("records since the cursor are overwritten")
    found = read_journal(spark, journal.path).where((F.col("usn") >= cursor.next_usn) & (F.col("usn") < journal.next_usn))
    return found, Cursor(journal.journal_id, journal.next_usn)


def journal_changes(raw: DataFrame) -> DataFrame:
    found = raw.select("usn", op_of(F.col("reason")).alias("op"), "frn", "parent_frn", "name", flags_of(F.col("attributes")).alias("flags"))
    return found.where(F.col("op").isNotNull() & ordinary(F.col("frn")))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Entries of a directory tree, numbered from FIRST_WALKED; links are listed and not followed, unreadable folders skipped.

    Listing is the driver's work, as in any file index; a root that is missing is an error.
    """
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    rows, open_, number = [], [(root, 0)], FIRST_WALKED
    while open_:
        folder, parent = open_.pop()
        try:
            found = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for entry in found:
            is_dir = entry.is_dir(follow_symlinks=False)
            rows.append((number, parent, entry.name, DIR if is_dir else 0))
            if is_dir:
                open_.append((entry.path, number))
            number += 1
    schema = StructType([StructField("frn", LongType()), StructField("parent_frn", LongType()), StructField("name", StringType()), StructField("flags", IntegerType())])
    return spark.createDataFrame(rows, schema)
