"""Connected components of a table of links, by alternating star contraction; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.core import join_known, map_arrow, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest node of its component, for links that fit in memory."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's links, replaced by those of its forest."""
    for batch in batches:
        if batch.num_rows:
            a, b = forest(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of links (a, b: long); root is the component's smallest node.

    Rounds until the links no longer change: every node's larger neighbours are
    linked to its smallest neighbour, then its smaller ones.  Both steps keep
    the components; the links end as one star a component.
    """
    now = written(map_arrow(links.select("a", "b").where("a <> b"), _contract, "a long, b long").distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark or not seen["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = (seen["n"], seen["h"])
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        large = join_known(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        down = written(down, "down")
        lowest = written(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "lowest")
        small = join_known(down, lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        now = written(small.where("a <> b").distinct(), "links")
