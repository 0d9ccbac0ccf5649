"""Connected components of a distributed list of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import drop, save

#: Links up to this count (16 MB) are one task's work; more are contracted step by step. The roots are the same.
LOCAL = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the smallest node that can be reached.

    Beyond LOCAL links every step is a groupBy and a join on a node, and writes its links to the shared folder; a node
    with very many links is summed in parts and joined as a skewed key. The number of steps grows
    with the logarithm of the longest chain. Links of a node to itself keep it as its own root.
    """
    loops = links.where("a = b").select(F.col("a").alias("node"))
    now = save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    now = _stars(now) if now.count() > LOCAL else now.repartition(1).mapInArrow(_local, "a long, b long")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return found.union(roots.union(loops.select("node", F.col("node").alias("root"))).distinct().join(found.select("node"), "node", "left_anti"))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for each node but the roots: b is its root. Labels sink to the smallest neighbour's, then to their label's."""
    parts = [np.column_stack((x.column(0).to_numpy(), x.column(1).to_numpy())) for x in batches]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]])], names=["a", "b"])


def _stars(now: DataFrame) -> DataFrame:
    """(a, b) for each node but the roots: b is its root. now: saved links, a > b."""
    mark = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        new = large.join(small, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")).select("x.a", F.col("x.m").alias("b")).where("a <> b").distinct()
        new = save(new, "links")
        drop(now)
        now, was = new, mark
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was:
            return now
