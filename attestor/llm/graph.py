"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.shared import stage, unstage

#: The links of one node are spread over so many join keys, so that a hub does not make one huge task.
HUB_SALTS = 8
EDGE = "hi long, lo long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of each batch by (node, least node) links of the batch's own components."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = np.array([(x, root(x)) for x in parent], dtype="i8").reshape(-1, 2)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["hi", "lo"])


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Join each (node, other) link with the node's least neighbour; hubs are spread by a salt."""
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HUB_SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(HUB_SALTS)).cast("int")).join(spread, ["node", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(edges.select("lo", "hi"))
    least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))
    return _with_least(both, least).where("other > node").selectExpr("other as hi", "least as lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.selectExpr("hi as node", "lo as other")
    least = down.groupBy("node").agg(F.min("other").alias("least"))
    moved = _with_least(down, least).where("other <> least").selectExpr("other as hi", "least as lo")
    return moved.union(least.selectExpr("node as hi", "least as lo")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; ``root`` is the least node reachable from it.

    Self links and repeated links don't matter; null ends are dropped. Each round is staged in the shared
    folder, so lineage stays short and a lost executor costs one round at most. The number of rounds grows
    with the logarithm of the longest path.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("hi <> lo").mapInArrow(_forest, EDGE)
    now, seen = stage(edges.distinct()), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            unstage(before)
            return now.selectExpr("hi as node", "lo as root").union(now.selectExpr("lo", "lo").distinct())
        if seen is not None:
            unstage(before)
        seen, before = mark, now
        now = stage(_small_star(_large_star(now)))
