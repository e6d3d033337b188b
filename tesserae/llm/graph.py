"""Connected components of large edge tables, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, drop_cut


#: Up to so many edges (16 bytes each) are united in one task, which saves the rounds; more are not.
LOCAL_EDGES = 1_000_000


def _unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of a task: (uid, root) of every node that isn't its component's least."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = np.fromiter(root, np.int64, len(root))
    tops = np.fromiter((find(n) for n in root), np.int64, len(root))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != tops]), pa.array(tops[nodes != tops])], names=["uid", "root"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(uid, root) for every end of an edge (a, b) that isn't its component's least; root is that least.

    Each round links all larger neighbours of a node to its least neighbour, then all smaller ones, until the
    table is the same again: logarithmically many rounds. Least neighbours are aggregated before the
    shuffle; the joins that bring them back have plain shuffles on both sides, so that hot nodes are split.
    """
    if edges.count() <= LOCAL_EDGES:
        return cut(edges.select("a", "b").coalesce(1).mapInArrow(_unite, "uid long, root long"), "roots")
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = cut(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        lower = cut(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for done in (least, large, lower, now):
            drop_cut(done)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("a").alias("uid"), F.col("b").alias("root"))
