"""Projections, set operations and keep-one deduplication over triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def slot_set(triples: DataFrame, slot: str) -> DataFrame:
    return triples.select(F.col(slot).alias("node")).distinct()


def concept_set(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("s", "o")).alias("node")).distinct()


def roots(triples: DataFrame) -> DataFrame:
    """Subjects that are no objects."""
    return slot_set(triples, "s").join(slot_set(triples, "o"), "node", "left_anti")


def leaves(triples: DataFrame) -> DataFrame:
    """Objects that are no subjects."""
    return slot_set(triples, "o").join(slot_set(triples, "s"), "node", "left_anti")


def remove_leaves(triples: DataFrame, which: Column | None = None) -> DataFrame:
    """Drop the edges (of those that `which` picks) that end in a leaf."""
    marked = triples.join(slot_set(triples, "s").select(F.col("node").alias("o"), F.lit(True).alias("inner_node")), "o", "left")
    drop = F.col("inner_node").isNull() & (F.lit(True) if which is None else which)
    return marked.filter(~drop).select("s", "p", "o")


def reversed_edges(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))


def predicate_dict(triples: DataFrame, predicate: str) -> DataFrame:
    """Sorted objects of each subject under a predicate; an object that repeats is listed again."""
    own = triples.filter(F.col("p") == predicate)
    return own.groupBy("s").agg(F.sort_array(F.collect_list("o")).alias("values"))


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order. A minimum, so that it is aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    ordered = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*key).agg(F.min(ordered).alias("_first")).select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def keep_longest(df: DataFrame, key: list[str], sizes: list[str], order: str) -> DataFrame:
    """The row of largest sizes of each key, the first of equals by order."""
    rest = [c for c in df.columns if c not in key]
    best = F.struct(*sizes, (-F.col(order)).alias("_earlier"))
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), best).alias("_best")).select(*key, "_best.*")


def node_labels(triples: DataFrame, label_predicate: str) -> DataFrame:
    return triples.filter(F.col("p") == label_predicate).groupBy(F.col("s").alias("node")).agg(F.min("o").alias("label"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Rows of rank 1 to k; the bound on row_number lets each task keep k rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
