"""Incremental forms of profile operators over streams of facts: an extension, not part of the surveyed system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(facts: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of each predicate by tumbling window; facts that come later than `late` are left out."""
    w = facts.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "p").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "p", "n")


def first_facts(facts: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each (s, p, o) once within the watermark."""
    return facts.withWatermark(time, late).dropDuplicatesWithinWatermark(["s", "p", "o"])
