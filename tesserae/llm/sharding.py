"""Contiguous shards of near equal size, by global prefix sums of bytes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import cut

LAW = "bytes"


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null, plus 1 for the row itself."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def byte_shards(documents: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut all rows, in key order, into `shards` contiguous runs whose bytes are as equal as whole rows allow.

    A row belongs to the shard in which the first of its bytes falls when the sum of all sizes is cut
    at equal targets. One range shuffle of (key, size, crc) orders the rows; totals of its partitions are
    summed to offsets (a table of one row a partition); running sums inside a partition start there.

    Rows with equal or null keys keep some fixed order (null keys first). A null text has size 1 and the
    checksum of the empty string. No rows give no rows. Columns other than key and text are not read.
    """
    rows = documents.select(
        F.col(key).cast("long").alias("doc_id"),
        text_bytes(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    ordered = rows.repartitionByRange(F.asc_nulls_first("doc_id"), F.asc("tie"))
    ordered = cut(ordered.withColumn("part", F.spark_partition_id()), "shard-rows")

    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    whole = Window.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    run = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = ordered.join(F.broadcast(offsets), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("bytes_before") + F.sum("size").over(run) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.count(F.lit(1)).over(run) - 1).alias("row"),
        "all_bytes",
    ).withColumn("shard", F.expr(f"cast(start * {int(shards)} div all_bytes as int)"))
    placed = cut(placed, "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
