from pyspark.sql import functions as F

from tesserae.plans.registry import table
from tesserae.sources.scratch import written


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_packed_tables_are_not_broadcast_by_the_sizes_of_their_files(spark, tmp_path):
    """A million short rows take little room in a file and much in memory."""
    rows = spark.range(1_000_000).select((F.col("id") / 20).cast("long").alias("k"), (F.col("id") % 20).cast("int").alias("i"))
    packed = written(rows)
    assert "BroadcastHashJoin" not in plan(packed.join(packed.withColumnRenamed("i", "j"), "k"))
    rows.write.parquet(f"{tmp_path}/rows.parquet")
    read = table(spark, str(tmp_path), "rows")
    assert "BroadcastHashJoin" not in plan(read.join(read.withColumnRenamed("i", "j"), "k"))
    few = written(spark.range(100).select(F.col("id").alias("k")))
    assert "BroadcastHashJoin" in plan(packed.join(few, "k"))
