from pyspark.sql import functions as F

from tesserae.streaming.incremental import first_facts, windowed_counts


def stream(spark, tmp_path):
    rows = [("a", "p", "x", "2024-01-01 00:01:00"), ("a", "p", "x", "2024-01-01 00:02:00"), ("b", "q", "y", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "s string, p string, o string, t string").select("s", "p", "o", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("s string, p string, o string, ts timestamp").parquet(str(tmp_path / "in"))


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_windowed_counts(spark, tmp_path):
    out = drain(windowed_counts(stream(spark, tmp_path)), "counts", "complete")
    assert {(r["p"], r["n"]) for r in out.collect()} == {("p", 2), ("q", 1)}


def test_first_facts(spark, tmp_path):
    out = drain(first_facts(stream(spark, tmp_path)), "facts", "append")
    assert {(r["s"], r["o"]) for r in out.collect()} == {("a", "x"), ("b", "y")}
    assert out.count() == 2
