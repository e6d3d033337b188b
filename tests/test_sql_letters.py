"""Letters outside ASCII, where a query and its SQL could part."""

import duckdb
import pytest

from tesserae.functions import text as X
from tesserae.operators import annotate as N
from tesserae.plans import registry


@pytest.mark.parametrize("name", ["label_matches", "annotate_spans", "annotate_html", "sentify"])
def test_same_rows(spark, tmp_path, name):
    texts = [(1, "ob ciónñmente lo sabe"), (2, "ciónta lo ve . ße ist da. . ᾀb c . ﬁn"), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"<p>{t}</p>") for i, t in texts], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    turns = [(1, 1, "ciónñmente lo sabe"), (1, 2, "ciónta lo ve"), (1, 0, "mente"), (2, 0, "ciónta")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_labels_of_any_number_of_tokens_are_found(spark):
    texts = spark.createDataFrame([(1, "ob ciónñmente lo sabe")], "doc_id long, text string")
    labels = spark.createDataFrame([("ciónñmente lo",)], "label string")
    assert [r["label"] for r in N.matches(texts, labels).collect()] == ["ciónñmente lo"]


def test_capitals_of_one_character(spark):
    """Latin, Greek and ligatures; elsewhere the engines know different versions of Unicode."""
    every = "select i, chr(i::int) c, upper(chr(i::int)) u from range(1, 65536) t(i) where i < 384 or i between 880 and 1023 or i between 7680 and 8191 or i between 64256 and 64279"
    rows = duckdb.sql(every).fetchall()
    df = spark.createDataFrame([(c, u) for _, c, u in rows], "c string, u string")
    assert df.filter(X.capital(df.c) != df.u).collect() == []
