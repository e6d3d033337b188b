import zlib

import pytest
from pyspark.sql import functions as F

from tesserae.llm.sharding import byte_shards


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_contiguous_balanced_gapless(docs, corpus, shards):
    rows = sorted(byte_shards(docs(corpus), shards).collect(), key=lambda r: r["doc_id"])
    texts = dict(corpus)
    assert [r["doc_id"] for r in rows] == sorted(texts)
    total = sum(r["size"] for r in rows)
    start, slots = 0, {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert r["shard"] == start * shards // total
        assert r["slot"] == slots.get(r["shard"], 0)
        slots[r["shard"]] = r["slot"] + 1
        start += r["size"]


def test_one_key_of_many_rows(docs):
    rows = byte_shards(docs([(7, f"t{i % 3}") for i in range(900)] + [(1, "a"), (9, "b")]), 4).collect()
    sizes = {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert len(rows) == 902
    assert max(sizes.values()) - min(sizes.values()) <= 6


def test_no_python_in_the_plan(docs, corpus):
    plan = byte_shards(docs(corpus).withColumn("extra", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
