import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import topk, warc


def brute(rows, is_query, k):
    fine = [(i, [np.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(fine):
        if is_query(q):
            scored = sorted((-int(np.dot(v, w)), i) for m, (i, w) in enumerate(fine) if m != n and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 8192])
def test_search_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # one common vector: ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (None, rows[0][1]), (303, []), (310, [1.0, 2.0]), (304, [0.0] * 8), (305, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k=5).collect())
    assert got == brute(as_float, lambda i: i % 10 == 0, 5)


def test_search_in_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_bounds_never_lose_a_winner():
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.standard_normal((500, 16)) * rng.random(16))
    q = np.floor(256 * rng.standard_normal((40, 16)))
    for i, found in enumerate(topk.SortedLists(v).candidates(q, 5, np.full(40, -1))):
        best = np.argsort(-(v @ q[i]), kind="stable")[:5]
        assert set(best.tolist()) <= set(found.tolist())


PAGES = [(3, "http://a/3", "x" * 150), (1, "http://a/1", "x" * 150), (2, None, "x" * 150), (4, "http://a/4", "short"), (5, "http://a/5", "short"), (6, "http://a/6\r\nX: y", None), (7, "u", "é" * 5000 + "\r\n\r\nWARC/1.1\r\n"), (8, "u", ""), (9, "u", "é" * 5000 + "\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("chunk", [64, 256 << 10])
def test_archive_round_trip(spark, chunk):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, record_type string")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archive_pages(df, chunk).collect()}
    first = {}
    for i, _, h in sorted(PAGES):
        data = (h or "").encode()
        f = first.setdefault(data, i) if len(data) >= 100 else i
        assert got[i] == (len(data), hashlib.sha256(data).hexdigest(), "response" if f == i else "revisit", None if f == i else f)
    assert len(got) == len(PAGES)


def test_chunks_are_bounded_and_whole(spark):
    chunks = warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), 64)
    assert chunks.agg(F.max(F.octet_length("block"))).first()[0] < 64 + 700
    text = {i: h for i, _, h in PAGES}
    own = {}
    for r in warc.record_payloads(chunks).orderBy("record_id", "serial", "chunk_no").collect():
        data = own.setdefault(r["record_id"], b"")
        assert r["offset"] == len(data)
        own[r["record_id"]] = data + bytes(r["payload"])
    assert own["<urn:page:7>"].decode() == text[7]
    assert own["<urn:page:9>"] == b""


def test_damage_is_found(spark):
    chunks = warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    bad = chunks.withColumn("block", F.when(F.col("record_id") == "<urn:page:4>", F.encode(F.replace(F.decode("block", "UTF-8"), F.lit("short"), F.lit("shirt")), "UTF-8")).otherwise(F.col("block")))
    assert {r["page_id"] for r in warc.read_archive(bad).filter("not intact").collect()} == {4}


def test_repeated_pages_and_null_ids(spark):
    rows = [(1, "u", "y" * 200), (1, "u", "y" * 200), (None, "u", "y" * 200), (2, "u", "y" * 200)]
    got = sorted((str(r["page_id"]), r["record_type"]) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [("1", "response"), ("1", "response"), ("2", "revisit"), ("None", "response")]
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_one_page_id_with_several_payloads(spark):
    a, b, own = "a" * 200, "b" * 200, "c" * 200
    rows = [(1, "u", a), (2, "u", b), (3, "u", a), (3, "u", b), (3, "u", own)]
    out = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = sorted((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, digest(a), "response", None), (2, digest(b), "response", None), (3, digest(a), "revisit", 1), (3, digest(b), "revisit", 2), (3, digest(own), "response", None)]
    assert got == sorted(want)


def test_long_addresses_and_dates(spark):
    rows = [(1, "http://a/" + "y" * 300_000, "z" * 500), (2, "http://b/\u00e9", "z" * 500)]
    chunks = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), 64, date="2020-01-02T03:04:05Z")
    heads = [bytes(r["block"]) for r in chunks.filter("chunk_no = 0").collect()]
    assert all(b"\r\nWARC-Date: 2020-01-02T03:04:05Z\r\n" in h for h in heads)
    got = sorted((r["page_id"], r["record_type"], r["intact"]) for r in warc.read_archive(chunks).collect())
    assert got == [(1, "response", True), (2, "revisit", True)]


def test_reads_stop_early_where_lists_allow_it():
    """Vectors of a few large components are told apart near the ends of the lists."""
    rng = np.random.default_rng(5)
    v = np.zeros((2000, 12))
    for row in v:
        row[rng.integers(0, 12, 2)] = np.floor(256 * rng.random(2) ** 0.25)
    lists = topk.SortedLists(v)
    found = lists.candidates(v[:30], 5, np.arange(30))
    assert np.mean(lists.depths) < 0.6
    assert max(map(len, found)) < 1000
    for i, rows in enumerate(found):
        score = np.delete(v @ v[i], i)
        kept = rows[rows != i]
        assert sorted((v[kept] @ v[i]).tolist())[-5:] == sorted(score.tolist())[-5:]


def test_queries_read_the_lists_together(monkeypatch):
    """A part of the lists is made once, not for each query; unlike magnitudes lose no winner in single precision."""
    made = []
    part = topk.SortedLists._part

    def counted(self, a, b):
        if (a, b) not in self.parts:
            made.append((a, b))
        return part(self, a, b)

    monkeypatch.setattr(topk.SortedLists, "_part", counted)
    rng = np.random.default_rng(7)
    v = np.floor(rng.standard_normal((3000, 16)) * 10.0 ** rng.integers(0, 9, (3000, 1)))
    v[::97] = 0
    q = np.concatenate([v[:200], -v[200:300]])
    found = topk.SortedLists(v).candidates(q, 5, np.full(300, -1))
    assert len(made) <= 2 * len(topk.LOOKS)
    for x, rows in zip(q, found, strict=True):
        exact = sorted((int(s) for s in topk._exact_scores(v, x)), reverse=True)[:5]
        assert sorted((int(s) for s in topk._exact_scores(v[rows], x)), reverse=True)[:5] == exact
