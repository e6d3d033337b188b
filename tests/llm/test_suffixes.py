import hashlib

import numpy as np
import pytest

from tesserae.llm import suffixes


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


@pytest.fixture(scope="module")
def repeats(corpus):
    rows = [*corpus, (500, "ab" * 300), (501, "ab" * 120 + "c"), (502, "z" * 99), (503, "z" * 100), (504, "z" * 101), (505, "€uro " * 50)]
    return rows


def test_against_brute_force(docs, repeats):
    assert result(suffixes.remove_repeats(docs(repeats))) == brute(repeats, 100)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_thousands_of_texts_of_one_doc_id(spark, docs, doc_id):
    """Each is a document of its own: what is removed from all of them, told by the texts, is what one order gives."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    word = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    passages = [word(int(rng.integers(100, 140))) for _ in range(40)]
    texts = list({word(int(rng.integers(1, 80))) + passages[rng.integers(40)] + word(int(rng.integers(1, 80))) for _ in range(4000)})
    table = docs([(doc_id, t) for t in texts + texts[:300]])
    order = {r["text"]: r["tag"] for r in table.select("text", F.xxhash64("text").alias("tag")).distinct().collect()}
    want = brute([(order[t], t) for t in texts], 100)
    done = suffixes._without_repeats(table.withColumn("whole", F.col("text")), ["whole"], 100).select("row.whole", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert len(done) == len(texts) + 300
    for r in done:
        assert tuple(r)[1:] == want[order[r["whole"]]]


def test_common_anchors_are_split(docs, repeats):
    from pyspark.sql import functions as F

    table = docs(repeats)
    keyed = table.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    read = lambda group: {(r["r_doc"], bytes(r["ranges"])) for r in suffixes.repeated_ranges(keyed, group=group).collect()}
    assert read(0.01) == read(0.2) == read(10_000)


def test_small_collections(docs, repeats):
    from pyspark.sql import functions as F

    keyed = docs(repeats).select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    read = lambda n: {(r["r_doc"], bytes(r["ranges"])) for r in suffixes.repeated_ranges(keyed, collection=n).collect()}
    assert read(5) == read(60_000)


def test_transform_orders_suffixes():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 99, rng.integers(10, 30)).astype(np.uint8)) for _ in range(40)]
    anchors = np.array([rng.integers(0, 9) for _ in strings])
    for column, order, common in suffixes.positional_bwt(strings, anchors, 10):
        tails = [s[max(0, column - 9 + a) :] if 0 <= column - 9 + a < len(s) else b"" for s, a in zip(strings, anchors, strict=True)]
        ordered = [tails[i] for i in order]
        live = [t for t in ordered if t]
        assert live == sorted(live)
        for k in range(1, len(ordered)):
            x, y = ordered[k - 1], ordered[k]
            shared = next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            if column >= 9:
                assert common[k] == shared


def test_texts_are_cut(docs):
    rng = np.random.default_rng(8)
    passage = "".join(chr(c) for c in rng.integers(97, 123, 150))
    out = {r["doc_id"]: r for r in suffixes.cut_repeats(docs([(1, passage), (2, "é" + passage + "end")])).collect()}
    assert out[1]["text"] == passage
    assert out[2]["text"] == "éend" and out[2]["n_chars"] == 4
