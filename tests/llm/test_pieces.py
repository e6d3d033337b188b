import numpy as np
import pytest

from tesserae.llm import pieces


def vocab():
    return pieces.vocabulary()


def test_round_trip(spark, docs, corpus):
    table = docs(corpus)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(table)).collect()}
    assert back == dict(corpus)
    assert all(r["lossless"] for r in pieces.encode_digest(table).collect())


def test_reproducible_whatever_the_partitions(docs, corpus):
    ids = lambda df: {r["doc_id"]: r["ids"] for r in pieces.encode(df).collect()}
    table = docs(corpus)
    first = ids(table)
    assert first == ids(table.repartition(7))
    assert first != {r["doc_id"]: r["ids"] for r in pieces.encode(table, seed=2).collect()}


def all_paths(v, text):
    """Every segmentation of a chunk and its weight, by recursion."""
    known = {v.bytes_of[i].decode(): i for i in range(259, len(v.bytes_of)) if v.bytes_of[i]}
    if not text:
        return {(): 0.0}
    out = {}
    for k in range(1, len(text) + 1):
        if text[:k] in known:
            i = known[text[:k]]
            for rest, w in all_paths(v, text[k:]).items():
                out[(i, *rest)] = pieces.THETA * v.weight[i] + w
    return out


@pytest.mark.parametrize("word", [" the", " dated"])
def test_sampled_frequencies_are_the_lattice_s(word):
    v = vocab()
    paths = all_paths(v, word)
    weights = np.array(list(paths.values()))
    share = dict(zip(paths, np.exp(weights - np.logaddexp.reduce(weights)), strict=True))
    n = 20_000
    drawn = pieces.sample_texts([word[1:]] * n, np.arange(n), v)
    seen = {}
    for d in drawn:
        seen[tuple(d.tolist())] = seen.get(tuple(d.tolist()), 0) + 1
    assert set(seen) <= set(share)
    for path, p in share.items():
        assert abs(seen.get(path, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_segmentation_does_not_depend_on_the_batch():
    v = vocab()
    texts = ["a small text", "another  one\n\nhere", "x" * 3000]
    together = pieces.sample_texts(texts, np.array([5, 6, 7]), v)
    for i, t in enumerate(texts):
        assert together[i].tolist() == pieces.sample_texts([t], np.array([5 + i]), v)[0].tolist()
