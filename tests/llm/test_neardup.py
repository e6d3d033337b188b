import re

import numpy as np
import pytest

from tesserae.llm import graph, neardup


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(docs, corpus, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(corpus), k).collect()}
    assert got == brute(corpus, k)


def test_large_groups_take_every_way(docs, monkeypatch):
    """Blocks of a few rows and small components send stragglers through all comparisons."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neardup, "LARGE", 4)
    monkeypatch.setattr(neardup, "PIVOT_ROWS", 3)
    monkeypatch.setattr(neardup, "HOT_SAMPLE", 3)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.choice(60, rng.integers(0, 9), replace=False):
            own[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(rows), 2).collect()}
    assert got == brute(rows, 2)


def test_screen_misses_little():
    need = neardup.least_matches()
    rng = np.random.default_rng(1)
    hashes = np.cumsum(rng.random((2000, neardup._HASHES)) < 0.8, axis=1)
    lost = np.zeros(2000, bool)
    for n, least in need.items():
        lost |= hashes[:, n - 1] < least
    assert lost.mean() < 0.001


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_components(spark, monkeypatch, local):
    """By star rounds and by one task."""
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    got = {r["uid"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for n in near:
        seen, front = {n}, {n}
        while front:
            front = {m for x in front for m in near[x]} - seen
            seen |= front
        assert got.get(n, n) == min(seen)


def test_one_of_each_group_stays(docs, corpus):
    kept = {r["doc_id"] for r in neardup.reject_near_duplicates(docs(corpus), 2).collect()}
    assert kept == {i for i, (_, _, k) in brute(corpus, 2).items() if k}
