import random

import numpy as np
import pytest

from tesserae.llm import jaccard, neardup
from tests.llm.test_neardup import brute


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (1, 60), (2, 100), (5, 75)])
def test_against_brute_force(docs, corpus, k, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(corpus), k, percent).collect()}
    assert got == {i: x[:2] for i, x in brute(corpus, k, percent).items()}


@pytest.mark.parametrize("seed", [0, 1])
def test_large_groups_take_every_way(docs, monkeypatch, seed):
    """Chains of texts that differ more and more, around the threshold; blocks of a few rows."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neardup, "LARGE", 4)
    monkeypatch.setattr(neardup, "PIVOT_ROWS", 3)
    monkeypatch.setattr(neardup, "HOT_SAMPLE", 3)
    rng = random.Random(seed)
    rows = []
    for group in range(5):
        own = [f"w{group}_{i}" for i in range(rng.choice([12, 40, 90]))]
        for i in range(50):
            rows.append((group * 1000 + i, " ".join(own)))
            if rng.random() < 0.3:
                own = rows[rng.randrange(group * 50, len(rows))][1].split()
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                own.insert(rng.randrange(len(own)), "y")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(rows)).collect()}
    assert got == {i: x[:2] for i, x in brute(rows, 3, 90).items()}


def test_many_pivots_lose_no_link(docs):
    """A text that is similar to several that aren't similar to each other, each of which shares other signatures with it."""
    base = [f"w{i}" for i in range(200)]
    rows = [(100, " ".join(base))]
    for i in range(8):
        rows.append((i, " ".join(base[: 20 * i] + [f"x{i}_{j}" for j in range(9)] + base[20 * i + 9 :])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(rows), 1, 90).collect()}
    want = {i: x[:2] for i, x in brute(rows, 1, 90).items()}
    assert got == want and len({c for _, c in want.values()}) == 1


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_similar_sets_share_a_signature_and_survive(percent):
    rng = np.random.default_rng(percent)
    similar = 0
    sketch = jaccard.PartEnum(1, percent)
    for _ in range(3000):
        n = int(rng.integers(1, 150))
        common = rng.integers(0, 2**64, n, dtype=np.uint64)
        spare = max(1, n * (100 - percent) // 60)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**64, int(rng.integers(0, spare + 1)), dtype=np.uint64)])) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if len(a) == len(b) == both or 100 * both < percent * (len(a) + len(b) - both):
            continue
        similar += 1
        assert len(np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)))
        tables = [np.frombuffer(next(sketch.describe(x, np.array([0]), np.array([len(x)])))[0], np.uint8).reshape(1, -1) for x in (a, b)]
        assert len(sketch.survivors(*tables)[0]) == 1
    assert similar > 300


def test_unlike_sets_share_none():
    rng = np.random.default_rng(0)
    seen = set()
    for _ in range(300):
        own = set(jaccard.signatures(np.sort(rng.integers(0, 2**64, 300, dtype=np.uint64)), 90).tolist())
        assert not own & seen
        seen |= own


def test_bands_follow_each_other():
    for percent in (60, 80, 90, 99):
        last = (-1, 0, 0)
        for n in range(1, 3000):
            band = jaccard.size_band(n, percent)
            assert band[1] <= n <= band[2] and band[0] in (last[0], last[0] + 1)
            # the smallest partner is in this band or the one below
            assert jaccard.size_band(-(-n * percent // 100), percent)[0] >= band[0] - 1
            last = band


def test_empty_and_bare(docs):
    assert jaccard.jaccard_components(docs([])).count() == 0
    rows = [(None, None), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (4, "other"), (5, ""), (6, None)]
    got = sorted((tuple(r) for r in jaccard.jaccard_components(docs(rows)).collect()), key=str)
    assert got == sorted([(None, 0, None), (None, 2, 4), (4, 2, 4), (4, 2, 4), (4, 1, 4), (5, 0, 5), (6, 0, 6)], key=str)
