import hashlib
import math
import random

import numpy as np
import pytest

from tesserae.llm import codes


def brute(rows, parts, entries, rounds):
    """Rows (vec_id, vector, label) by plain loops."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[list(cut(v)[p]) for _, v, _ in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((far(x, c), e) for e, c in enumerate(book)) for x, book in zip(cut(v), books, strict=True)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(kept[i][1])[p] for i, f in enumerate(found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), lab) for (i, _, lab), f in zip(kept, assign(), strict=True)]
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, lab, c, min(e, 2**63 - 1), min(total[lab], 2**63 - 1), digest) for i, c, e, lab in out), key=str)


def rows_of(seed, n, dims, spread=1.0):
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.gauss(0, spread)) for _ in range(dims)], rng.choice([0, 1, 2, None])) for i in range(n)]
    rows += [(500 + i, rows[3][1], 1) for i in range(n // 3)]
    return rows + [(700, None, 0), (701, [None] * dims, 0), (702, [float("nan")] * dims, 1), (703, [float("-inf")] * dims, None), (None, rows[1][1], None), (2, rows[4][1], 2), (2, rows[2][1], 2), (800, [0.0] * dims, 9)]


@pytest.mark.parametrize(("seed", "n", "dims", "spread"), [(0, 90, 16, 1.0), (1, 40, 8, 0.0001), (2, 5, 24, 1.0), (3, 60, 16, 1e9), (4, 60, 16, 1e30)])
def test_codes_against_brute_force(spark, seed, n, dims, spread):
    rows = rows_of(seed, n, dims, spread)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(5)
    got = sorted((tuple(r) for r in codes.vector_codes(df).collect()), key=str)
    # the JVM's floor gives 64-bit integers, the largest for what is beyond
    clip = lambda v: None if v is None else [x if x is None or not math.isfinite(x) else max(-(2.0**63), min(x * 4096, 2.0**63)) / 4096 for x in v]
    want = brute([(i, clip(v), lab) for i, v, lab in rows], 8, 16, 6)
    if spread < 1e20:
        assert got == want
    else:
        assert [g[0] for g in got] == [w[0] for w in want]


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert codes.vector_codes(spark.createDataFrame([(1, None, 2)], schema)).count() == 0


def test_unlike_lengths_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0] * 8, 2), (2, [1.0] * 16, 2)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError, match="equal parts"):
        codes.vector_codes(df)


@pytest.mark.parametrize("seed", range(4))
def test_pruning_never_loses_the_nearest(seed):
    rng = np.random.default_rng(seed)
    entries = np.floor(40 * rng.standard_normal((16, 4)) * rng.random((16, 1))).astype(np.int64)
    entries[7] = entries[3]
    x = np.floor(40 * rng.standard_normal((3000, 4)) * rng.random((3000, 1))).astype(np.int64)
    x[:16] = entries
    book = codes.Annuli(entries)
    index, squared = book.nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (squared == every.min(axis=1)).all()
    assert book.evaluated < 0.8 * every.size
