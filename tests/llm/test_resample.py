import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import resample
from tesserae.llm.common import utf8_buffer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_of(text, longest):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(lower)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, buckets=10_000, longest=1, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in runs_of(text, longest)[1]) for texts in ([x for _, x in rows], target))
    total = sum(s.values()) + buckets, sum(t.values()) + buckets
    out, keyed = [], []
    for n, (i, text) in enumerate(rows):
        words, found = runs_of(text, longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * total[0] / ((s[b] + 1) * total[1]))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if len(words) >= least:
            keyed.append((-score, i is None, i or 0, n))
    for rank, (*_, n) in enumerate(sorted(keyed)[: percent * len(keyed) // 100], 1):
        out[n][4] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("longest", "percent", "range_rows", "block"), [(1, 10, 16_384, 4096), (1, 60, 7, 3), (3, 100, 20, 2), (2, 0, 7, 3)])
def test_draw_against_brute_force(spark, docs, corpus, monkeypatch, longest, percent, range_rows, block):
    monkeypatch.setattr(resample, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(resample, "BLOCK_ROWS", block)
    rows = [*corpus, (500, "Ärger-2x ÄRGER\x7fa`b{c" * 30), (501, "x" * 300 + " " + "Y" * 65 + " z" * 30), (None, "a b c d e " * 5), (None, "f g h i j " * 5)]
    rows += [(502, rows[4][1]), (502, rows[4][1])]
    target = [t for i, t in corpus if i % 7 == 0] + [None, ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs(rows).repartition(4), items, longest=longest, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, target, longest=longest, percent=percent)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(docs([]), none).count() == 0
    rows = [(i, f"w{i} " * 30) for i in range(20)]
    assert sorted((tuple(r) for r in resample.resample(docs(rows), none).collect()), key=str) == brute(rows, [])
    blank = [(1, None), (2, ""), (None, None)]
    assert sorted((tuple(r) for r in resample.resample(docs(blank), none).collect()), key=str) == brute(blank, [])


def test_ties_of_many_rows(spark, docs, monkeypatch):
    """A third of all rows with one doc_id and text: one score, parted over ranges by the rows themselves."""
    monkeypatch.setattr(resample, "RANGE_ROWS", 10)
    rows = [(7, "a b " * 20)] * 60 + [(i, f"w{i % 9} x " * 15) for i in range(100, 220)]
    items = spark.createDataFrame([(1, "a b a b")], "item_id long, text string")
    got = resample.resample(docs(rows).repartition(5), items, percent=50).collect()
    want = brute(rows, ["a b a b"], percent=50)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_buckets_are_those_of_crc32():
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice([*range(32, 127), 233, 0x1F600])) for _ in range(rng.randrange(400))) for _ in range(50)] + ["q" * 1000, None, ""]
    owner, bucket, words = resample.features(*utf8_buffer(pa.array(texts)), 10_000, 2)
    want = sorted((d, zlib.crc32(f.encode()) % 10_000) for d, t in enumerate(texts) for f in runs_of(t, 2)[1])
    assert sorted(zip(owner.tolist(), bucket.tolist(), strict=True)) == want
    assert words.tolist() == [len(runs_of(t, 1)[0]) for t in texts]


@pytest.mark.parametrize("wanted", [0, 1, 37, 500])
def test_merge_of_runs(wanted):
    rng = random.Random(wanted)
    runs = [sorted((rng.randrange(50), 0, rng.randrange(9), r * 1000 + i, i, r) for i in range(rng.randrange(1, 60))) for r in range(11)]
    blocks = [(run[i][:4], r, run[i : i + 5]) for r, run in enumerate(runs) for i in range(0, len(run), 5)]
    merge = resample.Merge(wanted)
    most = 0
    for head, r, rows in sorted(blocks):
        merge.add(r, head, np.array(rows, np.int64).tobytes())
        most = max(most, len(merge.open))
    merge.advance(resample.Tournament.DONE)
    assert merge.take() == list(heapq.merge(*runs))[:wanted]
    assert most <= len(runs)
