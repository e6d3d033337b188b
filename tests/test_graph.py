import itertools
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import graph, sets

TINY = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("c", "e"), ("x", "y")]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(s, "r", o) for s, o in TINY], "s string, p string, o string")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def reach(edges):
    nodes = {n for e in edges for n in e}
    out = set()
    for n in nodes:
        front, seen = {n}, set()
        while front:
            front = {o for s, o in edges if s in front} - seen
            seen |= front
        out |= {(n, m) for m in seen}
    return out


def test_roots_and_leaves(tiny):
    assert {r[0] for r in sets.roots(tiny).collect()} == {"d", "x"}
    assert {r[0] for r in sets.leaves(tiny).collect()} == {"e", "y"}


def test_closure(tiny):
    got = pairs(graph.closure(tiny))
    assert got == reach(TINY)
    assert len(got) == 17


def test_reachable_with_and_without_depth(spark, tiny):
    d = spark.createDataFrame([("d",)], "node string")
    assert {r["node"] for r in graph.reachable(tiny, d).collect()} == set("abcde")
    assert {r["node"] for r in graph.reachable(tiny, d, depth=1).collect()} == {"a", "d"}


def test_components(tiny):
    weak = {}
    for n, c in pairs(graph.weak_components(tiny)):
        weak.setdefault(c, set()).add(n)
    assert sorted(map(sorted, weak.values())) == [list("abcde"), ["x", "y"]]
    strong = {}
    for n, c in pairs(graph.strong_components(tiny)):
        strong.setdefault(c, set()).add(n)
    assert [v for v in strong.values() if len(v) > 1] == [{"a", "b", "c"}]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(22)]
    df = spark.createDataFrame([(s, "r", o) for s, o in edges], "s string, p string, o string")
    nodes = {n for e in edges for n in e}
    both = reach([*edges, *[(o, s) for s, o in edges]])
    assert pairs(graph.weak_components(df)) == {(n, min([n, *[m for k, m in both if k == n]])) for n in nodes}
    forward = reach(edges)
    assert pairs(graph.strong_components(df)) == {(n, max([n, *[m for k, m in forward if k == n and (m, n) in forward]])) for n in nodes}


def test_betweenness(tiny):
    got = {r["node"]: (r["raw"], r["normalised"]) for r in graph.betweenness(tiny).collect()}
    assert all(got[n][0] == pytest.approx(4) for n in "abc")
    assert all(got[n][0] == 0 for n in "dexy")
    assert got["a"][1] == pytest.approx(4 / 30)


def test_equivalence_is_symmetric(spark):
    t = spark.createDataFrame([("a", "eq", "b"), ("a", "eq", "c"), ("c", "likes", "z")], "s string, p string, o string")
    out = graph.equivalence_edges(t, ["eq"])
    assert {r["s"] for r in out.filter("p = 'likes'").collect()} == {"a", "b", "c"}


def test_formal_concepts_against_brute_force(spark):
    rng = random.Random(3)
    context = {(f"o{i}", f"a{j}") for i in range(6) for j in range(5) if rng.random() < 0.5}
    got = {(frozenset(r["intent"]), frozenset(r["extent"])) for r in graph.formal_concepts(spark.createDataFrame(sorted(context), "object string, attribute string")).collect()}
    objects, attributes = {o for o, _ in context}, {a for _, a in context}
    want = set()
    for k in range(len(attributes) + 1):
        for some in itertools.combinations(sorted(attributes), k):
            extent = frozenset(o for o in objects if all((o, a) in context for a in some))
            intent = frozenset(a for a in attributes if all((o, a) in context for o in extent))
            want.add((intent, extent))
    # an intersection over no object at all is only reached if two objects' intents meet in it
    assert {c for c in want if c[1]} <= got | {(frozenset(), frozenset(objects))}
    assert got <= want


def test_transitive_reduction(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("a", "r", "c")], "s string, p string, o string")
    assert pairs(graph.transitive_reduction(e)) == {("a", "b"), ("b", "c")}


def test_keep_longest_takes_the_first_of_ties(spark):
    rows = spark.createDataFrame([(1, 1, 5, 0), (1, 2, 3, 1), (1, 2, 9, 2), (1, 2, 9, 3)], "k int, tokens int, chars int, ord int")
    assert sets.keep_longest(rows, ["k"], ["tokens", "chars"], "ord").first()["ord"] == 2


def test_ranking_ties_take_the_larger_index(spark):
    from tesserae.operators.rank import ranked

    rows = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.7), (1, 2, 0.5)], "q int, idx int, similarity double")
    got = ranked(rows, "q", "idx", threshold=0.5).orderBy("rank")
    assert [r["idx"] for r in got.collect()] == [1, 2, 0]


def test_tfidf(spark):
    from tesserae.operators.rank import tfidf_similarity

    corpus = spark.createDataFrame([(0, "law applies to contract"), (1, "contract obligation law"), (2, "court decides")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "contract obligation")], "qid int, question string")
    got = {r["doc_id"]: r["similarity"] for r in tfidf_similarity(corpus, q).collect()}
    assert got[0] == pytest.approx(0.084770, abs=1e-6)
    assert got[1] == pytest.approx(0.944960, abs=1e-6)
    assert got.get(2, 0.0) == 0.0


def test_label_similarity(spark):
    from tesserae.functions.text import similar

    row = spark.range(1).select(similar(F.lit("obligation"), F.lit("obligations")).alias("a"), similar(F.lit("court"), F.lit("contract")).alias("b"), similar(F.lit(""), F.lit("")).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (True, False, True)


def test_concepts_are_complete_or_an_error(spark):
    context = spark.createDataFrame([(f"o{i}", f"a{j}") for i in range(4) for j in range(4) if i != j], "object string, attribute string")
    assert graph.formal_concepts(context).count() == 16
    with pytest.raises(ValueError, match="after 1 rounds"):
        graph.formal_concepts(context, max_rounds=1)


def test_betweenness_in_batches_and_by_samples(spark):
    import random

    rng = random.Random(4)
    rows = [(f"n{rng.randrange(25)}", "r", f"n{rng.randrange(25)}") for _ in range(60)]
    edges = spark.createDataFrame(rows, "s string, p string, o string")
    read = lambda df: {r["node"]: round(r["raw"], 6) for r in df.collect()}
    whole = read(graph.betweenness(edges))
    assert read(graph.betweenness(edges, batch=6)) == whole
    assert read(graph.betweenness(edges, batch=9, sources=100)) == whole
    some = read(graph.betweenness(edges, sources=8))
    n = len(whole)
    assert some.keys() == whole.keys() and some != whole
    assert all(abs(some[x] - whole[x]) <= 4 * n * n / (2 * 8**0.5) for x in whole)


def test_equivalence_says_all_of_a_class(spark):
    rows = [("a", "same", "b"), ("b", "same", "c"), ("a", "p", "x"), ("y", "q", "c"), ("b", "r", "a"), ("x", "q", "y"), ("x", "q", "y")]
    edges = spark.createDataFrame(rows, "s string, p string, o string")
    got = [tuple(r) for r in graph.equivalence_edges(edges, ["same"]).collect()]
    peers = {"a": "abc", "b": "abc", "c": "abc"}
    want = {(m, p, o) for s, p, o in rows for m in peers.get(s, s)} | {(s, p, m) for s, p, o in rows for m in peers.get(o, o)}
    assert sorted(got) == sorted(want)


def test_pairs_of_a_large_class_are_made_once_each_and_not_shuffled(spark):
    """Before, all pairs went through a distinct; classes that speak of classes and null predicates are told apart as ever."""
    from pyspark.sql import types as T

    rows = [(f"m{i}", "same", "c") for i in range(300)] + [(f"n{i}", "same", "d") for i in range(40)]
    rows += [("m1", "p", "n1"), ("m2", "p", "n2"), ("m2", "p", "z"), ("z", "p", "n3"), ("n1", None, "m7"), ("z", "q", "z"), ("m1", "same", "m2"), ("m1", "p", "n1")]
    out = graph.equivalence_edges(spark.createDataFrame(rows, T._parse_datatype_string("s string, p string, o string")), ["same"])
    got = [tuple(r) for r in out.collect()]
    peers = {}
    for name, hub in (("m", "c"), ("n", "d")):
        all_of = {hub} | {s for s, p, o in rows if p == "same" and o == hub}
        peers |= dict.fromkeys(all_of, all_of)
    want = {(m, p, o) for s, p, o in rows for m in peers.get(s, {s})} | {(s, p, m) for s, p, o in rows for m in peers.get(o, {o})}
    assert len(got) == len(set(got)) and set(got) == want
    assert "Aggregate [" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_dealt_join_gives_the_rows_of_a_join(spark):
    left = spark.createDataFrame([(i % 3 and 1, i) for i in range(90)], "k long, x long")
    right = spark.createDataFrame([(i % 4 and 1, i) for i in range(70)], "k long, y long")
    assert sorted(map(tuple, graph._dealt_join(left, right, "k", block=8).collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_cooccurrence(spark):
    from tesserae.operators.summary import cooccurrence

    words = {1: "a b a c", 2: "b a", 3: "a"}
    rows = [(s, i, w) for s, t in words.items() for i, w in enumerate(t.split())]
    df = spark.createDataFrame(rows, "sent int, pos long, word string")
    for window in (0, 1, 2):
        want: dict = {}
        for s, i, w in rows:
            for t, j, x in rows:
                if s == t and i < j and w != x and (not window or j - i <= window):
                    key = tuple(sorted((w, x)))
                    want[key] = want.get(key, 0) + 1
        assert {(r["a"], r["b"]): r["weight"] for r in cooccurrence(df, window).collect()} == want


def test_clusters_against_distances_of_all_pairs(spark):
    import math

    rng = random.Random(5)
    rows = [(g, i * 3, [float(rng.randrange(4)) for _ in range(2)]) for g in (1, 2) for i in range(12)] + [(3, 1, [0.0, 0.0])]
    want = []
    for g in (1, 2):
        live = {i: (v, 1) for h, i, v in rows if h == g}
        for step in range(11):
            d, a, b = min((math.dist(live[a][0], live[b][0]), a, b) for a in live for b in live if a < b)
            (u, m), (v, n) = live[a], live.pop(b)
            live[a] = ([(x * m + y * n) / (m + n) for x, y in zip(u, v, strict=True)], m + n)
            want.append((g, step, a, b, m + n, round(d, 9)))
    got = graph.dendrogram(spark.createDataFrame(rows, "group long, id long, vector array<double>")).collect()
    assert sorted((*r[:5], round(r[5], 9)) for r in got) == want


def test_clusters_hold_no_distances_of_all_pairs():
    """Before, 1,500 vectors of 64 numbers took more than a GB."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    vectors = np.random.default_rng(1).normal(size=(1500, 64))
    rows = pd.DataFrame({"group": 1, "id": range(1500), "vector": list(vectors)})
    tracemalloc.start()
    assert len(graph._linkage(rows)) == 1499
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
