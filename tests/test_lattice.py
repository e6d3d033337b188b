import random
from itertools import combinations

import pytest

from tesserae.operators import lattice as L


def context(seed, n, m, share):
    rng = random.Random(seed)
    return {f"o{i}": frozenset(f"a{j}" for j in range(m) if rng.random() < share) for i in range(n)}


def brute(rows):
    """Concepts of object -> attributes, covers, labels and triples by plain search; objects without attributes are none."""
    rows = {o: a for o, a in rows.items() if a}
    every = frozenset().union(*rows.values())
    intents = {every} | {frozenset.intersection(*(rows[o] for o in g)) for n in range(1, len(rows) + 1) for g in combinations(sorted(rows), n)}
    extents = {b: sorted(o for o, a in rows.items() if b <= a) for b in intents}
    covers = {(u, d) for u in intents for d in intents if u < d and not any(u < x < d for x in intents)}
    objects = {b: sorted(o for o, a in rows.items() if a == b) for b in intents}
    greatest = {a: min((b for b in intents if a in b), key=len) for a in every}
    properties = {b: sorted(a for a in every if greatest[a] == b) for b in intents}
    triples = set()
    for u, d in covers:
        if objects[u]:
            rest, seen = [d], set()
            while rest:
                x = rest.pop()
                if x in seen:
                    continue
                seen.add(x)
                if objects[x]:
                    triples.add((tuple(objects[u]), tuple(properties[d]), tuple(objects[x])))
                else:
                    rest += [z for y, z in covers if y == x]
    return extents, covers, triples


CONTEXTS = {1: context(0, 7, 5, 0.5), 2: context(1, 9, 6, 0.3), 3: context(2, 6, 4, 0.8), None: {"x": frozenset({"p"})}, 5: {"x": frozenset("pq"), "y": frozenset("pq"), "z": frozenset("p")}}


@pytest.fixture(scope="module")
def made(spark):
    rows = [(c, o, a, 1) for c, objects in CONTEXTS.items() for o, own in objects.items() for a in own]
    rows += rows[:5] + [(1, None, "a1", 1), (2, "o1", None, 1)]
    return L.Lattices(spark.createDataFrame(rows, "context int, object string, attribute string, k int"))


def by_context(df, f):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["context"], set()).add(f(r))
    return out


def test_concepts_of_many_contexts(made):
    got = by_context(made.concepts(), lambda r: (tuple(r["intent"]), tuple(r["extent"])))
    assert got == {c: {(tuple(sorted(b)), tuple(e)) for b, e in brute(x)[0].items()} for c, x in CONTEXTS.items()}
    assert made.concepts().count() == sum(map(len, got.values()))


def test_neighbours(made):
    got = by_context(made.edges(), lambda r: (tuple(r["upper"]), tuple(r["lower"])))
    assert got == {c: e for c, x in CONTEXTS.items() if (e := {(tuple(sorted(u)), tuple(sorted(d))) for u, d in brute(x)[1]})}


def test_triples_skip_concepts_without_objects(made):
    got = by_context(made.triples(), lambda r: (tuple(r["subjects"]), tuple(r["properties"]), tuple(r["objects"])))
    assert got == {c: t for c, x in CONTEXTS.items() if (t := brute(x)[2])}


def test_minimal_taxonomy(spark):
    above = {"dog": ["dog", "canine", "animal"], "cat": ["cat", "feline", "animal"], "canine": ["canine", "animal"], "feline": ["feline", "animal"], "animal": ["animal"]}
    df = spark.createDataFrame([(s, o) for s, x in above.items() for o in x], "s string, o string")
    got = {tuple(r) for r in L.minimal_taxonomy(df).collect()}
    assert got == {("dog", "canine"), ("canine", "animal"), ("cat", "feline"), ("feline", "animal")}


def test_nothing(spark):
    none = L.Lattices(spark.createDataFrame([], "context int, object string, attribute string"))
    assert none.concepts().count() == none.edges().count() == none.triples().count() == 0


def test_taxonomies_do_not_hold_the_concept_of_all_attributes(spark, monkeypatch):
    """Before, it stood below each of the lowest concepts with its whole intent: the square of the nodes."""
    sizes, write = [], L.written

    def seen(df):
        out = write(df)
        if "lower" in out.columns:
            sizes.append(out.selectExpr("max(size(lower))").first()[0] or 0)
        return out

    monkeypatch.setattr(L, "written", seen)
    rows = [(f"s{i}", o) for i in range(30) for o in (f"s{i}", f"n{i % 3}", "r")] + [(f"n{i}", o) for i in range(3) for o in (f"n{i}", "r")] + [("r", "r")]
    got = {tuple(r) for r in L.minimal_taxonomy(spark.createDataFrame(rows, "s string, o string")).collect()}
    assert got == {(f"s{i}", f"n{i % 3}") for i in range(30)} | {(f"n{i}", "r") for i in range(3)}
    assert max(sizes) == 3


def test_labels_do_not_repeat_the_concept_of_all_attributes(spark, monkeypatch):
    """Before, each attribute had a row with that concept's whole intent: the square of the nodes."""
    rows = [(0, f"s{i}", o) for i in range(30) for o in (f"s{i}", f"n{i % 3}")]
    made = L.Lattices(spark.createDataFrame(rows, "context int, object string, attribute string"))
    want = sorted(map(str, made.labelled().filter("size(b) < 33").collect()))
    assert sorted(map(str, made.labelled(bottom=False).collect())) == want
    monkeypatch.setattr(made, "intents", lambda: 1 / 0)
    assert made.triples().count() == 0


def test_minimal_taxonomy_is_of_all_classes(spark):
    """Before, customers and parts were left out."""
    from tesserae.plans import registry

    got = registry.queries()["minimal_taxonomy"](spark, "/root/testdata/sf0.001").select("s").distinct()
    kinds = {r[0] for r in got.selectExpr("split_part(s, ':', 1)").distinct().collect()}
    assert kinds == {"cust", "supp", "nation", "part", "name"}


def test_nodes_alike_in_a_minimal_taxonomy(spark, monkeypatch):
    """Two nodes stand in the lattice for all that lead to the same, and the rest get the same classes."""
    above = {"a": "a", "b": "b", "c": "c", "cc": "cc c", "alone": "alone", "m": "m x", "loose": "y x", "p": "p x"}
    above |= {f"ab{i}": f"ab{i} a b" for i in range(5)} | {f"bc{i}": f"bc{i} b cc c" for i in range(3)} | {f"free{i}": f"free{i}" for i in range(4)} | {f"abc{i}": f"abc{i} a b c" for i in range(2)}
    rows = [(s, o) for s, x in above.items() for o in x.split()]
    edges = spark.createDataFrame(rows + [("m", None), (None, "a")] + rows[:3], "s string, o string")
    sizes, make = [], L.Lattices

    def counted(incidence):
        sizes.append(incidence.select("object").distinct().count())
        return make(incidence)

    monkeypatch.setattr(L, "Lattices", counted)
    got = sorted(tuple(r) for r in L.minimal_taxonomy(edges).collect())
    steps = make(spark.createDataFrame([(0, s, o) for s, o in rows], "context int, object string, attribute string")).triples().collect()
    want = {(c, o) for r in steps for c in r["properties"] for o in r["subjects"]} | {(s, c) for r in steps for c in r["properties"] for s in r["objects"] if s != c}
    assert got == sorted(want)
    assert sizes[0] < len(above)
