import json
import random

from pyspark.sql import functions as F

from tesserae.sources import jsonld


def plain(x):
    return x if isinstance(x, str) else json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def shred(doc, key):
    """Depth first, keys in order; arrays stand for their elements."""
    out, fresh = [], iter(range(10**6))

    def flat(x):
        return [z for y in x for z in flat(y)] if isinstance(x, list) else [x]

    def name(x):
        if isinstance(x, dict):
            if x.get("@value", None) is not None or "@value" in x:
                return plain(x["@value"])
            return plain(x["@id"]) if "@id" in x else f"_:{key}_{next(fresh)}"
        return plain(x)

    def visit(own, node):
        for p in sorted(k for k in node if k != "@id"):
            for x in flat(node[p]):
                o = name(x)
                out.append((own, p, o))
                if isinstance(x, dict) and "@value" not in x:
                    visit(o, x)

    for top in doc if isinstance(doc, list) else [doc]:
        if isinstance(top, dict):
            visit(f"_:{key}_{next(fresh)}" if "@value" in top else name(top), top)  # at the top it's an object like others
    return out


def make(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(["text", "my:thing", 3, True, "é", "", {"@value": "v", "@language": "en"}, {"@id": "x:1"}])
    if rng.random() < 0.35:
        return [make(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: make(rng, depth - 1) for k in rng.sample(["@id_", "b", "a", "c d", "rdfs:label", "Z"], rng.randrange(4))} | ({"@id": f"n:{rng.randrange(9)}"} if rng.random() < 0.4 else {})


def documents():
    rng = random.Random(5)
    return [(i, make(rng, 4)) for i in range(60)] + [(70, [{"a": 1}, "x", {"b": [[1, [2]], []]}]), (71, {}), (72, 5), (73, [])]


def test_triples_against_brute_force(spark):
    docs = documents()
    rows = [(i, json.dumps(d), "clash") for i, d in docs] + [(80, None, ""), (81, "{broken", ""), (82, "", "")]
    df = spark.createDataFrame(rows, "k long, d string, path string").repartition(5)
    got: dict = {}
    for r in jsonld.jsonld_triples(df, "k", "d").orderBy("ord").collect():
        got.setdefault(r["k"], []).append((r["s"], r["p"], r["o"]))
    assert got == {i: x for i, d in docs if (x := shred(d, i))}
    orders = {tuple(sorted(r["o"])) == tuple(range(len(r["o"]))) for r in jsonld.jsonld_triples(df, "k", "d").groupBy("k").agg(F.collect_list("ord").alias("o")).collect()}
    assert orders == {True}


def test_texts(spark):
    doc = {"@id": "d", "a": ["one", "http://x/y", "my:z"], "rdfs:label": "name", "b": {"@value": "two", "@language": "en"}}
    shredded = jsonld.jsonld_triples(spark.createDataFrame([(1, json.dumps(doc))], "k long, d string"), "k", "d")
    assert [(r["id"], r["text"]) for r in jsonld.literal_texts(shredded, "k").orderBy("ord").collect()] == [("1", "one"), ("1", "two")]


def test_repeated_and_missing_keys(spark):
    doc = json.dumps({"a": {"b": 1}})
    rows = [(1, doc), (1, doc), (None, doc)]
    got = sorted((str(r["k"]), r["s"], r["p"], r["o"]) for r in jsonld.jsonld_triples(spark.createDataFrame(rows, "k long, d string"), "k", "d").collect())
    one = [("1", "_:1_0", "a", "_:1_1"), ("1", "_:1_1", "b", "1")]
    assert got == sorted(one * 2 + [("None", "_:_0", "a", "_:_1"), ("None", "_:_1", "b", "1")])
    assert jsonld.jsonld_triples(spark.createDataFrame([], "k long, d string"), "k", "d").count() == 0


def test_values(spark):
    def values(x, key):
        if isinstance(x, dict) and key in x:
            return [plain(x[key])]
        inside = [x[k] for k in sorted(x)] if isinstance(x, dict) else x if isinstance(x, list) else []
        return [v for y in inside for v in values(y, key)]

    docs = documents()
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs] + [(90, None), (91, "{")], "k long, d string")
    got: dict = {}
    for r in jsonld.json_values(df, "k", "d", "a").orderBy("ord").collect():
        got.setdefault(r["k"], []).append(r["value"])
    assert got == {i: v for i, d in docs if (v := values(d, "a"))}
