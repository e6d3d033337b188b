from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.operators import qa


def values(spark, column, rows):
    df = spark.createDataFrame([(r,) for r in rows], "x " + ("array<string>" if isinstance(rows[0], list) else "double" if isinstance(rows[0], float) else "string"))
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_formats(spark):
    assert values(spark, X.titlefy, ["law", "éa", "", None]) == ["Law", "Éa", "", None]
    assert values(spark, X.format_percentage, [0.5, 0.125, 0.12345, 0.15625]) == ["50%", "12.50%", "12.35%", "15.63%"]
    assert values(spark, X.is_int, ["12", "-3", "1.0", "1.5", "x", "", None]) == [True, True, True, False, False, False, None]
    assert values(spark, X.path_join, [["a/", "/b/", "", "c/"], ["", "x"], [""]]) == ["a/b/c/", "x", ""]
    assert values(spark, lambda x: X.clip(x, 1.0, 2.0), [0.5, 1.5, 9.0]) == [1.0, 1.5, 2.0]
    odd = "a.b*c+d?e^f$g{h}i(j)k|l[m]n\\o"
    import re

    pattern = values(spark, X.escape_regexp, [odd])[0]
    assert re.fullmatch(pattern, odd) and not re.fullmatch(pattern, odd.replace(".", "x"))


def test_labelled_clusters(spark):
    rows = [("a", "p", "x", "A", "P", "contract"), ("a", "p", "y", "A", "P", "contracts"), ("a", "p", "z", "A", "P", "law"), ("a", "p", "z", "A", "P", "zoo"), ("a", "p", "w", "A2", "P", "one"), ("b", "p", "z", "B", "P", "law")]
    df = spark.createDataFrame(rows, "s string, p string, o string, label_s string, label_p string, label_o string")
    got = {(r["side"], r["key"], r["label_key"]): (r["members"], r["labels"]) for r in qa.labelled_clusters(df).collect()}
    assert got == {("o", "a", "A"): (["x", "z"], ["contract", "law"]), ("s", "z", "law"): (["a", "b"], ["A", "B"])}


def test_taxonomy_page(spark):
    t = [("a", "rdfs:subClassOf", "b"), ("b", "rdfs:subClassOf", "c"), ("d", "rdfs:subClassOf", "c"), ("x", "rdfs:subClassOf", "y"), ("a", "rdfs:label", "A"), ("x", "rdfs:label", "X"), ("d", "rdfs:label", "D"), ("b", "my:hasSource", "_:1"), ("_:1", "my:content", "text"), ("_:1", "my:docID", "doc"),
         ("b", "dbo:abstract", "own"), ("a", "dbo:abstract", "other"), ("b", "rdf:type", "T"), ("T", "rdfs:label", "type"), ("i", "rdf:type", "b"), ("b", "rdfs:label", "")]
    df = spark.createDataFrame(t, "s string, p string, o string")
    definitions = spark.createDataFrame([("c", "see"), ("x", "no")], "node string, definition string")
    got = {tuple(r) for r in qa.taxonomy_page(df, "b", definitions).collect()}
    out = {("x", "rdfs:subClassOf", "y"), ("x", "rdfs:label", "X"), ("a", "dbo:abstract", "other"), ("b", "rdfs:label", "")}
    assert got == {x for x in t if x not in out} | {("c", "dbo:abstract", "see")}


def test_definitions_of_equivalents(spark):
    df = spark.createDataFrame([("a", "my:inSynset", "wn:1"), ("b", "my:inSynset", "wn:1"), ("c", "my:inSynset", "wn:2")], "s string, p string, o string")
    definitions = spark.createDataFrame([("wn:1", "one"), ("wn:2", "two")], "node string, definition string")
    assert [tuple(r) for r in qa.equivalent_definitions(df, "a", definitions).collect()] == [("a", "dbo:abstract", "one")]


def test_joins_with_few_nodes_leave_other_triples_where_they_lie(spark):
    from tesserae.sources.scratch import touching

    df = spark.createDataFrame([(f"n{i}", "p", f"n{i + 1}") for i in range(50)], "s string, p string, o string")
    nodes = spark.createDataFrame([("n3",), ("n4",), ("none",), ("n3",)], "node string")
    assert {r["s"] for r in touching(df, "s", nodes).collect()} == {"n3", "n4"}
    assert touching(df, "s", nodes, rows=2).count() == 50
    assert "left_semi" in touching(df, "s", nodes)._jdf.queryExecution().analyzed().toString().lower().replace("leftsemi", "left_semi")
    assert "leftsemi" in qa.out_edges(nodes.distinct(), df)._jdf.queryExecution().analyzed().toString().lower()
    # ways longer than those that are looked up one by one
    end = qa.sub_graph(df, spark.createDataFrame([("n40",)], "node string")).collect()
    assert {r["s"] for r in end} == {f"n{i}" for i in range(40, 50)}


def test_texts_of_answers_have_numbers(spark, tmp_path):
    rows = [("a", "{subj} places {obj}", "b", "law", "{subj} places {obj}", "court"), ("c", "{subj} places {obj}", "b", "law", "{subj} places {obj}", "court")]
    triples = spark.createDataFrame(rows, "s string, p string, o string, label_s string, label_p string, label_o string")
    index = qa.register_answers(f"file://{tmp_path}/i", qa.texts_of(triples.unionByName(triples)))
    assert index.corpus.texts.schema["key"].dataType.simpleString() == "bigint" and index.corpus.texts.count() == 3
    assert index.facts.count() == 6


def test_concepts_have_counts_documents_and_sources(spark):
    """Before, concepts were counted without their sources."""
    from tesserae.operators import entity
    from tesserae.plans import registry

    rows = [(1, "x", "a b a"), (1, "y", "a"), (1, "y", "a"), (2, "x", "b"), (None, "z", "b"), (3, None, "c"), (4, "x", None)]
    got = {r["concept"]: (r["n"], r["n_docs"], r["sources"]) for r in entity.concept_profile(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == {"a": (4, 1, ["x", "y"]), "b": (3, 2, ["x", "z"]), "c": (1, 1, [])}
    assert "sources" in registry.queries()["concept_counts"](spark, "/root/testdata/sf0.001").columns
