import json

from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.sources import jsonld, markup
from tesserae.sources import triples as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_html_lists_come_under_their_paragraph():
    page = "<p>Rules:</p><ul><li>one</li><li>two &amp; three</li></ul><p>Rules:</p><script>no</script><p>End</p>"
    assert markup.paragraphs(page) == ["Rules: one", "Rules: two & three", "Rules:", "End"]


def test_html_of_nothing(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "plain")], "page_id long, html string")
    assert markup.html_paragraphs(pages).count() == 0


def test_legal_paragraphs(spark):
    xml = '<article eid="a1"><num>1</num><heading>Scope</heading><list><intro><p>It covers</p></intro><paragraph eid="p1"><num>(a)</num><p>law</p></paragraph></list></article>'
    rows = markup.legal_paragraphs(spark.createDataFrame([(1, xml)], "k long, xml string"), "k").collect()
    assert [(r["pos"], r["text"], json.loads(r["annotation"])) for r in rows] == [(1, "It covers law", {"my:paragraph_id": {"@id": "1:p1", "rdfs:label": "(a)"}, "my:article_id": {"@id": "1:a1", "rdfs:label": "1"}, "my:reference_id": []})]


def test_legal_annotations(spark):
    item = '<blockList><listIntroduction>Means:</listIntroduction><item eId="i1"><num>i</num><p>one <ref href="#x">Art. 9</ref> and <b><ref href="#y">inner</ref></b></p></item></blockList>'
    xml = f'<akomaNtoso><chapter eId="c1"><heading>Rules</heading><section eId="s1"><num>1</num><heading>Scope</heading>{item}<p>last</p></section></chapter></akomaNtoso>'
    rows = markup.legal_paragraphs(spark.createDataFrame([("d", xml), ("e", None)], "k string, xml string"), "k", base=F.lit("act"))
    assert [(r["k"], r["pos"], r["text"]) for r in rows.collect()] == [("d", 0, "Means: one Art. 9 and inner"), ("d", 1, "last")]
    got = {(r["s"], r["p"], r["o"]) for r in markup.legal_annotations(rows, "k").collect()}
    chapter, section = ("act:c1", "my:heading", "Rules"), {("act:s1", "rdfs:label", "1"), ("act:s1", "my:heading", "Scope")}
    first = {("_:d_0_0", "my:block_id", "act:i1"), ("act:i1", "rdfs:label", "i"), ("_:d_0_0", "my:reference_id", "act:#x"), ("act:#x", "rdfs:label", "Art. 9"), ("_:d_0_0", "my:section_id", "act:s1"), ("_:d_0_0", "my:chapter_id", "act:c1")}
    assert got == first | {chapter} | section | {("_:d_1_0", "my:section_id", "act:s1"), ("_:d_1_0", "my:chapter_id", "act:c1")}


def test_jsonld_is_shredded_once(spark):
    doc = json.dumps({"@id": "x", "p": [{"q": 1}, {"q": {"@value": "v"}}], "r": ["a", "b"]})
    rows = jsonld.jsonld_triples(spark.createDataFrame([(1, doc)], "k long, d string"), "k", "d").orderBy("ord").collect()
    assert [(r["s"], r["p"], r["o"]) for r in rows] == [("x", "p", "_:1_0"), ("_:1_0", "q", "1"), ("x", "p", "_:1_1"), ("_:1_1", "q", "v"), ("x", "r", "a"), ("x", "r", "b")]


def test_normalise(spark):
    assert one(spark, X.join_lines(F.lit("A con-\ntract is\nsigned.\n\nNext - part"))) == "A contract is signed.\n\nNext part"
    assert one(spark, X.normalise(F.lit("ﬁne\r\nword"))) == "fine word"


def test_readable_key(spark):
    assert one(spark, X.readable_key(F.lit("my:someName_ofThing"))) == "Some Name of Thing"
    assert one(spark, X.readable_key(F.lit("x:EULaw"))) == "EU Law" or one(spark, X.readable_key(F.lit("x:EULaw"))) == "EULaw"
    assert one(spark, X.readable_key(F.lit(""))) == ""


def test_sentences(spark):
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, X.sentence(lit("law"), F.lit(V.SUBCLASS), lit("rule"))) == "law is rule"
    assert one(spark, X.sentence(lit("law", "the law"), F.lit("{subj} (be) made by {obj}"), lit("us"))) == "the law is made by us"
    assert one(spark, X.sentence(lit("my:hidden"), F.lit(V.TYPE), lit("rule"))) == ""
    assert one(spark, X.sentence(lit("a"), F.lit(V.LABEL), lit("b", "cc"))) == "«a» is called «b» (or: «cc»)"


def test_graphml_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([("a", "r", "b<"), ("c", "q", "d")], "s string, p string, o string")
    V.graphml_lines(edges).coalesce(1).write.text(str(tmp_path / "g"))
    back = V.read_graphml(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in back.collect()} == {("a", "r", "b<"), ("c", "q", "d")}


def test_subclass_tables(spark, tmp_path):
    (tmp_path / "Thing.csv").write_text("SubClasses;x\nPart;1\n;2\n")
    got = {tuple(r) for r in markup.subclass_tables(spark, str(tmp_path)).collect()}
    assert got == {("Thing", "Thing"), ("Part", "Part")}


def test_k_shortest_paths(spark):
    from tesserae.operators.summary import k_shortest_paths

    lines = [(1, "courts apply the law daily"), (2, "courts apply the old law"), (3, "judges apply the law daily")]
    tags = {"courts": "NNS", "judges": "NNS", "apply": "VBP", "the": "DT", "old": "JJ", "law": "NN", "daily": "RB"}
    rows = [(7, s, i, w, tags[w]) for s, line in lines for i, w in enumerate(line.split())]
    got = k_shortest_paths(spark.createDataFrame(rows, "cluster long, sent int, pos int, word string, tag string"), k=3, min_words=4).orderBy("rank").collect()
    assert len(got) == 3
    assert [r["cost"] for r in got] == sorted(r["cost"] for r in got)
    assert got[0]["words"].split()[1:4] == ["apply", "the", "law"]


def test_path_search_ends_only_when_no_path_is_left(spark):
    from tesserae.operators.summary import k_shortest_paths

    plain = [[f"{'ab'[choice(i)]}{i}" for i in range(17)] for choice in (lambda i: 0, lambda i: 1, lambda i: i % 2, lambda i: 1 - i % 2)]
    verbal = [f"v{i}" for i in range(40)]  # dearer than all of the 131,072 paths without a verb
    rows = [(1, s, p, w, "VB" if w == "v3" else "NN") for s, line in enumerate([*plain, verbal]) for p, w in enumerate(line)]
    got = k_shortest_paths(spark.createDataFrame(rows, "cluster long, sent int, pos int, word string, tag string"), k=3).collect()
    assert [r["words"] for r in got] == [" ".join(verbal)]


def test_deep_nesting_and_broken_json(spark):
    from tesserae.sources import markup

    deep = "<div>" * 3000 + "<p>inside</p>" + "</div>" * 3000
    assert markup.paragraphs(deep) == ["inside"]
    nested = {"@id": "top"}
    for i in range(12):
        nested = {"@id": f"n{i}", "in": nested}
    import json

    rows = [(1, json.dumps(nested)), (2, None), (3, "{broken"), (4, "[" * 100_000)]
    got = jsonld.jsonld_triples(spark.createDataFrame(rows, "k long, doc string"), "k", "doc").collect()
    assert {r["k"] for r in got} == {1} and len(got) == 12
    legal = "<section eId='s'>" + "<block>" * 2000 + "<p>text</p>" + "</block>" * 2000 + "</section>"
    assert markup.legal_paragraphs(spark.createDataFrame([(1, legal)], "k long, xml string"), "k").first()["text"] == "text"


def test_graphml_document(spark, tmp_path):
    import xml.etree.ElementTree as ET

    rows = [("a & b", "<p>", "c"), ("c", 'say "x"', "é"), ("é", "p", "a & b")]
    V.write_graphml(spark.createDataFrame(rows, "s string, p string, o string"), f"file://{tmp_path}/g")
    text = "".join(f.read_text() for f in sorted((tmp_path / "g").glob("part-*")))
    graph = ET.fromstring(text.encode())[1]
    name = "{http://graphml.graphdrawing.org/xmlns}"
    assert {x.get("id") for x in graph.findall(f"{name}node")} == {"a & b", "c", "é"}
    assert {(x.get("source"), x[0].text, x.get("target")) for x in graph.findall(f"{name}edge")} == set(rows)
    (tmp_path / "whole.graphml").write_text(text)
    assert {tuple(r) for r in V.read_graphml(spark, f"file://{tmp_path}/whole.graphml").collect()} == set(rows)


def test_plain_sentences(spark):
    """A sentence of two strings is that of arrays of one, and its expression doesn't repeat its parts at each step."""
    ends = [None, "", "my:x", "wn:dog.n.01", "..a..", ".", "law , b", "( x )", "a : b", "x / y"]
    predicates = [V.LABEL, V.TYPE, "{subj} (be) with {obj}", "my:next", None]
    df = spark.createDataFrame([(a, p, b) for a in ends for p in predicates for b in ends], "a string, p string, b string")
    a, p, b = F.col("a"), F.col("p"), F.col("b")
    both = df.select(X.sentence(F.array(a), p, F.array(b)).alias("x"), X.plain_sentence(a, p, b).alias("y"))
    assert both.filter("not (x <=> y)").count() == 0
    assert len(df.select(X.sentence(F.array(a), p, F.array(b)))._jdf.queryExecution().analyzed().toString()) < 100_000


def test_each_triple_has_a_sentence(spark):
    """Before, triples of five predicates alone were told."""
    from tesserae.plans import registry

    sf = "/root/testdata/sf0.001"
    told = registry.queries()["triple_to_text"](spark, sf)
    t = V.from_tables(spark, sf)
    assert told.count() == t.distinct().count()
    assert told.select("p").distinct().count() == t.select("p").distinct().count()


def test_distinct_triples(spark):
    rows = [("a", "p", "x"), ("a", "p", "x"), ("a", None, "x"), (None, "p", None), (None, "p", None)]
    texts = [("d1", V.CONTENT, "one"), ("d2", V.CONTENT, "two"), ("d2", V.CONTENT, "two"), ("d2", V.CONTENT, "other"), ("d3", V.CONTENT, None), (None, V.CONTENT, "x"), (None, V.CONTENT, "x")]
    df = spark.createDataFrame(rows + texts, "s string, p string, o string")
    assert sorted(map(str, V.distinct_triples(df).collect())) == sorted(map(str, df.distinct().collect()))
