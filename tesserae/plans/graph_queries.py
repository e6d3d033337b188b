"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators import assembly, entity, graph, lattice, qa, sets
from tesserae.plans.registry import query, table
from tesserae.plans.set_queries import SUB, TRIPLES, subclass
from tesserae.sources import triples as V

CLOSURE = "c(a, b) AS (SELECT s, o FROM {e} UNION SELECT c.a, e.o FROM c JOIN {e} e ON c.b = e.s)"
#: A graph with several components: suppliers, nations and regions, and names under their nouns.
SMALL = f"{SUB}, e AS (SELECT s, o FROM sub WHERE s LIKE 'supp:%' OR s LIKE 'nation:%' OR s LIKE 'name:%')"
NEXT = f"{TRIPLES}, e AS (SELECT s, o FROM triples WHERE p = 'my:next')"
SMALL_WCC = f"""{SMALL}, both_ways AS (SELECT s, o FROM e UNION SELECT o, s FROM e),
c(a, b) AS (SELECT s, s FROM both_ways UNION SELECT c.a, x.o FROM c JOIN both_ways x ON c.b = x.s),
comp AS (SELECT a AS node, min(b) AS component FROM c GROUP BY a)"""


def small(spark, sf):
    return subclass(spark, sf).filter("s like 'supp:%' or s like 'nation:%' or s like 'name:%'")


def next_edges(spark, sf):
    return V.from_tables(spark, sf).filter("p = 'my:next'")


def nodes_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@query(f"{SUB}, {CLOSURE.format(e='sub')} SELECT a, b FROM c")
def closure(spark, sf):
    return graph.closure(subclass(spark, sf))


@query(f"{SUB}, d(node, hops) AS (SELECT 'region:0', 0 UNION SELECT sub.s, d.hops + 1 FROM d JOIN sub ON sub.o = d.node) SELECT node, min(hops) AS hops FROM d GROUP BY node")
def subclass_descendants(spark, sf):
    return graph.reachable(subclass(spark, sf), nodes_of(spark, "region:0"), "in")


@query(f"{NEXT}, d(node, hops) AS (SELECT 'part:1', 0 UNION SELECT e.o, d.hops + 1 FROM d JOIN e ON e.s = d.node WHERE d.hops < 3) SELECT node, min(hops) AS hops FROM d GROUP BY node")
def k_hop(spark, sf):
    return graph.reachable(next_edges(spark, sf), nodes_of(spark, "part:1"), "out", depth=3)


@query(f"{SUB}, d(node) AS (SELECT s FROM sub WHERE s IN ('part:1', 'cust:1') UNION SELECT sub.o FROM d JOIN sub ON sub.s = d.node) SELECT node FROM d")
def ancestors(spark, sf):
    return graph.reachable(subclass(spark, sf), nodes_of(spark, "part:1", "cust:1"), "out").select("node")


@query(f"""{TRIPLES}, i AS (SELECT s, o FROM triples WHERE p <> '{V.SUBCLASS}' AND p NOT LIKE '%{{obj}}%'),
d(node) AS (SELECT 'part:1' UNION SELECT 'part:2' UNION SELECT i.o FROM d JOIN i ON i.s = d.node)
SELECT DISTINCT t.s, t.p, t.o FROM triples t JOIN d ON t.s = d.node""")
def sub_graph(spark, sf):
    return qa.sub_graph(V.from_tables(spark, sf), nodes_of(spark, "part:1", "part:2"))


CONCEPT_GRAPH = f"""{SUB}, d(node) AS (SELECT 'region:0' UNION SELECT sub.s FROM d JOIN sub ON sub.o = d.node),
cg AS (SELECT DISTINCT s, p, o FROM triples WHERE p LIKE '%{{obj}}%' AND (s IN (SELECT node FROM d) OR o IN (SELECT node FROM d)))"""


@query(f"{CONCEPT_GRAPH} SELECT s, p, o FROM cg")
def concept_graph(spark, sf):
    return qa.concept_graph(V.from_tables(spark, sf), "region:0", keep=V.is_relation())


@query(f"""{SMALL}, r AS (SELECT 'supp:' || s_suppkey AS node, s_suppkey AS ord FROM supplier UNION ALL SELECT DISTINCT 'name:' || p_name, 1000000000 + dense_rank() OVER (ORDER BY p_name) FROM part),
{CLOSURE.format(e='e')}, reach AS (SELECT node AS root, ord, node FROM r UNION ALL SELECT r.node, r.ord, c.b FROM r JOIN c ON c.a = r.node),
own AS (SELECT node, arg_min(root, ord) AS root FROM reach GROUP BY node)
SELECT own.root, e.s, '{V.SUBCLASS}' AS p, e.o FROM e JOIN own ON own.node = e.s""")
def rooted_edges(spark, sf):
    supp = table(spark, sf, "supplier").select(F.expr("'supp:' || s_suppkey").alias("node"), F.col("s_suppkey").cast("long").alias("ord"))
    names = table(spark, sf, "part").select(F.expr("'name:' || p_name").alias("node")).distinct()
    ordered = graph.ordered_ranks(names, [], [F.col("node")]).select("node", (F.col("ord") + 1000000000).cast("long").alias("ord"))
    return graph.rooted_edges(small(spark, sf), supp.unionByName(ordered))


@query(f"{SMALL_WCC} SELECT node, component FROM comp")
def wcc(spark, sf):
    return graph.weak_components(small(spark, sf))


@query(f"{SMALL_WCC}, n AS (SELECT component, count(*) AS n_edges FROM e JOIN comp ON comp.node = e.s GROUP BY component) SELECT component, n_edges FROM n")
def component_sizes(spark, sf):
    return graph.component_sizes(small(spark, sf))


@query(f"""{SMALL_WCC}, n AS (SELECT component, count(*) AS n FROM e JOIN comp ON comp.node = e.s GROUP BY component ORDER BY n DESC, component LIMIT 1)
SELECT e.s, '{V.SUBCLASS}' AS p, e.o FROM e JOIN comp ON comp.node = e.s JOIN n USING (component)""")
def biggest_component(spark, sf):
    return graph.biggest_component(small(spark, sf))


@query(f"""{TRIPLES}, e AS (SELECT s, o FROM triples WHERE p = 'my:next' UNION SELECT s, o FROM triples WHERE s LIKE 'name:%' AND p = '{V.SUBCLASS}'),
{CLOSURE.format(e='e')}, nodes AS (SELECT s AS n FROM e UNION SELECT o FROM e),
same AS (SELECT x.a, x.b FROM c x JOIN c y ON x.a = y.b AND x.b = y.a UNION SELECT n, n FROM nodes)
SELECT a AS node, max(b) AS component FROM same GROUP BY a""")
def scc(spark, sf):
    t = V.from_tables(spark, sf)
    return graph.strong_components(t.filter(f"p = 'my:next' or (p = '{V.SUBCLASS}' and s like 'name:%')"))


@query(f"""{TRIPLES}, t AS (SELECT s, p, o FROM triples WHERE p IN ('my:next', '{V.TYPE}', '{V.IN_SYNSET}')),
k AS (SELECT s AS node, o AS c FROM triples WHERE p = '{V.IN_SYNSET}' UNION SELECT o, o FROM triples WHERE p = '{V.IN_SYNSET}'),
peers AS (SELECT x.node, y.node AS peer FROM k x JOIN k y USING (c) WHERE x.node <> y.node)
SELECT s, p, o FROM t UNION SELECT peer, p, o FROM t JOIN peers ON t.s = peers.node UNION SELECT s, p, peer FROM t JOIN peers ON t.o = peers.node""")
def equivalence_edges(spark, sf):
    t = V.from_tables(spark, sf).filter(F.col("p").isin("my:next", V.TYPE, V.IN_SYNSET))
    return graph.equivalence_edges(t, [V.IN_SYNSET])


@query(f"""{SUB}, d(node) AS (SELECT 'region:1' UNION SELECT sub.s FROM d JOIN sub ON sub.o = d.node)
SELECT DISTINCT s, p, o FROM triples WHERE s <> '' AND o <> '' AND (
 (p IN ('{V.LABEL}', '{V.TYPE}', '{V.HAS_SOURCE}') AND s IN (SELECT node FROM d)) OR (p = '{V.SUBCLASS}' AND (s IN (SELECT node FROM d) OR o IN (SELECT node FROM d))))""")
def taxonomical_view(spark, sf):
    t = V.from_tables(spark, sf)
    wanted = graph.reachable(subclass(spark, sf), nodes_of(spark, "region:1"), "in").select("node")
    own = qa.out_edges(wanted, t.filter(F.col("p").isin(V.LABEL, V.TYPE, V.HAS_SOURCE)))
    tree = t.filter(F.col("p") == V.SUBCLASS)
    both = own.unionByName(qa.out_edges(wanted, tree)).unionByName(qa.in_edges(wanted, tree))
    return both.filter("s <> '' and p <> '' and o <> ''").distinct()


@query(f"""{SUB}, seeds AS (SELECT 'supp:' || s_suppkey AS n FROM supplier), {CLOSURE.format(e='sub')}
SELECT n AS a, n AS b FROM seeds UNION SELECT a, b FROM c JOIN seeds ON a = n""")
def path_star(spark, sf):
    seeds = table(spark, sf, "supplier").select(F.expr("'supp:' || s_suppkey").alias("a"))
    pairs = graph.closure(subclass(spark, sf).filter("s like 'supp:%' or s like 'nation:%'"))
    return pairs.join(seeds, "a", "left_semi").unionByName(seeds.select("a", F.col("a").alias("b"))).distinct()


@query(f"""{TRIPLES}, x AS (SELECT DISTINCT o AS node FROM triples WHERE p = '{V.TYPE}' UNION SELECT 'name:' || p_name FROM part),
y AS (SELECT node FROM x UNION SELECT o FROM triples JOIN x ON s = node WHERE p = '{V.SUBCLASS}')
SELECT node FROM y WHERE node NOT IN (SELECT s FROM triples WHERE p = '{V.SUBCLASS}')""")
def type_leaves(spark, sf):
    t = V.from_tables(spark, sf)
    tree = t.filter(F.col("p") == V.SUBCLASS)
    seeds = sets.slot_set(t.filter(F.col("p") == V.TYPE), "o").unionByName(table(spark, sf, "part").select(F.expr("'name:' || p_name").alias("node"))).distinct()
    classes = entity.zero_or_one(tree, seeds)
    return classes.join(tree.select(F.col("s").alias("node")).distinct(), "node", "left_anti")


@query(f"""{TRIPLES} SELECT DISTINCT a.s, a.p, b.o FROM triples a JOIN triples b ON a.o = b.s WHERE a.p = '{V.HAS_SOURCE}' AND b.p = '{V.DOC_ID}'
UNION SELECT s, p, o FROM triples WHERE p = '{V.TYPE}'""")
def deanonymise(spark, sf):
    t = V.from_tables(spark, sf).filter(F.col("p").isin(V.HAS_SOURCE, V.DOC_ID, V.TYPE))
    return graph.deanonymise(t, F.col("node").startswith("_:"))


@query(f"{SMALL} SELECT DISTINCT s, o FROM e")
def transitive_reduction(spark, sf):
    edges = small(spark, sf)
    return graph.transitive_reduction(graph.closure(edges).select(F.col("a").alias("s"), F.col("b").alias("o")))


# fixed values: noun patterns and the classes that they suggest
PATTERNS = [("(an|ic)", "my:PatternA"), ("e", "my:PatternB"), ("^name:[a-d]", "my:PatternC"), ("t$", "my:PatternD")]
PATTERN_SQL = "pat(pattern, cls) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PATTERNS) + ")"
DIRECT = f"{SUB}, {PATTERN_SQL}, nodes AS (SELECT s AS node FROM sub WHERE s LIKE 'name:%' UNION SELECT o FROM sub WHERE o LIKE 'noun:%'), d AS (SELECT DISTINCT node, cls FROM nodes JOIN pat ON regexp_matches(node, pattern))"


def _typed(spark, sf):
    tree = subclass(spark, sf).filter("s like 'name:%'")
    patterns = spark.createDataFrame(PATTERNS, "pattern string, cls string")
    nodes = sets.concept_set(tree)
    return tree, nodes.join(F.broadcast(patterns), F.expr("node rlike pattern")).select("node", "cls").distinct()


@query(f"{DIRECT} SELECT node, cls FROM d")
def regex_type_join(spark, sf):
    return _typed(spark, sf)[1]


@query(f"{DIRECT} SELECT node, cls FROM d WHERE NOT EXISTS (SELECT 1 FROM sub JOIN d u ON u.node = sub.o WHERE sub.s = d.node AND u.cls = d.cls)")
def pattern_typing(spark, sf):
    """Types by pattern, left out where an ancestor already gives them."""
    tree, direct = _typed(spark, sf)
    above = graph.closure(tree).join(direct, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "cls").distinct()
    return direct.join(above, ["node", "cls"], "left_anti")


@query(f"""{SUB}, e AS (SELECT DISTINCT s, o FROM (SELECT s, o FROM sub WHERE s LIKE 'nation:%' OR s LIKE 'name:%' UNION ALL SELECT s, o FROM triples WHERE p = 'my:next') WHERE s <> o), n AS (SELECT s AS node FROM e UNION SELECT o FROM e),
f(src, node, hops, path) AS (SELECT s, o, 1, [s, o] FROM e UNION ALL SELECT src, e.o, hops + 1, list_append(path, e.o) FROM f JOIN e ON e.s = f.node WHERE NOT list_contains(path, e.o)),
b AS (SELECT *, min(hops) OVER (PARTITION BY src, node) AS least FROM f), g AS (SELECT *, count(*) OVER (PARTITION BY src, node) AS sigma FROM b WHERE hops = least),
t AS (SELECT node, sum(d) AS raw FROM (SELECT unnest(path[2:len(path) - 1]) AS node, 1.0 / sigma AS d FROM g) GROUP BY node), c AS (SELECT count(*) AS n FROM n)
SELECT node, round(coalesce(raw, 0.0), 6) AS raw, round(coalesce(raw, 0.0) / ((n - 1) * (n - 2)), 9) AS normalised FROM n LEFT JOIN t USING (node), c""")
def betweenness(spark, sf):
    found = graph.betweenness(small(spark, sf).filter("s not like 'supp:%'").unionByName(next_edges(spark, sf)))
    return found.select("node", F.round("raw", 6).alias("raw"), F.round("normalised", 9).alias("normalised"))


def _name_words(spark, sf):
    """A context of names and their words."""
    return table(spark, sf, "part").select(F.col("p_name").alias("object"), F.explode(F.split("p_name", " ")).alias("attribute")).distinct()


_CONTEXT = """w AS (SELECT DISTINCT p_name AS object, unnest(string_split(p_name, ' ')) AS attribute FROM part), o AS (SELECT object, list_sort(list(DISTINCT attribute)) AS own FROM w GROUP BY object), b AS (SELECT DISTINCT own FROM o),
i(intent) AS (SELECT own FROM b UNION SELECT list_sort(list(DISTINCT attribute)) FROM w UNION SELECT list_sort(list_intersect(i.intent, b.own)) FROM i, b)"""


@query(f"WITH RECURSIVE {_CONTEXT} SELECT array_to_string(intent, '|') AS intent, coalesce(string_agg(object, '|' ORDER BY object), '') AS extent FROM i LEFT JOIN o ON list_has_all(own, intent) GROUP BY intent")
def fca_concepts(spark, sf):
    concepts = lattice.formal_concepts(_name_words(spark, sf))
    return concepts.select(F.array_join("intent", "|").alias("intent"), F.array_join("extent", "|").alias("extent"))


@query(f"""WITH RECURSIVE {_CONTEXT}, l AS (SELECT u.intent AS upper, d.intent AS lower FROM i u, i d WHERE len(u.intent) < len(d.intent) AND list_has_all(d.intent, u.intent))
SELECT array_to_string(upper, '|') AS upper, array_to_string(lower, '|') AS lower FROM l WHERE NOT EXISTS (SELECT 1 FROM l x JOIN l y ON x.lower = y.upper WHERE x.upper = l.upper AND y.lower = l.lower)""")
def lattice_edges(spark, sf):
    edges = lattice.Lattices(_name_words(spark, sf).withColumn("context", F.lit(0))).edges()
    return edges.select(F.array_join("upper", "|").alias("upper"), F.array_join("lower", "|").alias("lower"))


#: What nations do above the average: customers' accounts by segment, orders by priority.
_DEEDS = """a AS (SELECT n_name AS s, c_mktsegment AS o, avg(c_acctbal) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
b AS (SELECT n_name AS s, o_orderpriority AS o, count(*) AS x FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
e AS (SELECT s, 'hold' AS p, o FROM a QUALIFY x > avg(x) OVER (PARTITION BY o) UNION ALL SELECT s, 'send', o FROM b QUALIFY x > avg(x) OVER (PARTITION BY o)),
w AS (SELECT p AS c, s AS object, 'that can ' || p || ' ' || o || ' is' AS attribute FROM e UNION SELECT p, o, 'that can be ' || p || '-ed by ' || s || ' is' FROM e),
o AS (SELECT c, object, list_sort(list(DISTINCT attribute)) AS own FROM w GROUP BY ALL), m AS (SELECT c, list_sort(list(DISTINCT attribute)) AS own FROM w GROUP BY c),
i(c, intent) AS (SELECT c, own FROM (SELECT c, own FROM o UNION SELECT c, own FROM m) UNION SELECT i.c, list_sort(list_intersect(i.intent, o.own)) FROM i JOIN o ON o.c = i.c)"""


def deeds(spark, sf):
    nations = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    accounts = nations.groupBy(F.col("n_name").alias("s"), F.lit("hold").alias("p"), F.col("c_mktsegment").alias("o")).agg(F.avg("c_acctbal").alias("x"))
    sent = table(spark, sf, "orders").join(nations, F.col("o_custkey") == F.col("c_custkey"))
    sent = sent.groupBy(F.col("n_name").alias("s"), F.lit("send").alias("p"), F.col("o_orderpriority").alias("o")).agg(F.count("*").cast("double").alias("x"))
    mean = F.avg("x").over(Window.partitionBy("p", "o"))
    return accounts.unionByName(sent).withColumn("mean", mean).filter("x > mean").select("s", "p", "o")


def _deed_lattices(spark, sf):
    return lattice.Lattices(assembly.typing_context(deeds(spark, sf), "both", action=True).withColumnRenamed("predicate", "context"))


@query(f"WITH RECURSIVE {_DEEDS} SELECT i.c AS predicate, array_to_string(intent, '|') AS intent, coalesce(string_agg(object, '|' ORDER BY object), '') AS extent FROM i LEFT JOIN o ON o.c = i.c AND list_has_all(own, intent) GROUP BY i.c, intent")
def action_concepts(spark, sf):
    """The concepts of each predicate's lattice of what nodes do and suffer."""
    found = _deed_lattices(spark, sf).concepts()
    return found.select(F.col("context").alias("predicate"), F.array_join("intent", "|").alias("intent"), F.array_join("extent", "|").alias("extent"))


@query(f"""WITH RECURSIVE {_DEEDS}, l AS MATERIALIZED (SELECT u.c, u.intent AS upper, d.intent AS lower FROM i u JOIN i d ON u.c = d.c WHERE len(u.intent) < len(d.intent) AND list_has_all(d.intent, u.intent)),
cov AS MATERIALIZED (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l x JOIN l y ON x.c = y.c AND x.lower = y.upper WHERE x.c = l.c AND x.upper = l.upper AND y.lower = l.lower)),
ob AS MATERIALIZED (SELECT c, own AS intent, string_agg(object, '|' ORDER BY object) AS objects FROM o GROUP BY ALL),
ga AS (SELECT c, attribute, arg_min(intent, len(intent)) AS intent FROM (SELECT c, intent, unnest(intent) AS attribute FROM i) GROUP BY ALL),
pr AS MATERIALIZED (SELECT c, intent, string_agg(attribute, '|' ORDER BY attribute) AS properties FROM ga GROUP BY ALL),
st(c, subjects, properties, node) AS (SELECT cov.c, ob.objects, coalesce(pr.properties, ''), cov.lower FROM ob JOIN cov ON cov.c = ob.c AND cov.upper = ob.intent LEFT JOIN pr ON pr.c = cov.c AND pr.intent = cov.lower
  UNION SELECT st.c, st.subjects, st.properties, cov.lower FROM st JOIN cov ON cov.c = st.c AND cov.upper = st.node LEFT JOIN ob ON ob.c = st.c AND ob.intent = st.node WHERE ob.objects IS NULL)
SELECT DISTINCT st.c AS predicate, subjects, properties, ob.objects AS objects FROM st JOIN ob ON ob.c = st.c AND ob.intent = st.node""")
def action_lattices(spark, sf):
    """Triples of each predicate's lattice, past the concepts that have no objects of their own."""
    found = _deed_lattices(spark, sf).triples()
    return found.select(F.col("context").alias("predicate"), *[F.array_join(c, "|").alias(c) for c in ("subjects", "properties", "objects")])


@query(f"{SUB} SELECT DISTINCT s, o FROM sub UNION SELECT 'name:' || p_name, 'adjective:' || split_part(p_name, ' ', 1) FROM part")
def minimal_taxonomy(spark, sf):
    """The direct classes again, from all that each node is below; names are below a noun and an adjective."""
    direct = subclass(spark, sf)
    looks = table(spark, sf, "part").select(F.expr("'name:' || p_name").alias("s"), F.expr("'adjective:' || substring_index(p_name, ' ', 1)").alias("o")).distinct()
    edges = direct.select("s", "o").unionByName(looks)
    above = graph.closure(edges).select(F.col("a").alias("s"), F.col("b").alias("o"))
    own = edges.select(F.explode(F.array("s", "o")).alias("s")).distinct().withColumn("o", F.col("s"))
    return lattice.minimal_taxonomy(above.unionByName(own))


@query(f"""{TRIPLES}, e AS (SELECT s, o FROM triples WHERE p = 'my:next' UNION SELECT s, o FROM triples WHERE s LIKE 'name:%' AND p = '{V.SUBCLASS}'),
{CLOSURE.format(e='e')}, same AS (SELECT x.a, max(x.b) AS m FROM c x JOIN c y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)
SELECT DISTINCT s AS node FROM e WHERE s NOT IN (SELECT o FROM e) UNION SELECT greatest(a, m) FROM same""")
def entry_points(spark, sf):
    t = V.from_tables(spark, sf)
    return graph.entry_points(t.filter(f"p = 'my:next' or (p = '{V.SUBCLASS}' and s like 'name:%')"))


@query(f"""{NEXT}, t(root, nodes, node, depth) AS (SELECT 'part:' || k, ['part:' || k], 'part:' || k, 0 FROM range(1, 6) r(k)
UNION ALL SELECT root, list_append(nodes, e.o), e.o, depth + 1 FROM t JOIN e ON e.s = t.node WHERE depth < 3 AND NOT list_contains(nodes, e.o))
SELECT root, array_to_string(nodes, '/') AS path, node, depth FROM t""")
def nested_paths(spark, sf):
    return graph.nested_paths(next_edges(spark, sf), nodes_of(spark, *[f"part:{k}" for k in range(1, 6)]), 3)


@query()
def dendrogram(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return graph.dendrogram(v).withColumn("distance", F.round("distance", 6))
