"""Queries of what clients are shown: taxonomy pages, clusters of labelled couples, triples with sources, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.operators import entity, qa
from tesserae.plans.registry import query, table
from tesserae.plans.set_queries import SUB, TRIPLES
from tesserae.sources import triples as V


@query("""SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS title, replace(printf('%.2f', floor(p_size / CAST(64 AS DOUBLE) * 10000 + 0.5) / 100), '.00', '') || '%' AS percentage,
regexp_replace(p_name || ' (' || p_brand || ')', '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g') AS pattern, 'a/' || p_brand || '/' || p_type AS path, regexp_matches(trim(CAST(p_retailprice AS VARCHAR)), '^[+-]?[0-9]+(\\.0*)?$') AS whole,
CASE WHEN p_size < 10 THEN 10.0 WHEN p_size > 40 THEN 40.0 ELSE CAST(p_size AS DOUBLE) END AS clipped FROM part""")
def formatters(spark, sf):
    """Names as titles, sizes in per cent, patterns, paths, whole numbers, values in bounds."""
    part = table(spark, sf, "part")
    return part.select(
        "p_partkey",
        X.titlefy(F.col("p_name")).alias("title"),
        X.format_percentage(F.col("p_size") / F.lit(64.0)).alias("percentage"),
        X.escape_regexp(F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))).alias("pattern"),
        X.path_join(F.array(F.lit("a/"), F.concat(F.lit("/"), F.col("p_brand"), F.lit("/")), F.lit(""), F.concat(F.lit("/"), F.col("p_type")))).alias("path"),
        X.is_int(F.col("p_retailprice").cast("string")).alias("whole"),
        X.clip(F.col("p_size").cast("double"), 10.0, 40.0).alias("clipped"),
    )


@query(f"""{TRIPLES}, t AS (SELECT DISTINCT s, p, o FROM triples WHERE p IN ('{V.SUBCLASS}', '{V.TYPE}') AND (s LIKE 'nation:%' OR s LIKE 'supp:%')), lab AS (SELECT s AS node, o AS label FROM triples WHERE p = '{V.LABEL}'),
l AS (SELECT s, p, o, coalesce(a.label, s) AS ls, coalesce(b.label, o) AS lo FROM t LEFT JOIN lab a ON a.node = s LEFT JOIN lab b ON b.node = o),
r AS (SELECT 'o' AS side, s AS key, p, ls AS label_key, o AS member, lo AS label FROM l UNION ALL SELECT 's', o, p, lo, s, ls FROM l),
g AS (SELECT *, row_number() OVER w AS ord, count(*) OVER (PARTITION BY side, key, p, label_key) AS n FROM (SELECT side, key, p, label_key, member, min(label) AS label FROM r GROUP BY ALL) WINDOW w AS (PARTITION BY side, key, p, label_key ORDER BY label, member)),
k(side, key, p, label_key, ord, member, label, kept) AS (SELECT side, key, p, label_key, ord, member, label, [label] FROM g WHERE ord = 1 AND n > 1 UNION ALL
 SELECT g.side, g.key, g.p, g.label_key, g.ord, g.member, CASE WHEN alike THEN NULL ELSE g.label END, CASE WHEN alike THEN kept ELSE list_append(kept, g.label) END
 FROM (SELECT g.*, k.kept, len(list_filter(k.kept, lambda x: levenshtein(x, g.label) / CAST(greatest(length(x), length(g.label)) AS DOUBLE) < 0.3)) > 0 AS alike FROM k JOIN g ON g.side = k.side AND g.key = k.key AND g.p = k.p AND g.label_key = k.label_key AND g.ord = k.ord + 1) g)
SELECT side, key, p, label_key, p AS label_p, string_agg(member, '|' ORDER BY ord) AS members, string_agg(label, '|' ORDER BY ord) AS labels FROM k WHERE label IS NOT NULL GROUP BY ALL""".replace("WITH triples", "WITH RECURSIVE triples"))
def labelled_clusters(spark, sf):
    """What nations and regions have under them, by labels, alike ones left out."""
    t = V.from_tables(spark, sf)
    own = t.filter(F.col("p").isin(V.SUBCLASS, V.TYPE) & (F.col("s").startswith("nation:") | F.col("s").startswith("supp:"))).distinct()
    labels = t.filter(F.col("p") == V.LABEL).select(F.col("s").alias("node"), F.col("o").alias("label"))
    for slot in "so":
        names = labels.select(F.col("node").alias(slot), F.col("label").alias(f"label_{slot}"))
        own = own.join(names, slot, "left").withColumn(f"label_{slot}", F.coalesce(f"label_{slot}", slot))
    found = qa.labelled_clusters(own.withColumn("label_p", F.col("p")))
    return found.withColumn("members", F.array_join("members", "|")).withColumn("labels", F.array_join("labels", "|"))


@query(f"""{TRIPLES}, d AS (SELECT '_:doc' || doc_id AS doc, source, lang FROM documents), n AS (SELECT DISTINCT s AS node, source FROM triples JOIN d ON d.doc = o WHERE p = '{V.HAS_SOURCE}'
 UNION SELECT DISTINCT 'my:next', source FROM d WHERE lang <> 'en'), t AS (SELECT s, p, o FROM triples WHERE p IN ('my:next', '{V.TYPE}')),
c AS (SELECT DISTINCT t.s, t.p, t.o, a.source FROM t JOIN n a ON a.node = t.s JOIN n b ON b.node = t.p AND b.source = a.source JOIN n c ON c.node = t.o AND c.source = a.source)
SELECT t.s, t.p, t.o, c.source FROM t LEFT JOIN c ON c.s = t.s AND c.p = t.p AND c.o = t.o""")
def triple_sources(spark, sf):
    """The sources that subject, predicate and object have in common, null where there is none."""
    t = V.from_tables(spark, sf)
    docs = table(spark, sf, "documents").select(F.expr("'_:doc' || doc_id").alias("o"), "source", "lang")
    nodes = t.filter(F.col("p") == V.HAS_SOURCE).join(docs, "o").select(F.col("s").alias("node"), "source")
    sources = nodes.unionByName(docs.filter("lang <> 'en'").select(F.lit("my:next").alias("node"), "source")).distinct()
    return qa.sourced(t.filter(F.col("p").isin("my:next", V.TYPE)).select("s", "p", "o"), sources)


_CONCEPT = "name:blue bolt"


@query(f"""{SUB}, dn(node) AS (SELECT '{_CONCEPT}' UNION SELECT sub.s FROM dn JOIN sub ON sub.o = dn.node), un(node) AS (SELECT '{_CONCEPT}' UNION SELECT sub.o FROM un JOIN sub ON sub.s = un.node),
ar AS (SELECT node FROM dn UNION SELECT node FROM un), st AS (SELECT s, p, o FROM triples WHERE p = '{V.SUBCLASS}' AND (s IN (SELECT node FROM ar) OR o IN (SELECT node FROM ar))),
sh AS (SELECT s AS node FROM st UNION SELECT o FROM st UNION SELECT node FROM ar), so AS (SELECT s, p, o FROM triples WHERE p = '{V.HAS_SOURCE}' AND s IN (SELECT node FROM sh)),
df AS (SELECT 'name:' || p_name AS node, 'a thing of size ' || min(p_size) AS definition FROM part GROUP BY p_name)
SELECT s, p, o FROM (SELECT * FROM st UNION SELECT s, p, o FROM triples WHERE p = '{V.LABEL}' AND s IN (SELECT node FROM sh) UNION SELECT * FROM so
 UNION SELECT s, p, o FROM triples WHERE s IN (SELECT o FROM so) UNION SELECT node, '{V.DEFINITION}', definition FROM df WHERE node IN (SELECT node FROM sh)) WHERE s <> '' AND p <> '' AND o <> ''""")
def taxonomy_page(spark, sf):
    """All that the page of one name shows; a source says what its document is and holds."""
    definitions = table(spark, sf, "part").groupBy(F.expr("'name:' || p_name").alias("node")).agg(F.expr("'a thing of size ' || min(p_size)").alias("definition"))
    return qa.taxonomy_page(V.from_tables(spark, sf), _CONCEPT, definitions)


@query(f"""{TRIPLES}, e AS (SELECT s, o FROM triples WHERE p = '{V.IN_SYNSET}'), r(node) AS (SELECT '{_CONCEPT}' UNION SELECT CASE WHEN e.s = r.node THEN e.o ELSE e.s END FROM r JOIN e ON e.s = r.node OR e.o = r.node)
SELECT DISTINCT '{_CONCEPT}' AS s, '{V.DEFINITION}' AS p, p_brand || ' ' || p_type AS o FROM part WHERE 'part:' || p_partkey IN (SELECT node FROM r)""".replace("WITH triples", "WITH RECURSIVE triples"))
def concept_definitions(spark, sf):
    """The definitions of what one name's parts are."""
    definitions = table(spark, sf, "part").select(F.expr("'part:' || p_partkey").alias("node"), F.expr("p_brand || ' ' || p_type").alias("definition"))
    return qa.equivalent_definitions(V.from_tables(spark, sf), _CONCEPT, definitions)


#: Parts with a brand's type beside their own, where their size is even; customers with their segment; suppliers have none.
_TYPED = """t AS (SELECT 'part:' || p_partkey AS s, 'rdf:type' AS p, 'ptype:' || p_type AS o FROM part UNION SELECT 'part:' || p_partkey, 'rdf:type', p_brand FROM part WHERE p_size % 2 = 0 UNION SELECT 'part:' || p_partkey, 'rdfs:label', p_name FROM part
UNION SELECT 'cust:' || c_custkey, 'rdf:type', c_mktsegment FROM customer UNION SELECT 'cust:' || c_custkey, 'rdf:type', 'http://www.w3.org/2002/07/owl#Thing' FROM customer UNION SELECT 'supp:' || s_suppkey, 'rdfs:label', s_name FROM supplier)"""


@query(f"""WITH {_TYPED}, c AS (SELECT s, sum(CASE WHEN k = 1 THEN 2 ELSE 1 + 2 * k END) AS n FROM (SELECT s, p, count(*) AS k FROM t GROUP BY s, p) GROUP BY s),
y AS (SELECT s, list_sort(list(DISTINCT o)) AS types FROM t WHERE p = 'rdf:type' GROUP BY s), g AS (SELECT coalesce(types, ['my:Unknown']) AS types, CAST(sum(n) AS BIGINT) AS n_statements, count(*) AS n_entities FROM c LEFT JOIN y USING (s) GROUP BY 1)
SELECT CASE WHEN len(types) > 1 THEN 'my:CompositeClass' || CAST(sum(CASE WHEN len(types) > 1 THEN 1 ELSE 0 END) OVER (ORDER BY array_to_string(types, ' ')) - 1 AS BIGINT) ELSE types[1] END AS id, len(types) > 1 AS composite,
array_to_string(CASE WHEN len(types) > 1 THEN list_filter(types, lambda x: x <> 'http://www.w3.org/2002/07/owl#Thing') ELSE types END, '|') AS classes, n_statements, n_entities, CAST(row_number() OVER (ORDER BY n_statements DESC, array_to_string(types, ' ')) AS INTEGER) AS position FROM g""")
def type_graph(spark, sf):
    """Classes and composite classes of entities, those with most statements first."""
    edge = lambda name, s, p, o: table(spark, sf, name).select(F.expr(s).alias("s"), F.lit(p).alias("p"), F.expr(o).alias("o"))
    brands = table(spark, sf, "part").filter("p_size % 2 = 0").select(F.expr("'part:' || p_partkey").alias("s"), F.lit(V.TYPE).alias("p"), F.col("p_brand").alias("o"))
    parts = [
        edge("part", "'part:' || p_partkey", V.TYPE, "'ptype:' || p_type"),
        brands,
        edge("part", "'part:' || p_partkey", V.LABEL, "p_name"),
        edge("customer", "'cust:' || c_custkey", V.TYPE, "c_mktsegment"),
        edge("customer", "'cust:' || c_custkey", V.TYPE, "'http://www.w3.org/2002/07/owl#Thing'"),
        edge("supplier", "'supp:' || s_suppkey", V.LABEL, "s_name"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return entity.type_graph(out).withColumn("classes", F.array_join("classes", "|"))


@query(f"""{TRIPLES}, e AS (SELECT DISTINCT s, p, o FROM triples WHERE p IN ('{V.SUBCLASS}', '{V.TYPE}')),
x AS (SELECT s, p, o, replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS q FROM e)
SELECT 0 AS part, CAST(i AS INTEGER) AS place, value FROM (SELECT unnest(range(4)) AS i, unnest(['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="r" for="edge" attr.name="r" attr.type="string"/>', '<graph edgedefault="directed">']) AS value)
UNION ALL SELECT 1, 0, '<node id="' || node || '"/>' FROM (SELECT s AS node FROM e UNION SELECT o FROM e) UNION ALL SELECT 2, 0, '<edge source="' || s || '" target="' || o || '"><data key="r">' || q || '</data></edge>' FROM x
UNION ALL SELECT 3, 0, '</graph>' UNION ALL SELECT 3, 1, '</graphml>'""")
def graphml_document(spark, sf):
    """The lines of a document of all classes and types."""
    return V.graphml_document(V.from_tables(spark, sf).filter(F.col("p").isin(V.SUBCLASS, V.TYPE)).distinct())
