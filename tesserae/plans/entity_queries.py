"""Queries of entities, templates, couples and parsed tokens."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators import entity, extract, qa
from tesserae.plans.rank_queries import TOKENS
from tesserae.plans.registry import query, table
from tesserae.plans.set_queries import TRIPLES
from tesserae.sources import triples as V


@query(f"{TRIPLES} SELECT s, p, string_agg(DISTINCT o, '|' ORDER BY o) AS objects FROM triples WHERE p <> '{V.CONTENT}' GROUP BY s, p")
def entity_merge(spark, sf):
    merged = entity.merge_entities(V.from_tables(spark, sf).filter(F.col("p") != V.CONTENT))
    return merged.select("s", "p", F.array_join("values", "|").alias("objects"))


@query("SELECT 'user:' || user_id AS s, event_type AS p, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS o FROM events GROUP BY 1, 2")
def entity_last_wins(spark, sf):
    facts = table(spark, sf, "events").select(F.expr("'user:' || user_id").alias("s"), F.col("event_type").alias("p"), F.col("event_id").alias("o"), "ts", "event_id")
    return entity.last_wins(facts, ["ts", "event_id"])


@query("SELECT types, count(*) AS n_entities FROM (SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ' + ' ORDER BY l_returnflag || l_linestatus) AS types FROM lineitem GROUP BY l_orderkey) GROUP BY types")
def type_sets(spark, sf):
    return entity.type_sets(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("s"), F.concat("l_returnflag", "l_linestatus").alias("o")))


@query(f"{TRIPLES}, n AS (SELECT DISTINCT s FROM triples WHERE p IN ('{V.LABEL}', '{V.TYPE}')), t AS (SELECT DISTINCT s, o FROM triples WHERE p = '{V.TYPE}') SELECT coalesce(o, 'my:Unknown') AS \"group\", n.s FROM n LEFT JOIN t ON n.s = t.s")
def entity_groups(spark, sf):
    return entity.group_by_key(V.from_tables(spark, sf).filter(F.col("p").isin(V.LABEL, V.TYPE)), V.TYPE)


@query(f"{TRIPLES} SELECT split_part(s, ':', 1) AS kind, p, count(*) AS n, count(DISTINCT s) AS n_subjects FROM triples GROUP BY 1, 2")
def statement_count(spark, sf):
    return entity.statement_counts(V.from_tables(spark, sf))


@query(f"""{TRIPLES}, n AS (SELECT count(*) AS n_nodes FROM (SELECT s FROM triples UNION SELECT o FROM triples))
SELECT count(*) AS n_statements, count(DISTINCT s) AS n_entities, count(DISTINCT p) AS n_predicates, count(DISTINCT CASE WHEN p = '{V.TYPE}' THEN o END) AS n_classes, max(n_nodes) AS n_nodes FROM triples, n""")
def dataset_profile(spark, sf):
    return entity.dataset_profile(V.from_tables(spark, sf))


# fixed values: templates as sets of predicates
TEMPLATES = [(1, [V.LABEL, V.SUBCLASS]), (2, [V.LABEL, V.SUBCLASS, V.TYPE]), (3, [V.CONTENT]), (4, [V.CONTENT, V.DOC_ID]), (5, [V.PLACES]), (6, ["my:next", V.TYPE]), (7, [V.LABEL, V.SUPPLIES])]
TEMPLATE_SQL = "tpl(template, keys) AS (VALUES " + ", ".join(f"({i}, list_value({', '.join(repr(k) for k in ks)}))" for i, ks in TEMPLATES) + ")"


def _templates(spark):
    return spark.createDataFrame(TEMPLATES, "template int, keys array<string>")


@query(f"""{TRIPLES}, {TEMPLATE_SQL}, k AS (SELECT template, len(keys) AS n, unnest(keys) AS p FROM tpl), h AS (SELECT DISTINCT s, p FROM triples)
SELECT template, s FROM h JOIN k USING (p) GROUP BY template, s HAVING count(*) = max(n)""")
def template_match(spark, sf):
    return entity.match_templates(V.from_tables(spark, sf), _templates(spark))


@query(f"""{TRIPLES}, ks AS (SELECT s, list_sort(list(DISTINCT p)) AS keys FROM triples GROUP BY s), tk AS (SELECT DISTINCT keys FROM ks),
tpl AS (SELECT row_number() OVER (ORDER BY len(keys), array_to_string(keys, '|')) AS template, keys FROM tk)
SELECT a.template, array_to_string(a.keys, '|') AS keys FROM tpl a WHERE NOT EXISTS (
SELECT 1 FROM tpl b WHERE list_has_all(b.keys, a.keys) AND (len(a.keys) < len(b.keys) OR (len(a.keys) = len(b.keys) AND a.template < b.template)))""")
def template_prune(spark, sf):
    """Of the templates that the nodes' own keys give, those that no other holds."""
    keys = V.from_tables(spark, sf).groupBy("s").agg(F.array_sort(F.collect_set("p")).alias("keys")).select("keys").distinct()
    order = Window.orderBy(F.size("keys"), F.array_join("keys", "|"))  # as many rows as there are sets of keys
    templates = keys.withColumn("template", F.row_number().over(order).cast("long"))
    return entity.prune_templates(templates).select("template", F.array_join("keys", "|").alias("keys"))


@query(f"""{TRIPLES}, t AS (SELECT DISTINCT s, p, o FROM triples WHERE p IN ('{V.TYPE}', '{V.IN_SYNSET}')),
c AS (SELECT 'o' AS side, s AS key, p, string_agg(DISTINCT o, '|' ORDER BY o) AS members, count(DISTINCT o) AS n FROM t GROUP BY s, p UNION ALL SELECT 's', o, p, string_agg(DISTINCT s, '|' ORDER BY s), count(DISTINCT s) FROM t GROUP BY o, p)
SELECT side, key, p, members FROM c WHERE n > 1""")
def couple_clusters(spark, sf):
    t = V.from_tables(spark, sf).filter(F.col("p").isin(V.TYPE, V.IN_SYNSET))
    return qa.couple_clusters(t).withColumn("members", F.array_join("members", "|"))


@query("""WITH s AS (SELECT DISTINCT l_returnflag AS p, l_orderkey AS source, 'supp:' || l_suppkey AS s FROM lineitem), o AS (SELECT DISTINCT l_returnflag AS p, l_orderkey AS source, 'part:' || l_partkey AS o FROM lineitem)
SELECT s, p, o, source FROM s JOIN o USING (p, source)""")
def couple_to_triples(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("predicate"), F.col("l_orderkey").alias("source"), F.expr("'supp:' || l_suppkey").alias("x"), F.expr("'part:' || l_partkey").alias("y"))
    return extract.couple_triples(rows.withColumnRenamed("x", "concept"), rows.withColumnRenamed("y", "concept"))


CHAIN = "SELECT DISTINCT array_to_string(w[k:], ' ') AS s, array_to_string(w[k + 1:], ' ') AS o FROM (SELECT w, unnest(range(1, len(w))) AS k FROM (SELECT string_split(p_name || ' ' || p_type, ' ') AS w FROM part)) WHERE array_to_string(w[k:], ' ') <> array_to_string(w[k + 1:], ' ')"


@query(CHAIN)
def subclass_chain(spark, sf):
    return extract.suffix_chain(table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name")))


@query(f"""{TRIPLES}, src AS (SELECT DISTINCT a.s AS node, b.o AS source FROM triples a JOIN triples b ON a.o = b.s WHERE a.p = '{V.HAS_SOURCE}' AND b.p = '{V.DOC_ID}'), t AS (SELECT s, p, o FROM triples WHERE p = 'my:next')
SELECT t.s, t.p, t.o, m.source FROM t LEFT JOIN (SELECT t.s, t.p, t.o, x.source FROM t JOIN src x ON x.node = t.s JOIN src y ON y.node = t.o AND y.source = x.source) m ON m.s = t.s AND m.o = t.o""")
def triple_sources(spark, sf):
    t = V.from_tables(spark, sf)
    docs = t.filter(F.col("p") == V.DOC_ID).select(F.col("s").alias("doc"), F.col("o").alias("source"))
    sources = t.filter(F.col("p") == V.HAS_SOURCE).join(docs, F.col("o") == F.col("doc")).select(F.col("s").alias("node"), "source")
    return qa.slot_sources(t.filter("p = 'my:next'"), sources)


@query(f"""{TRIPLES}, src AS (SELECT s AS node, o AS source FROM triples WHERE p = '{V.HAS_SOURCE}'), c AS (SELECT s AS doc, o AS text FROM triples WHERE p = '{V.CONTENT}')
SELECT node, source, length(min(text)) AS n FROM src LEFT JOIN c ON c.doc = source GROUP BY node, source""")
def source_contents(spark, sf):
    t = V.from_tables(spark, sf)
    sources = t.filter(F.col("p") == V.HAS_SOURCE).select(F.col("s").alias("node"), F.col("o").alias("source"))
    contents = t.filter(F.col("p") == V.CONTENT).groupBy(F.col("s").alias("source")).agg(F.min("o").alias("text"))
    return sources.join(contents, "source", "left").select("node", "source", F.length("text").cast("long").alias("n")).distinct()


@query(f"WITH t AS (SELECT doc_id, source, unnest({TOKENS.format(x='text')}) AS term FROM documents) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs, coalesce(string_agg(DISTINCT source, '|' ORDER BY source), '') AS sources FROM t GROUP BY term")
def concept_counts(spark, sf):
    """How often each concept is said, in how many documents, and the sources that say it."""
    return entity.concept_profile(table(spark, sf, "documents").select("doc_id", "source", "text")).select(F.col("concept").alias("term"), "n", "n_docs", F.array_join("sources", "|").alias("sources"))


@query(f"""WITH s AS (SELECT DISTINCT doc_id, source, text FROM documents), t AS (SELECT doc_id, source, unnest({TOKENS.format(x='text')}) AS term FROM s)
SELECT term, count(*) AS n, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM t GROUP BY term""")
def concept_sources(spark, sf):
    """How often each concept is said, and the sources that say it."""
    found = entity.concept_counter(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return found.select(F.col("concept").alias("term"), "n", F.array_join("sources", "|").alias("sources"))


@query(f"WITH t AS (SELECT unnest({TOKENS.format(x='text')}) AS term FROM conversations), k AS (SELECT DISTINCT unnest({TOKENS.format(x='text')}) AS term FROM documents) SELECT term, count(*) AS n FROM t WHERE term NOT IN (SELECT term FROM k) GROUP BY term")
def missing_concepts(spark, sf):
    from tesserae.functions.text import word_tokens

    words = lambda name: table(spark, sf, name).select(F.explode(word_tokens(F.col("text"))).alias("term"))
    return words("conversations").join(words("documents").distinct(), "term", "left_anti").groupBy("term").agg(F.count("*").alias("n"))


# fixed values: words that say nothing of themselves
STOP_WORDS = ["the", "of", "and", "a", "to", "in", "is", "it", "that", "for", "on", "with", "as", "at", "by", "be", "are", "this", "or", "an"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(f"WITH t AS (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]')) AS word FROM conversations) SELECT conv_id, turn, word FROM t WHERE word <> '' AND NOT regexp_matches(word, '[0-9]') AND word NOT IN ({STOP_SQL})")
def couple_filter(spark, sf):
    words = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split(F.lower("text"), "[^a-zA-Z0-9]")).alias("word"))
    stop = spark.createDataFrame([(w,) for w in STOP_WORDS], "stop string")
    return extract.couple_filter(words, stop).select("conv_id", "turn", "word")


@query(f"SELECT 'cust:' || c_custkey AS s, '{V.LABEL}' AS p, c_name AS o FROM customer UNION ALL SELECT 'cust:' || c_custkey, '{V.SUBCLASS}', 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'cust:' || c_custkey, '{V.TYPE}', c_mktsegment FROM customer")
def emit_triples(spark, sf):
    me = F.expr("'cust:' || c_custkey")
    return entity.emit(table(spark, sf, "customer"), [(me, F.lit(V.LABEL), F.col("c_name")), (me, F.lit(V.SUBCLASS), F.expr("'nation:' || c_nationkey")), (me, F.lit(V.TYPE), F.col("c_mktsegment"))])


@query(f"{TRIPLES} SELECT DISTINCT p, o FROM triples WHERE s = 'part:1'")
def describe_node(spark, sf):
    return entity.describe(V.from_tables(spark, sf), "part:1")


@query(f"""{TRIPLES}, rk AS (SELECT s AS node, count(*) AS rank FROM triples WHERE p LIKE '%{{obj}}%' GROUP BY s),
l AS (SELECT 'out' AS side, p, o AS other FROM triples WHERE s = 'nation:1' AND p <> '{V.LABEL}' UNION SELECT 'in', p, s FROM triples WHERE o = 'nation:1' AND p <> '{V.LABEL}' UNION SELECT 'literal', p, o FROM triples WHERE s = 'nation:1' AND p = '{V.LABEL}')
SELECT side, p, other, coalesce(rank, -1) AS rank FROM l LEFT JOIN rk ON node = other""")
def sparql_linksum(spark, sf):
    t = V.from_tables(spark, sf)
    ranks = t.filter(V.is_relation()).groupBy(F.col("s").alias("node")).agg(F.count("*").alias("rank"))
    return entity.link_summary(t, ranks, "nation:1", [V.LABEL]).withColumn("rank", F.coalesce("rank", F.lit(-1)))


@query(f"{TRIPLES}, k AS (SELECT DISTINCT s FROM triples WHERE p = '{V.TYPE}' AND o IN (SELECT min('ptype:' || p_type) FROM part)), x AS (SELECT s, p, o FROM triples WHERE p IN ('{V.TYPE}', '{V.LABEL}', '{V.IN_SYNSET}')) SELECT s, p, o, s IN (SELECT s FROM k) AS chosen FROM x")
def split_entities(spark, sf):
    t = V.from_tables(spark, sf).filter(F.col("p").isin(V.TYPE, V.LABEL, V.IN_SYNSET))
    first = table(spark, sf, "part").agg(F.min(F.expr("'ptype:' || p_type"))).first()[0]
    own, rest = entity.split_by_type(t, [first])
    return own.withColumn("chosen", F.lit(True)).unionByName(rest.withColumn("chosen", F.lit(False)))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id")
def unique_elements(spark, sf):
    return entity.unique_elements(table(spark, sf, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_key_values(spark, sf):
    from tesserae.sources.jsonld import json_values

    return json_values(table(spark, sf, "events"), "event_id", "props", "k").select("event_id", "value")
