"""Queries of the set, lookup and deduplication operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import qa, sets
from tesserae.plans.registry import query, table
from tesserae.sources import triples as V

TRIPLES = f"WITH RECURSIVE triples AS ({V.DUCKDB_TRIPLES})"
SUB = f"{TRIPLES}, sub AS (SELECT s, o FROM triples WHERE p = '{V.SUBCLASS}')"


def subclass(spark, sf):
    return V.from_tables(spark, sf).filter(F.col("p") == V.SUBCLASS)


@query(f"{TRIPLES} SELECT p, count(*) AS n, count(DISTINCT s || chr(31) || o) AS n_distinct FROM triples GROUP BY p")
def triple_counts(spark, sf):
    t = V.from_tables(spark, sf)
    return t.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s", "o").alias("n_distinct"))


@query(f"{TRIPLES} SELECT DISTINCT s AS node FROM triples WHERE p LIKE '%{{obj}}%'")
def subject_set(spark, sf):
    return sets.slot_set(V.from_tables(spark, sf).filter(V.is_relation()), "s")


@query(f"{TRIPLES} SELECT DISTINCT p AS node FROM triples")
def predicate_set(spark, sf):
    return sets.slot_set(V.from_tables(spark, sf), "p")


@query(f"{SUB} SELECT s AS node FROM sub UNION SELECT o FROM sub")
def concept_set(spark, sf):
    return sets.concept_set(subclass(spark, sf))


@query(f"{SUB} SELECT DISTINCT s AS node FROM sub WHERE s NOT IN (SELECT o FROM sub)")
def roots(spark, sf):
    return sets.roots(subclass(spark, sf))


@query(f"{SUB} SELECT DISTINCT o AS node FROM sub WHERE o NOT IN (SELECT s FROM sub)")
def leaves(spark, sf):
    return sets.leaves(subclass(spark, sf))


@query(f"{SUB} SELECT s, '{V.SUBCLASS}' AS p, o FROM sub WHERE o IN (SELECT s FROM sub)")
def remove_leaves(spark, sf):
    return sets.remove_leaves(subclass(spark, sf))


@query(f"{SUB} SELECT o AS s, '{V.SUBCLASS}' AS p, s AS o FROM sub")
def reverse_order(spark, sf):
    return sets.reversed_edges(subclass(spark, sf))


@query(f"{TRIPLES} SELECT s, string_agg(o, '|' ORDER BY o) AS objects FROM triples WHERE p = '{V.CONTAINS}' GROUP BY s")
def predicate_dict(spark, sf):
    d = sets.predicate_dict(V.from_tables(spark, sf), V.CONTAINS)
    return d.select("s", F.array_join("values", "|").alias("objects"))


@query(f"""{TRIPLES}, nodes AS (SELECT s AS node FROM triples WHERE p IN ('{V.SUBCLASS}', '{V.TYPE}') UNION SELECT o FROM triples WHERE p IN ('{V.SUBCLASS}', '{V.TYPE}'))
SELECT node, coalesce((SELECT min(o) FROM triples t WHERE t.s = node AND t.p = '{V.LABEL}'), split_part(node, ':', 2)) AS label FROM nodes""")
def node_label(spark, sf):
    t = V.from_tables(spark, sf)
    nodes = sets.concept_set(t.filter(F.col("p").isin(V.SUBCLASS, V.TYPE)))
    named = nodes.join(sets.node_labels(t, V.LABEL), "node", "left")
    return named.select("node", F.coalesce("label", F.expr("split_part(node, ':', 2)")).alias("label"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def keep_first(spark, sf):
    return sets.keep_first(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT lang, source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) = 1")
def keep_longest(spark, sf):
    return sets.keep_longest(table(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], ["n_chars"], "doc_id")


@query("""SELECT 'supp:' || l_suppkey AS s, 'part:' || l_partkey AS o, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS p
FROM lineitem GROUP BY 1, 2""")
def digraph_collapse(spark, sf):
    edges = table(spark, sf, "lineitem").select(
        F.expr("'supp:' || l_suppkey").alias("s"), F.col("l_returnflag").alias("p"), F.expr("'part:' || l_partkey").alias("o"), F.expr("l_orderkey * 10 + l_linenumber").alias("ord")
    )
    return V.collapse_parallel(edges)


@query(f"{TRIPLES} SELECT t.s, t.p, t.o FROM triples t JOIN (SELECT DISTINCT s FROM triples WHERE p = '{V.SUPPLIES}') n ON t.s = n.s")
def out_edges(spark, sf):
    t = V.from_tables(spark, sf)
    return qa.out_edges(sets.slot_set(t.filter(F.col("p") == V.SUPPLIES), "s"), t)


@query(f"{TRIPLES} SELECT t.s, t.p, t.o FROM triples t WHERE t.o IN (SELECT 'nation:' || n_nationkey FROM nation)")
def in_edges(spark, sf):
    nodes = table(spark, sf, "nation").select(F.expr("'nation:' || n_nationkey").alias("node"))
    return qa.in_edges(nodes, V.from_tables(spark, sf))


@query("""WITH first AS (SELECT sentence, min(struct_pack(question := conv_id, pos := turn)) AS f FROM (SELECT conv_id, turn, text AS sentence FROM conversations) GROUP BY sentence),
r AS (SELECT f.question AS question, f.pos AS pos, sentence, CAST(row_number() OVER (PARTITION BY f.question ORDER BY f.pos, sentence) AS INTEGER) AS rank FROM first)
SELECT question, pos, sentence, rank FROM r WHERE rank <= 3""")
def cross_question_dedup(spark, sf):
    from tesserae.operators.summary import first_use

    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("question"), F.col("turn").alias("pos"), F.col("text").alias("sentence"))
    return first_use(rows, 3).select("question", "pos", "sentence", "rank")


@query("SELECT conv_id, turn, length(text) AS n FROM conversations")
def memoised_call(spark, sf):
    from tesserae.sources.markup import memoised

    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return memoised(rows, ["text"], F.length("text").cast("long"), "n").select("conv_id", "turn", "n")
