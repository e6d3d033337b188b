"""Queries of the operators that prepare inputs, order outputs and assemble what clients show."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import assembly as A
from tesserae.operators import concepts as C
from tesserae.plans import extract_queries as E
from tesserae.plans.registry import query, table
from tesserae.plans.text_queries import _clean_sql, _readable_sql
from tesserae.sources.scratch import load_or_create as load_or_create_table
from tesserae.sources.scratch import shared_path


@query(f"SELECT CASE WHEN doc_id % 3 = 0 THEN text ELSE 'doc:' || doc_id END AS id, text, {_clean_sql('text')} AS normalised_text FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL")
def content_rows(spark, sf):
    own = F.when(F.expr("doc_id % 3 <> 0"), F.expr("'doc:' || doc_id")).alias("id")
    return A.content_rows(table(spark, sf, "documents").select(own, "text", F.when(F.expr("doc_id % 5 = 0"), F.lit("{}")).alias("graph")))


@query("SELECT DISTINCT p_type || ' of ' || p_brand AS term FROM part")
def csv_terms(spark, sf):
    lines = table(spark, sf, "part").select(F.concat_ws(";", F.col("p_partkey").cast("string"), F.concat_ws(" of ", "p_type", "p_brand")).alias("line"))
    return A.csv_terms(lines, "code string, term string", "term")


@query(f"SELECT 'part:' || p_partkey AS id, trim(lower({_readable_sql('key')})) AS description FROM (SELECT p_partkey, 'my:' || replace(p_name, ' ', '_') || 'OfKind' AS key FROM part WHERE p_size % 2 = 0)")
def jsonld_descriptions(spark, sf):
    key = F.when(F.expr("p_size % 2 = 0"), F.expr("'my:' || replace(p_name, ' ', '_') || 'OfKind'"))
    entry = F.struct(F.expr("'part:' || p_partkey").alias("@id"), key.alias("name"))
    return A.jsonld_descriptions(table(spark, sf, "part").select(F.to_json(F.array(entry)).alias("json")), "name")


@query("SELECT DISTINCT lower(trim(p_name)) AS stop FROM part WHERE p_size % 7 <> 0")
def stop_word_lines(spark, sf):
    return A.stop_word_lines(table(spark, sf, "part").select(F.when(F.expr("p_size % 7 = 0"), F.concat(F.lit("# "), "p_name")).otherwise(F.concat(F.lit(" "), "p_name")).alias("line")))


@query("SELECT n_nationkey, n_name FROM nation")
def load_or_create(spark, sf):
    path = shared_path(spark, "nations", [f"{sf}/nation.parquet", f"{sf}/region.parquet"])
    make = lambda: table(spark, sf, "nation").select("n_nationkey", "n_name")
    load_or_create_table(spark, path, make)
    return load_or_create_table(spark, path, lambda: spark.range(0).select(F.lit("never made")))


@query(f"WITH RECURSIVE {E._TOK} SELECT sent_id, string_agg(trim(lower(lemma)), ' ' ORDER BY i) AS lemmas FROM rt WHERE pos <> 'PUNCT' AND lower(text) NOT IN ('the', 'of', 'and', 'is', 'by') GROUP BY sent_id")
def lemma_tokens(spark, sf):
    stops = spark.createDataFrame([(w,) for w in ("the", "of", "and", "is", "by")], "stop string")
    return A.lemma_tokens(E.tokens(spark, sf), stops).withColumn("lemmas", F.array_join("lemmas", " "))


@query("SELECT DISTINCT x AS label, x <> '' AS filled, x NOT IN ('', 'ECONOMY', 'small') AS plain, NOT regexp_matches(x, '[0-9]') AND x <> '' AS no_number FROM (SELECT unnest([p_type, p_brand, split_part(p_name, ' ', 1), '']) AS x FROM part)")
def concept_filters(spark, sf):
    labels = table(spark, sf, "part").select(F.explode(F.array("p_type", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(""))).alias("label")).distinct()
    keep = lambda *a, **k: A.concept_filter(F.col("label"), *a, **k)
    return labels.select("label", keep().alias("filled"), keep(["ECONOMY", "small"]).alias("plain"), keep(numbers=False).alias("no_number"))


@query("SELECT DISTINCT 'my:' || replace(lower(p_name), ' ', '_') AS uri, p_name AS label, length(p_name) - length(replace(p_name, ' ', '')) < 1 AS one_word FROM part")
def concept_uris(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    return names.select(C.concept_uri(F.lower("p_name")).alias("uri"), F.col("p_name").alias("label"), C.is_valid_syntagm(F.col("p_name"), 1).alias("one_word"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN text[1:40] || '[...]' ELSE text END AS clipped FROM documents")
def clip_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.clip_text(F.col("text"), 40).alias("clipped"))


@query("""SELECT n_regionkey, '<table class="table table-bordered"><tr><th>key</th><th>name</th></tr>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' ORDER BY n_nationkey) || '</table>' AS html FROM nation GROUP BY n_regionkey""")
def html_table(spark, sf):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    grouped = table(spark, sf, "nation").groupBy("n_regionkey").agg(rows.alias("rows"))
    return grouped.select("n_regionkey", A.html_table(["key", "name"], F.col("rows")).alias("html"))


@query("SELECT *, CAST(row_number() OVER (PARTITION BY s ORDER BY p, o) AS INTEGER) AS position FROM (SELECT DISTINCT l_suppkey AS s, l_returnflag AS p, l_partkey AS o FROM lineitem)")
def adjacency_order(spark, sf):
    return A.adjacency_order(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("p"), F.col("l_partkey").alias("o")).distinct())


_KEYS = ["@id", "type", "label", "abstract", "http://a.b/c/zone", "http://a.b/c/label", "brand", "size"]


@query(f"""SELECT s, p, CAST(row_number() OVER (PARTITION BY s ORDER BY r, CASE WHEN r = 2 THEN n END, p) AS INTEGER) AS position FROM (SELECT *, CASE WHEN n[1] = '@' OR n = 'type' THEN 0 WHEN n IN ('abstract', 'label') THEN 1 ELSE 2 END AS r
FROM (SELECT p_partkey AS s, p, CASE WHEN p LIKE 'http%' THEN split_part(p, '/', -1) ELSE p END AS n FROM part, (SELECT unnest({_KEYS}) AS p) WHERE (p_size + length(p)) % 3 <> 0))""")
def key_order(spark, sf):
    keys = table(spark, sf, "part").select(F.col("p_partkey").alias("s"), "p_size", F.explode(F.array(*map(F.lit, _KEYS))).alias("p"))
    return A.key_order(keys.filter("(p_size + length(p)) % 3 <> 0").select("s", "p"))


@query("SELECT cluster, text, score, words, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, text) AS INTEGER) AS rank FROM (SELECT DISTINCT p_brand AS cluster, p_name AS text, 2 AS words, min(p_size) / 2.0::DOUBLE AS score FROM part GROUP BY p_brand, p_name)")
def rank_compressions(spark, sf):
    found = table(spark, sf, "part").groupBy(F.col("p_brand").alias("cluster"), F.col("p_name").alias("text")).agg(F.min("p_size").alias("score")).withColumn("words", F.lit(2))
    return A.rank_compressions(found, by_length=True)


_LOOPS = "e AS (SELECT DISTINCT c_custkey % 97 AS s, c_nationkey AS o FROM customer UNION SELECT c_nationkey, c_nationkey FROM customer UNION SELECT 5000 + s_suppkey, s_nationkey FROM supplier)"


@query(f"WITH {_LOOPS} SELECT 'root' AS kind, s AS node FROM (SELECT DISTINCT s FROM e) WHERE s NOT IN (SELECT o FROM e WHERE s <> o) UNION ALL SELECT 'leaf', o FROM (SELECT DISTINCT o FROM e) WHERE o NOT IN (SELECT s FROM e WHERE s <> o)")
def roots_and_leaves(spark, sf):
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    edges = customer.selectExpr("c_custkey % 97 as s", "cast(c_nationkey as bigint) as o").union(customer.selectExpr("c_nationkey", "c_nationkey")).union(supplier.selectExpr("5000 + s_suppkey", "s_nationkey")).distinct()
    return A.roots(edges).select(F.lit("root").alias("kind"), "node").unionByName(A.leaves(edges).select(F.lit("leaf").alias("kind"), "node"))


_HYPER = "h AS (SELECT DISTINCT 'wn:' || split_part(p_name, ' ', 1) || '.' || split_part(p_name, ' ', 2) AS s, 'wn:' || split_part(p_name, ' ', 2) AS o FROM part UNION SELECT DISTINCT 'wn:' || split_part(p_name, ' ', 2), 'wn:entity' FROM part)"


@query(f"WITH RECURSIVE {_HYPER}, n AS (SELECT DISTINCT s FROM h WHERE s LIKE 'wn:%.%'), c(s, o) AS (SELECT s, s FROM n UNION SELECT c.s, h.o FROM c JOIN h ON h.s = c.o) SELECT s, o FROM c")
def hypernym_edges(spark, sf):
    part = table(spark, sf, "part")
    first, last = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
    hypernyms = part.selectExpr(f"'wn:' || {first} || '.' || {last} as s", f"'wn:' || {last} as o").union(part.selectExpr(f"'wn:' || {last}", "'wn:entity'")).distinct()
    nodes = part.selectExpr(f"'wn:' || {first} || '.' || {last} as node").union(part.selectExpr("p_name"))
    return A.hypernym_edges(nodes, hypernyms)


_ACTS = "e AS (SELECT DISTINCT 'supp:' || l_suppkey AS s, CASE l_returnflag WHEN 'R' THEN 'return' WHEN 'A' THEN 'accept' ELSE 'note' END AS p, 'part:' || l_partkey AS o FROM lineitem)"


@query(f"""WITH {_ACTS}, x AS (SELECT 'type' AS kind, NULL AS predicate, s AS object, 'that can ' || p || ' is' AS attribute FROM e UNION SELECT 'type', NULL, o, 'that can be ' || p || '-ed is' FROM e
UNION SELECT 'action', p, s, 'that can ' || p || ' ' || o || ' is' FROM e UNION SELECT 'action', p, o, 'that can be ' || p || '-ed by ' || s || ' is' FROM e UNION SELECT 'plain', p, s, p || ', ' || o FROM e)
SELECT kind, coalesce(predicate, '') AS predicate, object, attribute FROM x""")
def typing_contexts(spark, sf):
    verb = F.when(F.col("l_returnflag") == "R", "return").when(F.col("l_returnflag") == "A", "accept").otherwise("note")
    edges = table(spark, sf, "lineitem").select(F.expr("'supp:' || l_suppkey").alias("s"), verb.alias("p"), F.expr("'part:' || l_partkey").alias("o")).distinct()
    kinds = [("type", A.typing_context(edges, "both")), ("action", A.typing_context(edges, "both", action=True)), ("plain", A.typing_context(edges, "active", action=True, templates=False))]
    out = None
    for kind, context in kinds:
        own = context.select(F.lit(kind).alias("kind"), F.coalesce("predicate", F.lit("")).alias("predicate"), "object", "attribute")
        out = own if out is None else out.unionByName(own)
    return out


_SAID = "w AS (SELECT conv_id, turn, role, text, list_filter(string_split(lower(text), ' '), lambda x: x <> '')[1:3] AS words FROM conversations)"


def _sentences(spark, sf):
    words = F.slice(F.filter(F.split(F.lower("text"), " "), lambda x: x != ""), 1, 3)
    annotated = F.transform(words, lambda w: F.struct(w.alias("text"), F.when(F.length(w) > 3, F.array(F.concat(F.lit("wn:"), w))).otherwise(F.array().cast("array<string>")).alias("annotations")))
    own = F.when(F.col("role") == "user", F.array(F.lit("my:user"), F.lit("my:second"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.struct("turn", "role", F.struct("text", own.alias("annotations"), annotated.alias("words")).alias("s")).alias("s"))
    return rows.groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["s"]).alias("sentences"))


@query(f"WITH {_SAID} SELECT conv_id AS id, text, 'my:user' AS annotation FROM w WHERE role = 'user' UNION ALL SELECT conv_id, x, 'wn:' || x FROM (SELECT conv_id, unnest(words) AS x FROM w) WHERE length(x) > 3")
def annotation_list(spark, sf):
    return A.annotation_list(_sentences(spark, sf))


@query(f"""WITH {_SAID}, a AS (SELECT conv_id, turn, role, text, unnest([-2, -1]) AS k, unnest(['my:user', 'my:second']) AS x FROM w WHERE role = 'user' UNION ALL SELECT conv_id, turn, role, text, generate_subscripts(words, 1), unnest(words) FROM w),
b AS (SELECT conv_id, turn, role, text, k, CASE WHEN k < 0 THEN x ELSE 'wn:' || x END AS x FROM a WHERE k < 0 OR length(x) > 3),
d AS (SELECT conv_id, x, row_number() OVER (PARTITION BY conv_id ORDER BY min(struct_pack(t := turn, r := role, k := k, y := x))) AS n FROM b GROUP BY conv_id, x)
SELECT c.conv_id AS id, coalesce(string_agg(x, ', ' ORDER BY n) FILTER (WHERE n <= 3), '') || CASE WHEN count(x) >= 3 THEN ', etc..' ELSE '' END AS concepts FROM (SELECT DISTINCT conv_id FROM w) c LEFT JOIN d ON d.conv_id = c.conv_id GROUP BY c.conv_id""")
def known_concepts(spark, sf):
    return A.known_concepts(_sentences(spark, sf), 3)


@query("SELECT 'order of ' || o_orderpriority AS process, 'in:' || l_linenumber AS id, CAST(l_linenumber * 10 AS VARCHAR) AS value, CAST(l_linenumber AS VARCHAR) AS feature_order, 'api' AS api FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT DISTINCT l_linenumber FROM lineitem)")
def process_inputs(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_linenumber").distinct()
    item = F.struct(F.expr("'in:' || l_linenumber").alias("id"), (F.col("l_linenumber") * 10).cast("string").alias("value"), F.col("l_linenumber").cast("string").alias("feature_order"), F.lit("api").alias("api"))
    inputs = lines.agg(F.array_sort(F.collect_list(item)).alias("inputs"))
    orders = table(spark, sf, "orders").select(F.expr("'order of ' || o_orderpriority").alias("label"))
    return A.process_inputs(orders.join(F.broadcast(inputs)).select(F.array(F.struct("label", "inputs")).alias("processes")))


@query("WITH v AS (SELECT l_orderkey AS request, l_linenumber % 4 + 8 AS n, arg_max(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS value FROM lineitem GROUP BY ALL) SELECT request, string_agg(value, ',' ORDER BY n) AS \"values\" FROM v GROUP BY request")
def counterfactual_inputs(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request"), F.expr("cast(l_linenumber % 4 + 8 as string)").alias("id"), F.col("l_partkey").cast("string").alias("value"), F.struct("l_linenumber", "l_partkey").alias("ord"))
    return A.counterfactual_inputs(rows).withColumn("values", F.array_join("values", ","))


@query(r"SELECT doc_id, CASE WHEN len(w) < 30 THEN text ELSE '> ' || array_to_string(w[1:12], ' ') END AS summary FROM (SELECT doc_id, text, regexp_split_to_array(regexp_replace(text, '^ +| +$', '', 'g'), '\s+') AS w FROM documents)")
def summarise_texts(spark, sf):
    return A.summarise_texts(table(spark, sf, "documents").select("doc_id", "text"), lambda x: F.concat(F.lit("> "), x), least=30, window=12).select("doc_id", "summary")


@query("SELECT DISTINCT 'part:' || p_partkey AS s, 'my:inSynset' AS p, 'wn:' || split_part(p_name, ' ', 2) || '.n.01' AS o FROM part WHERE p_size % 2 = 0 OR p_name LIKE '% ring'")
def tag_senses(spark, sf):
    part = table(spark, sf, "part")
    nodes = part.selectExpr("'part:' || p_partkey as node", "case when p_size % 2 = 0 or p_name like '% ring' then split_part(p_name, ' ', 2) else 'none' end as lemma")
    senses = part.selectExpr("split_part(p_name, ' ', 2) as lemma", "split_part(p_name, ' ', 2) || '.n.01' as sense").distinct()
    return A.tag_senses(nodes, senses)


@query("WITH t AS (SELECT conv_id AS root, turn AS node, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, text FROM conversations) SELECT DISTINCT root, text FROM t WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM t c WHERE c.root = t.root AND c.parent = t.node)")
def leaf_texts(spark, sf):
    tree = table(spark, sf, "conversations").selectExpr("conv_id as root", "turn as node", "case when turn > 0 then (turn - 1) div 2 end as parent", "text")
    return A.leaf_texts(tree)
