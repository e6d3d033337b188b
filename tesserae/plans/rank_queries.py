"""Queries of term weights, similarities, rankings and answers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tesserae.operators import corpus as K
from tesserae.operators import qa, rank, sets, summary
from tesserae.plans.graph_queries import CONCEPT_GRAPH
from tesserae.plans.registry import query, table
from tesserae.plans.set_queries import SUB, TRIPLES
from tesserae.sources import triples as V
from tesserae.sources.scratch import written

QUESTIONS = [(1, "what is the order of the united shipment"), (2, "which supplier offers the blue anvil"), (3, "tion and the erst"), (4, "que la casa de los"), (5, "der die und das en")]
Q_SQL = "q(qid, question) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in QUESTIONS) + ")"
TOKENS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "qid int, question string")


def tfidf_sql(corpus: str, asked: str = Q_SQL) -> str:
    """CTEs w(key, term, tf, df, weight) and sim(qid, key, similarity) over corpus(key, text)."""
    return f"""tok AS (SELECT key, unnest({TOKENS.format(x='text')}) AS term FROM ({corpus})),
tf AS (SELECT key, term, count(*) AS tf FROM tok GROUP BY key, term), n AS (SELECT count(DISTINCT key) AS n FROM ({corpus})),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT key, term, tf, df, tf * log2(n / CAST(df AS DOUBLE)) AS raw FROM tf JOIN df USING (term), n),
nrm AS (SELECT key, sqrt(sum(raw * raw)) AS nrm FROM raw GROUP BY key),
w AS (SELECT key, term, tf, df, coalesce(raw / nullif(nrm, 0), 0) AS weight FROM raw JOIN nrm USING (key)),
{asked}, qt AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({TOKENS.format(x='question')}) AS term FROM q) GROUP BY qid, term),
qr AS (SELECT qid, term, tf * log2(n / CAST(df AS DOUBLE)) AS raw FROM qt JOIN df USING (term), n),
qn AS (SELECT qid, sqrt(sum(raw * raw)) AS nrm FROM qr GROUP BY qid),
sim AS (SELECT qid, key, round(sum(coalesce(raw / nullif(nrm, 0), 0) * weight), 6) AS similarity FROM qr JOIN qn USING (qid) JOIN w USING (term) GROUP BY qid, key)"""


DOCS = "SELECT doc_id AS key, text FROM documents"
DOTS = """p AS (SELECT q.vec_id AS qid, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)"""


def document_corpus(spark, sf):
    return K.registered(spark, "documents", [f"{sf}/documents.parquet"], lambda: table(spark, sf, "documents"))


def part_name_corpus(spark, sf):
    return K.registered(spark, "part-names", [f"{sf}/part.parquet"], lambda: table(spark, sf, "part").select("p_name").distinct(), key="p_name", text="p_name")


def doc_similarity(spark, sf, **limits):
    return K.similarities(document_corpus(spark, sf), questions(spark), **limits).withColumnRenamed("key", "doc_id")


def dots(spark, sf, **limits):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    pairs = rank.dot_pairs(q, v, **limits)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {tfidf_sql(DOCS)} SELECT key AS doc_id, term, tf, df, round(weight, 6) AS weight FROM w")
def tfidf_weights(spark, sf):
    return document_corpus(spark, sf).postings.select(F.col("key").alias("doc_id"), "term", "tf", "df", F.round("weight", 6).alias("weight"))


@query(f"""WITH {tfidf_sql(DOCS)}, r AS (SELECT qid, key AS doc_id, similarity, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, key DESC) AS INTEGER) AS rank FROM sim)
SELECT qid, doc_id, similarity, rank FROM r WHERE rank <= 5""")
def tfidf_topk(spark, sf):
    return K.search(document_corpus(spark, sf), questions(spark), k=5).withColumnRenamed("key", "doc_id")


@query(f"WITH {DOTS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id DESC) AS INTEGER) AS rank FROM p) SELECT qid, vec_id, similarity, rank FROM r WHERE rank <= 3")
def dot_topk(spark, sf):
    return rank.ranked(dots(spark, sf, k=3), "qid", "vec_id", k=3)


@query(f"WITH {DOTS}, m AS (SELECT avg(similarity) AS mean FROM p) SELECT qid, vec_id, round(greatest(similarity - mean, 0), 5) AS centred FROM p, m")
def centred_similarity(spark, sf):
    return rank.centred(dots(spark, sf)).select("qid", "vec_id", F.round("centred", 5).alias("centred"))


@query(f"WITH {DOTS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id DESC) AS INTEGER) AS rank FROM p WHERE similarity >= 0.2) SELECT qid, vec_id, similarity, rank FROM r")
def ranked_threshold(spark, sf):
    return rank.ranked(dots(spark, sf, threshold=0.2), "qid", "vec_id", threshold=0.2)


@query(f"WITH {DOTS} SELECT qid, max(similarity) AS similarity, arg_max(vec_id, similarity + vec_id * 1e-12) AS vec_id FROM p GROUP BY qid")
def nearest_one(spark, sf):
    best = dots(spark, sf, k=1).groupBy("qid").agg(F.max(F.struct("similarity", "vec_id")).alias("b"))
    return best.select("qid", "b.similarity", "b.vec_id")


@query(f"WITH {DOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id DESC) AS k FROM p WHERE similarity >= 0.25) SELECT qid AS s, 'my:hinge' AS p, vec_id AS o FROM r WHERE k = 1")
def graph_hinge(spark, sf):
    """Edges from each node to the nearest node of another graph, where that is near enough."""
    best = rank.ranked(dots(spark, sf, k=1, threshold=0.25), "qid", "vec_id", threshold=0.25, k=1)
    return best.select(F.col("qid").alias("s"), F.lit("my:hinge").alias("p"), F.col("vec_id").alias("o"))


@query(f"""WITH {tfidf_sql(DOCS)}, b AS (SELECT 1 AS k, embedding AS e FROM embeddings WHERE vec_id = 0),
sem AS (SELECT vec_id AS doc_id, round(list_dot_product(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS d FROM embeddings, b)
SELECT s.qid, s.key AS doc_id, round(0.5 * s.similarity + 0.5 * sem.d, 7) AS weighted FROM sim s JOIN sem ON sem.doc_id = s.key""")
def weighted_similarity(spark, sf):
    v = table(spark, sf, "embeddings")
    first = v.filter("vec_id = 0").select(F.col("embedding").alias("e"))
    semantic = v.crossJoin(F.broadcast(first.limit(1))).select(F.col("vec_id").alias("doc_id"), F.round(rank.dot(F.col("e"), F.col("embedding")), 6).alias("d"))
    both = doc_similarity(spark, sf).join(semantic, "doc_id")
    return both.select("qid", "doc_id", F.round(rank.weighted(F.col("similarity"), F.col("d"), 0.5), 7).alias("weighted"))


@query(f"""WITH {tfidf_sql(DOCS)}, v AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sem AS (SELECT q.qid, v.key, round(list_dot_product(x.e, v.e), 6) AS semantic FROM q JOIN v x ON x.key = q.qid JOIN v ON true),
b AS (SELECT qid, key, coalesce(similarity, 0) AS syntactic, semantic, 0.5 * coalesce(similarity, 0) + 0.5 * semantic AS w FROM sem LEFT JOIN sim USING (qid, key)), m AS (SELECT avg(w) AS m FROM b)
SELECT qid, key, syntactic, semantic, round(greatest(w - m, 0), 5) AS weighted FROM b, m""")
def corpus_weighted(spark, sf):
    """Similarities by terms and by vectors of all texts, centred; a question has the vector of its number."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("e"))
    asked = questions(spark)
    own = asked.select("qid").join(v.select(F.col("key").alias("qid"), F.col("e").alias("q")), "qid")
    semantic = v.crossJoin(F.broadcast(own.limit(len(QUESTIONS)))).select("qid", "key", F.round(rank.dot(F.col("q"), F.col("e")), 6).alias("semantic"))
    out = K.weighted(document_corpus(spark, sf), asked, semantic, 0.5, centre=True)
    return out.withColumn("weighted", F.round("weighted", 5))


@query(f"""WITH {tfidf_sql(DOCS)}, r AS (SELECT qid, key, similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, key DESC) AS rank FROM sim WHERE similarity >= 0.05)
SELECT qid, count(*) AS n_answers, max(CASE WHEN rank = 1 THEN key END) AS first_doc, max(CASE WHEN rank = 1 THEN similarity END) AS first_similarity FROM r GROUP BY qid""")
def answer_quality(spark, sf):
    r = rank.ranked(doc_similarity(spark, sf, threshold=0.05), "qid", "doc_id", threshold=0.05)
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    return r.groupBy("qid").agg(F.count("*").alias("n_answers"), first("doc_id").alias("first_doc"), first("similarity").alias("first_similarity"))


NAMES = "SELECT DISTINCT p_name AS key, p_name AS text FROM part"


@query(f"""WITH {tfidf_sql(NAMES)}, r AS (SELECT qid, key, similarity, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, key DESC) AS INTEGER) AS rank FROM sim WHERE similarity >= 0.3)
SELECT qid, key AS label, similarity, rank FROM r WHERE rank <= 3""")
def annotate(spark, sf):
    """The labels nearest to each text, best first."""
    found = K.search(part_name_corpus(spark, sf), questions(spark), threshold=0.3, k=3)
    return found.select("qid", F.col("key").alias("label"), "similarity", "rank")


@query("""WITH x AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT label, unnest(range(len(e))) AS i, unnest(e) AS v FROM x), c AS (SELECT label, i, avg(v) AS m FROM u GROUP BY label, i),
m AS (SELECT label, list(m ORDER BY i) AS c FROM c GROUP BY label),
s AS (SELECT label, vec_id, round(list_cosine_similarity(e, c), 6) AS similarity FROM x JOIN m USING (label))
SELECT label, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) = 1""")
def centroid_medoid(spark, sf):
    """The member of each cluster that is most like the cluster's mean."""
    v = table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    mean = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("c"))
    cosine = rank.dot(F.col("embedding"), F.col("c")) / (rank.norm(F.col("embedding")) * rank.norm(F.col("c")))
    scored = v.join(centre, "label").select("label", "vec_id", F.round(cosine, 6).alias("similarity"))
    return sets.top_k(scored, ["label"], [F.desc("similarity"), F.col("vec_id")], 1).drop("rank")


LABELLED = f"""{CONCEPT_GRAPH}, lab AS (SELECT s AS node, o AS label FROM triples WHERE p = '{V.LABEL}'),
l AS (SELECT cg.s, cg.p, cg.o, coalesce(ls.label, cg.s) AS label_s, cg.p AS label_p, coalesce(lo.label, cg.o) AS label_o
 FROM cg LEFT JOIN lab ls ON ls.node = cg.s LEFT JOIN lab lo ON lo.node = cg.o WHERE cg.s <> cg.o)"""


def labelled_graph(spark, sf):
    t = V.from_tables(spark, sf)
    labels = t.filter(F.col("p") == V.LABEL).select(F.col("s").alias("node"), F.col("o").alias("label"))
    graph = qa.concept_graph(t, "region:0", keep=V.is_relation())
    return qa.labelled(graph, labels, "region:0")


@query(f"{LABELLED} SELECT s, p, o, label_s, label_p, label_o FROM l")
def labelled_triples(spark, sf):
    return labelled_graph(spark, sf)


def answer_index(spark, sf):
    """The texts of the graph below and around one concept."""
    inputs = [f"{sf}/{t}.parquet" for t in ("customer", "supplier", "nation", "region", "part", "orders", "lineitem", "documents")]
    return qa.registered_answers(spark, "region-0", inputs, lambda: qa.texts_of(written(labelled_graph(spark, sf))))


def node_labels(spark, sf, triples):
    """The labels of all nodes, and their corpus."""
    labels = written(triples.filter(F.col("p") == V.LABEL).select(F.col("s").alias("node"), F.col("o").alias("label")))
    inputs = [f"{sf}/{t}.parquet" for t in ("customer", "supplier", "nation", "region", "part")]
    return labels, K.registered(spark, "labels", inputs, lambda: labels.select("label").distinct(), key="label", text="label")


#: The predicates of this concept graph are '{subj} verb {obj}', so a sentence is two replacements.
ANSWER_TEXTS = f"""{LABELLED}, st AS (SELECT s, p, o, label_s, label_o,
 CASE WHEN contains(label_s, label_o) AND label_s <> label_o AND false THEN '' ELSE replace(replace(p, '{{subj}}', rtrim(ltrim(label_s, '.'), '.')), '{{obj}}', rtrim(ltrim(label_o, '.'), '.')) END AS sentence FROM l),
texts AS (SELECT DISTINCT s, p, o, sentence, text FROM (SELECT s, p, o, sentence, unnest([sentence, label_s, label_o]) AS text FROM st)),
first AS (SELECT text, s, p, o, min(sentence) AS sentence FROM texts GROUP BY text, s, p, o)"""


def answers_sql(threshold: float, asked: str = Q_SQL) -> str:
    """CTEs up to an(qid, rank, abstract, sentence, confidence, s, p, o), the answers from the graph of one concept."""
    return f"""{ANSWER_TEXTS}, {tfidf_sql('SELECT DISTINCT text AS key, text FROM first', asked)},
hits AS (SELECT qid, f.text AS abstract, f.sentence, similarity AS confidence, f.s, f.p, f.o FROM first f JOIN sim ON sim.key = f.text WHERE similarity >= {threshold}),
bt AS (SELECT qid, s, p, o, confidence, abstract, sentence FROM hits QUALIFY row_number() OVER (PARTITION BY qid, s, p, o ORDER BY confidence DESC, abstract DESC, sentence DESC) = 1),
bs AS (SELECT * FROM bt QUALIFY row_number() OVER (PARTITION BY qid, sentence ORDER BY confidence DESC, abstract DESC, s DESC, p DESC, o DESC) = 1),
an AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY confidence DESC, sentence DESC) AS INTEGER) AS rank, abstract, sentence, confidence, s, p, o FROM bs)"""


@query(f"{answers_sql(0.1)} SELECT qid, rank, abstract, sentence, confidence, s, p, o FROM an")
def answers(spark, sf):
    """From a seed concept to ranked answers: closure, edges, labels, sentences, scores, two deduplications."""
    return qa.answers(answer_index(spark, sf), questions(spark))


WORDS = "tokens AS (SELECT conv_id AS cluster, turn AS sent, pos, word FROM (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]'), lambda x: x <> '')) AS word, unnest(range(len(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9]'), lambda x: x <> '')))) AS pos FROM conversations))"


def conversation_tokens(spark, sf):
    from tesserae.functions.text import tokens

    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("cluster"), F.col("turn").alias("sent"), F.posexplode(tokens(F.col("text"))).alias("pos", "word"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {WORDS} SELECT cluster, sent, pos, word, coalesce(lag(word) OVER w, '-') AS before, coalesce(lead(word) OVER w, '-') AS after FROM tokens WINDOW w AS (PARTITION BY cluster, sent ORDER BY pos)")
def neighbour_context(spark, sf):
    return summary.neighbour_context(conversation_tokens(spark, sf))


@query(f"WITH {WORDS} SELECT word, count(*) AS n, count(DISTINCT cluster) AS n_clusters FROM tokens GROUP BY word")
def term_freq(spark, sf):
    return conversation_tokens(spark, sf).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("n_clusters"))


CO = f"WITH {WORDS}, co AS (SELECT least(x.word, y.word) AS a, greatest(x.word, y.word) AS b, count(*) AS weight FROM tokens x JOIN tokens y ON x.cluster = y.cluster AND x.sent = y.sent AND y.pos > x.pos AND y.pos - x.pos <= 2 WHERE x.word <> y.word GROUP BY 1, 2)"


def cooccurring(spark, sf):
    t = conversation_tokens(spark, sf).withColumn("sent", F.concat_ws("/", "cluster", "sent"))
    return summary.cooccurrence(t, window=2)


@query(f"{CO} SELECT a, b, weight FROM co")
def cooccurrence(spark, sf):
    return cooccurring(spark, sf)


def _rounds(n: int) -> str:
    out = "s0 AS (SELECT DISTINCT a AS word, 1.0::DOUBLE AS score FROM sh)"
    for k in range(n):
        out += f", s{k + 1} AS (SELECT b AS word, 0.15 + 0.85 * sum(share * score) AS score FROM sh JOIN s{k} ON a = word GROUP BY b)"
    return out


@query(f"""{CO}, both_ways AS (SELECT a, b, weight FROM co UNION ALL SELECT b, a, weight FROM co), t AS (SELECT a, sum(weight) AS total FROM both_ways GROUP BY a),
sh AS (SELECT a, b, CAST(weight AS DOUBLE) / total AS share FROM both_ways JOIN t USING (a)), {_rounds(3)} SELECT word, round(score, 5) AS score FROM s3""")
def textrank_3iter(spark, sf):
    return summary.textrank(written(cooccurring(spark, sf)), rounds=3, tolerance=None).select("word", F.round("score", 5).alias("score"))


PART_WORDS = "tokens AS (SELECT cluster, sent, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT p_brand AS cluster, p_partkey AS sent, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part))"


def part_tokens(spark, sf):
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    return table(spark, sf, "part").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("sent"), F.posexplode(words).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {PART_WORDS}, f AS (SELECT cluster, word, count(*) AS f FROM tokens GROUP BY ALL),
e AS (SELECT DISTINCT x.cluster, x.word AS a, y.word AS b FROM tokens x JOIN tokens y ON x.cluster = y.cluster AND x.sent = y.sent AND y.pos = x.pos + 1),
d AS (SELECT x.cluster, x.sent, x.word AS a, y.word AS b, min(y.pos - x.pos) AS d FROM tokens x JOIN tokens y ON x.cluster = y.cluster AND x.sent = y.sent AND y.pos > x.pos GROUP BY ALL),
c AS (SELECT cluster, a, b, sum(1.0::DOUBLE / d) AS c FROM d GROUP BY ALL)
SELECT cluster, a, b, round((fa.f + fb.f) / c / (fa.f * fb.f), 6) AS weight FROM e JOIN c USING (cluster, a, b) JOIN f fa ON fa.cluster = e.cluster AND fa.word = a JOIN f fb ON fb.cluster = e.cluster AND fb.word = b""".replace("SELECT cluster, a, b, round(", "SELECT e.cluster, a, b, round("))
def word_graph_weights(spark, sf):
    return summary.edge_weights(part_tokens(spark, sf)).withColumn("weight", F.round("weight", 6))


@query()
def k_paths(spark, sf):
    tagged = part_tokens(spark, sf).withColumn("tag", F.when(F.col("pos") == 1, "NN").when(F.col("pos") == 0, "VB").otherwise("JJ"))
    keyed = tagged.withColumn("cluster", F.expr("cast(regexp_replace(cluster, '[^0-9]', '') as long)"))
    return summary.k_shortest_paths(keyed, k=3, min_words=2).withColumn("cost", F.round("cost", 6))


@query(f"""WITH {WORDS}, o AS (SELECT *, length(word) > 3 AS ok FROM tokens), g AS (SELECT *, pos - sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY cluster, sent ORDER BY pos) AS island FROM o)
SELECT cluster, sent, min(pos) AS start, string_agg(word, ' ' ORDER BY pos) AS words FROM g WHERE ok GROUP BY cluster, sent, island""")
def keyphrase_runs(spark, sf):
    return summary.runs(conversation_tokens(spark, sf), F.length("word") > 3)


def _tree() -> str:
    first = "CASE WHEN right(p_name, 1) = '.' THEN '' ELSE '.' END"
    return f"""WITH l0 AS (SELECT p_brand AS key, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, upper(p_name[1]) || p_name[2:] || {first} AS text FROM part),
l1 AS (SELECT key, pos // 3 AS pos, string_agg(text, ' | ' ORDER BY pos) AS text FROM l0 GROUP BY key, pos // 3),
l2 AS (SELECT key, pos // 3 AS pos, string_agg(text, ' | ' ORDER BY pos) AS text FROM l1 GROUP BY key, pos // 3)
SELECT key, 0 AS level, pos, pos // 3 AS parent_pos, text FROM l0 UNION ALL SELECT key, 1, pos, pos // 3, text FROM l1 UNION ALL SELECT key, 2, pos, pos // 3, text FROM l2"""


@query(_tree())
def tree_reduce(spark, sf):
    leaves = graph_positions(table(spark, sf, "part").select(F.col("p_brand").alias("key"), "p_partkey", F.col("p_name").alias("text")))
    return summary.tree_reduce(leaves, arity=3, depth=2, merge=lambda texts: F.array_join(texts, " | "))


def graph_positions(rows):
    from tesserae.operators.graph import ordered_ranks

    return ordered_ranks(rows, ["key"], [F.col("p_partkey")]).select("key", (F.col("ord") - 1).alias("pos"), "text")


LAB = f"lab AS (SELECT s AS node, o AS label FROM triples WHERE p = '{V.LABEL}')"


def _again(sql: str) -> str:
    """CTEs of tfidf_sql() under other names, to stand beside the first ones."""
    return re.sub(r"\b(tok|tf|n|df|raw|nrm|w|q|qt|qr|qn|sim)\b", r"\1_2", sql)


@query(f"""{SUB}, {LAB}, {tfidf_sql('SELECT DISTINCT label AS key, label AS text FROM lab')},
al AS (SELECT qid, node AS seed FROM sim JOIN lab ON lab.label = sim.key WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, node DESC) = 1),
fo(seed, node) AS (SELECT DISTINCT seed, seed FROM al UNION SELECT fo.seed, sub.s FROM fo JOIN sub ON sub.o = fo.node), re AS (SELECT DISTINCT s, p, o FROM triples WHERE contains(p, '{{obj}}')),
se AS MATERIALIZED (SELECT DISTINCT seed, s, p, o FROM fo JOIN re ON re.s = fo.node OR re.o = fo.node),
ll AS (SELECT s, p, o, coalesce(a.label, s) AS label_s, coalesce(b.label, o) AS label_o FROM (SELECT DISTINCT s, p, o FROM se WHERE s <> o) t LEFT JOIN lab a ON a.node = t.s LEFT JOIN lab b ON b.node = t.o),
st AS (SELECT s, p, o, label_s, label_o, replace(replace(p, '{{subj}}', rtrim(ltrim(label_s, '.'), '.')), '{{obj}}', rtrim(ltrim(label_o, '.'), '.')) AS sentence FROM ll),
fi AS MATERIALIZED (SELECT text, s, p, o, min(sentence) AS sentence FROM (SELECT s, p, o, sentence, unnest([sentence, label_s, label_o]) AS text FROM st) WHERE text <> '' GROUP BY text, s, p, o),
{_again(tfidf_sql('SELECT DISTINCT text AS key, text FROM fi'))},
hi AS (SELECT qid, fi.text AS abstract, fi.sentence, similarity AS confidence, s, p, o FROM fi JOIN sim_2 ON sim_2.key = fi.text JOIN se USING (s, p, o) JOIN al USING (qid, seed) WHERE similarity >= 0.1),
bs AS (SELECT * FROM hi QUALIFY row_number() OVER (PARTITION BY qid, sentence ORDER BY confidence DESC, abstract DESC, s DESC, p DESC, o DESC) = 1)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY confidence DESC, sentence DESC) AS INTEGER) AS rank, abstract, sentence, confidence, s, p, o FROM bs""")
def ask(spark, sf):
    """Questions to ranked answers by the concepts that they name."""
    t = V.from_tables(spark, sf)
    return qa.ask(t, *node_labels(spark, sf, t), questions(spark), concept_threshold=0.3)


@query(f"""{TRIPLES}, {LAB}, {tfidf_sql('SELECT DISTINCT label AS key, label AS text FROM lab')},
c AS (SELECT qid, node AS concept, label, similarity FROM sim JOIN lab ON lab.label = sim.key WHERE similarity >= 0.3)
SELECT qid, concept, label, similarity, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, concept DESC) AS INTEGER) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, concept DESC) <= 3""")
def concept_alignment(spark, sf):
    t = V.from_tables(spark, sf)
    return qa.align(*node_labels(spark, sf, t), questions(spark), 0.3, 3)


# fixed values: what an overview of a concept asks
OVERVIEW = ["what is {concept}", "who places an order in {concept}", "how is {concept} supplied", "where does {concept} lie", "why does {concept} contain it"]


@query("SELECT 'nation:' || n_nationkey AS concept, k AS qid, replace(q, '{concept}', n_name) AS question FROM nation, (SELECT unnest(range(5)) AS k, unnest([" + ", ".join(f"'{x}'" for x in OVERVIEW) + "]) AS q)")
def overview_questions(spark, sf):
    concepts = table(spark, sf, "nation").select(F.expr("'nation:' || n_nationkey").alias("concept"), F.col("n_name").alias("label"))
    return qa.fill_templates(OVERVIEW, concepts).withColumn("qid", F.col("qid").cast("long"))


_OVERVIEW_SQL = "q(qid, question) AS (VALUES " + ", ".join(f"({i}, '{x.replace('{concept}', 'the region')}')" for i, x in enumerate(OVERVIEW)) + ")"


@query(f"{answers_sql(0.02, _OVERVIEW_SQL)} SELECT qid, rank, abstract, sentence, confidence, s, p, o FROM an")
def concept_overview(spark, sf):
    """Answers to the overview questions of one concept over its graph."""
    asked = qa.fill_templates(OVERVIEW, spark.createDataFrame([("region:0", "the region")], "concept string, label string")).select("qid", "question")
    return qa.answers(answer_index(spark, sf), asked, threshold=0.02)


@query(f"{answers_sql(0.1)} SELECT qid, CAST(to_json(list({{'rank': rank, 'abstract': abstract, 'sentence': sentence, 'confidence': confidence, 'triple': [s, p, o]}} ORDER BY rank)) AS VARCHAR) AS json FROM an GROUP BY qid")
def answers_json(spark, sf):
    return qa.answers_json(answers(spark, sf))


@query("""WITH p AS (SELECT string_agg(n, '|' ORDER BY length(n) DESC, n) AS pattern FROM (SELECT DISTINCT lower(p_name) AS n FROM part WHERE split_part(p_name, ' ', -1) = (SELECT min(split_part(p_name, ' ', -1)) FROM part)))
SELECT p_partkey, regexp_replace(lower(p_name || ' and ' || p_type), pattern, (SELECT min(split_part(p_name, ' ', -1)) FROM part), 'g') AS text FROM part, p""")
def subclass_replacer(spark, sf):
    t = V.from_tables(spark, sf)
    part = table(spark, sf, "part")
    noun = part.agg(F.min(F.expr("substring_index(p_name, ' ', -1)"))).first()[0]
    texts = part.select("p_partkey", F.lower(F.concat("p_name", F.lit(" and "), "p_type")).alias("text"))
    return qa.replace_subclasses(texts, t, f"noun:{noun}", F.substring_index("node", ":", -1)).select("p_partkey", "text")


@query("""WITH l AS (SELECT p_brand AS key, p_partkey, p_name, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)
SELECT key, p_partkey, p_name FROM l WHERE n <= 2 OR k <= ceil(n / 3.0)""")
def cut_factor(spark, sf):
    return summary.cut_levels(table(spark, sf, "part").select(F.col("p_brand").alias("key"), "p_partkey", "p_name"), "key", "p_partkey", 3.0)


@query("""WITH r AS (SELECT conv_id AS question, turn, text AS sentence FROM conversations), t AS (SELECT DISTINCT text AS sentence FROM conversations)
SELECT t.sentence, question, turn FROM t LEFT JOIN r USING (sentence)""")
def tree_leaf_answers(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("question"), "turn", F.col("text").alias("sentence"))
    leaves = rows.select("sentence").distinct().withColumn("level", F.lit(0))
    return summary.attach_answers(leaves, rows).select("sentence", "question", "turn")


PHRASES = f"""{PART_WORDS}, ph AS (SELECT DISTINCT words FROM (SELECT cluster, sent, string_agg(word, ' ' ORDER BY pos) AS words FROM tokens GROUP BY cluster, sent))"""


def phrases(spark, sf):
    return summary.runs(part_tokens(spark, sf), F.lit(True)).select("words").distinct()


@query(f"""WITH {PART_WORDS}, f AS (SELECT cluster, word AS phrase, CAST(count(*) AS DOUBLE) AS score FROM tokens GROUP BY ALL), c AS (SELECT p_brand AS cluster, lower(p_name || ' ' || p_type) AS words, CAST(p_size AS DOUBLE) AS cost FROM part),
t AS (SELECT cluster, words, sum(score) AS total FROM (SELECT DISTINCT cluster, words FROM c) JOIN f USING (cluster) WHERE contains(words, phrase) GROUP BY ALL),
s AS (SELECT cluster, words, cost, round(cost / (len(string_split(words, ' ')) * (1 + coalesce(total, 0))), 9) AS score FROM c LEFT JOIN t USING (cluster, words))
SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score, words, cost) AS INTEGER) AS rank FROM s""")
def reranked(spark, sf):
    """Candidates of each brand by their cost for each word and by the weight of the words in them."""
    candidates = table(spark, sf, "part").select(F.col("p_brand").alias("cluster"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("words"), F.col("p_size").cast("double").alias("cost"))
    scores = part_tokens(spark, sf).groupBy("cluster", F.col("word").alias("phrase")).agg(F.count("*").cast("double").alias("score"))
    return summary.rerank(candidates, scores)


@query(f"WITH {PHRASES}, f AS (SELECT word, count(*) AS n FROM tokens GROUP BY word), u AS (SELECT words, unnest(string_split(words, ' ')) AS word FROM ph) SELECT words, round(sum(CAST(n AS DOUBLE)) / (count(*) + 1), 6) AS score FROM u JOIN f USING (word) GROUP BY words")
def keyphrase_scores(spark, sf):
    scores = part_tokens(spark, sf).groupBy("word").agg(F.count("*").cast("double").alias("score"))
    return summary.phrase_scores(phrases(spark, sf), scores).withColumn("score", F.round("score", 6))


@query(f"""WITH {PHRASES}, x AS (SELECT words FROM ph UNION SELECT DISTINCT word FROM tokens), s AS (SELECT words, list_sort(list_distinct(string_split(words, ' '))) AS st FROM x)
SELECT a.words, b.words AS head FROM s a JOIN s b ON list_has_all(b.st, a.st) QUALIFY row_number() OVER (PARTITION BY a.words ORDER BY len(b.st) DESC, b.words) = 1""")
def keyphrase_clusters(spark, sf):
    words = part_tokens(spark, sf).select(F.col("word").alias("words"))
    return summary.phrase_clusters(phrases(spark, sf).unionByName(words))
