"""Queries of concept extraction, over sentences that a rule makes of the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import concepts as C
from tesserae.operators import extract
from tesserae.plans.registry import query, table
from tesserae.sources.scratch import written

# (condition, key, text, lemma, part of speech, dependency, key of the head, key of the noun chunk), SQL of both engines
_WORDS = [
    ("true", "d1", "'The'", "'the'", "DET", "'det'", "'s'", "s"),
    ("true", "a", "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 1)", "ADJ", "'amod'", "'s'", "s"),
    ("true", "s", "split_part(p_name, ' ', 2)", "split_part(p_name, ' ', 2)", "NOUN", "CASE WHEN p_size % 3 = 0 THEN 'nsubjpass' ELSE 'nsubj' END", "'v'", "s"),
    # two subjects; a clause about the subject
    ("p_size % 7 = 0", "sk", "'and'", "'and'", "CCONJ", "'cc'", "'s'", None),
    ("p_size % 7 = 0", "s2", "'kits'", "'kit'", "NOUN", "'conj'", "'s'", "s2"),
    ("p_size % 11 = 0", "rs", "'that'", "'that'", "PRON", "'nsubj'", "'rv'", None),
    ("p_size % 11 = 0", "rv", "'holds'", "'hold'", "VERB", "'relcl'", "'s'", None),
    ("p_size % 11 = 0", "ro", "'water'", "'water'", "NOUN", "'dobj'", "'rv'", "ro"),
    ("p_size % 3 = 0", "x", "'is'", "'be'", "AUX", "'auxpass'", "'v'", None),
    ("true", "v", "CASE WHEN p_size % 3 = 0 THEN 'joined' ELSE 'joins' END", "'join'", "VERB", "'ROOT'", "'v'", None),
    ("p_size % 2 = 0", "n", "'never'", "'never'", "ADV", "'neg'", "'v'", None),
    ("p_size % 3 = 0", "b", "'by'", "'by'", "ADP", "'prep'", "'v'", None),
    ("true", "d2", "'the'", "'the'", "DET", "'det'", "'o'", "o"),
    ("true", "c", "p_type", "lower(p_type)", "NOUN", "'compound'", "'o'", "o"),
    ("true", "o", "'parts'", "'part'", "NOUN", "CASE WHEN p_size % 3 = 0 THEN 'pobj' ELSE 'dobj' END", "CASE WHEN p_size % 3 = 0 THEN 'b' ELSE 'v' END", "o"),
    ("true", "f", "'of'", "'of'", "ADP", "'prep'", "'o'", None),
    ("true", "p", "p_brand", "p_brand", "PROPN", "'pobj'", "'f'", "p"),
    ("p_size % 5 = 0", "k", "'and'", "'and'", "CCONJ", "'cc'", "'p'", None),
    ("p_size % 5 = 0", "j", "'others'", "'other'", "NOUN", "'conj'", "'p'", "j"),
    # an adverbial; a second verb with an object of its own
    ("p_size % 4 = 1", "l", "'in'", "'in'", "ADP", "'prep'", "'v'", None),
    ("p_size % 4 = 1", "lo", "'stores'", "'store'", "NOUN", "'pobj'", "'l'", "lo"),
    ("p_size % 13 < 2", "vk", "'and'", "'and'", "CCONJ", "'cc'", "'v'", None),
    ("p_size % 13 < 2", "v2", "'moves'", "'move'", "VERB", "'conj'", "'v'", None),
    ("p_size % 13 < 2", "o2", "'tools'", "'tool'", "NOUN", "'dobj'", "'v2'", "o2"),
    ("true", "z", "'.'", "'.'", "PUNCT", "'punct'", "'v'", None),
]
_FIELDS = ("k", "text", "lemma", "pos", "dep", "hk", "ck")


def _values(row: tuple) -> list[str]:
    _, k, text, lemma, pos, dep, hk, ck = row
    return [f"'{k}'", text, lemma, f"'{pos}'", dep, hk, "CAST(NULL AS STRING)" if ck is None else f"'{ck}'"]


def _sql_struct(row: tuple) -> str:
    return f"CASE WHEN {row[0]} THEN {{{', '.join(f'{n}: {v}' for n, v in zip(_FIELDS, _values(row), strict=True))}}} END"


def _spark_struct(row: tuple) -> str:
    inside = ", ".join(f"'{n}', {v}" for n, v in zip(_FIELDS, _values(row), strict=True))
    return f"CASE WHEN {row[0]} THEN named_struct({inside}) END"


def tokens(spark, sf):
    """(sent_id, i, idx, text, lemma, pos, dep, head, chunk) of one sentence for each part."""
    words = "filter(array(" + ", ".join(map(_spark_struct, _WORDS)) + "), x -> x is not null)"
    # parts are dealt before they grow to some twenty words each, which are written once
    rows = table(spark, sf, "part").repartition("p_partkey").select(F.col("p_partkey").alias("sent_id"), F.expr(words).alias("w"))
    rows = rows.select("sent_id", "w", F.expr("transform(w, x -> x.k)").alias("keys"), F.posexplode("w").alias("i", "t"))
    place = lambda k: F.array_position("keys", F.col(k)).cast("int") - 1
    idx = F.expr("cast(aggregate(slice(w, 1, i), 0, (n, x) -> n + length(x.text) + 1) as int)")
    rows = written(rows.select("sent_id", "i", idx.alias("idx"), "t.text", "t.lemma", "t.pos", "t.dep", place("t.hk").alias("head"), place("t.ck").alias("chunk")))
    return written(C.resolved_dependencies(rows))


_TOK = f"""w AS (SELECT p_partkey AS sent_id, list_filter([{', '.join(map(_sql_struct, _WORDS))}], lambda x: x IS NOT NULL) AS w FROM part),
q AS (SELECT sent_id, w, list_transform(w, lambda x: x.k) AS keys, unnest(range(len(w))) AS i FROM w),
tok AS (SELECT sent_id, CAST(i AS INTEGER) AS i, CAST(coalesce(list_sum(list_transform(w[1:i], lambda x: length(x.text) + 1)), 0) AS INTEGER) AS idx, w[i + 1].text AS text, w[i + 1].lemma AS lemma, w[i + 1].pos AS pos, w[i + 1].dep AS dep,
  CAST(list_position(keys, w[i + 1].hk) - 1 AS INTEGER) AS head, CAST(list_position(keys, w[i + 1].ck) - 1 AS INTEGER) AS chunk FROM q),
up(sent_id, i, ancestor, distance) AS (SELECT sent_id, i, head, 1 FROM tok WHERE i <> head UNION ALL SELECT up.sent_id, up.i, tok.head, distance + 1 FROM up JOIN tok ON tok.sent_id = up.sent_id AND tok.i = up.ancestor WHERE tok.i <> tok.head),
own AS (SELECT * FROM up UNION ALL SELECT sent_id, i, i, 0 FROM tok),
near AS (SELECT up.sent_id, up.i, arg_min(t.dep, distance) AS rdep FROM up JOIN tok t ON t.sent_id = up.sent_id AND t.i = ancestor AND t.dep <> 'conj' GROUP BY ALL),
rt AS (SELECT tok.*, CASE WHEN dep = 'conj' THEN near.rdep ELSE dep END AS rdep FROM tok LEFT JOIN near USING (sent_id, i)),
core AS (SELECT sent_id, i FROM rt WHERE regexp_matches(rdep, '{C.SUBJECT}|{C.OBJECT}') OR (rdep = 'ROOT' AND pos = 'NOUN'))"""
_LEMMA = f"coalesce(lower(string_agg(lemma, ' ' ORDER BY i) FILTER (WHERE pos NOT IN {C.NO_LEMMA} AND lemma <> '{C.PRONOUN}')), '')"
_TEXT = "lower(replace(string_agg(text, ' ' ORDER BY i), ' - ', ''))"
_CONCEPTS = f"""{_TOK},
sp(sent_id, core, i, a, e, g) AS (SELECT sent_id, i, i, true, true, true FROM core UNION ALL SELECT sp.sent_id, core, t.i, a AND dep <> 'conj' AND regexp_matches(rdep, '{C.MODIFIER}'), e AND dep <> 'conj' AND regexp_matches(rdep, '{C.EXTENDED}'), g AND dep <> 'conj' AND regexp_matches(rdep, '{C.GROUP}')
  FROM sp JOIN rt t ON t.sent_id = sp.sent_id AND t.head = sp.i AND t.i <> t.head),
kd AS (SELECT sent_id, core, core AS i, 0 AS kind FROM sp WHERE i = core UNION ALL SELECT sent_id, core, i, 1 FROM sp WHERE a UNION ALL SELECT core.sent_id, core.i, x.i, 2 FROM core JOIN rt y ON y.sent_id = core.sent_id AND y.i = core.i JOIN rt x ON x.sent_id = y.sent_id AND x.chunk = y.chunk
  UNION ALL SELECT sent_id, core, i, 3 FROM sp WHERE e UNION ALL SELECT sent_id, core, i, 4 FROM sp WHERE g UNION ALL SELECT sent_id, core, i, 5 FROM sp),
kt AS (SELECT kd.*, idx, text, lemma, pos, rdep IN {C.CONCEPT_ENDS} AS noise FROM kd JOIN rt USING (sent_id, i)),
ke AS (SELECT sent_id, core, kind, min(i) AS lo, max(i) AS hi FROM kt WHERE NOT noise GROUP BY ALL),
ks AS (SELECT sent_id, core, kind, list(i ORDER BY i) AS span, list(idx ORDER BY i) AS idx, {_TEXT} AS text, {_LEMMA} AS lemma FROM kt JOIN ke USING (sent_id, core, kind) WHERE i BETWEEN lo AND hi GROUP BY ALL),
ko AS (SELECT * FROM ks QUALIFY row_number() OVER (PARTITION BY sent_id, core, span ORDER BY kind) = 1),
kr AS (SELECT *, row_number() OVER r - 1 AS rank, list(text) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS smaller FROM ko WINDOW r AS (PARTITION BY sent_id, core ORDER BY len(span), length(text), kind)),
cc AS (SELECT sent_id, core, CAST(rank AS INTEGER) AS rank, text, lemma, idx, span, CASE WHEN rank > 1 THEN list_reverse(smaller) WHEN rank = 1 THEN smaller ELSE [text] END AS chain FROM kr),
cl AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY sent_id, text, idx ORDER BY core, rank) = 1)"""
_PREDICATES = f"""{_CONCEPTS},
mt AS (SELECT x.sent_id, x.i AS a, y.i AS b, oa.distance AS da, ob.distance AS db, oa.ancestor AS meet FROM core x JOIN core y ON x.sent_id = y.sent_id AND x.i < y.i JOIN own oa ON oa.sent_id = x.sent_id AND oa.i = x.i JOIN own ob ON ob.sent_id = y.sent_id AND ob.i = y.i AND ob.ancestor = oa.ancestor),
bs AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY sent_id, a, b ORDER BY da + db, meet) = 1),
pa AS (SELECT bs.sent_id, a, b, own.ancestor AS i FROM bs JOIN own ON own.sent_id = bs.sent_id AND own.i = a AND distance <= da UNION SELECT bs.sent_id, a, b, own.ancestor FROM bs JOIN own ON own.sent_id = bs.sent_id AND own.i = b AND distance <= db),
pt AS (SELECT pa.* FROM pa WHERE i <> a AND i <> b AND NOT EXISTS (SELECT 1 FROM pa z JOIN core ON core.sent_id = z.sent_id AND core.i = z.i WHERE z.sent_id = pa.sent_id AND z.a = pa.a AND z.b = pa.b AND z.i <> z.a AND z.i <> z.b)),
mk AS (SELECT *, true AS mark FROM pt UNION ALL SELECT sent_id, a, b, unnest([a, b]), false FROM (SELECT DISTINCT sent_id, a, b FROM pt)),
ins AS (SELECT mk.sent_id, a, b, own.i, arg_min(mark, distance) AS inside, min(distance) AS distance FROM mk JOIN own ON own.sent_id = mk.sent_id AND own.ancestor = mk.i GROUP BY ALL),
tu AS (SELECT ins.*, CASE WHEN regexp_matches(ra.rdep, '{C.OBJECT}') <> regexp_matches(rb.rdep, '{C.OBJECT}') THEN regexp_matches(ra.rdep, '{C.OBJECT}') WHEN regexp_matches(ra.rdep, '{C.SUBJECT}') <> regexp_matches(rb.rdep, '{C.SUBJECT}') THEN regexp_matches(rb.rdep, '{C.SUBJECT}') ELSE false END AS turned
  FROM ins JOIN rt ra ON ra.sent_id = ins.sent_id AND ra.i = a JOIN rt rb ON rb.sent_id = ins.sent_id AND rb.i = b WHERE inside),
cn AS (SELECT sent_id, CASE WHEN turned THEN b ELSE a END AS subj, CASE WHEN turned THEN a ELSE b END AS obj, i, distance = 0 AS on_path FROM tu),
pw AS (SELECT cn.*, text, lemma, pos, rdep FROM cn JOIN rt USING (sent_id, i)),
wh AS (SELECT sent_id, subj, obj, list(i ORDER BY i) AS span, bool_or(rdep = 'auxpass') AS passive, bool_or(pos = 'VERB') AS verbal FROM pw GROUP BY ALL),
pc AS (SELECT sent_id, subj, obj, {_TEXT} AS core_text, {_LEMMA} AS core_lemma FROM pw WHERE on_path GROUP BY ALL),
al AS (SELECT sent_id, subj, obj, i, text, lemma, pos, rdep FROM pw UNION ALL SELECT wh.sent_id, subj, obj, i, text, lemma, pos, rdep FROM wh JOIN rt ON rt.sent_id = wh.sent_id AND rt.i IN (subj, obj)),
ae AS (SELECT sent_id, subj, obj, min(i) AS lo, max(i) AS hi FROM al WHERE rdep NOT IN {C.PREDICATE_ENDS} GROUP BY ALL),
sg AS (SELECT sent_id, subj, obj, CASE WHEN i < least(subj, obj) THEN 0 WHEN i < greatest(subj, obj) THEN 1 ELSE 2 END AS part, {_TEXT} AS text, {_LEMMA} AS lemma FROM al JOIN ae USING (sent_id, subj, obj) WHERE i BETWEEN lo AND hi AND i <> subj AND i <> obj GROUP BY ALL),
tm AS (SELECT wh.*, core_text, core_lemma, {', '.join(f"concat_ws(' ', (SELECT {c} FROM sg s WHERE s.sent_id = wh.sent_id AND s.subj = wh.subj AND s.obj = wh.obj AND part = 0), CASE WHEN wh.subj < wh.obj THEN '{{subj}}' ELSE '{{obj}}' END, (SELECT {c} FROM sg s WHERE s.sent_id = wh.sent_id AND s.subj = wh.subj AND s.obj = wh.obj AND part = 1), CASE WHEN wh.subj < wh.obj THEN '{{obj}}' ELSE '{{subj}}' END, (SELECT {c} FROM sg s WHERE s.sent_id = wh.sent_id AND s.subj = wh.subj AND s.obj = wh.obj AND part = 2)) AS {c}" for c in ("text", "lemma"))}
  FROM wh JOIN pc USING (sent_id, subj, obj)),
pr AS (SELECT sent_id, subj AS core, 'subj' AS dependency, text AS predicate, lemma AS predicate_lemma, span AS predicate_span FROM tm UNION ALL SELECT sent_id, obj, 'obj', text, lemma, span FROM tm),
cp AS (SELECT cl.*, dependency, predicate, predicate_lemma, predicate_span, len(span) = 1 AND span[1] = core AS at_core FROM cl JOIN pr USING (sent_id, core) WHERE NOT list_has_any(span, predicate_span))"""
_URI = "'my:' || regexp_replace(replace({x}, ' ', '_'), '\\s', '', 'g')"
_FACTS = f"""{_PREDICATES},
lg AS (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY sent_id, predicate, predicate_lemma, predicate_span, dependency, core ORDER BY len(span) DESC, length(text) DESC, rank) = 1),
fa AS (SELECT s.sent_id, s.predicate, s.predicate_lemma, s.text AS st, s.lemma AS sl, s.chain AS sc, o.text AS ot, o.lemma AS ol, o.chain AS oc FROM lg s JOIN lg o ON s.sent_id = o.sent_id AND s.predicate = o.predicate AND s.predicate_lemma = o.predicate_lemma AND s.predicate_span = o.predicate_span WHERE s.dependency = 'subj' AND o.dependency = 'obj'),
ea AS (SELECT sent_id, st AS text, sl AS lemma, sc AS chain FROM fa UNION ALL SELECT sent_id, ot, ol, oc FROM fa UNION ALL SELECT sent_id, predicate, predicate_lemma, NULL FROM fa),
st AS (SELECT chain[k] AS x, chain[k + 1] AS y FROM (SELECT chain, unnest(range(1, len(chain))) AS k FROM ea WHERE len(chain) > 1)),
us AS (SELECT part.* FROM part WHERE p_partkey IN (SELECT sent_id FROM fa))
SELECT DISTINCT * FROM (SELECT {_URI.format(x='sl')} AS s, {_URI.format(x='predicate_lemma')} AS p, {_URI.format(x='ol')} AS o FROM fa
UNION ALL SELECT {_URI.format(x='lemma')}, 'rdfs:label', text FROM ea UNION ALL SELECT {_URI.format(x='lemma')}, 'my:hasSource', '_:source' || sent_id FROM ea
UNION ALL SELECT '_:source' || p_partkey, 'my:content', p_name || ' ' || p_type FROM us UNION ALL SELECT '_:source' || p_partkey, 'my:docID', 'myfile:' || p_brand FROM us
UNION ALL SELECT {_URI.format(x='x')}, 'rdfs:subClassOf', {_URI.format(x='y')} FROM st WHERE {_URI.format(x='x')} <> {_URI.format(x='y')})"""


def cores(t):
    return t.filter(C.is_core_concept()).select("sent_id", "i")


@query(f"WITH RECURSIVE {_TOK} SELECT sent_id, i, idx, text, CASE WHEN pos = 'VERB' THEN text ELSE lemma END AS lemma, pos, dep, rdep, head, coalesce(chunk, -1) AS chunk FROM rt")
def parsed_tokens(spark, sf):
    return tokens(spark, sf).withColumns({"lemma": C.token_lemma(keep_verbs=True), "chunk": F.coalesce("chunk", F.lit(-1))}).select("sent_id", "i", "idx", "text", "lemma", "pos", "dep", "rdep", "head", "chunk")


@query(f"WITH RECURSIVE {_TOK} SELECT sent_id, i FROM core")
def core_concepts(spark, sf):
    return cores(tokens(spark, sf))


_SHOW = "array_to_string(idx, ' ') AS idx, array_to_string(span, ' ') AS span, array_to_string(chain, '|') AS chain"


def _shown(df):
    return df.withColumns({"idx": F.array_join("idx", " "), "span": F.array_join("span", " "), "chain": F.array_join("chain", "|")})


@query(f"WITH RECURSIVE {_CONCEPTS} SELECT sent_id, core, rank, text, lemma, {_SHOW} FROM cc")
def composite_concepts(spark, sf):
    t = tokens(spark, sf)
    return _shown(C.composite_concepts(t, cores(t)))


@query(f"WITH RECURSIVE {_CONCEPTS} SELECT sent_id, core, rank, text, lemma, {_SHOW} FROM cl")
def concept_list(spark, sf):
    t = tokens(spark, sf)
    return _shown(C.concept_list(C.composite_concepts(t, cores(t))))


@query(f"WITH RECURSIVE {_PREDICATES} SELECT sent_id, subj, obj, i, on_path FROM cn")
def grammatical_connections(spark, sf):
    t = tokens(spark, sf)
    return C.grammatical_connections(t, cores(t))


def _templates(t):
    return C.predicate_templates(t, C.grammatical_connections(t, cores(t)))


@query(f"WITH RECURSIVE {_PREDICATES} SELECT sent_id, subj, obj, text, lemma, core_text, core_lemma, array_to_string(span, ' ') AS span, passive, verbal FROM tm")
def predicate_templates(spark, sf):
    return _templates(tokens(spark, sf)).withColumn("span", F.array_join("span", " "))


def _couples(t):
    return C.couple_list(C.concept_list(C.composite_concepts(t, cores(t))), _templates(t))


@query(f"WITH RECURSIVE {_PREDICATES} SELECT sent_id, core, rank, text, dependency, predicate, at_core FROM cp")
def couple_list(spark, sf):
    return _couples(tokens(spark, sf)).select("sent_id", "core", "rank", "text", "dependency", "predicate", "at_core")


@query(f"WITH RECURSIVE {_FACTS}")
def fact_edges(spark, sf):
    sentences = table(spark, sf, "part").select(F.col("p_partkey").alias("sent_id"), F.col("p_brand").alias("doc"), F.concat_ws(" ", "p_name", "p_type").alias("content"))
    return C.fact_edges(_couples(tokens(spark, sf)), sentences)


@query(f"""WITH RECURSIVE {_FACTS} UNION SELECT {_URI.format(x='ea.lemma')}, 'my:inSynset', 'wn:' || ea.lemma || '.n.01' FROM ea JOIN part ON p_partkey = ea.sent_id AND split_part(p_name, ' ', 2) = ea.lemma
UNION SELECT '_:source' || p_partkey, 'my:size', CAST(p_size AS VARCHAR) FROM us""")
def fact_annotations(spark, sf):
    """The facts with the synsets of what is named, and what is known of each sentence besides."""
    part = table(spark, sf, "part")
    sentences = part.select(F.col("p_partkey").alias("sent_id"), F.col("p_brand").alias("doc"), F.concat_ws(" ", "p_name", "p_type").alias("content"))
    lemma = F.split_part("p_name", F.lit(" "), F.lit(2))
    senses = part.select(F.col("p_partkey").alias("sent_id"), lemma.alias("lemma"), F.concat(lemma, F.lit(".n.01")).alias("sense"))
    annotations = part.select(F.col("p_partkey").alias("sent_id"), F.expr("'_:source' || p_partkey").alias("s"), F.lit("my:size").alias("p"), F.col("p_size").cast("string").alias("o"))
    return C.fact_edges(_couples(tokens(spark, sf)), sentences, senses, annotations)


#: Cores by their own dependency alone.
_NAMED = "nc AS (SELECT sent_id, i FROM tok WHERE dep IN ('nsubj', 'nsubjpass', 'dobj', 'pobj'))"


def named_cores(t):
    return t.filter("dep in ('nsubj', 'nsubjpass', 'dobj', 'pobj')").select("sent_id", "i")


@query(f"WITH RECURSIVE {_TOK} SELECT sent_id, i, ancestor, distance FROM up")
def dep_closure(spark, sf):
    return extract.ancestors(tokens(spark, sf))


@query(f"WITH RECURSIVE {_TOK}, {_NAMED} SELECT a.sent_id, a.i AS a, b.i AS b FROM nc a JOIN nc b ON a.sent_id = b.sent_id AND a.i < b.i")
def core_pairs(spark, sf):
    return extract.core_pairs(named_cores(tokens(spark, sf)))


@query(f"""WITH RECURSIVE {_TOK}, {_NAMED}, m AS (SELECT x.sent_id, x.i AS a, y.i AS b, oa.ancestor AS meet, oa.distance AS da, ob.distance AS db FROM nc x JOIN nc y ON x.sent_id = y.sent_id AND x.i < y.i
 JOIN own oa ON oa.sent_id = x.sent_id AND oa.i = x.i JOIN own ob ON ob.sent_id = y.sent_id AND ob.i = y.i AND ob.ancestor = oa.ancestor QUALIFY row_number() OVER (PARTITION BY x.sent_id, x.i, y.i ORDER BY oa.distance + ob.distance, oa.ancestor) = 1),
z AS (SELECT DISTINCT m.sent_id, m.a, m.b FROM m JOIN nc ON nc.sent_id = m.sent_id AND nc.i <> m.a AND nc.i <> m.b JOIN own ON own.sent_id = m.sent_id AND own.ancestor = nc.i AND ((own.i = m.a AND own.distance <= m.da) OR (own.i = m.b AND own.distance <= m.db)))
SELECT m.sent_id, m.a, m.b, meet, da + db AS length FROM m LEFT JOIN z ON z.sent_id = m.sent_id AND z.a = m.a AND z.b = m.b WHERE z.a IS NULL""")
def dep_path(spark, sf):
    t = tokens(spark, sf)
    return extract.paths(t, named_cores(t))


@query(f"""WITH RECURSIVE {_TOK}, c AS (SELECT sent_id, head AS core, i FROM tok WHERE dep IN ('nsubj', 'nsubjpass', 'dobj')), p AS (SELECT sent_id, i AS core, text FROM tok WHERE pos = 'VERB')
SELECT c.sent_id, c.i AS concept, p.text AS predicate FROM c JOIN p ON c.sent_id = p.sent_id AND c.core = p.core WHERE c.i <> p.core""")
def span_overlap_join(spark, sf):
    t = tokens(spark, sf)
    concepts = t.filter("dep in ('nsubj', 'nsubjpass', 'dobj')").select("sent_id", F.col("head").alias("core"), F.col("i").alias("concept"), F.array("i").alias("span"))
    predicates = t.filter("pos = 'VERB'").select("sent_id", F.col("i").alias("core"), F.col("text").alias("predicate"), F.array("i").alias("span"))
    return extract.couples(concepts, predicates)


@query(f"WITH RECURSIVE {_TOK}, e AS (SELECT sent_id, min(i) AS a, max(i) AS b FROM tok WHERE dep NOT IN ('det', 'punct', 'prep') GROUP BY sent_id) SELECT tok.sent_id, i, text FROM tok JOIN e USING (sent_id) WHERE i BETWEEN a AND b")
def span_trim(spark, sf):
    return extract.trim_span(tokens(spark, sf), ["sent_id"], F.col("dep").isin("det", "punct", "prep")).select("sent_id", "i", "text")
