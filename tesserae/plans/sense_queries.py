"""Queries of sense tagging: the words of conversations, with benchmark passages as glosses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.text import word_tokens
from tesserae.operators import senses as S
from tesserae.plans.registry import query, table

TOKENS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"

_LESK = f"""gl AS (SELECT item_id AS sense, text AS gloss FROM benchmark), se AS (SELECT DISTINCT sense, unnest({TOKENS.format(x='gloss')}) AS lemma FROM gl),
tx AS (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL), wv AS (SELECT text, term, count(*) AS n FROM (SELECT text, unnest({TOKENS.format(x='text')}) AS term FROM tx) GROUP BY ALL),
gv AS (SELECT sense, term, count(*) AS n FROM (SELECT sense, unnest({TOKENS.format(x='gloss')}) AS term FROM gl) GROUP BY ALL),
wn AS (SELECT text, sqrt(sum(n * n)) AS norm FROM wv GROUP BY text), gn AS (SELECT sense, sqrt(sum(n * n)) AS norm FROM gv GROUP BY sense),
ds AS (SELECT w.text, g.sense, sum(w.n * g.n) / (any_value(wn.norm) * any_value(gn.norm)) AS c FROM wv w JOIN gv g USING (term) JOIN wn ON wn.text = w.text JOIN gn ON gn.sense = g.sense GROUP BY ALL),
bs AS (SELECT wv.text, se.lemma, se.sense, round(coalesce(ds.c, 0), 6) AS similarity FROM wv JOIN se ON se.lemma = wv.term LEFT JOIN ds ON ds.text = wv.text AND ds.sense = se.sense
 QUALIFY row_number() OVER (PARTITION BY wv.text, se.lemma ORDER BY round(coalesce(ds.c, 0), 6) DESC, se.sense) = 1)"""


def tagged(spark, sf):
    glosses = table(spark, sf, "benchmark").select(F.col("item_id").alias("sense"), F.col("item_id").alias("ord"), F.col("text").alias("gloss"))
    senses = glosses.withColumn("lemma", F.explode(F.array_distinct(word_tokens(F.col("gloss")))))
    return S.cosine_lesk(table(spark, sf, "conversations"), senses)


@query(f"WITH {_LESK} SELECT text, lemma, sense, similarity FROM bs")
def cosine_lesk(spark, sf):
    """The sense of each word of each sentence that has any."""
    return tagged(spark, sf)


@query(f"WITH {_LESK} SELECT DISTINCT 'my:' || lemma AS s, 'my:inSynset' AS p, 'wn:' || sense AS o FROM bs")
def synset_edges(spark, sf):
    """The triples that the senses give."""
    found = tagged(spark, sf)
    return S.synset_edges(found, found)
