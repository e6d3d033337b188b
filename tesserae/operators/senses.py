"""Senses of words by the likeness of their glosses to the sentence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.text import word_tokens
from tesserae.operators.concepts import concept_uri
from tesserae.sources import triples as V
from tesserae.sources.scratch import small, written


def _vectors(texts: DataFrame, key: str, text: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """(key, term, n, norm): how often each term is in a text, and the length of all these counts."""
    counts = texts.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    return counts.withColumn("norm", F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)).cast("double")))


def _meetings(words: DataFrame, own: DataFrame, known: DataFrame) -> tuple[int, int]:
    """How often a word of a sentence is one of a gloss, and how many words the glosses of its words' senses have (at most)."""
    often = written(words.groupBy("term").agg(F.count("*").alias("w")))
    by_term = often.join(own.groupBy("term").agg(F.count("*").alias("g")), "term")
    by_sense = often.withColumnRenamed("term", "lemma").join(known, "lemma").join(own.groupBy("sense").agg(F.count("*").alias("g")), "sense")
    return tuple(x.agg(F.coalesce(F.sum(F.col("w") * F.col("g")), F.lit(0))).first()[0] for x in (by_term, by_sense))


def cosine_lesk(sentences: DataFrame, senses: DataFrame, tokens: Callable[[Column], Column] = word_tokens, stop_words: DataFrame | None = None) -> DataFrame:
    """(text, lemma, sense, similarity): for each word of a sentence that has senses, the one whose gloss is most like it.

    sentences: (text); senses: (lemma, sense, ord, gloss), ord being the order of a lemma's senses, a sense of several
    lemmas having one gloss. Likeness is the cosine of the counts of terms; of equal ones, and where no term is
    shared, the sense that comes first is taken. A sentence is decided once, however often it stands there. Stop words
    (stop) have no sense, but count as context. Null texts have no words.
    """
    distinct = sentences.select("text").filter("text is not null").distinct().withColumn("sid", F.monotonically_increasing_id())
    rows = written(distinct)
    words = written(_vectors(rows, "sid", "text", tokens))
    glosses = senses.groupBy("sense").agg(F.min("gloss").alias("gloss"))
    own = written(_vectors(glosses, "sense", "gloss", tokens))
    lemmas = words.select("sid", F.col("term").alias("lemma"))
    if stop_words is not None:
        lemmas = lemmas.join(small(stop_words.select(F.col("stop").alias("lemma"))), "lemma", "left_anti")
    known = small(written(senses.groupBy("lemma", "sense").agg(F.min("ord").alias("ord"))))
    candidates = lemmas.join(known, "lemma")
    glossed = small(own.withColumnRenamed("n", "gloss_n").withColumnRenamed("norm", "gloss_norm"))
    cosine = F.sum(F.col("n") * F.col("gloss_n")) / (F.max("norm") * F.max("gloss_norm"))
    shared, asked = _meetings(words, own, known)
    if shared <= asked:
        # a sentence's words lie in one place, where what they share with each gloss adds up before anything is shuffled
        met = words.repartition("sid").join(glossed, "term")
    else:
        # a sentence meets a gloss once, whatever number of its words have that sense
        met = written(candidates.select("sid", "sense").distinct()).join(glossed, "sense").join(words, ["sid", "term"])
    alike = met.groupBy("sid", "sense").agg(cosine.alias("similarity"))
    scored = candidates.join(alike, ["sid", "sense"], "left").withColumn("similarity", F.round(F.coalesce("similarity", F.lit(0.0)), 6))
    best = scored.groupBy("sid", "lemma").agg(F.max_by(F.struct("sense", "similarity"), F.struct("similarity", -F.col("ord"), -F.xxhash64("sense"))).alias("b"))
    return best.join(rows, "sid").select("text", "lemma", "b.sense", "b.similarity")


def synset_edges(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(s, p, o): the senses of the nodes of sentences; nodes: (text, lemma), found as cosine_lesk() gives it."""
    both = nodes.select("text", "lemma").distinct().join(found, ["text", "lemma"])
    return both.select(concept_uri(F.col("lemma")).alias("s"), F.lit(V.IN_SYNSET).alias("p"), F.concat(F.lit("wn:"), F.col("sense").cast("string")).alias("o")).distinct()
