"""Entities merged from triples, their profiles, and templates that match them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.text import word_tokens
from tesserae.operators.sets import concept_set
from tesserae.sources import triples as V
from tesserae.sources.scratch import small, written


def merge_entities(triples: DataFrame) -> DataFrame:
    """(s, p, values): the distinct objects of each subject and predicate, sorted."""
    return triples.groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("values"))


def last_wins(facts: DataFrame, order: list[str]) -> DataFrame:
    """(s, p, o): of each subject and predicate the object that was written last."""
    return facts.groupBy("s", "p").agg(F.max_by("o", F.struct(*order)).alias("o"))


def type_sets(types: DataFrame) -> DataFrame:
    """(types, n_entities): entities by the set of types they have; types: (s, o)."""
    own = types.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("o")), " + ").alias("types"))
    return own.groupBy("types").agg(F.count("*").alias("n_entities"))


def group_by_key(triples: DataFrame, predicate: str, unknown: str = "my:Unknown") -> DataFrame:
    """(group, s): entities under the value of a predicate, those without it under `unknown`."""
    nodes = triples.select("s").distinct()
    own = triples.filter(F.col("p") == predicate).select("s", F.col("o").alias("group")).distinct()
    return nodes.join(own, "s", "left").select(F.coalesce("group", F.lit(unknown)).alias("group"), "s")


def statement_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy(F.substring_index("s", ":", 1).alias("kind"), "p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("n_subjects"))


def dataset_profile(triples: DataFrame) -> DataFrame:
    """One row: statements, entities (subjects), predicates, classes and nodes."""
    base = triples.agg(
        F.count("*").alias("n_statements"),
        F.countDistinct("s").alias("n_entities"),
        F.countDistinct("p").alias("n_predicates"),
        F.countDistinct(F.when(F.col("p") == V.TYPE, F.col("o"))).alias("n_classes"),
    )
    return base.crossJoin(concept_set(triples).agg(F.count("*").alias("n_nodes")))


def match_templates(triples: DataFrame, templates: DataFrame) -> DataFrame:
    """(template, s): entities that have all required predicates; templates: (template, keys).

    A row per key divides: an entity matches if it has as many of a template's keys as those are.
    """
    need = templates.select("template", F.size("keys").alias("needed"), F.explode("keys").alias("p"))
    has = triples.select("s", "p").distinct()
    got = has.join(small(need), "p").groupBy("template", "needed", "s").agg(F.count("*").alias("n"))
    return got.filter("n = needed").select("template", "s")


def prune_templates(templates: DataFrame) -> DataFrame:
    """Drop a template if one of more keys (of as many: a later one) has all of its keys."""
    fewer, more = templates.alias("a"), small(templates).alias("b")
    covers = (F.size(F.array_except("a.keys", "b.keys")) == 0) & ((F.size("a.keys") < F.size("b.keys")) | ((F.size("a.keys") == F.size("b.keys")) & (F.col("a.template") < F.col("b.template"))))
    return fewer.join(more, covers, "left_anti")


def zero_or_one(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes at the end of a property path `?`: the seeds and their direct objects."""
    one = seeds.select(F.col("node").alias("s")).join(edges, "s").select(F.col("o").alias("node"))
    return seeds.select("node").unionByName(one).distinct()


def describe(triples: DataFrame, node: str) -> DataFrame:
    return triples.filter(F.col("s") == node).select("p", "o").distinct()


def link_summary(triples: DataFrame, ranks: DataFrame, node: str, shown: list[str], limit: int | None = None) -> DataFrame:
    """Links out of a node, into it, and its literals, each with the rank of the other end where it has one.

    `shown` predicates count as literals; the rest are links. Sorted by rank, unranked last.
    """
    literal = F.col("p").isin(*shown)
    out = triples.filter((F.col("s") == node) & ~literal).select(F.lit("out").alias("side"), "p", F.col("o").alias("other"))
    into = triples.filter((F.col("o") == node) & ~literal).select(F.lit("in").alias("side"), "p", F.col("s").alias("other"))
    own = triples.filter((F.col("s") == node) & literal).select(F.lit("literal").alias("side"), "p", F.col("o").alias("other"))
    both = out.unionByName(into).unionByName(own).distinct()
    joined = both.join(ranks.select(F.col("node").alias("other"), "rank"), "other", "left").select("side", "p", "other", "rank")
    ordered = joined.orderBy(F.desc_nulls_last("rank"), "side", "p", "other")
    return ordered if limit is None else ordered.limit(limit)


def emit(rows: DataFrame, facts: list[tuple[Column, Column, Column]]) -> DataFrame:
    """Several triples from each row, those with an empty slot left out."""
    each = F.explode(F.array(*[F.struct(s.cast("string").alias("s"), p.alias("p"), o.cast("string").alias("o")) for s, p, o in facts])).alias("t")
    return rows.select(each).select("t.*").filter("s <> '' and p <> '' and o <> ''")


def split_by_type(triples: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Triples of entities that have one of the types, and the remainder."""
    own = triples.filter((F.col("p") == V.TYPE) & F.col("o").isin(*types)).select("s").distinct()
    return triples.join(own, "s", "left_semi"), triples.join(own, "s", "left_anti")


def unique_elements(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, order): the last value of each key at the place of its first."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))


def concept_counter(sentences: DataFrame) -> DataFrame:
    """(concept, n, sources): the words of (source, text, ...) sentences with their number and their sources in order.

    A sentence that repeats in a row with equal columns counts once.
    """
    words = sentences.distinct().select("source", F.explode(word_tokens(F.col("text"))).alias("concept"))
    each = words.groupBy("concept", "source").agg(F.count("*").alias("n"))
    return each.groupBy("concept").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"))


def concept_profile(texts: DataFrame) -> DataFrame:
    """(concept, n, n_docs, sources): the words of (doc_id, source, text) with their number, that of the different
    documents, and their sources in order. Rows count as often as they are there."""
    tokens = word_tokens(F.col("text"))
    none, one = F.lit(0).alias, F.lit(1).alias
    said = texts.select("source", F.explode(tokens).alias("concept"), one("n"), none("docs"))
    # a row's different words are found where it lies, so that words aren't shuffled by document
    own = texts.filter("doc_id is not null").select("doc_id", "source", F.explode(F.array_distinct(tokens)).alias("concept"))
    rows = said.unionByName(own.select("source", "concept", none("n"), one("docs")))
    repeated = small(written(texts.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")))
    if not repeated.isEmpty():
        again = own.join(repeated, "doc_id").groupBy("concept", "doc_id").agg((1 - F.count("*")).alias("docs"))
        nowhere = F.lit(None).cast(texts.schema["source"].dataType).alias("source")
        rows = rows.unionByName(again.select(nowhere, "concept", none("n"), "docs"))
    found = rows.groupBy("concept", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return found.groupBy("concept").agg(F.sum("n").alias("n"), F.sum("docs").alias("n_docs"), F.array_sort(F.collect_set("source")).alias("sources"))


def statements_of(triples: DataFrame) -> DataFrame:
    """(s, n): the statements of each entity as a nested view counts them.

    A predicate with one value counts for itself and the value, one with several for itself, and twice for each value,
    as a member of the list and by itself.
    """
    values = triples.select("s", "p", "o").distinct().groupBy("s", "p").agg(F.count("*").alias("k"))
    return values.groupBy("s").agg(F.sum(F.when(F.col("k") == 1, 2).otherwise(1 + 2 * F.col("k"))).alias("n"))


def type_graph(triples: DataFrame, predicate: str = V.TYPE, unknown: str = "my:Unknown", everything: str = "http://www.w3.org/2002/07/owl#Thing") -> DataFrame:
    """(id, composite, classes, n_statements, n_entities, position): a class for each set of types that entities have.

    One type is a class of its own, several make a composite class of them, numbered in the order of the sets;
    the class of everything is no part of it. Entities without a type are of the unknown one. Classes with more
    statements come first.
    """
    types = triples.filter(F.col("p") == predicate).groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("types"))
    own = statements_of(triples).join(types, "s", "left").withColumn("types", F.coalesce("types", F.array(F.lit(unknown))))
    sets = own.groupBy("types").agg(F.sum("n").alias("n_statements"), F.count("*").alias("n_entities"))
    # as many rows from here on as there are sets of types
    composite = F.size("types") > 1
    number = F.sum(composite.cast("int")).over(Window.orderBy(F.array_join("types", " "))) - 1
    named = sets.withColumn("id", F.when(composite, F.concat(F.lit("my:CompositeClass"), number.cast("string"))).otherwise(F.element_at("types", 1)))
    classes = F.when(composite, F.filter("types", lambda x: x != everything)).otherwise(F.col("types"))
    position = F.row_number().over(Window.orderBy(F.desc("n_statements"), F.array_join("types", " ")))
    return named.select("id", composite.alias("composite"), classes.alias("classes"), "n_statements", "n_entities", position.alias("position"))
