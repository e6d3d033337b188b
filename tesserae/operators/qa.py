"""Questions over a graph: concept graphs, labelled and sourced triples, answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import plain_sentence, readable_key, similar
from tesserae.operators import graph, rank
from tesserae.operators import corpus as K
from tesserae.operators.sets import keep_first
from tesserae.functions import text as X
from tesserae.sources import triples as V
from tesserae.sources.scratch import complete, shared_dir, shared_path, small, touching, written


def out_edges(nodes: DataFrame, triples: DataFrame) -> DataFrame:
    return nodes.select(F.col("node").alias("s")).join(touching(triples, "s", nodes), "s").select("s", "p", "o")


def in_edges(nodes: DataFrame, triples: DataFrame) -> DataFrame:
    return nodes.select(F.col("node").alias("o")).join(touching(triples, "o", nodes), "o").select("s", "p", "o")


def concept_graph(triples: DataFrame, seed: str, sub_concepts: bool = True, super_concepts: bool = False, incoming: bool = True, keep: Column | None = None) -> DataFrame:
    """Distinct triples of a concept and (if asked) the concepts below and above it, out of them and into them."""
    spark = triples.sparkSession
    nodes = spark.createDataFrame([(seed,)], "node string")
    subclass = triples.filter(F.col("p") == V.SUBCLASS)
    wanted = nodes
    if sub_concepts:
        wanted = wanted.unionByName(graph.reachable(subclass, nodes, "in").select("node"))
    if super_concepts:
        wanted = wanted.unionByName(graph.reachable(subclass, nodes, "out").select("node"))
    wanted = written(wanted.distinct())
    chosen = triples if keep is None else triples.filter(keep)
    found = out_edges(wanted, chosen)
    if incoming:
        found = found.unionByName(in_edges(wanted, chosen))
    return found.distinct()


#: So many hops are looked up in the triples as they lie; only longer ways are worth a table of all steps, long texts among them.
_NEAR = 3


def sub_graph(triples: DataFrame, seeds: DataFrame) -> DataFrame:
    """All out-edges of what is reached from the seeds by predicates that are neither subclass nor open relations."""
    inner = triples.filter((F.col("p") != V.SUBCLASS) & ~V.is_relation())
    found = front = written(seeds.select("node").distinct())
    for _ in range(_NEAR):
        after = out_edges(front, inner).select(F.col("o").alias("node")).distinct()
        front = written(after.join(found, "node", "left_anti"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    else:
        found = written(found.unionByName(graph.reachable(inner, front, "out").select("node")).distinct())
    return out_edges(found, triples).distinct()


def labelled(triples: DataFrame, labels: DataFrame, concept: str | None = None) -> DataFrame:
    """(s, p, o, label_s, label_p, label_o): every label of each slot, the id itself where there is none.

    Self loops go. A subclass triple stays only if it touches the concept and its labels aren't alike.
    """
    out = written(triples.filter("s <> o"))
    names = small(written(out.select(F.col("p").alias("node")).distinct()))
    for slot in "spo":
        known = labels.join(names, "node", "left_semi") if slot == "p" else labels
        own = known.select(F.col("node").alias(slot), F.col("label").alias(f"label_{slot}"))
        if slot == "p":  # predicates are few and shared by many triples, which are not dealt by them
            own = small(own)
        out = out.join(own, slot, "left").withColumn(f"label_{slot}", F.coalesce(f"label_{slot}", slot))
    hierarchy = F.col("p") == V.SUBCLASS
    fine = ~similar(F.col("label_s"), F.col("label_o"))
    if concept is not None:
        fine = fine & ((F.col("s") == concept) | (F.col("o") == concept))
    return out.filter(~hierarchy | fine).select("s", "p", "o", "label_s", "label_p", "label_o")


def sourced(triples: DataFrame, sources: DataFrame) -> DataFrame:
    """Triples with each source that s, p and o have in common; a null source where there is none.

    sources: (node, source). A triple whose predicate or another slot has no source has none.
    """
    common = triples
    for slot in "spo":
        own = sources.select(F.col("node").alias(slot), F.col("source").alias(f"source_{slot}")).distinct()
        on = slot if slot == "s" else [slot, "source"]
        own = own.withColumnRenamed(f"source_{slot}", "source")
        common = common.join(own, on)
    return triples.join(common.select("s", "p", "o", "source").distinct(), ["s", "p", "o"], "left").select("s", "p", "o", "source")


def slot_sources(triples: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that subject and object share, null where there is none."""
    s = sources.select(F.col("node").alias("s"), "source").distinct()
    o = sources.select(F.col("node").alias("o"), "source").distinct()
    both = triples.join(s, "s").join(o, ["o", "source"]).select("s", "p", "o", "source").distinct()
    return triples.join(both, ["s", "p", "o"], "left").select("s", "p", "o", "source")


def display_label(label: Column, node: Column) -> Column:
    """The label, else a readable form of the key."""
    return F.coalesce(label, readable_key(node))


def texts_of(labelled_triples: DataFrame) -> DataFrame:
    """The three texts under which a triple is found: its sentence and the labels of its ends. A triple's rows lie together."""
    each = labelled_triples.repartition("s", "p", "o").withColumn("sentence", plain_sentence(F.col("label_s"), F.col("label_p"), F.col("label_o")))
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("text")) for i, c in enumerate(("sentence", "label_s", "label_o"))])
    return each.select("s", "p", "o", "sentence", F.explode(kinds).alias("t")).select("s", "p", "o", "sentence", "t.kind", "t.text").filter("text <> ''")


@dataclass
class AnswerIndex:
    """facts: text, s, p, o, sentence, where a triple is found under its texts; corpus: the texts, each under a number."""

    facts: DataFrame
    corpus: K.Corpus


def _open_answers(spark: SparkSession, path: str) -> AnswerIndex:
    return AnswerIndex(spark.read.parquet(f"{path}/facts"), K.open_corpus(spark, path))


def register_answers(path: str, candidates: DataFrame) -> AnswerIndex:
    """Write candidates (s, p, o, sentence, text) and the corpus of their texts below path and open them."""
    spark = candidates.sparkSession
    keep_first(candidates.select("text", "s", "p", "o", "sentence"), ["text", "s", "p", "o"], ["sentence"]).write.mode("overwrite").parquet(f"{path}/facts")
    texts = spark.read.parquet(f"{path}/facts").select("text").distinct()
    K.register(path, texts.withColumn("id", F.monotonically_increasing_id()), "id", "text")
    return _open_answers(spark, path)


def registered_answers(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> AnswerIndex:
    """The index of that name for these input files as they are now, made if it isn't there yet."""
    path = shared_path(spark, f"answers-{name}", inputs)
    return _open_answers(spark, path) if complete(spark, f"{path}/terms") else register_answers(path, make())


def _scored(index: AnswerIndex, questions: DataFrame, threshold: float | None) -> DataFrame:
    """(qid, text, similarity): texts are looked up for the numbers that were found."""
    found = written(K.similarities(index.corpus, questions, threshold))
    return found.join(index.corpus.texts, "key").select("qid", "text", "similarity")


def _told(index: AnswerIndex, scores: DataFrame) -> DataFrame:
    """Facts with the scores (qid, text, ...) of their texts."""
    scores = written(scores)
    return touching(index.facts, "text", scores.select(F.col("text").alias("node"))).join(scores, "text")


def answers(index: AnswerIndex, questions: DataFrame, threshold: float = 0.1, tfidf_share: float = 1.0) -> DataFrame:
    """(qid, rank, abstract, sentence, confidence, s, p, o) of registered triples.

    Each text is scored against each question; the best text stands for a triple, the best triple for a sentence.
    """
    found = _scored(index, questions, threshold / tfidf_share if tfidf_share else None)
    scores = found.withColumn("confidence", F.round(F.col("similarity") * tfidf_share, 6)).filter(F.col("confidence") >= threshold)
    hits = _told(index, scores)
    hits = hits.select("qid", F.col("text").alias("abstract"), "sentence", "confidence", "s", "p", "o")
    # of equal confidences the later sort key wins, as in rankings
    by_triple = hits.groupBy("qid", "s", "p", "o").agg(F.max(F.struct("confidence", "abstract", "sentence")).alias("b")).select("qid", "s", "p", "o", "b.*")
    by_sentence = by_triple.groupBy("qid", "sentence").agg(F.max(F.struct("confidence", "abstract", "s", "p", "o")).alias("b")).select("qid", "sentence", "b.*")
    ordered = rank.ranked(by_sentence, "qid", "sentence", "confidence")
    return ordered.select("qid", "rank", "abstract", "sentence", "confidence", "s", "p", "o")


def align(labels: DataFrame, corpus: K.Corpus, questions: DataFrame, threshold: float, n: int = 1) -> DataFrame:
    """(qid, concept, label, similarity, rank): the n concepts whose labels are nearest to each question.

    labels: (node, label); corpus: the registered labels, under themselves.
    """
    scores = K.similarities(corpus, questions, threshold)
    concepts = scores.join(labels, F.col("key") == F.col("label")).select("qid", F.col("node").alias("concept"), "label", "similarity")
    return rank.ranked(concepts, "qid", "concept", k=n)


def ask(triples: DataFrame, labels: DataFrame, corpus: K.Corpus, questions: DataFrame, concept_threshold: float = 0.55, threshold: float = 0.1, n_concepts: int = 1) -> DataFrame:
    """Answers to each question from the graph around the concepts that it is aligned with; corpus: the registered labels.

    The closure below all concepts is found at once, as (seed, node) pairs; triples out of and into those nodes are
    labelled once whatever number of questions want them.
    """
    aligned = written(align(labels, corpus, questions, concept_threshold, n_concepts).select("qid", F.col("concept").alias("seed")))
    up = triples.filter(F.col("p") == V.SUBCLASS).select("s", "o")
    found = front = written(aligned.select("seed", F.col("seed").alias("node")).distinct())
    while True:
        below = front.join(up, F.col("node") == F.col("o")).select("seed", F.col("s").alias("node")).distinct()
        front = written(below.join(found, ["seed", "node"], "left_anti"))
        if front.isEmpty():
            break
        found = written(found.unionByName(front))
    relations = triples.filter(V.is_relation()).select("s", "p", "o")
    out = found.join(relations, F.col("node") == F.col("s")).select("seed", "s", "p", "o")
    into = found.join(relations, F.col("node") == F.col("o")).select("seed", "s", "p", "o")
    seen = written(out.unionByName(into).distinct())
    index = register_answers(f"{shared_dir(triples.sparkSession)}/asked-{uuid.uuid4().hex}", texts_of(labelled(seen.select("s", "p", "o").distinct(), labels)))
    scores = _scored(index, questions, threshold).withColumnRenamed("similarity", "confidence")
    hits = _told(index, scores).join(seen, ["s", "p", "o"]).join(aligned, ["qid", "seed"])
    hits = hits.select("qid", F.col("text").alias("abstract"), "sentence", "confidence", "s", "p", "o")
    by_sentence = hits.groupBy("qid", "sentence").agg(F.max(F.struct("confidence", "abstract", "s", "p", "o")).alias("b")).select("qid", "sentence", "b.*")
    return rank.ranked(by_sentence, "qid", "sentence", "confidence").select("qid", "rank", "abstract", "sentence", "confidence", "s", "p", "o")


def fill_templates(templates: list[str], concepts: DataFrame) -> DataFrame:
    """(qid, question) of question templates with {concept} filled in; concepts: (concept, label)."""
    each = F.posexplode(F.array(*[F.lit(x) for x in templates])).alias("k", "template")
    rows = concepts.select("concept", "label", each)
    return rows.select("concept", F.col("k").alias("qid"), F.replace("template", F.lit("{concept}"), F.col("label")).alias("question"))


def replace_subclasses(texts: DataFrame, triples: DataFrame, superclass: str, name: Column, text: str = "text") -> DataFrame:
    """Put a class's name for the names of its direct subclasses in texts, long names first.

    name turns a column `node` into its written form. The names of one class's direct subclasses form one pattern.
    """
    direct = triples.filter((F.col("p") == V.SUBCLASS) & (F.col("o") == superclass)).select(F.col("s").alias("node")).distinct()
    names = direct.select(F.lower(name).alias("n")).filter("n <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.length("n")).alias("k"), F.col("n")))), lambda z: F.concat(F.lit("\\Q"), z["n"], F.lit("\\E")))
    pattern = names.agg(F.array_join(ordered, "|").alias("pattern"))
    own = triples.sparkSession.range(1).select(F.lit(superclass).alias("node")).select(F.lower(name).alias("super"))
    joined = texts.crossJoin(F.broadcast(pattern)).crossJoin(F.broadcast(own))
    return joined.withColumn(text, F.when(F.col("pattern") == "", F.col(text)).otherwise(F.regexp_replace(F.col(text), F.col("pattern"), F.col("super")))).drop("pattern", "super")


def answers_json(found: DataFrame) -> DataFrame:
    """(qid, json): the answers of each question as one JSON array in rank order."""
    each = F.sort_array(F.collect_list(F.struct("rank", "abstract", "sentence", "confidence", F.array("s", "p", "o").alias("triple"))))
    return found.groupBy("qid").agg(F.to_json(each).alias("json"))


def couple_clusters(labelled_triples: DataFrame) -> DataFrame:
    """(side, key, predicate, members): objects of one subject and predicate, subjects of one object and predicate."""
    objects = labelled_triples.groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("members")).select(F.lit("o").alias("side"), F.col("s").alias("key"), "p", "members")
    subjects = labelled_triples.groupBy("o", "p").agg(F.array_sort(F.collect_set("s")).alias("members")).select(F.lit("s").alias("side"), F.col("o").alias("key"), "p", "members")
    return objects.unionByName(subjects).filter(F.size("members") > 1)


def labelled_clusters(labelled_triples: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(side, key, p, label_key, label_p, members, labels): like couple_clusters(), told apart by labels too.

    labelled_triples: (s, p, o, label_s, label_p, label_o). Of a subject (or object) and predicate under one pair of
    labels, if there are several rows: the different nodes at the other end in order of their labels, each under
    the first of them, without those whose label is like one that stays.
    """
    sides = []
    for own, other in (("s", "o"), ("o", "s")):
        sides.append(labelled_triples.select(F.lit(other).alias("side"), F.col(own).alias("key"), "p", F.col(f"label_{own}").alias("label_key"), "label_p", F.col(other).alias("member"), F.col(f"label_{other}").alias("label")))
    group = ["side", "key", "p", "label_key", "label_p"]
    rows = sides[0].unionByName(sides[1])
    several = rows.groupBy(*group).agg(F.count("*").alias("n")).filter("n > 1").select(F.struct(*group).alias("group"))
    first = rows.groupBy(F.struct(*group).alias("group"), "member").agg(F.min("label").alias("label")).join(several, "group", "left_semi")
    ordered = graph.ordered_ranks(first, ["group"], [F.col("label"), F.col("member")])
    kept = remove_similar(ordered.select("group", "ord", "label"), threshold).select("group", "ord")
    both = ordered.join(kept, ["group", "ord"])
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c])
    return both.groupBy("group").agg(in_order("member").alias("members"), in_order("label").alias("labels")).select("group.*", "members", "labels")


def equivalent_definitions(triples: DataFrame, concept: str, definitions: DataFrame) -> DataFrame:
    """(s, p, o): the definitions (node, definition) of what a concept is equivalent to by its senses."""
    seed = triples.sparkSession.createDataFrame([(concept,)], "node string")
    same = graph.reachable(triples.filter(F.col("p") == V.IN_SYNSET), seed, "both").select("node")
    return definitions.join(same, "node").select(F.lit(concept).alias("s"), F.lit(V.DEFINITION).alias("p"), F.col("definition").alias("o")).distinct()


def taxonomy_page(triples: DataFrame, concept: str, definitions: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(s, p, o) of all that a page on a concept's place in the taxonomy shows.

    Subclass triples of the concepts below and above it, labels and sources of all concepts in these, what is said of
    the sources, the concept's own definitions and those given for its neighbours (node, definition), its types
    and the nodes of its type with their labels. Rows with an empty part are left out.
    """
    seed = triples.sparkSession.createDataFrame([(concept,)], "node string")
    tree = triples.filter(F.col("p") == V.SUBCLASS)
    around = seed
    for direction in ("in", "out") if depth != 0 else ():
        around = around.unionByName(graph.reachable(tree, seed, direction, depth).select("node"))
    around = written(around.distinct())
    steps = written(out_edges(around, tree).unionByName(in_edges(around, tree)).distinct())
    shown = written(steps.select(F.explode(F.array("s", "o")).alias("node")).unionByName(around).distinct())
    sources = written(out_edges(shown, triples.filter(F.col("p") == V.HAS_SOURCE)).distinct())
    types = triples.filter(F.col("p") == V.TYPE)
    inside = lambda df, c: df.join(around.withColumnRenamed("node", c), c, "left_anti")
    up = inside(types.filter(F.col("s") == concept), "o").select(F.lit(concept).alias("s"), "p", "o")
    down = inside(types.filter(F.col("o") == concept), "s").select("s", "p", F.lit(concept).alias("o"))
    ends = up.select(F.col("o").alias("node")).unionByName(down.select(F.col("s").alias("node")))
    labels = out_edges(shown.unionByName(ends).distinct(), triples.filter(F.col("p") == V.LABEL))
    own = triples.filter((F.col("s") == concept) & (F.col("p") == V.DEFINITION)).select("s", "p", "o")
    parts = [steps, labels, sources, sub_graph(triples, sources.select(F.col("o").alias("node")).distinct()), own, up, down]
    if definitions is not None:
        parts.append(definitions.join(shown, "node").select(F.col("node").alias("s"), F.lit(V.DEFINITION).alias("p"), F.col("definition").alias("o")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more.select("s", "p", "o"))
    return out.filter("s <> '' and p <> '' and o <> ''").distinct()


def remove_similar(labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Greedy order-dependent dedup in each group (group, ord, label): a label goes if one that stays is alike.

    The labels of one group meet in one row, as each decision depends on those before it.
    """
    ordered = labels.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("all"))
    kind = labels.select(F.array(F.struct("ord", "label"))).schema[0].dataType.simpleString()
    kept = F.aggregate(
        "all",
        F.array().cast(kind),
        lambda held, x: F.when(F.exists(held, lambda y: X.edit_distance(x["label"], y["label"]) < threshold), held).otherwise(F.concat(held, F.array(x))),
    )
    return ordered.select("group", F.explode(kept).alias("x")).select("group", "x.ord", "x.label").select(labels.columns)
