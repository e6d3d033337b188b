"""Small operators that prepare inputs, order outputs and assemble what clients show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import text as X
from tesserae.operators.graph import closure
from tesserae.sources.scratch import small

CLIPPED = "[...]"  # fixed value: what clients read


def content_rows(items: DataFrame) -> DataFrame:
    """(id, text, normalised_text) of a reader's items (id, text, graph): those that are graphs are left out, texts without
    an id have themselves as id."""
    texts = items.filter("graph is null and text is not null")
    return texts.select(F.coalesce("id", "text").alias("id"), "text", X.join_lines(F.col("text")).alias("normalised_text"))


def csv_terms(lines: DataFrame, schema: str, column: str, line: str = "line") -> DataFrame:
    """The different values of one column of semicolon-separated lines."""
    parsed = lines.select(F.from_csv(F.col(line), schema, {"sep": ";"}).alias("r"))
    return parsed.select(F.col(f"r.`{column}`").alias("term")).filter("term is not null").distinct()


def jsonld_descriptions(documents: DataFrame, key: str, json: str = "json") -> DataFrame:
    """(id, description) of the entries of JSON-LD arrays that have the key: its readable form in lower case."""
    entries = documents.select(F.explode(F.from_json(F.col(json), "array<map<string,string>>")).alias("e"))
    own = entries.filter(F.map_contains_key("e", F.lit(key)) & F.map_contains_key("e", F.lit("@id")))
    return own.select(F.col("e")["@id"].alias("id"), F.trim(F.lower(X.readable_key(F.col("e")[key]))).alias("description"))


def stop_word_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The words of a stop-word file, a word a line; lines that begin with # are comments, empty ones count for nothing."""
    word = F.lower(F.trim(F.col(line)))
    return lines.filter(~F.col(line).startswith("#") & (word != "")).select(word.alias("stop")).distinct()


def lemma_tokens(tokens: DataFrame, stop_words: DataFrame | None = None) -> DataFrame:
    """(sent_id, lemmas): folded lemmas in order, without punctuation and pronouns, and without stop words if these are given."""
    kept = tokens.filter((F.col("pos") != "PUNCT") & (F.lower("lemma") != "-pron-"))
    if stop_words is not None:
        kept = kept.withColumn("stop", F.lower("text")).join(small(stop_words), "stop", "left_anti")
    each = F.struct("i", F.trim(F.lower("lemma")).alias("lemma"))
    return kept.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["lemma"]).alias("lemmas"))


def concept_filter(label: Column, stop_words: list[str] | None = None, numbers: bool = True) -> Column:
    """Whether a label is kept: not empty; no stop word, if these are given; without digits, if numbers aren't wanted."""
    keep = label.isNotNull() & (label != "")
    if stop_words is not None:
        keep = keep & ~label.isin(stop_words)
    return keep if numbers else keep & ~label.rlike("[0-9]")


def clip_text(text: Column, most: int | None) -> Column:
    """Texts of more than `most` characters end there and say so."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CLIPPED))).otherwise(text) if most else text


def html_table(heads: list[str], rows: Column) -> Column:
    """An HTML table of an array of arrays of strings."""
    head = "".join(f"<th>{h}</th>" for h in heads)
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda v: F.concat(F.lit("<td>"), v, F.lit("</td>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit(f'<table class="table table-bordered"><tr>{head}</tr>'), F.array_join(F.transform(rows, row), ""), F.lit("</table>"))


def adjacency_order(edges: DataFrame) -> DataFrame:
    """Append position to (s, p, o): the neighbours of a node in order of predicate and node."""
    return edges.withColumn("position", F.row_number().over(Window.partitionBy("s").orderBy("p", "o")))


def key_order(entries: DataFrame, entity: str = "s", key: str = "p") -> DataFrame:
    """Append position to an entity's keys: special ones (@..., type), then abstract and label, then the others by name."""
    name = F.when(X.is_url(F.col(key)), X.url_tail(F.col(key))).otherwise(F.col(key))
    rank = F.when(name.startswith("@") | (name == "type"), 0).when(name.isin("abstract", "label"), 1).otherwise(2)
    order = Window.partitionBy(entity).orderBy(rank, F.when(rank == 2, name), key)
    return entries.withColumn("position", F.row_number().over(order))


def rank_compressions(candidates: DataFrame, by_length: bool = False) -> DataFrame:
    """Append score and rank to (cluster, text, score, words), best first; by_length divides scores by the words."""
    score = F.col("score") / F.col("words") if by_length else F.col("score")
    return candidates.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "text")))


def roots(edges: DataFrame) -> DataFrame:
    """Sources of (s, o) to which no other node leads; an edge from a node to itself doesn't count."""
    into = edges.filter("s <> o").select(F.col("o").alias("node")).distinct()
    return edges.select(F.col("s").alias("node")).distinct().join(into, "node", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    """Targets of (s, o) that lead to no other node; an edge from a node to itself doesn't count."""
    return roots(edges.select(F.col("o").alias("s"), F.col("s").alias("o")))


def hypernym_edges(concepts: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """(s, o) from each wn: node of `concepts` to itself and to all that `hypernyms` (s, o) lead to."""
    own = concepts.filter(F.col("node").startswith("wn:")).select("node").distinct()
    above = closure(hypernyms).join(own, F.col("a") == F.col("node")).select(F.col("a").alias("s"), F.col("b").alias("o"))
    return above.unionByName(own.select(F.col("node").alias("s"), F.col("node").alias("o"))).distinct()


def typing_context(edges: DataFrame, side: str, action: bool = False, templates: bool = True) -> DataFrame:
    """(predicate, object, attribute): the context of a lattice of what nodes do (active), suffer (passive), or both.

    An attribute is the predicate, or with action the predicate and the node at the other end. With action each
    predicate has a lattice of its own; otherwise predicate is null.
    """
    def one(own: str, other: str, passive: bool) -> DataFrame:
        if templates:
            verb = F.concat(F.lit("that can be "), F.col("p"), F.lit("-ed")) if passive else F.concat(F.lit("that can "), F.col("p"))
            end = F.concat(F.lit(" by " if passive else " "), F.col(other)) if action else F.lit("")
            attribute = F.concat(verb, end, F.lit(" is"))
        else:
            attribute = F.concat_ws(", ", "p", other) if action else F.col("p")
        return edges.select((F.col("p") if action else F.lit(None).cast("string")).alias("predicate"), F.col(own).alias("object"), attribute.alias("attribute"))

    parts = {"active": [one("s", "o", False)], "passive": [one("o", "s", True)]}
    parts["both"] = parts["active"] + parts["passive"]
    out = parts[side][0]
    for more in parts[side][1:]:
        out = out.unionByName(more)
    return out.distinct()


_SENTENCES = "array<struct<text:string,annotations:array<string>,words:array<struct<text:string,annotations:array<string>>>>>"


def annotation_list(documents: DataFrame, sentences: str = "sentences") -> DataFrame:
    """(id, text, annotation): the first annotation of each annotated sentence and of each annotated word in it.

    documents: id and an array of sentences (text, annotations, words (text, annotations)).
    """
    each = documents.select("id", F.explode(sentences).alias("s"))
    words = each.select("id", F.explode("s.words").alias("w")).select("id", "w.text", F.get("w.annotations", F.lit(0)).alias("annotation"))
    own = each.select("id", "s.text", F.get("s.annotations", F.lit(0)).alias("annotation"))
    return own.unionByName(words).filter("annotation is not null")


def known_concepts(documents: DataFrame, most: int | None = None, sentences: str = "sentences") -> DataFrame:
    """(id, concepts): the different annotations of a document in order, at most so many, with a note if there may be more."""
    every = F.flatten(F.transform(sentences, lambda s: F.concat(s["annotations"], F.flatten(F.transform(s["words"], lambda w: w["annotations"])))))
    found = F.array_distinct(F.array_compact(every))
    text = F.array_join(F.slice(found, 1, most) if most else found, ", ")
    return documents.select("id", (F.when(F.size(found) >= most, F.concat(text, F.lit(", etc.."))).otherwise(text) if most else text).alias("concepts"))


def process_inputs(documents: DataFrame) -> DataFrame:
    """(process, id, value, feature_order, api) of the inputs of each different process of nested documents (processes)."""
    each = documents.select(F.explode("processes").alias("p"))
    first = each.groupBy(F.col("p.label").alias("process")).agg(F.min("p.inputs").alias("inputs"))
    return first.select("process", F.explode("inputs").alias("i")).select("process", "i.*")


def counterfactual_inputs(inputs: DataFrame) -> DataFrame:
    """(request, values): of the values given for an input (id) the last by ord, in numeric order of the ids."""
    last = inputs.groupBy("request", "id").agg(F.max_by("value", "ord").alias("value"))
    each = F.struct(F.col("id").cast("int").alias("n"), "value")
    return last.groupBy("request").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["value"]).alias("values"))


def summarise_texts(texts: DataFrame, summarise: Callable[[Column], Column], least: int, window: int, text: str = "text") -> DataFrame:
    """Append summary: texts of fewer than `least` words as they are, others by the given function of their first `window` words."""
    words = F.split(F.trim(F.col(text)), r"\s+")
    return texts.withColumn("summary", F.when(F.size(words) < least, F.col(text)).otherwise(summarise(F.array_join(F.slice(words, 1, window), " "))))


def tag_senses(nodes: DataFrame, senses: DataFrame) -> DataFrame:
    """(s, p, o): the sense of each node (node, lemma) by a table (lemma, sense) that a tagger made; nodes without one are left out."""
    return nodes.join(senses, "lemma").select(F.col("node").alias("s"), F.lit("my:inSynset").alias("p"), F.concat(F.lit("wn:"), "sense").alias("o")).distinct()


def leaf_texts(tree: DataFrame) -> DataFrame:
    """(root, text) of the sentences at the leaves of summary trees (root, node, parent, text): what is to be annotated."""
    inner = tree.filter("parent is not null").select("root", F.col("parent").alias("node")).distinct()
    return tree.join(inner, ["root", "node"], "left_anti").filter("text <> ''").select("root", "text").distinct()
