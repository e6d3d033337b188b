"""Summary trees, word graphs, co-occurrence and keyphrases."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.text import sentify
from tesserae.sources.scratch import written


def tree_reduce(leaves: DataFrame, arity: int = 3, depth: int | None = None, merge=None) -> DataFrame:
    """(key, level, pos, parent_pos, text) of the trees over (key, pos, text): `arity` neighbours become one node.

    merge turns the ordered array of their texts into the node's; the default joins their sentences. Levels end
    with one node a key or after `depth` of them.
    """
    merge = merge or (lambda texts: sentify(F.array_join(texts, " ")))
    level = leaves.select("key", F.col("pos").cast("long").alias("pos"), sentify(F.col("text")).alias("text"))
    widest = level.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    rounds = max(0, math.ceil(math.log(widest, arity) - 1e-9)) if depth is None else depth
    out = []
    for k in range(rounds + 1):
        out.append(level.withColumn("level", F.lit(k)).withColumn("parent_pos", F.floor(F.col("pos") / arity)))
        up = level.groupBy("key", F.floor(F.col("pos") / arity).alias("pos"))
        level = written(up.agg(merge(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda z: z["text"])).alias("text")))
    tree = out[0]
    for x in out[1:]:
        tree = tree.unionByName(x)
    return tree.select("key", "level", "pos", "parent_pos", "text")


def first_use(answers: DataFrame, horizon: int) -> DataFrame:
    """Of (question, pos, sentence): each sentence under the first question that has it, `horizon` a question."""
    first = answers.groupBy("sentence").agg(F.min(F.struct("question", "pos")).alias("f")).select("f.question", "f.pos", "sentence")
    w = Window.partitionBy("question").orderBy("pos", "sentence")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= horizon)


def cooccurrence(tokens: DataFrame, window: int = 0) -> DataFrame:
    """(a, b, weight) for words of one sentence (at most `window` apart, 0: any), of tokens (sent, pos, word)."""
    rows = tokens.select("sent", "pos", "word")
    if window:  # near words stand at known places: no others are compared
        shifted = rows.select("sent", "word", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + window)).alias("at"))
        pairs = shifted.join(rows.select("sent", F.col("pos").alias("at"), F.col("word").alias("other")), ["sent", "at"]).select("word", "other", F.lit(1).alias("n"))
    else:  # a word's occurrences in a sentence are counted first
        counts = rows.groupBy("sent", "word").agg(F.count("*").alias("n"))
        other = counts.select("sent", F.col("word").alias("other"), F.col("n").alias("m"))
        pairs = counts.join(other, "sent").filter("word < other").select("word", "other", (F.col("n") * F.col("m")).alias("n"))
    pairs = pairs.filter("word <> other")
    return pairs.groupBy(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).agg(F.sum("n").alias("weight"))


def textrank(edges: DataFrame, damping: float = 0.85, rounds: int = 30, tolerance: float | None = 1e-4) -> DataFrame:
    """(word, score) over undirected weighted edges (a, b, weight); all scores start at 1."""
    both = written(edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    total = written(both.groupBy("a").agg(F.sum("weight").alias("total")))
    steps = written(both.join(total, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("share")))
    scores = total.select(F.col("a").alias("word"), F.lit(1.0).alias("score"))
    for _ in range(rounds):
        given = steps.join(scores, F.col("a") == F.col("word")).groupBy("b").agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        after = written(given.select(F.col("b").alias("word"), (F.lit(1 - damping) + damping * F.col("got")).alias("score")))
        moved = tolerance is not None and after.alias("n").join(scores.alias("o"), "word").agg(F.max(F.abs(F.col("n.score") - F.col("o.score")))).first()[0]
        scores = after
        if tolerance is not None and moved is not None and moved < tolerance:
            break
    return scores


def edge_weights(tokens: DataFrame) -> DataFrame:
    """(a, b, weight) of a word graph from (cluster, sent, pos, word): (f_a + f_b) / sum(1 / distance) / (f_a * f_b).

    The sum takes for each sentence the least forward distance from a to b; an edge joins neighbours.
    """
    freq = tokens.groupBy("cluster", "word").agg(F.count("*").alias("f"))
    follow = Window.partitionBy("cluster", "sent").orderBy("pos")
    edges = tokens.withColumn("next", F.lead("word").over(follow)).filter("next is not null").select("cluster", F.col("word").alias("a"), F.col("next").alias("b")).distinct()
    x, y = tokens.alias("x"), tokens.alias("y")
    ahead = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.sent") == F.col("y.sent")) & (F.col("x.pos") < F.col("y.pos")))
    apart = ahead.groupBy("x.cluster", "x.sent", F.col("x.word").alias("a"), F.col("y.word").alias("b")).agg(F.min(F.col("y.pos") - F.col("x.pos")).alias("d"))
    closeness = apart.groupBy("cluster", "a", "b").agg(F.sum(1.0 / F.col("d")).alias("c"))
    fa, fb = freq.select("cluster", F.col("word").alias("a"), F.col("f").alias("fa")), freq.select("cluster", F.col("word").alias("b"), F.col("f").alias("fb"))
    joined = edges.join(closeness, ["cluster", "a", "b"]).join(fa, ["cluster", "a"]).join(fb, ["cluster", "b"])
    return joined.select("cluster", "a", "b", ((F.col("fa") + F.col("fb")) / F.col("c") / (F.col("fa") * F.col("fb"))).alias("weight"))


def neighbour_context(tokens: DataFrame) -> DataFrame:
    """Left and right neighbour of each token (cluster, sent, pos, word) in its sentence, '-' at the ends."""
    w = Window.partitionBy("cluster", "sent").orderBy("pos")
    side = lambda f: F.coalesce(f("word").over(w), F.lit("-"))
    return tokens.select("cluster", "sent", "pos", "word", side(F.lag).alias("before"), side(F.lead).alias("after"))


def runs(tokens: DataFrame, wanted: Column) -> DataFrame:
    """Longest runs of tokens that `wanted` picks: (cluster, sent, start, words)."""
    w = Window.partitionBy("cluster", "sent").orderBy("pos")
    own = tokens.withColumn("ok", wanted).withColumn("island", F.col("pos") - F.sum(F.col("ok").cast("int")).over(w)).filter("ok")
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda z: z["word"])
    return own.groupBy("cluster", "sent", "island").agg(F.min("pos").alias("start"), F.array_join(words, " ").alias("words")).drop("island")


def k_shortest_paths(tokens: DataFrame, k: int = 5, min_words: int = 4) -> DataFrame:
    """(cluster, rank, words, cost): cheapest loopless paths through each cluster's word graph that have a verb.

    tokens: (cluster, sent, pos, word, tag). Equal (word, tag) pairs of a cluster are one node, but for a sentence
    that uses one twice. A best-first search extends paths until k are found or
    none is left, which may be exponential in the words; clusters are sentences on one topic and small.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        follows: dict[tuple, dict[tuple, float]] = {}
        count: dict[tuple, int] = {}
        lines = []
        for _, line in group.sort_values(["sent", "pos"]).groupby("sent"):
            used: dict[tuple, int] = {}
            path = [("", "<", 0)]
            for word, tag in zip(line["word"].str.lower(), line["tag"], strict=True):
                used[word, tag] = used.get((word, tag), -1) + 1
                path.append((word, tag, used[word, tag]))
            path.append(("", ">", 0))
            lines.append(path)
            for node in path:
                count[node] = count.get(node, 0) + 1
        close: dict[tuple, float] = {}
        for path in lines:
            for i, a in enumerate(path):
                for j in range(i + 1, len(path)):
                    close[a, path[j]] = close.get((a, path[j]), 0.0) + 1.0 / (j - i)
        for path in lines:
            for a, b in zip(path[:-1], path[1:], strict=True):
                follows.setdefault(a, {})[b] = (count[a] + count[b]) / close[a, b] / (count[a] * count[b])
        found, seen, tick = [], set(), 0
        heap = [(0.0, 0, (("", "<", 0),))]
        while heap and len(found) < k:
            cost, _, path = heapq.heappop(heap)
            if path[-1][1] == ">":
                words = " ".join(n[0] for n in path[1:-1])
                if len(path) - 2 >= min_words and any(n[1].startswith("VB") for n in path) and words not in seen:
                    seen.add(words)
                    found.append((words, cost))
                continue
            for node, weight in sorted(follows.get(path[-1], {}).items()):
                if node not in path:
                    tick += 1
                    heapq.heappush(heap, (cost + weight, tick, (*path, node)))
        out = pd.DataFrame(found, columns=["words", "cost"])
        out.insert(0, "cluster", group["cluster"].iloc[0])
        out.insert(1, "rank", range(1, len(out) + 1))
        return out

    return tokens.groupBy("cluster").applyInPandas(one, "cluster long, rank int, words string, cost double")


def rerank(compressions: DataFrame, phrases: DataFrame) -> DataFrame:
    """(cluster, words, cost, score, rank), least score first, of compressions (cluster, words, cost).

    The cost of a path is taken over its number of words and one more than the scores of its cluster's keyphrases
    (cluster, phrase, score) that stand in it, so that what says more comes first.
    """
    held = compressions.select("cluster", "words").distinct().join(phrases.select("cluster", "phrase", F.col("score").alias("_s")), "cluster").filter(F.contains("words", "phrase"))
    total = held.groupBy("cluster", "words").agg(F.sum("_s").alias("_total"))
    joined = compressions.join(total, ["cluster", "words"], "left")
    score = F.col("cost") / (F.size(F.split("words", " ")) * (1 + F.coalesce("_total", F.lit(0.0))))
    scored = joined.select("cluster", "words", "cost", F.round(score, 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("score", "words", "cost")))


def phrase_scores(phrases: DataFrame, scores: DataFrame) -> DataFrame:
    """(words, score): the sum of a phrase's word scores over its length plus one; unknown words count 0."""
    each = phrases.select("words").distinct().select("words", F.explode(F.split("words", " ")).alias("word"))
    joined = each.join(scores, "word", "left")
    return joined.groupBy("words").agg((F.sum(F.coalesce("score", F.lit(0.0))) / (F.count("*") + 1)).alias("score"))


def phrase_clusters(phrases: DataFrame) -> DataFrame:
    """(words, head): phrases under the longest phrase (ties: the least) that has all of their words.

    Candidates share the phrase's first word in order of the alphabet, so no phrase meets all others.
    """
    own = phrases.select("words").distinct().withColumn("set", F.array_sort(F.array_distinct(F.split("words", " "))))
    by_word = own.select(F.col("words").alias("head"), F.col("set").alias("big"), F.explode("set").alias("first"))
    met = own.withColumn("first", F.get("set", F.lit(0))).join(by_word, "first").filter(F.size(F.array_except("set", "big")) == 0)
    return met.groupBy("words").agg(F.min(F.struct((-F.size("big")).alias("k"), F.col("head"))).alias("b")).select("words", "b.head")


def attach_answers(tree: DataFrame, answers: DataFrame) -> DataFrame:
    """Leaves of a summary tree with the metadata of the answers that they quote, by sentence."""
    return tree.filter("level = 0").join(answers, "sentence", "left")


def cut_levels(rows: DataFrame, key: str, order: str, factor: float) -> DataFrame:
    """The first ceil(n / factor) rows of each key that has more than two."""
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy(order)
    ranked = rows.withColumn("_k", F.row_number().over(w)).join(n, key)
    return ranked.filter((F.col("_n") <= 2) | (F.col("_k") <= F.ceil(F.col("_n") / factor))).drop("_n", "_k")
