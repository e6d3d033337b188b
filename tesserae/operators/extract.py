"""Operators over parsed tokens: tree closures, spans, couples and the triples they give.

tokens: (sent_id, i, text, lemma, pos, dep, head); the root is its own head.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.sources.scratch import small, written


def _climbed(rows: DataFrame, ends: bool) -> DataFrame:
    """(sent_id, i, ancestor, distance, flags): tokens with what lies above them, sentence by sentence.

    rows: (sent_id, i, head, flags). flags of a token and of those between it and the ancestor are joined by AND. With
    ends, rows without a head name the ancestors that are wanted; else all are. A sentence's rows meet in one, and many
    sentences are climbed at once, a level at a time.
    """

    def climb(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            token = lists.flatten()
            i, flags = (token.field(k).to_numpy(zero_copy_only=False).astype("i8") for k in (0, 2))
            named = token.field(1).is_null().to_numpy(zero_copy_only=False)
            head = token.field(1).fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
            if not len(i):
                continue
            least = min(i.min(), head.min())
            span = max(i.max(), head.max()) - least + 1
            # rows without a sentence have none in common
            code = lambda x: row * span + x - least
            wanted = np.unique(code(i)[named])
            row, i, flags, head = (x[~named] for x in (row, i, flags, head))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)[row]
            order = np.argsort(code(i), kind="stable")
            own, up = code(i)[order], code(head)
            at = np.minimum(np.searchsorted(own, up), max(0, len(own) - 1))
            above = np.where((own[at] == up) & known, order[at], -1) if len(own) else at
            start = now = np.arange(len(i))
            seen = flags
            for distance in range(1, len(i) + 1):
                if not len(start):
                    break
                out = np.isin(up[now], wanted) & known[now] if ends else np.ones(len(now), dtype=bool)
                sent = batch.column(0).take(pa.array(row[start[out]]))
                values = (i[start[out]], head[now[out]], np.full(out.sum(), distance), seen[out])
                yield pa.RecordBatch.from_arrays([sent, *[pa.array(v.astype("i4")) for v in values]], ["sent_id", "i", "ancestor", "distance", "flags"])
                on = above[now] >= 0
                start, now = start[on], above[now[on]]
                seen = seen[on] & flags[now]

    sentences = rows.groupBy("sent_id").agg(F.collect_list(F.struct("i", "head", "flags")).alias("tokens"))
    kind = rows.schema["sent_id"].dataType.simpleString()
    return sentences.mapInArrow(climb, f"sent_id {kind}, i int, ancestor int, distance int, flags int")


def ancestors(tokens: DataFrame) -> DataFrame:
    """(sent_id, i, ancestor, distance) for every proper ancestor of a token. A sentence is a tree of bounded depth."""
    return _climbed(tokens.filter("i <> head").select("sent_id", "i", "head", F.lit(0).alias("flags")), ends=False).drop("flags")


def descendants(tokens: DataFrame, cores: DataFrame, flags: list[Column]) -> DataFrame:
    """(sent_id, core, i, flags): the tokens below each core (sent_id, i), and which flags hold all the way, as bits."""
    bits = F.lit(0)
    for k, flag in enumerate(flags):
        bits = bits + F.when(flag, F.lit(1 << k)).otherwise(F.lit(0))
    edges = tokens.filter("i <> head").select("sent_id", "i", "head", bits.alias("flags"))
    ends = cores.select("sent_id", "i", F.lit(None).cast("int").alias("head"), F.lit(0).alias("flags"))
    return _climbed(edges.unionByName(ends), ends=True).select("sent_id", F.col("ancestor").alias("core"), "i", "flags")


def core_pairs(cores: DataFrame) -> DataFrame:
    """Unordered pairs of core concepts of one sentence: (sent_id, a, b)."""
    x, y = cores.alias("x"), cores.alias("y")
    return x.join(y, (F.col("x.sent_id") == F.col("y.sent_id")) & (F.col("x.i") < F.col("y.i"))).select("x.sent_id", F.col("x.i").alias("a"), F.col("y.i").alias("b"))


def paths(tokens: DataFrame, cores: DataFrame) -> DataFrame:
    """(sent_id, a, b, meet, length): the closest common ancestor of two cores, unless the path crosses a third core."""
    own = ancestors(tokens).unionByName(tokens.select("sent_id", "i", F.col("i").alias("ancestor"), F.lit(0).alias("distance")))
    own = written(own)
    left = own.select("sent_id", F.col("i").alias("a"), F.col("ancestor").alias("meet"), F.col("distance").alias("da"))
    right = own.select("sent_id", F.col("i").alias("b"), F.col("ancestor").alias("meet"), F.col("distance").alias("db"))
    met = core_pairs(cores).join(left, ["sent_id", "a"]).join(right, ["sent_id", "b", "meet"])
    best = met.groupBy("sent_id", "a", "b").agg(F.min_by(F.struct("meet", "da", "db"), F.struct(F.col("da") + F.col("db"), "meet")).alias("m"))
    best = written(best.select("sent_id", "a", "b", "m.*"))
    third = cores.select("sent_id", F.col("i").alias("c"))
    below = own.select("sent_id", F.col("ancestor").alias("c"), F.col("i").alias("end"), F.col("distance").alias("dc"))
    crossing = best.join(third, "sent_id").filter("c <> a and c <> b").join(below, ["sent_id", "c"])
    crossing = crossing.filter("(end = a and dc <= da) or (end = b and dc <= db)").select("sent_id", "a", "b").distinct()
    return best.join(crossing, ["sent_id", "a", "b"], "left_anti").select("sent_id", "a", "b", "meet", (F.col("da") + F.col("db")).alias("length"))


def couples(concepts: DataFrame, predicates: DataFrame) -> DataFrame:
    """(sent_id, concept, predicate): concepts and predicates of one core whose spans have no token in common.

    concepts: (sent_id, core, concept, span); predicates: (sent_id, core, predicate, span).
    """
    c, p = concepts.alias("c"), predicates.alias("p")
    on = (F.col("c.sent_id") == F.col("p.sent_id")) & (F.col("c.core") == F.col("p.core"))
    return c.join(p, on).filter(~F.arrays_overlap("c.span", "p.span")).select("c.sent_id", "concept", "predicate")


def trim_span(tokens: DataFrame, key: list[str], noise: Column) -> DataFrame:
    """Tokens between the first and the last of each span that aren't noise."""
    ends = tokens.filter(~noise).groupBy(*key).agg(F.min("i").alias("_first"), F.max("i").alias("_last"))
    return tokens.join(ends, key).filter(F.col("i").between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def couple_filter(tokens: DataFrame, stop_words: DataFrame, word: str = "word") -> DataFrame:
    """Words that are neither empty, nor stop words, nor hold a digit."""
    fine = tokens.filter((F.col(word) != "") & ~F.col(word).rlike("[0-9]"))
    return fine.join(small(stop_words.select(F.col("stop").alias(word))), word, "left_anti")


def couple_triples(subjects: DataFrame, objects: DataFrame) -> DataFrame:
    """(s, p, o, source): subjects and objects that share predicate and source; both are (predicate, source, concept)."""
    s = subjects.select("predicate", "source", F.col("concept").alias("s")).distinct()
    o = objects.select("predicate", "source", F.col("concept").alias("o")).distinct()
    return s.join(o, ["predicate", "source"]).select("s", F.col("predicate").alias("p"), "o", "source")


def suffix_chain(names: DataFrame, name: str = "name") -> DataFrame:
    """(s, o): each concept and the same without its first word, down to the last one."""
    words = F.split(F.col(name), " ")
    each = names.select(words.alias("w")).select("w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1)))).alias("k")).filter("size(w) > 1")
    tail = lambda k: F.array_join(F.slice("w", k, F.size("w")), " ")
    return each.select(tail(F.col("k")).alias("s"), tail(F.col("k") + 1).alias("o")).filter("s <> o").distinct()
