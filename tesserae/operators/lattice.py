"""Concept lattices of many contexts at once, and the taxonomies that they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.sources.scratch import small, written

# Columns: c, a context; o, an object; a, an attribute's number in its context; b, an intent as sorted numbers.


def _numbered(incidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, o, a) and (c, a, attribute): attributes of a context under numbers from 1 in their order, with gaps."""
    rows = incidence.select(F.col("context").alias("c"), F.col("object").alias("o"), "attribute").filter("o is not null and attribute is not null").distinct()
    ordered = rows.select("c", "attribute").distinct().repartitionByRange("c", "attribute").sortWithinPartitions("c", "attribute")
    names = written(ordered.select("c", (F.monotonically_increasing_id() + 1).alias("a"), "attribute"))
    on = F.col("r.c").eqNullSafe(F.col("n.c")) & (F.col("r.attribute") == F.col("n.attribute"))
    return written(rows.alias("r").join(small(names).alias("n"), on).select("r.c", "o", "a")), names


def _closures(extents: DataFrame, incidence: DataFrame, after: Column) -> DataFrame:
    """(c, b, j, d): for each concept of extents (c, b, y, o) and each attribute j that some of its objects have, that b
    doesn't, and that meets the condition, the closure d of b and j.

    The objects that have j are found by the incidences of each object; an attribute is in the closure if
    as many of them have it as have j.
    """
    held = _extended(extents, incidence, after)
    counts = held.join(incidence.withColumnRenamed("a", "d"), ["k", "o"]).groupBy("k", "b", "j", "d").agg(F.count("*").alias("n"))
    closed = counts.groupBy("k", "b", "j").agg(F.max("n").alias("n"), F.collect_list(F.struct("d", "n")).alias("each"))
    return closed.select("k", "b", "j", F.array_sort(F.transform(F.filter("each", lambda x: x["n"] == F.col("n")), lambda x: x["d"])).alias("d"))


def _extended(extents: DataFrame, incidence: DataFrame, after: Column) -> DataFrame:
    """(k, b, j, o): objects of a concept that have attribute j too."""
    return extents.join(incidence.withColumnRenamed("a", "j"), ["k", "o"]).filter(after & ~F.array_contains("b", F.col("j"))).select("k", "b", "j", "o")


def _enumerated(incidence: DataFrame, max_rounds: int | None) -> DataFrame:
    """(k, b, o) of all concepts with objects: Close-by-One, a round for each step down.

    A concept with intent b that was made by attribute y is extended by the attributes j after y. The
    closure counts if it has no attribute before j that b hasn't: so each concept is made once, and no round
    compares with those before it.
    """
    everyone = incidence.select("k", "o").distinct()
    sizes = everyone.groupBy("k").agg(F.count("*").alias("n"))
    shared = incidence.groupBy("k", "a").agg(F.count("*").alias("m")).join(sizes, "k")
    top = shared.groupBy("k").agg(F.array_sort(F.collect_list(F.when(F.col("m") == F.col("n"), F.col("a")))).alias("b"))
    front = written(everyone.join(top, "k").select("k", "b", F.lit(0).cast("long").alias("y"), "o"))
    found = []
    while not front.isEmpty():
        if max_rounds is not None and len(found) > max_rounds:
            raise ValueError(f"intents are still new after {max_rounds} rounds")
        found.append(front.select("k", "b", "o"))
        closed = _closures(front, incidence, F.col("j") > F.col("y"))
        new = closed.filter(F.array_min(F.array_except("d", "b")) == F.col("j"))
        rows = _extended(front, incidence, F.col("j") > F.col("y")).join(new, ["k", "b", "j"])
        front = written(rows.select("k", F.col("d").alias("b"), F.col("j").alias("y"), "o"))
    out = found[0] if found else front.select("k", "b", "o")
    for x in found[1:]:
        out = out.unionByName(x)
    return out


class Lattices:
    """Concepts of each context of (context, object, attribute), their neighbours and reduced labels.

    Null contexts are one context; rows without object or attribute say nothing. A lattice may be exponential in its
    context's attributes, so contexts are to be small; their number may be any. An error is raised if concepts are
    still new after max_rounds steps down (None: any number).
    """

    def __init__(self, incidence: DataFrame, max_rounds: int | None = None):
        own, names = _numbered(incidence)
        # contexts by a number, so that joins need no care of nulls
        keys = names.select("c").distinct()
        self.keys = written(keys.withColumn("k", F.xxhash64("c")))
        self.names = written(self._keyed(names))
        self.incidence = written(self._keyed(own).select("k", "o", "a"))
        self.extents = written(_enumerated(self.incidence, max_rounds))
        self.last = self.names.groupBy("k").agg(F.array_sort(F.collect_list("a")).alias("all"))

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("k", F.xxhash64("c"))

    def intents(self) -> DataFrame:
        """(k, b) of all concepts; that of all attributes is one, whether an object has them all or not."""
        return self.extents.select("k", "b").unionByName(self.last.select("k", F.col("all").alias("b"))).distinct()

    def _named(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Contexts and intents under their names."""
        out = rows
        for c in columns:
            each = rows.select("k", c).distinct().select("k", c, F.explode_outer(c).alias("a")).join(self.names.select("k", "a", "attribute"), ["k", "a"], "left")
            own = each.groupBy("k", c).agg(F.array_sort(F.collect_list("attribute")).alias(f"_{c}"))
            out = out.join(own, ["k", c])
        keep = [x for x in rows.columns if x != "k"]
        return out.join(small(self.keys), "k").select(F.col("c").alias("context"), *[F.col(f"_{x}").alias(x) if x in columns else F.col(x) for x in keep])

    def concepts(self) -> DataFrame:
        """(context, intent, extent), both sorted."""
        held = self.extents.groupBy("k", "b").agg(F.array_sort(F.collect_list("o")).alias("extent"))
        rows = self.intents().join(held, ["k", "b"], "left")
        empty = F.array().cast(f"array<{self.incidence.schema['o'].dataType.simpleString()}>")
        return self._named(rows.select("k", F.col("b").alias("intent"), F.coalesce("extent", empty).alias("extent")), "intent")

    def covers(self, bottom: bool = True) -> DataFrame:
        """(k, upper, lower): a concept and the greatest below it.

        For each attribute that a concept hasn't, its closure with it is below; it is a neighbour if every one of
        the attributes that it adds gives the same closure, so that their number is all that has to be counted.
        Attributes that none of the concept's objects has give the concept of all attributes. Without `bottom` that one
        is left out where no object has all of them: its intent stands beside every lowest concept, which takes the
        square of the attributes.
        """
        closed = _closures(self.extents.withColumn("y", F.lit(0)), self.incidence, F.lit(True))
        some = closed.groupBy("k", "b", "d").agg(F.count("*").alias("n"))
        if not bottom:
            # an object with all attributes is in every concept, and then `some` has them all
            return some.filter(F.col("n") == F.size("d") - F.size("b")).select("k", F.col("b").alias("upper"), F.col("d").alias("lower"))
        seen = closed.groupBy("k", "b").agg(F.count("*").alias("n"))
        inner = self.extents.select("k", "b").distinct().join(small(self.last), "k")
        none = inner.join(seen, ["k", "b"], "left").select("k", "b", F.col("all").alias("d"), (F.size("all") - F.size("b") - F.coalesce("n", F.lit(0))).alias("n"))
        every = some.unionByName(none).groupBy("k", "b", "d").agg(F.sum("n").alias("n"))
        near = every.filter((F.col("n") > 0) & (F.col("n") == F.size("d") - F.size("b")))
        return near.select("k", F.col("b").alias("upper"), F.col("d").alias("lower"))

    def edges(self) -> DataFrame:
        """(context, upper, lower): intents of neighbours."""
        return self._named(self.covers(), "upper", "lower")

    def labelled(self, bottom: bool = True) -> DataFrame:
        """(k, b, objects, properties): the objects whose attributes are the intent, and the attributes whose greatest
        concept it is; each object and attribute stands at one concept of its context.

        Without `bottom` the concept of all attributes is left out where no object has all of them. It is no attribute's
        greatest one, as an object has each attribute, and with one row for each of its attributes it takes their square.
        """
        held = self.extents.select("k", "b").distinct()
        own = self.incidence.groupBy("k", "o").agg(F.array_sort(F.collect_list("a")).alias("b"))
        objects = own.groupBy("k", "b").agg(F.array_sort(F.collect_list("o")).alias("objects"))
        each = held.select("k", "b", F.explode("b").alias("a"))
        greatest = each.groupBy("k", "a").agg(F.min(F.struct(F.size("b").alias("n"), "b")).alias("g")).select("k", "a", "g.b")
        properties = greatest.join(self.names, ["k", "a"]).groupBy("k", "b").agg(F.array_sort(F.collect_list("attribute")).alias("properties"))
        concepts = self.intents() if bottom else held
        return concepts.join(objects, ["k", "b"], "left").join(properties, ["k", "b"], "left")

    def triples(self) -> DataFrame:
        """(context, subjects, properties, objects): from the objects of a concept to those of its lower neighbours, by
        the properties of these. Below a neighbour without objects of its own the nearest that have some stand for it."""
        labels = written(self.labelled(bottom=False))  # a concept without objects leads to none
        down = written(self.covers(bottom=False))
        named = labels.filter("objects is not null").select("k", "b", "objects")
        front = named.withColumnRenamed("objects", "subjects").join(down, (named.k == down.k) & (F.col("b") == F.col("upper"))).select(named.k, "subjects", "lower")
        front = front.join(labels.select("k", F.col("b").alias("lower"), "properties"), ["k", "lower"]).select("k", "subjects", F.coalesce("properties", F.array().cast("array<string>")).alias("properties"), "lower")
        front, seen, found = written(front.distinct()), None, None
        blank = labels.filter("objects is null").select("k", F.col("b").alias("lower"))
        while not front.isEmpty():
            hits = front.join(named.withColumnRenamed("b", "lower"), ["k", "lower"]).select("k", "subjects", "properties", "objects")
            found = hits if found is None else found.unionByName(hits)
            seen = front if seen is None else written(seen.unionByName(front))
            ahead = front.join(blank, ["k", "lower"]).withColumnRenamed("lower", "upper").join(down, ["k", "upper"]).select("k", "subjects", "properties", "lower").distinct()
            front = written(ahead.join(seen, ["k", "subjects", "properties", "lower"], "left_anti"))
        if found is None:
            found = front.join(named.withColumnRenamed("b", "lower"), ["k", "lower"]).select("k", "subjects", "properties", "objects")
        return found.distinct().join(small(self.keys), "k").select(F.col("c").alias("context"), "subjects", "properties", "objects")


def formal_concepts(incidence: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(intent, extent) of all concepts of one context (object, attribute)."""
    return Lattices(incidence.withColumn("context", F.lit(0)), max_rounds).concepts().select("intent", "extent")


def minimal_taxonomy(hypernyms: DataFrame) -> DataFrame:
    """(s, o), s a direct subclass of o: the taxonomy of nodes by what they all lead to (s, o).

    The lattice has the nodes as objects and what they lead to as attributes. A class is put below the objects of the
    concepts above it, and the objects of its own concept below the class: each at one place, and no shortcuts.

    Nodes that no other leads to and that lead to the same are alike: two of them stand for all in the lattice, so that
    what they share stays a concept, and the others get the classes of the first.
    """
    rows = written(hypernyms.select("s", "o").filter("s is not null and o is not null").distinct())
    lone = rows.groupBy("o").agg(F.count("*").alias("n"), F.min("s").alias("s")).filter("n = 1 and s = o").select("s")
    above = rows.join(lone, "s").groupBy("s").agg(F.array_sort(F.collect_list(F.when(F.col("s") != F.col("o"), F.col("o")))).alias("above"))
    above = written(above)
    pairs = written(above.groupBy("above").agg(F.min("s").alias("first"), F.max("s").alias("last")).filter("first <> last"))
    alike = written(above.join(small(pairs), "above").filter("s <> first and s <> last").select("s", "first"))
    few = rows.join(alike.select("s"), "s", "left_anti")
    steps = Lattices(few.select(F.lit(0).alias("context"), F.col("s").alias("object"), F.col("o").alias("attribute"))).triples()
    each = written(steps.select("subjects", F.explode("properties").alias("class"), "objects"))
    up = each.select(F.col("class").alias("s"), F.explode("subjects").alias("o"))
    down = each.select(F.explode("objects").alias("s"), F.col("class").alias("o")).filter("s <> o")
    found = written(up.unionByName(down).distinct())
    firsts = written(found.withColumnRenamed("s", "first").join(small(pairs.select("first")), "first", "left_semi"))
    return found.unionByName(alike.join(small(firsts), "first").select("s", "o"))
