"""Closures, components, centrality and lattices over edge tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators.lattice import formal_concepts  # noqa: F401
from tesserae.sources.scratch import written


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select(F.col("s").alias("a"), F.col("o").alias("b"))
    back = edges.select(F.col("o").alias("a"), F.col("s").alias("b"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def reachable(edges: DataFrame, seeds: DataFrame, direction: str = "out", depth: int | None = None) -> DataFrame:
    """(node, hops): the seeds and all that edges lead to from them, within `depth` hops if given.

    A frontier joins the edges each round and drops what was visited; rounds end with it, so cycles do no harm.
    """
    steps = written(_oriented(edges, direction))
    front = written(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    seen, hops = front, 0
    while depth is None or hops < depth:
        hops += 1
        new = front.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        front = written(new.join(seen, "node", "left_anti").withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hops % 5 == 0:
            seen = written(seen)
    return seen


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(a, b) for all b reachable from a in one hop or more. Only pairs found last are extended."""
    steps = written(edges.select(F.col("s").alias("a"), F.col("o").alias("b")).distinct())
    seen = front = steps
    hops = 1
    while depth is None or hops < depth:
        hops += 1
        longer = front.alias("f").join(steps.alias("e"), F.col("f.b") == F.col("e.a")).select("f.a", "e.b").distinct()
        front = written(longer.join(seen, ["a", "b"], "left_anti"))
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front)) if hops % 4 == 0 else seen.unionByName(front)
    return seen


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each weakly connected component, by alternating stars."""
    nodes = edges.select(F.explode(F.array("s", "o")).alias("node")).distinct()
    now = written(edges.filter("s <> o").select(F.greatest("s", "o").alias("a"), F.least("s", "o").alias("b")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    state = mark(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = written(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, mark(now)
        if state == before:
            break
    return nodes.join(now, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components, each named by its greatest node.

    Trim nodes without an edge in or out; colour the rest by the greatest node that reaches them; the nodes of a
    colour that its root is reached from are the root's component. Repeat with what is left.
    """
    left = written(edges.filter("s <> o").select("s", "o").distinct())
    done = edges.select(F.explode(F.array("s", "o")).alias("node")).distinct().withColumn("component", F.lit(None).cast("string"))
    found: list[DataFrame] = []
    while not left.isEmpty():
        while True:  # trim
            inner = left.select(F.col("s").alias("n")).intersect(left.select(F.col("o").alias("n")))
            kept = written(left.join(inner, F.col("s") == F.col("n"), "left_semi").join(inner, F.col("o") == F.col("n"), "left_semi"))
            if kept.count() == left.count():
                break
            left = kept
        if left.isEmpty():
            break
        colour = written(left.select(F.explode(F.array("s", "o")).alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            offered = left.join(colour, F.col("s") == F.col("node")).select(F.col("o").alias("node"), "c").unionByName(colour)
            after = written(offered.groupBy("node").agg(F.max("c").alias("c")))
            moved = after.join(colour.withColumnRenamed("c", "old"), "node").filter("c <> old")
            still = moved.isEmpty()
            colour = after
            if still:
                break
        inside = left.join(colour, F.col("s") == F.col("node")).select("s", "o", F.col("c").alias("cs"))
        inside = written(inside.join(colour, F.col("o") == F.col("node")).filter("cs = c").select("s", "o", "c"))
        own = written(colour.filter("node = c"))
        front = own
        while True:
            back = inside.join(front, (inside.o == front.node) & (inside.c == front.c)).select(F.col("s").alias("node"), inside.c).distinct()
            front = written(back.join(own, ["node", "c"], "left_anti"))
            if front.isEmpty():
                break
            own = written(own.unionByName(front))
        found.append(own)
        gone = own.select(F.col("node").alias("n"))
        left = written(left.join(gone, F.col("s") == F.col("n"), "left_anti").join(gone, F.col("o") == F.col("n"), "left_anti"))
    named = done.select("node")
    if found:
        all_found = found[0]
        for f in found[1:]:
            all_found = all_found.unionByName(f)
        return named.join(all_found, "node", "left").select("node", F.coalesce("c", "node").alias("component"))
    return named.withColumn("component", F.col("node"))


def rooted_edges(edges: DataFrame, ordered_roots: DataFrame) -> DataFrame:
    """Edges that a root reaches, each with the first root (by ord) that does."""
    pairs = closure(edges).select(F.col("a").alias("root"), F.col("b").alias("node"))
    reach = ordered_roots.select(F.col("node").alias("root"), "ord").join(pairs, "root").unionByName(ordered_roots.select(F.col("node").alias("root"), "ord", "node"))
    owner = reach.groupBy("node").agg(F.min_by("root", "ord").alias("root"))
    return edges.join(owner, edges.s == owner.node).select("root", "s", "p", "o")


def _dealt_join(left: DataFrame, right: DataFrame, key: str, block: int = 2000) -> DataFrame:
    """Join by a key that many rows on both sides may have: they meet in cells of about `block` rows by `block`.

    So a key's pairs are made by as many tasks as they need, however few rows they come of. Of the partitions none are
    merged by the sizes of what goes in, as what comes out may be the square of it.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda df, n: df.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    cells = written(blocks(left, "_m").join(blocks(right, "_n"), key))
    place = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = [key, "_i", "_j"]
    one = left.join(cells, key).select("*", place(left, "_m").alias("_i"), every("_n").alias("_j")).drop("_m", "_n")
    two = right.join(cells, key).select("*", place(right, "_n").alias("_j"), every("_m").alias("_i")).drop("_m", "_n")
    return one.repartition(parts, *at).join(two.repartition(parts, *at), at).drop("_i", "_j")


def equivalence_edges(triples: DataFrame, equivalence: Iterable[str]) -> DataFrame:
    """All triples, with out-edges of a node copied to its equivalents and in-edges alike, not both ends at once.

    A class that many of its members name gives a triple for each two of them. They are made once each, so that nothing
    of this size is sorted or shuffled.
    """
    classes = written(weak_components(triples.filter(F.col("p").isin(*equivalence))))
    own = written(triples.select("s", "p", "o").distinct())
    class_of = lambda x: classes.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    known = written(own.join(class_of("s"), "s", "left").join(class_of("o"), "o", "left").select("s", "p", "o", "cs", "co"))
    members = lambda x: classes.select(F.col("component").alias("k"), F.col("node").alias(x))
    # what a class says as a whole, and what is said of it, once, then under the name of each member
    out = written(known.filter("cs is not null").select(F.col("cs").alias("k"), "p", "o").distinct())
    into = written(known.filter("co is not null").select(F.col("co").alias("k"), "s", "p", "cs").distinct())
    # where a class speaks of a class, some of this was said by the first as a whole: those members are left out
    both = F.struct("cs", "p", F.col("k").alias("co"))
    between = written(into.filter("cs is not null").select(both.alias("k"), "s"))
    said = known.filter("cs is not null and co is not null").select(F.struct("cs", "p", "co").alias("k"), "o").distinct()
    asked = between.select("k").distinct().withColumn("c", F.col("k.co"))
    unsaid = asked.join(members("o").withColumnRenamed("k", "c"), "c").select("k", "o").join(said, ["k", "o"], "left_anti")
    parts = [
        known.filter("cs is null and co is null").select("s", "p", "o"),
        _dealt_join(out, members("s"), "k").select("s", "p", "o"),
        _dealt_join(into.filter("cs is null").select("k", "s", "p"), members("o"), "k").select("s", "p", "o"),
        _dealt_join(between, written(unsaid), "k").select("s", "k.p", "o"),
    ]
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    return found


def betweenness(edges: DataFrame, batch: int | None = None, sources: int | None = None) -> DataFrame:
    """(node, raw, normalised) of directed betweenness: shortest-path counts forward by levels, dependencies back.

    Sources are taken about `batch` at a time (None: all at once), and what they give is added up, so that no more than
    batch times nodes rows are held. With `sources`, about so many nodes, picked by a hash, stand for all: raw is
    what they give times the share they are, an unbiased estimate. Its standard error for a node is at most the number
    of nodes squared over twice the square root of `sources`, as one source gives a node less than the number of
    nodes. As many sources as nodes, or more, make it exact.
    """
    steps = written(edges.filter("s <> o").select(F.col("s").alias("u"), F.col("o").alias("v")).distinct())
    nodes = written(edges.select(F.explode(F.array("s", "o")).alias("node")).distinct())
    n = nodes.count()
    picked = nodes
    if sources is not None and sources < n:
        # the least hashes, so that their number is the one asked for
        picked = written(nodes.orderBy(F.xxhash64("node", F.lit(0)), "node").limit(sources))
    chosen = n if picked is nodes else sources
    batches = 1 if batch is None else max(1, -(-chosen // batch))
    total = None
    for i in range(batches):
        part = picked if batches == 1 else picked.filter(F.pmod(F.xxhash64("node"), F.lit(batches)) == i)
        given = written(_dependencies(part, steps))
        total = given if total is None else written(total.unionByName(given).groupBy("node").agg(F.sum("raw").alias("raw")))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    raw = F.coalesce("raw", F.lit(0.0)) * (n / chosen if chosen else 0.0)
    return nodes.join(total, "node", "left").select("node", raw.alias("raw")).withColumn("normalised", F.col("raw") * scale)


def _dependencies(sources: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, raw): how much the shortest paths from some sources depend on each node."""
    levels = [written(sources.select(F.col("node").alias("src"), "node", F.lit(1.0).alias("sigma")))]
    seen = levels[0].select("src", "node")
    while True:
        ahead = levels[-1].join(steps, F.col("node") == F.col("u")).groupBy("src", "v").agg(F.sum("sigma").alias("sigma"))
        new = written(ahead.withColumnRenamed("v", "node").join(seen, ["src", "node"], "left_anti"))
        if new.isEmpty():
            break
        levels.append(new)
        seen = written(seen.unionByName(new.select("src", "node")))
    delta = levels[-1].select("src", "node", "sigma", F.lit(0.0).alias("delta"))
    parts = []
    for upper in reversed(levels[:-1]):
        below = delta.select("src", F.col("node").alias("v"), F.col("sigma").alias("sv"), F.col("delta").alias("dv"))
        given = upper.join(steps, F.col("node") == F.col("u")).join(below, ["src", "v"])
        given = given.groupBy("src", "node").agg(F.sum(F.col("sigma") / F.col("sv") * (1 + F.col("dv"))).alias("delta"))
        delta = written(upper.join(given, ["src", "node"], "left").select("src", "node", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        parts.append(delta.filter("src <> node").select("node", "delta"))
    total = parts[0] if parts else sources.select("node", F.lit(0.0).alias("delta"))
    for x in parts[1:]:
        total = total.unionByName(x)
    return total.groupBy("node").agg(F.sum("delta").alias("raw"))


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges of an acyclic graph that no longer path replaces."""
    direct = edges.select("s", "o").distinct()
    reach = written(closure(edges))
    longer = direct.alias("e").join(reach.alias("c"), F.col("e.o") == F.col("c.a")).select(F.col("e.s").alias("s"), F.col("c.b").alias("o")).distinct()
    return direct.join(longer, ["s", "o"], "left_anti")


def deanonymise(edges: DataFrame, is_anonymous: Column) -> DataFrame:
    """Replace unnamed objects by the named nodes that are reached through unnamed ones only.

    is_anonymous is a condition on a column called node.
    """
    flags = edges.select(F.explode(F.array("s", "o")).alias("node")).distinct().withColumn("anon", is_anonymous)
    flags = written(flags)
    obj = edges.join(flags.select(F.col("node").alias("o"), "anon"), "o").select("s", "p", "o", "anon")
    done = written(obj.filter("not anon").select("s", "p", "o"))
    front, seen = written(obj.filter("anon").select("s", "p", "o").distinct()), None
    hop = written(obj.select(F.col("s").alias("o"), F.col("o").alias("o2"), "anon"))
    while not front.isEmpty():
        seen = front if seen is None else written(seen.unionByName(front))
        ahead = written(front.join(hop, "o").select("s", "p", F.col("o2").alias("o"), "anon").distinct())
        done = done.unionByName(ahead.filter("not anon").select("s", "p", "o"))
        front = written(ahead.filter("anon").select("s", "p", "o").join(seen, ["s", "p", "o"], "left_anti"))
    unnamed = flags.filter("anon").select(F.col("node").alias("s"))
    return done.distinct().join(unnamed, "s", "left_anti").select("s", "p", "o")


def biggest_component(edges: DataFrame) -> DataFrame:
    """Edges of the weak component that has most (ties to the least node)."""
    own = written(edges.join(weak_components(edges), edges.s == F.col("node")).select("component", "s", "p", "o"))
    first = own.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return own.join(F.broadcast(first.select("component")), "component", "left_semi").select("s", "p", "o")


def component_sizes(edges: DataFrame) -> DataFrame:
    own = edges.join(weak_components(edges), edges.s == F.col("node"))
    return own.groupBy("component").agg(F.count("*").alias("n_edges"))


def ordered_ranks(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def entry_points(edges: DataFrame) -> DataFrame:
    """Nodes from which all others are reached: roots, and the greatest node of each strong component of several."""
    from tesserae.operators.sets import roots

    strong = written(strong_components(edges))
    several = strong.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("component").alias("node"))
    return roots(edges).unionByName(several).distinct()


def nested_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(root, path, node, depth): the tree that unfolding the graph gives, cut at nodes that are on their own path."""
    steps = written(edges.select("s", "o").distinct())
    level = written(seeds.select(F.col("node").alias("root"), F.array("node").alias("nodes"), "node"))
    out = [level.withColumn("depth", F.lit(0))]
    for k in range(1, depth + 1):
        ahead = level.join(steps, F.col("node") == F.col("s")).filter(~F.array_contains("nodes", F.col("o")))
        level = written(ahead.select("root", F.array_append("nodes", F.col("o")).alias("nodes"), F.col("o").alias("node")))
        out.append(level.withColumn("depth", F.lit(k)))
    tree = out[0]
    for x in out[1:]:
        tree = tree.unionByName(x)
    return tree.select("root", F.array_join("nodes", "/").alias("path"), "node", "depth")


def dendrogram(vectors: DataFrame) -> DataFrame:
    """(group, step, a, b, size, distance) of centroid linkage within each group of (group, id, vector).

    Clusters are named by their least id; every step joins the two whose centroids are nearest (ties by name). Each step
    needs the one before, so a group is one task. It holds the centroids and the nearest later neighbour of each, not the
    distances of all pairs; time grows with the square of a group.
    """
    return vectors.groupBy("group").applyInPandas(_linkage, "group long, step int, a long, b long, size int, distance double")


#: Squared differences that are held at once while distances are computed.
_CELLS = 1 << 20


def _linkage(rows):
    import numpy as np
    import pandas as pd

    ordered = rows.sort_values("id")
    ids = ordered["id"].to_numpy()
    centre = np.array(ordered["vector"].tolist(), dtype=float).reshape(len(ids), -1)
    n, count = np.ones(len(ids)), len(ids)
    step_rows = max(1, _CELLS // max(1, centre.shape[1]))
    # clusters that are still there, by name; their rows are moved together as others go
    place = np.arange(count)

    def distances(i, lo):
        """From place i to places lo and later."""
        parts = [np.sqrt(((centre[k : min(k + step_rows, count)] - centre[i]) ** 2).sum(-1)) for k in range(lo, count, step_rows)]
        return np.concatenate(parts) if parts else np.empty(0)

    near, far = np.full(count, -1), np.full(count, np.inf)

    def look(i):
        """The nearest of the later clusters, the first of equals."""
        own = distances(i, i + 1)
        if len(own):
            j = int(np.argmin(own))
            near[i], far[i] = i + 1 + j, own[j]
        else:
            near[i], far[i] = -1, np.inf

    for i in range(count):
        look(i)
    names, out = ids[place], []
    for step in range(len(ids) - 1):
        i = int(np.argmin(far[:count]))
        j = int(near[i])
        out.append((rows["group"].iloc[0], step, names[i], names[j], int(n[i] + n[j]), float(far[i])))
        centre[i] = (centre[i] * n[i] + centre[j] * n[j]) / (n[i] + n[j])
        n[i] += n[j]
        lost = (near[:count] == i) | (near[:count] == j)
        # the rows after j move up by one
        for x in (centre, n, names, near, far):
            x[j : count - 1] = x[j + 1 : count]
        lost = np.delete(lost, j)
        count -= 1
        near[:count][near[:count] > j] -= 1
        lost[i] = True
        for k in np.flatnonzero(lost):
            look(int(k))
        # earlier clusters whose nearest is still there may find the new one nearer
        if i:
            own = np.concatenate([np.sqrt(((centre[k : min(k + step_rows, i)] - centre[i]) ** 2).sum(-1)) for k in range(0, i, step_rows)])
            nearer = ~lost[:i] & ((own < far[:i]) | ((own == far[:i]) & (i < near[:i])))
            near[:i][nearer], far[:i][nearer] = i, own[nearer]
    return pd.DataFrame(out, columns=["group", "step", "a", "b", "size", "distance"])
