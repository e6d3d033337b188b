"""Exact top-k inner-product search by sorted lists read in sequence, without random access."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import cut

#: Candidates whose sorted lists one task holds, and queries that it answers from them.
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 16_384
#: Looks at the bounds, as shares of the lists that are read by then. Share of a block's rows that may be left for
#: resolution when a query stops. Queries that read the lists together, and how many of a block go ahead to tell the others
#: where a first look pays.
LOOKS, LEFT_SHARE, TOGETHER, AHEAD = (4 / 16, 8 / 16, 10 / 16, 11 / 16, 12 / 16, 14 / 16, 1.0), 1 / 8, 32, 8


class SortedLists:
    """A list for each dimension with its components in order, and the length of each row's vector.

    Queries read the lists in step, a part at a time, each from the end that suits the sign of the query's component. A
    part of all lists is a matrix with zeros for what lies elsewhere, so that what many queries read of it adds up in
    one product.
    """

    def __init__(self, vectors: np.ndarray):
        self.n, self.dims = vectors.shape
        top = float(np.abs(vectors).max(initial=0))
        self.scale = 2.0 ** np.ceil(np.log2(top)) if top > 0 else 1.0  # squares stay in range
        self.columns = np.ascontiguousarray((vectors / self.scale).T)
        order = np.argsort(self.columns, axis=1, kind="stable")
        self.values = np.take_along_axis(self.columns, order, axis=1)
        self.places = np.empty_like(order, dtype=np.int32)
        np.put_along_axis(self.places, order, np.broadcast_to(np.arange(self.n, dtype=np.int32), order.shape), axis=1)
        self.squares = (self.columns * self.columns).sum(axis=0)
        self.ends = [max(1, min(self.n, math.ceil(self.n * x))) for x in LOOKS]
        self.parts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        #: For each query the share of the lists that it read.
        self.depths: list[float] = []

    def candidates(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[np.ndarray]:
        """For each query the rows that may be among its k best (its own row is not), found by sequential reads alone."""
        if self.n <= k:
            return [np.arange(self.n)] * len(queries)
        found = self._read(queries[:AHEAD], k, own[:AHEAD], self.ends)
        first = max(1, round(float(np.median(self.depths[-len(found) :])) * self.n)) if found else 1
        ends = [to for to in self.ends if to >= first] or self.ends
        self.parts.clear()
        for at in range(AHEAD, len(queries), TOGETHER):
            found += self._read(queries[at : at + TOGETHER], k, own[at : at + TOGETHER], ends)
        return found

    def _part(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries a to b - 1 of each list: components, their squares and where they are, from the upper ends and from the lower ones."""
        if (a, b) not in self.parts:
            there = np.concatenate([(self.places >= self.n - b) & (self.places < self.n - a), (self.places >= a) & (self.places < b)])
            values = np.where(there, np.concatenate([self.columns, self.columns]), 0).astype(np.float32)
            self.parts[a, b] = values, values * values, there.astype(np.float32)
        return self.parts[a, b]

    def _read(self, queries: np.ndarray, k: int, own: np.ndarray, ends: list[int]) -> list[np.ndarray]:
        """Read until rows of which nothing was read can't qualify and few of the others can; those are returned.

        A row's score is the sum over its components read so far, plus a rest. The rest is at most, either way, the
        product of the lengths of what is left of both vectors, and at most the sum of the lists' frontiers (the
        last values read) where these add anything. The k-th best lower bound is the bar. Sums are of single precision;
        `loose` is more than they can be wrong by, relative to the lengths.
        """
        n, count = self.n, len(queries)
        found: list[np.ndarray] = [np.arange(n)] * count
        depths = np.zeros(count)
        live = np.flatnonzero(np.abs(queries).max(axis=1, initial=0) > 0)
        q = queries[live] / np.abs(queries[live]).max(axis=1, keepdims=True)
        signed = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
        loose = 1.2e-7 * (2 * self.dims + 8)
        length = (q * q).sum(axis=1)
        longest = np.sqrt(length * float(self.squares.max()))
        slack = loose * longest + 1e-30
        few = max(4 * k, n * LEFT_SHARE)
        squares = self.squares.astype(np.float32)
        score, mass, used = (np.zeros((len(live), n), np.float32) for _ in range(3))
        for read, to in zip([0, *ends], ends):
            if not len(live):
                break
            values, products, there = self._part(read, to)
            single = signed.astype(np.float32)
            score += single @ values
            if to < n:
                mass += (single != 0).astype(np.float32) @ products
                used += (single * single) @ there
                upper, lower = np.maximum(self.values[:, n - to], 0), np.minimum(self.values[:, to - 1], 0)
                frontier = signed @ np.concatenate([upper, lower])
                rest = np.maximum(length.astype(np.float32)[:, None] - used, 0) + (loose * length).astype(np.float32)[:, None]
                rest *= np.maximum(squares - mass, 0) + np.float32(loose) * squares
                np.sqrt(rest, out=rest)
                least = score - rest
                least[used == 0] = -np.inf
                most = score + np.minimum(rest, frontier.astype(np.float32)[:, None])
            else:
                frontier, least, most = np.zeros(len(live)), score.copy(), score
            mine = np.flatnonzero(own[live] >= 0)
            least[mine, own[live][mine]] = -np.inf
            bar = _kth_best(least, k) - 2 * slack
            hits = most >= bar.astype(np.float32)[:, None] - 1e-6 * np.abs(bar)[:, None].astype(np.float32)
            if to < n:
                hits &= used > 0
            done = (np.minimum(frontier, longest) < bar) & (hits.sum(axis=1) <= few) | (to == n)
            for i in np.flatnonzero(done):
                found[live[i]] = np.flatnonzero(hits[i])
            depths[live[done]] = to / n
            stay = ~done
            live, signed, length, longest, slack = live[stay], signed[stay], length[stay], longest[stay], slack[stay]
            score, mass, used = score[stay], mass[stay], used[stay]
        self.depths += depths.tolist()
        return found


def _kth_best(bounds: np.ndarray, k: int) -> np.ndarray:
    """A value that at least k columns of each row reach: the k-th best of the best ones of groups of 16 columns."""
    groups = bounds.shape[1] // 16
    if groups >= 16 * k:
        bounds = bounds[:, : 16 * groups].reshape(len(bounds), 16, groups).max(axis=1)
    n = bounds.shape[1]
    return np.partition(bounds, n - k, axis=1)[:, n - k].astype(np.float64)


def _exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * len(query)
    if bound < 2**53:
        return (vectors @ query).astype(np.int64)
    if bound < 2**62:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors], dtype=object)


def _best(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> list[tuple]:
    """The k highest of these (score, id, uid), ties to the smaller id."""
    if len(scores) > k and scores.dtype != object:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, ids, uids = scores[near], ids[near], uids[near]
    return sorted(zip((-scores).tolist(), ids.tolist(), uids.tolist(), strict=True))[:k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def _search(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and rows.num_rows:
            vectors, wanted = _matrix(rows.column("v")), _matrix(queries.column("v"))
            uid, ids = np.asarray(rows.column("uid")), np.asarray(rows.column("vec_id"))
            lists = SortedLists(vectors)
            where = {u: i for i, u in enumerate(uid.tolist())}
            q_uid, q_id = queries.column("uid").to_pylist(), queries.column("vec_id").to_pylist()
            own = np.array([where.get(u, -1) for u in q_uid])
            for u, i, q, rows_ in zip(q_uid, q_id, wanted, lists.candidates(wanted, k, own), strict=True):
                rows_ = rows_[uid[rows_] != u]
                scores = _exact_scores(vectors[rows_], q)
                out += [(u, i, v, w, -x) for x, v, w in _best(scores, ids[rows_], uid[rows_], k)]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_uid", "query_id", "vec_id", "uid", "score"])

    return run


def quantised(embedding: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x); null if the vector or a component is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """The k highest integer inner products of each query with all other rows: query_id, rank, vec_id, score.

    vectors has vec_id and embedding; is_query picks the queries by vec_id. Ties go to the smaller vec_id. Rows
    without id, or whose vector is null, empty or not finite, take no part; vectors of unlike lengths have
    no score with each other. Of rows with one vec_id each is a candidate and, if picked, a query of its own.
    Queries meet candidates block by block, both of bounded size; only k rows leave a block for each query.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"))
    rows = rows.filter("vec_id is not null and size(v) > 0").withColumn("uid", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("dim", F.size("v")), "vectors")
    wanted = rows.filter(is_query)
    n_rows, n_wanted = rows.count(), wanted.count()
    row_blocks, query_blocks = max(1, math.ceil(n_rows / CANDIDATE_BLOCK)), max(1, math.ceil(n_wanted / QUERY_BLOCK))
    spread = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.withColumn("qb", spread(query_blocks)).withColumn("cb", every(row_blocks))
    right = rows.withColumn("cb", spread(row_blocks)).withColumn("qb", every(query_blocks))
    keys = ["dim", "qb", "cb"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), "query_uid long, query_id long, vec_id long, uid long, score long")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
