"""Importance resampling towards a target distribution: hashed features, noisy scores, merged sorted runs."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import bound_batches, cut, slices, utf8_buffer, words_of

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Rows of a block of a run; eligible rows for which there is one more range, and the most ranges; keys sampled for each.
BLOCK_ROWS, RANGE_ROWS, MOST_RANGES, SAMPLES = 4096, 16_384, 4096, 32

_SEPARATES = np.ones(256, bool)
_SEPARATES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32_after(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Registers of CRC-32 after the bytes starts to ends - 1 of each, a byte of all words at a time."""
    size = ends - starts
    out = state.copy()
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    order = np.argsort(-np.where(size > LONG_WORD, 0, size), kind="stable")
    order = order[: int(((size > 0) & (size <= LONG_WORD)).sum())]
    at, own, left = starts[order], out[order], size[order]
    for j in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -j, "left"))  # words of more than j bytes come first
        own[:n] = _CRC[(own[:n] ^ raw[at[:n] + j]) & 255] ^ (own[:n] >> np.uint32(8))
    out[order] = own
    return out


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index and bucket of every feature of the texts in a buffer; the texts' numbers of words.

    A feature is a run of 1 to `longest` words, A-Z lower-cased, joined by a space; its bucket is its CRC-32 modulo
    `buckets`.
    """
    raw = _LOWER[raw]
    starts, ends, doc = words_of(raw, offsets, _SEPARATES)
    owners, found = [], []
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    first = np.arange(len(starts))
    for n in range(longest):
        if n:
            on = first[first + n < len(doc)]
            on = on[doc[on + n] == doc[on]]
            state = state[np.searchsorted(first, on)]
            state = _CRC[(state ^ np.uint32(0x20)) & 255] ^ (state >> np.uint32(8))
            first = on
        state = crc32_after(state, raw, starts[first + n], ends[first + n])
        owners.append(doc[first])
        found.append(((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(found), np.bincount(doc, minlength=len(offsets) - 1)


def _count(buckets: int, longest: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(iter(batches)):
            total += np.bincount(features(*utf8_buffer(b.column(0)), buckets, longest)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts in each bucket. A task gives a row for each bucket at most, as does the sum."""
    bound_batches(texts.sparkSession)
    counted = texts.select("text").mapInArrow(_count(buckets, longest), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(target's smoothed share / source's)) of each bucket."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weigh(gain: np.ndarray, longest: int):
    """Over rows (doc_id, text): doc_id, n_words, n_features, weight."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(iter(batches)):
            owner, bucket, words = features(*utf8_buffer(b.column(1)), len(gain), longest)
            weight = np.bincount(owner, gain[bucket], b.num_rows).astype(np.int64)  # exact below 2 ** 53
            columns = [b.column(0), pa.array(words), pa.array(np.bincount(owner, minlength=b.num_rows)), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))), u being made of the first 32 bits of a digest of seed and doc_id (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


#: The order of the draw: higher score, smaller doc_id (null last), row.
KEY = ["falling", "no_doc", "doc", "uid"]
BODY = [*KEY, "n_features", "weight"]


def _splitters(rows: DataFrame, n: int) -> np.ndarray:
    """Keys that part the rows in ranges of like sizes, from a bounded sample. No result depends on them."""
    ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
    if ranges < 2:
        return np.zeros((0, len(KEY)), np.int64)
    step = max(1, n // (SAMPLES * ranges))
    sample = np.array([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("uid"), F.lit(step)) == 0).select(*KEY).collect()], np.int64).reshape(-1, len(KEY))
    sample = sample[np.lexsort(sample.T[::-1])]
    return sample[np.arange(1, ranges) * len(sample) // ranges] if len(sample) else sample


def _runs(splitters: np.ndarray):
    """Over rows BODY in order: the task's sorted run in blocks (range, run, KEY of the first row, n, body) of one range each."""
    schema = pa.schema([("range", pa.int32()), ("run", pa.int64()), *((c, pa.int64()) for c in KEY), ("n", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        for b in batches:
            rows = np.stack([np.asarray(b.column(i), dtype=np.int64) for i in range(len(BODY))], axis=1)
            both = np.concatenate([splitters, rows[:, : len(KEY)]])
            order = np.lexsort(both.T[::-1])
            passed = np.cumsum(order < len(splitters))
            place = np.empty(len(both), np.int64)
            place[order] = passed
            place = place[len(splitters) :]
            heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(rows) else []
            blocks = [(a + i, min(z, a + i + BLOCK_ROWS)) for a, z in zip(heads, [*heads[1:], len(rows)], strict=True) for i in range(0, z - a, BLOCK_ROWS)]
            out = [(int(place[a]), own, *rows[a, : len(KEY)].tolist(), z - a, rows[a:z].tobytes()) for a, z in blocks]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


class Tournament:
    """Who is least among the heads of some runs: every match of the tree keeps its winner, and a new head replays log k."""

    DONE = (float("inf"),)

    def __init__(self):
        self.size = 1
        self.heads: list[tuple] = [self.DONE]
        self.tree = [0, 0]

    def set(self, run: int, head: tuple) -> None:
        """The head of a run; DONE if it has none."""
        if run >= self.size:
            while run >= self.size:
                self.size *= 2
            self.heads += [self.DONE] * (self.size - len(self.heads))
            self.tree = [0] * self.size + list(range(self.size))
            self.heads[run] = head
            for match in range(self.size - 1, 0, -1):
                self._play(match)
            return
        self.heads[run] = head
        match = (self.size + run) // 2
        while match:
            self._play(match)
            match //= 2

    def _play(self, match: int) -> None:
        a, b = self.tree[2 * match], self.tree[2 * match + 1]
        self.tree[match] = a if self.heads[a] <= self.heads[b] else b

    def winner(self) -> tuple[int, tuple]:
        run = self.tree[1]
        return run, self.heads[run]


class Merge:
    """The first rows of many sorted runs in order. Blocks come in order of their first rows, so that at most one of
    each run is held, and none is opened before its first row is due."""

    def __init__(self, wanted: int):
        self.wanted, self.tree = wanted, Tournament()
        self.seats: dict[int, int] = {}
        self.open: dict[int, tuple[list, int]] = {}
        self.rows: list[tuple] = []

    def add(self, run: int, head: tuple, body: bytes) -> None:
        self.advance(head)
        if len(self.rows) < self.wanted:
            seat = self.seats.setdefault(run, len(self.seats))
            rows = list(map(tuple, np.frombuffer(body, np.int64).reshape(-1, len(BODY)).tolist()))
            self.open[seat] = (rows, 0)
            self.tree.set(seat, rows[0])

    def advance(self, until: tuple) -> None:
        """Rows before a key, until there are enough."""
        while len(self.rows) < self.wanted:
            seat, head = self.tree.winner()
            if head >= until or head is Tournament.DONE:
                return
            self.rows.append(head)
            rows, at = self.open[seat]
            at += 1
            if at < len(rows):
                self.open[seat] = (rows, at)
                self.tree.set(seat, rows[at])
            else:
                del self.open[seat]
                self.tree.set(seat, Tournament.DONE)

    def take(self) -> list[tuple]:
        """What came out since; it counts no more."""
        out, self.rows = self.rows, []
        self.wanted -= len(out)
        return out


def _merged(offsets: dict[int, int], draw: int):
    """Over blocks in order of range and first row: BODY and rank of the first `draw` rows of all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranked(rows: list[tuple], rank: int) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(rank, rank + len(rows)))], names=[*BODY, "rank"])

        now, merge, rank = None, None, 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(2 + len(KEY))), b.column(2 + len(KEY)), strict=True):
                if r[0] != now:
                    if merge:
                        merge.advance(Tournament.DONE)
                        if rows := merge.take():
                            yield ranked(rows, rank)
                    now, rank = r[0], offsets[r[0]] + 1
                    merge = Merge(draw - offsets[now])
                merge.add(r[1], r[2:-1], r[-1].as_buffer())
                if len(merge.rows) >= BLOCK_ROWS:
                    rows = merge.take()
                    yield ranked(rows, rank)
                    rank += len(rows)
        if merge:
            merge.advance(Tournament.DONE)
            if rows := merge.take():
                yield ranked(rows, rank)

    return run


def _draw(scored: DataFrame, least_words: int, percent: int) -> DataFrame | None:
    """BODY and rank of the drawn rows; None if none is.

    Each partition's eligible rows are sorted where they lie and written as a run. Runs are parted in ranges by common
    splitters; a range is merged in one task, from a block of each run at a time. Ranges beyond the draw are not read.
    """
    eligible = scored.filter(F.col("n_words") >= least_words)
    n = eligible.count()
    draw = percent * n // 100
    if not draw:
        return None
    splitters = _splitters(eligible, n)
    sorted_rows = eligible.select(*BODY).sortWithinPartitions(*KEY)
    runs = cut(sorted_rows.mapInArrow(_runs(splitters), f"range int, run long, {', '.join(f'{c} long' for c in KEY)}, n long, body binary"), "runs")
    offsets, before = {}, 0
    for r in runs.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # one row a range
        if before < draw:
            offsets[r["range"]] = before
        before += r["n"]
    due = runs.filter(F.col("range") <= max(offsets)).select("range", "run", *KEY, "body").repartition("range").sortWithinPartitions("range", *KEY)
    return cut(due.mapInArrow(_merged(offsets, draw), ", ".join(f"{c} long" for c in [*BODY, "rank"])), "drawn")


def resample(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null if it isn't drawn.

    Texts are like those of target (text) as far as their hashed features say: a bucket's gain is
    floor(1000 * ln(share in target / share in documents)), each smoothed by one, weight the sum of the gains of a
    document's features. score adds Gumbel noise made of seed and doc_id, so that the highest scores are a
    draw without replacement. Of the documents of at least `least_words` words `percent` in 100 are drawn, ties to the
    smaller doc_id.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII, of whole texts. Null and empty
    texts have no features and weight 0. Null doc_ids have the noise of an empty one and come last among ties; rows of
    one doc_id and score are drawn in any order. Repeated rows count each. An empty target has equal shares in all buckets;
    no documents give no rows; other columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(rows, buckets, longest), bucket_counts(target, buckets, longest))
    weighed = rows.mapInArrow(_weigh(gain, longest), "doc_id long, n_words long, n_features long, weight long")
    falling = -(F.col("weight") + noise(F.col("doc_id"), seed))
    keyed = weighed.select("*", falling.alias("falling"), F.col("doc_id").isNull().cast("long").alias("no_doc"), F.coalesce("doc_id", F.lit(0)).alias("doc"), F.monotonically_increasing_id().alias("uid"))
    scored = cut(keyed, "scored")
    drawn = _draw(scored, least_words, percent)
    out = [F.when(F.col("no_doc") == 0, F.col("doc")).alias("doc_id"), "n_features", "weight", (-F.col("falling")).alias("score")]
    if drawn is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    last = drawn.orderBy(F.desc("rank")).select(*KEY).first()
    key, end = (F.struct(*(c.alias(k) for c, k in zip(cs, KEY, strict=True))) for cs in ([F.col(k) for k in KEY], [F.lit(x).cast("long") for x in last]))
    rest = scored.filter((F.col("n_words") < least_words) | (key > end))
    return drawn.select(*out, "rank").unionByName(rest.select(*out, F.lit(None).cast("long").alias("rank")))
