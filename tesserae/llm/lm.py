"""Masked pseudo-likelihood of documents under a small bidirectional window network."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import _LOWER, cut, mix64, slices, utf8_buffer, word_hashes, words_of

#: Words that the network predicts by themselves, with id 0 for all others; CLASSES groups of as many words by frequency.
VOCABULARY, CLASSES = 1024, 32
#: The other words fall into classes by a hash of their last two bytes, which the network predicts after id 0, and into
#: more by their own hash as neighbours. Their ids start beyond VOCABULARY. Both are powers of two.
RARE_CLASSES, RARE_CONTEXTS = 32, 1024
#: Taken off each count for words that no document has; they share it evenly among the hashes of their class.
DISCOUNT = 0.5
_UNSEEN = RARE_CLASSES * 2.0**-64
WIDTH = 16
#: A token is predicted from so many on either side.
REACH = 2
BATCH = 8192
#: Tokens of a training step, and the step size.
STEP_TOKENS, RATE = 1024, 0.15
#: Documents are dealt over groups of about so many tokens, each of which trains a network of its own.
GROUP_TOKENS = 1 << 21
FAN_IN = 32

_OFFSETS = [o for o in range(-REACH, REACH + 1) if o]
_PER_CLASS = VOCABULARY // CLASSES
#: Tokens and texts of a unit, whose rare words go to the shards of the counts together; its texts fit 16 bits.
UNIT_TOKENS, UNIT_TEXTS = 2_000_000, 30_000
_COUNTS = "shard int, words binary, n binary"
_UNITS = "unit long, shard int, ids array<long>, a binary, b binary"


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For slices of texts: hashes of all words, with their class in the lowest bits, and the index of each word's text."""
    for b in slices(iter(batches)):
        raw, offsets = utf8_buffer(b.column(b.schema.get_field_index("text")))
        starts, ends, doc = words_of(raw, offsets)
        words = word_hashes(raw, starts, ends)
        last = _LOWER[raw[ends - 1]].astype(np.uint64)
        before = np.where(ends - starts > 1, _LOWER[raw[np.maximum(ends - 2, 0)]], 0)
        own = mix64(last * np.uint64(256) + before.astype(np.uint64)) % np.uint64(RARE_CLASSES)
        yield b, (words // np.uint64(RARE_CLASSES) * np.uint64(RARE_CLASSES) + own).view(np.int64), doc


def _shards(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words.view(np.uint64) >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _packed(values: Iterable[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _unpacked(column: pa.ChunkedArray | pa.Array, dtype: type) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype) for v in column]


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, inverse = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
    return words, np.bincount(inverse, weights=np.concatenate([n for _, n in held]), minlength=len(words)).astype(np.int64)


def _counter(shards: int):
    def batch(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        shard = _shards(words, shards)
        order = np.argsort(shard, kind="stable")
        found, heads = np.unique(shard[order], return_index=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), _packed(np.split(words[order], heads[1:])), _packed(np.split(counts[order], heads[1:]))], names=["shard", "words", "n"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for _, words, _ in _texts(batches):
            held.append(np.unique(words, return_counts=True))
            size += len(held[-1][0])
            if size > 2_000_000:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield batch(*held[0])
                    held, size = [], 0
        if size:
            yield batch(*_merged(held))

    return run


def _add_counts(key: tuple, rows: pa.Table) -> pa.Table:
    words, n = _merged(list(zip(_unpacked(rows.column("words"), np.int64), _unpacked(rows.column("n"), np.int64), strict=True)))
    return pa.table([pa.array([key[0].as_py()], pa.int32()), _packed([words]), _packed([n])], names=["shard", "words", "n"])


def word_counts(documents: DataFrame) -> tuple[DataFrame, int]:
    """All words of all documents with their counts, packed into one row a shard, and the number of shards.

    There are as many shards as partitions of documents, so one holds about as many words as a partition.
    """
    texts = documents.select("text")
    shards = max(8, texts.rdd.getNumPartitions())
    counts = texts.mapInArrow(_counter(shards), _COUNTS).groupBy("shard").applyInArrow(_add_counts, _COUNTS)
    return cut(counts, "word-counts"), shards


def _most_frequent(counts: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """The most frequent words, and how many tokens they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, n in zip(_unpacked(b.column(1), np.int64), _unpacked(b.column(2), np.int64), strict=True):
                order = np.lexsort((words, -n))[: size - 1]
                yield pa.RecordBatch.from_arrays([pa.array(words[order]), pa.array(n[order])], names=["word", "n"])

    top = counts.mapInArrow(run, "word long, n long").orderBy(F.desc("n"), "word").limit(size - 1).collect()
    return np.array([r["word"] for r in top], np.int64), sum(r["n"] for r in top)


def vocabulary(documents: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """Hashes of the size - 1 most frequent words of all documents, most frequent first (ties by hash)."""
    return _most_frequent(word_counts(documents)[0], size)[0]


def _class_totals(counts: DataFrame, known: np.ndarray) -> np.ndarray:
    """For each class of rare words: tokens and different words, leaving out the known ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, RARE_CLASSES), np.int64)
        for b in batches:
            for words, n in zip(_unpacked(b.column(1), np.int64), _unpacked(b.column(2), np.int64), strict=True):
                rest = ~np.isin(words, known)
                own = words[rest] & (RARE_CLASSES - 1)
                total[0] += np.bincount(own, weights=n[rest], minlength=RARE_CLASSES).astype(np.int64)
                total[1] += np.bincount(own, minlength=RARE_CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(RARE_CLASSES)), pa.array(total[0]), pa.array(total[1])], names=["class", "n", "words"])

    out = np.zeros((2, RARE_CLASSES))
    for r in counts.mapInArrow(run, "class long, n long, words long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        out[:, r["class"]] = r["n"], r["words"]
    return out


def _kinds(ids: np.ndarray) -> np.ndarray:
    """Classes of ids; rare words are in that of id 0."""
    return np.where(ids > VOCABULARY, 0, ids // _PER_CLASS)


class WindowNetwork:
    """P(token | neighbours): embeddings of the neighbours by place, one tanh layer, softmax over classes and words.

    The probability of a token is that of its class times that of the token within the class. For a rare word it is
    that of id 0 times that of its rare class; `rest` has the counts that tell the words of a rare class apart.
    """

    #: The packed counts, their number of shards and the totals of the rare classes; None: no word has been counted.
    rest: tuple[DataFrame, int, np.ndarray] | None = None

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {
            "embed": f(len(_OFFSETS), VOCABULARY + 1 + RARE_CONTEXTS, WIDTH, s=0.3),  # row VOCABULARY stands beyond a text's ends
            "bias": np.zeros(WIDTH, np.float32),
            "to_class": f(WIDTH, CLASSES, s=0.2),
            "class_bias": np.zeros(CLASSES, np.float32),
            "to_word": f(CLASSES, WIDTH, _PER_CLASS, s=0.2),
            "word_bias": np.zeros((CLASSES, _PER_CLASS), np.float32),
            "to_rare": f(WIDTH, RARE_CLASSES, s=0.2),
            "rare_bias": np.zeros(RARE_CLASSES, np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> WindowNetwork:
        at = 0
        for k, v in self.p.items():
            self.p[k] = np.asarray(flat[at : at + v.size], np.float32).reshape(v.shape)
            at += v.size
        return self

    @staticmethod
    def contexts(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The neighbours of each token within its own text."""
        n = len(ids)
        out = np.full((len(_OFFSETS), n), VOCABULARY, np.uint16)
        for k, o in enumerate(_OFFSETS):
            a, b = max(0, -o), min(n, n - o)
            if a < b:
                out[k, a:b] = np.where(doc[a:b] == doc[a + o : b + o], ids[a + o : b + o], VOCABULARY)
        return out

    def _hidden(self, ctx: np.ndarray) -> np.ndarray:
        h = np.broadcast_to(self.p["bias"], (ctx.shape[1], WIDTH)).copy()
        for k in range(len(_OFFSETS)):
            h += self.p["embed"][k][ctx[k]]
        return np.tanh(h)

    def forward(self, ids: np.ndarray, ctx: np.ndarray, train: bool = False, whole: bool = True):
        """Log-probabilities of tokens that lie in order of their class; with train, the gradients too.

        Without whole, the embeddings' gradient is (rows, their gradients) of those that tokens have as neighbours.
        """
        p = self.p
        h = self._hidden(ctx)
        rare = np.flatnonzero(ids > VOCABULARY)
        rare_class = (ids[rare] - VOCABULARY - 1) % RARE_CLASSES
        kind, word = _kinds(ids), np.where(ids > VOCABULARY, 0, ids % _PER_CLASS)
        n = np.arange(len(ids))

        def softmax(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            np.minimum(z, 60, out=z)  # sums stay in range
            log = z[n[: len(y)], y]
            e = np.exp(z, out=z)
            total = e @ np.ones(e.shape[1], np.float32)
            log -= np.log(total)
            if train:
                e /= total[:, None]
                e[n[: len(y)], y] -= 1
            return log, e

        log, d_class = softmax(h @ p["to_class"] + p["class_bias"], kind)
        edges = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
        spans = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        z = p["word_bias"][kind]
        for c, at in spans:
            z[at] += h[at] @ p["to_word"][c]
        own, d_word = softmax(z, word)
        log += own
        g = {}
        if train:
            g = {"to_class": h.T @ d_class, "class_bias": d_class.sum(axis=0), "to_word": np.zeros_like(p["to_word"]), "word_bias": np.zeros_like(p["word_bias"])}
            dh = d_class @ p["to_class"].T
            for c, at in spans:
                g["to_word"][c] = h[at].T @ d_word[at]
                dh[at] += d_word[at] @ p["to_word"][c].T
            g["word_bias"][[c for c, _ in spans]] = np.add.reduceat(d_word, [at.start for _, at in spans], axis=0)
        own, d_rare = softmax(h[rare] @ p["to_rare"] + p["rare_bias"], rare_class)
        log[rare] += own
        if not train:
            return log
        g["to_rare"], g["rare_bias"] = h[rare].T @ d_rare, d_rare.sum(axis=0)
        dh[rare] += d_rare @ p["to_rare"].T
        d = dh * (1 - h * h)
        g["bias"] = d.sum(axis=0)
        near, sums = [], []
        for k in range(len(_OFFSETS)):
            order = np.argsort(ctx[k], kind="stable")
            own = ctx[k][order]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            near.append(own[heads].astype(np.int64) + k * p["embed"].shape[1])
            sums.append(np.add.reduceat(d[order], heads, axis=0))
        g["embed"] = np.concatenate(near), np.concatenate(sums)
        if whole:
            rows, own = g["embed"]
            g["embed"] = np.zeros_like(p["embed"])
            g["embed"].reshape(-1, WIDTH)[rows] = own
        return log, g

    def score(self, ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Sum of the tokens' conditional log-probabilities for each of `docs` texts; of rare words, those of their class."""
        ctx = self.contexts(ids, doc)
        total = np.zeros(docs)
        for a in range(0, len(ids), BATCH):
            order = a + np.argsort(_kinds(ids[a : a + BATCH]).astype(np.uint16), kind="stable")
            total += np.bincount(doc[order], weights=self.forward(ids[order], ctx[:, order]), minlength=docs)
        return total


def _ids(words: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Ids from 1 on of known (sorted) hashes, and from VOCABULARY + 1 on of others."""
    rare = VOCABULARY + 1 + (words & (RARE_CONTEXTS - 1))
    if not len(known):
        return rare
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, rank[at], rare)


def _numbered(known: np.ndarray, rank: np.ndarray):
    """Rows (group, key, text) to (group, key, ids of the words, 16 bits each), where there are words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words, doc in _texts(batches):
            ids = _ids(words, known, rank).astype(np.uint16)
            ends = 2 * np.searchsorted(doc, np.arange(b.num_rows + 1))
            own = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
            at = [b.schema.get_field_index(name) for name in ("group", "key")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in at), own], names=["group", "key", "ids"]).filter(pa.array(np.diff(ends) > 0))

    return run


class _Training:
    """Adagrad on a network, STEP_TOKENS tokens a step however they come in."""

    def __init__(self):
        self.net, self.seen = WindowNetwork(), 0
        self.squares = {k: np.full_like(v, 1e-2) for k, v in self.net.p.items()}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, ids: np.ndarray, doc: np.ndarray) -> None:
        self.held.append((ids, self.net.contexts(ids, doc)))
        self.waiting, self.seen = self.waiting + len(ids), self.seen + len(ids)
        if self.waiting >= STEP_TOKENS:
            self._learn(self.waiting // STEP_TOKENS * STEP_TOKENS)

    def _learn(self, tokens: int) -> None:
        ids, ctx = np.concatenate([x for x, _ in self.held]), np.concatenate([x for _, x in self.held], axis=1)
        for a in range(0, tokens, STEP_TOKENS):
            self._step(ids[a : a + STEP_TOKENS], ctx[:, a : a + STEP_TOKENS])
        self.held, self.waiting = [(ids[tokens:], ctx[:, tokens:])], len(ids) - min(tokens, len(ids))

    def _step(self, ids: np.ndarray, ctx: np.ndarray) -> None:
        order = np.argsort(_kinds(ids).astype(np.uint16), kind="stable")
        _, g = self.net.forward(ids[order], ctx[:, order], train=True, whole=False)
        for k, d in g.items():
            p, squares = self.net.p[k], self.squares[k]
            if k == "embed":
                # embeddings that no token has as a neighbour stay as they are
                (near, own), sums = d, squares.reshape(-1, WIDTH)
                own /= STEP_TOKENS
                total = sums[near] + own * own
                sums[near] = total
                p.reshape(-1, WIDTH)[near] -= RATE * own / np.sqrt(total)
            else:
                d /= STEP_TOKENS
                squares += d * d
                p -= RATE * d / np.sqrt(squares)

    def finish(self) -> np.ndarray:
        """The weights, after a last and lighter step over what is left."""
        if self.waiting:
            self._learn(self.waiting)
        return self.net.flat()


def _train_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A network for each group of rows (group, key, ids) that come in order of their group."""

    def network() -> pa.RecordBatch:
        weights = pa.array([own.finish()], pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([float(own.seen)]), weights], names=["part", "n", "weights"])

    group, own = None, _Training()
    for b in slices(iter(batches), "ids"):
        found, heads = np.unique(b.column(0).to_numpy(), return_index=True)
        for g, a, n in zip(found.tolist(), heads.tolist(), np.diff(heads, append=b.num_rows).tolist(), strict=True):
            if g != group:
                if group is not None:
                    yield network()
                group, own = g, _Training()
            raw, offsets = utf8_buffer(b.column(2).slice(a, n))
            own.add(raw.view(np.uint16).astype(np.int64), np.repeat(np.arange(n), np.diff(offsets) // 2))
    if group is not None:
        yield network()


def _average(key: tuple, rows: pa.Table) -> pa.Table:
    total, mean = 0.0, None
    rows = rows.sort_by("part")
    for n, w in zip(rows.column("n").to_pylist(), rows.column("weights"), strict=True):
        own = np.asarray(w.values, dtype=np.float64)
        mean = own if mean is None else mean + (own - mean) * (n / (total + n))
        total += n
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([total]), pa.array([mean.astype(np.float32)], pa.list_(pa.float32()))], names=["part", "n", "weights"])


def train(documents: DataFrame) -> tuple[np.ndarray, WindowNetwork]:
    """The vocabulary and a network trained on all documents, with the counts of all other words.

    Documents are dealt over groups of about GROUP_TOKENS tokens by a hash of doc_id and text (without doc_id: by their
    place). Each group trains from the same start by Adagrad once over all of its tokens, in order of that hash,
    predicting each from both sides; the networks are averaged by their number of tokens, FAN_IN at a time, up a tree.
    So the network does not depend on how documents with ids are dealt over partitions.
    """
    counts, shards = word_counts(documents)
    words, tokens = _most_frequent(counts, VOCABULARY)
    order = np.argsort(words)
    known, rank = words[order], order + 1
    totals = _class_totals(counts, known)
    groups = max(1, math.ceil((tokens + int(totals[0].sum())) / GROUP_TOKENS))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()), "text")
    texts = documents.filter("text is not null").select("text", key.alias("key")).withColumn("group", F.pmod("key", F.lit(groups)).cast("long"))
    ids = texts.mapInArrow(_numbered(known, rank), "group long, key long, ids binary")
    ids = ids.repartitionById(groups, F.col("group").cast("int")).sortWithinPartitions("group", "key")
    schema = "part long, n double, weights array<float>"
    nets = cut(ids.mapInArrow(_train_groups, schema), "networks")
    for _ in range(max(1, math.ceil(math.log(groups + 1, FAN_IN)))):
        nets = nets.groupBy(F.floor(F.col("part") / FAN_IN).cast("long").alias("up")).applyInArrow(_average, schema)
    nets = cut(nets, "network")
    last = nets.orderBy("part").collect()
    net = WindowNetwork()
    if last:
        n = np.array([r["n"] for r in last])
        net.load(np.average(np.array([r["weights"] for r in last]), axis=0, weights=n))
    net.rest = counts, shards, totals
    return words, net


def _scorer(known: np.ndarray, rank: np.ndarray, flat: np.ndarray, shards: int):
    """Units of texts: a row (shard -1) with ids, lengths and sums under the network, and one a shard with the rare words.

    Those are packed as a: different words; b: how often each is there (32 bits), then the text of each token (16 bits).
    """

    def unit(at: int, ids: list, counts: list, total: list, words: list, doc: list) -> Iterator[pa.RecordBatch]:
        own = pa.concat_arrays(ids)
        head = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        names = ["unit", "shard", "ids", "a", "b"]
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([-1], pa.int32()), head, _packed([np.concatenate(counts)]), _packed([np.concatenate(total)])], names=names)
        rare, text = np.concatenate(words), np.concatenate(doc)
        if not len(rare):
            return
        order = np.lexsort((rare, _shards(rare, shards)))
        rare, text = rare[order], text[order].astype(np.uint16)
        heads = np.flatnonzero(np.concatenate([[True], rare[1:] != rare[:-1]]))
        times = np.diff(heads, append=len(rare)).astype(np.uint32)
        found, first = np.unique(_shards(rare[heads], shards), return_index=True)
        parts = zip(np.split(times, first[1:]), np.split(text, heads[first[1:]]), strict=True)
        tokens = pa.array([n.tobytes() + d.tobytes() for n, d in parts], pa.binary())
        k = len(found)
        yield pa.RecordBatch.from_arrays([pa.array([at] * k, pa.int64()), pa.array(found.astype(np.int32)), pa.nulls(k, pa.list_(pa.int64())), _packed(np.split(rare[heads], first[1:])), tokens], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = WindowNetwork().load(flat)
        at = TaskContext.get().partitionId() << 32
        held: list[list] = [[], [], [], [], []]
        tokens = texts = 0
        for whole, words, doc in _texts(batches):
            ids = _ids(words, known, rank)
            sums, counts = net.score(ids, doc, whole.num_rows), np.bincount(doc, minlength=whole.num_rows)
            for a in range(0, whole.num_rows, UNIT_TEXTS):
                n = min(UNIT_TEXTS, whole.num_rows - a)
                rare = (ids > VOCABULARY) & (doc >= a) & (doc < a + n)
                if texts and (texts + n > 2 * UNIT_TEXTS or tokens >= UNIT_TOKENS):
                    yield from unit(at, *held)
                    at, held, tokens, texts = at + 1, [[], [], [], [], []], 0, 0
                own = whole.column(whole.schema.get_field_index("doc_id")).slice(a, n)
                for x, y in zip(held, (own, counts[a : a + n], sums[a : a + n], words[rare], doc[rare] - a + texts), strict=True):
                    x.append(y)
                tokens, texts = tokens + int(counts[a : a + n].sum()), texts + n
        if texts:
            yield from unit(at, *held)

    return run


def _rare_words(totals: np.ndarray):
    """Sums of log P(word | its class) by text, for the units' words of one shard."""

    def run(units: pa.Table, counts: pa.Table) -> pa.Table:
        known, n = np.zeros(1, np.int64), np.zeros(1, np.int64)
        if counts.num_rows:
            known, n = _unpacked(counts.column("words"), np.int64)[0], _unpacked(counts.column("n"), np.int64)[0]
        texts, sums = [], []
        for words, b in zip(_unpacked(units.column("a"), np.int64), units.column("b"), strict=True):
            raw = b.as_buffer()
            times = np.frombuffer(raw, np.uint32, len(words))
            doc = np.frombuffer(raw, np.uint16, offset=4 * len(words))
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            count = np.where(known[at] == words, n[at], 0)
            tokens, different = totals[:, words & (RARE_CLASSES - 1)]
            log = np.log(np.maximum(count - DISCOUNT, 0) + (DISCOUNT * different + 1) * _UNSEEN) - np.log(tokens + 1)
            total = np.bincount(doc, weights=np.repeat(log, times))
            own = np.flatnonzero(total)
            texts.append(own.astype(np.uint16))
            sums.append(total[own])
        return pa.table([units.column("unit"), units.column("shard"), pa.nulls(units.num_rows, pa.list_(pa.int64())), _packed(texts), _packed(sums)], names=["unit", "shard", "ids", "a", "b"])

    return run


def _finish(rows: pa.Table) -> pa.Table:
    head = rows.column("shard").to_pylist().index(-1)
    counts, total = np.frombuffer(rows.column("a")[head].as_buffer(), np.int64), np.frombuffer(rows.column("b")[head].as_buffer(), np.float64).copy()
    for k in np.argsort(rows.column("shard").to_numpy())[1:]:
        total[np.frombuffer(rows.column("a")[int(k)].as_buffer(), np.uint16)] += np.frombuffer(rows.column("b")[int(k)].as_buffer(), np.float64)
    mean = np.where(counts > 0, total / np.maximum(counts, 1), np.nan)
    return pa.table([rows.column("ids")[head].values, pa.array(counts), pa.array(total), pa.array(mean, mask=counts == 0)], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_probability"])


def pseudo_likelihood(documents: DataFrame, model: tuple[np.ndarray, WindowNetwork] | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over tokens of log P(token | both sides)) and its mean.

    Tokens are the words of whole texts, A-Z lower-cased. Every token has a probability of its own: those beyond the
    vocabulary that of their class under the network times their share of the class in the counts of the training
    documents; words without a count share what DISCOUNT takes from the others. Null texts and texts without words have
    no tokens, the sum 0 and a null mean. Equal texts get equal scores but for rounding; rows with equal doc_id are
    scored one by one; no rows give no rows; columns of other names are ignored.
    """
    words, net = model or train(documents)
    counts, shards, totals = net.rest or (documents.sparkSession.createDataFrame([], _COUNTS), 8, np.zeros((2, RARE_CLASSES)))
    order = np.argsort(words)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    units = cut(rows.mapInArrow(_scorer(words[order], order + 1, net.flat(), shards), _UNITS), "scored-units")
    rare = units.filter("shard >= 0").groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(_rare_words(totals), _UNITS)
    schema = "doc_id long, n_tokens long, log_likelihood double, mean_log_probability double"
    return units.filter("shard < 0").unionByName(rare).groupBy("unit").applyInArrow(_finish, schema)
