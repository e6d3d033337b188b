"""Near-duplicate documents: banded min-hash candidates, sequential Bayesian verification, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import cut, mix64, slices, utf8_buffer, word_hashes, words_of
from tesserae.llm.graph import components

SHINGLE, PERCENT = 5, 80
#: Rows of a band and bands: a pair at the threshold shares no band with probability (1 - 0.8 ** 5) ** 30 = 7e-6.
ROWS, BANDS = 5, 30
#: Hashes compared at a time, and the posterior probability of similarity below which a pair is given up.
STEP, MISS = 30, 1e-6
#: Partners that share one copy of a pivot's set, and rows of the blocks in which large buckets are compared.
PIVOT_ROWS, BLOCK_ROWS = 256, 512
#: Pivots that a document is confirmed against at first, the most promising ones; what that leaves apart meets in blocks.
FIRST_TRIES = 2
#: Components of more members meet other documents by full sets, block by block.
LARGE = 32
#: One class in so many is counted, and a band with so many of these is large.
HOT_SAMPLE = 64
#: Tables of more bytes than this (their rows are counted, their rows' width is bounded) are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

_HASHES = ROWS * BANDS
_A = mix64(np.arange(1, _HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix64(_A)
_ONE = np.uint64(0xA24BAED4963EE407)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles (64-bit hashes, sorted) of each text of a buffer, end to end, and their counts.

    A text of fewer than k words has all of them as its one shingle, a text without words none.
    """
    starts, ends, doc = words_of(raw, offsets)
    words = word_hashes(raw, starts, ends)
    n = len(offsets) - 1
    per_doc = np.bincount(doc, minlength=n)
    first = np.cumsum(per_doc) - per_doc
    whole = np.flatnonzero(doc[: max(0, len(doc) - k + 1)] == doc[k - 1 :])
    rolled = words[whole]
    for j in range(1, k):
        rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + words[whole + j])
    own = doc[whole]
    bounds = np.searchsorted(own, np.arange(n + 1))
    out, counts = [], np.zeros(n, np.int64)
    for d in range(n):
        if per_doc[d] >= k:
            u = np.unique(rolled[bounds[d] : bounds[d + 1]])
        elif per_doc[d]:
            x = np.array([_ONE + np.uint64(per_doc[d])])
            for w in words[first[d] : first[d] + per_doc[d]]:
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + w)
            u = x
        else:
            continue
        out.append(u)
        counts[d] = len(u)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def set_keys(sets: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that equal sets share: two sums of hashed members."""
    if not len(heads):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.add.reduceat(mix64(sets), heads).view(np.int64), np.add.reduceat(mix64(sets ^ _ONE), heads).view(np.int64)


SIGNED = "uid long, doc_id long, text_hash long, n long, k1 long, k2 long, sig binary, bands array<long>, packed binary"


def _signatures(sketch):
    """Over rows (doc_id, text, text_hash): SIGNED, with what the sketch says of the sets of a slice of texts."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64())), ("packed", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for b in slices(iter(batches)):
            sets, counts = shingle_sets(*utf8_buffer(b.column(1)), sketch.k)
            some = np.flatnonzero(counts)
            heads = (np.cumsum(counts) - counts)[some]
            keys = np.zeros((2, b.num_rows), np.int64)
            keys[:, some] = set_keys(sets, heads)
            out: list[list] = [[None] * b.num_rows for _ in range(3)]
            for d, own in zip(some.tolist(), sketch.describe(sets, heads, counts[some]), strict=True):
                out[0][d], out[1][d], out[2][d] = own
            ids = np.arange(uid, uid + b.num_rows)
            uid += b.num_rows
            columns = [pa.array(ids), b.column(0), b.column(2), pa.array(counts), pa.array(keys[0]), pa.array(keys[1])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(c, f.type) for c, f in zip(out, list(schema)[6:], strict=True)], schema=schema)

    return run


def _sets(k: int):
    """(doc_id, k1, k2, members) of texts with words; rows of one doc_id and set give one in a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in slices(iter(batches)):
            sets, counts = shingle_sets(*utf8_buffer(b.column(1)), k)
            some = np.flatnonzero(counts)
            heads = (np.cumsum(counts) - counts)[some]
            k1, k2 = set_keys(sets, heads)
            ids = b.column(0).to_pylist()
            fresh = []
            for i, key in enumerate(zip((ids[j] for j in some.tolist()), k1.tolist(), k2.tolist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            if not fresh:
                continue
            some, heads, k1, k2 = some[fresh], heads[fresh], k1[fresh], k2[fresh]
            members = [sets[a : a + n].tobytes() for a, n in zip(heads.tolist(), counts[some].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(k1), pa.array(k2), pa.array(members, pa.binary())], names=["doc_id", "k1", "k2", "members"])

    return run


def least_matches(percent: int = PERCENT, miss: float = MISS) -> dict[int, int]:
    """For each number of compared hashes: the matches below which P(similarity >= threshold) < miss.

    The posterior comes from a uniform prior; hashes are kept to 8 bits, so that unlike ones match 1 time in 256.
    """
    grid = (np.arange(2000) + 0.5) / 2000
    match = grid + (1 - grid) / 256
    similar = grid >= percent / 100 - 1e-9
    out = {}
    for n in range(STEP, _HASHES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(match) + (n - m) * np.log1p(-match)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        posterior = weight[:, similar].sum(axis=1) / weight.sum(axis=1)
        out[n] = int(np.argmax(posterior >= miss))
    return out


class MinHashes:
    """Min-hash signatures, banded, compared batch by batch until the posterior says that a pair isn't similar."""

    width = _HASHES

    def __init__(self, k: int, percent: int):
        self.k, self.percent, self.need = k, percent, least_matches(percent)

    def describe(self, sets: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        """For each set its signature (a byte of each least hash), its bands, and these as bytes."""
        least = np.empty((_HASHES, len(heads)), np.uint32)
        for i in range(_HASHES if len(heads) else 0):
            least[i] = np.minimum.reduceat(((sets * _A[i] + _B[i]) >> np.uint64(32)).astype(np.uint32), heads)
        bands = np.empty((len(heads), BANDS), np.int64)
        for j in range(BANDS):
            h = np.full(len(heads), j + 1, np.uint64)
            for r in range(ROWS):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + least[j * ROWS + r])
            bands[:, j] = h.view(np.int64)
        short = np.ascontiguousarray((least & np.uint32(255)).astype(np.uint8).T)
        return ((s.tobytes(), b, b.tobytes()) for s, b in zip(short, bands, strict=True))

    def survivors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of two signature tables that no batch of comparisons gives up, and their matches."""
        alive, found = np.arange(len(a)), np.zeros(len(a), np.int64)
        for n, least in self.need.items():
            found = found + (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(axis=1)
            keep = found >= least
            alive, found = alive[keep], found[keep]
            if not len(alive):
                break
        return alive, found


def _signature_matrix(signatures: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, width)


def _screen(sketch, tries: int):
    """Over rows (a, b, salts, sig_a, sig_b): pairs that may be similar, for each a in a batch the `tries` most promising."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                alive, found = sketch.survivors(*(_signature_matrix(b.column(i).to_pylist(), sketch.width) for i in (3, 4)))
                who = np.asarray(b.column(0))[alive]
                order = np.lexsort((np.asarray(b.column(1))[alive], -found, who))
                alive, who = alive[order], who[order]
                rank = np.arange(len(who)) - np.searchsorted(who, who)
                at = pa.array(alive[rank < tries])
                yield pa.RecordBatch.from_arrays([b.column(i).take(at) for i in range(3)], names=["a", "b", "salts"])

    return run


def _confirm(percent: int):
    """Over rows (b, salt, kind, a, members) in that order, a pivot's own set first: the pairs that are similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot = None, np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            for b, salt, kind, a, members in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                own = np.frombuffer(members.as_buffer(), np.uint64)
                if kind == 0:
                    key, pivot = (b, salt), own
                    continue
                if key != (b, salt):
                    raise ValueError(f"the set of {b} is missing")
                if _similar(pivot, own, percent):
                    links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return run


def _compare_blocks(sketch):
    """Over rows (band, block, part, kind, uid, root, sig, bands) in that order: pairs of unlike roots that may be similar.

    A pair of several common bands is given in the first of them alone, where the sketch gives bands as bytes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(band: int, rows: list[tuple]) -> pa.RecordBatch | None:
            kind, uid, root = (np.array([r[i] for r in rows], np.int64) for i in range(3))
            sig = _signature_matrix([r[3] for r in rows], sketch.width)
            bands = np.frombuffer(b"".join(r[4] for r in rows), np.int64).reshape(len(rows), -1)
            left = np.flatnonzero(kind == 1)
            out: dict[str, list] = {"a": [], "b": [], "matches": []}
            for i in np.flatnonzero(kind == 0):
                others = left[(root[left] != root[i])]
                if len(others):
                    alive, found = sketch.survivors(sig[others], np.broadcast_to(sig[i], (len(others), sketch.width)))
                    if bands.shape[1]:
                        common = bands[others[alive]] == bands[i]
                        first = bands[i][common.argmax(axis=1)] == band
                        alive, found = alive[first], found[first]
                    out["a"].append(uid[others[alive]])
                    out["b"].append(np.full(len(alive), uid[i]))
                    out["matches"].append(found)
            if out["a"]:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], names=list(out))
            return None

        key, rows = None, []
        for b in batches:
            for band, block, part, *row in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if (band, block, part) != key:
                    if rows and (done := pairs(key[0], rows)):
                        yield done
                    key, rows = (band, block, part), []
                rows.append(row)
        if rows and (done := pairs(key[0], rows)):
            yield done

    return run


def _meet_component(sketch):
    """Over rows (component, block, part, kind, uid, sig, members) in that order, a block of a component first: for each
    other document (kind 1) one link to the block if there is any. Likely partners are tried first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, table = None, [], None
        for batch in batches:
            links = []
            for *place, kind, uid, sig, members in zip(*(batch.column(i).to_pylist() for i in range(6)), batch.column(6), strict=True):
                if place != key:
                    key, own, table = place, [], None
                shingles = np.frombuffer(members.as_buffer(), np.uint64)
                if kind == 0:
                    own.append((uid, sig, shingles))
                    continue
                if table is None:
                    table = _signature_matrix([s for _, s, _ in own], sketch.width)
                alive, found = sketch.survivors(table, np.broadcast_to(np.frombuffer(sig, np.uint8), table.shape))
                for i in alive[np.argsort(-found, kind="stable")].tolist():
                    if _similar(own[i][2], shingles, sketch.percent):
                        links.append((uid, own[i][0]))
                        break
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of two sorted sets."""
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _small(df: DataFrame, rows: int, width: int = 40) -> DataFrame:
    """df, broadcast if so many rows of so many bytes are few enough."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


class Search:
    """Classes of equal sets, and links between classes whose sketches share a band."""

    def __init__(self, documents: DataFrame, sketch):
        self.sketch = sketch
        self.texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        hashed = self.texts.withColumn("text_hash", F.xxhash64("text"))
        self.signed = cut(hashed.mapInArrow(_signatures(sketch), SIGNED), "signatures")
        least = self.signed.filter("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "uid")).alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
        #: One row for each different set; equal sets have equal signatures.
        self.classes = cut(least.select("k1", "k2", "rep.uid", "rep.doc_id", "least", "copies", "sig", "bands", "packed"), "classes")

    def fetch(self, active: DataFrame, rows: int) -> None:
        """Have signatures and full sets of the active representatives, the sets from a second reading of the documents."""
        own = self.classes.join(_small(active, rows), "uid", "left_semi")
        self.sigs = cut(own.select("uid", "doc_id", "k1", "k2", "sig", "packed"), "active-signatures")
        keys = self.sigs.select("uid", F.col("doc_id").alias("d"), F.col("k1").alias("n1"), F.col("k2").alias("n2"))
        # null ids are told apart by the set alone
        read = self.texts.join(_small(keys.select("d").distinct(), rows), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
        sets = read.mapInArrow(_sets(self.sketch.k), "doc_id long, k1 long, k2 long, members binary")
        same = (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")) & F.col("doc_id").eqNullSafe(F.col("d"))
        self.sets, self.active = cut(sets.join(_small(keys, rows), same).select("uid", "members"), "sets"), rows

    def screen(self, pairs: DataFrame, tries: int) -> DataFrame:
        """pairs (a, b, salts) that may be similar by their signatures."""
        left, right = (_small(self.sigs.select(F.col("uid").alias(c), F.col("sig").alias(f"sig_{c}")), self.active, 40 + self.sketch.width) for c in "ab")
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "salts", "sig_a", "sig_b")
        return both.mapInArrow(_screen(self.sketch, tries), "a long, b long, salts long")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, salts) whose full sets are similar enough. The partners of b are dealt over so many groups,
        and its set is sent once to each."""
        groups = pairs.groupBy("b", F.pmod(F.xxhash64("a"), "salts").alias("salt")).agg(F.collect_set("a").alias("others"))
        seats = F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.col("b").alias("uid"))), F.transform("others", lambda x: F.struct(F.lit(1).alias("kind"), x.alias("uid"))))
        wanted = groups.select("b", "salt", F.explode(seats).alias("s")).select("b", "salt", "s.kind", "s.uid")
        rows = wanted.join(self.sets, "uid").select("b", "salt", "kind", F.col("uid").alias("a"), "members")
        dealt = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")
        return cut(dealt.mapInArrow(_confirm(self.sketch.percent), "a long, b long"), "links")

    def with_roots(self, df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
        own = _small(roots.select(F.col("uid").alias(column), F.col("root").alias("_root")), roots.count())
        return df.join(own, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")

    def members(self) -> DataFrame:
        """(band, uid, size, pivot) of the bands that several classes share.

        Most bands have one class and are never needed again, so all rows are dealt by band once, and counted
        there. Bands that a sample shows to be large are known to be shared; their rows aren't dealt.
        """
        in_bands = self.classes.select("uid", F.explode("bands").alias("band"))
        sample = in_bands.filter(F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(HOT_SAMPLE)) == 0)
        hot = cut(sample.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_SAMPLE).select("band"), "hot-bands")
        n_hot = hot.count()
        cold = in_bands.join(_small(hot, n_hot), "band", "left_anti") if n_hot else in_bands
        shared = cold.withColumn("n", F.count("*").over(Window.partitionBy("band"))).filter("n > 1").select("band", "uid")
        if n_hot:
            shared = shared.unionByName(in_bands.join(_small(hot, n_hot), "band", "left_semi").select("band", "uid"))
        shared = cut(shared, "shared")
        pivot = F.min_by("uid", F.xxhash64("uid", F.pmod("band", F.lit(4)))).alias("pivot")
        buckets = cut(shared.groupBy("band").agg(F.count("*").alias("size"), pivot), "buckets")
        return cut(shared.join(_small(buckets, buckets.count()), "band"), "members")

    def links(self) -> DataFrame:
        """Roots of the connected representatives: every similar pair that shares a bucket is connected in it."""
        members = self.members()
        # each member of a bucket meets the bucket's pivot
        met = F.collect_set(F.when(F.col("uid") != F.col("pivot"), F.col("pivot"))).alias("pivots")  # one for each band at most
        active = cut(members.groupBy("uid").agg(met, F.max("size").alias("size")), "active")
        rows = active.count()
        if not rows:
            return components(members.select(F.col("uid").alias("a"), F.col("pivot").alias("b")))
        self.fetch(active.select("uid"), rows)
        stars = active.select(F.col("uid").alias("a"), F.explode("pivots").alias("b"), F.ceil(F.col("size") / PIVOT_ROWS).alias("salts"))
        tried = cut(self.screen(stars, FIRST_TRIES), "screened")
        links = self.confirm(tried)
        roots = components(links)
        rooted = cut(self.with_roots(members.select("band", "uid"), roots, "uid", "root"), "rooted")
        mixed = self.mixed_buckets(rooted, roots)
        n_mixed = mixed.count()
        if not n_mixed:
            return roots
        found = [] if mixed.filter("large").isEmpty() else [self.meet_components(rooted, mixed, roots)]
        more = cut(self.screen_buckets(rooted, mixed, n_mixed), "across")
        n_more = more.count()
        if n_more:
            done = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            counts = more.groupBy("b").agg(F.ceil(F.count("*") / PIVOT_ROWS).alias("salts"))
            more = more.join(_small(done, 2 * rows), ["a", "b"], "left_anti").join(_small(counts, n_more), "b")
            found.append(self.confirm(more))
        for x in found:
            links = links.unionByName(x)
        return components(links) if any(not x.isEmpty() for x in found) else roots

    def mixed_buckets(self, rooted: DataFrame, roots: DataFrame) -> DataFrame:
        """Buckets that hold several components: (band, main, mains, all, members, large), main being the one that most
        rows of the bucket belong to, members its size everywhere."""
        sizes = rooted.groupBy("band", "root").agg(F.count("*").alias("n"))
        mixed = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("mains"), F.sum("n").alias("all"), F.count("*").alias("roots"))
        large = roots.groupBy("root").agg((F.count("*") + 1).alias("members")).filter(F.col("members") > LARGE).select(F.col("root").alias("main"), "members")
        joined = mixed.filter("roots > 1").join(_small(large, roots.count() // LARGE), "main", "left")
        return cut(joined.withColumn("large", F.col("members").isNotNull()), "mixed")

    def meet_components(self, rooted: DataFrame, mixed: DataFrame, roots: DataFrame) -> DataFrame:
        """Links of documents to the large components that they share a bucket with.

        Both sides are dealt in blocks of BLOCK_ROWS. Each document meets each block of the component once, whatever
        number of buckets they share, and gives one link to it at most: more would connect nothing further.
        """
        large = mixed.filter("large")
        n_large, n_mains = large.count(), roots.count() // LARGE
        meets = rooted.join(_small(large.select("band", "main", "members"), n_large), "band").filter("root <> main")
        meets = cut(meets.select("uid", F.col("main").alias("component"), "members").distinct(), "meets")
        blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
        dealt = meets.groupBy("component").agg(F.first("members").alias("members"), F.count("*").alias("guests"))
        dealt = cut(dealt.select("component", blocks("members").alias("blocks"), blocks("guests").alias("parts")), "meetings")
        seat = lambda n: F.pmod(F.xxhash64("uid"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        everyone = roots.select(F.col("root").alias("component"), "uid").unionByName(dealt.select("component", F.col("component").alias("uid")))
        own = everyone.join(_small(dealt, n_mains), "component").select("component", seat("blocks").alias("block"), every("parts").alias("part"), F.lit(0).alias("kind"), "uid")
        guests = meets.join(_small(dealt, n_mains), "component").select("component", every("blocks").alias("block"), seat("parts").alias("part"), F.lit(1).alias("kind"), "uid")
        rows = own.unionByName(guests).join(_small(self.sigs.select("uid", "sig"), self.active, 40 + self.sketch.width), "uid").join(self.sets, "uid")
        keys = ["component", "block", "part"]
        rows = rows.select(*keys, "kind", "uid", "sig", "members").repartition(*keys).sortWithinPartitions(*keys, "kind")
        return cut(rows.mapInArrow(_meet_component(self.sketch), "a long, b long"), "met")

    def screen_buckets(self, rooted: DataFrame, mixed: DataFrame, n_mixed: int) -> DataFrame:
        """Pairs of one bucket and unlike components that may be similar, but for those with a large main component.

        Of the main component in a bucket no two are compared. The others (stragglers) meet it and each
        other in blocks of bounded size.
        """
        sigs = self.sigs.select("uid", "sig", "packed")
        own = rooted.join(_small(mixed, n_mixed, 64), "band").filter(~(F.col("large") & (F.col("root") == F.col("main"))))
        main = F.col("root") == F.col("main")
        main_blocks, parts = (F.ceil(c / BLOCK_ROWS).cast("int") for c in (F.col("mains"), F.col("all") - F.col("mains")))
        block = F.pmod(F.xxhash64("uid"), F.when(main, main_blocks).otherwise(parts)).cast("int")
        upto = lambda n: F.sequence(F.lit(0), n - 1)
        # (block, part, kind): 1 stands on the left side of a comparison, 0 on the right
        seats = F.when(main, F.transform(upto(parts), lambda p: F.struct(F.col("own").alias("block"), p.alias("part"), F.lit(1).alias("kind")))).otherwise(
            F.concat(
                F.transform(upto(main_blocks), lambda m: F.struct(m.alias("block"), F.col("own").alias("part"), F.lit(0).alias("kind"))),
                F.transform(F.sequence(F.lit(0), F.col("own")), lambda j: F.struct((-1 - j).alias("block"), F.col("own").alias("part"), F.lit(0).alias("kind"))),
                F.transform(F.sequence(F.col("own"), parts - 1), lambda j: F.struct((-1 - F.col("own")).alias("block"), j.alias("part"), F.lit(1).alias("kind"))),
            )
        )
        seats = F.filter(seats, lambda s: ~F.col("large") | (s["block"] < 0))
        # a lone straggler beside a large component has no one to meet here
        seated = own.withColumn("own", block).filter("not large or all - mains > 1").select("band", F.explode(seats).alias("s"), "uid", "root")
        seated = seated.join(_small(sigs, self.active, 40 + self.sketch.width + 8 * BANDS), "uid")
        dealt = seated.select("band", "s.block", "s.part", "s.kind", "uid", "root", "sig", "packed").repartition("band", "block", "part").sortWithinPartitions("band", "block", "part", "kind")
        pairs = dealt.mapInArrow(_compare_blocks(self.sketch), "a long, b long, matches long")
        # pairs of one part stand in it both ways
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def named(self) -> DataFrame:
        """doc_id, n_shingles, component_id and text_hash of every document."""
        roots = self.links()
        nodes = self.with_roots(self.classes.select("uid", "k1", "k2", "least", "copies"), roots, "uid", "root")
        linked = nodes.join(_small(roots.select("root").distinct(), roots.count()), "root", "left_semi")
        linked = cut(linked.select("k1", "k2", "root", "least"), "linked")
        rows = linked.count()
        least = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")), "components")
        named = linked.join(_small(least, rows), "root").select("k1", "k2", "component_id")
        # copies of one set that is linked with no other
        alone = nodes.filter("copies > 1").join(_small(least.select("root"), rows), "root", "left_anti").select("k1", "k2", F.col("least").alias("component_id"))
        named = cut(named.unionByName(alone), "named")
        own = self.signed.filter("n > 0").select("doc_id", "n", "k1", "k2", "text_hash")
        out = own.join(_small(named.withColumn("known", F.lit(True)), named.count()), ["k1", "k2"], "left")
        out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash")
        bare = self.signed.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash")
        return out.unionByName(bare)


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash (xxhash64 of the text) for every document.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct `shingle`-word
    shingles (A-Z lower-cased; fewer words make one shingle; none, no set and no links). component_id is the
    smallest doc_id of a document's component, kept tells the document that has it. Rows of equal sets are one
    node, however many; null texts have no words; null doc_ids are never a component's id unless it has no other;
    rows with one doc_id are told apart; no rows give no rows; columns of other names are ignored.
    """
    rows = Search(documents, MinHashes(shingle, percent)).named()
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash")


def reject_near_duplicates(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that near_duplicates() keeps, with all of their columns: one of each component.

    Rows that repeat a kept doc_id and its text stay too.
    """
    out = cut(near_duplicates(documents, shingle, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct(), "rejected")
    whole = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_hash"))
    same = F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_t"))
    return whole.join(_small(out, out.count()), same, "left_anti").select("row.*")
