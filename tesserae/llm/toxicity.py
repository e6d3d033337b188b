"""Toxicity as an ordered severity, by a cumulative-link regression on sparse text features."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import bound_batches, cut, slices

#: The model is fitted on so many labelled documents at most (those with the least hash of their id).
SAMPLE_ROWS = 20_000
#: Features of the model at most, chosen by the strength of their evidence.
MAX_FEATURES = 512
#: Severity grades: 0 for clean documents, 1 to GRADES - 1 for toxic ones.
GRADES = 4
#: Beginnings of longer words are features too: inflected languages vary the ends.
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> list[str]:
    """Lower-cased words, and the first letters of longer ones marked by a star."""
    words = _WORD.findall(text.lower())
    return words + [w[:n] + "*" for n in PREFIXES for w in words if len(w) > n]


def _sketch(text: str) -> int:
    """One min-hash of the 3-word shingles: near copies mostly share it, other texts don't."""
    words = text.split()
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))), default=0)


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(weights . x - thresholds[k]) with x = log(1 + count); thresholds ascend."""

    features: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, times: np.ndarray, grades: int = GRADES, l2: float = 1e-5, steps: int = 1500, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights (shared by all thresholds) and ascending thresholds of largest likelihood, by Adam on all rows.

    times: how often each row counts. Thresholds are kept in order by writing each as the one below plus an exponential.
    """
    n, d = x.shape
    share = (times / times.sum())[:, None]
    p = np.zeros(d + grades - 1)
    p[d], p[d + 1 :] = 1.0, np.log(0.7)
    m, v = np.zeros_like(p), np.zeros_like(p)
    at_or_below = np.arange(grades - 1)[None, :]
    for t in range(1, steps + 1):
        w, gaps = p[:d], np.exp(p[d + 1 :])
        theta = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        # cumulative P(grade <= k), with 0 and 1 at the ends
        cdf = 1 / (1 + np.exp(np.clip((x @ w)[:, None] - theta[None, :], -40, 40)))
        density = cdf * (1 - cdf)
        padded = np.concatenate([np.zeros((n, 1)), cdf, np.ones((n, 1))], axis=1)
        mass = np.maximum(padded[np.arange(n), grade + 1] - padded[np.arange(n), grade], 1e-9)
        sign = (at_or_below == grade[:, None]).astype(float) - (at_or_below == grade[:, None] - 1)
        by_theta = -sign * density / mass[:, None] * share
        g_theta = by_theta.sum(axis=0)
        g_w = -(x.T @ by_theta.sum(axis=1)) + l2 * w
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([g_w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])


def _sample_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(iter(batches)):
        texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
        counted = [Counter(features_of(t)) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(b.schema.get_field_index("toxic")),
                pa.array([_sketch(t) for t in texts], pa.int64()),
                pa.array([list(c) for c in counted], pa.list_(pa.string())),
                pa.array([list(c.values()) for c in counted], pa.list_(pa.int32())),
            ],
            names=["toxic", "sketch", "features", "counts"],
        )


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit the regression on at most sample_rows labelled documents.

    The labels say only toxic or not; a toxic document's grade is 1 plus the number of cuts, at equal shares of
    the toxic sample, that its count of tell-tale features passes. Features are chosen by the likelihood
    ratio of their document counts among toxic and clean samples, against a level that allows for how many were
    looked at. Of near copies in the sample one counts. Null labels are left out; of several labels of a document
    the highest holds. Without toxic samples the model has no features and finds nothing toxic.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")
    rows = cut(sample.mapInArrow(_sample_features, "toxic int, sketch long, features array<string>, counts array<int>"), "labelled")
    rows = cut(rows.groupBy("sketch").agg(F.max_by(F.struct("toxic", "features", "counts"), F.struct("toxic", F.hash("features"))).alias("r")).select("r.*"), "labelled-once")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return OrdinalModel([], np.zeros(0), np.arange(1.0, GRADES))
    rate = bad / (bad + good)
    seen = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    seen = cut(seen.filter("n >= 4"), "features")
    looked_at = max(seen.count(), 1)
    share = F.col("bad") / F.col("n")
    evidence = 2 * (F.col("bad") * F.log(share / rate) + F.when(share < 1, (F.col("n") - F.col("bad")) * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    chosen = [
        r["feature"]
        for r in seen.filter(share > max(0.6, rate))
        .withColumn("evidence", evidence)
        .filter(F.col("evidence") > 2 * float(np.log(looked_at)) + 6)
        .orderBy(F.desc("evidence"), "feature")
        .limit(MAX_FEATURES)
        .collect()
    ]
    if not chosen:
        return OrdinalModel([], np.zeros(0), np.arange(1.0, GRADES))
    index = {f: i for i, f in enumerate(chosen)}
    picked = F.array(*[F.lit(f) for f in chosen])
    hits = rows.select("toxic", F.filter(F.arrays_zip("features", "counts"), lambda z: F.array_contains(picked, z["features"])).alias("hits")).collect()
    # the many rows without any hit are two rows here, one clean and one toxic, that count as often
    telling = [r for r in hits if r["hits"]]
    none = [sum(1 for r in hits if not r["hits"] and r["toxic"] == y) for y in (0, 1)]
    x, toxic = np.zeros((len(telling) + 2, len(chosen))), np.array([r["toxic"] for r in telling] + [0, 1])
    times = np.array([1.0] * len(telling) + none)
    for i, r in enumerate(telling):
        for z in r["hits"]:
            x[i, index[z["features"]]] = np.log1p(z["counts"])
    strength = x.sum(axis=1)
    cuts = np.quantile(np.repeat(strength[toxic == 1], times[toxic == 1].astype(int)), np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic == 1, 1 + (strength[:, None] > cuts[None, :]).sum(axis=1), 0)
    weights, thresholds = fit_ordinal(x, grade, times)
    return OrdinalModel(chosen, weights, thresholds)


def _score_function(model: OrdinalModel):
    weight = dict(zip(model.features, model.weights.tolist(), strict=True))
    words = {f: w for f, w in weight.items() if not f.endswith("*")}
    starts = {f[:-1]: w for f, w in weight.items() if f.endswith("*")}
    lengths = sorted({len(f) for f in starts})

    def score(text: str) -> float:
        tokens = _WORD.findall(text.lower())
        found = Counter(w for w in tokens if w in words)
        heads = Counter(h for n in lengths for w in tokens if (h := w[:n]) in starts and len(w) > n)
        return sum(words[f] * np.log1p(n) for f, n in found.items()) + sum(starts[f] * np.log1p(n) for f, n in heads.items())

    def grades(batch: pa.RecordBatch) -> np.ndarray:
        """P(grade > k) of each text of a batch, a column for each k."""
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        return model.above(np.array([score(t) if t else 0.0 for t in texts], dtype=float))

    return grades


def _scorer(model: OrdinalModel):
    grades = _score_function(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(iter(batches)):
            above = grades(b)
            toxic = above[:, 0]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(b.schema.get_field_index("doc_id")),
                    pa.array(above.sum(axis=1)),
                    pa.array(toxic),
                    pa.array((above >= 0.5).sum(axis=1), pa.int32()),
                    pa.array(toxic < 0.5),
                ],
                names=["doc_id", "expected_severity", "p_toxic", "grade", "kept"],
            )

    return run


def severity(documents: DataFrame, labels: DataFrame, model: OrdinalModel | None = None) -> DataFrame:
    """One row per document: expected_severity, p_toxic (any grade above 0), the median grade, and kept (grade 0).

    Labels tell toxic from clean alone, so the order among toxic grades is the model's own reading: without other evidence
    a toxic sample's grade is its third by the features that the regression then weighs (see train()).
    Whole texts are scored. Null and empty texts have no features and are kept; rows with equal doc_id
    are scored one by one; no rows give no rows; columns of other names are ignored.
    """
    bound_batches(documents.sparkSession)
    model = model or train(documents, labels)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scorer(model), "doc_id long, expected_severity double, p_toxic double, grade int, kept boolean")


def reject_toxic(documents: DataFrame, labels: DataFrame, model: OrdinalModel | None = None) -> DataFrame:
    """The documents that severity() keeps, with all of their columns.

    Null and empty texts stay, repeated rows each stay or go, an empty table stays empty.
    """
    bound_batches(documents.sparkSession)
    model = model or train(documents, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades = _score_function(model)
        for b in slices(iter(batches)):
            yield b.filter(pa.array(grades(b)[:, 0] < 0.5))

    return documents.mapInArrow(run, documents.schema)
