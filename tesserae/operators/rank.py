"""Term weighting, similarities and thresholded rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.text import word_tokens
from tesserae.operators.sets import top_k
from tesserae.sources.scratch import small


def term_counts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return texts.select(key, F.explode(word_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, df, weight): tf * log2(N / df), scaled to unit length for each text."""
    counts = term_counts(texts, key, text)
    n = texts.select(key).distinct().agg(F.count("*").alias("n_docs"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    raw = counts.join(df, "term").crossJoin(F.broadcast(n)).withColumn("raw", F.col("tf") * F.log2(F.col("n_docs") / F.col("df")))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "tf", "df", F.coalesce(F.try_divide(F.col("raw"), F.nullif(norm, F.lit(0.0))), F.lit(0.0)).alias("weight"))


def tfidf_similarity(corpus: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(qid, key, similarity) of all pairs that share a term; a query's weights use the corpus's df. Others are 0."""
    weights = tfidf(corpus, key)
    n = corpus.select(key).distinct().agg(F.count("*").alias("n_docs"))
    own = queries.select("qid", F.explode(word_tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("tf"))
    df = weights.groupBy("term").agg(F.max("df").alias("df"))
    raw = own.join(df, "term").crossJoin(F.broadcast(n)).withColumn("raw", F.col("tf") * F.log2(F.col("n_docs") / F.col("df")))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("qid")))
    q = raw.select("qid", "term", F.coalesce(F.try_divide(F.col("raw"), F.nullif(norm, F.lit(0.0))), F.lit(0.0)).alias("wq"))
    return q.join(weights, "term").groupBy("qid", key).agg(F.sum(F.col("wq") * F.col("weight")).alias("similarity"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


#: Rows of a block of vectors, and of queries that meet it at once.
_BLOCK = 1024


def _blocks(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(keys, whole, matrix): rows in blocks, their vectors as the bytes of doubles; one that is null or holds nulls isn't whole."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(lo, _BLOCK)
                whole = np.array(part.column(1).is_valid().to_pylist(), dtype=bool)
                values = np.asarray(part.column(1).flatten(), dtype="<f8")
                matrix = np.zeros((len(whole), len(values) // max(1, whole.sum())))
                matrix[whole] = values.reshape(whole.sum(), matrix.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([whole.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], ["keys", "whole", "matrix"])

    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.select("key", F.when(~F.exists("v", lambda x: x.isNull()), F.col("v")).alias("v"))
    return rows.mapInArrow(pack, "keys array<long>, whole binary, matrix binary")


def dot_pairs(queries: DataFrame, vectors: DataFrame, k: int | None = None, threshold: float | None = None, digits: int = 6) -> DataFrame:
    """(qid, vec_id, similarity) of a stated set of queries with all other vectors, all of one length.

    Blocks of vectors meet blocks of queries, and a product of two matrices has the similarities of all pairs of both.
    With k or a threshold, pairs that can't be among a query's k best or can't reach the threshold, once similarities
    are rounded to `digits`, are left out where they are made; of those that tie for the last place all stay. The
    similarity of a vector that is null or holds nulls is null.
    """
    slack = 2 * 10.0**-digits

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for qids, qw, q, ids, vw, v in zip(*[batch.column(i) for i in range(6)], strict=True):
                qid, vec = np.array(qids.as_py(), dtype="i8"), np.array(ids.as_py(), dtype="i8")
                a, b = [np.frombuffer(m.as_py(), "<f8").reshape(n, len(m.as_py()) // 8 // n) for m, n in ((q, len(qid)), (v, len(vec)))]
                some = [np.frombuffer(w.as_py(), dtype=bool) for w in (qw, vw)]
                for lo in range(0, len(qid), 64):  # some queries at a time, so that what is held and sent on is bounded
                    own = qid[lo : lo + 64]
                    score = a[lo : lo + 64] @ b.T if a.shape[1] == b.shape[1] else np.zeros((len(own), len(vec)))
                    none = ~(some[0][lo : lo + 64, None] & some[1][None, :])
                    score[none] = -np.inf
                    keep = own[:, None] != vec[None, :]
                    if threshold is not None:
                        keep &= ~(score < threshold - slack)
                    if k is not None and len(vec) > k + 1:
                        # a row's own vector may be one of its best
                        least = -np.partition(-np.where(keep, score, -np.inf), k - 1, axis=1)[:, k - 1 : k]
                        keep &= ~(score < least - slack)
                    i, j = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(vec[j]), pa.array(score[i, j], mask=none[i, j])], ["qid", "vec_id", "similarity"])

    left = _blocks(queries, "qid", "q").toDF("qids", "qw", "qm")
    if queries.limit(20_001).count() <= 20_000:
        left = F.broadcast(left)
    right = _blocks(vectors, "vec_id", "embedding").toDF("ids", "vw", "vm")
    return right.crossJoin(left).select("qids", "qw", "qm", "ids", "vw", "vm").mapInArrow(meet, "qid long, vec_id long, similarity double")


def centred(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Subtract the mean similarity of the whole batch (or of each group) and clip at 0."""
    mean = pairs.groupBy(*(by or [])).agg(F.avg("similarity").alias("mean"))
    joined = pairs.join(mean, by) if by else pairs.crossJoin(F.broadcast(mean))
    return joined.withColumn("centred", F.greatest(F.col("similarity") - F.col("mean"), F.lit(0.0))).drop("mean")


def weighted(syntactic: Column, semantic: Column, share: float) -> Column:
    return share * syntactic + (1 - share) * semantic


def ranked(pairs: DataFrame, by: str, index: str, score: str = "similarity", threshold: float | None = None, k: int | None = None) -> DataFrame:
    """Descending ranks; of equal scores the larger index comes first. Scores below the threshold end the ranking."""
    kept = pairs if threshold is None else pairs.filter(F.col(score) >= threshold)
    order = [F.desc(score), F.desc(index)]
    if k is not None:
        return top_k(kept, [by], order, k)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
