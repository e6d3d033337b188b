"""Quality rules whose thresholds adapt to each language and source. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut

#: The words of a text are split by these; the JVM's regular expressions know no \x0B in other forms.
_SPLIT = r"[\x20\x09-\x0D]+"
#: A sketch counts values in buckets of relative width SKETCH_GAMMA - 1; counts of two sketches add up.
SKETCH_GAMMA = 1.02
#: A group's sketch is merged with its language's, which counts as so many rows, and that with the sketch of all rows.
PRIOR_ROWS = 50
#: Fences lie so many spreads beyond the quartiles.
FENCE = 4.0
#: Metrics, the side on which each rejects, and the share that one event has in a text, times the words of the text: a
#: symbol; the words in repeated windows, and the repeated line, of a line of ten words that comes twice.
METRICS = {
    "symbol_share": ("high", 1),
    "repeat_share": ("high", 20),
    "dup_line_share": ("high", 10),
    "mean_word": ("both", 0),
}
_QUANTILES = (25, 50, 75, 90)
_COUNT = "decimal(38,0)"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which is found twice or more among the windows of the array.

    Windows become longs: the high part is a hash of the three words, the low part the place. Sorted, equal
    windows are neighbours, whose words are compared; sorted again by place, the lengths of the covered runs add up
    without an index.
    """
    n = F.size(words)
    # words ** 3 windows: place p in the low bits, as many as the number of words needs
    low = F.pow(F.lit(2.0), F.ceil(F.log2(n + 1))).cast("long")

    def keyed(step: Column) -> Column:
        zipped = F.arrays_zip(words.alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"))
        full = F.slice(zipped, 1, F.greatest(n - 2, F.lit(0)))
        return F.sort_array(F.transform(full, lambda w, i: (F.xxhash64(w["a"], w["b"], w["c"]).bitwiseAND(-step)) + i.cast("long")))

    def repeated(keys: Column, step: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            p, q = (k.bitwiseAND(step - 1).cast("int") for k in (x, y))
            words_too = [F.get(words, p + i) == F.get(words, q + i) for i in range(3)]
            return F.coalesce((x.bitwiseAND(-step) == y.bitwiseAND(-step)) & words_too[0] & words_too[1] & words_too[2], F.lit(False))

        return F.filter(
            F.transform(
                F.arrays_zip(
                    F.concat(F.array(F.lit(None).cast("long")), F.slice(keys, 1, F.greatest(F.size(keys) - 1, F.lit(0)))).alias("a"),
                    keys.alias("b"),
                    F.slice(keys, 2, F.size(keys)).alias("c"),
                ),
                lambda z: F.when(same(z["a"], z["b"]) | same(z["b"], z["c"]), z["b"].bitwiseAND(step - 1)),
            ),
            lambda p: p.isNotNull(),
        )

    def covered(places: Column) -> Column:
        ordered = F.sort_array(places)
        return _let(ordered, lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.coalesce(F.least(y - x, F.lit(3)), F.lit(3)).cast("long")),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        ))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(
        _let(low, lambda step: _let(keyed(step), lambda keys: covered(repeated(keys, step))))
    )


def text_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of whole texts.

    A null text counts as empty and has zeros. Columns of these names in the input are replaced; no rows give no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, _SPLIT), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stats = F.transform(F.array(words), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words"),
    ))[0]
    dup_lines = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    with_all = documents.withColumn("_stats", stats).withColumn("_dup", dup_lines)
    return with_all.select(
        *[F.col(f"`{c}`") for c in documents.columns if c not in STATISTICS],
        F.col("_stats.n_words").alias("n_words"),
        F.col("_stats.word_chars").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.col("_dup").alias("n_dup_lines"),
        F.col("_stats.n_repeat_words").alias("n_repeat_words"),
    )


def _metric(name: str) -> Column:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") * 10 / words,
        "mean_word": F.col("word_chars") / words,
        "n_words": words,
    }[name]


def quantile_sketches(values: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mergeable sketches as rows (by, metric, bucket, n): bucket k holds values in (gamma ** (k - 1), gamma ** k].

    Two sketches are merged by adding n; a quantile read from one is off by a factor of gamma at most. Values up
    to 1e-4 share the lowest bucket, so a group has a bounded number of rows however large it is.
    """
    each = values.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m"))
    bucket = F.ceil(F.round(F.log(F.greatest(F.col("m.value"), F.lit(1e-4))) / F.log(F.lit(SKETCH_GAMMA)), 6)).cast("int")
    return each.groupBy(*by, F.col("m.metric").alias("metric"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def _entries(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, b, size): the sketch of each group as an array of at most some hundred buckets, and its rows."""
    own = F.collect_list(F.struct("bucket", F.col("n").cast(_COUNT).alias("n")))
    return sketches.groupBy(*by, "metric").agg(own.alias("b"), F.sum("n").cast(_COUNT).alias("size"))


def _scaled(entries: Column, by: Column) -> Column:
    return F.transform(entries, lambda x: F.struct(x["bucket"].alias("bucket"), (x["n"] * by).cast(_COUNT).alias("n")))


def _merged(own: str, size: str, above: str, total: str) -> tuple[Column, Column]:
    """A sketch merged with PRIOR_ROWS rows of the one above it, in whole numbers: entries and their total."""
    prior = F.lit(PRIOR_ROWS).cast(_COUNT)
    entries = F.concat(_scaled(F.col(own), F.col(total)), _scaled(F.col(above), prior))
    return entries, ((F.col(size) + prior) * F.col(total)).cast(_COUNT)


def sketch_quantiles(entries: Column, total: Column) -> list[Column]:
    """The upper ends of the buckets in which the _QUANTILES of a sketch lie."""

    def at(ordered: Column, percent: int) -> Column:
        found = F.aggregate(
            ordered,
            F.struct(F.lit(0).cast(_COUNT).alias("seen"), F.lit(None).cast("int").alias("bucket")),
            lambda a, x: F.struct(
                (a["seen"] + x["n"]).cast(_COUNT).alias("seen"),
                F.when(a["bucket"].isNotNull(), a["bucket"]).when((a["seen"] + x["n"]) * 100 >= total * percent, x["bucket"]).alias("bucket"),
            ),
        )
        return F.pow(F.lit(SKETCH_GAMMA), found["bucket"])

    ordered = F.sort_array(entries)
    return [at(ordered, p).alias(f"q{p}") for p in _QUANTILES]


def sketch_quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, q1, q3, size) of sketches by themselves."""
    own = _entries(sketches, by).select(*by, "metric", "size", *sketch_quantiles(F.col("b"), F.col("size")))
    return own.select(*by, "metric", F.col("q25").alias("q1"), F.col("q75").alias("q3"), F.col("size").cast("long").alias("size"))


def adaptive_thresholds(stats: DataFrame) -> DataFrame:
    """(lang, source) -> lowest and highest value that each metric may take there.

    Only rows that pass the base rules are sketched. Each group's sketch is merged with PRIOR_ROWS rows of its language's
    sketch, and that with as many of all rows', so that small groups lean on the larger ones and no size is a switch.
    A fence lies FENCE spreads beyond a quartile. The spread is the largest of the distance between the quartiles,
    that between median and ninth decile, the share of one event in a text of the group's median length (most
    metrics are 0 in most texts, and the first two with them), and the width of the sketch's own buckets.
    """
    names = [*METRICS, "n_words"]
    sound = stats.filter(~F.col("base_failed")).select("lang", "source", *[_metric(m).alias(m) for m in names])
    fine = cut(quantile_sketches(sound, ["lang", "source"], names), "sketches")
    by_lang = merge_sketches(fine, ["lang"])
    everything = _entries(merge_sketches(by_lang, []), []).toDF("a_metric", "a_b", "a_size")  # a row for each metric
    langs = _entries(by_lang, ["lang"]).join(F.broadcast(everything), F.col("metric") == F.col("a_metric"))
    entries, total = _merged("b", "size", "a_b", "a_size")
    langs = langs.select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), entries.alias("l_b"), total.alias("l_total"))
    groups = _entries(fine, ["lang", "source"]).join(langs, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")))
    entries, total = _merged("b", "size", "l_b", "l_total")
    groups = groups.select("lang", "source", "metric", entries.alias("e"), total.alias("total"))
    groups = groups.select("lang", "source", "metric", *sketch_quantiles(F.col("e"), F.col("total")))
    pick = lambda m, q: F.max(F.when(F.col("metric") == m, F.col(q)))
    wide = groups.groupBy("lang", "source").agg(pick("n_words", "q50").alias("length"), *[pick(m, f"q{p}").alias(f"{m}_{p}") for m in METRICS for p in _QUANTILES])
    fences = []
    for m, (_, event) in METRICS.items():
        q = {p: F.col(f"{m}_{p}") for p in _QUANTILES}
        span = F.greatest(q[75] - q[25], q[90] - q[50], F.lit(float(event)) / F.col("length"), q[75] * (SKETCH_GAMMA - 1)) * FENCE
        fences += [(q[25] - span).alias(f"{m}_low"), (q[75] + span).alias(f"{m}_high")]
    return wide.select("lang", "source", *fences)


BASE_FAILED = "n_words < 50 or n_repeat_words * 100 > n_words * 50"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Threshold tables of more rows than this are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _judged(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """stats, which has lang and source, with base_failed and kept."""
    beyond = F.lit(False)
    for m, (side, _) in METRICS.items():
        beyond = beyond | (_metric(m) > F.col(f"t_{m}_high"))
        if side == "both":
            beyond = beyond | (_metric(m) < F.col(f"t_{m}_low"))
    limits = limits.toDF(*[f"t_{c}" for c in limits.columns])
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(~F.coalesce(beyond, F.lit(False)))
    return joined.withColumn("kept", kept)


def quality_verdicts(documents: DataFrame) -> DataFrame:
    """One row per document: the statistics, base_failed and kept, beside doc_id, lang and source.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. The other rows are
    kept unless a metric lies beyond the fences of their language and source. Null languages and sources are
    groups of their own; null or empty texts have no words and fail the base rules; rows with equal doc_id are
    judged one by one; an empty table gives no rows. Columns of other names are ignored.
    """
    rows = documents.select("doc_id", "lang", "source", "text")
    stats = cut(text_statistics(rows).drop("text").withColumn("base_failed", F.expr(BASE_FAILED)), "quality-stats")
    limits = cut(adaptive_thresholds(stats), "thresholds")
    return _judged(stats, limits).select("doc_id", "lang", "source", *STATISTICS, "base_failed", "kept")


def reject_low_quality(documents: DataFrame) -> DataFrame:
    """The documents that quality_verdicts() keeps, with all of their columns.

    Rows are judged as there: null or empty texts go, repeated rows each stay or go, an empty table stays empty. The
    statistics are written beside the rows, so that texts are gone through once.
    """
    whole = documents.select(F.struct("*").alias("row"), "lang", "source", "text")
    stats = text_statistics(whole).drop("text").withColumn("base_failed", F.expr(BASE_FAILED))
    stats = cut(stats, "quality-rows")
    limits = cut(adaptive_thresholds(stats.drop("row")), "thresholds")
    return _judged(stats, limits).filter("kept").select("row.*")
