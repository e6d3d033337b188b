import re
from collections import Counter

from pyspark.sql import functions as F

from tesserae.llm import quality


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force(docs, corpus):
    more = [(900, "a b c a b c a b"), (901, "a a a a"), (902, "x\ny\nx\n\nx \n"), (903, "# * $ a|b"), (904, "a b"), (905, "one two three " * 400), (906, "a\x0bb\x0cc\rd")]
    texts = dict([*corpus, *more])
    for r in quality.text_statistics(docs([*corpus, *more])).collect():
        got = tuple(r[c] for c in quality.STATISTICS)
        assert got == statistics(texts[r["doc_id"]]), r["doc_id"]


def test_sketches_merge_and_bound_the_error(spark):
    rows = spark.range(1, 5001).select((F.col("id") % 4).alias("g"), (F.col("id") / 10.0).alias("v"))
    by_group = quality.quantile_sketches(rows, ["g"], ["v"])
    merged = quality.sketch_quartiles(quality.merge_sketches(by_group, []), []).first()
    whole = quality.sketch_quartiles(quality.quantile_sketches(rows, [], ["v"]), []).first()
    assert merged == whole
    assert abs(merged["q1"] / 125 - 1) < 0.03 and abs(merged["q3"] / 375 - 1) < 0.03


def test_junk_goes_and_clean_stays(docs):
    clean = [(i, " ".join(f"word{(i * 7 + j * j) % 997}" for j in range(80))) for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{(i + j * j) % 997}***" for j in range(80))) for i in range(5)]
    kept = {r["doc_id"] for r in quality.quality_verdicts(docs(clean + junk)).filter("kept").collect()}
    assert kept == {i for i, _ in clean}


def test_groups_of_null_and_few_rows(docs):
    rows = docs([(1, "short"), (2, " ".join(f"w{j}" for j in range(60)))]).withColumn("lang", F.lit(None).cast("string"))
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_verdicts(rows).collect()}
    assert got == {1: (True, False), 2: (False, True)}


def test_no_python_in_the_plan(docs, corpus):
    plan = quality.quality_verdicts(docs(corpus))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_each_group_has_fences_of_its_own(docs):
    """Symbols that are common in one source are junk in another."""
    texts = lambda n, at, mark: [(at + i, " ".join(f"word{(i * 7 + j * j) % 997}" + ("*" if j < mark(i) else "") for j in range(80))) for i in range(n)]
    rows = docs(texts(120, 0, lambda i: i % 25) + texts(400, 1000, lambda i: 0) + texts(3, 2000, lambda i: 30))
    source = F.when(F.col("doc_id") < 1000, "signs").otherwise("plain")
    got = {r["doc_id"] for r in quality.quality_verdicts(rows.withColumn("source", source)).filter("kept").collect()}
    assert got == {*range(120), *range(1000, 1400)}
    moved = quality.quality_verdicts(rows.withColumn("source", F.when(F.col("doc_id") >= 2000, "signs").otherwise(source)))
    assert {r["doc_id"] for r in moved.filter("kept").collect()} == {*range(120), *range(1000, 1400), 2000, 2001, 2002}


def test_names_of_the_statistics_may_clash(docs, corpus):
    table = docs(corpus).withColumn("n_words", F.lit("mine")).withColumn("base_failed", F.lit(1))
    kept = quality.reject_low_quality(table)
    assert kept.columns == table.columns
    want = {r["doc_id"] for r in quality.quality_verdicts(docs(corpus)).filter("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert {r["n_words"] for r in kept.collect()} <= {"mine"}


def test_repeats_are_found_by_their_words(spark):
    """A long text without any window twice, and one whose last window is its first."""
    words = [f"w{i}" for i in range(60_000)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + words[:3]))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.text_statistics(rows).collect()}
    assert got == {1: 0, 2: 6}
