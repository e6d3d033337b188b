"""The pipeline stage by stage: verdicts of the operators, and plain versions of what can be done plainly."""

import random
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_suffixes import brute as repeats_brute
from tesserae.llm import quality, suffixes, toxicity
from tesserae.llm.common import cut

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, cut(stage(spark, docs, SF), name))
        docs = seen[name][1]
        if name != "packing":
            assert docs.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}

    before, after = seen["toxicity"]
    assert ids(after) == ids(toxicity.severity(before, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept"))
    before, after = seen["quality_rules"]
    assert ids(after) == ids(quality.quality_verdicts(before).filter("kept"))
    before, after = seen["minhash_dedup"]
    assert ids(after) == {i for i, (_, _, kept) in near_brute(sorted(texts(before).items()), 2).items() if kept}
    before, after = seen["suffix_array_dedup"]
    assert ids(before) == ids(after)
    want = repeats_brute(texts(before).items(), 100)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(before).collect()}
    assert got == want
    for i, t in texts(after).items():
        assert len(t.encode()) <= want[i][0] - want[i][1]
    before, after = seen["packing"]
    assert ids(after) == ids(before)

    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, seen["packing"][1].select("doc_id", "piece", "ids_crc32").collect()))


def corpus_dir(spark, tmp_path, rows, extra=True):
    """A folder with documents, with columns of clashing names, and labels."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", kept int, tag string, label string" if extra else "")
    full = [(i, t, lang, "s", None if t is None else len(t), *((1, "x", None) if extra else ())) for i, t, lang in rows]
    spark.createDataFrame(full, schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, corpus_dir(spark, tmp_path, [])).count() == 0


def test_null_and_equal_ids(spark, tmp_path):
    """Texts of no id and of one id are documents of their own: none is cut by another's ranges, clean ones stay."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    passage = " ".join(word() for _ in range(60))
    own = [" ".join(word() for _ in range(70)) for _ in range(600)]
    texts = [f"{t}\n{passage}" if k % 5 == 0 else t for k, t in enumerate(own)]
    rows = [(None if k % 2 else 7, t, None if k % 3 == 0 else "en") for k, t in enumerate(texts)] + [(None, None, "en"), (8, "", None), (9, "short", "en")]
    sf = corpus_dir(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = cut(stage(spark, docs, sf), name)
        assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    left = sorted(r["text"] for r in docs.collect())
    # every text stays whole but for the passage, which stays in one of them
    whole = [t for t in left if passage in t]
    assert len(whole) == 1 and len(left) == len(texts)
    assert sorted(t.replace(passage, "").strip()[:60] for t in left) == sorted(t[:60] for t in own)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert packed.select("doc_id", "piece").count() >= len(texts)
