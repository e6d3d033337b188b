"""Nulls, empty tables, repeated rows and clashing names, for every operator on documents."""

import pytest

from tesserae.llm import lm, neardup, packing, pieces, quality, sharding, suffixes, toxicity

OPERATORS = {
    "pieces": lambda d, labels: pieces.encode_digest(d),
    "lm": lambda d, labels: lm.pseudo_likelihood(d),
    "sharding": lambda d, labels: sharding.byte_shards(d),
    "packing": lambda d, labels: packing.pack_documents(d),
    "neardup": lambda d, labels: neardup.near_duplicates(d),
    "suffixes": lambda d, labels: suffixes.remove_repeats(d),
    "toxicity": lambda d, labels: toxicity.severity(d, labels),
    "quality": lambda d, labels: quality.quality_verdicts(d),
}
FILTERS = {
    "toxicity": toxicity.reject_toxic,
    "quality": lambda d, labels: quality.reject_low_quality(d),
    "neardup": lambda d, labels: neardup.reject_near_duplicates(d, 2),
    "suffixes": lambda d, labels: suffixes.cut_repeats(d),
}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs([]), labels).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_and_repeated_rows(docs, labels, name):
    rows = [(None, None), (None, "some text of no id"), (1, "one two three"), (1, "one two three"), (1, "other text"), (2, None), (3, "")]
    out = OPERATORS[name](docs(rows), labels).collect()
    assert len(out) == len(rows)
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows)


@pytest.mark.parametrize("name", FILTERS)
def test_filters_return_the_columns_of_documents(docs, labels, name):
    rows = docs([(1, "one two three " * 3), (2, "one two three " * 3), (None, None), (4, "")])
    out = FILTERS[name](rows, labels)
    assert out.columns == rows.columns
    assert out.count() <= rows.count()
    assert FILTERS[name](docs([]), labels).count() == 0
