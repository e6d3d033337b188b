"""Trees of parsed sentences are climbed where a sentence lies."""

from tesserae.operators import concepts, extract

SCHEMA = "sent_id long, i int, dep string, head int"
ROWS = [
    (1, 0, "nsubj", 1), (1, 1, "ROOT", 1), (1, 2, "dobj", 1), (1, 3, "conj", 2), (1, 4, "conj", 3),
    (2, 0, "ROOT", 0), (2, 1, "conj", 0), (2, 2, "conj", 9),  # a head outside of the sentence
    (None, 0, "ROOT", 0), (None, 1, "conj", 0), (None, 2, "conj", 1),  # rows without a sentence have none in common
    (3, 0, "conj", 0), (3, 1, "conj", 0), (3, 2, None, 1),
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ancestors_without_a_job_for_each_level(spark):
    tokens = spark.createDataFrame(ROWS, SCHEMA)
    found = extract.ancestors(tokens)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    expected = [(1, 0, 1, 1), (1, 2, 1, 1), (1, 3, 2, 1), (1, 3, 1, 2), (1, 4, 3, 1), (1, 4, 2, 2), (1, 4, 1, 3), (2, 1, 0, 1), (2, 2, 9, 1)]
    expected += [(None, 1, 0, 1), (None, 2, 1, 1), (3, 1, 0, 1), (3, 2, 1, 1), (3, 2, 0, 2)]
    assert rows(found) == sorted(expected, key=repr)
    assert extract.ancestors(tokens.limit(0)).collect() == []


def test_resolved_dependencies(spark):
    found = concepts.resolved_dependencies(spark.createDataFrame(ROWS, SCHEMA))
    got = {(r.sent_id, r.i): r.rdep for r in found.collect()}
    assert got == {
        (1, 0): "nsubj", (1, 1): "ROOT", (1, 2): "dobj", (1, 3): "dobj", (1, 4): "dobj", (2, 0): "ROOT", (2, 1): "ROOT", (2, 2): None,
        (None, 0): "ROOT", (None, 1): None, (None, 2): None, (3, 0): None, (3, 1): None, (3, 2): None,
    }


def test_descendants_with_flags(spark):
    tokens = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "a"), (1, 2, 1, "b"), (1, 3, 2, "a"), (2, 0, 0, "a"), (2, 1, 0, "b")], "sent_id long, i int, head int, kind string")
    cores = spark.createDataFrame([(1, 0), (1, 2), (2, 1)], "sent_id long, i int")
    got = rows(extract.descendants(tokens, cores, [tokens.kind == "a", tokens.i > 1]))
    assert got == [(1, 0, 1, 1), (1, 0, 2, 0), (1, 0, 3, 0), (1, 2, 3, 3)]
