import random

import numpy as np
import pytest

from tesserae.llm import lm, toxicity


def test_ordinal_regression_orders_its_thresholds():
    rng = np.random.default_rng(0)
    x = rng.poisson(0.6, (1500, 4)).astype(float)
    latent = x @ np.array([2.0, 1.0, 0.0, 0.5]) + rng.logistic(size=1500)
    grade = np.digitize(latent, [1.0, 2.5, 4.0])
    w, theta = toxicity.fit_ordinal(x, grade, np.ones(1500))
    assert (np.diff(theta) > 0).all()
    assert w == pytest.approx([2.0, 1.0, 0.0, 0.5], abs=0.3)
    assert theta == pytest.approx([1.0, 2.5, 4.0], abs=0.4)


def test_times_count_like_repeated_rows():
    x, grade = np.array([[0.0], [1.0], [2.0], [1.0]]), np.array([0, 1, 2, 0])
    once = toxicity.fit_ordinal(np.repeat(x, [3, 2, 1, 1], axis=0), np.repeat(grade, [3, 2, 1, 1]), np.ones(7), grades=3, l2=0.01)
    times = toxicity.fit_ordinal(x, grade, np.array([3.0, 2, 1, 1]), grades=3, l2=0.01)
    assert np.allclose(once[0], times[0]) and np.allclose(once[1], times[1])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(60)]
        toxic = i % 8 == 0
        for _ in range(rng.randrange(1, 7) if toxic else 0):
            text[rng.randrange(60)] = rng.choice(["vilest", "Rottenly,", "rottenest", "beastly"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark, docs, labelled):
    rows, labels = labelled
    known = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.severity(docs(rows), known).collect()}
    wrong = [i for i, _, y in labels[400:] if out[i]["kept"] == bool(y)]
    assert len(wrong) <= 2
    for i, _, y in labels[400:]:
        assert 0 <= out[i]["expected_severity"] <= toxicity.GRADES - 1
    bad = [out[i]["expected_severity"] for i, _, y in labels[400:] if y]
    good = [out[i]["expected_severity"] for i, _, y in labels[400:] if not y]
    assert np.mean(bad) > 1 > 0.2 > np.mean(good)


def test_no_toxic_labels_reject_nothing(spark, docs, labelled):
    rows, labels = labelled
    clean = spark.createDataFrame([x for x in labels if not x[2]], "doc_id long, quality int, toxic int")
    assert toxicity.reject_toxic(docs(rows), clean).count() == len(rows)


def test_network_gradients():
    net = lm.WindowNetwork()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    ids = np.sort(rng.integers(0, lm.VOCABULARY, 50))
    ctx = rng.integers(0, lm.VOCABULARY + 1, (len(lm._OFFSETS), 50)).astype(np.uint16)
    _, g = net.forward(ids, ctx, train=True)
    for name, at in (("to_class", (3, 5)), ("bias", (2,)), ("embed", (1, int(ctx[1, 7]), 4)), ("to_word", (int(ids[0]) // lm._PER_CLASS, 1, int(ids[0]) % lm._PER_CLASS))):
        old, eps = net.p[name][at], 1e-5
        net.p[name][at] = old + eps
        up = -net.forward(ids, ctx).sum()
        net.p[name][at] = old - eps
        down = -net.forward(ids, ctx).sum()
        net.p[name][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[name][at], rel=1e-3, abs=1e-6)


def test_scores_are_sums_over_tokens_and_normalised():
    net = lm.WindowNetwork()
    ids, doc = np.array([5, 9, 5, 1000, 3]), np.array([0, 0, 0, 1, 1])
    total = net.score(ids, doc, 3)
    ctx = net.contexts(ids, doc)
    assert ctx[lm._OFFSETS.index(1)].tolist() == [9, 5, lm.VOCABULARY, 3, lm.VOCABULARY]
    for d in (0, 1):
        own = np.flatnonzero(doc == d)
        probability = [sum(np.exp(net.forward(np.array([y]), ctx[:, [i]])[0]) for y in range(lm.VOCABULARY)) for i in own]
        assert probability == pytest.approx([1.0] * len(own), abs=1e-4)
        assert total[d] == pytest.approx(sum(net.forward(ids[[i]], ctx[:, [i]])[0] for i in own), abs=1e-4)
    assert total[2] == 0


def test_training_helps_on_held_out_texts(spark, docs):
    rng = random.Random(2)
    pairs = [(f"a{i}", f"b{i}") for i in range(30)]
    text = lambda: " ".join(w for _ in range(40) for w in rng.choice(pairs))
    train = docs([(i, text()) for i in range(400)])
    test = docs([(i, text()) for i in range(40)])
    mean = lambda model: np.mean([r["mean_log_probability"] for r in lm.pseudo_likelihood(test, model).collect()])
    words, net = lm.train(train)
    assert mean((words, net)) > mean((words, lm.WindowNetwork())) + 2
    # half of each pair tells the other: better than any model of single words
    assert mean((words, net)) > -np.log(60) + 0.7


def test_vocabulary_counts_all_documents(docs):
    table = docs([(1, "x x x y"), (2, "Y z z"), (3, None)])
    words = lm.vocabulary(table, size=3)
    assert len(words) == 2


def test_rare_words_have_probabilities_of_their_own(docs):
    common = [(i, " ".join(f"c{j}" for j in range(1100) for _ in range(3))) for i in range(2)]
    table = docs([*common, (10, "seldom"), (11, "seldom seldom"), (12, "seldom"), (13, "oddlym"), (14, "oddlym"), (15, "oncem")])
    model = lm.train(table)
    counts, _, totals = model[1].rest
    assert totals.sum(axis=1).tolist() == [(1100 - 1023) * 6 + 7, 1100 - 1023 + 3]
    assert sum(len(r["words"]) // 8 for r in counts.collect()) == 1103
    got = {r["doc_id"]: r["log_likelihood"] for r in lm.pseudo_likelihood(docs([(1, "oddlym"), (2, "oncem"), (3, "neverm"), (4, "oddlym"), (5, None)]), model).collect()}
    assert got[1] == got[4] and got[5] == 0 and got[3] < min(got[1], got[2]) - 20
    # equal last letters, so one class, and no neighbours: only the counts 4 and 0 tell these apart
    never = np.log((lm.DISCOUNT * totals[1][_class_of("xxom")] + 1) * lm._UNSEEN)
    seen = {r["doc_id"]: r["log_likelihood"] for r in lm.pseudo_likelihood(docs([(1, "seldom"), (2, "xxom"), (3, "yyom")]), model).collect()}
    assert seen[2] == pytest.approx(seen[3]) and seen[1] - seen[2] == pytest.approx(np.log(4 - lm.DISCOUNT) - never)


def _class_of(word):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([word])], names=["text"])
    return next(lm._texts([batch]))[1][0] & (lm.RARE_CLASSES - 1)


def test_rare_neighbours_and_targets_reach_the_network():
    net = lm.WindowNetwork()
    rare = lm.VOCABULARY + 1
    ids = np.array([rare + 5, 9, rare + 700])
    ctx = net.contexts(ids, np.zeros(3, int))
    assert ctx[lm._OFFSETS.index(1)].tolist() == [9, rare + 700, lm.VOCABULARY]
    inner = [np.exp(net.forward(np.array([rare + c]), ctx[:, :1])[0]) for c in range(lm.RARE_CLASSES)]
    assert sum(inner) == pytest.approx(np.exp(net.forward(np.array([0]), ctx[:, :1])[0]), rel=1e-4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g = net.forward(ids, ctx, train=True)
    for name, at in (("to_rare", (3, 5)), ("rare_bias", (700 % lm.RARE_CLASSES,)), ("embed", (lm._OFFSETS.index(1), rare + 700, 4))):
        old, eps = net.p[name][at], 1e-5
        net.p[name][at] = old + eps
        up = -net.forward(ids, ctx).sum()
        net.p[name][at] = old - eps
        down = -net.forward(ids, ctx).sum()
        net.p[name][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[name][at], rel=1e-3, abs=1e-6)


def test_scores_do_not_depend_on_partitions(docs, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_TOKENS", 3000)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(rng.choices(words, range(1500, 0, -1), k=60))) for i in range(150)] + [(200, None), (201, ""), (202, "w1 " * 9000)]
    table = docs(rows)
    few, many = lm.train(table.repartition(4)), lm.train(table.repartition(32, "doc_id"))
    assert (few[0] == many[0]).all()
    assert np.allclose(few[1].flat(), many[1].flat(), rtol=0, atol=1e-5)
    assert not np.allclose(few[1].flat(), lm.WindowNetwork().flat(), rtol=0, atol=0.05)
    scores = [{r["doc_id"]: r["log_likelihood"] for r in lm.pseudo_likelihood(table.repartition(n), model).collect()} for n, model in ((5, few), (17, many))]
    assert scores[0] == pytest.approx(scores[1], rel=1e-4) and scores[0][200] == scores[0][201] == 0


def test_steps_do_not_depend_on_batches():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 900, 40)
    ids, doc = rng.integers(0, lm.VOCABULARY, lengths.sum()), np.repeat(np.arange(40), lengths)
    ids += (lm.VOCABULARY + 1) * (rng.random(len(ids)) < 0.4)
    whole, pieces = lm._Training(), lm._Training()
    whole.add(ids, doc)
    for a in range(0, 40, 7):
        own = (doc >= a) & (doc < a + 7)
        pieces.add(ids[own], doc[own] - a)
    assert (whole.finish() == pieces.finish()).all() and whole.seen == pieces.seen == len(ids)
