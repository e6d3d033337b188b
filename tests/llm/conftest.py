import random

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """(doc_id, text, lang, source, n_chars) rows as a table, with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept int, uid string")

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, empty and very long ones."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(40)
    rows = [(i, text(rng.randrange(1, 160))) for i in range(60)]
    rows += [(100 + i, text(20) + "\n" + passage + "\n" + text(20)) for i in range(8)]
    base = text(120).split()
    for i in range(25):
        own = list(base)
        for _ in range(i % 9):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((200 + i, " ".join(own)))
    rows += [(300 + i, rows[3][1]) for i in range(5)]
    rows += [(400, None), (401, ""), (402, "   \n\t"), (403, "word"), (404, "word"), (405, "Word"), (406, text(9000)), (407, "é" * 300 + "😀" * 60), (408, "a\x00b ▁  c")]
    rng.shuffle(rows)
    return rows
