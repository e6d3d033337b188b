import math
import random
import re
from collections import Counter

from tesserae.operators import senses as S


def brute(sentences, senses, stop=()):
    count = lambda t: Counter(re.findall(r"\w+", t.lower()))
    size = lambda c: math.sqrt(sum(n * n for n in c.values()))
    out = {}
    for text in {t for t in sentences if t}:
        own = count(text)
        for w in own:
            found = []
            for lemma, sense, order, gloss in senses:
                if lemma == w and w not in stop:
                    g = count(gloss or "")
                    dot = sum(n * g[x] for x, n in own.items())
                    found.append((-round(dot / (size(own) * size(g)), 6) if dot else 0.0, order, sense))
            if found:
                s, _, sense = min(found)
                out[text, w] = (sense, -s)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["bank", "river", "money", "loan", "water", "the", "fish", "rate", "bass", "music"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    senses = [(w, f"{w}.{k}", k, text(rng.randrange(1, 6)) if k < 3 else None) for w in ("bank", "rate", "bass", "fish") for k in range(rng.randrange(1, 5))]
    sentences = [text(rng.randrange(1, 9)) for _ in range(60)] + [None, "", "Bank, BANK!", "nothing known"]
    df = spark.createDataFrame([(t, 1) for t in sentences + sentences[:9]], "text string, sense int")
    table = spark.createDataFrame(senses, "lemma string, sense string, ord int, gloss string")
    for stop in ((), ("fish",)):
        names = spark.createDataFrame([(x,) for x in stop], "stop string") if stop else None
        rows = S.cosine_lesk(df, table, stop_words=names).collect()
        got = {(r["text"], r["lemma"]): (r["sense"], r["similarity"]) for r in rows}
        want = brute(sentences, senses, stop)
        assert len(rows) == len(got) and got.keys() == want.keys()
        assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in got)


def test_edges_and_nothing(spark):
    table = spark.createDataFrame([("law", "law.1", 1, "rules of a state"), ("law", "law.2", 2, "the police")], "lemma string, sense string, ord int, gloss string")
    df = spark.createDataFrame([("the law of the police",), ("a law",)], "text string")
    found = S.cosine_lesk(df, table)
    assert {tuple(r) for r in S.synset_edges(found, found).collect()} == {("my:law", "my:inSynset", "wn:law.2"), ("my:law", "my:inSynset", "wn:law.1")}
    assert S.cosine_lesk(df.limit(0), table).count() == S.cosine_lesk(df, table.limit(0)).count() == 0


def test_either_way_to_meet_glosses(spark, monkeypatch):
    """By shared words or by candidate senses, as fewer rows are met: the same rows."""
    table = [("law", "law.1", 1, "rules of the state"), ("law", "law.2", 2, "the police"), ("rules", "law.1", 1, "rules of the state"), ("bank", "bank.1", 1, None)]
    sentences = ["the law of the police", "a law rules the bank", "rules of rules"]
    df = spark.createDataFrame([(t,) for t in sentences], "text string")
    senses = spark.createDataFrame(table, "lemma string, sense string, ord int, gloss string")
    for sizes in ((0, 1), (1, 0)):
        monkeypatch.setattr(S, "_meetings", lambda *_, sizes=sizes: sizes)
        got = {(r["text"], r["lemma"]): (r["sense"], round(r["similarity"], 5)) for r in S.cosine_lesk(df, senses).collect()}
        assert got == {k: (s, round(x, 5)) for k, (s, x) in brute(sentences, table).items()}
