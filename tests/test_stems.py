import random
import re

import pytest
from pyspark.sql import functions as F

from tesserae.functions import stems
from tesserae.operators import corpus as K

#: Words and stems as published with the algorithm's description.
KNOWN = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort
conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave
knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick
knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock
knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot running run flies fli dies die ties tie cries cri happily happili
generously generous generate generat skies sky dying die national nation relational relat conditional condit rational ration hopping hop hoping hope agreed agre
plastered plaster troubled troubl sized size falling fall hissing hiss filing file cry cri by by say say gas gas this this gaps gap kiwis kiwi beautiful beauti
inning inning succeed succeed news news early earli communism communism activate activ adjustable adjust replacement replac adoption adopt feudalism feudal formality formal""".split()


def plain(word):
    """The rules again, in a loop over a string."""
    if len(word) <= 2:
        return word
    if word in stems._EXCEPTIONS:
        return stems._EXCEPTIONS[word]
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", re.sub("^'", "", word)))
    region = lambda x: m.end() if (m := re.search("[aeiouy][^aeiouy]", x)) else len(x)
    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else region(w)
    r2 = r1 + region(w[r1:])
    short = lambda x: bool(re.search("([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", x))
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and re.search("[aeiouy].+s$", w):
        w = w[:-1]
    if w in stems._DONE_AFTER_PLURALS:
        return w.replace("Y", "y")
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            own = w[: -len(s)]
            if s.startswith("eed"):
                w = own + "ee" if len(own) >= r1 else w
            elif re.search("[aeiouy]", own):
                if own.endswith(("at", "bl", "iz")):
                    w = own + "e"
                elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", own):
                    w = own[:-1]
                else:
                    w = own + "e" if short(own) and len(own) <= r1 else own
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for rules, number in ((stems._STEP_2, 2), (stems._STEP_3, 3), ([(s, "") for s in stems._STEP_4], 4)):
        for s, by in rules:
            if w.endswith(s):
                own = w[: -len(s)]
                limit = r2 if number == 4 or s == "ative" else r1
                fine = len(own) >= limit
                fine &= s != "ogi" or own.endswith("l")
                fine &= number != 2 or s != "li" or own[-1:] in tuple("cdeghkmnrt")
                fine &= number != 4 or s != "ion" or own[-1:] in ("s", "t")
                w = own + by if fine else w
                break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[:-1].endswith("l"):
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(spark, words):
    df = spark.createDataFrame([(x,) for x in words], "word string").repartition(4)
    return {r["word"]: r["s"] for r in df.select("word", stems.stem(F.col("word")).alias("s")).collect()}


def test_published_stems(spark):
    want = dict(zip(KNOWN[::2], KNOWN[1::2], strict=True))
    assert stemmed(spark, want) == want
    assert {x: plain(x) for x in want} == want


@pytest.mark.parametrize("seed", [0, 1])
def test_made_words_against_brute_force(spark, seed):
    rng = random.Random(seed)
    ends = [s for s, _ in stems._STEP_2 + stems._STEP_3] + stems._STEP_4 + ["", "s", "es", "ies", "ied", "sses", "us", "eed", "eedly", "ing", "ingly", "ed", "edly", "y", "e", "ll", "'s", "'", "'s'", "ative", "logi", "tli"]
    syllable = lambda: rng.choice(["b", "c", "tt", "st", "y", "gener", "w", "l", "r", "", "q", "n"]) + rng.choice("aeiouy") + rng.choice(["t", "n", "w", "x", "y", "l", "", "bl", "iz", "pp"])
    words = {"".join(syllable() for _ in range(rng.randrange(0, 4))) + rng.choice(ends) + rng.choice(["", "", rng.choice(ends)]) for _ in range(1500)} | {"", "a", "'", "été", "'yes"}
    assert stemmed(spark, words) == {w: plain(w) for w in words}


def test_null(spark):
    assert spark.createDataFrame([(None,)], "word string").select(stems.stem(F.col("word"))).first()[0] is None


def test_stemmed_corpus(spark, tmp_path):
    texts = spark.createDataFrame([(1, "the courts applied a law"), (2, "contracting parties"), (3, "nothing")], "doc_id long, text string")
    corpus = K.register(f"file://{tmp_path}/c", texts, tokens=stems.stem_tokens)
    asked = spark.createDataFrame([(1, "applying laws"), (2, "a party contracted")], "qid int, question string")
    best = {r["qid"]: r["key"] for r in K.search(corpus, asked, k=1, tokens=stems.stem_tokens).collect()}
    assert best == {1: 1, 2: 2}
