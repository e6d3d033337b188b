"""English stems by the published Snowball rules, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import word_tokens

# fixed values: the suffixes and words of the published algorithm
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_DONE_AFTER_PLURALS = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
_LONG_STARTS = "gener|commun|arsen"
_DOUBLES = "bb|dd|ff|gg|mm|nn|pp|rr|tt"
_STEP_2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
#: A vowel between others, the last no w, x or Y, or a vowel and another at the beginning: the end of a short word.
_SHORT = f"({_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$"


def _without(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _first(w: Column, rules: list[tuple[str, Callable[[Column], Column]]]) -> Column:
    """The rule of the first suffix that w ends in, longer ones standing first; else w."""
    out = None
    for suffix, change in rules:
        out = F.when(w.endswith(suffix), change(w)) if out is None else out.when(w.endswith(suffix), change(w))
    return out.otherwise(w)


def _replace(suffix: str, by: str, allowed: Callable[[Column], Column]) -> tuple[str, Callable[[Column], Column]]:
    return suffix, lambda w: F.when(allowed(w) & (F.length(w) - len(suffix) >= 0), F.concat(_without(w, len(suffix)), F.lit(by))).otherwise(w)


def _region(w: Column) -> Column:
    """Length up to the end of the first vowel and other letter behind it; the whole length if there is none."""
    found = F.length(F.regexp_extract(w, f"^.*?{_VOWEL}{_OTHER}", 0))
    return F.when(found > 0, found).otherwise(F.length(w))


def _steps(r1: Column, r2: Column) -> list[Callable[[Column], Column]]:
    def within(region: Column, suffix: str) -> Callable[[Column], Column]:
        return lambda w: F.length(w) - len(suffix) >= region

    def behind(suffix: str, pattern: str) -> Callable[[Column], Column]:
        return lambda w: _without(w, len(suffix)).rlike(pattern)

    def possessive(w: Column) -> Column:
        return _first(w, [("'s'", lambda x: _without(x, 3)), ("'s", lambda x: _without(x, 2)), ("'", lambda x: _without(x, 1))])

    def plural(w: Column) -> Column:
        ie = lambda x: F.when(F.length(x) > 4, _without(x, 2)).otherwise(_without(x, 1))
        same = lambda x: x
        return _first(w, [("sses", lambda x: _without(x, 2)), ("ied", ie), ("ies", ie), ("us", same), ("ss", same), ("s", lambda x: F.when(x.rlike(f"{_VOWEL}.+s$"), _without(x, 1)).otherwise(x))])

    def past(w: Column) -> Column:
        def cut(suffix: str) -> tuple[str, Callable[[Column], Column]]:
            def change(x: Column) -> Column:
                own = _without(x, len(suffix))
                short = own.rlike(_SHORT) & (F.length(own) <= r1)
                mended = F.when(own.rlike("(at|bl|iz)$"), F.concat(own, F.lit("e"))).when(own.rlike(f"({_DOUBLES})$"), _without(own, 1)).when(short, F.concat(own, F.lit("e"))).otherwise(own)
                return F.when(own.rlike(_VOWEL), mended).otherwise(x)

            return suffix, change

        return _first(w, [_replace("eedly", "ee", within(r1, "eedly")), cut("ingly"), cut("edly"), _replace("eed", "ee", within(r1, "eed")), cut("ing"), cut("ed")])

    def last_y(w: Column) -> Column:
        return F.when(w.rlike(f"^.+{_OTHER}[yY]$"), F.concat(_without(w, 1), F.lit("i"))).otherwise(w)

    def second(w: Column) -> Column:
        rules = []
        for suffix, by in _STEP_2:
            allowed = within(r1, suffix)
            if suffix == "ogi":
                allowed = lambda x, f=allowed: f(x) & behind("ogi", "l$")(x)
            if suffix == "li":
                allowed = lambda x, f=allowed: f(x) & behind("li", "[cdeghkmnrt]$")(x)
            rules.append(_replace(suffix, by, allowed))
        return _first(w, rules)

    def third(w: Column) -> Column:
        return _first(w, [_replace(s, by, within(r2 if s == "ative" else r1, s)) for s, by in _STEP_3])

    def fourth(w: Column) -> Column:
        return _first(w, [_replace(s, "", (lambda x: within(r2, "ion")(x) & behind("ion", "[st]$")(x)) if s == "ion" else within(r2, s)) for s in _STEP_4])

    def fifth(w: Column) -> Column:
        e = lambda x: within(r2, "e")(x) | (within(r1, "e")(x) & ~behind("e", _SHORT)(x))
        return _first(w, [_replace("e", "", e), _replace("l", "", lambda x: within(r2, "l")(x) & behind("l", "l$")(x))])

    stop = lambda step: lambda w: F.when(w.isin(_DONE_AFTER_PLURALS), w).otherwise(step(w))
    return [possessive, plural, *map(stop, (past, last_y, second, third, fourth, fifth))]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stem(word: Column) -> Column:
    """The stem of a word in lower case. Words of one or two letters are their own stems."""

    def regular(w: Column) -> Column:
        consonants = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "^'", ""), "^y", "Y"), "([aeiouy])y", "$1Y")

        def regions(x: Column) -> Column:
            start = F.regexp_extract(x, f"^({_LONG_STARTS})", 1)
            return _let(F.when(start != "", F.length(start)).otherwise(_region(x)), lambda r1: _let(r1 + _region(F.substring(x, r1 + 1, F.length(x))), lambda r2: walk(x, r1, r2)))

        def walk(x: Column, r1: Column, r2: Column) -> Column:
            out = F.array(x)
            for step in _steps(r1, r2):
                out = F.transform(out, step)
            return F.replace(F.element_at(out, 1), F.lit("Y"), F.lit("y"))

        return _let(consonants, regions)

    def one(w: Column) -> Column:
        known = F.create_map(*[F.lit(x) for pair in _EXCEPTIONS.items() for x in pair])
        return F.when(F.length(w) <= 2, w).otherwise(F.coalesce(F.try_element_at(known, w), regular(w)))

    return _let(word, one)


def stem_tokens(text: Column) -> Column:
    """The stems of a text's words: what a corpus with stemmed terms is registered by."""
    return F.transform(word_tokens(text), stem)
