"""Text, identifier and label functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tesserae.sources import triples as V


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normal form; the JVM's SQL functions have none."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def join_lines(text: Column) -> Column:
    """Undo line breaks and hyphenation: one text with single blanks, without hyphens."""
    steps = [
        ("\r\n", "\n"),
        ("[\r\f\u000b]", "\n"),
        ("[-­֊᠆﹣－]\n+", ""),
        ("[‐‑‧⁃]\n+", " "),
        ("([^\n.])\n+([^\n])", "$1 $2"),
        ("[ \t]+", " "),
        (" - ", " "),
        ("- *", ""),
    ]
    for pattern, new in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(new))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalise(text: Column) -> Column:
    return join_lines(nfkc(text))


def readable_key(key: Column) -> Column:
    """'my:someName_ofThing' -> 'Some Name of Thing': last part of a key, split at capitals, initials kept together."""
    tail = F.substring_index(F.regexp_replace(key, "[_-]", " "), ":", -1)
    tail = F.concat(F.upper(F.substring(tail, 1, 1)), F.substring(tail, F.lit(2), F.length(tail)))
    words = F.regexp_extract_all(tail, F.lit("([A-Z][^A-Z]*)"), F.lit(1))
    # a capital that stands alone goes to what is before it
    glued = F.aggregate(
        words,
        F.lit(""),
        lambda text, w: F.when(text == "", w).when(F.length(w) == 1, F.concat(text, w)).otherwise(F.concat(text, F.lit(" "), w)),
    )
    return F.coalesce(F.trim(F.regexp_replace(glued, " +", " ")), F.lit(""))


def urify(text: Column) -> Column:
    return F.replace(F.trim(F.lower(text)), F.lit(" "), F.lit("_"))


def is_url(text: Column) -> Column:
    """Relative paths, anything that begins like a scheme or prefix, and addresses without one."""
    x = F.trim(F.lower(text))
    return x.startswith("../") | x.startswith("./") | x.rlike(r"^\w+:") | x.rlike(r"^//[a-z0-9$-_@.&+!*(),%]")


def is_html(text: Column) -> Column:
    """Texts that begin with a tag."""
    return text.rlike("^<[^>]+>")


def url_tail(url: Column) -> Column:
    """The last part of an address's path, or what follows its last #; other strings stay."""
    last = F.regexp_extract(url, r"(?:\w+:)?//[^/]+(?:/.+)*(/.+)", 1)
    return F.substring_index(F.when(last == "", url).otherwise(F.replace(last, F.lit("/"), F.lit(""))), "#", -1)


def spaced(text: Column) -> Column:
    """camelCase and under_scores as lower-case words."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z0-9]+)", "$1 $2"), "[_ ]+", " "))


def html_escape(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def titlefy(text: Column) -> Column:
    """The first character in upper case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def format_percentage(share: Column, decimals: int = 2) -> Column:
    """A share of 1 in per cent; decimals that are all zero are left out."""
    return F.concat(F.replace(F.format_string(f"%.{decimals}f", share * 100), F.lit("." + "0" * decimals), F.lit("")), F.lit("%"))


def escape_regexp(text: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def is_int(text: Column) -> Column:
    """Whether a string is written as a whole number."""
    return F.trim(text).rlike(r"^[+-]?[0-9]+(\.0*)?$")


def clip(value: Column, least: float, most: float) -> Column:
    return F.when(value < least, F.lit(least)).when(value > most, F.lit(most)).otherwise(value)


def path_join(parts: Column, separator: str = "/") -> Column:
    """Parts joined by a separator that stands once between two, empty ones left out."""
    quoted = "".join(f"[{c}]" for c in separator)
    last = F.size(parts) - 1
    inner = F.transform(parts, lambda x, i: F.when(i > 0, F.regexp_replace(x, f"^{quoted}", "")).otherwise(x))
    ends = F.transform(inner, lambda x, i: F.when(i < last, F.regexp_replace(x, f"{quoted}$", "")).otherwise(x))
    return F.array_join(F.filter(ends, lambda x: x != ""), separator)


def single_line(text: Column) -> Column:
    return F.trim(F.translate(text, "\n", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-zA-Z0-9]"), lambda x: x != "")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


# fixed values: letters whose capital is one character, though upper() writes two
_ONE = "ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ"
_CAPITAL = "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ"


def capital(letter: Column) -> Column:
    """The capital of one character as one character; a character that has none, such as a ligature, stays."""
    one = F.translate(letter, _ONE, _CAPITAL)
    return F.when(F.length(F.upper(one)) == 1, F.upper(one)).otherwise(one)


def sentify(text: Column) -> Column:
    """Split at ' . ', capitalise each sentence, end each with a full stop."""
    each = F.filter(F.split(text, r" \. "), lambda x: x != "")
    done = F.transform(
        each,
        lambda x: F.concat(capital(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)), F.when(x.endswith("."), "").otherwise(".")),
    )
    return F.array_join(done, " ")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; two empty strings are equal."""
    return F.coalesce(F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def similar(a: Column, b: Column, threshold: float = 0.3) -> Column:
    return edit_distance(a, b) < threshold


# fixed values: the prefixes that clients abbreviate
PREFIXES = {
    "my": "http://my_graph.co/",
    "myfile": "http://my_graph.co/files/",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "prov": "http://www.w3.org/ns/prov#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "dct": "http://purl.org/dc/terms/",
    "dc": "http://purl.org/dc/terms/",
    "dce": "http://purl.org/dc/elements/1.1/",
    "owl": "http://www.w3.org/2002/07/owl#",
    "dbo": "http://dbpedia.org/ontology/",
    "dbp": "http://dbpedia.org/property/",
    "dbr": "http://dbpedia.org/resource/",
    "ns1": "http://purl.org/linguistics/gold/",
    "vrank": "http://purl.org/voc/vrank#",
    "wn": "http://wordnet.princeton.edu/",
    "brusselsreg_en_1215-20212": "http://my_graph.co/brusselsreg_en_1215-20212/",
    "rome_i_en": "http://my_graph.co/rome_i_en/",
    "rome_ii_en": "http://my_graph.co/rome_ii_en/",
}


def expand_prefix(uri: Column) -> Column:
    """'rdfs:label' -> its full address; other strings stay."""
    known = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    prefix = F.substring_index(uri, ":", 1)
    full = F.concat(known[prefix], F.substring(uri, F.length(prefix) + 2, F.length(uri)))
    return F.when(uri == "@type", F.lit(PREFIXES["rdf"] + "type")).when(uri.contains(":"), F.coalesce(full, uri)).otherwise(uri)


def contract_prefix(uri: Column) -> Column:
    """Known addresses in a string as prefixes, those with long names first."""
    for name, address in sorted(PREFIXES.items(), key=lambda x: -len(x[0])):
        uri = F.replace(uri, F.lit(address), F.lit(name + ":"))
    return uri


# fixed values: sentences for the system predicates
TEMPLATES = {
    V.DOC_ID: "{subj} has been found in document {obj}",
    V.HAS_IDX: "{subj} starts at offset {obj} of its document",
    V.HAS_SOURCE: "{subj} is in the sentence {obj}",
    V.LABEL: "{subj} is called {obj}",
    V.SUBCLASS: "{subj} is {obj}",
    V.TYPE: "{subj} is {obj}",
    V.CAN_BE: "{subj} can be {obj}",
    V.IN_SYNSET: "{subj} is the same of {obj}",
    V.DEFINITION: "{subj} is: {obj}",
}


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _word(x: Column) -> Column:
    """What a sentence shows of a name; null for those that are hidden."""
    words = F.split(F.substring(x, F.lit(4), F.length(x)), r"\.")
    lexical = readable_key(F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), " "))
    return F.when(~x.startswith("my:"), F.when(x.startswith("wn:"), lexical).otherwise(x))


def _dressed(x: Column, predicate: Column) -> Column:
    """Without full stops at its ends, in quotation marks where the predicate asks for them."""
    bare = F.btrim(x, F.lit("."))
    return F.when(predicate.isin(V.DOC_ID, V.HAS_IDX, V.HAS_SOURCE, V.LABEL), F.concat(F.lit("«"), bare, F.lit("»"))).otherwise(bare)


def _slot(values: Column, predicate: Column) -> Column:
    shown = F.array_distinct(F.filter(F.transform(values, _word), lambda x: x != ""))
    outer = _let(shown, lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: y.contains(x) & (y != x))))
    dressed = F.transform(outer, lambda x, i: _let(_dressed(x, predicate), lambda y: F.struct(F.length(y).alias("n"), i.alias("i"), y.alias("x"))))
    ordered = F.transform(F.array_sort(dressed), lambda z: z["x"])
    more = lambda all_: F.when(F.size(all_) > 1, F.concat(F.lit(" (or: "), F.array_join(F.slice(all_, F.lit(2), F.greatest(F.size(all_), F.lit(1))), ", "), F.lit(")"))).otherwise("")
    return _let(ordered, lambda all_: F.when(F.size(all_) == 0, F.lit("")).otherwise(F.concat(F.get(all_, F.lit(0)), more(all_))))


def _filled(p: Column, subj: Column, obj: Column) -> Column:
    template = F.coalesce(F.create_map(*[F.lit(x) for pair in TEMPLATES.items() for x in pair])[p], p)
    text = F.when(template.contains("{subj}"), F.replace(template, F.lit("{subj}"), subj)).otherwise(F.concat_ws(" ", subj, template))
    text = F.when(text.contains("{obj}"), F.replace(text, F.lit("{obj}"), obj)).otherwise(F.concat_ws(" ", text, obj))
    for old, new in (("(be)", "is"),):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(F.regexp_replace(text, " +([,;.])", "$1"), " +/ +", "/")
    for old, new in ((" )", ")"), ("( ", "(")):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, "^: ", "")
    for old, new in ((" : ", ": "), ("::", ":"), (".,", ";")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.when((subj == "") | (obj == ""), F.lit("")).otherwise(text)


def sentence(s: Column, p: Column, o: Column) -> Column:
    """A triple as a sentence; s and o are arrays of alternatives. Empty if a side has nothing to show."""
    ends = F.struct(_slot(s, p).alias("s"), _slot(o, p).alias("o"))
    return _let(ends, lambda e: _filled(p, e["s"], e["o"]))


def plain_sentence(s: Column, p: Column, o: Column) -> Column:
    """sentence() of a triple whose ends have no alternatives: s and o are strings. Most triples are, and it takes much less."""
    subj, obj = (F.coalesce(F.when(_word(x) != "", _dressed(_word(x), p)), F.lit("")) for x in (s, o))
    return _filled(p, subj, obj)
