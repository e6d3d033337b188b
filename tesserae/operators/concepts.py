"""Concepts, predicates and facts of parsed sentences.

tokens: (sent_id, i, idx, text, lemma, pos, dep, head, chunk). i numbers a sentence's tokens, idx is the first character;
the root is its own head; chunk names the noun chunk of a token, if any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators import extract
from tesserae.operators.extract import ancestors, core_pairs
from tesserae.sources.scratch import written

# fixed values: dependencies of subjects, objects, and of what composite concepts take in
SUBJECT = "subj|expl"
OBJECT = "obj|obl|intj|attr|oprd|acomp|xcomp"
MODIFIER = "amod"
EXTENDED = "det|punct|fixed|flat|compound|subtok|case|dep|mod|nn|meta|neg|poss|appos"
GROUP = f"{SUBJECT}|{OBJECT}|prep|{EXTENDED}"
CONCEPT_ENDS = ("prep", "punct")
PREDICATE_ENDS = ("cc", "prep", "punct")
NO_LEMMA = ("DET", "PUNCT", "CCONJ")
PRONOUN = "-PRON-"


def resolved_dependencies(tokens: DataFrame) -> DataFrame:
    """Append rdep: the dependency, for a conjunct that of its nearest ancestor which isn't one."""
    heads = tokens.filter("dep <> 'conj'").select("sent_id", F.col("i").alias("ancestor"), F.col("dep").alias("own"))
    # by the heads of conjuncts alone one climbs to the first that isn't one, and no further
    above = ancestors(tokens.filter("not coalesce(dep <> 'conj', false)"))
    nearest = above.join(heads, ["sent_id", "ancestor"]).groupBy("sent_id", "i").agg(F.min_by("own", "distance").alias("own"))
    return tokens.join(nearest, ["sent_id", "i"], "left").withColumn("rdep", F.when(F.col("dep") == "conj", F.col("own")).otherwise(F.col("dep"))).drop("own")


def token_lemma(keep_verbs: bool = False) -> Column:
    """The lemma, or for verbs the text itself if these are to be kept."""
    return F.when(F.col("pos") == "VERB", F.col("text")).otherwise(F.col("lemma")) if keep_verbs else F.col("lemma")


def is_core_concept() -> Column:
    """Whether a token (with rdep) is a subject or object, or a noun that is the root."""
    return F.coalesce(F.col("rdep").rlike(f"{SUBJECT}|{OBJECT}"), F.lit(False)) | ((F.col("rdep") == "ROOT") & (F.col("pos") == "NOUN"))


def has_dependency(span: Column, dep: str) -> Column:
    """Whether a span of tokens (structs) has one of this dependency: is_passive for auxpass."""
    return F.exists(span, lambda t: t["rdep"] == dep)


def has_part_of_speech(span: Column, pos: str) -> Column:
    """Whether a span of tokens (structs) has one of this part of speech: is_verbal for VERB."""
    return F.exists(span, lambda t: t["pos"] == pos)


def span_text(span: Column) -> Column:
    """The lower-cased words of a span of tokens in order."""
    return F.lower(F.replace(F.array_join(F.transform(span, lambda t: t["text"]), " "), F.lit(" - "), F.lit("")))


def span_lemma(span: Column) -> Column:
    """The lower-cased lemmas of a span without determiners, punctuation, conjunctions and pronouns."""
    kept = F.filter(span, lambda t: ~t["pos"].isin(*NO_LEMMA) & (t["lemma"] != PRONOUN))
    return F.lower(F.array_join(F.transform(kept, lambda t: t["lemma"]), " "))


def _token() -> Column:
    return F.struct("i", "idx", "text", "lemma", "pos", "rdep")


def _ends(noise: tuple[str, ...]) -> list[Column]:
    """lo, hi: the first and the last token that isn't noise, as in trim_span(), where a span's tokens meet anyway."""
    own = F.when(~F.col("rdep").isin(*noise), F.col("i"))
    return [F.min(own).alias("lo"), F.max(own).alias("hi")]



def descendants(tokens: DataFrame, cores: DataFrame) -> DataFrame:
    """(sent_id, core, i, amod, extended, group): the tokens below each core, and by which dependencies alone each is reached."""
    names = ("amod", "extended", "group")
    kinds = [(F.col("dep") != "conj") & F.col("rdep").rlike(p) for p in (MODIFIER, EXTENDED, GROUP)]
    below = extract.descendants(tokens, cores, kinds)
    below = below.select("sent_id", "core", "i", *[(F.getbit("flags", F.lit(k)) == 1).alias(n) for k, n in enumerate(names)])
    return cores.select("sent_id", F.col("i").alias("core"), "i", *[F.lit(True).alias(n) for n in names]).unionByName(below)


def composite_concepts(tokens: DataFrame, cores: DataFrame) -> DataFrame:
    """(sent_id, core, rank, text, lemma, idx, span, chain) of up to six spans around each core, from small to large.

    They are the core, with its adjectives, its noun chunk, with its multi-word parts and modifiers, with its
    prepositional group, and its whole subtree; without prepositions and punctuation at the ends, each once. chain
    has the smaller concepts of the core from large to small; the two smallest have the smallest alone.
    """
    below = descendants(tokens, cores)
    kinds = F.array(F.when(F.col("i") == F.col("core"), 0), F.when(F.col("amod"), 1), F.when(F.col("extended"), 3), F.when(F.col("group"), 4), F.lit(5))
    each = below.select("sent_id", "core", "i", F.explode(F.array_compact(kinds)).alias("kind"))
    own = cores.select("sent_id", F.col("i").alias("core")).join(tokens.select("sent_id", F.col("i").alias("core"), "chunk"), ["sent_id", "core"])
    chunk = own.join(tokens.select("sent_id", "chunk", "i"), ["sent_id", "chunk"]).select("sent_id", "core", "i", F.lit(2).alias("kind"))
    rows = each.unionByName(chunk).join(tokens.select("sent_id", "i", "idx", "text", "lemma", "pos", "rdep"), ["sent_id", "i"])
    spans = rows.groupBy("sent_id", "core", "kind").agg(*_ends(CONCEPT_ENDS), F.array_sort(F.collect_list(_token())).alias("tokens")).filter("lo is not null")
    spans = spans.withColumn("tokens", F.filter("tokens", lambda t: t["i"].between(F.col("lo"), F.col("hi"))))
    spans = spans.select("sent_id", "core", "kind", F.transform("tokens", lambda t: t["i"]).alias("span"), span_text(F.col("tokens")).alias("text"), span_lemma(F.col("tokens")).alias("lemma"), F.transform("tokens", lambda t: t["idx"]).alias("idx"))
    once = spans.groupBy("sent_id", "core", "span").agg(F.min_by(F.struct("kind", "text", "lemma", "idx"), "kind").alias("c")).select("sent_id", "core", "span", "c.*")
    order = Window.partitionBy("sent_id", "core").orderBy(F.size("span"), F.length("text"), "kind")  # six rows at most
    smaller = F.collect_list("text").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranked = once.withColumn("rank", F.row_number().over(order) - 1).withColumn("smaller", smaller)
    ranked = ranked.withColumn("chain", F.when(F.col("rank") > 1, F.reverse("smaller")).when(F.col("rank") == 1, F.col("smaller")).otherwise(F.array("text")))
    return ranked.select("sent_id", "core", "rank", "text", "lemma", "idx", "span", "chain")


def concept_list(concepts: DataFrame) -> DataFrame:
    """The first concept of each text and place in a sentence, by core and size."""
    columns = [c for c in concepts.columns if c not in ("sent_id", "text", "idx")]
    first = concepts.groupBy("sent_id", "text", "idx").agg(F.min_by(F.struct(*columns), F.struct("core", "rank")).alias("c"))
    return first.select("sent_id", "text", "idx", "c.*")


def grammatical_connections(tokens: DataFrame, cores: DataFrame) -> DataFrame:
    """(sent_id, subj, obj, i, on_path): the predicate's tokens for each pair of cores that no third core parts.

    The path between two cores leads through their closest common ancestor. What hangs on it, and not on a core of
    the pair, belongs to the predicate too. The object is the core that alone is one by its dependency, else the
    subject is, else the first stands first.
    """
    own = written(ancestors(tokens).unionByName(tokens.select("sent_id", "i", F.col("i").alias("ancestor"), F.lit(0).alias("distance"))))
    ends = written(own.join(cores.select("sent_id", "i"), ["sent_id", "i"], "left_semi"))
    side = lambda c: ends.select("sent_id", F.col("i").alias(c), F.col("ancestor").alias("meet"), F.col("distance").alias(f"d{c}"))
    met = core_pairs(cores).join(side("a"), ["sent_id", "a"]).join(side("b"), ["sent_id", "b", "meet"])
    best = met.groupBy("sent_id", "a", "b").agg(F.min_by(F.struct("da", "db"), F.struct(F.col("da") + F.col("db"), "meet")).alias("m")).select("sent_id", "a", "b", "m.*")
    best = written(best)
    legs = [best.join(ends.withColumnRenamed("i", c), ["sent_id", c]).filter(F.col("distance") <= F.col(f"d{c}")).select("sent_id", "a", "b", F.col("ancestor").alias("i")) for c in "ab"]
    path = legs[0].unionByName(legs[1]).distinct().filter("i <> a and i <> b")
    path = path.join(cores.select("sent_id", "i", F.lit(True).alias("third")), ["sent_id", "i"], "left")
    crossed = path.filter("third").select("sent_id", "a", "b").distinct()
    path = written(path.join(crossed, ["sent_id", "a", "b"], "left_anti").select("sent_id", "a", "b", "i"))
    marks = path.withColumn("mark", F.lit(True)).unionByName(path.select("sent_id", "a", "b").distinct().select("sent_id", "a", "b", F.explode(F.array("a", "b")).alias("i"), F.lit(False).alias("mark")))
    near = marks.withColumnRenamed("i", "ancestor").join(own, ["sent_id", "ancestor"]).groupBy("sent_id", "a", "b", "i")
    inside = near.agg(F.min_by("mark", "distance").alias("inside"), F.min("distance").alias("distance")).filter("inside")
    roles = tokens.select("sent_id", F.col("i").alias("c"), F.col("rdep").rlike(OBJECT).alias("o"), F.col("rdep").rlike(SUBJECT).alias("s"))
    ends = [roles.select("sent_id", F.col("c").alias(x), F.col("o").alias(f"o{x}"), F.col("s").alias(f"s{x}")) for x in "ab"]
    turned = F.when(F.col("oa") != F.col("ob"), F.col("oa")).when(F.col("sa") != F.col("sb"), F.col("sb")).otherwise(F.lit(False))
    out = inside.join(ends[0], ["sent_id", "a"]).join(ends[1], ["sent_id", "b"]).withColumn("turned", turned)
    pick = lambda x, y: F.when(F.col("turned"), F.col(x)).otherwise(F.col(y))
    return out.select("sent_id", pick("b", "a").alias("subj"), pick("a", "b").alias("obj"), "i", (F.col("distance") == 0).alias("on_path"))


def predicate_templates(tokens: DataFrame, connections: DataFrame) -> DataFrame:
    """(sent_id, subj, obj, text, lemma, core_text, core_lemma, span, passive, verbal) of each connection.

    text and lemma have {subj} and {obj} in the places of the cores, and end without conjunctions, prepositions and
    punctuation beyond these.
    """
    key = ["sent_id", "subj", "obj"]
    connections = written(connections)
    cores = connections.select(*key).distinct().select(*key, F.explode(F.array("subj", "obj")).alias("i"), F.lit(None).cast("boolean").alias("on_path"))
    rows = connections.select(*key, "i", "on_path").unionByName(cores).join(tokens.select("sent_id", "i", "idx", "text", "lemma", "pos", "rdep"), ["sent_id", "i"])
    words = lambda on: F.array_sort(F.collect_list(F.when(on, _token())))
    joined = rows.groupBy(*key).agg(*_ends(PREDICATE_ENDS), words(F.col("on_path").isNotNull()).alias("p"), words(F.col("on_path")).alias("c"))
    joined = joined.filter(F.size("p") > 0)
    left, right = F.least("subj", "obj"), F.greatest("subj", "obj")
    inside = F.filter("p", lambda t: t["i"].between(F.col("lo"), F.col("hi")) & (t["i"] != F.col("subj")) & (t["i"] != F.col("obj")))
    part = lambda t: F.when(t["i"] < left, 0).when(t["i"] < right, 1).otherwise(2)
    joined = joined.withColumn("own", inside)
    some = lambda k: F.filter("own", lambda t: part(t) == k)
    joined = joined.withColumns({f"t{k}": some(k) for k in range(3)})
    first = F.when(F.col("subj") < F.col("obj"), F.lit("{subj}")).otherwise(F.lit("{obj}"))
    second = F.when(F.col("subj") < F.col("obj"), F.lit("{obj}")).otherwise(F.lit("{subj}"))

    def template(words) -> Column:
        some = [F.when(F.size(f"t{k}") > 0, words(F.col(f"t{k}"))) for k in range(3)]
        return F.concat_ws(" ", some[0], first, some[1], second, some[2])

    return joined.select(
        *key, template(span_text).alias("text"), template(span_lemma).alias("lemma"), span_text(F.col("c")).alias("core_text"), span_lemma(F.col("c")).alias("core_lemma"),
        F.transform("p", lambda t: t["i"]).alias("span"), has_dependency(F.col("p"), "auxpass").alias("passive"), has_part_of_speech(F.col("p"), "VERB").alias("verbal"),
    )


def couple_list(concepts: DataFrame, templates: DataFrame) -> DataFrame:
    """Concepts beside the predicates of their cores, unless they share a token; dependency tells the side.

    at_core: the concept is the core alone.
    """
    sides = F.explode(F.array(F.struct(F.lit("subj").alias("dependency"), F.col("subj").alias("core")), F.struct(F.lit("obj").alias("dependency"), F.col("obj").alias("core")))).alias("s")
    predicates = templates.select("sent_id", sides, F.col("text").alias("predicate"), F.col("lemma").alias("predicate_lemma"), F.col("span").alias("predicate_span"))
    predicates = predicates.select("sent_id", "s.core", "s.dependency", "predicate", "predicate_lemma", "predicate_span")
    joined = concepts.join(predicates, ["sent_id", "core"]).filter(~F.arrays_overlap("span", "predicate_span"))
    return joined.withColumn("at_core", (F.size("span") == 1) & (F.element_at("span", 1) == F.col("core")))


def concept_uri(lemma: Column) -> Column:
    return F.concat(F.lit("my:"), F.regexp_replace(F.replace(lemma, F.lit(" "), F.lit("_")), r"\s", ""))


def is_valid_syntagm(text: Column, most: int | None) -> Column:
    """Whether a phrase has fewer spaces than `most` (None or 0: any number)."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) < most if most else F.lit(True)


def fact_edges(couples: DataFrame, sentences: DataFrame, senses: DataFrame | None = None, annotations: DataFrame | None = None) -> DataFrame:
    """(s, p, o) of the longest concept of each core on either side of a predicate, with labels, sources and subclasses.

    couples as couple_list() gives them; sentences: (sent_id, doc, content). A sentence's source is a node of its own.
    senses (sent_id, lemma, sense) put concepts and predicates into synsets; annotations (sent_id, s, p, o) are what is
    known of a sentence besides, and come with those that say something.
    """
    size = F.struct(F.size("span"), F.length("text"), -F.col("rank"))
    longest = couples.groupBy("sent_id", "predicate", "predicate_lemma", "predicate_span", "dependency", "core").agg(F.max_by(F.struct("text", "lemma", "chain"), size).alias("c"))
    longest = written(longest)
    key = ["sent_id", "predicate", "predicate_lemma", "predicate_span"]
    side = lambda d, n: longest.filter(F.col("dependency") == d).select(*key, F.col("c").alias(n))
    facts = written(side("subj", "s").join(side("obj", "o"), key))
    source = F.concat(F.lit("_:source"), F.col("sent_id"))
    each = facts.select("sent_id", F.explode(F.array(*[F.struct(F.col(x)["lemma"].alias("lemma"), F.col(x)["text"].alias("text"), F.col(x)["chain"].alias("chain")) for x in "so"], F.struct(F.col("predicate_lemma").alias("lemma"), F.col("predicate").alias("text"), F.lit(None).cast("array<string>").alias("chain")))).alias("n")).select("sent_id", "n.*")
    edge = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    used = sentences.join(facts.select("sent_id").distinct(), "sent_id", "left_semi")
    text_uri = lambda c: concept_uri(c)
    steps = each.filter("size(chain) > 1").select(F.explode(F.arrays_zip(F.slice("chain", 1, F.size("chain") - 1).alias("a"), F.slice("chain", 2, F.size("chain")).alias("b"))).alias("x"))
    out = facts.select(concept_uri(F.col("s.lemma")).alias("s"), concept_uri(F.col("predicate_lemma")).alias("p"), concept_uri(F.col("o.lemma")).alias("o"))
    for more in (
        edge(each, concept_uri(F.col("lemma")), "rdfs:label", F.col("text")),
        edge(each, concept_uri(F.col("lemma")), "my:hasSource", source),
        edge(used, source, "my:content", F.col("content")),
        edge(used, source, "my:docID", F.concat(F.lit("myfile:"), F.col("doc").cast("string"))),
        edge(steps, text_uri(F.col("x.a")), "rdfs:subClassOf", text_uri(F.col("x.b"))).filter("s <> o"),
    ):
        out = out.unionByName(more)
    if senses is not None:
        tagged = each.select("sent_id", "lemma").distinct().join(senses, ["sent_id", "lemma"])
        out = out.unionByName(edge(tagged, concept_uri(F.col("lemma")), "my:inSynset", F.concat(F.lit("wn:"), F.col("sense"))))
    if annotations is not None:
        out = out.unionByName(annotations.join(used.select("sent_id").distinct(), "sent_id", "left_semi").select("s", "p", "o"))
    return out.distinct()
