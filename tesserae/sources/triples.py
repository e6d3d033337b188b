"""The triple table: vocabulary, the view of it that the driver's tables give, and how to load or write graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.scratch import small, written

# fixed values: the system predicates of the graph
DOC_ID = "my:docID"
HAS_IDX = "my:hasIDX"
HAS_SOURCE = "my:hasSource"
LABEL = "rdfs:label"
SUBCLASS = "rdfs:subClassOf"
TYPE = "rdf:type"
CAN_BE = "my:canBe"
IN_SYNSET = "my:inSynset"
DEFINITION = "dbo:abstract"
CONTENT = "my:content"

PLACES, CONTAINS, SUPPLIES = "{subj} places {obj}", "{subj} contains {obj}", "{subj} supplies {obj}"

#: predicate, subject, object, table: the graph as projections, in the SQL that Spark and DuckDB share.
_RULES = [
    (SUBCLASS, "'cust:' || c_custkey", "'nation:' || c_nationkey", "customer", ""),
    (SUBCLASS, "'supp:' || s_suppkey", "'nation:' || s_nationkey", "supplier", ""),
    (SUBCLASS, "'nation:' || n_nationkey", "'region:' || n_regionkey", "nation", ""),
    (SUBCLASS, "'part:' || p_partkey", "'name:' || p_name", "part", ""),
    (SUBCLASS, "'name:' || p_name", "'noun:' || {last}", "(SELECT DISTINCT p_name FROM part) names", ""),
    (TYPE, "'part:' || p_partkey", "'ptype:' || p_type", "part", ""),
    (IN_SYNSET, "'part:' || p_partkey", "'name:' || p_name", "part", ""),
    (PLACES, "'cust:' || o_custkey", "'order:' || o_orderkey", "orders", ""),
    (CONTAINS, "'order:' || l_orderkey", "'part:' || l_partkey", "lineitem", ""),
    (SUPPLIES, "'supp:' || l_suppkey", "'part:' || l_partkey", "lineitem", ""),
    (LABEL, "'cust:' || c_custkey", "c_name", "customer", ""),
    (LABEL, "'supp:' || s_suppkey", "s_name", "supplier", ""),
    (LABEL, "'nation:' || n_nationkey", "n_name", "nation", ""),
    (LABEL, "'region:' || r_regionkey", "r_name", "region", ""),
    (LABEL, "'part:' || p_partkey", "p_name", "part", ""),
    (CONTENT, "'_:doc' || doc_id", "text", "documents", ""),
    (DOC_ID, "'_:doc' || doc_id", "'myfile:' || source", "documents", ""),
    (HAS_SOURCE, "'part:' || p_partkey", "'_:doc' || (p_partkey % (SELECT count(*) FROM documents))", "part", ""),
    ("my:next", "'part:' || p_partkey", "'part:' || ((p_partkey * 7 + 3) % 64)", "part", "WHERE p_partkey < 64"),
]


def triples_sql(last_word: str) -> str:
    parts = [f"SELECT {s} AS s, '{p}' AS p, {o} AS o FROM {table} {where}" for p, s, o, table, where in _RULES]
    return "\nUNION ALL\n".join(parts).replace("{last}", last_word)


#: For the SQL checks: WITH triples AS (...).
DUCKDB_TRIPLES = triples_sql("split_part(p_name, ' ', -1)")


def from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o) of the star schema and the documents; a bag, as some facts repeat."""
    session = spark.newSession()
    for name in ("customer", "supplier", "nation", "region", "part", "orders", "lineitem", "documents"):
        session.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    parts = [f"SELECT {s} AS s, '{p}' AS p, {o} AS o FROM {table} {where}" for p, s, o, table, where in _RULES]
    union = "\nUNION ALL\n".join(parts).replace("{last}", "substring_index(p_name, ' ', -1)")
    return DataFrame(session.sql(union)._jdf, spark)


def distinct_triples(t: DataFrame) -> DataFrame:
    """Each of (s, p, o) once. Texts lie where they are, but for those of a subject that has several."""
    texts = t.filter(F.col("p") == CONTENT)
    several = small(written(texts.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("s").alias("several"))))
    same = F.col("s").eqNullSafe(F.col("several"))
    once, again = texts.join(several, same, "left_anti"), texts.join(several, same, "left_semi").distinct()
    return t.filter(~F.col("p").eqNullSafe(CONTENT)).distinct().unionByName(once).unionByName(again)


def is_relation(p: Column | str = "p") -> Column:
    """Predicates that are templates of open relations."""
    return (F.col(p) if isinstance(p, str) else p).contains("{obj}")


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """Edges (s, p, o) of a GraphML file."""
    schema = "_source string, _target string, data struct<_VALUE: string, _key: string>"
    rows = spark.read.format("xml").option("rowTag", "edge").option("useLegacyXMLParser", True).schema(schema).load(path)
    return rows.select(F.col("_source").alias("s"), F.col("data._VALUE").alias("p"), F.col("_target").alias("o"))


def collapse_parallel(edges: DataFrame, order: str = "ord") -> DataFrame:
    """A simple digraph: of the edges between two nodes the last one's predicate."""
    return edges.groupBy("s", "o").agg(F.max_by("p", F.struct(order, "p")).alias("p"))


def _escaped(name: str) -> Column:
    """A column's text as XML."""
    out = F.col(name)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def graphml_lines(edges: DataFrame) -> DataFrame:
    """Edge elements of a GraphML document, one a row, for a text sink; the frame around them is the caller's."""
    line = F.concat(F.lit('<edge source="'), _escaped("s"), F.lit('" target="'), _escaped("o"), F.lit('"><data key="r">'), _escaped("p"), F.lit("</data></edge>"))
    return edges.select(line.alias("value"))


# fixed values: the frame of a GraphML document whose edges have one property
_GRAPHML_HEAD = [
    '<?xml version="1.0" encoding="utf-8"?>',
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
    '<key id="r" for="edge" attr.name="r" attr.type="string"/>',
    '<graph edgedefault="directed">',
]
_GRAPHML_END = ["</graph>", "</graphml>"]


def graphml_document(edges: DataFrame) -> DataFrame:
    """(part, place, value): the lines of a GraphML document: its head, a node each, the edges, its end.

    Written as text in the order of part and place, the files one after the other are the document. Nodes and
    edges are in order of their lines.
    """
    spark = edges.sparkSession
    frame = [(part, i, x) for part, lines in ((0, _GRAPHML_HEAD), (3, _GRAPHML_END)) for i, x in enumerate(lines)]
    ids = edges.select(F.explode(F.array("s", "o")).alias("node")).distinct()
    nodes = ids.select(F.concat(F.lit('<node id="'), _escaped("node"), F.lit('"/>')).alias("value"))
    rows = lambda df, part: df.select(F.lit(part).alias("part"), F.lit(0).alias("place"), "value")
    return spark.createDataFrame(frame, "part int, place int, value string").unionByName(rows(nodes, 1)).unionByName(rows(graphml_lines(edges), 2))


def write_graphml(edges: DataFrame, path: str) -> None:
    """Write a GraphML document as text files whose names are in the order of the lines."""
    graphml_document(edges).orderBy("part", "place", "value").select("value").write.text(path)


def dot_lines(edges: DataFrame) -> DataFrame:
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(quote("s"), F.lit(" -> "), quote("o"), F.lit(" [label="), quote("p"), F.lit("];")).alias("value"))
