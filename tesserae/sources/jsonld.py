"""JSON and JSON-LD documents as triples, texts and values: VARIANT columns, opened a level at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tesserae.functions import text as X
from tesserae.sources import triples as V
from tesserae.sources.scratch import written


def _reading() -> WindowSpec:
    """The order in which a document is read."""
    return Window.partitionBy("_doc").orderBy("path")


def _items(v: Column) -> Column:
    """The elements of an array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _fields(v: Column) -> Column:
    """Entries (key, value) of an object in order of the keys; null for anything else."""
    own = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.array_sort(own, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def _member(v: Column, name: str) -> Column:
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(name))


def _plain(v: Column) -> Column:
    """A string as it is, anything else as JSON."""
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v), F.lit("null"))


def _parsed(documents: DataFrame, key: str, document: str) -> DataFrame:
    """(_doc, key, path, v): values at the top of the documents; an array's elements are each at the top. What isn't JSON
    gives no rows."""
    rows = documents.select(F.col(key).alias("key"), F.try_parse_json(F.col(document)).alias("v")).filter("v is not null")
    top = rows.withColumn("_doc", F.monotonically_increasing_id()).select("_doc", "key", F.posexplode(F.coalesce(_items(F.col("v")), F.array("v"))).alias("i", "v"))
    return written(top.select("_doc", "key", F.array("i").alias("path"), "v"))


def _levels(documents: DataFrame, key: str, document: str) -> list[DataFrame]:
    """(_doc, key, path, parent, p, id, text, v) of each level: what stands under key p of the object at path parent.

    v is an object or an array that is still to be opened, id an object's own id, text a literal. Paths are the places
    of keys and elements on the way, so that their order is that of reading. There is one written table a level.
    """
    top = _parsed(documents, key, document).filter(_fields(F.col("v")).isNotNull())
    level = top.select("_doc", "key", "path", F.lit(None).cast("array<int>").alias("parent"), F.lit(None).cast("string").alias("p"), _member(F.col("v"), "@id").alias("_id"), "v")
    level = written(level.select("_doc", "key", "path", "parent", "p", F.when(F.col("_id").isNotNull(), _plain(F.col("_id"))).alias("id"), F.lit(None).cast("string").alias("text"), "v"))
    out = []
    while not level.isEmpty():
        out.append(level)
        inner = level.filter("v is not null")
        entries = inner.filter(_items(F.col("v")).isNull()).select("_doc", "key", F.col("path").alias("parent"), F.posexplode(_fields(F.col("v"))).alias("i", "e"))
        entries = entries.select("_doc", "key", F.concat("parent", F.array("i")).alias("path"), "parent", F.col("e.key").alias("p"), F.col("e.value").alias("v")).filter("p <> '@id'")
        # an array stands for its elements, arrays in arrays too
        single = entries.select("_doc", "key", "path", "parent", "p", F.posexplode(F.coalesce(_items(F.col("v")), F.array("v"))).alias("i", "v"))
        again = inner.filter(_items(F.col("v")).isNotNull()).select("_doc", "key", "path", "parent", "p", F.posexplode(_items(F.col("v"))).alias("i", "v"))
        found = single.unionByName(again).withColumn("path", F.concat("path", F.array("i")))
        value, own = _member(F.col("v"), "@value"), _member(F.col("v"), "@id")
        is_object, is_array = _fields(F.col("v")).isNotNull(), _items(F.col("v")).isNotNull()
        text = F.when(is_object, F.when(value.isNotNull(), _plain(value))).when(~is_array, _plain(F.col("v")))
        found = found.withColumn("text", text).withColumn("id", F.when(F.col("text").isNull() & own.isNotNull(), _plain(own)))
        level = written(found.select("_doc", "key", "path", "parent", "p", "id", "text", F.when(F.col("text").isNull(), F.col("v")).alias("v")))
    return out


def jsonld_triples(documents: DataFrame, key: str, document: str) -> DataFrame:
    """(key, ord, s, p, o): a triple for each key of each object, and for each element of arrays.

    Objects without @id are named _:<key>_<number> in the order of reading, an object's keys being read in their order
    (JSON gives them none). {"@value": x} is the literal x, but at the top; literals that aren't strings are in JSON. Null documents
    and those that are no JSON give no rows; documents that share a key or have none are told apart, but
    not their names.
    """
    levels = _levels(documents, key, document)
    kind = documents.schema[key].dataType.simpleString()
    if not levels:
        return documents.sparkSession.createDataFrame([], f"{key} {kind}, ord int, s string, p string, o string")
    rows = levels[0]
    for x in levels[1:]:
        rows = rows.unionByName(x)
    rows = rows.withColumn("array", F.col("v").isNotNull() & _items(F.col("v")).isNotNull()).filter("not array")
    # anonymous objects are numbered along the order of reading, triples too
    rows = rows.withColumn("fresh", F.col("text").isNull() & F.col("id").isNull())
    rows = rows.withColumn("number", F.sum(F.col("fresh").cast("int")).over(_reading()) - 1).withColumn("ord", F.sum(F.col("p").isNotNull().cast("int")).over(_reading()) - 1)
    name = F.coalesce("id", "text", F.concat(F.lit("_:"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("_"), F.col("number").cast("string")))
    named = written(rows.select("_doc", "key", "path", "parent", "p", "ord", "text", name.alias("name")))
    subjects = named.filter("text is null").select("_doc", F.col("path").alias("parent"), F.col("name").alias("s"))
    out = named.filter("p is not null").join(subjects, ["_doc", "parent"])
    return out.select(F.col("key").alias(key), F.col("ord").cast("int").alias("ord"), "s", "p", F.col("name").alias("o"))


def literal_texts(shredded: DataFrame, key: str) -> DataFrame:
    """(id, text, ord) of triples whose object is no address or name and that give no label: what is read of a document."""
    return shredded.filter(~X.is_url(F.col("o")) & (F.col("p") != V.LABEL)).select(F.col(key).cast("string").alias("id"), F.col("o").alias("text"), "ord")


def json_values(documents: DataFrame, key: str, document: str, wanted: str) -> DataFrame:
    """(key, ord, value) of a JSON key at any depth; below a hit is not searched.

    Strings as they are, anything else in JSON, in the order of reading. What isn't JSON gives no rows.
    """
    level = _parsed(documents, key, document)
    found = []
    while not level.isEmpty():
        hit = _member(F.col("v"), wanted)
        found.append(level.withColumn("hit", hit).filter("hit is not null").select("_doc", "key", "path", _plain(F.col("hit")).alias("value")))
        rest = level.filter(hit.isNull())
        inside = F.coalesce(_items(F.col("v")), F.transform(_fields(F.col("v")), lambda e: e["value"]))
        below = rest.select("_doc", "key", "path", F.posexplode(inside).alias("i", "v"))
        level = written(below.select("_doc", "key", F.concat("path", F.array("i")).alias("path"), "v"))
    kind = documents.schema[key].dataType.simpleString()
    if not found:
        return documents.sparkSession.createDataFrame([], f"{key} {kind}, ord int, value string")
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    return rows.select(F.col("key").alias(key), (F.row_number().over(_reading()) - 1).alias("ord"), "value")
