"""Queries of legal XML: acts that are written of the tables, read back as paragraphs and their annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.plans.registry import query, table
from tesserae.sources import markup


def acts(spark, sf):
    """(act, xml): a chapter for each region, a section for each nation, an article for each of its suppliers; its
    account stands in a numbered paragraph with a list, its name and a reference to the nation in a block list."""
    tag = lambda name, *inner, eid=None: F.concat(F.lit(f"<{name}"), *([F.lit(' eId="'), eid, F.lit('"')] if eid is not None else []), F.lit(">"), *inner, F.lit(f"</{name}>"))
    text = lambda c: F.col(c).cast("string")
    key = text("s_suppkey")
    intro = tag("intro", tag("p", F.lit("Supplier number "), key, F.lit(" holds")))
    listed = tag("paragraph", tag("num", F.lit("("), key, F.lit(")")), tag("list", intro, tag("point", tag("p", F.lit("goods &amp; an  account")))), eid=F.concat(F.lit("par_"), key))
    ref = F.concat(F.lit('<ref href="#nat_'), text("n_nationkey"), F.lit('">'), F.col("n_name"), F.lit("</ref>"))
    block = tag("blockList", tag("listIntroduction", F.lit("It is named")), tag("item", tag("num", F.lit("i")), tag("p", F.col("s_name"), F.lit(" of "), ref), eid=F.concat(F.lit("item_"), key)))
    suppliers = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    articles = suppliers.select("n_nationkey", "n_name", "n_regionkey", "s_suppkey", tag("article", tag("num", F.lit("Article "), key), listed, block, eid=F.concat(F.lit("art_"), key)).alias("x"))
    ordered = lambda by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "x"))), lambda s: s["x"]), "")
    sections = articles.groupBy("n_regionkey", "n_nationkey", "n_name").agg(ordered("s_suppkey").alias("x"))
    sections = sections.withColumn("x", tag("section", tag("num", text("n_nationkey")), tag("heading", F.lit("Nation "), F.col("n_name")), F.col("x"), eid=F.concat(F.lit("nat_"), text("n_nationkey"))))
    chapters = sections.groupBy("n_regionkey").agg(ordered("n_nationkey").alias("x")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    chapter = tag("chapter", tag("heading", F.col("r_name")), F.col("x"), eid=F.concat(F.lit("reg_"), text("r_regionkey")))
    return chapters.select(F.col("r_regionkey").alias("act"), tag("akomaNtoso", chapter).alias("xml"))


#: Of each supplier three p elements: the introduction, which is no row, the point and the item.
_PLACES = "s AS (SELECT s_suppkey, s_name, n_nationkey, n_name, r_regionkey, r_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey, s_suppkey) - 1 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH {_PLACES} SELECT r_regionkey AS act, CAST(3 * k + 1 AS INTEGER) AS pos, 'Supplier number ' || s_suppkey || ' holds goods & an account' AS text FROM s
UNION ALL SELECT r_regionkey, CAST(3 * k + 2 AS INTEGER), 'It is named ' || s_name || ' of ' || n_name FROM s""")
def legal_paragraphs(spark, sf):
    return markup.legal_paragraphs(acts(spark, sf), "act").select("act", "pos", "text")


@query(f"""WITH {_PLACES}, r AS (SELECT *, r_regionkey || '_' || (3 * k + 1) AS id, true AS listed FROM s UNION ALL SELECT *, r_regionkey || '_' || (3 * k + 2), false FROM s),
t AS (SELECT id, unnest(CASE WHEN listed THEN [{{'p': 'my:paragraph_id', 'o': 'act:par_' || s_suppkey}}] ELSE [{{'p': 'my:block_id', 'o': 'act:item_' || s_suppkey}}, {{'p': 'my:reference_id', 'o': 'act:#nat_' || n_nationkey}}] END ||
  [{{'p': 'my:article_id', 'o': 'act:art_' || s_suppkey}}, {{'p': 'my:section_id', 'o': 'act:nat_' || n_nationkey}}, {{'p': 'my:chapter_id', 'o': 'act:reg_' || r_regionkey}}]) AS t FROM r),
l AS (SELECT id, unnest(CASE WHEN listed THEN [{{'s': 'act:par_' || s_suppkey, 'p': 'rdfs:label', 'o': '(' || s_suppkey || ')'}}] ELSE [{{'s': 'act:item_' || s_suppkey, 'p': 'rdfs:label', 'o': 'i'}}, {{'s': 'act:#nat_' || n_nationkey, 'p': 'rdfs:label', 'o': n_name}}] END ||
  [{{'s': 'act:art_' || s_suppkey, 'p': 'rdfs:label', 'o': 'Article ' || s_suppkey}}, {{'s': 'act:nat_' || n_nationkey, 'p': 'rdfs:label', 'o': CAST(n_nationkey AS VARCHAR)}}, {{'s': 'act:nat_' || n_nationkey, 'p': 'my:heading', 'o': 'Nation ' || n_name}}, {{'s': 'act:reg_' || r_regionkey, 'p': 'my:heading', 'o': r_name}}]) AS l FROM r)
SELECT id, '_:' || id || '_0' AS s, t.p AS p, t.o AS o FROM t UNION ALL SELECT id, l.s, l.p, l.o FROM l""")
def legal_annotations(spark, sf):
    rows = markup.legal_paragraphs(acts(spark, sf), "act", base=F.lit("act"))
    return markup.legal_annotations(rows, "act").select("id", "s", "p", "o")
