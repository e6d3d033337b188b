"""Queries of nested views: regions as JSON documents, and the tree of orders with its chains contracted."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import nested
from tesserae.plans.registry import query, table


def _below(spark, sf):
    """What lies in regions and nations, and their names."""
    nation, supplier, region = (table(spark, sf, n) for n in ("nation", "supplier", "region"))
    edge = lambda df, s, p, o: df.select(F.expr(s).alias("s"), F.lit(p).alias("p"), F.expr(o).alias("o"))
    parts = [
        edge(nation, "'region:' || n_regionkey", "my:contains", "'nation:' || n_nationkey"),
        edge(supplier, "'nation:' || s_nationkey", "my:contains", "'supp:' || s_suppkey"),
        edge(region, "'region:' || r_regionkey", "rdfs:label", "r_name"),
        edge(nation, "'nation:' || n_nationkey", "rdfs:label", "n_name"),
        edge(supplier, "'supp:' || s_suppkey", "rdfs:label", "s_name"),
        edge(nation, "'nation:' || n_nationkey", "my:within", "'region:' || n_regionkey"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("""WITH s AS (SELECT s_nationkey AS n, string_agg('{"@id":"supp:' || s_suppkey || '","rdfs:label":["' || s_name || '"]}', ',' ORDER BY 'supp:' || s_suppkey) AS x FROM supplier GROUP BY 1),
n AS (SELECT n_regionkey AS r, string_agg('{"@id":"nation:' || n_nationkey || '",' || coalesce('"my:contains":[' || s.x || '],', '') || '"my:within":["region:' || n_regionkey || '"],"rdfs:label":["' || n_name || '"]}', ',' ORDER BY 'nation:' || n_nationkey) AS x FROM nation LEFT JOIN s ON s.n = n_nationkey GROUP BY 1)
SELECT 'region:' || r_regionkey AS node, '{"@id":"region:' || r_regionkey || '",' || coalesce('"my:contains":[' || n.x || '],', '') || '"rdfs:label":["' || r_name || '"]}' AS json FROM region LEFT JOIN n ON n.r = r_regionkey""")
def nested_json(spark, sf):
    """Regions with all that they hold; a nation's own region is on its path and isn't unfolded again."""
    seeds = table(spark, sf, "region").select(F.expr("'region:' || r_regionkey").alias("node"))
    return nested.nested_json(_below(spark, sf), seeds, 4)


_TREE = """t AS (SELECT 'cust:' || c_custkey AS node, 'nation:' || c_nationkey AS parent FROM customer UNION ALL SELECT 'nation:' || n_nationkey, NULL FROM nation
UNION ALL SELECT 'order:' || o_orderkey, 'cust:' || o_custkey FROM orders UNION ALL SELECT DISTINCT 'line:' || l_orderkey || ':' || l_linenumber, 'order:' || l_orderkey FROM lineitem),
one AS (SELECT parent FROM t WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) = 1), l AS (SELECT node, parent FROM t JOIN one USING (parent)),
c(node, top) AS (SELECT t.node, t.node FROM t LEFT JOIN l USING (node) WHERE l.node IS NULL UNION ALL SELECT l.node, c.top FROM c JOIN l ON l.parent = c.node)"""


def _orders_tree(spark, sf):
    pairs = lambda name, node, parent: table(spark, sf, name).select(F.expr(node).alias("node"), F.expr(parent).alias("parent"))
    tree = pairs("customer", "'cust:' || c_custkey", "'nation:' || c_nationkey").unionByName(pairs("nation", "'nation:' || n_nationkey", "cast(null as string)"))
    return tree.unionByName(pairs("orders", "'order:' || o_orderkey", "'cust:' || o_custkey")).unionByName(pairs("lineitem", "'line:' || l_orderkey || ':' || l_linenumber", "'order:' || l_orderkey").distinct())


@query(f"WITH RECURSIVE {_TREE} SELECT t.node, p.top AS parent, m.n AS members FROM t JOIN (SELECT top, count(*) AS n FROM c GROUP BY top) m ON m.top = t.node LEFT JOIN c p ON p.node = t.parent")
def contracted_chains(spark, sf):
    """The tree of nations, customers, orders and lines; an order of one line is one node with it, and so on."""
    return nested.contracted(_orders_tree(spark, sf))
