"""Queries over the driver tables, one or more for each operator, with the SQL of their oracles (see platform_queries too)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import columns as C
from lakeloom.operators import diff, fold, graph, quality, reach, search
from lakeloom.plans import metrics
from lakeloom.sources.tables import latest_schema, spread, stored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- adapters: the driver tables as graphs -----------------------------------------------------------------------------


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    """region → nation → customer → order → part, and nation → supplier → part; links of lines repeat."""
    t = lambda name: table(spark, sf, name)
    pairs = [
        t("nation").select(key("r:", "n_regionkey").alias("src"), key("n:", "n_nationkey").alias("dst")),
        t("customer").select(key("n:", "c_nationkey").alias("src"), key("c:", "c_custkey").alias("dst")),
        t("orders").select(key("c:", "o_custkey").alias("src"), key("o:", "o_orderkey").alias("dst")),
        t("lineitem").select(key("o:", "l_orderkey").alias("src"), key("p:", "l_partkey").alias("dst")),
        t("supplier").select(key("n:", "s_nationkey").alias("src"), key("s:", "s_suppkey").alias("dst")),
        t("lineitem").select(key("s:", "l_suppkey").alias("src"), key("p:", "l_partkey").alias("dst")),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.union(p)
    return out


def dag(spark: SparkSession, sf: str) -> DataFrame:
    return links(spark, sf).distinct()


DAG = """
e AS (SELECT DISTINCT * FROM (
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders
  UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier
  UNION ALL SELECT 's:' || l_suppkey, 'p:' || l_partkey FROM lineitem)),
"""


def ring(spark: SparkSession, sf: str) -> DataFrame:
    """A small graph with cycles and self-loops, from all orders."""
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 40).alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 3) % 40).alias("dst")).distinct()


RING = "e AS (SELECT DISTINCT o_custkey % 40 AS src, (o_custkey * 7 + o_orderkey % 3) % 40 AS dst FROM orders),"


def walks(edges: str, most: int) -> str:
    """The closure as SQL: walk counts by length; the shortest are paths."""
    return f"""WITH RECURSIVE {edges}
w(a, d, h, c) AS (SELECT src, dst, 1, CAST(1 AS HUGEINT) FROM e WHERE src <> dst
  UNION ALL SELECT w.a, e.dst, w.h + 1, sum(w.c) FROM w JOIN e ON w.d = e.src AND e.src <> e.dst WHERE w.h < {most} GROUP BY w.a, e.dst, w.h),
k AS (SELECT a AS ancestor, d AS descendant, CAST(min(h) AS INTEGER) AS min_hops, CAST(arg_min(c, h) AS BIGINT) AS path_cnt FROM w WHERE a <> d GROUP BY a, d)
"""


@query(walks(DAG, 5) + "SELECT * FROM k")
def closure_dag(spark, sf):
    return graph.closure(links(spark, sf), kept=False)


@query(walks(RING, 12) + "SELECT * FROM k")
def closure_cyc(spark, sf):
    return graph.closure(ring(spark, sf))


@query(walks(RING, 12) + "SELECT x.ancestor AS a, x.descendant AS b FROM k x JOIN k y ON x.ancestor = y.descendant AND x.descendant = y.ancestor WHERE x.ancestor < x.descendant")
def cycle_pairs(spark, sf):
    return reach.cyclic(reach.strong_components(ring(spark, sf)))


@query(walks(RING, 12) + """, m AS (SELECT x.ancestor AS node, min(x.descendant) AS least FROM k x JOIN k y ON x.ancestor = y.descendant AND x.descendant = y.ancestor GROUP BY 1)
SELECT n.node, least(n.node, coalesce(m.least, n.node)) AS component FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) n LEFT JOIN m ON m.node = n.node""")
def strong_components(spark, sf):
    return reach.strong_components(ring(spark, sf))


def trails(spark, sf):
    """Long chains: the orders of each nation's customers by number, each leading to the next; every eleventh number leads back too."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    step = o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(Window.partitionBy("c_nationkey").orderBy("o_orderkey")).alias("dst")).filter("dst is not null")
    return step.union(step.filter("src % 11 = 0").select("dst", "src"))


# a way back over k steps needs k links that lead back
TRAILS = """WITH o AS (SELECT o_orderkey AS k, c_nationkey AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT *, sum(CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM o)
"""


@query(TRAILS + """, p AS (SELECT DISTINCT l_orderkey AS a, o_orderkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey + l_partkey - l_suppkey)
SELECT p.a, p.b, p.a <> p.b AND x.g = y.g AND (x.i < y.i OR coalesce(x.b, 0) - coalesce(y.b, 0) = x.i - y.i) AS reaches FROM p JOIN t x ON x.k = p.a JOIN t y ON y.k = p.b""")
def reach_pairs(spark, sf):
    """A pair for each line of an order, asked of the labels."""
    pair = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_partkey") - F.col("l_suppkey")).alias("b"))
    real = table(spark, sf, "orders").select(F.col("o_orderkey").alias("b"))
    return reach.reaches(reach.hub_labels(trails(spark, sf)), pair.join(real, "b", "left_semi"))


@query("SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS ways_forward, CAST(sum(n) AS BIGINT) AS nodes, true AS labels_are_few FROM (SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) HAVING sum(n) > 0")
def reach_labels(spark, sf):
    """The rows that a closure of the long chains would have, and whether their labels are few: a logarithm of the chain's length a node and side."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    n = F.col("count")
    sizes = o.groupBy("c_nationkey").count().agg(F.sum(F.expr("count * (count - 1) div 2")).alias("ways_forward"), F.sum(n).alias("nodes"), F.sum(2 * n * (1 + F.log2(n))).alias("most"))
    labels = reach.hub_labels(trails(spark, sf)).agg(F.count("*").alias("labels"))
    return sizes.join(F.broadcast(labels)).select("ways_forward", "nodes", (F.col("labels") <= F.col("most")).alias("labels_are_few"))


@query(walks(DAG, 5) + ", p AS (SELECT DISTINCT 'n:' || c_nationkey AS a, 'p:' || l_partkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey) SELECT a, b, min_hops AS hops, path_cnt FROM p JOIN k ON ancestor = a AND descendant = b")
def path_pairs(spark, sf):
    """Shortest paths from the nation of every customer to the parts that they ordered."""
    c, o, l = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))  # noqa: E741
    bought = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return reach.path_counts(dag(spark, sf), bought.select(key("n:", "c_nationkey").alias("a"), key("p:", "l_partkey").alias("b")))


@query(walks(DAG, 5) + "SELECT descendant, min_hops, path_cnt FROM k WHERE ancestor = 'r:1' ORDER BY min_hops, descendant LIMIT 50 OFFSET 50")
def impact_table(spark, sf):
    return graph.impact(graph.closure(links(spark, sf), spark.createDataFrame([("r:1",)], "src string")), "r:1", page=2, size=50)


@query(walks(DAG, 5) + "SELECT CAST(count(*) AS BIGINT) AS total_downstream FROM k WHERE ancestor = 'r:1'")
def impact_total(spark, sf):
    return graph.closure(links(spark, sf), spark.createDataFrame([("r:1",)], "src string")).agg(F.count("*").alias("total_downstream"))


@query(walks(DAG, 5) + "SELECT o_orderpriority AS task, CAST(count(DISTINCT descendant) AS BIGINT) AS affected FROM k JOIN orders ON descendant = 'o:' || o_orderkey WHERE ancestor = 'r:1' GROUP BY 1")
def impact_task(spark, sf):
    owners = table(spark, sf, "orders").select(key("o:", "o_orderkey").alias("descendant"), F.col("o_orderpriority").alias("task"))
    return graph.impact_by(graph.closure(links(spark, sf), spark.createDataFrame([("r:1",)], "src string")), "r:1", owners)


def bfs(here: str, there: str, start: str, edges: str) -> str:
    return f"""WITH RECURSIVE {edges}
v(node, h) AS (SELECT {start}, 0 UNION SELECT e.{there}, v.h + 1 FROM v JOIN e ON e.{here} = v.node WHERE v.h < 3),
m AS (SELECT node, min(h) AS h FROM v GROUP BY node)
SELECT src, dst, CAST(h + 1 AS INTEGER) AS level FROM m JOIN e ON e.{here} = m.node WHERE h < 3"""


@query(bfs("src", "dst", "'n:3'", DAG))
def lineage_down(spark, sf):
    return graph.lineage(dag(spark, sf), spark.createDataFrame([("n:3",)], "node string"), depth=3)


@query(bfs("dst", "src", "'p:1'", DAG))
def lineage_up(spark, sf):
    return graph.lineage(dag(spark, sf), spark.createDataFrame([("p:1",)], "node string"), upstream=True, depth=3)


@query(bfs("src", "dst", "CAST(5 AS BIGINT)", RING))
def lineage_cyc(spark, sf):
    return graph.lineage(ring(spark, sf), spark.createDataFrame([(5,)], "node long"), depth=3)


PATH = f"""WITH RECURSIVE {RING}
p(node, path) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)] UNION ALL SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.node
  WHERE NOT list_contains(p.path, e.dst) AND len(p.path) < 7),
b AS (SELECT path FROM p WHERE node = 30 ORDER BY len(path), path LIMIT 1)
SELECT CAST(i AS INTEGER) AS hop, path[i] AS src, path[i + 1] AS dst FROM (SELECT path, unnest(range(1, len(path))) AS i FROM b)"""


@query(PATH)
def lineage_path(spark, sf):
    return graph.shortest_path(ring(spark, sf), 1, 30)


def grown(spark, sf):
    return ring(spark, sf).union(spark.createDataFrame([(100, 5), (5, 101), (101, 102)], "src long, dst long"))


@query(walks(RING.rstrip(",").replace("e AS", "e0 AS") + ", e AS (SELECT * FROM e0 UNION ALL SELECT * FROM (VALUES (100, 5), (5, 101), (101, 102)) x(src, dst)),", 14) + "SELECT * FROM k")
def incr_closure(spark, sf):
    old = ring(spark, sf)
    return reach.maintained(graph.closure(old), old, grown(spark, sf))


def fewer(e: str) -> str:
    return f"SELECT src, dst FROM {e} WHERE src <> 7 AND (src + dst) % 9 <> 0"


@query("WITH RECURSIVE " + RING.rstrip(",").replace("e AS", "e0 AS") + f", e1 AS ({fewer('e0')} UNION ALL SELECT * FROM (VALUES (100, 5), (5, 101), (101, 102)) x(src, dst)), " + ", ".join(
    f"""w{i}(a, d, h, c) AS (SELECT src, dst, 1, CAST(1 AS HUGEINT) FROM e{i} WHERE src <> dst UNION ALL SELECT w.a, e.dst, w.h + 1, sum(w.c) FROM w{i} w JOIN e{i} e ON w.d = e.src AND e.src <> e.dst WHERE w.h < 16 GROUP BY w.a, e.dst, w.h),
k{i} AS (SELECT a AS ancestor, d AS descendant, CAST(min(h) AS INTEGER) AS min_hops, CAST(arg_min(c, h) AS BIGINT) AS path_cnt FROM w{i} WHERE a <> d GROUP BY a, d)""" for i in (0, 1)) + """
SELECT *, CAST(-1 AS INTEGER) AS sign FROM (SELECT * FROM k0 EXCEPT SELECT * FROM k1) UNION ALL SELECT *, 1 FROM (SELECT * FROM k1 EXCEPT SELECT * FROM k0)""")
def closure_delta(spark, sf):
    """Edges come and go: the signed rows between both closures."""
    old = ring(spark, sf)
    new = old.filter("src <> 7 and (src + dst) % 9 <> 0").union(spark.createDataFrame([(100, 5), (5, 101), (101, 102)], "src long, dst long"))
    return reach.closure_delta(graph.closure(old), old, new)


@query(f"""WITH RECURSIVE {DAG}
g AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e),
c AS (SELECT * FROM (SELECT 'r:' || r_regionkey AS candidate, r_name AS name FROM region UNION ALL SELECT 'n:' || n_nationkey, n_name FROM nation UNION ALL SELECT 's:' || s_suppkey, s_name FROM supplier)),
f AS (SELECT 'r:' || r_regionkey AS node, r_regionkey AS r FROM region UNION ALL SELECT 'n:' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 's:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT c.candidate, min(c.candidate) OVER (PARTITION BY f.r) AS family FROM c JOIN f ON f.node = c.candidate)
SELECT candidate, family, CAST(row_number() OVER (PARTITION BY family ORDER BY CASE WHEN candidate LIKE 's:%' THEN 4 WHEN candidate LIKE 'n:%' THEN 2 ELSE 1 END DESC, candidate) AS INTEGER) AS rank_in_family,
  (SELECT count(DISTINCT family) > 1 FROM m) AS ambiguous FROM m""")
def families(spark, sf):
    t = lambda name, p, k, layer: table(spark, sf, name).select(key(p, k).alias("candidate"), key(p, k).alias("node"), F.lit(layer).alias("layer"))
    own = t("region", "r:", "r_regionkey", "ods").union(t("nation", "n:", "n_nationkey", "dwd")).union(t("supplier", "s:", "s_suppkey", "ads"))
    own = own.withColumns({"certified": F.lit(0), "domain_match": F.lit(0), "confidence": F.lit(1.0)})
    upper = dag(spark, sf).filter("dst like 'n:%' or dst like 's:%'")
    return graph.families(own, graph.closure(upper)).select("candidate", "family", "rank_in_family", "ambiguous")


def tmp_edges(spark, sf):
    own = table(spark, sf, "supplier").select(key("n:", "s_nationkey").alias("src"), key("s:", "s_suppkey").alias("dst"), key("s", "s_suppkey").alias("sql_id"))
    items = table(spark, sf, "lineitem")
    parts = spread(items.select(key("s:", "l_suppkey").alias("src"), key("p:", "l_partkey").alias("dst")), items.count(), "src", "dst").distinct().withColumn("sql_id", F.col("dst"))
    both = own.union(parts).withColumns({"src_type": F.lit("sql"), "confidence": F.when(F.col("src").endswith("1"), "medium").otherwise("high"), "transform_expr": F.col("dst"), "filter_cond": F.col("src"), "join_cond": F.lit("")})
    return both.withColumn("edge_id", F.concat_ws(">", "src", "dst"))


@query("""WITH n AS (SELECT 'n:' || s_nationkey AS src, 's:' || s_suppkey AS mid FROM supplier),
p AS (SELECT DISTINCT 's:' || l_suppkey AS mid, 'p:' || l_partkey AS dst FROM lineitem),
j AS (SELECT n.src, p.dst, n.mid, row_number() OVER (PARTITION BY n.src, p.dst ORDER BY n.src || '>' || n.mid) AS rn FROM n JOIN p USING (mid))
SELECT src, dst, CASE WHEN src LIKE '%1' OR mid LIKE '%1' THEN 'medium' ELSE 'high' END AS confidence, dst || ' (through tmp: ' || mid || ')' AS transform_expr, mid AS filter_cond FROM j WHERE rn = 1""")
def tmp_fold(spark, sf):
    tmp = table(spark, sf, "supplier").select(key("s:", "s_suppkey").alias("node"))
    return fold.fold(tmp_edges(spark, sf), tmp).select("src", "dst", "confidence", "transform_expr", "filter_cond")


# --- quality -----------------------------------------------------------------------------------------------------------


def catalog(spark, sf):
    c = table(spark, sf, "customer")
    layer = F.element_at(F.array(*map(F.lit, ("ods", "dwd", "dws", "ads", "dim"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select(key("c:", "c_custkey").alias("full_name"), layer.alias("layer"), F.col("c_mktsegment").alias("domain"), (F.col("c_nationkey")).cast("string").alias("owner"), (F.col("c_acctbal") >= 0).alias("is_online"))


COVER = """t AS (SELECT 'c:' || c_custkey AS full_name, ['ods', 'dwd', 'dws', 'ads', 'dim'][c_custkey % 5 + 1] AS layer, c_mktsegment AS domain, CAST(c_nationkey AS VARCHAR) AS owner, c_acctbal >= 0 AS is_online FROM customer),
l AS (SELECT DISTINCT 'c:' || o_custkey AS full_name FROM orders),
c AS (SELECT layer, domain, owner, CAST(count(*) AS BIGINT) AS total, CAST(count(l.full_name) AS BIGINT) AS covered FROM t LEFT JOIN l USING (full_name) WHERE is_online AND layer IN ('dwd', 'dws', 'ads', 'dim') GROUP BY ALL)"""


def covered(spark, sf):
    return quality.coverage(catalog(spark, sf), table(spark, sf, "orders").select(key("c:", "o_custkey").alias("dst")))


@query(f"WITH {COVER} SELECT * FROM c")
def coverage_dim(spark, sf):
    return covered(spark, sf)


@query(f"WITH {COVER} SELECT layer, CAST(sum(total) AS BIGINT) AS total, CAST(sum(covered) AS BIGINT) AS covered, round(sum(covered) / sum(total), 4) AS ratio FROM c GROUP BY layer")
def coverage_layer(spark, sf):
    return quality.rolled_up(covered(spark, sf), "layer")


@query(f"WITH {COVER} SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(covered) AS BIGINT) AS covered, round(sum(covered) / sum(total), 4) AS ratio FROM c")
def coverage_total(spark, sf):
    return quality.rolled_up(covered(spark, sf))


@query("SELECT o_orderstatus AS parse_status, o_orderpriority AS reason, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def parse_status_hist(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("parse_status"), F.col("o_orderpriority").alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT CASE l_returnflag WHEN 'A' THEN 'medium' WHEN 'R' THEN 'low' ELSE 'high' END AS c FROM lineitem)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (c = 'medium') AS BIGINT) AS medium, round(count(*) FILTER (c = 'medium') / count(*), 4) AS medium_ratio, round(count(*) FILTER (c <> 'high') / count(*), 4) AS not_high_ratio FROM x""")
def confidence_dist(spark, sf):
    return quality.confidence_shares(table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "A", "medium").when(F.col("l_returnflag") == "R", "low").otherwise("high").alias("confidence")))


def audit(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("value") < 10, "refused").otherwise("ok")
    return e.select("ts", F.when(F.col("event_id") % 3 == 0, "adhoc").otherwise("semantic").alias("channel"), status.alias("status"), F.when(status == "refused", F.col("event_type")).alias("refuse_reason"), "user_id")


AUDIT = """a AS (SELECT ts, CASE WHEN event_id % 3 = 0 THEN 'adhoc' ELSE 'semantic' END AS channel, CASE WHEN value < 10 THEN 'refused' ELSE 'ok' END AS status, CASE WHEN value < 10 THEN event_type END AS refuse_reason, user_id FROM events),
w AS (SELECT * FROM a WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY)"""


def last_moment(spark, sf):
    return F.lit(table(spark, sf, "events").agg(F.max("ts")).first()[0])


@query(f"WITH {AUDIT} SELECT channel, status, refuse_reason, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY ALL")
def weekly_audit(spark, sf):
    return quality.usage_counts(audit(spark, sf), last_moment(spark, sf))


@query(f"""WITH {AUDIT} SELECT CAST(count(*) AS BIGINT) AS requests, CAST(count(DISTINCT user_id) AS BIGINT) AS users, round(count(*) FILTER (status = 'refused') / count(*), 4) AS refusal_ratio,
round(count(*) FILTER (channel = 'semantic') / greatest(count(*), 1), 4) AS semantic_ratio FROM w""")
def usage_ratios(spark, sf):
    return quality.usage(audit(spark, sf), last_moment(spark, sf))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(avg(value), 4) AS mean, max(value) AS most FROM events GROUP BY 1")
def percentiles(spark, sf):
    return quality.latency(table(spark, sf, "events"), "value", "event_type")


def both_sides(spark, sf):
    own = table(spark, sf, "lineitem").select(key("", "l_orderkey").alias("case_id"), F.col("l_linenumber").cast("string").alias("dst_col"), key("p", "l_partkey").alias("src_table"), F.lit("k").alias("src_col"), F.concat(F.lit("sum( "), "l_returnflag", F.lit(" )")).alias("expr"), F.struct("l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("place"), "l_suppkey")
    gold = own.filter("l_suppkey % 7 <> 0")
    machine = own.filter("l_suppkey % 11 <> 0").withColumn("expr", F.when(F.col("l_suppkey") % 13 == 0, "MAX(x)").otherwise(F.upper("expr")))
    return gold.drop("l_suppkey"), machine.drop("l_suppkey")


VERDICT = """o AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, CAST(l_linenumber AS VARCHAR) AS dst_col, 'p' || l_partkey AS src_table, 'k' AS src_col,
  'sum( ' || l_returnflag || ' )' AS expr, l_suppkey AS s, {'a': l_suppkey, 'b': l_quantity, 'c': l_extendedprice, 'd': l_shipdate} AS place FROM lineitem),
g AS (SELECT case_id, dst_col, src_table, src_col, arg_min(expr, place) AS gold FROM o WHERE s % 7 <> 0 GROUP BY ALL),
m AS (SELECT case_id, dst_col, src_table, src_col, arg_min(CASE WHEN s % 13 = 0 THEN 'MAX(x)' ELSE upper(expr) END, place) AS machine FROM o WHERE s % 11 <> 0 GROUP BY ALL),
v AS (SELECT case_id, dst_col, src_table, src_col, CASE WHEN machine IS NULL THEN 'missing' WHEN gold IS NULL THEN 'extra' WHEN contains(machine, upper(gold)) THEN 'matched' ELSE 'mismatch' END AS verdict
  FROM g FULL JOIN m USING (case_id, dst_col, src_table, src_col))"""


@query(f"WITH {VERDICT} SELECT * FROM v")
def gold_compare(spark, sf):
    return quality.compared(*both_sides(spark, sf))


@query(f"""WITH {VERDICT} SELECT dst_col, CAST(count(*) FILTER (verdict = 'matched') AS BIGINT) AS matched, CAST(count(*) FILTER (verdict = 'missing') AS BIGINT) AS missing, CAST(count(*) FILTER (verdict = 'extra') AS BIGINT) AS extra,
CAST(count(*) FILTER (verdict = 'mismatch') AS BIGINT) AS mismatch, round(count(*) FILTER (verdict = 'matched') / count(*), 4) AS accuracy FROM v GROUP BY dst_col""")
def gold_accuracy(spark, sf):
    return quality.accuracy(quality.compared(*both_sides(spark, sf)), "dst_col")


STATEMENT = "CASE l_linenumber % 7 WHEN 0 THEN 'insert overwrite table t select a from t' WHEN 1 THEN 'select a from x join y on x.i = y.i' WHEN 2 THEN 'with q as (select 1) select * from q' WHEN 3 THEN 'select row_number() over (order by a) from x' WHEN 4 THEN 'select b from x lateral view explode(y) z as b' WHEN 5 THEN 'from s insert into t select a insert into u select b' ELSE 'select a from x' END"


@query("SELECT CASE l_linenumber % 7 WHEN 0 THEN 'self_dep' WHEN 1 THEN 'join' WHEN 2 THEN 'cte' WHEN 3 THEN 'window' WHEN 4 THEN 'lateral_view' WHEN 5 THEN 'multi_insert' ELSE 'simple' END AS shape, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def shape_classify(spark, sf):
    return table(spark, sf, "lineitem").select(quality.shape_of(F.expr(STATEMENT)).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT sum(n) AS t FROM n),
s AS (SELECT 50 - count(*) AS s FROM n),
q AS (SELECT c_mktsegment, 1 + floor(n * s / t) AS base, n * s / t - floor(n * s / t) AS rest FROM n, t, s),
q2 AS (SELECT c_mktsegment, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, '(''' || c_mktsegment || ''',)') <= 50 - (SELECT sum(base) FROM q) THEN 1 ELSE 0 END AS quota FROM q),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0' || c_custkey), c_custkey) AS rn FROM customer)
SELECT c_custkey, c_mktsegment FROM r JOIN q2 USING (c_mktsegment) WHERE rn <= quota""")
def stratified_sample(spark, sf):
    return quality.stratified(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", ["c_mktsegment"], 50)


# --- expressions and search --------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN n LIKE 'ods\\_%' ESCAPE '\\' THEN 'ods' WHEN n LIKE 'dwd\\_%' ESCAPE '\\' THEN 'dwd' WHEN n LIKE 'd\\_%' ESCAPE '\\' THEN 'dwd' WHEN n LIKE 'tmp\\_%' ESCAPE '\\' THEN 'tmp' ELSE '' END AS layer, n LIKE 'tmp\\_%' ESCAPE '\\' OR n LIKE '%\\_tmp' ESCAPE '\\' AS is_tmp
FROM (SELECT p_partkey, ['ods_', 'dwd_', 'd_', 'tmp_', 'x_'][p_partkey % 5 + 1] || p_name || CASE WHEN p_size > 40 THEN '_tmp' ELSE '' END AS n FROM part)""")
def layer_derive(spark, sf):
    name = F.concat(F.element_at(F.array(*map(F.lit, ("ods_", "dwd_", "d_", "tmp_", "x_"))), (F.col("p_partkey") % 5 + 1).cast("int")), "p_name", F.when(F.col("p_size") > 40, "_tmp").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", C.layer_of(name).alias("layer"), C.is_tmp(F.concat(F.lit("db."), name)).alias("is_tmp"))


@query("""SELECT p_partkey, CASE WHEN c = '' THEN 'empty' WHEN length(c) < 4 THEN 'too_short' WHEN lower(translate(c, '_ -', '')) = lower(translate(n, '_ -', '')) THEN 'no_increment' END AS reason
FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS n, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN left(p_name, 3) WHEN 2 THEN '' ELSE p_type END AS c FROM part)""")
def admission(spark, sf):
    comment = F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).when(F.col("p_partkey") % 4 == 1, F.left("p_name", F.lit(3))).when(F.col("p_partkey") % 4 == 2, "").otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", C.admission(F.replace("p_name", F.lit(" "), F.lit("_")), comment).alias("reason"))


@query("SELECT c_custkey, CASE WHEN c_name = '' OR c_name IS NULL THEN '' ELSE left(c_name, 1) || '***' END AS masked FROM customer")
def mask(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.masked(F.col("c_name")).alias("masked"))


WORD = "blue"


@query("""WITH g AS (SELECT DISTINCT substr('sofia brush', CAST(i AS INTEGER), 2) AS gram FROM range(1, 11) t(i)), n AS (SELECT count(*) AS n FROM part),
h AS (SELECT p_partkey, gram, CAST((length(t) - length(replace(t, gram, ''))) / 2 AS BIGINT) AS x, t FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part), g),
i AS (SELECT p_partkey, substr(t, CAST(k AS INTEGER), 2) AS gram FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part), range(1, 200) r(k) WHERE k < length(t)),
f AS (SELECT p_partkey, i.gram, count(*) AS tf FROM i JOIN g USING (gram) GROUP BY ALL), d AS (SELECT gram, count(*) AS df FROM f GROUP BY 1)
SELECT p_partkey AS id, round(sum(tf * pow(log10(n / df), 2)), 6) AS score, least(round(sum(tf * pow(log10(n / df), 2)), 6), 0.99) AS confidence FROM f JOIN d USING (gram), n GROUP BY 1 ORDER BY score DESC, id LIMIT 10""")
def search_ngram(spark, sf):
    texts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return search.full_text(texts, "sofia brush")


FUZZY = "smal red widgets"


@query(f"""WITH RECURSIVE n AS (SELECT p_partkey AS id, unnest([p_name, p_type]) AS name FROM part), d AS (SELECT DISTINCT name FROM n),
l(name, i, r) AS (SELECT name, 0, [0 FOR x IN range({len(FUZZY)})] FROM d UNION ALL
  SELECT name, i + 1, [list_max([CASE WHEN substr('{FUZZY}', CAST(k AS INTEGER), 1) = substr(name, i + 1, 1) THEN (CASE WHEN k = 1 THEN 0 ELSE r[k - 1] END) + 1 ELSE r[k] END FOR k IN range(1, j + 1)]) FOR j IN range(1, {len(FUZZY)} + 1)] FROM l WHERE i < length(name)),
s AS (SELECT name, 200.0 * r[{len(FUZZY)}] / (length(name) + {len(FUZZY)}) AS score FROM l WHERE i = length(name))
SELECT id, round(max(score) / 100, 4) AS confidence FROM n JOIN s USING (name) GROUP BY id HAVING max(score) >= 60""")
def search_fuzzy(spark, sf):
    terms = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array("p_name", "p_type").alias("names"))
    return search.fuzzy(terms, FUZZY, 60)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT min_by(e, vec_id) AS q FROM v),
r AS (SELECT vec_id AS id, round(list_cosine_similarity(e, q), 6) AS confidence FROM v, q)
SELECT CAST(0 AS BIGINT) AS query_id, id, confidence, CAST(row_number() OVER (ORDER BY confidence DESC, id) AS INTEGER) AS rank FROM r ORDER BY confidence DESC, id LIMIT 5""")
def vec_topk(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    one = v.agg(F.min_by("embedding", "id").alias("embedding")).select(F.lit(0).cast("long").alias("query_id"), "embedding")
    return search.nearest(v, one, 5)


@query("""WITH t AS (SELECT p_partkey AS id, lower(regexp_replace(p_name, '\\s+', '', 'g')) AS t FROM part),
g AS (SELECT id, substr(t, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS gram FROM t, range(1, 200) a(i), range(1, 4) b(n) WHERE i + n - 1 <= length(t)),
b AS (SELECT id, CAST('0x' || substr(md5(gram), 15, 2) AS INTEGER) AS dim, CASE WHEN CAST('0x' || substr(md5(gram), 13, 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM g),
s AS (SELECT id, dim, sum(sign) AS v FROM b GROUP BY ALL HAVING sum(sign) <> 0)
SELECT id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM s""")
def hash_embed(spark, sf):
    texts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return search.hash_parts(texts).withColumn("value", F.round("value", 6))


# --- state changes -----------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'kept' WHEN o_orderkey % 10 = 0 THEN 'inserted' WHEN o_orderkey % 10 = 2 THEN 'changed' ELSE 'unchanged' END AS change,
CASE WHEN o_orderkey % 10 IN (0, 2) THEN 'pending' ELSE 'success' END AS parse_status, CASE WHEN o_orderkey % 10 = 2 THEN o_orderpriority || '!' ELSE o_orderpriority END AS sql_text FROM orders""")
def upsert_diff(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("sql_text"))
    new = o.filter("o_orderkey % 10 <> 1").withColumn("sql_text", F.when(F.col("o_orderkey") % 10 == 2, F.concat("sql_text", F.lit("!"))).otherwise(F.col("sql_text")))
    return diff.upsert_by_hash(o.filter("o_orderkey % 10 <> 0").withColumn("parse_status", F.lit("success")), new, ["o_orderkey"], "sql_text")


@query("SELECT c_custkey AS full_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS is_online FROM customer")
def soft_delete(spark, sf):
    tables = table(spark, sf, "customer").select(F.col("c_custkey").alias("full_name"), F.lit(True).alias("is_online"))
    return diff.soft_deleted(tables, table(spark, sf, "orders").select(F.col("o_custkey").alias("full_name")))


@query("""SELECT CASE WHEN e.l_suppkey IS NULL THEN 'manual' ELSE 'sql' END AS src_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag <> 'A' AND l_orderkey % 10 <> 3 UNION ALL SELECT NULL FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_suppkey FROM lineitem WHERE l_orderkey % 10 = 3 AND l_linenumber = 1) e GROUP BY 1""")
def edge_replace(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sql_id"), F.when(F.col("l_returnflag") == "A", "manual").otherwise("sql").alias("src_type"), "l_suppkey", "l_linenumber")
    ids = edges.filter("sql_id % 10 = 3").select("sql_id")
    new = edges.filter("sql_id % 10 = 3 and l_linenumber = 1").withColumn("src_type", F.lit("sql"))
    return diff.replaced(edges, new, ids).groupBy("src_type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'delete' WHEN p_partkey % 9 IN (1, 2) THEN 'upsert' ELSE 'unchanged' END AS action FROM part")
def vector_diff(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.sha1("p_name").alias("content_hash"))
    held = p.filter("id % 9 <> 1").withColumn("content_hash", F.when(F.col("id") % 9 == 2, "old").otherwise(F.col("content_hash")))
    return diff.hash_diff(p.filter("id % 9 <> 0"), held)


@query("SELECT o_custkey AS full_name, max(o_orderdate) AS snap_date, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS columns FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' GROUP BY 1")
def schema_latest(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("full_name"), F.struct("o_orderdate", "o_orderkey").alias("snap_date"), F.col("o_orderkey").alias("columns"))
    upto = F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))
    return latest_schema(o.filter(F.col("snap_date.o_orderdate") <= upto)).withColumn("snap_date", F.col("snap_date.o_orderdate"))


# --- constructs the parser must understand, run as they are -------------------------------------------------------------


def views(spark, sf):
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        table(spark, sf, name).createOrReplaceTempView(name)
    return spark


def shape(name: str, spark_sql: str, sql: str | None = None):
    def run(spark, sf):
        return views(spark, sf).sql(spark_sql)

    run.__name__ = name
    query(sql or spark_sql)(run)


shape("dedup_latest", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1")
shape("rank_report", "SELECT c_nationkey, CAST(round(sum(o_totalprice), 0) AS BIGINT) AS total, rank() OVER (ORDER BY CAST(round(sum(o_totalprice), 0) AS BIGINT) DESC) AS r FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey", "SELECT c_nationkey, CAST(round(sum(o_totalprice), 0) AS BIGINT) AS total, CAST(rank() OVER (ORDER BY CAST(round(sum(o_totalprice), 0) AS BIGINT) DESC) AS INTEGER) AS r FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
shape("self_dep_rollup", "SELECT k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_custkey AS k, 1 AS n FROM orders UNION ALL SELECT c_custkey, 0 FROM customer) x GROUP BY k")
shape("lateral_tags", "SELECT tag, count(*) AS n FROM part LATERAL VIEW explode(split(p_name, ' ')) x AS tag GROUP BY tag", "SELECT tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) x GROUP BY tag")
shape("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
shape("cte_window", "WITH d AS (SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, q, CAST(row_number() OVER (ORDER BY q DESC, l_suppkey) AS BIGINT) AS rn FROM d")
shape("broadcast_agg", "SELECT /*+ BROADCAST(n) */ n_name, count(*) AS n FROM customer c JOIN nation n ON c_nationkey = n_nationkey GROUP BY n_name DISTRIBUTE BY n_name", "SELECT n_name, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")

metrics.add_queries(query, views)
