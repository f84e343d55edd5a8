"""Queries of the parser, rebuilds, sinks, guards, search and portal, each with the SQL or the hand-written rows that it must equal.
Functions that live on the driver (parser, guards, audits) run over the demo warehouse of sources/transit.py or a few rows of
the driver tables."""

from __future__ import annotations

import datetime
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import columns as C
from lakeloom.operators import diff, fold, graph, portal, quality, search
from lakeloom.plans import lineage, rebuild
from lakeloom.plans import metrics as M
from lakeloom.queries import DAG, audit, both_sides, dag, families, key, last_moment, links, query, ring, views, walks
from lakeloom.queries import RING as RING_SQL
from lakeloom.sources import feeds, synth
from lakeloom.sources.tables import Generations, metastore_tables, shared_dir, stored, table
from lakeloom.sources.transit import CASES, SCHEMA
from lakeloom.streaming import incremental


def rows_sql(columns: str, rows: list[tuple]) -> str:
    """SQL of the given rows; columns: names with types."""
    names = [c.split()[0] for c in columns.split(", ")]
    say = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    cast = ", ".join(f"CAST({n} AS {c.split()[1]}) AS {n}" for n, c in zip(names, columns.split(", "), strict=True))
    if not rows:
        return f"SELECT {cast} FROM (SELECT {', '.join(f'NULL AS {n}' for n in names)}) WHERE false"
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) t({', '.join(names)})"


def folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lakeloom/{label}-{uuid.uuid4().hex}"


def table_of(names: tuple[str, ...], k) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))


# --- sources ------------------------------------------------------------------------------------------------------------

KEYS = ("comment", "steward", "owner_mail", "other")


@query("""WITH p AS (SELECT o_custkey AS k, ['comment', 'steward', 'owner_mail', 'other'][o_orderkey % 4 + 1] AS key, min(o_orderpriority) AS v FROM orders GROUP BY ALL),
o AS (SELECT k, arg_min(v, CASE key WHEN 'owner_mail' THEN 1 ELSE 2 END) AS owner FROM p WHERE key IN ('owner_mail', 'steward') GROUP BY k),
c AS (SELECT o_custkey AS k, string_agg('c' || o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey % 2, o_orderkey) AS cols FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 = 0 GROUP BY 1)
SELECT n_name || '.' || c_name AS full_name, CASE WHEN c_custkey % 3 = 0 THEN 'view' ELSE 'table' END AS table_type, p.v AS comment, coalesce(o.owner, c_mktsegment) AS owner, coalesce(c.cols, '') AS cols
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN p ON p.k = c_custkey AND p.key = 'comment' LEFT JOIN o ON o.k = c_custkey LEFT JOIN c ON c.k = c_custkey""")
def metastore_scan(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    tbls = c.select(F.col("c_custkey").alias("tbl_id"), F.col("c_nationkey").alias("db_id"), F.col("c_custkey").alias("sd_id"), F.col("c_name").alias("tbl_name"), F.when(F.col("c_custkey") % 3 == 0, "VIRTUAL_VIEW").otherwise("MANAGED_TABLE").alias("tbl_type"), F.col("c_mktsegment").alias("owner"))
    dbs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("db_id"), F.col("n_name").alias("db_name"))
    params = o.groupBy(F.col("o_custkey").alias("tbl_id"), table_of(KEYS, F.col("o_orderkey") % 4).alias("param_key")).agg(F.min("o_orderpriority").alias("param_value"))
    column = lambda k: o.select(F.col("o_custkey").alias(k), F.col("o_orderkey").cast("int").alias("integer_idx"), key("c", "o_orderkey").alias("name"), F.col("o_orderstatus").alias("type"))
    found = metastore_tables(tbls, dbs, params, column("sd_id").filter("integer_idx % 2 = 0"), column("tbl_id").filter("integer_idx % 2 = 1 and integer_idx % 5 = 0"), ["owner_mail", "steward"])
    return found.select("full_name", "table_type", "comment", "owner", F.array_join(F.transform("columns", lambda x: F.concat_ws(":", x["name"], x["type"])), ",").alias("cols"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS task_id, CAST(n_regionkey AS BIGINT) AS node_seq, n_name AS target_table, 'SELECT ' || n_nationkey AS sql_text FROM nation WHERE n_nationkey <> 7")
def feed_pages(spark, sf):
    items = [{"job": r.n_nationkey, "step": r.n_regionkey, "writes": r.n_name if r.n_nationkey != 7 else None, "text": f"SELECT {r.n_nationkey}"} for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]
    fails = [1, 1]

    def fetch(page: int, size: int) -> list[dict]:
        if page == 2 and fails:
            fails.pop()
            raise OSError("busy")
        return items[(page - 1) * size : page * size]

    found = feeds.statements_of(feeds.pages(fetch, 10, wait=lambda s: None), {"task_id": "job", "node_seq": "step", "target_table": "writes", "sql_text": "text"})
    return spark.createDataFrame([tuple(s.values()) for s in found], "task_id long, node_seq long, target_table string, sql_text string")


@query("SELECT 'o' || o_orderkey AS sql_id, o_orderpriority AS sql_text FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 = 0")
def active_statements(spark, sf):
    statements = table(spark, sf, "orders").filter("o_orderkey % 10 = 0").select(key("o", "o_orderkey").alias("sql_id"), F.col("o_orderpriority").alias("sql_text"), (F.col("o_orderstatus") == "F").alias("is_active"))
    return spark.createDataFrame(rebuild.active(statements), "sql_id string, sql_text string")


@query("SELECT n_name AS case_id, 'SELECT ' || n_nationkey AS sql_text, CASE WHEN n_regionkey = 0 THEN 'spark' ELSE 'hive' END AS dialect FROM nation")
def exported_sample(spark, sf):
    sample = table(spark, sf, "nation").select(F.col("n_name").alias("case_id"), F.concat(F.lit("SELECT "), F.col("n_nationkey").cast("string")).alias("sql_text"), F.when(F.col("n_regionkey") == 0, "spark").alias("dialect"))
    path = f"{tempfile.mkdtemp()}/sample"  # files for people, on the driver's machine
    quality.exported(sample, path)
    texts = {p.stem: p.read_text() for p in Path(path).glob("*.sql")}
    dialects = feeds.read_dialects(path)
    return spark.createDataFrame([(k, t.strip(), dialects[k]) for k, t in texts.items()], "case_id string, sql_text string, dialect string")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS case_id, 'SELECT ' || n_name AS sql_text FROM nation")
def statement_files(spark, sf):
    local = shared_dir(spark).removeprefix("file://")
    path = Path(f"{local}/lakeloom/statements-{uuid.uuid4().hex}")
    path.mkdir(parents=True)
    for r in table(spark, sf, "nation").collect():
        (path / f"{r.n_nationkey}.sql").write_text(f"SELECT {r.n_name}")
    return feeds.sql_folder(spark, f"file://{path}")


@query(rows_sql("step VARCHAR, written BOOLEAN, edges INTEGER", [("first", True, 5), ("again", False, 5), ("forced", True, 5), ("verified", False, 5)]))
def annotations(spark, sf):
    with lineage.Parser(spark, SCHEMA) as parser:
        own = feeds.prefilled("legs", "legs.sql", "hive", parser.parse(CASES["legs"].sql))
    own["column_edges"] = sorted({(e["dst_col"]) for e in own["column_edges"]})
    path = f"{tempfile.mkdtemp()}/legs.yaml"
    steps = [("first", feeds.write_annotation(path, own)), ("again", feeds.write_annotation(path, own)), ("forced", feeds.write_annotation(path, own | {"verified": True}, force=True)), ("verified", feeds.write_annotation(path, own, force=True))]
    return spark.createDataFrame([(s, w, len(feeds.read_annotation(path)["column_edges"])) for s, w in steps], "step string, written boolean, edges int")


@query(rows_sql("metric VARCHAR, cn_name VARCHAR, version INTEGER, dims VARCHAR, questions INTEGER", [("late_trips", "late", 2, "day,line", 1), ("trips", "", 1, "", 0)]))
def metric_files(spark, sf):
    path = Path(tempfile.mkdtemp())
    (path / "b.yaml").write_text("metric: trips\nbase_table: core.trips\nexpression: COUNT(1)\n")
    (path / "a.yml").write_text("metric: late_trips\ncn_name: late\nversion: 2\nbase_table: core.trips\nexpression: COUNT(1)\ndimensions: {line: {column: base.line}, day: {column: base.day}}\nverified_questions: [how many were late]\n")
    found = M.catalogue(spark, M.load_metrics(str(path)))
    return found.select("metric", "cn_name", "version", F.array_join("dimensions", ",").alias("dims"), F.size("verified_questions").alias("questions"))


SYNTH = synth.shares(200, synth.LAYER_SHARES)


@query(rows_sql("kind VARCHAR, name VARCHAR, n BIGINT", [*(("layer", k, n) for k, n in (("ods", 64), ("dwd", 56), ("dws", 36), ("ads", 24), ("dim", 20), ("tmp", 3))), *(("shape", k, n) for k, n in (("simple", 40), ("join", 25), ("window", 15), ("agg", 10), ("self_dep", 5), ("tmp_chain", 6), ("lateral", 2)))]))
def synth_counts(spark, sf):
    paths = synth.stored(spark, folder(spark, "synth"), 200, 100)
    layers = spark.read.parquet(paths["tables"]).groupBy(F.lit("layer").alias("kind"), F.col("layer").alias("name")).agg(F.count("*").alias("n"))
    shapes = spark.read.parquet(paths["statements"]).groupBy(F.lit("shape").alias("kind"), F.regexp_extract("sql_id", r"^(\w+)_\d+$", 1).alias("name")).agg(F.count("*").alias("n"))
    return layers.unionByName(shapes)


# --- parser and rebuilds ------------------------------------------------------------------------------------------------


def corpus(spark: SparkSession) -> list[tuple[str, lineage.Parsed]]:
    return lineage.parse_all(spark, [(k, c.sql) for k, c in CASES.items()], SCHEMA)


@query(rows_sql("sql_id VARCHAR, parse_status VARCHAR, reason VARCHAR, target VARCHAR", [(k, c.status, c.reason, c.target) for k, c in CASES.items()]))
def parse_corpus(spark, sf):
    return lineage.tables_of(spark, corpus(spark))[1].select("sql_id", "parse_status", "reason", "target")


@query(rows_sql("sql_id VARCHAR, src_table VARCHAR, dst_table VARCHAR, is_self_loop BOOLEAN, confidence VARCHAR", [(k, s, c.target, s == c.target, "high" if c.status == "success" else "medium") for k, c in CASES.items() for s in c.sources.split()]))
def table_lineage(spark, sf):
    return lineage.tables_of(spark, corpus(spark))[0].filter("edge_level = 'table'").select("sql_id", "src_table", "dst_table", "is_self_loop", "confidence")


@query(rows_sql("sql_id VARCHAR, source VARCHAR, dst_column VARCHAR", [(k, leaf, column) for k, c in CASES.items() for column, leaves in c.columns.items() for leaf in leaves.split()]))
def column_lineage(spark, sf):
    return lineage.tables_of(spark, corpus(spark))[0].filter("edge_level = 'column'").select("sql_id", F.concat_ws(".", "src_table", "src_column").alias("source"), "dst_column")


@query(rows_sql("sql_id VARCHAR, where_has VARCHAR, on_has VARCHAR", [("trips", "next_stop", ""), ("line_day", "day", "line"), ("priced", "", "zone_to"), ("cube", "", ""), ("card_total", "", "")]))
def condition_texts(spark, sf):
    edges = lineage.tables_of(spark, corpus(spark))[0].filter("edge_level = 'table' and sql_id in ('trips', 'line_day', 'priced', 'cube', 'card_total')")
    each = edges.groupBy("sql_id").agg(F.max("filter_cond").alias("w"), F.max("join_cond").alias("o"))
    first = lambda c, *words: F.when(F.col(c) == "", "").otherwise(F.coalesce(*(F.when(F.contains(F.col(c), F.lit(w)), w) for w in words)))
    return each.select("sql_id", first("w", "next_stop", "day").alias("where_has"), first("o", "zone_to", "line").alias("on_has"))


@query(rows_sql("sql_id VARCHAR, sources VARCHAR", [(k, " ".join(sorted(c.sources.split()))) for k, c in CASES.items() if c.status == "success"]))
def second_reading(spark, sf):
    found = [(k, " ".join(sorted(lineage.sources_of(c.sql)))) for k, c in CASES.items() if c.status == "success"]
    return spark.createDataFrame(found, "sql_id string, sources string")


@query(rows_sql("full_name VARCHAR, column_name VARCHAR, ids BIGINT", [(t, "", 1) for t in sorted({c.target for c in CASES.values() if c.sources} | {s for c in CASES.values() for s in c.sources.split()})]))
def lineage_nodes(spark, sf):
    edges = lineage.tables_of(spark, corpus(spark))[0].filter("edge_level = 'table'")
    return lineage.nodes_of(edges).groupBy("full_name", "column_name").agg(F.countDistinct("node_id").alias("ids"))


#: What is left of the demo warehouse's table edges once its two temporary tables are folded, by hand.
FOLDED = [
    ("trips", "feed.taps", "core.trips", True), ("prices", "core.trips", "core.trip_prices", True), ("prices", "feed.fares", "core.trip_prices", True), ("prices", "feed.stops", "core.trip_prices", True),
    ("line_day", "core.trips", "mart.line_day", False), ("line_day", "feed.lines", "mart.line_day", False), ("card_total", "core.trip_prices", "mart.card_total", False), ("card_total", "mart.card_total", "mart.card_total", False),
    ("cube", "feed.stops", "mart.zone_cube", False), ("cube", "feed.taps", "mart.zone_cube", False), ("ranking", "mart.line_day", "show.ranking", False), ("nested", "mart.line_day", "show.ranking", False),
    ("line_modes", "feed.lines", "show.line_modes", False), ("kept", "feed.taps", "core.taps_kept", False), ("notes", "core.trips", "show.notes", False), ("notes", "feed.stops", "show.notes", False), ("notes", "mart.card_total", "show.notes", False),
    ("view", "mart.card_total", "show.cheap", False), ("made", "feed.lines", "show.operators", False), ("unknown_table", "feed.refunds", "core.taps_kept", False), ("unknown_column", "feed.taps", "core.taps_kept", False),
]
EDGE_COLUMNS = "sql_id VARCHAR, src VARCHAR, dst VARCHAR, is_derived BOOLEAN"
_BUILT: dict[str, rebuild.Warehouse] = {}


def built(spark: SparkSession) -> rebuild.Warehouse:
    """The demo warehouse after a full rebuild; once a session."""
    app = spark.sparkContext.applicationId
    if app not in _BUILT:
        w = rebuild.Warehouse(spark, folder(spark, "warehouse"))
        rebuild.full_rebuild(w, spark.createDataFrame([(k, c.sql, True) for k, c in CASES.items()], "sql_id string, sql_text string, is_active boolean"), SCHEMA)
        _BUILT[app] = w
    return _BUILT[app]


def table_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("edge_level = 'table'").select("sql_id", "src", "dst", "is_derived")


@query(rows_sql(EDGE_COLUMNS, FOLDED))
def full_rebuild(spark, sf):
    return table_edges(built(spark).edges)


@query(walks(f"e AS (SELECT DISTINCT src, dst FROM ({rows_sql(EDGE_COLUMNS, FOLDED)})),", 12) + "SELECT * FROM k")
def rebuilt_closure(spark, sf):
    return built(spark).closure


@query(rows_sql("parse_status VARCHAR, n BIGINT", [("success", 14), ("degraded", 3), ("failed", 3)]))
def rebuilt_statuses(spark, sf):
    return built(spark).statuses.groupBy("parse_status").agg(F.count("*").alias("n"))


@query(rows_sql("sql_id VARCHAR, source VARCHAR, target VARCHAR", [("trips", "feed.taps.card", "core.trips.card"), ("trips", "feed.taps.line", "core.trips.line"), ("trips", "feed.taps.stop", "core.trips.stop"), ("trips", "feed.taps.stop", "core.trips.next_stop"), ("trips", "feed.taps.card", "core.trips.next_stop"), ("trips", "feed.taps.tapped_at", "core.trips.next_stop"), ("trips", "feed.taps.tapped_at", "core.trips.minutes"), ("trips", "feed.taps.card", "core.trips.minutes")]))
def folded_columns(spark, sf):
    return built(spark).edges.filter("edge_level = 'column' and sql_id = 'trips'").select("sql_id", F.col("src").alias("source"), F.col("dst").alias("target"))


CHANGED = [(i, "feed.refunds" if i == "trips" else s, d, f) for i, s, d, f in FOLDED if i != "view"] + [("view", "feed.lines", "show.cheap", False), ("fresh", "show.ranking", "show.more", False)]


@query(rows_sql(EDGE_COLUMNS, CHANGED))
def incremental_rebuild(spark, sf):
    """One statement of a chain through a temporary table, one view and one new statement changed; the edges of a full rebuild."""
    w = rebuild.Warehouse(spark, folder(spark, "warehouse"))
    full = [(k, c.sql) for k, c in CASES.items()]
    rebuild.incremental(w, full, SCHEMA)
    rebuild.incremental(w, [("legs", "INSERT OVERWRITE TABLE tmp_trips.legs SELECT card FROM feed.refunds"), ("view", "CREATE VIEW show.cheap AS SELECT line FROM feed.lines"), ("fresh", "CREATE TABLE show.more AS SELECT line FROM show.ranking")], SCHEMA)
    return table_edges(w.edges)


@query(rows_sql("run_type VARCHAR, status VARCHAR, error VARCHAR", [("full", "success", None), ("full", "aborted", "too much"), ("incremental", "failed", "broken")]))
def run_log(spark, sf):
    w = rebuild.Warehouse(spark, folder(spark, "runs"))
    with w.run("full") as stats:
        stats["n"] = 1
    with w.run("full"):
        raise rebuild.Aborted("too much")
    try:
        with w.run("incremental"):
            raise ValueError("broken")
    except ValueError:
        pass
    return w.runs().select("run_type", "status", "error")


@query("SELECT * FROM (SELECT 'first' AS step, (SELECT count(*) FROM nation) AS n, NULL AS refused UNION ALL SELECT 'refused', (SELECT count(*) FROM nation), true UNION ALL SELECT 'second', (SELECT count(*) FROM customer), false UNION ALL SELECT 'back', (SELECT count(*) FROM nation), NULL) t")
def swap_generations(spark, sf):
    g, nation, customer = Generations(spark, folder(spark, "generations")), table(spark, sf, "nation"), table(spark, sf, "customer")
    g.swap({"a": g.write_shadow("a", nation), "b": g.write_shadow("b", nation)})
    rows = [("first", g.current("a").count(), None)]
    shadows = {"a": g.write_shadow("a", customer), "b": g.write_shadow("b", nation)}
    rows.append(("refused", g.current("a").count(), g.swap_guarded(shadows, {"a": 0.2, "b": 0.1}) is not None))
    refused = g.swap_guarded(shadows, {"b": 0.1}) is not None
    rows.append(("second", g.current("a").count(), refused))
    g.rollback()
    return spark.createDataFrame([*rows, ("back", g.current("a").count(), None)], "step string, n long, refused boolean")


# --- sinks --------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN c_mktsegment ELSE lower(c_mktsegment) END AS c_mktsegment, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS c_acctbal FROM customer")
def merged_metadata(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return diff.merged(c.filter("c_custkey % 4 <> 0"), c.filter("c_custkey % 4 <> 1").withColumn("c_mktsegment", F.lower("c_mktsegment")), ["c_custkey"], ["c_mktsegment"])


@query("SELECT CAST(count(*) AS BIGINT) AS columns, CAST(count(*) FILTER (p_size % 7 = 0 OR p_size % 5 = 0) AS BIGINT) AS blank FROM part")
def blank_comments(spark, sf):
    return quality.blank_comments(table(spark, sf, "part").select(F.when(F.col("p_size") % 7 == 0, "  ").when(F.col("p_size") % 5 == 0, None).otherwise(F.col("p_name")).alias("comment")))


@query("SELECT src_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'manual' WHEN 'R' THEN 'ingest_map' END AS src_type FROM lineitem WHERE l_returnflag IN ('A', 'R') UNION ALL SELECT 'sql' FROM orders) t GROUP BY 1")
def kept_edges(spark, sf):
    old = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.when(F.col("l_returnflag") == "A", "manual").when(F.col("l_returnflag") == "R", "ingest_map").otherwise("sql").alias("src_type"))
    new = table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.lit("sql").alias("src_type"))
    return diff.preserved(old, new).groupBy("src_type").agg(F.count("*").alias("n"))


@query("""SELECT src, dst, src_type, confidence FROM (SELECT c_custkey AS src, c_nationkey AS dst, CASE WHEN c_custkey % 2 = 0 THEN 'manual' ELSE 'sql' END AS src_type, 'high' AS confidence FROM customer WHERE c_custkey % 2 = 1 OR c_nationkey >= 5
UNION ALL SELECT DISTINCT s_suppkey, s_nationkey, 'manual', 'medium' FROM supplier WHERE s_nationkey < 5
UNION ALL SELECT c_custkey, c_nationkey, 'manual', 'high' FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey < 5 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier)) t""")
def manual_lineage(spark, sf):
    edge = lambda df, a, b: df.select(F.col(a).alias("src"), F.col(b).cast("long").alias("dst"), F.lit("table").alias("edge_level"))
    old = edge(table(spark, sf, "customer"), "c_custkey", "c_nationkey").withColumns({"src_type": F.when(F.col("src") % 2 == 0, "manual").otherwise("sql"), "confidence": F.lit("high"), "is_self_loop": F.lit(False)})
    new = edge(table(spark, sf, "supplier").filter("s_nationkey < 5"), "s_suppkey", "s_nationkey")
    once = diff.manual_edges(old, new)
    return diff.manual_edges(once, new).select("src", "dst", "src_type", "confidence")  # twice: nothing more happens


@query("SELECT r_name AS term, CASE r_regionkey WHEN 0 THEN 'deprecated' ELSE 'active' END AS status, r_regionkey = 0 AS certified FROM region UNION ALL SELECT 'new term', 'pending_review', false")
def glossary_changes(spark, sf):
    now = F.lit(datetime.datetime(2024, 1, 1))
    own = table(spark, sf, "region").select(F.col("r_name").alias("term"), F.lit("d").alias("domain"), F.lit("active").alias("status"), F.lit(False).alias("certified"), now.alias("updated_at"))
    more = portal.glossary_created(own, {"term": "new term", "domain": "d"})
    for bad, error in ((lambda: portal.glossary_created(more, {"term": "new term", "domain": "d"}), portal.Conflict), (lambda: portal.glossary_patched(more, "AFRICA", "d", {"term": "x"}), ValueError)):
        try:
            bad()
            raise AssertionError("not refused")
        except error:
            pass
    return portal.glossary_patched(more, "AFRICA", "d", {"status": "deprecated", "certified": True}).select("term", "status", "certified")


@query(rows_sql("user_id VARCHAR, rating INTEGER, comment VARCHAR", [("a", 1, "good"), ("b", 0, "")]))
def feedback_log(spark, sf):
    path = folder(spark, "feedback")
    portal.append_feedback(spark, path, "a", 1, "good")
    portal.append_feedback(spark, path, "b", 0)
    return spark.read.parquet(path).select("user_id", "rating", "comment")


# --- reads of a portal --------------------------------------------------------------------------------------------------


@query("SELECT p_name || p_partkey AS term FROM part WHERE (p_name ILIKE '%BLUE%' OR p_type ILIKE '%BLUE%') AND p_size > 10 ORDER BY p_size DESC, 1 LIMIT 200")
def glossary_page(spark, sf):
    own = table(spark, sf, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("term"), F.col("p_type").alias("caliber"), F.lit("d").alias("domain"), F.when(F.col("p_size") > 10, "active").otherwise("deprecated").alias("status"), F.col("p_size").alias("updated_at"))
    return portal.glossary_list(own, "BLUÉ", domain="d", status="active").select("term")


@query("SELECT 'j' || o_orderkey AS task_id, left(repeat(o_orderpriority, 300), 2000) AS sql_text FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey % 3 = 0 ORDER BY o_orderdate DESC, 1 LIMIT 100")
def failed_queue(spark, sf):
    statements = table(spark, sf, "orders").select(key("j", "o_orderkey").alias("task_id"), F.repeat("o_orderpriority", F.lit(300)).alias("sql_text"), (F.col("o_orderkey") % 3 == 0).alias("is_active"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "degraded").otherwise("success").alias("parse_status"), F.col("o_orderdate").alias("updated_at"))
    return portal.failed_queue(statements).select("task_id", "sql_text")


@query("SELECT c_name AS full_name, c_mktsegment AS domain, (SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = 7) AS cols, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT 'j' || o_orderkey AS k FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F')) AS tasks FROM customer WHERE c_custkey = 7")
def table_card(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    columns = o.select(F.col("c_name").alias("full_name"), F.col("o_orderpriority").alias("column_name")).distinct()
    statements = o.select(F.col("c_name").alias("target_table"), key("j", "o_orderkey").alias("task_id"), (F.col("o_orderstatus") == "F").alias("is_active"))
    name = c.filter("c_custkey = 7").first().c_name
    info = portal.table_info(c.select(F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("domain")), columns, statements, name)
    return spark.createDataFrame([(info["full_name"], info["domain"], ",".join(x["column_name"] for x in info["columns"]), ",".join(info["tasks"]) or None)], "full_name string, domain string, cols string, tasks string")


@query("""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS BIGINT) AS covered,
(SELECT CAST(count(*) AS BIGINT) FROM orders) AS edges, (SELECT CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) FROM orders) AS medium, (SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT o_orderstatus || ':' || count(*) AS x FROM orders GROUP BY o_orderstatus)) AS parses
FROM customer WHERE c_acctbal >= 0""")
def dashboard(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    tables = c.select(key("c:", "c_custkey").alias("full_name"), F.lit("dwd").alias("layer"), F.col("c_mktsegment").alias("domain"), F.lit("o").alias("owner"), (F.col("c_acctbal") >= 0).alias("is_online"))
    edges = o.select(key("c:", "o_custkey").alias("dst"), F.when(F.col("o_orderstatus") == "P", "medium").otherwise("high").alias("confidence"))
    found = portal.dashboard(tables, edges, o.select(F.col("o_orderstatus").alias("parse_status"), F.lit("").alias("reason")))
    parses = ";".join(sorted(f"{r['parse_status']}:{r['count']}" for r in found["parses"]))
    return spark.createDataFrame([(found["total"]["total"], found["total"]["covered"], found["confidence"]["total"], found["confidence"]["medium"], parses)], "total long, covered long, edges long, medium long, parses string")


@query(rows_sql("kind VARCHAR, level INTEGER, src VARCHAR, dst VARCHAR", [("lineage", 1, "core.trip_prices", "mart.card_total"), ("lineage", 1, "mart.card_total", "mart.card_total"), ("lineage", 2, "core.trips", "core.trip_prices"), ("lineage", 2, "feed.fares", "core.trip_prices"), ("lineage", 2, "feed.stops", "core.trip_prices"), ("lineage", 3, "feed.taps", "core.trips")]))
def degraded_answer(spark, sf):
    found = spark.createDataFrame([("card_total", "mart.card_total", "f", 1), ("cards", "mart.card_total", "f", 2)], "candidate string, node string, family string, rank_in_family int")
    edges = spark.createDataFrame([(s, d, "high") for _, s, d, _ in FOLDED], "src string, dst string, confidence string").distinct()
    out = portal.answer(found, edges)
    return spark.createDataFrame([(out["kind"], h["level"], h["src"], h["dst"]) for h in out["hops"]], "kind string, level int, src string, dst string")


@query(rows_sql("call INTEGER, answer VARCHAR, made INTEGER", [(1, "error", 1), (2, "ok", 2), (3, "ok", 2)]))
def cached_answers(spark, sf):
    now, made = datetime.datetime(2024, 1, 1, 2, 59, 30), []
    cache = portal.Cache(3, lambda: now)
    make = lambda: made.append(1) or ({"error": 1} if len(made) == 1 else {"ok": 1})
    return spark.createDataFrame([(k, next(iter(cache.get("k", make))), len(made)) for k in (1, 2, 3)], "call int, answer string, made int")


# --- graphs -------------------------------------------------------------------------------------------------------------


@query("SELECT 'n:3' AS src, 'c:' || c_custkey AS dst FROM customer WHERE c_nationkey = 3 AND 'c:' || c_custkey IN (SELECT x FROM (SELECT 'c:' || c_custkey AS x FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 's:' || s_suppkey FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'n:3') ORDER BY x <> 'n:3', x LIMIT 9) UNION ALL SELECT 'n:3', 's:' || s_suppkey FROM supplier WHERE s_nationkey = 3 AND 's:' || s_suppkey IN (SELECT x FROM (SELECT 'c:' || c_custkey AS x FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 's:' || s_suppkey FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'n:3') ORDER BY x <> 'n:3', x LIMIT 9)")
def capped_lineage(spark, sf):
    """The first nine nodes by level and name; n:3 is one of them by name or not, as the SQL says."""
    hops = graph.lineage(dag(spark, sf), spark.createDataFrame([("n:3",)], "node string"), depth=1)
    start = hops.withColumn("level", F.lit(1)).unionByName(spark.createDataFrame([("n:3", "n:3", 0)], "src string, dst string, level int"))
    return graph.capped(start, 9)[0].filter("src <> dst").select("src", "dst")


@query(f"""WITH RECURSIVE {RING_SQL}
p(node, path) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)] UNION ALL SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.node WHERE NOT list_contains(p.path, e.dst) AND len(p.path) < 7),
b AS (SELECT path FROM p WHERE node = 30 ORDER BY len(path), path LIMIT 1),
h AS (SELECT CAST(i AS INTEGER) AS hop, path[i] AS src, path[i + 1] AS dst FROM (SELECT path, unnest(range(1, len(path))) AS i FROM b)),
d AS (SELECT o_custkey % 40 AS src, (o_custkey * 7 + o_orderkey % 3) % 40 AS dst, arg_min(o_orderpriority, o_orderkey) AS transform_expr, arg_min('f' || o_orderkey, o_orderkey) AS filter_cond, arg_min('q' || o_custkey, o_orderkey) AS sql_id, arg_min(CASE WHEN o_orderstatus = 'P' THEN 'medium' ELSE 'high' END, o_orderkey) AS confidence FROM orders GROUP BY 1, 2)
SELECT hop, src, dst, transform_expr, filter_cond, sql_id, confidence FROM h JOIN d USING (src, dst)""")
def path_details(spark, sf):
    o = table(spark, sf, "orders")
    edges = o.select((F.col("o_custkey") % 40).alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 3) % 40).alias("dst"), F.col("o_orderkey").alias("edge_id"), F.col("o_orderpriority").alias("transform_expr"), key("f", "o_orderkey").alias("filter_cond"), key("q", "o_custkey").alias("sql_id"), F.when(F.col("o_orderstatus") == "P", "medium").otherwise("high").alias("confidence"))
    return graph.path_details(graph.shortest_path(ring(spark, sf), 1, 30), edges)


@query(walks(DAG, 5) + "SELECT descendant, min_hops, path_cnt, c_mktsegment AS layer, CAST(c_nationkey AS VARCHAR) AS domain, c_name AS owner FROM (SELECT descendant, min_hops, path_cnt FROM k WHERE ancestor = 'r:2' ORDER BY min_hops, descendant LIMIT 40) x LEFT JOIN customer ON descendant = 'c:' || c_custkey")
def impact_card(spark, sf):
    closed = graph.closure(links(spark, sf), spark.createDataFrame([("r:2",)], "src string"))
    about = table(spark, sf, "customer").select(key("c:", "c_custkey").alias("full_name"), F.col("c_mktsegment").alias("layer"), F.col("c_nationkey").cast("string").alias("domain"), F.col("c_name").alias("owner"))
    return graph.impact(closed, "r:2", 1, 40, about)


@query(walks(DAG, 5) + "SELECT 'n' || c_nationkey AS task, CAST(count(DISTINCT descendant) AS BIGINT) AS affected FROM k JOIN customer ON descendant = 'c:' || c_custkey WHERE ancestor = 'r:2' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2 OFFSET 2")
def impact_task_page(spark, sf):
    closed = graph.closure(links(spark, sf), spark.createDataFrame([("r:2",)], "src string"))
    owners = table(spark, sf, "customer").select(key("c:", "c_custkey").alias("descendant"), key("n", "c_nationkey").alias("task"))
    return graph.impact_by(closed, "r:2", owners, page=2, size=2)


@query("SELECT CAST(1 AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS hops, CAST(count(*) FILTER (s_suppkey % 4 = 0) AS BIGINT) AS unsure, string_agg('n:' || s_nationkey || ' > s:' || s_suppkey, '; ' ORDER BY 'n:' || s_nationkey || ' > s:' || s_suppkey) FILTER (s_suppkey % 4 = 0) AS to_check FROM supplier")
def lineage_card(spark, sf):
    hops = table(spark, sf, "supplier").select(F.lit(1).alias("level"), key("n:", "s_nationkey").alias("src"), key("s:", "s_suppkey").alias("dst"), F.when(F.col("s_suppkey") % 4 == 0, "medium").alias("confidence"))
    return graph.card(hops)


def chain_edges(spark, sf) -> DataFrame:
    """region → nation → customer → order with nations and customers temporary."""
    pairs = dag(spark, sf).filter("dst not like 'p:%' and dst not like 's:%'")
    return pairs.withColumns({"edge_id": F.concat_ws(">", "src", "dst"), "sql_id": F.col("dst"), "src_type": F.lit("sql"), "confidence": F.when(F.col("dst").endswith("7"), "low").otherwise("high"), "transform_expr": F.concat(F.lit("f("), "dst", F.lit(")")), "filter_cond": F.col("src"), "join_cond": F.lit("")})


CHAINS = """SELECT 'r:' || n_regionkey AS src, 'o:' || o_orderkey AS dst, 'o:' || o_orderkey AS sql_id, CASE WHEN 'n:' || n_nationkey LIKE '%7' OR 'c:' || c_custkey LIKE '%7' OR 'o:' || o_orderkey LIKE '%7' THEN 'low' ELSE 'high' END AS confidence,
'f(o:' || o_orderkey || ') (through tmp: f(n:' || n_nationkey || ') ; f(c:' || c_custkey || '))' AS transform_expr, 'c:' || c_custkey AS filter_cond, true AS is_derived
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


@query(CHAINS)
def fold_chain(spark, sf):
    """Chains through two temporary tables; inner expressions stand in the chain's order."""
    edges = chain_edges(spark, sf)
    tmp = edges.filter("dst like 'n:%' or dst like 'c:%'").select(F.col("dst").alias("node")).distinct()
    return fold.folded_edges(edges, tmp).select("src", "dst", "sql_id", "confidence", "transform_expr", "filter_cond", "is_derived")


@query("SELECT 'r:' || n_regionkey AS src, 'c:' || c_custkey AS dst, true AS is_derived FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 UNION ALL SELECT 'r:' || n_regionkey, 'n:' || n_nationkey, false FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, false FROM customer WHERE c_custkey % 2 = 1")
def fold_task(spark, sf):
    """One task's statements: only complete chains among them give way; the rest stays as it is."""
    edges = chain_edges(spark, sf).filter("dst like 'n:%' or dst like 'c:%'").withColumn("sql_id", F.when(F.col("dst").startswith("n:") | (F.substring("dst", 3, 20).cast("long") % 2 == 0), "mine").otherwise("other"))
    tmp = edges.filter("dst like 'n:%'").select(F.col("dst").alias("node")).distinct()
    out = fold.folded_task(edges, tmp, spark.createDataFrame([("mine",)], "sql_id string"))
    return out.select("src", "dst", F.coalesce("is_derived", F.lit(False)).alias("is_derived"))


@query("SELECT p_partkey, p_size = 3 OR p_partkey % 3 = 0 AS is_tmp FROM part")
def tmp_by_catalogue(spark, sf):
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit("db.temp_x")).otherwise(F.lit("db.x"))
    return table(spark, sf, "part").select("p_partkey", C.is_tmp(name, F.when(F.col("p_size") == 3, "tmp").when(F.col("p_size") == 4, "ods")).alias("is_tmp"))


# --- governed metrics ---------------------------------------------------------------------------------------------------

#: (case, SQL, whether it may run)
GUARDED = [
    ("plain", "SELECT a, count(*) FROM x.t WHERE b > 1 GROUP BY a LIMIT 5", True), ("cte", "WITH c AS (SELECT a FROM x.t) SELECT a FROM c LIMIT 5", True), ("subquery", "SELECT a FROM x.t WHERE a IN (SELECT b FROM x.u) LIMIT 5", True),
    ("no limit", "SELECT a FROM x.t", False), ("inner limit", "SELECT a FROM (SELECT a FROM x.t LIMIT 5) y", False), ("union", "SELECT a FROM x.t UNION ALL SELECT b FROM x.u LIMIT 5", False), ("two", "SELECT 1 LIMIT 1; SELECT 2 LIMIT 1", False),
    ("drop", "DROP TABLE x.t", False), ("insert", "INSERT INTO x.t SELECT 1", False), ("lock", "SELECT a FROM x.t LIMIT 5 FOR UPDATE", False), ("broken", "SELEC a", False), ("barred", "SELECT a FROM X.Secret LIMIT 5", False),
    ("reflect", "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM x.t LIMIT 1", False), ("own function", "SELECT my_udf(a) FROM x.t LIMIT 1", False),
]


@query(rows_sql("name VARCHAR, allowed BOOLEAN", [(n, ok) for n, _, ok in GUARDED]))
def guard_cases(spark, sf):
    def allowed(sql: str) -> bool:
        try:
            M.guard_select(spark, sql, {"x.secret"})
            return True
        except M.Rejected:
            return False

    return spark.createDataFrame([(n, allowed(sql)) for n, sql, _ in GUARDED], "name string, allowed boolean")


#: (SQL, scope, what runs; none: refused)
SCOPED = [("SELECT a FROM x.t", "x.t", "SELECT a FROM x.t\nLIMIT 1000"), ("SELECT a FROM x.t LIMIT 3", "x.t x.u", "SELECT a FROM x.t LIMIT 3"), ("SELECT a FROM t", "x.t", None), ("SELECT a FROM x.u", "x.t", None), ("SELECT a FROM x.t", "", None), ("SELECT a FROM x.t", "a.a a.b a.c a.d a.e x.t", None), ("WITH c AS (SELECT 1 AS a) SELECT a FROM c", "x.t", None)]


@query(rows_sql("asked VARCHAR, scope VARCHAR, runs VARCHAR", SCOPED))
def scope_cases(spark, sf):
    def runs(sql: str, scope: str) -> str | None:
        try:
            return M.guard_scope(spark, sql, scope.split())
        except M.Rejected:
            return None

    return spark.createDataFrame([(q, s, runs(q, s)) for q, s, _ in SCOPED], "asked string, scope string, runs string")


PEOPLE = M.Metric.of({"metric": "spent", "base_table": "customer", "expression": "SUM(base.c_acctbal)", "dimensions": {"segment": {"column": "base.c_mktsegment"}, "cust_no": {"column": "base.c_custkey", "sensitivity": "L3"}, "id_card": {"column": "base.c_name", "sensitivity": "L4"}}, "row_policy": "base.c_nationkey IN :nations"})
ALLOWED = {"nations": [1, 2], "sensitive_whitelist": ["cust_no"], "user_id": "u"}
#: (case, plan, user, outcome)
PLANS = [
    ("plain", {"dimensions": ["segment"]}, ALLOWED, "ok"), ("customer", {"filters": [{"field": "cust_no", "op": "eq", "value": 1}]}, ALLOWED, "ok, about customers"), ("unknown field", {"dimensions": ["nope"]}, ALLOWED, "PlanError"),
    ("unknown operator", {"filters": [{"field": "segment", "op": "near", "value": 1}]}, ALLOWED, "PlanError"), ("empty list", {"filters": [{"field": "segment", "op": "in", "value": []}]}, ALLOWED, "PlanError"), ("order by nothing", {"order_by": [{"field": "segment", "dir": "up"}]}, ALLOWED, "PlanError"),
    ("never", {"dimensions": ["id_card"]}, ALLOWED, "PermissionDenied"), ("no permit", {"dimensions": ["cust_no"]}, {"nations": [1]}, "PermissionDenied"), ("filter without permit", {"filters": [{"field": "cust_no", "op": "eq", "value": 1}]}, {"nations": [1]}, "PermissionDenied"), ("no rows allowed", {}, {"nations": []}, "PermissionDenied"),
]


@query(rows_sql("name VARCHAR, outcome VARCHAR", [(n, out) for n, _, _, out in PLANS]))
def plan_cases(spark, sf):
    def outcome(plan: dict, user: dict) -> str:
        try:
            return "ok, about customers" if M.compile_plan(PEOPLE, plan, user).customer_query else "ok"
        except (M.PlanError, M.PermissionDenied) as e:
            return type(e).__name__

    return spark.createDataFrame([(n, outcome(p, u)) for n, p, u, _ in PLANS], "name string, outcome string")


@query("""SELECT 'semantic' AS channel, 'ok' AS status, 'u' AS user_id, CAST(1 AS INTEGER) AS row_count, round(sum(c_acctbal), 2) AS answer FROM customer WHERE c_nationkey IN (1, 2)
UNION ALL SELECT 'semantic', 'masked', 'u', CAST((SELECT count(*) FROM customer WHERE c_nationkey IN (1, 2)) AS INTEGER), NULL UNION ALL SELECT 'semantic', 'refused', NULL, NULL, NULL""")
def metric_receipts(spark, sf):
    views(spark, sf)
    path, m = folder(spark, "audit"), {"spent": PEOPLE}
    first = M.query_metric(spark, m, {"metric": "spent"}, ALLOWED, path)
    M.query_metric(spark, m, {"metric": "spent", "dimensions": ["cust_no"]}, ALLOWED, path)
    M.query_metric(spark, m, {"metric": "spent"}, {}, path)
    answer = F.when(F.col("status") == "ok", F.lit(round(first["data"]["rows"][0][0], 2)))
    return spark.read.parquet(path).select("channel", "status", "user_id", "row_count", answer.cast("double").alias("answer"))


@query("SELECT 'ok' AS status, CAST(5 AS INTEGER) AS row_count, 'u' AS user_id, NULL AS answer UNION ALL SELECT 'refused', NULL, 'u', NULL UNION ALL SELECT 'answer', CAST(1 AS INTEGER), NULL, (SELECT count(*) FROM nation)")
def adhoc_receipts(spark, sf):
    path, db = folder(spark, "audit"), f"adhoc_{uuid.uuid4().hex}"
    views(spark, sf)
    spark.sql(f"CREATE DATABASE {db}")
    try:
        spark.sql(f"CREATE VIEW {db}.n AS SELECT * FROM parquet.`{sf}/nation.parquet`")
        M.query_adhoc(spark, "five nations", [f"{db}.n"], lambda q, c: f"SELECT n_name FROM {db}.n LIMIT 5", {"user_id": "u"}, path)
        M.query_adhoc(spark, "something else", [f"{db}.n"], lambda q, c: "SELECT * FROM other.t", {"user_id": "u"}, path)
        out = M.query_adhoc(spark, "how many", [f"{db}.n"], lambda q, c: f"SELECT count(*) AS n FROM {db}.n" if "n_name string" in c else "no context")
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")
    own = spark.read.parquet(path).select("status", "row_count", "user_id", F.lit(None).cast("long").alias("answer"))
    return own.unionByName(spark.createDataFrame([("answer", out["data"]["row_count"], None, out["data"]["rows"][0][0])], "status string, row_count int, user_id string, answer long"))


@query("WITH f AS (SELECT 's:' || s_suppkey AS node, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'n:' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'r:' || r_regionkey, r_regionkey FROM region), g AS (SELECT r, min(node) AS family, min(node) FILTER (node LIKE 's:%') AS anchor FROM f GROUP BY r) SELECT coalesce(anchor, family) AS node FROM g ORDER BY family LIMIT 5")
def adhoc_scope(spark, sf):
    found = families(spark, sf).withColumn("node", F.col("candidate"))
    return spark.createDataFrame([(t,) for t in M.scope_of(found)], "node string")


# --- quality ------------------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 <> 0 THEN 't' || o_custkey END AS target, list_sort(list_distinct(list('p' || l_partkey))) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT k, CASE WHEN k % 50 <> 0 THEN 't' || CASE WHEN k % 11 = 0 THEN 'x' ELSE target[2:] END END AS target, list_filter(s, lambda x: CAST(x[2:] AS BIGINT) % 7 <> 0) || CASE WHEN k % 13 = 0 THEN ['more'] ELSE [] END AS s FROM g)
SELECT CAST(k AS VARCHAR) AS case_id, CASE WHEN g.target IS NULL THEN true ELSE g.target = m.target AND len(g.s) = len(list_intersect(g.s, m.s)) AND len(m.s) = len(list_intersect(g.s, m.s)) END AS agrees FROM g JOIN m USING (k)""")
def gold_tables(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    own = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_orderkey", "o_custkey").agg(F.sort_array(F.collect_set(key("p", "l_partkey"))).alias("sources"))
    named, k = F.col("o_orderkey") % 50 != 0, F.col("o_orderkey")
    gold = own.select(k.cast("string").alias("case_id"), F.when(named, key("t", "o_custkey")).alias("target"), "sources", F.lit(False).alias("failed"))
    sources = F.concat(F.filter("sources", lambda x: F.substring(x, 2, 20).cast("long") % 7 != 0), F.when(k % 13 == 0, F.array(F.lit("more"))).otherwise(F.array().cast("array<string>")))
    machine = own.select(k.cast("string").alias("case_id"), F.when(named, F.when(k % 11 == 0, "tx").otherwise(key("t", "o_custkey"))).alias("target"), sources.alias("sources"), (~named).alias("failed"))
    return quality.table_compared(gold, machine).select("case_id", "agrees")


@query("SELECT 'tables' AS what, CAST(100 AS BIGINT) AS n, true AS accepted UNION ALL SELECT 'mistakes found', CAST(1 AS BIGINT), NULL")
def gold_tampered(spark, sf):
    """A gold standard with one mistake made on purpose: the comparison finds that one."""
    machine = both_sides(spark, sf)[1].filter("case_id < '2'")
    gold = quality.tampered(machine.drop("place")).join(machine.select("case_id", "dst_col", "src_table", "src_col").distinct(), ["case_id", "dst_col", "src_table", "src_col"], "left_semi")
    verdicts = quality.compared(gold, machine.drop("place"))
    tables = spark.range(100).select(F.lit(True).alias("agrees"))
    _, accepted = quality.gold_report(tables, verdicts.filter("verdict = 'matched'").limit(50))
    return spark.createDataFrame([("tables", 100, accepted), ("mistakes found", verdicts.filter("verdict <> 'matched'").count(), None)], "what string, n long, accepted boolean")


@query("SELECT * FROM (VALUES (1.0, 0.9643, true), (0.98, 1.0, false), (0.99, 0.95, true), (1.0, 0.9499, false)) t(tables, edges, accepted)".replace("(1.0, 0.9643", "(CAST(1.0 AS DOUBLE), CAST(0.9643 AS DOUBLE)"))
def gold_accepted(spark, sf):
    return spark.createDataFrame([(t, e, quality.accepted(t, e)) for t, e in ((1.0, 0.9643), (0.98, 1.0), (0.99, 0.95), (1.0, 0.9499))], "tables double, edges double, accepted boolean")


@query("""WITH n AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, '(' || c_nationkey || ',)' LIMIT 4),
r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('0' || c_custkey), c_custkey) AS rn FROM customer) SELECT c_custkey, c_nationkey FROM r JOIN n ON k = c_nationkey WHERE rn = 1""")
def few_strata(spark, sf):
    """Fewer rows than strata: the largest give one each."""
    return quality.stratified(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey", ["c_nationkey"], 4)


@query("SELECT p_partkey, ['ods', 'dwd', 'other', 'dim'][p_partkey % 4 + 1] AS layer FROM part")
def layer_or_other(spark, sf):
    name = F.concat(F.lit("db."), table_of(("ods_", "d_", "x_", "dim_"), F.col("p_partkey") % 4), "p_name")
    return table(spark, sf, "part").select("p_partkey", quality.layer_or_other(name).alias("layer"))


WEEK = """a AS (SELECT ts, CASE WHEN event_id % 3 = 0 THEN 'adhoc' ELSE 'semantic' END AS channel, CASE WHEN value < 10 THEN 'refused' ELSE 'ok' END AS status, CASE WHEN value < 10 THEN event_type END AS refuse_reason, user_id FROM events),
w AS (SELECT * FROM a WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY)"""


@query(f"""WITH {WEEK},
u AS (SELECT count(*) AS n, count(DISTINCT user_id) AS users, round(count(*) FILTER (status = 'refused') / count(*), 4) AS refused, round(count(*) FILTER (channel = 'semantic') / greatest(count(*), 1), 4) AS semantic FROM w),
c AS (SELECT count(*) AS n, round(count(*) FILTER (l_returnflag = 'A') / count(*), 4) AS medium, round(count(*) FILTER (l_returnflag <> 'N') / count(*), 4) AS unsure FROM lineitem),
s AS (SELECT o_orderstatus AS st, o_orderpriority AS r, count(*) AS n FROM orders GROUP BY ALL),
f AS (SELECT channel, refuse_reason, count(*) AS n FROM w WHERE refuse_reason IS NOT NULL GROUP BY ALL)
SELECT '# Weekly report' AS line UNION ALL SELECT '' UNION ALL SELECT '' UNION ALL SELECT '' UNION ALL SELECT '| status | reason | statements |' UNION ALL SELECT '|-|-|-|' UNION ALL SELECT '| refusal | requests |' UNION ALL SELECT '|-|-|'
UNION ALL SELECT '- requests: ' || n || ', users: ' || users || ', refusal ratio: ' || refused || ', semantic ratio: ' || semantic FROM u
UNION ALL SELECT '- edges: ' || n || ', medium ratio: ' || medium || ', not high: ' || unsure FROM c
UNION ALL SELECT '| ' || st || ' | ' || r || ' | ' || n || ' |' FROM s UNION ALL SELECT '| ' || refuse_reason || ' | ' || n || ' |' FROM f""")
def weekly_lines(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "A", "medium").when(F.col("l_returnflag") == "R", "low").otherwise("high").alias("confidence"))
    statements = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("parse_status"), F.col("o_orderpriority").alias("reason"))
    text = quality.weekly_markdown(audit(spark, sf), edges, statements, last_moment(spark, sf))
    return spark.createDataFrame([(line,) for line in text.split("\n")], "line string")


@query(rows_sql("problem VARCHAR", [("full_run_too_old",), ("last_run_not_successful",), ("closure_empty",)]))
def health_rows(spark, sf):
    now = datetime.datetime(2024, 5, 1)
    runs = spark.createDataFrame([("1", "full", "success", now - datetime.timedelta(hours=50)), ("2", "full", "aborted", now - datetime.timedelta(hours=27)), ("3", "incremental", "success", now)], "run_id string, run_type string, status string, started_at timestamp")
    return quality.health(runs, 0, 200, F.lit(now))


# --- search -------------------------------------------------------------------------------------------------------------


def terms(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, c = table(spark, sf, "part"), table(spark, sf, "customer")
    glossary = p.select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("term"), F.to_json(F.array("p_brand", "p_type")).alias("aliases"), F.when(F.col("p_size") % 9 != 0, "active").otherwise("deprecated").alias("status"), key("t", "p_partkey").alias("ref_table"), F.lit(None).cast("string").alias("caliber"))
    glossary = glossary.withColumn("aliases", search.aliases_of(F.col("aliases")))
    tables = c.select(key("db.", "c_name").alias("full_name"), F.col("c_name").alias("table_name"), F.col("c_mktsegment").alias("comment"), F.when(F.col("c_custkey") % 5 == 0, "tmp").alias("layer"), F.lit("d").alias("domain"), (F.col("c_acctbal") > 0).alias("is_online"))
    columns = c.select(key("db.", "c_name").alias("full_name"), F.when(F.col("c_custkey") % 2 == 0, "Brand#3").otherwise("other_name").alias("column_name"), F.col("c_mktsegment").alias("comment"))
    return glossary, tables, columns


@query("""SELECT 'term' AS kind, p_name || ' ' || p_partkey AS candidate, 't' || p_partkey AS node, CAST(1.0 AS DOUBLE) AS confidence FROM part WHERE p_size % 9 <> 0 AND p_brand = 'Brand#3'
UNION ALL SELECT * FROM (SELECT 'column', 'db.' || c_name || '.Brand#3', 'db.' || c_name, CAST(1.0 AS DOUBLE) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AND c_acctbal > 0 ORDER BY 3 LIMIT 50)""")
def search_exact(spark, sf):
    """A column's name, which is also an alias; case is ignored for names, not for aliases."""
    return search.exact(*terms(spark, sf), "Brand#3")


@query("SELECT 'table' AS kind, 'db.' || c_name AS candidate, 'db.' || c_name AS node, CAST(1.0 AS DOUBLE) AS confidence FROM customer WHERE c_custkey = 3 AND c_acctbal > 0")
def search_name(spark, sf):
    return search.exact(*terms(spark, sf), "CÚSTOMER#000000003")


@query("SELECT 'table' AS kind, 'db.' || c_name AS candidate, 'db.' || c_name AS family, CAST(1 AS INTEGER) AS rank_in_family, false AS ambiguous FROM customer WHERE c_custkey = 3 AND c_acctbal > 0")
def search_families(spark, sf):
    glossary, tables, columns = terms(spark, sf)
    closed = spark.createDataFrame([("db.x", "db.y", 1, 1)], "ancestor string, descendant string, min_hops int, path_cnt long")
    found = search.search(glossary.withColumn("certified", F.lit(False)), tables, columns, closed, "customer#000000003")
    return found.select("kind", "candidate", "family", "rank_in_family", "ambiguous")


@query("SELECT p_partkey, p_brand = 'Brand#3' OR p_type = 'Brand#3' AS has FROM part")
def json_aliases(spark, sf):
    text = F.when(F.col("p_partkey") % 7 == 0, F.to_json(F.array("p_brand", "p_type"))).otherwise(F.concat(F.lit('["'), "p_brand", F.lit('", "'), "p_type", F.lit('"]')))
    return table(spark, sf, "part").select("p_partkey", F.array_contains(search.aliases_of(text), "Brand#3").alias("has"))


VECTOR = "c.c_custkey % 5 <> 0 AND c.c_acctbal > 0"


@query("""SELECT 'term:' || p_name || ' ' || p_partkey AS id, p_name || ' ' || p_partkey AS text, sha1(p_name || ' ' || p_partkey) AS content_hash FROM part WHERE p_size % 9 <> 0
UNION ALL SELECT 'column:db.' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '.Brand#3' ELSE '.other_name' END, c_mktsegment || ' ' || c_mktsegment || ' d', sha1('db.' || c_name || '|' || CASE WHEN c_custkey % 2 = 0 THEN 'Brand#3' ELSE 'other_name' END || '|' || c_mktsegment)
FROM customer c WHERE """ + VECTOR)
def vector_texts(spark, sf):
    return search.vector_texts(*(terms(spark, sf)[k] for k in (0, 2, 1)))[0]


@query(f"SELECT CASE WHEN c_custkey % 3 = 0 THEN 'empty' WHEN c_custkey % 3 = 1 THEN 'too_short' ELSE 'no_increment' END AS reason, CAST(count(*) AS BIGINT) AS n FROM customer c WHERE {VECTOR} GROUP BY 1")
def skip_reasons(spark, sf):
    glossary, tables, columns = terms(spark, sf)
    number = F.substring_index("full_name", "#", -1).cast("long")
    poor = columns.withColumn("comment", F.when(number % 3 == 0, None).when(number % 3 == 1, "ab").otherwise(F.upper("column_name")))
    return search.vector_texts(glossary, poor, tables)[1].withColumnRenamed("count", "n")


def lengths(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding service."""
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query("SELECT p_partkey AS id, CAST(length(p_name) AS DOUBLE) AS x, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS DOUBLE) AS y FROM part")
def embedder_hook(spark, sf):
    found = search.embedded(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), lengths)
    return found.select("id", F.element_at("embedding", 1).alias("x"), F.element_at("embedding", 2).alias("y"))


@query("""SELECT 'first' AS step, CAST(count(*) FILTER (p_partkey % 9 <> 1) AS BIGINT) AS upserted, CAST(0 AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS unchanged FROM part
UNION ALL SELECT 'second', count(*) FILTER (p_partkey % 9 = 1 OR p_partkey % 9 = 2), count(*) FILTER (p_partkey % 9 = 0), count(*) FILTER (p_partkey % 9 > 2) FROM part UNION ALL SELECT 'held', count(*) FILTER (p_partkey % 9 <> 0), NULL, NULL FROM part""")
def vector_collection(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    hashed = lambda df: df.withColumn("content_hash", F.sha1("text"))
    vectors = search.Collection(spark, folder(spark, "vectors"))
    first = vectors.sync(hashed(p.filter("id % 9 <> 1")), lengths)
    second = vectors.sync(hashed(p.filter("id % 9 <> 0").withColumn("text", F.when(F.col("id") % 9 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))), lengths)
    rows = [("first", first["upsert"], first["delete"], first["unchanged"]), ("second", second["upsert"], second["delete"], second["unchanged"]), ("held", vectors.get().count(), None, None)]
    return spark.createDataFrame(rows, "step string, upserted long, deleted long, unchanged long")


# --- streams ------------------------------------------------------------------------------------------------------------


@query("SELECT 'u' || user_id AS sql_id, arg_max(event_type || event_id, event_id) AS sql_text FROM events WHERE user_id % 3 <> 0 GROUP BY 1")
def stream_changed(spark, sf):
    """The last text of each statement of a batch, without those whose hash is known."""
    e = table(spark, sf, "events").select(key("u", "user_id").alias("sql_id"), F.concat("event_type", F.col("event_id").cast("string")).alias("sql_text"), F.col("event_id").alias("published_at"), "user_id")
    known = e.filter("user_id % 3 = 0").groupBy("sql_id").agg(F.sha2(F.max_by("sql_text", "published_at"), 256).alias("sql_hash"))
    return incremental.latest_changed(e, known).select("sql_id", "sql_text")


@query("""WITH a AS (SELECT ts, CASE WHEN event_id % 3 = 0 THEN 'adhoc' ELSE 'semantic' END AS channel, CASE WHEN value < 10 THEN 'refused' ELSE 'ok' END AS status FROM events),
w AS (SELECT date_trunc('day', ts) - INTERVAL 1 DAY * k AS start, channel, status FROM a, range(7) r(k))
SELECT CAST(start AS VARCHAR)[:10] AS start, channel, status, CAST(count(*) AS BIGINT) AS requests FROM w GROUP BY ALL""")
def usage_windows(spark, sf):
    """Seven-day windows that begin every day."""
    own = incremental.usage_by_window(audit(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))
    return own.select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "channel", "status", "requests")


@query(rows_sql("sql_id VARCHAR, dst VARCHAR", [("fresh", "show.more"), ("late", "show.more")]))
def published_statements(spark, sf):
    """Statements that land as files become lineage; the same file text again does nothing."""
    root = folder(spark, "published")
    lines = [("fresh", "INSERT INTO show.old SELECT line FROM show.ranking", "2024-01-01 00:00:00"), ("fresh", "INSERT INTO show.more SELECT line FROM show.ranking", "2024-01-02 00:00:00"), ("late", "INSERT INTO show.more SELECT card FROM show.notes", "2024-01-01 00:00:00")]
    landed = spark.createDataFrame(lines, "sql_id string, sql_text string, published_at string")
    w = rebuild.Warehouse(spark, f"{root}/lineage")
    for _ in range(2):
        landed.coalesce(1).write.mode("append").json(f"{root}/in")
        incremental.follow(w, f"{root}/in", SCHEMA, f"{root}/checkpoint", available_now=True).awaitTermination()
    return w.edges.filter("edge_level = 'table'").select("sql_id", "dst")
