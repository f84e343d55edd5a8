import time

import pytest
from pyspark.sql import functions as F
from lakeloom.sources.transit import CASES, SCHEMA, STATUSES

from lakeloom.functions.columns import is_tmp
from lakeloom.operators import fold, graph, reach
from lakeloom.plans import lineage


@pytest.fixture(scope="module")
def parsed(spark):
    return dict(lineage.parse_all(spark, [(k, c.sql) for k, c in CASES.items()], SCHEMA, threads=4))


@pytest.mark.parametrize("name", CASES)
def test_corpus(parsed, name):
    case, p = CASES[name], parsed[name]
    assert (p.status, p.reason, p.target) == (case.status, case.reason, case.target), p.message
    assert [e.src_table for e in p.edges if e.edge_level == "table"] == case.sources.split()
    own = {}
    for e in p.edges:
        if e.edge_level == "column":
            own.setdefault(e.dst_column, set()).add(f"{e.src_table}.{e.src_column}")
    assert own == {c: set(leaves.split()) for c, leaves in case.columns.items()}


def test_texts(parsed):
    text = lambda name, column: next(e for e in parsed[name].edges if e.dst_column == column)
    assert "RANK()" in text("ranking", "place").transform_expr.upper() and text("ranking", "place").filter_cond == ""
    assert "sum" in text("line_day", "minutes").transform_expr.lower() and "day" in text("line_day", "minutes").filter_cond
    on = next(e for e in parsed["priced"].edges if e.edge_level == "table").join_cond
    assert "next_stop" in on and "zone_to" in on and text("priced", "cents").join_cond == ""
    assert all(e.join_cond == "" for e in parsed["cube"].edges)  # USING
    assert [e.is_self_loop for e in parsed["card_total"].edges if e.edge_level == "table"] == [False, True]


def test_the_catalog_is_left_as_it_was(spark):
    before = {d.name for d in spark.catalog.listDatabases()}
    lineage.parse_all(spark, [("a", CASES["legs"].sql)], SCHEMA, default_db="somewhere")
    assert {d.name for d in spark.catalog.listDatabases()} == before and spark.catalog.currentDatabase() == "default"


def test_a_changed_schema_is_seen(spark):
    star = [("a", "INSERT INTO x.dst SELECT * FROM feed.taps")]
    columns = lambda schema: [e.src_column for e in lineage.parse_all(spark, star, schema)[0][1].edges if e.edge_level == "column"]
    with lineage.Parser(spark, SCHEMA) as old:  # its view of the old schema is still there
        old.parse(star[0][1])
        assert columns({"feed": {"taps": {"card": "string", "extra": "int"}}}) == ["card", "extra"]
    assert columns(SCHEMA) == list(SCHEMA["feed"]["taps"])


def test_default_database_and_dialects(spark):
    p = dict(lineage.parse_all(spark, [("a", "REPLACE INTO notes SELECT card, \"it's # text\" FROM taps # all of them"), ("b", "INSERT INTO notes SELECT card FROM `taps`")], SCHEMA["feed"] and {"feed": SCHEMA["feed"]}, "feed", dialects={"a": "mysql"}))
    assert (p["a"].status, p["a"].target, [e.src_table for e in p["a"].edges if e.edge_level == "table"], p["a"].reason) == ("success", "feed.notes", ["feed.taps"], "")
    assert p["b"].status == "success" and {e.src_column for e in p["b"].edges if e.edge_level == "column"} == {"card"}
    with pytest.raises(ValueError):
        lineage.in_spark("SELECT 1", "oracle")
    lineage_of = lineage.Parsed("success", "t", [lineage.Edge("feed.taps", "", "t", "", "table")])
    assert lineage.crosscheck("INSERT INTO t SELECT 'from nowhere' FROM feed.taps -- from x", lineage_of) and not lineage.crosscheck("INSERT INTO t SELECT 1 FROM a.b", lineage_of)


def test_a_late_statement_keeps_its_tables(spark, monkeypatch):
    slow = lineage.Parser._columns
    monkeypatch.setattr(lineage.Parser, "_columns", lambda self, *a: time.sleep(4) or slow(self, *a))
    found = lineage.parse_all(spark, [("a", CASES["kept"].sql), ("b", "SELECT")], SCHEMA, timeout_s=2.5)
    p = found[0][1]
    assert (p.status, p.reason, p.target, [(e.src_table, e.edge_level) for e in p.edges]) == ("degraded", "timeout", "core.taps_kept", [("feed.taps", "table")])
    assert found[1][1].status == "failed"
    time.sleep(2)


def test_from_statements_to_closure(spark, parsed):
    edges, status = lineage.tables_of(spark, list(parsed.items()))
    assert {r["parse_status"]: r["count"] for r in status.groupBy("parse_status").count().collect()} == STATUSES
    own = edges.filter("edge_level = 'table' and confidence = 'high'").select(F.xxhash64("sql_id", "src_table", "dst_table").alias("edge_id"), F.col("src_table").alias("src"), F.col("dst_table").alias("dst"), "sql_id", "src_type", "confidence", "transform_expr", "filter_cond", "join_cond")
    names = own.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    folded = fold.folded_edges(own, names.filter(is_tmp(F.col("node"))))
    assert folded.filter("src like 'tmp%' or dst like 'tmp%'").isEmpty()
    closed = {(r.ancestor, r.descendant): r.min_hops for r in graph.closure(folded).collect()}
    assert closed["feed.taps", "core.trips"] == 1 and closed["feed.taps", "show.cheap"] == 4 and closed["feed.fares", "core.trip_prices"] == 1
    assert reach.cyclic(reach.strong_components(folded)).isEmpty()
    path = graph.shortest_path(folded, "feed.taps", "show.ranking")
    assert [p.dst for p in path.orderBy("hop").collect()] == ["core.trips", "mart.line_day", "show.ranking"]
    said = graph.path_details(path, folded).orderBy("hop").collect()
    assert [p.sql_id for p in said[:2]] == ["trips", "line_day"] and said[2].sql_id in ("ranking", "nested") and "day" in said[1].filter_cond and said[0].confidence == "high"
    assert lineage.nodes_of(edges).count() == lineage.nodes_of(edges).select("node_id").distinct().count()


@pytest.mark.parametrize(
    "sql, sources",
    [
        ("select * from a, b x, (select 1 from c, d) y, db.e as z where x.k = y.k group by a, b", "db.e default.a default.b default.c default.d"),
        ("select extract(year from ts), trim(both 'x' from n), a is not distinct from b from t", "default.t"),
        ('select "from nowhere, x" from t -- from z\n', "default.t"),
        ("with q as (select * from a), r(x) as (select 1 from q, b) select * from r, q join c on q.x = c.x, d", "default.a default.b default.c default.d"),
        ("select e from range(10), t lateral view explode(a) e as f", "default.t"),
        ("insert overwrite table o select a, b from (p join q on p.x = q.x), r order by a, b", "default.p default.q default.r"),
        ("select substring((select max(a) from t), 1), (select 1 from u, v) from w, lateral (select * from x) union select 1, 2 from `y`.`z`", "default.t default.u default.v default.w default.x y.z"),
        ("", ""),
        ("select 1)) from", ""),
    ],
)
def test_second_reading(sql, sources):
    assert sorted(lineage.sources_of(sql)) == sources.split()


def test_second_reading_agrees(spark):
    text = 'INSERT INTO show.notes SELECT t.card, "said from x, y" FROM feed.taps t, feed.stops s WHERE t.stop = s.stop AND extract(year FROM t.tapped_at) = 2024'
    (_, p), (_, q) = lineage.parse_all(spark, [("a", text), ("b", text + " # from nowhere, here")], SCHEMA, dialects={"b": "mysql"})
    for each in (p, q):
        assert (each.status, each.reason) == ("success", ""), each.message
        assert sorted(e.src_table for e in each.edges if e.edge_level == "table") == ["feed.stops", "feed.taps"]
