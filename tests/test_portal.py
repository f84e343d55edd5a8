import datetime
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lakeloom.operators import portal
from lakeloom.plans.lineage import Edge, Parsed
from lakeloom.sources import feeds

GLOSSARY = "term string, aliases array<string>, caliber string, domain string, ref_table string, ref_column string, certified boolean, status string, updated_at timestamp"


def test_glossary(spark):
    now = datetime.datetime(2026, 7, 1)
    g = spark.createDataFrame([("Café", ["c"], "beans", "food", None, None, True, "active", now)], GLOSSARY)
    g = portal.glossary_created(g, {"term": "tea", "domain": "food", "caliber": "leaves"})
    with pytest.raises(portal.Conflict):
        portal.glossary_created(g, {"term": "tea", "domain": "food"})
    with pytest.raises(ValueError):
        portal.glossary_patched(g, "tea", "food", {"term": "x"})
    g = portal.glossary_patched(g, "tea", "food", {"status": "active", "aliases": ["cha"]})
    got = {r.term: (r.status, r.aliases) for r in g.collect()}
    assert got == {"Café": ("active", ["c"]), "tea": ("active", ["cha"])}
    assert [r.term for r in portal.glossary_list(g, "CAFE").collect()] == ["Café"] and portal.glossary_list(g, status="deprecated").isEmpty()


def test_reads_and_answers(spark):
    tables = spark.createDataFrame([("d.t", "dwd", "x", "o", True)], "full_name string, layer string, domain string, owner string, is_online boolean")
    columns = spark.createDataFrame([("d.t", "b"), ("d.t", "a")], "full_name string, column_name string")
    statements = spark.createDataFrame([("j1", "d.t", "s" * 3000, True, "failed", "r", 1), ("j2", "d.t", "s", False, "failed", "r", 2)], "task_id string, target_table string, sql_text string, is_active boolean, parse_status string, reason string, updated_at int")
    info = portal.table_info(tables, columns, statements, "d.t")
    assert [c["column_name"] for c in info["columns"]] == ["a", "b"] and info["tasks"] == ["j1"] and portal.table_info(tables, columns, statements, "no") is None
    assert [(r.task_id, len(r.sql_text)) for r in portal.failed_queue(statements).collect()] == [("j1", 2000)]
    edges = spark.createDataFrame([("o.s", "d.t", "high")], "src string, dst string, confidence string")
    assert portal.dashboard(tables, edges, statements)["total"] == {"total": 1, "covered": 1, "ratio": 1.0}
    found = spark.createDataFrame([("t", "d.t", "f", 1)], "candidate string, node string, family string, rank_in_family int")
    out = portal.answer(found, edges)
    assert out["kind"] == "lineage" and [h["src"] for h in out["hops"]] == ["o.s"] and not out["truncated"]
    assert portal.answer(found.limit(0), edges)["kind"] == "nothing"


def test_cache():
    now = [datetime.datetime(2026, 7, 1, 2, 59, 30)]
    cache, calls = portal.Cache(3, lambda: now[0]), []
    make = lambda: calls.append(1) or ({"error": 1} if len(calls) == 1 else {"ok": 1})
    assert cache.lifetime() == 60 and cache.get("k", make) == {"error": 1} and cache.get("k", make) == cache.get("k", make) == {"ok": 1} and len(calls) == 2


def test_feeds(spark, tmp_path):
    items = [{"task_id": k, "node_seq": 1, "target_table": "a.b" if k != 3 else None, "sql_text": "select 1"} for k in range(7)]
    waits, fails = [], [1, 1]

    def fetch(page, size):
        if fails:
            fails.pop()
            raise OSError("busy")
        return items[(page - 1) * size : page * size]

    assert [s["task_id"] for s in feeds.statements_of(feeds.pages(fetch, 3, waits.append))] == [0, 1, 2, 4, 5, 6] and waits == [2.0, 4.0]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.split("page=")[1].split("&")[0])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"items": items[(page - 1) * 3 : page * 3]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(feeds.SchedulerSource)
    got = spark.read.format("scheduler").option("url", f"http://127.0.0.1:{server.server_port}/x").option("size", "3").load()
    assert sorted(r.task_id for r in got.collect()) == ["0", "1", "2", "4", "5", "6"]
    for known, tasks in ((2, 2), (3, 2), (5, 9)):
        shared = spark.read.format("scheduler").option("url", f"http://127.0.0.1:{server.server_port}/x").option("size", "3").option("pages", str(known)).option("tasks", str(tasks)).load()
        assert sorted(r.task_id for r in shared.collect()) == ["0", "1", "2", "4", "5", "6"]
    server.shutdown()
    (tmp_path / "c1.sql").write_text("select 1\nfrom x")
    assert [tuple(r) for r in feeds.sql_folder(spark, f"file://{tmp_path}").collect()] == [("c1", "select 1\nfrom x")]
    own = feeds.prefilled("c1", "c1.sql", "hive", Parsed("success", "d.t", [Edge("a.b", "", "d.t", "", "table"), Edge("a.b", "x", "d.t", "y", "column", "e" * 200)]))
    path = str(tmp_path / "c1.yaml")
    assert feeds.write_annotation(path, own) and not feeds.write_annotation(path, own) and feeds.write_annotation(path, own | {"verified": True}, force=True)
    assert not feeds.write_annotation(path, own, force=True) and len(feeds.read_annotation(path)["column_edges"][0]["expr"]) == 161
