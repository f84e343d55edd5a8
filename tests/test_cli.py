import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from lakeloom import cli
from lakeloom.sources import feeds, synth


def test_commands(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/w"
    synth.stored(spark, root, 12, 14, 3)
    frames = {
        "tables": spark.read.parquet(f"{root}/tables").selectExpr("*", "'d' AS domain", "'o' AS owner", "'c' AS comment"),
        "columns": spark.read.parquet(f"{root}/columns").selectExpr("*", "if(place % 2 = 0, '', concat('the ', column_name, ' of a parcel')) AS comment"),
        "glossary": spark.createDataFrame([("parcel", "things sent", "active")], "term string, caliber string, status string"),
        "audit": spark.createDataFrame([], "ts timestamp, channel string, status string, refuse_reason string, user_id string"),
    }
    for name, df in frames.items():
        rows = df.collect()
        spark.createDataFrame(rows, df.schema).write.mode("overwrite").parquet(f"{root}/{name}")

    def run(*args):
        code = cli.main(["--root", root, *args], spark)
        out = capsys.readouterr().out
        return code, json.loads(out) if out.startswith("{") else out

    code, stats = run("full-rebuild")
    assert code == 0 and stats["status"] == "success" and stats["statuses"]["success"] == stats["statements"] >= 14
    one = spark.read.parquet(f"{root}/statements").orderBy("sql_id").first().sql_id
    assert run("incremental", "--sql-id", one)[1]["edges"] == stats["edges"]
    coverage = run("coverage")[1]
    assert coverage["total"]["total"] == sum(x["total"] for x in coverage["layers"]) > 0 and coverage["parses"][0]["parse_status"] == "success"
    first = run("vectorize")[1]
    assert first["upsert"] > 10 and first["skipped"]["empty"] > 0 and run("vectorize")[1] == first | {"upsert": 0, "unchanged": first["upsert"]}
    assert run("healthcheck") == (0, {"healthy": True, "problems": []})
    assert "# Weekly report" in run("weekly-report")[1]
    # one table is gone from the metastore
    synced = f"file://{tmp_path}/synced"
    gone = spark.read.parquet(f"{root}/tables").orderBy("full_name").first().full_name
    spark.read.parquet(f"{root}/tables").filter(f"full_name <> '{gone}'").write.parquet(f"{synced}/tables")
    spark.read.parquet(f"{root}/columns").filter(f"full_name <> '{gone}'").write.parquet(f"{synced}/columns")
    out = run("sync-metadata", "--synced", synced)[1]
    assert out["offline"] == 1 and out["blank"] > 0 and spark.read.parquet(f"{root}/tables").count() == out["tables"] + 1

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.split("page=")[1].split("&")[0])
            items = [{"task_id": "new", "node_seq": 1, "target_table": "ads.fresh", "sql_text": "INSERT INTO ads.fresh SELECT 1"}] if page == 1 else []
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(items).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/jobs"
        assert run("collect-sql", "--url", url)[1]["statements"] == 1 and run("collect-sql", "--url", url)[1]["statements"] == 0
    finally:
        server.shutdown()
    assert spark.read.parquet(f"{root}/statements").filter("sql_id = 'new#1' and is_active").count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "schema.json").write_text(json.dumps({"a": {"t": {"z": "int", "b": "string"}}}))
    assert list(feeds.read_schema(str(tmp_path / "schema.json"))["a"]["t"]) == ["z", "b"]
    assert feeds.read_dialects(str(tmp_path)) == {}
    snapshots = spark.createDataFrame([("a.t", [("z", "int"), ("b", "string")]), ("bare", [])], "full_name string, columns array<struct<name:string,type:string>>")
    assert feeds.schema_of(snapshots) == {"a": {"t": {"z": "int", "b": "string"}}, "default": {"bare": {}}}
