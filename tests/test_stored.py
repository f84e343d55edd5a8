"""What is stored and kept up to date: buckets, indexes, daily states, the stream's gate, guards, pools."""

import datetime
import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.functions.columns import similarity
from lakeloom.operators import daily, quality, search, textindex, vectorcells
from lakeloom.plans import metrics as M
from lakeloom.plans import rebuild
from lakeloom.sources.tables import Generations
from lakeloom.streaming import gate, incremental

DAY = datetime.datetime(2024, 1, 1)


# --- buckets


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Generations(spark, f"file://{tmp_path}/s")
    rows = spark.range(1000).select((F.col("id") % 200).alias("k"), "id", F.lit("x").alias("v"))
    store.swap({"t": store.write_buckets("t", rows, "k", 16), "other": store.write_shadow("other", spark.range(3))})
    before = {*store.current("t").inputFiles()}
    gone = spark.createDataFrame([(7,), (9,)], "k long")
    shadow = store.patch_buckets("t", gone, lambda held: held.join(gone, "k", "left_anti").union(spark.createDataFrame([(7, -1, None)], held.schema)))
    assert store.current("t").count() == 1000  # nothing changes before the swap
    store.swap({"t": shadow})
    after = {*store.current("t").inputFiles()}
    assert 14 <= len(before & after) < len(before) and store.current("other").count() == 3
    assert sorted(r.id for r in store.current("t").filter("k in (7, 9)").collect()) == [-1] and store.current("t").count() == 991
    assert store.rollback() and store.current("t").count() == 1000
    assert store.delta("t", shadow) == pytest.approx(0.009)
    # a bucket may lose all its rows, and a table may have none
    every = rows.select("k").distinct()
    store.swap({"t": store.patch_buckets("t", every, lambda held: held.filter("false"))})
    assert store.current("t").columns == ["k", "id", "v"] and store.current("t").isEmpty()
    store.swap({"t": store.patch_buckets("t", gone, lambda held: held.union(spark.createDataFrame([(7, 1, "y")], held.schema)))})
    assert [tuple(r) for r in store.current("t").collect()] == [(7, 1, "y")]


# --- the gate


def landed(folder, name, rows):
    (folder / f"{name}.json").write_text("".join(json.dumps({"sql_id": i, "sql_text": t, "published_at": f"2024-01-{d:02}T00:00:00"}) + "\n" for i, t, d in rows))


def test_gate_over_several_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = f"file://{tmp_path}/out"

    def run():
        stream = gate.changes(incremental.statements(spark, f"file://{tmp_path}/in")).writeStream.outputMode("update").foreachBatch(lambda b, _: b.write.mode("append").parquet(out))
        stream.option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.sql_id, r.published_at.day, r.sql_text) for r in spark.read.parquet(out).collect())

    landed(tmp_path / "in", "a", [("x", "A", 1), ("x", "B", 2), ("x", "B", 3), ("y", "A", 1), (None, "A", 1)])
    one = [("x", 1, "A"), ("x", 2, "B"), ("y", 1, "A")]
    assert run() == one
    landed(tmp_path / "in", "b", [("x", "A", 4), ("x", "late", 2), ("y", "A", 5), ("y", None, 6)])
    two = sorted([*one, ("x", 4, "A"), ("y", 6, "")])
    assert run() == two
    landed(tmp_path / "in", "c", [("x", "A", 5), ("x", "A", 4), ("y", "later text, earlier day", 5), ("z", "B", 1)])
    assert run() == sorted([*two, ("z", 1, "B")]) and run() == sorted([*two, ("z", 1, "B")])


def test_a_text_that_comes_back_is_lineage_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    w, schemas = rebuild.Warehouse(spark, f"file://{tmp_path}/w"), []
    text = lambda t: f"INSERT INTO b.t SELECT x FROM a.{t}"

    def schema():
        schemas.append(1)
        return {"a": {"one": {"x": "int"}, "two": {"x": "int"}}, "b": {"t": {"x": "int"}}}

    def run(name, rows):
        landed(tmp_path / "in", name, rows)
        incremental.follow(w, f"file://{tmp_path}/in", schema, f"file://{tmp_path}/cp", available_now=True).awaitTermination()
        return [(r.src, r.dst) for r in w.edges.filter("edge_level = 'table'").collect()], [(r.ancestor, r.descendant) for r in w.closure.collect()]

    for k, t in enumerate(("one", "two", "one")):
        assert run(str(k), [("q", text(t), k + 1)]) == ([(f"a.{t}", "b.t")],) * 2
    assert run("late", [("q", text("two"), 2)]) == ([("a.one", "b.t")],) * 2 and len(schemas) == 3


# --- text search


def texts_of(r, n):
    return [(k, " ".join(r.choice(["red", "blue", "bolt", "gear", "ring", "widget", "Economy", "x"]) for _ in range(r.randint(0, 6))) or None) for k in range(n)]


def test_gram_index_equals_scoring_everything(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(textindex, "FIRST", 1)
    docs, index = texts_of(r, 300) + [(1000 + k, "zeppelin zeppelin") for k in range(9)], textindex.GramIndex(spark, f"file://{tmp_path}/g", blocks=24)
    df = lambda rows: spark.createDataFrame(rows, "id long, text string")
    keywords = ["red bolt", "Economy ring", "zzz", "", "x", "blue widget gear", "red zeppelin"]
    asked = spark.createDataFrame(list(enumerate(keywords)), "kid long, keyword string")

    def check(now):
        got = {}
        for x in index.search(asked, 7).collect():
            got.setdefault(x.kid, []).append((x.rank, x.id, x.score))
        for kid, keyword in enumerate(keywords):
            want = [(x.id, x.score) for x in search.full_text(df(now), keyword, most=7).collect()]
            assert [(i, pytest.approx(s, abs=2e-6)) for _, i, s in sorted(got.get(kid, []))] == want

    assert index.sync(df(docs)) == {"texts": 309, "blocks": 24}
    check(docs)
    changed = [*docs[:50], (50, "a wholly new widget"), *docs[52:], (9999, "ring ring ring")]
    assert index.sync(df(changed))["blocks"] <= 3
    check(changed)
    assert index.sync(df(changed))["blocks"] == 0
    read = index._searched(asked, 7)[1]
    assert read.filter("not read").count() > 0  # blocks that cannot reach the best were left out


@pytest.mark.parametrize("least", (85.0, 92.5, 60.0, 100.0))
def test_fuzzy_join_equals_all_pairs(spark, least):
    r = random.Random(int(least))
    base = ["", "a", "ab", "aa", "abc", "widget", "red widget", "éclair", "🙂🙂🙂", "revenue by customer and month", "x" * 70, "orders " * 12]

    def spoilt(t):
        t = list(t)
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(t))
            t[k : k + r.randint(0, 1)] = r.choice(["", "q", "e"])
        return "".join(t)

    names = [(k, [spoilt(r.choice(base)), r.choice([None, spoilt(r.choice(base))])]) for k in range(60)]
    keywords = [(k, r.choice([*base, spoilt(r.choice(base))])) for k in range(30)] + [(99, None)]
    n, k = spark.createDataFrame(names, "id long, names array<string>"), spark.createDataFrame(keywords, "kid long, keyword string")
    got = {(x.kid, x.id): x.confidence for x in textindex.fuzzy_join(k, n, least).collect()}
    best = F.array_max(F.transform(F.filter("names", lambda x: x.isNotNull()), lambda x: similarity(x, F.col("keyword"))))
    every = k.filter("keyword is not null").crossJoin(n).select("kid", "id", best.alias("s")).filter(F.col("s") >= least)
    assert got == {(x.kid, x.id): round(x.s / 100, 4) for x in every.collect()}


def test_candidates_are_few(spark):
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = ["".join(r.choice(letters) for _ in range(20)) for _ in range(400)]
    names = spark.createDataFrame([(t,) for t in rows], "text string")
    asked = spark.createDataFrame([(t[:9] + "#" + t[10:],) for t in rows[:100]], "text string")
    found = textindex.candidates(asked, names, 85.0)
    assert 100 <= found.count() < 100 * 400 / 5


# --- vectors


def test_cells_equal_a_scan(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16)) * 4
    v = np.concatenate([centres[k % 20] + 0.3 * rng.standard_normal(16) for k in range(1500)]).reshape(1500, 16)
    v[7] = v[3]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    cells = vectorcells.VectorCells(spark, f"file://{tmp_path}/c", cells=20)
    assert cells.build(df) == 1500
    asked = df.filter("id % 40 = 3 or id > 9000").withColumnRenamed("id", "query_id")
    found, compared = cells.searched(asked, 6)
    got = {}
    for x in sorted(found.collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append((x.id, x.confidence))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(3, 1500, 40):
        s = np.round(u @ u[q], 6)
        want = [(int(k), s[k]) for k in np.lexsort((np.arange(1500), -s))[:6]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=1.5e-6)
        assert len({i for i, _ in got[q]} & {i for i, _ in want}) >= 5
    assert got.keys() == set(range(3, 1500, 40)) and got[3][:2] == [(3, 1.0), (7, 1.0)]
    share = compared.agg(F.sum("compared") / F.sum("held")).first()[0]
    assert share < 0.25
    with pytest.raises(ValueError):
        vectorcells.VectorCells(spark, "x", cells=0)


def test_small_collections(spark, tmp_path):
    cells = vectorcells.VectorCells(spark, f"file://{tmp_path}/c")
    one = spark.createDataFrame([(1, [3.0, 4.0])], "id long, embedding array<double>")
    assert cells.build(one) == 1
    assert [tuple(x) for x in cells.search(one.withColumnRenamed("id", "query_id")).collect()] == [(1, 1, 1.0, 1)]
    assert cells.build(one.limit(0)) == 0 and cells.search(one.withColumnRenamed("id", "query_id")).isEmpty()
    many = spark.range(search.MOST_QUERIES + 1).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("embedding"))
    with pytest.raises(ValueError):
        search.nearest(one, many)


# --- days


def test_exact_percentiles(spark):
    r = random.Random(4)
    values = {"one": [5.0], "same": [2.0] * 500, "wide": [r.choice([-1e308, 1e308, 0.0, 1e-300]) for _ in range(99)], "many": [r.gauss(0, 1) for _ in range(5000)], "whole": [float(r.randrange(40)) for _ in range(700)], "none": [None, float("nan")]}
    df = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "grp string, v double").repartition(6)
    at = (0.0, 0.01, 0.5, 0.95, 1.0)
    got = {(x.grp, x.p): x.exact for x in daily.exact_percentiles(df, "grp", "v", at).collect()}
    want = {(k, p): sorted(own)[max(int(np.ceil(p * len(own) - 1e-9)), 1) - 1] for k, own in values.items() if k != "none" for p in at}
    assert got == want


def test_windows_merge_days(spark):
    r = random.Random(5)
    rows = [((DAY + datetime.timedelta(days=r.choice([0, 1, 2, 5, 9]))).date(), f"u{r.randrange(300)}", r.random()) for _ in range(4000)] + [(None, "u1", 1.0), (DAY.date(), None, None)]
    df = spark.createDataFrame(rows, "day date, user_id string, cost double").repartition(5)
    out = {x.day: x for x in daily.usage_windows(df, days=3).collect()}
    assert set(out) == {d for d, _, _ in rows if d}
    for day, x in out.items():
        own = [z for z in rows if z[0] and 0 <= (day - z[0]).days < 3]
        costs = sorted(z[2] for z in own if z[2] is not None)
        assert (x.requests, x.users, x.p50) == (len(own), len({z[1] for z in own} - {None}), costs[-(-len(costs) // 2) - 1])
        assert abs(x.about_users - x.users) <= 0.06 * x.users + 1
        assert abs(np.searchsorted(costs, x.about_p50) / len(costs) - 0.5) < 0.05
    assert daily.usage_windows(df.limit(0)).isEmpty()


# --- health, guards, pools


def test_health_reads_the_run_that_started_last(spark, tmp_path):
    now = datetime.datetime(2024, 5, 1)
    schema = "run_id string, run_type string, status string, started_at timestamp"
    runs = lambda *rows: spark.createDataFrame([(i, "full", s, now - datetime.timedelta(hours=h)) for i, s, h in rows], schema)
    problems = lambda df: {r.problem for r in quality.health(df, 1, 0, F.lit(now)).collect()}
    assert problems(runs(("z", "aborted", 2), ("a", "success", 1))) == set()
    assert problems(runs(("a", "success", 2), ("z", "success", 30), ("b", "failed", 1))) == {"last_run_not_successful"}
    assert problems(runs()) == {"no_full_run"}
    for k in range(4):
        w = rebuild.Warehouse(spark, f"file://{tmp_path}/{k}")
        with w.run("full"):
            raise rebuild.Aborted("too much")
        with w.run("full"):
            pass
        assert not quality.health(w.runs(), 1, 0, F.current_timestamp()).collect()


def test_no_name_of_a_barred_table_passes(spark):
    barred = {"x.secret", "plain"}
    for source in ("x.secret", "spark_catalog.x.secret", "X.Secret", "`x`.`SECRET`", "other.x.secret", "plain", "db.plain", "spark_catalog.db.PLAIN", "(SELECT * FROM x.secret LIMIT 1)", "y.t JOIN spark_catalog.x.secret USING (a)", "y.t WHERE EXISTS (SELECT 1 FROM spark_catalog.x.secret)"):
        with pytest.raises(M.Rejected):
            M.guard_select(spark, f"SELECT a FROM {source} LIMIT 1", barred)
    for sql in ("WITH c AS (SELECT * FROM spark_catalog.x.secret) SELECT a FROM c LIMIT 1", "WITH plain AS (SELECT 1 AS a) SELECT a FROM plain LIMIT 1"):
        with pytest.raises(M.Rejected):
            M.guard_select(spark, sql, barred)
    for source in ("text.`/etc/hostname`", "parquet.`s3://b/t`", "csv.data", "JSON.`a b`", "`org.apache.spark.sql.parquet`.`t`", "x.`/etc/hostname`", "spark_catalog.parquet.`t`", "`../t`"):
        with pytest.raises(M.Rejected, match="files"):
            M.guard_select(spark, f"SELECT * FROM {source} LIMIT 1")
    for source in ("x.secrets", "secret", "x.t", "spark_catalog.x.t", "textual.t"):
        M.guard_select(spark, f"SELECT a FROM {source} LIMIT 1", barred)
    spark.sql("CREATE DATABASE IF NOT EXISTS guarded_home")
    try:
        spark.catalog.setCurrentDatabase("guarded_home")
        with pytest.raises(M.Rejected):
            M.guard_select(spark, "SELECT a FROM secret LIMIT 1", {"guarded_home.secret"})
    finally:
        spark.catalog.setCurrentDatabase("default")
        spark.sql("DROP DATABASE guarded_home")


def test_free_questions_do_not_hold_up_metrics(spark):
    taken = threading.Event()
    release = threading.Event()

    def hold():
        with M._SLOTS["adhoc"]:
            taken.set()
            release.wait(60)

    threads = [threading.Thread(target=hold) for _ in range(M.AT_ONCE // 2)]
    for t in threads:
        t.start()
    taken.wait(10)
    try:
        got = M.execute(spark, spark.range(3).toDF("n"), channel="semantic")
        assert (got["row_count"], got["pool"]) == (3, "semantic") and not M._SLOTS["adhoc"].acquire(timeout=0.1)
    finally:
        release.set()
        for t in threads:
            t.join()
    assert M.execute(spark, spark.range(2).toDF("n"), channel="adhoc")["pool"] == "adhoc" and spark.sparkContext.getLocalProperty(M.POOL) is None


def test_slices_of_cells_meet_blocks_of_queries(spark, tmp_path, monkeypatch):
    """No row of a plan is a pair of vectors, and small slices and blocks give what whole cells give, equal vectors included."""
    r = random.Random(3)
    rows = [(k, [r.gauss(0, 1) for _ in range(6)]) for k in range(200)]
    df = spark.createDataFrame(rows + [(k + 200, v) for k, v in rows[:30]], "id long, embedding array<double>")
    cells = vectorcells.VectorCells(spark, f"file://{tmp_path}/s", cells=3)
    cells.build(df)
    asked = df.filter("id % 4 = 0").withColumnRenamed("id", "query_id")
    want = sorted(tuple(x) for x in search.nearest(df, asked, 5).select("query_id", "id", "confidence", "rank").collect())
    for size in (16_384, 20):
        monkeypatch.setattr(vectorcells, "SLICE", size)
        monkeypatch.setattr(vectorcells, "BLOCK", size)
        found = cells.search(asked)
        assert sorted(tuple(x) for x in found.collect()) == want
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_joined_rows_are_dealt_by_their_number(spark, monkeypatch):
    """What one task of the similarity join and of folding holds is bounded by rows: few names make many rows of few bytes."""
    from lakeloom.operators import fold
    from lakeloom.sources import tables

    monkeypatch.setattr(tables, "PER_TASK", 100)
    names = spark.createDataFrame([(k, ["blue widget", "red gear"]) for k in range(1500)], "id long, names array<string>")
    asked = spark.createDataFrame([("a", "blue widgets"), ("b", "blue widge"), ("c", None)], "kid string, keyword string")
    found = textindex.fuzzy_join(asked, names)
    assert ", 31), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 3000
    edges = spark.createDataFrame([(f"{a}>{b}", a, b, "s", "sql", "high", "", "", "") for a, b in [("h", "t"), *(("t", f"d{k}") for k in range(900))]], "edge_id string, src string, dst string, sql_id string, src_type string, confidence string, transform_expr string, filter_cond string, join_cond string")
    folded = fold.fold(edges, spark.createDataFrame([("t",)], "node string"))
    assert ", 10), REPARTITION_BY_NUM" in folded._jdf.queryExecution().executedPlan().toString() and folded.count() == 900


def test_lists_of_postings_move_and_not_their_entries(spark, tmp_path):
    """Texts are summed in the tasks that hold the lists of their keyword and block: the aggregate of a scoring has no shuffle of its own."""
    index = textindex.GramIndex(spark, f"file://{tmp_path}/m", blocks=2)
    index.sync(spark.createDataFrame([(k, "red bolt" if k % 2 else "blue ring") for k in range(50)], "id long, text string"))
    postings = index.store.current("postings")
    asked = spark.createDataFrame([("q", "re", 1.0), ("q", "ed", 2.0)], "kid string, gram string, weight double")
    scored = index._scored(postings, asked, spark.createDataFrame([("q", 0), ("q", 1)], "kid string, block int"), postings.select("gram", "block", "best", "n"))
    assert "hashpartitioning(kid" in (plan := scored._jdf.queryExecution().executedPlan().toString()) and ", id" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    assert sorted(tuple(r) for r in scored.collect()) == [(("q"), k, 3.0) for k in range(1, 50, 2)]
