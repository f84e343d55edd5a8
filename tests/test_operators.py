import datetime
import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F
from lakeloom.sources.transit import CASES, SCHEMA, STATUSES

from lakeloom.functions.columns import similarity
from lakeloom.operators import diff, fold, graph, quality, reach, search
from lakeloom.plans import lineage, rebuild
from lakeloom.plans import metrics as M
from lakeloom.sources import synth
from lakeloom.sources.synth import generate
from lakeloom.sources.tables import Generations, counted, metastore_tables
from lakeloom.streaming import incremental


def brute_closure(edges):
    out = {}
    nodes = {a for a, _ in edges}
    adj = {}
    for a, b in set(edges):
        if a != b:
            adj.setdefault(a, set()).add(b)
    for s in nodes:
        hops, count, todo = {s: 0}, {s: 1}, deque([s])
        while todo:
            x = todo.popleft()
            for y in adj.get(x, ()):
                if y not in hops:
                    hops[y], count[y] = hops[x] + 1, 0
                    todo.append(y)
                if hops[y] == hops[x] + 1:
                    count[y] += count[x]
        out |= {(s, t): (h, count[t]) for t, h in hops.items() if t != s}
    return out


def rows_of(closed):
    return {(r.ancestor, r.descendant): (r.min_hops, r.path_cnt) for r in closed.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_closure_patch_and_bfs(spark, seed):
    r = random.Random(seed)
    old = [(r.randrange(14), r.randrange(14)) for _ in range(18)]
    new = [e for e in old if e[1] != 3] + [(r.randrange(16), 3) for _ in range(3)]
    df = lambda e: spark.createDataFrame(e, "src long, dst long")
    closed = graph.closure(df(old))
    assert rows_of(closed) == brute_closure(old)
    assert rows_of(reach.maintained(closed, df(old), df(new))) == brute_closure(new)
    start = old[0][0]
    hops = graph.lineage(df(old), spark.createDataFrame([(start,)], "node long"), depth=5).collect()
    reached = {h.dst for h in hops} - {start}
    assert reached == {b for (a, b), (h, _) in brute_closure(old).items() if a == start and h <= 5}


def test_closure_takes_off_what_leads_nowhere(spark, monkeypatch):
    """Without cycles no pair is carried from level to level; with a cycle its tails are not."""
    r, levels = random.Random(8), []
    monkeypatch.setattr(graph, "counted", lambda df, label, *flags: levels.append(label) or counted(df, label, *flags))
    tree = [(k // 3, k) for k in range(1, 60)] + [(r.randrange(20), r.randrange(60, 80)) for _ in range(90)] + [(r.randrange(20, 60), r.randrange(60, 80)) for _ in range(60)] + [(0, 60), (60, 60)]
    df = lambda e: spark.createDataFrame(e, "src long, dst long")
    assert rows_of(graph.closure(df(tree[1:]))) == brute_closure(tree[1:]) and "level" not in levels
    cycle = [(90, 91), (91, 92), (92, 93), (93, 90), (91, 93), (93, 1), (5, 90)]
    tails = [(90 + k % 4, 100 + k % 13) for k in range(30)] + [(100 + k % 13, 200 + k) for k in range(40)]
    want = brute_closure(cycle + tree[3:] + tails)
    assert rows_of(graph.closure(df(cycle + tree[3:] + tails))) == want
    assert rows_of(graph.closure(df(cycle + tree[3:] + tails), df([(92, 0), (4, 0), (300, 0)]))) == {p: w for p, w in want.items() if p[0] in (92, 4)}
    chain = [(k, k + 1) for k in range(12)] + [(k, 100 + k) for k in range(12)] + [(k, 50) for k in range(12)] + [(50, 300 + k) for k in range(40)]
    assert rows_of(graph.closure(df(chain))) == brute_closure(chain)  # more lengths than have sums of their own
    assert rows_of(graph.closure(df(tree).filter("false"))) == {}


def moved(spark, do):
    """What do() gives, and how many rows all its shuffles wrote."""
    sc, lists = spark.sparkContext._jsc.sc(), spark._jvm.java.util.ArrayList

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(lists(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), lists())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = max(stages(), default=-1)
    out = do()
    return out, sum(n for k, n in stages().items() if k > before)


def test_closure_moves_an_edge_three_times(spark):
    """Told apart and marked, to its source's ancestors, to its end: neither walks nor pairs move, however many there are to an edge."""
    r = random.Random(3)
    chain = [(k, k + 1) for k in range(8)]  # 8 ends the chain: all before it are ancestors of what follows
    edges = chain + [(8, 100 + k) for k in range(400)] + [e for k in range(400) for e in {(100 + k, 1000 + r.randrange(500)) for _ in range(25)}]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(2).localCheckpoint()
    got, n = moved(spark, lambda: rows_of(graph.closure(df)))
    assert got == brute_closure(edges) and n < 4 * len(edges)


@pytest.mark.parametrize("most", [2, 6])
def test_closure_of_hubs(spark, monkeypatch, most):
    """Nodes where more edges end than a task is given: the same pairs."""
    r = random.Random(most)
    monkeypatch.setattr(graph, "PER_TASK", most)
    tree = [(k // 3, k) for k in range(1, 40)] + [(r.randrange(40), 50 + r.randrange(9)) for _ in range(130)] + [(3, 3)] * 9 + [(1, 5)] * 4
    df = lambda e: spark.createDataFrame(e, "src long, dst long")
    want = brute_closure(tree[1:])
    assert rows_of(graph.closure(df(tree[1:]), kept=False)) == want
    assert rows_of(graph.closure(df(tree[1:]), df([(1, 0), (7, 0)]))) == {p: w for p, w in want.items() if p[0] in (1, 7)}
    texts = spark.createDataFrame([(f"a{k % 13}", None if k % 5 else "h") for k in range(40)] + [("h", f"z{k}") for k in range(20)], "src string, dst string")
    assert rows_of(graph.closure(texts)) == brute_closure([(f"a{k % 13}", "h") for k in range(0, 40, 5)] + [("h", f"z{k}") for k in range(20)])


def test_closure_of_many_ancestors(spark):
    """More ancestors than a list takes."""
    fan = [(1000 + k, 0) for k in range(1500)] + [(0, 1), (1005, 1)] + [(7, 10000 + k) for k in range(1600)]
    assert rows_of(graph.closure(spark.createDataFrame(fan, "src long, dst long"))) == brute_closure(fan)


def test_small_graphs(spark):
    df = lambda e: spark.createDataFrame(e, "src string, dst string")
    assert rows_of(graph.closure(df([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "d")])))["a", "d"] == (2, 2)
    loop = df([("a", "b"), ("b", "c"), ("c", "a")])
    assert {tuple(r) for r in reach.cyclic(reach.strong_components(loop)).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert graph.shortest_path(df([("a", "b")]), "a", "a").isEmpty() and graph.shortest_path(df([("a", "b")]), "b", "a").isEmpty()
    hops, cut = graph.capped(graph.lineage(df([("a", x) for x in "bcdef"]), spark.createDataFrame([("a",)], "node string")), 3)
    assert cut and {r.dst for r in hops.collect()} == {"b", "c"}


EDGE = "edge_id string, src string, dst string, sql_id string, src_type string, confidence string, transform_expr string, filter_cond string, join_cond string"


def test_fold(spark):
    e = lambda i, a, b, q="q", c="high", x="": (i, a, b, q, "sql", c, x, f"f{i}", f"j{i}")
    edges = [e("1", "ods.a", "tmp.x", c="high", x="sum(v)"), e("2", "tmp.x", "tmp.y", c="low", x="v + 1"), e("3", "tmp.y", "dwd.b", "last", "high", "max(v)"), e("4", "tmp.y", "tmp.x"), e("5", "ods.a", "dwd.c"), e("6", "tmp.x", "ods.a", "back")]
    df, tmp = spark.createDataFrame(edges, EDGE), spark.createDataFrame([("tmp.x",), ("tmp.y",)], "node string")
    got = {(r.src, r.dst): r for r in fold.fold(df, tmp).collect()}
    assert set(got) == {("ods.a", "dwd.b"), ("ods.a", "ods.a")}
    b = got["ods.a", "dwd.b"]
    assert (b.sql_id, b.confidence, b.transform_expr, b.filter_cond, b.is_self_loop) == ("last", "low", "max(v) (through tmp: sum(v) ; v + 1)", "f3", False)
    assert got["ods.a", "ods.a"].is_self_loop
    assert {r.edge_id for r in fold.used_edges(df, tmp).collect()} == {"1", "2", "3", "6"}
    whole = fold.folded_edges(df, tmp)
    assert {(r.src, r.dst) for r in whole.collect()} == {("ods.a", "dwd.b"), ("ods.a", "ods.a"), ("ods.a", "dwd.c")}
    assert {r.edge_id for r in fold.folded_edges(df, tmp, drop_all=False).collect() if r.edge_id} == {"4", "5"}
    again = fold.fold(whole.withColumn("edge_id", F.concat_ws(">", "src", "dst")), tmp)
    assert again.isEmpty()


def test_fold_through_many(spark):
    names = ["ods.a", *(f"tmp.t{k}" for k in range(33)), "dwd.b"]
    edges = [(str(k), a, b, "q", "sql", "high", "", "", "") for k, (a, b) in enumerate(zip(names, names[1:], strict=False))]
    whole = fold.folded_edges(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x,) for x in names[1:-1]], "node string"))
    assert [(r.src, r.dst) for r in whole.collect()] == [("ods.a", "dwd.b")]


def test_long_path(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(67)], "src long, dst long")
    assert sorted(tuple(r) for r in graph.shortest_path(chain, 0, 65).collect()) == [(k + 1, k, k + 1) for k in range(65)]


def test_similarity_against_brute_force(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = row[:]
            for j, y in enumerate(b):
                row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
        return row[-1]

    r = random.Random(0)
    pairs = [("授信金额", "授信额"), ("", ""), ("", "a"), ("abc", "abc")] + [("".join(r.choice("abcd") for _ in range(r.randint(0, 8))), "".join(r.choice("abcd") for _ in range(r.randint(0, 8)))) for _ in range(60)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for x in got:
        n = len(x.a) + len(x.b)
        assert abs(x.s - (200 * lcs(x.a, x.b) / n if n else 100)) < 1e-9


def test_search_stages(spark):
    glossary = spark.createDataFrame([("授信金额", ["credit amount"], "sum of approved", "credit", "dws.dws_org", True, "active"), ("逾期率", None, "", "risk", "ads.ads_risk", False, "active"), ("old", ["x"], "", "", "dws.dws_org", False, "deprecated")], "term string, aliases array<string>, caliber string, domain string, ref_table string, certified boolean, status string")
    tables = spark.createDataFrame([("dws.dws_org", "dws_org", "organisation credit by day", "dws", "credit", True), ("ads.ads_risk", "ads_risk", "overdue report", "ads", "risk", True), ("ods.Café", "Café", "raw", "ods", "", True), ("tmp.t", "t", "organisation credit", "tmp", "", True)], "full_name string, table_name string, comment string, layer string, domain string, is_online boolean")
    columns = spark.createDataFrame([("dws.dws_org", "credit_amt", "approved amount"), ("ads.ads_risk", "credit_amt", "credit amt"), ("tmp.t", "credit_amt", "x")], "full_name string, column_name string, comment string")
    closed = spark.createDataFrame([("dws.dws_org", "ads.ads_risk", 1, 1)], "ancestor string, descendant string, min_hops int, path_cnt long")
    find = lambda k: [(r.kind, r.candidate) for r in search.search(glossary, tables, columns, closed, k).orderBy("family", "rank_in_family").collect()]
    assert find("授信金额") == [("term", "授信金额")] and find("credit amount") == [("term", "授信金额")] and find("old") == []
    assert find("cafe") == [("table", "ods.Café")]
    both = search.search(glossary, tables, columns, closed, "credit_amt").collect()
    assert {r.family for r in both} == {"ads.ads_risk.credit_amt"} and not both[0].ambiguous
    assert ("table", "dws.dws_org") in find("organisation")
    assert ("term", "授信金额") in find("授信额")
    texts, skipped = search.vector_texts(glossary, columns, tables)
    assert {r.id for r in texts.collect()} == {"term:授信金额", "term:逾期率", "column:dws.dws_org.credit_amt"} and [tuple(r) for r in skipped.collect()] == [("no_increment", 1)]
    vectors = search.hash_embedding(texts)
    assert all(abs(sum(v * v for v in r.embedding) - 1) < 1e-9 and len(r.embedding) == 256 for r in vectors.collect())
    assert search.search(glossary, tables, columns, closed, "zzqqxx", vectors=vectors).isEmpty()


def test_quality(spark):
    assert quality.quotas({"a": 90, "b": 9, "c": 1}, 10) == {"a": 7, "b": 2, "c": 1} and quality.quotas({"a": 5, "b": 3, "c": 1}, 2) == {"a": 1, "b": 1}
    case = "case_id string, target string, sources array<string>, failed boolean"
    gold = spark.createDataFrame([("1", "t", ["a", "b"], False), ("2", None, [], True), ("3", "t", ["a"], False)], case)
    machine = spark.createDataFrame([("1", "t", ["b", "a"], False), ("2", None, [], True), ("3", "t", ["a", "c"], False)], case)
    assert {r.case_id: (r.agrees, r.extra) for r in quality.table_compared(gold, machine).collect()} == {"1": (True, []), "2": (True, []), "3": (False, ["c"])}
    assert quality.accepted(1.0, 0.9643) and not quality.accepted(0.98, 1.0)
    now = datetime.datetime(2026, 7, 25)
    runs = spark.createDataFrame([("1", "full", "success", now - datetime.timedelta(hours=30)), ("2", "full", "aborted", now - datetime.timedelta(hours=27))], "run_id string, run_type string, status string, started_at timestamp")
    assert {r.problem for r in quality.health(runs, 0, 300, F.lit(now)).collect()} == {"full_run_too_old", "last_run_not_successful", "too_many_failed_sql", "closure_empty"}
    assert quality.health(runs.filter("run_id = '1'"), 5, 0, F.lit(now - datetime.timedelta(hours=20))).isEmpty()
    audit = spark.createDataFrame([(now, "semantic", "refused", "no permit", 1), (now, "adhoc", "ok", None, 2), (now - datetime.timedelta(days=8), "adhoc", "ok", None, 3)], "ts timestamp, channel string, status string, refuse_reason string, user_id long")
    edges = spark.createDataFrame([("high",), ("medium",), (None,)], "confidence string")
    report = quality.weekly_markdown(audit, edges, spark.createDataFrame([("success", None)], "parse_status string, reason string"), F.lit(now))
    assert "requests: 2, users: 2, refusal ratio: 0.5, semantic ratio: 0.5" in report and "| no permit | 1 |" in report and "medium ratio: 0.3333, not high: 0.6667" in report


def test_state_changes(spark):
    e = "src string, dst string, edge_level string, sql_id string, src_type string, confidence string, is_self_loop boolean"
    edges = spark.createDataFrame([("a", "b", "table", "1", "sql", "high", False), ("x", "b", "table", None, "manual", "medium", False)], e)
    new = spark.createDataFrame([("y", "b", "table"), ("b", "b", "table")], "src string, dst string, edge_level string")
    once = diff.manual_edges(edges, new)
    assert sorted(map(str, once.collect())) == sorted(map(str, diff.manual_edges(once, new).collect())) and once.count() == 3
    old = spark.createDataFrame([(1, "c", True), (2, "d", False)], "id long, comment string, secret boolean")
    fresh = spark.createDataFrame([(1, "C", None), (3, "n", None)], "id long, comment string, secret boolean")
    assert {tuple(r) for r in diff.merged(old, fresh, ["id"], ["comment"]).collect()} == {(1, "C", True), (2, "d", False), (3, "n", None)}
    tables = spark.createDataFrame([("a", True), ("b", True)], "full_name string, is_online boolean")
    assert {tuple(r) for r in diff.soft_deleted(tables, tables.limit(0)).collect()} == {("a", True), ("b", True)}


def test_metastore(spark):
    df = spark.createDataFrame
    got = metastore_tables(df([(1, 1, 1, "t", "MANAGED_TABLE", "o"), (2, 1, 2, "v", "VIRTUAL_VIEW", "o")], "tbl_id int, db_id int, sd_id int, tbl_name string, tbl_type string, owner string"), df([(1, "db")], "db_id int, db_name string"), df([(1, "comment", "c"), (1, "k2", "second"), (1, "k1", "first")], "tbl_id int, param_key string, param_value string"), df([(1, 1, "b", "int"), (1, 0, "a", "int")], "sd_id int, integer_idx int, name string, type string"), df([(1, 0, "dt", "string")], "tbl_id int, integer_idx int, name string, type string"), ["k1", "k2"])
    rows = {r.full_name: r for r in got.collect()}
    assert [c.name for c in rows["db.t"].columns] == ["a", "b", "dt"] and rows["db.t"].owner == "first" and rows["db.v"].table_type == "view" and rows["db.v"].columns == []


METRIC = {"metric": "total", "base_table": "dws.summary", "expression": "SUM(base.amt)", "version": 3, "dimensions": {"org": {"column": "o.name", "join": {"alias": "o", "table": "dim.org", "on": "base.org_no = o.org_no"}}, "cust_no": {"column": "base.cust_no", "sensitivity": "L3"}, "id_card": {"column": "base.id_card", "sensitivity": "L4"}, "dt": {"column": "base.dt"}}, "default_filters": ["base.amt IS NOT NULL"], "row_policy": "base.org_no IN :user_orgs"}


def test_compiler():
    m, user = M.Metric.of(METRIC), {"user_orgs": ["O01", "O'2"]}
    a = M.compile_plan(m, {"dimensions": ["dt"], "filters": [{"field": "org", "op": "eq", "value": "x"}, {"field": "dt", "op": "gte", "value": "1"}], "limit": 5000}, user)
    b = M.compile_plan(m, {"dimensions": ["dt"], "filters": [{"field": "dt", "op": "gte", "value": "1"}, {"field": "org", "op": "eq", "value": "x"}], "limit": 5000}, user)
    assert a == b and a.sql.splitlines() == ["SELECT base.dt AS dt, SUM(base.amt) AS total", "FROM dws.summary AS base", "JOIN dim.org AS o ON base.org_no = o.org_no", "WHERE (base.amt IS NOT NULL) AND (base.dt >= '1') AND (o.name = 'x') AND (base.org_no IN ('O01', 'O\\'2'))", "GROUP BY base.dt", "LIMIT 1000"]
    assert M.compile_plan(m, {"limit": 0}, user).sql.endswith("LIMIT 1000")
    for plan, u, error in (({"dimensions": ["nope"]}, user, M.PlanError), ({"dimensions": ["id_card"]}, user, M.PermissionDenied), ({"filters": [{"field": "cust_no", "op": "eq", "value": 1}]}, user, M.PermissionDenied), ({}, {"user_orgs": []}, M.PermissionDenied), ({"limit": -1}, user, M.PlanError), ({"filters": [{"field": "dt", "op": "in", "value": []}]}, user, M.PlanError), ({"filters": [{"field": "dt", "op": "between", "value": [1]}]}, user, M.PlanError), ({"order_by": [{"field": "dt", "dir": "up"}]}, user, M.PlanError)):
        with pytest.raises(error):
            M.compile_plan(m, plan, u)
    assert M.compile_plan(m, {"dimensions": ["cust_no"]}, user | {"sensitive_whitelist": ["cust_no"]}).masked == ("cust_no",)


def test_guards(spark):
    ok = "SELECT a FROM x.t JOIN x.u USING (k) WHERE b > 1 GROUP BY a ORDER BY a LIMIT 5"
    M.guard_select(spark, ok)
    assert M.guard_scope(spark, "SELECT a FROM x.t", ["x.t"]).endswith("LIMIT 1000")
    for sql in ("SELECT a FROM x.t", "DROP TABLE x.t", "SELECT 1 LIMIT 1; SELECT 2 LIMIT 1", "INSERT INTO x.t SELECT 1", "(SELECT 1 AS a UNION ALL SELECT 2) LIMIT 5", "not sql", "SELECT a FROM x.t FOR UPDATE"):
        with pytest.raises(M.Rejected):
            M.guard_select(spark, sql)
    for sql, scope in (("SELECT a FROM t", ["x.t"]), ("SELECT a FROM x.u", ["x.t"]), ("SELECT a FROM x.t", []), ("WITH c AS (SELECT 1) SELECT * FROM c", ["x.t"]), ("SELECT a FROM x.t WHERE a IN (SELECT b FROM y.z)", ["x.t"])):
        with pytest.raises(M.Rejected):
            M.guard_scope(spark, sql, scope)


def test_guards_against_what_reaches_outside(spark):
    for sql in ("SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM x.t LIMIT 1", "SELECT a FROM x.t WHERE java_method('java.util.UUID', 'randomUUID') = a LIMIT 1", "SELECT max(try_reflect('a', 'b')) FROM x.t LIMIT 1", "SELECT my_own_udf(a) FROM x.t LIMIT 1", "SELECT a FROM x.t ORDER BY input_file_name() LIMIT 1", "SELECT a FROM (SELECT a FROM x.t LIMIT 5)", "WITH c AS (SELECT a FROM x.t LIMIT 5) SELECT a FROM c", "SELECT a FROM x.t WHERE a IN (SELECT reflect('a', 'b')) LIMIT 1"):
        with pytest.raises(M.Rejected):
            M.guard_select(spark, sql)
    M.guard_select(spark, "SELECT count(DISTINCT upper(a)) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY b) FROM x.t LIMIT 1")
    for sql in ("SELECT a FROM Ods.Secret LIMIT 1", "SELECT a FROM x.t JOIN ods.secret USING (a) LIMIT 1"):
        with pytest.raises(M.Rejected):
            M.guard_select(spark, sql, {"ods.secret"})
    M.guard_select(spark, "SELECT a FROM ods.secrets LIMIT 1", {"ods.secret"})
    assert M.guard_scope(spark, "SELECT a FROM (SELECT a FROM x.t LIMIT 5)", ["x.t"]).endswith("LIMIT 1000")


def test_policies():
    assert M.policy("base.o IN :orgs", {"orgs": ["a", "b"]}) == M.policy("base.o IN (:orgs)", {"orgs": ["a", "b"]}) == M.policy("base.o IN ( :orgs )", {"orgs": {"b", "a"}}) == "base.o IN ('a', 'b')"
    assert M.policy("o = :org AND p = (:org)", {"org": "it's"}) == "o = 'it\\'s' AND p = ('it\\'s')"
    assert M.policy(":a AND :ab", {"a": 1, "ab": 2}) == "1 AND 2"
    for user in ({}, {"orgs": []}, {"orgs": ""}, {"orgs": None}, {"orgs": set()}):
        with pytest.raises(M.PermissionDenied):
            M.policy("o IN :orgs", user)


def test_definitions_from_files(spark, tmp_path):
    """Definitions as people write them: base columns by `base`, a joined dimension, a policy without brackets."""
    (tmp_path / "visits.yaml").write_text("""metric: visits
cn_name: visits of clinics
caliber: visits added up
version: 4
base_table: care_day
expression: SUM(base.visits)
dimensions:
  ward: {column: base.ward}
  ward_name: {column: w.label, join: {alias: w, table: care_ward, "on": w.ward = base.ward}}
  patient: {column: base.patient, sensitivity: L3}
  secret: {column: base.patient, sensitivity: L4}
default_filters: [base.day IS NOT NULL]
row_policy: base.ward IN :wards
""")
    m = M.load_metrics(str(tmp_path))
    spark.createDataFrame([("a", "p1", 3, 1), ("a", "p2", 4, 2), ("b", "p3", 5, 3), ("a", "p4", 9, None)], "ward string, patient string, visits long, day int").createOrReplaceTempView("care_day")
    spark.createDataFrame([("a", "Ward A"), ("b", "Ward B")], "ward string, label string").createOrReplaceTempView("care_ward")
    ask = lambda plan, user={"wards": ["a"]}, **k: M.query_metric(spark, m, {"metric": "visits"} | plan, user, **k)
    assert ask({})["data"]["rows"] == [[7]] and ask({"dimensions": ["ward_name"]}, {"wards": ["a", "b"]})["data"]["row_count"] == 2
    assert ask({"filters": [{"field": "ward_name", "op": "eq", "value": "Ward A"}]})["data"]["rows"] == [[7]]
    assert ask({}, {"wards": []})["error"] == "PermissionDenied" and ask({"dimensions": ["secret"]})["error"] == "PermissionDenied"
    assert ask({}, blacklist={"CARE_DAY"})["error"] == "Rejected"
    path = f"file://{tmp_path}/audit"
    with pytest.raises(Exception):
        M.query_metric(spark, {"visits": M.Metric.of({"metric": "visits", "base_table": "care_day", "expression": "SUM(raise_here)"})} and {"visits": M.Metric.of({"metric": "visits", "base_table": "care_day", "expression": "SUM(CAST(base.ward AS int))"})}, {"metric": "visits"}, {}, path)
    spark.sql("CREATE DATABASE IF NOT EXISTS care")
    spark.sql("CREATE OR REPLACE VIEW care.v (n COMMENT 'how many') AS SELECT 7 AS n")
    try:
        said = []
        out = M.query_adhoc(spark, "how many?", ["care.v"], lambda q, c: said.append(c) or "SELECT n FROM care.v", {"user_id": "u"}, path)
        assert out["data"]["rows"] == [[7]] and said == ["care.v(n int -- how many)"]
        assert M.query_adhoc(spark, "?", ["care.v"], lambda q, c: "SELECT x FROM care.v", audit_path=path)["error"] == "Rejected"
        assert M.query_adhoc(spark, "?", ["care.v"], lambda q, c: "SELECT n FROM care.w", audit_path=path)["error"] == "Rejected"
    finally:
        spark.sql("DROP DATABASE care CASCADE")
    assert {(r.channel, r.status): r["count"] for r in spark.read.parquet(path).groupBy("channel", "status").count().collect()} == {("semantic", "error"): 1, ("adhoc", "ok"): 1, ("adhoc", "refused"): 2}
    families = spark.createDataFrame([("f", 1, "a.x"), ("f", 2, "a.y"), ("g", 1, "b.z"), ("g", 2, None)], "family string, rank_in_family int, node string")
    assert M.scope_of(families) == ["a.x", "b.z", "a.y"] and M.scope_of(families, 1) == ["a.x"]


def test_metric_endpoint_audits(spark, tmp_path):
    spark.createDataFrame([("C001", "O01", 100000.0), ("C002", "O01", 50000.0), ("C003", "O02", 88888.0)], "cust_no string, org_no string, amt double").createOrReplaceTempView("summary_t")
    m = {"total": M.Metric.of(METRIC | {"base_table": "summary_t"})}
    path = f"file://{tmp_path}/audit"
    out = M.query_metric(spark, m, {"metric": "total"}, {"user_id": "u", "user_orgs": ["O01"]}, path)
    assert out["data"]["rows"] == [[150000.0]] and out["label"] == "total@v3"
    assert M.query_metric(spark, m, {"metric": "total"}, {"user_id": "u"}, path)["error"] == "PermissionDenied"
    masked = M.query_metric(spark, m, {"metric": "total", "dimensions": ["cust_no"], "order_by": [{"field": "total"}]}, {"user_orgs": ["O01"], "sensitive_whitelist": ["cust_no"]}, path)
    assert masked["data"]["rows"] == [["C***", 50000.0], ["C***", 100000.0]] and masked["customer_query"]
    assert {(r.status, r["count"]) for r in spark.read.parquet(path).groupBy("status").count().collect()} == {("ok", 1), ("refused", 1), ("masked", 1)}


def test_generations(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}/t")
    assert g.current("a") is None and not g.rollback()
    g.swap({"a": g.write_shadow("a", spark.range(100)), "b": g.write_shadow("b", spark.range(10))})
    shadow, other = g.write_shadow("a", spark.range(130)), g.write_shadow("b", spark.range(11))
    assert abs(g.delta("a", shadow) - 0.3) < 1e-9
    assert "a changed by 30%" in g.swap_guarded({"a": shadow, "b": other}, {"b": 0.2, "a": 0.2}) and g.current("b").count() == 10
    assert g.swap_guarded({"a": shadow, "b": other}, {"a": 0.4}) is None
    assert (g.current("a").count(), g.current("b").count()) == (130, 11) and g.rollback() and (g.current("a").count(), g.current("b").count()) == (100, 10)


def test_rebuild_then_stream(spark, tmp_path):
    w = rebuild.Warehouse(spark, f"file://{tmp_path}/w")
    texts = [(k, c.sql) for k, c in CASES.items()]
    statements = spark.createDataFrame([(*t, True) for t in texts] + [("gone#1", "INSERT INTO a.b SELECT x FROM c.d", False)], "sql_id string, sql_text string, is_active boolean")
    stats = rebuild.full_rebuild(w, statements, SCHEMA, threads=2)
    assert stats["status"] == "success" and stats["statuses"] == STATUSES and stats["cycles"] == 0
    again = rebuild.full_rebuild(w, texts[:3], SCHEMA)
    assert again["status"] == "aborted" and "edges changed" in again["reason"] and w.runs().filter("status = 'aborted'").count() == 1
    assert w.statuses.count() == len(CASES)
    before = w.closure.count()
    landing = tmp_path / "in"
    landing.mkdir()
    source = CASES["cube"].target
    (landing / "a.json").write_text(json.dumps({"sql_id": "new#1", "sql_text": f"INSERT OVERWRITE TABLE mart.brand_new SELECT 1 FROM {source}", "published_at": "2026-07-01T00:00:00"}) + "\n")
    for _ in range(2):
        incremental.follow(w, f"file://{landing}", SCHEMA, f"file://{tmp_path}/cp", available_now=True).awaitTermination()
    closed = w.closure
    assert closed.count() == before + closed.filter("descendant = 'mart.brand_new'").count() > before
    want = brute_closure([(r.src, r.dst) for r in w.edges.filter("edge_level = 'table'").collect()])
    assert rows_of(closed) == want and w.statuses.count() == len(CASES) + 1


def state(w):
    edges = w.edges.filter("edge_level = 'table'").select("sql_id", "src", "dst", "is_derived", "transform_expr")
    return sorted(map(tuple, edges.collect()), key=str), rows_of(w.closure), sorted(map(tuple, w.statuses.select("sql_id", "parse_status").collect()))


def test_incremental_equals_full(spark, tmp_path):
    r = random.Random(5)
    tables = [f"s.t{k}" for k in range(4)] + [f"tmp_x.m{k}" for k in range(3)] + [f"m.u{k}" for k in range(4)]
    schema = {"s": {f"t{k}": {"a": "int"} for k in range(4)}, "tmp_x": {f"m{k}": {"a": "int"} for k in range(3)}, "m": {f"u{k}": {"a": "int"} for k in range(4)}}
    statement = lambda: f"INSERT INTO {r.choice(tables[4:])} SELECT a FROM {r.choice(tables)}"
    now = {f"q{k}": statement() for k in range(9)} | {"q9": "not sql"}
    one = rebuild.Warehouse(spark, f"file://{tmp_path}/one")
    for k, step in enumerate((list(now), ["q1", "q4", "new"], ["q9", "q2"])):  # the first on a fresh warehouse
        if k:
            now |= {i: statement() for i in step}
        rebuild.incremental(one, [(i, now[i]) for i in step], schema)
        other = rebuild.Warehouse(spark, f"file://{tmp_path}/full{k}")
        rebuild.full_rebuild(other, list(now.items()), schema)
        assert state(one) == state(other)


def test_chain_through_a_changed_task(spark, tmp_path):
    schema = {"ods": {"a": {"x": "int"}, "b": {"x": "int"}}, "tmp": {"m": {"x": "int"}}, "dwd": {"t": {"x": "int"}}}
    w = rebuild.Warehouse(spark, f"file://{tmp_path}/w")
    rebuild.full_rebuild(w, [("s1", "INSERT INTO tmp.m SELECT x FROM ods.a"), ("s2", "INSERT INTO dwd.t SELECT x FROM tmp.m")], schema)
    assert {(r.src, r.dst) for r in _pairs(w)} == {("ods.a", "dwd.t")}
    rebuild.incremental(w, [("s1", "INSERT INTO tmp.m SELECT x FROM ods.b")], schema)
    assert {(r.src, r.dst) for r in _pairs(w)} == {("ods.b", "dwd.t")} == {(r.ancestor, r.descendant) for r in w.closure.collect()}
    raw = w.store.current("raw").filter("edge_level = 'table'")
    task = rebuild.incremental_task(w, raw, spark.createDataFrame([("s1",), ("s2",)], "sql_id string"))
    assert [(r.src, r.dst, r.sql_id) for r in task.collect()] == [("ods.b", "dwd.t", "s2")]
    assert rebuild.incremental_task(w, raw, spark.createDataFrame([("s1",)], "sql_id string")).count() == 2


def _pairs(w):
    return w.edges.filter("edge_level = 'table'").collect()


def test_generator_is_reproducible(spark, tmp_path):
    assert generate(60, 80, 7) == generate(60, 80, 7) != generate(60, 80, 8)
    schema, statements = generate(60, 80, 7)
    assert sum(len(t) for d, t in schema.items() if d != "tmp_steps") == 60 and len(statements) == 80 + len(schema.get("tmp_steps", {}))
    parsed = lineage.parse_all(spark, statements, schema)
    assert [(i, p.status, p.reason, p.message) for i, p in parsed if p.status != "success" or p.reason] == []
    paths = synth.stored(spark, f"file://{tmp_path}/w", 20, 20)
    assert spark.read.parquet(paths["statements"]).count() == len(generate(20, 20)[1]) and spark.read.parquet(paths["tables"]).filter("layer = 'ods'").count() > 3


def test_row_count_goes_beyond_the_page(spark, tmp_path):
    """Rows come as a page of MAX_ROWS; row_count and its receipt count all, or as many as the plan asks for."""
    n = M.MAX_ROWS + 7
    spark.range(n).selectExpr("concat('C', id) as cust_no", "'O01' as org_no", "1.0D as amt").createOrReplaceTempView("many_t")
    m, path = {"total": M.Metric.of(METRIC | {"base_table": "many_t"})}, f"file://{tmp_path}/audit"
    user = {"user_orgs": ["O01"], "sensitive_whitelist": ["cust_no"]}
    for limit, count in ((None, n), (n - 3, n - 3), (5, 5)):
        data = M.query_metric(spark, m, {"metric": "total", "dimensions": ["cust_no"], "limit": limit}, user, path)["data"]
        assert (data["row_count"], len(data["rows"])) == (count, min(count, M.MAX_ROWS))
    assert sorted(r.row_count for r in spark.read.parquet(path).collect()) == [5, n - 3, n]


def test_hash_parts_keep_no_state_of_grams(spark):
    """No aggregate runs over exploded grams; texts of one id count as one, one without grams is the first unit vector."""
    texts = spark.createDataFrame([(1, "Ab c"), (2, None), (3, "ab"), (3, "c"), (4, "abc")], "id long, text string")
    parts = search.hash_parts(texts)
    assert "dim" not in "".join(x for x in parts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x)
    rows = {}
    for r in parts.collect():
        rows.setdefault(r.id, {})[r.dim] = r.value
    assert rows[2] == {0: 1.0} and rows[1] == rows[4] != rows[3] and all(abs(sum(v * v for v in x.values()) - 1) < 1e-12 for x in rows.values())
