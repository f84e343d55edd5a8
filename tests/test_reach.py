"""Components, labels, many paths and closure deltas against plain breadth-first searches over random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import fold, graph, reach

EDGES = "src long, dst long"


def bfs(edges, start):
    """node: (hops, shortest paths) of what start reaches, itself aside."""
    near = {}
    for a, b in set(edges):
        if a != b and None not in (a, b):
            near.setdefault(a, []).append(b)
    found, front, hops = {start: (0, 1)}, {start: 1}, 0
    while front:
        hops, new = hops + 1, {}
        for x, ways in front.items():
            for y in near.get(x, ()):
                if y not in found:
                    new[y] = new.get(y, 0) + ways
        found |= {y: (hops, ways) for y, ways in new.items()}
        front = new
    del found[start]
    return found


def nodes_of(edges):
    return sorted({x for e in edges for x in e if x is not None})


def graph_of(seed):
    r = random.Random(seed)
    n, m = ((40, 30), (40, 55), (25, 120))[seed]
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(100, 108)] + [(105, 102)]
    new = [e for e in edges if r.random() > 0.1] + [(r.randrange(n), r.randrange(n)) for _ in range(5)] + [(200, 103)]
    return edges + edges[:5] + [(3, 3), (500, 500), (None, 1), (2, None)], new


@pytest.mark.parametrize("seed", (0, 2))
def test_against_breadth_first_search(spark, seed):
    old, new = graph_of(seed)
    df, df2 = spark.createDataFrame(old, EDGES), spark.createDataFrame(new, EDGES)
    nodes = nodes_of(old)
    ways = {a: bfs(old, a) for a in nodes}
    parts = {x.node: x.component for x in reach.strong_components(df).collect()}
    assert parts == {a: min([b for b in ways[a] if a in ways[b]] + [a]) for a in nodes}
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes] + [(None, 1), (1, 999)], "a long, b long")
    got = {(x.a, x.b): x.reaches for x in reach.reaches(reach.hub_labels(df), pairs).collect()}
    assert got == {(a, b): b in ways[a] for a in nodes for b in nodes} | {(1, 999): False}
    clean = df.filter("src is not null and dst is not null")
    counts = {(x.a, x.b): (x.hops, x.path_cnt) for x in reach.path_counts(clean, pairs).collect()}
    assert counts == {(a, b): found for a in nodes for b, found in ways[a].items()}
    closed = graph.closure(clean)
    delta = reach.closure_delta(closed, clean, df2)
    before = {(a, b, *found) for a in nodes for b, found in ways[a].items()}
    after = {(a, b, *found) for a in nodes_of(new) for b, found in bfs(new, a).items()}
    assert {tuple(x) for x in reach.applied(closed, delta).collect()} == after
    assert {tuple(x) for x in delta.collect()} == {(*x, -1) for x in before - after} | {(*x, 1) for x in after - before}


def test_deltas_are_small_where_changes_are(spark):
    """A chain's last edge: one row for each ancestor, nothing else."""
    chain = [(k, k + 1) for k in range(12)]
    df = lambda e: spark.createDataFrame(e, EDGES)
    closed = graph.closure(df(chain))
    rows = reach.closure_delta(closed, df(chain), df(chain[:-1])).collect()
    assert len(rows) == 12 and {r.descendant for r in rows} == {12} and {r.sign for r in rows} == {-1}
    assert reach.closure_delta(closed, df(chain), df(chain[::-1])).isEmpty()


def test_labels_of_a_long_chain_are_few(spark):
    n = 300
    df = spark.createDataFrame([(k, k + 1) for k in range(n)], EDGES)
    labels = reach.hub_labels(df)
    assert labels.count() < 2 * n * 12 < n * n / 4
    pairs = spark.createDataFrame([(a, b) for a in range(0, n, 29) for b in range(0, n, 31)], "a long, b long")
    assert all(x.reaches == (x.a < x.b) for x in reach.reaches(labels, pairs).collect())


def test_empty_graphs(spark):
    none = spark.createDataFrame([], EDGES)
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert reach.strong_components(none).isEmpty() and reach.hub_labels(none).isEmpty() and reach.path_counts(none, pairs).isEmpty()
    assert [tuple(x) for x in reach.reaches(reach.hub_labels(none), pairs).collect()] == [(1, 2, False)]
    loops = spark.createDataFrame([(1, 1), (2, 2)], EDGES)
    assert sorted(tuple(x) for x in reach.strong_components(loops).collect()) == [(1, 1), (2, 2)]
    closed = graph.closure(none)
    some = spark.createDataFrame([(1, 2)], EDGES)
    assert [tuple(x) for x in reach.closure_delta(closed, none, some).collect()] == [(1, 2, 1, 1, 1)]


def test_components_condense(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 1)], EDGES)
    parts = reach.strong_components(df)
    assert sorted(tuple(x) for x in reach.condensed(df, parts).collect()) == [(1, 3), (5, 1)]
    assert sorted(tuple(x) for x in reach.cyclic(parts).collect()) == [(1, 2), (3, 4)]


def simple_chains(edges, tmp):
    """Ids of edges on chains from outside tmp through distinct tmp nodes to outside, by following all of them."""
    used = set()

    def follow(at, chain, visited):
        for i, a, b in edges:
            if a == at:
                if b not in tmp:
                    used.update([*chain, i])
                elif b not in visited:
                    follow(b, [*chain, i], visited | {b})

    for i, a, b in edges:
        if a not in tmp and b in tmp:
            follow(b, [i], {b})
    return used


@pytest.mark.parametrize("seed", range(3))
def test_used_edges(spark, seed):
    r = random.Random(seed)
    edges = [(str(k), f"n{r.randrange(11)}", f"n{r.randrange(11)}") for k in range(22)]
    tmp = {f"n{k}" for k in range(7)}
    df = spark.createDataFrame([(i, a, b, "q") for i, a, b in edges], "edge_id string, src string, dst string, sql_id string")
    got = {x.edge_id for x in fold.used_edges(df, spark.createDataFrame([(x,) for x in tmp], "node string")).collect()}
    assert got == simple_chains(edges, tmp)


def test_quick_reads(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), *(("hub", f"x{k:03}") for k in range(300))], "src string, dst string")
    rows, cut = graph.neighbourhood(edges, "a", depth=3)
    want = graph.lineage(edges, spark.createDataFrame([("a",)], "node string"), depth=3)
    assert not cut and sorted((x["src"], x["dst"], x["level"]) for x in rows) == sorted(tuple(x) for x in want.select("src", "dst", "level").collect())
    rows, cut = graph.neighbourhood(edges, "hub")
    assert cut and len(rows) == graph.MAX_NODES - 1
    assert graph.neighbourhood(edges, "e") == ([], False)
    assert [x["src"] for x in graph.neighbourhood(edges, "e", upstream=True, depth=1)[0]] == ["d"]


def test_null_free_columns(spark):
    df = spark.createDataFrame([(1, 2, "x"), (2, 3, None)], "src long, dst long, component string")
    assert reach.strong_components(df).columns == ["node", "component"]
    assert reach.hub_labels(df).filter(F.col("node").isNull()).isEmpty()


def test_pairs_meet_by_the_shortest_order_of_joins(spark):
    """A source with many middle nodes and many targets of one middle node each: pairs times middle nodes never meet. All orders agree."""
    width = 60
    edges = [("s", f"m{k}") for k in range(width)] + [(f"m{k}", f"t{k}") for k in range(width)]
    df = spark.createDataFrame(edges + [(b, a + "x") for a, b in edges], "src string, dst string")
    pairs = spark.createDataFrame([("s", f"t{k}") for k in range(width)] + [("s", "none")], "a string, b string")
    assert {tuple(x) for x in reach.path_counts(df, pairs).collect()} == {("s", f"t{k}", 2, 1) for k in range(width)}
    front = lambda rows, c: spark.createDataFrame(rows, f"{c} string, at string, ways long")
    mine, other = front([("s", f"m{k}", 1) for k in range(width)], "a"), front([(f"t{k}", f"m{k}", 1) for k in range(width)], "b")
    plan = reach._met(pairs, mine, other)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Inner")  # pairs come last
    few = pairs.filter("b = 't7'")
    for a, b in ((mine, other), (mine.filter("at = 'm7'"), other), (mine, other.filter("at = 'm7'"))):
        assert [tuple(x) for x in reach._met(few, a, b).collect()] == [("s", "t7", 1)]


def test_runs_cost_two_labels_a_node(spark):
    """A chain with links back, a bare cycle and a chain that ends in a cycle; ids in no order."""
    r = random.Random(5)
    ids = r.sample(range(1000), 90)
    chain, ring, tail = ids[:40], ids[40:60], ids[60:]
    line = lambda x: list(zip(x, x[1:]))
    plain = line(chain) + [(b, a) for a, b in line(chain) if a % 5 == 0] + line(ring) + [(ring[-1], ring[0])]
    assert reach.hub_labels(spark.createDataFrame(plain, EDGES)).count() == 2 * 60
    edges = plain + line(tail) + [(tail[-1], tail[10])]
    labels = reach.hub_labels(spark.createDataFrame(edges, EDGES))
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids], "a long, b long")
    ways = {a: bfs(edges, a) for a in ids}
    assert {(x.a, x.b): x.reaches for x in reach.reaches(labels, pairs).collect()} == {(a, b): b in ways[a] for a in ids for b in ids}
