"""Reachability on directed graphs without their closure: strong components, hub labels, paths between many pairs at once, and the
closure kept up to date by deltas.

Edges are (src, dst); self-loops and repeated edges change nothing, null ends are left out. Loops run one job a round and write each round to
the shared folder; nothing but a round's row count comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.graph import components
from lakeloom.sources.tables import counted, stored

TRIMS = 3  # rounds of trimming before each colouring


def plain(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src <> dst").distinct()


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).filter("node is not null").distinct()


# --- strong components ---------------------------------------------------------------------------------------------------


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component: the least node among those that reach it and are reached from it; itself for most.

    Trimming: an edge whose source nothing enters, or whose target nothing leaves, lies on no cycle. Colouring: every node takes the least
    node that reaches it, from frontiers of nodes whose colour changed. A component has one colour, and a node of its own colour
    is the root of one: what reaches the root inside its colour is its component. Edges between colours go, the rest starts anew."""
    whole = stored(plain(edges), "edges")
    live, n, _ = counted(whole, "live")
    found = None
    while n:
        for _ in range(TRIMS):
            before = n
            trimmed = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            live, n, _ = counted(trimmed.select("src", "dst"), "live")
            if n in (0, before):
                break
        if not n:
            break
        colours = _colours(live)
        own = colours.select(F.col("node").alias("src"), F.col("colour").alias("src_colour"))
        other = colours.select(F.col("node").alias("dst"), F.col("colour").alias("dst_colour"))
        inside = stored(live.join(own, "src").join(other, "dst").filter("src_colour = dst_colour").select("src", "dst"), "coloured")
        frontier = colours.filter("node = colour").select("node", F.col("node").alias("component"))
        done, m = None, 1
        while m:
            frontier, m, _ = counted(frontier, "backward")
            done = frontier if done is None else done.union(frontier)
            step = inside.join(frontier, inside["dst"] == frontier["node"]).select(F.col("src").alias("node"), "component").distinct()
            frontier = step.join(done, ["node", "component"], "left_anti")
        found = done if found is None else found.union(done)
        gone = done.select("node")
        rest = inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        live, n, _ = counted(rest.select("src", "dst"), "live")
    every = nodes_of(edges)
    if found is None:
        return every.withColumn("component", F.col("node"))
    return every.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _colours(live: DataFrame) -> DataFrame:
    """node, colour: the least node that reaches a node (itself included)."""
    colours = stored(nodes_of(live).withColumn("colour", F.col("node")), "colours")
    frontier = colours
    while True:
        told = live.join(frontier, live["src"] == frontier["node"]).groupBy(F.col("dst").alias("to")).agg(F.min("colour").alias("told"))
        new = colours.join(told, F.col("node") == F.col("to"), "left").select("node", F.least("colour", "told").alias("new"), F.coalesce(F.col("told") < F.col("colour"), F.lit(False)).alias("changed"))
        new, _, (changed,) = counted(new.withColumnRenamed("new", "colour"), "colours", F.col("changed"))
        colours = new.drop("changed")
        if not changed:
            return colours
        frontier = new.filter("changed").drop("changed")


def cyclic(components: DataFrame) -> DataFrame:
    """a < b that reach each other: the pairs inside components."""
    a, b = (components.select("component", F.col("node").alias(c)) for c in "ab")
    return a.join(b, "component").filter("a < b").select("a", "b")


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges between components: a graph without cycles."""
    side = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    return plain(plain(edges).join(side("src"), "src").join(side("dst"), "dst").select(F.col("src_of").alias("src"), F.col("dst_of").alias("dst")))


# --- hub labels ----------------------------------------------------------------------------------------------------------


LAST = (1 << 63) - 1


def hub_labels(edges: DataFrame) -> DataFrame:
    """node, hub, side, place: a reaches b (not a itself) exactly if an out label of a and an in label of b have one hub, the former's place not
    behind the latter's. An `out` label says that a node reaches its hub's places from this one on, `in` that the places up to this one reach it.

    Nodes with edges both ways are one to begin with. Links that alone leave their source and alone enter their target make runs, whose
    nodes have places in order; a node's own labels name its run, so a chain of any length costs two labels a node. Between runs,
    labels come from contraction (_hubs). A run on a cycle is one place."""
    whole = stored(plain(edges), "edges")
    met = stored(whole.filter("src < dst").intersect(turned(whole.filter("src > dst"))), "both-ways")
    group = None if met.isEmpty() else components(met.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    if group is not None:
        for c in ("src", "dst"):
            whole = whole.join(group.select(F.col("node").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
        whole = stored(plain(whole), "merged")
    placed = _runs(whole)
    side = lambda c: placed.select(F.col("node").alias(c), F.col("run").alias(f"{c}_run"), F.col("place").alias(f"{c}_place"))
    between = whole.join(side("src"), "src").join(side("dst"), "dst").filter("src_run <> dst_run or dst_place <= src_place")
    between = stored(between.select(F.col("src_run").alias("src"), F.col("dst_run").alias("dst")).distinct(), "between")
    links = _hubs(between)
    # a cycle of runs has a hub that others on it reach and are reached from
    round_trip = links.filter("side = 'out'").select("node", "hub").intersect(links.filter("side = 'in'").select("node", "hub"))
    turning = between.filter("src = dst").select(F.col("src").alias("run")).union(round_trip.select(F.explode(F.array("node", "hub")))).distinct()
    placed = placed.join(turning.withColumn("turns", F.lit(True)), "run", "left").select("node", "run", F.when(F.col("turns"), 0).otherwise(F.col("place")).cast("long").alias("place"))
    every = nodes_of(edges)
    if group is None:
        known = every.join(placed, "node", "left")
    else:
        held = every.join(group, "node", "left").select("node", F.coalesce("component", "node").alias("of"))
        known = held.join(placed.withColumnRenamed("node", "of"), "of", "left")
    known = stored(known.select("node", F.coalesce("run", "of" if group is not None else "node").alias("run"), F.coalesce("place", F.lit(0)).alias("place")), "placed")
    own = known.select("node", F.col("run").alias("hub"), F.explode(F.array(F.lit("out"), F.lit("in"))).alias("side"), "place")
    far = known.select("node", "run").join(links.withColumnRenamed("node", "run"), "run")
    return own.union(far.select("node", "hub", "side", F.when(F.col("side") == "out", 0).otherwise(LAST).cast("long")))


def _runs(whole: DataFrame) -> DataFrame:
    """node, run, place of the nodes of links that alone leave their source and alone enter their target: run is the first node of such a chain; a
    cycle of links is one place, its run the least node. Tasks first shorten what lies in one of them (a range of sources), then
    pointers double over what is left."""
    one = lambda c: whole.groupBy(c).agg(F.count("*").alias("n")).filter("n = 1").select(c)
    links = whole.join(one("src"), "src", "left_semi").join(one("dst"), "dst", "left_semi")
    kind = dict(whole.dtypes)["src"]

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The links of a task → a row for each of their targets: the first node of its chain here, how far it is away, whether it is the last here."""
        own = list(batches)
        if not own:
            return
        held = pa.Table.from_batches(own)
        both = pa.concat_arrays([c for name in ("src", "dst") for c in held.column(name).chunks]).dictionary_encode()
        code, n = both.indices.to_numpy(), held.num_rows
        size = len(both.dictionary)
        before, steps = np.arange(size), np.zeros(size, np.int64)
        before[code[n:]], steps[code[n:]] = code[:n], 1
        ends = np.ones(size, bool)
        ends[code[:n]] = False
        first = before.copy()
        for _ in range(size.bit_length()):
            steps, first = steps + steps[first], first[first]
        closed = before[first] != first  # on a cycle that lies here whole: left as it is
        first, steps = np.where(closed, before, first), np.where(closed, 1, steps)
        to = code[n:]
        columns = [both.dictionary.take(pa.array(to)), both.dictionary.take(pa.array(first[to])), pa.array(steps[to]), pa.array(ends[to] | closed[to])]
        yield pa.RecordBatch.from_arrays(columns, ["node", "from", "steps", "last"])

    parts = max(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")), whole.count() >> 20)
    ranged = links.repartitionByRange(parts, "src")
    short = stored(ranged.mapInArrow(shorten, f"node {kind}, from {kind}, steps long, last boolean"), "shortened")
    # pointers: each end of a shortened piece to the start of it; starts that are no ends stay
    rest, n, _ = counted(short.filter("last").select("node", F.col("from").alias("to"), "steps", F.least("node", "from").alias("least"), F.lit(False).alias("done")), "pointers")
    for _ in range(n.bit_length() + 1 if n else 0):
        ahead = rest.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"))
        on = rest.filter("not done").join(ahead, "to", "left")
        moved = on.select("node", F.coalesce("to2", "to").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.least("least", "least2").alias("least"), F.col("to2").isNull().alias("done"))
        rest, _, (open_,) = counted(rest.filter("done").union(moved), "pointers", ~F.col("done"))
        if not open_:
            break
    # what is still open lies on a cycle
    ends = rest.select("node", F.when(F.col("done"), F.col("to")).otherwise(F.col("least")).alias("run"), F.when(F.col("done"), F.col("steps")).otherwise(F.lit(0)).alias("place"), ~F.col("done"))
    ends = stored(ends.toDF("node", "run", "place", "cycle"), "ends")
    inside = short.filter("not last").join(ends.withColumnRenamed("node", "from"), "from", "left")
    inside = inside.select("node", F.coalesce("run", "from").alias("run"), F.when(F.col("cycle"), 0).otherwise(F.coalesce("place", F.lit(0)) + F.col("steps")).alias("place"))
    found = ends.select("node", "run", "place").union(inside)
    rest = nodes_of(whole).join(found.select("node"), "node", "left_anti")
    return stored(found.union(rest.select("node", "node", F.lit(0).cast("long"))), "runs")


def _hubs(edges: DataFrame) -> DataFrame:
    """node, hub, side: `out` hubs that a node reaches, `in` hubs that reach it, itself aside, so that a reaches b exactly if an out hub of
    a (or a) is an in hub of b (or b).

    Nodes are contracted round by round, those first whose degree (then hash) is least among their neighbours: a contracted node keeps its
    edges to what is left as links upwards, and each way through it becomes an edge. Every way between two nodes can then be
    bent into one that goes up to its last contracted node and down from there; hubs are what links upwards reach, found by doubling.
    Trees of n nodes get about log n hubs a node. Cycles are welcome; dense ones are best condensed first."""
    live, n, _ = counted(plain(edges).select("src", "dst", F.lit(0).alias("kind")), "live")
    ups = None
    while n:
        pair = lambda a, b, live=live: live.select(F.col(a).alias("node"), F.col(b).alias("other"))
        beside = stored(pair("src", "dst").union(pair("dst", "src")), "beside")
        rank = beside.groupBy("node").agg(F.count("*").alias("degree")).select("node", F.struct("degree", F.xxhash64("node").alias("hash"), "node").alias("rank"))
        near = beside.join(rank.select(F.col("node").alias("other"), "rank"), "other").groupBy("node").agg(F.min("rank").alias("near"))
        chosen = stored(rank.join(near, "node").filter("rank < near").select("node"), "chosen")
        mark = lambda side, chosen=chosen: chosen.select(F.col("node").alias(side), F.lit(True).alias(f"{side}_goes"))
        marked = stored(live.select("src", "dst").join(mark("src"), "src", "left").join(mark("dst"), "dst", "left"), "marked")
        leaving, entering = marked.filter("src_goes"), marked.filter("dst_goes")
        short = entering.select(F.col("src").alias("from"), F.col("dst").alias("via")).join(leaving.select(F.col("src").alias("via"), F.col("dst").alias("to")), "via")
        rest = marked.filter("src_goes is null and dst_goes is null").select("src", "dst").union(short.filter("from <> to").select("from", "to")).distinct()
        kinds = rest.withColumn("kind", F.lit(0)).union(leaving.select("src", "dst", F.lit(1))).union(entering.select("dst", "src", F.lit(2)))
        whole, _, (more,) = counted(kinds, "contracted", F.col("kind") == 0)
        live, up = whole.filter("kind = 0"), whole.filter("kind > 0")
        ups = up if ups is None else ups.union(up)
        n = int(more)
    if ups is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("hub"), F.lit("out").alias("side")).filter("false")
    links, n, _ = counted(ups.select(F.col("src").alias("node"), F.col("dst").alias("hub"), F.when(F.col("kind") == 1, "out").otherwise("in").alias("side")), "links")
    while True:
        before = n
        further = links.join(links.select(F.col("node").alias("hub"), F.col("hub").alias("top"), "side"), ["hub", "side"]).select("node", F.col("top").alias("hub"), "side")
        links, n, _ = counted(links.union(further).distinct(), "links")
        if n == before:
            return links.filter("node <> hub")


def reaches(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) → a, b (distinct, none null), reaches: whether there is a way from a to b; nothing reaches itself."""
    asked = pairs.select("a", "b").filter("a is not null and b is not null").distinct()
    up = labels.filter("side = 'out'").select(F.col("node").alias("a"), "hub", F.col("place").alias("from"))
    down = labels.filter("side = 'in'").select(F.col("node").alias("b"), F.col("hub").alias("down"), F.col("place").alias("upto"))
    fits = [F.col("t.b") == F.col("d.b"), F.col("hub") == F.col("down"), F.col("from") <= F.col("upto")]
    good = asked.filter("a <> b").join(up, "a").alias("t").join(down.alias("d"), fits, "left_semi").select("a", "b").distinct().withColumn("reaches", F.lit(True))
    return asked.join(good, ["a", "b"], "left").na.fill(False, ["reaches"])


# --- paths between many pairs --------------------------------------------------------------------------------------------


def path_counts(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) → a, b, hops, path_cnt: the length and number of the shortest paths; pairs without a path, and pairs of one node, have no row.

    Frontiers go from all a forward and from all b backward, each a hop in turn, and carry path counts. When they have gone f and g hops,
    the pairs at distance f + g are those with a common node in both frontiers, and every shortest path passes one: its count is
    the sum of products there. Settled pairs leave, and ends that no pair waits for stop; rounds are half the greatest distance."""
    there = stored(plain(edges), "edges")
    back = turned(there)
    waiting, n, _ = counted(pairs.select("a", "b").filter("a <> b").distinct(), "pairs")
    frontiers = {c: waiting.select(F.col(c), F.col(c).alias("at"), F.lit(1).cast("long").alias("ways")).distinct() for c in "ab"}
    seen = {c: frontiers[c].select(c, "at") for c in "ab"}
    found, hops = None, 0
    while n:
        side = "ab"[hops % 2]
        graph = there if side == "a" else back
        front = frontiers[side].join(waiting.select(side).distinct(), side, "left_semi")
        step = front.join(graph, front["at"] == graph["src"]).groupBy(side, F.col("dst").alias("next")).agg(F.sum("ways").alias("ways")).withColumnRenamed("next", "at")
        new, m, _ = counted(step.join(seen[side], [side, "at"], "left_anti"), "front")
        if not m:
            break
        frontiers[side], seen[side] = new, seen[side].union(new.select(side, "at"))
        hops += 1
        met = _met(waiting, frontiers["a"], frontiers["b"])
        met, k, _ = counted(met.select("a", "b", F.lit(hops).alias("hops"), "path_cnt"), "met")
        if k:
            found = met if found is None else found.union(met)
            waiting, n, _ = counted(waiting.join(met, ["a", "b"], "left_anti").select("a", "b"), "pairs")
    none = pairs.select("a", "b", F.lit(0).alias("hops"), F.lit(0).cast("long").alias("path_cnt")).filter("false")
    return none if found is None else found


def _met(waiting: DataFrame, front_a: DataFrame, front_b: DataFrame) -> DataFrame:
    """a, b, path_cnt: the pairs of waiting with a common node in both frontiers. Of three orders of the joins the one with fewest rows between
    them is taken: pairs with the frontier of their a, pairs with that of their b, or both frontiers by node, pairs last."""
    mine, other = (f.withColumnRenamed("ways", f"ways_{c}") for c, f in (("a", front_a), ("b", front_b)))

    def rows(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
        n, m = left.groupBy(on).agg(F.count("*").alias("n")), right.groupBy(on).agg(F.count("*").alias("m"))
        return n.join(m, on).agg(F.lit(on).alias("by"), F.coalesce(F.sum(F.col("n").cast("double") * F.col("m")), F.lit(0.0)).alias("rows"))

    between = {r.by: r.rows for r in rows(waiting, mine, "a").union(rows(waiting, other, "b")).union(rows(mine, other, "at")).collect()}
    ways = F.sum(F.col("ways_a") * F.col("ways_b")).alias("path_cnt")
    if between["at"] <= min(between["a"], between["b"]):
        return mine.join(other, "at").groupBy("a", "b").agg(ways).join(waiting, ["a", "b"], "left_semi")
    both = waiting.join(mine, "a").join(other, ["b", "at"]) if between["a"] <= between["b"] else waiting.join(other, "b").join(mine, ["a", "at"])
    return both.groupBy("a", "b").agg(ways)


# --- the closure by deltas -----------------------------------------------------------------------------------------------

PAIR = ["ancestor", "descendant"]


def _spread(ends: DataFrame, steps: DataFrame, jumps: DataFrame, some_jumps: bool) -> DataFrame:
    """(of, node): what each end of ends(of) leads to, itself included, by a closure, steps(from, far), and further edges, jumps(from, to). A round
    follows one such edge and the closure behind it."""

    def on(frontier: DataFrame) -> DataFrame:
        further = frontier.join(steps, frontier["node"] == steps["from"]).select("of", F.col("far").alias("node"))
        return frontier.union(further).distinct()

    frontier = stored(on(ends.select("of", F.col("of").alias("node"))), "spread")
    seen, n = frontier, int(some_jumps)
    while n:
        jumped = frontier.join(jumps, frontier["node"] == jumps["from"]).select("of", F.col("to").alias("node")).distinct()
        frontier, n, _ = counted(on(jumped).join(seen, ["of", "node"], "left_anti"), "spread")
        if n:
            seen = seen.union(frontier)
    return seen


def affected(closed: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(ancestor, descendant) whose paths may have changed: a changed edge lies on some way between them over old and new edges; and the
    new edges. None if no edge changed. closed: the closure of the old edges, so only what edges that came add is followed anew."""
    old, new = stored(plain(old_edges), "old"), stored(plain(new_edges), "new")
    came = new.exceptAll(old).withColumn("came", F.lit(True))
    changed, n, (some,) = counted(old.exceptAll(new).withColumn("came", F.lit(False)).union(came), "changed", F.col("came"))
    if not n:
        return None
    came = changed.filter("came")
    up = closed.select(F.col("descendant").alias("from"), F.col("ancestor").alias("far"))
    down = closed.select(F.col("ancestor").alias("from"), F.col("descendant").alias("far"))
    above = _spread(changed.select(F.col("src").alias("of")).distinct(), up, came.select(F.col("dst").alias("from"), F.col("src").alias("to")), some)
    below = _spread(changed.select(F.col("dst").alias("of")).distinct(), down, came.select(F.col("src").alias("from"), F.col("dst").alias("to")), some)
    pairs = changed.join(above.select(F.col("of").alias("src"), F.col("node").alias("ancestor")), "src").join(below.select(F.col("of").alias("dst"), F.col("node").alias("descendant")), "dst")
    return stored(pairs.filter("ancestor <> descendant").select(*PAIR).distinct(), "affected"), new


def closure_delta(closed: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """closed: the closure of old_edges (see graph.closure). Signed rows that turn it into that of new_edges: ancestor, descendant, min_hops, path_cnt, sign (-1: an
    old row that goes, 1: a new one). Rows that stay as they are do not appear.

    Only affected pairs are made anew, level by level: a pair of h hops gets its paths from pairs of h - 1 hops whose last node has an
    edge to it. Those are unaffected ones, which the closure knows, or affected ones that the level before has settled."""
    found = affected(closed, old_edges, new_edges)
    if found is None:
        return closed.filter("false").withColumn("sign", F.lit(0))
    pairs, new = found
    into = stored(pairs.join(new.withColumnRenamed("dst", "descendant"), "descendant").select(*PAIR, F.col("src").alias("last")), "into")
    known = closed.select("ancestor", F.col("descendant").alias("last"), F.col("min_hops").alias("h"), F.col("path_cnt").alias("c"))
    stays = known.join(pairs.select("ancestor", F.col("descendant").alias("last")), ["ancestor", "last"], "left_anti")
    given = into.join(stays, ["ancestor", "last"]).select(*PAIR, (F.col("h") + 1).alias("h"), "c")
    given = given.union(into.filter("ancestor = last").select(*PAIR, F.lit(1).alias("h"), F.lit(1).cast("long").alias("c")))
    given, n, _ = counted(given.groupBy(*PAIR, "h").agg(F.sum("c").alias("c")), "given")
    made, level, m = None, 0, 0
    while n or m:
        level += 1
        step = given.filter(F.col("h") == level).select(*PAIR, "c")
        if m:
            onward = front.select("ancestor", F.col("descendant").alias("last"), F.col("path_cnt").alias("c"))
            step = step.union(into.join(onward, ["ancestor", "last"]).select(*PAIR, "c"))
        if made is not None:
            step = step.join(made, PAIR, "left_anti")
        front, m, _ = counted(step.groupBy(*PAIR).agg(F.sum("c").alias("path_cnt")).select(*PAIR, F.lit(level).alias("min_hops"), "path_cnt"), "level")
        if m:
            made = front if made is None else made.union(front)
        elif n:
            n = given.filter(F.col("h") > level).count()
    fields = [*PAIR, "min_hops", "path_cnt"]
    before = closed.join(pairs, PAIR, "left_semi").select(fields)
    after = before.filter("false") if made is None else made
    same = before.intersect(after)
    signed = lambda rows, sign: rows.join(same.select(*PAIR), PAIR, "left_anti").withColumn("sign", F.lit(sign))
    return stored(signed(before, -1).unionByName(signed(after, 1)), "delta")


def applied(closed: DataFrame, delta: DataFrame) -> DataFrame:
    """The closure after a delta."""
    gone = delta.filter("sign < 0").select(*PAIR)
    return closed.join(gone, PAIR, "left_anti").unionByName(delta.filter("sign > 0").select(closed.columns))


def maintained(closed: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    return applied(closed, closure_delta(closed, old_edges, new_edges))
