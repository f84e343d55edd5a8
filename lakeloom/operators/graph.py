"""Lineage graphs as node and edge DataFrames: closure, traversal, paths, impact, families (see reach.py for cycles, labels and deltas).

Loops run one job a level and write each level to the shared folder, so plans stay short and no level lives on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.tables import PER_TASK, counted, spread, stored

MAX_NODES, MAX_HOPS = 200, 2000


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src <> dst").distinct()


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("ancestor"), F.col("dst").alias("descendant"), F.lit(1).alias("min_hops"), F.lit(1).cast("long").alias("path_cnt"))


def _dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """As spread; what one task could hold is dealt without a number, so Spark joins small partitions up."""
    return spread(df, rows, *keys) if rows > PER_TASK else df.repartition(*keys)


def closure(edges: DataFrame, sources: DataFrame | None = None, kept: bool = True) -> DataFrame:
    """edges(src, dst) → ancestor, descendant, min_hops, path_cnt (number of shortest paths); nothing reaches itself. sources(src):
    only from these ancestors. kept=False: the outermost layer, most of the rows, is not written but made as it is read, for who reads it once.

    Edges into nodes that lead nowhere are taken off as a layer, as long as a layer holds half of the edges that are left (so all layers together move
    twice the edges at most). What is then left, cycles among it, goes level by level; layers follow inside out, where pairs of a layer come from the pairs
    found so far and one step, and are summed once: they can be in no other layer.

    An edge moves once to be told apart and marked, once to meet its source's ancestors, and once with all of them in lists (see _packed) to its end,
    where they are summed. Hubs, where more than PER_TASK edges end, are dealt to several tasks."""
    starts = None if sources is None else sources.select("src").distinct()
    rest, layers, seen = edges.select("src", "dst").filter("src <> dst"), [], None
    found = edges.groupBy("dst").count().agg(F.sum("count"), F.max("count"), F.collect_list(F.when(F.col("count") > PER_TASK, F.col("dst")))).first()
    left, parts, hubs = found[0] or 0, (found[1] or 0) // PER_TASK + 1, found[2]  # a hub has PER_TASK edges, so hubs are few
    while True:
        marked, n, _ = counted(_marked(rest, left, hubs, parts), "layer")
        rest = marked.filter("onward").select("src", "dst")
        left = rest.count()
        if 2 * left > n:
            seen = _levels(marked.select("src", "dst"), starts)
            break
        layers.append((marked.filter("not onward").select("src", "dst"), n - left, rest))
        if not left:
            break
    while layers:
        ends, n, inner = layers.pop()
        pairs = _pairs(ends if starts is None else ends.join(starts, "src", "left_semi")) if seen is None else _layer(seen, ends, n, inner.select("src").distinct(), starts, hubs)
        pairs = stored(pairs, "pairs") if kept or layers else pairs
        seen = pairs if seen is None else seen.unionByName(pairs)
    return seen


def _marked(edges: DataFrame, n: int, hubs: list, parts: int) -> DataFrame:
    """Distinct edges of n, and whether their end leads on. Edges into a hub are dealt to `parts` places, so its mark is at each."""
    inner = edges.select(F.col("src").alias("dst"), F.lit(True).alias("onward")).distinct()
    keys = ["dst"]
    if hubs:
        keys, hub = ["dst", "part"], F.col("dst").isin(hubs)
        edges = edges.withColumn("part", F.when(hub, F.pmod(F.xxhash64("src"), F.lit(parts)).cast("int")).otherwise(0))
        inner = inner.withColumn("part", F.explode(F.when(hub, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return _dealt(edges, n, *keys).distinct().join(inner, keys, "left").select("src", "dst", F.coalesce("onward", F.lit(False)).alias("onward"))


def _layer(seen: DataFrame, ends: DataFrame, n: int, heads: DataFrame, starts: DataFrame | None, hubs: list) -> DataFrame:
    """The pairs that end in a layer of n edges, from those seen. An edge is the shortest path of its pair and needs no move. Only heads(src) have
    other ways to a node than an edge of the layer: they are in their own lists, so these ways are known by their edge and left out."""
    own = lambda df: df if starts is None else df.join(starts, "src", "left_semi")
    size = n + seen.count()
    lengths = sorted({1, *(r[0] + 1 for r in seen.select("min_hops").distinct().collect())})
    selves = own(heads).select(F.col("src").alias("ancestor"), F.col("src").alias("descendant"), F.lit(0).alias("min_hops"), F.lit(1).cast("long").alias("path_cnt"))
    lists = _packed(_dealt(seen.unionByName(selves), size, "descendant")).withColumnRenamed("descendant", "src")
    flat = lambda df: df.select("descendant", F.inline(F.arrays_zip("ancestor", "min_hops", "path_cnt")))

    def further(edges: DataFrame, apart: bool) -> DataFrame:
        ways = _dealt(edges, size, "src").join(lists, "src").select(F.col("dst").alias("descendant"), "ancestor", "min_hops", "path_cnt")
        return _shortest(flat(_dealt(ways, size, "descendant") if apart else ways), lengths).filter("min_hops > 1")

    out = _pairs(own(ends))
    if not hubs:
        return out.unionByName(further(ends, True))
    hub = F.col("dst").isin(hubs)  # walks there are dealt by both of their ends
    return out.unionByName(further(ends.filter(~hub), True)).unionByName(further(ends.filter(hub), False))


def _packed(pairs: DataFrame, most: int = 1000) -> DataFrame:
    """Pairs dealt by descendant → descendant and its ancestors, each one hop further, in lists of at most `most`: ancestor, min_hops, path_cnt."""
    place = F.row_number().over(Window.partitionBy("descendant").orderBy("ancestor"))
    way = F.struct("ancestor", (F.col("min_hops") + 1).alias("min_hops"), "path_cnt")
    lists = pairs.withColumn("part", F.floor((place - 1) / most)).groupBy("descendant", "part").agg(F.collect_list(way).alias("ways"))
    return lists.select("descendant", "ways.ancestor", "ways.min_hops", "ways.path_cnt")


def _shortest(walks: DataFrame, lengths: list[int], most: int = 8) -> DataFrame:
    """Walks of a pair summed, those of least length. Of few lengths each has a sum of its own, so walks move once."""
    if len(lengths) > most:
        sums = walks.groupBy("ancestor", "descendant", "min_hops").agg(F.sum("path_cnt").alias("path_cnt"))
        return sums.groupBy("ancestor", "descendant").agg(F.min_by("path_cnt", "min_hops").alias("path_cnt"), F.min("min_hops").alias("min_hops")).select("ancestor", "descendant", "min_hops", "path_cnt")
    sums = walks.groupBy("ancestor", "descendant").agg(*(F.sum(F.when(F.col("min_hops") == h, F.col("path_cnt"))).alias(f"of_{h}") for h in lengths))
    least = F.coalesce(*(F.when(F.col(f"of_{h}").isNotNull(), F.lit(h)) for h in lengths))
    return sums.select("ancestor", "descendant", least.alias("min_hops"), F.coalesce(*(f"of_{h}" for h in lengths)).alias("path_cnt"))


def _levels(plain: DataFrame, starts: DataFrame | None) -> DataFrame:
    """The closure of stored edges without loops or repeats, a job a level."""
    first = plain if starts is None else plain.join(starts, "src", "left_semi")
    frontier, n, _ = counted(_pairs(first), "level")
    seen = frontier
    hops = 1
    while n:
        hops += 1
        step = frontier.join(plain, frontier["descendant"] == plain["src"]).filter("dst <> ancestor")
        step = step.groupBy("ancestor", F.col("dst").alias("descendant")).agg(F.sum("path_cnt").alias("path_cnt"))
        step = step.join(seen.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti")
        frontier, n, _ = counted(step.select("ancestor", "descendant", F.lit(hops).alias("min_hops"), "path_cnt"), "level")
        if n:
            seen = seen.unionByName(frontier)
    return seen


def lineage(edges: DataFrame, start: DataFrame, upstream: bool = False, depth: int = 3) -> DataFrame:
    """start(node), edges(src, dst, ...) → every edge row met, with level; a node is expanded once, at its least level."""
    here, there = ("dst", "src") if upstream else ("src", "dst")
    frontier, visited, out = start.select("node").distinct(), None, None
    for level in range(1, min(depth, 5) + 1):
        visited = frontier if visited is None else visited.union(frontier)
        hops = stored(edges.join(frontier, edges[here] == frontier["node"], "left_semi").withColumn("level", F.lit(level)), "hops")
        out = hops if out is None else out.unionByName(hops)
        if level == min(depth, 5):
            break
        frontier, n, _ = counted(hops.select(F.col(there).alias("node")).distinct().join(visited, "node", "left_anti"), "frontier")
        if not n:
            break
    return out


def capped(hops: DataFrame, most: int = MAX_NODES) -> tuple[DataFrame, bool]:
    """Hops whose ends lie among the first nodes by (level, name), and whether nodes were cut."""
    ends = hops.select("level", F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.min("level").alias("level"))
    kept = ends.orderBy("level", "node").limit(most)
    both = hops.join(kept.select(F.col("node").alias("src")), "src", "left_semi").join(kept.select(F.col("node").alias("dst")), "dst", "left_semi")
    return both, ends.count() > most


def neighbourhood(edges: DataFrame, node, upstream: bool = False, depth: int = 3, most: int = MAX_NODES) -> tuple[list[dict], bool]:
    """What lineage gives for one node, for a reader who waits: edge rows with their level, and whether it stopped at `most` nodes. Each level is
    one filtered read for at most `most` names, which the scan can prune by; nothing is written or shuffled."""
    here, there = ("dst", "src") if upstream else ("src", "dst")
    frontier, seen, out = [node], {node}, []
    for level in range(1, min(depth, 5) + 1):
        rows = edges.filter(F.col(here).isin(frontier)).orderBy("src", "dst").limit(MAX_HOPS).collect()
        new = sorted({r[there] for r in rows} - seen - {None})
        cut = len(rows) == MAX_HOPS or len(seen) + len(new) > most
        kept = seen | set(new[: max(0, most - len(seen))])
        out += [r.asDict() | {"level": level} for r in rows if r[there] in kept]
        frontier, seen = sorted(kept - seen), kept
        if cut or not frontier:
            return out, cut
    return out, False


def card(hops: DataFrame) -> DataFrame:
    """hops(level, src, dst, confidence) → a row for each level: how many hops, how many of them not of high confidence, and both ends
    of those as texts in order."""
    unsure = F.coalesce("confidence", F.lit("high")) != "high"
    marked = F.sort_array(F.collect_set(F.when(unsure, F.concat_ws(" > ", "src", "dst"))))
    return hops.groupBy("level").agg(F.count("*").alias("hops"), F.count_if(unsure).alias("unsure"), F.concat_ws("; ", marked).alias("to_check")).orderBy("level")


def shortest_path(edges: DataFrame, source, target) -> DataFrame:
    """hop, src, dst of a shortest path; of several the one least in order of its nodes. Empty if there is none, or if the ends are
    the same."""
    spark = edges.sparkSession
    plain = stored(_plain(edges), "edges")
    frontier = spark.createDataFrame([(source, [source])], f"node {dict(plain.dtypes)['src']}, path array<{dict(plain.dtypes)['src']}>")
    visited = frontier.select("node")
    while source != target:
        step = frontier.join(plain, frontier["node"] == plain["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        frontier, n, (there,) = counted(step.join(visited, "node", "left_anti"), "paths", F.col("node") == F.lit(target))
        if there:
            found = frontier.filter(F.col("node") == F.lit(target))
            at = F.explode(F.sequence(F.lit(1), F.size("path") - 1))
            return found.select("path", at.alias("hop")).select("hop", F.element_at("path", F.col("hop")).alias("src"), F.element_at("path", F.col("hop") + 1).alias("dst"))
        if not n:
            break
        visited = visited.union(frontier.select("node"))
    return plain.filter("false").select(F.lit(1).alias("hop"), "src", "dst")


def path_details(path: DataFrame, edges: DataFrame) -> DataFrame:
    """path(hop, src, dst), edges(src, dst, edge_id, transform_expr, filter_cond, sql_id, confidence) → each hop with what the least edge
    by id (then by sql_id) between its ends says."""
    said = ["transform_expr", "filter_cond", "sql_id", "confidence"]
    least = edges.join(path.select("src", "dst"), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min_by(F.struct(*said), F.struct(F.col("edge_id").isNull(), "edge_id", "sql_id")).alias("e"))
    return path.join(least, ["src", "dst"], "left").select("hop", "src", "dst", *(F.col(f"e.{c}").alias(c) for c in said))


def impact(closed: DataFrame, node, page: int = 1, size: int = 50, tables: DataFrame | None = None) -> DataFrame:
    """A page of what lies downstream: descendant, min_hops, path_cnt; with tables(full_name, layer, domain, owner) also what they say."""
    own = closed.filter(F.col("ancestor") == F.lit(node)).select("descendant", "min_hops", "path_cnt")
    paged = own.orderBy("min_hops", "descendant").offset((page - 1) * size).limit(size)
    if tables is None:
        return paged
    return paged.join(tables.select(F.col("full_name").alias("descendant"), "layer", "domain", "owner"), "descendant", "left").orderBy("min_hops", "descendant")


def impact_by(closed: DataFrame, node, owners: DataFrame, page: int = 1, size: int | None = None) -> DataFrame:
    """owners(descendant, task) → task, affected (distinct descendants), a page of them if size is given."""
    own = closed.filter(F.col("ancestor") == F.lit(node)).join(owners, "descendant")
    ranked = own.groupBy("task").agg(F.countDistinct("descendant").alias("affected")).orderBy(F.desc("affected"), "task")
    return ranked if size is None else ranked.offset((page - 1) * size).limit(size)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) → node, component: the least node that is reachable in either direction. Labels spread along edges and
    jump to the label of their label, until nothing changes."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "both")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new = labels.join(near, "node").select("node", F.least("component", "near").alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = new.join(jump, "component").select("node", F.least("component", "further").alias("new")).join(labels, "node")
        new, _, (changed,) = counted(new.select("node", F.col("new").alias("component"), (F.col("new") != F.col("component")).alias("changed")), "labels", F.col("changed"))
        labels = new.drop("changed")
        if not changed:
            return labels


def families(candidates: DataFrame, closed: DataFrame) -> DataFrame:
    """candidates(candidate, node, certified, domain_match, layer, confidence) → those columns, family (its least candidate),
    rank_in_family (1: the anchor), ambiguous (more than one family). Candidates are of one family if their nodes are the
    same or one reaches the other; without a node a candidate is alone."""
    own = candidates.filter("node is not null").select("candidate", "node")
    same = own.groupBy("node").agg(F.min("candidate").alias("a")).join(own, "node").select("a", F.col("candidate").alias("b"))
    first = own.groupBy("node").agg(F.min("candidate").alias("candidate"))
    linked = closed.join(first.select(F.col("node").alias("ancestor"), F.col("candidate").alias("a")), "ancestor").join(first.select(F.col("node").alias("descendant"), F.col("candidate").alias("b")), "descendant").select("a", "b")
    found = components(same.union(linked)).withColumnRenamed("component", "family")
    joined = candidates.join(found, candidates["candidate"] == found["node"], "left").drop(found["node"]).withColumn("family", F.coalesce("family", "candidate"))
    layer = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (("ads", 4), ("dws", 3), ("dwd", 2), ("dim", 2), ("ods", 1)) for x in kv]), F.col("layer")), F.lit(0))
    order = Window.partitionBy("family").orderBy(F.desc("certified"), F.desc("domain_match"), layer.desc(), F.desc("confidence"), "candidate")
    several = joined.agg((F.countDistinct("family") > 1).alias("ambiguous"))
    return joined.withColumn("rank_in_family", F.row_number().over(order)).join(F.broadcast(several))
