"""Folding of temporary tables: chains through them become one derived edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import CONFIDENCE, confidence_rank
from lakeloom.operators.reach import strong_components, turned
from lakeloom.sources.tables import counted, spread, stored


def _marked(edges: DataFrame, tmp: DataFrame) -> DataFrame:
    mark = lambda side: tmp.select(F.col("node").alias(side), F.lit(True).alias(f"{side}_tmp")).distinct()
    return stored(edges.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left").na.fill(False, ["src_tmp", "dst_tmp"]), "marked")


def fold(edges: DataFrame, tmp: DataFrame) -> DataFrame:
    """edges(edge_id, src, dst, sql_id, src_type, confidence, transform_expr, filter_cond, join_cond), tmp(node) → derived edges. A chain
    starts outside tmp, goes through tmp nodes (each once) and ends outside; the derived edge has the last edge's task and
    conditions, the least confidence of the chain and the outermost expression around the inner ones, first to last. Of chains with
    the same ends and task the shortest counts, then the least by ids. Chains may be of any length: levels go on until no tmp
    node is new to its head. A shortest chain goes on from shortest chains, so only one is kept for each head and node."""
    marked = _marked(edges, tmp)
    rank = confidence_rank(F.col("confidence"))
    reach = lambda step: step.groupBy("head", "at").agg(F.min_by(F.struct("chain", "inner", "rank"), "chain").alias("c")).select("head", "at", "c.*")
    first = marked.filter("not src_tmp and dst_tmp").select(F.col("src").alias("head"), F.col("dst").alias("at"), F.array("edge_id").alias("chain"), F.array("transform_expr").alias("inner"), rank.alias("rank"))
    frontier, n, _ = counted(reach(first), "chains")
    seen = frontier.select("head", "at")
    onward = marked.filter("src_tmp").withColumn("own_rank", rank)
    fields = ["sql_id", "src_type", "transform_expr", "filter_cond", "join_cond"]
    done, size = None, 0
    while done is None or n:
        step = frontier.join(onward, frontier["at"] == onward["src"])
        step, steps, _ = counted(step.select("head", "dst", "dst_tmp", F.array_append("chain", F.col("edge_id")).alias("chain"), "inner", F.least("rank", "own_rank").alias("rank"), *fields), "steps")
        size += steps
        ended = step.filter("not dst_tmp")
        done = ended if done is None else done.unionByName(ended)
        on = step.filter("dst_tmp").select("head", F.col("dst").alias("at"), "chain", F.array_append("inner", F.col("transform_expr")).alias("inner"), "rank")
        frontier, n, _ = counted(reach(on.join(seen, ["head", "at"], "left_anti")), "chains")
        seen = seen.union(frontier.select("head", "at"))
    order = Window.partitionBy("head", "dst", "sql_id").orderBy(F.size("chain"), "chain")
    inner = F.concat_ws(" ; ", F.filter("inner", lambda x: F.coalesce(x, F.lit("")) != ""))
    outer = F.coalesce("transform_expr", F.lit(""))
    return spread(done, size, "head", "dst", "sql_id").withColumn("rn", F.row_number().over(order)).filter("rn = 1").select(
        F.col("head").alias("src"), "dst", "sql_id", "src_type",
        F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("rank") + 1).alias("confidence"),
        F.when(inner == "", outer).otherwise(F.concat(outer, F.lit(" (through tmp: "), inner, F.lit(")"))).alias("transform_expr"),
        "filter_cond", "join_cond", F.lit(True).alias("is_derived"), (F.col("head") == F.col("dst")).alias("is_self_loop"),
    )


def _reached(start: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes of start(node) and all that edges(src, dst) lead to from them."""
    frontier, n, _ = counted(start.select("node").distinct(), "reached")
    seen = frontier
    while n:
        step = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        frontier, n, _ = counted(step.join(seen, "node", "left_anti"), "reached")
        if n:
            seen = seen.union(frontier)
    return seen


def used_edges(edges: DataFrame, tmp: DataFrame) -> DataFrame:
    """edge_id of the edges on any complete chain (each tmp node once). An edge that leads from what a head feeds to what leads to an end
    is on one, unless it lies inside a cycle of tmp nodes; only there chains are followed, from where they come in to where they leave."""
    marked = _marked(edges, tmp)
    inner = stored(marked.filter("src_tmp and dst_tmp").select("src", "dst").distinct(), "inner")
    heads = _reached(marked.filter("not src_tmp and dst_tmp").select(F.col("dst").alias("node")), inner)
    ends = _reached(marked.filter("src_tmp and not dst_tmp").select(F.col("src").alias("node")), turned(inner))
    part = strong_components(inner)
    side = lambda c, known, flag: known.select(F.col("node").alias(c), F.lit(True).alias(flag))
    through = marked.filter("src_tmp or dst_tmp").join(side("src", heads, "fed"), "src", "left").join(side("dst", ends, "leads"), "dst", "left")
    through = through.filter("(not src_tmp or fed) and (not dst_tmp or leads)").select("edge_id", "src", "dst", "src_tmp", "dst_tmp")
    for c in ("src", "dst"):
        through = through.join(part.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")), c, "left")
    through = stored(through.withColumn("inside", F.coalesce(F.col("src_tmp") & F.col("dst_tmp") & (F.col("src_part") == F.col("dst_part")), F.lit(False))), "through")
    across, onward = through.filter("not inside"), through.filter("inside").select("src", "dst", "edge_id")
    out = across.filter("src_tmp").select(F.col("src").alias("leaves")).distinct()
    done = across.select("edge_id")
    frontier, n = across.filter("dst_tmp").select(F.col("dst").alias("at"), F.array().cast(f"array<{dict(edges.dtypes)['edge_id']}>").alias("chain"), F.array("dst").alias("visited")).distinct(), 1
    while n:
        step = frontier.join(onward, frontier["at"] == onward["src"]).filter(~F.array_contains("visited", F.col("dst")))
        frontier, n, _ = counted(step.select(F.col("dst").alias("at"), F.array_append("chain", F.col("edge_id")).alias("chain"), F.array_append("visited", F.col("dst")).alias("visited")), "steps")
        if n:
            done = done.union(frontier.join(out, frontier["at"] == out["leaves"], "left_semi").select(F.explode("chain").alias("edge_id")))
    return done.distinct()


def folded_edges(edges: DataFrame, tmp: DataFrame, drop_all: bool = True) -> DataFrame:
    """The edge table after folding: without the tmp edges (all of them, or only those used), with the derived ones."""
    derived = fold(edges, tmp)
    if drop_all:
        rest = edges.join(tmp.select(F.col("node").alias("src")), "src", "left_anti").join(tmp.select(F.col("node").alias("dst")), "dst", "left_anti")
    else:
        rest = edges.join(used_edges(edges, tmp), "edge_id", "left_anti")
    return rest.withColumns({"is_derived": F.lit(False), "is_self_loop": F.col("src") == F.col("dst")}).unionByName(derived, allowMissingColumns=True)


def folded_task(edges: DataFrame, tmp: DataFrame, sql_ids: DataFrame) -> DataFrame:
    """Folding among the edges of one task's statements; all other edges stay."""
    own = edges.join(sql_ids.select("sql_id"), "sql_id", "left_semi")
    return edges.join(sql_ids.select("sql_id"), "sql_id", "left_anti").unionByName(folded_edges(own, tmp, drop_all=False), allowMissingColumns=True)
