"""Full and incremental lineage rebuilds: parse, fold, close, guard, swap all generations at once."""

from __future__ import annotations

import datetime
import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.columns import is_tmp
from lakeloom.operators import diff, fold, graph, reach
from lakeloom.plans import lineage
from lakeloom.sources.tables import Generations, stored

EDGE_BOUND, CLOSURE_BOUND = 0.20, 0.10
RUN_SCHEMA = "run_id string, run_type string, status string, started_at timestamp, ended_at timestamp, stats string, error string"


class Aborted(Exception):
    """A guard found too large a change; the old generation keeps serving."""


class Warehouse:
    """The lineage store under one folder: generations of parsed edges (`raw`, before folding), folded `edges`, `closure` and statement
    `statuses`, all named by one pointer; and the list of runs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.store = Generations(spark, root)

    @property
    def edges(self) -> DataFrame | None:
        return self.store.current("edges")

    @property
    def closure(self) -> DataFrame | None:
        return self.store.current("closure")

    @property
    def statuses(self) -> DataFrame | None:
        return self.store.current("statuses")

    @contextmanager
    def run(self, run_type: str):
        """Records the run. An aborted one does not raise: its stats say so (status, reason), and the old generations serve on."""
        run_id, began, stats = uuid.uuid4().hex, datetime.datetime.now(), {}
        status, error = "success", None
        try:
            yield stats
        except Aborted as e:
            status, error = "aborted", str(e)
            stats |= {"reason": str(e)}
        except Exception as e:
            status, error = "failed", str(e)[:2000]
            raise
        finally:
            stats["status"] = status
            row = (run_id, run_type, status, began, datetime.datetime.now(), json.dumps(stats), error)
            self.spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(f"{self.root}/runs")

    @contextmanager
    def stage(self, stats: dict, name: str):
        """Adds the seconds that a stage takes to the stats of its run."""
        began = time.time()
        yield
        stats.setdefault("seconds", {})[name] = round(time.time() - began, 3)

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.root}/runs")


def active(statements: DataFrame) -> list[tuple[str, str]]:
    """statements(sql_id, sql_text, is_active) → the texts of active ones, in order of their ids; the parser lives on the driver."""
    rows = statements.filter(F.col("is_active") & F.col("sql_text").isNotNull()).select("sql_id", "sql_text").orderBy("sql_id")
    return [(r.sql_id, r.sql_text) for r in rows.toLocalIterator()]


def edge_rows(edges: DataFrame) -> DataFrame:
    """Parsed edges in the shape of the store: node names as src and dst (table, or table.column), ids from what they say."""
    end = lambda side: F.when(F.col("edge_level") == "table", F.col(f"{side}_table")).otherwise(F.concat_ws(".", f"{side}_table", f"{side}_column"))
    out = edges.withColumns({"src": end("src"), "dst": end("dst")})
    return out.withColumn("edge_id", F.xxhash64("sql_id", "edge_level", "src", "dst")).dropDuplicates(["edge_id"])


def _tmp(edges: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Nodes of temporary tables: by their names, or by the catalogue (tables: full_name, layer) where there is one."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("src_table").alias("t")), F.struct(F.col("dst").alias("node"), F.col("dst_table").alias("t")))).alias("x"))
    own = sides.select("x.*").distinct()
    if tables is None:
        return own.filter(is_tmp(F.col("t"))).select("node")
    known = own.join(tables.select(F.col("full_name").alias("t"), "layer").dropDuplicates(["t"]), "t", "left")
    return known.filter(is_tmp(F.col("t"), F.col("layer"))).select("node")


def _folded(edges: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    out = None
    for level in ("table", "column"):
        own = edges.filter(F.col("edge_level") == level)
        done = fold.folded_edges(own, _tmp(own, tables)).withColumn("edge_level", F.lit(level))
        out = done if out is None else out.unionByName(done)
    split = lambda side, k: F.when(F.col("edge_level") == "table", F.col(side) if k == 0 else F.lit("")).otherwise(F.substring_index(side, ".", 2) if k == 0 else F.substring_index(side, ".", -1))
    out = out.withColumns({f"{side}_{name}": F.coalesce(f"{side}_{name}", split(side, k)) for side in ("src", "dst") for k, name in enumerate(("table", "column"))})
    return out.withColumn("edge_id", F.coalesce("edge_id", F.xxhash64("sql_id", "edge_level", "src", "dst", "is_derived")))


def _table_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("edge_level = 'table'")


def full_rebuild(warehouse: Warehouse, statements: list[tuple[str, str]] | DataFrame, schema: dict, default_db: str = "default", threads: int = 8, tables: DataFrame | None = None) -> dict:
    """Parses every active statement and makes new generations of parsed edges (manual and ingested ones carried over), folded edges,
    closure and statuses; all are swapped together, or none if edges or closure changed too much (stats: status, reason). tables:
    the catalogue, for tables that only it calls temporary."""
    spark = warehouse.spark
    with warehouse.run("full") as stats:
        texts = active(statements) if isinstance(statements, DataFrame) else statements
        store, shadows = warehouse.store, {}
        with warehouse.stage(stats, "parse"):
            edges, status = lineage.tables_of(spark, lineage.parse_all(spark, texts, schema, default_db, threads))
        with warehouse.stage(stats, "load"):
            fresh, old = edge_rows(edges), store.current("raw")
            shadows |= {"raw": store.write_buckets("raw", fresh if old is None else diff.preserved(old, fresh), "sql_id"), "statuses": store.write_shadow("statuses", status)}
        with warehouse.stage(stats, "fold"):
            shadows["edges"] = store.write_shadow("edges", _folded(store.shadow("raw", shadows["raw"]), tables))
        whole = store.shadow("edges", shadows["edges"])
        with warehouse.stage(stats, "closure"):
            shadows["closure"] = store.write_buckets("closure", graph.closure(_table_edges(whole)), "ancestor")
        sizes = reach.strong_components(_table_edges(whole)).groupBy("component").count()
        cycles = sizes.agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0))).first()[0]
        stats |= {"statements": len(texts), "edges": whole.count(), "closure": store.shadow("closure", shadows["closure"]).count(), "cycles": cycles}
        stats["statuses"] = {r["parse_status"]: r["count"] for r in status.groupBy("parse_status").count().collect()}
        with warehouse.stage(stats, "swap"):
            reason = store.swap_guarded(shadows, {"edges": EDGE_BOUND, "closure": CLOSURE_BOUND})
        if reason:
            raise Aborted(reason)
    return stats


def incremental(warehouse: Warehouse, statements: list[tuple[str, str]], schema: dict, default_db: str = "default", tables: DataFrame | None = None) -> dict:
    """Replaces the parsed edges and statuses of changed statements, folds anew and applies to the closure the delta of the folded edges that
    came or went, so that all generations equal those of a full rebuild; of parsed edges and closure only the buckets that change are
    written. Without a guard, for few statements change much of a small graph. A warehouse without generations gets its first ones."""
    spark = warehouse.spark
    with warehouse.run("incremental") as stats:
        edges, status = lineage.tables_of(spark, lineage.parse_all(spark, statements, schema, default_db))
        ids = spark.createDataFrame([(i,) for i, _ in statements], "sql_id string")
        store, fresh, old, known = warehouse.store, edge_rows(edges), warehouse.edges, warehouse.statuses
        shadows: dict = {"raw": store.write_buckets("raw", fresh, "sql_id") if old is None else store.patch_buckets("raw", ids, lambda held: diff.replaced(held, fresh, ids))}
        shadows["edges"] = store.write_shadow("edges", _folded(store.shadow("raw", shadows["raw"]), tables))
        whole = store.shadow("edges", shadows["edges"])
        if old is None:
            shadows["closure"] = store.write_buckets("closure", graph.closure(_table_edges(whole)), "ancestor")
        else:
            delta = reach.closure_delta(warehouse.closure, _table_edges(old), _table_edges(whole))
            shadows["closure"] = store.patch_buckets("closure", delta.select("ancestor"), lambda held: reach.applied(held, delta))
        shadows["statuses"] = store.write_shadow("statuses", status if known is None else known.join(ids, "sql_id", "left_anti").unionByName(status))
        store.swap(shadows)
        stats |= {"statements": len(statements), "edges": whole.count(), "closure": warehouse.closure.count(), "statuses": {r["parse_status"]: r["count"] for r in status.groupBy("parse_status").count().collect()}}
    return stats


def incremental_task(warehouse: Warehouse, edges: DataFrame, task: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """The fold of one task's statements alone (task: sql_id), among edges not folded yet; complete chains give way to derived edges, all
    others stay until the next full rebuild."""
    out = None
    for level in ("table", "column"):
        own = edges.filter(F.col("edge_level") == level)
        done = fold.folded_task(own, _tmp(own, tables), task).withColumn("edge_level", F.lit(level))
        out = done if out is None else out.unionByName(done)
    return out
