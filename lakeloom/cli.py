"""Commands over a lineage warehouse: python -m lakeloom.cli --root FOLDER COMMAND. FOLDER holds Parquet tables (tables, columns, snapshots,
statements, glossary, audit) and the generations of lineage. Results are printed as JSON, the weekly report as text."""

from __future__ import annotations

import argparse
import datetime
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import diff, quality, search
from lakeloom.plans import rebuild
from lakeloom.sources import feeds
from lakeloom.sources.tables import latest_schema, stored


class Commands:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.warehouse = rebuild.Warehouse(spark, f"{self.root}/lineage")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _replace(self, name: str, df: DataFrame) -> None:
        stored(df, name).write.mode("overwrite").parquet(f"{self.root}/{name}")

    def schema(self) -> dict:
        return feeds.schema_of(latest_schema(self.table("snapshots")))

    def sync_metadata(self, synced: str) -> dict:
        """synced: a folder of Parquet tables `tables` and `columns` as the metastore has them now."""
        seen = self.spark.read.parquet(f"{synced}/tables")
        columns = self.spark.read.parquet(f"{synced}/columns")
        old = self.table("tables")
        merged = diff.merged(old, seen, ["full_name"], [c for c in seen.columns if c in old.columns and c not in ("full_name", "is_online")])
        self._replace("tables", diff.soft_deleted(merged, seen))
        today = datetime.date.today().isoformat()
        snapshot = columns.groupBy("full_name").agg(F.array_sort(F.collect_list(F.struct("place", F.col("column_name").alias("name"), F.col("data_type").alias("type")))).alias("c"))
        snapshot = snapshot.select("full_name", F.lit(today).alias("snap_date"), F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))).alias("columns"))
        self._replace("snapshots", self.table("snapshots").filter(F.col("snap_date") != today).unionByName(snapshot))
        out = {"tables": seen.count(), "offline": self.table("tables").filter("not is_online").count()}
        return out | (quality.blank_comments(columns).first().asDict() if "comment" in columns.columns else {})

    def collect_sql(self, url: str, since: str | None = None) -> dict:
        self.spark.dataSource.register(feeds.SchedulerSource)
        reader = self.spark.read.format("scheduler").option("url", url)
        found = (reader.option("updated_since", since) if since else reader).load()
        new = stored(found.select(F.concat_ws("#", "task_id", "node_seq").alias("sql_id"), "sql_text").dropDuplicates(["sql_id"]), "collected")
        old = self.table("statements")
        known = old.select("sql_id", F.sha2("sql_text", 256).alias("h"))
        changed = stored(new.withColumn("h", F.sha2("sql_text", 256)).join(known, ["sql_id", "h"], "left_anti").drop("h"), "changed")
        self._replace("statements", old.join(changed, "sql_id", "left_anti").unionByName(changed.withColumn("is_active", F.lit(True)), allowMissingColumns=True))
        rows = [(r.sql_id, r.sql_text) for r in changed.orderBy("sql_id").toLocalIterator()]
        return rebuild.incremental(self.warehouse, rows, self.schema()) if rows else {"statements": 0}

    def full_rebuild(self) -> dict:
        return rebuild.full_rebuild(self.warehouse, self.table("statements"), self.schema(), tables=self.table("tables"))

    def incremental(self, sql_id: str) -> dict:
        rows = rebuild.active(self.table("statements").filter(F.col("sql_id") == sql_id))
        if not rows:
            raise SystemExit(f"no active statement {sql_id}")
        return rebuild.incremental(self.warehouse, rows, self.schema(), tables=self.table("tables"))

    def task_edges(self, sql_id: str) -> dict:
        """What one statement's edges are when they are folded alone, before the next rebuild."""
        raw = self.warehouse.store.current("raw")
        if raw is None:
            raise SystemExit("no lineage yet: run full-rebuild first")
        task = self.spark.createDataFrame([(sql_id,)], "sql_id string")
        own = rebuild.incremental_task(self.warehouse, raw.filter(F.col("sql_id") == sql_id), task, self.table("tables"))
        return {"edges": [f"{r.src} > {r.dst}" for r in own.filter("edge_level = 'table'").orderBy("src", "dst").collect()]}

    def _edges(self) -> DataFrame:
        edges = self.warehouse.edges
        if edges is None:
            raise SystemExit("no lineage yet: run full-rebuild first")
        return edges.filter("edge_level = 'table'")

    def coverage(self) -> dict:
        covered = stored(quality.coverage(self.table("tables"), self._edges()), "coverage")
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a few groups
        parses = self.warehouse.statuses.groupBy("parse_status", "reason").count().orderBy("parse_status", "reason")
        return {"layers": rows(quality.rolled_up(covered, "layer").orderBy("layer")), "total": rows(quality.rolled_up(covered))[0], "parses": rows(parses)}

    def vectorize(self) -> dict:
        texts, skipped = search.vector_texts(self.table("glossary"), self.table("columns"), self.table("tables"))
        return search.Collection(self.spark, f"{self.root}/vectors").sync(texts) | {"skipped": {r.reason: r["count"] for r in skipped.collect()}}

    def healthcheck(self) -> dict:
        statuses, closed = self.warehouse.statuses, self.warehouse.closure
        failed = statuses.filter("parse_status = 'failed'").count() if statuses is not None else 0
        problems = quality.health(self.warehouse.runs(), closed.count() if closed is not None else 0, failed, F.current_timestamp())
        found = sorted(r.problem for r in problems.collect())
        return {"healthy": not found, "problems": found}

    def weekly_report(self) -> str:
        return quality.weekly_markdown(self.table("audit"), self._edges(), self.warehouse.statuses, F.current_timestamp())


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lakeloom", description=__doc__)
    parser.add_argument("--root", required=True)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("sync-metadata").add_argument("--synced", required=True)
    collect = sub.add_parser("collect-sql")
    collect.add_argument("--url", required=True)
    collect.add_argument("--since")
    for name in ("incremental", "task-edges"):
        sub.add_parser(name).add_argument("--sql-id", required=True)
    for name in ("full-rebuild", "coverage", "vectorize", "healthcheck", "weekly-report"):
        sub.add_parser(name)
    given = vars(parser.parse_args(args))
    own = Commands(spark or SparkSession.builder.getOrCreate(), given.pop("root"))
    out = getattr(own, (command := given.pop("command")).replace("-", "_"))(**given)
    print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, default=str))
    return int(command == "healthcheck" and not out["healthy"])


if __name__ == "__main__":
    sys.exit(main())
