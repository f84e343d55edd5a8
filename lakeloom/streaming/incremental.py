"""Incremental lineage from a folder of published statements, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeloom.plans.rebuild import Warehouse, incremental
from lakeloom.streaming import gate

STATEMENT_SCHEMA = "sql_id string, sql_text string, published_at timestamp"


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of STATEMENT_SCHEMA that land in the folder."""
    return spark.readStream.schema(STATEMENT_SCHEMA).json(folder)


def latest_changed(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """For one batch without a stream: the last text of each statement, if its sha256 differs from the known last one (sql_id, sql_hash, one row
    a statement)."""
    last = batch.groupBy("sql_id").agg(F.max_by("sql_text", "published_at").alias("sql_text")).withColumn("sql_hash", F.sha2("sql_text", 256))
    return last if known is None else last.join(known, ["sql_id", "sql_hash"], "left_anti")


def follow(warehouse: Warehouse, folder: str, schema: dict | Callable[[], dict], checkpoint: str, default_db: str = "default", available_now: bool = False) -> StreamingQuery:
    """Every micro-batch replaces the edges of statements whose text changed (see gate.changes) and applies the closure's delta. schema may be a
    function, which is asked anew for each batch. A batch that is run again leaves the same edges."""

    def apply(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("sql_id").agg(F.max_by("sql_text", F.struct("published_at", "sql_hash")).alias("sql_text"))
        own = last.collect()  # changed statements of one batch: the parser lives on the driver
        if own:
            incremental(warehouse, [(r.sql_id, r.sql_text) for r in own], schema() if callable(schema) else schema, default_db)

    writer = gate.changes(statements(warehouse.spark, folder)).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def usage_by_window(audit: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """audit(ts timestamp, channel, status) as a stream or table → requests by sliding window, late rows dropped after `late`."""
    return audit.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "channel", "status").agg(F.count("*").alias("requests"))
