"""Point reads and small writes of a portal: table cards, queues, glossary, feedback, dashboard, cached answers."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import graph, quality

GLOSSARY_STATUS = ("active", "pending_review", "deprecated")
GLOSSARY_FIELDS = ("aliases", "caliber", "ref_table", "ref_column", "certified", "status")


class Conflict(ValueError):
    """(term, domain) is taken."""


def table_info(tables: DataFrame, columns: DataFrame, statements: DataFrame, full_name: str) -> dict | None:
    """Metadata, columns and the active tasks that write a table."""
    found = tables.filter(F.col("full_name") == full_name).first()
    if found is None:
        return None
    own = columns.filter(F.col("full_name") == full_name).orderBy("column_name").collect()
    tasks = statements.filter((F.col("target_table") == full_name) & F.col("is_active")).select("task_id").distinct().orderBy("task_id").collect()
    return found.asDict() | {"columns": [c.asDict() for c in own], "tasks": [t.task_id for t in tasks]}


def failed_queue(statements: DataFrame, most: int = 100) -> DataFrame:
    own = statements.filter(F.col("is_active") & F.col("parse_status").isin("failed", "degraded"))
    return own.orderBy(F.desc("updated_at"), "task_id").limit(most).withColumn("sql_text", F.left("sql_text", F.lit(2000)))


def glossary_list(glossary: DataFrame, keyword: str | None = None, domain: str | None = None, status: str | None = None, most: int = 200) -> DataFrame:
    """Terms whose name or caliber has the keyword, letter case and accents aside; newest first."""
    own = glossary
    if keyword:
        word = F.collate(F.lit(keyword), "UNICODE_CI_AI")
        own = own.filter(F.contains(F.collate(F.col("term"), "UNICODE_CI_AI"), word) | F.contains(F.collate(F.coalesce("caliber", F.lit("")), "UNICODE_CI_AI"), word))
    for column, value in (("domain", domain), ("status", status)):
        if value:
            own = own.filter(F.col(column) == value)
    return own.orderBy(F.desc("updated_at"), "term").limit(most)


def glossary_created(glossary: DataFrame, term: dict) -> DataFrame:
    if not term.get("term"):
        raise ValueError("a term needs a name")
    if term.get("status", "pending_review") not in GLOSSARY_STATUS:
        raise ValueError(f"status is one of {', '.join(GLOSSARY_STATUS)}")
    if not glossary.filter((F.col("term") == term["term"]) & (F.col("domain") == term.get("domain", ""))).isEmpty():
        raise Conflict(f"{term['term']} is there already")
    row = {"domain": "", "status": "pending_review", "certified": False, "updated_at": datetime.datetime.now()} | term
    return glossary.unionByName(glossary.sparkSession.createDataFrame([tuple(row.get(c) for c in glossary.columns)], glossary.schema))


def glossary_patched(glossary: DataFrame, term: str, domain: str, patch: dict) -> DataFrame:
    """Only the fields that may change do; others are refused."""
    if odd := set(patch) - set(GLOSSARY_FIELDS):
        raise ValueError(f"may not change {', '.join(sorted(odd))}")
    if patch.get("status", "active") not in GLOSSARY_STATUS:
        raise ValueError(f"status is one of {', '.join(GLOSSARY_STATUS)}")
    own = (F.col("term") == term) & (F.col("domain") == domain)
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    changed = {c: F.when(own, value(v)).otherwise(F.col(c)) for c, v in (patch | {"updated_at": datetime.datetime.now()}).items()}
    return glossary.withColumns(changed)


def append_feedback(spark, path: str, user_id: str, rating: int, comment: str = "") -> None:
    if rating not in (0, 1):
        raise ValueError("rating is 1 or 0")
    spark.createDataFrame([(user_id, rating, comment)], "user_id string, rating int, comment string").withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path)


def dashboard(tables: DataFrame, edges: DataFrame, statements: DataFrame) -> dict:
    covered = quality.coverage(tables, edges)
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a few groups each
    return {"coverage": rows(covered.orderBy("layer", "domain", "owner")), "layers": rows(quality.rolled_up(covered, "layer").orderBy("layer")), "total": rows(quality.rolled_up(covered))[0], "confidence": rows(quality.confidence_shares(edges))[0], "parses": rows(statements.groupBy("parse_status", "reason").count().orderBy("parse_status", "reason"))}


def answer(found: DataFrame, edges: DataFrame, depth: int = 3) -> dict:
    """Without a language model: the single family's anchor with its lineage upstream, or the families to choose from. found: of search.search."""
    anchors = found.filter("rank_in_family = 1").orderBy("family").limit(50).collect()
    if len(anchors) != 1 or anchors[0].node is None:
        return {"kind": "choose" if anchors else "nothing", "families": [a.asDict() for a in anchors]}
    start = edges.sparkSession.createDataFrame([(anchors[0].node,)], "node string")
    hops, cut = graph.capped(graph.lineage(edges, start, upstream=True, depth=depth))
    return {"kind": "lineage", "anchor": anchors[0].asDict(), "hops": [h.asDict() for h in hops.orderBy("level", "src", "dst").collect()], "truncated": cut}


class Cache:
    """Answers kept until the next rebuild hour (60 seconds at least); errors are not kept."""

    def __init__(self, rebuild_hour: int = 3, now: Callable[[], datetime.datetime] = datetime.datetime.now):
        self.hour, self.now, self.kept = rebuild_hour, now, {}

    def lifetime(self) -> float:
        now = self.now()
        after = now.replace(hour=self.hour, minute=0, second=0, microsecond=0)
        if after <= now:
            after += datetime.timedelta(days=1)
        return max(60.0, (after - now).total_seconds())

    def get(self, key: str, make: Callable[[], dict]) -> dict:
        held = self.kept.get(key)
        if held and held[0] > time.time():
            return held[1]
        value = make()
        if "error" not in value:
            self.kept[key] = (time.time() + self.lifetime(), value)
        return value
