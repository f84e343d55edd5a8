"""Upserts, soft deletes and replacements as joins of the old with the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_by_hash(old: DataFrame, new: DataFrame, keys: list[str], text: str, status: str = "parse_status") -> DataFrame:
    """old and new statements → all statements with `change`: inserted, changed, unchanged or kept (not in new). Inserted and
    changed ones become pending; the others keep their status. Hashes are sha256 of the text."""
    before = old.select(*keys, F.col(text).alias("old_text"), F.col(status).alias("old_status"), F.sha2(text, 256).alias("old_hash"))
    after = new.select(*keys, F.col(text).alias("new_text"), F.sha2(text, 256).alias("new_hash")).dropDuplicates(keys)
    joined = before.join(after, keys, "full_outer")
    change = F.when(F.col("new_hash").isNull(), "kept").when(F.col("old_hash").isNull(), "inserted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return joined.withColumn("change", change).select(*keys, F.coalesce("new_text", "old_text").alias(text), F.when(F.col("change").isin("inserted", "changed"), "pending").otherwise(F.col("old_status")).alias(status), "change")


def soft_deleted(tables: DataFrame, seen: DataFrame, key: str = "full_name") -> DataFrame:
    """Tables not seen go offline; nothing does when nothing was seen. Seen ones are online."""
    flag = seen.select(key).distinct().withColumn("seen", F.lit(True))
    some = seen.limit(1).agg((F.count("*") > 0).alias("some"))
    joined = tables.join(flag, key, "left").join(F.broadcast(some))
    return joined.withColumn("is_online", F.when(F.col("seen"), True).when(F.col("some"), False).otherwise(F.col("is_online"))).drop("seen", "some")


def merged(old: DataFrame, new: DataFrame, keys: list[str], synced: list[str]) -> DataFrame:
    """Rows of new replace the synced columns only; other columns of old stay; rows on either side alone are kept."""
    mark = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in synced), F.lit(True).alias("__new"))
    joined = old.join(mark, keys, "full_outer")
    own: list[Column] = [F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in synced else F.col(c) for c in old.columns]
    return joined.select(own)


def replaced(edges: DataFrame, new: DataFrame, sql_ids: DataFrame) -> DataFrame:
    """The statement's own edges give way to new ones; manual and ingested edges survive."""
    gone = sql_ids.select("sql_id").distinct().withColumn("src_type", F.lit("sql"))
    return edges.join(gone, ["sql_id", "src_type"], "left_anti").unionByName(new, allowMissingColumns=True)


def preserved(edges: DataFrame, parsed: DataFrame) -> DataFrame:
    """A new generation: parsed edges and the old ones that no statement made."""
    return edges.filter("src_type <> 'sql'").unionByName(parsed, allowMissingColumns=True)


def manual_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent replacement of manual edges for each (dst, edge_level) that new names; confidence is medium."""
    gone = new.select("dst", "edge_level").distinct().withColumn("src_type", F.lit("manual"))
    own = new.withColumns({"src_type": F.lit("manual"), "confidence": F.lit("medium"), "is_self_loop": F.col("src") == F.col("dst")}).distinct()
    return edges.join(gone, ["dst", "edge_level", "src_type"], "left_anti").unionByName(own, allowMissingColumns=True)


def hash_diff(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """wanted(id, content_hash), held(id, content_hash) → id, action: upsert, delete or unchanged."""
    joined = wanted.select("id", F.col("content_hash").alias("a")).join(held.select("id", F.col("content_hash").alias("b")), "id", "full_outer")
    return joined.select("id", F.when(F.col("a").isNull(), "delete").when(F.col("b").isNull() | (F.col("a") != F.col("b")), "upsert").otherwise("unchanged").alias("action"))
