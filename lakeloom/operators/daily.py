"""Usage by sliding windows from mergeable daily states, with exact counts and percentiles where a sketch is not enough.

A day's state holds its number of requests, a HyperLogLog sketch of its users and a KLL sketch of its latencies, a few kilobytes whatever the
day holds. A window merges the states of its days and never reads their rows again. Exact percentiles come by refinement: each round
counts the values of every window in BINS bins between bounds, and keeps the bin that holds the rank, until its least and greatest value
are the same; a task counts before anything is shuffled, so no window's values meet in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.tables import counted, stored

BINS = 1024
USERS_LOG2, LATENCY_K = 12, 200


def daily_states(audit: DataFrame, day: str = "day", user: str = "user_id", value: str = "cost") -> DataFrame:
    """audit(day date, user, value double) → day, requests, users (binary), latency (binary). Rows without day are left out; null users and
    values count as requests alone."""
    rows = audit.filter(F.col(day).isNotNull())
    return rows.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("requests"), F.hll_sketch_agg(user, USERS_LOG2).alias("users"), F.kll_sketch_agg_double(F.col(value).cast("double"), LATENCY_K).alias("latency"))


def windows(states: DataFrame, days: int = 7) -> DataFrame:
    """states with one row a day → for each day that has a state: day, and the merged state of it and the days - 1 before it."""
    ends = states.select(F.col("day").alias("end")).distinct()
    each = states.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_add("day", k))).alias("end"), "requests", "users", "latency")
    return each.join(ends, "end", "left_semi").groupBy(F.col("end").alias("day")).agg(F.sum("requests").alias("requests"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("latency").alias("latency"))


def read(merged: DataFrame, at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """day, requests, about_users, and about_p50, ... of merged states."""
    found = [F.kll_sketch_get_quantile_double("latency", F.lit(float(p))).alias(f"about_p{round(100 * p)}") for p in at]
    return merged.select("day", "requests", F.hll_sketch_estimate("users").alias("about_users"), *found)


def within(audit: DataFrame, ends: DataFrame, days: int, day: str = "day") -> DataFrame:
    """The rows of audit once for each window (a column `end`) that holds their day; ends: day."""
    each = audit.withColumn("end", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_add(day, k))))
    return each.join(ends.select(F.col("day").alias("end")).distinct(), "end", "left_semi")


def exact_percentiles(rows: DataFrame, by: str, value: str, at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """rows(by, value) → by, p, exact: the least value whose share of values up to it reaches p, as percentile_disc has it. Nulls and NaN are
    left out; a group without values has no row."""
    own = rows.select(F.col(by).alias("grp"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    sums = own.groupBy("grp").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ps = F.explode(F.array(*(F.lit(float(p)) for p in at)))
    goals = sums.select("grp", "n", "lo", "hi", ps.alias("p")).withColumn("rank", F.greatest(F.ceil(F.col("p") * F.col("n") - 1e-9), F.lit(1)).cast("long"))
    open_, left, _ = counted(goals.select("grp", "p", "lo", "hi", "rank"), "goals", F.col("lo") < F.col("hi"))
    done = open_.filter("lo = hi")
    while left:
        now = open_.filter("lo < hi")
        # a bin's number from its share of the span; the halves keep differences of huge values finite
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bin_ = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
        held = own.join(now, "grp").filter("v >= lo and v <= hi").groupBy("grp", "p", "rank", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("grp", "p").orderBy("bin"))  # at most BINS rows
        hit = held.withColumn("upto", upto).filter("upto >= rank and upto - n < rank")
        open_, _, (more,) = counted(hit.select("grp", "p", "lo", "hi", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "goals", F.col("lo") < F.col("hi"))
        done, left = done.union(open_.filter("lo = hi")), more
    return done.select(F.col("grp").alias(by), "p", F.col("lo").alias("exact"))


def usage_windows(audit: DataFrame, days: int = 7, at: tuple[float, ...] = (0.5, 0.95), states: DataFrame | None = None) -> DataFrame:
    """For each day of audit(day, user_id, cost) and the days before it: requests, users (exact), p50, ... (exact), and beside them what the
    merged states say. states: those that are kept already."""
    kept = stored(daily_states(audit) if states is None else states, "states")
    about = read(windows(kept, days), at)
    spread = stored(within(audit.select("day", "user_id", "cost"), kept.select("day"), days), "windows")
    users = spread.groupBy("end").agg(F.countDistinct("user_id").alias("users"))
    exact = exact_percentiles(spread, "end", "cost", at).groupBy("end").agg(*(F.max(F.when(F.col("p") == float(p), F.col("exact"))).alias(f"p{round(100 * p)}") for p in at))
    return about.join(users.withColumnRenamed("end", "day"), "day", "left").join(exact.withColumnRenamed("end", "day"), "day", "left")
