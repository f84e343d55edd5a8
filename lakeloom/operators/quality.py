"""Coverage, parse and usage reports, gold-standard comparison and sampling."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.columns import layer_of, squashed

COVERED_LAYERS = ("dwd", "dws", "ads", "dim")


def ratio(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(1.0), 4)


def coverage(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """tables(full_name, layer, domain, owner, is_online), edges(dst) → layer, domain, owner, total, covered (tables that an edge
    leads to)."""
    led = edges.select(F.col("dst").alias("full_name")).distinct().withColumn("led", F.lit(1))
    own = tables.filter(F.col("is_online") & F.col("layer").isin(*COVERED_LAYERS)).join(led, "full_name", "left")
    return own.groupBy("layer", "domain", "owner").agg(F.count("*").alias("total"), F.count("led").alias("covered"))


def rolled_up(covered: DataFrame, *keys: str) -> DataFrame:
    sums = covered.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("covered").alias("covered"))
    return sums.select(*keys, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("covered", F.lit(0)).alias("covered"), ratio(F.coalesce("covered", F.lit(0)), F.coalesce("total", F.lit(0))).alias("ratio"))


def confidence_shares(edges: DataFrame) -> DataFrame:
    """Counts by confidence in one row, and both readings of 'not certain': medium alone, and all but high."""
    n = F.count("*")
    return edges.agg(n.alias("total"), F.count_if(F.col("confidence") == "medium").alias("medium"), ratio(F.count_if(F.col("confidence") == "medium"), n).alias("medium_ratio"), ratio(F.count_if(F.coalesce("confidence", F.lit("")) != "high"), n).alias("not_high_ratio"))


def usage(audit: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """audit(ts, channel, status, refuse_reason, user_id) of the last days before as_of: one row of counts and ratios."""
    own = audit.filter((F.col("ts") > as_of - F.expr(f"interval {days} days")) & (F.col("ts") <= as_of))
    semantic, adhoc = F.count_if(F.col("channel") == "semantic"), F.count_if(F.col("channel") == "adhoc")
    return own.agg(F.count("*").alias("requests"), F.countDistinct("user_id").alias("users"), ratio(F.count_if(F.col("status") == "refused"), F.count("*")).alias("refusal_ratio"), F.round(semantic / F.greatest(semantic + adhoc, F.lit(1)), 4).alias("semantic_ratio"))


def usage_counts(audit: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    own = audit.filter((F.col("ts") > as_of - F.expr(f"interval {days} days")) & (F.col("ts") <= as_of))
    return own.groupBy("channel", "status", "refuse_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "channel", "status", "refuse_reason")


def latency(values: DataFrame, column: str, *keys: str) -> DataFrame:
    """Nearest-rank percentiles, mean and maximum."""
    p = [F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY {column})").alias(f"p{int(x * 100)}") for x in (0.5, 0.95, 0.99)]
    return values.groupBy(*keys).agg(*p, F.round(F.avg(column), 4).alias("mean"), F.max(column).alias("most"))


def compared(gold: DataFrame, machine: DataFrame) -> DataFrame:
    """Column edges (case_id, dst_col, src_table, src_col, expr, and place: their order in the case, if there is one) of both sides → verdict:
    matched, missing, extra or mismatch. An edge that stands several times counts once, with the first expression (by place, then by
    text). An empty gold expression is not compared; else it must occur in the machine's, letter case, white space and quoting aside."""
    keys = ["case_id", "dst_col", "src_table", "src_col"]

    def first(side: DataFrame, name: str, mark: str) -> DataFrame:
        order = F.struct("place", "expr") if "place" in side.columns else F.col("expr")
        return side.groupBy(*keys).agg(F.min_by("expr", order).alias(name)).withColumn(mark, F.lit(True))

    left, right = first(gold, "gold_expr", "g"), first(machine, "machine_expr", "m")
    same = (squashed(F.coalesce("gold_expr", F.lit(""))) == "") | F.contains(squashed(F.coalesce("machine_expr", F.lit(""))), squashed(F.coalesce("gold_expr", F.lit(""))))
    verdict = F.when(F.col("m").isNull(), "missing").when(F.col("g").isNull(), "extra").when(same, "matched").otherwise("mismatch")
    return left.join(right, keys, "full_outer").select(*keys, verdict.alias("verdict"))


def table_compared(gold: DataFrame, machine: DataFrame) -> DataFrame:
    """cases(case_id, target, sources array, failed) of both sides → case_id, missing, extra sources, and whether the case agrees; a gold
    case without target wants the machine to fail."""
    g, m = (x.select("case_id", *(F.col(c).alias(f"{p}_{c}") for c in ("target", "sources", "failed"))) for x, p in ((gold, "g"), (machine, "m")))
    none = F.array().cast("array<string>")
    joined = g.join(m, "case_id", "left")
    missing, extra = F.array_except(F.coalesce("g_sources", none), F.coalesce("m_sources", none)), F.array_except(F.coalesce("m_sources", none), F.coalesce("g_sources", none))
    agrees = F.when(F.col("g_target").isNull(), F.coalesce("m_failed", F.lit(True))).otherwise(F.coalesce(F.col("g_target") == F.col("m_target"), F.lit(False)) & (F.size(missing) == 0) & (F.size(extra) == 0))
    return joined.select("case_id", missing.alias("missing"), extra.alias("extra"), agrees.alias("agrees"))


def accuracy(verdicts: DataFrame, *keys: str) -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.groupBy(*keys).agg(*(n(v).alias(v) for v in ("matched", "missing", "extra", "mismatch")), ratio(n("matched"), F.count("*")).alias("accuracy"))


def accepted(table_accuracy: float, edge_accuracy: float, least_table: float = 0.99, least_edge: float = 0.95) -> bool:
    return table_accuracy >= least_table and edge_accuracy >= least_edge


def shape_of(sql: Column) -> Column:
    """The construct that a statement stands for: the first that fits of multi_insert, self_dep, lateral_view, cte, window, join, simple."""
    text = F.lower(sql)
    target = F.regexp_extract(text, r"insert\s+(?:overwrite|into)\s+(?:table\s+)?([\w.`]+)", 1)
    sources = F.regexp_extract_all(text, F.lit(r"(?:from|join)\s+([\w.`]+)"), F.lit(1))
    return (
        F.when(F.size(F.regexp_extract_all(text, F.lit(r"insert\s+(overwrite|into)\s"), F.lit(1))) > 1, "multi_insert")
        .when((target != "") & F.array_contains(sources, target), "self_dep")
        .when(text.rlike(r"lateral\s+view"), "lateral_view")
        .when(text.rlike(r"\bwith\s+\w+\s+as\s*\("), "cte")
        .when(text.rlike(r"\bover\s*\("), "window")
        .when(text.rlike(r"\bjoin\b"), "join")
        .otherwise("simple")
    )


def quotas(counts: dict, total: int) -> dict:
    """How many of total each stratum gives: one each first, the rest in proportion by largest remainder, never more than it has (what is
    left over goes to the largest). With fewer than there are strata the largest give one each."""
    size, order = sum(counts.values()), sorted(counts, key=lambda k: (-counts[k], str(k)))
    if total >= size:
        return dict(counts)
    if total < len(order):
        return dict.fromkeys(order[:total], 1)
    rest = total - len(order)
    exact = {k: rest * counts[k] / size for k in order}
    out = {k: 1 + int(exact[k]) for k in order}
    for k in sorted(order, key=lambda k: (int(exact[k]) - exact[k], str(k)))[: total - sum(out.values())]:
        out[k] += 1
    out = {k: min(n, counts[k]) for k, n in out.items()}
    for k in order:
        out[k] += min(counts[k] - out[k], total - sum(out.values()))
    return out


def stratified(rows: DataFrame, key: str, strata: list[str], total: int, seed: str = "0") -> DataFrame:
    """A reproducible sample: in each stratum the rows with the least md5(seed, key) up to its quota."""
    counts = {tuple(r[:-1]): r[-1] for r in rows.groupBy(*strata).count().collect()}  # a few strata
    wanted = quotas(counts, total)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n in strata)
    table = rows.sparkSession.createDataFrame([(*[dict(zip(strata, k, strict=True))[n] for n, _ in rows.dtypes if n in strata], q) for k, q in wanted.items()], f"{schema}, quota long")
    order = Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return rows.withColumn("rn", F.row_number().over(order)).join(F.broadcast(table), strata).filter("rn <= quota").drop("rn", "quota")


def layer_or_other(name: Column) -> Column:
    """The layer of a table name, `other` if no rule fits."""
    layer = layer_of(F.substring_index(name, ".", -1))
    return F.when(layer == "", "other").otherwise(layer)


def exported(sample: DataFrame, folder: str) -> dict[str, str]:
    """Writes sample(case_id, sql_text, dialect) as <case_id>.sql files and dialects.json into a folder of this machine; returns the
    dialects. A sample is a few statements for people to read."""
    out: dict[str, str] = {}
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    for r in sample.select("case_id", "sql_text", "dialect").orderBy("case_id").collect():
        name = re.sub(r"\W+", "_", r.case_id or "").strip("_") or "unknown"
        (root / f"{name}.sql").write_text((r.sql_text or "").rstrip() + "\n")
        out[name] = r.dialect or "hive"
    (root / "dialects.json").write_text(json.dumps(out, indent=1, sort_keys=True))
    return out


def blank_comments(columns: DataFrame) -> DataFrame:
    """columns(comment) → how many there are and how many have no comment."""
    return columns.agg(F.count("*").alias("columns"), F.count_if(F.trim(F.coalesce("comment", F.lit(""))) == "").alias("blank"))


def tampered(machine: DataFrame, wrong: str = "WRONG(expr)") -> DataFrame:
    """Column edges (case_id, dst_col, src_table, src_col, expr) as a gold standard with one mistake: the least edge's expression is replaced.
    For checking that a comparison finds it."""
    keys = ["case_id", "dst_col", "src_table", "src_col"]
    least = machine.agg(F.min(F.struct(*keys)).alias("least")).first()["least"]  # one row
    if least is None:
        return machine
    hit = F.lit(True)
    for k in keys:
        hit = hit & F.col(k).eqNullSafe(F.lit(least[k]))
    return machine.withColumn("expr", F.when(hit, wrong).otherwise(F.col("expr")))


def gold_report(tables: DataFrame, edges: DataFrame) -> tuple[str, bool]:
    """table_compared rows and compared verdicts → the report as text, and whether both accuracies are accepted."""
    t = tables.agg(F.count("*").alias("n"), F.count_if("agrees").alias("good")).first()
    per = accuracy(edges, "case_id").orderBy("case_id").collect()  # a row a case, written for people
    good, whole = sum(r.matched for r in per), sum(r.matched + r.missing + r.extra + r.mismatch for r in per)
    share = lambda a, b: a / b if b else 1.0
    passed = accepted(share(t.good, t.n), share(good, whole))
    lines = ["# Gold-standard report", "", f"- tables: {t.good}/{t.n} = {100 * share(t.good, t.n):.2f} %", f"- column edges: {good}/{whole} = {100 * share(good, whole):.2f} %", f"- accepted: {'yes' if passed else 'no'}", "", "| case | matched | missing | extra | mismatch |", "|-|-|-|-|-|"]
    lines += [f"| {r.case_id} | {r.matched} | {r.missing} | {r.extra} | {r.mismatch} |" for r in per]
    return "\n".join(lines), passed


def health(runs: DataFrame, closure_rows: int, failed_sql: int, as_of: Column, oldest_hours: int = 26, most_failed: int = 200) -> DataFrame:
    """runs(run_id, run_type, status, started_at) → problem rows; none means healthy. The last full run is the one that started last (of two at
    one moment the one of the greater id)."""
    last = runs.filter("run_type = 'full'").agg(F.max_by(F.struct("status", "started_at"), F.struct("started_at", "run_id")).alias("last")).select("last.status", F.col("last.started_at").alias("at"))
    checks = {
        "no_full_run": F.col("at").isNull(),
        "full_run_too_old": F.col("at") < as_of - F.expr(f"interval {oldest_hours} hours"),
        "last_run_not_successful": F.col("status").isin("aborted", "failed"),
        "too_many_failed_sql": F.lit(failed_sql > most_failed),
        "closure_empty": F.lit(closure_rows == 0),
    }
    return last.select(F.explode(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items()))).alias("problem")).filter("problem is not null")


def weekly_markdown(audit: DataFrame, edges: DataFrame, statements: DataFrame, as_of: Column) -> str:
    """The weekly report as text; every figure is aggregated on the cluster first."""
    u, c = usage(audit, as_of).first(), confidence_shares(edges).first()
    lines = ["# Weekly report", "", f"- requests: {u.requests}, users: {u.users}, refusal ratio: {u.refusal_ratio}, semantic ratio: {u.semantic_ratio}", f"- edges: {c.total}, medium ratio: {c.medium_ratio}, not high: {c.not_high_ratio}", "", "| status | reason | statements |", "|-|-|-|"]
    lines += [f"| {r.parse_status} | {r.reason or ''} | {r['count']} |" for r in statements.groupBy("parse_status", "reason").count().orderBy("parse_status", "reason").collect()]
    lines += ["", "| refusal | requests |", "|-|-|"] + [f"| {r.refuse_reason} | {r.n} |" for r in usage_counts(audit, as_of).filter("refuse_reason is not null").collect()]
    return "\n".join(lines)
