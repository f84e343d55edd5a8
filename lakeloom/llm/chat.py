"""Preference formatting: a shared prompt and two completions with loss masks, in DataFrame functions only.

A pair holds two conversations, chosen and rejected, as arrays of turns (role, text). The longest common prefix of turns is
rendered once as the prompt; what follows in each conversation is its completion, given as the rendered text, as segments
with the mask of the loss (assistant turns count, others do not), and as one mask character for each turn.

A null role or text counts as empty. Equal rows of a conversation count once; turns with the same number are ordered by role
and text. Rows without conv_id belong to no conversation and are left out. Where one side is a prefix of the other its completion is
empty. An empty table gives an empty result; other columns are not read. A conversation is one row, as long as its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm._common import stored

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNT = "assistant"


def conversations(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) → conv_id, turns (array of role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that two arrays share."""
    shorter = F.least(F.size(a), F.size(b))
    every = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(every, lambda i: F.get(a, i) != F.get(b, i)), F.lit(0)), shorter)


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, chosen, rejected: arrays of turns) → pair_id, n_prompt_turns, prompt, and for each side its completion,
    segments (array of text, loss) and mask."""
    counted = pairs.select("pair_id", "chosen", "rejected", common_prefix(F.col("chosen"), F.col("rejected")).alias("n"))
    join = lambda turns: F.array_join(F.transform(turns, rendered), "")
    out = [F.col("pair_id"), F.col("n").cast("long").alias("n_prompt_turns"), join(F.slice("chosen", 1, F.col("n"))).alias("prompt")]
    for side in ("chosen", "rejected"):
        rest = F.slice(side, F.col("n") + 1, F.size(side))
        out += [
            join(rest).alias(side),
            F.transform(rest, lambda t: F.struct(rendered(t).alias("text"), (t["role"] == LEARNT).alias("loss"))).alias(f"{side}_segments"),
            F.array_join(F.transform(rest, lambda t: F.when(t["role"] == LEARNT, "1").otherwise("0")), "").alias(f"{side}_mask"),
        ]
    return counted.select(*out)


def following(keys: DataFrame) -> DataFrame:
    """keys(conv_id), distinct → conv_id, following: the next key in order, after the last the first. Keys are ordered within range
    partitions; only partitions' first keys meet others, so one task sees a row for each partition, never all keys."""
    ranged = stored(keys.repartitionByRange("conv_id").withColumn("part", F.spark_partition_id()), "keys")
    inside = ranged.withColumn("after", F.lead("conv_id").over(Window.partitionBy("part").orderBy("conv_id")))
    line = Window.orderBy("part")  # rows are partitions
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = ranged.groupBy("part").agg(F.min("conv_id").alias("first"))
    heads = firsts.select("part", F.coalesce(F.lead("first").over(line), F.min("first").over(whole)).alias("head"))
    return inside.join(heads, "part").select("conv_id", F.coalesce("after", "head").alias("following"))


def branched_pairs(rows: DataFrame) -> DataFrame:
    """A pair for each conversation of rows: it is chosen, and rejected is its first half (rounded down) followed by the turns
    that the next conversation (by conv_id, after the last the first) has from there on."""
    own = stored(conversations(rows), "conversations")
    after = own.select(F.col("conv_id").alias("following"), F.col("turns").alias("after"))
    paired = own.join(following(own.select("conv_id")), "conv_id").join(after, "following")
    half = F.floor(F.size("turns") / 2).cast("int")
    return paired.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", 1, half), F.slice("after", half + 1, F.size("after"))).alias("rejected"))


def digests(formatted: DataFrame) -> DataFrame:
    return formatted.select(F.col("pair_id").alias("conv_id"), "n_prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn, r, x) AS v FROM t GROUP BY conv_id),
n AS (SELECT conv_id, v, coalesce(lead(v) OVER (ORDER BY conv_id), first_value(v) OVER (ORDER BY conv_id)) AS a, len(v) // 2 AS k FROM c),
p AS (SELECT conv_id, v, list_concat(list_slice(v, 1, k), list_slice(a, k + 1, len(a))) AS b FROM n),
i AS (SELECT conv_id, v, b, unnest(range(1, greatest(len(v), len(b)) + 2)) AS i FROM p),
m AS (SELECT conv_id, any_value(v) AS v, any_value(b) AS b, min(i) - 1 AS m FROM i
      WHERE i > least(len(v), len(b)) OR v[i].r <> b[i].r OR v[i].x <> b[i].x GROUP BY conv_id)
SELECT conv_id, CAST(m AS BIGINT) AS n_prompt_turns,
       array_to_string([concat('<|', y.r, '|>', chr(10), y.x, '<|end|>', chr(10)) FOR y IN list_slice(v, 1, m)], '') AS prompt,
       array_to_string([concat('<|', y.r, '|>', chr(10), y.x, '<|end|>', chr(10)) FOR y IN list_slice(v, m + 1, len(v))], '') AS chosen,
       array_to_string([CASE WHEN y.r = 'assistant' THEN '1' ELSE '0' END FOR y IN list_slice(v, m + 1, len(v))], '') AS chosen_mask,
       array_to_string([concat('<|', y.r, '|>', chr(10), y.x, '<|end|>', chr(10)) FOR y IN list_slice(b, m + 1, len(b))], '') AS rejected,
       array_to_string([CASE WHEN y.r = 'assistant' THEN '1' ELSE '0' END FOR y IN list_slice(b, m + 1, len(b))], '') AS rejected_mask
FROM m
"""
