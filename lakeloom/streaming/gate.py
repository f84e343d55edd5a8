"""The gate in front of the parser as a stateful stream: of published statements only those whose text differs from the one before go on.

State is kept for each sql_id: the hash of its last text and when that was published. A text that comes back after another one is a change
again; a text that repeats the last one is none; rows published no later than the last seen are late and are ignored. Rows of one batch go by
published_at, then by hash. The watermark trails by `keep`: what is older is late for every statement, and the state of a statement that
published nothing for `keep` behind the watermark expires, so that its next text counts as new. Time is that of the rows, so a run over
what there is ends, and a second run over the same files does the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "sql_hash string, micros long"
PASSED = "sql_id string, sql_text string, sql_hash string, published_at timestamp"
KEEP_MS = 400 * 24 * 3600 * 1000


def passed(key: str, rows: Iterator[tuple[int, str]], last: tuple[str, int] | None) -> tuple[list[tuple], tuple[str, int] | None]:
    """rows: (micros, text) of one statement in a batch. Those that go on as (id, text, hash, micros), and the new state."""
    out, digest, at = [], *(last or (None, None))
    for when, own, text in sorted((when, hashlib.sha256(text.encode()).hexdigest(), text) for when, text in rows):
        if last and when <= last[1]:
            continue
        if own != digest:
            out.append((key, text, own, when))
        digest, at = own, when
    return out, None if digest is None else (digest, at)


def changes(published: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """published(sql_id, sql_text, published_at) as a stream → the rows of PASSED whose text is new (update mode). Rows without id or time are left out, a
    null text counts as empty."""
    rows = published.filter("sql_id is not null and published_at is not null").withWatermark("published_at", f"{keep_ms} milliseconds")
    rows = rows.select("sql_id", F.coalesce("sql_text", F.lit("")).alias("sql_text"), F.unix_micros("published_at").alias("micros"), "published_at")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        met = [x for b in batches for x in zip(b["micros"].tolist(), b["sql_text"].tolist(), strict=True)]
        out, new = passed(key[0], iter(met), tuple(state.get) if state.exists else None)
        if new:
            state.update(new)
            state.setTimeoutTimestamp(max(new[1] // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        if out:  # a frame costs more than the rows of a statement
            yield pd.DataFrame(dict(zip(("sql_id", "sql_text", "sql_hash", "micros"), map(list, zip(*out, strict=True)), strict=True)))

    found = rows.groupBy("sql_id").applyInPandasWithState(step, "sql_id string, sql_text string, sql_hash string, micros long", STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return found.select("sql_id", "sql_text", "sql_hash", F.timestamp_micros("micros").alias("published_at"))
