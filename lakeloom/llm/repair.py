"""Token ids on disk as Re-Pair grammars, with random access.

Documents stand in ascending order of doc_id (nulls first, ties by place in the scan), cut into shards of about SHARD ids. In each shard
the pairs of neighbouring symbols that occur most are replaced by new symbols (non-overlapping, from the left), again and
again until no pair occurs LEAST times; the rules and the length of each symbol's expansion are stored with the rest of the sequence, so any document is
decoded from its own part of the sequence alone. A shard is one row of a table written by Spark; its `data` is the file:

    "RPG1"; unsigned 32-bit counts: documents, rules, symbols; 64-bit doc_ids; one byte each: doc_id is null; then unsigned
    32-bit arrays: ids in each document, left and right symbol of each rule, expansion length of each rule, the sequence.
    Symbols under FIRST_RULE are ids, FIRST_RULE + k is rule k. All little-endian.

Null and empty texts hold the end id alone. Repeated rows are written once each. An empty table gives files without documents and an empty
result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm._common import chunks, partition_id, ragged, tidied, tune, write_table
from lakeloom.llm.wordbpe import word_ids

SHARD, SLICE = 1 << 20, 4 << 20  # ids in a shard, bytes of text that are encoded at once
FIRST_RULE = 1 << 17
PER_ROUND, LEAST = 1 << 14, 16


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left and right symbol of each rule, expansion lengths, the sequence that is left). Every round counts the pairs there are (a count
    by hash first tells which cannot occur LEAST times) and replaces the most frequent ones; where two overlap, the more frequent. Rounds go
    on until no pair occurs LEAST times: the most frequent keeps half of its places at least, so every round makes a rule. Pairs that
    are too rare stay so, as only pairs with new symbols come about: their places are not looked at again."""
    sequence = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.empty(0, np.uint32)
    alive = np.arange(max(len(sequence) - 1, 0))  # where pairs begin that may be frequent
    while len(alive) >= LEAST:
        left, right = sequence[alive], sequence[alive + 1]
        bucket = (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(12)
        some = (np.bincount(bucket, minlength=1 << 20) >= LEAST)[bucket]
        held = alive[some]
        pairs, inverse, counts = np.unique(left[some].astype(np.uint64) << np.uint64(32) | right[some], return_inverse=True, return_counts=True)
        top = np.flatnonzero(counts >= LEAST)
        if not len(top):
            break
        top = top[np.argsort(-counts[top], kind="stable")[:PER_ROUND]]
        rank = np.full(len(counts), -1, np.int32)
        rank[top] = np.arange(len(top))
        own = rank[inverse]
        chosen = own >= 0
        at, own = held[chosen], own[chosen]
        frequent = at if len(top) < PER_ROUND else held[counts[inverse] >= LEAST]
        pair = np.stack([pairs[top] >> np.uint64(32), pairs[top] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        # where places overlap the more frequent pair keeps its own, and of the places left between those every second in a run
        near = np.concatenate([[False], at[1:] == at[:-1] + 1, [False]])
        before, after = np.concatenate([[0], own[:-1]]), np.append(own[1:], 0)
        keep = _every_second(near[:-1] & (before == own)) & ~(near[:-1] & (before < own)) & ~(near[1:] & (after < own))
        free = ~keep & ~(near[:-1] & np.concatenate([[False], keep[:-1]])) & ~(near[1:] & np.append(keep[1:], False))
        rest = np.flatnonzero(free)
        keep[rest] = _every_second(np.concatenate([[False], at[rest][1:] == at[rest][:-1] + 1])[: len(rest)])
        at, own = at[keep], own[keep]
        often = np.bincount(own, minlength=len(top)) >= LEAST // 2
        at, own = at[often[own]], own[often[own]]
        number = np.cumsum(often) - 1
        pair = pair[often]
        of_rule = np.concatenate([lengths, [1]]).astype(np.int64)  # the last stands for ids
        symbol = np.where(pair >= FIRST_RULE, pair.astype(np.int64) - FIRST_RULE, len(lengths))
        new = of_rule[symbol].sum(1).astype(np.uint32)
        sequence = sequence.copy()
        sequence[at] = (FIRST_RULE + len(lengths) + number[own]).astype(np.uint32)
        stay = np.ones(len(sequence), bool)
        stay[at + 1] = False
        maybe = np.zeros(len(sequence), bool)
        maybe[frequent] = maybe[at] = True
        before = at - 1
        before[~stay[before]] -= 1  # the symbol before is a new one itself
        maybe[before[before >= 0]] = True
        sequence, maybe = sequence[stay], maybe[stay]
        alive = np.flatnonzero(maybe[:-1])
        rules.append(pair)
        lengths = np.concatenate([lengths, new])
    return np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), lengths, sequence


def _every_second(goes_on: np.ndarray) -> np.ndarray:
    """Marks the first, third, ... element of each run; goes_on: whether an element belongs to the run of the one before."""
    out, at = np.ones(len(goes_on), bool), np.flatnonzero(goes_on)
    if len(at):
        run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        out[at[place % 2 == 0]] = False
    return out


def pack(doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    rules, lengths, sequence = compress(ids)
    head = np.array([len(counts), len(rules), len(sequence)], "<u4").tobytes()
    null = np.asarray(doc_ids.is_null()).astype(np.uint8).tobytes()
    keys = np.asarray(doc_ids.fill_null(0)).astype("<i8").tobytes()
    return b"RPG1" + head + keys + null + b"".join(np.ascontiguousarray(x, "<u4").tobytes() for x in (counts, rules[:, 0], rules[:, 1], lengths, sequence))


class Shard:
    """A file of the format above; ids of one document or of all."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPG1":
            raise ValueError("not a Re-Pair shard")
        n, rules, symbols = np.frombuffer(data, "<u4", 3, 4)
        n, rules, symbols = int(n), int(rules), int(symbols)
        self.doc_ids = pa.array(np.frombuffer(data, "<i8", n, 16), mask=np.frombuffer(data, np.uint8, n, 16 + 8 * n).astype(bool))
        at, parts = 16 + 9 * n, []
        for size in (n, rules, rules, rules, symbols):
            parts.append(np.frombuffer(data, "<u4", size, at))
            at += 4 * size
        self.counts, self.left, self.right, self.lengths, self.sequence = parts
        self.bounds = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])
        flat = np.arange(FIRST_RULE, FIRST_RULE + rules, dtype=np.uint32)  # every rule, expanded step by step
        while len(at := np.flatnonzero(flat >= FIRST_RULE)):
            rule = flat[at] - FIRST_RULE
            many = np.ones(len(flat), np.int64)
            many[at] = 2
            at, flat = (np.cumsum(many) - many)[at], np.repeat(flat, many)
            flat[at], flat[at + 1] = self.left[rule], self.right[rule]
        self.flat = flat
        self.begin = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.size = np.ones(symbols, np.int64)
        rule = self.sequence >= FIRST_RULE
        self.size[rule] = self.lengths[self.sequence[rule] - FIRST_RULE]
        self.ends = np.cumsum(self.size)

    def _expand(self, a: int, b: int) -> np.ndarray:
        """Ids of symbols a to b."""
        symbols, size = self.sequence[a:b], self.size[a:b]
        rule = symbols >= FIRST_RULE
        out = np.repeat(symbols, size)
        own = symbols[rule] - FIRST_RULE
        out[ragged(np.cumsum(size)[rule] - size[rule], size[rule])] = self.flat[ragged(self.begin[own], size[rule])]
        return out

    def document(self, i: int) -> np.ndarray:
        """Random access: only the symbols that overlap document i are expanded."""
        start, stop = self.bounds[i], self.bounds[i + 1]
        a, b = int(np.searchsorted(self.ends, start, "right")), int(np.searchsorted(self.ends, stop, "left")) + 1
        skip = int(start - (self.ends[a] - self.size[a])) if a < len(self.ends) else 0
        return self._expand(a, b)[skip : skip + int(stop - start)]

    def all(self) -> np.ndarray:
        return self._expand(0, len(self.sequence))


def write(docs: DataFrame, tokenizer: str, end: int = 2, shard: int = SHARD) -> str:
    """docs(doc_id, text) → path of the written shards (part, shard, n_tokens, data). part and shard order them."""
    tune(docs.sparkSession)

    def run(batches):
        part, number = partition_id(), 0
        keys: list = []
        counts: list = []
        ids: list = []
        size = 0

        def row():
            doc_ids, n = pa.concat_arrays(keys), np.concatenate(counts)
            data = pack(doc_ids, n, np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([int(n.sum())], pa.int64()), pa.array([data], pa.binary())], ["part", "shard", "n_tokens", "data"])

        for _, own, texts in chunks(batches, SLICE):
            flat, bounds = word_ids(tokenizer)(texts)
            n = np.diff(bounds)
            whole = np.insert(flat, bounds[1:], end).astype(np.uint32)
            edges = np.concatenate([[0], np.cumsum(n + 1)])
            at = 0
            while at < len(texts):
                cut = int(np.clip(np.searchsorted(edges, edges[at] + shard - size, "right") - 1, at + 1, len(texts)))
                keys.append(own.slice(at, cut - at))
                counts.append((n[at:cut] + 1).astype(np.uint32))
                ids.append(whole[edges[at] : edges[cut]])
                size += int(edges[cut] - edges[at])
                at = cut
                if size >= shard:
                    yield row()
                    number, size, keys, counts, ids = number + 1, 0, [], [], []
        if keys:
            yield row()

    # rows of one doc_id may be many: they are ranged by their place in the scan too
    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    ranged = keyed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    return write_table(ranged.mapInArrow(tidied(run), "part int, shard int, n_tokens long, data binary"), "repair")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone."""
    shards = spark.read.parquet(path)

    def run(batches):
        for batch in batches:
            for part, number, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Shard(data)
                ids = own.all().astype("<u4")
                n = len(own.counts)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(own.bounds[:-1], own.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([own.doc_ids, pa.array(own.bounds[:-1]), pa.array(own.counts.astype(np.int64)), pa.array(crc, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32())], ["doc_id", "inside", "n_tokens", "ids_crc32", "part", "shard"])

    documents = shards.select("part", "shard", "data").mapInArrow(tidied(run), "doc_id long, inside long, n_tokens long, ids_crc32 long, part int, shard int")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("of_part"))
    starts = sizes.withColumn("of_shard", F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("shard")), F.lit(0))).join(parts, "part")
    joined = documents.join(starts.select("part", "shard", (F.col("of_part") + F.col("of_shard")).alias("first")), ["part", "shard"])
    return joined.select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
