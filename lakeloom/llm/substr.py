"""Removal of passages that repeat: level-wise doubling of repeated windows.

Level 0 holds windows of half the length (rounded up). Only a content-defined sample of them is counted: the least hash
of every stretch that spans one full window, so each full window holds a sampled one at the same place of its text
(winnowing). A full window is a candidate at level 1 only where its sampled half repeats. Windows that repeat at one level,
those alone, are extended to twice the length at the next, until no candidates survive: a window of twice the length can
repeat only where both its halves do, and its hash is made of theirs, so these levels hold the survivors and read no text.
Levels count over the whole corpus: each chunk asks once about every distinct window, per key partition, and is told which
ones start twice or more. A window that a third of the documents hold is asked about once per chunk.

Windows are runs of words `[^\\x20\\x09-\\x0D]+` of one document, named by two independent 64-bit hashes of their words (beyond the
first full level by one, made from those of the halves). Null and
empty texts have no words; texts shorter than a window lose nothing; repeated rows count as documents of their own, so all
words of a copied text that fills a window go. An empty table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._common import CHUNK_SCHEMA, Texts, _joined, by_part, chunk_batch, chunks, dropped, key_parts, pairs, read_chunk, split, squeeze, stored, swept, text_chunks, tidied, tidy, tune, unsqueeze, windows, word_hashes

LENGTH = 35
LIMIT = 4 << 20  # bytes of text in a chunk


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every width consecutive values."""
    have, step = values, 1
    while step * 2 <= width:
        have = pick(have[:-step], have[step:])
        step *= 2
    rest = width - step
    return pick(have[: len(have) - rest], have[rest:]) if rest else have


class Chunk:
    """The words of a chunk, and the windows of the first levels."""

    def __init__(self, texts: Texts, length: int):
        self.texts, self.length, self.half = texts, length, (length + 1) // 2
        self.starts, self.ends, self.bounds = split(texts)

    @cached_property
    def hashes(self) -> np.ndarray:
        return word_hashes(self.texts, self.starts, self.ends)

    def sample(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of full windows, for each the least hash of the halves within, and the hashes of all sampled halves."""
        at, halves = windows(self.hashes, self.bounds, self.half)
        starts, full_hashes = windows(self.hashes, self.bounds, self.length)
        if not len(starts):
            return starts, full_hashes, np.empty(0, np.uint64), np.empty(0, np.uint64)
        spread = np.full(len(self.hashes), np.iinfo(np.uint64).max, np.uint64)
        spread[at] = halves
        width = self.length - self.half + 1
        least = _sliding(spread, width, np.minimum)[starts]
        full = np.zeros(len(self.hashes) + width, np.uint64)  # 0: no full window starts here
        full[starts + width - 1] = least
        seen = _sliding(full, width, np.maximum)[: len(self.hashes)]
        return starts, full_hashes, least, halves[halves == seen[at]]

    def others(self) -> np.ndarray:
        """The second hash of the full windows."""
        return windows(word_hashes(self.texts, self.starts, self.ends, 1), self.bounds, self.length)[1]


def _ask(chunk: int, parts: int, a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """A row for each key partition: the distinct windows, and which stand in the chunk more than once. b may be empty."""
    first, _, counts = pairs(a, b)
    a, b, many = a[first], b[first] if len(b) else b, counts > 1
    return [(chunk, p, a[m].tobytes(), b[m].tobytes() if len(b) else b"", np.packbits(many[m]).tobytes()) for p, m in by_part((a % np.uint64(parts)).astype(np.int64), parts)]


def _answer(group: pa.Table) -> pa.Table:
    lists = [np.frombuffer(k, np.uint64) for k in group.column("keys").to_pylist()]
    many = np.concatenate([np.unpackbits(np.frombuffer(d, np.uint8), count=len(k)) for d, k in zip(group.column("data").to_pylist(), lists, strict=True)])
    a, b = np.concatenate(lists), np.frombuffer(b"".join(group.column("lengths").to_pylist()), np.uint64)
    order = np.argsort(a, kind="stable")
    same = a[order][1:] == a[order][:-1]
    if len(b):
        both = same & (b[order][1:] == b[order][:-1])
        if (both != same).any():  # windows of equal first hashes lie in any order
            order = np.lexsort((b, a))
            both = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        same = both
    twice = many[order].astype(bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(a), bool)
    out[order] = twice
    at, rows = 0, []
    for chunk, part, keys in zip(group.column("chunk").to_pylist(), group.column("part").to_pylist(), lists, strict=True):
        rows.append((chunk, part, b"", b"", np.packbits(out[at : at + len(keys)]).tobytes()))
        at += len(keys)
    return pa.Table.from_batches([chunk_batch(rows)])


def _told(a: np.ndarray, b: np.ndarray, parts: int, answers: list[tuple]) -> np.ndarray:
    """Which of the windows repeat, from the answers to _ask."""
    first, inverse, _ = pairs(a, b)
    out, got = np.zeros(len(first), bool), {p: data for p, _, _, data in answers}
    for p, m in by_part((a[first] % np.uint64(parts)).astype(np.int64), parts):
        out[m] = np.unpackbits(np.frombuffer(got[p], np.uint8), count=len(m)).astype(bool)
    return out[inverse]


STATE, FOUND = -2, -3  # parts of rows that hold a level's candidates, and the repeated windows of level 1, 2, ... (-3, -4, ...)


def _steps(x: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences."""
    return squeeze(np.diff(x, prepend=0).astype(np.int32).tobytes(), 1)


def _unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(unsqueeze(data), np.int32), dtype=np.int64)


def _level(chunk: int, parts: int, starts: np.ndarray, texts: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """The candidates of a level (starts, their texts' numbers and hashes) as a row of state and questions."""
    if not len(starts):
        return []
    first, _, _ = pairs(a, b)
    told_apart = b if len(b) and len(np.unique(a[first])) < len(first) else b[:0]  # the second hashes are kept only where the first do not do
    return [(chunk, STATE, _steps(starts), _steps(texts), a.tobytes() + told_apart.tobytes()), *_ask(chunk, parts, a, b)]


def _batches(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([chunk_batch(rows)] if rows else [], chunk_batch([(0, 0, b"", b"", b"")]).schema)


def removed(docs: DataFrame, length: int = LENGTH, longest: bool = True, parts: int | None = None) -> DataFrame:
    """docs(doc_id, text) → doc_id, text_md5, n_words, n_removed, kept (binary: the words left, joined by one space), spans (array of
    [first, last + 1) of removed words), and longest: the greatest level length of a repeated window (0: none; levels
    beyond the first full one are walked only if longest)."""
    spark = docs.sparkSession
    tune(spark)
    parts = parts or key_parts(spark)

    def first(batches):
        for chunk, _, texts in chunks(batches, LIMIT):
            if rows := _ask(chunk, parts, Chunk(texts, length).sample()[3], np.empty(0, np.uint64)):
                yield chunk_batch(rows)

    def candidates(group: pa.Table) -> pa.Table:
        """Full windows whose sampled half repeats."""
        (_, texts), answers = read_chunk(group)
        chunk = Chunk(texts, length)
        starts, a, least, sampled = chunk.sample()
        good = np.unique(sampled[_told(sampled, np.empty(0, np.uint64), parts, answers)])
        alive = np.flatnonzero(np.isin(least, good, kind="sort"))
        b = chunk.others()[alive] if len(alive) else np.empty(0, np.uint64)
        of = np.searchsorted(chunk.bounds, starts[alive], "right") - 1
        return _batches(_level(group.column("chunk")[0].as_py(), parts, starts[alive], of, a[alive], b))

    def doubled(size, level):
        """The repeated windows of a level (of size words; of the first level where they start, of others the texts that have any),
        and those of twice the size whose halves both repeat. These are named by one hash: both halves are known by two."""

        def run(group: pa.Table) -> pa.Table:
            chunk = group.column("chunk")[0].as_py()
            _, rows = read_chunk(group)
            (_, places, numbers, hashes), answers = next(r for r in rows if r[0] == STATE), [r for r in rows if r[0] >= 0]
            starts, of, hashes = _unsteps(places), _unsteps(numbers), np.frombuffer(hashes, np.uint64)
            a, b = hashes[: len(starts)], hashes[len(starts) :]
            repeated = _told(a, b, parts, answers)
            starts, of, a = starts[repeated], of[repeated], a[repeated]
            out = [(chunk, FOUND - level, _steps(np.unique(of) if level else starts), b"", b"")] if len(starts) else []
            if longest and len(starts):
                other = np.searchsorted(starts, starts + size)
                other[other == len(starts)] = 0
                both = np.flatnonzero((starts[other] == starts + size) & (of[other] == of))
                out += _level(chunk, parts, starts[both], of[both], _joined(a[both], a[other[both]]), np.empty(0, np.uint64))
            return _batches(out)

        return run

    def last(group: pa.Table) -> pa.Table:
        (keys, texts), rows = read_chunk(group)
        try:
            return _kept(keys, Chunk(texts, length), [_unsteps(r[1]) for r in rows[::-1]])  # level 1 first
        finally:
            tidy()

    scratch: list[str] = []  # what only the levels read
    told = stored(docs.select("doc_id", "text").mapInArrow(tidied(first), CHUNK_SCHEMA).groupBy("part").applyInArrow(_answer, CHUNK_SCHEMA), "substr-0", scratch)
    asked = stored(text_chunks(docs, LIMIT).unionByName(told).groupBy("chunk").applyInArrow(candidates, CHUNK_SCHEMA), "substr-1", scratch)
    swept(spark)  # the texts' way to their chunks
    found, level, kept = None, 0, []
    while True:
        told = asked.filter("part >= 0").groupBy("part").applyInArrow(_answer, CHUNK_SCHEMA)
        before, scratch = scratch, []
        asked = stored(asked.filter(F.col("part") == STATE).unionByName(told).groupBy("chunk").applyInArrow(doubled(length << level, level), CHUNK_SCHEMA), f"substr-{level + 2}", scratch)
        dropped(spark, before)
        swept(spark)
        own = stored(asked.filter(F.col("part") <= FOUND), "substr-found", kept)
        found = own if found is None else found.unionByName(own)
        level += 1
        if not longest or asked.filter("part >= 0").isEmpty():
            break
    found = stored(found, "substr-found")
    dropped(spark, scratch + kept)
    schema = "doc_id long, text_md5 string, n_words long, n_removed long, kept binary, spans array<array<int>>, longest int"
    return text_chunks(docs, LIMIT).unionByName(found).groupBy("chunk").applyInArrow(last, schema)


def _kept(keys: pa.Array, chunk: Chunk, found: list[np.ndarray]) -> pa.Table:
    """found: where the repeated windows of the first level start, and the texts that have any of each level beyond."""
    n = len(chunk.starts)
    delta = np.zeros(n + 1, np.int64)
    repeated = found[0] if found else np.empty(0, np.int64)
    delta[: n + 1] += np.bincount(repeated, minlength=n + 1)
    delta -= np.bincount(repeated + chunk.length, minlength=n + 1)
    gone = np.cumsum(delta)[:n] > 0
    # kept words and the byte after each, which is white space or the end of the text; it becomes one space
    data, offsets = chunk.texts.data.copy(), chunk.texts.offsets
    starts, ends = chunk.starts[~gone], chunk.ends[~gone]
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] = 1
    mark[ends] -= 1
    inside = np.cumsum(mark, dtype=np.int8).view(bool)[:-1]
    last = np.zeros(len(data) + 1, bool)
    last[offsets] = True
    after = ends[~last[ends]]
    data[after] = 32
    inside[after] = True
    edges = np.concatenate([[0], np.cumsum(np.add.reduceat(np.append(inside, False).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0))]) if len(offsets) > 1 else np.zeros(1, np.int64)
    out = data[inside]
    kept = [out[a:b].tobytes().removesuffix(b" ") for a, b in zip(edges[:-1], edges[1:], strict=True)]
    words = np.diff(chunk.bounds)
    lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[chunk.bounds])
    longest = np.zeros(len(words), np.int32)
    for k, texts in enumerate(found):
        longest[texts if k else np.searchsorted(chunk.bounds, texts, "right") - 1] = chunk.length << k
    spans = [[] for _ in range(len(words))]
    for d in np.flatnonzero(lost):
        a, b = chunk.bounds[d], chunk.bounds[d + 1]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]])))
        spans[d] = edge.reshape(-1, 2).tolist()
    md5 = [hashlib.md5(chunk.texts.bytes_of(i)).hexdigest() for i in range(len(words))]
    return pa.table({"doc_id": keys, "text_md5": pa.array(md5, pa.string()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))), "longest": pa.array(longest)})


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "longest")

