"""Shared helpers: tables, session settings, written intermediate tables, and chunks of documents.

A *chunk* is a run of documents of one scan partition, packed into one compressed row. Operators that must bring
something from the whole corpus back to each position (token ids, counts, repeat marks) exchange one list per
(chunk, key partition) in place of one row per position. Within a chunk every key stands once, so a key that fills a
third of the corpus is met at most once per chunk: hot keys need no salting.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Arrow batches small enough for long documents; left alone where the user set another size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "256")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where the session has none and runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def write_table(df: DataFrame, label: str, **options: str) -> str:
    """Write to a fresh path of the shared folder, which cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lakeloom/{label}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return path


def stored(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """df written and read again. scratch: gets the path, for dropped() once nothing reads it any more."""
    path = write_table(df, label)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows in the order of keys (nulls first) over range partitions and within them. Equal rows may lie in several partitions, so no value
    fills one. rows must be read from files, whose order is the same when a task is repeated."""
    tie = "spread_tie"
    tied = rows.withColumn(tie, F.xxhash64(F.monotonically_increasing_id()))
    return tied.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie).drop(tie)


def in_order(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """rows spread by keys and written, with a column `at` that ascends in their order: at >> 33 is the partition, the rest the place in it."""
    return stored(spread(rows, keys).withColumn("at", F.monotonically_increasing_id()), label)


def dropped(spark: SparkSession, scratch: list[str]) -> None:
    """Removes written tables that no result reads any more, and forgets them."""
    for path in scratch:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    scratch.clear()


def swept(spark: SparkSession) -> None:
    """Has the driver collect its garbage, after which Spark removes the shuffle files of steps that nothing refers to any more: loops
    would else keep those of every round."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidied(run):
    """A function for mapInArrow that gives the memory it used back to the system when it ends: Python workers serve many tasks."""

    @functools.wraps(run)
    def own(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return own


def tidy() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


class Texts:
    """Texts one after another in one byte buffer: text i is data[offsets[i]:offsets[i + 1]]. Null counts as empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        if column.null_count:
            column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        if not len(column):
            return cls(np.empty(0, np.uint8), np.zeros(1, np.int64))
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()[:3]
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        return cls(whole, at - at[0])

    @classmethod
    def join(cls, parts: list[Texts]) -> Texts:
        ends = np.cumsum([0] + [len(p.data) for p in parts])
        offsets = [p.offsets[:-1] + e for p, e in zip(parts, ends, strict=False)] + [ends[-1:]]
        return cls(np.concatenate([p.data for p in parts]) if parts else np.empty(0, np.uint8), np.concatenate(offsets).astype(np.int64))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        """A-Z lower-cased, all else as it is."""
        capital = (self.data >= 65) & (self.data <= 90)
        return Texts(self.data + (capital.view(np.uint8) << 5), self.offsets)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(texts: Texts, limit: int = 1 << 20) -> Iterator[tuple[int, Texts]]:
    """(number of the first text, texts) in runs of about limit bytes, one text at least: bounds the memory of what is computed
    for all words at once."""
    at = 0
    while at < len(texts):
        cut = max(at + 1, int(np.searchsorted(texts.offsets, texts.offsets[at] + limit, "right")) - 1)
        part = texts.offsets[at : cut + 1]
        yield at, Texts(texts.data[part[0] : part[-1]], part - part[0])
        at = cut


def _ascii_space(data: np.ndarray) -> np.ndarray:
    """Space, tab, line feed, vertical tab, form feed, carriage return."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def split(texts: Texts, space=_ascii_space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the buffer, and where each text's words begin among them (one more than texts)."""
    n = len(texts.data)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~space(texts.data)
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, texts.offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of the public splitmix64 generator)."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


ODD = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def need(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 17)
            cls.up, cls.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (ODD, pow(ODD, -1, 1 << 64)))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end], which depends on nothing else: running sums of values times powers of an
    odd base (mod 2**64). starts must not decrease; long inputs are taken in slices, so memory stays bounded."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, a + (1 << 16))))
        b = int(ends[i:j].max())
        _Powers.need(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[a:b] * _Powers.up[: b - a], dtype=np.uint64, out=total[1:])
        s = starts[i:j] - a
        out[i:j] = (total[ends[i:j] - a] - total[s]) * _Powers.down[s]
        i = j
    return out


def word_hashes(texts: Texts, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each word: every 8 bytes go through a mixing of all bits, so no pattern of bytes cancels out as it
    does in a sum of powers, and words of one length up to 8 bytes never meet. Long words go through the public XXH3. Another salt
    gives an independent hash: two of them name a word among all words of a corpus."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) + np.uint64((salt * ODD + 0x243F6A8885A308D3) & MASK64))
    if not len(starts):
        return out
    data = texts.data
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # the 8 bytes from each place on
    at = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    start, left = starts[at], lengths[at]
    while len(at):
        block = eight[start]
        short = left < 8
        block[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[at] = mix(out[at] ^ block)
        more = left > 8
        at, start, left = at[more], start[more] + 8, left[more] - 8
    far = np.flatnonzero(lengths > LONG)
    if len(far):
        import xxhash

        out[far] = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b].tobytes(), seed=salt) for a, b in zip(starts[far], ends[far], strict=True)), np.uint64, len(far))
    return out


LONG = 256


def distinct(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[Texts, np.ndarray]:
    """The distinct words by their bytes, in order of first appearance, and for each word the number of its distinct one."""
    n, data = len(texts.data), texts.data
    if int((ends - starts).sum()) < n:  # else words fill the buffer, and may be empty
        edge = np.zeros(n + 1, np.int8)
        edge[starts] = 1
        edge[ends] -= 1
        data = data[np.cumsum(edge[:n], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return Texts.of(found.dictionary), found.indices.to_numpy().astype(np.int64)


def pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, inverse, counts) of the distinct pairs (a, b); b may be empty: of a alone."""
    _, first, inverse, counts = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
    if len(b) and (b != b[first][inverse]).any():
        _, first, inverse, counts = np.unique(np.stack([a, b], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse.ravel(), counts


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pair (a, b); order counts."""
    return mix(a * np.uint64(ODD) ^ ((b << np.uint64(29)) | (b >> np.uint64(35))))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on (fewer places than hashes by n - 1), joined by doubling: 1, 2, 4, ... and what is left."""
    have, size, out, done = hashes, 1, None, 0
    while True:
        if n & size:
            if out is None:
                out, done = have, size
            else:
                k = len(hashes) - done - size + 1
                out, done = _joined(out[:k], have[done : done + k]) if k > 0 else hashes[:0], done + size
        if 2 * size > n:
            return out
        k = len(hashes) - 2 * size + 1
        have = _joined(have[:k], have[size : size + k]) if k > 0 else hashes[:0]
        size *= 2


def windows(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (among all words) and hashes of the windows of n consecutive words that lie within one text."""
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.flatnonzero(np.arange(len(hashes)) + n <= ends)
    return starts, runs(hashes, n)[starts]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, one span after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return first + np.arange(total)


def squeeze(data: bytes, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array, Texts]]:
    """(chunk id, keys, texts) from batches of (key, text). Ids come from the scan partition and the order in it, so a
    partition that is computed again gets the same ones. Chunks end at documents, about every limit bytes."""
    base, n, size = partition_id() << 32, 0, 0
    keys: list[pa.Array] = []
    texts: list[Texts] = []
    for batch in batches:
        at = 0
        own = Texts.of(batch.column(1))
        while at < batch.num_rows:
            cut = int(np.searchsorted(own.offsets, own.offsets[at] + limit - size, "right"))
            cut = min(max(cut, at + 1), batch.num_rows)
            keys.append(batch.column(0).slice(at, cut - at))
            part = own.offsets[at : cut + 1]
            texts.append(Texts(own.data[part[0] : part[-1]], part - part[0]))
            size += int(part[-1] - part[0]) + 16 * (cut - at)
            at = cut
            if size >= limit:
                yield base + n, pa.concat_arrays(keys), Texts.join(texts)
                n, size, keys, texts = n + 1, 0, [], []
    if keys:
        yield base + n, pa.concat_arrays(keys), Texts.join(texts)


def pack_texts(keys: pa.Array, texts: Texts, level: int = 3) -> list[bytes]:
    """[keys with a mask of nulls, lengths, compressed bytes]."""
    mask = np.asarray(keys.is_null())
    return [np.asarray(keys.fill_null(0), dtype=np.int64).tobytes() + mask.astype(np.uint8).tobytes(), np.diff(texts.offsets).astype(np.int64).tobytes(), squeeze(texts.data.tobytes(), level)]


def unpack_texts(keys: bytes, lengths: bytes, data: bytes) -> tuple[pa.Array, Texts]:
    n = len(lengths) // 8
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int64))]).astype(np.int64)
    ids = pa.array(np.frombuffer(keys, np.int64, n), mask=np.frombuffer(keys, np.uint8, n, 8 * n).astype(bool))
    return ids, Texts(np.frombuffer(unsqueeze(data), np.uint8), offsets)


CHUNK_SCHEMA = "chunk long, part int, keys binary, lengths binary, data binary"


def chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of CHUNK_SCHEMA."""
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["chunk", "part", "keys", "lengths", "data"])


def text_chunks(docs: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """The documents' keys and texts as rows of CHUNK_SCHEMA, part -1: one row for each chunk."""

    def run(batches):
        for chunk, keys, texts in chunks(batches, limit):
            yield chunk_batch([(chunk, -1, *pack_texts(keys, texts))])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), CHUNK_SCHEMA)


def key_parts(spark: SparkSession) -> int:
    """Key partitions of the exchange between chunks and keys: as many as shuffle partitions, 32 at least."""
    return max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices of its members), for the parts that have any."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            yield p, order[cuts[p] : cuts[p + 1]]


def read_chunk(table: pa.Table) -> tuple[tuple[pa.Array, Texts] | None, list[tuple[int, bytes, bytes, bytes]]]:
    """The texts of a chunk's rows, and the rest of the rows by part."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "keys", "lengths", "data")), strict=True), key=lambda r: r[0])
    own = [r for r in rows if r[0] == -1]
    return (unpack_texts(*own[0][1:]) if own else None), [r for r in rows if r[0] != -1]
