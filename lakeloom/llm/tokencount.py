"""Token counts from flat token files without an index, by a scan for separators.

A flat file is a sequence of ids, documents one after another, each followed by the end id; nothing else tells where a
document ends. Files are written as fixed-size blocks (file, block, ids as little-endian unsigned 16-bit), so blocks of one
file are scanned by many tasks: each searches its ids for the separator in one vectorised comparison and reports the length
before the first separator, the lengths between separators, and what is left behind the last. A prefix scan over the blocks
of a file joins what is left to the first length of a later block.

Null and empty texts count 0 ids. Ids that would equal the end id cannot occur in a document (special tokens in texts are
encoded as ordinary text). Repeated rows count once each. An empty table gives an empty result; further columns are not read, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm._common import chunks, partition_id, stored, tidied, tune
from lakeloom.llm.wordbpe import word_ids

BLOCK, SLICE = 1 << 18, 4 << 20  # ids in a block, bytes of text that are encoded at once
END = 49407


def write_flat(docs: DataFrame, tokenizer: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) → the written flat files (file, block, ids) and, beside them, the documents in order (file, block,
    doc_ids: those that begin in the block). A file is a partition of docs."""
    tune(docs.sparkSession)

    def run(batches):
        file, number = partition_id(), 0
        ids, keys, size = [], [], 0

        def rows(last: bool):
            nonlocal number, ids, keys, size
            whole = np.concatenate(ids) if ids else np.empty(0, np.uint16)
            upto = len(whole) if last else len(whole) // block * block
            for a in range(0, upto, block):
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([whole[a : a + block].astype("<u2").tobytes()], pa.binary()), pa.array([keys], pa.list_(pa.int64()))], ["file", "block", "ids", "doc_ids"])
                number, keys = number + 1, []
            ids, size = [whole[upto:]], len(whole) - upto

        for _, own, texts in chunks(batches, SLICE):
            flat, bounds = word_ids(tokenizer, ordinary=True)(texts)
            ids.append(np.insert(flat, bounds[1:], end).astype(np.uint16))
            keys += own.to_pylist()
            size += len(ids[-1])
            if size >= block:
                yield from rows(False)
        yield from rows(True)

    return stored(docs.select("doc_id", "text").mapInArrow(tidied(run), "file int, block int, ids binary, doc_ids array<long>"), "flat")


def scan(files: DataFrame, end: int = END) -> DataFrame:
    """files(file, block, ids) → file, document (from 0), n_tokens (without the end id)."""

    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                ids = np.frombuffer(data, "<u2")
                at = np.flatnonzero(ids == end)
                lengths = np.diff(np.concatenate([[-1], at])) - 1
                out.append((len(ids), len(at), len(ids) - int(at[-1]) - 1 if len(at) else len(ids), lengths.astype(np.int64).tolist()))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True))], ["file", "block", "n", "ends", "rest", "lengths"])

    blocks = files.select("file", "block", "ids").mapInArrow(tidied(run), "file int, block int, n long, ends long, rest long, lengths array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    # ids behind the last separator before this block = ids so far, less ids up to that separator
    placed = blocks.withColumns({"base": zero(F.sum("n").over(before)), "first": zero(F.sum("ends").over(before))})
    ended = F.when(F.col("ends") > 0, F.col("base") + F.col("n") - F.col("rest"))
    placed = placed.withColumn("carried", F.col("base") - zero(F.max(ended).over(before)))
    each = placed.filter("ends > 0").select("file", "first", "carried", F.posexplode("lengths").alias("k", "length"))
    own = F.when(F.col("k") == 0, F.col("length") + F.col("carried")).otherwise(F.col("length"))
    return each.select("file", (F.col("first") + F.col("k")).alias("document"), own.alias("n_tokens"))


def named(counts: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, file, document, n_tokens: counts joined with the order of documents kept beside the files."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    order = files.select("file", "block", "doc_ids").withColumn("first", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)))
    keys = order.select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("document"), "doc_id")
    return counts.join(keys, ["file", "document"]).select("doc_id", "file", "document", "n_tokens")
