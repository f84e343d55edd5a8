"""Document fingerprints: SimHash over weighted terms, and the search for near fingerprints in permuted block tables.

Terms are pairs of neighbouring words (A-Z lower-cased; the word itself where a text has one word), weighted 1 + ln(count).
Each term's 64-bit hash votes with its weight on every bit; a bit of the fingerprint is 1 where the sum is above 0. The
likeness of two fingerprints is 1 - distance / 64.

The search cuts fingerprints into BLOCKS blocks. Two fingerprints within `radius` bits agree in all but radius blocks, so a
table for each choice of BLOCKS - radius blocks, keyed by their bits, holds them under one key; a pair counts in the first
table that holds it. Equal fingerprints are joined to one before. A text without words (null, empty) has fingerprint 0. Rows of one doc_id
follow each other by a hash of their texts; a table of one row has itself as next; an empty one gives an empty result; further columns
are not read, whatever their names. RADIUS 3 of
64 stands for copies with a few changed words: by the angle between term vectors, texts of five-word shingle similarity 0.95 differ
by about 3 bits, those of 0.8 by about 6.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm._common import Texts, dropped, mix, partition_id, runs, slices, split, stored, tidied, tune, word_hashes

RADIUS, BLOCKS = 3, 6


def fingerprints(texts: Texts) -> np.ndarray:
    """The fingerprint of each text (unsigned 64-bit)."""
    parts = [_fingerprints(part.lower()) for _, part in slices(texts)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _fingerprints(texts: Texts) -> np.ndarray:
    starts, ends, bounds = split(texts)
    words = word_hashes(texts, starts, ends)
    out = np.zeros(len(texts), np.uint64)
    for d in range(len(texts)):
        own = words[bounds[d] : bounds[d + 1]]
        if len(own):
            terms = runs(own, 2) if len(own) > 1 else mix(own)
            terms, counts = np.unique(terms, return_counts=True)
            weights = (1 + np.log(counts)).astype(np.float32)
            votes = np.zeros(64, np.float32)
            for a in range(0, len(terms), 4096):  # long texts in slices
                bits = np.unpackbits(terms[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                votes += weights[a : a + 4096] @ bits.astype(np.float32)
            out[d] = np.packbits(votes * 2 > weights.sum(), bitorder="little").view(np.uint64)[0]
    return out


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


FIRST, LAST = 1, 2  # kinds of rows that meet those of another partition; 0: whole rows
_ORDERED = "part int, kind int, doc_id long, n_chars long, edited_sha256 string, fingerprint long, edited_fingerprint long, next_fingerprint long, text string"


def in_order(docs: DataFrame) -> DataFrame:
    """_ORDERED rows of docs(doc_id, text) in range partitions by (doc_id, nulls first; hash of the text; place in the scan), so equal
    doc_ids and equal rows are split too. Within a partition each row meets the next as they stream by; only a partition's
    first and last rows keep their texts, as rows of kinds FIRST and LAST."""
    text = F.coalesce("text", F.lit(""))
    keys = ["doc_id", "tie", "place"]
    ranged = docs.select("doc_id", F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("place"), text.alias("text")).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def row(part, kind, ids, lengths, sha, prints, changed, after, texts):
        n = len(ids)
        longs = lambda x: pa.array(x, pa.int64()) if x is not None else pa.nulls(n, pa.int64())
        text = pa.array(texts, pa.string()) if texts is not None else pa.nulls(n, pa.string())
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.int32()), longs(ids), longs(lengths), pa.array(sha, pa.string()) if sha is not None else pa.nulls(n, pa.string()), longs(prints), longs(changed), longs(after), text], [c.split()[0] for c in _ORDERED.split(", ")])

    def run(batches):
        part, last = partition_id(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            prints = fingerprints(Texts.of(batch.column(1))).view(np.int64).tolist()
            if last is None:
                yield row(part, FIRST, ids[:1], None, None, prints[:1], None, None, texts[:1])
            else:
                ids, texts, prints = [last[0], *ids], [last[1], *texts], [last[2], *prints]
            last = ids[-1], texts[-1], prints[-1]
            if len(ids) > 1:
                changed = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for t, after in zip(texts[:-1], texts[1:], strict=True)]
                own = fingerprints(Texts.of(pa.array(changed, pa.string()))).view(np.int64).tolist()
                yield row(part, 0, ids[:-1], [len(t) for t in texts[:-1]], [hashlib.sha256(x.encode()).hexdigest() for x in changed], prints[:-1], own, prints[1:], None)
        if last is not None:
            yield row(part, LAST, [last[0]], [len(last[1])], None, [last[2]], None, None, [last[1]])

    return ranged.select("doc_id", "text").mapInArrow(tidied(run), _ORDERED)


def following(parts: DataFrame) -> DataFrame:
    """parts(part), one row for each partition that has rows → part, following: the next one, after the last the first."""
    line = Window.orderBy("part")  # rows are partitions, not documents
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return parts.select("part", F.coalesce(F.lead("part").over(line), F.min("part").over(whole)).alias("following"))


def edited(docs: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint of docs(doc_id, text; null: empty): the edited text
    is the text whose last floor(n_chars / 4) code points gave way to the first as many of the next document's."""
    rows = stored(in_order(docs), "ordered", scratch)
    firsts = rows.filter(F.col("kind") == FIRST).select(F.col("part").alias("following"), F.col("fingerprint").alias("after"), F.col("text").alias("first_text"))
    links = following(rows.filter(F.col("kind") == FIRST).select("part"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    text = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("first_text", F.lit(1), quarter))
    ends = rows.filter(F.col("kind") == LAST).join(links, "part").join(firsts, "following").select("doc_id", "n_chars", "fingerprint", "after", text.alias("edited"))

    def run(batches):
        for batch in batches:
            changed = Texts.of(batch.column(4))
            sha = [hashlib.sha256(changed.bytes_of(i)).hexdigest() for i in range(len(changed))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sha, pa.string()), batch.column(2), pa.array(fingerprints(changed).view(np.int64)), batch.column(3)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint long, edited_fingerprint long, next_fingerprint long"
    return rows.filter("kind = 0").select(names).unionByName(ends.mapInArrow(tidied(run), schema))


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) → doc_id, fingerprint (long, the 64 bits)."""
    tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(Texts.of(batch.column(1))).view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, fingerprint long")


def near(queries: DataFrame, every: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """queries(fingerprint), every(fingerprint) → fingerprint, n_near: for each distinct query the rows of every within radius
    bits. More blocks make longer keys for larger tables: expected chance candidates are C(blocks, radius) * |queries| *
    |every| / 2**(64 * (1 - radius / blocks))."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tables = [signed(sum(masks[b] for b in kept)) for kept in combinations(range(blocks), blocks - radius)]
    keys = F.array(*(F.col("fingerprint").bitwiseAND(F.lit(m)) for m in tables))
    left = queries.select("fingerprint").distinct().select("fingerprint", F.posexplode(keys).alias("t", "key"))
    right = every.groupBy(F.col("fingerprint")).agg(F.count("*").alias("n")).select(F.col("fingerprint").alias("other"), "n", F.posexplode(keys).alias("t", "key"))
    differ = F.col("fingerprint").bitwiseXOR(F.col("other"))
    first = F.lit(True)
    for k, m in enumerate(tables):  # no table before t holds the pair
        first = first & ((F.col("t") <= k) | (differ.bitwiseAND(F.lit(m)) != 0))
    pairs = left.hint("merge").join(right, (left["t"] == right["t"]) & (left["key"] == right["key"])).select(left["fingerprint"], "other", "n", left["t"])
    return pairs.filter((F.bit_count(differ) <= radius) & first).groupBy("fingerprint").agg(F.sum("n").alias("n_near"))


def document_fingerprints(docs: DataFrame, every: int = 50) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (16 hex digits), near_edited, near_next, and n_near:
    for documents whose doc_id `every` divides the other documents within RADIUS bits, for the rest null."""
    tune(docs.sparkSession)
    scratch: list[str] = []
    marked = stored(edited(docs, scratch), "fingerprints")
    dropped(docs.sparkSession, scratch)
    query = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    found = near(marked.filter(query).select("fingerprint"), marked.select("fingerprint"))
    asked = marked.filter(query).hint("merge").join(found, "fingerprint").withColumn("n_near", F.col("n_near") - 1)
    joined = marked.filter(~query).withColumn("n_near", F.lit(None).cast("long")).unionByName(asked)
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    own, changed, after = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return joined.select("doc_id", "n_chars", "edited_sha256", hexed(own).alias("fingerprint"), hexed(changed).alias("edited_fingerprint"), likeness(own, changed).alias("near_edited"), likeness(own, after).alias("near_next"), "n_near")
