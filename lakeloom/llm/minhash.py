"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

1. Every document gives its set's size, a 128-bit hash of the whole set and a signature: one hash per shingle, the least
   of each of 150 bins, empty bins filled from full ones along a random probe sequence of their own. Documents of equal
   shingles (repeated ones counted) become one class, represented by its least doc_id, so exact copies add no candidates.
2. 30 bands of 5 bins bucket the classes. In each bucket edges go from one centre to the others (a star), so a bucket of
   m classes gives m - 1 candidates; the first round takes the least id as centre, further rounds other members.
3. Candidates are confirmed on full sets (100 * intersection >= 80 * union for a similarity of 0.8), and the confirmed ones
   are joined to components by alternating large and small stars. Rounds of stars go on over the buckets that still hold
   more than one component, until comparing what is left there is cheap (or rounds stop helping); then every pair of such
   a bucket whose classes lie in different components is compared by signature and by a sketch of its set, in blocks, and
   those within SIGMAS standard deviations of the similarity are confirmed. Links within a component are not listed.

Two sets of similarity 0.8 share no bucket with probability 7e-6; one pair of a bucket that is compared in blocks is refused by
signature with 2e-8 or by sketch with 7e-9 (binomial tails for large sets), which loses a link only if no other path joins the
two classes. Texts with fewer words than a shingle are one shingle;
texts without words (null, empty) are linked with nothing. Rows without doc_id are linked with nothing and kept
(component_id null). Repeated rows get the same answer each; texts of different rows with one doc_id that represents them
count as one document, linked by any of them. An empty table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._common import Texts, dropped, key_parts, mix, runs, slices, split, stored, tidied, tune, windows, word_hashes

BINS, BAND = 150, 5
SIMILARITY = 80  # per cent
BLOCK = 1024
HOT, SALTS = 1000, 64
SKETCH = 512
SIGMAS = 6  # how far below the similarity signatures and sketches of a pair may be found
_PROBES = np.random.default_rng(7).integers(0, BINS, (2048, BINS))


def shingles(texts: Texts, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [s for _, part in slices(texts) for s in _shingles(part.lower(), n)]


def _shingles(texts: Texts, n: int) -> list[np.ndarray]:
    starts, ends, bounds = split(texts)
    hashes = word_hashes(texts, starts, ends)
    at, found = windows(hashes, bounds, n)
    cuts, words, out = np.searchsorted(at, bounds), np.diff(bounds), []
    for d in range(len(texts)):
        if 0 < words[d] < n:
            out.append(mix(runs(hashes[bounds[d] : bounds[d + 1]], int(words[d])) + np.uint64(words[d])))
        else:
            out.append(np.unique(found[cuts[d] : cuts[d + 1]]))
    return out


def _second(texts: Texts, n: int) -> list[int]:
    """A sum over each text's shingles of a hash of their words' second hashes."""
    starts, ends, bounds = split(texts)
    hashes = word_hashes(texts, starts, ends, 1)
    at, found = windows(hashes, bounds, n)
    cuts, total, own = np.searchsorted(at, bounds), np.concatenate([[np.uint64(0)], np.cumsum(mix(found), dtype=np.uint64)]), np.diff(bounds)
    sums = (total[cuts[1:]] - total[cuts[:-1]]).tolist()
    for d in np.flatnonzero((own > 0) & (own < n)):
        sums[d] = int(runs(hashes[bounds[d] : bounds[d + 1]], int(own[d]))[0])
    return sums


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """16 bits of the least hash of each bin, empty bins densified."""
    bins, first = np.unique(shingle_set % np.uint64(BINS), return_index=True)
    full = np.zeros(BINS, bool)
    full[bins.astype(np.int64)] = True
    out = np.zeros(BINS, np.uint16)
    out[full] = (mix(shingle_set[first]) & np.uint64(0xFFFF)).astype(np.uint16)
    empty = np.flatnonzero(~full)
    for probe in _PROBES:
        if not len(empty):
            return out
        source = probe[empty]
        hit = full[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    out[empty] = out[np.flatnonzero(full)[0]]
    return out


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """docs(doc_id, text) → doc_id, n_shingles, set_a, set_b (128-bit hash of the set's shingles, the second half counting repeated ones
    and made from a second hash of the words), signature."""

    def run(batches):
        for batch in batches:
            texts = Texts.of(batch.column(1))
            sets = shingles(texts, n)
            sums = [[int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets], [x for _, part in slices(texts) for x in _second(part.lower(), n)]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in sums), pa.array([signature(s).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "set_a", "set_b", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def confirm(pairs: DataFrame, texts: DataFrame, n: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. texts: id, text of all that occur."""

    def run(batches):
        for batch in batches:
            left, right = (shingles(Texts.of(batch.column(c)), n) for c in (2, 3))
            good = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= per_cent * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    own = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(other, "b").join(own, "a").select("a", "b", "text_a", "text_b").mapInArrow(tidied(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) → node, component (the least node reachable), for nodes with edges. Large and small stars alternate, each
    round a written table, until nothing changes: rounds grow with the logarithm of the graph's diameter."""
    last: list[str] = []
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", last)
    state = None
    while True:
        before, last = last, []
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(edges.join(least, "a").filter("b = m").select("a", "b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(small, "edges", last)
        dropped(edges.sparkSession, before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now


def sketches(texts: DataFrame, n: int) -> DataFrame:
    """id, sketch: the upper halves of the SKETCH least hashes of each text's set; a set that small is held whole."""

    def run(batches):
        for batch in batches:
            least = [(s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for s in shingles(Texts.of(batch.column(1)), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.binary())], ["id", "sketch"])

    return texts.select("id", "text").mapInArrow(tidied(run), "id long, sketch binary")


def _alike(x: np.ndarray, y: np.ndarray) -> float:
    """The share of the least SKETCH hashes of the union of two sets that both hold."""
    union = np.union1d(x, y)[:SKETCH]
    both = np.intersect1d(x, y)
    return np.searchsorted(both, union[-1], "right") / len(union)


def _unsure(buckets: DataFrame, per_cent: int, parts: int) -> DataFrame:
    """Pairs of different components of a bucket that may reach the similarity by size, signature and sketch, each of them
    given by the first bucket it shares. Buckets are compared in blocks of BLOCK classes against BLOCK."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        band = key[0].as_py()
        cols = {c: group.column(c).to_numpy() for c in ("id", "component", "n_shingles", "block")}
        sig = np.stack([np.frombuffer(s, np.uint16) for s in group.column("signature").to_pylist()])
        low, high = key[2].as_py(), key[3].as_py()
        left, right = np.flatnonzero(cols["block"] == low), np.flatnonzero(cols["block"] == high)
        bands = sig.reshape(len(sig), -1, BAND)
        sketch = [np.unique(np.frombuffer(x, np.uint32)) for x in group.column("sketch").to_pylist()]
        out = []
        for i in left:
            j = right[right > i] if low == high else right
            j = j[cols["component"][j] != cols["component"][i]]
            less, more = np.minimum(cols["n_shingles"][j], cols["n_shingles"][i]), np.maximum(cols["n_shingles"][j], cols["n_shingles"][i])
            j, less = j[100 * less >= per_cent * more], less[100 * less >= per_cent * more]
            if len(j):
                s = per_cent / 100
                slack = np.maximum(0.12, SIGMAS * np.sqrt(s * (1 - s) / np.minimum(BINS, less)))
                likely = (sig[j] == sig[i]).mean(1) >= s - slack
                first = (bands[j] == bands[i]).all(2).argmax(1) == band
                for k in j[likely & first]:
                    whole = max(cols["n_shingles"][i], cols["n_shingles"][k]) <= SKETCH
                    if _alike(sketch[i], sketch[k]) >= s - (0.01 if whole else SIGMAS * np.sqrt(s * (1 - s) / SKETCH)):
                        out.append((cols["id"][i], cols["id"][k]))
        a = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": np.minimum(a[:, 0], a[:, 1]), "b": np.maximum(a[:, 0], a[:, 1])})

    size = buckets.groupBy("band", "key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = buckets.join(size, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    return pairs.repartition(parts, "band", "key", "low", "high").groupBy("band", "key", "low", "high").applyInArrow(run, "a long, b long")


def starred(active: DataFrame, order, scratch: list[str]) -> DataFrame:
    """active(band, key, id, component) → a, b: an edge from each bucket's centre (the first by order) to every member of another component.
    Buckets that hold a share of 1 / HOT of all rows or more, HOT at most, are dealt out to SALTS tasks each, with the centre copied."""
    centres = active.groupBy("band", "key").agg(F.min_by(F.struct("id", "component"), order).alias("centre"), F.count("*").alias("n"))
    centres = stored(centres, "centres", scratch)
    least = (centres.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = centres.filter((F.col("n") >= least) & (F.col("n") > SALTS)).select("band", "key", F.lit(SALTS).alias("salts"))  # HOT rows at most
    salts = F.coalesce("salts", F.lit(1))
    dealt = active.join(F.broadcast(hot), ["band", "key"], "left").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(2)), salts)).drop("salts")
    copied = centres.join(F.broadcast(hot), ["band", "key"], "left").select("band", "key", "centre", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)).alias("salt"))
    star = dealt.join(copied, ["band", "key", "salt"]).filter("component <> centre.component")
    return star.select(F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, per_cent: int = SIMILARITY, cheap: int = 20_000_000) -> DataFrame:
    """docs(doc_id, text) → doc_id, n_shingles, component_id, kept. cheap: comparisons of signatures for which no further
    round of stars is run first; it decides on the way only, not on the result."""
    spark: SparkSession = docs.sparkSession
    tune(spark)
    scratch: list[str] = []  # what only the search reads
    held = functools.partial(stored, scratch=scratch)
    signed = stored(signatures(docs, n), "signatures")
    real = signed.filter("doc_id is not null and n_shingles > 0")
    classes = real.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature"))
    classes = held(classes, "classes")
    width = 2 * BAND
    keys = F.array(*(F.xxhash64(F.substring("signature", 1 + k * width, width)) for k in range(BINS // BAND)))
    rows = classes.select("id", F.posexplode(keys).alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    buckets = held(rows.join(shared, ["band", "key"]), "buckets")
    named = docs.select(F.col("doc_id").alias("id"), "text")
    # rows of one doc_id may differ in text: each text once
    texts = named.join(buckets.select("id").distinct(), "id", "left_semi").groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).drop("h")
    texts = held(texts, "texts")
    labels, links, round_ = None, None, 0
    before = None
    while True:
        if labels is None:
            active = buckets.withColumn("component", F.col("id"))
        else:
            own = buckets.join(labels, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id")).drop("node")
            mixed = own.groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("band", "key")
            active = held(own.join(mixed, ["band", "key"]), "active")
            per = active.groupBy("band", "key", "component").agg(F.count("*").alias("c")).groupBy("band", "key").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("work"))
            work = per.agg(F.sum("work")).first()[0] or 0
            if not work:
                break
            if work <= 2 * cheap or (before is not None and work > 0.9 * before):
                unsure = active.join(classes.select("id", "n_shingles", "signature"), "id")
                own = texts.join(active.select("id").distinct(), "id", "left_semi")
                unsure = unsure.join(sketches(own, n), "id")
                pairs = _unsure(unsure, per_cent, key_parts(spark))
                links = links.unionByName(held(confirm(held(pairs, "pairs"), texts, n, per_cent), "links"))
                labels = held(components(links), "labels")
                break
            before = work
        order = F.col("id") if labels is None else F.xxhash64("id", "band", F.lit(round_))
        found = held(confirm(starred(active, order, scratch), texts, n, per_cent), "links")
        links = found if links is None else links.unionByName(found)
        labels = held(components(links), "labels")
        round_ += 1
    of_class = classes.select("set_a", "set_b", "id").join(labels, F.col("id") == F.col("node"), "left").select("set_a", "set_b", F.coalesce("component", "id").alias("class_component"))
    of_class = stored(of_class, "components")
    dropped(spark, scratch)
    linked = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("class_component"))
    out = signed.drop("signature").join(of_class, ["set_a", "set_b"], "left").withColumn("component_id", linked)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

