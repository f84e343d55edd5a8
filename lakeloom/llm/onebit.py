"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes with error bounds, and exact reranking.

A vector is its centroid plus a residual. The residual's direction o is turned by a random rotation and kept as one sign a dimension, with two
correction scalars: the residual's length and f, the inner product of o with the unit vector of its signs. For a query q, turned
alike, <signs, q> / (f sqrt(D)) estimates <o, q>; the estimate's error is that of a random direction at right angles to o, so it stays
under EPSILON |q| sqrt(1 - f^2) / (f sqrt(D - 1)) but with a probability of about 0.003 at EPSILON 3. Only vectors whose upper bound
reaches the k-th best of lower bounds and of exact products found so far are reranked, by the exact product in double precision.

The index holds every vector. Centroids come from k-means on a sample of about SAMPLE vectors (all there are, if fewer; rows whose hash of vec_id and
vector falls under a rate), rows are encoded where they are read and packed into blocks of at most BLOCK vectors. Searches take a stated set of
queries against all blocks: groups of about GROUP queries meet slices of the blocks, one (group, slice) a task at a time, which streams
through its blocks and holds k results a query. Work is queries times vectors, in codes; nothing is collected but the sample.

Vectors that are null, zero, or hold nulls, NaN or infinities, and rows without vec_id, take no part. A query meets vectors of its own length
alone, and no row of its own vec_id. Equal rows among queries count once, among candidates each counts; of candidates that are equal bit for
bit, only the k + 1 of the least vec_id are kept by a task, for no query has room for more. Ties go to the smaller vec_id. An empty table gives
an empty result; further columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm._common import stored, tidied, tune

SAMPLE, CENTROIDS, ROUNDS, SEED = 20_000, 64, 8, 20
BLOCK, GROUP, SLICE, SLICES, MOST_PARTS = 512, 1024, 1 << 18, 8, 20_000
EPSILON = 3.0
PAIRS = 1 << 16


def sound(vector: str = "embedding") -> Column:
    """Whether a vector takes part in searches."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, dims, v: the vectors that take part, in the precision they are stored in; products are taken in double precision."""
    v = F.col("embedding")
    return table.filter(sound() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(v).alias("dims"), v.alias("v"))


def rotation(dims: int) -> np.ndarray:
    """A random rotation, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """k-means by Lloyd's rounds; a centroid for 64 sampled vectors at most."""
    k = max(1, min(k, len(sample) // 64))
    centres = sample[np.random.default_rng(SEED).choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = nearest(sample, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def fitted(all_vectors: DataFrame) -> dict[int, np.ndarray]:
    """Centroids of each number of dimensions, from a sample of about SAMPLE vectors of all."""
    n = all_vectors.count()
    rate = 1 << 20
    share = min(rate, rate * SAMPLE // max(n, 1))
    rows = all_vectors.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(rate)) < share).select("dims", "v").limit(2 * SAMPLE).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.dims, []).append(r.v)
    return {dims: centroids(np.array(v, np.float64)) for dims, v in by.items()}


class Codes:
    """A block of encoded vectors: ids, cell, packed signs, correction scalars, and the vectors themselves for reranking."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, cell: np.ndarray, bits: np.ndarray, length: np.ndarray, f: np.ndarray):
        self.ids, self.v, self.cell, self.bits, self.length, self.f = ids, v, cell, bits, length, f

    @classmethod
    def of(cls, ids: np.ndarray, v: np.ndarray, centres: np.ndarray) -> Codes:
        dims = v.shape[1]
        cell = nearest(v.astype(np.float64), centres)
        residual = v - centres[cell]
        length = np.sqrt((residual**2).sum(1))
        turned = (residual / np.where(length > 0, length, 1)[:, None]) @ rotation(dims).T
        f = np.abs(turned).sum(1) / np.sqrt(dims)
        return cls(ids, v, cell.astype(np.int32), np.packbits(turned > 0, axis=1), length.astype(np.float32), np.where(f > 0, f, 1).astype(np.float32))

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(x).tobytes() for x in (self.ids, self.v, self.cell, self.bits, self.length, self.f)]

    @classmethod
    def unpacked(cls, dims: int, ids: bytes, v: bytes, cell: bytes, bits: bytes, length: bytes, f: bytes) -> Codes:
        n = len(ids) // 8
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(v, f"f{len(v) // (n * dims)}").reshape(n, dims), np.frombuffer(cell, np.int32), np.frombuffer(bits, np.uint8).reshape(n, -1), np.frombuffer(length, np.float32), np.frombuffer(f, np.float32))


CODES = "dims int, block int, ids binary, v binary, cell binary, bits binary, length binary, f binary"


def index(all_vectors: DataFrame, fit: dict[int, np.ndarray], k: int = 20) -> DataFrame:
    """Every vector in blocks of codes (see the module's note on equal ones)."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        number = 0

        def block(dims: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, v = np.concatenate(held[dims][0]), np.concatenate(held[dims][1])
            held[dims] = ([], [])
            few = _few(ids, v, k + 1)
            codes = Codes.of(ids[few], v[few], fit[dims] if dims in fit else np.zeros((1, dims)))
            return pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int32()), "block": pa.array([number], pa.int32())} | {name: pa.array([x], pa.binary()) for name, x in zip(("ids", "v", "cell", "bits", "length", "f"), codes.packed(), strict=True)})

        for batch in batches:
            of = batch.column("dims").to_numpy(zero_copy_only=False)
            for dims in np.unique(of):
                own = batch.filter(pa.array(of == dims))
                ids, v = held.setdefault(int(dims), ([], []))
                ids.append(own.column("vec_id").to_numpy(zero_copy_only=False))
                v.append(own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                if sum(map(len, ids)) >= BLOCK:
                    yield block(int(dims))
        for dims in [d for d, (ids, _) in held.items() if ids]:
            yield block(dims)

    return all_vectors.mapInArrow(tidied(run), CODES)


def _few(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows but for those whose vector k rows of smaller id have."""
    _, kind = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((ids, kind))
    new = np.flatnonzero(np.diff(kind[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    return order[rank < k]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, each summed from the first component to the last."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d].astype(np.float64) * b[:, d]
    return out


class Search:
    """k best of what a group of queries has met so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, centres: np.ndarray, k: int):
        queries = queries.astype(np.float64)
        self.ids, self.q, self.k = ids, queries, k
        n, dims = queries.shape
        self.turned = (queries @ rotation(dims).T).astype(np.float32)
        self.centred = (queries @ centres.T).astype(np.float32)
        self.reach = (np.sqrt((queries**2).sum(1)) * EPSILON / np.sqrt(max(dims - 1, 1))).astype(np.float32)
        self.slack = np.float32(1e-5) * np.sqrt((queries**2).sum(1)).astype(np.float32)  # of single precision
        self.score = np.full((n, k), -np.inf)
        self.best = np.full((n, k), np.iinfo(np.int64).max)
        self.reranked = 0

    def meet(self, codes: Codes) -> None:
        n, dims = codes.v.shape
        for a in range(0, len(self.ids), 256):  # bounds the memory of a block's estimates
            self._meet(codes, slice(a, a + 256), n, dims)

    def _meet(self, codes: Codes, part: slice, n: int, dims: int) -> None:
        signs = np.unpackbits(codes.bits, axis=1, count=dims).astype(np.float32) * 2 - 1
        scale = codes.length / codes.f / np.sqrt(np.float32(dims))
        middle = self.centred[part][:, codes.cell] + (self.turned[part] @ signs.T) * scale
        width = self.reach[part, None] * (codes.length * np.sqrt(np.maximum(0, 1 - codes.f**2)) / codes.f) + self.slack[part, None] * (1 + codes.length)
        own = self.ids[part, None] == codes.ids
        low = np.where(own, -np.inf, middle - width)
        floor = self.score[part, -1]
        if n > self.k:
            floor = np.maximum(floor, -np.partition(-low, self.k - 1, axis=1)[:, self.k - 1])
        rows, cols = np.nonzero((middle + width >= floor[:, None]) & ~own)
        self.reranked += len(rows)
        exact = np.empty(len(rows))
        q = self.q[part]
        for b in range(0, len(rows), PAIRS):
            exact[b : b + PAIRS] = np.einsum("ij,ij->i", q[rows[b : b + PAIRS]], codes.v[cols[b : b + PAIRS]].astype(np.float64))
        good = exact >= floor[rows] - 1e-9
        rows, cols, exact = rows[good], cols[good], exact[good]
        exact = np.concatenate([products(q[rows[b : b + PAIRS]], codes.v[cols[b : b + PAIRS]]) for b in range(0, len(rows), PAIRS)] or [exact])
        self._keep(part, rows, codes.ids[cols], exact)

    def _keep(self, part: slice, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        m = len(self.ids[part])
        row = np.concatenate([np.repeat(np.arange(m), self.k), rows])
        score = np.concatenate([self.score[part].ravel(), scores])
        ids = np.concatenate([self.best[part].ravel(), ids])
        order = np.lexsort((ids, -score, row))
        first = np.searchsorted(row[order], np.arange(m))
        keep = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[part], self.best[part] = score[keep].reshape(m, self.k), ids[keep].reshape(m, self.k)


def search(all_vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Both: vec_id, dims, v (see vectors). The k of all_vectors found nearest to each query: query_id, rank from 1, vec_id, score."""
    spark = all_vectors.sparkSession
    tune(spark)
    fit = fitted(all_vectors)
    n, m = all_vectors.count(), queries.count()
    groups, slices = -(-m // GROUP) or 1, max(SLICES, -(-n // SLICE))
    query = F.struct("vec_id", F.xxhash64("v").alias("mark"), "v")
    asked = queries.distinct().groupBy("dims", F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int").alias("grp")).agg(F.collect_list(query).alias("asked"))
    asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    blocks = stored(index(all_vectors, fit, k), "onebit").withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int"))
    blocks = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # a group's queries come first, then the blocks of the slice
    both = asked.unionByName(blocks, allowMissingColumns=True)
    met = both.repartition(min(4 * groups * slices, MOST_PARTS), "grp", "slice", "dims").sortWithinPartitions("grp", "slice", "dims", F.col("asked").isNull())

    def run(batches):
        state: Search | None = None

        def out() -> pa.RecordBatch:
            row, at = np.nonzero(np.isfinite(state.score))
            return pa.RecordBatch.from_arrays([pa.array(state.ids[row]), pa.array(state.marks[row]), pa.array(state.best[row, at]), pa.array(state.score[row, at])], ["query_id", "mark", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                dims = batch.column("dims")[i].as_py()
                own = batch.column("asked")[i]
                if own.is_valid:
                    if state is not None:
                        yield out()
                    q = own.values
                    state = Search(q.field("vec_id").to_numpy(), q.field("v").flatten().to_numpy().reshape(-1, dims), fit[dims] if dims in fit else np.zeros((1, dims)), k)
                    state.marks, state.key = q.field("mark").to_numpy(), [batch.column(c)[i].as_py() for c in ("grp", "slice", "dims")]
                elif state is not None and state.key == [batch.column(c)[i].as_py() for c in ("grp", "slice", "dims")]:
                    state.meet(Codes.unpacked(dims, *(batch.column(c)[i].as_py() for c in ("ids", "v", "cell", "bits", "length", "f"))))
        if state is not None:
            yield out()

    found = met.mapInArrow(tidied(run), "query_id long, mark long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest of every vector whose vec_id is divisible by `every`."""
    found = vectors(embeddings)
    return search(found, found.filter(F.col("vec_id") % every == 0), k)
