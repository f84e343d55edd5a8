"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another. The model of a category is a sparse (L1) logistic regression over hashed word
and word-beginning features and the probabilities of the categories before it. In training those probabilities are
out-of-fold predictions: for each fold of documents a model that has not seen the fold gives them, so a later model
meets the errors that it will meet in use.

Models are fitted from at most MOST_LABELLED labelled documents (the least by a hash of doc_id; a doc_id with several labels
counts as positive where any row says so, and of texts with one doc_id the one with the greatest features counts). Spark counts
each feature's documents by fold and classes; the FEATURES that tell the classes apart best (chi-square, of those that three
documents or more have) are chosen for each model from these counts, and only they are brought to the one task that fits the
chain. So that task and the driver hold at most MOST_LABELLED rows of chosen features, however long the texts are. Scoring is
one pass over all documents, without a shuffle. Null and empty texts score by the bias alone. Rows are scored one by one, so
repeated rows, ties and null ids change nothing. Without labels, or with one class only, a category's probability is the
smoothed share of positives. Empty tables give an empty result; other columns of the tables are not read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm._common import Texts, dropped, mix, slices, split, stored, tidied, tidy, tune, word_hashes

MOST_LABELLED = 6000
FOLDS, FEATURES, SLOTS = 5, 1024, 1 << 20
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
_BEGINNINGS = (0, 4, 5, 6, 7, 8)  # bytes of a word that make a feature; 0: the whole word


@dataclass
class Linear:
    slots: np.ndarray  # hashed features that are used
    present: np.ndarray  # their weights where present
    often: np.ndarray  # their weights times log(1 + count)
    earlier: np.ndarray  # weights of the log-odds of the categories before
    bias: float

    def odds(self, rows: np.ndarray, slots: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.slots, slots)
        known = at < len(self.slots)
        known[known] = self.slots[at[known]] == slots[known]
        at, rows, counts = at[known], rows[known], counts[known]
        out = np.bincount(rows, self.present[at] + self.often[at] * np.log1p(counts.astype(np.float64)), minlength=len(before))
        return out + before @ self.earlier + self.bias


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, count) of every feature that occurs."""
    parts = [(rows + at, found, counts) for at, part in slices(texts) for rows, found, counts in [_features(part.lower())]]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64))


def _features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, bounds = split(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    keys = []
    for k, length in enumerate(_BEGINNINGS):
        end = np.minimum(starts + length, ends) if length else ends
        slot = word_hashes(texts, starts, end, k) % np.uint64(SLOTS)
        keys.append(text * SLOTS + slot.astype(np.int64))
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    return (found // SLOTS).astype(np.int32), (found % SLOTS).astype(np.int32), counts.astype(np.int32)


def _fit(rows, slots, counts, best: np.ndarray, earlier: np.ndarray, y: np.ndarray, rounds: int = 200, l1: float = 3e-4) -> Linear:
    """Proximal gradient descent with momentum over the chosen slots (best, ascending)."""
    n, positive = len(y), int(y.sum())
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    none = np.empty(0)
    if not 0 < positive < n:
        return Linear(np.empty(0, np.int64), none, none, np.zeros(earlier.shape[1]), bias)
    k = len(best)
    column = np.searchsorted(best, slots)
    own = column < k
    own[own] = best[column[own]] == slots[own]
    x = np.zeros((n, 2 * k + earlier.shape[1]), np.float32)
    x[rows[own], column[own]] = 1
    x[rows[own], k + column[own]] = np.log1p(counts[own].astype(np.float32))
    x[:, 2 * k :] = earlier
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        v = x.T @ (x @ (v / max(np.linalg.norm(v), 1e-9)))
    step = 1 / (0.3 * np.linalg.norm(v) / n + 1e-6)
    w = ahead = np.zeros(x.shape[1])
    b = ahead_b = bias
    t = 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(np.float32) + ahead_b, -30, 30))) - y
        new = ahead - step * (x.T @ error.astype(np.float32)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - l1 * step, 0)
        new_b = ahead_b - error.mean()
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / faster * (new - w), new_b + (t - 1) / faster * (new_b - b)
        w, b, t = new, new_b, faster
    used = (w[:k] != 0) | (w[k : 2 * k] != 0)
    return Linear(best[used], w[:k][used], w[k : 2 * k][used], w[2 * k :], float(b))


def fit_chain(rows, slots, counts, folds: np.ndarray, labels: list[np.ndarray], chosen: dict[tuple[int, int], np.ndarray]) -> list[Linear]:
    """A model for each category, in order. folds: the fold of each text; chosen: the slots of each model by category and the
    fold left out (FOLDS: none)."""
    chain, before = [], np.zeros((len(folds), 0))
    for c, y in enumerate(labels):
        y = y.astype(float)
        none = np.empty(0, np.int64)
        chain.append(_fit(rows, slots, counts, chosen.get((c, FOLDS), none), before, y))
        apart = np.zeros(len(y))
        for fold in np.unique(folds) if c + 1 < len(labels) else ():
            inside = folds != fold
            at = np.cumsum(inside) - 1
            use = inside[rows]
            model = _fit(at[rows[use]], slots[use], counts[use], chosen.get((c, int(fold)), none), before[inside], y[inside])
            apart[~inside] = model.odds(rows, slots, counts, before)[~inside]
        before = np.column_stack([before, np.clip(apart, -10, 10)])
    return chain


_LABELLED = "doc_id long, fold int, classes int, slots binary, counts binary"


def _labelled(docs: DataFrame, labels: DataFrame, categories, most: int, scratch: list[str] | None = None) -> DataFrame:
    """_LABELLED for the documents used: bit k of classes is category k, slots and counts are all features of the text."""
    classes = sum((F.max(F.expr(f"coalesce(int({c}), 0)")) * (1 << k) for k, (_, c) in enumerate(categories)), F.lit(0)).cast("int")
    truth = labels.filter("doc_id is not null").groupBy("doc_id").agg(classes.alias("classes"))
    sample = stored(truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "sample", scratch)

    def run(batches):
        for batch in batches:
            rows, slots, counts = features(Texts.of(batch.column(2)))
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            folds = (mix(np.asarray(batch.column(0)).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int32)
            lists = (pa.array([x[a:b].astype(t).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x, t in ((slots, np.int32), (np.minimum(counts, 65535), np.uint16)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folds), batch.column(1), *lists], ["doc_id", "fold", "classes", "slots", "counts"])

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "classes", "text")  # most rows at most
    found = texts.mapInArrow(tidied(run), _LABELLED)
    return found.groupBy("doc_id", "fold", "classes").agg(F.max(F.struct("slots", "counts")).alias("f")).select("doc_id", "fold", "classes", "f.slots", "f.counts")


def _chosen(labelled: DataFrame, n_categories: int) -> DataFrame:
    """category, fold (left out; FOLDS: none), slot: the FEATURES best slots of each model."""
    cells = FOLDS << n_categories  # documents by fold and classes
    kinds = F.col("fold") * (1 << n_categories) + F.col("classes")

    def run(batches):
        for batch in batches:
            n, lists = batch.num_rows, [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
            key = np.concatenate([s.astype(np.int64) * cells + k for s, k in zip(lists, batch.column(0).to_pylist(), strict=True)]) if n else np.empty(0, np.int64)
            key, many = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key // cells).astype(np.int32)), pa.array((key % cells).astype(np.int32)), pa.array(many)], ["slot", "cell", "n"])

    sums = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    positive = lambda c: F.expr(f"(cell & {1 << c}) != 0")
    outside = lambda f: F.floor(F.col("cell") / (1 << n_categories)) != f
    models = [(c, f) for c in range(n_categories) for f in range(FOLDS + 1)]
    columns = [x for f in range(FOLDS + 1) for x in (sums(outside(f)).alias(f"n{f}"), *(sums(outside(f) & positive(c)).alias(f"p{c}_{f}") for c in range(n_categories)))]
    per_slot = labelled.select(kinds.alias("cell"), "slots").mapInArrow(tidied(run), "slot int, cell int, n long").groupBy("slot").agg(*columns)
    whole = labelled.select(kinds.alias("cell"), F.lit(1).alias("n")).agg(*columns).first()  # a few counts

    def chi_square(c: int, f: int) -> Column:
        seen, n = F.col(f"n{f}"), F.lit(max(whole[f"n{f}"], 1))
        expected = seen * F.lit(whole[f"p{c}_{f}"]) / n
        score = (F.col(f"p{c}_{f}") - expected) ** 2 / F.greatest(expected * (1 - seen / n), F.lit(1e-9))
        return F.struct(F.lit(c).alias("category"), F.lit(f).alias("fold"), F.when(seen >= 3, score).otherwise(0.0).alias("score"))

    scored = per_slot.select("slot", F.explode(F.array(*(chi_square(*m) for m in models))).alias("m")).select("slot", "m.*").filter("score > 0")
    order = Window.partitionBy("category", "fold").orderBy(F.desc("score"), "slot")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= FEATURES).select("category", "fold", "slot")


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, most: int = MOST_LABELLED) -> list[tuple[str, Linear]]:
    """docs(doc_id, text), labels(doc_id and what the categories' conditions read) → the chain. most: labelled documents used."""
    tune(docs.sparkSession)
    scratch: list[str] = []
    labelled = stored(_labelled(docs, labels, categories, most, scratch), "labelled", scratch)
    chosen: dict = {}
    for r in _chosen(labelled, len(categories)).collect():  # FEATURES rows a model
        chosen.setdefault((r.category, r.fold), []).append(r.slot)
    chosen = {k: np.sort(np.array(v, np.int64)) for k, v in chosen.items()}
    every = np.unique(np.concatenate([*chosen.values(), np.empty(0, np.int64)]))

    def cut(batches):
        for batch in batches:
            lists = [(np.frombuffer(s, np.int32), np.frombuffer(n, np.uint16)) for s, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            use = [np.isin(s, every) for s, _ in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s[u].tobytes() for (s, _), u in zip(lists, use, strict=True)], pa.binary()), pa.array([n[u].tobytes() for (_, n), u in zip(lists, use, strict=True)], pa.binary())], batch.schema.names)

    def fit(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("doc_id").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        slots, counts = ([np.frombuffer(x, t) for x in group.column(c).to_pylist()] for c, t in (("slots", np.int32), ("counts", np.uint16)))
        rows = np.repeat(np.arange(len(slots)), [len(x) for x in slots])
        classes = group.column("classes").to_numpy()
        y = [(classes >> k & 1).astype(float) for k in range(len(categories))]
        chain = fit_chain(rows, np.concatenate(slots), np.concatenate(counts), group.column("fold").to_numpy(), y, chosen)
        tidy()
        return pa.table({"chain": pa.array([pickle.dumps(chain)], pa.binary())})

    found = labelled.mapInArrow(tidied(cut), _LABELLED).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(fit, "chain binary").collect()  # most rows of chosen features in one task
    dropped(docs.sparkSession, scratch)
    chain = pickle.loads(found[0].chain) if found else fit_chain(*(np.empty(0, int),) * 4, [np.empty(0)] * len(categories), {})
    return list(zip([name for name, _ in categories], chain, strict=True))


def _probabilities(chain: list[tuple[str, Linear]], column: pa.Array) -> np.ndarray:
    out = [np.zeros((0, len(chain)))]
    for _, part in slices(Texts.of(column)):
        rows, slots, counts = _features(part.lower())
        before = np.zeros((len(part), 0))
        for _, model in chain:
            before = np.column_stack([before, np.clip(model.odds(rows, slots, counts, before), -10, 10)])
        out.append(before)
    return 1 / (1 + np.exp(-np.concatenate(out)))


def score(docs: DataFrame, chain: list[tuple[str, Linear]]) -> DataFrame:
    """docs(doc_id, text) → doc_id and the probability of each category."""
    tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            p = _probabilities(chain, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in p.T)], ["doc_id", *(name for name, _ in chain)])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, " + ", ".join(f"`{name}` double" for name, _ in chain))


def keep_clean(docs: DataFrame, chain: list[tuple[str, Linear]], category: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose probability of the category is under the threshold."""
    tune(docs.sparkSession)
    which, text = [name for name, _ in chain].index(category), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_probabilities(chain, batch.column(text))[:, which] < threshold))

    return docs.mapInArrow(tidied(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the probability of each category, and rejected: whether that of `toxic` reaches the threshold."""
    rejected: Column = F.col("toxic") >= threshold
    return score(docs, train(docs, labels)).withColumn("rejected", rejected)
