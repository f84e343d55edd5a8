"""Language-model scores: a hashed maximum-entropy model with class-factored softmax, beside an add-0.1 unigram base.

Tokens are words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased) and one end after each text. Counts of all training tokens are
gathered over the whole corpus: each chunk of documents asks once about each distinct word, per key partition; words of
different chunks are told apart by their bytes.

P(token | history) is a product of softmaxes over hashed features (previous word, previous two, and two skip features). The first chooses one of 16 head or 16 tail classes. The HEAD most frequent tokens lie in the head classes, and a second softmax
chooses among the 32 of one. The other tokens that occur LEAST times or more lie in tail classes by their last two bytes, each
a tree in order of their counts: a node holds FAN words and leads to FAN further nodes, and each node on the way has its own
softmax, so places grow with the vocabulary and a token costs the logarithm of it. Place 0 of a tail class is all rarer words,
chosen among by add-0.1 counts, which leaves one share for each unknown word. The rows of both tables of weights grow with the
words that have places. All softmaxes are trained on every training token, in rounds that each take their own part of the
documents: tasks follow the gradient over their share in small batches from the shared weights, and the rows of the new
weights are averaged by how often each task met them (distributed gradient updates, combined by block of rows so that no
task holds all updates). Each trainer holds the weights twice; trainers are as many as cores.

Null and empty texts are one end. A null doc_id belongs to training (it has no remainder). Repeated rows count once each. An empty table gives
an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._common import CHUNK_SCHEMA, ODD, Texts, by_part, chunk_batch, chunks, distinct, dropped, key_parts, mix, pack_texts, ragged, read_chunk, split, squeeze, stored, swept, tidied, tune, unsqueeze, word_hashes

HEAD_CLASSES, SLOTS, TAIL_CLASSES = 16, 32, 16
HEAD, CLASSES = HEAD_CLASSES * SLOTS, HEAD_CLASSES + TAIL_CLASSES
LEAST, FAN = 100, SLOTS // 2
LEAST_BITS, ROWS_PER_WORD, BATCH, RATE, ROUNDS = 14, 2, 1 << 13, 0.45, 2
SHORT = 16
END = np.uint64(0x0D0C0B0A01020304)
ADD = 0.1


def held_out() -> Column:
    """Whether crc32(doc_id as text) mod 10 is 0; false for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tails(words: Texts) -> np.ndarray:
    """The tail class of each word, by its last two bytes; 0 for an empty one."""
    first, last, data = words.offsets[:-1], words.offsets[1:], np.append(words.data, np.uint8(0))
    byte = lambda k: np.where(last - first >= k, data[np.maximum(last - k, 0)], 0).astype(np.uint32)
    found = ((byte(1) * np.uint32(0x9E3779B1) + byte(2) * np.uint32(0x85EBCA6B)) >> np.uint32(28)).astype(np.int64) % TAIL_CLASSES
    return np.where(last > first, found, 0)


class Tokens:
    """The tokens of a chunk: numbers of distinct ones (the end is the last), their hashes, places in their text, and tail classes."""

    def __init__(self, texts: Texts):
        lower = texts.lower()
        starts, ends, bounds = split(lower)
        self.own, number = distinct(lower, starts, ends)
        first, last = self.own.offsets[:-1], self.own.offsets[1:]
        self.hashes = np.append(word_hashes(self.own, first, last), END)
        self.tails = np.append(tails(self.own), 0)
        self.number = np.insert(number, bounds[1:], len(self.own))
        self.hash, self.tail = self.hashes[self.number], self.tails[self.number]
        self.bounds = bounds + np.arange(len(bounds))
        self.place = np.arange(len(self.hash)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))

    def features(self, a: int, b: int) -> np.ndarray:
        """Hashes of the features of tokens a to b: (b - a, 4)."""
        place = self.place[a:b]
        past = []
        for k in (1, 2, 3):
            at = np.arange(a, b) - k
            past.append(np.where(place >= k, self.hash[np.maximum(at, 0)], END))
        one, two, three = past
        keys = np.stack([one, one * np.uint64(3) + mix(two), two + np.uint64(0x51ED27), three + np.uint64(0xA24BAED)], axis=1)
        return mix(keys)


class Model:
    """words: sorted hashes of the tokens with places; kind, index: their classes and places in them. Node k < HEAD_CLASSES is head
    class k; those of tail class t begin at base[t]. tail_n, tail_v: counts and distinct words without places of the tail classes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tails: np.ndarray, tail_n: np.ndarray, tail_v: np.ndarray):
        """hashes, counts, tails: of the tokens with places, by rank. The biases start at the unigram distribution."""
        self.tail_n, self.tail_v, self.is_raised = tail_n, tail_v, False
        self.bits = max(LEAST_BITS, int(ROWS_PER_WORD * len(hashes) - 1).bit_length())
        self.w, self.u = np.zeros((1 << self.bits, CLASSES), np.float32), np.zeros((1 << self.bits, SLOTS), np.float32)
        rank, far = np.arange(len(hashes)), tails[HEAD:]
        order = np.argsort(far, kind="stable")
        sizes = np.bincount(far, minlength=TAIL_CLASSES) + 1  # place 0: the words without places
        kind, index = rank % HEAD_CLASSES, rank // HEAD_CLASSES
        kind[HEAD:] = HEAD_CLASSES + far
        index[HEAD + order] = np.arange(1, len(far) + 1) - np.repeat(np.cumsum(sizes - 1) - (sizes - 1), sizes - 1)
        nodes = (sizes + FAN - 1) // FAN
        self.base = HEAD_CLASSES + np.cumsum(nodes) - nodes
        mass = np.zeros((HEAD_CLASSES + nodes.sum(), SLOTS))
        mass[kind[:HEAD], index[:HEAD]] = counts[:HEAD] + ADD
        mass[self.base, 0] = tail_n + ADD * (tail_v + 1)
        at = index[HEAD:]
        mass[self.base[far] + at // FAN, at % FAN] = counts[HEAD:] + ADD
        for first, n in zip(self.base, nodes, strict=True):
            for k in range(n - 1, 0, -1):  # a node's children come after it
                mass[first + (k - 1) // FAN, FAN + (k - 1) % FAN] = mass[first + k].sum()
        self.mixed = mix(np.arange(1, len(mass) + 1, dtype=np.uint64))
        of_class = np.concatenate([mass[:HEAD_CLASSES].sum(1), mass[self.base].sum(1)])
        self.b = np.log(of_class / of_class.sum() + 1e-12).astype(np.float32)
        self.c = np.log(mass / np.maximum(mass.sum(1, keepdims=True), 1e-12) + 1e-12).astype(np.float32)
        by = np.argsort(hashes)
        self.words, self.kind, self.index = hashes[by], kind[by].astype(np.uint8), index[by].astype(np.int32)

    def raised(self) -> Model:
        """A model for scoring alone, whose weights and biases are the exponentials of this one's: its softmaxes multiply them. The model
        itself where a product could leave what single precision holds."""
        most = lambda table: float(np.abs(table).max(initial=0))
        if self.is_raised or not max(4 * most(self.w) + most(self.b), 4 * most(self.u) + most(self.c)) < 80:
            return self
        own = copy.copy(self)
        own.w, own.u, own.b, own.c = map(np.exp, (self.w, self.u, self.b, self.c))
        own.is_raised = True
        return own

    def targets(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token and place in it (0 in a tail class: a word without a place)."""
        at = np.minimum(np.searchsorted(self.words, tokens.hashes), len(self.words) - 1)
        known = self.words[at] == tokens.hashes
        return np.where(known, self.kind[at], HEAD_CLASSES + tokens.tails)[tokens.number], np.where(known, self.index[at], 0)[tokens.number]

    def steps(self, classes: np.ndarray, index: np.ndarray):
        """(numbers of tokens, nodes, options taken there) by distance from the tokens' own nodes."""
        tail = classes >= HEAD_CLASSES
        base = self.base[np.maximum(classes - HEAD_CLASSES, 0)]
        up = np.where(tail, index // FAN, 0)
        yield np.arange(len(classes)), np.where(tail, base + up, classes), np.where(tail, index % FAN, index)
        at = np.flatnonzero(up)
        while len(at):
            k = up[at] - 1
            up[at] = k // FAN
            yield at, base[at] + k // FAN, FAN + k % FAN
            at = at[up[at] > 0]

    def rows(self, features: np.ndarray) -> np.ndarray:
        """Rows of the first softmax."""
        return (features >> np.uint64(64 - self.bits)).view(np.int64)

    def inner(self, features: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Rows of the softmax of a node: features crossed with the node."""
        crossed = features ^ self.mixed.take(nodes)[:, None]
        crossed *= np.uint64(ODD)
        return self.rows(crossed)

    @staticmethod
    def powers(parts, bias: np.ndarray, most: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """What a softmax divides, and by what. parts(): the weights to add to the biases, one feature after another. Biases are
        logarithms of shares, so exponents stay far inside what single precision holds; where they do not, they are cut (most)."""
        own = parts()
        z = bias + next(own)
        for part in own:
            z += part
        if most:
            np.clip(z, -most, most, out=z)
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
            total = z @ np.ones(z.shape[1], np.float32)
        if not most and len(z) and not (total.min() > 1e-30 and total.max() < 1e30):
            return Model.powers(parts, bias, 60)
        return z, total

    @staticmethod
    def softmax(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        z, total = Model.powers(lambda: (weights.take(own, 0) for own in rows.T), bias)
        z /= total[:, None]
        return z

    @staticmethod
    def share(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray, options: np.ndarray) -> np.ndarray:
        """One option's part of each softmax. Rows are summed one by one, so that equal ones have equal shares wherever they stand."""
        z, _ = Model.powers(lambda: (weights.take(own, 0) for own in rows.T), bias)
        return z[np.arange(len(z)), options].astype(float) / z.sum(1)

    @staticmethod
    def raised_share(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray, options: np.ndarray) -> np.ndarray:
        """As share, from exponentials."""
        z = weights.take(rows[:, 0], 0)
        z *= bias
        for k in range(1, rows.shape[1]):
            z *= weights.take(rows[:, k], 0)
        return z[np.arange(len(z)), options].astype(float) / z.sum(1)

    def log_probability(self, tokens: Tokens, counts: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token; counts: those in training."""
        if not self.is_raised and (own := self.raised()).is_raised:
            return own.log_probability(tokens, counts)
        share = self.raised_share if self.is_raised else self.share
        out, (every, places) = np.empty(len(tokens.hash)), self.targets(tokens)
        for a in range(0, len(out), BATCH):
            b = min(len(out), a + BATCH)
            features, classes, index = tokens.features(a, b), every[a:b], places[a:b]
            p = share(self.w, self.rows(features), self.b, classes)
            for at, nodes, options in self.steps(classes, index):
                p[at] *= share(self.u, self.inner(features[at], nodes), self.c.take(nodes, 0), options)
            rest = np.flatnonzero((classes >= HEAD_CLASSES) & (index == 0))
            own = classes[rest] - HEAD_CLASSES
            p[rest] *= (counts[a:b][rest] + ADD) / (self.tail_n[own] + ADD * (self.tail_v[own] + 1))
            out[a:b] = np.log10(np.maximum(p, 1e-300))
        return out


def whole(table: np.ndarray) -> np.ndarray:
    """The rows of a table as single values, which are set faster than their numbers."""
    return table.view(np.dtype((np.void, table.shape[1] * table.itemsize))).ravel()


def run_sums(gradient: np.ndarray, token: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the runs, longest first; the sums of the gradients of their tokens in that order). Run i has two tokens at least,
    token[first[i] : first[i] + many[i]]: the first SHORT of them are added by their places, over all runs at once, what is beyond by runs."""
    order = np.argsort(-many, kind="stable")
    first, many = first[order], many[order]
    total = gradient.take(token[first], 0)
    total += gradient.take(token[first + 1], 0)
    beyond = np.searchsorted(-many, -np.arange(SHORT + 1))  # runs of more than k tokens
    for k in range(2, SHORT):
        n = beyond[k]
        if not n:
            break
        total[:n] += gradient.take(token[first[:n] + k], 0)
    n = beyond[SHORT]
    if n:
        more = many[:n] - SHORT
        total[:n] += np.add.reduceat(gradient.take(token[ragged(first[:n] + SHORT, more)], 0), np.cumsum(more) - more, axis=0)
    return order, total


class Rows:
    """The distinct rows of a batch's features (own, in order, each many times), `at`: the number of each feature's row there, and the
    features' tokens in the order of their rows, those of each row beginning at `first`. The tables of weights are much larger than a
    cache, so a batch reads each row of them once."""

    def __init__(self, rows: np.ndarray):
        flat = rows.ravel()
        packed = np.sort(flat << 16 | np.arange(len(flat)))  # a batch has fewer than 2**16 features
        order, ordered = packed & 0xFFFF, packed >> 16
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        self.first = np.flatnonzero(new)
        self.own, self.many = ordered[self.first], np.diff(np.append(self.first, len(ordered)))
        self.token, at = order // rows.shape[1], np.empty(len(flat), np.int64)
        at[order] = np.cumsum(new) - 1
        self.at = at.reshape(rows.shape)

    def sums(self, gradient: np.ndarray) -> np.ndarray:
        """The gradients of each row's tokens, summed."""
        total = gradient.take(self.token[self.first], 0)
        left = np.flatnonzero(self.many > 1)
        if len(left):
            order, sums = run_sums(gradient, self.token, self.first[left], self.many[left])
            whole(total)[left[order]] = whole(sums)
        return total


class Trainer:
    """Follows the gradient from a model's weights, with step sizes by row; counts how often each row was met."""

    def __init__(self, model: Model):
        self.m = model
        self.w, self.u, self.b, self.c = model.w.copy(), model.u.copy(), model.b.copy(), model.c.copy()
        n = len(model.w)
        # of each row, read and set at once as the two parts of a complex number: how steep it was, and how often it was met
        self.row, self.row_u = np.full(n, 1e-2, complex), np.full(n, 1e-2, complex)
        self.n = 0

    @staticmethod
    def _rate(row: np.ndarray, total: np.ndarray, many) -> np.ndarray:
        """Adds gradients (total) of so many tokens to rows. Each row's step follows its sum over the root of its count."""
        row.real += np.einsum("ij,ij->i", total, total) / many
        row.imag += many
        return (RATE / np.sqrt(row.real * many)).astype(np.float32)[:, None]

    def _outer(self, rows: Rows, classes: np.ndarray) -> np.ndarray:
        """The first softmax and a step down its gradient, which is returned."""
        held, row = self.w.take(rows.own, 0), self.row.take(rows.own)
        g = Model.softmax(held, rows.at, self.b)
        g.ravel()[np.arange(0, g.size, g.shape[1]) + classes] -= 1
        total = rows.sums(g)
        total *= self._rate(row, total, rows.many)
        held -= total
        np.put(whole(self.w), rows.own, whole(held))
        self.row[rows.own] = row
        return g

    def _inner(self, rows: np.ndarray, bias: np.ndarray, options: np.ndarray) -> np.ndarray:
        """Softmaxes of nodes and a step down their gradient, which is returned. Nearly every row is met by one token of the batch, so
        weights stay in the order of tokens, feature by feature, and only rows met by several are summed and set apart."""
        n, features = rows.shape
        flat = rows.T.ravel()
        held = self.u.take(flat, 0)
        parts = held.reshape(features, n, -1)
        g, total = Model.powers(lambda: iter(parts), bias)
        g /= total[:, None]
        g.ravel()[np.arange(0, g.size, g.shape[1]) + options] -= 1
        packed = np.sort(flat << 16 | np.arange(len(flat)))  # a batch has fewer than 2**16 features
        ordered = packed >> 16
        edge = np.diff((ordered[1:] == ordered[:-1]).view(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        several = None
        if len(first):
            many = last - first + 1
            order, sums = run_sums(g, (packed[ragged(first, many)] & 0xFFFF) % n, np.cumsum(many) - many, many)
            first, many = first[order], many[order]
            own, kept = ordered[first], held.take(packed[first] & 0xFFFF, 0)
            row = self.row_u.take(own)
            sums *= self._rate(row, sums, many)
            kept -= sums
            several = own, kept, row

        row = self.row_u.take(flat)
        each = row.reshape(features, n)
        each.real += np.einsum("ij,ij->i", g, g)
        each.imag += 1
        rate, change = (RATE / np.sqrt(each.real)).astype(np.float32)[:, :, None], np.empty_like(g)
        for k in range(features):
            np.multiply(g, rate[k], out=change)
            parts[k] -= change
        np.put(whole(self.u), flat, whole(held))
        self.row_u[flat] = row
        if several:
            own, kept, row = several
            np.put(whole(self.u), own, whole(kept))
            self.row_u[own] = row
        return g

    def see(self, tokens: Tokens) -> None:
        every, places = self.m.targets(tokens)
        for a in range(0, len(tokens.hash), BATCH):
            b = min(len(tokens.hash), a + BATCH)
            features, classes, index = tokens.features(a, b), every[a:b], places[a:b]
            g = self._outer(Rows(self.m.rows(features)), classes)
            self.b -= RATE * (np.full(b - a, 1 / (b - a), np.float32) @ g)
            for at, nodes, options in self.m.steps(classes, index):
                g = self._inner(self.m.inner(features[at], nodes), self.c.take(nodes, 0), options)
                head = np.flatnonzero(nodes < HEAD_CLASSES)  # the other biases stay at the unigram distribution
                if len(head):
                    one = np.zeros((HEAD_CLASSES, len(head)), np.float32)
                    one[nodes[head], np.arange(len(head))] = 1
                    self.c[:HEAD_CLASSES] -= RATE * (one @ g[head]) / np.maximum(one.sum(1), 1)[:, None]
            self.n += b - a


_BLOCK = 256
_UPDATE = "block int, met binary, change binary"


def _updates(t: Trainer):
    """The trainer's changes and how often it met each row, in blocks of rows; the last block has the biases. Half precision keeps
    the exchange small; sums are taken in double precision."""
    blocks = len(t.w) // _BLOCK
    for base, (new, old, met) in enumerate(((t.w, t.m.w, t.row.imag), (t.u, t.m.u, t.row_u.imag))):
        for k in range(blocks):
            at = slice(k * _BLOCK, (k + 1) * _BLOCK)
            if met[at].any():
                yield base * blocks + k, met[at], new[at] - old[at]
    if t.n:
        yield -1, np.array([t.n]), np.concatenate([t.b - t.m.b, (t.c - t.m.c)[:HEAD_CLASSES].ravel()])[None, :]


def _mean(group: pa.Table) -> pa.Table:
    """A block's changes, weighted by how often each trainer met the rows."""
    met, change = 0, 0
    for m, c in zip(group.column("met").to_pylist(), group.column("change").to_pylist(), strict=True):
        own = np.frombuffer(unsqueeze(m), np.int64)
        met, change = met + own, change + np.frombuffer(unsqueeze(c), np.float16).reshape(len(own), -1) * own[:, None].astype(float)
    change = (change / np.maximum(met, 1)[:, None]).astype(np.float16)
    return pa.table({"block": group.column("block")[:1], "change": pa.array([squeeze(change.tobytes(), 1)], pa.binary())})


def train(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """docs: training documents. Each round takes its own part of them."""
    spark = docs.sparkSession
    trainers = max(8, 2 * spark.sparkContext.defaultParallelism)
    for r in range(rounds):

        def run(batches, model=model):
            trainer = Trainer(model)
            for _, _, texts in chunks(batches, 1 << 22):
                trainer.see(Tokens(texts))
            for block, met, change in _updates(trainer):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([squeeze(met.astype(np.int64).tobytes(), 1)], pa.binary()), pa.array([squeeze(change.astype(np.float16).tobytes(), 1)], pa.binary())], ["block", "met", "change"])

        part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select("doc_id", "text")
        scratch: list[str] = []
        found = stored(part.coalesce(trainers).mapInArrow(tidied(run), _UPDATE).groupBy("block").applyInArrow(_mean, "block int, change binary"), "maxent-weights", scratch)
        swept(spark)
        blocks = len(model.w) // _BLOCK
        for row in found.toLocalIterator():  # the weights, which grow with the words that have places
            change = np.frombuffer(unsqueeze(row.change), np.float16).astype(np.float32)
            if row.block < 0:
                model.b += change[:CLASSES]
                model.c[:HEAD_CLASSES] += change[CLASSES:].reshape(HEAD_CLASSES, SLOTS)
            else:
                weights, k = (model.w, row.block) if row.block < blocks else (model.u, row.block - blocks)
                weights[k * _BLOCK : (k + 1) * _BLOCK] += change.reshape(_BLOCK, -1)
        dropped(spark, scratch)
    return model


def _ask(batches, parts: int):
    """For each key partition of a chunk: its distinct tokens' bytes (the end has none) and training counts."""
    for chunk, keys, texts in chunks(batches):
        tokens = Tokens(texts)
        learn, own = np.asarray(keys.cast(pa.bool_())), tokens.own
        counts = np.bincount(tokens.number, np.repeat(learn, np.diff(tokens.bounds)), minlength=len(tokens.hashes)).astype(np.uint32)
        first, sizes = own.offsets, np.append(np.diff(own.offsets), 0)
        yield chunk_batch([(chunk, p, squeeze(own.data[ragged(first[m], sizes[m])].tobytes()), squeeze(sizes[m].astype(np.uint32).tobytes(), 1), squeeze(counts[m].tobytes(), 1)) for p, m in by_part((tokens.hashes % np.uint64(parts)).astype(np.int64), parts)])


def _count(group: pa.Table) -> pa.Table:
    """Global counts back to each chunk, and a row of chunk -1: the tokens that may have places, and sums by tail class."""
    sizes = [np.frombuffer(unsqueeze(x), np.uint32).astype(np.int64) for x in group.column("lengths").to_pylist()]
    every = Texts(np.frombuffer(b"".join(map(unsqueeze, group.column("keys").to_pylist())), np.uint8), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))
    counts = np.concatenate([np.frombuffer(unsqueeze(x), np.uint32) for x in group.column("data").to_pylist()])
    words, inverse = distinct(every, every.offsets[:-1], every.offsets[1:])
    hashes, total = word_hashes(words, words.offsets[:-1], words.offsets[1:]), np.bincount(inverse, counts, minlength=len(words)).astype(np.int64)
    end = np.diff(words.offsets) == 0
    hashes[end] = END
    part, at, rows = group.column("part")[0].as_py(), 0, []
    for chunk, n in zip(group.column("chunk").to_pylist(), map(len, sizes), strict=True):
        rows.append((chunk, part, b"", b"", squeeze(total[inverse[at : at + n]].tobytes(), 1)))
        at += n
    own = tails(words)
    top = np.lexsort((hashes, -total))
    top = top[: max(int((total >= LEAST).sum()), min(HEAD, int((total > 0).sum())))]
    sums = np.stack([np.bincount(own, total, TAIL_CLASSES), np.bincount(own, total > 0, TAIL_CLASSES)])
    if end.any():  # the end is always in the head
        top = np.unique(np.concatenate([np.flatnonzero(end), top]))
    rows.append((-1, part, hashes[top].tobytes() + total[top].tobytes() + own[top].astype(np.int64).tobytes(), b"", sums.tobytes()))
    return pa.Table.from_batches([chunk_batch(rows)])


def _model(summary: list) -> tuple[Model, int, int]:
    """An untrained model, N and V from the rows of chunk -1: the HEAD most frequent tokens and all of LEAST counts have places."""
    tops, sums = [], np.zeros((2, TAIL_CLASSES))
    for row in summary:
        tops.append(np.frombuffer(row.keys, np.int64).reshape(3, -1))
        sums += np.frombuffer(row.data).reshape(2, -1)
    total, distinct = int(sums[0].sum()), int(sums[1].sum())
    every = np.concatenate(tops, axis=1) if tops else np.zeros((3, 0), np.int64)
    hashes, counts, tails = every[0].view(np.uint64), every[1], every[2]
    order = np.lexsort((hashes, -counts, hashes != END))
    order = order[(np.arange(len(order)) < HEAD) | (counts[order] >= LEAST)]
    hashes, counts, tails = hashes[order], counts[order], tails[order]
    sums -= np.stack([np.bincount(tails, counts, TAIL_CLASSES), np.bincount(tails, counts > 0, TAIL_CLASSES)])
    if not len(order):
        hashes, counts, tails = np.array([END]), np.zeros(1, np.int64), np.zeros(1, np.int64)
    return Model(hashes, counts, tails, sums[0], sums[1]), total, distinct


def scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, text) → doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    tune(spark)
    parts = key_parts(spark)
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    # `asked` reads whether a document is learnt from in place of its key
    asked = marked.select((~F.col("held_out")).cast("long"), "text").mapInArrow(tidied(lambda b: _ask(b, parts)), CHUNK_SCHEMA)
    told = stored(asked.groupBy("part").applyInArrow(_count, CHUNK_SCHEMA), "maxent-counts")
    swept(spark)
    model, total, distinct = _model(told.filter("chunk = -1").collect())
    model = train(marked.filter("not held_out"), model, rounds).raised()
    unigram = total + ADD * (distinct + 1)

    def texts(batches):
        for chunk, keys, own in chunks(batches):
            yield chunk_batch([(chunk, -1, *pack_texts(keys, own, 1))])

    def run(group: pa.Table) -> pa.Table:
        (keys, own), answers = read_chunk(group)
        tokens = Tokens(own)
        counts, got = np.zeros(len(tokens.hashes), np.int64), {a[0]: a[3] for a in answers}
        for p, m in by_part((tokens.hashes % np.uint64(parts)).astype(np.int64), parts):
            counts[m] = np.frombuffer(unsqueeze(got[p]), np.int64)
        counts = counts[tokens.number]
        n = np.diff(tokens.bounds)
        sums = [np.add.reduceat(x, tokens.bounds[:-1]) for x in (np.log10((counts + ADD) / unigram), model.log_probability(tokens, counts))]
        known = np.add.reduceat((counts > 0).astype(np.int64), tokens.bounds[:-1])
        return pa.table({"doc_id": keys, "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(n), total), pa.int64()), "base_score": pa.array(sums[0]), "score": pa.array(sums[1])})

    packed = marked.select("doc_id", "text").mapInArrow(tidied(texts), CHUNK_SCHEMA)
    out = packed.unionByName(told.filter("chunk >= 0")).groupBy("chunk").applyInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("held_out", held_out()).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
