import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm import maxent
from lakeloom.llm._common import Texts


def corpus(n=400):
    r = random.Random(6)
    texts = [None, "", " \n", "A b\tÉ é", "x " * 300]
    tongues = [[f"{t}{k}" for k in range(200)] for t in ("na", "ge", "to")]
    for _ in range(n):
        own = r.choice(tongues)
        texts.append(" ".join(own[min(int(r.expovariate(0.08)), 199)] for _ in range(r.randint(1, 120))))
    return list(enumerate(texts))


def test_base_and_held_out(spark):
    rows = corpus()
    got = {x.doc_id: x for x in maxent.scores(spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    count = Counter(w for i, own in words.items() if i not in held for w in own)
    n, v = sum(count.values()), len(count)
    for i, own in words.items():
        x = got[i]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (i in held, len(own), sum(count[w] > 0 for w in own), n)
        assert abs(x.base_score - base) < 1e-6 and x.score < 0
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held) * 0.97


@pytest.mark.parametrize("often", [1, 300])
def test_probabilities_sum_to_one(often):
    """Over all known words, the end, and one unknown word for each tail class. often: with words that have places in tail classes."""
    words = [f"w{k}" for k in range(900)]
    count = Counter({w: 1 + 900 * often // (k + 1) for k, w in enumerate(words)})
    text = " ".join(w for w, c in count.items() for _ in range(c))
    asked = pa.Table.from_batches([*_chunks([(1, text)])])
    summary = maxent._count(asked).filter(pa.compute.field("chunk") == -1).to_pylist()
    model, total, distinct = maxent._model([type("R", (), row) for row in summary])
    assert (total, distinct) == (sum(count.values()) + 1, 901) and (len(model.words) > 600) == (often > 1)
    model.w += np.random.default_rng(0).normal(size=model.w.shape).astype(np.float32)
    model.u += np.random.default_rng(1).normal(size=model.u.shape).astype(np.float32)
    unknown = {}
    for k in range(10_000):
        tokens = maxent.Tokens(Texts.of(pa.array([f"u{k}%{k % 97:x}"])))
        unknown.setdefault(int(tokens.tail[0]), f"u{k}%{k % 97:x}")
        if len(unknown) == maxent.TAIL_CLASSES:
            break
    for history in ("w5 w9", "never-seen", ""):
        n = len(history.split())
        every = [*words, *unknown.values()]
        tokens = maxent.Tokens(Texts.of(pa.array([f"{history} {w}" for w in every] + [history])))
        last = tokens.bounds[1:] - 2
        last[-1] += 1  # the end itself
        counts = np.array([0] * n + [0] * len(tokens.hash))[: len(tokens.hash)]
        counts[last[: len(words)]] = [count[w] for w in words]
        p = 10 ** model.log_probability(tokens, counts)[last]
        assert len(unknown) == maxent.TAIL_CLASSES and abs(p.sum() - 1) < 1e-6


def test_softmax_of_large_weights():
    rows, bias = np.array([[0, 1], [1, 1]]), np.zeros(3, np.float32)
    for size in (1, 50, 500):
        p = maxent.Model.softmax(np.array([[size, 0, -size], [size, -size, 0]], np.float32), rows, bias)
        assert np.isfinite(p).all() and np.allclose(p.sum(1), 1, atol=1e-6) and (p.argmax(1) == 0).all()


def test_sums_of_rows():
    """Gradients summed by the row of each feature, for rows met once, a few times and very often, against adding them one by one."""
    r = np.random.default_rng(3)
    for n, most in ((1, 5), (40, 1), (40, 10_000), (3000, 30), (3000, 2000)):
        features = (most * r.random((n, 4)) ** 3).astype(np.int64)
        gradient = r.normal(size=(n, 8)).astype(np.float32)
        rows, want = maxent.Rows(features), np.zeros((most, 8))
        np.add.at(want, features.ravel(), np.repeat(gradient.astype(float), 4, axis=0))
        assert (rows.own[rows.at] == features).all() and rows.many.tolist() == np.unique(features, return_counts=True)[1].tolist()
        assert np.allclose(rows.sums(gradient), want[rows.own], atol=1e-3)


def test_scores_by_hand(spark):
    """Every score is the sum of the logarithms that the trained model gives token by token."""
    rows = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = docs.select("doc_id", "text", maxent.held_out().alias("held_out"))
    asked = marked.select((~marked.held_out).cast("long").alias("k"), "text").mapInArrow(lambda b: maxent._ask(b, 32), maxent.CHUNK_SCHEMA)
    told = asked.groupBy("part").applyInArrow(maxent._count, maxent.CHUNK_SCHEMA)
    model, total, distinct = maxent._model(told.filter("chunk = -1").collect())
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in [*(t or "").encode().lower().split(), None])
    assert (total, distinct) == (sum(count.values()), len(count))
    for _, t in rows:
        tokens = maxent.Tokens(Texts.of(pa.array([t or ""])))
        own = [*(t or "").encode().lower().split(), None]
        whole = model.log_probability(tokens, np.array([count[w] for w in own]))
        one = [model.log_probability(maxent.Tokens(Texts.of(pa.array([b" ".join(own[: k + 1]).decode()]))), np.array([count[w] for w in own[: k + 1]] + [0]))[k] for k in range(min(len(own) - 1, 5))]
        assert np.allclose(whole[: len(one)], one, atol=1e-5)


def test_places_grow_with_the_vocabulary():
    counts = np.concatenate([np.full(40_000, 1000 - 1), np.full(500, 3)]) + np.arange(40_500)[::-1]
    hashes, tails = np.random.default_rng(2).integers(1 << 62, size=40_500).astype(np.uint64), np.arange(40_500) % 16
    counts[40_000:] = 3
    row = type("R", (), {"keys": np.concatenate([hashes.view(np.int64), counts, tails]).tobytes(), "data": np.stack([np.bincount(tails, counts, 16), np.bincount(tails, minlength=16).astype(float)]).tobytes()})
    model, total, distinct = maxent._model([row])
    assert (len(model.words), total, distinct) == (40_000, counts.sum(), 40_500) and len(model.w) >= 2 * 40_000
    assert len({(k, i) for k, i in zip(model.kind.tolist(), model.index.tolist(), strict=True)}) == 40_000 and model.tail_n.sum() == 1500
    # before training, the softmaxes on the way to a word multiply to its share
    words = type("T", (), {"hashes": hashes, "tails": tails, "number": np.arange(40_500)})
    p = np.zeros(40_500)
    classes, index = model.targets(words)
    p[:] = (np.exp(model.b) / np.exp(model.b).sum())[classes]
    for at, nodes, options in model.steps(classes, index):
        e = np.exp(model.c[nodes].astype(float))
        p[at] *= e[np.arange(len(at)), options] / e.sum(1)
    assert np.allclose(p[:40_000] * total, counts[:40_000], rtol=1e-2)


def _chunks(rows):
    maxent.chunks, kept = (lambda batches, limit=0: iter([(0, pa.array([1] * len(rows)), Texts.of(pa.array([t for _, t in rows])))])), maxent.chunks
    try:
        yield from maxent._ask([], 1)
    finally:
        maxent.chunks = kept


def test_odd_rows(spark):
    assert maxent.scores(spark.createDataFrame([(0, "ü"), (3, "x" * 5000)], "doc_id long, text string")).count() == 2
    docs = spark.createDataFrame([(None, None), (None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert len(maxent.scores(docs).collect()) == 4
    assert maxent.scores(docs.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 30])
def test_scoring_by_exponentials(size):
    """Products of exponentials give the shares of the softmax; weights too large for them are scored from their sums."""
    r = np.random.default_rng(4)
    hashes, counts, tails = r.integers(1 << 62, size=2000).astype(np.uint64), np.arange(2000, 0, -1) + 100, np.arange(2000) % 16
    model = maxent.Model(hashes, counts, tails, np.full(16, 50.0), np.full(16, 5.0))
    model.w, model.u = ((r.uniform(-size, size, t.shape)).astype(np.float32) for t in (model.w, model.u))
    own, rows = model.raised(), r.integers(len(model.w), size=(300, 4))
    assert own.is_raised == (size == 1) and not model.is_raised
    if own.is_raised:
        options = r.integers(maxent.CLASSES, size=300)
        assert np.allclose(maxent.Model.raised_share(own.w, rows, own.b, options), maxent.Model.share(model.w, rows, model.b, options), rtol=1e-5)
    tokens = maxent.Tokens(Texts.of(pa.array(["a b c d e f g " * 50])))
    assert np.isfinite(model.log_probability(tokens, np.zeros(len(tokens.hash), np.int64))).all()


def test_step_of_inner_softmaxes():
    """A step down the gradient of a batch, with rows met once, twice, very often and several times by one token, against one row after another."""
    r = np.random.default_rng(5)
    for n, most in ((1, 3), (50, 2), (400, 300), (4000, 20_000)):
        model = maxent.Model(np.arange(1, 601, dtype=np.uint64), np.arange(700, 100, -1), np.arange(600) % 16, np.full(16, 50.0), np.full(16, 5.0))
        trainer, rows = maxent.Trainer(model), np.minimum((most * r.random((n, 4)) ** 2).astype(np.int64), len(model.u) - 1)
        trainer.u[:] = r.normal(size=trainer.u.shape)
        before, options, bias = trainer.u.astype(float), r.integers(maxent.SLOTS, size=n), r.normal(size=(n, maxent.SLOTS)).astype(np.float32)
        g = trainer._inner(rows, bias, options)
        z = np.exp(bias + before[rows].sum(1))
        want = z / z.sum(1, keepdims=True) - np.eye(maxent.SLOTS)[options]
        assert np.allclose(g, want, atol=1e-5)
        total, many = np.zeros(before.shape), np.bincount(rows.ravel(), minlength=len(before))
        np.add.at(total, rows.ravel(), np.repeat(want, 4, axis=0))
        steep = 1e-2 + (total**2).sum(1) / np.maximum(many, 1)
        assert np.allclose(trainer.u, before - total * (maxent.RATE / np.sqrt(steep * np.maximum(many, 1)))[:, None], atol=1e-3)
        assert (trainer.row_u.imag == many).all() and np.allclose(trainer.row_u.real, steep, rtol=1e-3)


@pytest.mark.parametrize("size", [1, 30])
def test_equal_texts_have_equal_scores(size):
    """Wherever they stand in a batch, to the last bit."""
    r = np.random.default_rng(6)
    words = [f"w{k}" for k in range(40)]
    tokens = maxent.Tokens(Texts.of(pa.array([" ".join(words)] * 50)))
    model = maxent.Model(tokens.hashes[::-1], np.arange(41, 0, -1) + 100, tokens.tails[::-1], np.full(16, 50.0), np.full(16, 5.0))
    model.w, model.u = ((r.uniform(-size, size, t.shape)).astype(np.float32) for t in (model.w, model.u))
    assert model.raised().is_raised == (size == 1)
    assert len(np.unique(model.log_probability(tokens, np.full(len(tokens.hash), 3)).reshape(50, 41), axis=0)) == 1
