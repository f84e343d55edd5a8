import random

import numpy as np
import pyarrow as pa

from lakeloom.llm import toxicity
from lakeloom.llm._common import Texts, mix, word_hashes


def corpus(n=900):
    r = random.Random(1)
    plain, bad = [f"w{r.randrange(800)}x" for _ in range(800)], ["vilest", "vileword", "rotten", "rottener"]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 200))]
        junk, toxic = r.random() < 0.3, r.random() < 0.25
        if junk:
            words += ["%%%"] * 5
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    known = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    held = range(600, 900)
    assert np.mean([(got[i].toxic >= 0.5) == labels[i][2] for i in held]) > 0.97
    assert np.mean([(got[i].low_quality >= 0.5) == (1 - labels[i][1]) for i in held]) > 0.97
    assert [name for name, _ in chain] == ["low_quality", "toxic"] and [len(m.earlier) for _, m in chain] == [0, 1]
    kept = {r.doc_id for r in toxicity.keep_clean(docs, chain).collect()}
    assert kept == {i for i in got if got[i].toxic < 0.5}
    assert toxicity.keep_clean(docs, chain).columns == docs.columns


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, ""), (2, "b " * 30000), (2, "c")], "doc_id long, text string")
    for labels in ([], [(1, 1, 1)], [(None, 1, 1), (1, None, None), (1, 0, 1), (2, 1, 0)]):
        got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == 5 and all(0 <= r.toxic <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).collect() == []


def test_all_of_a_sample_of_thousands_is_used(spark):
    ids = spark.range(4500)
    docs, labels = ids.selectExpr("id AS doc_id", "concat('w', id % 7) AS text"), ids.selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality", "CAST(id % 3 AS int) AS toxic")
    used = toxicity._labelled(docs, labels, toxicity.CATEGORIES, toxicity.MOST_LABELLED)
    assert used.count() == 4500 and toxicity._labelled(docs, labels, toxicity.CATEGORIES, 100).count() == 100
    assert {r.classes: r["count"] for r in used.groupBy("classes").count().collect()} == {0: 1500, 1: 1500, 2: 750, 3: 750}


def test_chosen_slots_are_those_of_chi_square(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice([f"w{k}" for k in range(40)] + ["bad"] * (i % 3 == 0) * 8) for _ in range(12))) for i in range(200)]
    labels = [(i, int(i % 5 > 0), int(i % 3 == 0)) for i, _ in docs]
    labelled = toxicity._labelled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.CATEGORIES, 1000)
    rows = labelled.collect()
    got = {}
    for x in toxicity._chosen(labelled, 2).collect():
        got.setdefault((x.category, x.fold), set()).add(x.slot)
    assert len(got) == 2 * (toxicity.FOLDS + 1)
    for (category, fold), slots in got.items():
        inside = [x for x in rows if x.fold != fold]
        y = np.array([x.classes >> category & 1 for x in inside])
        seen, positive = np.zeros(toxicity.SLOTS), np.zeros(toxicity.SLOTS)
        for x, label in zip(inside, y, strict=True):
            seen[np.frombuffer(x.slots, np.int32)] += 1
            positive[np.frombuffer(x.slots, np.int32)] += label
        expected = seen * y.mean()
        score = np.where(seen >= 3, (positive - expected) ** 2 / np.maximum(expected * (1 - seen / len(y)), 1e-9), 0)
        assert slots == set(np.flatnonzero(score > 0).tolist()) and len(slots) < toxicity.FEATURES


def plain_features(text):
    """Slots and counts of a text's words and word beginnings, one at a time."""
    out = {}
    for word in (text or "").split():
        own = "".join(c.lower() if "A" <= c <= "Z" else c for c in word).encode()
        for k, length in enumerate(toxicity._BEGINNINGS):
            part = own[:length] if length else own
            slot = int(word_hashes(Texts.of(pa.array([part], pa.binary())), np.array([0]), np.array([len(part)]), k)[0] % np.uint64(toxicity.SLOTS))
            out[slot] = out.get(slot, 0) + 1
    return out


def plain_choice(features, y):
    """The slots that tell the classes apart best, of those that three documents or more have."""
    n, positive, score = len(y), sum(y), {}
    for slot in {s for f in features for s in f}:
        seen = [k for k, f in enumerate(features) if slot in f]
        if len(seen) >= 3:
            expected = len(seen) * positive / n
            score[slot] = (sum(y[k] for k in seen) - expected) ** 2 / max(expected * (1 - len(seen) / n), 1e-9)
    return sorted(sorted((s for s in score if score[s] > 0), key=lambda s: (-score[s], s))[: toxicity.FEATURES])


def plain_fit(features, slots, before, y, rounds=200, l1=3e-4):
    """L1 logistic regression by proximal descent with momentum, in double precision over a dense matrix: a function from features and earlier odds to odds."""
    x = np.array([[f.get(s, 0) > 0 for s in slots] + [np.log1p(f.get(s, 0)) for s in slots] + list(b) for f, b in zip(features, before, strict=True)], float).reshape(len(y), -1)
    y = np.array(y, float)
    b = faster_b = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    step = 1 / (0.3 * np.linalg.norm(x, 2) ** 2 / len(y) + 1e-6)
    w = faster = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ faster + faster_b))) - y
        new = faster - step * (x.T @ error) / len(y)
        new, new_b = np.sign(new) * np.maximum(abs(new) - l1 * step, 0), faster_b - error.mean()
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        faster, faster_b = new + (t - 1) / later * (new - w), new_b + (t - 1) / later * (new_b - b)
        w, b, t = new, new_b, later
    return lambda f, before: float(np.array([f.get(s, 0) > 0 for s in slots] + [np.log1p(f.get(s, 0)) for s in slots] + list(before), float) @ w + b)


def test_chain_equals_a_plain_one(spark):
    """Folds, choice of slots, fits, out-of-fold odds and chained scores, made again without Spark over dense matrices in double precision."""
    rows, labels = corpus(160)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels[:120], "doc_id long, quality int, toxic int")).collect()}
    known = [plain_features(t) for _, t, _ in rows[:120]]
    folds = [int(mix(np.array([i], np.uint64))[0] % np.uint64(toxicity.FOLDS)) for i in range(120)]
    targets = [[1 - q for _, q, _ in labels[:120]], [t for _, _, t in labels[:120]]]
    models, before = [], [[] for _ in known]
    for c, y in enumerate(targets):
        models.append(plain_fit(known, plain_choice(known, y), before, y))
        if c == 0:
            apart = [0.0] * len(known)
            for fold in set(folds):
                use = [k for k in range(120) if folds[k] != fold]
                own = [known[k] for k in use], [y[k] for k in use]
                model = plain_fit(own[0], plain_choice(*own), [[] for _ in use], own[1])
                for k in range(120):
                    if folds[k] == fold:
                        apart[k] = float(np.clip(model(known[k], []), -10, 10))
            before = [[x] for x in apart]
    for i, text, _ in rows:
        f = plain_features(text)
        first = float(np.clip(models[0](f, []), -10, 10))
        second = models[1](f, [first])
        assert abs(got[i].low_quality - 1 / (1 + np.exp(-first))) < 2e-4
        assert abs(got[i].toxic - 1 / (1 + np.exp(-np.clip(second, -10, 10)))) < 2e-4
        assert got[i].rejected == (got[i].toxic >= 0.5)
