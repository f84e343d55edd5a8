import random

import numpy as np
import pytest

from lakeloom.llm import minhash


def brute(rows, n, per_cent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    label = {i: i for i in range(len(rows))}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= per_cent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)}


def family(r, vocabulary, size, length, edits):
    base = [r.choice(vocabulary) for _ in range(length)]
    out = [base]
    for _ in range(size):
        w = list(r.choice(out))
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("cheap", [20_000_000, 3])
def test_against_brute_force(spark, cheap):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)] + ["É", "é"]
    texts = [None, "", " \t", "one", "ONE", "one two", "a b c", "a b c d", "A b\nc d", "x " * 50]
    for size, length, edits in ((30, 150, 6), (25, 60, 3), (15, 400, 12), (10, 12, 1), (8, 25, 1), (20, 100, 4)):
        texts += family(r, vocabulary, size, length, edits)
    texts += texts[-5:] * 3
    rows = list(enumerate(texts))
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component string")
    got = {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(docs, 4, 80, cheap).collect()}
    assert got == brute(rows, 4, 80)


def test_a_large_bucket_of_sets_near_the_similarity(spark):
    """Hundreds of texts that share most of their words, alike by 0.7 to 0.9: no link is lost, none is made up."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(260)]
    texts = []
    for _ in range(260):
        w = list(base)
        for _ in range(r.randint(5, 9)):
            w[r.randrange(len(w))] = f"own{r.random()}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for salts in (minhash.SALTS, 3):  # dealt out or not
        kept, minhash.SALTS = minhash.SALTS, salts
        try:
            got = {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(docs, 4, 80, 3).collect()}
        finally:
            minhash.SALTS = kept
        want = brute(rows, 4, 80)
        assert got == want and 1 < len({c for _, _, c, _ in want}) < 260


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (200, 100), (7, 7)]
    got = dict((x.node, x.component) for x in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


def test_null_keys_and_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    got = sorted(map(str, minhash.near_duplicates(docs).collect()))
    assert [("component_id=None" in x, "kept=True" in x) for x in got] == [(False, True)] * 3 + [(True, True)]


def test_pairs_far_under_the_similarity_by_chance_are_confirmed(spark):
    # 95 of 150 bins and 364 of 512 least hashes are equal: more than four standard deviations under 0.8, fewer than six
    bins = np.arange(150, dtype=np.uint16)
    other = np.where(np.arange(150) < 95, bins, bins + 1000).astype(np.uint16)
    both, rest = np.arange(364), np.arange(364, 512)
    x, y = (np.concatenate([both, own, np.arange(74) + far]).astype(np.uint32) for own, far in ((rest[::2], 1000), (rest[1::2], 2000)))
    rows = [(0, 1, k, k, 1000, bytearray(s.tobytes()), bytearray(z.tobytes())) for k, s, z in ((1, bins, x), (2, other, y))]
    buckets = spark.createDataFrame(rows, "band int, key long, id long, component long, n_shingles int, signature binary, sketch binary")
    assert [tuple(r) for r in minhash._unsure(buckets, 80, 4).collect()] == [(1, 2)]
