import random
from collections import Counter

import pytest

from lakeloom.llm import substr


def brute(texts, length):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "a b", "\x1c"]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(3, 60))] for _ in range(4)]
    texts = [None, "", " \n\t", "one", "a " * 100, "x " * 7, "x y " * 30]
    for _ in range(40):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        for p in r.sample(passages, r.randint(0, 2)):
            k = r.randint(0, len(words))
            words[k:k] = p
        texts.append(r.choice([" ", "\n", "  ", "\t"]).join(words))
    return texts + texts[10:14]


@pytest.mark.parametrize("length", [7, 35])
def test_against_brute_force(spark, length):
    texts = corpus(length)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substr.removed(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_longest(spark):
    texts = corpus(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.longest, r.spans) for r in substr.removed(docs, 5, longest=True).collect()}
    levels = {length: brute(texts, length) for length in (5, 10, 20, 40, 80, 160, 320)}
    for i in range(len(texts)):
        assert got[i][1] == max([0, *(k for k, v in levels.items() if v[i][1])])
        assert got[i][0] == levels[5][i][1] == sum(b - a for a, b in got[i][2])


def test_empty_and_null_keys(spark):
    assert substr.removed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(None, "a b c"), (None, None), (2, "a b c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in substr.removed(docs, 3).collect()) == [("2", 3), ("None", 0), ("None", 3)]
