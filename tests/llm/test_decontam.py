import hashlib
import random
import re

from lakeloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, n=10):
    spans = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            spans.setdefault(tuple(w[s : s + k]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, got = words(text), set(), set()
        for k in {len(s) for s in spans}:
            for s in range(len(w) - k + 1):
                if own := spans.get(tuple(w[s : s + k])):
                    hit.update(range(s, s + k))
                    got |= own
        got = sorted(map(str, got))
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(got).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 20 + ["É", "é", "Ä0", "日本"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 9, 10, 11, 14, 30, 60])))) for i in range(60)]
    items += [(60, None), (61, ""), (62, "..."), (5, items[5][1]), (5, "the " * 12), (63, "the the The"), (64, "x y x y x y x y x y x y")]
    docs = [(0, None), (1, ""), (2, "."), (3, "THE " * 40), (4, "x y " * 20)]
    for d in range(5, 80):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            own = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(own) - 8))
            k = r.randint(0, len(w))
            w[k:k] = own[a : a + r.randint(5, 30)]
        docs.append((d, r.choice([" ", "-", "\n", ", "]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
    docs += docs[6:9] + [(6, "another text of the same id"), (None, docs[10][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, words string")
    got = decontam.digests(decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string"))).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_proximity_and_empty_tables(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, item.replace("gamma", "gamma x")), (2, "alpha " + "y " * 50 + "beta"), (3, "none")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_near, r.contaminated) for r in decontam.contamination(df, bench).collect()}
    assert got == {1: (1, False), 2: (0, False), 3: (0, False)}
    assert decontam.contamination(df.limit(0), bench).collect() == []
    assert {r.n_hit for r in decontam.contamination(df, bench.limit(0)).collect()} == {0}


def test_one_word_again_and_again(spark):
    item, text = "same " * 200, "same " * 20_000
    docs = [(1, text), (2, text), (3, "same " * 9 + "other " + "same " * 10), (4, "other")]
    bench = spark.createDataFrame([(9, item), (10, "same other")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: (20_000, 20_000, ["9"]), 2: (20_000, 20_000, ["9"]), 3: (20, 12, ["10", "9"]), 4: (1, 0, [])}
