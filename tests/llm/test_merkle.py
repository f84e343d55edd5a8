import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """All levels, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((bool(i & 1), level[i ^ 1] if i ^ 1 < len(level) else None))
        i //= 2
    return out


def folded(at, steps):
    for left, sibling in steps:
        at = H(at) if sibling is None else H(sibling, at) if left else H(at, sibling)
    return at


def brute(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, k)
            shown = (*r[:3], r[3] + 1, r[4]) if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r
            root = folded(leaf(shown), steps)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H(*(s for _, s in steps if s)), root, root == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", range(0, 8))
@pytest.mark.parametrize("sub", (1, 2, 3))
def test_traversal_gives_every_path(height, sub):
    for n in {1 << height, max(1, (1 << height) - 3), (1 << height) // 2 + 1}:
        leaves = [H(str(i)) for i in range(n)]
        levels = [leaves]
        for _ in range(height):
            levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        assert [[s for _, s in path(levels, i)] for i in range(n)] == list(merkle.traversal(leaves, height, sub))
        assert merkle.subtree_root(leaves, height) == levels[-1][0]


@pytest.mark.parametrize("heights", ((8, 12), (2, 1)))
def test_equals_the_whole_tree(spark, monkeypatch, heights):
    monkeypatch.setattr(merkle, "HEIGHT", heights[0])
    monkeypatch.setattr(merkle, "UPPER", heights[1])
    r = random.Random(3)
    rows = [(r.choice([None, 5, 5, r.randrange(-50, 10**9)]), r.choice([None, "", "a:b"]), r.choice(["en", "en", "en", None, "", "é", "de", "z"]), r.choice([None, 0, 2**63 - 1, r.randrange(99)]), r.choice([None, "", "x\n", "é🙂" * r.randrange(9)])) for _ in range(300)]
    rows += [(7, "s", "en", 1, "same")] * 150 + [(k, "s", f"lang{k}", 1, "one leaf") for k in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).select(*(F.lit(1).alias(c) for c in ("tree", "own", "at", "digest", "path", "spread_tie")), *SCHEMA.replace(" long", "").replace(" string", "").split(", "))
    assert sorted((tuple(x) for x in merkle.verified(docs).collect()), key=str) == brute(rows)


def test_small_tables(spark):
    for rows in ([(1, None, None, None, None)], [(1, "a", "x", 2, "t"), (2, "a", "x", 2, "t")], [(k, "a", str(k), 2, "t") for k in range(3)]):
        assert sorted((tuple(x) for x in merkle.verified(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
    none = merkle.verified(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and none.columns[0] == "doc_id"


def test_paths_stand_alone(spark):
    docs = spark.createDataFrame([(k, "s", "ab"[k % 2], k, f"text {k}") for k in range(40)], SCHEMA)
    for x in merkle.manifest(docs).collect():
        assert folded(x.leaf, [(s.left, s.digest) for s in x.path]) == x.root
        assert folded(H(x.leaf), [(s.left, s.digest) for s in x.path]) != x.root
