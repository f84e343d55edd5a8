import math

import numpy as np
import pytest

from lakeloom.llm import onebit

SCHEMA = "vec_id long, embedding array<float>"


def exact(ids, v, every=20, k=20):
    """(query, rank, vec_id, score) over all pairs."""
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = onebit.products(np.repeat(v[i : i + 1], len(v), 0), v)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("dims", (64, 7, 129))
def test_recall_and_scores(spark, dims):
    rng = np.random.default_rng(dims)
    centres = rng.standard_normal((12, dims)) * 2
    v = (centres[rng.integers(0, 12, 4000)] * rng.integers(0, 2, 4000)[:, None] + rng.standard_normal((4000, dims))).astype(np.float32)
    v[1000:2200] = v[1000] + rng.standard_normal((1200, dims)) * 1e-3  # near copies of one vector
    ids = rng.permutation(8000)[:4000]
    got = collected(onebit.neighbours(spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], SCHEMA).repartition(6)))
    want = exact(ids, v.astype(np.float64))
    assert got.keys() == want.keys()
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(found) >= 0.98 and min(found) >= 0.8
    at = {int(i): v[k].astype(np.float64) for k, i in enumerate(ids)}
    for q, rows in got.items():
        assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert all(s == onebit.products(at[q][None], at[i][None])[0] for i, s in rows[:3])


def test_error_bounds_hold_and_choose_few():
    rng = np.random.default_rng(1)
    v = np.repeat(rng.standard_normal((60, 256)), 50, 0) + 0.5 * rng.standard_normal((3000, 256))
    q = v[::75] + 0.3 * rng.standard_normal((40, 256))
    centres = onebit.centroids(v)
    search = onebit.Search(np.arange(40) + 10**6, q, centres, 20)
    codes = onebit.Codes.of(np.arange(3000), v, centres)
    truth = q @ v.T
    signs = np.unpackbits(codes.bits, axis=1, count=256) * 2.0 - 1
    scale = codes.length / codes.f / 16
    middle = search.centred[:, codes.cell] + (search.turned @ signs.T) * scale
    width = search.reach[:, None] * codes.length * np.sqrt(1 - codes.f**2) / codes.f
    assert np.mean(np.abs(middle - truth) <= width) > 0.996
    search.meet(codes)
    assert search.reranked < 0.1 * truth.size
    assert np.mean(search.best == np.argsort(-truth, axis=1)[:, :20]) > 0.98


def test_ties_copies_and_odd_vectors(spark):
    one = [1.0] + [0.0] * 7
    rows = [(k, one) for k in range(100)] + [(200, [0.0] * 8), (220, None), (240, [1.0, None] + [0.0] * 6), (260, [math.nan] + one[1:]), (280, [math.inf] + one[1:]), (None, one), (300, [1.0, 2.0]), (301, [3.0, 4.0]), (320, []), (400, one), (400, one)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", v string, dims int, score int").repartition(3)
    got = collected(onebit.neighbours(df))
    assert set(got) == {0, 20, 40, 60, 80, 300, 400}
    for q in (0, 20, 40, 60, 80):
        assert got[q] == [(k, 1.0) for k in range(21) if k != q][:20]
    assert got[300] == [(301, 11.0)]
    assert got[400] == [(k, 1.0) for k in range(20)]
    assert onebit.neighbours(df.limit(0)).collect() == []
    few = collected(onebit.neighbours(spark.createDataFrame([(0, one), (1, one), (2, one)], SCHEMA)))
    assert few == {0: [(1, 1.0), (2, 1.0)]}
    assert onebit.neighbours(spark.createDataFrame([(0, one)], SCHEMA)).collect() == []
