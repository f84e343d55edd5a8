import hashlib
import random

import numpy as np
import pyarrow as pa

from lakeloom.llm import simhash
from lakeloom.llm._common import Texts


def test_contract_columns(spark):
    r = random.Random(5)
    texts = [None, "", "a", "abcd", "é" * 9, "日本語 のテキスト です 🙂🙃"] + [" ".join(r.choice(["the", "of", "x", "yy", "Zz"]) + str(r.randrange(40)) for _ in range(r.randint(1, 300))) for _ in range(150)]
    texts += [texts[9]] * 20
    ids = sorted(r.sample(range(0, 200_000, 10), len(texts)))
    docs = spark.createDataFrame([(i, t, 7) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, block int").repartition(5)
    got = {x.doc_id: x for x in simhash.document_fingerprints(docs).collect()}
    own = [simhash.fingerprints(Texts.of(pa.array([t], pa.string())))[0] for t in texts]
    distance = [[int(np.bitwise_count(a ^ b)) for b in own] for a in own]
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        x = got[i]
        changed = simhash.fingerprints(Texts.of(pa.array([edited])))[0]
        assert (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{own[k]:016x}", f"{changed:016x}")
        assert x.near_edited == 1 - int(np.bitwise_count(own[k] ^ changed)) / 64
        assert x.near_next == 1 - distance[k][(k + 1) % len(texts)] / 64
        assert x.n_near == (sum(d <= simhash.RADIUS for d in distance[k]) - 1 if i % 50 == 0 else None)
    long = [k for k, t in enumerate(texts) if t and len(t) > 500]
    assert np.mean([got[ids[k]].near_edited for k in long]) > 0.7 > 0.6 > np.mean([got[ids[k]].near_next for k in long[:-25]])


def test_one_id_for_a_third_of_the_rows(spark):
    texts = [f"text {k % 90} " * (k % 9) for k in range(300)]
    rows = [(None if k < 60 else 7 if k < 160 else k * 1_000_003, t) for k, t in enumerate(texts)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = simhash.edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(d), len(t)) for d, t in rows)
    # next fingerprints are the fingerprints, each once
    assert sorted(r.fingerprint for r in got) == sorted(r.next_fingerprint for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id > 7}
    ids = sorted(by)
    assert all(by[a].next_fingerprint == by[b].fingerprint for a, b in zip(ids[:-1], ids[1:], strict=True))


def test_search_finds_all_within_radius(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(50)]
    every = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(6)]
    as_long = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(as_long(x),) for x in every], "fingerprint long")
    got = {x.fingerprint: x.n_near for x in simhash.near(df, df).collect()}
    assert got == {as_long(x): sum((x ^ y).bit_count() <= 3 for y in every) for x in set(every)}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "x"), (None, None), (3, "x"), (3, "x")], "doc_id long, text string")
    assert len(simhash.document_fingerprints(docs).collect()) == 4
    assert len(simhash.document_fingerprints(docs.filter("text = 'x' and doc_id = 3").limit(1)).collect()) == 1
    assert simhash.document_fingerprints(docs.limit(0)).collect() == []
