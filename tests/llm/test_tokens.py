import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_bpe import ODD, fuzz

from lakeloom.llm import repair, tokencount, wordbpe
from lakeloom.llm._common import Texts
from lakeloom.llm.bpe import load
from lakeloom.llm.registry import tokenizer_path


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("word_bpe_49k.json")


WORDS = ["Été, ÀÉÎ. straße ÿ Ÿ DON'T don't. x... a,b A.b ﬁ Ω ΑΣ ş İ i̇ Å é", "ends.,., 1234 a1b2 --- ,.", "<|startoftext|>a"]


def texts():
    r = random.Random(8)
    return ODD + WORDS + fuzz(2) + [" ".join(r.choice(["the", "of", "idea", "Größe", "été.", "x-y"]) for _ in range(r.randint(1, 400))) for _ in range(60)] + ["copy of this"] * 40


@pytest.mark.parametrize("ordinary", [False, True])
def test_word_ids_as_the_library(path, ordinary):
    every = texts()
    flat, bounds = wordbpe.WordIds(path, ordinary)(Texts.of(pa.array(every, pa.string())))
    tokenizer = load(path, ordinary)
    for t, a, b in zip(every, bounds[:-1], bounds[1:], strict=True):
        assert flat[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_repair_round_trip_and_random_access():
    r = np.random.default_rng(0)
    for ids in (np.empty(0), [5], [7] * 1000, r.integers(0, 9, 20_000), np.tile(r.integers(0, 49_000, 50), 300)):
        ids = np.asarray(ids, np.uint32)
        cuts = np.sort(r.integers(0, len(ids) + 1, 20))
        counts = np.diff(np.concatenate([[0], cuts, [len(ids)]])).astype(np.uint32)
        shard = repair.Shard(repair.pack(pa.array([None, *range(20)], pa.int64()), counts, ids))
        assert (shard.all() == ids).all() and shard.doc_ids[0].as_py() is None
        at = np.concatenate([[0], np.cumsum(counts)]).astype(int)
        for i in range(21):
            assert (shard.document(i) == ids[at[i] : at[i + 1]]).all()
    assert len(shard.sequence) < len(ids) / 10 and len(shard.left)


def test_repair_goes_on_until_no_pair_is_frequent():
    r = np.random.default_rng(1)
    for ids in (np.tile(r.integers(0, 49_000, 700), 60), r.zipf(1.3, 60_000) % 49_000, np.full(5000, 7), np.tile(np.arange(3), 40)):
        rules, lengths, sequence = repair.compress(ids.astype(np.uint32))
        pairs = sequence[:-1].astype(np.uint64) << np.uint64(32) | sequence[1:]
        assert not len(pairs) or np.unique(pairs, return_counts=True)[1].max() < repair.LEAST
        assert lengths[sequence[sequence >= repair.FIRST_RULE] - repair.FIRST_RULE].sum() + (sequence < repair.FIRST_RULE).sum() == len(ids)


def plain_repair(ids, least):
    """Re-Pair as it is written down: the most frequent pair gives way to a new symbol, again and again."""
    ids, rules = list(ids), []
    while True:
        count, last = {}, {}
        for k, pair in enumerate(zip(ids[:-1], ids[1:], strict=True)):  # without overlaps
            if last.get(pair, -2) != k - 1:
                count[pair] = count.get(pair, 0) + 1
                last[pair] = k
        if not count or max(count.values()) < least:
            return rules, ids
        best, out, k = max(count, key=count.get), [], 0
        while k < len(ids):
            if tuple(ids[k : k + 2]) == best:
                out.append(repair.FIRST_RULE + len(rules))
                k += 2
            else:
                out.append(ids[k])
                k += 1
        rules.append(best)
        ids = out


def test_grammar_against_plain_repair():
    """Many pairs a round against one a round: as small but for a few per cent, and the same ids."""
    r = np.random.default_rng(4)
    for ids in (r.zipf(1.5, 6000) % 300, np.tile(r.integers(0, 50, 90), 40), r.integers(0, 4, 3000)):
        ids = ids.astype(np.uint32)
        rules, lengths, sequence = repair.compress(ids)
        plain, left = plain_repair(ids.tolist(), repair.LEAST)
        assert len(sequence) + 2 * len(rules) < 1.1 * (len(left) + 2 * len(plain)) + 20
        shard = repair.Shard(repair.pack(pa.array([0]), np.array([len(ids)], np.uint32), ids))
        assert (shard.all() == ids).all()


def test_files(spark, path):
    every = texts()
    ids = random.Random(3).sample(range(10_000), len(every))
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, every, strict=True)], "doc_id long, text string, start int").repartition(3)
    tokenizer, want, start = load(path), [], 0
    for i, t in sorted(zip(ids, every, strict=True)):
        own = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    for shard in (1 << 20, 100):
        assert sorted(map(tuple, repair.read(spark, repair.write(docs, path, 2, shard)).collect())) == want


def test_separator_scan(spark, path):
    every = texts()
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(3)
    plain = load(path, True)
    want = [(i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(every)]
    for block in (1 << 18, 64, 7):
        files = tokencount.write_flat(docs, path, block=block)
        assert sorted((r.doc_id, r.n_tokens) for r in tokencount.named(tokencount.scan(files), files).collect()) == want


def test_empty_and_null(spark, path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repair.read(spark, repair.write(none, path)).collect() == []
    odd = spark.createDataFrame([(None, None), (None, "a"), (1, ""), (1, "")], "doc_id long, text string")
    assert [r.n_tokens for r in repair.read(spark, repair.write(odd, path)).orderBy("start").collect()] == [1, 2, 1, 1]
    files = tokencount.write_flat(odd, path)
    assert sorted(r.n_tokens for r in tokencount.named(tokencount.scan(files), files).collect()) == [0, 0, 0, 1]
    files = tokencount.write_flat(none, path)
    assert tokencount.named(tokencount.scan(files), files).collect() == []
