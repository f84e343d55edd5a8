"""Words whose sums of bytes times powers are equal (the Thue-Morse word and its complement) are different words to every operator."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_minhash import brute as groups
from test_substr import brute as passages

from lakeloom.llm import _common, bpe, maxent, minhash, repair, substr, tokencount
from lakeloom.llm.registry import tokenizer_path

ONE = "".join("ab"[k.bit_count() % 2] for k in range(1024))
OTHER = "".join("ba"[k.bit_count() % 2] for k in range(1024))


@pytest.fixture(scope="module")
def rows():
    rest = " ".join(f"w{k}" for k in range(34))
    return [(0, f"{ONE} {rest}"), (1, f"{OTHER} {rest}"), (2, f"{ONE} {ONE}"), (3, f"{OTHER} {OTHER}"), (4, ONE), (5, OTHER)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_words_and_runs():
    r = np.random.default_rng(0)
    words = [ONE.encode(), OTHER.encode(), b"", b"a", b"a\0", b"ab", b"x" * 256, b"x" * 257, b"x" * 258] + [r.integers(0, 256, r.integers(1, 40), np.uint8).tobytes() for _ in range(3000)]
    words += words[:50]
    texts = _common.Texts(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]))
    for salt in (0, 1):
        h = _common.word_hashes(texts, texts.offsets[:-1], texts.offsets[1:], salt).tolist()
        assert len(set(h)) == len(set(words)) and dict(zip(words, h, strict=True)) == dict(zip(words[::-1], h[::-1], strict=True))
    some = [w for w in words if w]
    texts = _common.Texts(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in some])]))
    own, inverse = _common.distinct(texts, texts.offsets[:-1], texts.offsets[1:])
    assert [own.bytes_of(i) for i in inverse] == some and len(own) == len(set(some))
    values = r.integers(0, 3, 4000).astype(np.uint64)
    for n in (1, 2, 3, 7, 18, 35, 64):
        got = _common.runs(values, n).tolist()
        want = [tuple(values[i : i + n].tolist()) for i in range(len(values) - n + 1)]
        assert len(got) == len(want) and len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_token_ids(spark, rows, docs):
    path = tokenizer_path("byte_bpe_50k.json")
    got = {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.encode(docs, path), path).collect()}
    for i, t in rows:
        ids = bpe.load(path).encode(t, add_special_tokens=False).ids
        assert got[i] == (hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    path = tokenizer_path("word_bpe_49k.json")
    own = {i: bpe.load(path).encode(t, add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in repair.read(spark, repair.write(docs, path)).collect()} == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in own.items()}
    files = tokencount.write_flat(docs, path)
    assert {r.doc_id: r.n_tokens for r in tokencount.named(tokencount.scan(files), files).collect()} == {i: len(x) for i, x in own.items()}


def test_links_and_passages(rows, docs):
    assert {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(docs, 4, 80).collect()} == groups(rows, 4, 80)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substr.removed(docs, 35).collect()}
    assert [got[i] for i, _ in rows] == passages([t for _, t in rows], 35)


def test_counts(rows, docs):
    import zlib as z

    train = [t for i, t in rows if z.crc32(str(i).encode()) % 10]
    count = Counter(w for t in train for w in t.split())
    got = {x.doc_id: (x.n_tokens, x.n_known) for x in maxent.scores(docs).collect()}
    assert got == {i: (len(t.split()) + 1, 1 + sum(count[w] > 0 for w in t.split())) for i, t in rows}
    assert pa.scalar(len(count)).as_py() == 36
