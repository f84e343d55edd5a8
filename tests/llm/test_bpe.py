import hashlib
import random

import numpy as np
import pytest

from lakeloom.llm import bpe
from lakeloom.llm.registry import tokenizer_path

ODD = [None, "", " ", "\n", "  a", "a  b   c", "a   b", "x   y", "it's  we'LL don't", "<|endoftext|>", "a <|endoftext|>  b", "\x1c\x1d a\x1f", "日本語 テキスト　です", "é" * 50, "tab\t\t x", "!\x1c?", "end   ", "퟿ 🙂🙃 ", "a" * 5000 + " b" * 3000]


def fuzz(seed, n=300):
    r = random.Random(seed)
    alphabet = list("ab1'!  \n\t") + [" ", " ", "　", "\x85", "\x1c", "é", "日", "🙂", "'s", "<|endoftext|>", "́", " ", "᠎", "​", "﻿"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("byte_bpe_50k.json")


def test_matches_the_library(spark, path):
    texts = ODD + fuzz(1) + ["the same"] * 50
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(0, None, 1)], "doc_id long, text string, ids long")
    encoded = bpe.encode(docs, path)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(encoded, path).collect())
    tokenizer, want = bpe.load(path), []
    for i, t in [*enumerate(texts), (0, None)]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert {bytes(r.text_utf8).decode() for r in bpe.decode_ids(encoded, path).collect()} == {t or "" for t in texts}


def test_empty_table(spark, path):
    assert bpe.digests(bpe.encode(spark.createDataFrame([], "doc_id long, text string"), path), path).collect() == []


def test_incomplete_characters_as_the_library(path):
    tokenizer = bpe.load(path)
    r = random.Random(3)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(20)]
        assert bpe.decode(path, np.array(ids, np.uint32), np.array([0, 20]))[0].decode() == tokenizer.decode(ids, skip_special_tokens=False)
