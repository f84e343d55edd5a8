"""The pipeline's rows: stage 1 against the scores of its operator (which test_toxicity.py holds against a plain chain), stages 2 to 5 against a
brute-force version on what stage 1 keeps."""

import hashlib

import numpy as np
import pytest
from test_decontam import brute as contaminated
from test_minhash import brute as groups
from test_substr import brute as passages

import corpus_pipeline
from lakeloom.llm import bpe, toxicity
from lakeloom.llm.registry import tokenizer_path


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables: part of sf0.001's documents with copies, near copies, passages and benchmark items planted."""
    root = tmp_path_factory.mktemp("tables")
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text) < 4000][:90]
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    rows = [tuple(r) for r in docs]
    extra, passage = [], " ".join(f"planted{k}" for k in range(60))
    for k, r in enumerate(docs[:24]):
        text = [r.text, r.text.replace("the", "a", 1), f"{r.text}\n{passage}", f"{r.text} {items[k].text}"][k % 4]
        extra.append((10_000 + k, text, r.lang, r.source, len(text)))
    extra += [(20_000, None, "en", "x", None), (20_001, "", "en", "x", 0), (None, "a text of a document without an id", "en", "x", 34)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + extra, schema).write.parquet(f"file://{root}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"file://{root}/{t}.parquet")
    return f"file://{root}"


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, small), name)
        kept[name] = docs
        if name != "bpe":
            assert docs.columns == before.columns
    clean = [(r.doc_id, r.text) for r in kept["toxicity"].collect()]
    judged = toxicity.toxicity(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")).collect()
    assert sorted((str(d) for d, _ in clean)) == sorted(str(r.doc_id) for r in judged if not r.rejected)
    known = [(d, t) for d, t in clean if d is not None]
    stay = {d for d, _, c, k in groups(known, 5, 80) if k}
    assert {r.doc_id for r in kept["near_duplicates"].collect()} == stay | {None}
    left = [(d, t) for d, t in clean if d is None or d in stay]
    cut = dict(zip([d for d, _ in left], passages([t for _, t in left], 35), strict=True))
    texts = {d: (cut[d][2].decode() if cut[d][1] else t) for d, t in left}
    assert {r.doc_id: r.text for r in kept["substring_dedup"].collect()} == texts
    assert any(c[1] for c in cut.values())
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    gone = {r[0] for r in contaminated(list(texts.items()), items) if r[5]}
    assert gone and {r.doc_id for r in kept["decontamination"].collect()} == set(texts) - gone
    tokenizer = bpe.load(tokenizer_path("byte_bpe_50k.json"))
    for r in kept["bpe"].collect():
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert kept["bpe"].count() == len(texts) - len(gone)
