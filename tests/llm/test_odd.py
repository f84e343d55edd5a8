"""Every operator and pipeline stage over odd tables: nulls in any column, empty and very long texts and words, repeated rows, columns whose
names clash with those that operators use, and tables without rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import bpe, chat, decontam, maxent, minhash, registry, repair, simhash, substr, tokencount, toxicity

BYTE, WORD = registry.tokenizer_path("byte_bpe_50k.json"), registry.tokenizer_path("word_bpe_49k.json")
CLASHING = ["own", "own_key", "cut_of", "left_text", "kept", "h1", "h2", "value", "place", "tie", "part", "kind", "band", "key", "id", "node", "component", "signature", "n_words", "held_out", "score", "chunk", "toxic", "rejected", "edited", "fold", "classes", "start", "stop"]
LONG = " ".join(f"w{k % 700}" for k in range(20_000))
TEXTS = [(None, None), (None, None), (None, "a text without an id"), (1, None), (2, ""), (3, " \n\t"), (4, "x" * 300_000), (5, LONG), (6, LONG), (7, "same " * 3000), (8, "one"), (8, "one"), (8, "another of this id"), (-5, "é̂ 🙂 " * 40), (1 << 40, "far away"), (9, "a\0b \0")]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return base.select(F.lit("en").alias("lang"), "text", "doc_id", F.lit(None).cast("string").alias("source"), *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (4, 0, 1, None), (5, 1, 0, ""), (7, 0, 1, ""), (8, None, None, None), (None, 1, 1, ""), (4, 0, 1, None)], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "same " * 30, 7), (1, "same " * 30, 7), (2, None, 7), (None, "one", 7), (3, "", 7), (4, " ".join(f"w{k}" for k in range(50)), 7)], "item_id long, text string, doc_id int")


OPERATORS = {
    "toxicity": lambda d, labels, items: toxicity.toxicity(d, labels),
    "bpe": lambda d, labels, items: bpe.digests(bpe.encode(d, BYTE), BYTE),
    "simhash": lambda d, labels, items: simhash.document_fingerprints(d),
    "maxent": lambda d, labels, items: maxent.scores(d),
    "repair": lambda d, labels, items: repair.read(d.sparkSession, repair.write(d, WORD)),
    "tokencount": lambda d, labels, items: (lambda files: tokencount.named(tokencount.scan(files), files))(tokencount.write_flat(d, WORD)),
    "decontam": lambda d, labels, items: decontam.digests(decontam.contamination(d, items)),
    "minhash": lambda d, labels, items: minhash.near_duplicates(d),
    "substr": lambda d, labels, items: substr.digests(substr.removed(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, labels, items, name):
    got = OPERATORS[name](docs, labels, items).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(d) for d, _ in TEXTS)
    by = {}
    for r, row in ((r, r.asDict()) for r in got):  # equal texts of one id have equal answers, whatever their places are
        row = {k: v for k, v in row.items() if k not in ("start", "file", "document", "near_edited", "near_next", "edited_sha256", "edited_fingerprint", "n_near")}
        by.setdefault(r.doc_id, []).append(row)
    assert len({str(x) for x in by[8]}) <= 2
    none = OPERATORS[name](docs.limit(0), labels.limit(0), items.limit(0))
    assert none.collect() == [] and none.columns == OPERATORS[name](docs.limit(0), labels, items).columns


def test_stages(spark, docs, labels, items, tmp_path):
    root = f"file://{tmp_path}"
    labels.write.parquet(f"{root}/labels.parquet")
    items.write.parquet(f"{root}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, now, root), name)
        assert out.columns == docs.columns and out.count() > 0
        assert {tuple(r) for r in out.select(CLASHING).distinct().collect()} <= {tuple(range(len(CLASHING)))}
        assert stage(spark, now.limit(0), root).collect() == []
        now = out
    assert corpus_pipeline.STAGES[-1][1](spark, now, root).count() == now.count()


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "user", "b"), (2, 0, "assistant", "x" * 200_000), (3, 5, "", "")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, part int")
    got = chat.digests(chat.format_pairs(chat.branched_pairs(df))).collect()
    assert sorted(r.conv_id for r in got) == [1, 2, 3]
    assert chat.digests(chat.format_pairs(chat.branched_pairs(df.limit(0)))).collect() == []
