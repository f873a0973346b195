"""Every registered query on awkward tables: nulls, empty and very long texts, repeats,
clashing columns, and no rows at all."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import registry

LONG = "Every word counts here. " * 20_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 12, "en"),
    (1, "The quick brown fox jumps over the lazy dog. " * 12, "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \t\n\x0b\x0c\r", "de"),
    (5, "a", "en"),
    (6, LONG, "en"),
    (7, "x" * 60_000, "en"),
    (None, "No id here, but words. And more of them! Is that all?", None),
    (None, None, None),
    (8, "漢字 és \U0001f600 <|endoftext|> ▁▁ \x00 </s>  two  spaces\n\n\nand lines\r\n", "zh"),
    (50, "The quick brown fox jumps over the lazy dog. " * 12, "en"),
    (9, "STUPID idiot you are a loser. " * 30, "en"),
]
#: Names that operators use themselves.
CLASH = ["n_tokens", "score", "fp", "shard", "slot", "_id", "_row", "node", "chunk", "p", "length", "start", "n_removed", "quality", "size", "key", "label", "__cut_id", "__removed", "__kept_id", "_text", "shard_"]
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PER_ROW = ["op1_katz", "op3_line_dedup", "op4_simhash", "op5_toxicity", "op6_token_counts", "op7_quality", "op8_resharding", "op10_byte_bpe"]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('awkward')}"
    rows = [(i, t, lang, None, len(t or "")) for i, t, lang in TEXTS]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    docs.withColumns({c: F.lit(-7) for c in CLASH} | {"when": F.lit(dt.date(2020, 1, 1))}).write.parquet(f"{at}/documents.parquet")
    labels = [(1, 1, 0), (1, 1, 0), (5, None, None), (9, 0, 1), (None, 1, 1), (6, 0, 0), (77, 1, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash")).write.parquet(f"{at}/labels.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [0.5, -0.25]), (50, [0.5, -0.25]), (50, [0.5, -0.25]), (3, [0.5, -0.25]), (4, None), (5, []), (6, [nan, 1.0]), (7, [1.0, None]), (100, [inf, 0.0]), (None, [1.0, 1.0]), (8, [1e30, 0.0]), (9, [-1.0, 0.125]), (10, [1.0])]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('empty')}"
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_document(spark, awkward, name):
    out = registry.queries()[name](spark, awkward).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _, _ in TEXTS)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty, name):
    df = registry.queries()[name](spark, empty)
    assert df.collect() == []
    assert df.columns == registry.queries()[name](spark, "/root/testdata/sf0.001").columns


def test_packing_loses_nothing(spark, awkward):
    out = registry.op2_packing(spark, awkward).collect()
    assert {r["doc_id"] for r in out} == {i for i, _, _ in TEXTS}
    # Repeated ids: twice the same document, and two null ids of different texts.
    for i, texts in Counter(i for i, _, _ in TEXTS).items():
        rows = [r for r in out if r["doc_id"] == i]
        assert sum(r["start"] == 0 for r in rows) == texts
        assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_top_k_of_odd_vectors(spark, awkward):
    out = [tuple(r) for r in registry.op9_topk(spark, awkward).collect()]
    # Null, NaN, infinite and null-holding vectors and the null id take no part; all else does, row by row.
    large = math.floor(256 * float(np.float32(1e30)))
    rows = [(0, [128, -64]), (50, [128, -64]), (50, [128, -64]), (3, [128, -64]), (5, []), (8, [large, 0]), (9, [-256, 32]), (10, [256])]
    expected = []
    for n, (q, a) in enumerate(rows):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for m, (i, b) in enumerate(rows) if m != n)[:5]
            expected += [(q, k, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best, 1)]
    assert sorted(out) == sorted(expected) and len(out) == 15


def test_pipeline_stages_keep_columns(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, awkward)
        assert out.columns == columns, name
        assert out.where("n_removed <> -7 OR shard <> -7").count() == 0
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.run(spark, awkward).collect() == []  # too short or too repetitive, all of them


def test_null_text_stays_null_in_line_dedup(spark, awkward):
    out = {(r["doc_id"], r["text"]) for r in registry.op3_line_dedup(spark, awkward).collect()}
    assert (2, None) in out and (3, "") in out
