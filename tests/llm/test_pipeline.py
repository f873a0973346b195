"""The pipeline, stage by stage, against brute force over single texts."""

from __future__ import annotations

import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import line_dedup, quality, toxicity
from palimpsest.llm.common import table

SF = "/root/testdata/sf0.001"
WORDS = re.compile(b"[^\x20\x09-\x0d]+")


def test_whole_pipeline(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    texts = {i: t for i, t in texts.items() if scorer.score(scorer.evidences(pa.array([t])))[0] < 0.5}
    left = docs.where(docs["doc_id"].isin(list(texts)))

    chain = quality.fit(left, labels)
    texts = {i: t for i, t in texts.items() if quality.verdict(chain, quality.shapes(pa.array([t])), 0.5)[1][0]}

    documents = pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())})  # noqa: F841  read by the SQL
    texts = {i: t for i, t in duckdb.sql(f"SELECT doc_id, text FROM ({line_dedup.ORACLE})").fetchall()}

    ids = sorted(texts)
    words = [WORDS.findall(texts[i].encode().lower()) for i in ids]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    texts = {i: texts[i] for k, i in enumerate(ids) if root[k] == k}

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for i, t in texts.items():
        coded = [*library.encode(t, add_special_tokens=False).ids, 2]
        for at in range(0, len(coded), 4096):
            part = coded[at : at + 4096]
            pieces[i, at] = (len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(coded))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows} == pieces
    assert len(rows) == len(pieces) > 0


def test_a_shared_id_is_one_labelled_text(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(500)] + [(2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.fit(docs, labels) == toxicity.Model()
    assert quality.fit(docs, labels).emit.shape == (len(quality.FEATURES), 2)
