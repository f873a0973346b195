"""The quality chain labels lines, not documents."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import quality, registry

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled():
    """Rows to fit to and rows not seen, as (text, quality)."""
    rows = duckdb.sql(f"SELECT doc_id, text, quality FROM '{SF}/labels.parquet' JOIN '{SF}/documents.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    kept, held = [], []
    for i, text, good in rows:
        (held if zlib.crc32(str(i).encode()) % 3 == 0 else kept).append((text, good))
    return kept[:1500], held


@pytest.fixture(scope="module")
def chain(labelled):
    texts, good = zip(*labelled[0], strict=True)
    return quality.fit_lines(quality.shapes(pa.array(texts)), np.array(good) == 1)


def test_verdicts_on_rows_not_seen(labelled, chain):
    texts, good = zip(*labelled[1], strict=True)
    failed, kept = quality.verdict(chain, quality.shapes(pa.array(texts)), 0.5)
    good = np.array(good) == 1
    assert (kept == good)[~failed].mean() > 0.98 and (~good & ~failed).sum() > 50


def test_some_documents_have_lines_of_both_kinds(labelled, chain):
    found = quality.shapes(pa.array([t for t, _ in labelled[1]]))
    share = quality.content_share(chain, found)
    several = np.bincount(found.line_doc, minlength=found.n_docs) > 1
    assert ((share > 0) & (share < 1) & several).sum() > 0.05 * several.sum()


def test_lines_of_mixed_documents(labelled, chain):
    """Stretches of good and of bad documents that weren't fitted to, one after another."""
    rng = np.random.default_rng(9)
    sources = [[t.split("\n") for t, q in labelled[1] if q == kind and t.count("\n") > 2] for kind in (0, 1)]
    right = total = 0
    for _ in range(300):
        lines, truth, kind = [], [], int(rng.integers(2))
        for _ in range(int(rng.integers(2, 5))):
            source = sources[kind][rng.integers(len(sources[kind]))]
            at = rng.integers(len(source))
            part = [x for x in source[at : at + int(rng.integers(1, 8))] if x.strip()]
            lines, truth, kind = lines + part, truth + [kind] * len(part), 1 - kind
        if lines:
            found = quality.shapes(pa.array(["\n".join(lines)]))
            right += int((quality.viterbi(chain, found.features, np.array([len(lines)])) == np.array(truth)).sum())
            total += len(lines)
    assert right / total > 0.9


def test_the_verdict_comes_from_the_best_path(spark, monkeypatch):
    """``kept`` of the query, from a plain dynamic programme over each document's lines."""
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda *a, fit=quality.fit, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in registry.op7_quality(spark, sf).collect()}
    emit, move = fitted[0].emit, fitted[0].move
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall():
        found = quality.shapes(pa.array([text]))
        paths = {0: (0.0, []), 1: (0.0, [])}
        for k, features in enumerate(found.features):
            scores = features @ emit
            paths = {z: max(((s + (move[p[-1], z] if k else 0) + scores[z], [*p, z]) for s, p in paths.values()), key=lambda x: x[0]) for z in (0, 1)}
        best = max(paths.values(), key=lambda x: x[0])[1]
        content = sum(int(w) for w, z in zip(found.line_words, best, strict=True) if z)
        assert rows[i]["kept"] == (not rows[i]["base_failed"] and 2 * content >= rows[i]["n_words"]), i
