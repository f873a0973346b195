"""The near-dedup stage against true Jaccard similarity of five-word shingles."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import simhash


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(words, kind, share, rng):
    n = max(1, int(len(words) * share))
    new = [f"n{rng.randrange(10**9)}" for _ in range(n)]
    if kind == "append":
        return words + new
    if kind == "truncate":
        return words[:-n]
    if kind == "replace":
        return words[:-n] + new
    out = list(words)
    for i, w in zip(rng.sample(range(len(words)), max(1, n // 4)), new, strict=False):
        out[i] = w
    return out


def pairs_of(kind, seed, least, most, many=60):
    rng, out = random.Random(seed), []
    while len(out) < many:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(80, 600))]
        a, b = " ".join(words), " ".join(edited(words, kind, rng.uniform(0.02, 0.4), rng))
        if least <= jaccard(a, b) < most:
            out.append((a, b))
    return out


def linked(spark, pairs):
    rows = [(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.group_similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(found[2 * i] == 2 * i for i in range(len(pairs)))
    return sum(found[2 * i + 1] == 2 * i for i in range(len(pairs)))


def test_block_edits_are_found(spark):
    kinds = ("append", "truncate", "replace", "scatter")
    pairs = [p for n, kind in enumerate(kinds) for p in pairs_of(kind, n, 0.8, 0.95)]
    assert linked(spark, pairs) == len(pairs)


def test_less_alike_texts_all_stay(spark):
    """A link needs a true similarity of 0.8: close misses are no copies, however many bits agree."""
    pairs = [p for n, kind in enumerate(("append", "replace", "scatter")) for p in pairs_of(kind, 10 + n, 0.7, 0.8)]
    assert linked(spark, pairs) == 0


def test_families_of_texts_around_the_limit(spark):
    """Components against all pairs, where many texts share a template and are 0.6 to 0.9 alike."""
    rng, rows = random.Random(21), []
    for family in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60 + 80 * family)]
        for _ in range(60):
            rows.append((len(rows), " ".join(edited(base, rng.choice(("scatter", "replace", "append", "truncate")), rng.uniform(0.02, 0.35), rng))))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", "one two", "one two", "a b c d e", "a b c d e f"])]
    root = list(range(len(rows)))
    sets = [shingles(t) or {tuple(t.split())} for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[a][1] and rows[b][1] and both / len(sets[a] | sets[b]) >= 0.8:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    found = simhash.group_similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(root))
    assert 10 < len(set(root)) < 200


def test_components_of_given_documents(spark):
    """Every pair of sf0.01 that shares a shingle, its true similarity, and the components that follow."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    holders, root = {}, {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        met = {j for s in sets[i] for j in holders.get(s, ())}
        for j in met:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    found = simhash.group_similar(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: find(i) for i in sets}


def spread(spark, seed=30):
    """60 pairs at 0.85 to 0.97 among 400 other texts: the rows, and their shingles' hashes by id."""
    pairs = [p for n, kind in enumerate(("append", "replace", "scatter")) for p in pairs_of(kind, seed + n, 0.85, 0.97, many=20)]
    rng = random.Random(seed)
    rows = [(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    rows += [(120 + i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 300)))) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), {i: np.unique(simhash.shingle_hashes(t, 5)) for i, t in rows}


def test_fingerprints_are_majorities_of_bits():
    for many in (1, 2, 255, 256, 1000):
        hashes = np.random.default_rng(many).integers(0, 1 << 63, many, dtype=np.uint64) * np.uint64(2)
        made = simhash.wide_fingerprint(hashes)
        assert len(made) == simhash.WORDS == len(set(made.tolist())) and made[0] == simhash.fingerprint(hashes)[0]
    assert not len(simhash.wide_fingerprint(hashes[:0]))


def test_near_fingerprints(spark):
    """Nearly all near copies have near fingerprints, and what is found is near by brute force."""
    docs, sets = spread(spark)
    node = {simhash._node(s): i for i, s in sets.items()}
    found = {tuple(sorted(node[x % 2**64] for x in r)) for r in simhash.near_prints(simhash.shingle_keys(docs)).collect()}
    assert sum((2 * i, 2 * i + 1) in found for i in range(60)) >= 58
    for a, b in found:
        bits = simhash.wide_fingerprint(sets[a]) ^ simhash.wide_fingerprint(sets[b])
        assert min(x.bit_count() for x in bits.tolist()) <= simhash.APART


def test_fingerprints_alone_link_near_copies(spark):
    """Without any band's key the components are those of SimHash, verified."""
    docs, sets = spread(spark)
    keyed = simhash.shingle_keys(docs)
    least = keyed.groupBy("node").agg(F.min("doc_id").alias("least"))
    bare = keyed.withColumn("keys", F.array().cast("array<bigint>"))
    node = {simhash._node(s): i for i, s in sets.items()}
    found = simhash.similar_components(bare, simhash.Sets(docs, least, 5, "doc_id", "text"), 0.8).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["root"], set()).add(node[r["node"] % 2**64])
    assert all(min(g) % 2 == 0 and g == {min(g), min(g) + 1} and max(g) < 120 for g in groups.values())
    assert len(groups) >= 58


def test_stage_goes_through_fingerprints(spark, monkeypatch):
    met = []
    made = simhash.near_prints
    monkeypatch.setattr(simhash, "near_prints", lambda keyed: met.append(made(keyed)) or met[-1])
    docs, _ = spread(spark)
    left = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()}
    assert len(met) == 1 and not left & set(range(1, 120, 2)) and left >= set(range(0, 120, 2))
