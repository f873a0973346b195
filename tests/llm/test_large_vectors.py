"""Vectors with large finite components take part, with exact scores."""

from __future__ import annotations

import pytest

from palimpsest.llm import topk


# Sums of products below 2**53, below 2**63, and cells whose bound is beyond 2**63.
@pytest.mark.parametrize("large", [2.0**18, 2.0**21 + 1, 2.0**40])
def test_large_components(spark, large):
    rows = [(0, [1.0, 0.5]), (1, [large, 1.0]), (2, [-large, 1.0]), (3, [large, 0.5]), (50, [0.25, -1.0])]
    whole = [(i, [int(256 * x) for x in v]) for i, v in rows]
    expected = []
    for q, a in whole:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q)[:5]
            expected += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == expected


def test_bound_beyond_a_bigint(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**16, 1.0]), (2, [0.0, 2.0**40])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()))
    assert got == [(0, 1, 1, 2**62 + 2**16), (0, 2, 2, 2**56)]


def test_scores_beyond_a_bigint_rank_by_their_value(spark):
    rows = [(0, [2.0**60, 0.0]), (1, [2.0**60, 0.0]), (2, [2.0**61, 0.0]), (3, [-(2.0**61), 0.0]), (4, [-(2.0**60), 0.0]), (5, []), (6, [1.0, 1.0])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=6, shard_rows=2).collect()))
    most = 2**63 - 1
    assert got == [(0, 1, 2, most), (0, 2, 1, most), (0, 3, 6, most), (0, 4, 5, 0), (0, 5, 4, -most - 1), (0, 6, 3, -most - 1)]


def test_repeated_rows_are_candidates_and_queries_of_their_own(spark):
    rows = [(0, [1.0]), (0, [1.0]), (7, [2.0]), (7, [2.0]), (8, [0.5])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), k=3).collect()))
    one = [(0, 1, 7, 256 * 512), (0, 2, 7, 256 * 512), (0, 3, 0, 256 * 256)]
    assert got == sorted(one + one)
