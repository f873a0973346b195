"""Exact top-k inner products by block-at-a-time pruning.

Components are terms, scaled to integers. Each shard of the vectors is put in an
order in which neighbours share their largest term and cut into document-range
blocks. A block has the maximum and minimum of every term, and a forward index
(its vectors, packed). For a query, the maxima times its positive weights plus
the minima times its negative ones bound every score in a block. Blocks are
taken by falling bound and scored whole until the bound falls below the k-th
score; a block whose bound equals it is still scored, since ties go to smaller ids.

Queries meet the vectors in a grid: shards of vectors by blocks of queries, each
cell a task's worth of bounded size. Each cell gives k rows a query at most, and
these are merged by query. Where bounds prune nothing (dense vectors of all
directions, such as the given table's) every cell is scored whole.

Defined results: vectors that are null, or hold null or non-finite components (or
ones that are non-finite when scaled), take no part. Scores are exact whatever the
size of the terms: a cell counts in doubles, 64-bit integers or Python's integers,
the first that can't go wrong. A score beyond a bigint ranks by its true value and is
returned as the bigint next to it. An empty vector scores 0 with all; vectors of
different lengths meet in their common components. Rows that repeat, or share an id,
are rows of their own: each is a candidate of every row but itself, and each row
whose id is divisible has its own results. Null ids take no part; an empty table gives
an empty table; with fewer than k candidates all are returned; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import stored

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Scores beyond a bigint are told apart by an order-preserving text of so many digits.
DIGITS = 800


def quantised(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, terms`` (whole numbers as an array of double, exact) of the vectors that take part."""
    scaled = F.transform(F.col(embedding), lambda x: x.cast("double") * scale)
    floors = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), floors.alias("terms"))
    # NaN is larger than any other number here.
    odd = F.exists("terms", lambda x: x.isNull() | (F.abs(x) >= float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("terms").isNotNull() & ~odd)


class BlockIndex:
    """A shard of vectors as document-range blocks with term bounds and forward indexes."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, rows: np.ndarray, block: int = 64):
        top = np.argmax(terms, axis=1) if terms.shape[1] else np.zeros(len(terms), dtype=np.int64)
        high = np.array([t[i] for t, i in zip(terms, top, strict=True)], dtype=np.float64) if terms.shape[1] else np.zeros(len(terms))
        order = np.lexsort((ids, -high, top))
        self.ids, self.rows, self.terms = ids[order], rows[order], terms[order]
        self.starts = np.arange(0, len(ids), block)
        self.stops = np.append(self.starts[1:], len(ids))
        self.upper = np.maximum.reduceat(self.terms, self.starts, axis=0)
        self.lower = np.minimum.reduceat(self.terms, self.starts, axis=0)
        self.scored = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that a vector in each block can score, for each query."""
        return np.maximum(queries, 0) @ self.upper.T + np.minimum(queries, 0) @ self.lower.T

    def search(self, query_row: int, query: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than the query's own."""
        order = np.argsort(-bounds, kind="stable")
        ids = scores = np.zeros(0, dtype=np.int64)
        at, step = 0, 1
        while at < len(order):
            take = order[at : at + step]
            if len(ids) == k:
                take = take[bounds[take] >= scores[-1]]
                if not len(take):
                    break
            rows = np.concatenate([np.arange(self.starts[b], self.stops[b]) for b in take.tolist()])
            self.scored += len(rows)
            found = self.terms[rows] @ query
            found = np.rint(found).astype(np.int64) if found.dtype == np.float64 else found
            other = self.rows[rows] != query_row
            ids = np.concatenate((ids, self.ids[rows][other]))
            scores = np.concatenate((scores, found[other]))
            best = np.lexsort((ids, -scores))[:k] if scores.dtype != object else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
            ids, scores = ids[best], scores[best]
            at, step = at + step, min(2 * step, 32)
        return ids, scores


def _matrix(terms: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(terms), width))
    for i, t in enumerate(terms):
        out[i, : len(t)] = t
    return out


def _whole(terms: np.ndarray, most: int) -> np.ndarray:
    """Terms in the first kind of number in which sums up to ``most`` are exact."""
    if most < 2**53:
        return terms
    if most < 2**63:
        return terms.astype(np.int64)
    return np.array([[int(x) for x in row] for row in terms.tolist()], dtype=object).reshape(terms.shape)


def _beyond(score: int) -> str | None:
    """For a score at or beyond a bigint's ends, a text that sorts as the score does."""
    return None if LEAST < score < MOST else f"{score + 10 ** (DIGITS - 1) * 5:0{DIGITS}d}"


_FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint, beyond string"


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard_rows: int = 4096, query_rows: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``; queries are the rows whose id is divisible by ``every``."""
    rows = stored(quantised(vectors, scale, vec_id, embedding).withColumn("_row", F.monotonically_increasing_id()), "vectors")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    shards, columns = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // query_rows))
    grid = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    docs = rows.select("*", F.explode(grid(columns)).alias("_q"), F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int").alias("_s"))
    sent = asked.select("*", F.explode(grid(shards)).alias("_s"), F.pmod(F.xxhash64("_row"), F.lit(columns)).cast("int").alias("_q"))

    def cell(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(docs) and len(asked):
            width = int(max(docs["terms"].map(len).max(), asked["terms"].map(len).max()))
            terms, queries = _matrix(docs["terms"], width), _matrix(asked["terms"], width)
            most = int(np.abs(terms).max(initial=0)) * int(np.abs(queries).max(initial=0)) * width
            terms, queries = _whole(terms, most), _whole(queries, most)
            index = BlockIndex(docs["vec_id"].to_numpy(dtype=np.int64), terms, docs["_row"].to_numpy(dtype=np.int64))
            bounds = index.bounds(queries)
            for i, (own, row) in enumerate(zip(asked["vec_id"].tolist(), asked["_row"].tolist(), strict=True)):
                ids, scores = index.search(row, queries[i], bounds[i], k)
                scores = [int(x) for x in scores.tolist()]
                held = np.array([min(max(x, LEAST), MOST) for x in scores], dtype=np.int64)
                out.append(pd.DataFrame({"query_row": row, "query_id": own, "vec_id": ids, "score": held, "beyond": [_beyond(x) for x in scores]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_row", "query_id", "vec_id", "score")} | {"beyond": pd.Series(dtype="object")})

    found = docs.groupBy("_s", "_q").cogroup(sent.groupBy("_s", "_q")).applyInPandas(cell, _FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB, scoring every pair.
ORACLE = """
WITH q AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.t, b.t), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.r <> b.r)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM pairs) WHERE k <= 5
"""
