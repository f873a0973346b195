"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie in ragged numpy arrays: one flat array of symbols and
one of the rank of each adjacent pair. Every step finds the lowest-ranked pair
of each pre-token, merges it in all of them at once, drops the swallowed
symbols and looks up only the pairs that changed. The symbols left when no pair
can merge are the tokens.

Where a merged piece cannot take part in a merge of the same or a lower rank,
all its occurrences in a pre-token merge in one step (leftmost first among
overlapping ones), as the sequential order would have it; else the leftmost
occurrence alone merges. So the result equals the sequential one, and a very
long pre-token takes about as many steps as it has different pieces.

Defined results: a null or empty text has no tokens; a text of any length is
counted whole; repeated rows and null ids are counted row by row; an empty
table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Memo, bounded_batches, distinct_words, slices

SPACE_MARK = "▁"
_NONE = np.iinfo(np.int32).max
_RUNS = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*")


class RankMerger:
    """Merges batches of symbol sequences by a table of ranked pairs."""

    def __init__(self, pieces: list[str], scores: list[float]):
        self.symbol = {p: i for i, p in enumerate(pieces)}
        order = np.unique(-np.asarray(scores, dtype=np.float64), return_inverse=True)[1]
        self.rank = order.astype(np.int32)
        self.n = len(pieces)
        left, right, whole = [], [], []
        get = self.symbol.get
        for i, p in enumerate(pieces):
            for k in range(1, len(p)):
                a, b = get(p[:k]), get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(i)
        left, right, whole = (np.asarray(x, dtype=np.int64) for x in (left, right, whole))
        keys = left * self.n + right
        by = np.argsort(keys)
        self.keys = np.append(keys[by], np.iinfo(np.int64).max)
        self.whole = np.append(whole[by], -1).astype(np.int32)
        # A piece is in order if every merge that it is part of comes strictly later.
        first = np.full(self.n, _NONE, dtype=np.int32)
        np.minimum.at(first, left, self.rank[whole])
        np.minimum.at(first, right, self.rank[whole])
        times = np.bincount(self.rank, minlength=int(self.rank.max(initial=0)) + 1)
        self.in_order = (first > self.rank) & (times[self.rank] == 1)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1."""
        key = left.astype(np.int64) * self.n + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.whole[at], -1)

    def _ranks(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged >= 0, self.rank[merged], _NONE)

    def survivors(self, symbols: np.ndarray, weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum of the weights of the symbols left in each sequence.

        ``symbols`` holds the sequences one after another (-1: unknown, never
        merges), ``lengths`` their lengths (1 at least). A merged symbol weighs 1.
        """
        total = np.zeros(len(lengths), dtype=np.int64)
        own = np.arange(len(lengths))
        sym, weight, length = symbols.astype(np.int32), weights.astype(np.int64), lengths.astype(np.int64)
        merged = np.full(len(sym), -1, dtype=np.int32)
        merged[:-1] = self._pairs(sym[:-1], sym[1:])
        merged[np.cumsum(length) - 1] = -1
        while len(own):
            starts = np.cumsum(length) - length
            ranks = self._ranks(merged)
            least = np.minimum.reduceat(ranks, starts)
            done = least == _NONE
            if done.any():
                total[own[done]] = np.add.reduceat(weight, starts)[done]
                keep = np.repeat(~done, length)
                sym, weight, merged, ranks = sym[keep], weight[keep], merged[keep], ranks[keep]
                own, length, least = own[~done], length[~done], least[~done]
                if not len(own):
                    break
                starts = np.cumsum(length) - length
            at = np.flatnonzero(ranks == np.repeat(least, length))
            seq = np.searchsorted(starts, at, side="right") - 1
            first = np.ones(len(at), dtype=bool)
            first[1:] = seq[1:] != seq[:-1]
            # Of overlapping pairs (neighbours in `at`) every second one falls away.
            run = first.copy()
            run[1:] |= at[1:] != at[:-1] + 1
            index = np.arange(len(at))
            even = (index - np.maximum.accumulate(np.where(run, index, 0))) % 2 == 0
            take = first | (even & self.in_order[merged[at]])
            at, seq = at[take], seq[take]
            sym[at], weight[at] = merged[at], 1
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            merged[at] = merged[at + 1]  # its right neighbour's end of sequence, if so
            last = np.zeros(len(sym), dtype=bool)
            last[starts + length - 1] = True
            last[at] |= last[at + 1]
            moved = np.cumsum(keep) - 1
            length = length - np.bincount(seq, minlength=len(length))
            sym, weight, merged, last = sym[keep], weight[keep], merged[keep], last[keep]
            new = moved[at]
            changed = np.concatenate((new, new[new > 0] - 1))
            changed = changed[~last[changed]]
            merged[changed] = self._pairs(sym[changed], sym[changed + 1])
            merged[last] = -1
        return total


class PieceCounter:
    """Counts the pieces of a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_path: str, memo: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = [model.id_to_piece(i) for i in ids]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("pieces that go on past a space: words can't be counted one by one")
        self.merger = RankMerger(pieces, [model.get_score(i) for i in ids])
        self.memo = Memo(memo)

    def _count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token, given without its first space mark."""
        text = SPACE_MARK + SPACE_MARK.join(words)
        code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        points, inverse = np.unique(code, return_inverse=True)
        chars = [chr(c) for c in points.tolist()]
        symbol = np.array([self.merger.symbol.get(c, -1) for c in chars], dtype=np.int32)
        weight = np.array([1 if c in self.merger.symbol else len(c.encode()) for c in chars], dtype=np.int64)
        return self.merger.survivors(symbol[inverse], weight[inverse], lengths)

    def _fill(self, words: list[str]) -> None:
        new = self.memo.missing(words)
        if new:
            self.memo.update(zip(new, self._count(new).tolist(), strict=True))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        texts = pc.fill_null(texts, "")
        offsets, index, words = distinct_words(pc.split_pattern(texts, " "))
        words = words.to_pylist()
        self._fill(words)
        each = np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))
        total = np.add.reduceat(each[index], offsets[:-1])
        total[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = 0
        # Runs of spaces, and space marks in the text itself, make other pre-tokens.
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, SPACE_MARK))
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            runs = [r[1:] for r in _RUNS.findall(SPACE_MARK + texts[i].as_py().replace(" ", SPACE_MARK))]
            self._fill(runs)
            total[i] = sum(map(self.memo.__getitem__, runs))
        return total


@functools.lru_cache(maxsize=2)
def _counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit``. No shuffle."""
    rows = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = rows.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            n = _counter(model_path).count(texts)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, schema)
