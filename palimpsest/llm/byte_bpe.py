"""Byte-level BPE by dynamic programming over prefixes.

Each byte prefix of a pre-token has exactly one token that its encoding can end
with. ``PrefixTable`` stores that token for every prefix; the encoding of the
whole is read off backwards. Bytes appended later extend the table without
touching it, and after an edit only prefixes near it are worked out again: as
soon as every prefix that a longest token can reach back to ends as before, the
rest is copied.

A candidate last token is the right one if it and the last token of the prefix
before it stay apart, that is, if merging the bytes of the two from scratch
gives those two tokens back. A token sequence is the BPE encoding of its bytes
exactly when all its neighbours stay apart.

Defined results: a null or empty text has no tokens and decodes to no bytes;
texts of any length are encoded whole; repeated rows and null ids are encoded
row by row; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import math
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Memo, bounded_batches, ragged, slices

#: Unicode White_Space, which is what \s means to the tokenizer's own regex engine.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Vocabulary:
    """Ranked byte tokens: id = rank."""

    def __init__(self, ranks: dict[bytes, int], memo: int = 400_000):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.known = Memo(memo)
        self._edges: dict[int, tuple | None] = {}  # by token: as many as the vocabulary at most

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        lines = Path(path).read_bytes().splitlines()
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a})

    def merge(self, data: bytes) -> tuple[list[bytes], list[tuple[int, int, int]]]:
        """The tokens of ``data`` by merging pairs from single bytes (for short inputs),
        and the rank, place and number of symbols of each merge."""
        parts, merges, none = [data[i : i + 1] for i in range(len(data))], [], len(self.ranks)
        while len(parts) > 1:
            ranked = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranked)
            if best == none:
                break
            at = ranked.index(best)
            merges.append((best, at, len(parts)))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, merges

    def edges(self, token: int) -> tuple[list[tuple[bytes, float]], list[tuple[bytes, float]]] | None:
        """The symbols at the token's start and at its end while it is merged, each with
        the rank of the merge that swallows it (infinite for the token itself). None if
        the token isn't what its bytes merge to, or its merges don't come in rank order."""
        if token not in self._edges:
            data = self.token[token]
            parts, merges = self.merge(data)
            found = None
            if parts == [data] and all(x[0] < y[0] for x, y in zip(merges, merges[1:], strict=False)):
                first, last = data[:1], data[-1:]
                starts, ends, symbols = [], [], [data[i : i + 1] for i in range(len(data))]
                for rank, at, n in merges:
                    symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                    if at == 0:
                        starts.append((first, rank))
                        first = symbols[0]
                    if at == n - 2:
                        ends.append((last, rank))
                        last = symbols[-1]
                found = ([*starts, (first, math.inf)], [*ends, (last, math.inf)])
            self._edges[token] = found
        return self._edges[token]

    def _stays(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens merge to just these two. Both merge by
        themselves until a pair across the border has a lower rank than the next merge
        at either edge (of equal ranks the leftmost comes first)."""
        a, b = self.edges(left), self.edges(right)
        if a is None or b is None:
            return self.merge(self.token[left] + self.token[right])[0] == [self.token[left], self.token[right]]
        ends, starts, i, j = a[1], b[0], 0, 0
        while True:
            (x, x_gone), (y, y_gone) = ends[i], starts[j]
            across = self.ranks.get(x + y, math.inf)
            if across < x_gone and across <= y_gone and across < math.inf:
                return False
            if x_gone == y_gone == math.inf:
                return True
            if x_gone <= y_gone:
                i += 1
            else:
                j += 1

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay as they are (right alone, if left is -1)."""
        key = (left << 32) | right
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= self.known.most:
                self.known.clear()
            if left < 0:
                known = self.merge(self.token[right])[0] == [self.token[right]]
            else:
                known = self._stays(left, right)
            self.known[key] = known
        return known


class PrefixTable:
    """The unique last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def _ends(self, end: int) -> int:
        """The last token of the prefix of ``end`` bytes; shorter prefixes are known."""
        vocabulary, data, last = self.vocabulary, self.data, self.last
        token_of, known_of = vocabulary.ranks.get, vocabulary.known.get
        for start in range(max(0, end - vocabulary.longest), end):
            token = token_of(data[start:end])
            if token is not None:
                left = last[start - 1] if start else -1
                stay = known_of((left << 32) | token)
                if vocabulary.apart(left, token) if stay is None else stay:
                    return token
        raise ValueError(f"no token ends a prefix: byte {data[end - 1]} is not in the vocabulary")

    def move_to(self, data: bytes) -> PrefixTable:
        """Turns the string into ``data``, keeping what is known of their common prefix."""
        same, both = 0, min(len(data), len(self.data))
        while same < both and data[same] == self.data[same]:
            same += 1
        del self.last[same:]
        self.data = data[:same]
        return self.append(data[same:])

    def append(self, more: bytes) -> PrefixTable:
        """Extends the string; nothing that was known changes."""
        self.data += more
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self._ends(end))
        return self

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces bytes ``start`` to ``stop`` by ``new``; the number of prefixes worked out again."""
        tail = self.last[stop:]
        self.data, self.last = self.data[:start] + new + self.data[stop:], self.last[:start]
        fresh = start + len(new)
        same = 0
        while len(self.last) < len(self.data):
            at = len(self.last) - fresh
            # Prefixes in the edit itself differ, so as many must agree as a token reaches back.
            if at >= 0 and same >= self.vocabulary.longest:
                self.last += tail[at:]
                return at + len(new)
            self.last.append(self._ends(len(self.last) + 1))
            same = same + 1 if at >= 0 and self.last[-1] == tail[at] else 0
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.token[out[-1]])
        return out[::-1]


class ByteBpe:
    """Encodes texts pre-token by pre-token and decodes ids."""

    #: Letters of the Latin blocks, with a space before them or not: one pre-token.
    WORD = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$"

    def __init__(self, ranks_path: str, pattern: str, memo: int = 400_000):
        import regex

        self.vocabulary = Vocabulary.from_file(ranks_path)
        explicit = pattern.replace(r"[^\s", rf"[^{WHITE}").replace(r"\S", rf"[^{WHITE}]").replace(r"\s", rf"[{WHITE}]")
        self.pattern = regex.compile(explicit)
        # Between two characters that aren't white space, a lone space begins a match of its own.
        white = re.sub(r"\\[xu]([0-9a-f]+)", r"\\x{\1}", WHITE)  # as Arrow's engine writes them
        self.crowded = f"[{white}] | [{white}]"
        self.known = Memo(memo)

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token. One that is itself a token stays one."""
        whole = self.vocabulary.ranks.get(piece)
        return [whole] if whole is not None else PrefixTable(self.vocabulary, piece).tokens()

    def _fill(self, pieces: list[str]) -> None:
        """Ids of the pre-tokens that aren't known yet: in sorted order, one table moves
        from each to the next and works out only the prefixes that they don't share."""
        table, whole, known = PrefixTable(self.vocabulary), self.vocabulary.ranks.get, self.known
        for data, piece in sorted((p.encode(), p) for p in known.missing(pieces)):
            token = whole(data)  # a pre-token that is itself a token stays one
            ids = table.move_to(data).tokens() if token is None else [token]
            known[piece] = struct.pack(f"<{len(ids)}I", *ids)

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Stretches of the texts that can be split by themselves, one after another, and
        how many each text has."""
        crowded = pc.match_substring_regex(texts, self.crowded)
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        counts = np.diff(offsets)
        before = np.full(int(counts.sum()), True)
        before[offsets[:-1] - offsets[0]] = False
        chunks = pc.binary_join_element_wise(pa.array(["", " "]).take(pa.array(before.astype(np.int8))), lists.flatten(), "")
        odd = np.flatnonzero(crowded.to_numpy(zero_copy_only=False))
        if len(odd):
            # These are their matches.
            found = [self.pattern.findall(texts[i].as_py()) for i in odd.tolist()]
            starts = np.cumsum(counts) - counts
            parts, at = [], 0
            for i, ms in zip(odd.tolist(), found, strict=True):
                parts += [chunks.slice(at, starts[i] - at), pa.array(ms, pa.string())]
                at = starts[i] + counts[i]
            chunks = pa.concat_arrays([*parts, chunks.slice(at)])
            counts[odd] = [len(ms) for ms in found]
        return chunks, counts

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        chunks, counts = self._chunks(pc.fill_null(texts, ""))
        coded = chunks.dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        simple = pc.match_substring_regex(words, self.WORD)
        whole = words.filter(simple).to_pylist()
        split = [self.pattern.findall(c) for c in words.filter(pc.invert(simple)).to_pylist()]
        self._fill([*whole, *itertools.chain.from_iterable(split)])
        simple = simple.to_numpy(zero_copy_only=False)
        found = np.empty(len(words), dtype=object)
        found[simple] = list(map(self.known.__getitem__, whole))
        found[~simple] = [b"".join([self.known[p] for p in ps]) for ps in split] if split else []
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        ids = ragged(np.frombuffer(b"".join(found), dtype="<u4"), size, index)
        stops = np.concatenate(([0], np.cumsum(size[index])))
        return ids, np.diff(stops[np.concatenate(([0], np.cumsum(counts)))])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        ids, sizes = self.encode_array(pa.array(texts, pa.string()))
        stops = np.cumsum(sizes)
        return [ids[a:b].tobytes() for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def _coder(ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks_path, pattern)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``ids`` (packed little-endian unsigned 32-bit), ``decoded`` (binary). No shuffle."""
    rows = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = rows.select("doc_id").schema.add("ids", "binary").add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for batch in slices(batches, "text"):
            ids, sizes = coder.encode_array(batch.column("text"))
            bounds = np.concatenate(([0], 4 * np.cumsum(sizes))).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
            decoded = [coder.decode(p) for p in packed.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, schema)


def digest(encoded: DataFrame) -> DataFrame:
    """Counts and digests of the rows of :func:`encode_texts`."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def sha256_of_ids(ids: list[int]) -> str:
    return hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()
