"""Packing by first-fit decreasing over a tournament tree of bin capacities.

Documents become token ids with an end id. A document longer than a sequence is
cut into full sequences and a rest; rests are packed first-fit decreasing. The
pieces are dealt to randomised groups by a hash of their row's number, so copies, null
ids and all else that repeats fall into all groups alike. Each group (about ``group_docs``
documents) is packed by itself, so groups run in parallel, and the only
loss against packing all at once is one part-filled sequence or so a group.

Only lengths are shuffled: ids are made and cut where the documents are read. The
narrow rows of lengths are stored first, so that a row's number stays what it is
when a task is run again.

Defined results: a null or empty text is the end id alone; repeated rows and rows with
a null id are documents of their own (their pieces are told apart by sequence and
offset); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Memo, bounded_batches, distinct_words, ragged, slices, stored


class TournamentTree:
    """Capacities of bins at the leaves, the larger of two children above them."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Takes ``size`` from the first bin that has it; that bin. ValueError if none has."""
        best = self.best
        if best[1] < size:
            raise ValueError("no bin is large enough")
        at = 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        best[at] -= size
        leaf = at - self.leaves
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return leaf


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size: larger ones first, equal ones in the order given."""
    order = np.argsort(-sizes, kind="stable")
    tree = TournamentTree(max(1, len(sizes)), capacity)
    bins = np.empty(len(sizes), dtype=np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        bins[i] = tree.place(size)
    return bins


class TextEncoder:
    """Ids of whole texts by a tokenizer that splits at white space and drops it.

    Distinct words are encoded once for a batch. Where the tokenizer lower-cases,
    splits by a pattern and marks word ends in its tokens, plain words (ASCII, Latin
    letters, common punctuation) are lower-cased and split in Arrow; each pre-token
    is encoded once, many as one text that the marks take apart again, and
    remembered. Other words go to the tokenizer by themselves.
    """

    def __init__(self, vocabulary: str, memo: int = 450_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known, self.words = Memo(memo), Memo(memo // 4)
        setup = json.loads(self.tokenizer.to_str())
        suffix = setup["model"].get("end_of_word_suffix")
        splits = [p["pattern"]["Regex"] for p in (setup["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split" and p.get("invert")]
        lowers = any(n["type"] == "Lowercase" for n in (setup["normalizer"] or {}).get("normalizers", []))
        # White space is ASCII here, of which \s leaves one out in Arrow's engine.
        self.split = "(" + splits[0].replace(r"[^\s", r"[^\t-\r ") + ")" if suffix and len(splits) == 1 and lowers else None
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        if self.split:
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    #: A character that isn't plain (composing, odd-cased, other white space), or the start of a special token.
    NOT_PLAIN = r"[^\t-\r -~\x{a1}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20ac}]|<\|"

    def _coded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(c.ids, dtype="<u4") for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str], at_once: int = 256) -> None:
        """Encodes new pre-tokens, some as one text."""
        if "" in new:  # between the spaces, not a pre-token
            new.remove("")
            self.known[""] = b""
        for at in range(0, len(new), at_once):
            part = new[at : at + at_once]
            ids = self._coded([" ".join(part)])[0]
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                data, cuts = ids.tobytes(), (4 * ends).tolist()
                self.known.update((w, data[a:b]) for w, a, b in zip(part, [0, *cuts], cuts, strict=False))
            else:
                self.known.update((w, c.tobytes()) for w, c in zip(part, self._coded(part), strict=True))

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after another, and their numbers."""
        if self.split:
            plain = pc.invert(pc.match_substring_regex(words, self.NOT_PLAIN))
        else:
            plain = pa.array(np.zeros(len(words), dtype=bool))
        low = pc.utf8_lower(words.filter(plain))
        letters = pc.utf8_is_alpha(low)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(low.filter(pc.invert(letters)), self.split or "", r"\1 "))
        coded = pa.concat_arrays([low.filter(letters), lists.flatten()]).dictionary_encode()
        parts, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        self._learn(self.known.missing(parts))
        other = words.filter(pc.invert(plain)).to_pylist()
        new = self.words.missing(other)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.words.update((w, c.tobytes()) for w, c in zip(some, self._coded(some), strict=True))
        found = [*map(self.known.__getitem__, parts), *map(self.words.__getitem__, other)]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4

        # The parts of every word in order: itself, or its pre-tokens.
        plain, letters = plain.to_numpy(zero_copy_only=False), letters.to_numpy(zero_copy_only=False)
        simple = plain.copy()
        simple[plain] = letters
        split = plain & ~simple
        counts = np.ones(len(words), dtype=np.int64)
        counts[split] = np.diff(lists.offsets.to_numpy())
        order = np.empty(int(counts.sum()), dtype=np.int64)
        first = np.cumsum(counts) - counts
        order[first[simple]] = code[: int(simple.sum())]
        order[first[~plain]] = len(parts) + np.arange(len(other))
        order[np.repeat(split, counts)] = code[int(simple.sum()) :]
        return ragged(np.frombuffer(b"".join(found), dtype="<u4"), size, order), np.bincount(np.repeat(np.arange(len(words)), counts), weights=size[order], minlength=len(words)).astype(np.int64)

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, with ``end`` (packed ids) after each, and their lengths."""
        offsets, index, words = distinct_words(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
        flat, size = self._ids(words)
        last = np.frombuffer(end, dtype="<u4")
        flat, size = np.concatenate((flat, last)), np.append(size, len(last))
        counts = np.diff(offsets) + 1
        stops = np.cumsum(counts)
        order = np.full(int(counts.sum()), len(words), dtype=np.int64)
        inside = np.ones(len(order), dtype=bool)
        inside[stops - 1] = False
        order[inside] = index
        sizes = np.concatenate(([0], np.cumsum(size[order])))
        return ragged(flat, size, order), np.diff(sizes[np.concatenate(([0], stops))])


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> TextEncoder:
    return TextEncoder(vocabulary)


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece of at most ``capacity`` ids: ``doc_id``, ``start``, ``length``, ``ids``
    (packed little-endian unsigned 32-bit), ``doc_tokens``. No shuffle."""
    rows = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = rows.select("doc_id").schema.add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, tokens = _encoder(vocabulary).encode(batch.column("text"), end)
            many = -(-tokens // capacity)
            own = np.repeat(np.arange(len(tokens)), many)
            start = (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)) * capacity
            length = np.minimum(tokens[own] - start, capacity)
            # The pieces lie one after another in the ids.
            bounds = pa.py_buffer(np.concatenate(([0], 4 * np.cumsum(length))).astype(np.int32))
            data = pa.Array.from_buffers(pa.binary(), len(own), [None, bounds, pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own)), pa.array(start), pa.array(length), data, pa.array(tokens[own])], ["doc_id", "start", "length", "ids", "doc_tokens"])

    return rows.mapInArrow(run, schema)


def pack(cut: DataFrame, groups: int, capacity: int = 4096, seed: int = 7) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have ``doc_id``, ``start`` and ``length``.

    Every row is stored and moves once, to its group; keep wide columns out of ``cut``.
    Sequence ids are the group's number times 2**32 plus the sequence's number in it.
    """
    numbered = stored(cut.withColumn("_group", F.monotonically_increasing_id()), "pieces")
    grouped = numbered.withColumn("_group", F.pmod(F.xxhash64("_group", F.lit(seed)), F.lit(groups)))
    schema = cut.schema.add("sequence_id", "long").add("offset", "long")
    names = schema.fieldNames()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "length"], kind="stable", ignore_index=True)
        sizes = pdf["length"].to_numpy(dtype=np.int64)
        bins = first_fit_decreasing(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.ones(len(order), dtype=bool)
        first[1:] = bins[order][1:] != bins[order][:-1]
        before = ends - sizes[order]
        offset = np.empty(len(order), dtype=np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        pdf["sequence_id"] = (pdf["_group"].to_numpy(dtype=np.int64) << 32) + bins
        pdf["offset"] = offset
        return pdf[names]

    return grouped.groupBy("_group").applyInPandas(run, schema)


def group_count(docs: DataFrame, group_docs: int = 2048) -> int:
    return max(1, -(-docs.count() // group_docs))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096, group_docs: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece."""
    cut = pieces(docs, vocabulary, end_id, capacity, doc_id, text)
    narrow = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(narrow, group_count(docs, group_docs), capacity)


def sequences(cut: DataFrame, packed: DataFrame, pad_id: int = 0, capacity: int = 4096) -> DataFrame:
    """The padded sequences themselves: ``sequence_id`` and ``ids`` (packed), from the
    pieces with their ids and the places that :func:`pack` gave them."""
    keys = ["doc_id", "start"]
    placed = cut.join(packed.select(*keys, "sequence_id", "offset").dropDuplicates(keys), keys)
    joined = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    pad = F.unhex(F.lit(pad_id.to_bytes(4, "little").hex()))
    full = F.concat(ids, F.unhex(F.repeat(F.hex(pad), (F.lit(capacity) - F.octet_length(ids) / 4).cast("int"))))
    return joined.select("sequence_id", full.alias("ids"))


