"""Katz backoff language model over a corpus of any size.

Counts are discounted by Good-Turing up to ``K`` and the mass they give up goes,
exactly normalised, to words not seen after a context, in proportion to the
next lower order: p(w | h) = d(c) c(h w) / c(h) where h w was seen, and
alpha(h) p(w | shorter h) where not. At the lowest order the mass goes to one
unknown word. A context none of whose words has a discounted count counts once
more than it was seen, and that one is its mass. Discounts that Good-Turing
leaves outside (0, 1) are (r - 0.5) / r.

The corpus is encoded once into chunks: the documents of some ``chunk_bytes`` of
text, their distinct words as 64-bit hashes, and each token as its place among
these. For each order a chunk asks about each different (context, word) once,
however often and in however many documents it holds it, in packed arrays by
partition; a partition adds up the counts of all chunks, keeps them as its part
of the n-gram table, and answers every chunk with counts, dense ids (the contexts
of the next order) and what it needs to back off. Chunks then evaluate the
recursion for their own tokens. So what is shuffled is a few bytes for each
different n-gram of a chunk, tokens are never shuffled (the chunks are a bucketed
table), and a frequent n-gram is one row a chunk.

A context followed by so many words that its partition would stand out (more
than an eighth of a partition's share of the tokens) is spread over all
partitions, and its sums, of which there are few by that bound, go to all chunks.

Words are told apart by 64-bit hashes. ``order`` is a parameter: 2 in the
registered query. A chunk writes an array for each partition, so ``chunk_bytes`` and
``tokens_a_part`` should grow with executors' memory where a corpus has so many of
both that the arrays get short (terabytes, at the sizes given).

Defined results: a null or empty text is the end token alone; a null id trains;
repeated rows count each; without training documents every token is unknown, of
probability 1; an empty table gives an empty table; other columns are ignored;
texts of any length are scored whole (a longer one is a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, bucketed, id_text_crc, slices, stored

#: Counts up to this one are discounted.
K = 5
TABLE, REPLY, HOT = 0, 1, 2
_ANSWER = "kind int, p int, chunk bigint, parts array<binary>, stats array<bigint>, ctx bigint, low double"


def pack(values: np.ndarray, deltas: bool = False) -> bytes:
    """An integer or double array as compressed byte planes (ascending ones as differences)."""
    import zstandard

    values = np.ascontiguousarray(values)
    raw = values.view(np.uint64) if values.dtype == np.float64 else values.astype(np.uint64)
    if deltas and len(raw):
        raw = np.concatenate((raw[:1], np.diff(raw)))
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used and not planes[used - 1].any():
        used -= 1
    return len(raw).to_bytes(8, "little") + bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def unpack(data: bytes, deltas: bool = False, dtype: type = np.int64) -> np.ndarray:
    import zstandard

    n, used = int.from_bytes(data[:8], "little"), data[8]
    planes = np.zeros((8, n), dtype=np.uint8)
    planes[:used] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=max(1, n * used)), dtype=np.uint8).reshape(used, n)
    raw = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    if deltas:
        raw = np.cumsum(raw, dtype=np.uint64)
    return raw.view(dtype)


def pack_codes(values: np.ndarray) -> list[bytes]:
    """Doubles of few different values: these, and which one each is."""
    distinct, code = np.unique(values, return_inverse=True)
    return [pack(distinct), pack(code)]


def unpack_codes(distinct: bytes, code: bytes) -> np.ndarray:
    return unpack(distinct, dtype=np.float64)[unpack(code)]


def discounts(n: list[int]) -> np.ndarray:
    """d(0) .. d(K) from how many n-grams were seen 1 .. K + 1 times (d(0) isn't used)."""
    d = np.zeros(K + 1)
    for r in range(1, K + 1):
        d[r] = (r - 0.5) / r
        if n[0] and n[r - 1]:
            rest = (K + 1) * n[K] / n[0]
            found = ((r + 1) * n[r] / n[r - 1] / r - rest) / (1 - rest) if rest != 1 else 0
            if 0 < found < 1:
                d[r] = found
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(counts > K, counts, d[np.minimum(counts, K)] * counts)


@dataclass
class Level:
    """What the driver knows of one order: bounded by the number of partitions."""

    d: np.ndarray  # discounts
    first_id: np.ndarray  # by partition
    ids: int  # how many; also the id of the context at a text's start
    seen: int  # different n-grams in training texts
    total: int  # n-grams in training texts
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # ids that are spread as contexts
    hot_counts: np.ndarray = field(default_factory=lambda: np.zeros((0, K), dtype=np.int64))  # of the next order: by context of the level below
    hot_low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hot_ctx: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    unknown: float = 1.0  # at the lowest order
    base: float = 1.0  # what a count is divided by at the lowest order


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads ids over 64 bits."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _cuts(part: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition begins in an array ordered by partition; its length last."""
    return np.searchsorted(part, np.arange(parts + 1))


def encode(docs: DataFrame, held: Column, chunk_bytes: int, doc_id: str, text: str) -> DataFrame:
    """The chunks, as a bucketed external table in the shared folder."""
    rows = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), (~held).alias("train"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"chunk bigint, doc_ids array<{kind}>, lengths binary, train binary, tokens binary, words binary, counts binary, n_train bigint, docs_train bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        first = TaskContext.get().partitionId() << 24
        for k, batch in enumerate(slices(batches, "text", chunk_bytes)):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
            flat = lists.flatten()
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            coded = flat.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            there = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
            there = there[code] if len(code) else np.zeros(0, dtype=bool)
            code, of = code[there], of[there]
            # The end token's name has a space, which no word has.
            hashes = np.array([*map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), xxhash.xxh64_intdigest(b" end")], dtype=np.uint64)
            words, place = np.unique(hashes, return_inverse=True)
            used = np.zeros(len(words), dtype=bool)
            used[place[code]] = used[place[-1]] = True
            place, words = (np.cumsum(used) - 1)[place], words[used]
            lengths = np.bincount(of, minlength=len(lists)) + 1
            ends = np.cumsum(lengths) - 1
            tokens = np.full(int(lengths.sum()), place[-1], dtype=np.int64)
            inside = np.ones(len(tokens), dtype=bool)
            inside[ends] = False
            tokens[inside] = place[code]
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            trains = np.repeat(train, lengths)
            counts = np.bincount(tokens[trains], minlength=len(words))
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + k]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in (pack(lengths), pack(train), pack(tokens), pack(words, True), pack(counts))),
                    pa.array([int(trains.sum())]), pa.array([int(train.sum())]),
                ],
                ["chunk", "doc_ids", "lengths", "train", "tokens", "words", "counts", "n_train", "docs_train"],
            )

    spark = docs.sparkSession
    chunks = rows.mapInArrow(run, schema)
    # With fewer buckets than shuffle partitions, joins would shuffle the chunks after all.
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, rows.rdd.getNumPartitions()))
    return bucketed(chunks, "chunks", buckets, "chunk")


def _answer(kind: int, p: int, chunk: int = -1, parts: list[bytes] | None = None, stats: list[int] | None = None, ctx: int = -1, low: float = 0.0) -> dict:
    return {"kind": kind, "p": p, "chunk": chunk, "parts": parts or [], "stats": stats or [], "ctx": ctx, "low": low}


def _frame(answers: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(answers, columns=["kind", "p", "chunk", "parts", "stats", "ctx", "low"])


def _counted(counts: np.ndarray) -> list[int]:
    """How many were seen 1 .. K + 1 times."""
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2].tolist()


def _hot(counts: np.ndarray, threshold: float) -> list[int]:
    """Places and counts of the contexts to spread, one after the other."""
    at = np.flatnonzero(counts > threshold)
    return np.column_stack((at, counts[at])).ravel().tolist()


def _merge_words(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Order 1 in one partition: adds up the counts of each word and answers every chunk."""
    pdf = pdf.sort_values("chunk")
    p = int(pdf["p"].iloc[0])
    keys = [unpack(x[0], True, np.uint64) for x in pdf["parts"]]
    words, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([unpack(x[1]) for x in pdf["parts"]]), minlength=len(words)).astype(np.int64)
    seen = counts > 0
    out = [_answer(TABLE, p, parts=[pack(words[seen], True), pack(counts[seen])], stats=[len(words), int(seen.sum()), int(counts.sum()), *_counted(counts), *_hot(counts, threshold)])]
    at = 0
    for chunk, k in zip(pdf["chunk"].tolist(), keys, strict=True):
        own = inverse[at : at + len(k)]
        at += len(k)
        out.append(_answer(REPLY, p, chunk, [pack(counts[own]), pack(own, True)]))
    return _frame(out)


def _merge_pairs(pdf: pd.DataFrame, threshold: float, hot: np.ndarray, last: bool) -> pd.DataFrame:
    """A higher order in one partition: counts by (context, word) and sums by context.
    At the last order nobody asks for ids."""
    pdf = pdf.sort_values("chunk")
    p = int(pdf["p"].iloc[0])
    ctx = [np.repeat(unpack(x[0], True), unpack(x[1])) for x in pdf["parts"]]
    sizes = [len(c) for c in ctx]
    contexts, place = np.unique(np.concatenate(ctx), return_inverse=True)
    word = np.concatenate([unpack(x[2]) for x in pdf["parts"]])
    pairs, first, inverse = np.unique((place.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), return_index=True, return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([unpack(x[3]) for x in pdf["parts"]]), minlength=len(pairs)).astype(np.int64)
    low = np.concatenate([unpack_codes(x[4], x[5]) for x in pdf["parts"]])[first]
    of = (pairs >> np.uint64(32)).astype(np.int64)
    seen = counts > 0
    below = np.bincount(of[seen], weights=low[seen], minlength=len(contexts))
    few = np.zeros((len(contexts), K), dtype=np.int64)
    small = seen & (counts <= K)
    np.add.at(few, (of[small], counts[small] - 1), 1)
    own = np.bincount(of[seen], minlength=len(contexts))
    stats = [len(pairs), int(seen.sum()), int(counts.sum()), *_counted(counts), *_hot(counts, threshold)]
    table = [pack(contexts[own > 0], True), pack(own[own > 0]), pack((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)[seen]), pack(counts[seen])]
    out = [_answer(TABLE, p, parts=table, stats=stats)]
    spread = np.isin(contexts, hot)
    for i in np.flatnonzero(spread & (own > 0)).tolist():
        out.append(_answer(HOT, p, stats=few[i].tolist(), ctx=int(contexts[i]), low=float(below[i])))
    stiff = ~few.any(axis=1)
    at = 0
    for chunk, n in zip(pdf["chunk"].tolist(), sizes, strict=True):
        mine, met = inverse[at : at + n], place[at : at + n]
        at += n
        asked = met[np.flatnonzero(np.diff(met, prepend=-1))]  # contexts of this chunk, in order
        lacks = np.zeros(len(contexts), dtype=bool)
        lacks[met[counts[mine] == 0]] = True
        back = asked[lacks[asked] & ~spread[asked]]
        out.append(_answer(REPLY, p, chunk, [pack(counts[mine]), b"" if last else pack(mine), pack(stiff[asked]), pack(lacks[asked] & ~spread[asked]), *(pack(few[back, r]) for r in range(K)), pack(below[back])]))
    return _frame(out)


@dataclass
class Walk:
    """Probabilities of a chunk's tokens at the highest order walked so far, and what the next one needs."""

    lengths: np.ndarray
    tokens: np.ndarray  # as places among the chunk's words
    word: np.ndarray  # global word id of each token
    count: np.ndarray  # of the highest order's n-gram that ends at each token
    gram: np.ndarray  # its id
    p: np.ndarray
    word_counts: np.ndarray

    def contexts(self, start_id: int, start_count: int) -> tuple[np.ndarray, np.ndarray]:
        """Id and count of the n-gram before each token."""
        starts = np.cumsum(self.lengths) - self.lengths
        ctx, count = np.empty_like(self.gram), np.empty_like(self.count)
        ctx[1:], count[1:] = self.gram[:-1], self.count[:-1]
        ctx[starts], count[starts] = start_id, start_count
        return ctx, count


@dataclass
class Asked:
    """A chunk's different (context, word) pairs, by partition, context and word."""

    ctx: np.ndarray
    word: np.ndarray
    inverse: np.ndarray  # of each token
    part: np.ndarray


def ask(ctx: np.ndarray, word: np.ndarray, hot: np.ndarray, parts: int) -> Asked:
    contexts, place = np.unique(ctx, return_inverse=True)
    pairs, inverse = np.unique((place.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), return_inverse=True)
    of, w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    h = _mix(contexts)[of]
    spread = np.isin(contexts, hot)[of]
    h = np.where(spread, _mix(h ^ w.astype(np.uint64)), h)
    part = _part(h, parts)
    order = np.argsort(part, kind="stable")
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return Asked(contexts[of[order]], w[order], back[inverse], part[order])


def _first_walk(row: dict, replies: list, level: Level) -> Walk:
    lengths, tokens = unpack(row["lengths"]), unpack(row["tokens"])
    counts = np.concatenate([unpack(r["parts"][0]) for r in replies])
    ids = np.concatenate([unpack(r["parts"][1], True) + level.first_id[r["p"]] for r in replies])
    p = np.where(counts > 0, discounted(counts, level.d) / level.base, level.unknown)
    return Walk(lengths, tokens, ids[tokens], counts[tokens], ids[tokens], p[tokens], counts)


def _next_walk(walk: Walk, replies: list, below: Level, level: Level, start_count: int, parts: int) -> Walk:
    """One order up: p(w | h) from the partitions' answers and the probabilities one order down."""
    ctx, seen_ctx = walk.contexts(below.ids, start_count)
    asked = ask(ctx, walk.word, below.hot, parts)
    n = len(asked.ctx)
    counts = np.concatenate([unpack(r["parts"][0]) for r in replies])
    ids = np.concatenate([unpack(r["parts"][1]) + level.first_id[r["p"]] if r["parts"][1] else np.zeros(0, dtype=np.int64) for r in replies])
    ids = ids if len(ids) else np.zeros(n, dtype=np.int64)
    first = np.ones(n, dtype=bool)
    first[1:] = (asked.ctx[1:] != asked.ctx[:-1]) | (asked.part[1:] != asked.part[:-1])
    of = np.cumsum(first) - 1
    stiff = np.concatenate([unpack(r["parts"][2]) for r in replies]).astype(bool)
    has = np.concatenate([unpack(r["parts"][3]) for r in replies]).astype(bool)
    few = np.zeros((len(stiff), K))
    for r in range(K):
        few[has, r] = np.concatenate([unpack(x["parts"][4 + r]) for x in replies])
    low_sum = np.zeros(len(stiff))
    low_sum[has] = np.concatenate([unpack(x["parts"][4 + K], dtype=np.float64) for x in replies])
    mine = asked.ctx[first]
    if len(level.hot_ctx):
        at = np.minimum(np.searchsorted(level.hot_ctx, mine), len(level.hot_ctx) - 1)
        known = level.hot_ctx[at] == mine
        few[known], low_sum[known] = level.hot_counts[at[known]], level.hot_low[at[known]]
        stiff[known] = ~few[known].any(axis=1)
    before = np.zeros(n)
    before[asked.inverse] = seen_ctx
    low = np.zeros(n)
    low[asked.inverse] = walk.p
    with np.errstate(divide="ignore", invalid="ignore"):
        freed = (few * (1 - level.d[1:]) * np.arange(1, K + 1)).sum(axis=1)[of]
        base = np.where(stiff[of], before + 1, before)
        mass = np.where(stiff[of], 1, freed) / base
        p = np.where(counts > 0, discounted(counts, level.d) / base, np.where(before > 0, mass / (1 - low_sum[of]) * low, low))
    return Walk(walk.lengths, walk.tokens, walk.word, counts[asked.inverse], ids[asked.inverse], p[asked.inverse], walk.word_counts)


class KatzModel:
    """Counts of every order for the chunks of one corpus, in partitioned tables."""

    def __init__(self, docs: DataFrame, held: Column, order: int = 2, chunk_bytes: int = 8 << 20, tokens_a_part: int = 2_000_000, least_parts: int = 64, doc_id: str = "doc_id", text: str = "text"):
        self.chunks = encode(docs, held, chunk_bytes, doc_id, text)
        self.kind = self.chunks.schema["doc_ids"].dataType.elementType.simpleString()
        n, d = self.chunks.agg(F.sum("n_train"), F.sum("docs_train")).first()
        self.n_train, self.docs_train = n or 0, d or 0
        self.parts = max(least_parts, self.n_train // tokens_a_part)
        self.threshold = self.n_train / (8 * self.parts)
        self.levels: list[Level] = []
        self.tables: list[DataFrame] = []
        self._words()
        for n in range(1, order):
            self._pairs(last=n == order - 1)

    def _keep(self, requests: DataFrame, merge, tag: str) -> DataFrame:  # noqa: ANN001
        # One task a partition of the table, however many partitions shuffles have in this session.
        dealt = requests.repartitionById(self.parts, "p")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [f for f in frames if len(f)]
            if held:
                yield merge(pd.concat(held, ignore_index=True))

        answers = stored(dealt.mapInPandas(run, _ANSWER), tag, "kind")
        self.tables.append(answers)
        return answers

    def _level(self, answers: DataFrame) -> Level:
        """One row a partition is collected."""
        rows = sorted(answers.where(F.col("kind") == TABLE).select("p", "stats").collect())
        ids = np.zeros(self.parts, dtype=np.int64)
        sums, hot = np.zeros(K + 3, dtype=np.int64), []
        for p, stats in rows:
            ids[p] = stats[0]
            sums += np.array(stats[1 : K + 4])
        first = np.cumsum(ids) - ids
        for p, stats in rows:
            hot += [first[p] + at for at in stats[K + 4 :: 2]]
        total = int(ids.sum())
        if self.docs_train > self.threshold:
            hot.append(total)
        return Level(discounts(sums[2:].tolist()), first, total, int(sums[0]), int(sums[1]), np.array(sorted(hot), dtype=np.int64))

    def _words(self) -> None:
        parts, threshold = self.parts, self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    words, counts = unpack(row["words"], True, np.uint64), unpack(row["counts"])
                    cuts = _cuts(_part(words, parts), parts)
                    cells = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i for i, _, _ in cells], pa.int32()), pa.array([row["chunk"]] * len(cells), pa.int64()), pa.array([[pack(words[a:b], True), pack(counts[a:b])] for _, a, b in cells], pa.list_(pa.binary()))],
                        ["p", "chunk", "parts"],
                    )

        requests = self.chunks.select("chunk", "words", "counts").mapInArrow(run, "p int, chunk bigint, parts array<binary>")
        level = self._level(self._keep(requests, lambda pdf: _merge_words(pdf, threshold), "words"))
        freed = 0.0
        if level.total:
            n = self.tables[0].where(F.col("kind") == TABLE).select(*(F.sum(F.get("stats", F.lit(3 + r))).alias(str(r)) for r in range(K))).first()
            freed = float(sum((1 - level.d[r]) * r * (n[r - 1] or 0) for r in range(1, K + 1)))
        level.base = level.total if freed else level.total + 1
        level.unknown = (freed or 1.0) / level.base
        self.levels.append(level)

    def _walked(self, run, schema: str) -> DataFrame:  # noqa: ANN001
        """``run(row, walk)`` over all chunks, walked up to the orders that are known."""
        rows = self.chunks.select("chunk", "doc_ids", "lengths", "train", "tokens")
        for k, answers in enumerate(self.tables):
            mine = answers.where(F.col("kind") == REPLY).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("p", "parts"))).alias(f"replies{k}"))
            rows = rows.join(mine.hint("shuffle_hash"), "chunk")
        levels, starts, parts = self.levels, self.docs_train, self.parts

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    row = {c: one.column(c)[0].as_py() for c in one.schema.names if c != "doc_ids"}
                    walk = _first_walk(row, row["replies0"], levels[0])
                    for k in range(1, len(levels)):
                        walk = _next_walk(walk, row[f"replies{k}"], levels[k - 1], levels[k], starts, parts)
                    out = run(one, row, walk)
                    del row, walk, one
                    yield out
                    pa.default_memory_pool().release_unused()

        return rows.mapInArrow(each, schema)

    def _pairs(self, last: bool) -> None:
        below, starts, parts, threshold = self.levels[-1], self.docs_train, self.parts, self.threshold

        def run(one: pa.RecordBatch, row: dict, walk: Walk) -> pa.RecordBatch:
            ctx, _ = walk.contexts(below.ids, starts)
            asked = ask(ctx, walk.word, below.hot, parts)
            trains = np.repeat(unpack(row["train"]), walk.lengths)
            counts = np.bincount(asked.inverse, weights=trains, minlength=len(asked.ctx)).astype(np.int64)
            low = np.zeros(len(asked.ctx))
            low[asked.inverse] = walk.p
            cuts = _cuts(asked.part, parts)
            cells, blobs = [], []
            for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if a < b:
                    begins = np.flatnonzero(np.diff(asked.ctx[a:b], prepend=-1))
                    runs = np.diff(begins, append=b - a)
                    cells.append(i)
                    blobs.append([pack(asked.ctx[a:b][begins], True), pack(runs), pack(asked.word[a:b]), pack(counts[a:b]), *pack_codes(low[a:b])])
            return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([row["chunk"]] * len(cells), pa.int64()), pa.array(blobs, pa.list_(pa.binary()))], ["p", "chunk", "parts"])

        hot = below.hot
        requests = self._walked(run, "p int, chunk bigint, parts array<binary>")
        answers = self._keep(requests, lambda pdf: _merge_pairs(pdf, threshold, hot, last), "pairs")
        level = self._level(answers)
        # At most one row for each spread context, of which there are fewer than 8 a partition.
        sums = answers.where(F.col("kind") == HOT).groupBy("ctx").agg(
            *(F.sum(F.get("stats", F.lit(r))).alias(f"n{r}") for r in range(K)),
            F.aggregate(F.sort_array(F.collect_list(F.struct("p", "low"))), F.lit(0.0), lambda s, x: s + x["low"]).alias("low"),
        )
        rows = sorted(sums.collect())
        level.hot_ctx = np.array([r["ctx"] for r in rows], dtype=np.int64)
        level.hot_counts = np.array([[r[f"n{i}"] for i in range(K)] for r in rows], dtype=np.int64).reshape(-1, K)
        level.hot_low = np.array([r["low"] for r in rows])
        self.levels.append(level)

    def scores(self) -> DataFrame:
        """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
        n, v = self.levels[0].total, self.levels[0].seen

        def run(one: pa.RecordBatch, row: dict, walk: Walk) -> pa.RecordBatch:
            starts = np.cumsum(walk.lengths) - walk.lengths
            add = lambda x: np.add.reduceat(x, starts)
            base = np.log10((walk.word_counts + 1) / (n + v + 1))
            known = (walk.word_counts > 0).astype(np.int64)
            ids = one.column("doc_ids").flatten()
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(walk.lengths), pa.array(add(known[walk.tokens])), pa.array(np.full(len(ids), n)), pa.array(add(base[walk.tokens])), pa.array(add(np.log10(walk.p)))],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        return self._walked(run, f"doc_id {self.kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return id_text_crc(F.col(doc_id)) % 7 == 2


def score_documents(docs: DataFrame, order: int = 2, doc_id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """Trains on the documents that aren't held out and scores all of them."""
    scored = KatzModel(docs, held_out(doc_id), order, doc_id=doc_id, text=text, **sizes).scores()
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
