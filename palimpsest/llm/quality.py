"""Quality rules by labelling lines with a linear-chain conditional random field.

Every line with a word gets features of its shape (length, shares of capitals,
symbols, bars, repeated words, how it ends, whether it repeats an earlier line).
Viterbi decoding of a two-label chain marks each line as content or boilerplate,
and the share of words in content lines decides whether a document is kept.

The chain is fitted to a bounded sample of quality-labelled documents. These are
labelled as wholes, so their lines' labels are learned: they begin as their
document's, and then turn to what the chain says, as long as most words of a good
document are content and most of a bad one boilerplate. What changes between lines
looks like is learned from chains spliced of stretches of good and bad documents.

Word and line statistics of whole texts come from arrays over the distinct words
of a batch. No shuffle; the longest text is one task's work at most.

Defined results: a null or empty text, or one of white space, has no words and
fails the base rules; without labels of both kinds every line is content and the
base rules alone decide; a document with several labels counts by its lowest;
repeated rows are judged each; null ids are judged like others and never
labelled; an empty table gives an empty table; other columns are ignored by
:func:`judge` and kept by :func:`good_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, give_back, labelled_texts, one_array, slices

#: The characters that the base rules count as symbols.
SYMBOLS = "[#*$%&|<>]"
FEATURES = ("bias", "one word", "up to 4", "up to 9", "40 and more", "some bars", "many bars", "some symbols", "many symbols", "many capitals", "shouts", "some repeats", "many repeats", "ends a sentence", "begins with a capital", "many digits", "short words", "long words", "repeats a line")


def _runs(index: np.ndarray, n: int) -> np.ndarray:
    """How many of each 0 .. n-1, as int64."""
    return np.bincount(index, minlength=n).astype(np.int64)


@dataclass
class Shapes:
    """Words, lines and documents of a batch as arrays."""

    n_docs: int
    line_doc: np.ndarray  # of lines with a word
    features: np.ndarray  # a row for each of these
    line_words: np.ndarray
    counts: dict[str, np.ndarray]  # by document


def shapes(texts: pa.Array) -> Shapes:
    texts = pc.fill_null(texts, "")
    n_docs = len(texts)
    split = pc.split_pattern(texts, "\n")
    lines = split.flatten()
    doc_of_line = np.repeat(np.arange(n_docs), np.diff(split.offsets.to_numpy()))
    parts = pc.ascii_split_whitespace(lines)
    words = parts.flatten()
    line_of_word = np.repeat(np.arange(len(lines)), np.diff(parts.offsets.to_numpy()))
    coded = words.dictionary_encode()
    code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    there = pc.greater(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, dtype=bool)
    code, line_of_word = code[there], line_of_word[there]
    of = lambda a, kind: a.to_numpy(zero_copy_only=False).astype(kind)
    chars = of(pc.utf8_length(distinct), np.int64)[code]
    symbols = of(pc.count_substring_regex(distinct, SYMBOLS), np.int64)[code]
    bar = of(pc.equal(distinct, "|"), bool)[code]
    capital = of(pc.utf8_is_upper(distinct), bool)[code] & (chars > 1)
    shout = of(pc.ends_with(distinct, "!!"), bool)[code]
    digit = of(pc.match_substring_regex(distinct, "[0-9]"), bool)[code]
    ends = of(pc.match_substring_regex(distinct, r"[\pL\pN)\]\"”»][.?!…:]$"), bool)[code]
    title = of(pc.match_substring_regex(distinct, r"^\p{Lu}\P{Lu}*$"), bool)[code]
    doc_of_word = doc_of_line[line_of_word]

    # Words in three-word windows found twice or more in their text.
    n = len(code)
    repeated = np.zeros(n, dtype=bool)
    if n > 2:
        same = doc_of_word[2:] == doc_of_word[:-2]
        c = code.astype(np.int64)
        pair = np.unique((c[:-1] << 32) | c[1:], return_inverse=True)[1].astype(np.int64)
        triple = np.unique((pair[:-1] << 32) | c[2:], return_inverse=True)[1].astype(np.int64)
        at = np.flatnonzero(same)
        _, inverse, times = np.unique((doc_of_word[at] << 32) | triple[at], return_inverse=True, return_counts=True)
        twice = at[times[inverse] > 1]
        for d in range(3):
            repeated[twice + d] = True

    words_of_line = _runs(line_of_word, len(lines))
    held = words_of_line > 0
    line_code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False)[held].astype(np.int64)
    line_doc, line_words = doc_of_line[held], words_of_line[held]
    first = np.unique((line_doc << 32) | line_code, return_index=True)[1]
    again = np.ones(len(line_doc), dtype=bool)
    again[first] = False

    rank = np.cumsum(held) - 1
    own = rank[line_of_word]
    m = len(line_doc)
    total = lambda x: np.bincount(own, weights=x, minlength=m)
    share = lambda x: total(x) / np.maximum(line_words, 1)
    start = np.cumsum(line_words) - line_words
    echo = np.zeros(n, dtype=bool)
    echo[1:] = (code[1:] == code[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    bars, odd, caps, shouts, echoes, digits = share(bar), share(symbols > 0), share(capital), share(shout), share(echo), share(digit)
    mean = share(chars)
    last = start + line_words - 1
    at = lambda x, i: x[i] if n else np.zeros(0, dtype=bool)
    features = np.column_stack(
        (
            np.ones(m), line_words == 1, line_words <= 4, line_words <= 9, line_words >= 40, bars > 0.1, bars > 0.3, odd > 0.1, odd > 0.3, caps > 0.5, shouts > 0.3,
            echoes > 0.1, echoes > 0.4, at(ends, last), at(title, start), digits > 0.3, mean < 3, mean > 10, again,
        )
    ).astype(np.float64)
    counts = {
        "n_words": _runs(doc_of_word, n_docs),
        "word_chars": np.bincount(doc_of_word, weights=chars, minlength=n_docs).astype(np.int64),
        "n_symbols": np.bincount(doc_of_word, weights=symbols, minlength=n_docs).astype(np.int64),
        "n_dup_lines": _runs(line_doc[again], n_docs),
        "n_repeat_words": np.bincount(doc_of_word, weights=repeated, minlength=n_docs).astype(np.int64),
    }
    return Shapes(n_docs, line_doc, features, line_words, counts)


@dataclass
class Chain:
    """Weights of the two-label chain: label 0 is boilerplate, 1 content."""

    emit: np.ndarray  # features x 2
    move: np.ndarray  # from x to

    @classmethod
    def all_content(cls) -> Chain:
        emit = np.zeros((len(FEATURES), 2))
        emit[0, 1] = 1
        return cls(emit, np.zeros((2, 2)))


def _steps(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each position along the chains: the chains that reach it, longest first, and their rows."""
    order = np.argsort(-lengths, kind="stable")
    starts = np.cumsum(lengths) - lengths
    sorted_ = -lengths[order]
    for t in range(int(lengths.max(initial=0))):
        live = order[: np.searchsorted(sorted_, -t, side="left")]
        yield live, starts[live] + t


def viterbi(chain: Chain, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels of chains that lie one after another (all of length 1 at least)."""
    emit = features @ chain.emit
    best = np.zeros((len(lengths), 2))
    back = np.zeros((len(features), 2), dtype=np.int8)
    rows_at = []
    for t, (live, rows) in enumerate(_steps(lengths)):
        if t:
            reach = best[live][:, :, None] + chain.move
            back[rows] = reach.argmax(axis=1)
            best[live] = reach.max(axis=1)
        best[live] += emit[rows]
        rows_at.append((live, rows))
    labels = np.zeros(len(features), dtype=np.int8)
    now = best.argmax(axis=1).astype(np.int8)
    for live, rows in reversed(rows_at):
        labels[rows] = now[live]
        now[live] = back[rows, now[live]]
    return labels


def fit_chain(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = 150, penalty: float = 1.0, start: Chain | None = None) -> Chain:
    """Maximum likelihood by gradient ascent with forward and backward sums (chains of length 1 at least)."""
    n, steps = len(features), list(_steps(lengths))
    width = features.shape[1]
    theta = np.zeros(2 * width + 4) if start is None else np.concatenate((start.emit.ravel(), start.move.ravel()))
    seen = np.zeros((n, 2))
    seen[np.arange(n), labels] = 1
    inner = np.ones(n, dtype=bool)
    inner[np.cumsum(lengths) - lengths] = False  # rows that have one before them
    later = np.flatnonzero(inner)
    moved = np.zeros((2, 2))
    np.add.at(moved, (labels[later - 1], labels[later]), 1)
    told = np.concatenate(((features.T @ seen).ravel(), moved.ravel()))
    scale, mean, square = max(1, len(lengths)), np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        emit, move = features @ theta[: 2 * width].reshape(width, 2), theta[2 * width :].reshape(2, 2)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        for t, (_, rows) in enumerate(steps):
            ahead[rows] = emit[rows] + (np.logaddexp.reduce(ahead[rows - 1][:, :, None] + move, axis=1) if t else 0)
        for t in range(len(steps) - 1, 0, -1):
            rows = steps[t][1]
            behind[rows - 1] = np.logaddexp.reduce(move + (emit[rows] + behind[rows])[:, None, :], axis=2)
        one = ahead + behind
        one = np.exp(one - np.logaddexp.reduce(one, axis=1)[:, None])
        two = ahead[later - 1][:, :, None] + move + (emit[later] + behind[later])[:, None, :]
        two = np.exp(two - np.logaddexp.reduce(two.reshape(-1, 4), axis=1)[:, None, None])
        gradient = (told - np.concatenate(((features.T @ one).ravel(), two.sum(axis=0).ravel())) - penalty * theta) / scale
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta + 0.2 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return Chain(theta[: 2 * width].reshape(width, 2), theta[2 * width :].reshape(2, 2))


def spliced(found: Shapes, good: np.ndarray, many: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``found``, lengths, labels) of ``many`` chains of two to five stretches, of good and bad documents in turn."""
    rng = np.random.default_rng(seed)
    lengths = _runs(found.line_doc, found.n_docs)
    starts = np.cumsum(lengths) - lengths
    docs = [np.flatnonzero((lengths > 0) & (good == kind)) for kind in (False, True)]
    rows, sizes, labels = [], [], []
    for _ in range(many if len(docs[0]) and len(docs[1]) else 0):
        kind, n = int(rng.integers(2)), 0
        for _ in range(int(rng.integers(2, 6))):
            doc = docs[kind][rng.integers(len(docs[kind]))]
            at = int(rng.integers(lengths[doc]))
            stop = min(int(lengths[doc]), at + int(rng.geometric(0.25)))
            rows.append(np.arange(starts[doc] + at, starts[doc] + stop))
            labels.append(np.full(stop - at, kind))
            n, kind = n + stop - at, 1 - kind
        sizes.append(n)
    whole = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)
    return whole(rows), np.array(sizes, dtype=np.int64), whole(labels)


def pieces(lengths: np.ndarray, most: int = 100) -> np.ndarray:
    """The lengths of chains cut into pieces of ``most`` lines and a rest."""
    return np.concatenate([np.diff([*range(0, n, most), n]) for n in lengths.tolist()]) if len(lengths) else lengths


def agreeing(labels: np.ndarray, found: Shapes, good: np.ndarray) -> np.ndarray:
    """``labels`` of lines, but the document's own where they would make most of its words the other kind."""
    words = np.bincount(found.line_doc, weights=found.line_words, minlength=found.n_docs)
    content = np.bincount(found.line_doc, weights=found.line_words * labels, minlength=found.n_docs)
    against = (2 * content > words) != good
    return np.where(against[found.line_doc], good[found.line_doc], labels).astype(np.int64)


def fit_lines(found: Shapes, good: np.ndarray, turns: int = 3) -> Chain:
    """A chain fitted to documents of which only the kind is known, good or not."""
    lengths = _runs(found.line_doc, found.n_docs)
    rows, sizes, known = spliced(found, good, found.n_docs)
    features = np.concatenate((found.features, found.features[rows]))
    chains = np.concatenate((pieces(lengths[lengths > 0]), pieces(sizes)))
    labels, chain = good[found.line_doc].astype(np.int64), None
    for turn in range(turns):
        chain = fit_chain(features, chains, np.concatenate((labels, known)), rounds=60 if turn else 150, start=chain)
        labels = agreeing(viterbi(chain, found.features, lengths[lengths > 0]), found, good)
    return chain


def content_share(chain: Chain, found: Shapes) -> np.ndarray:
    """The share of each document's words that lie in content lines (1 without words)."""
    lengths = _runs(found.line_doc, found.n_docs)
    labels = viterbi(chain, found.features, lengths[lengths > 0])
    content = np.bincount(found.line_doc, weights=found.line_words * labels, minlength=found.n_docs)
    words = found.counts["n_words"]
    return np.where(words > 0, content / np.maximum(words, 1), 1)


def verdict(chain: Chain, found: Shapes, least_share: float, least_words: int = 50, most_repeats: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of each document."""
    n = found.counts["n_words"]
    failed = (n < least_words) | (100 * found.counts["n_repeat_words"] > most_repeats * n)
    return failed, ~failed & (content_share(chain, found) >= least_share)


def fit(docs: DataFrame, labels: DataFrame, most: int = 1000, doc_id: str = "doc_id", text: str = "text") -> Chain:
    """A chain from ``most`` labelled documents of either kind at most, the first by a hash of the id."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    first = lambda good: marks.where((F.col("quality") == 1) == F.lit(good)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = first(True).union(first(False)).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    got = labelled_texts(docs, sample, doc_id, text)
    good = np.asarray(got["label"].to_pylist(), dtype=np.int64) == 1
    if not good.any() or good.all():
        return Chain.all_content()
    chain = fit_lines(shapes(one_array(got["text"])), good)
    del got
    give_back()
    return chain


def judge(docs: DataFrame, chain: Chain, least_share: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and ``kept`` per row."""
    rows = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = rows.select("doc_id").schema
    for c in names:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found = shapes(batch.column("text"))
            marks = verdict(chain, found, least_share)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found.counts[c]) for c in names), *map(pa.array, marks)], ["doc_id", *names, "base_failed", "kept"])

    return rows.mapInArrow(run, schema)


def good_documents(docs: DataFrame, chain: Chain, least_share: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, whole and in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            yield batch.filter(pa.array(verdict(chain, shapes(batch.column(text)), least_share)[1]))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
