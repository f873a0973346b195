"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labelled documents: words, and stems that begin many
words, that are far more common in toxic documents than in others. A trie of its
terms is intersected with the automaton of words within an edit (a letter
changed, added or missing, anywhere, or two neighbours swapped), as one
deterministic automaton whose states are built when first needed, so a word is
matched in one pass that ends at the first letter no term can follow. A term of
three letters or fewer matches exactly, a longer one within one edit; a stem needs a
letter more. Words within an edit that clean
labelled documents use are let pass, and a term of four letters that such a word is
close to matches exactly alone.

A hit counts by its context: within a quotation (an opening mark and the next
closing one) whose marks lie in a window of words around it, or of any length if a
word of saying stands near, it is a mention rather than abuse and weakens. A
logistic curve over the weighted hits, fitted to the same labelled documents, gives
the score.

Labels are read only where crc32 of the id (as text) modulo 5 is not 0, and of
those at most ``most_toxic`` toxic and ``most_clean`` other rows, the first by a
hash of the id: the model's sample is bounded, everything scored is whole.

Defined results: a null or empty text, or one without hits, has the score of no
evidence; no labels, or none of one kind, give the empty lexicon and one score
below 0.5 for all; a document with several labels is toxic if any says so; null
labels count as none; repeated rows are scored each; a null id is not held out;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Memo, bounded_batches, distinct_words, give_back, id_text_crc, labelled_texts, one_array, slices

NONE, EXACT, CLOSE = 0, 1, 2
QUOTES = frozenset("\"“”„«»‹›")
SAYING = frozenset("said says wrote writes quote quoted quotes called word term sagte schrieb zitat nannte wort dit écrit cité mot dijo escribió cita palabra".split())
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def bare(word: str) -> str:
    """A lower-case word without what surrounds its letters."""
    return word if word.isalpha() else _EDGES.sub("", word)


def edits_for(entry: str, stem: bool = False) -> int:
    """How many edits an entry of the lexicon allows."""
    return int(len(entry) - stem >= 4)


class LexiconAutomaton:
    """The words within the edits that a term allows, or that begin so with a stem.

    A state is a set of (trie node, edits made, letter owed): of two swapped letters the
    term's first one is owed when its second has been read. States are forgotten
    when there are more than ``most``.
    """

    def __init__(self, terms: list[str], stems: list[str], exact: frozenset[str] = frozenset(), most: int = 100_000):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.stems: dict[int, int] = {}
        self.allowed = [0]  # the most edits of any entry through a node
        self.most = most
        for marks, entries in ((self.ends, terms), (self.stems, stems)):
            for entry in entries:
                edits = 0 if entry in exact else edits_for(entry, marks is self.stems)
                at = 0
                self.allowed[0] = max(self.allowed[0], edits)
                for c in entry:
                    if c not in self.children[at]:
                        self.children[at][c] = len(self.children)
                        self.children.append({})
                        self.allowed.append(0)
                    at = self.children[at][c]
                    self.allowed[at] = max(self.allowed[at], edits)
                marks[at] = edits
        self._restart()

    def _restart(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.at_end: list[int] = []
        self.begun: list[int] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, reached: set[tuple[int, int, str]]) -> int:
        # Letters of a term may also be missing in the word.
        todo = list(reached)
        while todo:
            node, made, owed = todo.pop()
            for child in () if owed else self.children[node].values():
                if made < self.allowed[child] and (child, made + 1, "") not in reached:
                    reached.add((child, made + 1, ""))
                    todo.append((child, made + 1, ""))
        fewest: dict[tuple[int, str], int] = {}
        for node, made, owed in reached:
            fewest[node, owed] = min(made, fewest.get((node, owed), made))
        members = frozenset((node, made, owed) for (node, owed), made in fewest.items())
        number = self.numbers.get(members)
        if number is None:
            number = self.numbers[members] = len(self.sets)
            self.sets.append(members)
            self.steps.append({})
            kind = lambda marks: min((EXACT if e == 0 else CLOSE for n, e, owed in members if not owed and e <= marks.get(n, -1)), default=NONE)
            self.at_end.append(kind(self.ends))
            self.begun.append(kind(self.stems))
        return number

    def _step(self, state: int, letter: str) -> int:
        reached = set()
        for node, made, owed in self.sets[state]:
            if owed:
                if owed == letter:
                    reached.add((node, made, ""))
                continue
            more = made + 1
            for c, child in self.children[node].items():
                if c == letter:
                    reached.add((child, made, ""))
                    continue
                if more <= self.allowed[child]:
                    reached.add((child, more, ""))
                after = self.children[child].get(letter)
                if after is not None and more <= self.allowed[after]:
                    reached.add((after, more, c))
            if more <= self.allowed[node]:
                reached.add((node, more, ""))  # the word's letter is one too many
        return self._state(reached)

    def match(self, word: str) -> int:
        if len(self.sets) > self.most:
            self._restart()
        state, best = self.start, NONE
        for c in word:
            steps = self.steps[state]
            next_ = steps.get(c)
            if next_ is None:
                next_ = steps[c] = self._step(state, c)
            state = next_
            begun = self.begun[state]
            if begun == EXACT:
                return EXACT
            best = best or begun
            if not self.sets[state]:
                return best
        return self.at_end[state] if self.at_end[state] == EXACT else best or self.at_end[state]


def quotations(words: list[str]) -> list[tuple[int, int]]:
    """(first word, last word) of each quotation: from an opening mark, one before a word's
    letters, to the next closing one, one behind them. A mark alone opens or closes."""
    found, opened = [], None
    for i, w in enumerate(words):
        if QUOTES.isdisjoint(w):
            continue
        letters = [k for k, c in enumerate(w) if c.isalnum()]
        if not letters:
            if opened is None:
                opened = i
            else:
                found.append((opened, i))
                opened = None
            continue
        if not QUOTES.isdisjoint(w[: letters[0]]):
            opened = i
        if opened is not None and not QUOTES.isdisjoint(w[letters[-1] + 1 :]):
            found.append((opened, i))
            opened = None
    return found


@dataclass
class Model:
    """A lexicon, the words let pass, and the curve over the weighted hits."""

    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    passed: frozenset[str] = frozenset()
    exact: frozenset[str] = frozenset()
    slope: float = 0.0
    level: float = -2.0
    window: int = 8
    quoted_weight: float = 0.2
    close_weight: float = 0.6


class Scorer:
    def __init__(self, model: Model, memo: int = 200_000):
        self.model = model
        self.automaton = LexiconAutomaton(model.terms, model.stems, model.exact)
        self.memo = Memo(memo)

    def kind(self, word: str) -> int:
        """The kind of match of a lower-case word."""
        core = bare(word)
        kind = self.automaton.match(core) if core else NONE
        return NONE if kind == CLOSE and core in self.model.passed else kind

    def kinds(self, words: list[str]) -> np.ndarray:
        """The kinds of distinct words."""
        for w in self.memo.missing(words):
            self.memo[w] = self.kind(w)
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.int8, count=len(words))

    def mentioned(self, words: list[str], at: int, spans: list[tuple[int, int]]) -> bool:
        """Whether the word ``at`` is quoted rather than used."""
        reach = self.model.window
        for first, last in spans:
            if first <= at <= last:
                near = words[max(0, first - reach) : first] + words[last + 1 : last + 1 + reach]
                return (at - first <= reach and last - at <= reach) or any(bare(w) in SAYING for w in near)
        return False

    def evidence(self, words: list[str], kinds: np.ndarray) -> float:
        """The weighted hits of a text; ``kinds`` by word."""
        total, spans = 0.0, quotations(words)
        for at in np.flatnonzero(kinds).tolist():
            weight = 1.0 if kinds[at] == EXACT else self.model.close_weight
            total += weight * (self.model.quoted_weight if self.mentioned(words, at, spans) else 1.0)
        return total

    def evidences(self, texts: pa.Array) -> np.ndarray:
        """The weighted hits of each text."""
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        offsets, index, words = distinct_words(lists)
        each = self.kinds(words.to_pylist())
        kinds = each[index] if len(words) else np.zeros(0, dtype=np.int8)
        hits = np.concatenate(([0], np.cumsum(kinds > 0)))
        out = np.zeros(len(lists))
        for i in np.flatnonzero(hits[offsets[1:]] > hits[offsets[:-1]]).tolist():
            out[i] = self.evidence(lists[i].as_py(), kinds[offsets[i] : offsets[i + 1]])
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.model.slope * np.log1p(evidence) + self.model.level)))


@dataclass
class Bag:
    """Which words each document of a sample has, as arrays."""

    words: pa.Array  # distinct bare words
    doc: np.ndarray
    word: np.ndarray  # of each different (document, word) pair, in this order

    @classmethod
    def of(cls, texts: pa.Array) -> Bag:
        offsets, index, raw = distinct_words(pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
        coded = pa.array([bare(w) for w in raw.to_pylist()], pa.string()).dictionary_encode()
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        word = coded.indices.to_numpy(zero_copy_only=False)[index] if len(index) else index
        pairs = np.unique((doc.astype(np.int64) << 32) | word)
        return cls(coded.dictionary, pairs >> 32, pairs & 0xFFFFFFFF)

    def copy_weights(self, toxic: np.ndarray) -> np.ndarray:
        """1 over how many documents (of a kind) have the same three longest words."""
        length = pc.utf8_length(self.words).to_numpy(zero_copy_only=False)
        order = np.lexsort((self.word, -length[self.word], self.doc))
        doc, word = self.doc[order], self.word[order]
        first = np.ones(len(doc), dtype=bool)
        first[1:] = doc[1:] != doc[:-1]
        at = np.arange(len(doc)) - np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
        key = np.full((len(toxic), 4), -1, dtype=np.int64)
        key[:, 3] = toxic
        for k in range(3):
            key[doc[at == k], k] = word[at == k]
        _, inverse, times = np.unique(key, axis=0, return_inverse=True, return_counts=True)
        return 1 / times[inverse.ravel()]


def learn_lexicon(bag: Bag, toxic: np.ndarray, least: float = 3, share: float = 0.02, ratio: float = 20, chance: float = 0.01, longest: int = 12) -> tuple[list[str], list[str]]:
    """(terms, stems) from labelled documents.

    An entry (a word, or a beginning of four to ``longest`` letters) must be in ``least`` toxic documents and a ``share`` of them, ``ratio``
    times as common there as elsewhere, and beyond chance for the number of entries
    tried. Copies of a document count as one between them.
    """
    weights = bag.copy_weights(toxic)
    of_toxic, of_clean = float(weights[toxic].sum()), float(weights[~toxic].sum())
    length = pc.utf8_length(bag.words).to_numpy(zero_copy_only=False)
    tried, found = 0, {}
    floor = max(least, share * of_toxic) - 1e-9
    for n in (0, *range(4, longest + 1)):  # 0: whole words
        there = length[bag.word] >= (n or 4)
        if not there.any():
            continue
        cut = pc.utf8_slice_codeunits(bag.words, 0, n).dictionary_encode() if n else bag.words.dictionary_encode()
        code = cut.indices.to_numpy(zero_copy_only=False)
        pairs = np.unique((bag.doc[there] << 32) | code[bag.word[there]])
        doc, entry = pairs >> 32, pairs & 0xFFFFFFFF
        both = [np.bincount(entry[toxic[doc] == kind], weights=weights[doc[toxic[doc] == kind]], minlength=len(cut.dictionary)) for kind in (True, False)]
        tried += int((both[0] >= least).sum())
        for i in np.flatnonzero(both[0] >= floor).tolist():
            found[cut.dictionary[i].as_py() + ("" if n else "$")] = (float(both[0][i]), float(both[1][i]))
    usual, bits = of_toxic / (of_toxic + of_clean), math.log(max(1, tried) / chance)

    def surprise(b: float, g: float) -> float:
        return b * math.log(b / (b + g) / usual) + (g and g * math.log(g / (b + g) / (1 - usual)))

    far = {e: b for e, (b, g) in found.items() if b / of_toxic >= ratio * g / of_clean and surprise(b, g) >= bits}
    longer: dict[str, float] = defaultdict(float)
    for e, n in far.items():
        longer[e[:-1]] = max(longer[e[:-1]], n)
    # A stem stands for its words only where no longer stem or word covers nearly the same documents.
    stems = [e for e, n in far.items() if not e.endswith("$") and longer[e] < 0.9 * n]
    stems = [e for e in stems if not any(e != s and e.startswith(s) for s in stems)]
    terms = [e[:-1] for e in far if e.endswith("$") and not any(e.startswith(s) for s in stems)]
    # A stem that one of the terms makes up the better part of is that term.
    stems = [s for s in stems if not any(t.startswith(s) and far[t + "$"] >= 0.5 * far[s] for t in terms)]
    by = lambda e: (-far.get(e + "$", far.get(e, 0)), e)
    return sorted(terms, key=by), sorted(stems, key=by)


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, level) of a logistic curve, by Newton steps with a small penalty."""
    w, level = np.zeros(2), np.column_stack((np.log1p(x), np.ones(len(x))))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(level @ w, -30, 30)))
        gradient = level.T @ (y - p) - 0.1 * w
        curve = (level * (p * (1 - p))[:, None]).T @ level + 0.1 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def fit_model(texts: pa.Array, toxic: np.ndarray) -> Model:
    if not toxic.any() or toxic.all():
        return Model()
    bag = Bag.of(texts)
    terms, stems = learn_lexicon(bag, toxic)
    if not terms and not stems:
        return Model()
    clean = bag.words.take(pa.array(np.unique(bag.word[~toxic[bag.doc]]))).to_pylist()
    short = LexiconAutomaton([t for t in terms if len(t) == 4], [])
    close = [w for w in clean if short.match(w) == CLOSE]
    exact = frozenset(t for t in terms if len(t) == 4 and any(LexiconAutomaton([t], []).match(w) == CLOSE for w in close))
    near = LexiconAutomaton(terms, stems, exact)
    passed = frozenset(w for w in clean if near.match(w) == CLOSE)
    model = Model(terms, stems, passed, exact)
    x = Scorer(model).evidences(texts)
    slope, level = fit_curve(x, toxic.astype(float))
    if slope <= 0:
        return Model()
    return Model(terms, stems, passed, exact, slope, min(level, -1e-9))


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 1500, most_clean: int = 3000, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model from a bounded sample of the labelled documents that aren't held out."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_text_crc(F.col("doc_id")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda bad, n: marks.where((F.col("toxic") == 1) == F.lit(bad)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = first(True, most_toxic).union(first(False, most_clean)).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    got = labelled_texts(docs, sample, doc_id, text)
    model = fit_model(one_array(got["text"]), np.asarray(got["label"].to_pylist(), dtype=np.int64) == 1)
    del got
    give_back()
    return model


@functools.lru_cache(maxsize=4)
def _scorer(key: tuple) -> Scorer:
    return Scorer(Model(list(key[0]), list(key[1]), *key[2:]))


def score_texts(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row. No shuffle."""
    rows = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    key = (tuple(model.terms), tuple(model.stems), model.passed, model.exact, model.slope, model.level, model.window, model.quoted_weight, model.close_weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key)
        for batch in slices(batches, "text"):
            score = scorer.score(scorer.evidences(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = rows.mapInArrow(run, rows.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", (id_text_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, whole and in place. No shuffle."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key)
        for batch in slices(batches, text):
            keep = scorer.score(scorer.evidences(batch.column(text))) < 0.5
            yield batch.filter(pa.array(keep))

    key = (tuple(model.terms), tuple(model.stems), model.passed, model.exact, model.slope, model.level, model.window, model.quoted_weight, model.close_weight)
    return bounded_batches(docs).mapInArrow(run, schema)
