"""Language model, dedup, toxicity and quality against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import katz, line_dedup, quality, registry, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


class BruteKatz:
    def __init__(self, trained, order):
        self.count = [None, *(Counter() for _ in range(order))]
        for words in trained:
            w = ["^"] * (order - 1) + words
            for k in range(order - 1, len(w)):
                for n in range(1, order + 1):
                    self.count[n][tuple(w[k - n + 1 : k + 1])] += 1
        self.d = [None, *(katz.discounts([Counter(c.values())[r] for r in range(1, 7)]) for c in self.count[1:])]
        self.after = defaultdict(list)
        for n in range(2, order + 1):
            for g, c in self.count[n].items():
                self.after[g[:-1]].append((g[-1], c))
        total = sum(self.count[1].values())
        freed = sum(c - self.cut(1, c) for c in self.count[1].values())
        self.base = total if freed else total + 1
        self.unknown = (freed or 1) / self.base
        self.backoff = {}

    def cut(self, n, c):
        return c if c > katz.K else self.d[n][c] * c

    def context(self, h):
        if h not in self.backoff:
            seen = self.after[h]
            total, stiff = sum(c for _, c in seen), not any(c <= katz.K for _, c in seen)
            mass = 1 if stiff else sum(c - self.cut(len(h) + 1, c) for _, c in seen)
            self.backoff[h] = (total + stiff, mass, sum(self.p(w, h[1:]) for w, _ in seen))
        return self.backoff[h]

    def p(self, w, h):
        c = self.count[len(h) + 1].get((*h, w), 0)
        if not h:
            return self.cut(1, c) / self.base if c else self.unknown
        if h not in self.after:
            return self.p(w, h[1:])
        base, mass, low = self.context(h)
        return self.cut(len(h) + 1, c) / base if c else mass / base / (1 - low) * self.p(w, h[1:])


@pytest.mark.parametrize(("order", "chunk"), [(1, 1 << 20), (2, 40_000), (3, 60_000)])
def test_katz_scores(spark, documents, order, chunk):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in katz.score_documents(docs, order, chunk_bytes=chunk, least_parts=5).collect()}
    words = {i: [*map(bytes.decode, t.encode().lower().split()), "$ end"] for i, t in documents.items()}
    held = {i for i in words if zlib.crc32(str(i).encode()) % 7 == 2}
    brute = BruteKatz([words[i] for i in sorted(words) if i not in held], order)
    total, vocabulary = sum(brute.count[1].values()), len(brute.count[1])
    for i, ws in words.items():
        w = ["^"] * (order - 1) + ws
        score = sum(math.log10(brute.p(w[k], tuple(w[k - order + 1 : k]))) for k in range(order - 1, len(w)))
        base = sum(math.log10((brute.count[1][(x,)] + 1) / (total + vocabulary + 1)) for x in ws)
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(ws), sum((x,) in brute.count[1] for x in ws), total)
        assert math.isclose(r["score"], score, rel_tol=1e-9) and math.isclose(r["base_score"], base, rel_tol=1e-9)
    if order > 1:
        assert sum(rows[i]["score"] for i in held) > sum(rows[i]["base_score"] for i in held)
        for h in random.Random(0).sample(sorted(brute.after), 5):
            assert math.isclose(sum(brute.p(x, h) for (x,) in brute.count[1]) + brute.p("never seen", h), 1, rel_tol=1e-9)


def test_arrays_survive_packing():
    rng = np.random.default_rng(0)
    for a in (np.zeros(0, np.int64), np.array([5]), rng.integers(0, 2**40, 1000)):
        assert (katz.unpack(katz.pack(a)) == a).all()
        assert (katz.unpack(katz.pack(np.sort(a), True), True) == np.sort(a)).all()
    x = rng.random(100).round(1)
    assert (katz.unpack_codes(*katz.pack_codes(x)) == x).all()


def test_line_dedup_agrees_with_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = con.sql(line_dedup.ORACLE)
    df = registry.op3_line_dedup(spark, SF)
    assert sorted(map(tuple, df.select(*sql.columns).collect())) == sorted(sql.fetchall())


def test_passages_are_cut_but_once(spark):
    passage = "Alpha beta gamma delta one. Epsilon zeta eta theta two. Iota kappa lambda mu three. Nu xi omicron pi four."
    own = lambda i: f"Only document {i} says this first. And it says {i} again here. "
    texts = [(i, own(i) + passage + f" Then {i} ends in its own way, quietly.") for i in range(5)] + [(9, "la la la\n" * 3), (10, passage + " " + passage)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id int, text string")).collect()}
    assert out[0] == texts[0][1]
    for i in range(1, 5):
        assert "Epsilon" not in out[i] and "kappa" not in out[i]
        assert own(i) in out[i] and f"Then {i} ends" in out[i]
    assert out[9] == texts[5][1]  # too short to tell
    assert out[10] == ""
    twice = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame([(1, passage + "\n" + passage)], "doc_id int, text string")).collect()}
    assert twice[1].strip() == passage


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((30, 20), (60, 60), (40, 39)):
        pairs = [(i, i + 1) for i in range(n - 1)] if m == n - 1 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        rng.shuffle(pairs)
        got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
        expected = union_find(n, pairs)
        assert got == {i: expected[i] for p in pairs if p[0] != p[1] for i in p}


def test_simhash_groups(spark, documents):
    ids = sorted(documents)
    prints = np.array([simhash.fingerprint(simhash.shingle_hashes(documents[i]))[0] for i in ids], dtype=np.uint64)
    pairs = [(i, int(j)) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)]
    roots = union_find(len(ids), pairs)
    expected = {ids[i]: (f"{int(prints[i]):016x}", ids[roots[i]]) for i in range(len(ids))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.op4_simhash(spark, SF).collect()} == expected


def test_links_find_every_near_pair(spark):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for x in list(prints):
        for bits in (1, 2, 3, 4):
            y = x
            for b in rng.sample(range(64), bits):
                y ^= 1 << b
            prints.add(y)
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(signed), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


def test_similar_texts_leave_one(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows, n = [], 0
    for g in range(12):
        words = [word() for _ in range(300)]
        for _ in range(4):
            copy = list(words)
            for at in rng.sample(range(300), 2):  # about 0.87 alike
                copy[at] = word()
            rows.append((n, g, " ".join(copy)))
            n += 1
    rows += [(n, -1, ""), (n + 1, -1, None), (n + 2, -1, " ")]
    left = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, g int, text string")).collect()
    assert sorted(r["g"] for r in left) == [-1, *range(12)]
    assert all(r["doc_id"] % 4 == 0 for r in left)


def edits(a, b):
    """Edit distance with swaps of neighbours that nothing else touches."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def expected_kind(word, terms, stems, exact=()):
    close = False
    for t in terms:
        n = edits(t, word)
        if n == 0:
            return toxicity.EXACT
        close |= n <= (0 if t in exact else toxicity.edits_for(t))
    for t in stems:
        n = min(edits(t, word[:k]) for k in range(len(word) + 1))
        if n == 0:
            return toxicity.EXACT
        close |= n <= toxicity.edits_for(t, stem=True)
    return toxicity.CLOSE if close else toxicity.NONE


def near_words(entries, rng, many):
    words = ["".join(rng.choice("abcidotsumrn") for _ in range(rng.randrange(1, 9))) for _ in range(many)]
    for t in entries:
        for _ in range(200):
            w = list(t)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w))
                if rng.random() < 0.3:
                    w[at : at + 2] = w[at : at + 2][::-1]
                else:
                    w[at : at + rng.randrange(2)] = rng.choice(["", "x", "a", "o"])
                w = w or ["x"]
            words.append("".join(w))
    return words


@pytest.mark.parametrize("most", [100_000, 3])
def test_automaton_against_edit_distance(most):
    terms, stems, rng = ["idiot", "scum", "moronic", "abcabc", "mud", "ratsbane", "dumb"], ["lostra", "vequ"], random.Random(2)
    automaton = toxicity.LexiconAutomaton(terms, stems, frozenset({"dumb"}), most)
    for w in near_words([*terms, *(s + "ado" for s in stems)], rng, 2000):
        assert automaton.match(w) == expected_kind(w, terms, stems, {"dumb"}), w
    assert [automaton.match(w) for w in ("xidiot", "ldiot", "idoit", "diot", "sucm", "muds", "lostrxbc", "osltra")] == [2, 2, 2, 2, 2, 0, 2, 0]


def test_score_against_a_plain_recount():
    """Words matched by edit distance, quotations paired by hand, one text at a time."""
    model = toxicity.Model(["idiot", "scum"], ["lostra"], frozenset({"idiom"}), frozenset({"scum"}), 2.0, -1.0)
    scorer, rng = toxicity.Scorer(model, memo=20), random.Random(4)
    pool = ["idiot", "Idiot!", "idiom", "scum", "scam", "lostrabu", "lstrax", "plain", "thing", "said", "he", "and", '"', '"she', 'went"', '"quiet"', "„ja", "nein“."]
    for _ in range(400):
        words = [rng.choice(pool) for _ in range(rng.randrange(0, 30))]
        spans, opened = [], None
        for i, w in enumerate(words):
            if w == '"' and opened is not None:
                spans.append((opened, i))
                opened = None
            elif w[0] in '"„':
                opened = i
            if len(w) > 1 and w[-1 - w.endswith(".")] in '"“' and opened is not None:
                spans.append((opened, i))
                opened = None
        total = 0.0
        for i, w in enumerate(words):
            core = w.lower().strip('"„“!.')
            kind = expected_kind(core, model.terms, model.stems, model.exact) if core else 0
            if kind == toxicity.NONE or (kind == toxicity.CLOSE and core == "idiom"):
                continue
            span = next(((a, b) for a, b in spans if a <= i <= b), None)
            mention = span and ((i - span[0] <= 8 and span[1] - i <= 8) or "said" in words[max(0, span[0] - 8) : span[0]] + words[span[1] + 1 : span[1] + 9])
            total += (1.0 if kind == toxicity.EXACT else 0.6) * (0.2 if mention else 1.0)
        text = " ".join(words)
        assert scorer.evidences(pa.array([text]))[0] == pytest.approx(total), text
        assert scorer.score(np.array([total]))[0] == pytest.approx(1 / (1 + (1 + total) ** -2 * np.e))


def test_abuse_between_quotations_is_no_mention():
    scorer = toxicity.Scorer(toxicity.Model(["idiot"], []))
    texts = ['He said "hello" once . You are an idiot and she said "bye" then', 'He said "you idiot" once', '"' + "a " * 20 + "idiot" + " b" * 20 + '"', 'she said "' + "a " * 20 + "idiot" + " b" * 20 + '"', 'no end: "you idiot']
    assert scorer.evidences(pa.array(texts)).tolist() == [1.0, 0.2, 1.0, 0.2, 1.0]


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    rows = []
    for i in range(n):
        words, bad = [word() for _ in range(rng.randrange(20, 80))], rng.random() < 0.3
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["stupidly", "Moronic!", "scumbag,", "vequ" + word()]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_documents(spark):
    rows = toxic_corpus(1500, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model.terms) == {"stupidly", "moronic", "scumbag"} and model.stems == ["vequ"]
    truth = {r[0]: r[2] for r in rows}
    out = toxicity.score_texts(docs, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert all(r["predicted"] == (r["score"] >= 0.5) == truth[r["doc_id"]] for r in out if r["held_out"])
    assert {r["doc_id"] for r in toxicity.without_toxic(docs, model).collect()} == {i for i, bad in truth.items() if not bad}


def test_quotation_and_misspelling():
    model = toxicity.Model(["stupidly"], [], frozenset({"stupidle"}), frozenset(), 10.0, -6.0)
    scorer = toxicity.Scorer(model)
    texts = ["you act stupidly again", 'he said “you act stupidly” yesterday', "you act stupidlly here", "a stupidle thing", "", None, "nothing here"]
    plain, quoted, misspelt, passed, *none = scorer.evidences(pa.array(texts)).tolist()
    assert plain == 1 and 0 < quoted < misspelt < plain and passed == 0 and none == [0, 0, 0]
    assert (scorer.score(np.array([0.0, 1.0])) >= 0.5).tolist() == [False, True]


WORDS = re.compile("[^\x20\x09-\x0d]+")


def base_counts(text):
    w = WORDS.findall(text or "")
    times, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if times[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), again, len(covered)


def test_base_rules(spark, documents):
    for r in registry.op7_quality(spark, SF).collect():
        n, chars, symbols, again, repeated = base_counts(documents[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, again, repeated)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    odd = ["", None, " \n ", "a\n a\na\n a", "a a a a", "x\x0by\x0cz # <b>|", "\x1fa\x85b"]
    counts = quality.shapes(pa.array(odd)).counts
    assert list(zip(*(counts[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)) == [base_counts(t) for t in odd]


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = rng.integers(1, 7, 5)
        features = rng.normal(size=(int(lengths.sum()), 3))
        chain = quality.Chain(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
        found, at = quality.viterbi(chain, features, lengths), 0
        for n in lengths.tolist():
            e = features[at : at + n] @ chain.emit
            score = lambda z: sum(e[i, z[i]] for i in range(n)) + sum(chain.move[a, b] for a, b in itertools.pairwise(z))  # noqa: B023, E731
            assert tuple(found[at : at + n]) == max(itertools.product((0, 1), repeat=n), key=score)
            at += n


def test_gradient_finds_the_labels():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 9, 60)
    x = rng.normal(size=(int(lengths.sum()), 2))
    labels = (x[:, 0] > 0).astype(np.int64)
    chain = quality.fit_chain(np.column_stack((np.ones(len(x)), x)), lengths, labels)
    assert (quality.viterbi(chain, np.column_stack((np.ones(len(x)), x)), lengths) == labels).mean() > 0.95


def test_quality_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    verdicts = registry.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(~F.col("base_failed"))
    right = verdicts.agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.97
