"""Token counts, byte-level BPE and packing against the libraries and brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from palimpsest.llm import byte_bpe, packing, registry, token_counts

SF = "/root/testdata/sf0.001"
BITS = ["a", "b", "É", "th", "  ", " ", "\n", "▁", "é", "漢", "\U0001f600", "\x00", "<s>", "</s>", "<0x0A>", "\x1c", "\x85", "the ", "ing", "'s", "'LL", "\t", "\r\n", "　", "0", "12", "ﬁ", "é", "The", "ER", "İ", "ß", "aa", "!!", "##", "<|endoftext|>", "​", "٣", "½", "Σ", "_", "</w>", "\xa0", "ǅ", "’", "—", " ", "\x0b"]


def odd_texts(n=3000):
    rng = random.Random(4)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(30))) for _ in range(n)] + ["", " ", "a" * 3000, " " * 500 + "the", "ab" * 1500, "漢" * 300]


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_token_counts(spark, documents):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = odd_texts()
    assert token_counts.PieceCounter(path).count(pa.array(texts)).tolist() == [len(library.encode(t)) for t in texts]
    for r in registry.op6_token_counts(spark, SF).collect():
        n = len(library.encode(documents[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(documents[r["doc_id"]].encode()), n, n > 4096)


def test_small_memo_changes_nothing():
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = pa.array(odd_texts(200))
    assert token_counts.PieceCounter(path, memo=3).count(texts).tolist() == token_counts.PieceCounter(path).count(texts).tolist()


@pytest.fixture(scope="module")
def tik():
    lines = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_byte_bpe(spark, documents, tik, coder):
    texts = odd_texts()
    packed = coder.encode(texts)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [tik.encode_ordinary(t) for t in texts]
    assert [coder.decode(p) for p in packed] == [t.encode() for t in texts]
    for r in registry.op10_byte_bpe(spark, SF).collect():
        ids = tik.encode_ordinary(documents[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), byte_bpe.sha256_of_ids(ids))
        assert r["decoded_sha256"] == hashlib.sha256(documents[r["doc_id"]].encode()).hexdigest()


def test_prefix_tables(coder, tik):
    rng = random.Random(2)
    v = coder.vocabulary
    for _ in range(100):
        data = "".join(rng.choice(BITS) for _ in range(20)).encode()
        grown = byte_bpe.PrefixTable(v)
        for b in data:
            grown.append(bytes([b]))
        table = byte_bpe.PrefixTable(v, data)
        assert grown.last == table.last
        assert table.tokens() == tik._encode_single_piece(data) if data else table.tokens() == []
        start = rng.randrange(len(data) + 1)
        stop = min(len(data), start + rng.randrange(5))
        new = rng.choice(BITS).encode()
        table.edit(start, stop, new)
        again = byte_bpe.PrefixTable(v, data[:start] + new + data[stop:])
        assert (table.data, table.last) == (again.data, again.last)
    long = byte_bpe.PrefixTable(v, b"abcdefgh" * 300)
    assert long.edit(10, 12, b"zz") < 300
    assert long.last == byte_bpe.PrefixTable(v, long.data).last


def test_borders_between_tokens(coder):
    rng, v = random.Random(3), coder.vocabulary
    tokens = list(v.token)
    for _ in range(5000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert v.apart(a, b) == (v.merge(v.token[a] + v.token[b])[0] == [v.token[a], v.token[b]])


def test_first_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        sizes = np.array([rng.randint(1, 20) for _ in range(rng.randrange(30))], dtype=np.int64)
        room, expected = [], np.empty(len(sizes), dtype=np.int64)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            room[k:] = room[k:] or [20]
            room[k] -= sizes[i]
            expected[i] = k
        assert (packing.first_fit_decreasing(sizes, 20) == expected).all()
    with pytest.raises(ValueError):
        packing.first_fit_decreasing(np.array([21]), 20)


def test_packing(spark, documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, coder = Tokenizer.from_file(path), packing.TextEncoder(path)
    texts = odd_texts()
    ids, sizes = coder.encode(pa.array(texts), (2).to_bytes(4, "little"))
    split = np.split(ids, np.cumsum(sizes)[:-1])
    assert [s.tolist() for s in split] == [[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)]
    rows = registry.op2_packing(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == documents.keys()
    for i, mine in by_doc.items():
        ids = [*library.encode(documents[i], add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(mine, key=lambda r: r["start"]):
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(piece.tobytes()))
            at += r["length"]
        assert at == len(ids)
    for mine in by_sequence.values():
        ends = np.cumsum([r["length"] for r in sorted(mine, key=lambda r: r["offset"])])
        assert [r["offset"] for r in sorted(mine, key=lambda r: r["offset"])] == [0, *ends[:-1]]
        assert ends[-1] <= 4096
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) * 4096 <= 1.01 * total + 4096


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i * 40)) for i in range(12)], "doc_id bigint, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    cut = packing.pieces(docs, path, capacity=256)
    packed = packing.pack(cut.drop("ids"), 2, 256)
    made = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(cut, packed, capacity=256).collect()}
    assert all(len(v) == 256 for v in made.values())
    ids = {(r["doc_id"], r["start"]): np.frombuffer(r["ids"], "<u4") for r in cut.collect()}
    for r in packed.collect():
        assert (made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids[r["doc_id"], r["start"]]).all()
