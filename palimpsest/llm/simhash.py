"""SimHash fingerprints and their groups by multi-index hashing.

A fingerprint's bit is the majority of that bit in the XXH64 hashes of the
text's word shingles. Fingerprints at most three bits apart are linked. Cut into
two halves of 32 bits, two linked fingerprints have a half in which they differ
in one bit at most. So every half is stored in a table; the Hamming ball of
radius one around each half (itself and its 32 neighbours) is looked up there,
and the whole distance of each match is verified. With 32-bit keys a chance
match stays rare however many fingerprints there are.

Equal fingerprints are one node, so a group of copies of any size costs one row.
Links are contracted to components by alternating large and small stars over
tables in the shared folder: no component or neighbour list is ever gathered in
one task.

Defined results: a null or empty text, or one of white space, has fingerprint
zero and is linked like any other; texts with fewer words than a shingle are one
shingle; repeated rows are rows of their own in one component; a component's id
is its smallest non-null doc_id (null if it has none); an empty table gives an
empty table; other columns are ignored. Long texts count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from palimpsest.llm.common import Memo, bitmap, bounded_batches, forget, slices, stored, with_mark
from palimpsest.shared import unused


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size and size > 1:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    if size == 1:
        return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64, count=len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The majority of each bit (strictly more than half), as one unsigned 64-bit number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long). No shuffle."""
    rows = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [fingerprint(shingle_hashes(t, size, seed)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, rows.select("doc_id").schema.add("fp", "long"))


#: Fingerprints of a set, each by other bits of its hashes; how many bits apart two may be; the leading
#: bits that the rows of a window share. Sets 0.8 alike differ in 0.15 of the bits, 9.7 of 64.
WORDS, APART, LEADING = 32, 10, 12
_SALT = np.random.default_rng(44).integers(0, 1 << 63, (2, WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``WORDS`` fingerprints of a set of hashes (none if it is empty); the first is :func:`fingerprint`'s."""
    if not len(shingles):
        return np.zeros(0, dtype=np.uint64)
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(shingles), 255):  # as many rows as eight bits can count
        mixed = shingles[at : at + 255, None] * _SALT[0]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _SALT[1]
        mixed ^= mixed >> np.uint64(29)
        mixed[:, 0] = shingles[at : at + 255]
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)


#: Bands of rows of a MinHash signature: sets 0.8 alike share no band with a chance of
#: (1 - 0.8 ** 8) ** 64, 8 in 10**6; more alike ones with less, and sets 0.5 alike share one
#: with a chance of 0.2, so that few others are looked at.
BANDS, ROWS = 64, 8
_TIMES = np.random.default_rng(42).integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_PLUS = np.random.default_rng(43).integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash signature of a set of hashes (none if it is empty)."""
    if not len(shingles):
        return np.zeros(0, dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 2048):
        mixed = high[None, at : at + 2048] * _TIMES
        mixed += _PLUS
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key = key ^ (key >> np.uint64(29))
    return key


def _node(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes())


def _longs(arrays: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if x is None else x.view(np.int64) for x in arrays], pa.list_(pa.int64()))


def shingle_keys(docs: DataFrame, size: int = 5, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``node`` (a hash of the set of shingles), ``prints`` (its fingerprints) and ``keys``
    (of its bands), as signed longs. No shuffle. A task gives a set's prints and keys once: they are
    null in rows whose set it has had before, so that a group of copies has them once a task."""
    rows = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = Memo(1_000_000)
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, size, seed)) for t in batch.column("text").to_pylist()]
            nodes = [_node(s) for s in sets]
            new = set(given.missing(nodes))
            first = [n in new and not new.discard(n) for n in nodes]
            given.update(dict.fromkeys(nodes))
            prints, keys = (_longs([made(s) if f else None for s, f in zip(sets, first, strict=True)]) for made in (wide_fingerprint, band_keys))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), prints, keys], ["doc_id", "node", "prints", "keys"])

    longs = ArrayType(LongType())
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("node", "long").add("prints", longs).add("keys", longs))


def shingle_sets(docs: DataFrame, size: int = 5, seed: int = 42, text: str = "text") -> DataFrame:
    """``node`` and ``shingles`` (the set, sorted) of every row."""
    rows = bounded_batches(docs).select(F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, size, seed)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(s) for s in sets], dtype=np.uint64).view(np.int64)), _longs(sets)], ["node", "shingles"])

    return rows.mapInArrow(run, "node bigint, shingles array<bigint>")


def _halves(fp: Column) -> list[Column]:
    """The two halves as keys that differ between halves."""
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    return [low, F.shiftrightunsigned(fp, 32).bitwiseOR(F.lit(1 << 32))]


def links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Pairs ``u < v`` of distinct fingerprints (column ``fp``) at most ``most`` (3 or fewer) bits apart."""
    if not 0 <= most <= 3:
        raise ValueError("two halves with a ball of radius one find distances up to 3")
    held = nodes.select(F.col("fp").alias("v"), F.explode(F.array(*_halves(F.col("fp")))).alias("key"))
    ball = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(32)))
    probes = nodes.select(F.col("fp").alias("u"), F.explode(F.array(*_halves(F.col("fp")))).alias("half"))
    probes = probes.select("u", F.explode(F.transform(ball, lambda m: F.col("half").bitwiseXOR(m))).alias("key"))
    # Hardly any of a ball's keys is in the table; only those that may be are shuffled.
    probes = with_mark(probes, F.xxhash64("key"), bitmap(held.select(F.xxhash64("key"))), "_mark").where("_mark").drop("_mark")
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most)
    return probes.join(held, (probes["key"] == held["key"]) & near).select("u", "v").distinct()


def near_prints(keyed: DataFrame) -> DataFrame:
    """Pairs ``u < v`` of nodes (``node, prints``) that have a fingerprint at most ``APART`` bits apart, stored.

    Each half of each fingerprint has a table, sorted by that half and then the other one: a node's
    neighbour in it is the one that shares most leading bits, however many nodes there are. The whole
    distance of neighbours is verified. A table costs a row a node, and a large group of near
    copies a pair a row.
    """
    fp = F.col("fp")
    turned = F.shiftleft(fp, 32).bitwiseOR(F.shiftrightunsigned(fp, 32))
    words = keyed.select("node", F.posexplode("prints").alias("word", "fp"))
    seen = words.select("node", "word", F.posexplode(F.array(fp, turned)).alias("half", "bits"))
    seen = seen.select("node", (2 * F.col("word") + F.col("half")).alias("table"), "bits")
    order = Window.partitionBy("table", F.shiftrightunsigned("bits", 64 - LEADING)).orderBy("bits", "node")
    met = seen.select("node", "bits", F.lag("node").over(order).alias("other"), F.lag("bits").over(order).alias("other_bits"))
    met = met.where((F.col("node") != F.col("other")) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("other_bits"))) <= APART))
    return stored(met.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct(), "near")


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, root`` for every node of the edges; the root is the component's smallest node.

    Each round turns every node's edges to the smallest neighbour, first for larger
    neighbours, then for smaller ones, until all edges point at roots.
    """
    edges = stored(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v"), "edges")
    state = None
    while True:
        # What a join meets is a table of its own, so that a node with very many edges can be split in it.
        both = edges.union(edges.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        down = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "down")
        low = stored(down.groupBy("u").agg(F.min("v").alias("m")), "low")
        met = down.join(low, "u")
        small = met.select(F.col("u"), F.col("m").alias("v")).union(met.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        last, edges = edges, stored(small, "edges")
        forget(last, least, down, low)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def group(docs: DataFrame, size: int = 3, most: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` per row."""
    prints = stored(fingerprints(docs, size, doc_id=doc_id, text=text), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = _named(nodes.withColumnRenamed("fp", "node"), components(links(nodes.select("fp"), most)))
    return prints.join(named, F.col("fp") == F.col("node")).select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """16 lower-case hex digits of a signed long's bits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class Sets:
    """The shingle sets of some documents, made anew where they are wanted: few documents share a key
    with another one, so this reads their texts again rather than store the sets of all."""

    def __init__(self, docs: DataFrame, least: DataFrame, size: int, doc_id: str, text: str):
        """``least``: ``node`` and ``least``, an id that has it."""
        self.docs, self.least, self.size, self.doc_id, self.text = docs, least, size, doc_id, text

    def of(self, nodes: DataFrame) -> DataFrame:
        """``node, shingles`` of the ``nodes``; only documents whose id's place in a bitmap is taken by one
        that has a wanted node are read, and none is shuffled but these."""
        mark = unused(self.docs, "__in")
        ids = nodes.join(self.least, "node").select(F.xxhash64("least").alias("at"))
        read = with_mark(self.docs, F.xxhash64(self.doc_id), bitmap(ids), mark).where(mark)
        made = shingle_sets(read, self.size, text=self.text)
        return made.join(nodes.hint("merge"), "node", "left_semi").groupBy("node").agg(F.min("shingles").alias("shingles"))


def alike(pairs: DataFrame, sets: Sets, similarity: float) -> DataFrame:
    """The pairs ``u, v`` whose ``shingles`` have this Jaccard similarity or more, counted exactly; stored."""
    met = stored(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "met")
    own = stored(sets.of(met), "shingles")
    a, b = (own.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("u", "a"), ("v", "b")))
    both = F.size(F.array_intersect("a", "b"))
    # Merge joins at every size: what they shuffle is a few arrays a pair.
    found = stored(pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").where(both / (F.size("a") + F.size("b") - both) >= similarity).select("u", "v"), "links")
    forget(met, own)
    return found


def within_reach(open_: DataFrame, sets: Sets, similarity: float) -> DataFrame:
    """Pairs ``u < v`` of nodes with different roots that may be ``similarity`` alike, none of them left out; stored.

    ``open_`` has ``node, root``. A node's shingles are ordered by how many of these nodes have them,
    the rarest first. Two sets so alike share a shingle among the first ``n - similarity * n + 1``
    of each, and at the first one that they share enough shingles must be left behind it in both.
    So what is peculiar to a text keeps it from all that it isn't close to, in the join itself.
    """
    open_ = stored(open_, "open")
    own = stored(sets.of(open_.select("node")).join(open_.hint("merge"), "node"), "sets")
    each = own.select("node", F.explode("shingles").alias("s"))
    common = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(common.hint("merge"), "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("shared"))
    rows = own.select("node", "root", F.size("shingles").alias("n")).join(shared, "node")
    alone = F.col("n") - F.size("shared")  # shingles of no other node come first
    prefix = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1
    first = F.slice("shared", F.lit(1), F.greatest(F.lit(0), prefix - alone).cast("int"))
    held = stored(rows.select("node", "root", "n", alone.alias("alone"), F.posexplode(first).alias("k", "e")).select("node", "root", "n", (F.col("n") - F.col("alone") - F.col("k")).alias("left"), F.col("e.s").alias("s")), "prefixes")
    a, b = (held.select("s", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n", "left"))) for x in "ab")
    near = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
    near = near & (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
    near = near & (F.least("left_a", "left_b") >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    found = stored(a.join(b, (a["s"] == b["s"]) & near).select(F.col("node_a").alias("u"), F.col("node_b").alias("v")).distinct(), "near")
    forget(open_, own, held)
    return found


def similar_components(keyed: DataFrame, sets: Sets, similarity: float) -> DataFrame:
    """``node, root`` of the linked nodes of ``keyed`` (``node, prints, keys``): those that are alike.

    First the pairs of near fingerprints are verified and linked. Fingerprints can't reach all pairs
    this alike, so what they have left apart is looked for by the bands' keys: each node is held
    against the smallest one of each of its keys, which costs a pair a node and key however large a
    group of near copies is. Nodes that then still share a key with one of another component are
    held against what is :func:`within_reach` among them.
    """
    near = near_prints(keyed)
    found = alike(near, sets, similarity)
    roots = stored(components(found), "roots")
    held = keyed.select("node", F.explode("keys").alias("key"))
    ends = held.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("_last")).where("u < _last")
    ends = stored(ends.select("key", "u"), "ends")  # few keys have two nodes, and only theirs are shuffled again
    held = with_mark(held, F.col("key"), bitmap(ends.select("key")), "_mark").where("_mark").drop("_mark")
    shared = stored(held.join(ends.hint("merge"), "key").distinct(), "shared")
    forget(ends)
    first = shared.where("node > u").select("u", F.col("node").alias("v")).distinct()
    for end in "uv":
        first = first.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left")
    apart = F.coalesce("_u", "u") != F.coalesce("_v", "v")
    first = stored(first.where(apart).select("u", "v").join(near, ["u", "v"], "left_anti"), "pairs")
    found = found.union(alike(first, sets, similarity))
    forget(roots)
    roots = components(found).select("node", "root")
    rooted = stored(shared.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "rooted")
    forget(shared)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("key")
    mixed = stored(mixed, "mixed")  # a table of its own, so that a key with many nodes can be split in the join
    left = within_reach(rooted.join(mixed, "key").select("node", "root").distinct(), sets, similarity)
    more = alike(left.join(first.union(near), ["u", "v"], "left_anti"), sets, similarity)
    forget(rooted, mixed, left, first, near)
    return components(found.union(more))


def group_similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, component_id`` per row, linking texts whose shingle sets are
    ``similarity`` alike (Jaccard) or more.

    Candidates come from SimHash fingerprints of the sets, then, for pairs whose fingerprints
    lie too far apart, from bands of a MinHash signature. No number of bits tells 0.8 from 0.75,
    so each candidate is verified on the sets themselves.
    """
    keyed = stored(shingle_keys(docs, size, doc_id=doc_id, text=text), "keys")
    least = stored(keyed.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    found = similar_components(keyed, Sets(docs, least, size, doc_id, text), similarity)
    done = stored(keyed.select("doc_id", "node").join(_named(least, found), "node").select("doc_id", "component_id"), "groups")
    forget(keyed, least)
    return done


def _named(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``node, component_id`` from ``node, least`` and the roots of the linked ones."""
    roots = found.select(F.col("node").alias("_node"), "root")
    rooted = nodes.join(roots, F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("node", "root").join(named, "root").select("node", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component of similar texts (all rows of that id; rows with a null id stay)."""
    kept = unused(docs, "__kept_id")
    named = group_similar(docs, size, similarity, doc_id, text).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(named, F.col(doc_id) == F.col(kept), "left").where(F.col(kept).isNotNull() | F.col(doc_id).isNull()).drop(kept)
