"""Resharding by minimum-cost flow.

Documents lie in old shards (by default by a hash of the text); new shards are to
have equal bytes. Equal texts of an old shard are a group, and a group goes as a whole.

A group larger than a ``PART`` of a shard is placed on its own: it stays if its shard
has room, else it goes where there is most; one larger than a whole shard, which no
shard can hold, is first split into pieces. There are fewer than ``PART`` such groups a
shard whatever the table's size. What room they leave is filled evenly: a flow of bytes
from old shards to new ones, at cost 0 for bytes that stay and 1 for bytes that move,
gives the transfers that move the fewest bytes. It is solved on the driver over shard
totals, whose number is a parameter, never over documents.

Each old shard is a line of groups, those of long texts first, else by the hash of the
text. The flow cuts the line into stretches: first what stays, then what goes to each
receiver. So a block transfer is a range of (length, hash), cuts fall among the
shortest texts, and any row's shard follows from its text and the few cuts: no row is
looked up anywhere. Where a cut falls is found from sums over blocks of the line, a
bounded number of them, and from the groups of the one block that it falls into.

:func:`rewrite` shuffles the affected rows by shard, a large shard over many tasks, and
writes their files; a row's slot is its place in them.

Defined results: a null text counts as empty (size 16); repeated rows and rows with null
ids are rows like any other; a group that is split has even pieces; an empty table
gives no files; an old shard number that is null or out of range is an error; other
columns are written as they are, but for one named ``shard``, which gives way to the folder's.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import shared_path, stored
from palimpsest.shared import unused

#: A group of equal texts beyond this part of a shard is placed on its own.
PART = 64
#: Blocks of an old shard's line have about so many groups, but there are at most 2 ** MOST_BITS of each length class.
BLOCK, MOST_BITS = 128, 8
#: Rows of a group that is split are numbered in cells of about so many.
CELL = 50_000


class FlowNetwork:
    """A directed network with integer capacities and costs (no negative ones)."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, tail: int, head: int, room: int, cost: int) -> int:
        """Adds an arc and its reverse; the arc's number."""
        for a, b, r, c in ((tail, head, room, cost), (head, tail, 0, -cost)):
            self.out[a].append(len(self.head))
            self.head.append(b)
            self.room.append(r)
            self.cost.append(c)
        return len(self.head) - 2

    def send(self, source: int, sink: int) -> tuple[int, int]:
        """As much as can flow, at the least cost: (amount, cost). Shortest augmenting
        paths under node prices that keep reduced costs from being negative."""
        n = len(self.out)
        price, amount, spent = [0] * n, 0, 0
        while True:
            far: list[int | None] = [None] * n
            via = [-1] * n
            far[source] = 0
            heap = [(0, source)]
            while heap:
                d, at = heapq.heappop(heap)
                if d > far[at]:
                    continue
                for k in self.out[at]:
                    to = self.head[k]
                    if self.room[k] and (far[to] is None or d + self.cost[k] + price[at] - price[to] < far[to]):
                        far[to] = d + self.cost[k] + price[at] - price[to]
                        via[to] = k
                        heapq.heappush(heap, (far[to], to))
            if far[sink] is None:
                return amount, spent
            reach = max(d for d in far if d is not None)
            price = [p + (reach if d is None else d) for p, d in zip(price, far, strict=True)]
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.head[via[at] ^ 1]
            most = min(self.room[k] for k in path)
            for k in path:
                self.room[k] -= most
                self.room[k ^ 1] += most
                spent += most * self.cost[k]
            amount += most


def even_capacities(total: int, shards: int) -> list[int]:
    """Capacities that add up to ``total`` and are one byte apart at most."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def transfers(old_sizes: Sequence[int], capacities: Sequence[int]) -> list[list[tuple[int, int]]]:
    """For each old shard, (new shard, bytes) in the order in which its line is cut: itself first.

    An old shard's bytes may stay only where the same number is a new shard too.
    """
    old, new = len(old_sizes), len(capacities)
    net, source, sink = FlowNetwork(old + new + 2), old + new, old + new + 1
    for i, size in enumerate(old_sizes):
        net.arc(source, i, size, 0)
    for j, room in enumerate(capacities):
        net.arc(old + j, sink, room, 0)
    arcs = {(i, j): net.arc(i, old + j, min(old_sizes[i], capacities[j]), int(i != j)) for i in range(old) for j in range(new)}
    amount, _ = net.send(source, sink)
    if amount != sum(old_sizes):
        raise ValueError("the new capacities don't hold the old shards")
    sent = {ij: net.room[k ^ 1] for ij, k in arcs.items()}
    return [[(j, sent[i, j]) for j in sorted(range(new), key=lambda j: (j != i, j)) if sent[i, j]] for i in range(old)]


def filled(loads: Sequence[int], amount: int) -> list[int]:
    """What each shard takes of ``amount`` so that all become as even as their loads allow."""
    order = sorted(range(len(loads)), key=lambda j: (loads[j], j))
    takes, level, n = [0] * len(loads), 0, 0
    for n in range(1, len(order) + 1):
        below = sum(loads[j] for j in order[:n])
        level = (amount + below) // n
        if n == len(order) or level <= loads[order[n]]:
            break
    rest = amount - sum(level - loads[j] for j in order[:n])
    for k, j in enumerate(order[:n]):
        takes[j] = level - loads[j] + (k < rest)
    return takes


@dataclass(frozen=True)
class Layout:
    """Where everything goes: bounded by the numbers of shards alone."""

    shards: int
    old_shards: int
    overhead: int
    cuts: dict[int, list[tuple[int, int, int]]]  # by old shard: (length class, hash) of the first group past each stretch, and its shard
    large: dict[tuple[int, int], list[int]]  # (old shard, hash): the shard of each piece
    rows: dict[tuple[int, int], int]  # how many rows those have

    def affected(self) -> list[int]:
        """Shards that some row leaves or comes to."""
        moves = [(i, j) for i, ends in self.cuts.items() for _, _, j in ends] + [(i, j) for (i, _), to in self.large.items() for j in to]
        return sorted({s for i, j in moves if i != j for s in (i, j) if s < self.shards})


class Rows:
    """A row's size, place in a line and old shard, as columns."""

    def __init__(self, text: str, old_shards: int, old_shard: str | None, overhead: int):
        words = F.coalesce(F.col(text).cast("string"), F.lit(""))
        self.group = F.xxhash64(words)
        self.size = (F.octet_length(words) + overhead).cast("long")
        self.rank = -F.length(F.bin(self.size))  # long texts come first
        if old_shard is None:
            self.lies = F.pmod(self.group, F.lit(old_shards)).cast("int")
        else:
            given = F.col(old_shard).cast("int")
            bad = F.raise_error(F.concat(F.lit("no such old shard: "), F.coalesce(given.cast("string"), F.lit("null")))).cast("int")
            self.lies = F.when(given.between(0, old_shards - 1), given).otherwise(bad)


def _pieces(size: int, rows: int, room: int) -> list[int]:
    """Rows of each piece of a group: one piece if it fits into a shard, else as few even ones as do."""
    n = 1 if size * rows <= room else -(-rows // max(1, room // size))
    return [rows // n + (k < rows % n) for k in range(n)]


def plan(docs: DataFrame, shards: int = 40, old_shards: int | None = None, overhead: int = 16, text: str = "text", old_shard: str | None = None) -> Layout:
    """The layout with the fewest moved bytes; only hashes and sizes are read.

    ``old_shard`` names a column with shard numbers below ``old_shards``; without it
    a hash of the text gives them.
    """
    old_shards = old_shards or shards
    own = Rows(text, old_shards, old_shard, overhead)
    rows = docs.select(own.lies.alias("lies"), own.group.alias("g"), own.size.alias("size"), own.rank.alias("c"))
    groups = stored(rows.groupBy("lies", "g").agg(F.max("size").alias("size"), F.min("c").alias("c"), F.count("*").alias("n"), F.sum("size").alias("bytes")), "groups")
    total, many = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    room = total // shards
    # Fewer than PART * shards rows, as each has more than a part of the room.
    large = groups.where(F.col("bytes") * PART > room).orderBy(F.desc("bytes"), "lies", "g").collect() if room else []
    loads, places = [0] * shards, {}
    pieces = [(r["size"] * n, r["lies"], r["g"], k) for r in large for k, n in enumerate(_pieces(r["size"], r["n"], room))]
    for size, lies, g, _ in sorted(pieces, key=lambda x: (-x[0], *x[1:])):
        stays = lies < shards and loads[lies] + size <= room
        to = lies if stays else min(range(shards), key=lambda j: (loads[j], j))
        loads[to] += size
        places.setdefault((lies, g), []).append(to)
    counts = {(r["lies"], r["g"]): r["n"] for r in large}

    bits = min(MOST_BITS, max(0, (many // (old_shards * BLOCK)).bit_length() - 1))
    small = (groups.where(F.col("bytes") * PART <= room) if room else groups).withColumn("block", F.shiftright("g", 64 - bits) if bits else F.lit(0).cast("long"))
    blocks = small.groupBy("lies", "c", "block").agg(F.sum("bytes").alias("bytes")).collect()
    line: dict[int, list[tuple[int, int, int]]] = {i: [] for i in range(old_shards)}
    for r in sorted(blocks, key=lambda r: (r["lies"], r["c"], r["block"])):
        line[r["lies"]].append((r["c"], r["block"], r["bytes"]))
    totals = [sum(b for *_, b in line[i]) for i in range(old_shards)]
    stretches = transfers(totals, filled(loads, sum(totals)))

    inside = []  # cuts within a block: old shard, class, block, bytes from its start, which stretch
    for i, found in enumerate(stretches):
        end, at, k = 0, 0, 0
        for n, (_, amount) in enumerate(found[:-1]):
            end += amount
            while at + line[i][k][2] <= end:
                at, k = at + line[i][k][2], k + 1
            inside.append((i, line[i][k][0], line[i][k][1], end - at, n))
    ends = {}
    if inside:
        asked = docs.sparkSession.createDataFrame(inside, "lies int, c int, block bigint, far bigint, cut int")  # a row a cut
        upto = Window.partitionBy("lies", "c", "block").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
        there = small.join(F.broadcast(asked.select("lies", "c", "block").distinct()), ["lies", "c", "block"])
        middles = there.withColumn("_mid", F.sum("bytes").over(upto) - F.col("bytes") / 2)
        after = middles.join(F.broadcast(asked), ["lies", "c", "block"]).where("_mid >= far")
        ends = {(r["lies"], r["cut"]): r["g"] for r in after.groupBy("lies", "cut").agg(F.min("g").alias("g")).collect()}
    cuts: dict[int, list[tuple[int, int, int]]] = {}
    for i, c, block, _, n in inside:
        here = (c, ends[i, n]) if (i, n) in ends else _behind(c, block, bits)
        cuts.setdefault(i, []).append((*here, stretches[i][n][0]))
    for i, found in enumerate(stretches):
        if found:
            cuts.setdefault(i, []).append((*_behind(0, 0, 0), found[-1][0]))
    return Layout(shards, old_shards, overhead, cuts, places, counts)


def _behind(c: int, block: int, bits: int) -> tuple[int, int]:
    """The first place in a line that is past a block."""
    start = (block + 1) << (64 - bits)
    return (c, start) if bits and start < 1 << 63 else (c + 1, -(1 << 63))


def place(docs: DataFrame, layout: Layout, text: str = "text", old_shard: str | None = None) -> DataFrame:
    """``docs`` with each row's new shard in the last column, ``shard``. No row is shuffled, but for
    those of groups that are split, which are stored and numbered in cells of bounded size."""
    spark, own = docs.sparkSession, Rows(text, layout.old_shards, old_shard, layout.overhead)
    tmp = unused(docs, "__to")
    col = lambda c: F.col(f"{tmp}_{c}")
    ends = spark.createDataFrame(list(layout.cuts.items()), f"{tmp}_i int, {tmp}_ends array<struct<c: int, g: bigint, shard: int>>")
    large = [(i, g, to, layout.rows[i, g]) for (i, g), to in layout.large.items()]
    pieces = spark.createDataFrame(large, f"{tmp}_li int, {tmp}_lg bigint, {tmp}_own array<int>, {tmp}_n bigint")
    # Both have a few rows a shard at most.
    met = docs.withColumns({f"{tmp}_lies": own.lies, f"{tmp}_g": own.group, f"{tmp}_c": own.rank})
    met = met.join(F.broadcast(ends), col("lies") == col("i"), "left")
    met = met.join(F.broadcast(pieces), (col("lies") == col("li")) & (col("g") == col("lg")), "left")
    met = met.withColumn(f"{tmp}_k", F.lit(0))
    if any(len(to) > 1 for to in layout.large.values()):
        whole = F.coalesce(F.size(col("own")) <= 1, F.lit(True))
        split = stored(met.where(~whole).withColumn(f"{tmp}_k", F.monotonically_increasing_id()), "split")
        split = split.withColumn(f"{tmp}_cell", F.pmod(F.xxhash64(col("k")), F.ceil(col("n") / CELL)))
        number = F.row_number().over(Window.partitionBy(col("lies"), col("g"), col("cell")).orderBy(col("k"))) + col("cell")
        split = split.withColumn(f"{tmp}_k", F.pmod(number, F.size(col("own"))).cast("int")).drop(f"{tmp}_cell")
        met = met.where(whole).unionByName(split)
    here = F.struct(col("c").alias("c"), col("g").alias("g"))
    ahead = F.filter(col("ends"), lambda e: here < F.struct(e["c"].alias("c"), e["g"].alias("g")))
    shard = F.coalesce(F.get(col("own"), col("k")), F.get(ahead, F.lit(0))["shard"])
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"]
    return met.select(*kept, shard.cast("int").alias("shard"))


def rewrite(docs: DataFrame, layout: Layout, path: str | None = None, every: bool = False, text: str = "text", old_shard: str | None = None) -> DataFrame:
    """Writes the affected shards of ``docs`` (or with ``every``, for documents that have no
    files yet, all shards) as Parquet, a folder ``shard=N`` each; its rows, read back."""
    path = path or shared_path(docs.sparkSession, "shards")
    placed = place(docs, layout, text, old_shard)
    if not every:
        placed = placed.where(F.col("shard").isin(layout.affected()))
    placed.hint("rebalance", F.col("shard")).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path)


def slotted(files: DataFrame) -> DataFrame:
    """Rows of written shards with ``slot``: 0, 1, .. within a shard, in order of its files and their rows.
    No row is shuffled: what is sent to all tasks has a row a file, as the driver's listing of them has."""
    meta, tmp = files.metadataColumn("_metadata"), unused(files, "__at")
    rows = files.withColumns({f"{tmp}_file": meta["file_path"], f"{tmp}_row": meta["row_index"]})
    counts = rows.groupBy("shard", f"{tmp}_file").agg(F.count("*").alias(f"{tmp}_n"))
    before = Window.partitionBy("shard").orderBy(f"{tmp}_file").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(f"{tmp}_file").alias(f"{tmp}_of"), F.coalesce(F.sum(f"{tmp}_n").over(before), F.lit(0)).alias(f"{tmp}_first"))
    met = rows.join(F.broadcast(first), F.col(f"{tmp}_file") == F.col(f"{tmp}_of"))
    kept = [F.col(f"`{c}`") for c in files.columns if c.lower() != "slot"]
    return met.select(*kept, (F.col(f"{tmp}_first") + F.col(f"{tmp}_row")).cast("long").alias("slot"))
