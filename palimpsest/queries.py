"""The registered queries over the driver's tables, and their SQL twins.

``L`` is the change log in ``events``: seq is the event id plus one, the key is the
user, the value the properties, and an error is a delete. ``epoch`` cuts it into
flushes of 500 records. ``O`` is the one in ``orders``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import model, scalar
from palimpsest.operators import lww, read, stats
from palimpsest.plans.table import KvTable, with_seqs
from palimpsest.shell import parsed
from palimpsest.shared import shared_folder
from palimpsest.shipping import ship
from palimpsest.sources import sst, wal
from palimpsest.sources.manifest_text import parsed_lines
from palimpsest.streaming import upsert

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_L = """L AS (
  SELECT event_id + 1 AS seq, printf('user:%06d', user_id) AS key, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, event_id // 500 AS epoch FROM events)"""
_O = """O AS (
  SELECT o_orderkey + 1 AS seq, printf('cust:%06d', o_custkey) AS key, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS value FROM orders)"""
_NOW = "cur AS (SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM L) WHERE rn = 1)"
_SEG = "seg AS (SELECT epoch, key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY epoch, key ORDER BY seq DESC) AS rn FROM L) WHERE rn = 1)"


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_type") != "error", F.col("props"))
    return events.select((F.col("event_id") + 1).alias("seq"), F.format_string("user:%06d", "user_id").alias("key"), value.alias("value"), F.floor(F.col("event_id") / 500).alias("epoch"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
    return orders.select((F.col("o_orderkey") + 1).alias("seq"), F.format_string("cust:%06d", "o_custkey").alias("key"), value.alias("value"))


def segments(log: DataFrame) -> DataFrame:
    """One version a key and epoch, as flushes at epoch ends would leave."""
    return lww.first_of_each(log, ("epoch", "key"), [F.desc("seq")]).select("epoch", "key", "seq", "value")


def _new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def _text(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("seq").cast("long").alias("seq"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {_L}, {_NOW} SELECT key, value FROM cur WHERE value IS NOT NULL ORDER BY key")
def kv_scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(change_log(spark, sf_dir))


@query(f"WITH {_L}, {_NOW} SELECT key, value FROM cur WHERE value IS NOT NULL AND key >= 'user:000020' AND key < 'user:000090' ORDER BY key")
def kv_scan_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(change_log(spark, sf_dir), "user:000020", "user:000090")


@query(f"WITH {_L}, {_NOW} SELECT key, value FROM cur WHERE value IS NOT NULL AND key >= 'user:000100' ORDER BY key")
def kv_scan_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(change_log(spark, sf_dir), "user:000100")


@query(f"WITH {_L}, {_NOW} SELECT key, value FROM cur WHERE value IS NOT NULL AND key < 'user:000050' ORDER BY key")
def kv_scan_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(change_log(spark, sf_dir), end="user:000050")


@query(f"WITH {_L}, {_NOW} SELECT key, value FROM cur WHERE value IS NOT NULL AND key >= 'user:000090' AND key < 'user:000020'")
def kv_scan_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(change_log(spark, sf_dir), "user:000090", "user:000020")


@query(f"WITH {_O}, cur AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM O) WHERE rn = 1) SELECT key, value FROM cur WHERE value IS NOT NULL ORDER BY key")
def kv_scan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.scan(order_log(spark, sf_dir))


@query(f"WITH {_L}, {_NOW} SELECT key FROM cur ORDER BY key")
def kv_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.keys(change_log(spark, sf_dir))


@query(f"WITH {_L}, {_NOW} SELECT seq, value FROM cur WHERE key = 'user:000001' AND value IS NOT NULL")
def kv_get_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.get(change_log(spark, sf_dir), "user:000001")


_DEAD = "(SELECT min(key) FROM cur WHERE value IS NULL)"


@query(f"WITH {_L}, {_NOW} SELECT seq, value FROM cur WHERE key = {_DEAD} AND value IS NOT NULL")
def kv_get_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest deleted key: a read finds nothing."""
    log = change_log(spark, sf_dir)
    dead = lww.newest(log).where("value IS NULL").agg(F.min("key")).first()[0]
    return read.get(log, dead)


@query(f"WITH {_L}, {_NOW} SELECT seq, value FROM cur WHERE key = {_DEAD}")
def kv_get_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with tombstones visible."""
    log = change_log(spark, sf_dir)
    dead = lww.newest(log).where("value IS NULL").agg(F.min("key")).first()[0]
    return read.get_entry(log, dead)


@query(f"WITH {_L}, {_NOW} SELECT seq, value FROM cur WHERE key = 'user:absent'")
def kv_get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.get(change_log(spark, sf_dir), "user:absent")


@query(f"WITH {_L} SELECT count(*) > 0 AS present FROM L WHERE key = 'user:000003'")
def kv_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.contains(change_log(spark, sf_dir), "user:000003")


@query(f"WITH {_L}, {_NOW}, asked AS (SELECT DISTINCT printf('user:%06d', c_custkey * 3) AS key FROM customer) SELECT asked.key, cur.seq, cur.value FROM asked LEFT JOIN cur ON asked.key = cur.key AND cur.value IS NOT NULL")
def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.format_string("user:%06d", F.col("c_custkey") * 3).alias("key"))
    return read.multi_get(change_log(spark, sf_dir), asked)


@query(f"WITH {_L}, {_NOW} SELECT key, seq, value FROM cur ORDER BY key")
def kv_memtable_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.entries(change_log(spark, sf_dir))


@query(f"WITH {_L} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM L WHERE seq <= 250) WHERE rn = 1")
def kv_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state as it was after record 250."""
    return lww.as_of(change_log(spark, sf_dir), 250)


@query(f"WITH {_L} SELECT coalesce(max(seq), 0) AS max_seq FROM L")
def kv_replay_max_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.max_seq(change_log(spark, sf_dir))


@query(f"WITH {_L}, {_O} SELECT greatest((SELECT max(seq) FROM L), (SELECT max(seq) FROM O)) AS seq")
def kv_recovered_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.recovered_seq(change_log(spark, sf_dir), order_log(spark, sf_dir))


@query(
    f"""WITH {_L}, arrived AS (
  SELECT key, seq % 40 AS seq, value, (seq * 7919) % 100003 AS arrival FROM L)
SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, arrival) AS rn FROM arrived) WHERE rn = 1"""
)
def kv_stale_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled arrivals with equal seqs: of those the first to arrive wins."""
    rows = change_log(spark, sf_dir).select("key", (F.col("seq") % 40).alias("seq"), "value", ((F.col("seq") * 7919) % 100003).alias("arrival"))
    return lww.stale_gate(rows)


@query(f"WITH {_L}, {_NOW} SELECT count(*) AS entries, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS approx_size FROM cur")
def kv_approx_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.approx_size(change_log(spark, sf_dir))


_RECORD = "strlen(key) + CASE WHEN value IS NULL THEN 17 ELSE 21 + strlen(value) END"


@query(f"WITH {_L}, {_SEG} SELECT epoch, count(*) AS n_entries, max(seq) AS max_seq, min(key) AS min_key, max(key) AS max_key, CAST(sum({_RECORD}) AS BIGINT) AS record_bytes FROM seg GROUP BY epoch")
def kv_segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.segment_stats(segments(change_log(spark, sf_dir)), "epoch")


@query(f"WITH {_L} SELECT CAST(sum(strlen(key) + CASE WHEN value IS NULL THEN 21 ELSE 25 + strlen(value) END) AS BIGINT) AS log_bytes FROM L")
def kv_wal_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.total_log_bytes(change_log(spark, sf_dir))


@query(
    """SELECT CAST(t AS INTEGER) AS trigger, CAST(f AS INTEGER) AS flushes,
  CAST(CASE WHEN t = 0 THEN f WHEN t = 1 THEN CASE WHEN f = 1 THEN 1 ELSE 0 END ELSE f % t END AS INTEGER) AS l0,
  CAST(CASE WHEN t = 0 THEN 0 WHEN t = 1 THEN CASE WHEN f > 1 THEN 1 ELSE 0 END WHEN f >= t THEN 1 ELSE 0 END AS INTEGER) AS l1
FROM range(8) AS a(t), range(60) AS b(f)"""
)
def kv_level_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(480).select((F.col("id") % 8).cast("int").alias("trigger"), F.floor(F.col("id") / 8).cast("int").alias("flushes"))
    l0, l1 = stats.level_layout(F.col("flushes"), F.col("trigger"))
    return grid.select("trigger", "flushes", l0.alias("l0"), l1.alias("l1"))


@query(f"WITH {_L}, {_SEG} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch DESC) AS rn FROM seg) WHERE rn = 1")
def kv_first_match_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest segment that has a key answers for it, whatever the seqs."""
    return lww.first_match(segments(change_log(spark, sf_dir)).withColumn("source_rank", -F.col("epoch")))


@query(
    f"""WITH {_L}, {_SEG}, {_NOW}, first AS (SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch DESC) AS rn FROM seg) WHERE rn = 1)
SELECT count(*) FILTER (WHERE a.key IS NULL OR b.key IS NULL OR a.seq <> b.seq OR a.value IS DISTINCT FROM b.value) AS differences, count(*) AS keys FROM first a FULL JOIN cur b ON a.key = b.key"""
)
def kv_get_equals_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys for which the first match and the highest seq differ: none while ranks follow seqs."""
    held = segments(change_log(spark, sf_dir)).withColumn("source_rank", -F.col("epoch"))
    met = lww.first_match(held).unionByName(lww.newest(held)).groupBy("key", "seq", "value").agg(F.count("*").alias("n"))
    return met.groupBy("key").agg(F.min("n").alias("n")).agg(F.count_if(F.col("n") < 2).alias("differences"), F.count("*").alias("keys"))


@query(f"WITH {_L}, {_O}, both_ AS (SELECT key, seq, value, 0 AS r FROM L UNION ALL SELECT replace(key, 'cust', 'user'), seq, value, 1 FROM O) SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, r) AS rn FROM both_) WHERE rn = 1")
def kv_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs with the same keys: of equal seqs the first source's version."""
    other = order_log(spark, sf_dir).withColumn("key", F.regexp_replace("key", "cust", "user"))
    return lww.merge(change_log(spark, sf_dir), other)


def _compaction(gc: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = change_log(spark, sf_dir)
        last = F.floor(F.lit(log.agg(F.max("epoch")).first()[0]))
        held = lww.newest(log.where(F.col("epoch") < last))
        return lww.compacted(held, log.where(F.col("epoch") == last).select("key", "seq", "value"), gc)

    run.__name__ = f"kv_compact_{gc}"
    return run


_OLD = f"WITH {_L}, top AS (SELECT max(epoch) AS e FROM L), old AS (SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM L WHERE epoch < (SELECT e FROM top)) WHERE rn = 1)"
query(f"{_OLD} SELECT key, seq, value FROM old")(_compaction("none"))
query(f"{_OLD} SELECT key, seq, value FROM old WHERE value IS NOT NULL OR key NOT IN (SELECT key FROM L WHERE epoch = (SELECT e FROM top))")(_compaction("as_coded"))
query(f"{_OLD} SELECT key, seq, value FROM old WHERE value IS NOT NULL")(_compaction("full"))


@query(f"WITH {_L} SELECT key, count(DISTINCT epoch) AS n_segments FROM L GROUP BY key")
def kv_read_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.read_amplification(segments(change_log(spark, sf_dir)), "epoch")


@query(
    """WITH g AS (SELECT n, p, greatest(8, CAST(ceil(-n * ln(p) / (ln(2.0) * ln(2.0))) AS BIGINT)) AS m FROM (VALUES (1), (10), (100), (1000), (10000), (123457), (1000000)) AS a(n), (VALUES (CAST(0.01 AS DOUBLE)), (0.001), (0.05), (0.5)) AS b(p))
SELECT CAST(n AS BIGINT) AS n, p, m AS num_bits, CAST(greatest(1, ceil(CAST(m AS DOUBLE) / n * ln(2.0))) AS INTEGER) AS num_hashes, CAST(16 + ceil(m / 8.0) AS BIGINT) AS size FROM g"""
)
def kv_bloom_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(n, p) for n in (1, 10, 100, 1000, 10_000, 123_457, 1_000_000) for p in (0.01, 0.001, 0.05, 0.5)], "n bigint, p double")
    n, p = F.col("n"), F.col("p")
    return grid.select("n", "p", scalar.bloom_bits(n, p).alias("num_bits"), scalar.bloom_hashes(n, p).alias("num_hashes"), scalar.bloom_bytes(n, p).alias("size"))


def _fnv_sql(basis: int) -> str:
    octets = "list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS UHUGEINT))"
    return f"CAST(list_reduce(list_prepend(CAST({basis} AS UHUGEINT), {octets}), lambda h, x: (xor(h, x) * CAST({scalar.FNV_PRIME} AS UHUGEINT)) % CAST({scalar.TWO_64} AS UHUGEINT)) AS VARCHAR)"


@query(f"WITH {_L} SELECT key, {_fnv_sql(scalar.FNV_BASIS_1)} AS h1, {_fnv_sql(scalar.FNV_BASIS_2)} AS h2 FROM (SELECT DISTINCT key FROM L)")
def kv_fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both hashes of every key, as decimal digits."""
    keys = change_log(spark, sf_dir).select("key").distinct()
    return keys.select("key", scalar.fnv1a(F.col("key")).cast("string").alias("h1"), scalar.fnv1a(F.col("key"), scalar.FNV_BASIS_2).cast("string").alias("h2"))


_HASHED = f"SELECT tag, id, CAST({_fnv_sql(scalar.FNV_BASIS_1)} AS UHUGEINT) AS h1, CAST({_fnv_sql(scalar.FNV_BASIS_2)} AS UHUGEINT) AS h2 FROM (SELECT tag, id, tag || CAST(id AS VARCHAR) AS key FROM (VALUES ('in:'), ('out:')) AS a(tag), range(10000) AS b(id))"


@query(
    f"""WITH hashed AS ({_HASHED}), bits AS (SELECT tag, id, unnest(list_transform(range(7), lambda i: CAST(((h1 + CAST(i AS UHUGEINT) * h2) % CAST({scalar.TWO_64} AS UHUGEINT)) % CAST(95851 AS UHUGEINT) AS BIGINT))) AS bit FROM hashed),
held AS (SELECT DISTINCT bit FROM bits WHERE tag = 'in:'), asked AS (SELECT id, bool_and(bit IN (SELECT bit FROM held)) AS maybe FROM bits WHERE tag = 'out:' GROUP BY id)
SELECT count(*) AS asked, count(*) FILTER (WHERE maybe) AS false_positives FROM asked"""
)
def kv_bloom_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 keys in, 10,000 others asked: how many of these seem to be there."""
    bits, hashes = 95_851, 7
    indexes = scalar.bit_indexes_udf(bits, hashes)
    key = lambda tag: F.concat(F.lit(tag), F.col("id").cast("string")).cast("binary")
    held = spark.range(10_000).select(F.explode(indexes(key("in:"))).alias("bit")).distinct()
    asked = spark.range(10_000).select("id", F.explode(F.array_distinct(indexes(key("out:")))).alias("bit"))
    hits = asked.join(held.withColumn("_set", F.lit(1)), "bit", "left").groupBy("id").agg(F.every(F.col("_set").isNotNull()).alias("maybe"))
    return hits.agg(F.count("*").alias("asked"), F.count_if("maybe").alias("false_positives"))


def _le_sql(number: str, width: int) -> str:
    return f"list_transform(range({width}), lambda i: (CAST({number} AS BIGINT) >> (8 * i)) & 255)"


def _octets_sql(text: str) -> str:
    return f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"


def _crc_sql(octets: str) -> str:
    """CRC-32 of a list of octets, bit by bit."""
    octet = "list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda b, _: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, x: {octet}), 4294967295)"


_SEGMENT_BODY = f"list_concat({_le_sql('length(key)', 4)}, {_octets_sql('key')}, {_le_sql('seq', 8)}, CASE WHEN value IS NULL THEN [0] ELSE list_concat([1], {_le_sql('length(value)', 4)}, {_octets_sql('value')}) END)"
_LOG_BODY = f"list_concat({_le_sql('seq', 8)}, [CASE WHEN value IS NULL THEN 1 ELSE 0 END], {_le_sql('length(key)', 4)}, {_octets_sql('key')}, CASE WHEN value IS NULL THEN [] ELSE list_concat({_le_sql('length(value)', 4)}, {_octets_sql('value')}) END)"


@query(f"WITH {_L}, {_NOW} SELECT key, seq, CAST({_crc_sql(_SEGMENT_BODY)} AS BIGINT) AS segment_crc32, CAST({_crc_sql(_LOG_BODY)} AS BIGINT) AS log_crc32 FROM cur")
def kv_record_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of each current version's segment record and log record, assembled in SQL."""
    now = lww.newest(change_log(spark, sf_dir))
    key, seq, value = F.col("key"), F.col("seq"), F.col("value")
    return now.select("key", "seq", F.crc32(scalar.record_body(key, seq, value)).alias("segment_crc32"), F.crc32(scalar.log_body(seq, key, value)).alias("log_crc32"))


_NAME = "'sst-' || lpad(CAST(max_seq AS VARCHAR), 20, '0') || '-' || CAST(1700000000000 + epoch AS VARCHAR) || '.sst'"


@query(
    f"""WITH {_L}, s AS (SELECT epoch, max(seq) AS max_seq FROM L GROUP BY epoch)
SELECT CAST(epoch AS BIGINT) AS line_no, CAST(epoch % 2 AS INTEGER) AS level, {_NAME} AS filename FROM s WHERE epoch % 5 <> 4"""
)
def kv_manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a text manifest, every fifth a comment."""
    made = change_log(spark, sf_dir).groupBy("epoch").agg(F.max("seq").alias("max_seq"))
    name = scalar.segment_name(F.col("max_seq"), F.lit(1700000000000) + F.col("epoch"))
    line = F.when(F.col("epoch") % 5 == 4, F.concat(F.lit("# "), name)).otherwise(F.concat(F.lit(" L"), (F.col("epoch") % 2).cast("string"), F.lit(":"), name, F.lit(" ")))
    return parsed_lines(made.select(F.col("epoch").alias("line_no"), line.alias("value")))


@query(f"WITH {_L}, s AS (SELECT epoch, max(seq) AS max_seq FROM L GROUP BY epoch) SELECT CAST(row_number() OVER (ORDER BY {_NAME} DESC) AS INTEGER) AS ordinal, {_NAME} AS filename FROM s")
def kv_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment names, newest first: one row a segment."""
    made = change_log(spark, sf_dir).groupBy("epoch").agg(F.max("seq").alias("max_seq"))
    names = made.select(scalar.segment_name(F.col("max_seq"), F.lit(1700000000000) + F.col("epoch")).alias("filename"))
    return names.select(F.row_number().over(Window.orderBy(F.desc("filename"))).alias("ordinal"), "filename")


@query(f"WITH {_L} SELECT seq, key, value, strlen(key) BETWEEN 1 AND 65536 AND coalesce(strlen(value), 0) <= 10485760 AS valid FROM (SELECT seq, CASE WHEN seq % 97 = 0 THEN '' WHEN seq % 89 = 0 THEN repeat('k', 65537) ELSE key END AS key, value FROM L)")
def kv_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows the limits let through: some keys are made empty or too long."""
    log = change_log(spark, sf_dir)
    key = F.when(F.col("seq") % 97 == 0, "").when(F.col("seq") % 89 == 0, F.repeat(F.lit("k"), 65_537)).otherwise(F.col("key"))
    return log.select("seq", key.alias("key"), "value").withColumn("valid", model.is_valid())


_SIZE = "(a.held + CASE WHEN x.before > a.since THEN x.v - x.had ELSE x.k + x.v END)"


@query(
    f"""WITH {_L}, sized AS (
  SELECT seq, strlen(key) AS k, coalesce(strlen(value), 0) AS v, coalesce(lag(seq) OVER w, -1) AS before, coalesce(lag(coalesce(strlen(value), 0)) OVER w, 0) AS had FROM L WINDOW w AS (PARTITION BY key ORDER BY seq)),
steps AS (SELECT list(struct_pack(seq := seq, k := k, v := v, before := before, had := had, since := CAST(-1 AS BIGINT), held := CAST(0 AS BIGINT), sizes := CAST([] AS BIGINT[])) ORDER BY seq) AS l FROM sized),
fold AS (SELECT list_reduce(list_prepend(struct_pack(seq := CAST(0 AS BIGINT), k := CAST(0 AS BIGINT), v := CAST(0 AS BIGINT), before := CAST(-1 AS BIGINT), had := CAST(0 AS BIGINT), since := CAST(-1 AS BIGINT), held := CAST(0 AS BIGINT), sizes := CAST([] AS BIGINT[])), l),
  lambda a, x: struct_pack(seq := x.seq, k := x.k, v := x.v, before := x.before, had := x.had,
    since := CASE WHEN {_SIZE} >= 1024 THEN x.seq ELSE a.since END, held := CASE WHEN {_SIZE} >= 1024 THEN 0 ELSE {_SIZE} END, sizes := list_append(a.sizes, {_SIZE}))).sizes AS sizes, l FROM steps)
SELECT s.seq AS seq, size AS memtable_size, size >= 1024 AS flush FROM (SELECT unnest(l) AS s, unnest(sizes) AS size FROM fold)"""
)
def kv_flush_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where flushes at 1,024 bytes fall, and the memtable's size after each record."""
    return stats.flush_points(change_log(spark, sf_dir), 1024)


@query(f"WITH {_L} SELECT seq, key, value FROM L")
def kv_assign_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers given anew, in order, by partitions: they come out as they were."""
    log = change_log(spark, sf_dir).select("key", "value", F.col("seq").alias("was"))
    return with_seqs(log, ("was",), 0).select("seq", "key", "value")


_COMMANDS = ["SET a  1", "set b 2   x", "SET c 3", "SET d 4", "DEL b", "FLUSH", "GET b", "GET c", "SCAN", "SCAN b d", "SET e", "FOO", "", "COMPACT", "EXIT", "GET a"]


@query(
    """SELECT * FROM (VALUES (0, 'SET', 'a', '1'), (1, 'SET', 'b', '2 x'), (2, 'SET', 'c', '3'), (3, 'SET', 'd', '4'), (4, 'DEL', 'b', ''), (5, 'FLUSH', NULL, ''), (6, 'GET', 'b', ''), (7, 'GET', 'c', ''), (8, 'SCAN', NULL, ''), (9, 'SCAN', 'b', 'd'), (10, 'SET', 'e', ''), (11, 'FOO', NULL, ''), (12, NULL, NULL, ''), (13, 'COMPACT', NULL, ''), (14, 'EXIT', NULL, ''), (15, 'GET', 'a', '')) AS v(line_no, verb, key, rest)"""
)
def kv_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the shell takes command lines apart."""
    lines = spark.createDataFrame(list(enumerate(_COMMANDS)), "line_no int, line string")
    return parsed(lines).select("line_no", "verb", F.get("args", F.lit(0)).alias("key"), "rest")


@query(f"WITH {_L}, {_NOW} SELECT key, value FROM cur WHERE value IS NOT NULL")
def kv_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log appended to a table in three batches, compacted, and scanned from its segments."""
    log = change_log(spark, sf_dir)
    third = F.ceil(F.col("seq") * 3 / F.lit(log.agg(F.max("seq")).first()[0]))
    table = KvTable(spark, _new_path(spark, "table"), l0_trigger=0)
    for i in (1, 2, 3):
        table.append(log.where(third == i).select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.col("seq").alias("at")), "at")
    table.compact()
    return table.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))



@query(f"WITH {_L} SELECT seq, key, value FROM L")
def kv_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as framed log files and read back."""
    path = _new_path(spark, "log")
    wal.write_log(change_log(spark, sf_dir), path)
    return _text(wal.read_log(spark, path))


def _segment_round_trip(version: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _new_path(spark, "segments")
        sst.write_segments(lww.newest(change_log(spark, sf_dir)), path, version)
        return _text(sst.read_segments(spark, path))

    run.__name__ = f"kv_segment_round_trip_v{version}"
    return run


for _version in (1, 2, 3):
    query(f"WITH {_L}, {_NOW} SELECT seq, key, value FROM cur")(_segment_round_trip(_version))


@query(f"WITH {_L}, {_NOW} SELECT key, value FROM cur WHERE value IS NOT NULL")
def kv_stream_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log streamed file by file into a table, each micro-batch a segment, and scanned."""
    source, log = _new_path(spark, "stream"), change_log(spark, sf_dir)
    rows = log.select("seq", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    rows.repartitionByRange(3, "seq").write.parquet(source)
    table = KvTable(spark, _new_path(spark, "table"))
    upsert.fold_batches(spark, source, rows.schema, table, _new_path(spark, "marks"))
    return table.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
