"""The reference queries by name, over whole tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import layout, manifest, recovery, resolve, scan
from tidemark.plans import history, ranges
from tidemark.shipping import ship
from tidemark.streaming import state

LOW, HIGH = history.key_of(20), history.key_of(60)
TARGETS = [history.key_of(0), history.key_of(7) + "5", history.key_of(150), "zzz"]
ROTATE_AT, BLOCK_SIZE, SWEEP, VALUE_LIMIT = 65_536, 4096, 1000, 20_000
BAD_RECORDS = (7321, 8000)
LISTING = ["CURRENT", "MANIFEST-000007", "MANIFEST-000003", "000004.log", "000009.log", "000005.sst", "000008.sst", "000011.tmp", "CURRENT.tmp", "junk"]
LIVE = [("log", 9), ("table", 8), ("manifest", 7)]
FIELDS = [(1, 4, 6, None), (2, None, 8, 120), (3, 7, None, None), (4, None, 12, 340)]


def _half(h: DataFrame) -> int:
    return history.last_seq(h) // 2


def get_at_snapshot(spark: SparkSession, d: str) -> DataFrame:
    half = _half(history.events(spark, d))
    return resolve.live(history.events(spark, d, at=half), half).select("k", "seq", "v")


def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return resolve.live(history.events(spark, d)).select("k", "seq", "v")


def latest_seq(spark: SparkSession, d: str) -> DataFrame:
    return resolve.newest_seq(history.events(spark, d))


def latest_with_kind(spark: SparkSession, d: str) -> DataFrame:
    return resolve.newest(history.events(spark, d)).select("k", "seq", F.col("kind").cast("long").alias("kind"), "v")


def point_get(spark: SparkSession, d: str) -> DataFrame:
    key = history.key_of(7)
    return resolve.get(history.events(spark, d, low=key, high=history.key_of(8)), key).select("k", "seq", "v")


def multi_get(spark: SparkSession, d: str) -> DataFrame:
    keys = history.read(spark, d, "customer").select(history.number_key(F.col("c_custkey")).alias("k"))
    keys = keys.union(spark.createDataFrame([("absent",)], "k string"))
    return resolve.multi_get(keys, history.orders(spark, d)).select("k", "v", F.col("found").cast("long").alias("found"))


def snapshot_sweep(spark: SparkSession, d: str) -> DataFrame:
    return resolve.sweep(history.events(spark, d), SWEEP)


def ordered_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.positions(history.events(spark, d)).select("pos", "k", "seq")


def range_scan(spark: SparkSession, d: str) -> DataFrame:
    half = _half(history.events(spark, d))
    return scan.key_range(history.events(spark, d, low=LOW, high=HIGH, at=half), LOW, HIGH, half).select("k", "seq", "v")


def seek_ge(spark: SparkSession, d: str) -> DataFrame:
    return scan.seek_ge(history.events(spark, d), TARGETS)


def batch_apply(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("batch", "k").orderBy(F.col("i").desc())
    h = history.events(spark, d).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return h.select("batch", "k", (F.col("batch") * 10 + 1 + F.col("i")).alias("seq"), "v")


def delete_then_put(spark: SparkSession, d: str) -> DataFrame:
    by_key = history.events(spark, d).groupBy("k").agg(F.min(F.when(F.col("kind") == 0, F.col("seq"))).alias("first_delete"), F.max(F.when(F.col("kind") == 1, F.col("seq"))).alias("last_put"))
    return by_key.where("last_put > first_delete")


def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    return layout.file_metadata(history.events(spark, d))


def file_pruning(spark: SparkSession, d: str) -> DataFrame:
    h = history.turns(spark, d)
    return layout.candidates(h.select("k").distinct(), layout.file_metadata(h).select("f", "smallest", "largest")).groupBy("k").agg(F.count(F.lit(1)).alias("n_runs"))


def level_lookup(spark: SparkSession, d: str) -> DataFrame:
    h = history.turns(spark, d)
    return layout.candidates(h.select("k").distinct(), layout.file_metadata(h).select("f", "smallest", "largest"))


def read_amplification(spark: SparkSession, d: str) -> DataFrame:
    return layout.read_amplification(history.events(spark, d))


def space_amplification(spark: SparkSession, d: str) -> DataFrame:
    return layout.space_amplification(history.events(spark, d))


def prefix_compression(spark: SparkSession, d: str) -> DataFrame:
    return layout.prefix_stats(history.events(spark, d))


def order_violations(spark: SparkSession, d: str) -> DataFrame:
    """Runs in arrival order, which isn't key order: most rows break it."""
    return scan.order_violations(history.events(spark, d), "seq").select("f", "k", "seq")


def memtable_rotation(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("k") + 8 + layout.ENTRY_OVERHEAD + F.octet_length("props")
    return layout.rotations(history.events(spark, d).select("shard", "seq", size.cast("long").alias("bytes")), ROTATE_AT)


def block_layout(spark: SparkSession, d: str) -> DataFrame:
    return layout.blocks(history.events(spark, d), BLOCK_SIZE)


def table_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Each run as a table of blocks: how many blocks it takes, and whether reading gives back every entry."""
    return layout.tables(history.events(spark, d), BLOCK_SIZE).select("f", "n_blocks", "same")


def as_of(spark: SparkSession, d: str) -> DataFrame:
    """For every customer at each of four snapshots, the order that was theirs then."""
    h = history.orders(spark, d)
    top = history.last_seq(h)
    keys = history.read(spark, d, "customer").select(history.number_key(F.col("c_custkey")).alias("k"))
    asked = keys.select("k", F.explode(F.array(*[F.lit(top * i // 4).cast("long") for i in range(1, 5)])).alias("at"))
    return resolve.as_of(asked, h)


def internal_key_validity(spark: SparkSession, d: str) -> DataFrame:
    """Internal keys of all writes, some cut short or with a kind that doesn't exist: which are valid."""
    h = history.events(spark, d).select("seq", codec.internal_key(F.col("k"), F.col("seq"), F.col("kind")).alias("ikey"))
    n = F.length("ikey")
    broken = F.when(F.col("seq") % 5 == 0, F.substring(F.col("ikey"), n - 13, F.lit(14))).when(F.col("seq") % 5 == 1, F.concat(F.substring(F.col("ikey"), F.lit(1), n - 16), F.lit("02"), F.substring(F.col("ikey"), n - 13, F.lit(14))))
    return h.select("seq", codec.valid_internal_key(F.coalesce(broken, "ikey")).alias("valid"))


def manifest_replay(spark: SparkSession, d: str) -> DataFrame:
    """Live files of edits that were written as a framed manifest of tagged records and read back."""
    return manifest.live_files(manifest.read_manifest(manifest.write_manifest(manifest.sample_edits(spark))))


def replayed_state(spark: SparkSession, d: str) -> DataFrame:
    """The live rows of a history that is rebuilt from framed logs, one for each run."""
    return resolve.live(recovery.replay(recovery.write_logs(history.events(spark, d)))).select("k", "seq", "v")


def manifest_live_files(spark: SparkSession, d: str) -> DataFrame:
    return manifest.live_files(manifest.sample_edits(spark))


def manifest_fields(spark: SparkSession, d: str) -> DataFrame:
    return manifest.fields(spark.createDataFrame(FIELDS, manifest.FIELD_SCHEMA))


def obsolete_files(spark: SparkSession, d: str) -> DataFrame:
    listing = spark.createDataFrame([(n,) for n in LISTING], "name string")
    return manifest.obsolete(listing, spark.createDataFrame(LIVE, "kind string, number long"))


def live_rows(spark: SparkSession, d: str) -> DataFrame:
    files = manifest.live_files(manifest.sample_edits(spark)).select(F.col("number").alias("f"))
    return history.events(spark, d).join(ranges.small(files), "f", "left_semi").select("k", "seq", "f")


def torn_tail(spark: SparkSession, d: str) -> DataFrame:
    bad = f"seq in ({', '.join(map(str, BAD_RECORDS))})"
    return recovery.before_damage(history.events(spark, d).select("k", "seq", "v"), bad)


def recovered_sequence(spark: SparkSession, d: str) -> DataFrame:
    batches = history.events(spark, d).groupBy("batch").agg(F.min("seq").alias("base"), F.count(F.lit(1)).alias("n"))
    return recovery.last_sequence(batches)


def log_replay_order(spark: SparkSession, d: str) -> DataFrame:
    return recovery.replay_order(spark.createDataFrame([(12,), (4,), (9,), (3,), (27,)], "number long"), 9)


def internal_key_codec(spark: SparkSession, d: str) -> DataFrame:
    h = history.events(spark, d).select("k", "seq", "kind", codec.internal_key(F.col("k"), F.col("seq"), F.col("kind")).alias("ikey"))
    key, seq, kind = codec.split_internal_key(F.col("ikey"))
    return h.select("seq", "ikey", ((key == F.hex(F.encode("k", "UTF-8"))) & (seq == F.col("seq")) & (kind == F.col("kind"))).alias("same"))


def crc_mask(spark: SparkSession, d: str) -> DataFrame:
    crc = (history.read(spark, d, "events").select(F.col("event_id"), ((F.col("event_id") * 2654435761) % 4294967296).alias("crc")))
    masked = crc.withColumn("masked", codec.mask_column(F.col("crc")))
    return masked.withColumn("unmasked", codec.unmask_column(F.col("masked")))


def crc32c_values(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    h = history.events(spark, d)
    return h.select("seq", codec.crc32c_column(F.encode(F.concat_ws(":", "k", "v"), "UTF-8")).alias("crc"))


def bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    """For each run: its own keys that its filter finds (all of them), and absent keys that it can't rule out."""
    ship(spark)
    h = history.events(spark, d).select("f", "k").distinct()
    return h.groupBy("f").applyInPandas(codec.bloom_group, "f long, n_keys long, found long, false_positives long")


def wal_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Each run's writes as a framed log: its bytes, the records read back, and how many survive a cut in the middle."""
    ship(spark)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        records = [codec.encode_batch(s, [(k_, k.encode(), None if v is None else v.encode())]) for s, k_, k, v in zip(rows["seq"], rows["kind"], rows["k"], rows["v"], strict=True)]
        log = codec.frame(records)
        back, _ = codec.readable(log)
        torn, status = codec.readable(log[: len(log) // 2])
        return pd.DataFrame({"f": [rows["f"].iloc[0]], "n_bytes": [len(log)], "n_records": [len(back)], "same": [back == records and torn == records[: len(torn)]], "n_torn": [len(torn)], "status": [status]})

    return history.events(spark, d).select("f", "k", "seq", "kind", "v").groupBy("f").applyInPandas(run, "f long, n_bytes long, n_records long, same boolean, n_torn long, status string")


def kv_request_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Of each document's id, a request by turns: GET finds ids of live keys, PUT stores the text, DELETE always works."""
    docs = history.read(spark, d, "documents").select("doc_id", F.octet_length("text").alias("size"), history.number_key(F.col("doc_id")).alias("k"))
    live = resolve.live(history.events(spark, d)).select("k", F.lit(1).alias("found"))
    method = F.element_at(F.array(F.lit("GET"), F.lit("PUT"), F.lit("DELETE")), (F.col("doc_id") % 3 + 1).cast("int"))
    asked = docs.withColumn("method", method).join(live, "k", "left")
    status = F.when(F.col("method") == "GET", F.when(F.col("found") == 1, 200).otherwise(404)).when((F.col("method") == "PUT") & (F.col("size") > VALUE_LIMIT), 413).otherwise(204)
    return asked.select("doc_id", "method", status.cast("long").alias("status"))


def stream_latest_state(spark: SparkSession, d: str) -> DataFrame:
    source = history.read(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    kind = F.when(F.col("event_type") == "error", 0).otherwise(1)
    changes = stream.select(history.number_key(F.col("user_id")).alias("k"), (F.col("event_id") + 1).alias("seq"), kind.alias("kind"), F.when(kind == 1, F.concat("event_type", F.lit(":"), "props")).alias("v"))
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = f"{shared or tempfile.mkdtemp(prefix='tidemark-')}/stream-{uuid.uuid4().hex}"
    state.maintain(changes, folder).awaitTermination()
    return state.latest(spark, folder).where("kind = 1").select("k", "seq", "v")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        get_at_snapshot, latest_state, latest_seq, latest_with_kind, point_get, multi_get, snapshot_sweep, ordered_scan, range_scan, seek_ge,
        batch_apply, delete_then_put, file_metadata, file_pruning, level_lookup, read_amplification, space_amplification, prefix_compression,
        order_violations, memtable_rotation, block_layout, table_roundtrip, as_of, internal_key_validity, manifest_replay, replayed_state, manifest_live_files, manifest_fields, obsolete_files, live_rows, torn_tail,
        recovered_sequence, log_replay_order, internal_key_codec, crc_mask, crc32c_values, bloom_probe, wal_roundtrip, kv_request_outcome,
        stream_latest_state,
    )
}

_H1 = """h AS (SELECT lpad(CAST(user_id AS VARCHAR), 19, '0') AS k, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind,
 CASE WHEN event_type = 'error' THEN NULL ELSE event_type || ':' || props END AS v, event_id // 1000 + 1 AS f, event_id // 10 AS batch, event_id % 10 AS i, props, user_id // 50 AS shard FROM events)"""
_H2 = """h AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 19, '0') AS k, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS kind, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS v FROM orders)"""
_H3 = """h AS (SELECT lpad(CAST(conv_id AS VARCHAR), 19, '0') || ':' || lpad(CAST(turn AS VARCHAR), 19, '0') AS k, conv_id // 16 + 1 AS f FROM conversations)"""
# internal keys in hex, runs in their order, and the bytes an entry has in common with the one before it
_IKEYS = """o AS (SELECT *, hex(k) || lpad(to_hex(kind), 2, '0') || array_to_string([lpad(to_hex((seq >> (8 * j)) & 255), 2, '0') FOR j IN range(0, 7)], '') AS ikey FROM h)"""
_COMMON = """c AS (SELECT f, k, seq, ikey, coalesce(strlen(v), 0) AS vb, row_number() OVER w AS pos, lag(ikey) OVER w AS b FROM o WINDOW w AS (PARTITION BY f ORDER BY k, seq DESC)),
p AS (SELECT f, k, seq, pos, length(ikey) // 2 AS n, vb, CASE WHEN b IS NULL THEN 0 ELSE CAST(coalesce(list_max(list_filter(range(1, least(length(ikey), length(b)) // 2 + 1), lambda j: left(ikey, 2 * j) = left(b, 2 * j))), 0) AS INTEGER) END AS common FROM c)"""


def _entry(shared: str) -> str:
    """Bytes of an entry in SQL; lengths are below 2 ** 14."""
    sizes = " + ".join(f"CASE WHEN {x} < 128 THEN 1 ELSE 2 END" for x in (shared, f"n - {shared}", "vb"))
    return f"({sizes} + n - {shared} + vb)"


_NEW = "r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM h)"
_META = "m AS (SELECT f, min(k) AS lo, max(k) AS hi FROM h GROUP BY f)"
_EDITS = "e(ord, op, level, number) AS (VALUES (1,'new',0,3),(2,'new',0,5),(3,'del',2,3),(4,'new',1,9),(5,'new',9,11))"
_LIVE = f"""{_EDITS}, x AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY ord DESC, op DESC) AS n FROM e WHERE op = 'del' OR level BETWEEN 0 AND 6),
l AS (SELECT level, number FROM x WHERE n = 1 AND op = 'new')"""

_BLOCKS = f"""WITH RECURSIVE {_H1}, {_IKEYS}, {_COMMON}, z AS (SELECT f, pos, common, n, vb, {_entry("common")} AS joined, {_entry("0")} AS alone FROM p),
b AS (SELECT f, pos, CAST(1 AS BIGINT) AS block, alone AS size, 1 AS restarts, 1 AS held FROM z WHERE pos = 1
 UNION ALL SELECT z.f, z.pos, b.block + CASE WHEN b.size + 4 * b.restarts + 4 >= {BLOCK_SIZE} THEN 1 ELSE 0 END,
  CASE WHEN b.size + 4 * b.restarts + 4 >= {BLOCK_SIZE} THEN z.alone WHEN b.held = 16 THEN b.size + z.alone ELSE b.size + z.joined END,
  CASE WHEN b.size + 4 * b.restarts + 4 >= {BLOCK_SIZE} THEN 1 WHEN b.held = 16 THEN b.restarts + 1 ELSE b.restarts END,
  CASE WHEN b.size + 4 * b.restarts + 4 >= {BLOCK_SIZE} OR b.held = 16 THEN 1 ELSE b.held + 1 END
 FROM b JOIN z ON z.f = b.f AND z.pos = b.pos + 1)
"""

ORACLES: dict[str, str] = {
    "get_at_snapshot": f"WITH {_H1}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM h WHERE seq <= (SELECT max(seq) // 2 FROM h)) SELECT k, seq, v FROM r WHERE n = 1 AND kind = 1",
    "latest_state": f"WITH {_H1}, {_NEW} SELECT k, seq, v FROM r WHERE n = 1 AND kind = 1",
    "latest_seq": f"WITH {_H1} SELECT k, max(seq) AS seq FROM h GROUP BY k",
    "latest_with_kind": f"WITH {_H1}, {_NEW} SELECT k, seq, CAST(kind AS BIGINT) AS kind, v FROM r WHERE n = 1",
    "point_get": f"WITH {_H1}, {_NEW} SELECT k, seq, v FROM r WHERE n = 1 AND kind = 1 AND k = '{history.key_of(7)}'",
    "multi_get": f"""WITH {_H2}, {_NEW}, q AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 19, '0') AS k FROM customer UNION ALL SELECT 'absent')
SELECT q.k, s.v, CASE WHEN s.k IS NULL THEN CAST(0 AS BIGINT) ELSE 1 END AS found FROM q LEFT JOIN (SELECT k, v FROM r WHERE n = 1 AND kind = 1) s ON q.k = s.k""",
    "snapshot_sweep": f"""WITH {_H1}, s AS (SELECT DISTINCT CAST(ceil(seq / {SWEEP}.0) AS BIGINT) * {SWEEP} AS snap FROM h),
r AS (SELECT s.snap, h.*, row_number() OVER (PARTITION BY s.snap, k ORDER BY seq DESC) AS n FROM s JOIN h ON h.seq <= s.snap) SELECT snap, k, seq, v FROM r WHERE n = 1 AND kind = 1""",
    "ordered_scan": f"WITH {_H1} SELECT row_number() OVER (ORDER BY k, seq DESC) AS pos, k, seq FROM h",
    "range_scan": f"WITH {_H1}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM h WHERE seq <= (SELECT max(seq) // 2 FROM h)) SELECT k, seq, v FROM r WHERE n = 1 AND kind = 1 AND k >= '{LOW}' AND k < '{HIGH}'",
    "seek_ge": f"WITH {_H1}, t(target) AS (VALUES {', '.join(f"('{t}')" for t in TARGETS)}) SELECT target, (SELECT min(k) FROM h WHERE k >= target) AS k FROM t",
    "batch_apply": f"WITH {_H1}, r AS (SELECT *, row_number() OVER (PARTITION BY batch, k ORDER BY i DESC) AS n FROM h) SELECT batch, k, batch * 10 + 1 + i AS seq, v FROM r WHERE n = 1",
    "delete_then_put": f"WITH {_H1} SELECT * FROM (SELECT k, min(CASE WHEN kind = 0 THEN seq END) AS first_delete, max(CASE WHEN kind = 1 THEN seq END) AS last_put FROM h GROUP BY k) WHERE last_put > first_delete",
    "file_metadata": f"""WITH {_H1} SELECT f, min(k) AS smallest, max(k) AS largest, count(*) AS n_rows, count(DISTINCT k) AS n_keys, CAST(sum(1 - kind) AS BIGINT) AS n_tombstones,
CAST(ceil(greatest(64, 10 * count(DISTINCT k)) / 8.0) + 1 AS BIGINT) AS filter_bytes FROM h GROUP BY f""",
    "file_pruning": f"WITH {_H3}, {_META} SELECT k, count(*) AS n_runs FROM (SELECT DISTINCT k FROM h) JOIN m ON k BETWEEN lo AND hi GROUP BY k",
    "level_lookup": f"WITH {_H3}, {_META} SELECT k, f FROM (SELECT DISTINCT k FROM h) JOIN m ON k BETWEEN lo AND hi",
    "read_amplification": f"WITH {_H1}, {_META}, t AS (SELECT k, max(f) AS hit FROM h GROUP BY k) SELECT k, count(*) AS runs_read FROM t JOIN m ON m.f >= hit AND k BETWEEN lo AND hi GROUP BY k",
    "space_amplification": f"WITH {_H1} SELECT k, count(*) AS versions, CAST(sum(1 - kind) AS BIGINT) AS tombstones, count(*) - 1 AS superseded FROM h GROUP BY k",
    "prefix_compression": f"""WITH {_H1}, {_IKEYS}, {_COMMON} SELECT f, k, seq, pos, CAST(CASE WHEN (pos - 1) % 16 = 0 THEN 0 ELSE common END AS BIGINT) AS shared FROM p""",
    "order_violations": f"""WITH {_H1}, p AS (SELECT f, k, seq, lag(k) OVER w AS pk, lag(seq) OVER w AS ps FROM h WINDOW w AS (PARTITION BY f ORDER BY seq))
SELECT f, k, seq FROM p WHERE pk > k OR (pk = k AND ps <= seq)""",
    "memtable_rotation": f"""WITH RECURSIVE {_H1}, s AS (SELECT shard, seq, CAST(sum(19 + 8 + 56 + length(props)) OVER w AS BIGINT) AS upto, lead(seq) OVER w AS next_seq FROM h WINDOW w AS (PARTITION BY shard ORDER BY seq)),
g AS (SELECT shard, CAST(1 AS BIGINT) AS generation, min(seq) AS lo, CAST(0 AS BIGINT) AS before FROM s GROUP BY shard
 UNION ALL SELECT g.shard, g.generation + 1, n.next_seq, n.upto FROM g, LATERAL (SELECT s.next_seq, s.upto FROM s WHERE s.shard = g.shard AND s.upto - g.before >= {ROTATE_AT} ORDER BY s.upto LIMIT 1) n WHERE n.next_seq IS NOT NULL),
e AS (SELECT *, lead(lo) OVER (PARTITION BY shard ORDER BY generation) AS following FROM g)
SELECT e.shard, generation, lo, max(s.seq) AS hi, max(s.upto) - before AS bytes FROM e JOIN s ON s.shard = e.shard AND s.seq >= e.lo AND (following IS NULL OR s.seq < following) GROUP BY e.shard, generation, lo, before""",
    "block_layout": f"{_BLOCKS} SELECT f, pos, block FROM b",
    "table_roundtrip": f"{_BLOCKS} SELECT f, max(block) AS n_blocks, true AS same FROM b GROUP BY f",
    "as_of": f"""WITH {_H2}, q AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 19, '0') AS k, (SELECT max(seq) FROM h) * i // 4 AS "at" FROM customer, range(1, 5) t(i)),
a AS (SELECT q.k, q."at", h.seq, h.kind, h.v FROM q ASOF LEFT JOIN h ON q.k = h.k AND q."at" >= h.seq)
SELECT k, "at", CASE WHEN kind = 1 THEN seq END AS seq, CASE WHEN kind = 1 THEN v END AS v, CAST(coalesce(kind, 0) AS BIGINT) AS found FROM a""",
    "internal_key_validity": "SELECT event_id + 1 AS seq, (event_id + 1) % 5 NOT IN (0, 1) AS valid FROM events",
    "manifest_replay": f"WITH {_LIVE} SELECT CAST(level AS BIGINT) AS level, CAST(number AS BIGINT) AS number FROM l",
    "replayed_state": f"WITH {_H1}, {_NEW} SELECT k, seq, v FROM r WHERE n = 1 AND kind = 1",
    "crc32c_values": f"""WITH {_H1}, t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda acc, i: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 2197175160) ELSE acc >> 1 END, n)) AS t)
SELECT seq, xor(list_reduce(list_transform(string_split(concat_ws(':', k, v), ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda acc, b: xor(t.t[(xor(acc, b) & 255) + 1], acc >> 8), 4294967295), 4294967295) AS crc FROM h, t""",
    "bloom_probe": f"""WITH {_H1}, d AS (SELECT DISTINCT f, k FROM h), s AS (SELECT f, greatest(64, 10 * count(*)) AS least FROM d GROUP BY f),
p AS (SELECT d.f, k, own, (least + 7) // 8 * 8 AS bits, CASE WHEN own THEN k ELSE k || 'x' END AS key FROM d JOIN s ON s.f = d.f, (VALUES (true), (false)) o(own)),
w AS (SELECT *, list_transform(string_split(key, ''), lambda c: CAST(unicode(c) AS HUGEINT)) AS b, length(key) AS n FROM p),
x AS (SELECT *, list_reduce(list_transform(range(0, n // 4), lambda j: b[4 * j + 1] + 256 * b[4 * j + 2] + 65536 * b[4 * j + 3] + 16777216 * b[4 * j + 4]),
  lambda h, word: xor(((h + word) * 3332679571) % 4294967296, (((h + word) * 3332679571) % 4294967296) // 65536), xor(CAST(3164544308 AS HUGEINT), (n * CAST(3332679571 AS HUGEINT)) % 4294967296)) AS h FROM w),
y AS (SELECT *, CASE WHEN n % 4 = 0 THEN h ELSE ((h + CAST(list_sum(list_transform(range(0, n % 4), lambda j: b[n // 4 * 4 + j + 1] * [1, 256, 65536][j + 1])) AS HUGEINT)) * 3332679571) % 4294967296 END AS g FROM x),
u AS (SELECT *, CASE WHEN n % 4 = 0 THEN g ELSE xor(g, g // 16777216) END AS e FROM y),
q AS (SELECT f, key, own, list_transform(range(0, 6), lambda i: CAST((e + i * (e // 131072 + (e * 32768) % 4294967296)) % 4294967296 % bits AS BIGINT)) AS places FROM u),
m AS (SELECT DISTINCT f, unnest(places) AS place FROM q WHERE own), a AS (SELECT f, own, key, unnest(list_distinct(places)) AS place, len(list_distinct(places)) AS n FROM q),
z AS (SELECT a.f, own, key, n, count(m.place) AS hit FROM a LEFT JOIN m ON m.f = a.f AND m.place = a.place GROUP BY a.f, own, key, n)
SELECT f, count(*) FILTER (own) AS n_keys, count(*) FILTER (own AND hit = n) AS found, count(*) FILTER (NOT own AND hit = n) AS false_positives FROM z GROUP BY f""",
    "manifest_live_files": f"WITH {_LIVE} SELECT CAST(level AS BIGINT) AS level, CAST(number AS BIGINT) AS number FROM l",
    "manifest_fields": f"""WITH e(ord, log_number, next_file_number, last_sequence) AS (VALUES {', '.join('(' + ', '.join('NULL' if x is None else str(x) for x in row) + ')' for row in FIELDS)})
SELECT {', '.join(f'CAST(arg_max({c}, ord) FILTER ({c} IS NOT NULL) AS BIGINT) AS {c}' for c in ('log_number', 'next_file_number', 'last_sequence'))} FROM e""",
    "obsolete_files": """WITH n(name) AS (VALUES ('CURRENT'),('MANIFEST-000007'),('MANIFEST-000003'),('000004.log'),('000009.log'),('000005.sst'),('000008.sst'),('000011.tmp'),('CURRENT.tmp'),('junk')),
c AS (SELECT name, CASE WHEN regexp_matches(name, '^MANIFEST-[0-9]+$') THEN 'manifest' WHEN regexp_matches(name, '^[0-9]+\\.log$') THEN 'log' WHEN regexp_matches(name, '^[0-9]+\\.sst$') THEN 'table' WHEN regexp_matches(name, '^[0-9]+\\.tmp$') THEN 'temp' END AS kind FROM n),
k AS (SELECT name, kind, CAST(regexp_extract(name, '[0-9]+') AS BIGINT) AS number FROM c WHERE kind IS NOT NULL)
SELECT * FROM k WHERE NOT ((kind = 'log' AND number >= 9) OR (kind = 'table' AND number = 8) OR (kind = 'manifest' AND number = 7))""",
    "live_rows": f"WITH {_H1}, {_LIVE} SELECT k, seq, f FROM h WHERE f IN (SELECT number FROM l)",
    "torn_tail": f"WITH {_H1} SELECT k, seq, v FROM h WHERE seq < coalesce((SELECT min(seq) FROM h WHERE seq IN {BAD_RECORDS}), 9223372036854775807)",
    "recovered_sequence": f"WITH {_H1}, b AS (SELECT min(seq) AS base, count(*) AS n FROM h GROUP BY batch) SELECT max(base + n - 1) AS last_seq FROM b",
    "log_replay_order": "SELECT lpad(CAST(number AS VARCHAR), 6, '0') || '.log' AS name, CAST(number AS BIGINT) AS number, row_number() OVER (ORDER BY number) AS pos FROM (VALUES (12), (4), (9), (3), (27)) t(number) WHERE number >= 9",
    "internal_key_codec": f"""WITH {_H1} SELECT seq, hex(k) || lpad(to_hex(kind), 2, '0') || array_to_string([lpad(to_hex((seq >> (8 * j)) & 255), 2, '0') FOR j IN range(0, 7)], '') AS ikey, true AS same FROM h""",
    "crc_mask": """WITH c AS (SELECT event_id, CAST((CAST(event_id AS HUGEINT) * 2654435761) % 4294967296 AS BIGINT) AS crc FROM events)
SELECT event_id, crc, ((crc >> 15) | ((crc & 32767) << 17)) + 2726488792 - CASE WHEN ((crc >> 15) | ((crc & 32767) << 17)) + 2726488792 >= 4294967296 THEN 4294967296 ELSE 0 END AS masked, crc AS unmasked FROM c""",
    "kv_request_outcome": f"""WITH {_H1}, {_NEW}, l AS (SELECT k FROM r WHERE n = 1 AND kind = 1)
SELECT doc_id, ['GET', 'PUT', 'DELETE'][doc_id % 3 + 1] AS method, CAST(CASE doc_id % 3 WHEN 0 THEN CASE WHEN l.k IS NOT NULL THEN 200 ELSE 404 END WHEN 1 THEN CASE WHEN strlen(text) > {VALUE_LIMIT} THEN 413 ELSE 204 END ELSE 204 END AS BIGINT) AS status
FROM documents LEFT JOIN l ON l.k = lpad(CAST(doc_id AS VARCHAR), 19, '0')""",
    "stream_latest_state": f"WITH {_H1}, {_NEW} SELECT k, seq, v FROM r WHERE n = 1 AND kind = 1",
}
