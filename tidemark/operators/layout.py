"""Shape of stored runs: their metadata, pruning by it, what a read costs, and how writes are cut into pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import table_format
from tidemark.functions.codec import bloom_may_contain_many, internal_key
from tidemark.plans.ranges import bounds, range_of, small
from tidemark.shipping import ship

RESTART = 16
#: What an entry costs in memory beside its key and value: trailer and node.
ENTRY_OVERHEAD = 56


def bloom_bytes(n_keys: Column) -> Column:
    """Size of a run's filter: 10 bits a key, 64 at least, and one byte for the number of probes."""
    return (F.ceil(F.greatest(F.lit(64), 10 * n_keys) / 8) + 1).cast("long")


def file_metadata(history: DataFrame) -> DataFrame:
    """A row for each run: key bounds, rows, distinct keys, tombstones, filter size."""
    by_key = history.groupBy("f", "k").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("kind")).alias("t"))
    own = by_key.groupBy("f").agg(
        F.min("k").alias("smallest"), F.max("k").alias("largest"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum("t").cast("long").alias("n_tombstones")
    )
    return own.withColumn("filter_bytes", bloom_bytes(F.col("n_keys")))


def candidates(keys: DataFrame, files: DataFrame) -> DataFrame:
    """keys (k, ...) with the f of each run whose bounds hold the key.

    A range join as an equi-join on cells: cells are cut at quantiles of the runs' bounds, whatever keys look like; a run
    lies in each cell between its bounds, a key in one, and the exact bounds decide. Cells of runs are broadcast if they are few.
    """
    cuts = bounds(files.select(F.explode(F.array("smallest", "largest")).alias("bound")), "bound")
    cells = files.withColumn("_cell", F.explode(F.sequence(range_of(F.col("smallest"), cuts), range_of(F.col("largest"), cuts))))
    return keys.withColumn("_cell", range_of(F.col("k"), cuts)).join(small(cells), "_cell").where("k between smallest and largest").select(*keys.columns, "f")


def read_amplification(history: DataFrame) -> DataFrame:
    """(k, runs_read): runs that a read consults, newest first, until the first that has the key."""
    meta = file_metadata(history).select("f", "smallest", "largest")
    hit = history.groupBy("k").agg(F.max("f").alias("hit"))
    return candidates(hit, meta).where("f >= hit").groupBy("k").agg(F.count(F.lit(1)).alias("runs_read"))


def space_amplification(history: DataFrame) -> DataFrame:
    """(k, versions, tombstones, superseded)"""
    return history.groupBy("k").agg(F.count(F.lit(1)).alias("versions"), F.sum(1 - F.col("kind")).cast("long").alias("tombstones"), (F.count(F.lit(1)) - 1).alias("superseded"))


def shared_bytes(a: Column, b: Column) -> Column:
    """Length of the common prefix of two byte strings in hex; 0 if there is no b."""
    n = F.least(F.length(a), F.length(b)) / 2
    pairs = F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))
    differs = F.array_position(F.transform(pairs, lambda i: F.substring(a, 2 * i - 1, F.lit(2)) == F.substring(b, 2 * i - 1, F.lit(2))), False)
    return F.when(b.isNull() | (n == 0), 0).when(differs > 0, differs - 1).otherwise(n).cast("long")


def placed_keys(history: DataFrame) -> DataFrame:
    """(f, k, seq, pos, common, key_bytes, value_bytes): runs in internal-key order, and how many bytes of its internal key an
    entry has in common with the one before it."""
    own = history.select("f", "k", "seq", internal_key(F.col("k"), F.col("seq"), F.col("kind")).alias("_ikey"), F.coalesce(F.octet_length("v"), F.lit(0)).cast("long").alias("value_bytes"))
    w = Window.partitionBy("f").orderBy(F.col("k"), F.col("seq").desc())
    seen = own.withColumns({"pos": F.row_number().over(w).cast("long"), "_before": F.lag("_ikey").over(w)})
    return seen.select("f", "k", "seq", "pos", shared_bytes(F.col("_ikey"), F.col("_before")).alias("common"), (F.length("_ikey") / 2).cast("long").alias("key_bytes"), "value_bytes")


def prefix_stats(history: DataFrame) -> DataFrame:
    """(f, k, seq, pos, shared): within each run in internal-key order, how many bytes of its internal key an entry shares
    with the one before it; every 16th starts anew."""
    shared = F.when((F.col("pos") - 1) % RESTART == 0, 0).otherwise(F.col("common"))
    return placed_keys(history).select("f", "k", "seq", "pos", shared.cast("long").alias("shared"))


def rotations(history: DataFrame, threshold: int) -> DataFrame:
    """(shard, generation, lo, hi, bytes): when a shard's write buffer is rotated. history: (shard, seq, bytes).

    A buffer is closed before a write once it holds the threshold or more, so it may overshoot by one write. What
    comes later depends on where the last buffer ended, so a shard's writes are folded in order; shards run beside each
    other. Rows stream through the fold in sorted batches: a task holds one batch, however long a shard's history is.
    """
    ship(history.sparkSession)
    ordered = history.select(F.col("shard").cast("long").alias("shard"), F.col("seq").cast("long").alias("seq"), F.col("bytes").cast("long").alias("bytes"))
    ordered = ordered.repartition("shard").sortWithinPartitions("shard", "seq")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, generation, lo, hi, total = None, 0, None, None, 0
        for batch in batches:
            out = []
            for own, seq, size in zip(batch["shard"], batch["seq"], batch["bytes"], strict=True):
                if own != shard or total >= threshold:
                    if shard is not None:
                        out.append((shard, generation, lo, hi, total))
                    shard, generation, lo, total = own, generation + 1 if own == shard else 1, seq, 0
                total, hi = total + size, seq
            if out:
                yield pd.DataFrame(out, columns=_ROTATIONS)
        if shard is not None:
            yield pd.DataFrame([(shard, generation, lo, hi, total)], columns=_ROTATIONS)

    return ordered.mapInPandas(fold, ", ".join(f"{c} long" for c in _ROTATIONS))


_ROTATIONS = ["shard", "generation", "lo", "hi", "bytes"]


def blocks(history: DataFrame, block_size: int) -> DataFrame:
    """(f, pos, block): the block of each entry, runs beside each other. history: (f, k, seq, kind, v).

    A block is closed before an entry once its size estimate (entries, 4 bytes for each restart and 4 more) reaches
    the block size. A fresh block has one restart. Prefixes are those of internal keys, in bytes. What an entry has in common with
    the one before it is a column; the fold adds sizes, and a run is as long as a buffer made it.
    """
    ship(history.sparkSession)

    def varint(n: int) -> int:
        return max(1, -(-n.bit_length() // 7))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        out, block, size, restarts, count = [], 1, 0, 1, 0
        for common, key, value in zip(rows["common"].tolist(), rows["key_bytes"].tolist(), rows["value_bytes"].tolist(), strict=True):
            if size + 4 * restarts + 4 >= block_size:
                block, size, restarts, count = block + 1, 0, 1, 0
            shared = common if size else 0
            if count == RESTART:
                restarts, count, shared = restarts + 1, 0, 0
            size += varint(shared) + varint(key - shared) + varint(value) + key - shared + value
            count += 1
            out.append(block)
        return pd.DataFrame({"f": rows["f"].to_numpy(), "pos": rows["pos"].to_numpy(), "block": out})

    own = placed_keys(history).select("f", "pos", "common", "key_bytes", "value_bytes")
    return own.groupBy("f").applyInPandas(fold, "f long, pos long, block long")


def tables(history: DataFrame, block_size: int) -> DataFrame:
    """(f, content, n_blocks, same): each run as the bytes of a table, and whether reading it gives back all entries."""
    ship(history.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [table_format.encode_key(k.encode(), int(s), int(t)) for k, s, t in zip(rows["k"], rows["seq"], rows["kind"], strict=True)]
        entries = sorted(zip(keys, [b"" if v is None else v.encode() for v in rows["v"]], strict=True), key=lambda e: table_format.rank(e[0]))
        content = table_format.encode_table(entries, block_size)
        back, filter_ = table_format.decode_table(content)
        same = [e for b in back for e in b] == entries and bool(bloom_may_contain_many(filter_, [k.encode() for k in rows["k"]]).all())
        return pd.DataFrame({"f": [rows["f"].iloc[0]], "content": [content], "n_blocks": [len(back)], "same": [same]})

    return history.select("f", "k", "seq", "kind", "v").groupBy("f").applyInPandas(run, "f long, content binary, n_blocks long, same boolean")
