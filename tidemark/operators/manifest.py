"""The set of live runs as a fold over edits, and the files nobody refers to."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec, edits as tagged
from tidemark.shipping import ship

LEVELS = 7
#: Edits are (ord, op, level, number); within one ord deletions come before additions.
EDIT_SCHEMA = "ord long, op string, level int, number long"
FIELD_SCHEMA = "ord long, log_number long, next_file_number long, last_sequence long"


def live_files(edits: DataFrame) -> DataFrame:
    """(level, number): added and not deleted later. A deletion goes by number alone; levels that don't exist are left out."""
    known = edits.where((F.col("op") == "del") | F.col("level").between(0, LEVELS - 1))
    step = F.struct("ord", F.when(F.col("op") == "new", 1).otherwise(0).alias("new"), "level")
    return known.groupBy("number").agg(F.max(step).alias("last")).where("last.new = 1").select(F.col("last.level").cast("long").alias("level"), "number")


def fields(edits: DataFrame) -> DataFrame:
    """The last value present of each field, in the order of the edits; one row."""
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("ord", c)))[c].alias(c) for c in ("log_number", "next_file_number", "last_sequence")]
    return edits.agg(*last)


def classify(listing: DataFrame) -> DataFrame:
    """(name, kind, number): what each name in a database directory is."""
    n = F.col("name")
    kind = (
        F.when(n == "CURRENT", "current").when(n.rlike(r"^MANIFEST-[0-9]+$"), "manifest").when(n.rlike(r"^[0-9]+\.log$"), "log")
        .when(n.rlike(r"^[0-9]+\.sst$"), "table").when(n.rlike(r"^[0-9]+\.tmp$"), "temp").otherwise("unknown")
    )
    digits = F.regexp_extract(n, "([0-9]+)", 1)
    return listing.select("name", kind.alias("kind"), F.when(kind.isin("manifest", "log", "table", "temp"), digits.cast("long")).alias("number"))


def obsolete(listing: DataFrame, live: DataFrame) -> DataFrame:
    """(name, kind, number) of numbered files that live (kind, number) doesn't hold; logs from the first live one on stay."""
    named = classify(listing).where(F.col("number").isNotNull())
    first_log = live.where("kind = 'log'").agg(F.min("number").alias("_first"))
    kept = named.join(live, ["kind", "number"], "left_anti").join(F.broadcast(first_log))
    return kept.where("not (kind = 'log' and number >= _first)").select("name", "kind", "number")


def sample_edits(spark: SparkSession) -> DataFrame:
    rows = [(1, "new", 0, 3), (2, "new", 0, 5), (3, "del", 2, 3), (4, "new", 1, 9), (5, "new", 9, 11)]
    return spark.createDataFrame(rows, EDIT_SCHEMA)


def write_manifest(edits: DataFrame) -> DataFrame:
    """(content) of one framed manifest of edits (EDIT_SCHEMA): a record for each ord, deletions first. A manifest is one file, so one
    task writes it."""
    ship(edits.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        records = []
        for _, own in rows.sort_values("ord", kind="stable").groupby("ord", sort=True):
            gone = [(int(lv), int(n)) for op, lv, n in zip(own["op"], own["level"], own["number"], strict=True) if op == "del"]
            new = [(int(lv), int(n), 0, b"", b"") for op, lv, n in zip(own["op"], own["level"], own["number"], strict=True) if op == "new"]
            records.append(tagged.Edit(deleted=gone, new=new).encode())
        return pd.DataFrame({"content": [codec.frame(records)]})

    return edits.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, "content binary")


def read_manifest(manifest: DataFrame) -> DataFrame:
    """Edits (EDIT_SCHEMA) of a framed manifest (content); a damaged one is an error."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch["content"]:
                for i, e in enumerate(tagged.decode_manifest(bytes(content)), 1):
                    rows += [(i, "del", lv, n) for lv, n in e.deleted] + [(i, "new", lv, n) for lv, n, *_ in e.new]
            yield pd.DataFrame(rows, columns=["ord", "op", "level", "number"])

    return manifest.select("content").mapInPandas(run, EDIT_SCHEMA)
