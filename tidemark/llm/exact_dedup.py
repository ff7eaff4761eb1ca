"""Exact duplicates by progressive refinement: length, then a prefix's hash, then the full hash.

1. Texts are grouped by byte length; lengths that occur once are out.
2. What is left is grouped by length and the hash of a short prefix; what occurs once is out.
3. Only documents of a surviving (length, prefix) have their full text hashed.

The first two steps shuffle a few integers a document, pre-aggregated in each task; full hashes are made where the
text is read. The surviving keys are broadcast if there are few (they are counted), so that documents outside them
skip the full hash; beyond that the hash is made for all, before a plain join. Verdicts are attached to rows by a
broadcast of the groups. Past BROADCAST_ROWS groups only the largest are broadcast, and rows of the others go through
one shuffle with their text; rows that are done already are dealt at random there, so no group of copies is one task.

Defined results: null texts count as empty and equal each other. Rows that repeat a doc_id and a text are one
document: all of them stay or go together and each counts in group_size. Ties don't occur, as equal ids of equal texts
are one document. Texts of any length are hashed whole. An empty table gives an empty result. Columns of the input are
kept as they are whatever their names are, but for keep_id, group_size and kept, which give way to the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import aside, attach, back, cut, is_small, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 64


def normalised(text: Column) -> Column:
    """Lower-cased in A-Z only."""
    return F.translate(text, UPPER, LOWER)


def refine(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(_len, _head) of the lengths and prefix hashes that more than one document has, as a cut table."""
    text = text_of()
    keys = docs.select(F.octet_length(text).alias("_len"), F.xxhash64(normalised(F.substring(text, 1, prefix))).alias("_head"))
    by_head = cut(keys.groupBy("_len", "_head").agg(F.count(F.lit(1)).alias("_n")), "heads")
    lengths = by_head.groupBy("_len").agg(F.sum("_n").alias("_n")).where("_n > 1").select("_len")
    return cut(by_head.where("_n > 1").join(lengths, "_len", "left_semi").select("_len", "_head"), "survivors")


def mark(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """docs with keep_id, group_size and kept: of equal texts the row with the largest doc_id is kept."""
    text, own = text_of(), aside(docs, "doc_id", "text")
    survivors = refine(own, prefix)
    keyed = own.withColumns({"_len": F.octet_length(text), "_head": F.xxhash64(normalised(F.substring(text, 1, prefix)))})
    if is_small(survivors):
        hashed = keyed.join(F.broadcast(survivors.withColumn("_candidate", F.lit(True))), ["_len", "_head"], "left").withColumn("_full", F.when(F.col("_candidate"), digest(text)))
        slim = hashed
    else:  # too many survivors to send everywhere: the hash goes along instead of the text
        hashed = keyed.withColumn("_full", digest(text))
        slim = hashed.select("_len", "_head", "doc_id", "_full").join(survivors, ["_len", "_head"], "left_semi")
    groups = slim.where("_full is not null").groupBy("_full").agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    marked = attach(hashed, cut(groups, "groups"), "_full", "_size")
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    added = {"keep_id": keep, "group_size": F.coalesce("_size", F.lit(1)).cast("long"), "kept": keep.eqNullSafe(F.col("doc_id"))}
    return back(marked.withColumns(added), docs, ("doc_id", "text"), added)


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text), 256)
