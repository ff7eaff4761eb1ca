"""A corpus pipeline: toxic documents go, exact and near copies go, sources are mixed, and the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of docs (the last one
returns packed pieces). Columns that a stage doesn't use pass through it whatever their names are. A stage on an
empty table returns an empty one; null texts count as empty, and texts of any length are worked on whole. Repeated rows: toxicity
and exact_dedup keep or drop them together, near_dedup too, mixing shares out the copies that were decided for them, packing
packs each. Ties are settled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, mixing, neardup, packing, toxicity
from tidemark.llm.common import aside, back, cut, free, table
from tidemark.llm.registry import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
USED = ("doc_id", "text", "source")


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    return back(found, docs, USED)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _back(toxicity.score(aside(docs, *USED), model, "_score").where("_score < 0.5"), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _back(exact_dedup.mark(aside(docs, *USED)).where("kept"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _back(neardup.mark(aside(docs, *USED)).where("kept"), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: Trained scores, signatures and tokenisation can't be said in SQL: the stages are tested one by one instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each one's result is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
