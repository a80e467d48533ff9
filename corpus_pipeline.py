"""From documents to training sequences: five stages, each an operator of lodestone.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet in the shared
folder and read back as the next one's docs. All but the last return the columns of documents.

Every stage takes any rows: null, empty and very long texts, null and repeated doc_ids, repeated rows, no rows at all, and extra
columns of any names, which it carries. What becomes of them is said at each stage; the modules of the operators say more.

Line dedup comes before near-dedup, so it has taken from a near copy the lines that stood in an earlier document; what is left of
it is often no near copy any more, and near-dedup rightly keeps it: its new lines are nowhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, lines, packing, quality, simhash
from lodestone.session import drop_table, persist_table, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier grades clean; trained on the labelled ones among them.

    Null, empty and word-less texts have no features: they stay if the prior of the labels is for it, without labels they go.
    Each row is judged by itself, so repeats and null ids change nothing. Long texts are read whole."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.rating())
    return quality.select(docs, model, quality.SELECT_GRADE, quality.LEAST)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line stays where it first stands; documents that hold nothing new go.

    Null, empty and blank texts stay; repeated rows become one; rows without id come first; equal lines are told by (doc_id, text hash,
    line number). n_chars, where there is one, follows the text."""
    left = lines.dedup_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least (doc_id, text hash).

    Texts without a word and rows without id stay; repeated rows become one."""
    return simhash.drop_near_duplicates(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item and no line of one, as line dedup may have left of it.

    Null and empty texts hold none and stay; every row is judged by itself; an empty benchmark lets all pass."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), by_line=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths: (doc_id, piece, start, bucket, tokens).

    Texts without tokens give none; repeated rows repeat theirs; ids may be null."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality_filter), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("benchmark decontamination", benchmark_filter), ("packing", pack)]

#: Trained weights, random bit orders and a byte-pair vocabulary are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    read = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = persist_table(docs, name.replace(" ", "-"))
            if read is not None:
                drop_table(read)  # the stage before it is written, so nothing reads its input again
            read = docs
    return docs
