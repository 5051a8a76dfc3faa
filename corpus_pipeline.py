"""Training-corpus pipeline: drop toxic documents, repeated lines and near copies, mix the sources, pack into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import fresh, parallelism, staged, table
from tickloom.llm.lines import drop_lines, line_bitmaps
from tickloom.llm.mixing import mix, mixed_documents
from tickloom.llm.neardup import near_duplicates
from tickloom.llm.packing import pack, token_pieces, word_tokenizer
from tickloom.llm.toxicity import fit_from, score_texts
from tickloom.session import configure


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    score, spans = fresh("tox_score", docs), fresh("tox_spans", docs)
    scored = score_texts(docs, fit_from(docs, table(configure(spark), sf_dir, "labels")), score, spans)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in five documents or more stay only in the last of them; no document goes."""
    configure(spark)
    return drop_lines(docs, staged(line_bitmaps(docs), "bitmaps")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five-word shingles, 0.8) the smallest doc_id stays; rows without a doc_id stay."""
    configure(spark)
    gone = near_duplicates(docs, width=5, percent=80).where(F.col("doc_id").isNotNull() & ~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, dealt to shards and shuffled there."""
    configure(spark)
    shard, position = fresh("shard", docs), fresh("position", docs)
    copies = mixed_documents(docs, mix(docs), shard=shard, position=position)
    dealt = copies.repartition(parallelism(spark), shard, F.substring(position, 1, 2)).sortWithinPartitions(shard, position)
    return dealt.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document: where it lies in which sequence of at most 2048 tokens."""
    configure(spark)
    return pack(token_pieces(docs, word_tokenizer()))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The toxicity model and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage is written to the shared folder and read back as the next one's input."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
