"""From raw documents to packed sequences: rules, language, near duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
``documents``; the last returns the packed pieces. Models are learned from bounded samples of the stage's own documents.

All stages: further columns of ``docs`` are dropped first, so none can clash with what an operator adds; repeated rows each get their
own decision (equal ones an equal decision); texts are read whole, however long; an empty table gives an empty table. A null in
``lang``, ``source`` or ``n_chars`` changes no decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import language_id, line_crf, packing, shingle_join, suffix_dedup
from tapeloom.llm.common import bounded_batches, read
from tapeloom.llm.queries import BYTE_BPE
from tapeloom.sources.storage import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose content lines hold half of their words or more.

    A null or empty text has no words and goes; a share of exactly one half stays. Without labels of both kinds all lines are content."""
    bounded_batches(spark)
    model = line_crf.learn(docs, read(spark, sf_dir, "labels"))
    return line_crf.with_rules(docs.select(*COLUMNS), model).where("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; ``lang`` stays as it came.

    A null, empty or letterless text goes, and so does a tie of the two best languages. Without a ``lang`` to learn from all go."""
    bounded_batches(spark)
    known = language_id.learn(docs)
    return language_id.with_language(docs.select(*COLUMNS), known).where(language_id.accepted()).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that links connect; rows that repeat a doc_id are that one
    document and stay or go together, documents without doc_id stay. Null and empty texts are linked with nothing and stay."""
    bounded_batches(spark)
    groups = shingle_join.near_duplicates(docs)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes of 100-byte strings that occur earlier; n_chars follows the text.

    Of equal rows of one doc_id the first in the stage's order keeps its text; a null text stays as it is or becomes empty."""
    bounded_batches(spark)
    cut = suffix_dedup.without_repeats(docs.select(*COLUMNS))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", "text", "lang", "source", chars.alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a null or empty text is one piece of the end token alone."""
    bounded_batches(spark)
    return packing.packed_documents(docs, BYTE_BPE, end_id=0, capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("best-fit packing", packed),
]
#: Learned line labels, compression and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
