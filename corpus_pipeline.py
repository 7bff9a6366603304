"""Corpus pipeline: five operators of millrace.llm, each on what the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. The mix is an order of rows, which the Parquet
files keep; the last stage reads it back from the places of rows in the files.

Defined results: null and empty texts are scored as one empty line, are copies of nothing and hold no item; if they
are kept they are mixed and encoded (as the end id). Rows with a null id stay in every stage but the first, which
may reject them. Rows that repeat an id stay or go together, and count as one document for near copies. Empty
tables pass as they are. Extra columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, mixing
from millrace.llm.common import Scratch
from millrace.llm.entry import MIX, REST, table, word_tokens
from millrace.llm.jaccard_join import jaccard_components
from millrace.llm.quality import fit, score


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    taken, name = {c.lower() for c in docs.columns}, "score"
    while name in taken:
        name = f"_{name}"
    return score(docs, model, name).where(f"{name} >= 0.5").drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies: five words, similarity 0.8."""
    groups = jaccard_components(docs.select("doc_id", "text"), width=5, num=80, den=100, counted=False)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.mixed(docs, MIX, REST, block=32, period=100)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, in the order of its rows in the files."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    placed = docs.select("doc_id", "text", part.alias("part"), F.col("_metadata.row_index").alias("row"))
    return word_tokens(placed, order=["part", "row"])


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources to target weights", source_mix), ("token-ID output", tokens)]
ORACLE_SQL = None  # the classifier and the tokenizer have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
