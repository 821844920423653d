"""A corpus pipeline in five stages, each of which takes what the stage before it kept.

Language identification, line de-duplication, near-duplicate removal, benchmark decontamination, and
SentencePiece encoding with a decoded check. Stages are written as Parquet and read again in between.

In every stage a null text counts as an empty one, repeated rows are each judged, an empty table gives an
empty table with the same columns, and columns beyond those of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.decontaminate import clean_documents
from orrery.llm.jaccard_join import similarity_groups
from orrery.llm.language_id import identify_documents
from orrery.llm.line_dedup import dedup_lines
from orrery.llm.queries import tokenizer_path
from orrery.llm.sentence_pieces import encode_texts
from orrery.llm.storage import scratch, shared_folder
from orrery.storage import delete


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found from text, declared language and source; texts that are empty or without letters go."""
    return identify_documents(docs).where("accepted").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document of smaller id holds; n_chars, if it is there, follows. A document that keeps no text but had some goes."""
    out = dedup_lines(docs)
    out = out.where((F.col("n_dropped") == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five words, similarity 0.8 or more) the document of the smallest id.

    Rows are judged each, by id and text: of rows of one id those stay that are in no group, or are the one that stays in it. Texts without words
    belong to no group and stay, as do rows without an id: these don't decide which of the others is kept.
    """
    groups = similarity_groups(docs, shingle=5, num=4, den=5, keep=True)
    gone = groups.where((F.col("doc_id") != F.col("keep_id")) | (F.col("mark") != F.col("keep_mark"))).where(F.col("doc_id").isNotNull())
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    return docs.join(gone, (docs.doc_id == F.col("_id")) & (F.xxhash64("text") == F.col("_mark")), "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of the benchmark; empty texts have none."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, the ids of each text, their number, and whether they decode to the text."""
    out = encode_texts(docs, tokenizer_path("piece_bpe_32k.model"), check="round_trip")
    return out.select(*docs.columns, "tokens", F.size("tokens").cast("long").alias("n_tokens"), "round_trip")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pieces", pieces)]

#: SQL can't express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; what a stage needed goes once it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            path = shared_folder(spark, f"stage-{name}")
            keep.append(path)
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
