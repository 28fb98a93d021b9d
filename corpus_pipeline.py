"""The corpus pipeline: language ID, line dedup, near dedup, mixing and packing of documents, stage by stage.

Every stage reads what the one before wrote and returns the columns of documents, but for the last, which returns pieces.
Weights of the mix are uniform over sources by characters; the output is as large as what the stage was given.

Of every stage: an empty table gives an empty one with the same columns; columns other than COLUMNS are not read and not
returned, so none can clash; null ids are one id like any other, null languages and sources values of their own; texts are
read whole, however long; repeated rows (the same id and text) are one document, and come back as often as they came.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import language_id, line_dedup, mixing, near_dedup, packing
from veriframe.llm.common import checkpoint_folder
from veriframe.llm.queries import held_out, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of a text's words, in expectation, that its language must have.
LEAST_SCORE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those in which no language has half of the words; lang becomes the prediction.

    The model learns from the labelled documents that are not held out. Null and empty texts have no letter, so they go;
    documents without a lang stay and get one.
    """
    model = language_id.fit(docs.filter(~held_out()))
    found = language_id.predict(docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in COLUMNS])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; documents of which no word is left go.

    The earliest copy is that of the smallest id, then of the smaller hash of the text; null ids come first. Null and
    empty texts stay as they are, and n_chars follows the text.
    """
    return line_dedup.dedup(docs.select(*COLUMNS)).filter("not emptied").select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity 0.8) the document of smallest id stays.

    Different texts of one id are one document, which stays or goes as a whole. Texts without words are linked with nothing.
    """
    return near_dedup.representatives(docs.select(*COLUMNS), percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources at the same share of the characters; copies of a document are rows of their own.

    Repeated rows draw the same number of copies, each of them. A document may draw none, as the method has it.
    """
    return mixing.mix(docs.select(*COLUMNS), size_col="n_chars").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences; null texts are empty, so of one token."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: A learned language model decides what the first stage keeps, so SQL cannot express the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
