"""Five stages from raw documents to token counts; each works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import bpe, linededup, mixing, quality, simhash
from tallygrove.local import name_shared_dir
from tallygrove.session import release, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _begin(spark: SparkSession) -> None:
    """Before a stage: the shared folder has a name, and the finished stages' shuffle files go."""
    name_shared_dir(spark)
    release(spark)


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are good with a probability of a half or more."""
    _begin(spark)
    return quality.judge(docs.select(*COLUMNS)).where("kept").select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines of three-line windows that an earlier document or place holds."""
    _begin(spark)
    found = linededup.remove_repeats(docs.select(*COLUMNS))
    return _documents(found.select("row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    _begin(spark)
    return simhash.distinct_texts(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document; a document taken twice is there twice."""
    _begin(spark)
    return _documents(mixing.mixed_texts(docs.select(*COLUMNS)))


def token_counts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's packed token ids and source, their number and digest, and the digest of the text decoded from them."""
    _begin(spark)
    whose = docs.select(F.struct("doc_id", "source").alias("row"), "text")
    found = bpe.encode(whose, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, key="row")
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "row.source")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_documents),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", without_near_duplicates),
    ("mixing to target weights", mixed),
    ("byte-level bpe", token_counts),
]

#: Signatures, permutations and tokens have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


#: What ``run`` returns of the last stage; its Parquet has the token ids and sources as well.
FIGURES = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def run(spark: SparkSession, sf_dir: str, out: str | None = None) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again; the last one, with the token ids, to ``out`` if named."""
    name_shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = out if out and i == len(STAGES) - 1 else scratch_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.select(*FIGURES)
