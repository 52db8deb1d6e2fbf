"""Corpus pipeline over ``documents``: language ID, line dedup, near-dedup, removal of long repeats, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``, with the text as the stage leaves it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexgale.llm import language, line_dedup, near_dedup, packing, repeats, tokens
from hexgale.llm.common import tokenizer_path
from hexgale.session import configure, ensure_checkpoint_dir


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text or no letter) go; ``lang`` of the others becomes the predicted one.

    Where nothing could be learned, documents with a letter stay with the ``lang`` they have.
    """
    model, langs = language.fit_language_model(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*docs.columns)
    named = language.label_rows(docs, model, langs)
    return named.where(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each fuzzy line stays at its first place only; documents that consisted of such lines alone stay, empty."""
    return _counted(line_dedup.dedup_lines(docs), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the first by id: five-word shingles, similarity 0.8 or more.

    A row number stands beside the id, so rows that share an id, or have none, are decided one by one.
    """
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    decided = near_dedup.near_duplicates(numbered.select(F.struct("doc_id", "__row").alias("at"), "text"), shingle=5, doc_id="at")
    gone = decided.where(~F.col("kept")).select(F.col("doc_id.__row").alias("__row"))
    return numbered.join(gone, "__row", "left_anti").select(*docs.columns)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 200-byte string that starts anywhere else too are cut out; broken characters at the cuts go."""
    return _counted(repeats.cut_repeats(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 4096 tokens."""
    pieces = tokens.token_pieces(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=False)
    return packing.best_fit_pack(pieces)


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    return changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


STAGES = [("language ID", identify), ("line dedup", lines), ("MinHash near-dedup", near), ("suffix-array dedup", long_repeats), ("best-fit packing", pack)]

#: Not expressible in SQL (a trained model, MinHash candidates, tokenizers); tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between stages are tables in the cluster's shared folder."""
    configure(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
