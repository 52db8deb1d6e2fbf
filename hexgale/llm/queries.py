"""Registered queries of the text operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hexgale.llm import bpe, cover_tree, fingerprints, hamming_index, html, language, line_dedup, lm_score, merkle, near_dedup, packing, repeats, runs, tokens
from hexgale.llm.common import table, tokenizer_path
from hexgale.llm.sql import ORACLES  # noqa: F401  (read by the entry module)
from hexgale.session import configure


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.stupid_backoff(table(spark, sf_dir, "documents")).drop("mean_score")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_decisions(table(spark, sf_dir, "documents")).drop("row")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokens.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep_ids=False)
    return packing.best_fit_pack(pieces)


def op5_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep_ids=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify_language(docs, *language.fit_language_model(docs))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.next_edit_likeness(table(spark, sf_dir, "documents"))


def op11_hamming_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_index.nearest_vectors(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


_ALL = [
    op1_lm_score,
    op2_embedding_near_dedup,
    op3_line_dedup,
    op4_best_fit_packing,
    op5_long_repeats,
    op6_html_extraction,
    op7_minhash_near_dedup,
    op8_bpe,
    op9_language_id,
    op10_fingerprints,
    op11_hamming_neighbours,
    op12_periodic_runs,
    op13_merkle_manifest,
]


def _configured(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(configure(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _configured(f) for f in _ALL}
