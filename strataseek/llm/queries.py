"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataseek.llm import op1_merkle, op2_toxicity, op3_language, op4_ppm, op5_packing, op6_warc, op7_secrets, op8_neighbours, op9_jaccard, op10_bpe


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merkle_fingerprints": lambda spark, d: op1_merkle.corpus_fingerprints(_table(spark, d, "documents")),
    "op2_toxicity_chain": lambda spark, d: op2_toxicity.toxicity(_table(spark, d, "documents"), _table(spark, d, "labels")),
    "op3_language_unigrams": lambda spark, d: op3_language.language_id(_table(spark, d, "documents")),
    "op4_ppm_code_length": lambda spark, d: op4_ppm.code_lengths(_table(spark, d, "documents")),
    "op5_best_fit_packing": lambda spark, d: op5_packing.pack(_table(spark, d, "documents")),
    "op6_warc_chunks": lambda spark, d: op6_warc.page_chunks(_table(spark, d, "pages")),
    "op7_secret_ownership": lambda spark, d: op7_secrets.secret_scan(_table(spark, d, "documents")),
    "op8_block_neighbours": lambda spark, d: op8_neighbours.neighbours(_table(spark, d, "embeddings"), every=op8_neighbours.EVERY),
    "op9_jaccard_join": lambda spark, d: op9_jaccard.jaccard_join(_table(spark, d, "documents")),
    "op10_bpe_encode": lambda spark, d: op10_bpe.encode(_table(spark, d, "documents")),
}

ORACLE: dict[str, str] = {
    "op1_merkle_fingerprints": op1_merkle.ORACLE,
    "op6_warc_chunks": op6_warc.ORACLE,
    "op7_secret_ownership": op7_secrets.ORACLE,
    "op8_block_neighbours": op8_neighbours.ORACLE,
    "op9_jaccard_join": op9_jaccard.ORACLE,
}
