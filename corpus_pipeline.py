"""A corpus-cleaning pipeline: toxicity, language ID, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet and read back as the next one's docs.
All but the last return the columns of documents; rows with a null doc_id, text, lang or source go through each stage by the rules in its operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.llm import op2_toxicity, op3_language, op5_packing, op7_secrets, op9_jaccard
from strataseek.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: IDs that are broadcast, 64 MB; more of them are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Nats for each character: a language trails the best one by BEHIND where it is plainly another; a text below NONE is in no language of the sample,
#: one above PLAIN is plainly in one. On sf0.1 98 % of the texts are between -2.2 and -1.4. Each holds if it makes EVIDENCE nats over the text.
BEHIND, NONE, PLAIN, EVIDENCE = 0.3, -4.0, -2.5, 30.0


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = op2_toxicity.train(docs, labels)
    return op2_toxicity.scored(docs, chain, COLUMNS).where("NOT is_toxic").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go, and those that are plainly not in the language they declare: another explains them better, none of the
    sample does, or one does though they declare a language that the sample lacks. A null language is no claim and stays."""
    model = op3_language.train(docs)
    if not model.names:  # no document declares a language, so there is nothing to hold any against
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = op3_language.scored(docs, model, COLUMNS)
    much = lambda rate: rate * F.col("n_plain") > EVIDENCE
    other = (F.col("behind") < -BEHIND) & much(-F.col("behind"))
    none = much(NONE - F.col("plain"))
    same = F.lower(F.substring_index(F.translate("lang", "_", "-"), "-", 1)) == F.col("language")
    outside = F.col("behind").isNull() & ~same & much(F.col("plain") - PLAIN)
    foreign = F.when(F.col("lang").isNull(), False).when(F.col("behind").isNull(), outside).otherwise(other | none)
    return found.where((F.col("language") != "und") & ~F.coalesce(foreign, F.lit(False))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by pairs of a Jaccard of at least 0.5, the one with the smallest doc_id stays; rows with a null doc_id stay."""
    gone = written(op9_jaccard.duplicate_groups(docs).select("doc_id"), "pipeline-gone")
    if gone.count() <= BROADCAST_IDS:  # else both sides move; the same documents go either way
        gone = F.broadcast(gone)
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets of one owner, and shared ones that aren't examples, are replaced in the text; all documents stay."""
    return op7_secrets.redacted(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, part, n_tokens, sequence, offset, fixed of each document's parts in training sequences; a null or empty text is one part of one token."""
    return op5_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: Classifiers, connected groups and packing are beyond SQL; tests/llm/test_tables.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
