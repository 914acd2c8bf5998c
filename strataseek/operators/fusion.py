"""Fusion of ranked streams: reciprocal ranks, weighted blend, blend with a reranker.

Hits are DataFrames with path, block_id and score; a ranked stream has rank from 1 too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataseek.functions.paths import KEY

RRF_K = 60
RANK_BONUS = ((1, 0.05), (3, 0.02))
#: Scores are compared at so many decimals, so that the order of summation decides no tie.
DECIMALS = 9
DEFAULT_BLEND_TIERS = ((3, 0.75), (10, 0.60), (None, 0.40))


def by_score(score: str = "score") -> list[Column]:
    return [F.round(score, DECIMALS).desc(), F.col("path").asc(), F.col("block_id").asc()]


def top_k(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(*by_score()).limit(k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits with their rank from 1. The window runs over k rows alone."""
    return top_k(hits, k).withColumn("rank", F.row_number().over(Window.orderBy(*by_score())))


def reciprocal_rank_fusion(streams: Sequence[tuple[str, DataFrame, float]], k: int, constant: int = RRF_K) -> DataFrame:
    """path, block_id, score, sub_results of the k best over (name, ranked hits, weight).

    Of a key that a stream has several times the best-ranked hit counts, and the ranks after it move up. A hit adds weight / (constant + rank) for each stream and, once, a bonus for its best rank. sub_results maps a stream's name to
    the score and snippet there. Equal scores keep the order in which they are met: streams in turn, each by rank.
    """
    if not streams:
        raise ValueError("There is no stream to fuse")
    parts = []
    for i, (name, hits, weight) in enumerate(streams):
        snippet = F.col("snippet") if "snippet" in hits.columns else F.lit(None).cast("string")
        hits = first_occurrences(hits)
        parts.append(
            hits.select(
                *KEY, F.lit(i).alias("_stream"), F.col("rank").alias("_rank"), (F.lit(float(weight)) / (F.lit(float(constant)) + F.col("rank"))).alias("_part"),
                F.struct(F.lit(name).alias("key"), F.struct(F.col("score").alias("score"), snippet.alias("snippet")).alias("value")).alias("_hit"),
            )
        )
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    g = both.groupBy(*KEY).agg(
        F.sum("_part").alias("_sum"), F.min("_rank").alias("_best"), F.min(F.struct("_stream", "_rank")).alias("_first"), F.map_from_entries(F.collect_list("_hit")).alias("sub_results")
    )
    bonus = F.when(F.col("_best") <= RANK_BONUS[0][0], RANK_BONUS[0][1]).when(F.col("_best") <= RANK_BONUS[1][0], RANK_BONUS[1][1]).otherwise(0.0)
    scored = g.withColumn("score", F.col("_sum") + bonus)
    return scored.orderBy(F.round("score", DECIMALS).desc(), "_first").limit(k).select(*KEY, "score", "sub_results")


def first_occurrences(hits: DataFrame) -> DataFrame:
    """Ranked hits, each key at its first rank alone, with ranks from 1 without gaps. hits: a top-k."""
    again = hits.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("rank"))).where("_n = 1").drop("_n")
    return again.withColumn("rank", F.row_number().over(Window.orderBy("rank", *KEY)))


def weighted_blend(results: DataFrame, weights: dict[str, float], k: int | None = None) -> DataFrame:
    """Rescore results (pos from 0, one nullable score column for each name) by the weighted sum of min-max normalised scores.

    A missing score is 0 before normalisation; a name whose scores are all equal gives 1 / (pos + 1) instead. Equal sums keep their pos.
    The bounds come from one global aggregate of one row, joined back.
    """
    bounds = results.agg(*[x for n in weights for x in (F.min(F.coalesce(n, F.lit(0.0))).alias(f"_lo_{n}"), F.max(F.coalesce(n, F.lit(0.0))).alias(f"_hi_{n}"))])
    j = results.crossJoin(F.broadcast(bounds))  # one row
    total = F.lit(0.0)
    for n, w in weights.items():
        span = F.col(f"_hi_{n}") - F.col(f"_lo_{n}")
        total = total + F.lit(float(w)) * F.when(span == 0, 1.0 / (F.col("pos") + 1)).otherwise((F.coalesce(n, F.lit(0.0)) - F.col(f"_lo_{n}")) / F.when(span == 0, 1.0).otherwise(span))
    out = j.withColumn("score", total).select(*[c for c in results.columns if c != "score"], "score").orderBy(F.round("score", DECIMALS).desc(), "pos")
    return out if k is None else out.limit(k)


def blend_with_reranker(results: DataFrame, rerank: DataFrame, tiers: Sequence[tuple[int | None, float]] = DEFAULT_BLEND_TIERS) -> DataFrame:
    """Rescore results (rank from 1) with w / rank + (1 - w) * rerank_score, w by the rank's tier (up to, weight); the last tier takes the rest.

    rerank: path, block_id, rerank_score; a missing one counts 0. The retrieval score plays no part.
    """
    if not tiers:
        raise ValueError("At least one tier is needed")
    w = F.lit(float(tiers[-1][1]))
    for upto, weight in reversed(tiers):
        if upto is not None:
            w = F.when(F.col("rank") <= upto, float(weight)).otherwise(w)
    j = results.join(rerank.select(*KEY, "rerank_score"), KEY, "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    j = j.withColumn("_w", w).withColumn("score", F.col("_w") * (1.0 / F.col("rank")) + (1 - F.col("_w")) * F.col("rerank_score")).drop("_w")
    return j.orderBy(F.round("score", DECIMALS).desc(), "rank")


def rank_decay(hits: DataFrame) -> DataFrame:
    """Hits with the score replaced by 1 - (rank - 1) / hits, for engines that give an order and no score."""
    n = hits.agg(F.count(F.lit(1)).alias("_n"))
    return hits.crossJoin(F.broadcast(n)).withColumn("score", 1.0 - (F.col("rank") - 1) / F.col("_n")).drop("_n")  # one row
