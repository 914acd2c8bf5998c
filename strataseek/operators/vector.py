"""Vector retrieval: exact cosine top-k over all blocks.

Blocks are DataFrames with path, block_id and embedding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataseek.functions.paths import KEY, any_prefix
from strataseek.operators.fusion import DECIMALS, top_k

DEFAULT_DEPTH = 100


def check_dimension(embedding: Sequence[float], dimension: int) -> None:
    if len(embedding) != dimension:
        raise ValueError(f"Expected dimensionality {dimension}, got {len(embedding)}")


def checked(blocks: DataFrame, dimension: int) -> DataFrame:
    """blocks, failing where an embedding hasn't the dimension. The test is part of the column, so it can't be left out by pruning."""
    e = F.col("embedding")
    message = F.concat(F.lit(f"Expected dimensionality {dimension}, got "), F.size(e).cast("string"))
    return blocks.withColumn("embedding", F.when(F.size(e) == dimension, e).otherwise(F.raise_error(message).cast("array<float>")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where a norm is 0."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)
    square = lambda v: F.aggregate(v, zero, lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when(norm == 0, 0.0).otherwise(dot / F.when(norm == 0, 1.0).otherwise(norm))


def cosine_similarity(a: Sequence[float], b: Sequence[float]) -> float:
    if len(a) != len(b):
        raise ValueError(f"Vector length mismatch: {len(a)} and {len(b)}")
    x, y = np.asarray(a, np.float64), np.asarray(b, np.float64)
    norm = float(np.sqrt(x @ x) * np.sqrt(y @ y))
    return float(x @ y) / norm if norm else 0.0


def best_cosine(blocks: DataFrame, queries: Sequence[Sequence[float]]) -> DataFrame:
    """path, block_id, score: each block's largest cosine over the queries. One matrix product for each Arrow batch, no shuffle."""
    q = np.array([list(v) for v in queries], np.float64).reshape(len(queries), -1)
    norms = np.sqrt((q * q).sum(1))
    q = q / np.where(norms == 0, 1, norms)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.column("embedding")
            sizes = np.diff(rows.offsets.to_numpy())
            wrong = np.flatnonzero(sizes != q.shape[1])
            if len(wrong):
                raise ValueError(f"Expected dimensionality {q.shape[1]}, got {sizes[wrong[0]]}")
            if rows.flatten().null_count:
                raise ValueError("An embedding has a null component")
            v = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            n = np.sqrt((v * v).sum(1))
            scores = (v @ q.T).max(1) / np.where(n == 0, 1, n)
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("block_id"), pa.array(np.where(n == 0, 0.0, scores))], names=["path", "block_id", "score"])

    return blocks.where("embedding IS NOT NULL").select(*KEY, "embedding").mapInArrow(run, "path string, block_id string, score double")


def search(blocks: DataFrame, queries: Sequence[Sequence[float]], k: int = DEFAULT_DEPTH, paths: Iterable[str] | None = None) -> DataFrame:
    """path, block_id, score of the k blocks with the largest cosine to any of the queries."""
    if not len(queries):
        return blocks.select(*KEY, F.lit(0.0).alias("score")).limit(0)
    keep = any_prefix(F.col("path"), paths)
    return top_k(best_cosine(blocks if keep is None else blocks.where(keep), queries), k)


#: Components of the requests that batch_search holds in a task: 256 MB.
HELD_COMPONENTS = 32 << 20


#: Scores that batch_search holds in a task at once: 8 MB, and some copies of it.
HELD_SCORES = 1 << 20


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k largest of each row; of equal ones at the k-th place the first columns."""
    n = scores.shape[1]
    if n <= k:
        r, c = (x.ravel() for x in np.indices(scores.shape))
        return r, c, scores.ravel()
    if k <= 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    least = np.partition(scores, n - k, axis=1)[:, n - k, None]
    taken = scores >= least
    for i in np.flatnonzero(np.count_nonzero(taken, axis=1) > k):
        equal = np.flatnonzero(scores[i] == least[i])
        taken[i, equal[k - np.count_nonzero(scores[i] > least[i]) :]] = False
    r, c = np.nonzero(taken)
    return r, c, scores[r, c]


def batch_search(blocks: DataFrame, requests: DataFrame, k: int = DEFAULT_DEPTH) -> DataFrame:
    """request_id, rank, path, block_id, score for many requests (request_id, embedding): the k best blocks of each.

    The requests are a stated set: they are collected, and their size is checked. Each batch of blocks meets all of them in one matrix product and hands on its k best for each
    request; only those move. Requests with a null or without a component are left out.
    """
    found = requests.where("request_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    size = found.agg(F.sum(F.size("embedding")).alias("n")).first()["n"] or 0
    if size > HELD_COMPONENTS:
        raise ValueError(f"{size} components of requests; send at most {HELD_COMPONENTS} at once")
    asked = found.select("request_id", "embedding").orderBy("request_id").toArrow()
    kind = requests.schema["request_id"].dataType.simpleString()
    schema = f"request_id {kind}, path string, block_id string, score double"
    if not asked.num_rows:
        return blocks.sparkSession.createDataFrame([], f"request_id {kind}, rank int, path string, block_id string, score double")
    ids, lists = (asked[c].combine_chunks() for c in ("request_id", "embedding"))
    if len(np.unique(np.diff(lists.offsets.to_numpy()))) > 1:
        raise ValueError("Requests differ in dimensionality")
    q = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    norms = np.sqrt((q * q).sum(1))
    held = blocks.sparkSession.sparkContext.broadcast(q / np.where(norms == 0, 1, norms)[:, None])  # its size was checked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        for b in batches:
            if not b.num_rows:
                continue
            # in the order of keys, so that of equal scores the first ones count
            b = b.sort_by([(c, "ascending") for c in KEY])
            rows = b.column("embedding")
            wrong = np.flatnonzero(np.diff(rows.offsets.to_numpy()) != q.shape[1])
            if len(wrong):
                raise ValueError(f"Expected dimensionality {q.shape[1]} in all blocks")
            v = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            n = np.sqrt((v * v).sum(1))
            v = v / np.where(n == 0, 1, n)[:, None]
            step = max(1, HELD_SCORES // b.num_rows)
            for s in range(0, len(q), step):
                exact = q[s : s + step] @ v.T
                r, c, _ = _best(np.round(exact, DECIMALS), k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(s + r)), b.column("path").take(pa.array(c)), b.column("block_id").take(pa.array(c)), pa.array(exact[r, c])], names=["request_id", "path", "block_id", "score"])

    near = blocks.where("embedding IS NOT NULL").select(*KEY, "embedding").mapInArrow(run, schema)
    w = Window.partitionBy("request_id").orderBy(F.round("score", DECIMALS).desc(), "path", "block_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("request_id", "rank", *KEY, "score")


def encode_embedding(embedding: Column) -> Column:
    """An embedding as text, [x,y,...], as SQL clients pass it."""
    return F.when(embedding.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(embedding, lambda x: x.cast("string")), ","), F.lit("]")))


def decode_embedding(text: Column) -> Column:
    """array<float> of such a text; what is no list of numbers gives null."""
    return F.from_json(text, "array<float>")
