"""Approximate nearest neighbours by a block matrix join with int8 tiles; the result is exact.

Vectors are scaled to length 1, quantised to int8 with a scale of their own, and laid out in blocks. Queries are the vectors whose id is divisible by every. Each block of
queries meets every block of vectors of its dimension in a tile: one integer matrix product (int8 values held as float32, in which sums up to 2^24 are exact) gives all
similarities of the tile. With x = q + e, where q is what int8 holds and e the error, |x.y - qx.qy| <= |ex| + |ey| |qx|, so each approximate similarity has a bound. A
pair survives if its upper bound reaches the query's k-th best lower bound so far; the bounds of several tasks are merged, and what still survives is recomputed from the
float vectors in double precision and goes to the query's heap of k. No pair is dropped that the bounds don't rule out.

Work is the queries times the vectors, as in any block join. The grid of tasks has the square root of the blocks on a side, so blocks (of int8, never pairs or floats) move in proportion
to the blocks times that root; floats move for survivors only, of which each query has little more than k.

Defined results: rows with a null id, a null or empty embedding, a null or not finite component, or a zero length are left out; vectors meet those of their own
dimension; repeated ids count once (the larger embedding); a vector isn't its own neighbour; ties go by the smaller id, distances being compared at 9 decimals.
Fewer than k others give fewer rows. Only the id and embedding columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataseek.llm.common import whole_groups, written

K = 10
BLOCK = 2_048
#: Queries of the registered query: ids divisible by it.
EVERY = 20
#: A side of the grid has at least so many blocks to a task.
SIDE = 4
BLOCK_SCHEMA = "dim int, block bigint, n int, ids binary, ints binary, scale binary, size binary, error binary"


def _block(ids: np.ndarray, v: np.ndarray, number: int) -> tuple:
    """A block's columns from ids and float64 vectors, which get length 1."""
    v = unit(v)
    scale = np.abs(v).max(1) / 127
    q = np.rint(v / scale[:, None]).astype(np.int8)
    held = q * scale[:, None]
    size, error = np.sqrt((held * held).sum(1)), np.sqrt(((v - held) ** 2).sum(1))
    return v.shape[1], number, len(ids), ids.astype(np.int64).tobytes(), q.tobytes(), scale.tobytes(), size.tobytes(), error.tobytes()


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1)[:, None]  # squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1))[:, None]


def valid(vectors: DataFrame, key: str) -> DataFrame:
    """id, v, dim: the vectors that count, once each."""
    ok = vectors.select(F.col(key).cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    ok = ok.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)")
    return ok.groupBy("id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v"))


def blocks(known: DataFrame, numbers: DataFrame, count: str) -> DataFrame:
    """BLOCK_SCHEMA: the vectors in blocks by the hash of their id, as many as numbers' column count says for a dimension."""
    placed = known.join(numbers.select("dim", F.col(count).alias("_n")), "dim").select("dim", F.pmod(F.xxhash64("id"), F.col("_n")).alias("block"), "id", "v")
    placed = placed.repartition("dim", "block").sortWithinPartitions("dim", "block", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held, number = [], [], None
        names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]

        def out() -> pa.RecordBatch:
            row = _block(np.concatenate(held_ids), np.concatenate(held), number[1])
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            dims, which, ids = (b.column(c).to_numpy() for c in ("dim", "block", "id"))
            flat, starts = b.column("v").flatten().to_numpy(), np.cumsum(dims) - dims
            cuts = [0, *(np.flatnonzero((np.diff(which) != 0) | (np.diff(dims) != 0)) + 1).tolist(), len(which)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                now = (int(dims[s]), int(which[s]))
                if number is not None and now != number:
                    yield out()
                    held_ids, held = [], []
                number = now
                held_ids.append(ids[s:e])
                held.append(flat[starts[s] : starts[s] + (e - s) * now[0]].reshape(e - s, now[0]))
        if held:
            yield out()

    return placed.mapInArrow(run, BLOCK_SCHEMA)


class Side:
    """A block, read back from its row."""

    def __init__(self, row: dict, prefix: str):
        n, dim = row[prefix + "n"], row[prefix + "dim"]
        self.ids = np.frombuffer(row[prefix + "ids"], np.int64)
        self.ints = np.frombuffer(row[prefix + "ints"], np.int8).reshape(n, dim).astype(np.float32)
        self.scale, self.size, self.error = (np.frombuffer(row[prefix + x], np.float64) for x in ("scale", "size", "error"))


class Bounds:
    """The k best lower bounds of each query of a block, and the pairs that may still be among its k best."""

    def __init__(self, a: Side, k: int):
        self.a, self.k = a, k
        self.best = np.full((len(a.ids), k), -np.inf, np.float32)
        self.pairs: list[tuple[np.ndarray, ...]] = []

    def tile(self, b: Side) -> None:
        """Meet the vectors of b."""
        a = self.a
        near = (a.ints @ b.ints.T) * a.scale.astype(np.float32)[:, None]
        near *= b.scale.astype(np.float32)[None, :]
        bound = a.error[:, None].astype(np.float32) + a.size[:, None].astype(np.float32) * b.error[None, :].astype(np.float32) + np.float32(1e-5)
        order = np.argsort(b.ids)
        at = np.minimum(np.searchsorted(b.ids, a.ids, sorter=order), len(b.ids) - 1)
        same = np.flatnonzero(b.ids[order[at]] == a.ids)
        lower, upper = near - bound, near + bound
        lower[same, order[at[same]]] = upper[same, order[at[same]]] = -np.inf
        top = np.partition(lower, len(b.ids) - self.k, axis=1)[:, -self.k :] if len(b.ids) > self.k else lower
        self.best = np.partition(np.concatenate([self.best, top], 1), -self.k, axis=1)[:, -self.k :]
        q, o = np.nonzero((upper >= self.best.min(1)[:, None]) & (upper > -np.inf))
        self.pairs.append((q, b.ids[o], lower[q, o], upper[q, o]))
        if sum(len(p[0]) for p in self.pairs) > 4 * self.k * len(a.ids):
            self.left()

    def left(self) -> tuple[np.ndarray, ...]:
        """(query row, id, lower, upper) of the pairs that the bounds so far don't rule out."""
        q, o, lower, upper = (np.concatenate(c) for c in zip(*self.pairs))
        ok = upper >= self.best.min(1)[q]
        self.pairs = [(q[ok], o[ok], lower[ok], upper[ok])]
        return self.pairs[0]


class Heaps:
    """The k best (distance, id) of each query, as sorted rows."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.distance, self.other = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def push(self, query: np.ndarray, distance: np.ndarray, other: np.ndarray) -> None:
        """Offer (query row, distance, id) triples."""
        rows = np.unique(query)
        q = np.concatenate([query, np.repeat(rows, self.k)])
        d = np.concatenate([distance, self.distance[rows].ravel()])
        o = np.concatenate([other, self.other[rows].ravel()])
        order = np.lexsort((o, d, q))
        q, d, o = q[order], d[order], o[order]
        take = np.searchsorted(q, rows)[:, None] + np.arange(self.k)
        self.distance[rows], self.other[rows] = d[take], o[take]


def neighbours(vectors: DataFrame, key: str = "vec_id", k: int = K, block: int = BLOCK, every: int = 1, side: int = SIDE) -> DataFrame:
    """key, rank (from 1), neighbour, distance (1 - cosine): the k nearest others of every vector whose id is divisible by every, among all vectors."""
    known = written(valid(vectors, key), "ann-vectors")
    query = F.pmod("id", F.lit(every)) == 0
    grid = known.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).alias("nb"), F.ceil(F.count(F.when(query, 1)) / block).alias("nq")).where("nq > 0")
    grid = written(grid.withColumn("_s", F.greatest(F.lit(side), F.ceil(F.sqrt("nb")))).select("dim", "nb", "nq", F.ceil(F.col("nq") / F.col("_s")).alias("rows"), F.ceil(F.col("nb") / F.col("_s")).alias("columns")), "ann-grid")
    # a block of queries goes to all cells of its row, a block of vectors to all of its column
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = blocks(known.where(query), grid, "nq").join(grid, "dim").withColumn("_row", F.pmod("block", F.col("rows"))).withColumn("_column", spread("columns")).drop("nb", "nq", "rows", "columns")
    right = blocks(known, grid, "nb").join(grid, "dim").withColumn("_column", F.pmod("block", F.col("columns"))).withColumn("_row", spread("rows")).drop("nb", "nq", "rows", "columns")
    right = right.select("_row", "_column", *[F.col(c).alias("o_" + c) for c in right.columns if c[0] != "_"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[tuple, Bounds] | None = None

        def out() -> Iterator[pa.RecordBatch]:
            q, o, lower, upper = now[1].left()
            for s in range(0, len(q), 100_000):
                e = s + 100_000
                yield pa.RecordBatch.from_arrays([pa.array(now[1].a.ids[q[s:e]]), pa.array(o[s:e]), pa.array(lower[s:e]), pa.array(upper[s:e])], names=["query", "other", "lower", "upper"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                number = (row.column("dim")[0].as_py(), row.column("block")[0].as_py())
                if now is None or now[0] != number:
                    if now is not None:
                        yield from out()
                    now = (number, Bounds(Side({c: row.column(c)[0].as_py() for c in row.schema.names if not c.startswith("o_")}, ""), k))
                now[1].tile(Side({c: row.column(c)[0].as_py() for c in row.schema.names if c.startswith("o_")}, "o_"))
        if now is not None:
            yield from out()

    pairs = left.join(right.hint("shuffle_hash"), (F.col("dim") == F.col("o_dim")) & (left["_row"] == right["_row"]) & (left["_column"] == right["_column"]))
    pairs = pairs.select(*[c for c in left.columns if c[0] != "_"], *[c for c in right.columns if c[0] != "_"])
    found = written(pairs.mapInArrow(tiles, "query bigint, other bigint, lower float, upper float"), "ann-survivors")
    # the k-th best lower bound over all cells rules out what a cell alone couldn't
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower"))))
    kth = ranked.withColumn("_k", F.min(F.when(F.col("_r") == k, F.col("lower"))).over(Window.partitionBy("query")))
    left_over = kth.where("_k IS NULL OR upper >= _k").select("query", "other")
    vectors_of = lambda c, v: known.select(F.col("id").alias(c), F.col("v").alias(v))
    both = left_over.join(vectors_of("other", "y"), "other").join(vectors_of("query", "x"), "query").select("query", "other", "x", "y")
    both = both.repartition("query").sortWithinPartitions("query")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "query"):
            ids, place = np.unique(t["query"].to_numpy(), return_inverse=True)
            x, y = (t[c].combine_chunks() for c in ("x", "y"))
            dims = np.diff(x.offsets.to_numpy())
            distance, other = np.zeros(t.num_rows), t["other"].to_numpy()
            x, y, ends = x.flatten().to_numpy(), y.flatten().to_numpy(), np.concatenate(([0], np.cumsum(dims)))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                cells = ends[at][:, None] + np.arange(d)
                distance[at] = np.round(1 - np.einsum("ij,ij->i", unit(x[cells]), unit(y[cells])), 9)
            heaps = Heaps(ids, k)
            heaps.push(place, distance, other)
            keep = heaps.distance < np.inf
            ranks, rows = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), keep.shape), np.broadcast_to(ids[:, None], keep.shape)
            yield pa.RecordBatch.from_arrays([pa.array(rows[keep]), pa.array(ranks[keep]), pa.array(heaps.other[keep]), pa.array(heaps.distance[keep])], names=[key, "rank", "neighbour", "distance"])

    return both.mapInArrow(exact, f"{key} bigint, rank int, neighbour bigint, distance double")


ORACLE = f"""
WITH e AS (SELECT vec_id, CAST(max(embedding) AS DOUBLE[]) AS v FROM embeddings GROUP BY vec_id),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, round(1 - list_cosine_similarity(a.v, b.v), 9) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM p) WHERE rank <= {K}
"""
