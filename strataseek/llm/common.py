"""What the operators share: the shared folder, Arrow plumbing, vectorised tokens."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A slice of a batch holds about so many bytes of text, so that temporary arrays stay small.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir isn't set; on a cluster it must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strataseek-"))
        folder = sc.getCheckpointDir()
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def remove_written(spark: SparkSession) -> int:
    """Delete the tables that written made in this process, once the results that read them are stored; how many there were."""
    n = len(_written)
    for path in _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.clear()
    return n


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes in the column; one long row is a part of its own."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def plain_strings(column: pa.Array) -> pa.Array:
    """The column as a compact large_string array without nulls."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-cased words between ASCII white space: offsets by text, a code for each word, and the distinct words."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    words = lists.values
    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    first = int(ends[0])
    codes, ends = codes[first : int(ends[-1])], ends - first
    if empty >= 0:
        keep = codes != empty
        ends = np.concatenate(([0], np.cumsum(keep)))[ends]
        codes = codes[keep]
    return ends, codes, coded.dictionary


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string; the same in every process."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of unsigned 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 of all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Sorted batches, cut so that the rows of one value of column are never apart."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(column).to_numpy()
        cut = int(np.searchsorted(v, v[-1]))
        if cut == 0 and held and held[-1].column(column)[-1].as_py() != v[0]:
            yield pa.Table.from_batches(held)
            held = []
        elif cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def sample_by_hash(df: DataFrame, rows: int, total: int | None = None) -> DataFrame:
    """About rows of df, the same in every run: the distinct ones whose hash (of all columns, 64 bits) falls in the share rows / total of the range.

    Rows that repeat count once, so no key or text can fill the sample however often it occurs. total: df's rows, counted if not given.
    """
    total = df.select(F.count(F.lit(1))).first()[0] if total is None else total
    if total <= rows:
        return df
    least = max(1, (rows << 64) // total) - (1 << 63)
    return df.where(F.xxhash64(F.lit(42), *[F.col(c) for c in df.columns]) < F.lit(least).cast("bigint")).dropDuplicates()


def fitted(rows: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """What fit makes of the rows, in one task of an executor: a bounded sample's texts and features never come to the driver.

    The result must be of built-in and NumPy types.
    """
    schema = pa.schema([(name, pa.large_string() if kind == "string" else pa.int64()) for name, kind in rows.dtypes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.cast(schema) for b in batches]
        table = pa.Table.from_batches(held, schema=schema)
        del held
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table))], pa.binary())], names=["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0][0]) if made else fit(schema.empty_table())  # a plan known to be empty runs no task
