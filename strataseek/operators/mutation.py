"""Upsert, delete and orphan reclamation as joins. They return a new table; writing it is the catalog's work."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataseek.functions.paths import KEY, any_prefix


def last_wins(blocks: DataFrame, seq: str) -> DataFrame:
    """One row for each key: that with the largest seq."""
    w = Window.partitionBy(*KEY).orderBy(F.col(seq).desc())
    return blocks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, and the rows of old whose key new hasn't."""
    return old.join(new.select(*KEY), KEY, "left_anti").select(*old.columns).unionByName(new)


def delete(blocks: DataFrame, selectors: Iterable[tuple[str, str | None]]) -> DataFrame:
    """blocks without those selected: (path, block_id) exactly, or (path, None) for all at or under a path."""
    chosen = list(selectors)
    exact = [(p, b) for p, b in chosen if b is not None]
    under = any_prefix(F.col("path"), [p for p, b in chosen if b is None])
    out = blocks if under is None else blocks.where(~under)
    if exact:
        keys = blocks.sparkSession.createDataFrame(exact, "path string, block_id string")
        out = out.join(keys, KEY, "left_anti").select(*blocks.columns)
    return out


def orphan_paths(docs: DataFrame, *blocks: DataFrame) -> DataFrame:
    """The paths of docs that no table of blocks has; all of them if there is no table."""
    paths = docs.select("path").distinct()
    for b in blocks:
        paths = paths.join(b.select("path"), "path", "left_anti")
    return paths
