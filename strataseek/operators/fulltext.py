"""Lexical retrieval: postings, BM25, prefix and fuzzy terms, merging of several queries.

Blocks are DataFrames with path, block_id and content. The stored inverted index is postings (term, path, block_id, tf, len), dfs (term, df) and stats (one row: blocks,
avg_len); a search joins postings with the query's few terms, so at scale postings are stored sorted by term, for row groups to be skipped. Where nothing
is stored, a search of plain terms counts them inside each block's row: the corpus is tokenised once, and what moves is a row of counts for each block.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataseek.functions.paths import KEY, any_prefix
from strataseek.functions.text import Analyzer
from strataseek.operators.fusion import DECIMALS, rank_decay, ranked, top_k

DEFAULT_DEPTH = 100
K1, B = 1.2, 0.75
#: Tokens that a task counts at once (some 60 bytes each), and postings that it hands on at once.
HELD_TOKENS, HELD_ROWS = 1 << 20, 100_000


@dataclass
class FullTextTables:
    """blocks: path, block_id, content, ...; postings: term, path, block_id, tf, len; dfs: term, df. stored: whether the tables are read, not computed from blocks."""

    blocks: DataFrame
    postings: DataFrame
    stats: DataFrame
    dfs: DataFrame
    stored: bool = False


def _counted(tokens: pa.ListArray) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows with about HELD_TOKENS tokens in sum: first row, distinct terms, and for each distinct token of each row the row, the term's number, its count; the rows' lengths."""
    offsets = tokens.offsets.to_numpy()
    start = 0
    while start < len(tokens):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + HELD_TOKENS, "right")) - 1)
        n = np.diff(offsets[start : end + 1])
        found = tokens.slice(start, end - start).flatten().dictionary_encode()
        terms = max(1, len(found.dictionary))
        both, tf = np.unique(np.repeat(np.arange(len(n)), n) * terms + found.indices.to_numpy(), return_counts=True)
        yield start, found.dictionary, both // terms, both % terms, tf, n
        start = end


def build_postings(blocks: DataFrame, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """term, path, block_id, tf, len for each distinct token of each block; len is the block's number of tokens.

    Tokens are numbered and counted in Arrow batches, by slices of rows, so nothing moves between tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, terms, row, term, tf, n in _counted(b.column("_t")):
                for i in range(0, len(row), HELD_ROWS):
                    part = slice(i, i + HELD_ROWS)
                    at = pa.array(start + row[part])
                    columns = [terms.take(pa.array(term[part])), b.column("path").take(at), b.column("block_id").take(at), pa.array(tf[part], pa.int32()), pa.array(n[row[part]], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["term", *KEY, "tf", "len"])

    return blocks.select(*KEY, analyzer.column(F.col("content")).alias("_t")).mapInArrow(run, "term string, path string, block_id string, tf int, len int")


def term_totals(blocks: DataFrame, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """term, df, cf: the blocks that have the term, and its occurrences. As from the postings, but blocks are added up before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, terms, _, term, tf, _ in _counted(b.column("_t")):
                df = np.bincount(term, minlength=len(terms))
                cf = np.zeros(len(terms), np.int64)
                np.add.at(cf, term, tf)
                yield pa.RecordBatch.from_arrays([terms, pa.array(df, pa.int64()), pa.array(cf)], names=["term", "df", "cf"])

    parts = blocks.select(analyzer.column(F.col("content")).alias("_t")).mapInArrow(run, "term string, df bigint, cf bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def exploded_postings(blocks: DataFrame, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """build_postings by exploding and grouping."""
    t = blocks.select(*KEY, analyzer.column(F.col("content")).alias("_t")).where(F.size("_t") > 0)
    return t.select(*KEY, F.size("_t").alias("len"), F.explode("_t").alias("term")).groupBy("term", *KEY, "len").agg(F.count(F.lit(1)).cast("int").alias("tf")).select("term", *KEY, "tf", "len")


def corpus_stats(blocks: DataFrame, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """One row: blocks (all of them) and avg_len (over those with a token)."""
    n = F.size(analyzer.column(F.col("content")))
    return blocks.select(n.alias("_n")).agg(F.count(F.lit(1)).alias("blocks"), F.avg(F.when(F.col("_n") > 0, F.col("_n"))).alias("avg_len"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """term, df: postings have one row for each block that has the term."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tables(blocks: DataFrame, analyzer: Analyzer = Analyzer()) -> FullTextTables:
    return FullTextTables(blocks, build_postings(blocks, analyzer), corpus_stats(blocks, analyzer), term_totals(blocks, analyzer).select("term", "df"))


def bm25(tf: Column, df: Column, length: Column) -> Column:
    """A term's part of a block's score; blocks and avg_len are columns."""
    idf = F.log(1 + (F.col("blocks") - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg_len")))


def term_scores(index: FullTextTables, terms: DataFrame, paths: Iterable[str] | None = None, known: list[str] | None = None) -> DataFrame:
    """path, block_id, the other columns of terms, and the BM25 part of each matching term, from the postings. terms: term and more.

    df and avg_len are the whole index's, whatever the paths. known: all of the terms, where they are few; the scan of stored postings then skips what has none of them. What is broadcast is left to Spark, which sees sizes: a short prefix may reach a large part of the vocabulary.
    """
    asked = index.dfs.join(terms, "term")
    keep = any_prefix(F.col("path"), paths)
    scoped = index.postings if keep is None else index.postings.where(keep)
    if known:
        scoped = scoped.where(F.col("term").isin(known))
    j = scoped.join(asked, "term").crossJoin(F.broadcast(index.stats))  # one row
    return j.withColumn("part", bm25(F.col("tf"), F.col("df"), F.col("len"))).drop("df", "blocks", "avg_len", "tf", "len")


def _equals(term: str):
    return lambda x: x == F.lit(term)


def counted_scores(index: FullTextTables, queries: list[list[str]], paths: Iterable[str] | None = None, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """path, block_id, scores: an array with the BM25 score of each query (null where none of its terms occurs), of the blocks that any query hits, from the blocks themselves."""
    terms = list(dict.fromkeys(t for q in queries for t in q))
    tokens = index.blocks.select(*KEY, analyzer.column(F.col("content")).alias("_t"))
    asked = F.array(*map(F.lit, terms))
    mine = F.filter("_t", lambda x: F.array_contains(asked, x))  # most blocks have few of them
    counts = tokens.select(*KEY, F.size("_t").alias("len"), mine.alias("_m"))
    counts = counts.select(*KEY, "len", F.array(*[F.size(F.filter("_m", _equals(t))) for t in terms]).alias("_tf"))
    # one exchange of narrow rows, read by both sides below: both ask for all its columns, so that neither is pruned and it runs once
    counts = counts.repartition(*KEY)
    every = F.bit_xor(F.xxhash64(*KEY, "len", "_tf")).alias("_all")
    stats = counts.agg(F.count(F.lit(1)).alias("blocks"), F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("avg_len"), F.array(*[F.count_if(F.col("_tf")[i] > 0) for i in range(len(terms))]).alias("_df"), every)
    keep = any_prefix(F.col("path"), paths)
    some = F.exists("_tf", lambda n: n > 0) if keep is None else F.exists("_tf", lambda n: n > 0) & keep
    # the condition asks for the statistics too, or it would be pushed below the exchange, which then differed from the other side's
    hits = counts.crossJoin(F.broadcast(stats)).where(F.when(F.col("blocks") > 0, some))  # one row
    number = {t: i for i, t in enumerate(terms)}

    def score(q: list[str]) -> Column:
        parts = [(F.col("_tf")[number[t]], F.col("_df")[number[t]]) for t in q]
        if not parts:
            return F.lit(None).cast("double")
        some = sum((tf for tf, _ in parts), F.lit(0)) > 0
        return F.when(some, sum((F.when(tf > 0, bm25(tf, df, F.col("len"))).otherwise(0.0) for tf, df in parts), F.lit(0.0)))

    return hits.select(*KEY, F.array(*map(score, queries)).alias("scores"))


def query_terms(df: DataFrame, queries: list[str], analyzer: Analyzer) -> DataFrame:
    """term, query_ord of all queries; blank queries have none."""
    rows = [(t, i) for i, q in enumerate(queries) for t in analyzer.terms(q)]
    return df.sparkSession.createDataFrame(rows, "term string, query_ord int")


def merged(per_query: DataFrame, how: str) -> DataFrame:
    """One score for each block from one for each query: their 'sum' or their 'max'."""
    if how not in ("sum", "max"):
        raise ValueError(f"Unknown merge: {how}")
    return per_query.groupBy(*KEY).agg((F.sum if how == "sum" else F.max)("score").alias("score"))


def with_snippets(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hits with their block's whole content as snippet. The hits are a top-k, so they go to the blocks, not these to them."""
    return blocks.select(*KEY, F.col("content").alias("snippet")).join(F.broadcast(hits), KEY).select(*hits.columns, "snippet")


def search(index: FullTextTables, queries: list[str], k: int = DEFAULT_DEPTH, merge: str = "sum", paths: Iterable[str] | None = None, analyzer: Analyzer = Analyzer(), depth: int | None = None) -> DataFrame:
    """path, block_id, score of the k best blocks: BM25 with any of a query's terms, merged over queries.

    depth: if given, each query's hits are cut to so many before they are merged.
    """
    if merge not in ("sum", "max"):
        raise ValueError(f"Unknown merge: {merge}")
    asked = [analyzer.terms(q) for q in queries]
    if not any(asked):
        return index.blocks.select(*KEY, F.lit(0.0).alias("score")).limit(0)
    if not index.stored:
        scores = counted_scores(index, asked, paths, analyzer)
        if depth is None:
            known = F.filter("scores", lambda x: x.isNotNull())
            one = F.array_max(known) if merge == "max" else F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
            return top_k(scores.select(*KEY, one.alias("score")), k)
        per_query = scores.select(*KEY, F.posexplode("scores").alias("query_ord", "score")).where("score IS NOT NULL")
    else:
        parts = term_scores(index, query_terms(index.postings, queries, analyzer), paths, sorted({t for q in asked for t in q}))
        if depth is None and merge == "sum":
            return top_k(parts.groupBy(*KEY).agg(F.sum("part").alias("score")), k)
        per_query = parts.groupBy("query_ord", *KEY).agg(F.sum("part").alias("score"))
    if depth is not None:
        w = Window.partitionBy("query_ord").orderBy(F.round("score", DECIMALS).desc(), "path", "block_id")
        per_query = per_query.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= depth)
    return top_k(merged(per_query, merge), k)


def decayed_search(index: FullTextTables, query: str, k: int = DEFAULT_DEPTH, paths: Iterable[str] | None = None, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """search for one query with scores that tell the order only: 1 - (rank - 1) / hits."""
    return rank_decay(ranked(search(index, [query], k, paths=paths, analyzer=analyzer), k)).select(*KEY, "score")


def expanded_terms(index: FullTextTables, query: str, prefix: bool = True, fuzzy: float | None = None, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """term, query_ord, weight: the vocabulary's terms that a query's terms reach.

    Exactly (weight 1), as a prefix (length of the query's term over the term's), or within an edit distance of fuzzy times the query term's
    length, rounded (weight 1 / (1 + distance)). Only the vocabulary is searched, never the postings.
    """
    asked = analyzer.terms(query)
    if not asked:
        return index.dfs.select("term", F.lit(0).alias("query_ord"), F.lit(1.0).alias("weight")).limit(0)
    return index.dfs.select("term", F.lit(0).alias("query_ord"), expansion_weight(F.col("term"), asked, prefix, fuzzy).alias("weight")).where("weight IS NOT NULL")


def _near(term: Column, asked: str, fuzzy: float) -> Column:
    most = F.round(F.lit(len(asked)) * F.lit(float(fuzzy))).cast("int")
    return (F.abs(F.length(term) - F.lit(len(asked))) <= most) & (F.levenshtein(term, F.lit(asked)) <= most)


def expansion_weight(term: Column, asked: list[str], prefix: bool = True, fuzzy: float | None = None) -> Column:
    """The largest weight at which any of the asked terms reaches term; null if none does."""

    def one(a: str) -> Column:
        weight = F.when(term == F.lit(a), 1.0)
        if prefix:
            weight = weight.when(F.startswith(term, F.lit(a)), F.lit(len(a)) / F.length(term))
        return weight if fuzzy is None else weight.when(_near(term, a, fuzzy), 1.0 / (1 + F.levenshtein(term, F.lit(a))))

    return F.array_max(F.array(*map(one, asked)))


def counted_expansion(index: FullTextTables, query: str, prefix: bool, fuzzy: float | None, paths: Iterable[str] | None, analyzer: Analyzer) -> DataFrame:
    """path, block_id, part, weight of each reached term of each block, from the blocks themselves: term_scores of expanded_terms where nothing is stored.

    The corpus is tokenised once, and what moves is a row for each block, with the tokens that the query reaches alone.
    """
    asked = analyzer.terms(query)

    def reached(x: Column) -> Column:
        ways = [w for a in asked for w in ([F.startswith(x, F.lit(a)) if prefix else x == F.lit(a)] + ([] if fuzzy is None else [_near(x, a, fuzzy)]))]
        return functools.reduce(operator.or_, ways)

    tokens = index.blocks.select(*KEY, analyzer.column(F.col("content")).alias("_t"))
    # a token '', which no text has, stands for the block itself
    held = F.concat(F.coalesce(F.filter("_t", reached), F.array().cast("array<string>")), F.array(F.lit("")))
    counts = tokens.select(*KEY, F.coalesce(F.size("_t"), F.lit(-1)).alias("len"), held.alias("_m"))
    # one exchange, read by all three below; the sums go by all of its columns, so that none is pruned on one side only
    each = counts.repartition(*KEY).select(*KEY, "len", F.explode_outer("_m").alias("term"))
    rows = each.groupBy(*KEY, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    block, some = F.col("term") == "", F.col("len") > 0
    stats = rows.agg(F.sum(F.when(block, F.col("tf"))).alias("blocks"), (F.sum(F.when(block & some, F.col("tf") * F.col("len"))) / F.sum(F.when(block & some, F.col("tf")))).alias("avg_len"))
    dfs = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    keep = any_prefix(F.col("path"), paths)
    j = rows.join(dfs, "term").crossJoin(F.broadcast(stats))  # one row
    # with the statistics in the condition, it isn't pushed below the exchange, which then differed from the others'
    j = j.where(F.when(F.col("blocks") > 0, ~block if keep is None else ~block & keep))
    return j.select(*KEY, bm25(F.col("tf"), F.col("df"), F.col("len")).alias("part"), expansion_weight(F.col("term"), asked, prefix, fuzzy).alias("weight"))


def expanded_search(index: FullTextTables, query: str, k: int = DEFAULT_DEPTH, prefix: bool = True, fuzzy: float | None = 0.2, paths: Iterable[str] | None = None, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """search for one query, with prefix and fuzzy terms at their weights."""
    if not index.stored and analyzer.terms(query):
        scores = counted_expansion(index, query, prefix, fuzzy, paths, analyzer)
    else:
        scores = term_scores(index, expanded_terms(index, query, prefix, fuzzy, analyzer), paths)
    return top_k(scores.groupBy(*KEY).agg(F.sum(F.col("part") * F.col("weight")).alias("score")), k)


def coverage_search(index: FullTextTables, query: str, k: int = DEFAULT_DEPTH, paths: Iterable[str] | None = None, analyzer: Analyzer = Analyzer()) -> DataFrame:
    """search by coverage: distinct query terms that a block has over all of them, ties by their density in the block."""
    terms = query_terms(index.postings, [query], analyzer)
    n = max(1, len(analyzer.terms(query)))
    hits = index.postings.join(F.broadcast(terms), "term")  # the query's terms
    keep = any_prefix(F.col("path"), paths)
    hits = hits if keep is None else hits.where(keep)
    density = F.sum("tf") / F.first("len")
    return top_k(hits.groupBy(*KEY).agg((F.countDistinct("term") / F.lit(n) + density / F.lit(2 * n)).alias("score")), k)
