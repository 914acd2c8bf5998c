"""Document fingerprints: a Merkle tree over paragraphs and sections.

A leaf is the SHA-256 of a trimmed paragraph (a line that is not blank). A section
is a run of paragraphs; it ends at a blank line and after a paragraph whose digest
begins with "0" or "1" (one in eight), so that an insertion moves no later boundary. Its node
hashes its leaves, and the root hashes the section nodes; the three levels have
different prefixes, so that no node of one level can pass for one of another.

Equal roots mean equal paragraphs and sections. To locate an edit, only branches
that differ are opened: sections whose node the other tree lacks, and in those
the paragraphs whose leaf the other tree lacks.

Defined results: a null text has a null root and no sections; an empty text has the
root of an empty tree; rows that repeat give rows that repeat; a null doc_id is kept but is
never another document's twin or base. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.llm.common import ragged, written

#: Holders of a paragraph or section that more roots hold are compared by their distinct sets of such keys, not one by one. Results don't depend on it.
HOT = 64
#: A block of the comparison of sets holds about so many sets, and so many keys.
BLOCK_SETS, BLOCK_KEYS = 1 << 15, 1 << 21


def _leaves(text: Column) -> Column:
    """A digest for each paragraph, '' for each blank line."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.when(F.trim(p) == "", F.lit("")).otherwise(F.sha2(F.concat(F.lit("L"), F.trim(p)), 256)))


def _sections(leaves: Column) -> Column:
    """The leaves of each section, joined by spaces."""
    marked = F.transform(leaves, lambda h: F.when(h == "", F.lit("|")).when(F.substring(h, 1, 1).isin("0", "1"), F.concat(h, F.lit("|"))).otherwise(F.concat(h, F.lit(" "))))
    return F.filter(F.transform(F.split(F.array_join(marked, ""), r"\|", -1), lambda s: F.trim(s)), lambda s: s != "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, root, sections (array of node, leaves): the tree of each document."""
    d = docs.select("doc_id", F.col("text").alias("_t"))
    d = d.select("doc_id", _sections(_leaves(F.col("_t"))).alias("_s"))
    nodes = F.transform("_s", lambda s: F.struct(F.sha2(F.concat(F.lit("S"), s), 256).alias("node"), F.split(s, " ").alias("leaves")))
    d = d.select("doc_id", nodes.alias("sections"))
    return d.select("doc_id", F.sha2(F.concat(F.lit("R"), F.array_join(F.col("sections.node"), " ")), 256).alias("root"), "sections")


def changed_paragraphs(mine: Column, other: Column) -> Column:
    """Leaves of mine, by position from 0, that other lacks; sections that other has too are never opened."""
    # set differences take time in proportion; what is searched one by one after them is the edit alone
    nodes, leaves = F.array_except(mine["node"], other["node"]), F.array_except(F.flatten(mine["leaves"]), F.flatten(other["leaves"]))
    opened = F.flatten(F.transform(mine, lambda s: F.transform(s["leaves"], lambda h: F.array_contains(nodes, s["node"]) & F.array_contains(leaves, h))))
    return F.filter(F.transform(opened, lambda changed, i: F.when(changed, i)), lambda x: x.isNotNull())


def diff(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Two versions of a corpus by key: same (roots equal), removed and added (paragraph positions in left and in right).

    Each side's key should be unique; a key that repeats gives all pairs. A document on one side only has a null on the other
    and all its paragraphs are removed or added.
    """
    a = fingerprints(left.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), F.col("root").alias("_ra"), F.col("sections").alias("_sa"))
    b = fingerprints(right.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), F.col("root").alias("_rb"), F.col("sections").alias("_sb"))
    none = F.filter(F.col("_sa"), lambda s: F.lit(False))
    j = a.join(b, key, "full_outer")
    j = j.withColumns({"_na": F.coalesce("_sa", F.filter(F.col("_sb"), lambda s: F.lit(False))), "_nb": F.coalesce(F.col("_sb"), none)})
    same = F.coalesce(F.col("_ra") == F.col("_rb"), F.lit(False))
    return j.select(key, same.alias("same"), changed_paragraphs(F.col("_na"), F.col("_nb")).alias("removed"), changed_paragraphs(F.col("_nb"), F.col("_na")).alias("added"))


def _bases(own: DataFrame) -> DataFrame:
    """doc_id, _r, base_id, _b (its root) of the documents that have an earlier relative. own: doc_id, _r, sections, one row for each root.

    Keys are paragraphs, and sections of several. Relatives by a key that at most HOT roots hold are paired one by one, and what they share of
    hotter keys is added. Relatives by hotter keys alone share what their sets of such keys share, so the first root of each distinct set stands for all.
    """
    leaves = F.transform(F.array_distinct(F.flatten("sections.leaves")), lambda h: F.struct(F.lit(True).alias("leaf"), F.xxhash64(h).alias("k")))
    nodes = F.transform(F.array_distinct(F.filter("sections", lambda s: F.size(s["leaves"]) > 1)["node"]), lambda h: F.struct(F.lit(False).alias("leaf"), F.xxhash64(h).alias("k")))
    keys = own.select("doc_id", "_r", F.explode(F.concat(leaves, nodes)).alias("_k"))
    held = written(keys.join(keys.groupBy("_k").agg(F.count("*").alias("n")).where("n > 1"), "_k").select("_k", F.struct("doc_id", "_r").alias("d"), "n"), "merkle-keys")
    is_leaf, k = F.col("_k.leaf"), F.col("_k.k")
    hot = held.where(F.col("n") > HOT).groupBy("d").agg(F.sort_array(F.collect_list(F.when(is_leaf, k))).alias("ls"), F.sort_array(F.collect_list(F.when(~is_leaf, k))).alias("ns"))
    hot = written(hot.withColumn("id", F.xxhash64(F.size("ls"), "ls", "ns")), "merkle-hot")
    sets = written(hot.groupBy("id").agg(F.min("d").alias("first"), F.first("ls").alias("ls"), F.first("ns").alias("ns")), "merkle-sets")

    rare = held.where(F.col("n") <= HOT).join(hot.select("d", "id"), "d", "left").select("_k", F.struct("d.doc_id", "d._r", "id").alias("d"))
    all_of = rare.groupBy("_k").agg(F.sort_array(F.collect_list("d")).alias("_all"))
    rare = all_of.select("_k", "_all", F.posexplode("_all").alias("_i", "d")).select("_k", "d", F.explode(F.slice("_all", F.lit(1), F.col("_i"))).alias("e"))
    rare = rare.where("e.doc_id < d.doc_id").groupBy("d", "e").agg(F.sum(is_leaf.cast("int")).alias("leaves"), F.sum((~is_leaf).cast("int")).alias("others"))
    rare = written(rare, "merkle-pairs")
    both = F.col("d.id").isNotNull() & F.col("e.id").isNotNull()
    a, b = (sets.select(F.col("id").alias(f"_{x}"), F.col("ls").alias(f"_{x}l"), F.col("ns").alias(f"_{x}n")) for x in "ab")
    more = rare.where(both).join(a, F.col("d.id") == F.col("_a")).join(b, F.col("e.id") == F.col("_b"))
    more = more.withColumns({"leaves": F.col("leaves") + F.size(F.array_intersect("_al", "_bl")), "others": F.col("others") + F.size(F.array_intersect("_an", "_bn"))})
    bare = [F.struct(f"{x}.doc_id", f"{x}._r").alias(x) for x in "de"]
    pairs = rare.where(~both).select(*bare, "leaves", "others").unionByName(more.select(*bare, "leaves", "others")).unionByName(_by_sets(hot, sets))
    best = pairs.groupBy("d").agg(F.min_by("e", F.struct(-F.col("leaves"), -F.col("others"), "e")).alias("e"))
    return best.select("d.doc_id", "d._r", F.col("e.doc_id").alias("base_id"), F.col("e._r").alias("_b"))


def _by_sets(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """d, e, leaves, others: for each d of hot, the best earlier e by the keys of their sets alone."""
    near = _nearest(sets)
    near = sets.select("id", "first", F.size("ls").alias("_l"), F.size("ns").alias("_n")).join(near, "id", "left")
    # later roots of a set share all of it with its first root, so only one with all of it can come before that
    whole = F.coalesce((F.col("leaves") == F.col("_l")) & (F.col("others") == F.col("_n")), F.lit(False))
    own = (F.col("d.doc_id") > F.col("first.doc_id")) & ~whole
    found = hot.select("d", "id").join(near, "id")
    return found.select("d", *[F.when(own, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("first", "e"), ("_l", "leaves"), ("_n", "others"))]).where("e IS NOT NULL")


def _nearest(sets: DataFrame) -> DataFrame:
    """id, e, leaves, others: for each set, of the sets with an earlier first root that share a key with it, the best one's. All pairs of blocks of sets are compared."""
    n, keys = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("ls") + F.size("ns")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_SETS), -(-keys // BLOCK_KEYS), 1)
    mine, other = F.pmod("id", F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = sets.select("id", "first.doc_id", "first._r", "ls", "ns", mine.cast("int").alias("_x"), other.alias("_y"))
    tiles = rows.withColumns({"tile": F.col("_x") * blocks + F.col("_y"), "asks": F.lit(True)}).unionByName(rows.withColumns({"tile": F.col("_y") * blocks + F.col("_x"), "asks": F.lit(False)}))
    kind = sets.schema["first"].dataType["doc_id"].dataType.simpleString()
    found = tiles.drop("_x", "_y").repartition(blocks * blocks, "tile").groupBy("tile").applyInArrow(_tile, f"id bigint, doc_id {kind}, _r binary, leaves int, others int")
    order = F.struct(-F.col("leaves"), -F.col("others"), F.struct("doc_id", "_r").alias("e"), "leaves", "others")
    return found.groupBy("id").agg(F.min(order).alias("_m")).select("id", "_m.e", "_m.leaves", "_m.others")


def _tile(rows: pa.Table) -> pa.Table:
    """The best earlier set of those that don't ask, for each that asks."""
    rows = rows.append_column("_o", pc.rank(rows["doc_id"], tiebreaker="dense")).sort_by([("doc_id", "ascending"), ("_r", "ascending")]).combine_chunks()
    asks, held = rows.filter(rows["asks"]), rows.filter(pc.invert(rows["asks"]))
    # in the order of doc_id, so that those before a set come first and the first of equals is the smallest
    before = np.searchsorted(held["_o"].to_numpy(), asks["_o"].to_numpy())
    found = [_postings(asks[c], held[c]) for c in ("ls", "ns")]
    out = []
    for i in range(asks.num_rows):
        if before[i]:
            leaves, others = (np.bincount(owners[ragged(starts[a:b], sizes[a:b])], minlength=before[i])[: before[i]] for owners, starts, sizes, ends in found for a, b in [ends[i : i + 2]])
            at = int(np.argmax(leaves * (int(others.max()) + 1) + others))
            if leaves[at] or others[at]:
                out.append((i, at, int(leaves[at]), int(others[at])))
    i, at, leaves, others = (pa.array([r[c] for r in out], t) for c, t in enumerate([pa.int64(), pa.int64(), pa.int32(), pa.int32()]))
    return pa.table({"id": asks["id"].take(i), "doc_id": held["doc_id"].take(at), "_r": held["_r"].take(at), "leaves": leaves, "others": others})


def _postings(asks: pa.ChunkedArray, held: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of held by key, where those of each key of asks start and how many they are, and where the keys of each row of asks start."""
    flat = [(pc.list_flatten(c).to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(c).to_numpy()))).astype(np.int64)) for c in (asks, held)]
    (wanted, ends), (keys, cuts) = flat
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[order]
    starts = np.searchsorted(keys, wanted, "left")
    return owners, starts, np.searchsorted(keys, wanted, "right") - starts, ends


def corpus_fingerprints(docs: DataFrame) -> DataFrame:
    """The root of every document, its twin, and where it departs from an earlier relative.

    twin_id: the smallest doc_id with the same root. base_id: for a document that is its own twin, the smaller doc_id, of those that are their
    own twins, that shares most of its distinct paragraphs; then most of its sections of several paragraphs; then the smallest.
    edited: positions of its paragraphs that the base lacks.
    A document without a common paragraph has no base, however alike the words are.
    """
    trees = written(fingerprints(docs), "merkle").withColumn("_r", _short(F.col("root")))
    known = trees.where("root IS NOT NULL AND doc_id IS NOT NULL")
    roots = known.groupBy("_r").agg(F.min("doc_id").alias("twin_id"))
    own = known.join(roots.select("_r", F.col("twin_id").alias("doc_id")), ["doc_id", "_r"]).dropDuplicates(["doc_id", "_r"])
    base = written(_bases(own), "merkle-base")
    # what a comparison needs of a tree: 64 bits of each digest tell the paragraphs of two documents apart
    small = F.transform("sections", lambda s: F.struct(F.xxhash64(s["node"]).alias("node"), F.transform(s["leaves"], lambda h: F.xxhash64(h)).alias("leaves")))
    compact = known.select("doc_id", "_r", small.alias("_s"))
    mine = compact.join(base, ["doc_id", "_r"]).dropDuplicates(["doc_id", "_r"])
    theirs = compact.select(F.col("doc_id").alias("base_id"), F.col("_r").alias("_b"), F.col("_s").alias("_o")).join(base.select("base_id", "_b").distinct(), ["base_id", "_b"], "left_semi").dropDuplicates(["base_id", "_b"])
    edits = mine.join(theirs, ["base_id", "_b"]).select("_r", "base_id", changed_paragraphs(F.col("_s"), F.col("_o")).alias("edited"))
    found = roots.join(edits, "_r", "left")
    sizes = {"n_sections": F.size("sections"), "n_paragraphs": F.size(F.flatten("sections.leaves"))}
    out = trees.select("doc_id", "root", "_r", *[F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).alias(c) for c, n in sizes.items()], F.coalesce(F.col("sections.node"), F.array().cast("array<string>")).alias("section_nodes"))
    own = F.col("doc_id") == F.col("twin_id")
    return out.join(found, "_r", "left").select("doc_id", "root", "n_sections", "n_paragraphs", "section_nodes", F.when(F.col("doc_id").isNotNull(), F.col("twin_id")).alias("twin_id"), F.when(own, F.col("base_id")).alias("base_id"), F.when(own, F.col("edited")).alias("edited"))


def _short(digest: Column) -> Column:
    """The first 128 bits of a digest in hexadecimal, as a key to move."""
    return F.unhex(F.substring(digest, 1, 32))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, list_filter(list_transform(string_split(array_to_string(list_transform(list_transform(string_split(text, chr(10)),
           lambda p: CASE WHEN trim(p) = '' THEN '' ELSE sha256('L' || trim(p)) END),
           lambda h: CASE WHEN h = '' THEN '|' WHEN h[1] IN ('0', '1') THEN h || '|' ELSE h || ' ' END), ''), '|'),
           lambda s: trim(s)), lambda s: s <> '') AS secs
  FROM documents),
n AS (SELECT doc_id, secs, list_transform(secs, lambda s: sha256('S' || s)) AS nodes FROM t),
r AS (SELECT *, sha256('R' || coalesce(array_to_string(nodes, ' '), '')) AS root FROM n),
w AS (SELECT root, min(doc_id) AS twin_id FROM r GROUP BY root),
o AS (SELECT DISTINCT ON (r.root) r.* FROM r JOIN w ON w.root = r.root AND w.twin_id = r.doc_id),
k AS (SELECT doc_id, TRUE AS leaf, unnest(list_distinct(flatten(list_transform(secs, lambda s: string_split(s, ' '))))) AS k FROM o
      UNION ALL SELECT doc_id, FALSE, unnest(list_distinct(list_filter(list_transform(secs, lambda s: CASE WHEN contains(s, ' ') THEN sha256('S' || s) END), lambda x: x IS NOT NULL))) FROM o),
v AS (SELECT d.doc_id, e.doc_id AS e, count(*) FILTER (WHERE d.leaf) AS leaves, count(*) FILTER (WHERE NOT d.leaf) AS others
      FROM k d JOIN k e ON e.leaf = d.leaf AND e.k = d.k AND e.doc_id < d.doc_id GROUP BY d.doc_id, e.doc_id),
b AS (SELECT doc_id, arg_min(e, (-leaves, -others, e)) AS base_id FROM v GROUP BY doc_id),
p AS (SELECT r.doc_id, unnest(list_transform(secs, lambda s: string_split(s, ' '))) AS ls, generate_subscripts(secs, 1) AS k FROM r),
q AS (SELECT doc_id, k, unnest(ls) AS leaf, generate_subscripts(ls, 1) AS j FROM p),
l AS (SELECT doc_id, k, leaf, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS pos FROM q),
e AS (SELECT b.doc_id, CAST(coalesce(list(l.pos ORDER BY l.pos) FILTER (WHERE NOT list_contains(o.nodes, m.nodes[l.k]) AND
        NOT EXISTS (SELECT 1 FROM l z WHERE z.doc_id = b.base_id AND z.leaf = l.leaf)), []) AS INTEGER[]) AS edited
      FROM b JOIN r m ON m.doc_id = b.doc_id JOIN r o ON o.doc_id = b.base_id JOIN l ON l.doc_id = b.doc_id GROUP BY b.doc_id)
SELECT r.doc_id, r.root, CAST(len(nodes) AS INTEGER) AS n_sections,
       CAST((SELECT count(*) FROM l WHERE l.doc_id = r.doc_id) AS INTEGER) AS n_paragraphs, nodes AS section_nodes, twin_id, base_id, edited
FROM r LEFT JOIN w ON w.root = r.root LEFT JOIN b ON b.doc_id = r.doc_id LEFT JOIN e ON e.doc_id = r.doc_id
"""
