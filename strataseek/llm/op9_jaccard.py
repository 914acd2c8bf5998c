"""N-gram Jaccard join: which documents have word n-gram sets that are alike, as classes, links and pairs.

Words are lower-cased runs between white space; a text of fewer than n words has one gram, all of it. Texts with equal words are one entry: the join compares
entries, and what copies add follows without any comparison. The join goes by tiles. A tile holds the entries that agree in one of BANDS keys of
ROWS min-hashes; in it rows are sorted by size, and a row meets only the band of sizes that the threshold allows. A tile of more than CELL rows
is cut into cells: by size class, of which only neighbours can be alike, and by the hash of the row within a class; a pair of rows meets in one cell. Each entry has a
bitmap of its hashed grams, two to four bits for each, which folds to that of a smaller one: a bit that one has and the other lacks is a gram of one that the
other lacks, so bit counts bound the overlap from above, and what can't reach the threshold goes no further. Pairs left are settled exactly, on sorted arrays of
64-bit gram hashes. A pair is met in the first tile it shares and in no other.

What leaves a cell is linear in its rows (each row's links and the smallest row it is connected with), never its pairs; only similar_texts returns pairs. There is no cap
on tiles, partners or candidates. A pair at Jaccard j shares no tile with probability (1 - j^ROWS)^BANDS: 1 in 10,000 at 0.5, below 1 in 10^9 from 0.7 up.

Defined results: a null doc_id is left out; null and blank texts have no grams and no links; rows with the same doc_id and words count once; a doc_id with several texts is one document in
classes, and its links are those of its texts, one another's among them. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.llm.common import coded_words, hashes_of, mixed, plain_strings, ragged, slices, whole_groups, written

N = 3
THRESHOLD = 0.5
BANDS, ROWS = 32, 2
_random = np.random.Generator(np.random.PCG64(9))
FACTORS = (_random.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
SHIFTS = _random.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)[:, None]
WORD_FACTORS = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Pairs of a tile looked at in one step, and rows that a tile has before it is cut into cells.
STEP, CELL = 500_000, 2_048


def gram_sets(texts: pa.Array, n: int = N) -> Iterator[tuple[np.ndarray, int]]:
    """(sorted distinct gram hashes, hash of the whole word sequence) of each text."""
    ends, codes, words = coded_words(texts)
    h = hashes_of(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    g = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for i in range(n):
        g += h[i : i + len(g)] * WORD_FACTORS[i]
    g = mixed(g)
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if e == s:
            yield np.zeros(0, np.uint64), 0
            continue
        x = h[s:e]
        whole = mixed((mixed(x + np.arange(e - s, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).sum(keepdims=True))
        yield (np.unique(g[s : e - n + 1]) if e - s >= n else mixed((x * WORD_FACTORS[: e - s]).sum(keepdims=True) + np.uint64(e - s))), int(whole[0])


def min_hash_keys(grams: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS min-hashes; 32 bits of a gram's hash go in, so equal sets have equal keys and few others do."""
    low, x = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    for s in range(0, len(x), 4_096):
        np.minimum(low, (x[None, s : s + 4_096] * FACTORS + SHIFTS).min(1), out=low)
    low = mixed(low.astype(np.uint64) + np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64(1 << 32)).reshape(BANDS, ROWS)
    return mixed((low * WORD_FACTORS[:ROWS]).sum(1) + np.arange(BANDS, dtype=np.uint64))


def bitmap(grams: np.ndarray) -> np.ndarray:
    """A power of two of bits, at least 64, two to four for each gram."""
    width = max(64, 1 << (2 * len(grams) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(grams >> np.uint64(10)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps, rows of 64-bit words, as those of so many words would be."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def signatures(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, words (a hash of all words, 128 bits, null where there are none), n_grams, keys, bits."""
    given = docs.where("doc_id IS NOT NULL").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                for d, (g, whole) in zip(part.column("doc_id").to_pylist(), gram_sets(plain_strings(part.column("text")), n)):
                    rows.append((d, words_key(g, whole), len(g), min_hash_keys(g).tobytes(), bitmap(g).tobytes()) if len(g) else (d, None, 0, None, None))
                types = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "words", "n_grams", "keys", "bits"])

    return given.mapInArrow(run, "doc_id bigint, words binary, n_grams int, keys binary, bits binary")


def words_key(grams: np.ndarray, whole: int) -> bytes:
    return whole.to_bytes(8, "big") + int(mixed(grams).sum()).to_bytes(8, "big")


def _needed(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """The overlap that sets of sizes a and b need for a Jaccard of t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def tile_candidates(tile: np.ndarray, size: np.ndarray, band: np.ndarray, side: np.ndarray, keys: np.ndarray, bits: list[bytes], t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of rows of one tile that may reach t. Rows are sorted by tile, then size; keys [rows, BANDS]; side: 0, or 1 and 2 where only rows of different sides meet."""
    n = len(tile)
    new = np.concatenate(([True], tile[1:] != tile[:-1])) if n else np.zeros(0, bool)
    number = np.cumsum(new)
    # one increasing number from tile and size, so that one search finds where the size band of each row ends
    scale = int(size.max()) + 2 if n else 1
    end = np.searchsorted(number * scale + size, number * scale + np.minimum(np.floor(size / t + 1e-9), scale - 1).astype(np.int64), side="right")
    partners = np.maximum(end - np.arange(n) - 1, 0)
    done = np.concatenate(([0], np.cumsum(partners)))
    width = np.fromiter(map(len, bits), np.int64, n) // 8
    by_width = {int(w): (at := np.flatnonzero(width == w), np.frombuffer(b"".join([bits[i] for i in at.tolist()]), np.uint64).reshape(len(at), int(w))) for w in np.unique(width)}
    place = np.zeros(n, np.int64)
    for at, _ in by_width.values():
        place[at] = np.arange(len(at))
    narrow: dict[tuple[int, int], np.ndarray] = {}
    s = 0
    while s < n:
        e = min(n, max(s + 1, int(np.searchsorted(done, done[s] + STEP, side="right")) - 1))
        i = np.repeat(np.arange(s, e), partners[s:e])
        j = ragged(np.arange(s, e) + 1, partners[s:e])
        for u in range(0, len(i), STEP):
            a, b = i[u : u + STEP], j[u : u + STEP]
            first = ((keys[a] == keys[b]).argmax(1) == band[a]) & ((side[a] != side[b]) | (side[a] == 0))
            a, b = a[first], b[first]
            for w, v in {(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in np.unique(width[a] << 32 | width[b])}:
                here = np.flatnonzero((width[a] == w) & (width[b] == v))
                if (w, v) not in narrow:
                    narrow[w, v] = folded(by_width[v][1], w)
                for k in range(0, len(here), max(1, 4_000_000 // w)):
                    p, q = a[here[k : k + max(1, 4_000_000 // w)]], b[here[k : k + max(1, 4_000_000 // w)]]
                    x, y = by_width[w][1][place[p]], narrow[w, v][place[q]]
                    over = np.minimum(size[p] - np.bitwise_count(x & ~y).sum(1), size[q] - np.bitwise_count(y & ~x).sum(1))
                    ok = over >= _needed(size[p], size[q], t)
                    if ok.any():
                        yield p[ok], q[ok]
        s = e


def entries_of(sig: DataFrame) -> DataFrame:
    """eid, words, head (the smallest doc_id with these words), copies (doc_ids with them), n_rows (rows of the head), n_grams, keys, bits: one row for each text. Written, so that eid stays."""
    some = sig.where("words IS NOT NULL")
    heads = some.groupBy("words", "doc_id").agg(F.count(F.lit(1)).alias("n_rows")).groupBy("words").agg(F.min(F.struct("doc_id", "n_rows")).alias("_h"), F.count(F.lit(1)).alias("copies"))
    heads = heads.select("words", "_h.doc_id", "_h.n_rows", "copies")
    found = some.join(heads, ["words", "doc_id"]).dropDuplicates(["words", "doc_id"])
    return written(found.select(F.monotonically_increasing_id().alias("eid"), "words", F.col("doc_id").alias("head"), "copies", "n_rows", "n_grams", "keys", "bits"), "jaccard-entries")


def cells_of(entries: DataFrame, t: float, cell: int = CELL) -> DataFrame:
    """tile, eid, band, side: the rows of every tile that has two or more, a larger one in cells."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64)
                each = [np.repeat(b.column(c).to_numpy(), BANDS) for c in ("eid", "n_grams")]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(each[0]), pa.array(each[1]), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows))], names=["key", "eid", "n_grams", "band"])

    keyed = entries.select("eid", "n_grams", "keys").mapInArrow(explode, "key bigint, eid bigint, n_grams int, band int")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = written(keyed.join(counts, "key"), "jaccard-shared")
    cold = shared.where(F.col("_n") <= cell).select(F.col("key").alias("tile"), "eid", "band", F.lit(0).alias("side"))
    # sizes of one class differ by less than 1 / t, so what is alike is in the same class or in the next
    hot = shared.where(F.col("_n") > cell).withColumn("_c", F.floor(F.log(F.col("n_grams")) / F.lit(float(-np.log(t))) + 1e-9).cast("int"))
    parts = hot.groupBy("key", "_c").agg(F.ceil(F.count(F.lit(1)) * 2 / cell).cast("int").alias("_p"))  # a cell has two parts
    parts = parts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("_c", "_p"))).alias("_parts"))  # a key has as many as there are classes, some twenty
    hot = hot.join(parts, "key").withColumn("_s", F.pmod(F.xxhash64("eid", "key"), F.element_at("_parts", F.col("_c"))).cast("int"))

    def met(other, make):
        many = F.coalesce(F.try_element_at("_parts", other), F.lit(0))
        return F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), make)).otherwise(F.array().cast("array<struct<c:int,d:int,i:int,j:int,side:int>>"))

    c, s = F.col("_c"), F.col("_s")
    row = lambda c, d, i, j, side: F.struct(c.cast("int").alias("c"), F.lit(d).alias("d"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    own = met(c, lambda j: row(c, 0, F.least(s, j), F.greatest(s, j), F.when(s == j, 0).when(s < j, 1).otherwise(2)))
    after = met(c + 1, lambda j: row(c, 1, s, j, F.lit(1)))
    before = met(c - 1, lambda j: row(c - 1, 1, j, s, F.lit(2)))
    hot = hot.withColumn("_m", F.explode(F.concat(own, after, before)))
    return cold.unionByName(hot.select(F.xxhash64("key", "_m.c", "_m.d", "_m.i", "_m.j").alias("tile"), "eid", "band", F.col("_m.side").alias("side")))


def settled(docs: DataFrame, entries: DataFrame, n: int, t: float, want: str) -> DataFrame:
    """What the exact intersections of all candidates give. want: 'pairs' (a, b: heads, jaccard), 'links' (eid, links: copies of the entries alike, head, root: the
    smallest head it is connected with in its cell), or 'roots' (the same without links, where a pair that is connected already needs no intersection)."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Half of each key goes along: it tells the first tile of a pair, and two tiles are taken for one in 2^32."""
        for b in batches:
            if b.num_rows:
                k = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.uint64).astype(np.uint32).reshape(-1, BANDS)
                yield pa.RecordBatch.from_arrays([b.column("eid"), b.column("n_grams"), pa.array([x.tobytes() for x in k], pa.binary()), b.column("bits")], names=["eid", "n_grams", "keys", "bits"])

    shortened = entries.select("eid", "n_grams", "keys", "bits").mapInArrow(short, "eid bigint, n_grams int, keys binary, bits binary")
    wide = cells_of(entries, t).join(shortened, "eid").select("tile", "eid", "band", "side", "n_grams", "keys", "bits")
    wide = wide.repartition(shuffles, "tile").sortWithinPartitions("tile", "n_grams", "eid")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tb in whole_groups(batches, "tile"):
            tile, ids, size, band, side = (tb[c].to_numpy() for c in ("tile", "eid", "n_grams", "band", "side"))
            keys = np.frombuffer(b"".join(tb["keys"].to_pylist()), np.uint32).reshape(-1, BANDS)
            found = list(tile_candidates(tile, size.astype(np.int64), band, side, keys, tb["bits"].to_pylist(), t))
            if not found:
                continue
            a, b = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            # one row for each entry of the tile, with its partners by place among them: what is sent later grows with rows, not pairs
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            rows = np.unique(np.concatenate([a, b]))
            starts, stops = np.searchsorted(a, rows), np.searchsorted(a, rows, side="right")
            partners = [ids[b[s:e]].tobytes() for s, e in zip(starts, stops)]
            yield pa.RecordBatch.from_arrays([pa.array(tile[rows]), pa.array(ids[rows]), pa.array(partners, pa.binary())], names=["tile", "eid", "partners"])

    met = written(wide.mapInArrow(meet, "tile bigint, eid bigint, partners binary"), "jaccard-met")
    needed = entries.select("eid", "words", "head", "copies", "n_rows").join(met.select("eid").distinct(), "eid", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = [(words_key(g, whole), g.tobytes()) if len(g) else (None, None) for g, whole in gram_sets(plain_strings(part.column("text")), n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*got))], names=["head", "words", "grams"])

    def grams(heads: DataFrame) -> DataFrame:
        texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").join(heads.select(F.col("head").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return texts.mapInArrow(sets, "head bigint, words binary, grams binary").join(heads, ["head", "words"]).select("eid", "head", "copies", "grams")

    repeated = grams(needed.where("n_rows > 1")).groupBy("eid").agg(F.first("head").alias("head"), F.first("copies").alias("copies"), F.first("grams").alias("grams"))
    held = grams(needed.where("n_rows = 1")).unionByName(repeated)
    both = met.join(held, "eid").select("tile", "eid", "partners", "head", "copies", "grams").repartition(shuffles, "tile").sortWithinPartitions("tile")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tb in whole_groups(batches, "tile"):
            tile, columns = tb["tile"].to_numpy(), [tb[c].to_numpy() for c in ("eid", "head", "copies")]
            partners, sets = tb["partners"].to_pylist(), tb["grams"].to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
            out = [_cell(*(c[s:e] for c in columns), partners[s:e], sets[s:e], t, want) for s, e in zip(cuts[:-1], cuts[1:])]
            out = [np.concatenate(c) for c in zip(*out)]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["a", "b", "jaccard"] if want == "pairs" else ["eid", "links", "head", "root"])

    return both.mapInArrow(settle, "a bigint, b bigint, jaccard double" if want == "pairs" else "eid bigint, links bigint, head bigint, root bigint")


def _cell(ids: np.ndarray, heads: np.ndarray, copies: np.ndarray, partners: list[bytes], grams: list[bytes], t: float, want: str) -> tuple[np.ndarray, ...]:
    """The rows of one cell that settled makes of it."""
    arrays, order = [np.frombuffer(g, np.uint64) for g in grams], np.argsort(ids)
    sizes = np.array([len(x) for x in arrays], np.int64)
    others = [order[np.searchsorted(ids[order], np.frombuffer(p, np.int64))] for p in partners]
    dense = sum(map(len, others)) > 4 * len(ids)
    if dense:  # the cell's grams by number, so that a row is marked once for all its partners
        starts = np.cumsum(sizes) - sizes
        _, place = np.unique(np.concatenate(arrays), return_inverse=True)
        mark = np.zeros(int(place.max()) + 1, bool)
    label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    pairs: list[tuple] = []
    for i in sorted(range(len(ids)), key=lambda i: -len(others[i])):
        o = others[i]
        for u in range(0, len(o), 2_000):
            part = o[u : u + 2_000]
            if want == "roots":
                part = part[label[part] != label[i]]
            if not len(part):
                continue
            firsts = np.cumsum(sizes[part]) - sizes[part]
            if dense:
                mine = place[starts[i] : starts[i] + sizes[i]]
                mark[mine] = True
                hit = mark[place[ragged(starts[part], sizes[part])]]
                mark[mine] = False
            else:
                theirs = np.concatenate([arrays[x] for x in part])
                hit = arrays[i][np.minimum(np.searchsorted(arrays[i], theirs), sizes[i] - 1)] == theirs
            common = np.add.reduceat(hit.astype(np.int64), firsts)
            j = common / (sizes[i] + sizes[part] - common)
            part, j = part[j >= t - 1e-12], j[j >= t - 1e-12]
            if not len(part):
                continue
            if want == "pairs":
                pairs.append((np.minimum(heads[i], heads[part]), np.maximum(heads[i], heads[part]), j))
                continue
            links[part] += copies[i]
            links[i] += copies[part].sum()
            label[np.isin(label, label[part])] = label[i]
    if want == "pairs":
        return tuple(np.concatenate(c) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, heads)
    some = links > 0
    return ids[some], links[some], heads[some], least[label][some]


def similar_texts(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """doc_a, doc_b, jaccard of the pairs of different texts, each by the smallest doc_id that has it, with a Jaccard of at least t. Copies are in members."""
    entries = entries_of(written(signatures(docs, n), "jaccard-signatures"))
    found = settled(docs, entries, n, t, "pairs").where("a <> b")
    return found.groupBy(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")).agg(F.round(F.max("jaccard"), 9).alias("jaccard"))


def members(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, representative: the smallest doc_id with the same words, for each text of each document."""
    some = signatures(docs, n).where("words IS NOT NULL").select("doc_id", "words").distinct()
    return some.join(some.groupBy("words").agg(F.min("doc_id").alias("representative")), "words").select("doc_id", "representative")


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id) of every node of edges (a, b) that isn't its component's smallest, by large-star and small-star rounds until nothing changes."""
    now = written(edges.select("a", "b").where("a <> b").distinct(), "stars")
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, "stars")
        if not after.join(now, ["a", "b"], "left_anti").take(1) and after.count() == now.count():
            break
        now = after
    return after.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))


def _classes(docs: DataFrame, n: int, t: float, count: bool) -> DataFrame:
    sig = written(signatures(docs, n), "jaccard-signatures")
    entries = entries_of(sig)
    found = written(settled(docs, entries, n, t, "links" if count else "roots"), "jaccard-settled")
    links = found.groupBy("eid").agg(F.sum("links").alias("_l"))
    info = entries.select("eid", "words", "head", "copies").join(links, "eid", "left").select("words", "head", (F.col("copies") - 1 + F.coalesce("_l", F.lit(0))).alias("_l"))
    texts = sig.select("doc_id", "words").distinct().join(info, "words", "left")
    each = written(texts.groupBy("doc_id").agg(F.min("head").alias("head"), F.coalesce(F.sum("_l"), F.lit(0)).alias("n_links"), F.count("head").alias("_t")), "jaccard-documents")
    several = each.where("_t > 1").select("doc_id", F.col("head").alias("b"))  # a document with several texts ties them
    tied = texts.join(several, "doc_id").select(F.col("head").alias("a"), "b")
    class_of = components(found.select(F.col("head").alias("a"), F.col("root").alias("b")).unionByName(tied)).select(F.col("id").alias("head"), "component")
    return each.join(class_of, "head", "left").select("doc_id", F.coalesce("component", "head", "doc_id").alias("class_id"), "n_links")


def jaccard_join(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id that a chain of links leads to), n_links (texts of other documents with a Jaccard of at least t, each copy counting) of every document."""
    return _classes(docs, n, t, True)


def duplicate_groups(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """doc_id, kept: the smallest doc_id that a chain of links leads to, for the documents that aren't it. Of a cell whose rows are connected already no more pairs are intersected."""
    return _classes(docs, n, t, False).where("doc_id <> class_id").select("doc_id", F.col("class_id").alias("kept"))


ORACLE = f"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id, ws) AS rid FROM w),
g AS (SELECT DISTINCT rid, doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {N} THEN [array_to_string(ws, ' ')]
        ELSE list_transform(generate_series(1, len(ws) - {N - 1}), lambda i: array_to_string(list_slice(ws, i, i + {N - 1}), ' ')) END) AS gram FROM r),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, any_value(a.doc_id) AS doc_a, any_value(b.doc_id) AS doc_b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.rid <> b.rid GROUP BY a.rid, b.rid),
e AS (SELECT doc_a, doc_b FROM p JOIN n x ON x.rid = p.a JOIN n y ON y.rid = p.b WHERE c / (x.n + y.n - c) >= {THRESHOLD}),
reach AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, e.doc_b FROM reach JOIN e ON e.doc_a = reach.b),
l AS (SELECT doc_a, count(*) AS n FROM e GROUP BY doc_a)
SELECT a AS doc_id, min(b) AS class_id, CAST(coalesce(any_value(l.n), 0) AS BIGINT) AS n_links FROM reach LEFT JOIN l ON l.doc_a = reach.a GROUP BY a
"""
