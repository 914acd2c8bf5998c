"""Prediction by partial matching: code lengths of documents under byte contexts.

A document costs the bits that an order-k PPM coder (method C: a context with q distinct symbols and n occurrences gives symbol s
n(s) / (n + q) and the escape q / (n + q)) would spend on its UTF-8 bytes. On an escape the next shorter
context is asked, without the symbols that the longer one knew (symbol exclusion); below order 0 the symbols left are equally likely.

Pretrained: the counts of all documents, held in two halves by the hash of the doc_id, and each document is coded by the half that it isn't in, so that
it never predicts itself. With fixed counts the cost of a byte depends on it and the k bytes before alone; every
(k+1)-gram of the corpus is therefore priced once, in Spark, and a document's code length is the sum of its grams' prices.
Pricing needs, beside a gram, only grams with the same last bytes, so it runs in one task for each pair of last context bytes, over the orders from 2 up;
the orders below are small tables of at most 256^2 rows. Grams are gathered by partial sums from whole partitions.
The price table grows with the corpus's distinct grams. Its rows are counted; up to MAX_ROWS it is broadcast (128 MB). A larger one is joined: documents go in slices, each
slice asks once for each of its distinct grams, and is coded with the answers. Documents are read once, whatever the size, and both ways give the same.

Adaptive: the trie starts empty for each document and learns as it reads (PpmTrie), for texts that no corpus describes.

Documents begin after k zero bytes. Defined results: a null or empty text has 0 bytes, 0 bits and a null rate; rows that repeat get
equal results; a null doc_id counts as the value that hashes to its half. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.llm.common import ragged, slices, whole_groups, written

ORDER = 4
#: Rows of a price table that is broadcast, 16 bytes each; a larger one is joined. Bytes of text that are then coded together.
MAX_ROWS, SLICE = 8_000_000, 32 << 20


def half_of(key: str):
    return F.pmod(F.xxhash64(F.lit(4), F.col(key)), F.lit(2)).cast("int")


def padded(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each after order zero bytes, and the lengths without those."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    buffers = texts.buffers()
    starts = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[starts[0] : starts[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    out = np.zeros(int(sizes.sum()) + order * len(sizes), np.uint8)
    out[ragged(np.cumsum(sizes + order) - sizes, sizes)] = data
    return out, sizes


def grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text, it and the order bytes before as one number; and the number of bytes of each text."""
    data, sizes = padded(texts, order)
    n = len(data)
    out = np.zeros(n, np.uint64)
    for back in range(order + 1):
        out[back:] |= data[: n - back].astype(np.uint64) << np.uint64(8 * back)
    return out[ragged(np.cumsum(sizes + order) - sizes, sizes)], sizes


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    return g[first], np.add.reduceat(c, first) if len(first) else c


def corpus_counts(docs: DataFrame, order: int) -> DataFrame:
    """gram, n0, n1: occurrences of each gram in each half of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]
        size = [0, 0]

        def rows(h: int) -> pa.RecordBatch:
            g, c = merged(held[h])
            held[h], size[h] = [], 0
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c * (h == 0), pa.int64()), pa.array(c * (h == 1), pa.int64())], names=["gram", "n0", "n1"])

        for batch in batches:
            for part in slices(batch, "text"):
                for h in (0, 1):
                    own = part.filter(pc.equal(part.column("half"), h))
                    held[h].append(counted(grams(own.column("text"), order)[0]))
                    size[h] += len(held[h][-1][0])
                    if len(held[h]) > 8:
                        held[h] = [merged(held[h])]
                        size[h] = len(held[h][0][0])
                    if size[h] > 4_000_000:
                        yield rows(h)
        for h in (0, 1):
            if held[h]:
                yield rows(h)

    raw = docs.select(half_of("doc_id").alias("half"), "text").mapInArrow(run, "gram bigint, n0 bigint, n1 bigint")
    return raw.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def low_orders(counts: DataFrame) -> dict[int, np.ndarray]:
    """The occurrences of one and two last bytes: {0: [256, 2], 1: [256, 256, 2]}."""
    two = counts.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("g")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    n1 = np.zeros((65536, 2))
    n1[two["g"].to_numpy()] = np.column_stack([two["n0"].to_numpy(), two["n1"].to_numpy()])
    n1 = n1.reshape(256, 256, 2)
    return {1: n1, 0: n1.sum(0)}


def prices(gram: np.ndarray, n: np.ndarray, low: dict[int, np.ndarray], order: int, half: int) -> np.ndarray:
    """Bits of each gram under the counts n of the other half. gram: all of those with like last context bytes, distinct and sorted."""
    n = n.astype(np.float64)
    bits, open_ = np.zeros(len(gram)), np.ones(len(gram), bool)
    known_above: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # contexts of the order above, what they exclude below: occurrences, symbols
    for j in range(order, -1, -1):
        mask = np.uint64((1 << (8 * (j + 1))) - 1)
        key = gram & mask
        context = key >> np.uint64(8)
        if j >= 2:
            keys, place = np.unique(key, return_inverse=True)
            count = np.bincount(place, n, len(keys))
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(of, count, len(contexts)), np.bincount(of, count > 0, len(contexts))
            mine, at = count[place], of[place]
            total, kinds = total[at], kinds[at].astype(np.float64)
            rows, row_count = keys, count
        else:
            table = low[j][..., 1 - half]
            if j == 1:
                mine = table[(context & np.uint64(255)).astype(np.int64), (key & np.uint64(255)).astype(np.int64)]
                c = (context & np.uint64(255)).astype(np.int64)
                total, kinds = table.sum(1)[c], (table > 0).sum(1)[c].astype(np.float64)
            else:
                mine = table[key.astype(np.int64)]
                total, kinds = np.full(len(gram), table.sum()), np.full(len(gram), float((table > 0).sum()))
        seen = total > 0
        if known_above is not None:  # what the context one longer knew is out
            up, less_total, less_kinds = known_above
            total, kinds = total - less_total[up], kinds - less_kinds[up]
        now = open_ & (mine > 0)
        bits[now] -= np.log2(mine[now] / (total + kinds)[now])
        open_ &= ~now
        escape = open_ & seen & (kinds > 0) & (total > 0)
        bits[escape] -= np.log2(kinds[escape] / (total + kinds)[escape])
        # what this order's contexts exclude from the one below
        if j >= 2:
            below = below_counts(gram, n, low, j - 1, half, rows)
            known = row_count > 0
            known_above = (of[place], np.bincount(of, below * known, len(contexts)), np.bincount(of, known, len(contexts)).astype(np.float64))
        elif j == 1:
            known = table > 0
            known_above = (c, (known * low[0][:, 1 - half][None, :]).sum(1), known.sum(1).astype(np.float64))
        else:
            left = 256 - float((table > 0).sum())
            bits[open_] += math.log2(max(left, 1))
    return bits


def below_counts(gram: np.ndarray, n: np.ndarray, low: dict[int, np.ndarray], j: int, half: int, rows: np.ndarray) -> np.ndarray:
    """For rows of order j + 1, the occurrences of the same symbol in the context one shorter."""
    if j == 1:
        return low[1][..., 1 - half][((rows >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (rows & np.uint64(255)).astype(np.int64)]
    mask = np.uint64((1 << (8 * (j + 1))) - 1)
    keys, place = np.unique(gram & mask, return_inverse=True)
    return np.bincount(place, n, len(keys))[np.searchsorted(keys, rows & mask)]


def price_table(counts: DataFrame, order: int) -> DataFrame:
    """gram, bits0, bits1: the price of each gram in documents of half 0 (counts of half 1) and of half 1."""
    held = counts.sparkSession.sparkContext.broadcast(low_orders(counts))  # 65,536 rows, whatever the data
    cores = counts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = counts.withColumn("ctx", F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))).repartition(int(cores), "ctx").sortWithinPartitions("ctx")

    def rows(ctx: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(ctx)
        g = t["gram"].to_numpy().view(np.uint64)
        by = np.argsort(g)
        g, n0, n1 = g[by], t["n0"].to_numpy()[by], t["n1"].to_numpy()[by]
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(prices(g, n1, held.value, order, 0), pa.float32()), pa.array(prices(g, n0, held.value, order, 1), pa.float32())], names=["gram", "bits0", "bits1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # whole contexts, priced many at a time: contexts don't mix in the arithmetic
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ctx = batch.column("ctx").to_numpy()
            cut = int(np.searchsorted(ctx, ctx[-1]))
            if cut or (kept and kept[-1].column("ctx")[-1].as_py() != ctx[0]):
                if cut:
                    kept.append(batch.slice(0, cut))
                n += cut
                if n > 500_000:
                    yield rows(kept)
                    kept, n = [], 0
            kept.append(batch.slice(cut))
            n += batch.num_rows - cut
        if kept:
            yield rows(kept)

    return spread.select("gram", "n0", "n1", "ctx").mapInArrow(run, "gram bigint, bits0 float, bits1 float")


class Prices:
    """Prices of one shard for look-up: contexts sorted, and a dense row of byte prices for each where that is small."""

    def __init__(self, gram: np.ndarray, *bits: np.ndarray):
        """bits: one array for each half; the grams' trie is the same for both."""
        order = np.argsort(gram)
        self.gram, self.bits = gram[order], np.column_stack(bits)[order]
        self.levels: list[np.ndarray] | None = None
        if len(gram) and len(gram) <= MAX_ROWS:
            self.build(int(max(int(self.gram.max()).bit_length() - 1, 0) // 8 + 1))

    def build(self, depth: int) -> None:
        """The grams as a trie of dense levels, first byte first; left out where a level would be too large."""
        keys = self.gram
        symbols = [((keys >> np.uint64(8 * (depth - 1 - i))) & np.uint64(255)).astype(np.int64) for i in range(depth)]
        self.bytes = np.unique(np.concatenate([np.unique(s) for s in symbols]))
        self.code = np.full(256, -1, np.int32)
        self.code[self.bytes] = np.arange(len(self.bytes))
        a, node, levels = len(self.bytes), np.zeros(len(keys), np.int64), []
        for i in range(depth):
            cell = node * a + self.code[symbols[i]]
            used, node = np.unique(cell, return_inverse=True)
            width = (int(cell.max() // a) + 1) * a
            if width > 40_000_000:
                return
            table = np.full(width + a, -1, np.int32)
            table[used] = np.arange(len(used))
            levels.append(table)
        self.levels, self.depth = levels, depth
        self.at = self.bits[np.argsort(node, kind="stable")]

    def of(self, gram: np.ndarray, half: np.ndarray | int = 0) -> np.ndarray:
        """The price of each gram in a document of its half, 0 for those of other shards."""
        if self.levels is None:
            if not len(self.gram):
                return np.zeros(len(gram), np.float32)
            at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
            return np.where(self.gram[at] == gram, self.bits[at, half], np.float32(0))
        a = len(self.bytes)
        node = np.zeros(len(gram), np.int32)
        dead = np.zeros(len(gram), bool)
        for i, table in enumerate(self.levels):
            c = self.code[((gram >> np.uint64(8 * (self.depth - 1 - i))) & np.uint64(255)).astype(np.uint8)]
            dead |= c < 0
            node = table[node * np.int32(a) + c]
            dead |= node < 0
            node[dead] = 0
        if self.depth < 8:
            dead |= (gram >> np.uint64(8 * self.depth)) > 0
        return np.where(dead, np.float32(0), self.at[node, half])


def code_lengths(docs: DataFrame, order: int = ORDER, max_rows: int = MAX_ROWS, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, n_bytes, bits, bits_per_byte of every document, by the counts of the other half of all documents."""
    counts = written(corpus_counts(docs, order), "ppm-counts")
    table = written(price_table(counts, order), "ppm-prices")
    given = docs.select("doc_id", half_of("doc_id").alias("half"), "text")
    out = _by_broadcast(given, table, order) if table.count() <= max_rows else _by_slices(given, table, order, slice_bytes)
    return out.select("doc_id", "n_bytes", F.round("bits", 3).alias("bits"), F.when(F.col("n_bytes") > 0, F.round(F.col("bits") / F.col("n_bytes"), 6)).alias("bits_per_byte"))


CODED = "doc_id bigint, n_bytes bigint, bits double"


def _coded(rows: pa.RecordBatch, table: Prices, order: int) -> pa.RecordBatch:
    """CODED for rows with doc_id, half, text."""
    g, sizes = grams(rows.column("text"), order)
    price = table.of(g, np.repeat(rows.column("half").to_numpy().astype(np.int8), sizes))
    sums = np.concatenate(([0.0], np.cumsum(price, dtype=np.float64)))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(sums[ends[1:]] - sums[ends[:-1]])], names=["doc_id", "n_bytes", "bits"])


def _by_broadcast(given: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """A price table of at most max_rows rows, which was counted, goes to every task."""
    t = table.toArrow()
    held = given.sparkSession.sparkContext.broadcast((t["gram"].to_numpy().view(np.uint64), t["bits0"].to_numpy(), t["bits1"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prices_ = Prices(*held.value)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield _coded(part, prices_, order)

    return given.mapInArrow(run, CODED)


def _by_slices(given: DataFrame, table: DataFrame, order: int, slice_bytes: int) -> DataFrame:
    """Documents in slices of about slice_bytes: each slice asks once for each of its distinct grams, one join answers all slices, and a slice is coded with its answers alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size = uuid.uuid4().int & (2**63 - 1), 0
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                n = int(pc.sum(pc.fill_null(pc.binary_length(part.column("text")), 0)).as_py() or 0)
                if size and size + n > slice_bytes:
                    now, size = uuid.uuid4().int & (2**63 - 1), 0
                size += n
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, now))], names=[*part.schema.names, "slice"])

    cuts = written(given.mapInArrow(cut, "doc_id bigint, half int, text string, slice bigint"), "ppm-slices")  # a slice's number stays, since it is written

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "slice"):  # a file has a slice's rows together; a slice that two tasks read asks twice
            numbers = t["slice"].to_numpy()
            for number in np.unique(numbers):
                texts = t["text"].filter(pa.array(numbers == number)).combine_chunks()
                g = np.unique(grams(texts, order)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), number)), pa.array(g.view(np.int64))], names=["slice", "gram"])

    answers = cuts.select("slice", "text").mapInArrow(ask, "slice bigint, gram bigint").dropDuplicates().join(table, "gram")

    def code(rows: pa.Table, answer: pa.Table) -> pa.Table:
        prices_ = Prices(answer["gram"].to_numpy().view(np.uint64), answer["bits0"].to_numpy(), answer["bits1"].to_numpy())
        parts = [_coded(p, prices_, order) for b in rows.combine_chunks().to_batches() for p in slices(b, "text", 1 << 20)]
        return pa.Table.from_batches(parts)

    return cuts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(code, CODED)


class PpmTrie:
    """A byte-context trie that learns as it codes: PPM, method C, with symbol exclusion."""

    def __init__(self, order: int = ORDER):
        self.order, self.root = order, {}

    def node(self, context: bytes, make: bool = False) -> dict | None:
        """counts of the symbols after context; a node is (counts, children), reached backwards from the last byte."""
        at = self.root
        for b in reversed(context):
            nxt = at.get(("c", b))
            if nxt is None:
                if not make:
                    return None
                nxt = at["c", b] = {}
            at = nxt
        return at

    def bits(self, context: bytes, symbol: int) -> float:
        """The price of symbol after context (its last order bytes)."""
        out, excluded = 0.0, set()
        for j in range(min(self.order, len(context)), -1, -1):
            node = self.node(context[len(context) - j :])
            counts = {s: n for s, n in (node or {}).items() if isinstance(s, int)}
            left = {s: n for s, n in counts.items() if s not in excluded}
            total = sum(left.values()) + len(left)
            if symbol in left:
                return out - math.log2(left[symbol] / total)
            if left:
                out -= math.log2(len(left) / total)
            excluded |= counts.keys()
        return out + math.log2(max(256 - len(excluded), 1))

    def learn(self, context: bytes, symbol: int) -> None:
        for j in range(min(self.order, len(context)) + 1):
            node = self.node(context[len(context) - j :], make=True)
            node[symbol] = node.get(symbol, 0) + 1

    def code_length(self, text: str | None, adapt: bool = True) -> float:
        """Bits of a text; with adapt, each byte is learnt once it is coded."""
        data = bytes(self.order) + (text or "").encode()
        out = 0.0
        for i in range(self.order, len(data)):
            context = data[i - self.order : i]
            out += self.bits(context, data[i])
            if adapt:
                self.learn(context, data[i])
        return out


def adaptive_code_lengths(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_bytes, bits: each document coded by a trie that starts empty with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([PpmTrie(order).code_length(t) for t in texts], pa.float64())], names=["doc_id", "n_bytes", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, bits double")
