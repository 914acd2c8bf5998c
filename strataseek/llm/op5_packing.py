"""Best-fit packing after Martello-Toth dominance reduction.

Documents become items: their tokens under a public tokenizer and one for the end of the document, cut into whole sequences of the capacity and
a rest where it is longer (part p holds the tokens from p times the capacity on). An item's identity doesn't matter for packing, only its size, so the instance is the histogram of
sizes, which has at most capacity entries however many documents there are; it is packed on the driver and
the plan, whose length follows the capacity too, is applied to the documents in Spark by their rank within a size.

Reduction: for the largest item left, a set that fits and dominates all other sets it could be with is fixed for good. One
set dominates another if the other's items can be shared out over its own without exceeding any. Fixed, in this order: the item alone if nothing fits with it;
with an item that fills the sequence exactly; and, where at most two more fit, with the largest that fits, if that is at least any
pair that fits, or with that and the largest that fits beside both, if every pair that fits is dominated. What no rule
settles is set aside and packed best-fit decreasing, with what the fixed sets leave.

The tokenizer's file is a parameter; special tokens' strings are ordinary text. Defined results: null and empty texts are items of size 1, as is their one row in the pipeline's last stage; rows with the same doc_id and part are different items; ties between documents of one size
go by doc_id, nulls first. An empty table gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataseek.llm.common import slices, written

CAPACITY = 2_048
#: Ranks within a size are taken in parts of about so many items by their hash, so that a size with very many documents is no single task's work.
PART_ROWS = 1 << 20


class Histogram:
    """Counts by size, with the next smaller and larger size that is left, by bisection over a bit set."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = [0] * (capacity + 1)
        self.bits = 0
        for s, c in counts.items():
            if c:
                self.n[s] = c
                self.bits |= 1 << s

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            self.bits &= ~(1 << size)

    def at_most(self, size: int) -> int:
        """The largest size left up to size, or 0."""
        return (self.bits & ((1 << (size + 1)) - 1)).bit_length() - 1 if size > 0 and self.bits & ((1 << (size + 1)) - 1) else 0

    def smallest(self, k: int) -> list[int]:
        """The k smallest items, repeated sizes counting."""
        out, bits = [], self.bits
        while bits and len(out) < k:
            low = (bits & -bits).bit_length() - 1
            out += [low] * min(self.n[low], k - len(out))
            bits &= bits - 1
        return out


@dataclass
class Plan:
    """groups: (sizes, sequences of that kind, whether the reduction fixed them), in order of the sequences' numbers."""

    groups: list[tuple[tuple[int, ...], int, bool]] = field(default_factory=list)


def dominating(h: Histogram, largest: int, capacity: int) -> tuple[int, ...] | None:
    """What to put with the item largest (already taken out of h), if a rule proves it; () for nothing, None if none does."""
    room = capacity - largest
    k = h.at_most(room)
    if not k:
        return ()
    if k == room:
        return (k,)
    low = h.smallest(3)
    if len(low) < 2 or low[0] + low[1] > room:
        return (k,)
    if len(low) == 3 and sum(low) <= room:
        return None
    beside = 0  # the largest that fits with both largest and k
    h.take(k, 1)
    beside = h.at_most(room - k)
    h.n[k] += 1
    h.bits |= 1 << k
    worst, high = 0, 0  # over the pairs that fit: the largest sum, and that of pairs whose smaller item exceeds beside
    bits = h.bits & ((1 << (room + 1)) - 1)
    while bits:
        a = (bits & -bits).bit_length() - 1
        bits &= bits - 1
        h.take(a, 1)
        b = h.at_most(room - a)
        h.n[a] += 1
        h.bits |= 1 << a
        if b >= a:
            worst = max(worst, a + b)
            if a > beside:
                high = max(high, a + b)
    if worst <= k:
        return (k,)
    if beside and high <= k:
        return (k, beside)
    return None


def reduce_sizes(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets fixed by dominance with how often, and the sizes that are left."""
    h, fixed, tried = Histogram(counts, capacity), [], 0
    while left := h.bits & ~tried:  # what no rule settled may still go with a smaller item
        j = left.bit_length() - 1
        h.take(j, 1)
        found = dominating(h, j, capacity)
        if found is None:
            h.n[j] += 1
            h.bits |= 1 << j
            tried |= 1 << j
            continue
        for s in found:
            h.take(s, 1)
        times = 1
        if len(found) <= 1 and (not found or found[0] == capacity - j):  # these two rules hold as long as the sizes last
            s = found[0] if found else 0
            more = h.n[j] // 2 if s == j else min(h.n[j], h.n[s]) if s else h.n[j]
            if more:
                h.take(j, more)
                if s:
                    h.take(s, more)
            times += more
        fixed.append(((j, *found), times))
    return fixed, {s: c for s, c in enumerate(h.n) if c}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal items go to equal sequences many at a time. The result is that of item by item."""
    rooms: dict[int, list[list]] = {}  # room left: [sizes, how many]
    bits = 0
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bits >> size
            # the least room that takes it; a sequence takes as many of this size as fit before the next one does
            room = size + (at & -at).bit_length() - 1 if at else capacity
            fit = room // size
            k, each = (left // fit, fit) if left >= fit else (1, left)
            sizes: tuple[int, ...] = ()
            if at:
                group = rooms[room][-1]
                k = min(k, group[1])
                sizes = group[0]
                group[1] -= k
                if not group[1]:
                    rooms[room].pop()
                    if not rooms[room]:
                        bits &= ~(1 << room)
            sizes, rest = (*sizes, *(size,) * each), room - size * each
            left -= k * each
            rooms.setdefault(rest, []).append([sizes, k])
            bits |= 1 << rest
    return [(tuple(s), k) for room in sorted(rooms) for s, k in rooms[room]]


def plan(counts: dict[int, int], capacity: int) -> Plan:
    fixed, left = reduce_sizes(counts, capacity)
    out = Plan()
    rest = best_fit(left, capacity)
    out.groups = [(s, k, True) for s, k in fixed] + [(s, k, False) for s, k in rest]
    return out


@dataclass
class Slots:
    """Where the items of each size go: runs of ranks with the sequence of the first, sorted by size and rank."""

    key: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    fixed: np.ndarray

    @staticmethod
    def of(plan_: Plan) -> Slots:
        taken: dict[int, int] = {}
        runs, base = [], 0
        for sizes, k, fixed in plan_.groups:
            offset = 0
            for s in sizes:
                runs.append((s, taken.get(s, 0), base, offset, fixed))
                taken[s] = taken.get(s, 0) + k
                offset += s
            base += k
        runs.sort()
        a = np.array([r[:4] for r in runs], np.int64).reshape(-1, 4)
        return Slots(a[:, 0], a[:, 1], a[:, 2], a[:, 3], np.array([r[4] for r in runs], bool))

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, fixed) of each item."""
        # a run's place in one order of (size, rank): sizes are small and ranks below 2^48
        at = np.searchsorted(self.key * (1 << 48) + self.rank, size.astype(np.int64) * (1 << 48) + rank, side="right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at], self.fixed[at]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n: a document's tokens and one for its end. path: a file of ranks, as op10 takes it; here the library that owns the format counts, as only counts are asked for."""
    import public_tokenizers

    file, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    with open(file, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in held.value.split(b"\n") if line.strip())}
        tokenizer = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            for part in slices(batch, "text"):
                n = [len(tokenizer.encode_ordinary(t)) + 1 if t else 1 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint")


def items(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, part, n_tokens: a document's tokens and one for its end, in parts of at most the capacity."""
    d = token_counts(docs, path).select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)"))).alias("part"))
    return d.select("doc_id", "part", F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("int").alias("n_tokens"))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, part, n_tokens, sequence, offset, fixed for each item: its sequence, its place there, and whether the reduction settled it."""
    spark = docs.sparkSession
    sized = written(items(docs, capacity, path), "pack-items")
    counts = {n: c for n, c in sized.groupBy("n_tokens").count().collect()}  # capacity rows at most, whatever the data
    salts = {n: -(-c // part_rows) for n, c in counts.items()}
    by_size = F.create_map(*[F.lit(x) for n, k in sorted(salts.items()) if k > 1 for x in (n, k)]) if any(k > 1 for k in salts.values()) else None
    salt = F.lit(0) if by_size is None else F.pmod(F.xxhash64("doc_id", "part"), F.coalesce(F.try_element_at(by_size, F.col("n_tokens")), F.lit(1))).cast("int")
    sized = sized.withColumn("salt", salt)
    # sizes, and one row more for each part_rows items of a size
    first: dict[tuple[int, int], int] = {(n, 0): 0 for n in counts}
    if by_size is not None:
        taken: dict[int, int] = {}
        for n, k, c in sorted(tuple(r) for r in sized.groupBy("n_tokens", "salt").count().collect()):
            first[n, k] = taken.get(n, 0)
            taken[n] = taken.get(n, 0) + c
    width = max(salts.values(), default=1)
    keys = np.array(sorted(n * width + k for n, k in first), np.int64)
    before = np.array([first[divmod(x, width)] for x in keys.tolist()], np.int64)
    held = spark.sparkContext.broadcast((keys, before, Slots.of(plan(counts, capacity))))
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "part")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, before, slots = held.value
        for b in batches:
            if not b.num_rows:
                continue
            size, salt, rank = (b.column(x).to_numpy().astype(np.int64) for x in ("n_tokens", "salt", "rank"))
            sequence, offset, fixed = slots.find(size, rank + before[np.searchsorted(keys, size * width + salt)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("n_tokens"), pa.array(sequence), pa.array(offset), pa.array(fixed)], names=["doc_id", "part", "n_tokens", "sequence", "offset", "fixed"])

    return ranked.mapInArrow(run, "doc_id bigint, part int, n_tokens int, sequence bigint, offset bigint, fixed boolean")
