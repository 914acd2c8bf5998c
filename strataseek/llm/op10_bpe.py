"""Byte-pair encoding and decoding by speculation and verification.

A text is cut into words by the tokenizer's public pattern, on arrays of character classes. Each distinct word gets the greedy longest-match tokens as a guess. A token
sequence is the tokenizer's own if and only if each adjacent pair is: merging the two tokens' bytes alone gives back the two. So all adjacent
pairs of all guesses are tested at once, by undoing the merges of both tokens towards their border and looking for one that would have come first.
Words with a failing pair (or with a token that merging doesn't reach) are merged exactly, in rank order; the rest are proven right as they are.
Decoding gathers the tokens' bytes.

The tokenizer is fixed and public; its path is a parameter. Special tokens' strings are ordinary text.
Defined results: a null text has null tokens; an empty text none; rows that repeat give equal results. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.llm.common import ragged, slices

HELD_WORDS = 200_000
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
SUFFIXES = ("ll", "ve", "re", "s", "d", "m", "t")


@functools.cache
def classes() -> np.ndarray:
    """The pattern's class of every code point: letter, number, white space or other."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a + 1 == len(m[0]):
                out[a : b + 1] = value
            else:  # a run across the surrogates' gap
                out[list(map(ord, m[0]))] = value
    return out


def word_starts(points: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether a word of the pattern starts at each code point. first: whether a text starts there."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    c = table[points]
    same = np.concatenate(([False], c[1:] == c[:-1])) & ~first
    start = ~same
    space = c == SPACE
    last = np.concatenate((first[1:], [True]))  # a text ends after this point
    following = np.concatenate((~space[1:], [False])) & ~last  # something else than white space follows in the text
    tail = space & following  # the last of a run of white space before a word
    run_start = start.copy()
    start |= tail  # it is no part of the run before it
    plain = tail & (points == 32)
    # a plain space belongs to the word after it
    start[np.flatnonzero(plain) + 1] = False
    # contractions: an apostrophe that starts a word and isn't after a plain space, with its suffix
    quotes = np.flatnonzero((points == 39) & run_start & ~np.concatenate(([False], plain[:-1])))
    for q in quotes.tolist():
        if not start[q]:
            continue
        stop = q + 1
        while stop < min(n, q + 3) and not first[stop]:
            stop += 1
        text = "".join(map(chr, points[q + 1 : stop].tolist()))
        for s in SUFFIXES:
            if text.startswith(s):
                e = q + 1 + len(s)
                start[q + 1 : e] = False
                if e < n:
                    start[e] = True if not (space[e] and not tail[e] and not run_start[e]) else start[e]
                break
    return start


def words_of(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts, one after the other, as binary, and how many each text has."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    starts = lead[word_starts(points, first[:-1][lead], table)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    bounds = np.searchsorted(starts, offsets)
    return np.diff(bounds), words


class Bpe:
    """A byte-level tokenizer from a file of ranks (lines of base64 and rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for b, r in ranks.items():
            self.bytes[r] = b
        self.longest = max(map(len, ranks))
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.sound = np.zeros(self.size, bool)  # merging a token's bytes gives the token
        pairs: dict[int, int] = {}
        for b, r in ranks.items():
            if len(b) == 1:
                self.left[r] = self.right[r] = r
                self.sound[r] = True
                continue
            parts = self.merge(b, r)
            if len(parts) == 2:
                self.left[r], self.right[r] = parts
                pairs[parts[0] << 32 | parts[1]] = r
                self.sound[r] = True
        keys = np.array(list(pairs), np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(pairs.values()), np.int64)[order]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(self.bytes), np.uint8)

    def merge(self, word: bytes, below: int | None = None) -> list[int]:
        """The tokens of a word by merging in rank order, using ranks under below alone."""
        limit, n = below if below is not None else self.size, len(word)
        ranks = self.ranks
        if n > 64:
            return self._merge_long(word, limit)
        parts = [word[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = limit, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], limit)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, word: bytes, limit: int) -> list[int]:
        """The same with a heap of possible merges: n log n for long words."""
        n, ranks = len(word), self.ranks
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                r = ranks.get(word[i : end[j]])
                if r is not None and r < limit:
                    heapq.heappush(heap, (r, i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = after[i]
        return out

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, ranks, longest = [], 0, len(word), self.ranks, self.longest
        while i < n:
            for e in range(min(n, i + longest), i, -1):
                r = ranks.get(word[i:e])
                if r is not None:
                    out.append(r)
                    i = e
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of tokens a[i] and b[i] gives back these two."""
        ok = np.ones(len(a), bool)
        idx, t1, t2, limit = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64), np.full(len(a), np.iinfo(np.int64).max)
        while len(idx):
            key = t1 << 32 | t2
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit)
            ok[idx[clash]] = False
            # undo the later of the two merges that made t1 and t2; single bytes have none left
            single1, single2 = self.left[t1] == t1, self.left[t2] == t2
            undo1 = ~single1 & (single2 | (t1 > t2))
            undo2 = ~single2 & ~undo1
            limit = np.where(undo1, t1, np.where(undo2, t2 + 1, limit))
            n1, n2 = np.where(undo1, self.right[t1], t1), np.where(undo2, self.left[t2], t2)
            go = ~clash & (undo1 | undo2)
            idx, t1, t2, limit = idx[go], n1[go], n2[go], limit[go]
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """(tokens of all words, how many each has, words that needed exact merging)."""
        guess = [[r] if (r := self.ranks.get(w)) is not None else self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        bad = np.zeros(len(words), bool)
        bad[word[~self.sound[flat]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        if len(inner):
            codes, of = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
            bad[word[inner[~self.compatible(codes >> 32, codes & 0xFFFFFFFF)[of]]]] = True
        # a word that is a token stands as that token, as the tokenizer looks whole words up first
        bad &= ~np.fromiter((w in self.ranks for w in words), bool, len(words))
        wrong = np.flatnonzero(bad)
        if len(wrong):
            for i in wrong.tolist():
                guess[i] = self.merge(words[i])
            sizes = np.fromiter(map(len, guess), np.int64, len(guess))
            flat = np.fromiter((t for g in guess for t in g), np.int64, int(sizes.sum()))
        return flat, sizes, len(wrong)

    def decode(self, tokens: np.ndarray) -> bytes:
        t = np.asarray(tokens, np.int64)
        return self.data[ragged(self.starts[t], self.lengths[t])].tobytes()


class Encoder:
    """Encodes batches and holds the tokens of words it has met."""

    def __init__(self, bpe: Bpe, table: np.ndarray):
        self.bpe, self.table = bpe, table
        self.clear()

    def clear(self) -> None:
        self.held = pa.array([], pa.large_binary())
        self.tokens, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of all texts, how many each has, whether decoding gives each text back)."""
        per_text, words = words_of(texts, self.table)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.held) > HELD_WORDS:
            self.clear()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.held), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = coded.dictionary.take(pa.array(new))
            flat, sizes, _ = self.bpe.encode_words(fresh.to_pylist())
            at[new] = len(self.held) + np.arange(len(new))
            self.held = pa.concat_arrays([self.held, fresh])
            self.starts = np.concatenate([self.starts, len(self.tokens) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.tokens = np.concatenate([self.tokens, flat.astype(np.int32)])
        word = at[codes] if len(codes) else codes
        sizes = self.sizes[word]
        tokens = self.tokens[ragged(self.starts[word], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(per_text)))]
        buffers = words.buffers()
        same = np.ones(len(texts), bool)
        if self.bpe.decode(tokens) != (buffers[2].to_pybytes() if len(words) else b""):
            same = np.array([self.bpe.decode(tokens[s:e]) == x.as_py().encode() for s, e, x in zip(ends[:-1], ends[1:], texts)], bool)
        return tokens, np.diff(ends), same


@functools.cache
def tokenizer(path: str) -> Bpe:
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, tokens, round_trip (whether the tokens decode to the text) of every document."""
    held = docs.sparkSession.sparkContext.broadcast((tokenizer(path or default_path()), classes()))  # the vocabulary, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*held.value)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.large_string())
                null = texts.is_null()
                tokens, sizes, ok = encoder(pc.fill_null(texts, ""))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(tokens, pa.int32()))
                none = pa.scalar(None, lists.type)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pc.if_else(null, pa.scalar(None, pa.int32()), pa.array(sizes, pa.int32())), pc.if_else(null, none, lists) if null.true_count else lists, pc.if_else(null, pa.scalar(None, pa.bool_()), pa.array(ok))], names=["doc_id", "n_tokens", "tokens", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens int, tokens array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, tokens; null tokens give a null text; an ID beyond the vocabulary raises."""
    held = encoded.sparkSession.sparkContext.broadcast(tokenizer(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held.value
        for batch in batches:
            texts = [None if t is None else bpe.decode(np.array(t, np.int64)).decode("utf-8", "replace") for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "tokens").mapInArrow(run, "doc_id bigint, text string")
