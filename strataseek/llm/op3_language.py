"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum, over all ways
to cut it into pieces, of the product of theirs; a forward pass over the word's characters takes that sum. Pieces don't reach across
white space, so a text's log probability is the sum of its words', and each distinct word is scored once for a batch.
The pieces' probabilities are fitted by expectation-maximisation over the same lattices, on a bounded sample of the
documents that name their language (sample_rows); all documents and whole texts are scored.

Defined results: a text without letters (null, empty, digits only) has the language 'und' and null scores; rows that repeat get equal
results; equal scores take the language first by name; no labelled rows at all make every text 'und'. Only doc_id, text and
lang are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.llm.common import coded_words, fitted, plain_strings, sample_by_hash, slices

SAMPLE_ROWS = 2_000
ROUNDS = 3
#: What a character that is no piece costs, and what a piece that a language hasn't shown has: probabilities.
UNKNOWN, UNSEEN = 1e-6, 1e-7
#: Words held with their scores in each worker at most; beyond it a word is scored again, to the same result.
HELD_WORDS = 300_000
#: Characters of a word that are fitted together; longer words are fitted in windows, so that no probability underflows. Scoring takes words whole.
WINDOW = 63
START = "▁"


def vocabulary(model: str | None = None) -> list[str]:
    """The pieces of a SentencePiece model, without its control and byte pieces. model: its path; by default the public 32k one."""
    import sentencepiece

    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    return sorted({p.lower() for i in ids if (p := sp.id_to_piece(i)).strip(START) or p == START} | {START})


@dataclass
class Trie:
    """The pieces as a trie in sorted arrays: edges hold state * 2^21 + code point; ends holds a state's piece or -1."""

    edges: np.ndarray
    targets: np.ndarray
    ends: np.ndarray
    longest: int

    @staticmethod
    def of(pieces: list[str]) -> Trie:
        children: dict[tuple[int, int], int] = {}
        ends = [-1]
        for k, piece in enumerate(pieces):
            state = 0
            for c in map(ord, piece):
                nxt = children.get((state, c))
                if nxt is None:
                    nxt = children[state, c] = len(ends)
                    ends.append(-1)
                state = nxt
            ends[state] = k
        keys = np.array([s << 21 | c for s, c in children], np.int64)
        order = np.argsort(keys)
        return Trie(keys[order], np.array(list(children.values()), np.int64)[order], np.array(ends, np.int64), max(map(len, pieces), default=1))

    def step(self, state: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The next state, or -1."""
        key = state << 21 | point
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.targets[at], -1)


def groups(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, lengths, code points padded with 0) of words with like lengths, each with the mark of a word's start before it."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    width = np.where(size <= 64, -(-size // 4) * 4, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    for w in np.unique(width):
        idx = np.flatnonzero(width == w)
        for part in np.array_split(idx, -(-len(idx) * int(w) // 2_000_000)):
            m = np.zeros((len(part), int(w)), np.int64)
            flat = np.frombuffer("".join(START + words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32)
            m[np.arange(int(w)) < size[part][:, None]] = flat
            yield part, size[part], m


def lattice(trie: Trie, size: np.ndarray, m: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """By start position, (piece length, word rows, piece or -1): all pieces that match, and each single character."""
    out = []
    for s in range(m.shape[1]):
        rows = np.flatnonzero(size > s)
        state, here = np.zeros(len(rows), np.int64), []
        for n in range(1, trie.longest + 1):
            inside = size[rows] >= s + n
            rows, state = rows[inside], state[inside]
            if not len(rows):
                break
            state = trie.step(state, m[rows, s + n - 1])
            piece = np.where(state >= 0, trie.ends[state], -1)
            use = piece >= 0 if n > 1 else np.ones(len(rows), bool)
            if use.any():
                here.append((n, rows[use], piece[use]))
            rows, state = rows[state >= 0], state[state >= 0]
        out.append(here)
    return out


def forward(edges: list, size: np.ndarray, width: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, log scale of each word, log probability by language). p: [pieces + 1, languages], the last row that of an unknown character.
    A word's alpha is divided where it gets small, all positions ahead at once, which the log scale takes up."""
    n, k = len(size), p.shape[1]
    a, scale = np.zeros((n, width + 1, k)), np.zeros(n)
    a[:, 0] = 1
    for s, here in enumerate(edges):
        for length, rows, piece in here:
            a[rows, s + length] += a[rows, s] * p[piece]
        top = a[:, s + 1].max(1)
        low = np.flatnonzero((top < 1e-60) & (top > 0))
        if len(low):
            a[low, s + 1 :] /= top[low, None, None]
            scale[low] += np.log(top[low])
    return a, scale, np.log(np.maximum(a[np.arange(n), size], 1e-300)) + scale[:, None]


def expected_counts(trie: Trie, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How often each piece is used by each language, over all segmentations, weighted by their probabilities. No word may exceed WINDOW characters."""
    out = np.zeros_like(p)
    for part, size, m in groups(words):
        edges = lattice(trie, size, m)
        a, _, _ = forward(edges, size, m.shape[1], p)
        b = np.zeros_like(a)
        b[np.arange(len(size)), size] = 1
        for s in range(len(edges) - 1, -1, -1):
            for length, rows, piece in edges[s]:
                b[rows, s] += p[piece] * b[rows, s + length]
        weight = counts[part] / np.maximum(a[np.arange(len(size)), size], 1e-300)
        for s, here in enumerate(edges):
            for length, rows, piece in here:
                used = a[rows, s] * p[piece] * b[rows, s + length] * weight[rows]
                for j in range(p.shape[1]):
                    out[:, j] += np.bincount(piece % len(p), used[:, j], len(p))
    return out


@dataclass
class Languages:
    """Fitted piece probabilities. names: the languages, sorted; p: [pieces + 1, languages]."""

    names: list[str]
    trie: Trie
    p: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The log probability of each word in each language, summed over all segmentations."""
        out = np.zeros((len(words), len(self.names)))
        for part, size, m in groups(words):
            out[part] = forward(lattice(self.trie, size, m), size, m.shape[1], self.p)[2]
        return out


def fit(texts: list[str], langs: list[str], pieces: list[str], rounds: int = ROUNDS) -> Languages:
    names = sorted(set(langs))
    trie = Trie.of(pieces)
    ends, codes, words = coded_words(pa.array(texts, pa.large_string()))
    lang = np.repeat(np.array([names.index(x) for x in langs], np.int64), np.diff(ends))
    counts = np.zeros((len(words), len(names)))
    np.add.at(counts, (codes, lang), 1)
    p = np.full((len(pieces) + 1, len(names)), 1 / (len(pieces) + 1))
    p[-1] = UNKNOWN
    # a word of more than WINDOW characters, as a sentence in a script without spaces, is counted window by window
    text, of = [], []
    for k, word in enumerate(words.to_pylist()):
        for s in range(0, max(1, len(word)), WINDOW):
            text.append(word[s : s + WINDOW])
            of.append(k)
    counts = counts[np.array(of, np.int64)] if of else counts
    for _ in range(rounds):
        c = expected_counts(trie, text, counts, p)
        c[-1] = 0
        p = np.maximum(c / np.maximum(c.sum(0), 1), UNSEEN)
        p[-1] = UNKNOWN
    return Languages(names, trie, p)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, model: str | None = None, rounds: int = ROUNDS) -> Languages:
    """Fit on at most about sample_rows documents that name their language, chosen by the hash of their doc_id."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", "text")
    pieces = vocabulary(model)

    def fit_rows(table: pa.Table) -> tuple:
        table = table.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
        found = fit(table["text"].to_pylist(), table["lang"].to_pylist(), pieces, rounds)
        return found.names, found.p

    names, p = fitted(sample_by_hash(known, sample_rows), fit_rows)
    return Languages(names, Trie.of(pieces), p)


class Scorer:
    """Scores batches and holds the words it has met."""

    def __init__(self, model: Languages):
        self.model, self.held, self.scores = model, pa.array([], pa.large_string()), np.zeros((0, len(model.names)))

    def words(self, words: pa.Array) -> np.ndarray:
        at = pc.fill_null(pc.index_in(words, value_set=self.held), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros((len(words), len(self.model.names)))
        out[at >= 0] = self.scores[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = words.take(pa.array(new))
            out[new] = self.model.word_scores(fresh.to_pylist())
            if len(self.held) + len(new) <= HELD_WORDS:
                self.held = pa.concat_arrays([self.held, fresh])
                self.scores = np.concatenate([self.scores, out[new]])
        return out

    def __call__(self, texts: pa.Array, declared: list[str | None]) -> tuple:
        """lang, score for each character, lead over the next language, the share of words that the declared language explains better than all others, and its own
        score for each character less the best one (null if the model lacks it), the best score for each character over words without a digit, and how many characters those have."""
        names, n = self.model.names, len(texts)
        ends, codes, words = coded_words(texts)
        letters = pc.match_substring_regex(words, r"\pL").to_numpy(zero_copy_only=False).astype(bool)
        keep = letters[codes] if len(codes) else np.zeros(0, bool)
        ends = np.concatenate(([0], np.cumsum(keep)))[ends]
        codes = codes[keep]
        if not names:
            return ["und"] * n, *([None] * n for _ in range(6))
        by_word = np.zeros((len(words), len(names)))
        by_word[letters] = self.words(words.filter(pa.array(letters)))
        sums = np.concatenate((np.zeros((1, len(names))), np.cumsum(by_word[codes], 0)))
        total = sums[ends[1:]] - sums[ends[:-1]]
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        chars = np.concatenate(([0], np.cumsum(sizes[codes])))
        chars = chars[ends[1:]] - chars[ends[:-1]]
        bare = ~pc.match_substring_regex(words, r"\d").to_numpy(zero_copy_only=False).astype(bool)  # keys, dates and the like are no language's
        sums = np.concatenate((np.zeros((1, len(names))), np.cumsum((by_word * bare[:, None])[codes], 0)))
        plain = (sums[ends[1:]] - sums[ends[:-1]]).max(1)
        spelt = np.concatenate(([0], np.cumsum((sizes * bare)[codes])))
        spelt = spelt[ends[1:]] - spelt[ends[:-1]]
        best = total.argmax(1)
        ordered = np.sort(total, 1)
        lead = ordered[:, -1] - ordered[:, -2] if len(names) > 1 else np.full(n, np.inf)
        top = np.sort(by_word, 1)[:, -2:]
        agrees = by_word >= top[:, -1:] - 1e-9
        if len(names) > 1:
            agrees &= (top[:, 1] - top[:, 0] > 1e-9)[:, None]  # a tie, as of a word that no language knows, speaks for none
        cum = np.concatenate((np.zeros((1, len(names))), np.cumsum(agrees[codes], 0)))
        share = (cum[ends[1:]] - cum[ends[:-1]]) / np.maximum(np.diff(ends), 1)[:, None]
        lang, score, ahead, own, behind, known = [], [], [], [], [], []
        for i in range(n):
            some = chars[i] > 0
            lang.append(names[best[i]] if some else "und")
            score.append(float(total[i, best[i]] / chars[i]) if some else None)
            ahead.append(float(lead[i]) if some else None)
            claim = names.index(declared[i]) if some and declared[i] in names else None
            own.append(None if claim is None else float(share[i, claim]))
            behind.append(None if claim is None else float((total[i, claim] - total[i, best[i]]) / chars[i]))
            known.append(float(plain[i] / spelt[i]) if spelt[i] else None)
        return lang, score, ahead, own, behind, known, spelt.tolist()


EXTRA = "language string, score double, lead double, own_share double, behind double, plain double, n_plain double"


def scored(docs: DataFrame, model: Languages, keep: list[str]) -> DataFrame:
    """The columns keep, which must include text and lang, with EXTRA."""
    given = docs.select(*keep)
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is the vocabulary's, times the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            for part in slices(batch, "text"):
                lang, score, *rest = scorer(plain_strings(part.column("text")), part.column("lang").to_pylist())
                extra = [pa.array(lang, pa.string()), *(pa.array(x, pa.float64()) for x in (score, *rest))]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, "language", "score", "lead", "own_share", "behind", "plain", "n_plain"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema), EXTRA])
    return given.mapInArrow(run, schema)


def language_id(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, model: str | None = None) -> DataFrame:
    """doc_id, declared (lang as given), language, score (log probability for each character), lead over the next language, own_share."""
    out = scored(docs, train(docs, sample_rows, model), ["doc_id", "text", "lang"])
    return out.select("doc_id", F.col("lang").alias("declared"), "language", "score", "lead", "own_share")
