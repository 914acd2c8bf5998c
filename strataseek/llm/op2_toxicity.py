"""Toxicity by classifier chains.

The categories are predicted one after the other: two kinds of toxic documents, then toxic, the label itself. Each model is linear in the words and
beginnings of words a document holds (once, twice) and the probabilities of the categories before it; those, at training, are out-of-fold
predictions, so that a later model learns how far to trust an earlier one on text that one hasn't seen. The given labels
name one category only. The two kinds are derived from the sample, without any word list: its toxic documents are cut in two by 2-means on
the features that tell most about the label, so they are whatever two vocabularies toxic documents have, and the larger comes first.

The chain is fitted on a bounded sample of the labelled rows (sample_rows); all documents and whole texts are scored.

Defined results: a null or empty text has no words and gets the intercepts' probabilities; rows that repeat get equal
scores; label rows with a null are left out; labels without both classes give a model that predicts their share; with
no labels at all nothing is toxic (probability 0). Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.llm.common import coded_words, fitted, plain_strings, sample_by_hash, slices

CATEGORIES = ("kind_1", "kind_2", "toxic")
SAMPLE_ROWS = 8_000
#: Features of a model, at most; each is in LEAST_ROWS rows of the sample at least and in MOST_SHARE of them at most. Those about which the kinds are formed.
FEATURES, LEAST_ROWS, MOST_SHARE, KIND_FEATURES = 1_024, 3, 0.9, 64
FOLDS = 3
PREFIXES = (4, 5, 6, 7)
TWICE = "#2"
THRESHOLD = 0.5
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "¡¿«»“”‘’…–—"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words without punctuation at their edges."""
    ends, codes, words = coded_words(texts)
    again = pc.utf8_trim(words, EDGES).dictionary_encode()
    return ends, again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(words) else codes, again.dictionary


def features_of(words: pa.Array) -> list[pa.Array]:
    """What each word may be known by: itself, and its beginnings of PREFIXES letters where it goes on after them (null else)."""
    out = [words]
    for k in PREFIXES:
        goes_on = pc.greater(pc.utf8_length(words), k)
        head = pc.binary_join_element_wise(pa.scalar("^", words.type), pc.utf8_slice_codeunits(words, 0, k), pa.scalar("", words.type))
        out.append(pc.if_else(goes_on, head, pa.scalar(None, words.type)))
    return out


def presence(texts: pa.Array, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) for each of the named features that a text has, once each. A name that ends in TWICE asks for two occurrences."""
    number = {name: i for i, name in enumerate(names)}
    base = sorted({name.removesuffix(TWICE) for name in names})
    once = np.array([number.get(b, -1) for b in base] or [-1])
    twice = np.array([number.get(b + TWICE, -1) for b in base] or [-1])
    ends, codes, words = words_of(texts)
    row, width, known = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), max(1, len(base)), pa.array(base, words.type)
    pairs = []
    for forms in features_of(words):
        at = pc.fill_null(pc.index_in(forms, value_set=known, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        feature = at[codes] if len(codes) else codes
        hit = feature >= 0
        pairs.append(row[hit] * width + feature[hit])
    pairs, times = np.unique(np.concatenate(pairs), return_counts=True)
    more = pairs[times > 1]
    row = np.concatenate([pairs // width, more // width])
    feature = np.concatenate([once[pairs % width], twice[more % width]])
    return row[feature >= 0], feature[feature >= 0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


def fit_linear(row: np.ndarray, feature: np.ndarray, n: int, scale: np.ndarray, dense: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Logistic regression by Adam over all rows: weights of the features, then of the dense columns, then the intercept.

    scale: a feature's value where it is present; what tells more about the label counts more, so that few strong features
    win over many weak ones. The weights returned are for a value of 1.
    """
    width = len(scale)
    w = np.zeros(width + dense.shape[1] + 1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if n else 1e-6
    w[-1] = logit(np.array(share))
    if n == 0 or y.min() == y.max():
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weight = np.sqrt(weight)  # between plain and balanced
    weight /= weight.sum()
    for t in range(1, steps + 1):
        margin = np.bincount(row, (w[:width] * scale)[feature], n) + dense @ w[width:-1] + w[-1]
        g = (sigmoid(margin) - y) * weight
        grad = np.concatenate([scale * np.bincount(feature, g[row], width), dense.T @ g, [g.sum()]])
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    w[:width] *= scale
    return w


def two_kinds(row: np.ndarray, feature: np.ndarray, n: int, scale: np.ndarray, y: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Whether each row is nearer to the first of two centres of the toxic rows, by 2-means on their KIND_FEATURES strongest features, begun with those that have the strongest one and the rest."""
    strong = np.argsort(-scale, kind="stable")[:KIND_FEATURES]
    number = np.full(len(scale) + 1, -1)
    number[strong] = np.arange(len(strong))
    use = number[feature] >= 0 if len(feature) else np.zeros(0, bool)
    x = np.zeros((n, max(1, len(strong))))
    x[row[use], number[feature[use]]] = 1
    toxic, first = y > 0, x[:, 0] > 0
    for _ in range(rounds):
        if not (toxic & first).any() or not (toxic & ~first).any():
            break
        a, b = x[toxic & first].mean(0), x[toxic & ~first].mean(0)
        after = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
        if (after == first).all():
            break
        first = after
    return first if (toxic & first).sum() * 2 >= toxic.sum() else ~first


@dataclass
class Chain:
    """A fitted chain. words: the features, a beginning marked by ^, two occurrences by TWICE; weights: for each category its words', earlier probabilities' and intercept's weights."""

    words: list[str]
    weights: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        n, width = len(texts), len(self.words)
        row, feature = presence(texts, self.words)
        earlier, out = np.zeros((n, 0)), []
        for w in self.weights:
            z = (np.bincount(row, w[feature], n) if len(row) else np.zeros(n)) + earlier @ w[width:-1] + w[-1]
            out.append(sigmoid(z))
            earlier = np.column_stack([earlier, out[-1]])
        return np.column_stack(out) if out else np.zeros((n, len(CATEGORIES)))


def fit_chain(texts: list[str] | pa.Array, toxic: np.ndarray, features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """A chain from labelled texts. Features: the words whose presence tells most about the label, by signed root of the chi square."""
    column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
    y = np.asarray(toxic, np.float64)
    n = len(y)
    if not n:
        return Chain([])
    ends, codes, words = words_of(column)
    codes, row = codes.astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), np.diff(ends))
    candidates: list[tuple[str, float, np.ndarray]] = []
    for names in features_of(words):
        coded = names.dictionary_encode()
        place = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int32)[codes] if len(codes) else codes
        here, many = place >= 0, max(1, len(coded.dictionary))
        pairs = row[here].astype(np.int64)
        pairs *= many
        pairs += place[here]
        pairs.sort()
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
        times, pairs = np.diff(np.append(first, len(pairs))), pairs[first]
        for own, mark in ((pairs, ""), (pairs[times > 1], TWICE)):
            r, f = (own // many).astype(np.int32), (own % many).astype(np.int32)
            seen, with_label = np.bincount(f, minlength=many), np.bincount(f, y[r], many)
            expected = seen * y.mean()
            z = np.abs(with_label - expected) / np.sqrt(np.maximum(expected * (1 - y.mean()), 1e-9))
            z[(seen < LEAST_ROWS) | (seen > MOST_SHARE * n)] = 0
            best = np.flatnonzero(z > 2)
            best = best[np.argsort(-z[best], kind="stable")][:features]
            order = np.argsort(f, kind="stable")
            lo, hi = np.searchsorted(f[order], best), np.searchsorted(f[order], best, side="right")
            candidates += [(coded.dictionary[int(i)].as_py() + mark, -float(z[i]), r[order[s:e]]) for i, s, e in zip(best, lo, hi)]
    candidates.sort(key=lambda c: (c[1], c[0]))
    candidates = candidates[:features]
    chosen, scale = [c[0] for c in candidates], np.array([-c[1] / 10 for c in candidates])
    row = np.concatenate([c[2] for c in candidates]) if candidates else np.zeros(0, np.int64)
    feature = np.repeat(np.arange(len(candidates)), [len(c[2]) for c in candidates])
    chain, width, earlier = Chain(chosen), len(chosen), np.zeros((n, 0))
    fold = np.random.Generator(np.random.PCG64(2)).permutation(n) % folds  # no pattern in the order of rows can empty a fold of a class
    first = two_kinds(row, feature, n, scale, y)
    for k in CATEGORIES:
        target = {"kind_1": y * first, "kind_2": y * ~first}.get(k, y)
        out_of_fold = np.zeros(n)
        for f in range(folds):
            use, held = fold != f, fold == f
            renamed = np.cumsum(use) - 1
            w = fit_linear(renamed[row[use[row]]], feature[use[row]], int(use.sum()), scale, earlier[use], target[use])
            z = np.bincount(row, w[feature], n) + earlier @ w[width:-1] + w[-1]
            out_of_fold[held] = sigmoid(z[held])
        chain.weights.append(fit_linear(row, feature, n, scale, earlier, target))
        earlier = np.column_stack([earlier, out_of_fold])
    return chain


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fit on at most about sample_rows labelled documents, chosen by the hash of their doc_id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("_y"))
    some = F.broadcast(sample_by_hash(known, sample_rows))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(some, "doc_id").select("doc_id", "text", F.col("_y").cast("bigint").alias("y"))

    def fit(table: pa.Table) -> tuple:
        table = table.sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
        texts, y = table["text"].combine_chunks(), table["y"].to_numpy()
        chain = fit_chain(texts, y)
        return chain.words, chain.weights

    return Chain(*fitted(rows, fit))


def scored(docs: DataFrame, chain: Chain, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns keep, which must include text, with a probability of each category and whether the document is toxic."""
    given = docs.select(*keep)
    held = docs.sparkSession.sparkContext.broadcast(chain)  # its size is that of FEATURES words, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                p = chain.probabilities(plain_strings(part.column("text")))
                extra = [pa.array(p[:, i]) for i in range(len(CATEGORIES))]
                yield pa.RecordBatch.from_arrays([*(c for name, c in zip(part.schema.names, part.columns) if name != "text" or "text" in keep), *extra, pa.array(p[:, -1] >= threshold)], names=[*part.schema.names, *(f"p_{k}" for k in CATEGORIES), "is_toxic"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema), *(f"p_{k} double" for k in CATEGORIES), "is_toxic boolean"])
    return given.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_kind_1, p_kind_2, p_toxic and is_toxic of every document."""
    chain = train(docs, labels, sample_rows)
    return scored(docs, chain, ["doc_id", "text"], threshold).drop("text")
