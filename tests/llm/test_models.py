"""Brute-force versions, exact round trips and held-out accuracy for the operators that SQL can't express."""

import base64
import itertools
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strataseek.llm import op2_toxicity, op3_language, op4_ppm, op5_packing, op10_bpe

SF = "/root/testdata/sf0.01"


def rows(sql):
    return duckdb.connect().execute(sql).fetchall()


# toxicity and language ID: held-out accuracy


def test_toxicity_held_out():
    data = rows(f"SELECT text, toxic FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) ORDER BY doc_id LIMIT 3000")
    train, held = data[:2200], data[2200:]
    chain = op2_toxicity.fit_chain([t for t, _ in train], np.array([y for _, y in train]))
    got = chain.probabilities(pa.array([t for t, _ in held], pa.large_string()))[:, -1] >= op2_toxicity.THRESHOLD
    y = np.array([y for _, y in held], bool)
    assert got[y].mean() >= 0.9
    assert got[~y].mean() <= 0.01
    assert len(chain.weights[2]) == len(chain.words) + 3  # the last model sees both earlier logits
    assert chain.weights[2][-3] != 0


def naive_forms(text):
    """Features of a text and how often each occurs, one word at a time."""
    out = Counter()
    for w in text.lower().split():
        w = w.strip(op2_toxicity.EDGES)
        out.update([w, *("^" + w[:k] for k in op2_toxicity.PREFIXES if len(w) > k)])
    return out


def test_toxicity_chain_equals_one_text_at_a_time():
    data = rows(f"SELECT text, toxic FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) ORDER BY doc_id")
    texts, y = [t for t, _ in data], np.array([y for _, y in data], float)
    chain = op2_toxicity.fit_chain(texts, y, features=200)
    got = chain.probabilities(pa.array(texts, pa.large_string()))
    assert len(chain.words) == 200 and got.shape == (len(texts), 3)
    for i, t in enumerate(texts):
        forms, earlier = naive_forms(t), []
        for k, w in enumerate(chain.weights):
            z = w[-1] + sum(x for name, x in zip(chain.words, w) if forms[name.removesuffix(op2_toxicity.TWICE)] > name.endswith(op2_toxicity.TWICE))
            z += sum(p * x for p, x in zip(earlier, w[len(chain.words) : -1]))
            earlier.append(1 / (1 + math.exp(-z)))
        assert np.allclose(earlier, got[i], atol=1e-9)


def test_toxicity_chain_is_fitted_on_out_of_fold_probabilities(monkeypatch):
    seen = []
    fit = op2_toxicity.fit_linear
    monkeypatch.setattr(op2_toxicity, "fit_linear", lambda row, feature, n, scale, dense, y: (seen.append((n, dense.copy(), y.copy(), row, feature)), fit(row, feature, n, scale, dense, y))[1])
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["oak", "elm", "ash", "fir"]) for _ in range(6)) + (" vile rat" if i % 4 == 0 else " foul pig" if i % 6 == 0 else "") for i in range(300)]
    y = np.array([float("vile" in t or "foul" in t) for t in texts])
    op2_toxicity.fit_chain(texts, y)
    folds = op2_toxicity.FOLDS
    assert len(seen) == 3 * (folds + 1)
    whole = [seen[i] for i in range(folds, len(seen), folds + 1)]
    assert [d.shape[1] for _, d, *_ in whole] == [0, 1, 2] and all(n == 300 for n, *_ in whole)
    assert ((whole[2][1] > 0) & (whole[2][1] < 1)).all()  # probabilities
    # each out-of-fold column is what models of the other folds say of the rows they were not fitted on
    fold = np.random.Generator(np.random.PCG64(2)).permutation(300) % folds
    _, _, first, row, feature = whole[0]
    scale_seen = []
    monkeypatch.setattr(op2_toxicity, "fit_linear", lambda row, feature, n, scale, dense, y: (scale_seen.append(scale), fit(row, feature, n, scale, dense, y))[1])
    op2_toxicity.fit_chain(texts, y)
    for f in range(folds):
        use = fold != f
        w = fit((np.cumsum(use) - 1)[row[use[row]]], feature[use[row]], int(use.sum()), scale_seen[0], np.zeros((int(use.sum()), 0)), first[use])
        z = np.bincount(row, w[feature], 300) + w[-1]
        assert np.allclose(1 / (1 + np.exp(-z[~use])), whole[1][1][~use, 0])
    # the two kinds are the two vocabularies, without any list of words
    kinds = whole[0][2]
    assert {("vile" in t, k) for t, k, v in zip(texts, kinds, y) if v} in ({(True, 1.0), (False, 0.0)}, {(True, 0.0), (False, 1.0)})
    assert (kinds + whole[1][2] == y).all()


def test_toxicity_degenerate():
    empty = op2_toxicity.fit_chain([], np.zeros(0))
    assert empty.probabilities(pa.array(["a"], pa.large_string())).tolist() == [[0, 0, 0]]
    one = op2_toxicity.fit_chain(["a b", "c d"], np.zeros(2))
    assert (one.probabilities(pa.array(["a", ""], pa.large_string())) < 0.01).all()


@pytest.fixture(scope="module")
def languages():
    data = rows(f"SELECT text, lang FROM '{SF}/documents.parquet' WHERE doc_id % 2 = 0 ORDER BY doc_id")
    return op3_language.fit([t for t, _ in data], [x for _, x in data], op3_language.vocabulary())


def test_language_held_out(languages):
    data = rows(f"SELECT text, lang FROM '{SF}/documents.parquet' WHERE doc_id % 2 = 1")
    lang, *_ = op3_language.Scorer(languages)(pa.array([t for t, _ in data], pa.large_string()), [x for _, x in data])
    assert np.mean([a == b for a, (_, b) in zip(lang, data)]) >= 0.95


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_language_fit_equals_brute_force():
    pieces = sorted(["▁", "a", "b", "ab", "▁a", "ba", "aba"])
    texts, langs = ["ab ab ba", "aba b", "bab ab", "ca bb"], ["x", "x", "y", "y"]
    got = op3_language.fit(texts, langs, pieces, rounds=2)
    p = {(w, la): 1 / (len(pieces) + 1) for w in pieces for la in "xy"}
    for _ in range(2):
        c = Counter()
        for t, la in zip(texts, langs):
            for w in t.split():
                ways = list(segmentations(op3_language.START + w, pieces))
                weights = [math.prod(p.get((x, la), op3_language.UNKNOWN) for x in way) for way in ways]
                for way, v in zip(ways, weights):
                    for x in way:
                        if x in pieces:
                            c[x, la] += v / sum(weights)
        p = {(w, la): max(c[w, la] / sum(c[v, la] for v in pieces), op3_language.UNSEEN) for w in pieces for la in "xy"}
    for i, w in enumerate(pieces):
        assert np.allclose(got.p[i], [p[w, "x"], p[w, "y"]], rtol=1e-6)
    # whole texts: the best language's score for each character, its lead
    lang, score, lead, *_ = op3_language.Scorer(got)(pa.array(["ab aba ab"], pa.large_string()), ["x"])
    logs = [sum(math.log(sum(math.prod(p.get((x, la), op3_language.UNKNOWN) for x in way) for way in segmentations(op3_language.START + w, pieces))) for w in "ab aba ab".split()) for la in "xy"]
    assert lang == ["xy"[logs[1] > logs[0]]] and math.isclose(score[0], max(logs) / 10, rel_tol=1e-6) and math.isclose(lead[0], abs(logs[0] - logs[1]), rel_tol=1e-6)


def test_language_without_spaces_is_fitted():
    rng = random.Random(2)
    say = lambda signs: "".join(rng.choice(signs) for _ in range(400))
    model = op3_language.fit([say("あいうえお") for _ in range(9)] + [say("かきくけこ") for _ in range(9)], ["aa"] * 9 + ["kk"] * 9, [op3_language.START, *"あいうえおかきくけこ"])
    assert op3_language.Scorer(model)(pa.array([say("あいうえお"), say("かきくけこ")], pa.large_string()), [None, None])[0] == ["aa", "kk"]
    assert op3_language.fit(["a" * 63, "a" * 64, "a" * 200], ["x"] * 3, ["▁", "a"]).p[1, 0] > 0.9


def test_language_forward_is_the_sum_over_all_segmentations(languages):
    pieces = {p: i for i, p in enumerate(op3_language.vocabulary())}
    for word in ("the", "über", "añejo", "zzqx", "☃a"):
        chars, total = op3_language.START + word, np.zeros(len(languages.names))
        for cuts in itertools.product([0, 1], repeat=len(chars) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(chars[last:i])
                    last = i
            parts.append(chars[last:])
            if all(p in pieces or len(p) == 1 for p in parts):
                total += np.prod([languages.p[pieces.get(p, -1)] for p in parts], axis=0)
        assert np.allclose(languages.word_scores([word])[0], np.log(total))


def test_language_long_word_doesnt_underflow(languages):
    s = languages.word_scores(["the" * 3000, "the"])
    assert np.isfinite(s).all() and (s[0] < -1000).all() and (s[0] > -1e5).all()


def test_language_without_letters(languages):
    assert op3_language.Scorer(languages)(pa.array(["", "123 %%", "the of and"], pa.large_string()), [None, "en", "en"])[0] == ["und", "und", "en"]


# PPM


def test_ppm_prices_equal_the_trie():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 60))) for _ in range(12)]
    order = 3
    learnt, coded = texts[:6], texts[6:]
    trie = op4_ppm.PpmTrie(order)
    for t in learnt:
        data = bytes(order) + t.encode()
        for i in range(order, len(data)):
            trie.learn(data[i - order : i], data[i])
    g0, _ = op4_ppm.grams(pa.array(coded), order)
    g1, _ = op4_ppm.grams(pa.array(learnt), order)
    every = np.unique(np.concatenate([g0, g1]))
    n0, n1 = (np.array([Counter(g.tolist())[x] for x in every.tolist()]) for g in (g0, g1))
    low = np.zeros((256, 256, 2))
    for g, a, b in zip(every.tolist(), n0, n1):
        low[(g >> 8) & 255, g & 255] += (a, b)
    low = {1: low, 0: low.sum(0)}
    price = np.zeros(len(every))
    context = (every >> np.uint64(8)) & np.uint64(0xFFFF)
    for c in np.unique(context):
        price[context == c] = op4_ppm.prices(every[context == c], n1[context == c], low, order, 0)
    assert np.allclose(price, op4_ppm.prices(every, n1, low, order, 0))  # contexts don't mix
    by_gram = dict(zip(every.tolist(), price))
    table = op4_ppm.Prices(every, price.astype(np.float32))
    for t in coded:
        g, _ = op4_ppm.grams(pa.array([t]), order)
        assert math.isclose(sum(by_gram[x] for x in g.tolist()), trie.code_length(t, adapt=False), abs_tol=1e-6)
        assert np.allclose(table.of(g), [by_gram[x] for x in g.tolist()], atol=1e-4)


def test_ppm_adaptive_is_a_probability():
    trie = op4_ppm.PpmTrie(2)
    trie.code_length("abracadabra abracadabra")
    for context in (b"ab", b"zz", b"a ", b"\0\0"):
        assert math.isclose(sum(2 ** -trie.bits(context, s) for s in range(256)), 1, rel_tol=1e-9)


def test_ppm_dense_levels_and_search_agree(monkeypatch):
    rng = np.random.default_rng(4)
    every = np.unique(rng.integers(0, 2**24, 3_000).astype(np.uint64))
    bits = rng.random(len(every)).astype(np.float32)
    asked = np.concatenate([every[::3], rng.integers(0, 2**24, 500).astype(np.uint64)])
    dense = op4_ppm.Prices(every, bits)
    monkeypatch.setattr(op4_ppm, "MAX_ROWS", 10)
    searched = op4_ppm.Prices(every, bits)
    assert dense.levels is not None and searched.levels is None
    assert np.array_equal(dense.of(asked), searched.of(asked))


@pytest.mark.parametrize("slice_bytes", [20, 1 << 20])
def test_ppm_by_broadcast_and_by_slices(spark, slice_bytes):
    data = [(i, t) for i, t in enumerate(["long " * 9_000, "one text", None, "", "é ñ", "one text"] * 2)] + [(None, "no id"), (3, "another text"), (3, "another text")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    one = sorted(map(str, op4_ppm.code_lengths(df, 4).collect()))
    assert len(one) == len(data) and sorted(map(str, op4_ppm.code_lengths(df, 4, max_rows=3, slice_bytes=slice_bytes).collect())) == one


def test_ppm_in_spark_with_one_and_more_shards(spark):
    data = [(i, t) for i, t in enumerate(["hello there world", "hello there word", "", None, "abc abc abc", "hello there world"] * 3)] + [(0, "hello there world")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 AS bits", "2 AS half")
    one = sorted(map(tuple, op4_ppm.code_lengths(df, 3).collect()))
    assert len(one) == len(data)
    assert sorted(map(tuple, op4_ppm.code_lengths(df, 3, max_rows=9).collect())) == one
    assert all(b == 0 and r is None for _, n, b, r in one if n == 0)
    half = {r[0]: r[1] for r in df.select("doc_id", op4_ppm.half_of("doc_id")).collect()}
    for d, t in data[:6]:
        trie = op4_ppm.PpmTrie(3)
        for e, u in data:
            x = bytes(3) + (u or "").encode()
            for i in range(3, len(x)) if half[e] != half[d] else ():
                trie.learn(x[i - 3 : i], x[i])
        assert math.isclose(next(r[2] for r in one if r[0] == d), trie.code_length(t, adapt=False), abs_tol=2e-3)


def test_ppm_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert op4_ppm.code_lengths(df).count() == 0
    assert op4_ppm.adaptive_code_lengths(spark.createDataFrame([(1, "ab")], "doc_id bigint, text string")).collect()[0]["n_bytes"] == 2


# packing


def naive_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= s]
        if fits:
            max(fits, key=sum).append(s)
        else:
            bins.append([s])
    return sorted(tuple(sorted(b, reverse=True)) for b in bins)


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_equals_item_by_item(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 80))]
    got = [tuple(sorted(s, reverse=True)) for s, k in op5_packing.best_fit(Counter(sizes), 30) for _ in range(k)]
    assert sorted(map(sum, got)) == sorted(map(sum, naive_best_fit(sizes, 30)))
    assert Counter(x for s in got for x in s) == Counter(sizes)


def optimum(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= sizes[i]:
                j = bins.index(room)
                go(i + 1, bins[:j] + [room - sizes[i]] + bins[j + 1 :])
        go(i + 1, [*bins, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_never_costs_a_sequence(seed):
    rng = random.Random(seed)
    capacity = 20
    sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
    fixed, left = op5_packing.reduce_sizes(Counter(sizes), capacity)
    assert Counter(x for s, k in fixed for x in s * k) + Counter(left) == Counter(sizes)
    assert all(sum(s) <= capacity for s, _ in fixed)
    assert sum(k for _, k in fixed) + optimum(list(Counter(left).elements()), capacity) == optimum(sizes, capacity)


def test_pack_in_spark(spark):
    data = [(i, " ".join(["w"] * (i * 7 % 40))) for i in range(150)] + [(None, None), (3, ""), (3, ""), (999, "x " * 100)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "'x' AS part", "7 AS rank")
    got = op5_packing.pack(df, 32).collect()
    assert Counter(r["doc_id"] for r in got)[999] == 4
    by = {}
    for r in got:
        by.setdefault(r["sequence"], []).append((r["offset"], r["n_tokens"]))
    for placed in by.values():
        end = 0
        for o, n in sorted(placed):
            assert o == end
            end = o + n
        assert end <= 32
    total = sum(n for p in by.values() for _, n in p)
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert total == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in data)
    assert set(by) == set(range(len(by)))
    assert op5_packing.pack(df.limit(0), 32).count() == 0


# BPE


@pytest.fixture(scope="module")
def bpe():
    return op10_bpe.Bpe(op10_bpe.default_path())


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n", "  \n\n  a", "it's we'll 'sting ''s 's  's\n's I'm!'s x'", "a b  c", "1½２ ٣", "日本語 テスト🙂🙂", "a  b   c\t\td \r\n", "'", "' s", "don'T 'LL", "é ñ", "<|endoftext|>", "x" * 5000, "ab" * 900 + " " * 700, "naïve—“quote”…", "\x00\x01 \x00"]


def encode_all(bpe, texts):
    tokens, sizes, ok = op10_bpe.Encoder(bpe, op10_bpe.classes())(pa.array(texts, pa.large_string()))
    assert ok.all() and len(ok) == len(texts)
    return [x.tolist() for x in np.split(tokens, np.cumsum(sizes)[:-1])]


def test_bpe_equals_the_tokenizer(bpe, reference):
    texts = ODD + [t for (t,) in rows(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 150")]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab'st  \n\t1é日.! lvremd") for _ in range(60)) for _ in range(400)]
    for t, got in zip(texts, encode_all(bpe, texts)):
        assert got == reference.encode_ordinary(t), t[:80]


def test_bpe_pair_test_equals_merging(bpe):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3000, 20000), rng.integers(0, 3000, 20000)
    got = bpe.compatible(a, b)
    assert got.tolist() == [bpe.merge(bpe.bytes[x] + bpe.bytes[y]) == [x, y] for x, y in zip(a, b)]
    assert 0 < got.sum() < len(got)


def test_bpe_merge_long_equals_short(bpe, reference):
    for w in (b"anticonstitutionally", b"ererer", b"aaaaaaaaaaaaa"):
        assert bpe._merge_long(w, bpe.size) == bpe.merge(w)
    rng = random.Random(6)
    words = ["".join(rng.choice("aeinrst") for _ in range(n)) for n in (63, 64, 65, 66, 100, 500, 3000)] + ["ab" * 400, "x" * 1000]
    assert all(bpe.merge(w.encode()) == reference.encode_ordinary(w) for w in words)
    assert encode_all(bpe, [*words, *words]) == [reference.encode_ordinary(w) for w in [*words, *words]]


def test_bpe_tells_which_text_does_not_round_trip(bpe, monkeypatch):
    encoder = op10_bpe.Encoder(bpe, op10_bpe.classes())
    wrong = bpe.ranks[b"b"]
    encode = bpe.encode_words
    monkeypatch.setattr(bpe, "encode_words", lambda words: (lambda f, n, k: (np.where(f == bpe.ranks[b"c"], wrong, f), n, k))(*encode(words)))
    assert encoder(pa.array(["a", "c", "", "b"], pa.large_string()))[2].tolist() == [True, False, True, True]


def test_bpe_held_words_change_nothing(bpe, monkeypatch):
    texts = [t for (t,) in rows(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 40")]
    whole = encode_all(bpe, texts)
    monkeypatch.setattr(op10_bpe, "HELD_WORDS", 5)
    encoder = op10_bpe.Encoder(bpe, op10_bpe.classes())
    assert [encoder(pa.array([t], pa.large_string()))[0].tolist() for t in texts] == whole


def test_bpe_in_spark(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id bigint, text string").selectExpr("*", "1 AS tokens")
    enc = op10_bpe.encode(df)
    assert all(r["round_trip"] in (True, None) for r in enc.collect())
    assert {r["doc_id"]: r["text"] for r in op10_bpe.decode(enc).collect()} == {i: t for i, t in enumerate([*ODD, None])}
    assert op10_bpe.encode(df.limit(0)).count() == 0
