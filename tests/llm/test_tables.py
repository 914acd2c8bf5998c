"""Operators over tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; the pipeline by brute force."""

import gzip
import hashlib
import io
import itertools
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataseek.llm import op1_merkle, op2_toxicity, op3_language, op5_packing, op6_warc, op7_secrets, op8_neighbours, op9_jaccard
from strataseek.llm.common import sample_by_hash

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TOKEN = "9f3c47be21d05a86e1f7"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, la, s, None if t is None else len(t)) for d, t, la, s in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, repeats, a long text, ties, and columns named like those the operators make."""
    words = "the quick brown fox jumps over the lazy dog and runs away".split()
    rows = [
        (1, " ".join(words), "en", "a/x"), (1, " ".join(words), "en", "a/x"), (2, " ".join(words), "en", None), (3, "", "en", "b"), (4, None, None, "b"), (None, " ".join(words), "en", "c"),
        (None, None, None, None), (5, "  \n\n ", "de", "d"), (6, "word " * 60_000, "en", "e"), (7, f'token = "{TOKEN}" one', "en", "a/x"), (8, f'token = "{TOKEN}" two', "en", "a/y"), (9, "q", None, "f"),
    ]
    clash = {c: F.lit(i) for i, c in enumerate(["root", "sections", "n_grams", "keys", "bits", "words", "kind", "secret", "verdict", "part", "rank", "is_toxic", "language", "score", "half", "twin_id", "_t", "_n", "entry", "salt"])}
    return docs_of(spark, rows).withColumns(clash)


def labels_of(spark, rows=((1, 1, 0), (2, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


# op 1


def model_tree(text):
    if text is None:
        return None
    sections, now = [], []
    for p in text.split("\n"):
        p = p.strip(" ")
        if not p:
            sections, now = [*sections, now], []
            continue
        now.append(hashlib.sha256(b"L" + p.encode()).hexdigest())
        if now[-1][0] in "01":
            sections, now = [*sections, now], []
    sections = [s for s in [*sections, now] if s]
    nodes = [hashlib.sha256(("S" + " ".join(s)).encode()).hexdigest() for s in sections]
    return hashlib.sha256(("R" + " ".join(nodes)).encode()).hexdigest(), nodes, sections


def test_merkle_trees_equal_the_model(spark, odd):
    for r in op1_merkle.fingerprints(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        want = model_tree(r["text"])
        assert r["root"] == (want[0] if want else None)
        assert [s["node"] for s in r["sections"] or []] == (want[1] if want else [])


def test_merkle_diff_locates_edits(spark):
    rng = random.Random(0)
    lines = ["".join(rng.choice("abcdef ") for _ in range(30)) for _ in range(40)]
    edited = [*lines[:7], "inserted", *lines[7:20], "changed", *lines[21:]]
    a = docs_of(spark, [(1, "\n".join(lines), "", ""), (2, "same", "", ""), (3, "only left", "", "")])
    b = docs_of(spark, [(1, "\n".join(edited), "", ""), (2, "same", "", ""), (4, "only right", "", "")])
    got = {r["doc_id"]: (r["same"], r["removed"], r["added"]) for r in op1_merkle.diff(a, b).collect()}
    assert got == {1: (False, [20], [7, 21]), 2: (True, [], []), 3: (False, [0], []), 4: (False, [], [0])}


def test_merkle_corpus(spark, odd):
    got = op1_merkle.corpus_fingerprints(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["twin_id"] == 1 and by[1]["base_id"] is None and by[4]["root"] is None and by[4]["n_sections"] == 0
    assert by[5]["n_paragraphs"] == 0 and by[5]["twin_id"] == 3  # blank is as empty
    assert op1_merkle.corpus_fingerprints(odd.limit(0)).count() == 0


def model_bases(rows):
    """{doc_id: base_id} by comparing all pairs, for distinct doc_ids."""
    trees, own = {d: model_tree(t) for d, t in rows}, {}
    for d in sorted(trees):
        own.setdefault(trees[d][0], d)
    own = sorted(own.values())
    leaves = {d: {h for s in trees[d][2] for h in s} for d in own}
    nodes = {d: {n for n, s in zip(*trees[d][1:]) if len(s) > 1} for d in own}
    out = {}
    for d in own:
        best = (0, 0, 0)
        for e in (e for e in own if e < d):
            shared = len(leaves[d] & leaves[e]), len(nodes[d] & nodes[e])
            best = max(best, (*shared, -e)) if any(shared) else best
        if best[:2] > (0, 0):
            out[d] = -best[2]
    return out


def test_merkle_near_copies_without_a_common_section(spark):
    text = "\n".join(f"paragraph {i} of a short document" for i in range(6))
    while len(model_tree(text)[1]) > 1:
        text = text.replace("paragraph", "paragraph x")
    lines = text.split("\n")
    edited = "\n".join([*lines[:2], "changed", *lines[3:]])
    while set(model_tree(edited)[1]) & set(model_tree(text)[1]):
        edited = edited.replace("changed", "changed y")
    rows = [(1, lines[0] + " alone\n" + lines[4], "", ""), (2, text, "", ""), (3, edited, "", ""), (4, "no relative", "", "")]
    got = {r["doc_id"]: (r["base_id"], r["edited"]) for r in op1_merkle.corpus_fingerprints(docs_of(spark, rows)).collect()}
    assert got[3] == (2, [2]) and got[1] == got[4] == (None, None)


@pytest.mark.parametrize("hot", [2, 64])
def test_merkle_bases_equal_the_model(spark, monkeypatch, hot):
    monkeypatch.setattr(op1_merkle, "HOT", hot)
    rng, rows = random.Random(4), []
    for i in range(60):
        base = rows[rng.randrange(len(rows))][1].split("\n") if rows and rng.random() < 0.7 else [f"line {rng.randint(0, 400)}" for _ in range(rng.randint(1, 25))]
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(["the license line", "", f"new {rng.randint(0, 999)}"])
        rows.append((i * 7 % 60, "\n".join(base)))
    got = {r["doc_id"]: r["base_id"] for r in op1_merkle.corpus_fingerprints(docs_of(spark, [(d, t, "", "") for d, t in rows])).collect()}
    assert {d: b for d, b in got.items() if b is not None} == model_bases(rows)


def test_merkle_base_by_paragraphs_that_many_hold(spark):
    rows = [(i, f"common {i % 2}\nalone {i}") for i in range(140)]
    rows += [(200, "common 0\ncommon 1\nx"), (201, "common 0\ncommon 1\ny"), (202, "common 1\ncommon 0\nalone 7"), (203, "common 1")]
    got = {r["doc_id"]: (r["base_id"], r["edited"]) for r in op1_merkle.corpus_fingerprints(docs_of(spark, [(d, t, "", "") for d, t in rows])).collect()}
    # 202 shares two with 7, 200 and 201
    assert got[200] == (0, [1, 2]) and got[201] == (200, [2]) and got[202] == (7, [1]) and got[203] == (1, [])


@pytest.mark.parametrize("hot, sets, keys", [(1, 4, 1000), (2, 1000, 20), (3, 1000, 1000)])
def test_merkle_bases_by_blocks_of_sets(spark, monkeypatch, hot, sets, keys):
    for name, value in (("HOT", hot), ("BLOCK_SETS", sets), ("BLOCK_KEYS", keys)):
        monkeypatch.setattr(op1_merkle, name, value)
    rng = random.Random(5)
    lines = [f"line {i}" for i in range(14)]
    rows = [(i, "\n".join(rng.choice([*lines, ""]) for _ in range(rng.randint(1, 9)))) for i in rng.sample(range(1000), 90)]
    table = docs_of(spark, [(d, t, "", "") for d, t in rows])
    got = {r["doc_id"]: r["base_id"] for r in op1_merkle.corpus_fingerprints(table).collect()}
    assert {d: b for d, b in got.items() if b is not None} == model_bases(rows)
    text = F.lpad(F.col("doc_id").cast("string"), 4, "0")
    got = {int(r["doc_id"]): r["base_id"] for r in op1_merkle.corpus_fingerprints(table.withColumn("doc_id", text)).collect()}
    assert {d: int(b) for d, b in got.items() if b is not None} == model_bases(rows)


def test_merkle_rows_of_one_doc_id_are_no_bases_of_each_other(spark, monkeypatch):
    monkeypatch.setattr(op1_merkle, "HOT", 1)
    rows = [(1, "a\nb\none"), (1, "a\nb\ntwo"), (1, "a\nb\nthree"), (0, "a\nzero"), (2, "a\nb\nfour")]
    got = {(r["doc_id"], r["n_paragraphs"], r["base_id"]) for r in op1_merkle.corpus_fingerprints(docs_of(spark, [(d, t, "", "") for d, t in rows])).collect()}
    assert got == {(1, 3, 0), (0, 2, None), (2, 3, 1)}


# ops 2 and 3


def test_toxicity_tables(spark, odd):
    got = op2_toxicity.toxicity(odd, labels_of(spark)).collect()
    assert len(got) == odd.count() and set(got[0].asDict()) == {"doc_id", "p_insult", "p_contempt", "p_toxic", "is_toxic"}
    none = op2_toxicity.toxicity(odd, labels_of(spark, [(None, 1, 1), (1, None, None)])).collect()
    assert len(none) == odd.count() and not any(r["is_toxic"] for r in none)
    assert op2_toxicity.toxicity(odd.limit(0), labels_of(spark)).count() == 0


def test_language_tables(spark, odd):
    got = op3_language.language_id(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["language"], r["score"] is None))
    assert by[3] == by[4] == by[5] == {("und", True)} and by[1] == {("en", False)}
    assert {r["language"] for r in op3_language.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert op3_language.language_id(odd.limit(0)).count() == 0


# op 6


def test_page_chunks(spark):
    pages = [(1, "u", "é" * 5000), (1, "u", "é" * 5000), (2, None, ""), (3, "v", None), (None, "w", "x" * 100)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "1 AS payload", "2 AS digest")
    got = op6_warc.page_chunks(df, 64).collect()
    whole = defaultdict(bytes)
    for r in sorted(got, key=lambda r: r["chunk_no"]):
        if r["page_id"] != 1:
            whole[r["page_id"]] += r["payload"]
            assert r["digest"] == hashlib.sha256(whole[r["page_id"]]).hexdigest()
    assert dict(whole) == {2: b"", None: b"x" * 100}
    first = [r for r in got if r["page_id"] == 1]
    assert len(first) == 2 * -(-10000 // 64) and max(r["chunk_length"] for r in first) == 64
    assert op6_warc.page_chunks(df.limit(0)).count() == 0
    broken = op6_warc.broken_records(spark.createDataFrame(got, op6_warc.page_chunks(df).schema))
    assert broken.count() == 1  # the page that repeats


def warc_bytes(records):
    out = b""
    for name, payload in records:
        out += f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: {name}\r\nWARC-Target-URI: http://x/{name}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_warc_files(spark, tmp_path, packed):
    rng = random.Random(3)
    records = [("a", b""), ("b", rng.randbytes(100_000)), ("c", b"WARC/1.0\r\n\r\n"), ("d", b"x")]
    data = b"".join(gzip.compress(warc_bytes([r])) for r in records) if packed else warc_bytes(records)
    path = tmp_path / ("t.warc.gz" if packed else "t.warc")
    path.write_bytes(data)
    rows = op6_warc.read_warc(spark, [str(path)], 1024).collect()
    whole = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: r["chunk_no"]):
        whole[r["record_id"]] += r["payload"]
        assert r["digest"] == hashlib.sha256(whole[r["record_id"]]).hexdigest() and r["chunk_length"] <= 1024 and r["complete"]
    assert dict(whole) == dict(records)
    assert sum(r["is_last"] for r in rows) == len(records)
    assert op6_warc.broken_records(spark.createDataFrame(rows)).count() == 0
    if not packed:
        path.write_bytes(data[: len(warc_bytes(records[:1])) + 5000])
        cut = sorted((r for r in op6_warc.read_warc(spark, [str(path)], 1024).collect() if r["record_id"] == "b"), key=lambda r: r["chunk_no"])
        assert cut[-1]["is_last"] and not cut[-1]["complete"] and sum(r["chunk_length"] for r in cut) < 5000


def chunks_of(data, chunk=1024):
    return [(r[0], r[3], bytes(r[6]), r[8], r[9]) for r in op6_warc.records(io.BytesIO(data), "f", chunk)]


def test_warc_that_is_malformed():
    one = lambda length, body, name="n": f"WARC/1.1\r\nWARC-Record-ID: {name}\r\nContent-Length: {length}\r\n\r\n".encode() + body + b"\r\n\r\n"
    good = one(3, b"abc", "good")
    for length in ("x", "-5", "3.0", "\u0663", "1e3"):
        assert chunks_of(one(length, b"abc") + good) == [("n", 0, b"", True, False), ("good", 0, b"abc", True, True)]
    padded = gzip.compress(good) + bytes(700) + gzip.compress(good) + bytes(5_000)
    assert chunks_of(padded) == [("good", 0, b"abc", True, True)] * 2
    assert chunks_of(gzip.compress(good) + b"no member") == [("good", 0, b"abc", True, True)]
    broken = bytearray(gzip.compress(one(50_000, random.Random(1).randbytes(50_000)) + good))
    broken[20_000:20_040] = bytes(40)
    assert chunks_of(bytes(broken))[-1][4] in (True, False)
    endless = b"WARC/1.1\r\nWARC-Record-ID: n\r\nX: " + b"y" * 5_000_000 + b"\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n" + good
    assert chunks_of(endless) == [("n", 0, b"hi", True, True), ("good", 0, b"abc", True, True)]
    assert chunks_of(b"z" * 3_000_000) == [] == chunks_of(b"")


def test_warc_reader_holds_a_block_at_a_time(tmp_path):
    size = 64 << 20
    with open(tmp_path / "t.warc.gz", "wb") as f, gzip.open(f, "wb") as z:
        z.write(f"WARC/1.1\r\nWARC-Record-ID: n\r\nContent-Length: {size}\r\n\r\n".encode())
        for _ in range(size >> 20):
            z.write(bytes(1 << 20))
    tracemalloc.start()
    with open(tmp_path / "t.warc.gz", "rb") as f:
        n = sum(r[5] for r in op6_warc.records(f, "f"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == size and peak < 2 << 20


# op 7


def test_secrets(spark, odd):
    key, shared, fake = "AKIA" + "ABCD2345EFGH6789", "9f8e7d6c5b4a39281706f5e4", "examplexample1234567"
    rows = [(20 + i, f"api_key: {shared}", "en", f"o{i}/r") for i in range(3)] + [(30, f"x {key} y {key}", "en", "solo/r1"), (31, f"{key}", "en", "solo/r2"), (32, f"password={fake}", "en", "solo/r1")]
    got = op7_secrets.secret_scan(odd.select("doc_id", "text", "source").unionByName(docs_of(spark, rows).select("doc_id", "text", "source"))).collect()
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by = {(r["doc_id"], r["secret_hash"]): r for r in got}
    assert by[20, h(shared)]["verdict"] == "example" and by[20, h(shared)]["n_owners"] == 3
    assert by[30, h(key)]["verdict"] == "live" and by[30, h(key)]["n_repos"] == 2 and by[30, h(key)]["n_docs"] == 2
    assert by[32, h(fake)]["verdict"] == "placeholder"
    assert by[7, h(TOKEN)]["verdict"] == "live" and by[7, h(TOKEN)]["n_repos"] == 2
    assert op7_secrets.secret_scan(odd.limit(0)).count() == 0


LETTERS = "q7Rw2Te9Yu4Io1Pa6Sd8Fg3Hj5Kl0Zx"
WHOLE = [  # text around %s, and the secret
    ('token = "%s" end', (LETTERS * 10)[:300]), ("token: %s, end", (LETTERS * 10)[:300]), ("a %s b", "xoxb-" + (LETTERS * 4)[:110]), ("a %s b", "sk-proj-" + (LETTERS * 6)[:156]),
    ("a %s b", "sk-proj-" + ("a1-B_" * 40)[:155] + "-"), ("a %s b", "sk_live_" + (LETTERS * 4)[:90]), ("a %s b", "ghp_" + (LETTERS * 2)[:50]), ("password = %s", "Tr0ub4dor9xQ7"), ("password = %s.", "Tr0ub4d0r!@#$%%x"), ("pwd='%s'", "it is \"4\" w0rds"),
    ('{"password": "%s"}', "p@ss,w0rd;(1)."), ('secret = "%s" end', 'ab\\"cd\\"9efgh'), ('secret = "%s and no quote', "zq8x!vm2k?"),
]


@pytest.mark.parametrize("around,secret", WHOLE)
def test_secrets_are_taken_whole(around, secret, spark):
    secret = secret.replace("%%", "%")
    out = {r["text"] for r in op7_secrets.redacted(docs_of(spark, [(1, around.replace("%s", secret), "en", "a/x"), (2, "password = hunter2 and token: none", "en", "b")])).collect()}
    assert out == {around.replace("%s", op7_secrets.REDACTED), "password = hunter2 and token: none"}


def test_secret_values_end_where_they_end(spark):
    text = 'api_key = "" token=q8Zx7!vB2m) password = "two w0rds here" + "other" secret: `' + "\npassword\n= no"
    got = {r["secret"] for r in op7_secrets.candidates(docs_of(spark, [(1, text, "en", "a")])).collect()}
    assert got == {"q8Zx7!vB2m", "two w0rds here"}


def test_redaction(spark, odd):
    out = op7_secrets.redacted(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[7]["text"] == f'token = "{op7_secrets.REDACTED}" one' and by[7]["n_chars"] == len(by[7]["text"])
    assert by[6]["text"] == "word " * 60_000


def test_secrets_of_rows_without_an_id(spark):
    rows = [(None, f"api_key: {TOKEN} a", "en", "solo/r"), (None, f"api_key: {TOKEN} b", "en", "solo/r"), (-1, f"api_key: {TOKEN} c", "en", "solo/r"), (5, f"x api_key: {TOKEN}", "en", "solo/q"), (5, "another text", "en", "solo/q")]
    rows += [(6 + i, "secret: 8Hq2!zzTr91x", "en", f"o{i}/r") for i in range(2)]
    docs = docs_of(spark, rows)
    got = op7_secrets.secret_scan(docs).collect()
    h = hashlib.sha256(TOKEN.encode()).hexdigest()
    assert {r["n_docs"] for r in got if r["secret_hash"] == h} == {3} and {r["verdict"] for r in got if r["secret_hash"] != h} == {"shared"}
    out = [r["text"] for r in op7_secrets.redacted(docs).collect()]
    assert len(out) == len(rows) and sum(op7_secrets.REDACTED in t for t in out) == 6 and not any(TOKEN in t or "8Hq2" in t for t in out)


# op 8


def brute_neighbours(rows, k, every=1):
    v = {i: np.array(x, float) / np.linalg.norm(x) for i, x in rows.items()}
    near = lambda i: sorted((round(1 - float(np.einsum("i,i->", v[i], v[j])), 9), j) for j in v if j != i and len(v[j]) == len(v[i]))[:k]
    return {(i, r, j, d) for i in v if i % every == 0 for r, (d, j) in enumerate(near(i), 1)}


@pytest.mark.parametrize("n,block,every", [(150, 20, 1), (7, 100, 2), (300, 8, 5)])
def test_neighbours_equal_brute_force(spark, n, block, every):
    rng = np.random.default_rng(n)
    rows = {i: rng.normal(size=5).tolist() for i in range(n)}
    rows[n], rows[n + 1], rows[-20] = rows[0], rows[0], [x * 1e200 for x in rows[1]]  # ties, a negative id, a length that overflows
    rows |= {1000 + i: rng.normal(size=3).tolist() for i in range(9)}  # another dimension
    bad = [(None, [1.0] * 5), (900, None), (901, []), (902, [0.0] * 5), (904, [float("nan")] * 5), (905, [1.0, None, 1.0, 1.0, 1.0]), (0, rows[0])]
    df = spark.createDataFrame([*rows.items(), *bad], "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS block", "2 AS distance", "3 AS rank", "4 AS id", "5 AS dim")
    got = {tuple(r) for r in op8_neighbours.neighbours(df, k=4, block=block, every=every, side=2).collect()}
    rows[-20] = [x / 1e200 for x in rows[-20]]
    assert {x[:3] for x in got} == {x[:3] for x in brute_neighbours(rows, 4, every)}
    assert op8_neighbours.neighbours(df.limit(0)).count() == 0


def test_tile_bounds_hold_and_prune():
    rng = np.random.default_rng(8)
    names = [x.split()[0] for x in op8_neighbours.BLOCK_SCHEMA.split(", ")]
    v = [op8_neighbours.unit(rng.normal(size=(500, 32))) for _ in range(2)]
    a, b = (op8_neighbours.Side(dict(zip(names, op8_neighbours._block(np.arange(500) + 500 * s, v[s], 0))), "") for s in (0, 1))
    near = (a.ints @ b.ints.T) * a.scale[:, None] * b.scale[None, :]
    bound = a.error[:, None] + a.size[:, None] * b.error[None, :]
    assert (np.abs(near - v[0] @ v[1].T) <= bound + 1e-6).all()
    bounds = op8_neighbours.Bounds(a, 10)
    bounds.tile(b)
    q, o, _, _ = bounds.left()
    assert len(q) < 0.2 * 500 * 500
    best = np.argsort(-(v[0] @ v[1].T), axis=1)[:, :10] + 500
    assert {(i, j) for i in range(500) for j in best[i].tolist()} <= set(zip(q.tolist(), o.tolist()))


# op 9


def grams(text, n=op9_jaccard.N):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute_pairs(rows, t=op9_jaccard.THRESHOLD):
    best = {}
    for (a, x), (b, y) in itertools.combinations([(d, s) for d, text in rows if d is not None and text and (s := grams(text))], 2):
        j = len(x & y) / len(x | y)
        if a != b and j >= t:
            best[min(a, b), max(a, b)] = max(best.get((min(a, b), max(a, b)), 0), round(j, 9))
    return best


def near_copies(seed, families=12):
    rng, rows = random.Random(seed), []
    for _ in range(families):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 200)) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 20)):
                w[rng.randrange(len(w))] = "zz" + str(rng.randint(0, 99))
            rows.append((len(rows), " ".join(w)))
    return rows


def brute_classes(rows, t=op9_jaccard.THRESHOLD):
    """{doc_id: (class_id, n_links)} by comparing all distinct texts of all documents."""
    texts = sorted({(d, tuple((text or "").lower().split())) for d, text in rows if d is not None})
    sets = [grams(" ".join(w)) for _, w in texts]
    links, edges = Counter(), []
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t:
            links.update([texts[i][0], texts[j][0]])
            edges.append((texts[i][0], texts[j][0]))
    top = union_find(edges)
    return {d: (top.get(d, d), links[d]) for d, _ in texts}


ONE_ID_TWO_TEXTS = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "a b c d e f g"), (3, "p q r s t u v"), (4, "x1 x2 x3"), (4, "x1 x2 x3"), (5, "x1 x2  X3"), (6, "m1 m2 m3 m4 m5 m6"), (6, "m1 m2 m3 m4 m5 m7")]


@pytest.mark.parametrize("seed,cell", [(0, 2_048), (1, 2_048), (2, 4)])
def test_jaccard_classes(spark, odd, seed, cell, monkeypatch):
    monkeypatch.setattr(op9_jaccard.cells_of, "__defaults__", (cell,))
    rows = [(d + 100, t) for d, t in near_copies(seed)] + [(r["doc_id"], r["text"]) for r in odd.collect()] + [(d + 9000, t) for d, t in ONE_ID_TWO_TEXTS]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS entry", "2 AS keys", "'k' AS key", "3 AS bits", "4 AS eid", "5 AS words")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in op9_jaccard.jaccard_join(df).collect()}
    want = brute_classes(rows)
    assert got == want
    assert {r["doc_id"]: r["kept"] for r in op9_jaccard.duplicate_groups(df).collect()} == {d: c for d, (c, _) in want.items() if c != d}


def test_jaccard_pairs_and_members(spark, odd):
    rows = [(d + 100, t) for d, t in near_copies(7)] + [(r["doc_id"], r["text"]) for r in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    first = {}
    for d, text in sorted((d, tuple(text.lower().split())) for d, text in rows if d is not None and text and text.split()):
        first.setdefault(text, d)
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in op9_jaccard.similar_texts(df).collect()}
    assert got == brute_pairs([(d, " ".join(w)) for w, d in first.items()])
    assert {(r["doc_id"], r["representative"]) for r in op9_jaccard.members(df).collect()} == {(d, first[tuple(text.lower().split())]) for d, text in rows if d is not None and text and text.split()}
    assert op9_jaccard.jaccard_join(df.limit(0)).count() == op9_jaccard.similar_texts(df.limit(0)).count() == 0


def test_one_id_with_two_texts_makes_no_pair_of_others(spark):
    df = spark.createDataFrame(ONE_ID_TWO_TEXTS, "doc_id bigint, text string")
    assert {tuple(r) for r in op9_jaccard.jaccard_join(df).collect()} == {(1, 1, 2), (2, 1, 1), (3, 1, 1), (4, 4, 1), (5, 4, 1), (6, 6, 2)}
    assert op9_jaccard.similar_texts(df).count() == 0


@pytest.mark.parametrize("m", [300, 3_000])
def test_a_family_of_near_copies_leaves_a_cell_in_rows(m):
    rng = np.random.default_rng(m)
    base = np.sort(rng.integers(0, 2**63, 120, dtype=np.uint64))
    texts = [np.unique(np.append(np.delete(base, rng.integers(0, 120, 3)), rng.integers(0, 2**63, 3, dtype=np.uint64))) for _ in range(m)]
    ids = np.arange(m)
    partners = [ids[i + 1 :].tobytes() for i in range(m)]
    done = []
    with pytest.MonkeyPatch.context() as mp:
        mp.setattr(op9_jaccard, "ragged", lambda a, b, f=op9_jaccard.ragged: (done.append(len(a)), f(a, b))[1])
        out = op9_jaccard._cell(ids, ids + 5, np.ones(m, np.int64), partners, [g.tobytes() for g in texts], 0.5, "roots")
    assert sum(done) == m - 1  # intersections
    assert len(out[0]) == m and set(out[3].tolist()) == {5}


def test_recall_of_tiles_at_the_threshold():
    rng, missed = np.random.default_rng(3), 0
    for _ in range(3_000):
        pool = rng.integers(0, 2**63, 150, dtype=np.uint64)  # 50 common of 100 and 100: a Jaccard of 1 / 2 is 66 of 99
        x, y = np.concatenate([pool[:50], pool[50:75]]), np.concatenate([pool[:50], pool[75:100]])
        missed += not (op9_jaccard.min_hash_keys(x) == op9_jaccard.min_hash_keys(y)).any()
    assert missed <= 5


def test_bit_counts_bound_the_overlap():
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
    for _ in range(50):
        x, y = sorted((np.unique(rng.choice(pool, rng.integers(1, 700))) for _ in range(2)), key=len)
        bx, by = (op9_jaccard.bitmap(v).view(np.uint64)[None, :] for v in (x, y))
        assert 2 * len(y) <= by.size * 64 <= max(64, 4 * len(y))
        by = op9_jaccard.folded(by, bx.shape[1])
        bound = min(len(x) - np.bitwise_count(bx & ~by).sum(), len(y) - np.bitwise_count(by & ~bx).sum())
        assert bound >= len(np.intersect1d(x, y))


def union_find(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in op9_jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in union_find([(a, b) for a, b in edges if a != b]).items() if k != v}
    assert op9_jaccard.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# op 5


def n_tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return len(t.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("part_rows", [1, 3, 1 << 20])
def test_packing_of_tokens(spark, odd, part_rows):
    got = op5_packing.pack(odd, 300, part_rows=part_rows).collect()
    sizes = defaultdict(list)
    for r in got:
        sizes[r["doc_id"]].append((r["part"], r["n_tokens"]))
    for d, text in {(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] not in (1, None)}:
        n = n_tokens(text) + 1
        assert sorted(sizes[d]) == [(p, min(300, n - 300 * p)) for p in range(-(-n // 300))]
    places = defaultdict(list)
    for r in got:
        places[r["sequence"]].append((r["offset"], r["n_tokens"]))
    for rows in places.values():  # end to end, without gap or overlap, and no more than fits
        assert [o for o, _ in sorted(rows)] == [sum(n for _, n in sorted(rows)[:i]) for i in range(len(rows))] and sum(n for _, n in rows) <= 300
    plan = op5_packing.plan(Counter(r["n_tokens"] for r in got), 300)
    assert sorted(places) == list(range(sum(k for _, k, _ in plan.groups)))
    assert op5_packing.pack(odd.limit(0)).count() == 0


# samples


def test_a_sample_is_never_empty_and_never_one_repeated_row(spark):
    rows = spark.range(2_000).selectExpr("id AS doc_id", "'en' AS lang")
    assert 0 < sample_by_hash(rows, 100).count() < 200
    assert sample_by_hash(rows, 100, total=40_000).count() < 30
    some = sample_by_hash(rows, 2**40, total=2**41).count()  # a table too large for a share of a million
    assert 800 < some < 1_200
    assert sample_by_hash(rows.limit(0), 100).count() == 0
    hot = rows.unionByName(rows.limit(1).withColumn("doc_id", F.explode(F.array_repeat(F.lit(5).cast("bigint"), 3_000))))
    got = sample_by_hash(hot, 2_500).collect()
    assert len(got) == len(set(got)) < 1_200
    # 5e10 rows and 2,000 asked for: a share of 4e-8, whose bound must not be 0
    assert "<" in str(sample_by_hash(rows, 2_000, total=5 * 10**10)._jdf.queryExecution().toString()) and (2_000 << 64) // (5 * 10**10) > 2**39


def test_no_declared_language_keeps_all(spark, odd):
    import corpus_pipeline

    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = Counter(r["doc_id"] for r in corpus_pipeline.language(spark, bare, "").collect())
    assert kept == Counter(r["doc_id"] for r in odd.collect() if r["text"] and any(c.isalpha() for c in r["text"]))


# the pipeline, stage by stage against what its operators' models say


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    word = lambda: rng.choice("the of and to in is was for that with".split()) if rng.random() < 0.4 else "".join(rng.choice("etaoinshr") for _ in range(6))
    rows, labels = [], []
    for i in range(120):
        w = [word() for _ in range(80)]
        if i % 6 == 0:
            w[5] = w[25] = "idiot"
        if i < 90:
            labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, " ".join(w), "en", f"o{i % 7}/r"))
    rows += [(200 + i, rows[i][1] + " tail", "en", "o1/r") for i in (1, 2, 3)]
    rows += [(300, 'nothing but token = "' + TOKEN + '" here', "en", "o1/r"), (301, "12 34", "en", "o1/r"), (302, None, None, None), (None, "some words of a document", "en", "o1")]
    d = str(tmp_path / "sf")
    docs_of(spark, rows).withColumn("rank", F.lit(1)).write.parquet(f"{d}/documents.parquet")
    labels_of(spark, labels).write.parquet(f"{d}/labels.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        kept.append(docs.collect())
        assert k == 4 or docs.columns == corpus_pipeline.COLUMNS
    toxic = {i for i in range(0, 120, 6)}
    ids = [{r["doc_id"] for r in x} for x in kept]
    assert ids[0] == {r[0] for r in rows} - toxic
    assert ids[1] == ids[0] - {301, 302}
    groups = union_find(brute_pairs([(r["doc_id"], r["text"]) for r in kept[1]]))
    assert ids[2] == {x for x in ids[1] if groups.get(x, x) == x}
    assert 201 not in ids[2] and 1 in ids[2]
    assert ids[3] == ids[2] and TOKEN not in next(r["text"] for r in kept[3] if r["doc_id"] == 300)
    want = Counter(n_tokens(r["text"]) + 1 for r in kept[3])
    assert Counter(r["n_tokens"] for r in kept[4]) == want
    plan = op5_packing.plan(dict(want), op5_packing.CAPACITY)
    assert len({r["sequence"] for r in kept[4]}) == sum(k for _, k, _ in plan.groups)
    whole = corpus_pipeline.run(spark, d)
    assert sorted(map(str, whole.collect())) == sorted(map(str, kept[4]))


def test_pipeline_drops_mislabelled_and_unknown_languages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    common = {
        "en": "the of and to in is was for that with this from have they which there would been about house water people other when your said each she how their will up out many then them these so some her make like him into time has look two more write go see number no way could than first".split(),
        "de": "der die und das ist nicht mit sich von auf ein eine auch wird werden haben hatte durch zwischen wasser haus menschen andere wenn ihre sagte jede wie ich du aber nach bei nur noch schon immer wieder kann muss über sehr zeit zwei mehr schreiben gehen sehen zahl kein weg könnte als".split(),
    }
    say = lambda la: " ".join(rng.choice(common[la]) for _ in range(60))
    rows = [(i, say(la), la, "o1/r") for i, la in enumerate(["en", "de"] * 80)]
    russian = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в духе братства"
    mixed = say("de") + " " + " ".join(say("en").split()[:8])  # own words above 5 %
    planted = {900: (say("de"), "en"), 901: (mixed, "en"), 902: (russian, "en"), 903: ("人人生而自由在尊严和权利上一律平等他们赋有理性和良心", "de"), 904: (say("en"), "xx")}
    stay = {910: (say("de"), None), 911: (russian, "ru"), 912: (say("en") + " 9f3c47be21d05a86e1f79f3c47be21d05a86e1f7" * 9, "en"), 913: ("haus", "en"), 914: (say("en"), "en-US")}
    extra = docs_of(spark, [(d, t, la, "o1/r") for d, (t, la) in (planted | stay).items()])
    model = op3_language.fit([r[1] for r in rows], [r[2] for r in rows], op3_language.vocabulary())
    with pytest.MonkeyPatch.context() as m:
        m.setattr(op3_language, "train", lambda docs: model)
        kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs_of(spark, rows).unionByName(extra), "").collect()}
    assert kept == {r[0] for r in rows} | set(stay)
