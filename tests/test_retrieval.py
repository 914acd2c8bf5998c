"""Contracts of retrieval, fusion, chunking, parsing, the catalog and the pipeline."""

import math
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataseek.functions import chunk, paths, text
from strataseek.operators import fulltext, fusion, mutation, vector
from strataseek.plans.pipeline import Citation, SearchPipeline, mock_citations, mock_expander, mock_reranker
from strataseek.sources.catalog import Catalog, FullTextAccess, FullTextQuery, PathSelector, SearchRequest, VectorAccess, VectorQuery, is_persistable


@pytest.fixture
def blocks(spark):
    def make(rows):
        return spark.createDataFrame(rows, "path string, block_id string, content string")

    return make


def refs(hits):
    return [(r["path"], r["block_id"]) for r in hits.collect()]


# paths


def test_prefixes_end_at_components(spark):
    given = ["/a", "/a/b", "/ab", "/a_b", "/axb", "/"]
    df = spark.createDataFrame([(p,) for p in given], "path string")
    for prefix in ("/a", "/a/", "/", "/a_b"):
        got = {r[0] for r in df.where(paths.prefix_predicate(F.col("path"), prefix)).collect()}
        assert got == {p for p in given if paths.matches_prefix(p, prefix)}
    assert paths.any_prefix(F.col("path"), []) is None
    assert not paths.matches_prefix("/ab", "/a")
    assert paths.safe_name("a/b é") == "a_47_b_32__233_"


def test_prefix_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("/en/1",)], "path string").write.parquet(str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).where(paths.prefix_predicate(F.col("path"), "/en"))._jdf.queryExecution().toString()
    assert "StringStartsWith(path,/en/)" in plan


# full text


def test_partial_matches_count_and_coverage_ranks(blocks):
    index = fulltext.tables(blocks([("/d/all", "b", "alpha beta gamma"), ("/d/two", "b", "alpha beta"), ("/d/one", "b", "alpha"), ("/d/none", "b", "delta")]))
    got = fulltext.search(index, ["alpha beta gamma"], 10).collect()
    assert got[0]["path"] == "/d/all" and {r["path"] for r in got} == {"/d/all", "/d/two", "/d/one"}
    assert all(r["score"] > 0 for r in got)


def test_merges(blocks):
    index = fulltext.tables(blocks([("/d", "all", "alpha beta gamma"), ("/d", "a", "alpha"), ("/d", "b", "beta"), ("/d", "c", "gamma")]))
    queries = ["alpha", "beta", "gamma"]
    total = fulltext.search(index, queries, 10).collect()
    assert total[0]["block_id"] == "all" and total[0]["score"] > total[1]["score"]
    most = {r["block_id"]: r["score"] for r in fulltext.search(index, queries, 10, "max").collect()}
    single = {r["block_id"]: r["score"] for r in fulltext.search(index, ["alpha"], 10).collect()}
    assert math.isclose(most["a"], single["a"])
    with pytest.raises(ValueError):
        fulltext.search(index, queries, 10, "mean")
    assert fulltext.search(index, ["  ", "!"], 10).count() == 0


def test_prefix_and_fuzzy_terms(blocks):
    index = fulltext.tables(blocks([("/d", "1", "searching"), ("/d", "2", "serach"), ("/d", "3", "other")]))
    assert refs(fulltext.expanded_search(index, "search", prefix=True, fuzzy=None)) == [("/d", "1")]
    assert refs(fulltext.expanded_search(index, "search", prefix=False, fuzzy=0.4)) == [("/d", "2")]


def test_both_ways_to_postings_agree(blocks):
    b = blocks([("/d", "1", "b a b Ünï-a 1½"), ("/d", "2", ""), ("/d", "3", None)])
    assert sorted(map(tuple, fulltext.build_postings(b).collect())) == sorted(map(tuple, fulltext.exploded_postings(b).collect()))
    assert fulltext.corpus_stats(b).collect()[0]["blocks"] == 3


def test_analyzer():
    assert text.Analyzer("en", True).terms("Été ÉTÉ straße") == ["ete", "strasse"]
    assert text.language_name("de") == text.language_name("german")
    with pytest.raises(ValueError):
        text.Analyzer("klingon")


# vectors


def test_cosine_forms_agree(spark):
    rng = random.Random(1)
    v = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(20)] + [[0.0, 0.0, 0.0]]
    df = spark.createDataFrame([("/v", str(i), x) for i, x in enumerate(v)], "path string, block_id string, embedding array<double>")
    got = {r["block_id"]: r["score"] for r in vector.search(df, [v[0]], 50).collect()}
    column = {r[0]: r[1] for r in df.select("block_id", vector.cosine(F.col("embedding"), F.array(*map(F.lit, v[0])))).collect()}
    for i, x in enumerate(v):
        assert math.isclose(got[str(i)], vector.cosine_similarity(v[0], x), abs_tol=1e-12)
        assert math.isclose(column[str(i)], got[str(i)], abs_tol=1e-12)
    assert got["20"] == 0 and refs(vector.search(df, [v[0]], 1)) == [("/v", "0")]
    assert vector.search(df, [], 5).count() == 0
    with pytest.raises(ValueError):
        vector.cosine_similarity([1], [1, 2])
    with pytest.raises(Exception, match="dimensionality 2"):
        vector.checked(df, 2).collect()
    requests = spark.createDataFrame([(1, v[0]), (2, v[1])], "request_id int, embedding array<double>")
    assert [tuple(r) for r in vector.batch_search(df, requests, 1).select("request_id", "block_id").orderBy("request_id").collect()] == [(1, "0"), (2, "1")]


# fusion


def stream(spark, *ids):
    return spark.createDataFrame([("/d", i, 1.0, n) for n, i in enumerate(ids, 1)], "path string, block_id string, score double, rank int")


def test_rrf_scores(spark):
    got = {r["block_id"]: r["score"] for r in fusion.reciprocal_rank_fusion([("x", stream(spark, "a", "b", "c", "d"), 1.0)], 10).collect()}
    for i, (b, bonus) in enumerate([("a", 0.05), ("b", 0.02), ("c", 0.02), ("d", 0)], 1):
        assert math.isclose(got[b], 1 / (60 + i) + bonus, abs_tol=1e-12)
    two = fusion.reciprocal_rank_fusion([("x", stream(spark, "a", "b"), 1.0), ("y", stream(spark, "b", "a"), 1.0)], 10).collect()
    assert [r["block_id"] for r in two] == ["a", "b"]  # a tie: as first met
    assert math.isclose(two[0]["score"], 1 / 61 + 1 / 62 + 0.05, abs_tol=1e-12)
    assert set(two[0]["sub_results"]) == {"x", "y"}
    assert fusion.reciprocal_rank_fusion([("x", stream(spark, "a", "b"), 1.0)], 1).count() == 1
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion([], 1)


def test_weighted_blend(spark):
    df = spark.createDataFrame([("/d", "a", 0, 1.0, None), ("/d", "b", 1, 3.0, -1.0), ("/d", "c", 2, 2.0, None)], "path string, block_id string, pos int, x double, y double")
    got = {r["block_id"]: r["score"] for r in fusion.weighted_blend(df, {"x": 1.0, "y": 1.0}).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 1.5}  # a missing score, 0, beats a negative one
    flat = {r["block_id"]: r["score"] for r in fusion.weighted_blend(df.withColumn("x", F.lit(2.0)), {"x": 1.0}).collect()}
    assert flat == {"a": 1.0, "b": 0.5, "c": 1 / 3}
    assert fusion.weighted_blend(df, {"x": 1.0}, 1).count() == 1


def test_blend_with_reranker(spark):
    hits = stream(spark, *[str(i) for i in range(1, 13)])
    rerank = spark.createDataFrame([("/d", "12", 1.0)], "path string, block_id string, rerank_score double")
    got = {r["block_id"]: r["score"] for r in fusion.blend_with_reranker(hits, rerank).collect()}
    assert math.isclose(got["1"], 0.75) and math.isclose(got["4"], 0.6 / 4) and math.isclose(got["12"], 0.4 / 12 + 0.6)
    with pytest.raises(ValueError):
        fusion.blend_with_reranker(hits, rerank, ())


# mutation


def test_upsert_and_delete(blocks):
    old = blocks([("/a", "1", "x"), ("/a", "2", "y"), ("/a/b", "1", "z"), ("/ab", "1", "w")])
    new = blocks([("/a", "1", "new")])
    assert sorted(r["content"] for r in mutation.upsert(old, new).collect()) == ["new", "w", "y", "z"]
    assert refs(mutation.delete(old, [("/a", None)])) == [("/ab", "1")]
    assert sorted(refs(mutation.delete(old, [("/a", "1")]))) == [("/a", "2"), ("/a/b", "1"), ("/ab", "1")]
    assert sorted(r[0] for r in mutation.orphan_paths(old, new).collect()) == ["/a/b", "/ab"]
    assert mutation.orphan_paths(old).count() == 3


# chunking


def test_break_points_and_fences():
    t = "# One\n\ntext\n## Two\n- item\n1. item\n---\n```\ncode\n```\n   \nlast"
    scores = dict(chunk.scan_break_points(t))
    assert [scores[p] for p in sorted(scores)] == [100, 20, 1, 90, 5, 5, 60, 80, 1, 80, 20, 1]
    assert chunk.find_code_fences(t) == [(t.index("```"), t.rindex("```"))]
    assert chunk.find_code_fences("a\n```\nb") == [(2, 7)]
    assert chunk.scan_break_points("") == [] and chunk.is_inside_code_fence([(2, 7)], 7)


def test_cutoff_prefers_score_then_nearness():
    assert chunk.find_best_cutoff([(50, 100), (99, 1)], [], 100, 60) == 50
    assert chunk.find_best_cutoff([(60, 20), (90, 20)], [], 100, 60) == 90
    assert chunk.find_best_cutoff([(60, 20)], [(50, 70)], 100, 60) == -1
    assert chunk.find_best_cutoff([(10, 20)], [], 100, 60) == -1


@pytest.mark.parametrize("seed", range(20))
def test_chunks_cover_the_text(seed):
    rng = random.Random(seed)
    t = "".join(rng.choice(["word ", "\n", "\n\n# Head\n", "\n```\ncode\n```\n", "- item\n"]) for _ in range(120))
    for overlap in (0, 7):
        got = chunk.chunk_markdown(t, 60, overlap)
        assert [c.index for c in got] == list(range(len(got))) and got[-1].end_pos == len(t)
        for a, b in zip(got, got[1:]):
            assert a.content == t[a.start_pos : a.end_pos] and b.start_pos in (max(a.start_pos + 1, a.end_pos - overlap), max(a.start_pos + 1, a.end_pos + 1 - overlap))
            assert not chunk.is_inside_code_fence(chunk.find_code_fences(t), a.end_pos) or a.end_pos == len(t)


def test_chunk_edges():
    assert chunk.chunk_markdown("", 10) == []
    assert [c.content for c in chunk.chunk_markdown("abcdefghij", 4)] == ["abcd", "efgh", "ij"]
    assert chunk.chunk_markdown("ab\n```\nc", 4)[-1].end_pos == 8  # a fence at the end is never cut
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert [c.start_pos for c in chunk.chunk_markdown("abcdef", 3, 3)] == [0, 1, 2, 3]
    assert seen
    with pytest.raises(ValueError):
        chunk.chunk_markdown("a", 0)


def test_columns_equal_the_functions(spark):
    texts = ["# a\n\nb\n```\nx\n```", "```\nopen", "", None, "- a\n***\n12. b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    points = {(r["id"], r["position"], r["score"]) for r in chunk.break_points(df, "id").collect()}
    assert points == {(i, p, s) for i, t in enumerate(texts) for p, s in chunk.scan_break_points(t or "")}
    fences = {(r["id"], r["start"], r["end"]) for r in chunk.code_fences(df, "id").collect()}
    assert fences == {(i, a, b) for i, t in enumerate(texts) if t for a, b in chunk.find_code_fences(t)}
    chunks = [tuple(r) for r in chunk.chunk_documents(df, "id", 6).collect()]
    assert chunks == [(i, c.index, c.content, c.start_pos, c.end_pos) for i, t in enumerate(texts) if t for c in chunk.chunk_markdown(t, 6)]


# queries


def test_structured_queries():
    got = text.parse_structured_query("\nlex: a fox\n  VEC:  jump \nhyde:x")
    assert [(q.type, q.query, q.line) for q in got] == [("lex", "a fox", 2), ("vec", "jump", 3), ("hyde", "x", 4)]
    for plain in ("", "  ", "plain", "two\nlines", "expand: it", "other: a", "expand: it\nmore"):
        assert text.parse_structured_query(plain) is None
    for wrong in ("lex: a\nplain", "lex: a\nexpand: b", "lex:", "expand:", "plain\nvec: a"):
        with pytest.raises(ValueError):
            text.parse_structured_query(wrong)


def test_validation():
    assert text.validate_lex_query('a "b c"') is None and text.validate_lex_query('a "b') and text.validate_lex_query("a\nb")
    assert text.validate_semantic_query("well-known") is None and text.validate_semantic_query("a -b") and text.validate_semantic_query('-"b c"')


def test_intent_and_best_chunk():
    assert len(text.STOP_WORDS) == 79
    assert text.intent_terms_of("How do the Web, (web) APIs perform?") == ["web", "apis", "perform"]
    best = text.select_best_chunk(["", "a concatenate", "cat nap", "cat nap"], ["cat"], ["nap"])
    assert (best.index, best.score) == (2, 1.5)
    assert text.select_best_chunk([""], ["x"]) is None


# catalog


def blocks_of(spark, rows):
    return spark.createDataFrame(rows, "path string, block_id string, content string")


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "path string, block_id string, embedding array<float>")


SPECS = {"text": {"type": "fulltext", "language": "en"}, "vec": {"type": "vector", "dimensionality": 2, "model": "m"}}


def test_catalog_round_trip(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "root"))
    index = c.create_index("my index", SPECS, metadata={"owner": "x"})
    ft, vec = FullTextAccess("text"), VectorAccess("vec")
    ft.get(index).add_document(blocks_of(spark, [("/d/1", "b1", "quick fox"), ("/d/2", "b2", "lazy dog")]))
    ft.get(index).add_document(blocks_of(spark, [("/d/2", "b2", "fox fox")]))
    vec.get(index).add_document(vectors_of(spark, [("/d/1", "b1", [1.0, 0.0]), ("/d/2", "b2", [0.0, 1.0])]))
    request = vec.set_query(ft.set_query(SearchRequest(5), FullTextQuery(["fox"])), VectorQuery([[0.0, 1.0]]))
    before = [tuple(r)[:3] for r in index.search(request).collect()]
    assert before[0][0] == "/d/2" and len(before) == 2
    c.close()
    with pytest.raises(RuntimeError):
        c.get_index("my index")
    with pytest.raises(RuntimeError):
        index.search(request)

    c = Catalog(spark, str(tmp_path / "root"))
    assert c.get_index_names() == ["my index"] and c.get_index("none") is None
    index = c.get_index("my index")
    assert index.metadata == {"owner": "x"}
    results = index.search(request)
    assert [tuple(r)[:3] for r in results.collect()] == before
    assert ft.get_result(results).where("path = '/d/2'").collect()[0]["snippet"] == "fox fox"
    assert index.search(SearchRequest(5)).count() == 0
    assert index.search(ft.set_query(SearchRequest(5, paths=["/d/1"]), FullTextQuery(["fox"]))).count() == 1
    assert ft.get(index).get_size() == 2 and ft.get(index).get_size("/d/1") == 1
    index.delete_documents([PathSelector("/d/2", "b2")])
    assert vec.get(index).get_size() == 1 and [r["path"] for r in ft.get(index).get_document_paths().collect()] == ["/d/1"]
    c.flush()
    assert is_persistable(ft.get(index)) and vec.get(index).get_index_info() == {"dimensionality": 2, "model": "m"}
    index.delete_index()
    assert c.get_index_names() == []


def test_catalog_load_actions(spark, tmp_path):
    root = str(tmp_path / "root")
    c = Catalog(spark, root)
    with pytest.raises(ValueError):
        c.create_index("bad", {"x": {"type": "graph"}})
    index = c.create_index("i", SPECS)
    with pytest.raises(ValueError):
        c.create_index("i")
    index.get_binding("text").add_document(blocks_of(spark, [("/d", "1", "fox")]))
    index.get_binding("vec").add_document(vectors_of(spark, [("/d", "1", [1.0, 0.0])]))
    with pytest.raises(ValueError, match="Expected dimensionality 2, got 3"):
        index.get_binding("vec").add_document(vectors_of(spark, [("/d", "2", [1.0, 0.0]), ("/d", "3", [1.0, 0.0, 0.0])]))
    assert index.get_binding("vec").get_size() == 1  # none of a failing batch lands
    c.close()
    c = Catalog(spark, root)
    index = c.get_index("i", {"text": {"skip": True}, "vec": {"type": "vector", "dimensionality": 3}})
    assert index.get_binding("text") is None and index.get_binding("vec").get_size() == 0
    assert c.get_index("i") is index
    c.close()
    c = Catalog(spark, root)
    assert c.get_index("i").get_binding("text").get_size() == 1  # what was skipped is still there
    c.close()
    c = Catalog(spark, root, {"fulltext": Catalog(spark, root).providers["fulltext"]})
    with pytest.raises(ValueError):
        c.get_index("i")
    assert c.get_index("i", on_missing_provider="warn").get_binding("vec") is None
    c.close()
    assert Catalog(spark, root).get_index("i").get_binding("vec") is not None
    assert Catalog(spark, root).create_index("i", {}, overwrite=True).bindings == {}


def test_access_is_typed():
    params = VectorAccess("v").set_config(FullTextAccess("t").set_config({}, {"language": "en"}), {"dimensionality": 2})
    assert FullTextAccess("t").get_config(params) == {"language": "en"} and FullTextAccess("v").get_config(params) is None


def test_stream_upserts(spark, tmp_path):
    from strataseek.streaming.ingest import stream_into

    c = Catalog(spark, str(tmp_path / "root"))
    c.create_index("s", {"text": SPECS["text"]})
    for i in range(2):
        blocks_of(spark, [("/d", "1", f"version {i}"), ("/d", f"x{i}", "fox")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("path string, block_id string, content string").parquet(str(tmp_path / "in"))
        stream_into(source, c, "s", "text", str(tmp_path / "cp")).awaitTermination()
    got = {r["block_id"]: r["content"] for r in c.get_index("s").get_binding("text").get_documents_blocks().collect()}
    assert got == {"1": "version 1", "x0": "fox", "x1": "fox"}


def test_flush_writes_what_changed(spark, tmp_path):
    root = tmp_path / "root"
    made = lambda: sorted(str(p.relative_to(root)) for p in root.glob("i/*")) + sorted(str(p.relative_to(root)) for p in root.glob("i/*/v*"))
    c = Catalog(spark, str(root))
    index = c.create_index("i", SPECS)
    index.get_binding("text").add_document(blocks_of(spark, [("/d", "1", "fox")]))
    c.flush()
    before = made()
    c.flush()
    c.close()
    c = Catalog(spark, str(root))
    assert c.get_index("i").get_binding("text").search(FullTextQuery(["fox"])).count() == 1
    c.close()
    assert made() == before  # neither a flush nor a close without a change writes
    c = Catalog(spark, str(root))
    for n in range(3):
        c.get_index("i").get_binding("vec").add_document(vectors_of(spark, [("/d", str(n), [1.0, 0.0])]))
        c.flush()
    assert [x for x in made() if "/vec/" in x] == ["i/vec/v3", "i/vec/v4"] and [x for x in made() if "/text/" in x] == ["i/text/v1"]
    assert sum(x.startswith("i/manifest") for x in made()) == 2
    assert c.get_index("i").get_binding("vec").get_size() == 3


def test_a_commit_that_fails_leaves_the_one_before(spark, tmp_path, monkeypatch):
    from strataseek.sources import catalog

    c = Catalog(spark, str(tmp_path / "root"))
    index = c.create_index("i", SPECS)
    index.get_binding("text").add_document(blocks_of(spark, [("/d", "1", "fox")]))
    c.flush()
    index.get_binding("text").add_document(blocks_of(spark, [("/d", "2", "dog")]))

    def crash(self, name, text):
        _, path = self._at(name + ".next")
        path.getFileSystem(self.conf).create(path, True).close()  # written, but not renamed
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(catalog.Files, "create", crash)
        with pytest.raises(OSError):
            c.flush()
    other = Catalog(spark, str(tmp_path / "root"))
    assert [r["block_id"] for r in other.get_index("i").get_binding("text").get_document_blocks_refs().collect()] == ["1"]
    with pytest.raises(FileExistsError):  # a second writer that saw the same manifest
        other.files.create("i/manifest-2.json", "{}")


def test_a_closed_index_is_opened_anew(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "root"))
    index = c.create_index("i", SPECS)
    index.get_binding("text").add_document(blocks_of(spark, [("/d", "1", "fox")]))
    c.flush()
    index.close()
    again = c.get_index("i")
    assert again is not index and again.get_binding("text").search(FullTextQuery(["fox"])).count() == 1


def test_modes_and_depth_of_the_index(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "root"))
    text = c.create_index("i", SPECS).get_binding("text")
    text.add_document(blocks_of(spark, [("/d", "1", "running fox"), ("/d", "2", "fix the runner fox"), ("/d", "3", "fog fog runs")]))
    ids = lambda **x: [r["block_id"] for r in text.search(FullTextQuery(**x)).orderBy(F.desc("score"), "block_id").collect()]
    for _ in range(2):  # from the blocks, then from stored postings
        assert ids(queries=["run"]) == [] and set(ids(queries=["run"], mode="prefix_fuzzy")) == {"1", "2", "3"}
        assert set(ids(queries=["fox"], mode="prefix_fuzzy", fuzzy=None)) == {"1", "2"} and set(ids(queries=["fox"], mode="prefix_fuzzy", fuzzy=0.34)) == {"1", "2", "3"}
        assert ids(queries=["fix fox"], mode="coverage")[0] == "2" and len(ids(queries=["fox", "fog"], mode="coverage", merge="max")) == 3
        assert [r["score"] for r in text.search(FullTextQuery(["fox fix"], mode="decay")).orderBy(F.desc("score")).collect()] == [1.0, 0.5]
        assert ids(queries=["fox", "fog"], depth=1) == ids(queries=["fox", "fog"], top_k=2) and ids(queries=["fox"], top_k=0) == [] == ids(queries=[]) == ids(queries=["--"], mode="prefix_fuzzy")
        assert ids(queries=["fox"], paths=["/e"]) == []
        c.flush()
    with pytest.raises(ValueError):
        ids(queries=["fox"], mode="other")


def test_arrow_sql_metadata_and_helpers(spark, tmp_path):
    from strataseek.sources import catalog

    rows = spark.createDataFrame([("/d", str(i), f"t{i}", '{"a": {"b": %d}}' % i if i else "no json") for i in range(50)], "path string, block_id string, content string, metadata string")
    for folder in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        files = catalog.write_arrow(rows.repartition(3), folder)
        assert len(files) == 3 and sorted(map(tuple, catalog.read_arrow(spark, files, rows._jdf.schema().toDDL()).collect())) == sorted(map(tuple, rows.collect()))
    assert catalog.write_arrow(rows.limit(0), str(tmp_path / "c")) == []
    index = Catalog(spark, str(tmp_path / "root")).create_index("i", {"text": SPECS["text"], "vec": {"type": "vector", "dimensionality": 2}})
    index.get_binding("text").add_document(rows)
    index.get_binding("vec").add_document(spark.createDataFrame([("/d", "1", "[1,0.5]")], "path string, block_id string, embedding string"))
    assert index.get_binding("vec").search(VectorQuery([[1.0, 0.5]])).collect()[0]["score"] == pytest.approx(1)
    client = catalog.SqlClient(spark, index)
    assert client.query("SELECT block_id FROM {text} WHERE content = :c", {"c": "t7"}).collect() == [("7",)]
    got = index.get_binding("text").get_documents_blocks().select("block_id", catalog.metadata_value(F.col("metadata"), "$.a.b").alias("b")).collect()
    assert {r["block_id"]: r["b"] for r in got} == {str(i): str(i) if i else None for i in range(50)}
    request = catalog.sub_query(catalog.sub_query(SearchRequest(3), "text", FullTextQuery, queries=["t1"]), "text", FullTextQuery, top_k=2)
    assert request.sub_queries["text"] == FullTextQuery(["t1"], 2) and catalog.result_of(index.search(request), "text").count() == 1


def test_ragged_and_repeated_rows(spark):
    ragged = vectors_of(spark, [("/d", "1", [1.0, 0.0, 0.0]), ("/d", "2", [1.0] * 5)]).coalesce(1)
    for run in (lambda: vector.search(ragged, [[1.0, 0.0, 0.0, 0.0]]).collect(), lambda: vector.batch_search(ragged, spark.createDataFrame([(1, [1.0, 0.0])], "request_id int, embedding array<float>")).collect()):
        with pytest.raises(Exception, match="Expected dimensionality"):
            run()
    hits = spark.createDataFrame([("/a", "1", 0.9, 1), ("/a", "1", 0.8, 2), ("/b", "1", 0.7, 3)], "path string, block_id string, score double, rank int")
    got = {r["path"]: (round(r["score"], 6), r["sub_results"]["s"]["score"]) for r in fusion.reciprocal_rank_fusion([("s", hits, 1.0)], 5).collect()}
    assert got == {"/a": (round(1 / 61 + 0.05, 6), 0.9), "/b": (round(1 / 62 + 0.02, 6), 0.7)}
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (None, [1.0, 1.0])], "request_id int, embedding array<float>")
    near = vector.batch_search(vectors_of(spark, [("/d", str(i), [1.0, float(i)]) for i in range(5)]), asked, 2).collect()
    assert [(r["request_id"], r["rank"], r["block_id"]) for r in sorted(near)] == [(1, 1, "0"), (1, 2, "1"), (2, 1, "0"), (2, 2, "1")]
    assert vector.batch_search(ragged, asked.limit(0)).count() == 0


def test_a_batch_hands_on_no_more_than_k_of_equal_scores(spark, monkeypatch):
    scores = np.round(np.random.default_rng(1).integers(0, 4, (20, 30)) / 3, 9)
    for k in (0, 1, 5, 29, 30, 40):
        r, c, got = vector._best(scores, k)
        want = [(i, j) for i in range(20) for j in sorted(sorted(range(30), key=lambda j: (-scores[i, j], j))[:k])]
        assert list(zip(r, c)) == want and (got == scores[r, c]).all()
    monkeypatch.setattr(vector, "HELD_SCORES", 70)
    rows = [(f"/{i * 7 % 50:02}", "0", [0.0, 0.0] if i % 2 else [1.0, 0.0]) for i in range(50)]
    asked = spark.createDataFrame([(i, [0.0, 1.0 * (i % 2)]) for i in range(9)], "request_id int, embedding array<float>")
    found = vector.batch_search(vectors_of(spark, rows).coalesce(1), asked, 3)
    assert {(r["request_id"], r["rank"], r["path"]) for r in found.collect()} == {(i, j + 1, f"/{j:02}") for i in range(9) for j in range(3)}
    # scores are compared at 9 decimals, but not rounded
    one = vector.batch_search(vectors_of(spark, [("/a", "0", [1.0, 2.0])]), spark.createDataFrame([(1, [1.0, 0.0])], "request_id int, embedding array<float>"), 1)
    assert abs(one.collect()[0]["score"] - 5**-0.5) < 1e-14


def test_break_points_agree_on_any_white_space(spark):
    text = "a\n\u00a0\nb\n\u2003---\u3000\n1.\u00a0x\n\u0661. y\n\x1c- z\n\x0b\nend"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [(r["position"], r["score"]) for r in chunk.break_points(df, "doc_id").orderBy("position").collect()] == chunk.scan_break_points(text)


def test_no_line_moves_between_tasks(spark, monkeypatch):
    monkeypatch.setattr(chunk, "HELD_PAIRS", 2)
    rows = [(1, "a\nb\n```\nc\n```"), (1, "x\n```"), (None, "# h\n\n- i"), (2, None)]  # keys may repeat: each text is scanned for itself
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    for found, scan in ((chunk.break_points(df, "id"), chunk.scan_break_points), (chunk.code_fences(df, "id"), chunk.find_code_fences)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan
        assert [tuple(r) for r in found.collect()] == [(i, *pair) for i, t in rows for pair in scan(t or "")]


def test_one_tokenisation_for_one_search(blocks):
    found = fulltext.search(fulltext.tables(blocks([("/a", "1", "fox dog"), ("/b", "1", "fox")])), ["fox", "dog"])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.partition("Initial Plan")[0]
    assert final.count("regexp_extract_all") == 1 and "ReusedExchange" in final


def test_one_tokenisation_for_expanded_terms(blocks):
    rows = [("/a", "1", "fox foxes fox box"), ("/a", "1", "fax"), ("/b", "1", "dog"), ("/b", "2", None), ("/c", "1", "--"), ("/c/d", "1", "foxglove dig fix")]
    index = fulltext.tables(blocks(rows))
    stored = fulltext.FullTextTables(index.blocks, fulltext.build_postings(index.blocks), index.stats, index.dfs, stored=True)
    for query, prefix, fuzzy in (("fox dog", True, 0.34), ("fox", True, None), ("fox dig", False, 0.4), ("fox", False, None)):
        for scope in (None, ["/c"]):
            found, want = (fulltext.expanded_search(i, query, 10, prefix, fuzzy, scope) for i in (index, stored))
            a, b = ([(*r[:2], round(r[2], 9)) for r in x.collect()] for x in (found, want))
            assert a == b and (a or scope)
            final = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
            assert final.count("regexp_extract_all") == 1 and "ReusedExchange" in final


def test_postings_by_slices(blocks, monkeypatch):
    monkeypatch.setattr(fulltext, "HELD_TOKENS", 3)
    monkeypatch.setattr(fulltext, "HELD_ROWS", 2)
    b = blocks([("/d", str(i), t) for i, t in enumerate(["b a b", None, "", "c c c c a b d e f", "-", "a"])] + [("/d", "0", "b a b")]).coalesce(1)
    got = [tuple(r) for r in fulltext.build_postings(b).collect()]
    tokens = [(str(i), t.split()) for i, t in ((0, "b a b"), (3, "c c c c a b d e f"), (5, "a"), (0, "b a b"))]
    assert sorted(got) == sorted((w, "/d", i, ts.count(w), len(ts)) for i, ts in tokens for w in set(ts))
    totals = {r["term"]: (r["df"], r["cf"]) for r in fulltext.term_totals(b).collect()}
    assert totals == {w: (sum(w in ts for _, ts in tokens), sum(ts.count(w) for _, ts in tokens)) for _, ts in tokens for w in ts}
    assert "Sort" not in fulltext.build_postings(b)._jdf.queryExecution().executedPlan().toString() and fulltext.build_postings(b)._jdf.queryExecution().executedPlan().toString().count("lambda") == 0


def test_stored_postings_lose_deleted_blocks_without_tokenising(spark, tmp_path):
    rows = [("/a/x", "1", "fox dog"), ("/ab", "1", "fox"), ("/b", "1", "dog dog"), ("/b", "2", "fox fox cat"), ("/c", "1", None)]
    c = Catalog(spark, str(tmp_path / "root"))
    text = c.create_index("i", SPECS).get_binding("text")
    text.add_document(blocks_of(spark, rows))
    assert "Join" not in text.blocks._jdf.queryExecution().executedPlan().toString()  # there is nothing that a first batch replaces
    c.flush()
    text.delete_documents([PathSelector("/a"), PathSelector("/b", "1")])
    assert "MapInArrow" not in text.tables.postings._jdf.queryExecution().executedPlan().toString() and text.tables.stored
    want = fulltext.tables(blocks_of(spark, [r for r in rows if r[:2] not in {("/a/x", "1"), ("/b", "1")}]))
    for _ in range(2):  # before the flush and after
        for name in ("postings", "dfs", "stats"):
            a, b = (getattr(x, name) for x in (text.tables, want))
            assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
        assert {r["path"] for r in text.search(FullTextQuery(["fox dog"])).collect()} == {"/b", "/ab"}
        c.close()
        c = Catalog(spark, str(tmp_path / "root"))
        text = c.get_index("i").get_binding("text")
    text.add_document(blocks_of(spark, [("/ab", "1", "dog")]))
    assert text.search(FullTextQuery(["dog"])).count() == 1


# pipeline


@pytest.fixture
def searched(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "root"))
    index = c.create_index("p", {"text": SPECS["text"]})
    content = blocks_of(spark, [("/a", "1", "fox fox fox"), ("/b", "1", "fox runs far away"), ("/c", "2", "dog")])
    index.get_binding("text").add_document(content)
    build = lambda x: FullTextAccess("text").set_query(SearchRequest(x.top_k, x.paths), FullTextQuery(x.lex_queries))
    return lambda **more: SearchPipeline(index, build, content).set(**more)


def test_pipeline_stages(searched):
    got = searched(prompt="fox", explain=True, reranker=mock_reranker({("/b", "1"): 1.0, ("/a", "1"): 0.0}), citer=mock_citations).execute()
    assert [(e.path, e.block_id) for e in got] == [("/a", "1"), ("/b", "1")]  # equal block ids stay apart
    assert math.isclose(got[0].score, 0.75) and math.isclose(got[1].score, 0.75 / 2 + 0.25)
    assert got[1].citation == Citation(("/b", "1"), "fox runs far away", got[1].score, 'Result for query "fox"')
    assert got[1].explain["rerank_score"] == 1.0 and math.isclose(got[0].explain["retrieval_score"], 1 / 61 + 0.05)


def test_pipeline_errors_are_tolerated(searched):
    seen = []

    def fail(*a, **k):
        raise RuntimeError("no")

    got = searched(prompt="fox", expander=fail, reranker=fail, citer=fail, on_error=lambda stage, e: seen.append(stage)).execute()
    assert seen == ["expand", "rerank", "cite"] and [e.path for e in got] == ["/a", "/b"]
    with pytest.raises(ValueError):
        searched().execute()
    with pytest.raises(ValueError):
        searched(semantic_queries=["x"]).execute()
    assert searched(text_queries=["fox"], top_k=1, paths=["/b"]).execute()[0].path == "/b"


def test_mocks():
    assert [q.type for q in mock_expander("q", "i", 3)] == ["lex", "vec", "hyde"] and len(mock_expander("q", max_variations=1)) == 1
    assert [s.score for s in mock_reranker()("q", [(("/a", "1"), ""), (("/a", "2"), "")], top_k=1)] == [1.0]


def test_registered_upsert_returns_whole_texts(spark, tmp_path):
    from strataseek.plans import queries

    long = "word " * 50 + "end"
    rows = [(1, long, "en", "src1", len(long)), (2, long, "en", "src2", len(long)), (3, long, "en", "src3", len(long))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.QUERIES["upsert_last_wins"](spark, str(tmp_path)).collect()
    assert sorted(r["content"] for r in got) == ["new 0", "newest", long]
