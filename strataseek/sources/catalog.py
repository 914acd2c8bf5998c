"""Indexes on storage: a catalog of named indexes, each with named sub-indexes, as Parquet versions under manifests.

<root>/<index>/manifest-<m>.json lists the sub-indexes with type, config and current version; <root>/<index>/<sub>/v<n>/ holds the tables
of version n. A flush writes the next version of what changed beside the current one and then the manifest of the next number, under another name first: its rename is the
commit, and at every moment the manifest with the largest number is whole. A reader keeps the version it opened; the last KEPT versions and manifests stay. A sub-index
that isn't opened, or didn't change, is left in place, manifest entry and all.
"""

from __future__ import annotations

import functools
import json
import re
import threading
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any, Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataseek.functions.paths import KEY, any_prefix, safe_name
from strataseek.functions.text import Analyzer, language_name
from strataseek.operators import fulltext, fusion, vector
from strataseek.operators.mutation import delete, last_wins, upsert

FULL_TEXT_TYPE, VECTOR_TYPE = "fulltext", "vector"
FORMAT_VERSION = 1
#: Versions of a sub-index, and manifests, that stay.
KEPT = 2
FULL_TEXT_MODES = ("bm25", "prefix_fuzzy", "coverage", "decay")


@dataclass
class SearchRequest:
    """sub_queries: by sub-index name. paths: for the sub-queries that name none."""

    top_k: int = 10
    paths: list[str] | None = None
    sub_queries: dict[str, Any] = field(default_factory=dict)


@dataclass
class FullTextQuery:
    """mode: one of FULL_TEXT_MODES. depth: each query's hits are cut to so many before several are merged. prefix, fuzzy: of the mode prefix_fuzzy."""

    queries: list[str]
    top_k: int | None = None
    paths: list[str] | None = None
    merge: str = "sum"
    mode: str = "bm25"
    depth: int | None = None
    prefix: bool = True
    fuzzy: float | None = 0.2


@dataclass
class VectorQuery:
    embeddings: list[list[float]]
    top_k: int | None = None
    paths: list[str] | None = None


@dataclass(frozen=True)
class PathSelector:
    """One block, or with no block_id all under a path."""

    path: str
    block_id: str | None = None


@runtime_checkable
class Persistable(Protocol):
    def serialise(self) -> Iterator[tuple[str, DataFrame]]: ...

    def load_from(self, entries: dict[str, DataFrame]) -> None: ...


def is_persistable(index: object) -> bool:
    return isinstance(index, Persistable)


class Files:
    """Small files under a URI by the session's Hadoop file system, so that any storage Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.conf), path

    def read(self, name: str) -> str | None:
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A file that isn't there yet: written under another name, then renamed, so that it is seen whole or not at all."""
        fs, path = self._at(name)
        _, fresh = self._at(name + ".next")
        stream = fs.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.exists(path) or not fs.rename(fresh, path):
            raise FileExistsError(f"{name} exists: another writer has committed")

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def folders(self, name: str = "") -> list[str]:
        fs, path = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def files(self, name: str) -> list[str]:
        fs, path = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isFile()) if fs.exists(path) else []


class SubIndex:
    """Blocks of one modality. add, delete and enumerate are the same for all; search is the modality's."""

    type = ""
    content = ""

    def __init__(self, spark: SparkSession, config: dict[str, Any]):
        self.spark, self.config, self.closed, self.dirty = spark, config, False, True
        self.lock = threading.RLock()
        #: Whether the blocks differ from the committed version's.
        self.unsaved = True
        #: Whether there are no blocks yet, so that the first batch replaces none.
        self.fresh = True
        self.blocks = spark.createDataFrame([], self.schema())

    def schema(self) -> str:
        return f"path string, block_id string, {self.content}, metadata string"

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("The sub-index is closed")

    def add_document(self, blocks: DataFrame) -> None:
        """Upsert blocks; of equal keys in one batch the last by seq wins (any, if there is no seq column)."""
        self._open()
        blocks = self.check(blocks)
        names = [x.split()[0] for x in self.schema().split(", ")]
        fresh = blocks if "metadata" in blocks.columns else blocks.withColumn("metadata", F.lit(None).cast("string"))
        fresh = last_wins(fresh, "seq") if "seq" in fresh.columns else fresh.dropDuplicates(KEY)
        with self.lock:
            self.blocks = fresh.select(*names) if self.fresh else upsert(self.blocks, fresh.select(*names))
            self.fresh = False
            self.dirty = self.unsaved = True

    def add_documents(self, batches: Iterable[DataFrame]) -> None:
        for b in batches:
            self.add_document(b)

    def delete_documents(self, selectors: Iterable[PathSelector]) -> None:
        self._open()
        with self.lock:
            self.blocks = delete(self.blocks, [(s.path, s.block_id) for s in selectors])
            self.dirty = self.unsaved = True

    def check(self, blocks: DataFrame) -> DataFrame:
        return blocks

    def _under(self, prefix: str | None) -> DataFrame:
        self._open()
        return self.blocks if prefix is None else self.blocks.where(any_prefix(F.col("path"), [prefix]))

    def get_size(self, prefix: str | None = None) -> int:
        return self._under(prefix).count()

    def get_document_paths(self, prefix: str | None = None) -> DataFrame:
        return self._under(prefix).select("path").distinct()

    def get_document_blocks_refs(self, prefix: str | None = None) -> DataFrame:
        return self._under(prefix).select(*KEY)

    def get_documents_blocks(self, prefix: str | None = None) -> DataFrame:
        return self._under(prefix)

    def get_index_info(self) -> dict[str, Any]:
        return dict(self.config)

    def prepare(self) -> None: ...

    def flush(self) -> None:
        self._open()
        self.prepare()

    def close(self) -> None:
        self.closed = True

    def serialise(self) -> Iterator[tuple[str, DataFrame]]:
        yield "blocks", self.blocks

    def load_from(self, entries: dict[str, DataFrame]) -> None:
        self.blocks, self.dirty, self.unsaved, self.fresh = entries["blocks"], True, False, False

    def search(self, query: Any, default_paths: list[str] | None = None) -> DataFrame:
        raise NotImplementedError


class FullTextIndex(SubIndex):
    type, content = FULL_TEXT_TYPE, "content string"

    def __init__(self, spark: SparkSession, config: dict[str, Any]):
        language_name(config.get("language", "simple"))
        super().__init__(spark, config)
        self.analyzer = Analyzer(config.get("language", "simple"), bool(config.get("strip_accents")))
        self.tables: fulltext.FullTextTables | None = None

    def prepare(self) -> None:
        if self.dirty or self.tables is None:
            self.tables = fulltext.tables(self.blocks, self.analyzer)
            self.dirty = False

    def delete_documents(self, selectors: Iterable[PathSelector]) -> None:
        """Stored postings only lose the blocks' rows: no text is tokenised again, and what is sorted stays so."""
        chosen = list(selectors)
        with self.lock:
            held = None if self.dirty else self.tables
            super().delete_documents(chosen)
            if held is not None and held.stored:
                postings = delete(held.postings, [(s.path, s.block_id) for s in chosen])
                self.tables = fulltext.FullTextTables(self.blocks, postings, fulltext.corpus_stats(self.blocks, self.analyzer), fulltext.document_frequencies(postings), stored=True)
                self.dirty = False

    def serialise(self) -> Iterator[tuple[str, DataFrame]]:
        self.prepare()
        made = self.tables
        stored = yield "blocks", self.blocks
        if stored is not None:  # the blocks are read as stored from here on, not computed again
            postings = made.postings if made.stored else fulltext.build_postings(stored, self.analyzer)
            made = fulltext.FullTextTables(stored, postings, fulltext.corpus_stats(stored, self.analyzer), made.dfs, made.stored)
        # sorted by term: a search reads the row groups of its terms alone. A frequent term's postings are cut by path.
        placed = made.postings if made.stored else made.postings.repartitionByRange("term", *KEY)
        stored = yield "postings", placed.sortWithinPartitions("term", *KEY)
        dfs = made.dfs if stored is None else fulltext.document_frequencies(stored)
        yield "dfs", dfs.sortWithinPartitions("term")
        yield "stats", made.stats

    def load_from(self, entries: dict[str, DataFrame]) -> None:
        self.blocks, self.unsaved, self.fresh = entries["blocks"], False, False
        self.dirty = not {"postings", "stats", "dfs"} <= entries.keys()
        self.tables = None if self.dirty else fulltext.FullTextTables(self.blocks, entries["postings"], entries["stats"], entries["dfs"], stored=True)

    def search(self, query: FullTextQuery, default_paths: list[str] | None = None) -> DataFrame:
        """The modes but bm25 take one query at a time; several are merged as those of bm25 are."""
        self._open()
        self.prepare()
        k, paths = fulltext.DEFAULT_DEPTH if query.top_k is None else query.top_k, query.paths or default_paths
        if query.mode not in FULL_TEXT_MODES:
            raise ValueError(f"Unknown mode: {query.mode}")
        if query.mode == "bm25":
            hits = fulltext.search(self.tables, query.queries, k, query.merge, paths, self.analyzer, query.depth)
        else:
            depth = max(k, fulltext.DEFAULT_DEPTH) if query.depth is None else query.depth
            if query.mode == "prefix_fuzzy":
                each = [fulltext.expanded_search(self.tables, q, depth, query.prefix, query.fuzzy, paths, self.analyzer) for q in query.queries]
            else:
                one = fulltext.coverage_search if query.mode == "coverage" else fulltext.decayed_search
                each = [one(self.tables, q, depth, paths, self.analyzer) for q in query.queries]
            if not each:
                return fulltext.with_snippets(fulltext.search(self.tables, [], k), self.blocks)
            hits = fusion.top_k(each[0] if len(each) == 1 else fulltext.merged(functools.reduce(DataFrame.unionByName, each), query.merge), k)
        return fulltext.with_snippets(hits, self.blocks)


class VectorIndex(SubIndex):
    type, content = VECTOR_TYPE, "embedding array<float>"

    def check(self, blocks: DataFrame) -> DataFrame:
        """The whole batch is checked before any of it lands. Embeddings may come as text."""
        d = self.config["dimensionality"]
        if dict(blocks.dtypes)["embedding"] == "string":
            blocks = blocks.withColumn("embedding", vector.decode_embedding(F.col("embedding")))
        wrong = blocks.where(F.coalesce(F.size("embedding"), F.lit(-1)) != d).select(F.size("embedding").alias("n")).take(1)
        if wrong:
            raise ValueError(f"Expected dimensionality {d}, got {wrong[0]['n']}")
        return blocks

    def search(self, query: VectorQuery, default_paths: list[str] | None = None) -> DataFrame:
        self._open()
        for e in query.embeddings:
            vector.check_dimension(e, self.config["dimensionality"])
        return vector.search(self.blocks, query.embeddings, vector.DEFAULT_DEPTH if query.top_k is None else query.top_k, query.paths or default_paths)


PROVIDERS: dict[str, type[SubIndex]] = {FULL_TEXT_TYPE: FullTextIndex, VECTOR_TYPE: VectorIndex}


class Index:
    """Named sub-indexes, searched together and fused by reciprocal ranks."""

    def __init__(self, name: str, metadata: Any = None, catalog: Catalog | None = None):
        self.name, self.metadata, self.catalog = name, metadata, catalog
        self.bindings: dict[str, SubIndex] = {}
        self.closed = False

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError(f"Index {self.name} is closed")

    def set_binding(self, name: str, index: SubIndex) -> None:
        self._open()
        self.bindings[name] = index

    def get_binding(self, name: str) -> SubIndex | None:
        return self.bindings.get(name)

    def get_bindings(self) -> Iterator[tuple[str, SubIndex]]:
        return iter(self.bindings.items())

    def search(self, request: SearchRequest) -> DataFrame:
        """path, block_id, score, sub_results of the request's top_k; only sub-indexes with a sub-query run."""
        self._open()
        streams = []
        for name, index in self.bindings.items():
            query = request.sub_queries.get(name)
            if query is None:
                continue
            hits = index.search(query, request.paths)
            streams.append((name, hits.withColumn("rank", F.row_number().over(Window.orderBy(*fusion.by_score()))), 1.0))  # a top-k
        if not streams:
            spark = self.catalog.spark if self.catalog is not None else SparkSession.getActiveSession()
            return spark.createDataFrame([], "path string, block_id string, score double, sub_results map<string, struct<score: double, snippet: string>>")
        return fusion.reciprocal_rank_fusion(streams, request.top_k)

    def delete_documents(self, selectors: Iterable[PathSelector]) -> None:
        self._open()
        chosen = list(selectors)
        for index in self.bindings.values():
            index.delete_documents(chosen)

    def flush(self) -> None:
        self._open()
        for index in self.bindings.values():
            index.flush()

    def close(self) -> None:
        if not self.closed:
            for index in self.bindings.values():
                index.close()
            self.closed = True
            if self.catalog is not None:
                self.catalog.forget(self)

    def delete_index(self) -> None:
        if self.catalog is not None:
            self.catalog.delete_index(self.name)
        self.close()


class Catalog:
    """The indexes under a root. Changes are serialised by a lock; flush() commits what changed in the open indexes. An index that is closed without it keeps what was committed."""

    def __init__(self, spark: SparkSession, root: str, providers: dict[str, type[SubIndex]] | None = None):
        self.spark, self.root, self.providers = spark, root.rstrip("/"), dict(providers or PROVIDERS)
        self.files, self.lock, self.open, self.closed = Files(spark, root), threading.RLock(), {}, False

    def _live(self) -> None:
        if self.closed:
            raise RuntimeError("The catalog is closed")

    def _manifest(self, name: str) -> dict | None:
        number = self._number(name)
        text = self.files.read(f"{safe_name(name)}/manifest-{number}.json") if number else None
        if text is None:
            return None
        found = json.loads(text)
        if found.get("format_version") != FORMAT_VERSION:
            raise ValueError(f"Index {name} has format {found.get('format_version')}; this is format {FORMAT_VERSION}")
        return found

    def _numbers(self, folder: str) -> list[int]:
        return sorted(int(m[1]) for f in self.files.files(folder) if (m := re.fullmatch(r"manifest-(\d+)\.json", f)))

    def _number(self, name: str) -> int:
        """The number of the manifest that counts, 0 if there is none."""
        return max(self._numbers(safe_name(name)), default=0)

    def _commit(self, name: str, manifest: dict) -> None:
        number = self._number(name) + 1
        self.files.create(f"{safe_name(name)}/manifest-{number}.json", json.dumps(manifest | {"name": name, "format_version": FORMAT_VERSION}))
        # what no kept manifest needs goes; a failure here loses nothing
        for old in self._numbers(safe_name(name)):
            if old <= number - KEPT:
                self.files.delete(f"{safe_name(name)}/manifest-{old}.json")
        for sub, held in manifest["sub_indexes"].items():
            for folder in self.files.folders(f"{safe_name(name)}/{safe_name(sub)}"):
                if re.fullmatch(r"v\d+", folder) and int(folder[1:]) <= held["version"] - KEPT:
                    self.files.delete(f"{safe_name(name)}/{safe_name(sub)}/{folder}")

    def get_index_names(self) -> list[str]:
        self._live()
        found = [json.loads(self.files.read(f"{d}/manifest-{n[-1]}.json"))["name"] for d in self.files.folders() if (n := self._numbers(d))]
        return sorted({*found, *self.open})

    def forget(self, index: Index) -> None:
        """An index that was closed is opened anew by the next get_index."""
        with self.lock:
            if self.open.get(index.name) is index:
                del self.open[index.name]

    def has_index(self, name: str) -> bool:
        self._live()
        return name in self.open or self._manifest(name) is not None

    def create_index(self, name: str, sub_indexes: dict[str, dict[str, Any]] | None = None, metadata: Any = None, overwrite: bool = False) -> Index:
        """sub_indexes: by name, a config with its type."""
        with self.lock:
            self._live()
            if self.has_index(name):
                if not overwrite:
                    raise ValueError(f"Index {name} exists")
                self.delete_index(name)
            index = Index(name, metadata, self)
            for sub, spec in (sub_indexes or {}).items():
                index.set_binding(sub, self._make(spec))
            self.open[name] = index
            self._commit(name, {"metadata": metadata, "sub_indexes": {sub: {"spec": spec, "version": 0, "entries": []} for sub, spec in (sub_indexes or {}).items()}})
            return index

    def _make(self, spec: dict[str, Any]) -> SubIndex:
        provider = self.providers.get(spec["type"])
        if provider is None:
            raise ValueError(f"No provider for type {spec['type']}")
        return provider(self.spark, {k: v for k, v in spec.items() if k != "type"})

    def get_index(self, name: str, sub_indexes: dict[str, dict[str, Any]] | None = None, on_missing_provider: str = "throw") -> Index | None:
        """An index by name; None if there is none. sub_indexes: load actions by name, {'skip': True} or a spec to begin anew with;
        the rest is adopted as it is. An index that is open already is returned as it is, whatever the actions."""
        with self.lock:
            self._live()
            if name in self.open:
                return self.open[name]
            manifest = self._manifest(name)
            if manifest is None:
                return None
            index = Index(name, manifest.get("metadata"), self)
            for sub, held in manifest["sub_indexes"].items():
                action = (sub_indexes or {}).get(sub)
                if action and action.get("skip"):
                    continue
                spec = action or held["spec"]
                if spec["type"] not in self.providers:
                    if on_missing_provider == "throw":
                        raise ValueError(f"No provider for type {spec['type']}")
                    continue
                made = self._make(spec)
                if not action and held["version"]:
                    made.load_from({e: self.spark.read.parquet(f"{self.root}/{safe_name(name)}/{safe_name(sub)}/v{held['version']}/{e}") for e in held["entries"]})
                index.set_binding(sub, made)
            for sub, spec in (sub_indexes or {}).items():
                if sub not in manifest["sub_indexes"] and not spec.get("skip"):
                    index.set_binding(sub, self._make(spec))
            self.open[name] = index
            return index

    def delete_index(self, name: str) -> None:
        with self.lock:
            self._live()
            index = self.open.pop(name, None)
            if index is not None:
                index.close()
            self.files.delete(safe_name(name))

    def flush(self, names: Iterable[str] | None = None) -> None:
        """Write and commit the next version of every sub-index that changed, of the open indexes (or those named); the rest keeps its entry. Nothing changed, nothing is written."""
        with self.lock:
            self._live()
            for name, index in [(n, i) for n, i in self.open.items() if names is None or n in set(names)]:
                manifest = self._manifest(name) or {"sub_indexes": {}}
                before = json.dumps(manifest, sort_keys=True)
                manifest["metadata"] = index.metadata
                for sub, made in index.get_bindings():
                    held = manifest["sub_indexes"].get(sub, {"version": 0, "entries": []})
                    if not getattr(made, "unsaved", True):
                        continue
                    version, entries = held["version"] + 1, []
                    base = f"{self.root}/{safe_name(name)}/{safe_name(sub)}/v{version}"
                    parts = made.serialise()
                    part = next(parts, None)
                    while part is not None:
                        entry, table = part
                        table.write.mode("overwrite").parquet(f"{base}/{entry}")
                        entries.append(entry)
                        # a generator gets each table back as it is stored, to go on from there
                        try:
                            part = parts.send(self.spark.read.parquet(f"{base}/{entry}")) if hasattr(parts, "send") else next(parts, None)
                        except StopIteration:
                            part = None
                    made.load_from({e: self.spark.read.parquet(f"{base}/{e}") for e in entries})
                    manifest["sub_indexes"][sub] = {"spec": {"type": made.type, **made.config}, "version": version, "entries": entries}
                if json.dumps(manifest, sort_keys=True) != before:
                    self._commit(name, manifest)

    def close(self) -> None:
        with self.lock:
            if not self.closed:
                self.flush()
                for index in list(self.open.values()):
                    index.close()
                self.open, self.closed = {}, True


def metadata_value(metadata: Column, path: str) -> Column:
    """A value of the JSON metadata of a block, by a path such as $.owner.name; null where the text isn't JSON or has no such value."""
    return F.get_json_object(metadata, path)


class SqlClient:
    """SQL over the blocks of an open index: each sub-index is a view by its name, for this client's queries alone."""

    def __init__(self, spark: SparkSession, index: Index):
        self.spark, self.index = spark, index

    def query(self, sql: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The rows of a query. {name} stands for the blocks of sub-index name, :x for the parameter x."""
        return self.spark.sql(sql, args=params, **{name: held.get_documents_blocks() for name, held in self.index.get_bindings()})


def sub_query(request: SearchRequest, name: str, make: type, **fields: Any) -> SearchRequest:
    """The request with a sub-query for a sub-index that it may have already, its fields replaced."""
    held = request.sub_queries.get(name)
    request.sub_queries[name] = make(**fields) if held is None else replace(held, **fields)
    return request


def result_of(results: DataFrame, name: str) -> DataFrame:
    """path, block_id, score, snippet of a sub-index's own hits among results."""
    own = F.col("sub_results").getItem(name)
    return results.where(own.isNotNull()).select(*KEY, own["score"].alias("score"), own["snippet"].alias("snippet"))


def write_arrow(blocks: DataFrame, folder: str) -> list[str]:
    """Blocks as Arrow IPC streams, a file for each partition; their paths. folder: a URI or path that pyarrow.fs opens, on storage that all executors share."""
    schema = blocks.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _opened(f"{folder.rstrip('/')}/part-{uuid.uuid4().hex}.arrow")
        writer = None
        for batch in batches:
            if writer is None:
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                sink = system.open_output_stream(inner)
                writer = pa.ipc.new_stream(sink, batch.schema)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([inner if "://" not in folder else f"{folder.rstrip('/')}/{inner.rpartition('/')[2]}"])], names=["file"])

    return sorted(r["file"] for r in blocks.select(*schema.names).mapInArrow(run, "file string").collect())  # a path for each partition


def read_arrow(spark: SparkSession, files: list[str], schema: str) -> DataFrame:
    """The rows of Arrow IPC streams, a task for each file, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("file").to_pylist():
                system, inner = _opened(path)
                with system.open_input_stream(inner) as source, pa.ipc.open_stream(source) as reader:
                    yield from reader

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files))).mapInArrow(run, schema)


def _opened(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class FullTextAccess:
    """Typed access to one full-text sub-index by name."""

    type: str = FULL_TEXT_TYPE

    def __init__(self, name: str):
        self.name = name

    def try_get(self, index: Index) -> SubIndex | None:
        found = index.get_binding(self.name)
        return found if found is not None and found.type == self.type else None

    def get(self, index: Index) -> SubIndex:
        found = self.try_get(index)
        if found is None:
            raise KeyError(f"No {self.type} sub-index {self.name}")
        return found

    def set_config(self, params: dict[str, Any], config: dict[str, Any]) -> dict[str, Any]:
        params.setdefault("sub_indexes", {})[self.name] = {"type": self.type, **config}
        return params

    def get_config(self, params: dict[str, Any]) -> dict[str, Any] | None:
        spec = (params.get("sub_indexes") or {}).get(self.name)
        return {k: v for k, v in spec.items() if k != "type"} if spec and spec["type"] == self.type else None

    def set_query(self, request: SearchRequest, query: Any) -> SearchRequest:
        request.sub_queries[self.name] = query
        return request

    def get_query(self, request: SearchRequest) -> Any:
        return request.sub_queries.get(self.name)

    def get_result(self, results: DataFrame) -> DataFrame:
        """path, block_id, score, snippet of this sub-index's own hits among results."""
        return result_of(results, self.name)


class VectorAccess(FullTextAccess):
    type = VECTOR_TYPE
