"""Search pipeline: expand, embed, search, rerank, cite. Callbacks run on the driver over a few rows; retrieval is one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.functions.paths import KEY
from strataseek.operators.fusion import DEFAULT_BLEND_TIERS, blend_with_reranker
from strataseek.sources.catalog import Index, SearchRequest

Ref = tuple[str, str]


@dataclass(frozen=True)
class ExpandedQuery:
    type: str
    query: str


@dataclass(frozen=True)
class ScoredItem:
    ref: Ref
    score: float


@dataclass(frozen=True)
class Citation:
    ref: Ref
    snippet: str
    relevance: float
    context: str | None = None


@dataclass
class PipelineEntry:
    path: str
    block_id: str
    score: float
    sub_results: dict[str, Any]
    citation: Citation | None = None
    explain: dict[str, Any] | None = None


@dataclass
class Context:
    """What a request is built from."""

    lex_queries: list[str]
    embeddings: list[list[float]]
    paths: list[str] | None
    top_k: int


@dataclass
class SearchPipeline:
    """Callbacks: build_request(Context) -> SearchRequest; expander(prompt, intent, max) -> [ExpandedQuery]; embed(text) -> vector;
    reranker(query, [(ref, text)], top_k) -> [ScoredItem]; citer(query, [ScoredItem], content) -> [Citation]. Blocks are known by
    (path, block_id), so that equal block ids under different paths stay apart. content: a DataFrame with path, block_id, content.
    """

    index: Index
    build_request: Callable[[Context], SearchRequest]
    content: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    expander: Callable[..., list[ExpandedQuery]] | None = None
    reranker: Callable[..., list[ScoredItem]] | None = None
    citer: Callable[..., list[Citation]] | None = None
    on_error: Callable[[str, Exception], None] = lambda stage, error: None
    tiers: Any = DEFAULT_BLEND_TIERS
    prompt: str | None = None
    intent: str | None = None
    text_queries: list[str] = field(default_factory=list)
    semantic_queries: list[str] = field(default_factory=list)
    embeddings: list[list[float]] = field(default_factory=list)
    paths: list[str] | None = None
    top_k: int = 10
    explain: bool = False
    skip: frozenset[str] = frozenset()

    def set(self, **values: Any) -> SearchPipeline:
        """Set any of the fields; returns the pipeline."""
        for k, v in values.items():
            if k not in self.__dataclass_fields__:
                raise AttributeError(k)
            setattr(self, k, v)
        return self

    def execute(self) -> list[PipelineEntry]:
        lex, vec, expanded = list(self.text_queries), list(self.semantic_queries), []
        if self.prompt:
            try:
                if self.expander is not None and "expand" not in self.skip:
                    expanded = list(self.expander(self.prompt, intent=self.intent))
            except Exception as e:  # the prompt itself is searched instead
                self.on_error("expand", e)
            for q in expanded:
                (lex if q.type == "lex" else vec).append(q.query)
            if not expanded:
                lex.append(self.prompt)
                if self.embed is not None:
                    vec.append(self.prompt)
        if not (lex or vec or self.embeddings):
            raise ValueError("There is nothing to search for")
        if vec and self.embed is None:
            raise ValueError("Semantic queries need embed")
        vectors = [*self.embeddings, *(self.embed(v) for v in vec)]
        request = self.build_request(Context(lex, vectors, self.paths, self.top_k))
        query = self.prompt or (lex or vec or [""])[0]
        # a top-k, held by rank, so that the callbacks see what the plan saw
        hits = self.index.search(request).collect()
        entries = [PipelineEntry(r["path"], r["block_id"], r["score"], {k: v.asDict() for k, v in r["sub_results"].items()}) for r in hits]
        first = {(e.path, e.block_id): e.score for e in entries}
        texts = self._texts(entries) if self.content is not None and (self.reranker or self.citer) and entries else {}
        scores: dict[Ref, float] = {}
        if self.reranker is not None and texts and "rerank" not in self.skip:
            try:
                scores = {s.ref: s.score for s in self.reranker(query, [((e.path, e.block_id), texts.get((e.path, e.block_id), "")) for e in entries], top_k=len(entries))}
                entries = self._blend(entries, scores)
            except Exception as e:  # the order stays
                self.on_error("rerank", e)
                scores = {}
        entries = entries[: self.top_k]
        if self.citer is not None and texts and "cite" not in self.skip:
            try:
                made = {c.ref: c for c in self.citer(query, [ScoredItem((e.path, e.block_id), e.score) for e in entries], texts.get)}
                for e in entries:
                    e.citation = made.get((e.path, e.block_id))
            except Exception as e:  # results go without citations
                self.on_error("cite", e)
        if self.explain:
            for e in entries:
                ref = (e.path, e.block_id)
                e.explain = {"expanded_queries": expanded, "retrieval_score": first[ref], "rerank_score": scores.get(ref), "blended_score": e.score}
        return entries

    def _texts(self, entries: list[PipelineEntry]) -> dict[Ref, str]:
        spark = self.content.sparkSession
        keys = spark.createDataFrame([(e.path, e.block_id) for e in entries], "path string, block_id string")
        return {(r["path"], r["block_id"]): r["content"] for r in self.content.join(F.broadcast(keys), KEY).select(*KEY, "content").collect()}

    def _blend(self, entries: list[PipelineEntry], scores: dict[Ref, float]) -> list[PipelineEntry]:
        spark = self.content.sparkSession
        ranked = spark.createDataFrame([(e.path, e.block_id, i) for i, e in enumerate(entries, 1)], "path string, block_id string, rank int")
        given = spark.createDataFrame([(*ref, float(s)) for ref, s in scores.items()], "path string, block_id string, rerank_score double")
        by = {(e.path, e.block_id): e for e in entries}
        out = []
        for r in blend_with_reranker(ranked, given, self.tiers).collect():
            e = by[r["path"], r["block_id"]]
            e.score = r["score"]
            out.append(e)
        return out


def mock_expander(query: str, intent: str | None = None, max_variations: int = 2) -> list[ExpandedQuery]:
    """The query itself, a semantic one from two variations up, and with an intent a made-up answer from three up."""
    out = [ExpandedQuery("lex", query)]
    if max_variations >= 2:
        out.append(ExpandedQuery("vec", f"semantic: {query}"))
    if max_variations >= 3 and intent:
        out.append(ExpandedQuery("hyde", f"Hypothetical answer about {query} in context of {intent}"))
    return out[:max_variations]


def mock_reranker(scores: dict[Ref, float] | None = None) -> Callable[..., list[ScoredItem]]:
    def rerank(query: str, candidates: list[tuple[Ref, str]], top_k: int | None = None) -> list[ScoredItem]:
        out = sorted((ScoredItem(ref, (scores or {}).get(ref, 1 / i)) for i, (ref, _) in enumerate(candidates, 1)), key=lambda s: -s.score)
        return out[:top_k] if top_k else out

    return rerank


def mock_citations(query: str, results: list[ScoredItem], content: Callable[[Ref], str | None], max_citations: int = 3) -> list[Citation]:
    """Citations of the first results, with the first 100 characters of each."""
    return [Citation(r.ref, (content(r.ref) or "")[:100], r.score, f'Result for query "{query}"') for r in results[:max_citations]]
