"""Markdown chunking: break points, code fences, and cuts near a target size.

Positions count code points. What a line is worth depends on the lines before it in its document alone, so all three are made by Python functions
over Arrow batches, in parallel across documents: no line moves between tasks.
"""

from __future__ import annotations

import bisect
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING_SCORE = {1: 100, 2: 90, 3: 80, 4: 70, 5: 60, 6: 50}
FENCE_SCORE, RULE_SCORE, BLANK_SCORE, LIST_SCORE, LINE_SCORE = 80, 60, 20, 5, 1
RULES = ("---", "___", "***")
HEADING = re.compile(r"(#{1,6}) ")
ITEM = re.compile(r"\d+\.\s|[-*]\s")
#: Pairs that a scan hands on at once.
HELD_PAIRS = 100_000


@dataclass(frozen=True)
class Chunk:
    index: int
    content: str
    start_pos: int
    end_pos: int


def _score(line: str, number: int) -> int | None:
    """What a cut before the line is worth; None for a first line that is nothing."""
    bare = line.strip()
    if not bare and number:
        return BLANK_SCORE
    if bare.startswith("```"):
        return FENCE_SCORE
    if bare in RULES:
        return RULE_SCORE
    if h := HEADING.match(line):
        return HEADING_SCORE[len(h[1])]
    if ITEM.match(bare):
        return LIST_SCORE
    return LINE_SCORE if number else None


def scan_break_points(text: str) -> list[tuple[int, int]]:
    """(position, score) of every line start worth cutting at."""
    out, at = [], 0
    for number, line in enumerate(text.split("\n") if text else []):
        if (s := _score(line, number)) is not None:
            out.append((at, s))
        at += len(line) + 1
    return out


def find_code_fences(text: str) -> list[tuple[int, int]]:
    """(start of the opening line, start of the closing line); a fence left open ends with the text."""
    marks, at = [], 0
    for line in text.split("\n"):
        if line.strip().startswith("```"):
            marks.append(at)
        at += len(line) + 1
    if len(marks) % 2:
        marks.append(len(text))
    return list(zip(marks[::2], marks[1::2]))


def is_inside_code_fence(fences: list[tuple[int, int]], position: int) -> bool:
    return any(a <= position <= b for a, b in fences)


def find_best_cutoff(points: list[tuple[int, int]], fences: list[tuple[int, int]], target: int, window: int, decay: float = 0.5) -> int:
    """The break point in [target - window, target] with the best score after decay by squared distance; the first of equals; -1 if there is none."""
    first = bisect.bisect_left(points, (max(0, target - window), -1))
    last = bisect.bisect_right(points, (target, 1 << 30))
    best, where = float("-inf"), -1
    for position, score in points[first:last]:
        if is_inside_code_fence(fences, position):
            continue
        far = (target - position) / window if window > 0 else 0.0
        worth = score * (1 - far * far * decay)
        if worth > best:
            best, where = worth, position
    return where


def chunk_markdown(text: str, target_chars: int, overlap: int = 0, window_fraction: float = 0.5, decay: float = 0.5) -> list[Chunk]:
    """Chunks of about target_chars that begin overlap characters before the last one's end and never end inside a fence.

    end_pos is at most the text's length. An overlap of target_chars or more advances by one character a chunk, with a warning.
    """
    if target_chars <= 0:
        raise ValueError("target_chars must be positive")
    if overlap >= target_chars:
        warnings.warn("overlap isn't below target_chars", stacklevel=2)
    n = len(text)
    points, fences, window = scan_break_points(text), find_code_fences(text), int(target_chars * window_fraction)
    out: list[Chunk] = []
    start = 0
    while start < n:
        ideal = start + target_chars
        if ideal >= n:
            out.append(Chunk(len(out), text[start:], start, n))
            break
        cut = find_best_cutoff(points, fences, ideal, window, decay)
        if cut <= start:
            cut = ideal
        while cut < n and (held := next((f for f in fences if f[0] <= cut <= f[1]), None)):
            line_end = text.find("\n", held[1])
            cut = n + 1 if line_end < 0 else line_end + 1
        out.append(Chunk(len(out), text[start:cut], start, min(cut, n)))
        start = max(start + 1, cut - overlap)
    return out


def chunk_documents(docs: DataFrame, key: str, target_chars: int, overlap: int = 0, window_fraction: float = 0.5, decay: float = 0.5) -> DataFrame:
    """key, index, content, start_pos, end_pos of every chunk of text. Null and empty texts have none."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, c) for k, t in zip(b.column(key).to_pylist(), b.column("text").to_pylist()) if t for c in chunk_markdown(t, target_chars, overlap, window_fraction, decay)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in rows], b.column(key).type), pa.array([c.index for _, c in rows], pa.int32()), pa.array([c.content for _, c in rows], pa.string()),
                    pa.array([c.start_pos for _, c in rows], pa.int32()), pa.array([c.end_pos for _, c in rows], pa.int32()),
                ],
                names=[key, "index", "content", "start_pos", "end_pos"],
            )

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, index int, content string, start_pos int, end_pos int")


def _scanned(docs: DataFrame, key: str, scan: Callable[[str], list[tuple[int, int]]], first: str, second: str) -> DataFrame:
    """key and the pairs that scan finds in each text, which is read once and in one task. Null and empty texts have none."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows, found = b.column(key), [], []

            def held() -> pa.RecordBatch:
                pairs = [pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)]
                return pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int32())), *pairs], names=[key, first, second])

            for i, t in enumerate(b.column("text")):
                here = scan(t.as_py() or "")
                rows += [i] * len(here)
                found += here
                if len(found) >= HELD_PAIRS:
                    yield held()
                    rows, found = [], []
            yield held()

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, {first} int, {second} int")


def break_points(docs: DataFrame, key: str) -> DataFrame:
    """key, position, score: scan_break_points of every text."""
    return _scanned(docs, key, scan_break_points, "position", "score")


def code_fences(docs: DataFrame, key: str) -> DataFrame:
    """key, start, end: find_code_fences of every text."""
    return _scanned(docs.where(F.col("text").contains("```")), key, find_code_fences, "start", "end")
