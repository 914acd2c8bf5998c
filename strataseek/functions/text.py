"""Text analysis: tokens of blocks and queries, intent terms, best chunks, query validation."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöøōőŕřśšßťùúûüūůűýÿžźż"

LANGUAGES = {
    "ar": "arabic", "da": "danish", "de": "german", "en": "english", "es": "spanish", "fi": "finnish", "fr": "french", "hu": "hungarian",
    "it": "italian", "nl": "dutch", "no": "norwegian", "pt": "portuguese", "ro": "romanian", "ru": "russian", "sv": "swedish", "tr": "turkish",
}

STOP_WORDS = frozenset(
    """a about above after against an and are as at be been before being below between but by can could
    did do does during for from had has have he how i in into is it its may me might
    must my need nor not of on or our over shall she should so that the these they this those
    through to under was we were what when where which who whom why will with would yet you your""".split()
)
TERM_EDGES = r"[\s,.;:!?()\[\]{}\"']+"


def language_name(language: str) -> str:
    """The full name of an ISO code or full name; 'simple' stands for none. Unknown ones raise."""
    low = language.lower()
    if low == "simple" or low in LANGUAGES.values():
        return low
    if low in LANGUAGES:
        return LANGUAGES[low]
    raise ValueError(f"Unsupported language: {language}")


@dataclass(frozen=True)
class Analyzer:
    """Lower-cased runs of letters and digits, without accents if strip_accents. The language is checked; stemming is not done."""

    language: str = "simple"
    strip_accents: bool = False

    def __post_init__(self) -> None:
        language_name(self.language)

    def column(self, text: Column) -> Column:
        low = F.lower(text)
        if self.strip_accents:
            low = F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), *_accents())
        return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))

    def terms(self, query: str) -> list[str]:
        """The distinct tokens of a query, in order."""
        low = query.lower()
        if self.strip_accents:
            low = low.replace("ß", "ss").translate(str.maketrans(*_accents()))
        return list(dict.fromkeys(re.findall(r"[^\W_]+", low)))


def _accents() -> tuple[str, str]:
    import unicodedata

    signs = [c for c in ACCENTED if unicodedata.normalize("NFD", c)[0] != c]
    return "".join(signs) + "ø", "".join(unicodedata.normalize("NFD", c)[0] for c in signs) + "o"


def intent_terms(text: Column) -> Column:
    """The distinct words of text that aren't stop words, in order."""
    stop = F.array(*[F.lit(w) for w in sorted(STOP_WORDS)])
    return F.array_distinct(F.filter(F.split(F.lower(text), TERM_EDGES), lambda w: (w != "") & ~F.array_contains(stop, w)))


def intent_terms_of(text: str) -> list[str]:
    words = re.split(TERM_EDGES, text.lower())
    return list(dict.fromkeys(w for w in words if w and w not in STOP_WORDS))


def chunk_score(chunk: Column, query_terms: list[str], intent: list[str] = (), intent_weight: float = 0.5) -> Column:
    """How many of the query's terms occur anywhere in the chunk (as parts of words too), and intent terms at their weight."""
    low, out = F.lower(chunk), F.lit(0.0)
    for t, w in [*((t, 1.0) for t in query_terms), *((t, intent_weight) for t in intent)]:
        out = out + F.when(low.contains(t.lower()), w).otherwise(0.0)
    return out


@dataclass(frozen=True)
class ChunkSelection:
    chunk: str
    index: int
    score: float


def select_best_chunk(chunks: list[str], query_terms: list[str], intent: list[str] = (), intent_weight: float = 0.5) -> ChunkSelection | None:
    """The chunk with the highest score; the first of equals; empty chunks are passed over; None if all are."""
    best = None
    for i, c in enumerate(chunks):
        if not c:
            continue
        low = c.lower()
        score = sum(t.lower() in low for t in query_terms) + intent_weight * sum(t.lower() in low for t in intent)
        if best is None or score > best.score:
            best = ChunkSelection(c, i, float(score))
    return best


def lex_query_error(query: Column) -> Column:
    """What is wrong with a lexical query, or null."""
    return F.when(query.contains("\n") | query.contains("\r"), "newline").when(F.regexp_count(query, F.lit('"')) % 2 == 1, "unbalanced quotes")


def semantic_query_error(query: Column) -> Column:
    """What is wrong with a semantic query, or null: it can't exclude words."""
    return F.when(query.rlike(r"(^|\s)-[\w\"]"), "negation")


def validate_lex_query(query: str) -> str | None:
    if "\n" in query or "\r" in query:
        return "A lexical query must be a single line"
    return "A lexical query has an unbalanced double quote" if query.count('"') % 2 else None


def validate_semantic_query(query: str) -> str | None:
    return "A semantic query can't exclude words with -" if re.search(r'(^|\s)-[\w"]', query) else None


@dataclass(frozen=True)
class ParsedQuery:
    type: str
    query: str
    line: int


def parse_structured_query(text: str) -> list[ParsedQuery] | None:
    """Lines 'lex:', 'vec:' and 'hyde:' as queries; None for plain text and for 'expand:' lines. Typed lines beside others, and empty ones, raise."""
    found: list[ParsedQuery] = []
    plain = expand = 0
    for number, line in enumerate(map(str.strip, text.split("\n")), 1):
        kind, colon, rest = line.partition(":")
        if not line:
            continue
        if not colon or kind.lower() not in ("lex", "vec", "hyde", "expand"):
            plain = plain or number
        elif not rest.strip():
            raise ValueError(f"Line {number}: {kind.lower()}: has no text")
        elif kind.lower() == "expand":
            expand = expand or number
        else:
            found.append(ParsedQuery(kind.lower(), rest.strip(), number))
    if found and expand:
        raise ValueError(f"Line {expand}: expand: can't stand beside typed queries")
    if found and plain:
        raise ValueError(f"Line {plain}: has no prefix, but other lines have")
    return found or None
