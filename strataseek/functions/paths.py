"""Path predicates, keys and names."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = ["path", "block_id"]


def prefix_predicate(path: Column, prefix: str) -> Column:
    """Whether path is prefix or lies under it. '/a' takes '/a' and '/a/b', not '/ab'; '/a/' takes what begins so, and itself.

    Written as equality or start, which Parquet scans take over; '%' and '_' have no meaning.
    """
    return (path == prefix) | path.startswith(prefix if prefix.endswith("/") else prefix + "/")


def any_prefix(path: Column, prefixes: Iterable[str] | None) -> Column | None:
    """prefix_predicate for any of prefixes; None (no restriction) if there are none."""
    each = [prefix_predicate(path, p) for p in prefixes or ()]
    return functools.reduce(operator.or_, each) if each else None


def matches_prefix(path: str, prefix: str) -> bool:
    """prefix_predicate for strings."""
    return path == prefix or path.startswith(prefix if prefix.endswith("/") else prefix + "/")


def escape_like(text: Column) -> Column:
    """text with the signs that LIKE reads as wildcards, and the backslash, escaped."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def composite_key(path: Column, block_id: Column) -> Column:
    """One string for both; the path's length in front keeps any two keys apart."""
    return F.concat(F.length(path).cast("string"), F.lit(":"), path, F.lit("|"), block_id)


def safe_name(name: str) -> str:
    """name with everything but ASCII letters and digits as _code_, for directories."""
    return re.sub(r"[^a-zA-Z0-9]", lambda m: f"_{ord(m[0])}_", name)
