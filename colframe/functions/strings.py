"""String matching, and functions of strings beyond it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col

MATCHES = ("starts_with", "ends_with", "match_substring", "match_substring_regex")


def match(name: str, x: Any, pattern: str) -> Column:
    """Whether a string starts or ends with a text, holds it, or holds a match of a regular expression; null gives null."""
    if not isinstance(pattern, str):
        raise ValueError("the pattern must be a string")
    x = col(x)
    if name == "starts_with":
        return x.startswith(pattern)
    if name == "ends_with":
        return x.endswith(pattern)
    if name == "match_substring":
        return x.contains(pattern)
    if name == "match_substring_regex":
        return x.rlike(pattern)
    raise ValueError(f"unknown match function {name!r}; known: {', '.join(MATCHES)}")


def apply(name: str, x: Any, *args: Any) -> Column:
    """lower, upper, length (characters), strip, replace (all occurrences of a text) or slice (0-based start, length)."""
    x = col(x)
    if name in ("lower", "upper", "length"):
        return getattr(F, name)(x)
    if name == "strip":
        return F.trim(x)
    if name == "replace":
        return F.replace(x, F.lit(args[0]), F.lit(args[1]))
    if name == "slice":
        return F.substring(x, args[0] + 1, args[1])
    raise ValueError(f"unknown string function {name!r}")
