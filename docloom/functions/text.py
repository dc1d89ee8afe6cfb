"""Text expressions whose results equal those of Unicode-aware string handling."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def u(pattern: str) -> str:
    """The pattern with Unicode classes."""
    return "(?U)" + pattern


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """Without the last extension; a name that begins with its only dot has none."""
    return F.regexp_replace(name, r"(?s)(?<=[^.])\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?s)[^.](\.[^.]*)$", 1))


def first_match(c: Column, patterns: Sequence[str]) -> Column:
    """The text of the first pattern, in their order, that is found; else null."""
    return F.coalesce(*(blank_to_null(F.regexp_extract(c, u(p), 0)) for p in patterns))


def first_label(c: Column, labels: Mapping[str, Sequence[str]], ignore_case: bool = False) -> Column:
    """The first label one of whose patterns is found; else null. Plain words need no regular expression."""
    out: Column | None = None
    for label, patterns in labels.items():
        if ignore_case or any(re.escape(p) != p for p in patterns):
            hit = c.rlike(("(?iU)" if ignore_case else "(?U)") + "|".join(f"(?:{p})" for p in patterns))
        else:
            hit = contains_any(c, patterns)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def strings(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def joined(separator: str, parts: Sequence[Column]) -> Column:
    """Parts that are neither null nor empty."""
    return F.concat_ws(separator, *map(blank_to_null, parts))


def cut(c: Column, n: int, mark: str = "...") -> Column:
    """The first n characters, and a mark if there were more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)
