"""Analyzers: text columns to arrays of terms, and the same for query strings on the driver."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
_token = regex.compile(TOKEN)
ANALYZERS = ("standard", "whitespace", "keyword")


def tokens(text: Column, analyzer: str = "standard") -> Column:
    """Terms of a text in order; empty for null."""
    if analyzer == "standard":
        found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    elif analyzer == "whitespace":
        found = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    elif analyzer == "keyword":
        found = F.array(text)
    else:
        raise ValueError(f"unknown analyzer [{analyzer}]")
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(found)


def analyze(text: str, analyzer: str = "standard") -> list[str]:
    """The same for a query string."""
    if analyzer == "standard":
        return _token.findall(text.lower())
    if analyzer == "whitespace":
        return text.split()
    if analyzer == "keyword":
        return [text]
    raise ValueError(f"unknown analyzer [{analyzer}]")


def term_frequency(terms: Column, term: Column) -> Column:
    return F.size(F.filter(terms, lambda t: t == term))


def term_positions(terms: Column, term: Column) -> Column:
    """Places of a term counted from 1."""
    placed = F.transform(terms, lambda t, i: F.when(t == term, i + 1))
    return F.filter(placed, lambda p: p.isNotNull())
