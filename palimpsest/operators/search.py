"""Search over messages: literal text, dates, and web-search syntax over token arrays."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import literal_match, tokens_simple


def grep(messages: DataFrame, needle: str) -> DataFrame:
    return messages.where(literal_match(F.col("content"), F.lit(needle)))


def between(messages: DataFrame, start: Column, end: Column) -> DataFrame:
    """Half-open [start, end), oldest first."""
    return messages.where((F.col("created_at") >= start) & (F.col("created_at") < end)).orderBy("created_at", "id")


def has_phrase(tokens: Column, words: list[str]) -> Column:
    """All words stand next to each other in this order."""
    if len(words) == 1:
        return F.array_contains(tokens, words[0])
    # tokens hold no spaces, so adjacency is a substring of the joined tokens, made once a row
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {' '.join(words)} ")


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def websearch(query: str, tokens: Column) -> Column:
    """Words are all required, "quoted" ones adjacent; `or` joins its neighbours; -word and -"phrase" exclude.

    A compound word (punctuation inside) is a phrase. A query without words matches nothing.
    """
    groups: list[list[Column]] = [[]]
    pending_or = False
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if not quoted and not minus and bare.lower() == "or":
            pending_or = True
            continue
        words = _words(quoted or bare)
        if not words:
            continue
        test = has_phrase(tokens, words)
        if pending_or and groups[-1]:
            groups.append([])
        pending_or = False
        groups[-1].append(~test if minus else test)
    out = None
    for g in groups:
        if g:
            part = g[0]
            for t in g[1:]:
                part = part & t
            out = part if out is None else out | part
    return F.lit(False) if out is None else out


def search_text(messages: DataFrame, query: str, limit: int) -> DataFrame:
    rows = messages.where(websearch(query, tokens_simple(F.col("content"))))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def any_term(tokens: Column, terms: list[str]) -> Column:
    """At least one of the terms; a compound one as a phrase."""
    out = F.lit(False)
    for t in dict.fromkeys(terms):
        if words := _words(t):
            out = out | has_phrase(tokens, words)
    return out
