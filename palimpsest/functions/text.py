"""Normalisation, analysis and formatting of text, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that normalisation trims, and those that Unicode stripping takes as white space.
NORM_TRIM = " \t\n\r\f\x0b"
STRIP = r"[\u0009-\u000D\u001C-\u0020\u1680\u2000-\u2006\u2008-\u200A\u2028-\u2029\u205F\u3000]"
CJK = r"\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}"


def normalize(content: Column) -> Column:
    """Trim the fixed set at both ends and lower; inner white space stays."""
    return F.lower(F.btrim(content, F.lit(NORM_TRIM)))


def strip(content: Column) -> Column:
    return F.regexp_replace(content, f"^{STRIP}+|{STRIP}+$", "")


def content_hash(content: Column) -> Column:
    return F.sha2(normalize(content), 256)


def entity_norm(name: Column) -> Column:
    """Strip, lower, and make each run of ASCII white space one space; null is empty."""
    return F.coalesce(F.regexp_replace(F.lower(strip(name)), r"[ \t\n\x0B\f\r]+", " "), F.lit(""))


def tokens_simple(text: Column) -> Column:
    """Lower-cased runs of letters and numbers."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def tokens_english(text: Column) -> Column:
    """Lower-cased words; an apostrophe, and a point or comma between digits, may join; no stop words, no stems."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+(?:(?:(?<=\p{L})['’.](?=\p{L})|(?<=\p{N})[.,](?=\p{N}))[\p{L}\p{N}_]+)*)"), 1)


def tokens_bigram(text: Column) -> Column:
    """Overlapping pairs of each run of Han, Hangul or Kana (a single one stays); other runs of letters and digits whole."""
    runs = F.regexp_extract_all(normalize(F.coalesce(text, F.lit(""))), F.lit(rf"([{CJK}]+|[\p{{L}}\p{{Nd}}&&[^{CJK}]]+)"), 1)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]") & (F.length(r) > 1), pairs(r)).otherwise(F.array(r))))


def bigram_tokens(text: str) -> list[str]:
    """tokens_bigram for single texts in Python."""
    import regex

    out: list[str] = []
    for run in regex.findall(r"[\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}]+|[[\p{L}\p{Nd}]--[\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}]]+", text.strip(" \t\n\r\f\x0b").lower(), regex.V1):
        if len(run) > 1 and regex.match(r"[\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}]", run):
            out += [run[i : i + 2] for i in range(len(run) - 1)]
        else:
            out.append(run)
    return out


Analyzer = Callable[[Column], Column]
_analyzers: dict[str, Analyzer] = {"en": tokens_english}


def register_analyzer(language: str, analyzer: Analyzer) -> None:
    """Plug in an analyzer, such as a morphological one for a language that has none here."""
    _analyzers[language] = analyzer


def analyzer_for(language: str | None) -> Analyzer:
    """By the language's prefix; bigrams where none is registered."""
    return next((a for prefix, a in _analyzers.items() if (language or "").lower().startswith(prefix)), tokens_bigram)


def analyzed(text: Column, analyzer: Analyzer = tokens_bigram) -> Column:
    return F.array_join(analyzer(text), " ")


def analyzed_tokens(content_analyzed: Column) -> Column:
    return F.filter(F.split(F.coalesce(content_analyzed, F.lit("")), r"\s+"), lambda t: t != "")


def information_score(tokens: Column, distinct_weight: int = 1) -> Column:
    return F.size(tokens) + distinct_weight * F.size(F.array_distinct(tokens))


def encode_segment(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))


def decode_segment(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))


def key_of(*segments: Column) -> Column:
    """Segments joined by colons, each escaped: three make a pair key, five a work-unit key."""
    return F.concat_ws(":", *[encode_segment(F.coalesce(s, F.lit(""))) for s in segments])


def key_segment(key: Column, i: int) -> Column:
    return decode_segment(F.element_at(F.split(key, ":", -1), i + 1))


def format_message(peer: Column, content: Column, created_at: Column) -> Column:
    return F.concat(F.date_format(created_at, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), peer, F.lit(": "), content)


def parse_instant(text: Column, fallback: Column) -> Column:
    """An ISO instant, else a date at midnight UTC, else the fallback."""
    instant = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))
    date = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return F.coalesce(instant, date, fallback)


def literal_match(content: Column, needle: Column) -> Column:
    """Case-insensitive substring; % _ and backslashes are ordinary characters."""
    return F.lower(content).contains(F.lower(needle))


def card_lines(lines: Column, most: int = 40) -> Column:
    """Stripped lines with an allowed prefix, the first `most`."""
    ok = F.filter(F.transform(lines, strip), lambda x: x.rlike("^(IDENTITY|ATTRIBUTE|RELATIONSHIP|INSTRUCTION):"))
    return F.slice(ok, 1, most)


def truncate_text(text: Column, most: int = 8000) -> Column:
    return F.substring(text, 1, most)
