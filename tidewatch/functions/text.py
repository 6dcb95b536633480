"""Text Column expressions: aggressive normalization, post cleaning, tokens, hashtags, slugs.

All are chains of JVM regex functions (Java regex; `(?U)` makes \\w, \\d, \\s, \\b Unicode-aware
like Python's `re`, `(?d)` makes `$` see only `\\n`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.stemming import STOP_EN, analyzed

# Patterns and replacements of the aggressive normalization, in order.
NORMALIZE_STEPS = (
    (r"(?U)\s+&amp;?\s+", " and "),
    (r"(?U)@[A-Za-z0-9_]+\b", "_USER_ "),
    (r"(?iU)\b\d\d?:\d\d\s*[ap]\.?m\.?\b", "_TIME_"),
    (r"(?iU)\b\d\d?\s*[ap]\.?m\.?\b", "_TIME_"),
    (r"(?iU)\b\d\d?:\d\d:\d\d\b", "_TIME_"),
    (r"(?iU)\b\d\d?:\d\d\b", "_TIME_"),
    (r"(?iU)\bhttps?:\S+", " _URL_ "),
    (r"(?idU)\s+https?$", " _URL_"),
    (r"(?U)[^\w\d\s:'\",.\(\)#@\?!/\u2019_]+", ""),
    (r"\n", " "),
    (r"(?U)\s{2,}", " "),
    (r"(?U)^\s+|\s+$", ""),
)

# Tokens never kept, and the minimum token length.
NOT_ALLOWED_TOKENS = ("rt", "http", "https", "ftp")
# Characters stripped from both ends of a hashtag.
HASHTAG_STRIP = "#.,-\"'&*^!"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_aggressive(text) -> Column:
    """Ampersands, @mentions, clock times and URLs replaced by placeholders, other
    symbols dropped, whitespace collapsed and trimmed."""
    out = _col(text)
    for pattern, repl in NORMALIZE_STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(repl))
    return out


def _remove_urls_names(t: Column) -> Column:
    """Every URL and @name found in the text removed by plain substring replacement (all
    occurrences, in the order found); texts with neither skip the work."""
    urls = F.regexp_extract_all(t, F.lit(r"(?U)(https?://[^\s]+)"), 1)
    names = F.transform(F.regexp_extract_all(t, F.lit(r"(?i)@([a-z0-9_]+)"), 1), lambda n: F.concat(F.lit("@"), n))
    removed = F.aggregate(F.concat(urls, names), t, lambda acc, w: F.replace(acc, w, F.lit("")))
    return F.when(t.contains("@") | t.contains("http"), removed).otherwise(t)  # the URL pattern is case-sensitive


def clean_post(text) -> Column:
    """Every URL and every @name found in the original text is removed by plain
    substring replacement (all occurrences, in order found), then trimmed."""
    return F.regexp_replace(_remove_urls_names(_col(text)), F.lit(r"(?U)^\s+|\s+$"), F.lit(""))


# Fixed value: analyzer words - runs of letters, marks, numbers and _, where a single
# '.', apostrophe or right single quote between two such runs does not split ("t.co", "it's").
WORD_PATTERN = r"[\p{L}\p{M}\p{N}_]+(?:[.'\u2019][\p{L}\p{M}\p{N}_]+)*"


def analyzed_words(text) -> Column:
    """Standard-analyzer style word split, lower-cased."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD_PATTERN), 0)


def tokenize(text, lang=None, stems: bool = True) -> Column:
    """Clean -> word split -> lower -> the language's stop words and stems (en, es, fr, it; words of
    other languages stay as they are, as do all without `lang`) -> distinct -> drop rt/http/https/ftp and
    tokens of length <= 1. Without `stems` the words of all languages stay as they are, but for English stop words."""
    return tokens_from_words(token_words(text), lang, stems)


def token_words(text) -> Column:
    """The analyzed words of a post after URL / @name removal (trimming cannot change them)."""
    return analyzed_words(_remove_urls_names(_col(text)))


def tokens_from_words(words: Column, lang=None, stems: bool = True) -> Column:
    """The tokenizer's filtering steps applied to already analyzed words."""
    if lang is not None and stems:
        words = analyzed(words, _col(lang))
    elif lang is not None:
        stop = F.array(*[F.lit(w) for w in sorted(STOP_EN)])
        words = F.when(F.coalesce(_col(lang) == "en", F.lit(False)), F.array_except(words, stop)).otherwise(words)
    banned = F.array(*[F.lit(w) for w in NOT_ALLOWED_TOKENS])
    words = F.array_except(F.array_distinct(words), banned)
    return F.filter(words, lambda w: F.length(F.trim(w)) > 1)


def hashtags(text) -> Column:
    """Whitespace-separated words that start with '#' and are shorter than 256
    characters, stripped of #.,-"'&*^! at both ends."""
    words = F.split(_col(text), r"(?U)\s+")
    tags = F.filter(words, lambda w: w.startswith("#") & (F.length(w) < 256))
    strip = "[" + "".join("\\" + c for c in HASHTAG_STRIP) + "]+"
    return F.transform(tags, lambda w: F.regexp_replace(w, F.lit(f"^{strip}|{strip}$"), F.lit("")))


def slug(text) -> Column:
    """Runs of non-word characters -> '_'."""
    return F.regexp_replace(_col(text), F.lit(r"(?U)\W+"), F.lit("_"))


def media_links(html) -> Column:
    """X6 over raw pages: distinct image sources (`<img src=...>`), in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(_col(html), F.lit(r"(?i)<img[^>]*\ssrc=\"([^\"]*)\""), 1))


def links(html) -> Column:
    """Distinct anchor targets (`<a href=...>`) of a raw page, in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(_col(html), F.lit(r"(?i)<a[^>]*\shref=\"([^\"]*)\""), 1))
