"""Column functions over text: cleaning, folding, tokens, times and their JSON forms."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDE = "".join(chr(0xFEE0 + ord(c)) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: White space as Python's patterns have it, one class for Java's.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else html.unescape(t))


def strip_html(text: Column) -> Column:
    """Without script and style blocks and tags, with entities decoded. Tags leave nothing behind, so words may fuse."""
    text = F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    return F.when(F.contains(text, F.lit("&")), F.pandas_udf(_unescape, "string")(text)).otherwise(text)


def normalize_whitespace(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def fold_fullwidth(text: Column) -> Column:
    """Full-width digits and letters as ASCII; punctuation stays."""
    return F.translate(text, _WIDE, _NARROW)


def remove_noise(text: Column) -> Column:
    """Without URLs and mail addresses; then only the lines with more than ten characters besides spaces, or more than 30 % Chinese ones."""
    text = F.regexp_replace(F.regexp_replace(text, rf"https?://[^{SPACE[1:-1]}]+", ""), rf"[^{SPACE[1:-1]}]+@[^{SPACE[1:-1]}]+", "")
    lines = F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", ""))

    def worth(line: Column) -> Column:
        total = F.length(F.replace(line, F.lit(" "), F.lit("")))
        chinese = F.regexp_count(line, F.lit("[一-鿿]"))
        return (total > 0) & ((total > 10) | (chinese > 0.3 * total))

    return F.array_join(F.filter(lines, worth), "\n")


def clean_text(text: Column) -> Column:
    """``strip_html``, ``normalize_whitespace``, ``fold_fullwidth`` and ``remove_noise``; the text is one line by then, so it stays or goes as a whole."""
    return remove_noise(fold_fullwidth(normalize_whitespace(strip_html(text))))


def normalize_for_segmentation(text: Column) -> Column:
    return normalize_whitespace(fold_fullwidth(text))


def tokenize_words(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def filter_tokens(tokens: Column, stopwords: list[str]) -> Column:
    """Without stopwords, empties and single characters that aren't Chinese; order and repeats stay."""
    trimmed = F.transform(tokens, lambda t: F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", ""))

    def stays(t: Column) -> Column:
        long = (F.length(t) > 1) | t.rlike("^[一-鿿]$")
        return long & ~t.isin(stopwords) if stopwords else long

    return F.filter(trimmed, stays)


def parse_publish_time(text: Column) -> Column:
    """The first 19 characters as ``Y-m-d H:M:S``, ``Y-m-dTH:M:S`` or ``Y-m-d``, padded or not; else null."""
    head = F.substring(text, 1, 19)
    return F.coalesce(*(F.try_to_timestamp(head, F.lit(f)) for f in ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d")))


def list_to_json(values: Column) -> Column:
    return F.to_json(F.coalesce(values, F.array().cast("array<string>")))


def list_from_json(text: Column) -> Column:
    """The list of strings; empty where it's missing or malformed."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


tokens_to_json = flags_to_json = list_to_json
tokens_from_json = flags_from_json = list_from_json


def build_pages(raw: DataFrame, least: int = 50) -> DataFrame:
    """Raw pages (``raw_html``) with their cleaned text, without those of fewer than ``least`` characters."""
    found = raw.withColumn("clean_text", clean_text(F.col("raw_html")))
    return found.filter(F.length("clean_text") >= least).withColumns({"text_length": F.length("clean_text"), "processed": F.lit(0)})


def unprocessed(pages: DataFrame, batch: int | None = None) -> DataFrame:
    """Pages to segment, at most ``batch`` of them."""
    found = pages.filter("processed = 0 and clean_text != ''")
    return found.orderBy("id").limit(batch) if batch is not None else found


def pending(pages: DataFrame) -> DataFrame:
    """Pages to analyse."""
    return pages.filter("processed < 2 and clean_text != ''")
