"""Column functions for text and dates: built-in functions only, except where Unicode composition has none."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTES, PLAIN = "‘’‚‛“”„–—− ", "''''\"\"\"--- "


def compatibility_form(text: Column) -> Column:
    """NFKC; Spark has no function for it. The UDF is made when it is asked for, as that needs a session."""

    @F.pandas_udf("string")
    def compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return compose(text)


def normalize_unicode(text: Column, compose: bool = True) -> Column:
    """Compatibility form, no zero-width or control characters, plain quotes and dashes (T01); ASCII texts skip the UDF."""
    whole = F.when(text.rlike(r"[^\x00-\x7F]"), compatibility_form(text)).otherwise(text) if compose else text
    return F.regexp_replace(F.translate(whole, QUOTES, PLAIN), r"[​-‏⁠﻿\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def collapse_ws(text: Column, keep_newlines: bool = False) -> Column:
    """White space as single spaces; with ``keep_newlines`` at most two line ends in a row stay."""
    if not keep_newlines:
        return F.trim(F.regexp_replace(text, r"\s+", " "))
    lines = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\x0B\f]+", " ")))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def dedup_key(text: Column) -> Column:
    """Lower case, punctuation as space, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "))


def short_sha1(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(text), 1, n)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def shingles(key: Column, n: int = 3) -> Column:
    """Distinct word n-grams of a key; the whole key where it has fewer words."""

    def of(own: Column) -> Column:
        size = F.size(own)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(own, i, n), " "))
        return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(F.array_join(own, " "))).otherwise(F.array_distinct(grams))

    # Bound to a lambda's variable, the words are worked out once and not for every n-gram.
    return F.flatten(F.transform(F.array(words(key)), of))


def hashed_shingles(key: Column, n: int = 3) -> Column:
    """The same n-grams as 64-bit hashes (T23): a join or a count on them shuffles eight bytes an n-gram."""

    def of(own: Column) -> Column:
        size = F.size(own)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(own, i, n)))
        return F.when(size == 0, F.array().cast("array<bigint>")).when(size < n, F.array(F.xxhash64(own))).otherwise(F.array_distinct(grams))

    return F.flatten(F.transform(F.array(words(key)), of))


def sentence_case(text: Column, share: float = 0.6) -> Column:
    """A text of mostly capitals in sentence case."""
    upper, letters = F.length(F.regexp_replace(text, "[^A-Z]", "")), F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    parts = F.transform(F.split(F.lower(text), r"(?<=[.!?]) "), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s))))
    return F.when(upper >= share * letters, F.array_join(parts, " ")).otherwise(text)


def tidy_category(text: Column) -> Column:
    """'' and '[]' and nan as null, a shouted value capitalised."""
    value = F.nullif(F.nullif(F.trim(text), F.lit("")), F.lit("[]"))
    value = F.when(F.lower(value) != "nan", value)
    return F.when(value == F.upper(value), F.concat(F.upper(F.substring(value, 1, 1)), F.lower(value.substr(F.lit(2), F.length(value))))).otherwise(value)


def tolerant_int(text: Column) -> Column:
    """'1.0', ' 7 ' and the like as ints, anything else null."""
    return text.try_cast("double").try_cast("int")


def pseudonym(name: Column) -> Column:
    return F.substring(F.sha1(F.lower(name)), 1, 8)


def area_group(text: Column) -> Column:
    """Upper case with digits parted from letters."""
    return collapse_ws(F.regexp_replace(F.regexp_replace(F.upper(text), r"([A-Z])([0-9])", "$1 $2"), r"([0-9])([A-Z])", "$1 $2"))


DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "MMMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "MMM d yyyy")


def parse_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The date by the first format that fits; ordinal endings and commas are dropped."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)(\d)(st|nd|rd|th)\b", "$1"), ",", ""))
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)).cast("date") for f in formats))


def parse_register_date(text: Column, assumed_year: int) -> tuple[Column, Column]:
    """(date, whether the year was assumed): a date without a year takes the assumed one."""
    full = parse_date(text)
    short = parse_date(F.concat(F.trim(text), F.lit(f" {assumed_year}")), ("d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "d/M yyyy"))
    return F.coalesce(full, short), full.isNull() & short.isNotNull()


def full_year(two_digits: Column) -> Column:
    """Pivot at 90."""
    return F.when(two_digits >= 90, 1900 + two_digits).otherwise(2000 + two_digits)


def year_in(text: Column, first: int = 1990, last: int = 2026) -> Column:
    year = F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d\d)\b", 1), F.lit("")).try_cast("int")
    return F.when(year.between(first, last), year)
