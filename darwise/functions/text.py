"""Arabic/English text functions, Column in, Column out."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from darwise import values as V

_DIGITS_FROM = V.ARABIC_INDIC_DIGITS + V.EASTERN_ARABIC_INDIC_DIGITS + V.ARABIC_SEPARATORS
_DIGITS_TO = V.WESTERN_DIGITS + V.WESTERN_DIGITS + V.WESTERN_SEPARATORS
_DIGIT_CLASS = f"[{V.ARABIC_INDIC_DIGITS}{V.EASTERN_ARABIC_INDIC_DIGITS}{V.ARABIC_SEPARATORS}]"
_DIACRITICS = "".join(chr(c) for lo, hi in V.DIACRITIC_RANGES for c in range(lo, hi + 1))
_ARABIC_BLOCK = r"[؀-ۿ]"
# ASCII is passed over first: a wide character class costs ten times as much per character.
_NFKC_SUSPECT = r"(?![\x00-\x7f])[^" + V.NFKC_STABLE_CLASS + "]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Drop leading and trailing white space of any script."""
    return F.btrim(col(c), F.lit(V.WHITESPACE))


def to_western_digits(c) -> Column:
    """Arabic-Indic and Eastern Arabic-Indic digits and separators to 0-9 . ,"""
    c = col(c)
    # To look for such a character costs a tenth of going through a text to replace them.
    return F.when(c.rlike(_DIGIT_CLASS), F.translate(c, _DIGITS_FROM, _DIGITS_TO)).otherwise(c)


def _nfkc_udf():
    # Defined in here so that it travels by value: executors need no copy of
    # this package.
    def to_nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(to_nfkc, T.StringType())


def nfkc(c) -> Column:
    """Unicode NFKC. Only texts with characters it may change are sent to Python."""
    c = col(c)
    return F.coalesce(_nfkc_udf()(F.when(c.rlike(_NFKC_SUSPECT), c)), c)


def nfkc_each(texts) -> Column:
    """``nfkc`` of each text of an array: one call to Python for all of them, which only arrays with characters it may change are sent to."""

    def to_nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in ts])

    texts = col(texts)
    some = F.exists(texts, lambda t: t.rlike(_NFKC_SUSPECT))
    return F.coalesce(F.pandas_udf(to_nfkc, T.ArrayType(T.StringType()))(F.when(some, texts)), texts)


def _fold(c: Column) -> Column:
    # Digits, letter variants and deletions touch disjoint characters, so one
    # translate does them all; Latin-only texts skip it.
    folded = F.translate(
        c, _DIGITS_FROM + V.LETTER_VARIANTS + V.TATWEEL + _DIACRITICS, _DIGITS_TO + V.LETTER_TARGETS
    )
    return F.lower(F.when(c.rlike(_ARABIC_BLOCK), folded).otherwise(c))


def normalize_arabic(c) -> Column:
    """Light normalisation for search and comparison (no stemming)."""
    return _fold(nfkc(c))


def tokens_of_normalized(c, drop_stopwords: bool = True) -> Column:
    """Tokens of a text that went through ``normalize_arabic`` already."""
    c = col(c)
    # The article is cut from the text itself: an article at the start of a
    # run of Arabic letters is an article at the start of a token.
    bare = c
    for article in V.ARABIC_ARTICLES:
        bare = F.regexp_replace(
            bare, f"(?<!{V.ARABIC_LETTER_CLASS}){article}(?={V.ARABIC_LETTER_CLASS}{{2}})", ""
        )
    text = F.when(c.rlike(_ARABIC_BLOCK), bare).otherwise(c)
    found = F.regexp_extract_all(text, F.lit(V.TOKEN_PATTERN), F.lit(0))
    if not drop_stopwords:
        return found
    stop = V.ARABIC_STOPWORDS + V.ENGLISH_STOPWORDS
    return F.filter(found, lambda t: ~t.isin(stop))


def tokenize(c, drop_stopwords: bool = True) -> Column:
    """Normalised Arabic, Latin and number tokens in text order."""
    return tokens_of_normalized(normalize_arabic(c), drop_stopwords)


def detect_language(c) -> Column:
    """``ar`` when Arabic letters are there and at least as many as Latin ones."""
    c = col(c)
    arabic = F.regexp_count(c, F.lit(V.ARABIC_LETTER_CLASS))
    latin = F.regexp_count(c, F.lit(V.LATIN_LETTER_CLASS))
    return F.when((arabic > 0) & (arabic >= latin), "ar").otherwise("en")


def normalize_for_match(c) -> Column:
    """Comparison key: normalised, separators as one space, null as empty."""
    return match_key_of_nfkc(nfkc(c))


def match_key_of_nfkc(c) -> Column:
    """``normalize_for_match`` of a text that went through ``nfkc`` already."""
    folded = F.coalesce(_fold(col(c)), F.lit(""))
    return F.btrim(F.regexp_replace(folded, V.MATCH_SEPARATORS, " "), F.lit(V.WHITESPACE))


def month_start(c) -> Column:
    return F.trunc(col(c), "MM")


def quarter_start(c) -> Column:
    return F.trunc(col(c), "quarter")


def month_index(c) -> Column:
    """Months since January of the base year; negative before it."""
    c = col(c)
    return (F.year(c) - V.MONTH_INDEX_BASE_YEAR) * 12 + F.month(c) - 1


def months_back(c, months: int) -> Column:
    """``months`` earlier; a day the target month lacks runs into the next month."""
    c = col(c)
    return F.date_add(F.add_months(F.trunc(c, "MM"), -months), F.dayofmonth(c) - 1)
