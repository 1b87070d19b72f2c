"""Normal forms of names as Columns. Only Unicode normalization and title case need Python, and both
run in Arrow batches behind an ASCII fast path that stays in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_ASCII = r"\A[\x00-\x7F]*\z"
_SPACE = r"(?U)\s+"


def _vectorized(fn):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    return run


_nfkd = _vectorized(lambda s: unicodedata.normalize("NFKD", s))
_nfkc = _vectorized(lambda s: unicodedata.normalize("NFKC", s))
_bare = _vectorized(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))
_nfkd_ascii = _vectorized(lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())
_nfkc_ascii = _vectorized(lambda s: unicodedata.normalize("NFKC", s).encode("ascii", "ignore").decode())
_title = _vectorized(str.title)
_capital = _vectorized(str.capitalize)


def _unless_ascii(col: Column, udf) -> Column:
    """ASCII texts are their own normal form; the UDF gets null for them, and so no work."""
    return F.when(col.rlike(_ASCII), col).otherwise(udf(F.when(~col.rlike(_ASCII), col)))


def nfkd(col: Column) -> Column:
    return _unless_ascii(col, _nfkd)


def nfkc(col: Column) -> Column:
    return _unless_ascii(col, _nfkc)


def drop_diacritics(col: Column) -> Column:
    """NFKD without combining marks."""
    return _unless_ascii(col, _bare)


def ascii_fold(col: Column) -> Column:
    """NFKD with everything beyond ASCII left out, in lower case; the result isn't stripped."""
    return F.lower(_unless_ascii(col, _nfkd_ascii))


def ascii_fold_composed(col: Column) -> Column:
    """As ascii_fold, by NFKC."""
    return F.lower(_unless_ascii(col, _nfkc_ascii))


def strip(col: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col, r"(?U)\A\s+|\s+\z", "")


def tidy_spaces(col: Column) -> Column:
    return strip(F.regexp_replace(col, _SPACE, " "))


def canonicalize(col: Column) -> Column:
    """Lower case letters and digits alone, to tell near-duplicate names."""
    return F.regexp_replace(F.lower(strip(col)), r"[^\p{L}\p{N}]+", "")


def match_normalize(col: Column) -> Column:
    """Without diacritics, in lower case, words of letters parted by single spaces."""
    return F.trim(F.regexp_replace(F.lower(drop_diacritics(col)), r"[^\p{L}]+", " "))


def skeleton(normal: Column) -> Column:
    """A match-normalized name without the five vowels."""
    return F.regexp_replace(normal, "[aeiou]+", "")


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def initials(normal: Column, n: int = 2) -> Column:
    return F.array_join(F.transform(F.slice(tokens(normal), 1, n), lambda t: F.substring(t, 1, 1)), "")


def surname(normal: Column) -> Column:
    """The last word, or an empty text."""
    return F.coalesce(F.try_element_at(tokens(normal), F.lit(-1)), F.lit(""))


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance in code points; with `most`, -1 for any longer one."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def upper(col: Column) -> Column:
    return F.upper(col)


def lower(col: Column) -> Column:
    return F.lower(col)


def capitalize(col: Column) -> Column:
    ascii_ = F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, (1 << 31) - 1)))
    return F.when(col.rlike(_ASCII), ascii_).otherwise(_capital(F.when(~col.rlike(_ASCII), col)))


def title(col: Column) -> Column:
    """Upper case after every character that isn't a letter; Spark's initcap looks at spaces alone."""
    pieces = F.regexp_extract_all(col, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    cased = F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, (1 << 31) - 1)))), "")
    return F.when(col.rlike(_ASCII), cased).otherwise(_title(F.when(~col.rlike(_ASCII), col)))


def clean_line(col: Column) -> Column:
    """A JSON line without outer white space and one trailing comma; null if shorter than 10."""
    s = strip(col)
    return F.when(F.length(s) >= 10, F.regexp_replace(s, r",\z", ""))


def hh_mm_ss(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
