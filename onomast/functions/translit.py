"""Transliteration by character maps, with a registry for adapters of other languages."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Russian and Greek letters and what they become; upper case follows from lower case.
RUSSIAN = dict(zip("абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye", strict=True)) | {
    "ё": "yo", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ь": "", "ъ": "",
}
GREEK = dict(zip("αβγδεζηικλμνξοπρστυφω", "avgdeziiklmnxoprstyfo", strict=True)) | {"θ": "th", "χ": "ch", "ψ": "ps"}
GREEK_LOWER_ONLY = dict(zip("άέίόύήώϊϋΐΰς", "aeioyioiyiys", strict=True))



def _both_cases(lower: dict[str, str]) -> dict[str, str]:
    return lower | {k.upper(): v.capitalize() for k, v in lower.items()}


MAPS = {"ru": ("builtin_ru_cyr2lat", _both_cases(RUSSIAN)), "el": ("builtin_el_greeklish", _both_cases(GREEK) | GREEK_LOWER_ONLY)}

_adapters: dict[str, tuple[str, Callable[[str], str]]] = {}


def register_adapter(lang: str, name: str, fn: Callable[[str], str]) -> None:
    """Add or replace the adapter of a language; it stands before the built-in maps."""
    _adapters[lang] = (name, fn)


def _autoload(lang: str) -> None:
    """Adapters of optional libraries, where they can be imported."""
    try:
        if lang == "ar":
            from arabic_buckwalter_transliteration.transliteration import arabic_to_buckwalter

            register_adapter("ar", "arabic_buckwalter", arabic_to_buckwalter)
        elif lang == "ja":
            from icu import Transliterator

            register_adapter("ja", "icu_ja", Transliterator.createInstance("Any-Latin; Title").transliterate)
        elif lang == "zh":
            from pypinyin import lazy_pinyin

            register_adapter("zh", "pypinyin", lambda s: " ".join(lazy_pinyin(s)))
    except ImportError:
        pass


def adapter(lang: str | None) -> tuple[str, Callable[[str], str]] | None:
    if lang and lang not in _adapters:
        _autoload(lang)
    if lang in _adapters:
        return _adapters[lang]
    if lang in MAPS:
        name, table = MAPS[lang]
        return name, lambda s: "".join(table.get(c, c) for c in s)
    return None


def transliterate_text(text: str, lang: str | None) -> tuple[str, str]:
    """(text, adapter): 'none' without an adapter, 'error' where it raises."""
    found = adapter(lang)
    if found is None:
        return text, "none"
    try:
        return found[1](text), found[0]
    except Exception:
        return text, "error"


def map_chars(col: Column, table: dict[str, str]) -> Column:
    letters = F.create_map(*map(F.lit, chain(*table.items())))
    return F.array_join(F.transform(F.split(col, ""), lambda c: F.coalesce(F.try_element_at(letters, c), c)), "")


def transliterate(text: Column, lang: Column) -> Column:
    """struct(text, adapter). The built-in maps run in the JVM; other adapters in Arrow batches, and
    only if any is registered."""
    name, out = F.lit("none"), text
    others = {k: v for k, v in _adapters.items()}
    if others:

        @F.pandas_udf("text string, adapter string")
        def run(t: pd.Series, code: pd.Series) -> pd.DataFrame:
            rows = []
            for x, y in zip(t, code, strict=True):
                try:
                    rows.append((None, None) if x is None or y not in others else (others[y][1](x), others[y][0]))
                except Exception:
                    rows.append((x, "error"))
            return pd.DataFrame(rows, columns=["text", "adapter"])

        got = run(text, lang)
        name, out = F.when(lang.isin(*others), got["adapter"]).otherwise(name), F.when(lang.isin(*others), got["text"]).otherwise(out)
    for code, (label, table) in MAPS.items():
        if code not in others:
            name, out = F.when(lang == code, F.lit(label)).otherwise(name), F.when(lang == code, map_chars(text, table)).otherwise(out)
    return F.struct(out.alias("text"), name.alias("adapter"))
