"""Noisy variants of names.

Each row has a random stream of its own, seeded by the seed and the row's key: a row gets the same
variant on any cluster and in any order. Rows go through one Arrow batch UDF.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.functions.translit import transliterate_text

# The keys next to each letter on a QWERTY keyboard.
NEIGHBOURS = {
    "a": "qwsz", "b": "vghn", "c": "xdfv", "d": "ersfcx", "e": "wsdr", "f": "rtgdvc", "g": "tyfhvb", "h": "yugjnb", "i": "ujko",
    "j": "uikhmn", "k": "ijolm,", "l": "kop;", "m": "njk", "n": "bhjm", "o": "iklp", "p": "ol;", "q": "was", "r": "edft",
    "s": "awedxz", "t": "rfgy", "u": "yhji", "v": "cfgb", "w": "qase", "x": "zsdc", "y": "tugh", "z": "asx",
}
# What a scanner takes for what.
CONFUSIONS = [("rn", "m"), ("cl", "d"), ("I", "l"), ("l", "1"), ("O", "0"), ("B", "8"), ("é", "e"), ("à", "a"), ("ü", "u"), ("ñ", "n"), ("c", "e"), ("t", "f"), (".", ",")]
# Latin letters and Greek or Cyrillic ones that look the same.
HOMOGLYPHS = {"A": "Α", "B": "В", "E": "Е", "a": "а", "e": "е", "p": "р", "H": "Н"}
# The odds of each rule.
ODDS = {"particle_rule": 0.35, "nickname": 0.4, "abbreviation": 0.25, "initials": 0.25, "placeholder_jitter": 0.15, "transliteration": 0.25}

#: Language profiles of our own making; `default` stands in for what a language doesn't say.
PROFILES: dict[str, dict] = {
    "default": {"placeholders": ["FNU", "LNU", "UNK"]},
    "en": {
        "particles": ["van", "de", "von", "of"],
        "nicknames": {"robert": ["Bob", "Rob", "Bobby"], "william": ["Bill", "Will"], "elizabeth": ["Liz", "Beth"], "john": ["Jack", "Johnny"], "margaret": ["Peggy", "Meg"]},
        "abbreviations": {"saint": ["St"], "junior": ["Jr"], "senior": ["Sr"], "william": ["Wm"], "charles": ["Chas"]},
    },
    "es": {
        "particles": ["de", "la", "las", "los", "del", "y"],
        "nicknames": {"josé": ["Pepe"], "francisco": ["Paco", "Pancho"], "dolores": ["Lola"]},
        "abbreviations": {"maría": ["Ma", "M"], "francisco": ["Fco"], "hernández": ["Hdez"]},
    },
    "fr": {"particles": ["de", "du", "des", "le", "la"], "abbreviations": {"saint": ["St"], "sainte": ["Ste"]}},
    "de": {"particles": ["von", "zu", "der", "vom"], "nicknames": {"johannes": ["Hans"], "friedrich": ["Fritz"]}},
    "ar": {"particles": ["al", "el", "bin", "ibn", "bint", "abu"], "abbreviations": {"muhammad": ["Mhd", "Md"], "mohammed": ["Mhd"]}, "allow_transliteration": True},
    "ru": {"nicknames": {"алексей": ["Алёша", "Лёша"], "александр": ["Саша"]}, "allow_transliteration": True},
    "el": {"allow_transliteration": True},
    "ja": {"allow_transliteration": True},
    "zh": {"allow_transliteration": True},
}


@dataclass(frozen=True)
class Profile:
    particles: frozenset[str] = frozenset()
    nicknames: dict[str, list[str]] = field(default_factory=dict)
    abbreviations: dict[str, list[str]] = field(default_factory=dict)
    placeholders: tuple[str, ...] = ()
    allow_transliteration: bool = False


def profile(profiles: dict[str, dict], lang: str | None) -> Profile:
    """A language's profile over the default one, with lower-cased keys."""
    p = profiles.get("default", {}) | (profiles.get(lang, {}) if lang else {})
    low = lambda m: {k.lower(): v for k, v in m.items()}
    return Profile(
        frozenset(x.lower() for x in p.get("particles", ())), low(p.get("nicknames", {})), low(p.get("abbreviations", {})),
        tuple(p.get("placeholders", ())), bool(p.get("allow_transliteration", False)),
    )


def _each(chance: float, pick: Callable[[str, random.Random], str | None]):
    """A transform that replaces characters one by one, where pick has something for them."""

    def run(s: str, rng: random.Random) -> str:
        swap = lambda c: new if (new := pick(c, rng)) is not None and rng.random() < chance else c
        return "".join(map(swap, s))

    return run


def _neighbour(c: str, rng: random.Random) -> str | None:
    if c.lower() not in NEIGHBOURS:
        return None
    new = rng.choice(NEIGHBOURS[c.lower()])
    return new.upper() if c.isupper() else new


def confuse(s: str, rng: random.Random, dot_is_any: bool = False) -> str:
    """One confusion at its first place. With dot_is_any the dot stands for the first character."""
    old, new = rng.choice(CONFUSIONS)
    if old == "." and dot_is_any:
        return re.sub(".", new, s, count=1)
    return s.replace(old, new, 1)


def join_or_split(s: str, rng: random.Random) -> str:
    u = rng.random()
    if u < 0.33:
        return s.replace("-", " ")
    if u < 0.66:
        return s.replace(" ", "")
    words = s.split()
    if len(words) < 2:
        return s
    at = rng.randrange(len(words) - 1)
    return " ".join([*words[:at], f"{words[at]}-{words[at + 1]}", *words[at + 2 :]])


def truncate(s: str, rng: random.Random) -> str:
    """10 to 30 % of a name of more than three characters goes, from either end or the middle."""
    if len(s) <= 3:
        return s
    n = max(1, int(len(s) * rng.uniform(0.1, 0.3)))
    at = rng.choice([0, len(s) - n, rng.randint(1, max(1, len(s) - n - 1))])
    return s[:at] + s[at + n :]


def swap_words(words: list[str], rng: random.Random) -> list[str]:
    out = list(words)
    if len(out) > 1:
        i, j = rng.sample(range(len(out)), 2)
        out[i], out[j] = out[j], out[i]
    return out


#: Character transforms by name; callers can pass a registry of their own.
TRANSFORMS: dict[str, Callable[[str, random.Random], str]] = {
    "drop_diacritics": lambda s, rng: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)),
    "nfkc_normalize": lambda s, rng: unicodedata.normalize("NFKC", s),
    "case_randomize": _each(0.15, lambda c, rng: c.swapcase() if c.isalpha() else None),
    "case_upper": lambda s, rng: s.upper(),
    "case_lower": lambda s, rng: s.lower(),
    "case_capitalize": lambda s, rng: s.capitalize(),
    "case_title": lambda s, rng: s.title(),
    "keyboard_subst": _each(0.08, _neighbour),
    "ocr_confuse": confuse,
    "hyphen_space": join_or_split,
    "homoglyph_swap": _each(0.05, lambda c, rng: HOMOGLYPHS.get(c)),
    "truncate": truncate,
}


def particles(words: list[str], known: frozenset[str], rng: random.Random) -> list[str]:
    """Each particle is left out (odds 0.5), joined to the next word (0.4) or kept."""
    out, rest = [], list(words)
    while rest:
        w = rest.pop(0)
        u = rng.random() if w.lower() in known else 1.0
        if u < 0.5:
            continue
        out.append(w + rest.pop(0) if u < 0.9 and rest else w)
    return out


def replace_words(words: list[str], table: dict[str, list[str]], chance: float, rng: random.Random) -> list[str]:
    return [rng.choice(table[w.lower()]) if w.lower() in table and rng.random() < chance else w for w in words]


def initial(words: list[str], rng: random.Random) -> list[str]:
    at = rng.randrange(len(words))
    return [w[0].upper() if i == at and w[:1].isalpha() else w for i, w in enumerate(words)]


def placeholders(words: list[str], known: tuple[str, ...], rng: random.Random) -> list[str]:
    u = rng.random()
    if u < 0.5:
        one = [rng.choice(known)]
        return one + words if rng.random() < 0.5 else words + one
    return [w for w in words if w.upper() not in {p.upper() for p in known}] if u < 0.7 else words


def augment_name(name: str, lang: str | None, rng: random.Random, profiles: dict[str, dict] = PROFILES, transforms=None, noise_rate: float = 0.35, max_ops: int = 2) -> tuple[str, list[str]]:
    """(variant, rules applied): word rules, then transliteration, then up to max_ops transforms."""
    transforms = TRANSFORMS if transforms is None else transforms
    s, ops = name.strip(), []
    if rng.random() > noise_rate:
        return s, ops
    p, words = profile(profiles, lang), s.split()
    rules = [
        ("particle_rule", bool(p.particles), lambda w: particles(w, p.particles, rng)),
        ("nickname", bool(p.nicknames), lambda w: replace_words(w, p.nicknames, 0.6, rng)),
        ("abbreviation", bool(p.abbreviations), lambda w: replace_words(w, p.abbreviations, 0.5, rng)),
        ("initials", True, lambda w: initial(w, rng)),
        ("placeholder_jitter", bool(p.placeholders), lambda w: placeholders(w, p.placeholders, rng)),
    ]
    for rule, applies, run in rules:
        if applies and rng.random() < ODDS[rule] and (rule != "initials" or len(words) > 1):
            words = run(words)
            ops.append(rule)
    s = " ".join(words)
    if p.allow_transliteration and lang and rng.random() < ODDS["transliteration"]:
        before, s = s, transliterate_text(s, lang)[0]
        if s != before:
            ops.append(f"transliteration({lang})")
    for op in rng.sample(list(transforms), min(rng.randint(0, max_ops), len(transforms))):
        before, s = s, transforms[op](s, rng)
        if s != before:
            ops.append(op)
    return " ".join(s.split()), ops


def augmenter(seed: int = 42, profiles: dict[str, dict] | None = None, transforms=None) -> Callable[..., Column]:
    """augment(name, lang, key, noise_rate, max_ops) -> struct(augmented, ops)."""
    profiles = PROFILES if profiles is None else profiles

    def augment(name: Column, lang: Column, key: Column, noise_rate: float = 0.35, max_ops: int = 2) -> Column:
        @F.pandas_udf("augmented string, ops array<string>")
        def run(names: pd.Series, langs: pd.Series, keys: pd.Series) -> pd.DataFrame:
            rows = [(None, None) if n is None else augment_name(n, x, random.Random(f"{seed}:{k}"), profiles, transforms, noise_rate, max_ops) for n, x, k in zip(names, langs, keys, strict=True)]
            return pd.DataFrame(rows, columns=["augmented", "ops"])

        return run(name, lang, key.cast("string"))

    return augment


def augment_rows(rows: DataFrame, key: str = "id", name: str = "name", lang: str = "language", seed: int = 42, noise_rate: float = 0.35, max_ops: int = 2) -> DataFrame:
    """rows with `augmented` and `ops`."""
    got = augmenter(seed)(F.col(name), F.col(lang), F.concat_ws(":", F.col(key).cast("string"), F.col(name)), noise_rate, max_ops)
    return rows.withColumn("__a", got).select(*rows.columns, "__a.augmented", "__a.ops")
