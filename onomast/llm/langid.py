r"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent letter n-grams (1 to 3 letters, word edges
marked), in order. A document is compared by its own such list: each of its n-grams counts the
difference of the two ranks, or the profile's length if the profile lacks it, and the language with
the least sum wins (the first by name where sums tie). The score is 1 - sum / largest possible sum.

Profiles are fitted on a bounded sample, `sample_docs` labelled documents of each language chosen by a
hash of their id; prediction reads every whole text, and takes only the text as its input.

Defined cases: null text, empty text and text without a letter give `und` with score 0, as does a
table without labelled documents; documents without an id count as hashed from the empty text;
rows without language aren't learned from; repeated rows are predicted alike; other columns are
not read. Letters beyond the Basic Multilingual Plane count as one letter.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onomast.llm.common import in_batches, shuffles_dropped

UNDETERMINED = "und"
_EDGE = 1  # stands for any run of other characters
_OTHER = 0xFFFF


@functools.cache
def _units() -> np.ndarray:
    """Code unit of each character of the Basic Multilingual Plane: itself for a letter, else _EDGE."""
    table = np.arange(1 << 16, dtype=np.int64)
    table[[i for i in range(1 << 16) if not chr(i).isalpha()]] = _EDGE
    return table


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count) as arrays sorted by document and n-gram. An n-gram is packed from
    its letters, 16 bits each."""
    none = np.zeros(0, np.int64)
    parts = [f"\n{t.lower()}\n" for t in texts]
    if not parts:
        return none, none, none
    code = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), "<u4")
    unit = np.where(code < 1 << 16, _units()[np.minimum(code, _OTHER)], _OTHER)
    far = np.flatnonzero(code >= 1 << 16)
    if len(far):
        distinct, back = np.unique(code[far], return_inverse=True)
        unit[far] = np.array([_OTHER if chr(c).isalpha() else _EDGE for c in distinct.tolist()])[back]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    keep = np.ones(len(unit), bool)
    keep[1:] = (unit[1:] != _EDGE) | (unit[:-1] != _EDGE) | (doc[1:] != doc[:-1])
    u, d = unit[keep], doc[keep] << 48
    same1, same2 = d[1:] == d[:-1], d[2:] == d[:-2]
    one = (d | u)[u != _EDGE]
    two = (d[1:] | u[:-1] << 16 | u[1:])[same1 & ((u[1:] != _EDGE) | (u[:-1] != _EDGE))]
    three = (d[2:] | u[:-2] << 32 | u[1:-1] << 16 | u[2:])[same2 & (u[1:-1] != _EDGE)]
    keys = np.concatenate([one, two, three])
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else none
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return keys >> 48, keys & ((1 << 48) - 1), counts


def top_ranks(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(document, n-gram, rank) of each document's k most frequent n-grams, ties by n-gram."""
    order = np.argsort(doc << 40 | ((1 << 40) - 1 - count), kind="stable")
    doc, gram = doc[order], gram[order]
    start = np.searchsorted(doc, doc)
    rank = np.arange(len(doc)) - start
    keep = rank < k
    return doc[keep], gram[keep], rank[keep]


def fit(docs: DataFrame, training, profile: int = 400, sample_docs: int = 2000) -> dict[str, np.ndarray]:
    """Profiles (n-grams in order) by language, from rows where `training` holds."""
    labelled = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    span = 1 << 30
    place = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(span))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    limit = sizes.select(F.col("lang").alias("l"), F.least(F.lit(float(span)), F.lit(float(span)) * sample_docs / F.col("n")).alias("limit"))
    # A row per language, fewer than the profiles that every task holds anyway.
    sample = labelled.select("lang", "text", place.alias("place")).join(F.broadcast(limit), F.col("lang") == F.col("l")).where(F.col("place") < F.col("limit"))

    out = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b["lang"].to_pylist(), b["text"].to_pylist()
            for lang in sorted(set(langs)):
                joined = "\n".join(t for x, t in zip(langs, texts, strict=True) if x == lang)
                _, gram, n = ngram_counts([joined])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], schema=out)

    counted = in_batches(sample.select("lang", "text"), run, "lang string, gram bigint, n bigint", most_bytes=1 << 19)
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    found: dict[str, list[int]] = {}
    with shuffles_dropped(docs.sparkSession):
        rows = ranked.where(F.col("rank") <= profile).orderBy("lang", "rank").collect()  # `profile` rows a language
    for r in rows:
        found.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in found.items()}


class Classifier:
    def __init__(self, profiles: dict[str, np.ndarray], k: int):
        self.langs, self.k = sorted(profiles), k
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)  # the last row: in no profile
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        doc, gram, rank = top_ranks(*ngram_counts([t or "" for t in texts]), self.k)
        used = np.bincount(doc, minlength=n)
        if not self.langs:
            return [UNDETERMINED] * n, np.zeros(n)
        at = np.searchsorted(self.grams, gram)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        sums = np.empty((n, len(self.langs)))
        for j in range(len(self.langs)):
            own = self.ranks[at, j]
            sums[:, j] = np.bincount(doc, np.where(own < 0, self.k, np.abs(own - rank)), n)
        best = sums.argmin(axis=1)
        score = 1 - sums[np.arange(n), best] / np.maximum(1, used * self.k)
        langs = [self.langs[b] if u else UNDETERMINED for b, u in zip(best, used, strict=True)]
        return langs, np.where(used > 0, np.clip(score, 0, 1), 0.0)


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], carry: list[str], profile: int = 400) -> DataFrame:
    """The columns `carry` of docs(text, ...) with lang_pred and score."""
    if clash := {"lang_pred", "score"} & set(carry):
        raise ValueError(f"columns {sorted(clash)} are this operator's own")
    wanted = docs.select(*carry, F.col("text").cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(profiles, profile)
        for b in batches:
            langs, score = classify(b["__text"].to_pylist())
            names = [n for n in b.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return in_batches(wanted, run, f"{fields}, lang_pred string, score double", most_bytes=1 << 19)


def remainder(id_col: str, mod: int):
    """crc32 of an id's text, modulo mod."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod


def identify(docs: DataFrame, profile: int = 400, sample_docs: int = 2000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs(doc_id, text, lang)."""
    held = remainder("doc_id", 4) == 2
    profiles = fit(docs, ~held, profile, sample_docs)
    return predict(docs.withColumn("held_out", held), profiles, ["doc_id", "held_out"], profile)


def keep_identified(docs: DataFrame, columns: list[str], min_score: float = 0.02, profile: int = 400, sample_docs: int = 2000) -> DataFrame:
    """The rows whose language can be told: those without letters, or hardly alike to any profile, go."""
    profiles = fit(docs, remainder("doc_id", 4) != 2, profile, sample_docs)
    told = predict(docs, profiles, columns, profile)
    return told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select(*columns)
