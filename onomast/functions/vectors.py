"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(v: Column) -> Column:
    # Within an array of one, so that it is worked out once and not for each component.
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.try_divide(x.cast("double"), n))), F.lit(0))


def cosine_distance(similarity: Column) -> Column:
    return F.lit(1.0) - similarity


def is_finite(col: Column) -> Column:
    return ~F.isnan(col) & (F.abs(col) < float("inf"))


def triplet_loss(pos: Column, neg: Column, margin: float) -> Column:
    return F.greatest(neg - pos + F.lit(margin), F.lit(0.0))


def semi_hard(pos: Column, neg: Column, margin: float) -> Column:
    return (neg >= pos - F.lit(margin)) & (neg < pos)


def hard(pos: Column, neg: Column, margin: float) -> Column:
    return neg >= pos - F.lit(margin)


#: Lowest integer score of each bucket, for personal and business names.
SCORE_BUCKETS = {
    "personal": [("same", 80), ("close", 50), ("likely", 30), ("plausible", 20), ("unlikely", 10)],
    "business": [("same", 80), ("close", 60), ("likely", 43), ("plausible", 30), ("unlikely", 20)],
}


def score_bucket(score: Column, kind: str = "personal") -> Column:
    out = F.lit("none")
    for name, least in reversed(SCORE_BUCKETS[kind]):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out
