"""Splits by whole groups, without leakage. The order within a bucket is a hash of the group's id, so a
split is the same on any cluster, and adding rows to a group moves no other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.functions.sampling import draw, half_even, placed
from onomast.operators.groups import bucket, sizes


def stratified(size: DataFrame, cutoff: int, edges: list[int], ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, caps: dict[str, int] | None = None) -> DataFrame:
    """(grp, size, bucket, split) of the groups of at least `cutoff`; caps bound a bucket's groups."""
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("ratios must sum to 1")
    ordinal, label = bucket(F.col("size"), cutoff, edges)
    kept = size.where(F.col("size") >= cutoff).select("grp", "size", ordinal.alias("ordinal"), label.alias("bucket"))
    kept = placed(kept, ["bucket"], draw(seed, "grp"), ["grp"]).withColumnRenamed("total", "n")
    for name, most in (caps or {}).items():
        kept = kept.where((F.col("bucket") != name) | (F.col("place") <= most))
        kept = kept.withColumn("n", F.when(F.col("bucket") == name, F.least("n", F.lit(most))).otherwise(F.col("n")))
    train, val = half_even(F.col("n") * ratios[0]), half_even(F.col("n") * ratios[1])
    split = F.when(F.col("place") <= train, "train").when(F.col("place") <= train + val, "val").otherwise("test")
    return kept.select("grp", "size", "ordinal", "bucket", split.alias("split"))


def summary(assigned: DataFrame) -> DataFrame:
    """Groups of each bucket by split, and a TOTAL row."""
    counts = [F.count_if(F.col("split") == s).alias(f"{s}_groups") for s in ("train", "val", "test")]
    rolled = assigned.rollup("bucket").agg(F.count("*").alias("total_groups"), *counts)
    return rolled.select(F.coalesce("bucket", F.lit("TOTAL")).alias("bucket"), "total_groups", "train_groups", "val_groups", "test_groups")


def by_threshold(size: DataFrame, train_min: int = 50, eval_min: int = 10, val_ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """(grp, size, split): large groups train; the others, down to eval_min, test or validate. The test
    share is rounded up."""
    rest = size.where((F.col("size") < train_min) & (F.col("size") >= eval_min))
    rest = placed(rest, [], draw(seed, "grp"), ["grp"])
    tests = F.ceil(F.round(F.col("total") * (1 - val_ratio), 9))
    rest = rest.select("grp", "size", F.when(F.col("place") <= tests, "test").otherwise("val").alias("split"))
    return size.where(F.col("size") >= train_min).select("grp", "size", F.lit("train").alias("split")).unionByName(rest)


def rows_of(rows: DataFrame, assigned: DataFrame, group_col: str = "id") -> DataFrame:
    """The rows of assigned groups with their split: one join for all three."""
    return rows.join(assigned.select(F.col("grp").alias(group_col), "split"), group_col)


def split_rows(rows: DataFrame, cutoff: int, edges: list[int], group_col: str = "id", **options) -> DataFrame:
    return rows_of(rows, stratified(sizes(rows, group_col), cutoff, edges, **options), group_col)


def leaks(assigned: DataFrame) -> DataFrame:
    """Groups in more than one split: none, if all is well."""
    return assigned.groupBy("grp").agg(F.count_distinct("split").alias("splits")).where(F.col("splits") > 1)
