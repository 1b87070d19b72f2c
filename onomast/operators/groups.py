"""Profiles of group sizes. Rows are counted once per group; all that follows works on the table of
sizes, which has a row per distinct size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sizes(rows: DataFrame, group_col: str = "id") -> DataFrame:
    """(group, size); rows without a group don't count."""
    return rows.where(F.col(group_col).isNotNull()).groupBy(F.col(group_col).alias("grp")).agg(F.count("*").alias("size"))


def frequencies(size: DataFrame, least: int = 1) -> DataFrame:
    f = size.where(F.col("size") >= least).groupBy("size").agg(F.count("*").alias("num_groups_at_size"))
    return f.withColumn("num_names_at_size", F.col("size") * F.col("num_groups_at_size"))


def cumulative(freq: DataFrame) -> DataFrame:
    """Groups and names in groups of at least each size, and their shares in percent."""
    above = Window.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = freq
    for what in ("groups", "names"):
        n = F.col(f"num_{what}_at_size")
        out = out.withColumn(f"cum_{what}_ge", F.sum(n).over(above)).withColumn(f"cum_{what}_ge_pct", F.sum(n).over(above) / F.sum(n).over(every) * 100.0)
    return out


def cutoff_explorer(size: DataFrame, candidates: list[int], least: int = 2) -> DataFrame:
    """The cumulative row of each candidate cutoff; sizes that don't occur give nulls."""
    spark = size.sparkSession
    wanted = spark.createDataFrame([(int(c),) for c in sorted(set(candidates))], "size bigint")
    summary = cumulative(frequencies(size, least))
    return wanted.join(summary.select("size", "cum_groups_ge", "cum_groups_ge_pct", "cum_names_ge", "cum_names_ge_pct"), "size", "left")


def suggest_cutoff(size: DataFrame, max_groups: int | None, max_names: int | None = None, least: int = 2) -> DataFrame:
    """The smallest cutoff that keeps to the caps, or null."""
    summary = cumulative(frequencies(size, least))
    for what, most in (("groups", max_groups), ("names", max_names)):
        if most is not None:
            summary = summary.where(F.col(f"cum_{what}_ge") <= most)
    return summary.agg(F.min("size").alias("cutoff"))


def choose_cutoff(size: DataFrame, train: int = 100_000, val: int = 10_000, test: int = 10_000, min_size: int = 4, buffer: float = 0.1) -> DataFrame:
    """The smallest size whose groups of that size or more reach the target, else min_size."""
    target = int((train + val + test) * (1.0 + buffer))
    viable = cumulative(frequencies(size, min_size)).where(F.col("cum_groups_ge") >= target)
    return viable.agg(F.coalesce(F.min("size"), F.lit(min_size).cast("bigint")).alias("cutoff"))


def large_small(size: DataFrame, min_large: int = 20, min_small: int = 1) -> DataFrame:
    n = F.col("size")
    return size.agg(
        F.count_if(n >= min_large).alias("large"), F.count_if((n >= min_small) & (n < min_large)).alias("small"), F.count("*").alias("total")
    )


def triplet_capacity(size: DataFrame, negatives: int = 1) -> DataFrame:
    """Ordered pairs within groups, times the negatives of each."""
    return size.agg((F.coalesce(F.sum(F.col("size") * (F.col("size") - 1)), F.lit(0)) * negatives).alias("triplets"))


def bucket(size: Column, lowest: int, edges: list[int]) -> tuple[Column, Column]:
    """(ordinal, label) of right-closed buckets from `lowest`; what is above the last edge is open."""
    bounds = [lowest - 1, *edges]
    label = lambda i: f"{bounds[i] + 1}-{bounds[i + 1] if i + 1 < len(bounds) else '∞'}"
    ordinal, name = F.lit(len(edges)), F.lit(label(len(edges)))
    for i in reversed(range(len(edges))):
        ordinal, name = F.when(size <= edges[i], F.lit(i)).otherwise(ordinal), F.when(size <= edges[i], F.lit(label(i))).otherwise(name)
    return F.when(size >= lowest, ordinal), F.when(size >= lowest, name)


def histogram(size: DataFrame, least: int = 2, width: int = 10, cap: int = 200, last_is_open: bool = True) -> DataFrame:
    """Counts by bins of `width` sizes up to cap, empty ones included. The sizes above the cap have a
    bin of their own, or fall into the last one."""
    n = F.col("size")
    bins = -(-cap // width)
    which = F.floor((n - 1) / width)
    which = F.when(n > cap, F.lit(bins if last_is_open else bins - 1)).otherwise(which)
    counted = size.where(n >= least).groupBy(which.cast("bigint").alias("bin")).agg(F.count("*").alias("groups"))
    every = size.sparkSession.range(bins + (1 if last_is_open else 0)).withColumnRenamed("id", "bin")
    return every.join(counted, "bin", "left").select("bin", (F.col("bin") * width + 1).alias("low"), F.coalesce("groups", F.lit(0).cast("bigint")).alias("groups"))


def members(rows: DataFrame, group_col: str = "id", name_col: str = "name") -> DataFrame:
    """The sorted names of each group."""
    return rows.groupBy(F.col(group_col).alias("grp")).agg(F.sort_array(F.collect_list(name_col)).alias("names"))
