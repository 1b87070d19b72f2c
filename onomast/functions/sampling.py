"""Randomness as a pure function of the data: the same seed and keys give the same draw anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *keys: str | Column) -> Column:
    """A whole number below 2^32: the first eight hex digits of an MD5 over seed and keys."""
    parts = [F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def unit(seed: int, *keys: str | Column) -> Column:
    """The draw as a fraction of one."""
    return draw(seed, *keys) / F.lit(4294967296.0)


def half_even(col: Column) -> Column:
    """Rounded to the nearest whole number, halves to the even one."""
    return F.rint(col).cast("long")


def placed(rows: DataFrame, by: list[str], number: Column, ties: list[str]) -> DataFrame:
    """rows with `place`, from 1 in the order of a draw and of `ties` among the rows of equal `by` columns (none: among
    all), and `total`, how many those are. Ranges of the draw are numbered apart, each from where the counts of the
    ranges before it end: a task holds 1 / 1024 of a group, whatever its size, and only counts are ordered as a whole."""
    parted = rows.withColumn("__draw", number).withColumn("__range", F.shiftright("__draw", 22))
    counts = parted.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    keys = by or [F.lit(1)]
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*keys)).alias("total"))
    own = F.row_number().over(Window.partitionBy(*by, "__range").orderBy("__draw", *ties))
    return parted.join(starts, [*by, "__range"]).withColumn("place", F.col("__before") + own).drop("__draw", "__range", "__before")
