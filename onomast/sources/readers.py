"""Scans: JSON lines in any compression that Spark knows, name tables in CSV, triplets, configuration."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.functions.text import clean_line
from onomast.schemas import NAME_TABLE, TRIPLET

# The tokens that pandas reads as missing and that occur among names and language codes.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
LINE_SUFFIXES = (".json", ".jsonl", ".json.gz", ".jsonl.gz", ".json.bz2", ".jsonl.bz2", ".txt", ".gz", ".bz2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_lines(spark: SparkSession, path: str | list[str], partitions: int | None = None, limit: int = 0) -> DataFrame:
    """Cleaned JSON lines as `value`; bzip2 splits, gzip doesn't and can be dealt out anew. A limit of
    0 means none."""
    lines = spark.read.text(path)
    if partitions:
        lines = lines.repartition(partitions)
    lines = lines.select(clean_line(F.col("value")).alias("value")).where(F.col("value").isNotNull())
    return lines.limit(limit) if limit else lines


def lines_of(spark: SparkSession, lines: Iterable[str], path: str) -> DataFrame:
    """Bounded standard input: landed as a text file at path, which all executors can read, and scanned."""
    spark.createDataFrame([(x.rstrip("\n"),) for x in lines], "value string").write.mode("overwrite").text(path)
    return read_lines(spark, path)


def parse(lines: DataFrame, schema, keep_raw: bool = False) -> DataFrame:
    """Parsed rows; lines that don't parse are left out (see rejects)."""
    row = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    row = row.where(F.col("r").isNotNull() & (F.to_json("r") != "{}"))
    return row.select("r.*", F.col("value").alias("raw")) if keep_raw else row.select("r.*")


def rejects(lines: DataFrame, schema) -> DataFrame:
    """How many lines there are and how many of them don't parse."""
    bad = F.from_json("value", schema).isNull() | (F.to_json(F.from_json("value", schema)) == "{}")
    return lines.agg(F.count("*").alias("lines"), F.count_if(bad).alias("rejected"))


def read_names(spark: SparkSession, path: str, na_tokens: tuple[str, ...] = NA_TOKENS, drop_missing: bool = True, data_col: str = "name") -> DataFrame:
    """A name table; NA tokens become null in every column, and rows without a name go on demand."""
    names = spark.read.schema(NAME_TABLE).options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    if na_tokens:
        names = names.select(*(F.when(~F.col(c).isin(*na_tokens), F.col(c)).alias(c) for c in names.columns))
    return names.where(F.col(data_col).isNotNull()) if drop_missing else names


def read_clusters(names: DataFrame, cluster_col: str = "canonical", name_col: str = "name", lang_col: str = "language") -> DataFrame:
    """(cluster_id, name, lang) with blanks as null; the cluster falls back to id, then canonical."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in names.columns else F.lit(None).cast("string")
    cid = F.coalesce(blank(cluster_col), blank("id"), blank("canonical"))
    rows = names.select(cid.alias("cluster_id"), blank(name_col).alias("name"), blank(lang_col).alias("lang"))
    return rows.where(F.col("cluster_id").isNotNull() & F.col("name").isNotNull())


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIPLET).json(path)


def read_config(spark: SparkSession, path: str) -> dict:
    """A small JSON document."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect()))
