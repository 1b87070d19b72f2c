"""Sinks: CSV that other CSV readers agree with, and JSON lines that keep nulls and characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}


def write_names(names: DataFrame, path: str) -> None:
    names.select("id", "canonical", "language", "name").write.mode("overwrite").options(**_CSV).csv(path)


def write_triplets(triplets: DataFrame, path: str) -> None:
    triplets.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_augmented(rows: DataFrame, path: str) -> None:
    rows.select("id", "name", "language", "augmented", F.to_json("ops").alias("ops")).write.mode("overwrite").options(**_CSV).csv(path)


def write_rich_triplets(rows: DataFrame, path: str) -> None:
    flat = rows.withColumns({c: F.to_json(c) for c in ("ops_anchor", "ops_pos")})
    flat = flat.select("cluster_id", "anchor", "anchor_lang", "pos", "pos_lang", "neg", "neg_lang", "neg_strategy", "ops_anchor", "ops_pos")
    flat.write.mode("overwrite").options(**_CSV).csv(path)


def send_records(records: DataFrame, send: Callable[[Iterator[Row]], None]) -> None:
    """Hand each partition's JSON records to an external engine's client, made inside `send`."""
    records.foreachPartition(send)
