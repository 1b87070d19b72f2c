"""The extraction over a growing folder of JSON lines: the same plan on a file stream.

Extraction is one narrow projection per line, so no state, watermark or late data comes into it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from onomast.functions.text import clean_line


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return lines.select(clean_line(F.col("value")).alias("value")).where(F.col("value").isNotNull())


def run_stream(lines: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Extract every new file once, appending to Parquet at path, and stop when none is left."""
    return extract(lines).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
