r"""Substring duplicates by content-defined chunking.

A rolling gear hash cuts every text into small chunks (about 32 bytes), wherever the bytes say so:
a passage gets the same cuts in every document, whatever stands before it. The digest of each two
neighbouring chunks is a unit of comparison. Units that more than one document holds are duplicates,
and neighbouring duplicate units form a run; runs of `min_bytes` or more are repeated passages. One
whole chunk is lost at either end of a passage, so min_bytes lies well below the passages to be found.

Which digests come again is counted with partial aggregates, so that a digest of a third of all
documents reaches its task as a row per partition. A bitmap of these digests, sized by their count up
to 16 MB, picks their units where they stand; the rest of the units never moves. First and last
document of a digest are partial aggregates as well, and meet the picked units in a join, whose
skewed side AQE splits. Units that the bitmap lets through by chance have no second document there.

Defined cases: null and empty texts have no units; a document that repeats itself is no duplicate by
that; exact copies repeat each other throughout; repeated rows count as documents of their own, as do
rows without an id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onomast.llm.common import bitmap, discard, in_batches, materialize
from onomast.llm.gear import cuts

UNITS = "doc_id bigint, row_key bigint, i int, digest bigint, start int, end int"
CUT = {"bits": 4, "least": 12, "most": 256, "dtype": np.uint16}
_LEAST_SLOTS, _MOST_SLOTS = 1 << 18, 1 << 27


def units_of(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(text, unit index, digest, start byte, end byte) of all units of the texts."""
    import xxhash

    whole = [(t or "").encode() for t in texts]
    ends = [cuts(np.frombuffer(t, np.uint8), **CUT) for t in whole]
    text, index, digest, start, end = [], [], [], [], []
    hash_ = xxhash.xxh3_64_intdigest
    for k, (t, e) in enumerate(zip(whole, ends, strict=True)):
        n = max(len(e) - 1, min(len(e), 1))  # a single chunk is a unit of its own
        edges = [0, *e.tolist()]
        stops = edges[2:] if len(e) > 1 else edges[1:]
        digest += [hash_(t[a:b]) for a, b in zip(edges, stops, strict=False)]
        start += edges[:n]
        end += stops[:n]
        text += [k] * n
        index += range(n)
    return np.array(text, np.int64), np.array(index, np.int32), np.array(digest, np.uint64).astype(np.int64), np.array(start, np.int32), np.array(end, np.int32)


def units(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, i, digest, start, end); row_id orders the rows by document id."""
    out = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("i", pa.int32()), ("digest", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 36
        for b in batches:
            text, index, digest, start, end = units_of(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(text)), pa.array(place + text), pa.array(index), pa.array(digest), pa.array(start), pa.array(end)], schema=out)
            place += b.num_rows

    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_batches(wanted, run, UNITS, rows=200)


def slots_for(digests: int) -> int:
    """Eight slots a digest, as a power of two within the bounds."""
    return min(max(1 << (8 * digests).bit_length(), _LEAST_SLOTS), _MOST_SLOTS)


def shared_units(cut: DataFrame) -> DataFrame:
    """The units whose digest another row holds too, and few others, written."""
    again = cut.groupBy("digest").agg(F.min("row_key").alias("low"), F.max("row_key").alias("high")).where("low != high").select("digest")
    again = materialize(again, "cdc-again")
    size = slots_for(again.count())
    seen = cut.sparkSession.sparkContext.broadcast(bitmap(again.select(F.col("digest").bitwiseAND(F.lit(size - 1)).alias("slot")), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b["digest"].to_numpy() & (size - 1)
            yield b.filter(pa.array(seen.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1, pa.uint8()).cast(pa.bool_()))

    shared = materialize(in_batches(cut, run, UNITS, rows=10000), "cdc-shared")
    seen.destroy()
    discard(again)
    return shared


def repeated_passages(docs: DataFrame, min_bytes: int = 120) -> DataFrame:
    """(doc_id, start_byte, end_byte, n_units, first, first_parts) for every place of a repeated passage:
    `first` where this is the first document, by id, that holds any of it; first_parts are the stretches
    (start_byte, end_byte) of it of which that is so, all or some or none of the place."""
    cut = materialize(units(docs), "cdc-units")
    shared = shared_units(cut)
    discard(cut)
    row = F.struct("doc_id", "row_key")
    held = shared.groupBy("digest").agg(F.min(row).alias("low"), F.max(row).alias("high")).where(F.col("low") != F.col("high")).select("digest", "low")
    shared = shared.join(held, "digest").select("doc_id", "row_key", "i", "start", "end", (F.col("low") == row).alias("first"))
    run = F.col("i") - F.row_number().over(Window.partitionBy("row_key").orderBy("i"))
    # The units of a run may stand first in different documents: its parts are the stretches of one answer.
    part = F.col("i") - F.row_number().over(Window.partitionBy("row_key", "first").orderBy("i"))
    parts = shared.withColumn("run", run).withColumn("part", part).groupBy("row_key", "run", "first", "part").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start_byte"), F.max("end").alias("end_byte"), F.count("*").alias("n_units")
    )
    own = F.sort_array(F.collect_list(F.when(F.col("first"), F.struct("start_byte", "end_byte"))))
    runs = parts.groupBy("row_key", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), F.sum("n_units").alias("n_units"), F.bool_and("first").alias("first"), own.alias("first_parts")
    )
    return runs.where(F.col("end_byte") - F.col("start_byte") >= min_bytes).drop("row_key", "run")


def _cuts(places: list[dict]) -> Iterator[tuple[int, int]]:
    """What is left of the places without the parts that stand first here."""
    for p in places:
        at = p["start_byte"]
        for own in p["first_parts"]:
            if at < own["start_byte"]:
                yield at, own["start_byte"]
            at = max(at, own["end_byte"])
        if at < p["end_byte"]:
            yield at, p["end_byte"]


def without_repeats(docs: DataFrame, min_bytes: int = 120) -> DataFrame:
    """docs with every repeated passage cut from their text but where it, or a part of it, stands first. Ids must be
    unique; null texts stay null, and a text that is all repeats becomes empty."""
    if "__cuts" in docs.columns:
        raise ValueError("the column __cuts is this operator's own")
    found = repeated_passages(docs, min_bytes).where("not first and doc_id is not null")
    place = F.struct("start_byte", "end_byte", "first_parts")
    cut_at = found.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_list(place)).alias("__cuts"))  # of one text
    joined = docs.join(cut_at, F.col("doc_id").cast("long") == F.col("__id"), "left").drop("__id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, cuts_ in zip(b["text"].to_pylist(), b["__cuts"].to_pylist(), strict=True):
                if text is not None and cuts_:
                    raw, at, kept = text.encode(), 0, []
                    for start, end in _cuts(cuts_):
                        kept.append(raw[at:start])
                        at = max(at, end)
                    # A chunk may end within a character; what is left of one goes with the passage.
                    text = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
                texts.append(text)
            names = [n for n in b.schema.names if n != "__cuts"]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b[n] for n in names], names=names)

    return in_batches(joined.select(*docs.columns, "__cuts"), run, fields)
