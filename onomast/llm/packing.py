r"""Best-fit packing by minimum bin slack.

Documents become token ids; one longer than a sequence is cut into full pieces behind a first piece
that may be shorter. The packing depends on the lengths alone, and of those there are at most as
many as a sequence has places. So the lengths are counted over the whole corpus, and the driver
packs the counts: per bin, the longest length left is set, and a bitset subset-sum programme over the
lengths that are left finds the fullest feasible combination to go with it; that pattern is removed
as often as the counts allow. The steps are bounded by the sequence length, not by the corpus.

A piece's place follows from its rank among the pieces of its length. Ranks come from counts per
(length, salt), so a length that a third of all rows share is spread over many tasks.

Defined cases: null text is empty and becomes the end id alone; repeated rows are packed each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onomast.llm.common import in_batches, materialize, ratio_up
from onomast.llm.tokens import default_path, encoder

SALT_ROWS = 50_000


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but perhaps the first."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def token_pieces(docs: DataFrame, size: int, end_id: int, path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = encode(text or "")
                ids.append(end_id)
                raw = memoryview(np.array(ids, "<u4")).cast("B")
                rows += [(doc_id, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids), size))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_batches(wanted, run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(counts: dict[int, int], room: int) -> Counter:
    """The multiset of the counted lengths with the largest sum of at most room (bit s of the set of
    sums says that s can be reached; longer lengths come first, and a full bin ends the search)."""
    sums, stages, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            take = min(k, left)
            grown = (sums | sums << (length * take)) & mask
            if grown != sums:
                stages.append((length, take, sums))
                sums = grown
            left, k = left - take, 2 * k
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, Counter()
    for length, take, before in reversed(stages):
        if not before >> at & 1:
            chosen[length] += take
            at -= length * take
    return chosen


def minimum_bin_slack(counts: dict[int, int], size: int) -> list[tuple[Counter, int]]:
    """Patterns (lengths of one bin) and how often each is used; they take up all the counts."""
    left, patterns = {k: v for k, v in counts.items() if v}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        pattern = fullest({k: v for k, v in left.items() if v}, size - seed)
        left[seed] += 1
        pattern[seed] += 1
        times = min(left[k] // m for k, m in pattern.items())
        for k, m in pattern.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
        patterns.append((pattern, times))
    return patterns


def slots(patterns: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """Per length, the ranges of ranks that each pattern takes: sorted by (length, first rank)."""
    rows, used, base = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            m = pattern[length]
            rows.append((length, used[length], m, base, offset))
            used[length] += m * times
            offset += m * length
        base += times
    rows.sort()
    names = ("length", "first", "per", "base", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def ranked(pieces: DataFrame, n: int) -> DataFrame:
    """pieces with `rank`, from 0 among those of the same length."""
    salts = ratio_up(n, SALT_ROWS, 8)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = salted.withColumn("local", F.row_number().over(own) - 1)
    return local.join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local")).drop("salt", "local", "before")


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(token_pieces(docs, size, end_id, tokenizer or default_path()), "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    place = slots(minimum_bin_slack(counts, size))
    n = sum(counts.values())
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One sorted key for (length, rank): ranks stay below n.
        keys = place["length"] * (n + 1) + place["first"]
        for b in batches:
            length, rank = (b[c].to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * (n + 1) + rank, side="right") - 1
            within = rank - place["first"][at]
            seq = place["base"][at] + within // place["per"][at]
            offset = place["offset"][at] + within % place["per"][at] * length
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names[:5]), pa.array(seq), pa.array(offset)], names=names)

    return ranked(pieces, n).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
