r"""Token ids in binary sequences, packed by best-fit decreasing with a segment tree.

Documents are dealt to shards by a hash of their id; a shard holds about `shard_bytes` of text, so
that its ids fit in one task. Within a shard the documents are tokenized, overlong ones split into
full pieces behind a first one that may be shorter (nothing is lost: the pieces' ids joined are the
document's), and the pieces, longest first, each go into the open sequence with the least room that
still holds them. A segment tree over the amounts of room finds that sequence in log time. Each
packed row is one line of the id matrix with its segments' cumulative lengths and position ids that
start anew at every segment.

Defined cases: null text is empty and becomes the end id alone; repeated rows are packed each; an
empty table gives an empty result; a very long document spreads over as many sequences as it needs;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm.common import ratio_up, text_or_empty
from onomast.llm.packing import cut
from onomast.llm.tokens import default_path, encoder


class RoomTree:
    """Counts of open bins by their room, 0 to size; finds the least room that is at least x."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.sum = [0] * (2 * self.base)

    def add(self, room: int, n: int) -> None:
        i = room + self.base
        while i:
            self.sum[i] += n
            i >>= 1

    def least(self, x: int) -> int | None:
        i = x + self.base
        if self.sum[i]:
            return x
        while i > 1:  # up until a right sibling has bins, then down to its leftmost
            if not i & 1 and self.sum[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.sum[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return None


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices into lengths; each length is 1 to size."""
    tree, by_room, bins = RoomTree(size), defaultdict(list), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room = tree.least(lengths[k])
        if room is None:
            room, b = size, len(bins)
            bins.append([])
        else:
            b = by_room[room].pop()
            tree.add(room, -1)
        bins[b].append(k)
        if left := room - lengths[k]:
            by_room[left].append(b)
            tree.add(left, 1)
    return bins


SCHEMA = "sequence_id bigint, n_tokens int, n_segments int, doc_ids array<bigint>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"


def packed(
    docs: DataFrame,
    size: int = 2048,
    end_id: int = 50256,
    tokenizer: str | None = None,
    shard_bytes: int = 24 << 20,
    pad_id: int | None = None,
) -> DataFrame:
    """The id matrix: a row per sequence; input_ids (little-endian unsigned 32-bit, padded to
    `size`), position_ids (16-bit for sizes up to 65536), cu_seqlens with a leading 0."""
    if not 0 < size <= 65536:
        raise ValueError("positions have 16 bits: size is 1 to 65536")
    path, pad = tokenizer or default_path(), end_id if pad_id is None else pad_id
    wanted = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    volume = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = ratio_up(volume, shard_bytes)
    out = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        encode, shard = encoder(path), group["shard"][0].as_py()
        order = sorted(range(group.num_rows), key=lambda k: ((v := group["doc_id"][k].as_py()) is None, v or 0, group["text"][k].as_py() if v is None else ""))
        ids, parts = [], []  # of each document; (document, piece, start, length)
        for k in order:
            x = encode(group["text"][k].as_py())
            x.append(end_id)
            ids.append(np.array(x, "<u4"))
            parts += [(len(ids) - 1, p, s, n) for p, (s, n) in enumerate(cut(len(x), size))]
        doc_ids = [group["doc_id"][k].as_py() for k in order]
        rows = []
        for b, held in enumerate(best_fit_decreasing([p[3] for p in parts], size)):
            inside = [parts[k] for k in held]
            cu = np.concatenate([[0], np.cumsum([p[3] for p in inside])])
            line = np.full(size, pad, "<u4")
            line[: cu[-1]] = np.concatenate([ids[d][s : s + n] for d, _, s, n in inside])
            position = np.zeros(size, "<u2")
            position[: cu[-1]] = np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))
            rows.append((shard << 32 | b, int(cu[-1]), len(inside), [doc_ids[p[0]] for p in inside], [p[1] for p in inside], cu.tolist(), line.tobytes(), position.tobytes()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    shard = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(shards)).alias("shard")
    return wanted.select("doc_id", "text", shard).groupBy("shard").applyInArrow(run, SCHEMA)


def write_packed(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the id matrix and return it as written."""
    packed(docs, **options).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def digest(matrix: DataFrame) -> DataFrame:
    """The matrix with checksums in place of its binary columns."""
    return matrix.select("sequence_id", "n_tokens", "n_segments", "doc_ids", "pieces", "cu_seqlens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))


def unpack(row: dict) -> list[tuple[int, int, np.ndarray]]:
    """(doc_id, piece, ids) of the segments of one row of the matrix."""
    ids, cu = np.frombuffer(row["input_ids"], "<u4"), row["cu_seqlens"]
    return [(d, p, ids[a:b]) for d, p, a, b in zip(row["doc_ids"], row["pieces"], cu[:-1], cu[1:], strict=True)]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
