r"""Media columns: payloads kept once as content-defined chunks, and read back verified.

A payload is cut by a rolling gear hash; each chunk is stored once, compressed, under its digest,
and a payload is the ordered list of its chunks. Three passes read the texts and none of them
shuffles all their bytes:

1. digests: every payload's SHA-256 and chunk list, without bytes. Spark joins on these small rows
   find the digests that occur more than once and name one owner for each.
2. store: chunks that surely occur once are written where they were cut. A bitmap of fixed size over
   the repeated digests tells them apart; chunks that may repeat go through a semi join with the
   owners, which leaves one copy of each.
3. read: a payload that is a single chunk is verified and described where it is stored; only the
   chunks of longer payloads are brought together by an ordered join.

Equal payloads are one medium: their rows share the stored form and its features, so a group of
copies, however large, costs one medium and small rows.

Defined cases: null text counts as empty, and an empty payload is padded to one unit; repeated rows
each come out; an empty table gives an empty result; other columns are not read; a payload whose
bytes read back differ from their digest raises an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm.common import bitmap, in_batches, in_bitmap, materialize
from onomast.llm.gear import cuts

UNIT = 576
PAD = b"\xff"
#: Chunks average about 16 KiB.
CUT = {"bits": 14, "least": 4096, "most": 65536}
SLOTS = 1 << 24
LEVEL = 6


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length without padding, and the padded payload."""
    raw = (text or "").encode()
    return len(raw), raw + PAD * (-len(raw) % UNIT or (0 if raw else UNIT))


def chunks_of(payload: bytes) -> list[bytes]:
    ends = cuts(np.frombuffer(payload, np.uint8), **CUT).tolist() if len(payload) > CUT["least"] else [len(payload)]
    return [payload[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _digest(chunk: bytes, whole: bool) -> bytes:
    """A chunk that is a whole payload and one that is part of a longer one count as two."""
    return hashlib.blake2b(chunk, digest_size=16, person=b"whole" if whole else b"part").digest()


def _slot(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") % SLOTS


def features(payload: bytes) -> str:
    """Mean, spread and entropy of the 8-bit samples."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p, v = n / n.sum(), np.arange(256)
    mean = float((p * v).sum())
    spread = float((p * (v - mean) ** 2).sum()) ** 0.5
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return f"mean={mean:.6f};std={spread:.6f};entropy={entropy:.6f};samples={len(payload)}"


def _described(payload: bytes, stored: list[bytes]) -> tuple:
    joined = b"".join(stored)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(joined), hashlib.sha256(joined).hexdigest(), features(payload)


MEDIA = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _digests(texts: DataFrame) -> DataFrame:
    """A row per text: its payload's SHA-256 and ordered chunk digests."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("chunks", pa.list_(pa.binary())), ("slots", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b["text"].to_pylist():
                n, payload = payload_of(text)
                parts = chunks_of(payload)
                digests = [_digest(c, len(parts) == 1) for c in parts]
                rows.append((n, hashlib.sha256(payload).digest(), digests, [_slot(d) for d in digests]))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(cols, out.types[1:], strict=True))], schema=out)

    return materialize(in_batches(texts, run, "doc_id bigint, n_bytes bigint, sha binary, chunks array<binary>, slots array<bigint>"), "media-digests")


def _chunk_rows(texts: DataFrame, repeated: np.ndarray, wanted: bool) -> DataFrame:
    """Compressed chunks whose slot is among the repeated ones, or is not: (digest, sha, seq, whole, body)."""
    out = pa.schema([("digest", pa.binary()), ("sha", pa.binary()), ("seq", pa.int32()), ("whole", pa.bool_()), ("body", pa.binary())])
    bits = texts.sparkSession.sparkContext.broadcast(repeated)  # SLOTS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze, table, seen = zstandard.ZstdCompressor(LEVEL), bits.value, set()
        for b in batches:
            rows = []
            if len(seen) > 1 << 18:
                seen.clear()
            for text in b["text"].to_pylist():
                _, payload = payload_of(text)
                parts, sha = chunks_of(payload), None
                for k, c in enumerate(parts):
                    digest = _digest(c, len(parts) == 1)
                    slot = _slot(digest)
                    if in_bitmap(table, slot) == wanted:
                        sha = sha or hashlib.sha256(payload).digest()
                        if (digest, sha, k) not in seen:
                            seen.add((digest, sha, k))
                            rows.append((digest, sha, k, len(parts) == 1, squeeze.compress(c)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out.types, strict=True)], schema=out)

    return in_batches(texts.select("text"), run, "digest binary, sha binary, seq int, whole boolean, body binary")


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digests, chunk store), both written: digests has a row per document, the store one per chunk."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    digests = _digests(texts)
    listed = digests.dropDuplicates(["sha"]).select("sha", F.posexplode(F.arrays_zip("chunks", "slots")).alias("seq", "c"))
    listed = listed.select("sha", "seq", F.col("c.chunks").alias("digest"), F.col("c.slots").alias("slot"))
    # Copies of a payload repeat its chunks too, in whatever tasks they are read.
    copies = digests.groupBy("sha").agg(F.count("*").alias("n"), F.first("chunks").alias("chunks"), F.first("slots").alias("slots"))
    by_copy = copies.where(F.col("n") > 1).select(F.explode("slots").alias("slot"))
    by_chunk = listed.groupBy("digest").agg(F.count("*").alias("n"), F.min("slot").alias("slot")).where(F.col("n") > 1).select("slot")
    owners = listed.groupBy("digest").agg(F.min(F.struct("sha", "seq")).alias("o")).select("digest", "o.sha", "o.seq")
    repeated = bitmap(by_copy.unionByName(by_chunk), SLOTS)
    once = _chunk_rows(texts, repeated, False)
    maybe = _chunk_rows(texts, repeated, True).join(owners, ["digest", "sha", "seq"], "left_semi")
    # Copies of the owner itself are left: one of each digest stays.
    maybe = maybe.groupBy("digest").agg(F.first(F.struct("sha", "seq", "whole", "body")).alias("c")).select("digest", "c.*")
    return digests, materialize(once.unionByName(maybe).select("digest", "whole", "body"), "media-store")


def read(digests: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per medium, from the stored bytes: `sha`, and the columns of MEDIA."""
    out = pa.schema([("sha", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for digest, body in zip(b["digest"].to_pylist(), b["body"].to_pylist(), strict=True):
                payload = expand.decompress(body)
                if _digest(payload, True) != digest:
                    raise ValueError("a stored chunk differs from its digest")
                d = _described(payload, [body])
                rows.append((bytes.fromhex(d[1]), *d))
            cols = list(zip(*rows, strict=True)) or [[]] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out.types, strict=True)], schema=out)

    def joined(group: pa.Table) -> pa.Table:
        import zstandard

        expand, sha = zstandard.ZstdDecompressor(), group["sha"][0].as_py()
        bodies = [body for _, body in sorted(zip(group["seq"].to_pylist(), group["body"].to_pylist(), strict=True))]
        payload = b"".join(map(expand.decompress, bodies))
        if hashlib.sha256(payload).digest() != sha or len(bodies) != group["n"][0].as_py():
            raise ValueError("a payload read back differs from its digest")
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip((sha, *_described(payload, bodies)), out.types, strict=True)], schema=out)

    alone = in_batches(chunks.where("whole").select("digest", "body"), single, f"sha binary, {MEDIA}")
    lists = digests.where(F.size("chunks") > 1).select("sha", "chunks").dropDuplicates(["sha"])
    lists = lists.select("sha", F.size("chunks").alias("n"), F.posexplode("chunks").alias("seq", "digest"))
    parts = lists.join(chunks.where(~F.col("whole")).select("digest", "body"), "digest")
    return materialize(alone.unionByName(parts.select("sha", "n", "seq", "body").groupBy("sha").applyInArrow(joined, f"sha binary, {MEDIA}")), "media-read")


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""
    digests, chunks = store(docs)
    described = read(digests, chunks)
    return digests.select("doc_id", "n_bytes", "sha").join(described, "sha").drop("sha")
