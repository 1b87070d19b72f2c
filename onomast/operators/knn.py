"""Nearest neighbours by inner product: exact by blocks, or by the cells of a coarse quantizer.

Both sides are packed into blocks, each query block meets each gallery block in one matrix product,
and only the best of each block go on. Nothing is broadcast, and a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.functions.vectors import l2_normalize

DIGITS = 6
#: Scores that a task works out at once.
PIECE = 1 << 20


def hashed_ngrams(dim: int = 256, sizes: tuple[int, ...] = (2, 3)) -> Callable[[list[str]], np.ndarray]:
    """The default encoder: character n-grams hashed into dim buckets, with a sign each."""

    def encode(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts, strict=True):
            padded = f" {t.lower()} "
            for n in sizes:
                for i in range(len(padded) - n + 1):
                    h = xxhash.xxh3_64_intdigest(padded[i : i + n])
                    row[h % dim] += 1 if h >> 63 else -1
        return out

    return encode


def encode(texts: DataFrame, encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_ngrams, text_col: str = "text") -> DataFrame:
    """(text, embedding) for each distinct text; the factory runs once per Python worker task, so that a
    model is loaded where it is used. Vectors come out with length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder_factory()
        for b in batches:
            v = np.asarray(model(b["text"].to_pylist()), np.float64)
            norms = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.where(norms > 0, norms, 1)
            yield pa.RecordBatch.from_arrays([b["text"], pa.array(list(v), pa.list_(pa.float64()))], names=["text", "embedding"])

    distinct = texts.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    return distinct.mapInArrow(run, "text string, embedding array<double>")


def half_precision(v: Column) -> Column:
    """Rounded to half precision and back; Spark has no such type."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.asarray(x, np.float16).astype(np.float32), na_action="ignore")

    return run(v)


def _packed(rows: DataFrame, block_rows: int, fields: dict[str, str], n: int | None = None) -> tuple[DataFrame, int]:
    """One row per block: the vectors as one binary, the other fields as arrays."""
    n = rows.count() if n is None else n
    blocks = max(1, -(-n // block_rows))
    names = [*fields]
    out = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("v", pa.binary()), *((f, pa.list_({"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[t])) for f, t in fields.items())])

    def run(group: pa.Table) -> pa.Table:
        v = np.array(group["v"].to_pylist(), np.float64)
        row = [group["block"][0].as_py(), v.shape[1], v.tobytes(), *(group[f].to_pylist() for f in names)]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, out.types, strict=True)], schema=out)

    schema = "block bigint, dim int, v binary, " + ", ".join(f"{f} array<{t}>" for f, t in fields.items())
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(*names), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, schema), blocks


def top_k(queries: DataFrame, gallery: DataFrame, k: int, other_groups_only: bool = False, block_rows: int = 4096) -> DataFrame:
    """(qid, id, score, rank) of the k best of gallery(id, grp, v) for each of queries(qid, grp, v, low,
    high), low <= score < high. Scores are rounded to six digits; ties go to the smaller id."""
    # What is packed must be the same in every task that packs it, so no column of it is random.
    left, n_left = _packed(queries.select("qid", F.col("grp").cast("string").alias("grp"), "v", "low", "high"), block_rows, {"qid": "string", "grp": "string", "low": "double", "high": "double"})
    right, n_right = _packed(gallery.select("id", F.col("grp").cast("string").alias("grp"), "v"), block_rows, {"id": "bigint", "grp": "string"})
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_right - 1).cast("bigint"))))
    right = right.select(F.col("block").alias("other"), F.col("v").alias("v2"), F.col("id"), F.col("grp").alias("grp2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, b = (np.frombuffer(r[x], np.float64).reshape(-1, r["dim"]) for x in ("v", "v2"))
                ids, codes = np.array(r["id"]), {g: i for i, g in enumerate(dict.fromkeys([*r["grp"], *r["grp2"]]))}
                order = np.argsort(ids, kind="stable")
                b, ids = b[order], ids[order]
                g2 = np.array([codes[g] for g in r["grp2"]])[order]
                g1 = np.array([codes[g] for g in r["grp"]])
                for at in range(0, len(a), 256):
                    s = np.round(a[at : at + 256] @ b.T, DIGITS)
                    low, high = (np.array(r[x][at : at + 256])[:, None] for x in ("low", "high"))
                    good = (s >= low) & (s < high)
                    if other_groups_only:
                        good &= g1[at : at + 256, None] != g2[None, :]
                    s = np.where(good, s, -np.inf)
                    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    score = np.take_along_axis(s, best, 1)
                    row, col = np.nonzero(np.isfinite(score))
                    yield pa.RecordBatch.from_arrays([pa.array([r["qid"][at + x] for x in row], pa.string()), pa.array(ids[best[row, col]], pa.int64()), pa.array(score[row, col])], names=["qid", "id", "score"])

    met = left.join(right, "other").repartition(n_left * n_right, "block", "other").mapInArrow(run, "qid string, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def unbounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("inf"))})


def knn_join(rows: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k nearest of rows(id, grp, v) for each of them, itself included."""
    return top_k(unbounded(rows).withColumn("qid", F.col("id").cast("string")), rows, k)


def nearest(gallery: DataFrame, query: list[float], k: int, tau: float | None = None, inside: bool = True) -> DataFrame:
    """The k rows of gallery(id, v) nearest to a query, by cosine distance; with tau only those of a
    similarity of tau or more, asked for before the limit or after it."""
    from onomast.functions.vectors import cosine

    scored = gallery.select("id", F.round(cosine(F.col("v"), F.array(*map(F.lit, query))), DIGITS).alias("score"))
    ordered = lambda df: df.orderBy(F.desc("score"), "id").limit(k)
    if tau is None:
        return ordered(scored)
    return ordered(scored.where(F.col("score") >= tau)) if inside else ordered(scored).where(F.col("score") >= tau)


def ivf_knn(rows: DataFrame, k: int, nlist: int | None = None, nprobe: int = 16, sample_rows: int = 500_000, seed: int = 42, block_rows: int = 8192) -> DataFrame:
    """Approximate neighbours: cells of a k-means over a sample of at most sample_rows; each query looks
    into the nprobe cells whose centres are nearest. nlist is 4 sqrt(n), at least 1024, at most n.

    The rows of a cell and the queries that look into it are dealt to blocks of about block_rows, and a task scores
    one block against another in pieces, so neither a popular cell nor one of many copies is held as a whole."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = rows.count()
    nlist = max(1, min(n, nlist or max(1024, int(4 * n**0.5))))
    unit = rows.select("id", "grp", l2_normalize(F.col("v")).alias("v"))
    share = min(1.0, sample_rows / max(1, n))
    sample = unit if share == 1.0 else unit.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    model = KMeans(k=nlist, seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
    centres = np.array(model.clusterCenters())
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PIECE // len(centres))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                s = part["v"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) @ centres.T
                first = np.argsort(-s, axis=1, kind="stable")[:, :nprobe].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["id"], part["v"], pa.array(list(first), pa.list_(pa.int32()))], names=["id", "v", "cells"])

    cells = unit.select("id", "v").mapInArrow(assign, "id bigint, v array<double>, cells array<int>")
    looked = cells.select(F.posexplode("cells").alias("nth", "cell"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.count(c) / F.lit(block_rows))).cast("int")
    sizes = F.broadcast(looked.groupBy("cell").agg(blocks(F.when(F.col("nth") == 0, 1)).alias("held"), blocks("nth").alias("asked")))
    dealt = lambda i, c: F.pmod(F.xxhash64(i), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    # Both sides come from `cells`; new names for one of them keep Spark from taking its columns for the other's.
    held = cells.select(F.col("id").alias("hid"), F.col("v").alias("hv"), F.get("cells", F.lit(0)).alias("cell")).join(sizes, "cell")
    held = held.select(F.col("hid").alias("id"), F.col("hv").alias("v"), F.col("cell").alias("hcell"), dealt("hid", "held").alias("hg"), each("asked").alias("hq"))
    asked = cells.select("id", "v", F.explode("cells").alias("cell")).join(sizes, "cell").select("id", "v", "cell", each("held").alias("g"), dealt("id", "asked").alias("q"))

    def search(q: pa.Table, g: pa.Table) -> pa.Table:
        if not (q.num_rows and g.num_rows):
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        order = np.argsort(g["id"].to_numpy(), kind="stable")
        ids, b, a = g["id"].to_numpy()[order], matrix(g)[order], matrix(q)
        # Vectors have length 1, so a score in whole units and a place fit one number, whose order is that of the result.
        best, step, bits, most = [], max(1, PIECE // len(b)), len(b).bit_length(), min(k, len(b))
        for at in range(0, len(a), step):
            keys = np.rint(a[at : at + step] @ b.T * -(10**DIGITS)).astype(np.int64) << bits | np.arange(len(b))
            best.append(np.partition(keys, most - 1, axis=1)[:, :most].ravel())
        keys = np.concatenate(best)
        return pa.table({"qid": np.repeat(q["id"].to_numpy(), most), "id": ids[keys & (1 << bits) - 1], "score": -(keys >> bits) / 10**DIGITS})

    found = asked.groupBy("cell", "g", "q").cogroup(held.groupBy("hcell", "hg", "hq")).applyInArrow(search, "qid bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
