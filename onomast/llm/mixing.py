r"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words; every document of it wants p = target / size copies. The whole
part of p is taken at once. The fractional parts are rounded by duels: two fractional documents
move words between them, in a random direction whose odds keep each expectation, until one of them
is whole. A source's sum of words therefore stays what it was, up to the one document left at the end.

Duels run per (source, shard) in parallel; each shard leaves at most one fractional document, and
the shards' residuals meet in a tree of fan-in 64 until one per source is left. Larger documents duel
first, so that what is left at the end is small. A row is known by its id, source and text (by its
hash) and its number among those that have all of these in common. Shards are dealt by a hash of that,
so a source, an id or a text that a third of all rows hold is spread like any other. All random
numbers are hashes of it and the seed: reruns agree, whatever the partitioning.

Defined cases: null text has size 0; a null source is a source of its own, listed last; a source
without words has target 0; documents without words take 0; repeated rows, and rows that share an id
or have none, are rounded each on its own; an empty table gives an empty result; columns other than
doc_id, source and text are not read, and repeated() gives them back whatever their names.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onomast.llm.common import materialize, ratio_up

WORD = r"[^\x20\x09-\x0D]+"
FAN_IN = 64
KEY = ["doc_id", "source", "text_key"]  # of rows that can't be told apart by what the mix reads
_RUN = 1 << 16  # equal rows that are numbered at a time


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """(source, source_size, target) of sizes(source, size, n): weights dealt out to the sources by code point in turn, the
    excess over limit x size reshared by weight among the rest until no source is above."""
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row per source
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", weight), "mix-sources")
    ceiling = F.col("source_size") * F.lit(float(limit))
    total = share * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # each turn closes a source at least, in practice almost all of them at once
        full = ceiling <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(full, ceiling).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        taken, open_weight = float(row[0] or 0), float(row[1] or 0)
        new = (total - taken) / open_weight if open_weight > 0 else level
        if new <= level:
            break
        level = new
    return sources.select("source", "source_size", F.least(ceiling, F.col("weight") * F.lit(level)).alias("target"))


def _draw(*key) -> float:
    return struct.unpack("<Q", hashlib.blake2b(repr(key).encode(), digest_size=8).digest())[0] / 2.0**64


def duels(rows: list[tuple], seed: int) -> tuple[list[tuple], tuple | None]:
    """rows: (id, size, fraction) in order. Returns (id, size, 0 or 1) of the whole ones and the
    fractional one that is left."""
    done, cur = [], None
    for row in rows:
        if cur is None:
            cur = row
            continue
        (i, wi, fi), (j, wj, fj) = cur, row
        up, down = min((1 - fi) * wi, fj * wj), min(fi * wi, (1 - fj) * wj)
        gain = up if _draw(seed, i, j) * (up + down) < down else -down
        # The side that reaches its bound is set to it exactly, free of rounding.
        ni = 1.0 if gain > 0 and up == (1 - fi) * wi else 0.0 if gain <= 0 and down == fi * wi else min(1.0, max(0.0, fi + gain / wi))
        nj = 0.0 if gain > 0 and up == fj * wj else 1.0 if gain <= 0 and down == (1 - fj) * wj else min(1.0, max(0.0, fj - gain / wj))
        cur = None
        for x, w, f in ((i, wi, ni), (j, wj, nj)):
            if f in (0.0, 1.0):
                done.append((x, w, int(f)))
            else:
                cur = (x, w, f)
    return done, cur


def numbered(sizes: DataFrame) -> DataFrame:
    """The rows that sizes(.., n) stands for, numbered `i` from 0 among equal ones. Long runs of them are
    numbered by several tasks."""
    few = sizes.where(F.col("n") <= _RUN).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(_RUN).cast("bigint")))
    many = sizes.where(F.col("n") > _RUN).withColumn("start", start).repartition(*KEY, "start")
    many = many.withColumn("i", F.explode(F.sequence("start", F.least(F.col("start") + _RUN, "n") - 1))).drop("start")
    return few.unionByName(many)


def _round_shards(level: DataFrame, last: bool, seed: int) -> DataFrame:
    """One level of the tree: duels within each (source, shard)."""
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("i", pa.int64()), ("source", pa.string()), ("shard", pa.int64()), ("size", pa.int64()), ("fraction", pa.float64()), ("extra", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        c = {n: group[n].to_pylist() for n in group.schema.names}
        ids = zip(c["doc_id"], c["text_key"], c["i"], strict=True)
        rows = list(zip(ids, c["size"], c["fraction"], c["tie"], strict=True))
        rows.sort(key=lambda r: (-r[1], r[3], repr(r[0])))
        source, shard = c["source"][0], c["shard"][0]
        done, cur = duels([r[:3] for r in rows], seed)
        if cur is not None and last:
            done, cur = [*done, (cur[0], cur[1], int(_draw(seed, "last", cur[0]) < cur[2]))], None
        got = [(*i, source, shard, w, None, x) for i, w, x in done] + ([(*cur[0], source, shard, cur[1], cur[2], None)] if cur else [])
        return pa.Table.from_pylist([dict(zip(out.names, r, strict=True)) for r in got], schema=out)

    tie = F.xxhash64(F.lit(seed), "doc_id", "text_key", "i")
    return level.withColumn("tie", tie).groupBy("source", "shard").applyInArrow(
        run, "doc_id bigint, text_key bigint, i bigint, source string, shard bigint, size bigint, fraction double, extra bigint"
    )


def _decided(docs: DataFrame, weights: tuple[float, ...], share: float, limit: float, seed: int, shard_rows: int) -> DataFrame:
    """(*KEY, size, source_size, target, copies) for each row of docs."""
    text = F.col("text").cast("string")
    sizes = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(text).alias("text_key"), word_count(text).alias("size"))
    sizes = materialize(sizes.groupBy(*KEY, "size").agg(F.count("*").alias("n")), "mix-sizes")
    targets = source_targets(sizes, weights, share, limit).withColumnRenamed("source", "s")
    wanted = numbered(sizes).drop("n").join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    wanted = wanted.withColumn("p", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    wanted = wanted.withColumn("whole", F.floor("p")).withColumn("fraction", F.col("p") - F.floor("p"))
    shards = ratio_up(int(sizes.agg(F.sum("n")).first()[0] or 0), shard_rows)
    open_ = (F.col("fraction") > 0) & (F.col("size") > 0)
    row = ["doc_id", "text_key", "i", "source"]
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_key", "i"), F.lit(shards))
    level = wanted.where(open_).select(*row, shard.alias("shard"), "size", "fraction")
    decided = []
    while True:
        rounded = materialize(_round_shards(level, shards == 1, seed), "mix-level")
        decided.append(rounded.where(F.col("extra").isNotNull()).select(*KEY, "size", "extra"))
        if shards == 1:
            break
        shards = ratio_up(shards, FAN_IN)
        level = rounded.where(F.col("extra").isNull()).select(*row, F.pmod("shard", F.lit(shards)).alias("shard"), "size", "fraction")
    extra = decided[0]
    for more in decided[1:]:
        extra = extra.unionByName(more)
    # Targets follow from the source, so the rounded rows need no join with the others.
    t = targets.select("s", "source_size", "target", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias("whole"))
    rounded = extra.join(t, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", F.col("whole") + F.col("extra"))
    rest = wanted.where(~open_).withColumn("copies", F.col("whole"))
    columns = [*KEY, "size", "source_size", "target", "copies"]
    return rounded.select(columns).unionByName(rest.select(columns))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 17,
    shard_rows: int = 20_000,
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each row of docs(doc_id, source, text)."""
    rows = _decided(docs, weights, share, limit, seed, shard_rows)
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 17,
    shard_rows: int = 20_000,
) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, none included. Rows that share id,
    source and text take what was decided for them together, in an order by their other columns."""
    names = {n: n for n in ("id", "of", "key", "copies", "n", "same", "before", "copy")}
    taken_names = {c.lower() for c in docs.columns}
    for n in names:
        while names[n] in taken_names or names[n] == n:
            names[n] = "_" + names[n]
    id_, of, key, copies, n, same, before, copy = names.values()
    rows = _decided(docs, weights, share, limit, seed, shard_rows)
    rows = rows.groupBy(F.col("doc_id").alias(id_), F.col("source").alias(of), F.col("text_key").alias(key))
    decided = materialize(rows.agg(F.sum("copies").alias(copies), F.count("*").alias(n)).where(F.col(copies) > 0), "mix-decided")
    met = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & F.col("source").cast("string").eqNullSafe(F.col(of)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key))
    times = lambda df, number: df.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), number))).select(*map(_quoted, docs.columns))
    taken = times(docs.join(decided.where(F.col(n) == 1), met), F.col(copies))
    shared = decided.where(F.col(n) > 1)
    if shared.isEmpty():
        return taken
    # Whole equal rows become one with a count before a window numbers what is left.
    columns = [*map(_quoted, docs.columns), id_, of, key, copies, n]
    alike = docs.join(shared, met).groupBy(*columns).agg(F.count("*").alias(same))
    order = Window.partitionBy(id_, of, key).orderBy(F.xxhash64(F.to_json(F.struct(*map(_quoted, docs.columns)))))
    alike = alike.withColumn(before, F.sum(same).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(same))
    more = F.least(F.greatest(F.pmod(F.col(copies), F.col(n)) - F.col(before), F.lit(0)), F.col(same))
    alike = alike.withColumn(copies, F.floor(F.col(copies) / F.col(n)) * F.col(same) + more).where(F.col(copies) > 0)
    return taken.unionByName(times(alike, F.col(copies)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
