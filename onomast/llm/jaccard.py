r"""Exact Jaccard join of documents over word n-grams: pivots, Voronoi regions and triangle-inequality windows.

Two documents link when their shingle sets reach a Jaccard similarity of percent / 100, that is, a
Jaccard distance of at most r. The join works on distinct sets, so exact copies cost one set.

Ground. Unrelated documents all lie at distance 1 of each other and of any pivot, where no window of
a triangle inequality tells them apart. So first comes a partition that is exact for near pairs: a
linked pair of sizes that sum to s differs in at most t = s (100 - percent) / (100 + percent)
shingles; if the shingles are dealt to more than t slices by a hash, some slice holds the very same
shingles in both. Sets are banded by size, each slice's digest is a key, and sets that share a key
may meet. Documents that share a passage alone differ somewhere in almost every slice.

Metric. Within a band distances are symmetric differences, of at most t between linked sets. A set's
sketch, the parities of its shingles in as many slots as the band has bits, never lies farther from
another than the sets do, and is itself in a metric space: what a sketch rules out is ruled out.

Regions. The pivot of a key is its most central set, the one whose keys are shared most; the sets of
a pivot's keys in a band are its region, measured against the pivot by sketches and, where these
leave it open, by whole sets. Sets linked to the pivot are connected and need no further look among
themselves; of them only those stay that the window of an outside set reaches: distance to the pivot
at least the least outside distance - t. A region of more rows than a block takes is split by new
pivots: each set goes to its nearest one, and to all others that are farther by at most 2 t, which
is where a linked set of another region can be. Regions are split anew until they fit, or until
the windows hold them together; then the rows are dealt to blocks and each two blocks meet.

Join. Within a region sketches tell which sets can be linked; the connected groups of these are joined
exactly by whole shingle sets. No task holds more than two blocks.

Components come from label propagation with pointer jumping over the links, which stay distributed.

Defined cases: null text, empty text and text without words have an empty set, are linked with nothing
and are a component of their own id; fewer words than a shingle takes make one shingle of all of
them; repeated rows are linked by equal sets; rows without id join their component, whose id is the
smallest non-null one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onomast.llm.common import arrow_rows, bitmap, discard, in_batches, in_bitmap, materialize, narrowed, slot_of, slots_of
from onomast.llm.words import hashed_words, mix

_MULT = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 1 << 24
KEPT_SLOTS = 1 << 21
BLOCK = 600  # rows of a region that go into one block at most
BLOCK_SHINGLES = 1 << 18  # and how many shingles they have, but for a single longer row
PIVOTS = 16  # of a region that is split
TURNS = 12  # splits of a region; what doesn't fit a block by then is joined block by block
COLUMNS = 4096  # shingles or bits of one matrix product


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    flat, lengths = hashed_words(texts)
    rolled = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    for j in range(words):
        rolled = rolled * _MULT + flat[j : j + len(rolled)]
    rolled, sets, at = mix(rolled), [], 0
    for n in lengths.tolist():
        if n >= words:
            sets.append(np.unique(rolled[at : at + n - words + 1]))
        elif n:
            h = np.array([n], np.uint64)  # so that no short text equals a shingle
            for x in flat[at : at + n]:
                h = mix(h ^ x) * _MULT
            sets.append(h)
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


def set_id(s: np.ndarray) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


class Bands:
    """Size bands and, for each, the slices that leave a linked pair one equal, non-empty slice."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.low = percent, [1]
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * 3 // 2)))
        low = np.array(self.low)
        top = low[1:] - 1  # of the smaller set of a pair
        self.reach = top * 100 // percent  # of the larger
        self.differ = (top + self.reach) * (100 - percent) // (100 + percent)
        self.spare = 3 + self.differ // 10  # slices that may be empty
        self.slices = self.differ + 1 + self.spare
        self.bits = np.array([max(64, 1 << (4 * n - 1).bit_length()) for n in self.low[:-1]])  # of a sketch

    def own(self, size):
        return np.searchsorted(np.array(self.low), size, side="right") - 1

    def of(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, band) twice: each set in its own band, and as the larger one in the band below."""
        own = self.own(sizes)
        at = np.flatnonzero((sizes > 0) & (self.differ[np.maximum(own, 0)] > 0))
        below = np.flatnonzero((own > 0) & (sizes <= self.reach[np.maximum(own - 1, 0)]) & (self.differ[np.maximum(own - 1, 0)] > 0))
        return [(at, own[at]), (below, own[below] - 1)]


def region_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, tag) of every region that a set falls into. The tag holds the band and, in its lower
    16 bits, how many keys of the band the set shares with any set that it is linked with, at least."""
    sizes = np.array([len(s) for s in sets], np.int64)
    none = np.zeros(0, np.int64)
    if not sizes.sum():
        return none, none, none
    bands, which, keys, tags = Bands(percent, int(sizes.max())), [], [], []
    for at, band in bands.of(sizes):
        if not len(at):
            continue
        k = bands.slices[band]
        offset = np.concatenate([[0], np.cumsum(k)])
        flat = np.concatenate([sets[i] for i in at])
        owner = np.repeat(np.arange(len(at)), sizes[at])
        slot = offset[owner] + ((flat >> np.uint64(32)) % k[owner].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(offset[-1], np.uint64)
        np.add.at(sums, slot, mix(flat + _MULT))
        full = np.bincount(slot, minlength=offset[-1]) > 0
        holder = np.repeat(np.arange(len(at)), k)
        empty = k - np.bincount(holder[full], minlength=len(at))
        # Two sets that both have more empty slices than can be spared may share empty ones only.
        full |= (empty > bands.spare[band])[holder]
        need = np.maximum(1, 1 + bands.spare[band] - empty)
        place = np.arange(offset[-1]) - offset[holder]
        tag = mix((band[holder] << 32 | place).astype(np.uint64) + np.uint64(1))
        keys.append(mix(sums[full] ^ tag[full]).astype(np.int64))
        which.append(at[holder[full]])
        tags.append((band << 16 | np.minimum(need, 0xFFFF))[holder[full]])
    return tuple(np.concatenate(x) if keys else none for x in (which, keys, tags))


def sketch(s: np.ndarray, bits: int) -> bytes:
    """Packed parities of the set's elements in `bits` slots, a power of two."""
    slot = (mix(s ^ _MULT) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(packed: bytes, bits: int) -> np.ndarray:
    """The sketch in `bits` slots, no more than it has, as bytes."""
    x = np.frombuffer(packed, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, bits // 8), axis=0) if 8 * len(x) > bits else x


def may_link(size: np.ndarray, other: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes, whose sketches lie `apart`, can be linked."""
    both = (size + other - apart) // 2  # at most
    return 100 * both >= percent * (size + other - both)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_id), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b["text"].to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64())], names=["doc_id", "n_shingles", "set_id"])

    return materialize(in_batches(_texts(docs), run, "doc_id bigint, n_shingles bigint, set_id bigint"), "jaccard-documents")


def members(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, band, id, n) of the keys that more than one set has, n being how many, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sets = {}
            for s in shingle_sets(b["text"].to_pylist(), words):
                if len(s) and (i := set_id(s)) not in seen:
                    sets[i] = s
            seen.update(sets)
            if len(seen) > 1 << 16:
                seen.clear()
            which, keys, tags = region_keys(list(sets.values()), percent)
            ids = np.array(list(sets), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids[which] if len(ids) else ids, pa.int64()), pa.array(tags, pa.int32())], names=["key", "id", "tag"])

    rows = in_batches(_texts(docs).select("text"), run, "key bigint, id bigint, tag int")
    held = Window.partitionBy("key")
    shared = rows.withColumn("low", F.min("id").over(held)).withColumn("high", F.max("id").over(held)).where(F.col("low") != F.col("high"))
    shared = materialize(shared.select("key", "id", "tag").distinct(), "jaccard-shared")  # keeps the partitioning by key
    # A set that shares fewer keys of a band than a link takes has none there, whatever it shares them with.
    strong = shared.groupBy("id", "tag").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("tag").bitwiseAND(0xFFFF)).drop("n")
    kept = shared.join(strong, ["id", "tag"], "left_semi").select("key", F.shiftright("tag", 16).alias("band"), "id").withColumn("n", F.count("*").over(held)).where("n > 1")
    kept = materialize(kept, "jaccard-members")
    discard(shared)
    return kept


def needed_sets(docs: DataFrame, ids: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, size, sketch, shingles) of the given sets, written. A bitmap of fixed size over the ids passes all of
    them, and few others, in the tasks that read the texts."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bitmap(ids.select(F.pmod("id", F.lit(SLOTS)).alias("slot")), SLOTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, table = set(), bits.value
        for b in batches:
            rows, bands = [], None
            for s in shingle_sets(b["text"].to_pylist(), words):
                if len(s) and (i := set_id(s)) not in seen and in_bitmap(table, i % SLOTS):
                    seen.add(i)
                    if bands is None or len(s) >= bands.low[-1]:
                        bands = Bands(percent, 2 * len(s))
                    rows.append((i, len(s), sketch(s, int(bands.bits[bands.own(len(s))])), s.tobytes()))
            if len(seen) > 1 << 16:
                seen.clear()
            yield arrow_rows(rows, [("id", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary()), ("shingles", pa.binary())])

    found = in_batches(_texts(docs).select("text"), run, "id bigint, size bigint, sketch binary, shingles binary").join(ids, "id", "left_semi")
    # Copies of a set from different tasks are equal; the size of what moves is small here.
    one = F.row_number().over(Window.partitionBy("id").orderBy(F.lit(1)))
    found = materialize(found.withColumn("r", one).where("r = 1").drop("r"), "jaccard-sets")
    bits.unpersist()
    return found


def measure(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (id, pivot, band) with `size`, `h` (the sketches' distance), `t` (what linked sets of the band
    differ in at most), `bits` (of the band) and `near` (they may be linked), written."""
    one = narrowed(sets.select("id", "size", "sketch"), "id", pairs)
    two = narrowed(sets.select(F.col("id").alias("pivot"), F.col("size").alias("other_size"), F.col("sketch").alias("other")), "pivot", pairs)
    joined = pairs.join(one, "id").join(two, "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, other_size, band = (b[c].to_numpy() for c in ("size", "other_size", "band"))
            bands = Bands(percent, 2 * int(max(size.max(initial=1), other_size.max(initial=1))))
            bits = bands.bits[band]
            h = np.array([int(np.bitwise_count(folded(x, n) ^ folded(y, n)).sum()) for x, y, n in zip(b["sketch"].to_pylist(), b["other"].to_pylist(), bits.tolist(), strict=True)], np.int64)
            near = may_link(size, other_size, h, percent)
            yield pa.RecordBatch.from_arrays([b["id"], b["pivot"], b["band"], b["size"], pa.array(h), pa.array(bands.differ[band]), pa.array(bits), pa.array(near)], names=["id", "pivot", "band", "size", "h", "t", "bits", "near"])

    schema = "id bigint, pivot bigint, band int, size bigint, h bigint, t bigint, bits bigint, near boolean"
    return materialize(in_batches(joined.select("id", "pivot", "band", "size", "other_size", "sketch", "other"), run, schema), "jaccard-measured")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the pairs (id, pivot), written."""
    others = narrowed(sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("other")), "pivot", pairs)
    joined = pairs.join(narrowed(sets.select("id", "shingles"), "id", pairs), "id").join(others, "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b["shingles"], b["other"], strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                n = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * n >= percent * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([b["id"], b["pivot"]], names=["id", "pivot"]).filter(pa.array(linked, pa.bool_()))

    return materialize(in_batches(joined.select("id", "pivot", "shingles", "other"), run, "id bigint, pivot bigint"), "jaccard-verified")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each end of the edges (a, b) can reach, written."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "jaccard-both")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "jaccard-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label").select("id", "old", F.least("label", "further").alias("label"))
        step = materialize(step, "jaccard-labels")
        discard(labels)
        labels = step
        if step.where(F.col("old") != F.col("label")).isEmpty():
            discard(both)
            return labels.select("id", "label")


def _least_reached(near: np.ndarray) -> np.ndarray:
    """For each row the least row that it can reach over the links."""
    n = len(near)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _common(row: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
    """How many columns each two of n rows share."""
    out = np.zeros((n, n), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        here = (column >= at) & (column < at + COLUMNS)
        holds = np.zeros((n, COLUMNS), np.float32)
        holds[row[here], column[here] - at] = 1
        out += holds @ holds.T
    return out.astype(np.int64)


REGION = "region bigint, id bigint, size bigint, linked boolean, t bigint, sketch binary"


def split(rows: DataFrame, turn: int) -> DataFrame:
    """The rows of regions with `targets`, written: which of the region's new pivots, numbered, each goes to.
    The pivots are the first by hash of PIVOTS parts of the region."""
    first = F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "id", "sketch")
    heads = rows.groupBy("region", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(PIVOTS)).alias("part")).agg(F.min(first).alias("first"))
    pivots = heads.groupBy("region").agg(F.sort_array(F.collect_list("first.sketch")).alias("pivots"))  # PIVOTS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            targets = []
            for own, t, pivots in zip(b["sketch"], b["t"].to_pylist(), b["pivots"], strict=True):
                x = np.frombuffer(own.as_buffer(), np.uint8)
                y = np.frombuffer(b"".join(pivots.as_py()), np.uint8).reshape(-1, len(x))
                h = np.bitwise_count(y ^ x).sum(axis=1, dtype=np.int64)
                targets.append(np.flatnonzero(h <= h.min() + 2 * t).tolist())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names if c != "pivots"), pa.array(targets, pa.list_(pa.int32()))], names=[*(c for c in b.schema.names if c != "pivots"), "targets"])

    return materialize(in_batches(rows.join(pivots, "region"), run, f"{REGION}, targets array<int>", rows=200), "jaccard-split")


def settled(rows: DataFrame) -> DataFrame:
    """The rows (REGION) of regions that fit a block, or that windows hold together."""
    done: list[DataFrame] = []
    turn = 0
    while True:
        # A region without two rows of which one is outside has nothing to join.
        sizes = rows.groupBy("region").agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.count_if(~F.col("linked")).alias("outside")).where("n > 1 and outside > 0")
        large = (F.col("n") > BLOCK) | (F.col("volume") > BLOCK_SHINGLES)
        sizes = materialize(sizes.select("region", large.alias("large")), "jaccard-sizes")
        done.append(rows.join(sizes.where("not large").select("region"), "region", "left_semi"))
        big = rows.join(sizes.where("large").select("region"), "region", "left_semi")
        if sizes.where("large").isEmpty():
            break
        placed = split(big, turn)
        # Windows that hold a region together would only multiply it.
        held = placed.groupBy("region").agg(((F.sum(F.size("targets")) > 2 * F.count("*")) | F.lit(turn + 1 >= TURNS)).alias("held"))
        told = placed.join(held, "region")
        done.append(told.where("held").select(*rows.columns))
        parts = told.where("not held").withColumn("region", F.explode(F.transform("targets", lambda x: F.xxhash64("region", x))))
        rows = materialize(parts.select(*rows.columns), "jaccard-regions")
        turn += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(part, id): sets that may be linked share a part, written. rows: of regions (REGION). Rows dealt to blocks meet
    the rows of every other block of their region, but linked rows don't meet each other."""
    of = F.struct(F.col("linked").alias("inner"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    sizes = rows.groupBy("region", "linked").agg(blocks.alias("blocks")).groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("linked", "blocks"))).alias("dealt"))  # two at most
    inner, outer = (F.coalesce(F.try_element_at("dealt", F.lit(x)), F.lit(0)) for x in (True, False))
    met = rows.join(sizes, "region").withColumn("blocks", F.try_element_at("dealt", "linked")).withColumn("own", of)
    listed = lambda n, x: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda y: F.struct(F.lit(x).alias("inner"), y.alias("block")))
    met = met.withColumn("other", F.explode(F.concat(listed(outer, False), F.when(F.col("linked"), F.array().cast("array<struct<inner:boolean,block:int>>")).otherwise(listed(inner, True)))))
    met = met.select("region", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "size", "linked", "sketch")
    out = pa.schema([("part", pa.int64()), ("id", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        import xxhash

        ids, size, linked = (group[c].to_numpy() for c in ("id", "size", "linked"))
        order = np.argsort(ids)
        ids, size, linked = ids[order], size[order], linked[order]
        packed = np.frombuffer(b"".join(group["sketch"].take(pa.array(order)).to_pylist()), np.uint8).reshape(len(ids), -1)
        shared = np.zeros((len(ids), len(ids)), np.float32)
        for at in range(0, packed.shape[1], COLUMNS // 8):
            bits = np.unpackbits(packed[:, at : at + COLUMNS // 8], axis=1).astype(np.float32)
            shared += bits @ bits.T
        odd = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
        apart = odd[:, None] + odd[None, :] - 2 * shared.astype(np.int64)
        near = may_link(size[:, None], size[None, :], apart, percent) & ~(linked[:, None] & linked[None, :])
        np.fill_diagonal(near, False)
        label = _least_reached(near)
        parts = []
        for x in np.flatnonzero(np.bincount(label, minlength=len(ids)) > 1):
            held = ids[label == x]
            part = xxhash.xxh3_64_intdigest(held.tobytes())  # the same sets make the same part in any region
            parts.append((np.full(len(held), part, np.uint64).astype(np.int64), held))
        c = [np.concatenate(x) for x in zip(*parts, strict=True)] or [[], []]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in c], schema=out)

    found = met.groupBy("region", "low", "high").applyInArrow(run, "part bigint, id bigint")
    return materialize(found.distinct(), "jaccard-parts")


def join_parts(parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect what is linked within the parts (part, id), written."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["shingles"]]
        size = np.array([len(x) for x in held])
        _, column, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), size)
        place = np.cumsum(times > 1) - 1  # what one set alone holds is in no intersection
        keep = times[column] > 1
        common = _common(row[keep], place[column[keep]], len(ids))
        near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(near, False)
        label = _least_reached(near)
        told = np.flatnonzero(label != np.arange(len(ids)))
        return pa.Table.from_arrays([pa.array(ids[told]), pa.array(ids[label[told]])], schema=out)

    joined = parts.join(narrowed(sets.select("id", "shingles"), "id", parts), "id").groupBy("part").applyInArrow(run, "a bigint, b bigint")
    return materialize(joined.distinct(), "jaccard-joined")


def links(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, b) between sets that give every component."""
    held = members(docs, words, percent)
    central = held.groupBy("id").agg(F.sum("n").alias("weight"))
    ranked = materialize(held.join(central, "id"), "jaccard-ranked")
    best = ranked.groupBy("key").agg(F.max(F.struct("weight", "id")).alias("best")).select("key", F.col("best.id").alias("pivot"))
    sets = needed_sets(docs, held.select("id").distinct(), words, percent)
    measured = measure(ranked.join(best, "key").where("id <> pivot").select("id", "pivot", "band").distinct(), sets, percent)
    linked = verify(measured.where("near").select("id", "pivot").distinct(), sets, percent)
    done = measured.join(linked.withColumn("linked", F.lit(True)), ["id", "pivot"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    # What the window of an outside set replicates to it: h >= h(outside) - t.
    open_ = done.groupBy("pivot", "band").agg(F.min(F.when(~F.col("linked"), F.col("h"))).alias("outside"), F.count("*").alias("held")).where("outside is not null and held > 1")
    rows = done.join(open_, ["pivot", "band"]).where(F.col("h") >= F.col("outside") - F.col("t"))
    rows = rows.select(F.xxhash64("pivot", "band").alias("region"), "id", "size", "linked", "t", "bits")
    rows = materialize(_with_sketch(rows, sets), "jaccard-regions")
    parts = candidates(settled(rows), percent)
    edges = linked.select(F.col("id").alias("a"), F.col("pivot").alias("b")).unionByName(join_parts(parts, sets, percent))
    edges = materialize(edges.distinct(), "jaccard-edges")
    discard(held, ranked, sets, measured, linked, rows, parts)
    return edges


def _with_sketch(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows with the sketch of their set, in as many bits as the region has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [folded(x, n).tobytes() for x, n in zip(b["sketch"].to_pylist(), b["bits"].to_pylist(), strict=True)]
            names = ["region", "id", "size", "linked", "t"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(own, pa.binary())], names=[*names, "sketch"])

    joined = rows.join(narrowed(sets.select("id", "sketch"), "id", rows), "id")
    return in_batches(joined.select("region", "id", "size", "linked", "t", "bits", "sketch"), run, REGION)


def cluster(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text)."""
    sets = document_sets(docs, words)
    label = components(links(docs, words, percent))
    linked = sets.where("n_shingles > 0").join(label.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    lowest = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(lowest, "label").select("doc_id", "n_shingles", "component_id")
    alone = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that are not the first, by id, of their component. Rows without id come last, in the order of
    a hash of their text, and are told apart by it; of equal rows one stays."""
    if clash := {c for c in docs.columns if c.startswith("__")}:
        docs = docs.withColumnsRenamed({c: f"kept:{c}" for c in clash})
    last = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62))
    docs = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), last))
    found = cluster(docs.select(F.col("__id").alias("doc_id"), "text"), words, percent)
    marked = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("__kept"), F.count("*").alias("__n"))
    marked = materialize(marked, "jaccard-kept")
    gone, kept = marked.where(~F.col("__kept")).select("doc_id"), marked.where("__kept")
    # Most documents share no slot with one that goes; only the others are looked up by id.
    slotted, slots = docs.withColumn("__slot", slot_of("__id", KEPT_SLOTS)), slots_of(gone, "doc_id", KEPT_SLOTS)
    maybe = slotted.join(slots, "__slot", "left_semi").join(gone.withColumnRenamed("doc_id", "__gone"), F.col("__id") == F.col("__gone"), "left_anti")
    out = slotted.join(slots, "__slot", "left_anti").unionByName(maybe).drop("__slot")
    if not kept.where("__n > 1").isEmpty():
        out = out.dropDuplicates(["__id", "text"])  # repeated rows of one id
    return out.drop("__id").withColumnsRenamed({f"kept:{c}": c for c in clash})
