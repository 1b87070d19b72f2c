r"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts, 5 bytes deep, with the counts of what followed them in the
training texts. A byte is predicted by its longest known context; where that has not seen it, the
model escapes (method C: as often as the context has different symbols) to the next shorter one,
and the symbols of the contexts left behind are excluded there. Below the empty context all bytes
left are equally likely. Byte 255, which no UTF-8 text holds, pads the start of a text and ends it.
A text's score is its log10 probability under the pretrained model, its end included.

Counting covers every whole training text, and every count takes part in the scores. Where more than
`max_nodes` grams were counted, contexts of up to 2 bytes (at most 256^3 counts) are shipped with the
finished values of at most `max_nodes` frequent grams; all other grams of the texts, and these values
themselves, are worked out by joins with the counts of the deeper contexts, which stay distributed.

The base score is a smoothed unigram model over words; its word counts grow with the corpus and
stay distributed: the `common` most frequent words are shipped, all others are joined.

Defined cases: null text counts as empty and is scored by its end alone; documents without an id
hash as the empty text; repeated rows are counted and scored each; without training texts every
byte has probability 1/256 and no word is known; an empty table gives an empty result; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm.common import in_batches, materialize
from onomast.llm.langid import remainder

DEPTH = 5
END = 255
SHIPPED = 2  # contexts of up to so many bytes are always shipped
_WORD, _GRAM = 0, 1
_UPPER = bytes(range(256)).lower()


def _tidy(text: str | None) -> bytes:
    return (text or "").encode().translate(_UPPER)


def _word_key(word: bytes) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The packed (context, byte) at each place of each text, its end included, and each text's
    first place."""
    pad = bytes([END]) * DEPTH
    buffer = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8).astype(np.int64)
    keys = buffer[:-DEPTH].copy()
    for j in range(1, DEPTH + 1):
        keys <<= 8
        keys |= buffer[j : len(buffer) - DEPTH + j]
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths + DEPTH)])[:-1]
    scored = np.ones(len(keys), bool)  # of the padding after a text only its first byte is its end
    for j in range(1, DEPTH):
        scored[first + lengths + j] = False
    return keys[scored], np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def training_counts(texts: DataFrame, flush: int = 1 << 19) -> DataFrame:
    """(kind, key, n): word counts by hash and gram counts over texts(text)."""
    out = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def rows(kind: int, keys, counts) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 1 << 16):
            k = np.asarray(keys[i : i + (1 << 16)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(np.asarray(counts[i : i + (1 << 16)], np.int64))], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        keys, counts, held = [], [], 0
        for b in batches:
            tidy = [_tidy(t) for t in b["text"].to_pylist()]
            for t in tidy:
                words.update(t.split())
            k, _ = gram_keys(tidy)
            k.sort()
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else k
            keys.append(k[first])
            counts.append(np.diff(np.append(first, len(k))))
            held += len(first)
            if held > flush:
                k, c = _summed(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > flush // 2:
                    yield from rows(_GRAM, k, c)
                    keys, counts, held = [], [], 0
            if len(words) > flush // 2:
                yield from rows(_WORD, [_word_key(w) for w in words], list(words.values()))
                words = Counter()
        yield from rows(_WORD, [_word_key(w) for w in words], list(words.values()))
        if keys:
            yield from rows(_GRAM, *_summed(keys, counts))

    partial = in_batches(texts.select(F.col("text").cast("string")), run, "kind int, key bigint, n bigint")
    return materialize(partial.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts")


class Trie:
    """Counts by order; order k has the packed (k-byte context, byte) keys, sorted, and its contexts."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        self.orders = []
        for k, (keys, n) in enumerate(grams):
            ctx = keys >> 8
            first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, first) if len(keys) else n
            kinds = np.diff(np.append(first, len(keys)))
            order = {"keys": keys, "n": n, "ctx": ctx[first], "total": total, "kinds": kinds, "below": np.zeros(len(first), np.int64)}
            if k and len(keys):  # what the context's symbols weigh in the next shorter context
                lower = self.orders[k - 1]
                at = np.searchsorted(lower["keys"], keys & ((1 << (8 * k)) - 1))
                order["below"] = np.add.reduceat(lower["n"][at], first)
            self.orders.append(order)

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places in the sorted table, -1 where absent."""
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def _seen(self, k: int, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """(total, kinds, below) of the keys' contexts of order k and the keys' counts, 0 where absent."""
        o, key = self.orders[k], keys & ((1 << (8 * (k + 1))) - 1)
        if not len(o["keys"]):
            return (np.zeros(len(key), np.int64),) * 4
        ctx, at = self._find(o["ctx"], key >> 8), self._find(o["keys"], key)
        return (*(np.where(ctx >= 0, o[c][ctx], 0) for c in ("total", "kinds", "below")), np.where(at >= 0, o["n"][at], 0))

    def log10(self, keys: np.ndarray, deep: dict[int, tuple[np.ndarray, ...]] | None = None) -> np.ndarray:
        """log10 probability of each packed (context, byte). deep: (total, kinds, below, n) of each key by
        order, zeros where nothing was counted, for the orders that this trie doesn't hold."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        gone, gone_kinds = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k in range(DEPTH, -1, -1):
            if not len(open_):
                return out
            c_total, c_kinds, below, n = (x[open_] for x in deep[k]) if k >= len(self.orders) else self._seen(k, keys[open_])
            has, hit = c_kinds > 0, n > 0
            total, kinds = np.where(has, c_total - gone[open_], 0), np.where(has, c_kinds - gone_kinds[open_], 0)
            out[open_[hit]] += np.log10(n[hit] / (total[hit] + kinds[hit]))
            esc = ~hit & (kinds > 0)
            out[open_[esc]] += np.log10(kinds[esc] / (total[esc] + kinds[esc]))
            left = open_[~hit]
            gone[left], gone_kinds[left] = below[~hit], c_kinds[~hit]
            open_ = left
        out[open_] -= np.log10(np.maximum(1, 256 - gone_kinds[open_]))
        return out


class HashTable:
    """Open addressing over sorted int64 keys, for lookups by whole arrays. A slot holds a key's place
    in the arrays that it was made of, so that these are not held twice."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = keys, values
        self.places = np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(todo):
            free = self.places[slot] < 0
            self.places[slot[free]] = todo[free]  # of several for one slot the last stays
            lost = self.places[slot] != todo
            todo, slot = todo[lost], slot[lost] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are absent."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.ones(len(keys), bool)
        slot = self._slot(keys)
        place = self.places[slot]
        todo = np.flatnonzero((place >= 0) & (self.keys[place] != keys))
        while len(todo):
            slot[todo] = slot[todo] + 1 & self.mask
            here = place[todo] = self.places[slot[todo]]
            todo = todo[(here >= 0) & (self.keys[here] != keys[todo])]
        return self.values[place].astype(np.float64), place < 0


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.select("key", "n").toArrow()
    keys, n = got["key"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _of_order(grams: DataFrame, k: int) -> DataFrame:
    """(key, n) of order k from those of a higher order."""
    return grams.groupBy(F.col("key").bitwiseAND((1 << (8 * (k + 1))) - 1).alias("key")).agg(F.sum("n").alias("n"))


def grams_by_order(grams: DataFrame, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gram counts of order 0 to depth, sorted by key."""
    return [_arrays(_of_order(grams, k)) for k in range(depth + 1)]


class DeepCounts:
    """The counts of orders SHIPPED + 1 to DEPTH as written tables, a row a context, and the trie of all others."""

    def __init__(self, grams: DataFrame):
        self.contexts, upper = {}, grams
        for k in range(DEPTH, SHIPPED, -1):
            lower = materialize(_of_order(upper, k - 1), f"ppm-order-{k - 1}")
            suffix = F.col("key").bitwiseAND((1 << (8 * k)) - 1).alias("suffix")
            met = upper.select("key", "n", suffix).join(lower.select(F.col("key").alias("suffix"), F.col("n").alias("m")), "suffix")
            byte = F.col("key").bitwiseAND(255).cast("int")
            row = met.groupBy(F.shiftright("key", 8).alias(f"c{k}")).agg(
                F.sum("n").alias(f"total{k}"), F.count("*").alias(f"kinds{k}"), F.sum("m").alias(f"below{k}"), F.map_from_entries(F.collect_list(F.struct(byte, "n"))).alias(f"seen{k}")
            )
            self.contexts[k], upper = materialize(row, f"ppm-contexts-{k}"), lower
        self.trie = Trie(grams_by_order(upper, SHIPPED))

    def values(self, keys: DataFrame) -> DataFrame:
        """(key, value): log10 probability of each of the distinct keys."""
        deep, names = list(self.contexts), ("total", "kinds", "below", "n")
        for k in deep:
            context = F.shiftright(F.col("key").bitwiseAND((1 << (8 * (k + 1))) - 1), 8).alias(f"c{k}")
            keys = keys.select("*", context).join(self.contexts[k], f"c{k}", "left")
            keys = keys.withColumn(f"n{k}", F.try_element_at(f"seen{k}", F.col("key").bitwiseAND(255).cast("int"))).drop(f"c{k}", f"seen{k}")
        keys = keys.select("key", *(F.coalesce(f"{x}{k}", F.lit(0).cast("bigint")).alias(f"{x}{k}") for k in deep for x in names))
        model = keys.sparkSession.sparkContext.broadcast(self.trie)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = {k: tuple(b[f"{x}{k}"].to_numpy() for x in names) for k in deep}
                yield pa.RecordBatch.from_arrays([b["key"], pa.array(model.value.log10(b["key"].to_numpy(), found))], names=["key", "value"])

        return in_batches(keys, run, "key bigint, value double", rows=1 << 16)


def _least(grams: DataFrame, max_nodes: int) -> int:
    """The least count that at most max_nodes grams reach."""
    if grams.count() <= max_nodes:
        return 1
    low, high = 1, int(grams.agg(F.max("n")).first()[0]) + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if grams.where(F.col("n") >= mid).count() <= max_nodes else (mid, high)
    return high


def _by_text(text: np.ndarray, keys: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """For each of n texts its distinct keys, and how often each is there."""
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])])) if len(keys) else np.zeros(0, np.int64)
    at = pa.array(np.searchsorted(text[new], np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(keys[new])), pa.ListArray.from_arrays(at, pa.array(np.diff(np.append(new, len(keys)))))


def score(docs: DataFrame, max_nodes: int = 1 << 22, common: int = 1 << 17) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    spark = docs.sparkSession
    held = remainder("doc_id", 10) == 0
    docs = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string"))
    counts = training_counts(docs.where(~F.col("held_out")))
    words = counts.where(F.col("kind") == _WORD)
    total, kinds = (int(x or 0) for x in words.agg(F.sum("n"), F.count("*")).first())
    shipped = words.orderBy(F.desc("n"), "key").limit(common).select("key", "n")
    word_keys, word_n = _arrays(shipped)
    grams = counts.where(F.col("kind") == _GRAM).select("key", "n")
    least = _least(grams, max_nodes)
    if least == 1:  # all counts are shipped, and no gram of a text is left for a join
        far, trie = None, Trie(grams_by_order(grams))
        deep = trie.orders[DEPTH]["keys"]
        known = [trie.log10(deep[i : i + (1 << 18)]).astype(np.float32) for i in range(0, len(deep), 1 << 18)]
        values = np.concatenate([*known, np.zeros(0, np.float32)])
    else:
        far, trie = DeepCounts(grams), None
        got = far.values(grams.where(F.col("n") >= least).select("key")).select("key", F.col("value").cast("float")).toArrow()
        deep, values = got["key"].to_numpy(), got["value"].to_numpy()
    model = spark.sparkContext.broadcast((trie, deep, values, word_keys, word_n))

    out = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64())), ("gram_times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trie, deep, values, word_keys, word_n = model.value
        table, row_id = HashTable(deep, values), TaskContext.get().partitionId() << 40
        of_key = dict(zip(word_keys.tolist(), word_n.tolist(), strict=True))
        logs: dict[bytes, float | int] = {}  # of a shipped word its log10(c + 0.1), of any other its key
        for b in batches:
            tidy = [_tidy(t) for t in b["text"].to_pylist()]
            keys, first = gram_keys(tidy)
            value, absent = table.get(keys)
            left = np.zeros(0, np.int64)
            if trie is None:
                value[absent], left = 0, np.flatnonzero(absent)
            elif absent.any():
                new, back = np.unique(keys[absent], return_inverse=True)
                value[absent] = trie.log10(new)[back]
            grams = _by_text(np.searchsorted(first, left, side="right") - 1, keys[left], len(tidy))
            scores = np.add.reduceat(value, first) if len(tidy) else []
            rows = []
            for k, t in enumerate(tidy):
                split = t.split()
                known, sum_, rare, times = 0, 0.0, [], []
                for w, times_w in Counter(split).items():
                    x = logs.get(w)
                    if x is None:
                        key = _word_key(w)
                        c = of_key.get(key)
                        x = logs[w] = key if c is None else math.log10(c + 0.1)
                    if type(x) is float:
                        known += times_w
                        sum_ += times_w * x
                    else:
                        rare.append(x)
                        times.append(times_w)
                # The end token is counted once in each training text, and is no word.
                rows.append((row_id + k, len(split) + 1, known, sum_ - sum(times), float(scores[k]), rare, times))
            row_id += len(tidy)
            if len(logs) > 1 << 18:
                logs.clear()
            c = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), b["doc_id"], b["held_out"], *(pa.array(x, t) for x, t in zip(c[1:], out.types[3:-2], strict=True)), *grams], schema=out)

    schema = "row_id bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, logs double, score double, rare array<bigint>, times array<bigint>, grams array<bigint>, gram_times array<bigint>"
    scored = materialize(in_batches(docs, run, schema), "ppm-scored")
    model.unpersist()
    ends = counts_of_end(docs)
    # An unknown word's log10(0.1) = -1 is in `logs` already; a known one makes up for it here.
    rare = scored.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row_id", F.col("w.rare").alias("key"), F.col("w.times").alias("times"))
    made_up = rare.join(words.select("key", "n"), "key").select("row_id", "times", (F.col("times") * (F.log10(F.col("n") + 0.1) + 1)).alias("more"))
    made_up = made_up.groupBy("row_id").agg(F.sum("times").alias("more_known"), F.sum("more").alias("more"))
    n, v = total + ends, kinds + (1 if ends else 0)
    below = math.log10(n + 0.1 * (v + 1))
    end_log = math.log10(ends + 0.1)
    base = F.col("logs") + F.coalesce(F.col("more"), F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(below)
    known = F.col("known") + F.coalesce(F.col("more_known"), F.lit(0)) + F.lit(1 if ends else 0)
    rows = scored.drop("rare", "times", "grams", "gram_times").join(made_up, "row_id", "left")
    whole = F.col("score")
    if far:
        asked = scored.select("row_id", F.explode(F.arrays_zip("grams", "gram_times")).alias("g")).select("row_id", F.col("g.grams").alias("key"), F.col("g.gram_times").alias("times"))
        values = materialize(far.values(asked.select("key").distinct()), "ppm-values")
        rows = rows.join(asked.join(values, "key").groupBy("row_id").agg(F.sum(F.col("times") * F.col("value")).alias("far")), "row_id", "left")
        whole = F.col("score") + F.coalesce("far", F.lit(0.0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score")
    )


def counts_of_end(docs: DataFrame) -> int:
    """Each training text has one end token."""
    return docs.where(~F.col("held_out")).count()
