r"""Approximate nearest neighbours: a navigable small-world graph per shard, merged.

Distinct vectors are dealt to shards by a hash of their values; each shard builds a hierarchical
navigable small-world graph by insertion and stores it as one row of flat arrays (vectors, member
ids, neighbour lists per layer). Queries visit every shard in blocks, descend from the top layer
and widen to a beam of `width` in the bottom layer; all that a shard finds is scored exactly in double
precision on the original vectors, and the shards' nearest are merged per query.

Equal vectors are one node with its smallest ids, k + 1 of them, which is all that any query can
need of it: a vector that a third of all rows share costs one node.

Defined cases: rows without id, and vectors that are null, empty, zero or hold null or non-finite
components take no part, neither as queries nor as candidates; a query's own id is never its
neighbour; repeated rows count once; vectors of different lengths are searched apart; ties go to the
smaller id; with fewer candidates than k all are returned; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onomast.llm.common import materialize, ratio_up


class Graph:
    """layers[0] holds an n x 2m array of neighbours (-1: none); layers[l] of the nodes that reach l
    an n_l x m array, by place in nodes[l]."""

    def __init__(self, vectors: np.ndarray, m: int, seed: int = 7):
        self.v = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
        n, self.m = len(vectors), m
        draws = np.random.default_rng(seed).random(n)
        self.level = np.floor(-np.log(np.maximum(draws, 1e-12)) / math.log(m)).astype(int)
        self.nodes = [np.flatnonzero(self.level >= x) for x in range(self.level.max() + 1)]
        self.place = [np.full(n, -1, np.int32) for _ in self.nodes]
        for p, own in zip(self.place, self.nodes, strict=True):
            p[own] = np.arange(len(own))
        self.layers = [np.full((len(own), 2 * m if x == 0 else m), -1, np.int32) for x, own in enumerate(self.nodes)]
        self.entry = 0
        self.stamp, self.turn = np.zeros(n, np.int64), 0

    def beam(self, q: np.ndarray, starts: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """The best `width` nodes found in a layer as (similarity, node), best first."""
        self.turn += 1
        turn, stamp, place, links, v = self.turn, self.stamp, self.place[layer], self.layers[layer], self.v
        found = [(float(v[s] @ q), s) for s in starts]
        stamp[starts] = turn
        heapq.heapify(found)
        todo = [(-s, x) for s, x in found]
        heapq.heapify(todo)
        while todo:
            s, x = heapq.heappop(todo)
            if len(found) >= width and -s < found[0][0]:
                break
            near = links[place[x]]
            near = near[near >= 0]
            near = near[stamp[near] != turn]
            if not len(near):
                continue
            stamp[near] = turn
            sims = v[near] @ q
            if len(found) >= width:
                good = sims > found[0][0]
                near, sims = near[good], sims[good]
            for s, x in zip(sims.tolist(), near.tolist(), strict=True):
                if len(found) < width:
                    heapq.heappush(found, (s, x))
                elif s > found[0][0]:
                    heapq.heapreplace(found, (s, x))
                else:
                    continue
                heapq.heappush(todo, (-s, x))
        return sorted(found, key=lambda f: (-f[0], f[1]))

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[tuple[float, int]]:
        """Up to `most` of the found, each nearer to the new node than to those chosen before it; then
        the best of the others."""
        nodes = np.array([x for _, x in found])
        between = self.v[nodes] @ self.v[nodes].T
        chosen: list[int] = []
        closest = np.full(len(nodes), -2.0, np.float32)
        for k, (s, _) in enumerate(found):
            if s > closest[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                np.maximum(closest, between[k], out=closest)
        taken = set(chosen)
        chosen += [k for k in range(len(found)) if k not in taken][: most - len(chosen)]
        return [found[k] for k in chosen]

    def _link(self, layer: int, a: int, b: int, s: float) -> None:
        """b among the neighbours of a; a full list gives up its farthest, if that is farther."""
        row = self.layers[layer][self.place[layer][a]]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = b
            return
        sims = self.v[row] @ self.v[a]
        worst = int(sims.argmin())
        if sims[worst] < s:
            row[worst] = b

    def build(self, width: int) -> Graph:
        top = -1
        for x in range(len(self.v)):
            q, level, starts = self.v[x], int(self.level[x]), [self.entry]
            for layer in range(top, level, -1):
                starts = [self.beam(q, starts, 1, layer)[0][1]]
            for layer in range(min(level, top), -1, -1):
                found = self.beam(q, starts, width, layer)
                for s, y in self._diverse(found, self.m):
                    self._link(layer, x, y, s)
                    self._link(layer, y, x, s)
                starts = [y for _, y in found]
            if level > top:
                top, self.entry = level, x
        return self

    def search(self, query: np.ndarray, width: int) -> list[int]:
        q = (query / np.linalg.norm(query)).astype(np.float32)
        starts = [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            starts = [self.beam(q, starts, 1, layer)[0][1]]
        return [x for _, x in self.beam(q, starts, width, 0)]

    def flat(self) -> dict:
        return {"entry": self.entry, "nodes": [n.astype(np.int32).tobytes() for n in self.nodes], "links": [x.tobytes() for x in self.layers]}

    @classmethod
    def restore(cls, vectors: np.ndarray, m: int, entry: int, nodes: list[bytes], links: list[bytes]) -> Graph:
        g = cls.__new__(cls)
        g.v = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
        g.m, g.entry, n = m, entry, len(vectors)
        g.nodes = [np.frombuffer(b, np.int32) for b in nodes]
        g.place = [np.full(n, -1, np.int32) for _ in g.nodes]
        for p, own in zip(g.place, g.nodes, strict=True):
            p[own] = np.arange(len(own))
        g.layers = [np.frombuffer(b, np.int32).reshape(len(own), -1) for b, own in zip(links, g.nodes, strict=True)]
        g.stamp, g.turn = np.zeros(n, np.int64), 0
        return g


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & good)
    return rows.where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v")).distinct()


INDEX = "dim int, shard bigint, vectors binary, member_counts binary, members binary, entry int, nodes array<binary>, links array<binary>"


def build_index(vectors: DataFrame, k: int, shard_rows: int, m: int, build_width: int) -> tuple[DataFrame, int]:
    """(index, shards): one written row per shard."""
    own = Window.partitionBy("v").orderBy("id")
    nodes = vectors.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k + 1)
    nodes = materialize(nodes.groupBy("v", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-nodes")
    shards = ratio_up(nodes.count(), shard_rows)
    out = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("vectors", pa.binary()), ("member_counts", pa.binary()), ("members", pa.binary()), ("entry", pa.int32()), ("nodes", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))])

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["ids"].to_pylist(), group["v"].to_pylist(), strict=True))
        v = np.array([r[1] for r in rows], np.float64)
        g = Graph(v, m).build(build_width).flat()
        counts = np.array([len(r[0]) for r in rows], np.int32)
        members = np.array([i for r in rows for i in r[0]], np.int64)
        row = (group["dim"][0].as_py(), group["shard"][0].as_py(), v.tobytes(), counts.tobytes(), members.tobytes(), g["entry"], g["nodes"], g["links"])
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, out.types, strict=True)], schema=out)

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards))).repartition(shards, "dim", "shard")
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(run, INDEX), "ann-index"), shards


def search(
    rows: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = 8192,
    m: int = 20,
    build_width: int = 96,
    width: int = 256,
    block_rows: int = 16_384,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine found for the rows where is_query (of
    the column `id`) holds."""
    vectors = materialize(usable(rows, id_col, vector_col), "ann-vectors")
    index, shards = build_index(vectors, k, shard_rows, m, build_width)
    queries = vectors.where(is_query)
    blocks = ratio_up(queries.count(), block_rows)
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        got: list[tuple[int, int, float]] = []
        if asked.num_rows and held.num_rows:
            row = held.slice(0, 1).to_pylist()[0]
            v = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            g = Graph.restore(v, m, row["entry"], row["nodes"], row["links"])
            norms = np.sqrt((v * v).sum(axis=1))
            counts = np.frombuffer(row["member_counts"], np.int32)
            ends = np.cumsum(counts)
            members = np.frombuffer(row["members"], np.int64)
            for qid, q in zip(asked["id"].to_pylist(), asked["v"].to_pylist(), strict=True):
                q = np.array(q, np.float64)
                near = np.array(g.search(q, width))
                score = (v[near] * q).sum(axis=1) / (norms[near] * np.sqrt((q * q).sum()))
                mine = sorted((-s, i) for x, s in zip(near.tolist(), score.tolist(), strict=True) for i in members[ends[x] - counts[x] : ends[x]].tolist() if i != qid)
                got += [(qid, i, -s) for s, i in mine[:k]]
        c = list(zip(*got, strict=True)) or [[]] * 3
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(c, out.types, strict=True)], schema=out)

    keys = ["dim", "shard", "block"]
    n = shards * blocks
    found = asked.repartition(n, *keys).groupBy(*keys).cogroup(held.repartition(n, *keys).groupBy(*keys)).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
