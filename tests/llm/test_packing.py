import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from onomast.llm import packing, tokenbin
from onomast.llm.common import table
from onomast.llm.tokens import Encoder, default_path

SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_both_encoders_agree(exact):
    ours, rng = Encoder(default_path()), random.Random(1)
    alphabet = "abcXYZ 012.,'\n\t  éüñßÀſǅɏ<|endoftext|>'s 're½² \u0085 漢字😀́"
    texts = ["", " ", "it's <|endoftext|> 'RE x", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(3000))]
    assert all(ours(t) == exact(t) for t in texts)


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(8, 8) == [(0, 8)] and packing.cut(16, 8) == [(0, 8), (8, 8)]
    assert packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_fullest_is_the_best_subset_sum():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 7))}
        room = rng.randint(0, 60)
        chosen = packing.fullest(dict(counts), room)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        assert sum(x * k for x, k in chosen.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[x] for x, k in chosen.items())


def test_patterns_use_up_the_counts_within_few_bins():
    rng = random.Random(3)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(30_000))
    patterns = packing.minimum_bin_slack(counts, 2048)
    used = Counter()
    for p, n in patterns:
        assert sum(k * m for k, m in p.items()) <= 2048
        for k, m in p.items():
            used[k] += m * n
    assert used == counts
    bins, least = sum(n for _, n in patterns), -(-sum(k * n for k, n in counts.items()) // 2048)
    assert bins <= least * 1.002 + 1


def check_pack(rows, docs, ids_of, size):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, text in docs:
        ids, own = [*ids_of(text or ""), 0], sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [(r["start"], r["length"]) for r in own] == packing.cut(len(ids), size)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for held in by_seq.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_seq)


def test_pack_whole_table(spark, sf, exact):
    docs = table(spark, sf, "documents")
    rows = packing.pack(docs).collect()
    n = check_pack(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], exact, 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_pack_odd_cases(spark, exact):
    docs = [(1, None), (2, ""), (3, "one two"), (4, "word " * 5000), (6, "é😀" * 40)]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id bigint, text string, length int, rank string")
    check_pack(packing.pack(df, size=64).collect(), docs, exact, 64)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x")], SCHEMA)).collect()
    assert len(twice) == 3 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 3


def test_pack_spreads_one_length(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text"))
    rows = packing.pack(df, size=16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000
    assert len({r["sequence_id"] for r in rows}) == -(-3000 // (16 // rows[0]["length"]))


def test_room_tree_and_best_fit():
    rng = random.Random(4)
    for _ in range(60):
        size = rng.choice([7, 8, 40])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 60))]
        bins = []  # plain best-fit decreasing
        for x in sorted(lengths, reverse=True):
            fits = [b for b in bins if size - sum(b) >= x]
            if fits:
                max(fits, key=sum).append(x)
            else:
                bins.append([x])
        got = tokenbin.best_fit_decreasing(lengths, size)
        assert sorted(k for b in got for k in b) == list(range(len(lengths)))
        assert sorted(sum(lengths[k] for k in b) for b in got) == sorted(map(sum, bins))


def test_matrix_round_trip(spark, sf, exact, tmp_path):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "long " * 9000)], SCHEMA)
    every = docs.unionByName(extra)
    matrix = tokenbin.write_packed(every, str(tmp_path / "m"), shard_bytes=200_000).collect()
    pieces = {}
    for r in matrix:
        cu = r["cu_seqlens"]
        position = np.frombuffer(r["position_ids"], "<u2")
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] <= 2048 and len(r["input_ids"]) == 4 * 2048
        assert all((position[a:b] == np.arange(b - a)).all() for a, b in zip(cu[:-1], cu[1:], strict=True))
        for d, p, ids in tokenbin.unpack(r):
            pieces[d, p] = ids
    for i, text in every.collect():
        own = [pieces[k] for k in sorted(k for k in pieces if k[0] == i)]
        assert np.concatenate(own).tolist() == [*exact(text or ""), 50256]
    assert tokenbin.packed(spark.createDataFrame([], SCHEMA)).count() == 0
