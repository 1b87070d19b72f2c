"""Jaccard join, substring duplicates, media and nearest neighbours."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from onomast.llm import ann, gear, jaccard, media, substrings
from onomast.llm.common import bitmap, in_bitmap, table

SCHEMA = "doc_id bigint, text string"


def words_of(t):
    return (t or "").encode().lower().split()


def plain_sets(docs, k):
    out = {}
    for i, t in docs:
        w = words_of(t)
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def plain_components(docs, k, percent):
    sets = plain_sets(docs, k)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, n, clusters):
    """Chains of edits around several texts, with a passage that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    shared = [word() for _ in range(60)]
    docs = []
    for _ in range(clusters):
        base = [word() for _ in range(rng.choice([3, 9, 30, 120, 300]))] + (shared if rng.random() < 0.6 else [])
        for _ in range(n):
            edited = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                at = rng.randrange(len(edited) + 1)
                edited[at : at + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
            docs.append(" ".join(edited))
            if rng.random() < 0.3:
                base = edited or base
    return list(enumerate(docs))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_components_match_all_pairs(spark, k, percent):
    docs = near_copies(k, 25, 14)
    assert sum(c != i for i, (_, c) in plain_components(docs, k, percent).items()) > 50
    got = jaccard.cluster(spark.createDataFrame(docs, SCHEMA), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(docs, k, percent)


def test_regions_are_split_by_pivots(spark, monkeypatch):
    """Blocks of three rows: regions are split again and again, or joined block by block."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    docs = near_copies(11, 25, 6)
    rows = spark.createDataFrame(docs, SCHEMA)
    split, turns = jaccard.split, []
    monkeypatch.setattr(jaccard, "split", lambda rows, turn: turns.append(turn) or split(rows, turn))
    got = jaccard.cluster(rows, 4, 85).collect()
    assert turns and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(docs, 4, 85)


def test_sketches_never_lie_farther_apart_than_the_sets():
    rng = np.random.default_rng(4)
    for n in (1, 9, 60, 700):
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[: rng.integers(0, len(x) + 1)], rng.integers(0, 1 << 63, rng.integers(0, n + 1)).astype(np.uint64)]))
            apart = len(np.setxor1d(x, y))
            for bits in (64, 512, 4096):
                a, b = (jaccard.sketch(s, 4096) for s in (x, y))
                assert jaccard.folded(a, bits).tobytes() == jaccard.sketch(x, bits)
                h = int(np.bitwise_count(jaccard.folded(a, bits) ^ jaccard.folded(b, bits)).sum())
                assert h <= apart
                both = len(np.intersect1d(x, y))
                if 100 * both >= 85 * (len(x) + len(y) - both):
                    assert jaccard.may_link(len(x), len(y), h, 85)


def test_components_whole_table(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = jaccard.cluster(table(spark, sf, "documents")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(docs, 4, 85)


def test_slices_meet_for_every_near_pair():
    rng = np.random.default_rng(1)
    for n in (2, 5, 7, 8, 11, 12, 17, 26, 27, 60, 140, 600):
        for _ in range(40):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            y = x[: max(1, int(np.ceil(n * 0.925)))]
            y = np.unique(np.concatenate([y, rng.integers(0, 1 << 63, rng.integers(0, max(1, n // 13) + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 85 * (len(x) + len(y) - both) and len(x) != both:
                which, keys, tags = jaccard.region_keys([x, y], 85)
                one, two = (dict(zip(keys[which == i].tolist(), tags[which == i].tolist(), strict=True)) for i in (0, 1))
                met = set(one) & set(two)
                assert any(sum(own[k] == tag for k in met) >= tag & 0xFFFF for own in (one, two) for tag in set(own.values()))


def test_jaccard_odd_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "one two three four"), (7, "one two three"), (7, "one two three"), (None, "one two"), (8, "w " * 30000), (9, "w " * 30001)]
    got = jaccard.cluster(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, set_id string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (7, 1, 7), (None, 1, 4), (8, 1, 8), (9, 1, 8)], key=str
    )
    assert jaccard.cluster(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one(spark):
    docs = near_copies(3, 10, 5) + [(900, None), (901, "")]
    want = sorted(i for i, (_, c) in plain_components(docs, 5, 80).items() if i == c)
    kept = jaccard.keep_one(spark.createDataFrame(docs + [docs[0]], SCHEMA))
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_keep_one_without_ids(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(None, base, 1), (None, base + " more", 2), (None, base, 1), (None, "other text of its own", 3), (7, "x " + base, 4), (None, None, 5), (None, "one more alone here", 6)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, __slot int")).collect()
    assert sorted(r["__slot"] for r in kept) == [3, 4, 5, 6]


# --- Content-defined cuts ---


def plain_hash(data, dtype):
    bits = np.dtype(dtype).itemsize * 8
    h, out = 0, []
    for b in data:
        h = ((h << 1) + (int(gear.GEARS[b]) & ((1 << bits) - 1))) & ((1 << bits) - 1)
        out.append(h)
    return out


@pytest.mark.parametrize("dtype", [np.uint16, np.uint32])
def test_rolling_hash_is_a_gear_hash(dtype):
    data = np.frombuffer(random.Random(2).randbytes(500), np.uint8)
    assert gear.rolling(data, dtype).tolist() == plain_hash(data.tolist(), dtype)


def test_cuts_follow_their_rules_and_resist_shifts():
    data = random.Random(3).randbytes(20_000)
    ends = gear.cuts(np.frombuffer(data, np.uint8), 5, 16, 128)
    gaps = np.diff(np.concatenate([[0], ends]))
    assert ends[-1] == len(data) and gaps.max() <= 128 and (gaps > 0).all()
    moved = gear.cuts(np.frombuffer(b"inserted" + data, np.uint8), 5, 16, 128)
    assert len(set((moved - 8).tolist()) & set(ends.tolist())) > 0.97 * len(ends)
    assert gear.cuts(np.zeros(0, np.uint8), 5, 16, 128).tolist() == [] and gear.cuts(np.zeros(1000, np.uint8), 5, 16, 128)[-1] == 1000


def test_bitmap(spark):
    slots = {0, 1, 5, 32767, 32768, 65535, 65536, 99999}
    t = bitmap(spark.createDataFrame([(s,) for s in slots for _ in range(2)], "slot bigint"), 100_000)
    assert {s for s in range(100_000) if in_bitmap(t, s)} == slots
    assert not bitmap(spark.createDataFrame([], "slot bigint"), 64).any()


# --- Substring duplicates ---


def passages(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    planted = [" ".join(word() for _ in range(55)) for _ in range(40)]
    docs, held = [], defaultdict(list)
    for i in range(160):
        p = i % 40 if i < 120 else None
        before, after = (" ".join(word() for _ in range(rng.randint(0, 80))) for _ in range(2))
        docs.append((i, f"{before} {planted[p]} {after}" if p is not None else f"{before} {after}"))
        if p is not None:
            held[i] = planted[p]
    return docs, held


def test_planted_passages_are_found_and_clean_documents_left(spark):
    docs, held = passages()
    got = substrings.repeated_passages(spark.createDataFrame(docs, SCHEMA)).collect()
    assert not {r["doc_id"] for r in got} - set(held)
    assert len({r["doc_id"] for r in got}) >= 0.97 * len(held)
    text = dict(docs)
    for r in got:
        part = text[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode()
        assert part.strip() in held[r["doc_id"]] and r["first"] == (r["doc_id"] < 40)


def test_repeats_are_cut_but_where_they_stand_first(spark):
    docs, held = passages()
    df = spark.createDataFrame([(t, i, "kept") for i, t in [*docs, (500, None), (501, "é" * 400), (502, "é" * 400)]], "text string, doc_id bigint, other string")
    got = {r["doc_id"]: r for r in substrings.without_repeats(df).collect()}
    text = dict(docs)
    assert len(got) == len(docs) + 3 and {r["other"] for r in got.values()} == {"kept"} and got[500]["text"] is None
    assert all(got[i]["text"] == text[i] for i in text if i < 40 or i not in held)
    assert sum(len(text[i]) - len(got[i]["text"]) >= 120 for i in held if i >= 40) >= 0.97 * 80
    assert got[501]["text"] == "é" * 400 and got[502]["text"] == ""


def test_a_longer_copy_keeps_what_it_is_first_to_hold(spark):
    rng = random.Random(8)
    start, end = (" ".join(f"{rng.getrandbits(40):x}" for _ in range(60)) for _ in range(2))
    df = spark.createDataFrame([(1, start), (2, f"{start} {end}"), (3, f"{start} {end}")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in substrings.without_repeats(df).collect()}
    assert got[1] == start and got[2].endswith(f" {end}") and len(got[2]) < len(end) + 300 and got[3] == ""
    _, _, digest, _, _ = substrings.units_of([start, f"{start} {end}"])
    kept = substrings.units_of([got[1], got[2]])[2]
    assert set(digest.tolist()) - set(kept.tolist()) <= set(substrings.units_of([start])[2].tolist()[-1:])
    places = {r["doc_id"]: r for r in substrings.repeated_passages(df).collect()}
    assert [(r["first"], r["start_byte"]) for _, r in sorted(places.items())] == [(True, 0), (False, 0), (False, 0)]
    own = {i: [tuple(p) for p in r["first_parts"]] for i, r in places.items()}
    assert own[1] == [(0, places[1]["end_byte"])] and own[3] == [] and len(own[2]) == 1
    assert 0 < own[2][0][0] <= len(start) and own[2][0][1] == len(start) + 1 + len(end)


def plain_units(data):
    """(start, end) of each two neighbouring chunks, byte by byte."""
    hits = [p for p, h in enumerate(plain_hash(data, np.uint16), 1) if h < 1 << 12 and 12 <= p < len(data)]
    edges = [0]
    for e in [p for k, p in enumerate(hits) if not k or p - hits[k - 1] >= 12] + [len(data)] * bool(data):
        while e - edges[-1] > 256:
            edges.append(edges[-1] + 256)
        edges.append(e)
    return [(edges[0], edges[1])] if len(edges) == 2 else list(zip(edges, edges[2:], strict=False))


def test_passages_match_a_plain_chunker(spark, sf):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    own, holders = {i: plain_units(t) for i, t in docs}, defaultdict(set)
    for i, t in docs:
        for a, b in own[i]:
            holders[t[a:b]].add(i)
    want = set()
    for i, t in docs:
        run = []
        for u in [*own[i], None]:
            if u and len(holders[t[u[0] : u[1]]]) > 1:
                run.append(u)
                continue
            if run and run[-1][1] - run[0][0] >= 120:
                want.add((i, run[0][0], run[-1][1], len(run)))
            run = []
    got = substrings.repeated_passages(table(spark, sf, "documents")).collect()
    assert want and {(r["doc_id"], r["start_byte"], r["end_byte"], r["n_units"]) for r in got} == want


def test_a_crowded_bitmap_loses_and_adds_nothing(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    want = sorted(map(str, substrings.repeated_passages(docs).collect()))
    monkeypatch.setattr(substrings, "_LEAST_SLOTS", 8)
    monkeypatch.setattr(substrings, "_MOST_SLOTS", 8)
    assert want and sorted(map(str, substrings.repeated_passages(docs).collect())) == want


def test_slots_follow_the_count_within_bounds():
    assert substrings.slots_for(0) == substrings._LEAST_SLOTS
    assert substrings.slots_for(1 << 20) == 1 << 24
    assert substrings.slots_for(1 << 40) == substrings._MOST_SLOTS


def test_substring_odd_cases(spark):

    long = " ".join(f"{random.Random(i).random()}" for i in range(4000))
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (None, long), (5, "same line here\n" * 500)]
    got = substrings.repeated_passages(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, start int")).collect()
    assert {r["doc_id"] for r in got} == {4, None} and {(r["start_byte"], r["end_byte"]) for r in got} == {(0, len(long))}
    assert substrings.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


# --- Media ---


def check_media(spark, df, docs):
    got = media.media(df).collect()
    assert len(got) == len(docs)
    form = {}
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want
        assert form.setdefault(payload, (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])
        assert r["feature"] == media.features(payload)


def test_media_round_trip(spark, sf):
    df = table(spark, sf, "documents")
    check_media(spark, df, {r["doc_id"]: r["text"] for r in df.collect()})


def test_media_odd_cases(spark):
    big = "".join(map(str, (random.Random(i).random() for i in range(40_000))))
    texts = [None, "", "x", "x" * 576, "é" * 288, big, big, big + "tail", big[:9000] + "y" + big[9000:], "z" * 200_000, "x"]
    docs = dict(enumerate(texts))
    check_media(spark, spark.createDataFrame([(i, t, "k") for i, t in docs.items()], "doc_id bigint, text string, sha string").repartition(4), docs)
    assert media.media(spark.createDataFrame([], SCHEMA)).count() == 0
    _, chunks = media.store(spark.createDataFrame(list(docs.items()), SCHEMA).repartition(3))
    rows = [bytes(r["digest"]) for r in chunks.collect()]
    plain = {media._digest(c, len(p) == 1) for t in texts for p in [media.chunks_of(media.payload_of(t)[1])] for c in p}
    assert len(rows) == len(set(rows)) and set(rows) == plain


# --- Nearest neighbours ---


def exact_top(ids, v, q, k):
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = n @ n[ids.index(q)]
    order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
    return [(ids[i], s[i]) for i in order]


def test_recall_on_the_table(spark, sf):
    rows = table(spark, sf, "embeddings").collect()
    ids, v = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    got = ann.search(table(spark, sf, "embeddings"), F.col("id") % 50 == 0, shard_rows=200).collect()
    queries = [i for i in ids if i % 50 == 0]
    assert {r["query_id"] for r in got} == set(queries) and len(got) == 5 * len(queries)
    hits = 0
    for q in queries:
        want = dict(exact_top(ids, v, q, 5))
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        score = {i: s for i, s in exact_top(ids, v, q, len(ids))}
        assert all(r["score"] == pytest.approx(score[r["vec_id"]], abs=1e-12) for r in mine)
        hits += sum(r["vec_id"] in want for r in mine)
    assert hits / (5 * len(queries)) >= 0.9


def test_recall_of_a_larger_graph():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 64))
    g = ann.Graph(v, 20).build(96)
    flat = g.flat()
    back = ann.Graph.restore(v, 20, flat["entry"], flat["nodes"], flat["links"])
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = sum(len(set(back.search(v[q], 256)[:5]) & set(np.argsort(-(n @ n[q]))[:5].tolist())) for q in range(0, 3000, 60))
    assert hits / 250 >= 0.9


def test_scaled_copies_tie(spark):
    """Many vectors of one direction: the nearest are those of the smallest ids."""
    rng = random.Random(6)
    rows = [(i, [2.0 ** (i % 23), 2.0 ** (i % 23 + 1)]) for i in range(60)] + [(100 + i, [rng.random(), -rng.random()]) for i in range(60)]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") == 50, shard_rows=40).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [0, 1, 2, 3, 4]


def test_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 40)] + [(100, [0.5, 0.5]), (150, [2.0, 0.0]), (200, None), (250, []), (300, [0.0, 0.0]), (350, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (450, [None, 1.0]), (None, [1.0, 0.0]), (500, [1.0, 2.0, 3.0]), (100, [0.5, 0.5])]
    got = ann.search(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score string"), F.col("id") % 50 == 0).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append(r["vec_id"])
    assert by == {0: [1, 2, 3, 4, 5], 100: [0, 1, 2, 3, 4], 150: [0, 1, 2, 3, 4]}
    assert ann.search(spark.createDataFrame([], "vec_id bigint, embedding array<double>"), F.col("id") % 50 == 0).count() == 0
