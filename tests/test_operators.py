import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from onomast.operators import augment, groups, knn, metrics, mining, records, splits, triplets
from onomast.sources import writers


def grouped(spark, sizes):
    return spark.createDataFrame([(f"g{i:04d}", f"n{i}-{j}") for i, n in enumerate(sizes) for j in range(n)], "id string, name string")


def test_bucket_edges(spark):
    size = spark.createDataFrame([(str(n), n) for n in (1, 29, 30, 31, 50, 51, 200, 201)], "grp string, size bigint")
    ordinal, label = groups.bucket(F.col("size"), 30, [30, 40, 50, 100, 200])
    got = [tuple(r) for r in size.orderBy("size").select(ordinal, label).collect()]
    assert got == [(None, None)] * 2 + [(0, "30-30"), (1, "31-40"), (2, "41-50"), (3, "51-100"), (4, "101-200"), (5, "201-∞")]


@pytest.mark.parametrize("n", [1, 2, 5, 15, 25])
def test_split_counts_round_half_even(spark, n):
    got = splits.summary(splits.stratified(groups.sizes(grouped(spark, [3] * n)), 2, [10])).where("bucket = 'TOTAL'").first()
    train, val = round(n * 0.8), round(n * 0.1)
    assert tuple(got) == ("TOTAL", n, train, val, n - train - val)


def test_splits_are_disjoint_complete_and_capped(spark):
    rows = grouped(spark, [2] * 20 + [12] * 20 + [60] * 5)
    assigned = splits.stratified(groups.sizes(rows), 2, [10, 50])
    assert splits.leaks(assigned).isEmpty() and assigned.count() == 45
    assert splits.split_rows(rows, 2, [10, 50]).count() == rows.count()
    capped = splits.stratified(groups.sizes(rows), 2, [10, 50], caps={"2-10": 3})
    assert capped.where("bucket = '2-10'").count() == 3
    with pytest.raises(ValueError, match="ratios"):
        splits.stratified(groups.sizes(rows), 2, [10], ratios=(0.5, 0.1, 0.1))
    t = splits.by_threshold(groups.sizes(rows), 50, 10).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in t} == {"train": 5, "val": 10, "test": 10}


def test_cutoffs(spark):
    size = groups.sizes(grouped(spark, [4] * 3 + [7] * 2))
    assert groups.choose_cutoff(size, 1, 1, 1).first()[0] == 4
    assert groups.choose_cutoff(size, 100, 1, 1, min_size=5).first()[0] == 5
    assert groups.suggest_cutoff(size, 2).first()[0] == 7
    assert groups.suggest_cutoff(size, 1).first()[0] is None


def test_pairs_of_large_groups_are_drawn_without_a_self_join(spark):
    m = triplets.indexed(grouped(spark, [50, 3]))
    drawn = triplets.sample_pairs(m, 20).where("grp = 'g0000'").collect()
    assert len(drawn) == 20 and len({(r["i"], r["j"]) for r in drawn}) == 20
    assert all(0 <= r["i"] < r["j"] < 50 and r["anchor"] != r["positive"] for r in drawn)


def test_unranking_covers_every_pair(spark):
    i, j = triplets._unranked(F.col("id"), F.lit(40))
    got = {(r[0], r[1]) for r in spark.range(40 * 39 // 2).select(i, j).collect()}
    assert got == {(a, b) for b in range(40) for a in range(b)}


def test_negatives_come_from_other_groups(spark):
    m = triplets.indexed(grouped(spark, [4, 5, 6]))
    got = triplets.build(m, None, 3).collect()
    assert len(got) == (6 + 10 + 15) * 3
    group_of = {r["name"]: r["grp"] for r in m.collect()}
    assert all(group_of[r["anchor"]] == group_of[r["positive"]] == r["anchor_group"] != group_of[r["negative"]] for r in got)
    assert triplets.build(triplets.indexed(grouped(spark, [4]))).isEmpty()


def test_caps_and_missing_groups(spark):
    rows = [("a", f"p{i}", "n", "g") for i in range(30)] + [("b", "p", "n", ""), ("b", "p", "n", None)]
    t = spark.createDataFrame(rows, "anchor string, positive string, negative string, anchor_group string")
    assert triplets.cap(t, 20, 7).count() == 7


CLUSTERS = [("c1", "Robert Downey", "en"), ("c1", "Bob Downey", "en"), ("c2", "Roberto Dauni", "es"), ("c3", "Muhammad Ali", "ar"), ("c4", "Алексей Иванов", "ru"), ("c5", "José García", "es")]


def test_heuristic_triplets(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CLUSTERS)], "row_id bigint, cluster_id string, name string, lang string")
    got = triplets.heuristic(rows, augment.augmenter(7), 2, noise_rate=0.9).collect()
    assert len(got) == 10 and all(isinstance(r["anchor"], str) and isinstance(r["pos"], str) and r["cluster_id"] for r in got)
    cluster = {n: c for c, n, _ in CLUSTERS}
    assert all(cluster[r["neg"]] != r["cluster_id"] for r in got)
    again = triplets.heuristic(rows.repartition(5), augment.augmenter(7), 2, noise_rate=0.9).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_negative_prefers_near_spellings(spark):
    names = [(0, "x", "Jon Smith"), (1, "y", "Jan Smith"), (2, "z", "Completely Other")]
    rows = spark.createDataFrame(names, "row_id bigint, cluster_id string, name string")
    got = {r["anchor_id"]: (r["row_id"], r["label"]) for r in triplets.choose_negative(rows, rows).collect()}
    assert got[0][0] == 1 and got[0][1].endswith("_lev1") and got[2][1] == "random_diff_cluster"


# --- Augmentation ---


def noisy(name, lang, n=60, **k):
    return [augment.augment_name(name, lang, random.Random(i), **k) for i in range(n)]


def test_augmentor_behaviour():
    assert augment.augment_name("José García", "es", random.Random(1), noise_rate=0.0) == ("José García", [])
    assert any(s != "José" for s, _ in noisy("José", "es", noise_rate=1.0))
    assert all(s for s, _ in noisy("Juan de la Cruz", "es", noise_rate=1.0, max_ops=0))
    assert any("initials" in o for _, o in noisy("John Smith", "en", noise_rate=1.0, max_ops=0))
    assert any(x.startswith("transliteration(ru)") for _, o in noisy("Алексей Иванов", "ru", noise_rate=1.0) for x in o)
    assert noisy("Robert Downey", "en") == noisy("Robert Downey", "en")


def test_transforms():
    rng = random.Random(3)
    assert augment.swap_words(["a", "b"], rng) == ["b", "a"]
    assert all(augment.truncate("abc", random.Random(i)) == "abc" for i in range(9))
    assert all(7 <= len(augment.truncate("abcdefghij", random.Random(i))) <= 9 for i in range(50))
    assert {augment.join_or_split("a-b c", random.Random(i)) for i in range(40)} == {"a b c", "a-bc", "a-b-c"}
    assert augment.confuse("John", random.Random(0), dot_is_any=True)
    assert "Xohn" not in {augment.confuse("John", random.Random(i)) for i in range(50)}
    assert ",ohn" in {augment.confuse("John", random.Random(i), dot_is_any=True) for i in range(200)}
    assert augment.replace_words(["Robert"], {"robert": ["Bob"]}, 1.1, rng) == ["Bob"]
    assert set(augment.particles(["de", "x"], frozenset(["de"]), random.Random(i))[0] for i in range(40)) == {"x", "dex", "de"}
    assert set(map(tuple, (augment.placeholders(["A", "FNU"], ("FNU",), random.Random(i)) for i in range(60)))) == {("FNU", "A", "FNU"), ("A", "FNU", "FNU"), ("A",), ("A", "FNU")}
    assert augment.profile(augment.PROFILES, "en").placeholders == ("FNU", "LNU", "UNK")


def test_augment_rows_do_not_depend_on_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"Robert Downey {i}", "en", "keep") for i in range(200)] + [(999, None, "en", "keep")], "id bigint, name string, language string, other string")
    one, two = (sorted(augment.augment_rows(r).collect(), key=lambda r: r["id"]) for r in (rows, rows.repartition(7)))
    assert one == two and one[-1]["augmented"] is None and {r["other"] for r in one} == {"keep"}
    writers.write_augmented(augment.augment_rows(rows), str(tmp_path / "a"))
    head = next((tmp_path / "a").glob("*.csv")).read_text().splitlines()[0]
    assert head == "id,name,language,augmented,ops"


# --- Vectors, mining, metrics ---


def vectors_of(spark, n=60, dim=8, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, i % 5, f"n{i}", v[i].tolist()) for i in range(n)], "id bigint, grp int, name string, v array<double>")


def test_knn_by_blocks_is_exact(spark):
    v, df = vectors_of(spark)
    got = {(int(r["qid"]), r["rank"]): r["id"] for r in knn.top_k(knn.unbounded(df).withColumn("qid", F.col("id").cast("string")), df, 4, block_rows=13).collect()}
    s = np.round(v @ v.T, 6)
    want = {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.lexsort((np.arange(60), -s[i]))[:4])}
    assert got == want


def test_ivf_finds_most_neighbours(spark):
    v, df = vectors_of(spark, 300)
    got = {(r["qid"], r["id"]) for r in knn.ivf_knn(df, 5, nlist=12, nprobe=6).collect()}
    want = {(i, int(j)) for i in range(300) for j in np.argsort(-(v[i] @ v.T))[:5]}
    assert len(got & want) / len(want) > 0.85


def test_ivf_by_blocks_is_the_same(spark, monkeypatch):
    v, df = vectors_of(spark, 200)
    copies = df.withColumn("v", F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, v[0].tolist()))).otherwise(F.col("v")))
    found = lambda **b: sorted(tuple(r) for r in knn.ivf_knn(copies, 5, nlist=8, nprobe=3, **b).select("qid", "id", "score", "rank").collect())
    whole = found()
    monkeypatch.setattr(knn, "PIECE", 64)
    assert found(block_rows=7) == whole and len(whole) == 1000


def test_encoder(spark):
    df = spark.createDataFrame([("ann",), ("ann",), ("",), (None,)], "text string")
    got = {r["text"]: r["embedding"] for r in knn.encode(df).collect()}
    assert set(got) == {"ann", ""} and np.linalg.norm(got["ann"]) == pytest.approx(1)
    assert spark.createDataFrame([([0.1],)], "v array<double>").select(knn.half_precision(F.col("v"))).first()[0] == [pytest.approx(float(np.float16(0.1)))]


def test_miners_hold_their_masks(spark):
    v, df = vectors_of(spark)
    for mined, most in ((mining.mine_exhaustive(df, 0.2, 3), 3), (mining.mine_sampled(df, 0.2, 3, groups=2), 3)):
        rows = mined.collect()
        assert rows and all(r["pos"] - 0.2 - 1e-6 <= r["score"] < r["pos"] and r["neg"] % 5 != r["grp"] and r["rank"] <= most for r in rows)
    capped = mining.mine_knn(df, 30, 4, 0.05, semi=True, cap_per_group=5).groupBy("grp").count().collect()
    assert capped and all(r["count"] <= 5 for r in capped)


def test_miners_take_every_pair(spark):
    v, df = vectors_of(spark, 120)
    s, want = np.round(v @ v.T, 6), set()
    for a in range(120):
        for b in range(a + 5, 120, 5):
            held = [j for j in range(120) if j % 5 != a % 5 and round(s[a, b] - 0.2, 8) <= s[a, j] < s[a, b]]
            want |= {(a, b, j, k + 1) for k, j in enumerate(sorted(held, key=lambda j: (-s[a, j], j))[:3])}
    assert len({(a, b) for a, b, _, _ in want}) > 5 * 200
    small = mining.mine_exhaustive(df, 0.2, 3, pairs_per_task=300, pairs_per_row=7, block_rows=25)
    for mined in (mining.mine_exhaustive(df, 0.2, 3), small, mining.mine_sampled(df, 0.2, 3, groups=4)):
        assert {(r["a"], r["b"], r["neg"], r["rank"]) for r in mined.collect()} == want


def test_counted_as_listed(spark):
    _, df = vectors_of(spark, 120)
    for more in ({}, {"semi": False}, {"pairs_per_group": 7}):
        listed, counted = (mining.mine_exhaustive(df, 0.2, 3, counted=c, **more) for c in (False, True))
        want = {r["grp"]: r["count"] for r in listed.groupBy("grp").count().collect()}
        assert want and {r["grp"]: r["n"] for r in counted.groupBy("grp").agg(F.sum("n").alias("n")).collect()} == want
        assert mining.written_per_group(counted).first() == mining.written_per_group(listed).first()


def test_pairs_are_mined_where_they_are_made(spark):
    _, df = vectors_of(spark, 120)
    plan = mining.mine_exhaustive(df, 0.2, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def parquet_bytes(df, path):
    df.write.parquet(str(path))
    return sum(f.stat().st_size for f in path.glob("*.parquet"))


def test_exhaustive_miner_lists_what_files_hold_well(spark, tmp_path):
    """The same rows in the order of their pairs take a third more, as scores that are alike stand far apart."""
    v, _ = vectors_of(spark, 2000, 64)
    df = spark.createDataFrame([(i, i % 10, (0.7 * v[i]).tolist()) for i in range(2000)], "id bigint, grp int, v array<double>")
    mined = mining.mine_exhaustive(df, 0.1, 10, pairs_per_task=1 << 40)
    size = parquet_bytes(mined, tmp_path / "mined")
    rows = spark.read.parquet(str(tmp_path / "mined"))
    assert rows.count() > 1_500_000 and size < 0.85 * parquet_bytes(rows.coalesce(1).sortWithinPartitions("a", "b", "rank"), tmp_path / "by_pair")
    _, few = vectors_of(spark, 120)
    assert sorted(mining.mine_exhaustive(few, 0.2, 3, sorted_rows=50).collect()) == sorted(mining.mine_exhaustive(few, 0.2, 3).collect()) != []


def test_exhaustive_miner_odd_scores(spark):
    """Scores that don't fit a number together with a place, and some that are no numbers."""
    rows = [(1, 0, [1e8]), (2, 0, [1e8]), (3, 0, [float("nan")]), (4, 1, [1e8 - 1e-8]), (5, 1, [1e8 - 2e-8]), (6, 1, [float("inf")]), (7, 1, [1e8])]
    df = spark.createDataFrame(rows, "id bigint, grp int, v array<double>")
    got = {(r["a"], r["b"], r["neg"], r["rank"]) for r in mining.mine_exhaustive(df, 10.0, 2).collect()}
    assert got == {(1, 2, 4, 1), (1, 2, 5, 2)} | {x for x in got if x[0] > 3} and not {r for r in got if r[2] in (3, 6)}
    every = {(r["a"], r["b"], r["neg"]) for r in mining.mine_exhaustive(df, 10.0, 2, semi=False).where("grp = 0").collect()}
    assert every == {(1, 2, 7), (1, 2, 4)}


def test_sampled_miner_draws_the_same_by_joins_and_in_place(spark):
    v, _ = vectors_of(spark, 150)
    df = spark.createDataFrame([(i, str(i % 13) if i % 17 else None, v[i].tolist()) for i in range(150)], "id bigint, grp string, v array<double>")
    rows_of = lambda **b: sorted(tuple(r) for r in mining.mine_sampled(df, 0.3, 3, groups=4, **b).collect())
    assert rows_of(join_rows=0) == rows_of(join_rows=1 << 40) != []
    assert rows_of(join_rows=0, semi=False, pairs_per_group=5) == rows_of(join_rows=1 << 40, semi=False, pairs_per_group=5) != []


def test_sampled_miner_lists_what_files_hold_well(spark, tmp_path):
    v, _ = vectors_of(spark, 2000, 64)
    df = spark.createDataFrame([(i, i % 10, (0.7 * v[i]).tolist()) for i in range(2000)], "id bigint, grp int, v array<double>").coalesce(1)
    for groups in (4, 10):
        mined = mining.mine_sampled(df, 0.1, 10, groups=groups, join_rows=0)
        size = parquet_bytes(mined, tmp_path / f"mined{groups}")
        rows = spark.read.parquet(str(tmp_path / f"mined{groups}"))
        by_pair = rows.withColumn("task", F.input_file_name()).repartition("task").sortWithinPartitions("task", "a", "b", "rank").drop("task")
        assert rows.count() > 1_500_000 and size < 0.95 * parquet_bytes(by_pair, tmp_path / f"by_pair{groups}")
        falling = rows.select("pos", F.input_file_name().alias("f")).toPandas().groupby("f")["pos"]
        assert all(x.is_monotonic_decreasing for _, x in falling)


def test_exhaustive_miner_odd_rows(spark):
    schema = "id bigint, grp string, v array<double>"
    assert mining.mine_exhaustive(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "a", None), (4, "b", [0.95, 0.0]), (5, "b", [0.95, 0.0]), (6, None, [0.96, 0.0])]
    got = mining.mine_exhaustive(spark.createDataFrame(rows, schema), k=2)
    assert {(r["a"], r["b"], r["neg"], r["rank"]) for r in got.collect()} == {(1, 2, 6, 1), (1, 2, 4, 2)} and got.schema["grp"].dataType.simpleString() == "string"
    capped = mining.mine_exhaustive(spark.createDataFrame([(i, i % 2, [1.0 - i / 100]) for i in range(20)], "id bigint, grp int, v array<double>"), pairs_per_group=3)
    assert {tuple(x) for x in capped.select("grp", "a", "b").distinct().groupBy("grp").count().collect()} <= {(0, 3), (1, 3), (0, 2), (1, 2), (0, 1), (1, 1)}


def scored(spark, rows):
    return spark.createDataFrame(rows, "y int, score double")


def plain_auc(rows):
    p, n = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))


def test_curve_metrics(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)]
    df = scored(spark, rows)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(plain_auc(rows))
    ap, seen, last = 0.0, 0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        hit = [y for y, s in rows if s >= t]
        recall = sum(hit) / sum(y for y, _ in rows)
        ap, last = ap + (recall - last) * sum(hit) / len(hit), recall
    assert metrics.average_precision(df).first()[0] == pytest.approx(ap)
    f1 = {t: 2 * (tp := sum(y for y, s in rows if s >= t)) / (sum(s >= t for _, s in rows) + sum(y for y, _ in rows)) for t in {s for _, s in rows}}
    order = sorted(f1)
    best = max(order, key=lambda t: (f1[t], -t))
    want = order[order.index(best) - 1] if best != order[0] else float(np.median([s for _, s in rows]))
    assert metrics.tau_max_f1(df).first()[0] == pytest.approx(want)


def test_edge_thresholds(spark):
    tied = scored(spark, [(1, 0.5), (0, 0.5)])
    assert metrics.roc_auc(tied).first()[0] == 0.5 and metrics.tau_max_f1(tied).first()[0] == 0.5
    perfect = scored(spark, [(1, 0.9), (1, 0.8), (0, 0.1)])
    assert metrics.tau_max_f1(perfect).first()[0] == 0.1 and metrics.tau_precision_at(perfect, 0.995).first()[0] == 0.8
    assert metrics.tau_precision_at(scored(spark, [(0, 0.9), (1, 0.1)]), 0.995).first()[0] == 0.9
    row = metrics.confusion(perfect, 2.0).first()
    assert row["ppv"] == 0 and row["npv"] == pytest.approx(1 / 3)
    assert metrics.confusion(perfect, -1.0).first()["npv"] == 0
    best = metrics.best_threshold(metrics.threshold_sweep(perfect)).first()
    assert best["t"] == pytest.approx(0.1) and best["f1"] == 1.0


def test_statistics(spark):
    rows = [("a", i, float(x)) for i, x in enumerate([1, 2, 3, 10])] + [("a", 9, float("nan")), ("b", 0, None)]
    df = spark.createDataFrame(rows, "k string, s int, x double")
    a = metrics.describe(df, "x", "k", 2.5).where("k = 'a'").first()
    v = np.array([1, 2, 3, 10.0])
    assert (a["mean"], a["std"], a["p95"], a["clip_rate"], a["non_finite"]) == (pytest.approx(v.mean()), pytest.approx(v.std()), pytest.approx(np.percentile(v, 95)), 0.5, 1)
    r = 0.0
    for x in v:
        r = 0.9 * r + 0.1 * x
    assert metrics.moving_average(df.where("not isnan(x) and x is not null"), "k", "s", "x").first()["ema"] == pytest.approx(r)


def test_pairs_carry_both_labels(spark):
    t = spark.createDataFrame([("a", "b", "c", "g"), ("a", "c", "b", "g"), ("a", "b", "c", "h")], "anchor string, positive string, negative string, anchor_group string")
    assert metrics.labelled_pairs(t).count() == 4 and metrics.gallery(t).count() == 3


# --- Records ---


def test_record_shapes(spark):
    schema = "DATA_SOURCE string, RECORD_ID string, RECORD_TYPE string, NAMES array<struct<NAME_TYPE:string,NAME_FULL:string,NAME_ORG:string>>, embeddings array<array<float>>"
    df = spark.createDataFrame([("T", "1", "PERSON", [("P", "Ann", None)], [[0.5, 1.0]]), ("T", "2", "ORGANIZATION", [("P", None, "Acme")], None)], schema)
    one, two = (json.loads(r["json"]) for r in records.with_embeddings(df, "PERSON").orderBy("RECORD_ID").collect())
    assert one["NAME_EMBEDDINGS"] == [{"NAME_EMBEDDING": "[0.5, 1.0]", "NAME_LABEL": "Ann"}] and "NAME_EMBEDDINGS" not in two


def test_search_results(spark):
    one = {"MATCH_INFO": {"FEATURE_SCORES": {"NAME": [{"SCORE": 90}]}}, "ENTITY": {"RESOLVED_ENTITY": {"ENTITY_ID": 7, "ENTITY_NAME": "Ann"}}}
    df = spark.createDataFrame([(json.dumps({"RESOLVED_ENTITIES": [one]}),), ('{"RESOLVED_ENTITIES": []}',)], "json string")
    assert [tuple(r) for r in records.search_results(df).collect()] == [(7, "Ann", 90, 0)]


def test_search(spark):
    v, df = vectors_of(spark)
    got = records.search(df, v[3].tolist(), 0.3).collect()
    assert got[0]["id"] == 3 and got[0]["bucket"] == "same" and all(r["score"] >= 0.3 for r in got)
