"""Anchor, positive and negative names from groups, by deterministic draws.

A negative's group is an offset from the anchor's in a dense numbering of the groups by hash, so it is
uniform over all others without a rejection loop, and an equi-join finds it. No task orders all groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.functions import text
from onomast.functions.sampling import draw, placed, unit


def indexed(rows: DataFrame, group_col: str = "id", name_col: str = "name", least: int = 2) -> DataFrame:
    """(grp, name, i, n): each group's names by a 0-based index, of groups of at least `least`."""
    own = Window.partitionBy("grp")
    named = rows.select(F.col(group_col).alias("grp"), F.col(name_col).alias("name")).where("grp is not null and name is not null")
    named = named.withColumn("i", F.row_number().over(own.orderBy("name")) - 1).withColumn("n", F.count("*").over(own))
    return named.where(F.col("n") >= least)


def _unranked(ordinal: Column, n: Column) -> tuple[Column, Column]:
    """(i, j), i < j < n, of a pair's place in the order (0,1), (0,2), (1,2), (0,3), ..."""
    j = F.floor((1 + F.sqrt(1 + 8 * ordinal.cast("double"))) / 2)
    j = F.when(j * (j - 1) / 2 > ordinal, j - 1).when((j + 1) * j / 2 <= ordinal, j + 1).otherwise(j)
    return (ordinal - (j * (j - 1) / 2).cast("bigint")).cast("int"), j.cast("int")


#: Primes next below 2^32 (fixed values).
STRIDES = (4294967291, 4294967279, 4294967231, 4294967197, 4294967189, 4294967161, 4294967143, 4294967111)


def sample_pairs(members: DataFrame, k: int | None = 200, seed: int = 42) -> DataFrame:
    """(grp, i, j, anchor, positive): all unordered pairs of each group, or k of them (all, if there are no more).
    The k have numbers that a drawn prime stride takes from a drawn start, around the number of pairs: no two are
    equal, and a group of any size costs k rows and no join with itself."""
    b = members.select("grp", F.col("i").alias("j"), F.col("name").alias("positive"))
    if not k:
        return members.select("grp", "i", F.col("name").alias("anchor")).join(b, "grp").where("i < j")
    every = (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
    heads = members.where(F.col("i") == 0).select("grp", "n", every.alias("every"), draw(seed, "grp", F.lit("pairs")).alias("start"), draw(seed, "grp", F.lit("stride")).alias("d"))
    prime = F.element_at(F.array(*(F.lit(x).cast("bigint") for x in STRIDES)), (F.col("d") % len(STRIDES) + 1).cast("int"))
    stride = F.when(prime % F.col("every") == 0, F.lit(1).cast("bigint")).otherwise(prime % F.col("every"))
    drawn = heads.withColumn("stride", stride).withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(k).cast("bigint"), F.col("every")) - 1)))
    i, j = _unranked((F.col("start") + F.col("t") * F.col("stride")) % F.col("every"), F.col("n"))
    drawn = drawn.select("grp", i.alias("i"), j.alias("j"))
    return drawn.join(members.select("grp", "i", F.col("name").alias("anchor")), ["grp", "i"]).join(b, ["grp", "j"]).select("grp", "i", "j", "anchor", "positive")


def group_order(members: DataFrame, seed: int = 42) -> DataFrame:
    """(grp, n, g, total): the groups by a dense number, in the order of a hash."""
    heads = members.where("i = 0").select("grp", "n")
    return placed(heads, [], draw(seed, "grp", F.lit("order")), ["grp"]).select("grp", "n", (F.col("place") - 1).alias("g"), "total")


def build(members: DataFrame, k: int | None = 200, negatives: int = 1, seed: int = 42, exclude_same_text: bool = False) -> DataFrame:
    """(anchor, positive, negative, anchor_group); none if there is but one group."""
    order = group_order(members)
    pairs = sample_pairs(members, k, seed).join(order.select("grp", "g", "total"), "grp").where("total > 1")
    pairs = pairs.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(negatives))))
    offset = draw(seed, "grp", "i", "j", "t", F.lit("g")) % (F.col("total") - 1)
    pairs = pairs.withColumn("other", (F.col("g") + 1 + offset) % F.col("total")).withColumn("pick", draw(seed, "grp", "i", "j", "t", F.lit("n")))
    other = order.select(F.col("g").alias("other"), F.col("grp").alias("neg_grp"), F.col("n").alias("neg_n"))
    pairs = pairs.join(other, "other").withColumn("neg_i", (F.col("pick") % F.col("neg_n")).cast("int"))
    names = members.select(F.col("grp").alias("neg_grp"), F.col("i").alias("neg_i"), F.col("name").alias("negative"))
    out = pairs.join(names, ["neg_grp", "neg_i"])
    if exclude_same_text:
        out = out.where("negative <> anchor")
    return out.select("anchor", "positive", "negative", F.col("grp").cast("string").alias("anchor_group"))


def build_distinct(members: DataFrame, seed: int = 42) -> DataFrame:
    """Every pair with one negative, as a set."""
    return build(members, None, 1, seed).distinct()


def blocking_keys(rows: DataFrame) -> DataFrame:
    """(row_id, cluster_id, name, normal, kind, key): a row per key that a name has."""
    normal = text.match_normalize(F.col("name"))
    keyed = rows.withColumn("normal", normal)
    keys = F.array(
        F.struct(F.lit("same_surname").alias("kind"), text.surname(F.col("normal")).alias("key")),
        F.struct(F.lit("consonant_skeleton").alias("kind"), text.skeleton(F.col("normal")).alias("key")),
        F.struct(F.lit("same_initials").alias("kind"), text.initials(F.col("normal")).alias("key")),
    )
    return keyed.select("row_id", "cluster_id", "name", "normal", F.inline(keys)).where("key <> ''")


def negative_candidates(anchors: DataFrame, rows: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    """(anchor_id, row_id, label, distance): rows of other clusters that share a key with an anchor
    (row_id of rows) at an edit distance from low to high."""
    keys = blocking_keys(rows)
    asked = blocking_keys(anchors).select(F.col("row_id").alias("anchor_id"), F.col("cluster_id").alias("own"), F.col("normal").alias("wanted"), "kind", "key")
    met = asked.join(keys, ["kind", "key"]).where(F.col("cluster_id") != F.col("own"))
    met = met.withColumn("distance", text.edit_distance(F.col("wanted"), F.col("normal"), high)).where(F.col("distance").between(low, high))
    return met.select("anchor_id", "row_id", F.concat(F.col("kind"), F.lit("_lev"), F.col("distance")).alias("label"), "distance")


def choose_negative(anchors: DataFrame, rows: DataFrame, seed: int = 42) -> DataFrame:
    """(anchor_id, row_id, label): the first candidate by hash order, else any row of another cluster."""
    found = negative_candidates(anchors, rows)
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(draw(seed, "anchor_id", "row_id", "label"), "row_id", "label"))
    found = found.withColumn("r", first).where("r = 1").select("anchor_id", "row_id", "label")
    members = indexed(rows.select(F.col("cluster_id").alias("id"), F.col("row_id").alias("name")), least=1)
    order = group_order(members)
    rest = anchors.join(found.select(F.col("anchor_id").alias("row_id")), "row_id", "left_anti").select(F.col("row_id").alias("anchor_id"), F.col("cluster_id").alias("grp"))
    rest = rest.join(order.select("grp", "g", "total"), "grp").where("total > 1")
    rest = rest.withColumn("other", (F.col("g") + 1 + draw(seed, "anchor_id", F.lit("g")) % (F.col("total") - 1)) % F.col("total"))
    rest = rest.join(order.select(F.col("g").alias("other"), F.col("grp").alias("neg_grp"), F.col("n").alias("neg_n")), "other")
    rest = rest.withColumn("neg_i", (draw(seed, "anchor_id", F.lit("n")) % F.col("neg_n")).cast("int"))
    fallback = rest.join(members.select(F.col("grp").alias("neg_grp"), F.col("i").alias("neg_i"), F.col("name").alias("row_id")), ["neg_grp", "neg_i"])
    return found.unionByName(fallback.select("anchor_id", "row_id", F.lit("random_diff_cluster").alias("label")))


def heuristic(rows: DataFrame, augment, per_cluster: int = 2, seed: int = 42, noise_rate: float = 0.5, max_ops: int = 2) -> DataFrame:
    """Rich triplets of rows(row_id, cluster_id, name, lang): per cluster and turn an anchor, a positive
    from its cluster (odds 0.6, if there is another) or the anchor itself, both augmented, and a
    negative that is hard to tell. augment(name, lang, key, noise_rate, max_ops) gives a
    struct(augmented, ops)."""
    own = Window.partitionBy("cluster_id")
    placed = rows.withColumn("i", F.row_number().over(own.orderBy("row_id")) - 1).withColumn("n", F.count("*").over(own))
    turns = placed.where("i = 0").select("cluster_id", "n", F.explode(F.sequence(F.lit(1), F.lit(per_cluster))).alias("turn"))
    key = lambda what: draw(seed, "cluster_id", "turn", F.lit(what))
    turns = turns.withColumn("i", (key("a") % F.col("n")).cast("int"))
    # Another member, uniform: an offset from the anchor.
    other = F.when((F.col("n") > 1) & (unit(seed, "cluster_id", "turn", F.lit("u")) < 0.6), (F.col("i") + 1 + key("p") % (F.col("n") - 1)) % F.col("n")).otherwise(F.col("i"))
    turns = turns.withColumn("p", other.cast("int"))
    a = placed.select("cluster_id", "i", F.col("row_id").alias("a_id"), F.col("name").alias("a_name"), F.col("lang").alias("a_lang"))
    p = placed.select("cluster_id", F.col("i").alias("p"), F.col("name").alias("p_name"), F.col("lang").alias("p_lang"))
    both = turns.join(a, ["cluster_id", "i"]).join(p, ["cluster_id", "p"])
    asked = rows.join(both.select(F.col("a_id").alias("row_id")).distinct(), "row_id", "left_semi")
    negative = choose_negative(asked, rows, seed).join(rows.select("row_id", F.col("name").alias("neg"), F.col("lang").alias("neg_lang")), "row_id").drop("row_id")
    both = both.join(negative.withColumnRenamed("anchor_id", "a_id"), "a_id")
    light = noise_rate if max_ops > 0 else 0.0
    both = both.withColumn("x", augment(F.col("a_name"), F.col("a_lang"), F.concat_ws(":", "cluster_id", "turn", F.lit("a")), noise_rate, max_ops))
    both = both.withColumn("y", augment(F.col("p_name"), F.col("p_lang"), F.concat_ws(":", "cluster_id", "turn", F.lit("p")), light, max_ops))
    return both.select(
        "cluster_id", F.col("x.augmented").alias("anchor"), F.col("a_lang").alias("anchor_lang"), F.col("y.augmented").alias("pos"), F.col("p_lang").alias("pos_lang"),
        "neg", "neg_lang", F.col("label").alias("neg_strategy"), F.col("x.ops").alias("ops_anchor"), F.col("y.ops").alias("ops_pos"),
    )


def cap(triplets: DataFrame, per_group: int = 1000, per_anchor: int = 100, seed: int = 42) -> DataFrame:
    """At most per_group of each group, then at most per_anchor of each anchor; no group, no row."""
    order = [draw(seed, "anchor", "positive", "negative", "anchor_group"), F.col("anchor"), F.col("positive"), F.col("negative"), F.col("anchor_group")]
    kept = triplets.where(F.nullif(F.col("anchor_group"), F.lit("")).isNotNull())
    for key, most in (("anchor_group", per_group), ("anchor", per_anchor)):
        kept = kept.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("r") <= most).drop("r")
    return kept


def mix_hard(training: DataFrame, hard: DataFrame, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Training triplets and int(ratio x their number) hard ones, by hash order."""
    columns = ["anchor", "positive", "negative", "anchor_group"]
    chosen = placed(hard, [], draw(seed, *columns), columns).where(F.col("place") <= int(training.count() * ratio))
    return training.unionByName(chosen.drop("place", "total"))
