"""Pair, triplet and retrieval metrics as relational plans.

Curves are computed over distinct scores, rounded to six digits: at most two million rows whatever
the number of pairs, and the only windows without partitions are over that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onomast.functions.vectors import dot, is_finite, triplet_loss
from onomast.operators.knn import DIGITS, knn_join


def _down(column: str = "score"):
    return Window.orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, 0)


def _every():
    return Window.partitionBy(F.lit(1))



def curve(scored: DataFrame) -> DataFrame:
    """(score, p, n, tp, fp, pos, neg, precision, recall, f1) per distinct score of scored(y, score), the
    predictions being those of that score or more."""
    by = scored.groupBy(F.round("score", DIGITS).alias("score")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n"))
    out = by.withColumns({"tp": F.sum("p").over(_down()), "fp": F.sum("n").over(_down()), "pos": F.sum("p").over(_every()), "neg": F.sum("n").over(_every())})
    out = out.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", "pos")})
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    return out.withColumn("f1", f1)


def roc_auc(scored: DataFrame) -> DataFrame:
    """The tie-aware area: a positive beats the negatives below it, and half of those of its score."""
    won = F.sum(F.col("p") * (F.col("neg") - F.col("fp") + F.col("n") / 2))
    return curve(scored).agg(F.try_divide(won, F.max("pos") * F.max("neg")).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    return curve(scored).agg(F.try_divide(F.sum(F.col("p") * F.col("precision")), F.max("pos")).alias("average_precision"))


def tau_max_f1(scored: DataFrame) -> DataFrame:
    """The threshold one below that of the first best F1, in ascending order, or the median score if
    that is the lowest threshold."""
    c = curve(scored).select("score", "f1")
    below = F.lag("score").over(Window.orderBy("score"))
    best = c.withColumn("below", below).agg(F.max(F.struct("f1", (-F.col("score")).alias("at"), "below")).alias("b"))
    return best.crossJoin(scored.agg(F.percentile(F.round("score", DIGITS), 0.5).alias("median"))).select(F.coalesce("b.below", "median").alias("tau"))


def tau_precision_at(scored: DataFrame, target: float = 0.995) -> DataFrame:
    """The lowest threshold of at least the target precision, or else the highest one."""
    return curve(scored).agg(F.coalesce(F.min(F.when(F.col("precision") >= target, F.col("score"))), F.max("score")).alias("tau"))


def confusion(scored: DataFrame, tau: float) -> DataFrame:
    """Counts and rates at a threshold; a rate without a denominator is 0."""
    yes, y = F.round("score", DIGITS) >= tau, F.col("y") == 1
    c = scored.agg(F.count_if(yes & y).alias("tp"), F.count_if(yes & ~y).alias("fp"), F.count_if(~yes & y).alias("fn"), F.count_if(~yes & ~y).alias("tn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp", "fp", "fn", "tn", rate(tp + tn, tp + fp + fn + tn).alias("accuracy"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(tp, tp + fp).alias("ppv"), rate(tn, tn + fn).alias("npv")
    )


def threshold_sweep(scored: DataFrame, steps: int = 100) -> DataFrame:
    """(t, precision, recall, f1) for t = 0, 1 / steps, ..., 1; predictions are scores above t. Scores
    are counted by step first, so the sweep is over steps and not over pairs."""
    s = F.round("score", DIGITS)
    # The last step that the score is above: t < score.
    step = F.least(F.greatest(F.ceil(F.round(s * steps, 4)) - 1, F.lit(-1)), F.lit(steps)).cast("bigint")
    by = scored.groupBy(step.alias("i")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n"))
    grid = scored.sparkSession.range(-1, steps + 1).withColumnRenamed("id", "i").join(by, "i", "left").na.fill(0, ["p", "n"])
    down = _down("i")
    c = grid.select("i", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(_every()).alias("pos")).where("i >= 0")
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, pos = F.col("tp"), F.col("fp"), F.col("pos")
    return c.select((F.col("i") / steps).alias("t"), rate(tp, tp + fp).alias("precision"), rate(tp, pos).alias("recall"), rate(2 * tp, tp + fp + pos).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first best F1 of a sweep."""
    return sweep.agg(F.max_by(F.struct("t", "f1"), F.struct("f1", -F.col("t"))).alias("b")).select("b.t", "b.f1")


def labelled_pairs(triplets: DataFrame) -> DataFrame:
    """Distinct (a, b, y): anchor and positive, anchor and negative."""
    side = lambda c, y: triplets.select(F.col("anchor").alias("a"), F.col(c).alias("b"), F.lit(y).cast("bigint").alias("y"))
    return side("positive", 1).unionByName(side("negative", 0)).distinct()


def gallery(triplets: DataFrame) -> DataFrame:
    """Every distinct text of the triplets."""
    return triplets.select(F.explode(F.array("anchor", "positive", "negative")).alias("text")).distinct()


def roles(triplets: DataFrame) -> DataFrame:
    """(role, text), a row per text of each triplet."""
    return triplets.selectExpr("stack(3, 'anchor', anchor, 'positive', positive, 'negative', negative) as (role, text)")


def look_up(pairs: DataFrame, embeddings: DataFrame, **columns: str) -> DataFrame:
    """Pairs with the embedding of each named text column: look_up(pairs, e, a="va")."""
    for col, out in columns.items():
        pairs = pairs.join(embeddings.select(F.col("text").alias(col), F.col("embedding").alias(out)), col)
    return pairs


def score_pairs(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    return look_up(pairs, embeddings, a="va", b="vb").select("a", "b", "y", F.round(dot(F.col("va"), F.col("vb")), DIGITS).alias("score"))


def score_triplets(triplets: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Triplets with the similarities `pos` and `neg`."""
    joined = look_up(triplets, embeddings, anchor="va", positive="vp", negative="vn")
    sim = lambda x: F.round(dot(F.col("va"), F.col(x)), DIGITS)
    return joined.select(*triplets.columns, sim("vp").alias("pos"), sim("vn").alias("neg"))


def triplet_metrics(scored: DataFrame, margin: float = 0.3) -> DataFrame:
    """Accuracy, mean gap, violation rate and mean loss of scored(pos, neg); non-finite rows don't count."""
    pos, neg = F.col("pos"), F.col("neg")
    good = scored.where(is_finite(pos) & is_finite(neg))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return good.agg(
        F.count("*").alias("triplets"), share(pos > neg).alias("accuracy"), F.avg(pos - neg).alias("gap"),
        share(neg > pos - margin).alias("violations"), F.avg(triplet_loss(pos, neg, margin)).alias("loss"),
    )


def outcomes(scored: DataFrame, margin: float = 0.3) -> DataFrame:
    """(outcome, triplets, share) of correct and satisfied, correct but violated, and incorrect ones."""
    pos, neg = F.col("pos"), F.col("neg")
    label = F.when(pos <= neg, "Incorrect").when(neg > pos - margin, "Correct but Violated").otherwise("Correct & Satisfied")
    counted = scored.groupBy(label.alias("outcome")).agg(F.count("*").alias("triplets"))
    return counted.withColumn("share", F.col("triplets") / F.sum("triplets").over(_every()))


def recall_at_k(rows: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(k, recall, queries) of rows(id, v, groups): the share of rows with a neighbour among the k nearest
    others that shares any of their groups."""
    pool = rows.select("id", F.lit("").alias("grp"), "v")
    near = knn_join(pool, max(ks) + 5).select(F.col("qid").cast("bigint").alias("a"), F.col("id").alias("b"), "rank").where("a <> b")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("rank")))
    groups = lambda x: rows.select(F.col("id").alias(x), F.col("groups").alias(f"g{x}"))
    met = near.join(groups("a"), "a").join(groups("b"), "b")
    hit = met.groupBy("a").agg(F.min(F.when(F.arrays_overlap("ga", "gb"), F.col("rank"))).alias("first"))
    every = rows.select(F.col("id").alias("a")).join(hit, "a", "left")
    share = [F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(str(k)) for k in ks]
    wide = every.agg(F.count("*").alias("queries"), *share)
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("recall")) for k in ks))
    return wide.select("queries", F.inline(pairs)).select("k", "recall", "queries")


def describe(rows: DataFrame, value: str, by: str, clip: float) -> DataFrame:
    """Mean, population spread, interpolated 95th percentile and share above `clip` of the finite values,
    and how many are not finite."""
    v = F.col(value)
    fine = F.when(is_finite(v), v)
    return rows.groupBy(by).agg(
        F.avg(fine).alias("mean"), F.stddev_pop(fine).alias("std"), F.percentile(fine, 0.95).alias("p95"),
        F.avg(F.when(fine > clip, 1.0).when(fine.isNotNull(), 0.0)).alias("clip_rate"), F.count_if(v.isNotNull() & fine.isNull()).alias("non_finite"),
    )


def moving_average(rows: DataFrame, key: str, step: str, value: str, keep: float = 0.9) -> DataFrame:
    """The exponential moving average of each key's values in the order of their steps, from 0."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(step), F.desc(value))) - 1
    weight = F.lit(1 - keep) * F.pow(F.lit(keep), back)
    return rows.select(key, (F.col(value).cast("double") * weight).alias("x")).groupBy(key).agg(F.sum("x").alias("ema"))


def score_density(scored: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, y, pairs): the data of a histogram of scores from -1 to 1."""
    which = F.least(F.greatest(F.floor((F.col("score") + 1) / 2 * bins), F.lit(0)), F.lit(bins - 1))
    return scored.groupBy(which.cast("bigint").alias("bin"), "y").agg(F.count("*").alias("pairs"))
