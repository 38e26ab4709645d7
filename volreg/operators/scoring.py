"""Accuracy against known truth: confusion, kappa, matched footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cloud import stored


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of a yes/no classification, error rates in percent, precision, recall and kappa."""
    t, p = F.col(truth), F.col(predicted)
    c = rows.where(t.isNotNull() & p.isNotNull()).agg(*(F.count_if(x).alias(n) for n, x in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    share = lambda a, b: F.try_divide(a, b)
    return c.select("tp", "fp", "fn", "tn", (100 * share(fn, tp + fn)).alias("type_1_pct"), (100 * share(fp, fp + tn)).alias("type_2_pct"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share((tp + tn) / n - chance, 1 - chance).alias("kappa"))


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs ``(truth, predicted, iou)`` taken by falling iou, larger keys first among equals.

    In each round every pair that is the best of both its sides is taken, which is what
    taking them one by one gives; a round is a few aggregations, and rounds end when
    nothing is left.
    """
    left, taken = stored(pairs.select("truth", "predicted", "iou"), "pairs"), None
    while not left.isEmpty():
        rank = F.struct("iou", "truth", "predicted")
        a = left.groupBy("truth").agg(F.max(rank).alias("m")).select("m.*")
        b = left.groupBy("predicted").agg(F.max(rank).alias("m")).select("m.*")
        now = stored(a.join(b, ["truth", "predicted", "iou"]), "taken")
        taken = now if taken is None else taken.unionByName(now)
        left = stored(left.join(now.select("truth"), "truth", "left_anti").join(now.select("predicted"), "predicted", "left_anti"), "pairs")
    return pairs.select("truth", "predicted", "iou").limit(0) if taken is None else taken.select("truth", "predicted", "iou")


def extraction_scores(matched: DataFrame, n_truth: int | DataFrame, n_predicted: int | DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and mean and least iou; a match below the threshold is a miss and a false alarm."""
    good = matched.where(F.col("iou") >= threshold).agg(F.count("*").alias("hits"), F.avg("iou").alias("mean_iou"), F.min("iou").alias("min_iou"))
    sizes = [F.broadcast(x.agg(F.count("*").alias(n))) if isinstance(x, DataFrame) else x for x, n in ((n_truth, "n_truth"), (n_predicted, "n_predicted"))]
    for x, n in zip(sizes, ("n_truth", "n_predicted"), strict=True):
        good = good.crossJoin(x) if isinstance(x, DataFrame) else good.withColumn(n, F.lit(x))  # one row each
    p, r = F.try_divide(F.col("hits"), F.col("n_predicted")), F.try_divide(F.col("hits"), F.col("n_truth"))
    return good.select("hits", "n_truth", "n_predicted", p.alias("precision"), r.alias("recall"), F.try_divide(2 * F.col("hits"), F.col("n_predicted") + F.col("n_truth")).alias("f1"), "mean_iou", "min_iou")


def storey_comparison(estimated: DataFrame, known: DataFrame) -> DataFrame:
    """``(b, n_estimated, n_known, extra, mean_error_m, max_error_m)``: the i-th storey above ground of each side."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("b").orderBy("level"))
    a = estimated.where("level >= 0").withColumn("i", place).select("b", "i", F.col("z_max").alias("za"))
    b = known.where("level >= 0").withColumn("i", place).select("b", "i", F.col("z_max").alias("zb"))
    both = a.join(b, ["b", "i"], "full")
    e = F.abs(F.col("za") - F.col("zb"))
    return both.groupBy("b").agg(F.count("za").alias("n_estimated"), F.count("zb").alias("n_known"), (F.count("za") - F.count("zb")).alias("extra"), F.bround(F.avg(e), 3).alias("mean_error_m"), F.bround(F.max(e), 3).alias("max_error_m"))
