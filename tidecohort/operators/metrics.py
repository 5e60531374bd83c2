"""Scores: subject means, classification metrics, threshold calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecohort.operators.ordered import running
from tidecohort.operators.tables import stored


def subject_scores(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(subject, s, y, n, predicted): mean score and first label of each subject; above the threshold is positive."""
    means = scores.groupBy("subject").agg(F.avg("s").alias("s"), F.min_by("y", "window_id").alias("y"), F.count("*").alias("n"))
    return means.withColumn("predicted", (F.col("s") > F.lit(float(threshold))).cast("int"))


def ranking_metrics(scores: DataFrame, by: list[str]) -> DataFrame:
    """ROC-AUC and average precision per group, from one row per distinct score; null where a class is missing.

    Scores are first summed up per distinct value; running counts over range partitions of these tell what lies below each.
    """
    distinct = stored(scores.groupBy(*by, "s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    tied = running(distinct, "s", {"__pos": "pos", "__neg": "neg"}, by)
    whole = distinct.groupBy(*by).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__q"))
    joined = tied.join(F.broadcast(whole)) if not by else tied.join(whole, by)
    below = joined.withColumns({"neg_below": F.col("__neg") - F.col("neg"), "pos_to": F.col("__p") - F.col("__pos") + F.col("pos"), "all_to": F.col("__p") - F.col("__pos") + F.col("pos") + F.col("__q") - F.col("__neg") + F.col("neg")})
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2))
    hits = F.sum(F.col("pos").cast("double") * F.col("pos_to") / F.col("all_to"))
    positive, negative = F.sum("pos"), F.sum("neg")
    both = (positive > 0) & (negative > 0)
    return below.groupBy(*by).agg(F.when(both, wins / (positive.cast("double") * negative)).alias("roc_auc"), F.when(both, hits / positive).alias("average_precision"))


def confusion(scores: DataFrame, by: list[str], threshold: float = 0.0) -> DataFrame:
    p, y = F.col("s") > F.lit(float(threshold)), F.col("y") == 1
    cells = {"tp": p & y, "fp": p & ~y, "fn": ~p & y, "tn": ~p & ~y}
    return scores.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])


def counted(scores: DataFrame, by: list[str], threshold: float = 0.0) -> DataFrame:
    """Metrics of the confusion counts per group; F1 and precision are 0 without predictions, MCC is null without both classes."""
    c = confusion(scores, by, threshold)
    tp, fp, fn, tn = (F.col(n).cast("double") for n in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    positive, negative = tp + fn, tn + fp
    sensitivity, specificity = share(tp, positive), share(tn, negative)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    both = (positive > 0) & (negative > 0)
    balanced = F.when(both, (sensitivity + specificity) / 2).otherwise(F.when(positive > 0, sensitivity).otherwise(specificity))
    return c.select(
        *by, (positive + negative).cast("long").alias("n"), positive.cast("long").alias("n_pos"), negative.cast("long").alias("n_neg"), share(tp + tn, positive + negative).alias("accuracy"), balanced.alias("balanced_accuracy"),
        sensitivity.alias("sensitivity"), specificity.alias("specificity"), share(tp, tp + fp).alias("precision"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), F.when(both, F.when(root > 0, (tp * tn - fp * fn) / root).otherwise(F.lit(0.0))).alias("mcc"),
    )


def classification(scores: DataFrame, by: list[str], threshold: float = 0.0) -> DataFrame:
    """The nine metrics per group: those of ``counted``, and the ranking metrics, null without both classes."""
    if not by:
        return counted(scores, by, threshold).crossJoin(F.broadcast(ranking_metrics(scores, by)))
    return counted(scores, by, threshold).join(ranking_metrics(scores, by), by)


def best_threshold(scores: DataFrame) -> DataFrame:
    """(threshold, balanced_accuracy): the lowest of the candidate cuts with the best balanced accuracy.

    Candidates are midpoints of distinct scores and one cut beyond either end. Counts at every cut are running sums over
    distinct scores. With one class the threshold is 0.
    """
    tied = stored(scores.groupBy("s").agg(F.sum("y").alias("pos"), F.count("*").alias("n")))
    stepped = running(tied, "s", {"__pos": "pos", "__all": "n"}, previous="lower")
    cuts = stepped.select(F.when(F.col("lower").isNull(), F.col("s") - F.lit(1e-6)).otherwise((F.col("lower") + F.col("s")) / 2).alias("threshold"), (F.col("__pos") - F.col("pos")).alias("pos_below"), (F.col("__all") - F.col("n")).alias("below"))
    total = tied.agg(F.sum("pos").alias("p"), F.sum("n").alias("k"), F.max("s").alias("top"))
    last = total.select((F.col("top") + F.lit(1e-6)).alias("threshold"), F.col("p").alias("pos_below"), F.col("k").alias("below"))
    every = cuts.union(last).join(F.broadcast(total))
    sensitivity = (F.col("p") - F.col("pos_below")).cast("double") / F.nullif(F.col("p"), F.lit(0))
    specificity = (F.col("below") - F.col("pos_below")).cast("double") / F.nullif(F.col("k") - F.col("p"), F.lit(0))
    scored = every.select("threshold", "p", "k", ((sensitivity + specificity) / 2).alias("b"))
    best = F.max_by(F.struct("threshold", "b"), F.struct("b", -F.col("threshold")))
    one = (F.max("p") == 0) | (F.max("p") == F.max("k"))
    return scored.agg(F.when(one, F.lit(0.0)).otherwise(best["threshold"]).alias("threshold"), F.when(~one, best["b"]).alias("balanced_accuracy"))
