"""Evaluation of binary classifiers, set-based and for every model at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threshold_metrics(holdout: DataFrame, p: str, threshold: float) -> DataFrame:
    """Precision, recall and F1 by model; 0 where a denominator is 0."""
    hit, yes = (F.col(p) >= threshold).cast("int"), F.col("outcome")
    tp, said, real = F.sum(hit * yes), F.sum(hit), F.sum(yes)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = holdout.groupBy("model_id").agg(ratio(tp, said).alias("precision"), ratio(tp, real).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return m.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def losses(holdout: DataFrame, p: str, least: float = 1e-18) -> DataFrame:
    """Brier score and log loss; p and 1 - p are clamped one by one, as ln(0) would be dropped."""
    q = F.col(p)
    said = F.when(F.col("outcome") == 1, F.greatest(q, F.lit(least))).otherwise(F.greatest(1 - q, F.lit(least)))
    return holdout.groupBy("model_id").agg(F.avg(F.pow(q - F.col("outcome"), 2)).alias("brier"), F.avg(-F.log(said)).alias("log_loss"), F.count(F.lit(1)).alias("n"))


def _by_score(holdout: DataFrame, p: str) -> DataFrame:
    return holdout.groupBy("model_id", F.col(p).alias("score")).agg(F.sum("outcome").alias("pos"), F.sum(1 - F.col("outcome")).alias("neg"))


def roc_auc(holdout: DataFrame, p: str) -> DataFrame:
    """Area under ROC, ties one half, from counts by distinct score."""
    below = Window.partitionBy("model_id").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    wins = _by_score(holdout, p).withColumn("won", F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return wins.groupBy("model_id").agg(F.when(pairs > 0, F.sum("won") / pairs).alias("roc_auc"))


def pr_auc(holdout: DataFrame, p: str) -> DataFrame:
    """Stepwise area under precision and recall over distinct scores."""
    down = Window.partitionBy("model_id").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = _by_score(holdout, p).withColumn("tp", F.sum("pos").over(down)).withColumn("said", F.sum(F.col("pos") + F.col("neg")).over(down))
    return run.groupBy("model_id").agg(F.when(F.sum("pos") > 0, F.sum(F.col("pos") * F.col("tp") / F.col("said")) / F.sum("pos")).alias("pr_auc"))


def calibration(holdout: DataFrame, p: str, bins: int) -> DataFrame:
    """Equal-width bins, the last one closed, empty ones kept: ``model_id, bin, n, mean_p, rate``."""
    each = holdout.withColumn("bin", F.least(F.floor(F.col(p) * bins).cast("int"), F.lit(bins - 1)))
    found = each.groupBy("model_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg("outcome").alias("rate"))
    every = holdout.select("model_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found, ["model_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.groupBy("model_id").agg((F.sum(F.coalesce(F.col("n") * F.abs(F.col("mean_p") - F.col("rate")), F.lit(0.0))) / F.sum("n")).alias("ece"))


def information_coefficient(holdout: DataFrame, p: str) -> DataFrame:
    flat = (F.max(p) == F.min(p)) | (F.max("outcome") == F.min("outcome"))
    return holdout.groupBy("model_id").agg(F.when(flat, 0.0).otherwise(F.covar_pop(F.col(p), F.col("outcome")) / (F.stddev_pop(p) * F.stddev_pop("outcome"))).alias("ic"))


def half_stability(holdout: DataFrame, p: str) -> DataFrame:
    """Difference of the Brier scores of the first floor(n/2) observations and the rest."""
    w = Window.partitionBy("model_id")
    half = holdout.withColumn("first", F.row_number().over(w.orderBy("observation_id")) <= F.floor(F.count(F.lit(1)).over(w) / 2))
    loss = F.pow(F.col(p) - F.col("outcome"), 2)
    return half.groupBy("model_id").agg(F.abs(F.avg(F.when(F.col("first"), loss)) - F.avg(F.when(~F.col("first"), loss))).alias("instability"))
