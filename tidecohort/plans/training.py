"""Queries over training and test of models on a subject split."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidecohort.operators import cohort, features, ml, training
from tidecohort.operators.tables import shared_dir, stored
from tidecohort.plans.analytics import METRIC_NAMES, METRICS_SQL, r6
from tidecohort.plans.cleaning import FS
from tidecohort.plans.cohorts import RATIOS
from tidecohort.plans.features import windows
from tidecohort.plans.register import query
from tidecohort.sources.fixtures import ctes, psd, scores


def split(rows, seed: int = 42):
    """Rows (subject, y, ...) with the split of their subject; no subject is in two splits."""
    of = rows.groupBy("subject").agg((F.avg("y") >= 0.5).alias("epilepsy"))
    return rows.join(cohort.splits(of, RATIOS, seed), "subject")


def raw_rows(spark, d, seed: int = 42):
    """Windows of samples with their split; their features are a stage of the pipeline."""
    return split(windows(spark, d), seed)


def extractor():
    return ml.ConvolutionFeatures(length=16, channels=4, kernels=4, groups=4)


def spectral_rows(spark, d, seed: int = 42):
    return split(psd(spark, d).select(F.col("path").cast("long").alias("window_id"), "subject", F.col("cls").alias("y"), "p")).withColumnRenamed("p", "features")


def rounded(found):
    return found.select("split", "level", "n", "n_pos", *[r6(m).alias(m) for m in METRIC_NAMES])


@query("model_performance")
def model_performance(spark, d):
    """Metrics of windows and subjects by split: convolution features, scaler and logistic regression, ten strengths by five folds."""
    rows = raw_rows(spark, d)
    trainer = training.Trainer(stages=(extractor(),), grid=training.GRID, most_steps=20)
    return rounded(trainer.test(trainer.fit(rows), rows))


@query("calibrated_performance")
def calibrated_performance(spark, d):
    """L1 chosen by recall over folds of whole subjects, and a threshold from the validation subjects."""
    trainer = training.Trainer(l1=True, grid=training.GRID, fold_by="subject", scoring="recall", merge=False, calibrate=True, most_steps=20)
    return rounded(trainer.performance(stored(spectral_rows(spark, d))))


@query("ridge_performance")
def ridge_performance(spark, d):
    """Ridge on targets of -1 and 1, ten strengths by five folds, tested on subjects it has not seen."""
    rows = spectral_rows(spark, d)
    trainer = training.Trainer(kind="ridge", grid=training.GRID)
    return rounded(trainer.test(trainer.fit(rows), rows))


@query("saved_model_scores")
def saved_model_scores(spark, d):
    """Scores of a pipeline that was saved and loaded again, beside those of the one that was fitted; ``same`` says they agree."""
    rows = raw_rows(spark, d)
    trainer = training.Trainer(stages=(extractor(),), most_steps=20)
    fitted = trainer.fit(rows)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    fitted.save(path)
    again = trainer.scores(training.load(spark, path), rows).select("window_id", F.col("s").alias("loaded"))
    both = trainer.scores(fitted, rows).join(again, "window_id")
    return both.select("window_id", "subject", "split", F.round("s", 6).alias("s"), (F.abs(F.col("s") - F.col("loaded")) < 1e-9).alias("same"))


@query("kernel_report")
def kernel_report(spark, d):
    """Kernels by wins, by difference of the classes and by the weights of a model fitted on them, with their frequencies."""
    rows = raw_rows(spark, d)
    fitted = training.Trainer(stages=(extractor(),), most_steps=20).fit(rows)
    counts = features.win_counts(rows, extractor().bank())
    found = features.kernel_report(counts, training.coefficients(spark, fitted), extractor().bank(), FS, n=10)
    return found.withColumns({c: F.round(c, 6) for c in ("score", "peak_hz", "centroid_hz")})


@query("seed_sweep")
def seed_sweep(spark, d):
    """Test metrics for three seeds of the subject split, and fit."""
    trainer = training.Trainer(grid=(1.0,), most_steps=10)
    found = training.sweep(lambda seed: split(spectral_rows(spark, d).drop("split"), seed), training.seeds(3), trainer)
    return rounded(found.filter("split = 'test'").withColumn("split", F.concat_ws("-", "split", F.col("seed").cast("string"))))


SPLIT_SQL = """lab AS (SELECT subject, avg(y) >= 0.5 AS epilepsy FROM scores GROUP BY subject),
ranked_subjects AS (SELECT subject, row_number() OVER (PARTITION BY epilepsy ORDER BY md5('42|' || subject), subject) AS r, count(*) OVER (PARTITION BY epilepsy) AS n FROM lab),
cut AS (SELECT s.*, CASE WHEN r <= floor(0.6 * n) THEN 'train' WHEN r <= floor(0.6 * n) + floor(0.2 * n) THEN 'val' ELSE 'test' END AS split FROM scores s JOIN ranked_subjects USING (subject))"""
BY_SPLIT = {"by": "split,", "group": "GROUP BY split", "part": "PARTITION BY split", "part_s": "PARTITION BY split, s", "out": "split,", "join": "JOIN rk USING (split)"}


@query("window_scores_by_split", ctes("scores") + ",\n" + SPLIT_SQL + ",\n" + METRICS_SQL.format(of="cut", **BY_SPLIT))
def window_scores_by_split(spark, d):
    """Metrics of stored window scores for each split of subjects."""
    found = training.evaluate(split(scores(spark, d))).filter("level = 'window'")
    return found.select("split", "n", "n_pos", *[r6(m).alias(m) for m in METRIC_NAMES])


@query("subject_scores_by_split", ctes("scores") + ",\n" + SPLIT_SQL + ",\nmeans AS (SELECT split, subject, avg(s) AS s, min_by(y, window_id) AS y FROM cut GROUP BY split, subject),\n" + METRICS_SQL.format(of="means", **BY_SPLIT))
def subject_scores_by_split(spark, d):
    """The same for subjects, each with the mean score of its windows."""
    found = training.evaluate(split(scores(spark, d))).filter("level = 'subject'")
    return found.select("split", "n", "n_pos", *[r6(m).alias(m) for m in METRIC_NAMES])


@query("kernels_by_weight", ctes("psd") + """, v AS (SELECT cls, i - 1 AS k, p[i] AS v FROM psd, unnest(range(1, 65)) AS u(i)), w AS (SELECT k, abs(avg(v) FILTER (cls = 1) - avg(v) FILTER (cls = 0)) * stddev_samp(v) AS w FROM v GROUP BY k)
SELECT CAST(k // 32 AS INTEGER) AS dilation, CAST(k % 32 // 16 AS INTEGER) AS diff, CAST(k % 8 // 4 AS INTEGER) AS grp, CAST(k % 4 AS INTEGER) AS kernel, round(sum(w), 6) AS weight FROM w GROUP BY ALL""")
def kernels_by_weight(spark, d):
    """Kernels by the size of their two coefficients times the features' deviations; coefficients are class differences of means."""
    long = psd(spark, d).select("cls", F.posexplode("p").alias("k", "v"))
    mean = lambda c: F.avg(F.when(F.col("cls") == c, F.col("v")))
    coefficients = long.groupBy("k").agg((mean(1) - mean(0)).alias("coef"), F.stddev_samp("v").alias("std"))
    found = features.by_weight(coefficients, dilations=(0, 1), groups=2, kernels=4)
    return found.select(*features.SLOT, F.round("weight", 6).alias("weight"))
