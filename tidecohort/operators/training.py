"""Training, validation and test over a split plan, and sweeps over seeds, as Spark ML pipelines.

Rows are windows (window_id, subject, split, y, and the input of the first stage). All stages see the training split, or
training and validation together (``merge``); the threshold is 0 or, with ``calibrate``, the one with the best balanced accuracy
over the subjects of the validation split. Everything but the fitted coefficients stays a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecohort.operators import metrics, ml
from tidecohort.operators.tables import stored

#: Ten strengths from 1e-3 to 1e3.
GRID = tuple(10.0 ** (-3 + 6 * k / 9) for k in range(10))
#: Numbers of a partition of a search (64 MB), its least partitions, and partitions that its fits hold at once.
VALUES, LEAST, HELD = 1 << 23, 2, 60


@dataclass(frozen=True)
class Fitted:
    """A pipeline of stages, scaler and classifier, with the threshold and the strength that belong to it."""

    pipeline: PipelineModel
    threshold: float
    strength: float
    by_strength: tuple[float, ...] = ()

    def save(self, path: str) -> None:
        """The pipeline as Spark ML saves it, and a row of options beside it; ``load`` reads both, in any session."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        row = [(self.threshold, self.strength, [float(v) for v in self.by_strength])]
        SparkSession.getActiveSession().createDataFrame(row, "threshold double, strength double, by_strength array<double>").write.mode("overwrite").parquet(f"{path}/options")


def coefficients(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """(k, coef, std): a coefficient for each feature, with the deviation that the scaler divides it by."""
    scaler, model = fitted.pipeline.stages[-2:]
    rows = [(k, float(c), float(s)) for k, (c, s) in enumerate(zip(model.coefficients.toArray(), scaler.std, strict=True))]
    return spark.createDataFrame(rows, "k int, coef double, std double")


def load(spark: SparkSession, path: str) -> Fitted:
    options = spark.read.parquet(f"{path}/options").first()
    return Fitted(ml.load_pipeline(spark, f"{path}/pipeline"), options["threshold"], options["strength"], tuple(options["by_strength"]))


@dataclass(frozen=True)
class Trainer:
    """Options of a fit. Folds of the search are cut by ``fold_by``: windows as they come, or whole subjects.

    ``stages`` come before the scaler, whose input is a column ``features``. Of several strengths the one with the best mean
    score over the folds is taken, the first of equals. The search counts classes once for all folds, fits strengths of all folds
    beside each other (``parallelism`` of them, fewer as partitions grow in number) and scores a fold by all its models in one pass.
    """

    kind: str = "logistic"
    l1: bool = False
    grid: tuple[float, ...] = (1.0,)
    folds: int = 5
    fold_by: str = "window_id"
    scoring: str = "balanced_accuracy"
    merge: bool = True
    calibrate: bool = False
    most_steps: int = 100
    stages: tuple = ()
    parallelism: int = 12

    def classifier(self):
        return ml.BalancedRidge() if self.kind == "ridge" else ml.BalancedLogistic(l1=self.l1, maxIter=self.most_steps)

    def search(self, rows: DataFrame):
        """(model, strength, mean scores by strength) from stored rows with a column ``scaled``."""
        fit = self.classifier()
        if len(self.grid) == 1:
            return fit.copy({fit.strength: self.grid[0]}).fit(rows), self.grid[0], ()
        dealt, folds = ml.dealt(rows, self.fold_by, self.folds)
        counts = {(r["fold"], int(r["y"])): r["count"] for r in dealt.groupBy("fold", "y").count().collect()}
        without = [{y: sum(n for (f, c), n in counts.items() if f != fold and c == y) for y in {c for f, c in counts if f != fold}} for fold in range(folds)]
        whole = {y: sum(n for (_, c), n in counts.items() if c == y) for _, y in counts}
        parts = max(LEAST, -(-sum(whole.values()) * rows.first()["scaled"].size // VALUES))
        models = [fit.copy({fit.strength: v}) for v in self.grid]
        judge = ml.BinaryScore(metricName=self.scoring)
        dealt = dealt.select("scaled", "y", "fold").coalesce(parts).persist()
        pool, carried = ThreadPool(max(2, min(self.parallelism, HELD // parts))), inheritable_thread_target(rows.sparkSession)
        try:
            dealt.count()
            fitted = pool.map(carried(lambda at: models[at[1]].fit_counted(dealt.filter(F.col("fold") != at[0]), without[at[0]])), np.ndindex(folds, len(models)), chunksize=1)
            by_fold = [fitted[f * len(models) : (f + 1) * len(models)] for f in range(folds)]
            found = pool.map(carried(lambda f: judge.each(ml.decisions(by_fold[f], dealt.filter(F.col("fold") == f)), len(models))), range(folds), chunksize=1)
            scores = tuple(np.mean(found, axis=0).tolist())
            best = scores.index(max(scores))
            return models[best].fit_counted(dealt, whole), self.grid[best], scores
        finally:
            pool.terminate()
            dealt.unpersist()

    def uncalibrated(self, rows: DataFrame) -> Fitted:
        """``fit`` with the threshold 0. Stored rows without stages before the scaler have their features stored already."""
        seen = rows.filter(F.col("split").isin("train", "val") if self.merge else F.col("split") == "train")
        before = Pipeline(stages=list(self.stages)).fit(seen)
        featured = before.transform(seen).select("window_id", "subject", "y", "features")
        if self.stages or not getattr(rows, "stored_at", None):
            featured = stored(featured)
        scaler = ml.SparseScaler().fit(featured)
        model, strength, scores = self.search(stored(scaler.transform(featured).select("window_id", "subject", "y", "scaled")))
        return Fitted(PipelineModel([*before.stages, scaler, model]), 0.0, strength, scores)

    def calibrated(self, fitted: Fitted, scores: DataFrame) -> Fitted:
        """``fitted`` with the threshold that the scores of validation windows give, if there is to be one."""
        if not self.calibrate:
            return fitted
        threshold = metrics.best_threshold(stored(metrics.subject_scores(scores))).first()["threshold"]
        return replace(fitted, threshold=float(threshold or 0.0))

    def fit(self, rows: DataFrame) -> Fitted:
        """The pipeline fitted on the training rows of a plan. Features and scaled features are computed and stored once."""
        fitted = self.uncalibrated(rows)
        return self.calibrated(fitted, self.scores(fitted, rows.filter("split = 'val'")))

    def performance(self, rows: DataFrame) -> DataFrame:
        """What ``test`` says of the pipeline that ``fit`` gives; the threshold is read off the scores that are tested."""
        fitted = self.uncalibrated(rows)
        scores = stored(self.scores(fitted, rows))
        return evaluate(scores, self.calibrated(fitted, scores.filter("split = 'val'")).threshold)

    def scores(self, fitted: Fitted, rows: DataFrame) -> DataFrame:
        """(window_id, subject, split, y, s) of windows under a fitted pipeline."""
        judged = fitted.pipeline.transform(rows)
        return judged.select("window_id", "subject", "split", "y", ml.decision(judged).alias("s"))

    def test(self, fitted: Fitted, rows: DataFrame) -> DataFrame:
        """The metrics by split and level (window, subject) of all rows; subjects have the mean score of their windows."""
        return evaluate(self.scores(fitted, rows), fitted.threshold)


def evaluate(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Metrics by split and level of scores (window_id, subject, split, y, s).

    Scores and means are stored before: counts and ranks must see the same values.
    """
    scores = stored(scores)
    means = scores.groupBy("split", "subject").agg(F.avg("s").alias("s"), F.min_by("y", "window_id").alias("y"))
    means = stored(means)
    row = lambda df, level: metrics.classification(df, ["split"], threshold).withColumn("level", F.lit(level))
    return row(scores, "window").unionByName(row(means, "subject"))


def sweep(featured, seeds: list[int], trainer: Trainer) -> DataFrame:
    """Metrics by seed: ``featured(seed)`` gives the rows of a plan for each; one fit a seed."""
    out = None
    for seed in seeds:
        rows = featured(seed)
        found = trainer.test(trainer.fit(rows), rows).withColumn("seed", F.lit(seed))
        out = found if out is None else out.unionByName(found)
    return out


def seeds(spec: int | list[int] | None) -> list[int]:
    """Seeds of a sweep: none, the first so many, or those listed."""
    return [] if spec is None else list(range(spec)) if isinstance(spec, int) else list(spec)
