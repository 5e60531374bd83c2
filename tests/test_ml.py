"""ML pipeline parts, metrics over computed means, keyed state, replayed orders, synthetic windows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from tidecohort.operators import cohort, features, metrics, ml, replayed, training
from tidecohort.plans import registry
from tidecohort.sources import synthetic
from tidecohort.streaming import windows as streams

DATA = "/root/testdata/sf0.001"
RATIOS = {"train": 0.6, "val": 0.2, "test": 0.2}


def planned(windows):
    of = windows.groupBy("subject").agg((F.avg("y") > 0.5).alias("epilepsy"))
    return windows.join(cohort.splits(of, RATIOS), "subject")


@pytest.fixture(scope="module")
def rows(spark):
    return planned(synthetic.labelled_windows(spark, 240)).cache()


def test_synthetic_windows_do_not_depend_on_partitions(spark):
    pick = lambda df: {r.window_id: (r.subject, r.y, np.round(r.x[0][:3], 12).tolist()) for r in df.collect()}
    one = pick(synthetic.labelled_windows(spark, 20))
    assert one == pick(synthetic.labelled_windows(spark, 40).filter("window_id < 20").repartition(7))
    assert {v[1] for v in one.values()} == {0, 1} and len({v[0] for v in one.values()}) == 4


def test_pipeline_learns_is_saved_and_loaded_by_another_session(spark, rows, tmp_path):
    extract = ml.ConvolutionFeatures(length=256, channels=4, kernels=4, groups=8)
    trainer = training.Trainer(stages=(extract,), grid=(0.01, 1.0, 100.0), folds=5, fold_by="subject", most_steps=30)
    fitted = trainer.fit(rows)
    found = {(r.split, r.level): r for r in trainer.test(fitted, rows).collect()}
    assert found["test", "window"].accuracy >= 0.85 and found["test", "subject"].balanced_accuracy >= 0.9
    assert len(fitted.by_strength) == 3 and fitted.strength in trainer.grid
    fitted.save(str(tmp_path / "run"))
    other = spark.newSession()
    again = training.load(other, str(tmp_path / "run"))
    assert [type(s).__name__ for s in again.pipeline.stages] == ["ConvolutionFeatures", "SparseScalerModel", "LogisticRegressionModel"]
    scores = lambda f: {r.window_id: r.s for r in trainer.scores(f, rows).collect()}
    assert scores(again) == scores(fitted) and again.strength == fitted.strength


def test_scaler_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.where(rng.random((50, 6)) < 0.4, 0, rng.normal(2, 2, (50, 6)))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id int, features array<double>").repartition(3)
    model = ml.SparseScaler(exponent=3.0).fit(frame.filter("id < 99"))
    root = np.sqrt(np.maximum(x, 0))
    std = root.std(0, ddof=1) + (root == 0).mean(0) ** 3 + 1e-8
    assert np.allclose(model.mean, root.mean(0)) and np.allclose(model.std, std)
    out = {r.id: r.scaled for r in model.transform(frame).collect()}
    assert np.allclose([out[i].toArray() for i in range(50)], np.where(root != 0, (root - root.mean(0)) / std, 0)) and out[99] is None
    plain = model.copy({model.mask: False}).transform(frame.filter("id = 0")).first().scaled
    assert np.allclose(plain.toArray(), ((root - root.mean(0)) / std)[0])
    with pytest.raises(Exception, match="for a scaler of 6"):
        model.transform(spark.createDataFrame([([1.0],)], "features array<double>")).collect()


def test_features_of_a_stack_equal_those_of_each_window(spark):
    rng, bank = np.random.default_rng(1), features.Bank(40, 3, kernels=4, groups=4)
    x = rng.standard_normal((9, 3, 40))
    each = np.stack([bank.features(w, float) for w in x])
    assert np.allclose(bank.features(x, float), each)
    frame = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(x)] + [(9, None), (10, rng.standard_normal((3, 25)).tolist())], "window_id long, x array<array<double>>")
    out = {r.window_id: r.features for r in features.transform(frame, bank, exact=True).collect()}
    assert np.allclose([out[i] for i in range(9)], each) and out[9] is None and len(out[10]) == bank.width
    with pytest.raises(Exception, match="40 are asked for"):
        ml.ConvolutionFeatures(length=40, channels=3).transform(frame).collect()


def test_evaluator_and_folds(spark):
    frame = spark.createDataFrame([(i, i % 2, float(i % 2) - 0.5 if i % 5 else -0.25) for i in range(40)], "window_id long, y int, prediction double")
    y, s = np.arange(40) % 2, np.where(np.arange(40) % 5, np.arange(40) % 2 - 0.5, -0.25)
    recall = ((s > 0) & (y == 1)).sum() / (y == 1).sum()
    assert ml.BinaryScore(metricName="recall").evaluate(frame) == pytest.approx(recall)
    assert ml.BinaryScore().evaluate(frame) == pytest.approx((recall + 1) / 2) and ml.BinaryScore().isLargerBetter()
    assert ml.BinaryScore(metricName="roc_auc").evaluate(frame.filter("y = 1")) == -1
    dealt, n = ml.dealt(frame.withColumn("subject", F.col("window_id") % 11), "subject", 5)
    assert {r.fold for r in dealt.collect()} == set(range(n)) and n > 2
    assert dealt.groupBy("subject").agg(F.countDistinct("fold").alias("k")).agg(F.max("k")).first()[0] == 1
    with pytest.raises(ValueError, match="two folds"):
        ml.dealt(frame.limit(1), "y", 5)


def test_cross_validation_takes_the_best_strength(spark, rows):
    featured = ml.ConvolutionFeatures(length=256, channels=4, kernels=4, groups=4).transform(rows.filter("split = 'train'"))
    dealt, n = ml.dealt(featured, "window_id", 3)
    ridge = ml.BalancedRidge()
    grid = ParamGridBuilder().addGrid(ridge.strength, [1e-3, 1.0, 1e6]).build()
    pipeline = Pipeline(stages=[ml.SparseScaler(), ridge])
    found = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=ml.BinaryScore(), numFolds=n, foldCol="fold").fit(dealt.cache())
    assert len(found.avgMetrics) == 3 and max(found.avgMetrics) > 0.8


@pytest.mark.parametrize(("kind", "scoring"), [("ridge", "balanced_accuracy"), ("logistic", "recall")])
def test_search_equals_cross_validation_with_fewer_jobs(spark, kind, scoring):
    """The same scores by strength as Spark's cross-validator; classes are not counted, nor rows judged, once for each fit."""
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, int(v[0] + rng.normal() > 0), Vectors.dense(v)) for i, v in enumerate(rng.normal(size=(150, 3)))], ["window_id", "y", "scaled"])
    trainer = training.Trainer(kind=kind, scoring=scoring, grid=(1e-2, 1.0, 1e3), folds=2, most_steps=5)
    dealt, n = ml.dealt(frame, "window_id", 2)
    fit = trainer.classifier()
    grid = ParamGridBuilder().addGrid(fit.strength, list(trainer.grid)).build()
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup(f"whole {kind} {scoring}", "")
    whole = CrossValidator(estimator=fit, estimatorParamMaps=grid, evaluator=ml.BinaryScore(metricName=scoring), numFolds=n, foldCol="fold").fit(dealt)
    spark.sparkContext.setJobGroup(f"search {kind} {scoring}", "")
    model, strength, scores = trainer.search(frame)
    spark.sparkContext.setJobGroup("others", "")
    assert np.allclose(scores, whole.avgMetrics, atol=1e-12) and strength == trainer.grid[int(np.argmax(whole.avgMetrics))]
    assert np.allclose(model.coefficients.toArray(), whole.bestModel.coefficients.toArray(), atol=1e-9)
    fits = len(trainer.grid) * n
    assert 0 < jobs(f"search {kind} {scoring}") < jobs(f"whole {kind} {scoring}") - 2 * fits


def test_search_cuts_its_rows_by_size(spark):
    """A table below 64 MB is two partitions to each of the fits, however many it came in."""
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, int(v[0] + rng.normal() > 0), Vectors.dense(v)) for i, v in enumerate(rng.normal(size=(160, 3)))], ["window_id", "y", "scaled"]).repartition(8)
    spark.sparkContext.setJobGroup("cut", "")
    training.Trainer(grid=(1e-2, 1.0), folds=2, most_steps=3).search(training.stored(frame))
    spark.sparkContext.setJobGroup("others", "")
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("cut") for s in tracker.getJobInfo(j).stageIds]
    tasks = [s.numTasks for s in stages if s]
    assert len(tasks) > 10 and sum(n > 2 for n in tasks) < len(tasks) / 4


def test_performance_scores_windows_once(spark, monkeypatch):
    """The metrics of the fitted and calibrated pipeline, with one pass over the windows for threshold and metrics."""
    rng = np.random.default_rng(6)
    y = [i % 20 % 2 for i in range(400)]
    raw = spark.createDataFrame([(i, f"u{i % 20:02d}", y[i], (rng.random(4) + 0.4 * y[i]).tolist()) for i in range(400)], "window_id long, subject string, y int, features array<double>")
    rows = training.stored(planned(raw))
    trainer = training.Trainer(l1=True, grid=(1e-2, 1.0), fold_by="subject", folds=3, scoring="recall", merge=False, calibrate=True, most_steps=10)
    calls, scores = [], training.Trainer.scores
    monkeypatch.setattr(training.Trainer, "scores", lambda self, *args: calls.append(1) or scores(self, *args))
    values = lambda df: {(r.split, r.level): [None if v is None else round(v, 9) for v in r[1:-1]] for r in df.collect()}
    found = values(trainer.performance(rows))
    assert len(calls) == 1
    fitted = trainer.fit(rows)
    assert fitted.threshold != 0 and found == values(trainer.test(fitted, rows)) and len(found) == 6


def test_metrics_of_computed_means_do_not_depend_on_partitions(spark):
    """Means of doubles differ in their last bit with the order of rows; ranks must come from stored ones."""
    rng = np.random.default_rng(7)
    scores = spark.createDataFrame([(i, f"u{i % 300}", int(i % 300 % 2), float(v)) for i, v in enumerate(rng.normal(size=6000))], "window_id long, subject string, y int, s double")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "3", "7") * 2:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        means = metrics.subject_scores(scores.repartition(int(n)))
        row = metrics.classification(means, []).first()
        found.append([round(row[m], 9) for m in ("roc_auc", "average_precision", "mcc")] + [round(metrics.best_threshold(means).first().balanced_accuracy, 9)])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(f == found[0] for f in found)
    pandas = scores.toPandas().groupby("subject").agg(s=("s", "mean"), y=("y", "first"))
    up, down = pandas.s[pandas.y == 1].to_numpy(), pandas.s[pandas.y == 0].to_numpy()
    assert found[0][0] == pytest.approx((up[:, None] > down).mean(), abs=1e-9)


@pytest.mark.parametrize(("name", "counts"), [("subject_scores_by_split", ("1", "3", "7")), ("ridge_performance", ("1", "7"))])
def test_model_queries_run_alike_at_any_partitioning(spark, name, counts):
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in counts:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(registry.QUERIES[name](spark, DATA).toPandas().sort_values("split").select_dtypes("number").round(3).to_numpy())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(np.allclose(f, found[0], equal_nan=True) for f in found) and len(found[0])


def test_replayed_order_equals_the_generator(spark):
    """The same plan by one numpy generator over lists, as the analysed pipeline draws it."""
    rng = np.random.default_rng(3)
    recs = [(f"u{k // 3:02d}", f"/p{k:03d}", bool(k // 3 % 3 == 0), float(rng.integers(30, 400))) for k in rng.permutation(60)]
    frame = spark.createDataFrame(recs, "subject string, path string, epilepsy boolean, duration double")
    length, stride, cap = 60.0, 30.0, 5
    state, plan, labels = np.random.RandomState(42), [], {}
    for subject in sorted({r[0] for r in recs}):
        own = sorted((r for r in recs if r[0] == subject), key=lambda r: r[1])
        windows = [(r[1], i, r[2]) for r in own for i in range(max(0, int((r[3] - length) // stride) + 1))]
        if not windows:
            continue
        labels.setdefault(str(windows[0][2]).lower(), []).append(subject)
        state.shuffle(windows)
        plan += [(subject, path, i, k) for k, (path, i, _) in enumerate(windows[:cap])]
    split = {}
    for names in labels.values():
        names = list(names)
        state.shuffle(names)
        a, b = int(0.6 * len(names)), int(0.6 * len(names)) + int(0.2 * len(names))
        split |= {s: "train" if i < a else "val" if i < b else "test" for i, s in enumerate(names)}
    found = replayed.plan(frame.repartition(5), length, stride, RATIOS, cap).collect()
    assert sorted((r.subject, r.path, r.idx, r.position, r.split) for r in found) == sorted((*p, split[p[0]]) for p in plan)
    assert all(r.end - r.start == length for r in found)
    balanced = replayed.plan(frame, length, stride, RATIOS, balance=True, stratified=False).groupBy("subject").count()
    assert balanced.agg(F.countDistinct("count")).first()[0] == 1
    with pytest.raises(ValueError):
        replayed.plan(frame, length, stride, RATIOS, cap=0)


def test_keyed_state_survives_a_restart(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "user_id long, value double, event_type string"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    last = lambda: {r.user_id: (r.n, r.most, r.kinds) for r in streams.last_state(streams.counters(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)), str(tmp_path / "out")).collect()}
    add([(1, 5.0, "a"), (2, None, "b"), (1, 2.0, "b")])
    assert last() == {1: (2, 5.0, {"a": 1, "b": 1}), 2: (1, None, {"b": 1})}
    add([(1, 9.0, "a"), (3, 1.0, "c")])
    assert last() == {1: (3, 9.0, {"a": 2, "b": 1}), 2: (1, None, {"b": 1}), 3: (1, 1.0, {"c": 1})}


def test_pooled_bags_equal_numpy(spark):
    rng, bank = np.random.default_rng(5), features.Bank(32, 1, kernels=2, groups=2)
    parts = [(b, i, (rng.standard_normal(32) if (b, i) != (0, 1) and b != 2 else np.zeros(32)).tolist()) for b in range(3) for i in range(4)]
    rows = features.bag_features(spark.createDataFrame(parts, "window_id long, ic int, x array<double>"), bank).toPandas()
    assert len(rows) == 3 * bank.width and rows[rows.window_id == 2][["mean", "most", "std", "n"]].eq(0).all(axis=None)
    own = np.stack([bank.features(np.array([x]), float) for b, i, x in parts if b == 0 and i != 1])
    got = rows[rows.window_id == 0].sort_values("k")
    for name, want in (("mean", own.mean(0)), ("most", own.max(0)), ("std", own.std(0))):
        assert np.allclose(got[name], want)
    assert isinstance(rows, pd.DataFrame) and set(got.n) == {3}
