"""Files of a corpus: EDF, listings, sidecars, the recordings builder, windows from files, runs, sinks and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecohort.functions import scalars
from tidecohort.operators import cohort, runs, training
from tidecohort.sources import builder, corpus, edf, sinks
from tidecohort.streaming import windows as streams

FS = 32


def wave(seconds, f, seed):
    t = np.arange(seconds * FS) / FS
    return 50 * np.sin(2 * np.pi * f * t) + np.random.default_rng(seed).normal(0, 1, len(t))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Three subjects with one recording each, of which one has a seizure and one a sidecar."""
    top = tmp_path_factory.mktemp("corpus")
    for k, (folder, subject) in enumerate([("00_epilepsy", "aaaaaaab"), ("00_epilepsy", "aaaaaaac"), ("01_no_epilepsy", "aaaaaaad")]):
        place = top / folder / subject / f"s00{k + 1}_201{k}" / "01_tcp_ar"
        place.mkdir(parents=True)
        stem = f"{subject}_s00{k + 1}_t000"
        data = {"EEG FP1-REF": wave(20 + k, 3, k), "EEG F7-REF": wave(20 + k, 5, k + 9)}
        (place / f"{stem}.edf").write_bytes(edf.edf_bytes(data, FS, patient=f"{subject} F 01-JAN-1980 {subject} Age:{30 + k}"))
        rows = ["# version = csv_v1.0.0", f"# duration = {20 + k}.0000 secs", "channel,start_time,stop_time,label,confidence", f"TERM,0.0,4.0,{'seiz' if k == 0 else 'bckg'},1.0"]
        (place / f"{stem}.csv_bi").write_text("\n".join(rows))
        if k == 1:
            (place / f"{stem}-bads.json").write_text(json.dumps({"bads": ["F7"], "too_many": False, "segments": [{"start": 2.0, "stop": 3.5}], "periodic": {"f0": 1.5, "strength": 0.7, "flagged": True}}))
    (top / ".hidden").mkdir()
    (top / ".hidden" / "x.edf").write_bytes(b"")
    return str(top)


def test_edf_samples_come_back(spark, root):
    rows = {(r.path.rsplit("/", 1)[1], r.channel): r for r in edf.read_edf(spark, root).collect()}
    assert len(rows) == 6
    for k, subject in enumerate(("aaaaaaab", "aaaaaaac", "aaaaaaad")):
        own = rows[f"{subject}_s00{k + 1}_t000.edf", "EEG F7-REF"]
        assert own.sfreq == FS and np.allclose(own.x, wave(20 + k, 5, k + 9), atol=0.06)
    edf.register(spark)
    parts = spark.read.format("edf").option("channels", "EEG F7-REF").option("partition_bytes", str(4 * FS * 4)).load(root)
    joined = {}
    for r in sorted(parts.collect(), key=lambda r: r.start_s):
        joined.setdefault(r.path, []).extend(r.x)
    assert {len(x) for x in joined.values()} == {20 * FS, 21 * FS, 22 * FS} and parts.count() > 9


def test_headers_and_recordings(spark, root):
    heads = {r.path.rsplit("/", 1)[1][:8]: r for r in edf.read_headers(spark, root).collect()}
    assert [(heads[s].age, heads[s].gender, heads[s].sfreq, heads[s].duration) for s in sorted(heads)] == [(30, "F", FS, 20.0), (31, "F", FS, 21.0), (32, "F", FS, 22.0)]
    rows = {r.subject: r for r in builder.recordings(spark, root).collect()}
    assert [(rows[s].n_seizure, rows[s].epilepsy, rows[s].year, rows[s].t_id, rows[s].montage) for s in sorted(rows)] == [(1, True, "2010", "t000", "01_tcp_ar"), (0, True, "2011", "t000", "01_tcp_ar"), (0, False, "2012", "t000", "01_tcp_ar")]
    assert {r.subject for r in builder.Corpus(spark, root, only_seizure_free=True).recordings().collect()} == {"aaaaaaac", "aaaaaaad"}
    assert builder.Corpus(spark, root, most_recordings=1).recordings().first().subject == "aaaaaaab"
    whole = builder.Corpus(spark, root).whole_signals(["EEG FP1-REF"]).collect()
    assert sorted(len(r.x) for r in whole) == [20 * FS, 21 * FS, 22 * FS] and str(min(r.measured for r in whole)) == "2010-01-01"


def test_listing_is_cached_as_text(spark, root, tmp_path):
    cache = str(tmp_path / "tree")
    first = sorted(tuple(r) for r in builder.cached_listing(spark, root, cache).collect())
    again = sorted(tuple(r) for r in builder.cached_listing(spark, "/nowhere", cache).collect())
    assert first == again and len(first) == 3 and first[0][1:4] == ("aaaaaaab", "s001", "2010")
    assert corpus.durations(spark, root).agg(F.sum("duration")).first()[0] == 63


def test_sidecars_fill_what_is_missing(spark, root):
    rows = builder.sidecars(spark, root).collect()
    assert len(rows) == 1 and rows[0].bads == ["F7"] and rows[0].segments[0].stop == 3.5 and rows[0].seizures == [] and rows[0].periodic.flagged


def test_windows_are_cut_from_files(spark, root):
    rec = builder.Corpus(spark, root).recordings()
    plan = cohort.windows(rec, 4.0, 3.0, 2).select("path", "subject", "idx", "start", "end", "sfreq")
    rows = builder.Corpus(spark, root).windows(plan).collect()
    assert len(rows) == 6
    for r in rows:
        k = ("aaaaaaab", "aaaaaaac", "aaaaaaad").index(r.subject)
        at = int(r.start * FS)
        assert r.names == ["EEG F7-REF", "EEG FP1-REF"] and np.allclose(r.x[0], wave(20 + k, 5, k + 9)[at : at + 4 * FS], atol=0.06)


def test_runs_are_scanned_with_their_configuration(spark, tmp_path):
    for seed, run in enumerate(("lr/0", "lr/1", "bare")):
        place = tmp_path / "logs" / run
        place.mkdir(parents=True)
        (place / "performance.csv").write_text(f"split,level,roc_auc\ntest,subject,0.{seed + 6}\n")
        if run != "bare":
            (place / "overrides.yaml").write_text(f"- data.seed={seed}\n- feature=x\n# note\n")
            (place / "config.yaml").write_text("model:\n  _target_: a.b.LogisticModel\nfeature:\n  _target_: c.Bank\n")
    root = str(tmp_path / "logs")
    rows = {r.run: r for r in runs.with_configuration(runs.scan(spark, [root]), runs.configurations(spark, root)).collect()}
    assert rows.keys() == {"lr/0", "lr/1", "bare"} and rows["lr/1"].seed == 1 and rows["lr/1"].model == "LogisticModel" and rows["lr/1"].feature == "Bank"
    assert rows["lr/0"].overrides == "data.seed=0; feature=x" and rows["bare"].model is None and rows["bare"].roc_auc == "0.8"
    assert runs.top_spec(["250:30", "256:0"]) == [(250.0, 30), (256.0, 0)]
    with pytest.raises(ValueError):
        runs.top_spec(["250:-1"])


def test_sinks_write_once(spark, tmp_path):
    base = str(tmp_path)
    psd = spark.createDataFrame([("a", "psd", [1.0]), ("b", "psd", [2.0])], "path string, variant string, p array<double>")
    assert sinks.spectra(psd, f"{base}/psd").count() == 2
    more = psd.union(spark.createDataFrame([("a", "psd-interp", [3.0])], psd.schema))
    sinks.spectra(more, f"{base}/psd")
    assert spark.read.parquet(f"{base}/psd").count() == 3
    bads = spark.createDataFrame([("a", ["x"]), ("b", [])], "path string, bads array<string>")
    sinks.bads(bads.limit(1), f"{base}/bads")
    sinks.bads(bads, f"{base}/bads")
    assert spark.read.json(f"{base}/bads").count() == 2
    windows = spark.createDataFrame([("a", 0.0, 2.0, "train"), ("b", 1.0, 3.0, "test")], "path string, start double, end double, split string")
    sinks.window_manifests(windows, f"{base}/manifests")
    read = spark.read.option("header", True).csv(f"{base}/manifests")
    replayed = cohort.replay(spark.createDataFrame([("a", 9.0), ("b", 9.0)], "path string, duration double"), read)
    assert {(r.path, r.split, r.end) for r in replayed.collect()} == {("a", "train", 2.0), ("b", "test", 3.0)}
    sinks.exclusions(windows.select("path"), f"{base}/excluded", ["top 2 at 250 Hz"])
    assert [r.value for r in corpus.exclusions(spark, f"{base}/excluded").collect()] == ["# top 2 at 250 Hz", "a", "b"]
    assert cohort.without_excluded(windows, corpus.exclusions(spark, f"{base}/excluded")).count() == 0
    summary = sinks.seed_sweep(spark.createDataFrame([(0, 0.5), (1, 0.7)], "seed int, roc_auc double"), f"{base}/sweep").first()
    assert summary.mean == pytest.approx(0.6) and summary.std == pytest.approx(0.1414, abs=1e-3)
    sinks.kernels(spark.createDataFrame([(1, [float(j) for j in range(9)])], "rank int, weights array<double>"), f"{base}/kernels")
    assert spark.read.option("header", True).csv(f"{base}/kernels").columns == ["rank", *[f"w{j}" for j in range(9)]]


def test_trainer_saves_and_keeps_subjects_apart(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, f"u{i // 6}", int(i // 6 % 2), [float(v) for v in np.abs(rng.normal(2 + 2 * (i // 6 % 2), 0.5, 3))]) for i in range(240)]
    frame = spark.createDataFrame(rows, "window_id long, subject string, y int, features array<double>")
    of = frame.groupBy("subject").agg((F.avg("y") > 0.5).alias("epilepsy"))
    plan = frame.join(cohort.splits(of, {"train": 0.6, "val": 0.2, "test": 0.2}), "subject")
    assert plan.groupBy("subject").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    trainer = training.Trainer(grid=(0.1, 10.0), folds=2, fold_by="subject", merge=False, calibrate=True, most_steps=20)
    fitted = trainer.fit(plan)
    found = {(r.split, r.level): r for r in trainer.test(fitted, plan).collect()}
    assert found["test", "subject"].balanced_accuracy > 0.9 and found["test", "window"].roc_auc > 0.9
    fitted.save(str(tmp_path / "model"))
    again = training.load(spark, str(tmp_path / "model"))
    scores = lambda f: [round(r.s, 9) for r in trainer.scores(f, plan).orderBy("window_id").collect()]
    assert scores(again) == scores(fitted) and again.threshold == fitted.threshold
    assert training.seeds(None) == [] and training.seeds(2) == [0, 1] and training.seeds([7]) == [7]


def test_streams_keep_running_counters(spark, tmp_path):
    source, out = tmp_path / "in", []
    rows = spark.createDataFrame([(1, 5.0), (2, 1.0), (1, 9.0)], "user_id long, value double")
    rows.write.parquet(str(source))
    spark.createDataFrame([(1, 2.0), (2, None)], rows.schema).write.mode("append").parquet(str(source))
    stream = streams.running(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, k: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {r.user_id: (r.n, r.most) for r in out}
    assert last == {1: (3, 9.0), 2: (2, 1.0)}


def test_late_rows_are_dropped(spark, tmp_path):
    source, schema = tmp_path / "in", "event_id long, user_id long, ts timestamp_ntz, value double"
    day = lambda h: f"timestamp_ntz'2024-01-01 {h:02d}:10:00'"
    batch = lambda *rows: spark.sql(" UNION ALL ".join(f"SELECT {i}L AS event_id, 1L AS user_id, {day(h)} AS ts, 1.0D AS value" for i, h in rows))
    got = []

    def run():
        hourly = streams.hourly(streams.event_stream(spark, str(source), schema))
        q = hourly.writeStream.outputMode("append").foreachBatch(lambda df, k: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    for rows in ([(1, 1), (2, 9)], [(3, 2), (4, 14)], [(5, 22)]):
        batch(*rows).coalesce(1).write.mode("append").parquet(str(source))
        run()
    assert {(r.hour.hour, r.n) for r in got} == {(1, 1), (9, 1), (14, 1)}


def test_small_scalars(spark):
    row = spark.range(1).select(
        scalars.try_number(F.lit("x")).alias("a"), scalars.try_number(F.lit("2.5")).alias("b"), scalars.mean_with_deviation(F.lit(0.7), F.lit(None).cast("double"), F.lit(1)).alias("c"), scalars.mean_with_deviation(F.lit(0.7), F.lit(0.05), F.lit(3)).alias("d"),
        scalars.stem_part(F.lit("aaab_s001_t003"), 3).alias("e"), scalars.stem_part(F.lit("other"), 1).alias("f"), scalars.electrode_region(F.lit("EEG FP1-REF")).alias("g"), scalars.electrode_region(F.lit("fz")).alias("h"), scalars.measured_on(F.lit("x")).alias("i"),
    ).first()
    assert tuple(row) == (0.0, 2.5, "0.700 (n=1)", "0.700 +/- 0.050", "t003", "", "frontal_left", "central_midline", None)
