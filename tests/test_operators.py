"""Array operators against closed forms and hand-walked cases, and edge cases of the relational ones."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecohort.functions import scalars
from tidecohort.operators import cohort, features, metrics, ml, ranking, replayed, signal
from tidecohort.sources import corpus
from tidecohort.streaming import windows as streams

RECORDINGS = "subject string, path string, epilepsy boolean, duration double"


def test_filters_keep_the_band():
    fs, t = 200.0, np.arange(2000) / 200.0
    tone = np.sin(2 * np.pi * 10 * t)
    kept = signal.fir_bandpass(tone + np.sin(2 * np.pi * 60 * t), fs, 1.0, 30.0)
    assert np.abs(kept - tone)[200:-200].max() < 0.02
    clean = signal.notch(tone + np.sin(2 * np.pi * 60 * t), fs, [60.0])
    assert np.abs(clean - tone)[200:-200].max() < 0.02


def test_resample_keeps_a_tone():
    t, u = np.arange(400) / 200.0, np.arange(200) / 100.0
    assert np.allclose(signal.resample(np.sin(2 * np.pi * 5 * t), 200.0, 100.0), np.sin(2 * np.pi * 5 * u), atol=1e-9)


def test_welch_integrates_to_the_variance():
    x = np.random.default_rng(0).standard_normal(20000)
    f, p = signal.welch(x, 100.0, 256)
    assert abs(p.sum() * (f[1] - f[0]) - x.var()) < 0.03
    tone = np.sin(2 * np.pi * 12.5 * np.arange(4096) / 100.0)
    f, p = signal.welch(tone, 100.0, 256)
    assert abs(f[p.argmax()] - 12.5) < 0.4


def test_periodicity_of_combs():
    fs = 100.0
    comb = np.zeros(3000)
    comb[::80] = 1
    f0, strength = signal.periodicity(comb, fs)
    assert abs(f0 - 1.25) < 0.05 and strength > 0.5
    assert signal.periodicity(np.zeros(100), fs) == (None, 0.0)


def test_artifact_subtraction_removes_the_template():
    tile = np.sin(np.linspace(0, 6, 50))
    x = np.concatenate([np.tile(tile, 30), tile[:20]])
    out = signal.subtract_average_artifact(x, 100.0, 0.5)
    assert np.abs(out[:1500]).max() < 1e-12 and np.allclose(out[1500:], tile[:20])
    assert signal.subtract_average_artifact(x[:100], 100.0, 0.5) is not None


def test_spline_reproduces_a_constant():
    rng = np.random.default_rng(1)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.standard_normal((n, 3)))
    w = signal.spherical_weights(unit(12), unit(3))
    assert np.allclose(w.sum(1), 1, atol=1e-6)


def test_bank_counts_winners():
    bank = features.Bank(64, 3, kernels=4, groups=4, seed=7)
    x = np.random.default_rng(2).standard_normal((3, 64))
    assert bank.features(x).shape == (bank.width,)
    assert np.array_equal(bank.features(x), features.Bank(64, 3, kernels=4, groups=4, seed=7).features(x))
    assert not np.array_equal(bank.features(x), features.Bank(64, 3, kernels=4, groups=4, seed=8).features(x))
    hard = sum(h.sum() for _, _, _, h in bank.winners(x))
    assert hard == bank.groups * len(bank.dilations) * (2 * 64 - 1)


def test_bank_equals_a_hand_walk():
    x = np.array([[1, 2, 3, 4, 5, 6], [6, 5, 4, 3, 2, 1], [0, 1, 0, 1, 0, 1], [2] * 6], float)
    bank = features.Bank(6, 4, kernels=2, groups=4, seed=0)
    for d, r, soft, hard in bank.winners(x):
        z = np.diff(x) if r else x
        want_soft, want_hard = np.zeros(4), np.zeros(4)
        for g in range(bank.groups):
            mixed = z[bank.channels[d, r, g]].sum(0)
            for t in range(z.shape[1]):
                values = [sum(w * (mixed[t + (k - 4) * bank.dilations[d]] if 0 <= t + (k - 4) * bank.dilations[d] < len(mixed) else 0) for k, w in enumerate(bank.weights[d, r, g, j])) for j in range(2)]
                want_soft[g * 2 + int(np.argmax(values))] += max(values)
                want_hard[g * 2 + int(np.argmin(values))] += 1
        assert np.allclose(soft, want_soft) and np.array_equal(hard, want_hard)


def test_scaler_keeps_zeros(spark):
    rows = spark.createDataFrame([(1, [0.0, 4.0]), (2, [9.0, 16.0]), (3, [1.0, 0.0])], "id int, features array<double>")
    out = {r["id"]: r["scaled"] for r in ml.SparseScaler().fit(rows).transform(rows).collect()}
    assert out[1][0] == 0 and out[3][1] == 0 and out[2][0] > 0


def test_windows_edges(spark):
    rows = spark.createDataFrame([("a", "/p1", True, 120.0), ("b", "/p2", False, 119.9), ("c", "/p3", False, 240.0)], RECORDINGS)
    counts = {r["subject"]: r["n_windows"] for r in cohort.subject_counts(rows, 120.0, 120.0).collect()}
    assert counts == {"a": 1, "c": 2}
    with pytest.raises(ValueError):
        cohort.windows(rows, 120.0, 60.0, cap=0)
    assert cohort.windows(rows.limit(0), 120.0, 60.0).count() == 0
    assert cohort.windows(rows, 120.0, 120.0, balance=True).groupBy("subject").count().agg(F.max("count")).first()[0] == 1


def test_touching_spans_do_not_overlap(spark):
    w = spark.createDataFrame([("/p", 0.0, 60.0), ("/p", 60.0, 120.0), ("/q", 0.0, 60.0)], "path string, start double, end double")
    s = spark.createDataFrame([("/p", 60.0, 70.0)], "path string, start double, stop double")
    assert {(r["path"], r["start"]) for r in cohort.overlapping(w, s).collect()} == {("/p", 0.0), ("/q", 0.0)}


def test_splits_share_no_subject(spark):
    rows = spark.createDataFrame([(str(i), i % 3 == 0) for i in range(50)], "subject string, epilepsy boolean")
    out = cohort.splits(rows, {"train": 0.6, "val": 0.2, "test": 0.2}).collect()
    assert len({r["subject"] for r in out}) == len(out) == 50 and {r["split"] for r in out} == {"train", "val", "test"}


def test_metrics_with_one_class(spark):
    rows = spark.createDataFrame([(1, "a", 1, 0.5), (2, "a", 1, -0.5)], "window_id long, subject string, y int, s double")
    got = metrics.classification(rows, []).first()
    assert got["mcc"] is None and got["roc_auc"] is None and got["sensitivity"] == 0.5
    assert metrics.best_threshold(rows).first()["threshold"] == 0.0


def test_constant_metric_has_zero_z(spark):
    rows = spark.createDataFrame([(str(i), 1.0, 2.0, float(i)) for i in range(5)], "path string, power double, roughness double, flatness double")
    assert all(r["z_power"] == 0 for r in ranking.robust_z(rows).collect())


def test_bipolar_needs_eighteen_pairs(spark):
    names = sorted({n for pair in signal.PAIRS for n in pair})
    frame = lambda keep: spark.createDataFrame([({n: [1.0, 2.0] for n in keep},)], "x map<string, array<double>>").select(signal.bipolar(F.col("x")).alias("b")).first()["b"]
    assert len(frame(names)) == 22
    assert frame([n for n in names if n not in ("C3", "C4")]) is None


def test_header_fields(spark):
    rows = spark.createDataFrame([("x M 1 Age:41 ",), ("Age:1 Age:2 F  M ",), (None,)], "h string")
    got = rows.select(scalars.header_age(F.col("h")).alias("a"), scalars.header_gender(F.col("h")).alias("g")).collect()
    assert [(r["a"], r["g"]) for r in got] == [(41, "M"), (-1, "X"), (-1, "X")]


def test_montage_electrodes(spark):
    lines = ["[Montage]", "montage = 0, A-B: A -- B", "montage = 1, B-C: B -- C"]
    rows = spark.createDataFrame([("m", i, v) for i, v in enumerate(lines)], "montage string, line int, value string")
    assert corpus.montage_electrodes(corpus.parse_montage(rows)).first()["channels"] == ["A", "B", "C"]


def test_corpus_files(spark, tmp_path):
    folder = tmp_path / "00_epilepsy/aaaa/s001_2015/01_tcp_ar"
    folder.mkdir(parents=True)
    (folder / "aaaa_s001_t000.edf").write_bytes(b"0       " + b"X F 01 Age:33".ljust(80) + b" " * 200)
    (folder / "aaaa_s001_t000.csv_bi").write_text("# version = 1\n# bname = a\n# duration = 300.0 secs\n# montage_file = m\n#\nchannel,start_time,stop_time,label,confidence\nTERM,1.5,2.5,seiz,1.0\n")
    got = corpus.listing(spark, str(tmp_path)).first()
    assert (got["subject"], got["session"], got["year"], got["epilepsy"]) == ("aaaa", "s001", "2015", True)
    assert corpus.headers(spark, str(tmp_path)).first()["age"] == 33
    assert corpus.durations(spark, str(tmp_path)).first()["duration"] == 300.0
    assert corpus.annotations(spark, str(tmp_path)).first()["label"] == "seiz"


def test_idempotent_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    corpus.write_new(rows, path, ["k"])
    corpus.write_new(rows.union(spark.createDataFrame([(3, "c")], "k int, v string")), path, ["k"])
    assert spark.read.parquet(path).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = streams.hourly(streams.event_stream(spark, str(tmp_path / "in"), source.schema))
    job = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    job.awaitTermination(120)
    batch = streams.hourly(source.withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda df: sorted((r["user_id"], str(r["hour"]), r["n"]) for r in df.collect())
    assert key(spark.table("hourly")) == key(batch)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exclusion_and_replay_do_not_sort_by_expressions(spark):
    """Sorts of a join evaluate their keys at every comparison; these were patterns over paths before."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(10).selectExpr("concat('/c/', id, '/s/', id, '.edf') AS path", "10.0D AS duration")
        kept = cohort.without_excluded(rows, spark.createDataFrame([("/c//1/./s/1.edf",), ("/c/1/s/1.edf",), ("# no",)], "value string"))
        assert kept.columns == rows.columns and kept.count() == 9
        manifests = rows.selectExpr("concat('/moved', path) AS path", "0.0D AS start", "5.0D AS end", "'test' AS split")
        replayed = cohort.replay(kept, manifests)
        assert replayed.count() == 9
        assert not any("Sort [" in line and "regexp" in line for p in (kept, replayed) for line in plan_of(p).splitlines())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_capped_plans_equal_brute_force_and_deal_recordings_not_windows(spark):
    """Before, every window was dealt to its subject and sorted there. With a cap of 1 some subjects find none below their bound."""
    rows = [(str(k), f"/{k}/{r}", 120.0 + 60 * (k * 7 % 13) + r) for k in range(3000) for r in range(2)]
    frame = spark.createDataFrame(rows, "subject string, path string, duration double")
    key = lambda w: (hashlib.md5(f"42|{w[1]}|{w[2]}".encode()).hexdigest(), *w[1:])
    listed = {}
    for subject, path, duration in rows:
        listed.setdefault(subject, []).extend((subject, path, i) for i in range(int((duration - 120) // 60) + 1))
    for cap in (1, 5):
        found = cohort.windows(frame, 120.0, 60.0, cap)
        want = {(*w, place) for own in listed.values() for place, w in enumerate(sorted(own, key=key)[:cap])}
        assert {(r["subject"], r["path"], r["idx"], r["position"]) for r in found.collect()} == want
        text = plan_of(cohort.windows(frame, 120.0, 60.0, cap))
        assert text.count("Exchange hashpartitioning(subject") == 1 and text.index("Exchange hashpartitioning(subject") > text.index("Generate explode")


def test_replay_matches_short_paths_only_as_they_stand(spark):
    """A manifest row without three components and without a recording met every such recording before."""
    rec = spark.createDataFrame([("a", 9.0), ("b", 9.0)], "path string, duration double")
    manifests = spark.createDataFrame([("a", 0.0, 1.0, "test"), ("z", 0.0, 1.0, "test")], "path string, start double, end double, split string")
    assert [r["path"] for r in cohort.replay(rec, manifests).collect()] == ["a"]


def test_splits_equal_brute_force(spark):
    rows = [(f"s{i}", None if i % 7 == 0 else i % 3 == 0) for i in range(500)]
    out = cohort.splits(spark.createDataFrame(rows, "subject string, epilepsy boolean"), {"train": 0.6, "val": 0.2, "test": 0.2})
    want = {}
    for label in (None, True, False):
        names = sorted((s for s, e in rows if e is label), key=lambda s: (hashlib.md5(f"42|{s}".encode()).hexdigest(), s))
        train, val = int(0.6 * len(names)), int(0.2 * len(names))
        want |= {s: "train" if i < train else "val" if i < train + val else "test" for i, s in enumerate(names)}
    assert {r["subject"]: r["split"] for r in out.collect()} == want


def test_only_recordings_with_spans_list_windows(spark):
    rec = spark.createDataFrame([("a", 9.0), ("b", 9.0)], "path string, duration double")
    spans = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("c", 1.0)], "path string, start double")
    assert [tuple(r) for r in cohort.with_spans(rec, spans).collect()] == [("a", 9.0)]


def test_replayed_plans_list_only_windows_with_a_place(spark):
    """Before, every window was listed and joined to the places."""
    rec = spark.createDataFrame([(str(k % 20), f"/{k % 20}/{k}", 900.0 + 600 * (k % 5), k % 2 == 0) for k in range(200)], "subject string, path string, duration double, epilepsy boolean")
    found = replayed.plan(rec, 120.0, 60.0, {"train": 0.6, "val": 0.2, "test": 0.2}, 3)
    assert found.groupBy("subject").count().filter("count <> 3").count() == 0 and found.select("subject").distinct().count() == 20
    assert "sequence(0" not in plan_of(found)
