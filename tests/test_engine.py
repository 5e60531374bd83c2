"""The corpus engine's options, record sources, kernel reports, and the sinks that had no test."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecohort.operators import chain, cohort, features, ranking, signal
from tidecohort.sources import builder, corpus, edf, sinks

FS, RATIOS = 32, {"train": 0.5, "test": 0.5}


def wave(seconds, seed, comb=0.0):
    x = 20 * np.random.default_rng(seed).standard_normal(seconds * FS)
    x[::FS] += comb
    return x


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Six subjects; sidecars: one with a bad channel, a bad segment and a seizure, one with a comb, one beyond repair."""
    top = tmp_path_factory.mktemp("engine")
    for k in range(6):
        folder = "00_epilepsy" if k % 2 == 0 else "01_no_epilepsy"
        place = top / "v1" / folder / f"sub{k}" / f"s001_201{k}" / "01_tcp_ar"
        place.mkdir(parents=True)
        stem = f"sub{k}_s001_t000"
        names = ["EEG FP1-REF", "EEG F7-REF", "EEG T3-REF", "EEG CZ-REF", "EEG C3-REF", "EEG C4-REF"]
        (place / f"{stem}.edf").write_bytes(edf.edf_bytes({n: wave(20, 10 * k + i, 200.0 if k == 1 else 0.0) for i, n in enumerate(names)}, FS, patient=f"sub{k} F 01-JAN-1980 sub{k} Age:{30 + k}"))
        (place / f"{stem}.csv_bi").write_text("# version\n# duration = 20.0 secs\nchannel,start_time,stop_time,label,confidence\nTERM,0.0,4.0,bckg,1.0\n")
        side = {0: {"bads": ["F7"], "too_many": False, "segments": [{"start": 4.5, "stop": 5.0}], "seizures": [{"start": 16.0, "stop": 17.0}]}, 1: {"bads": [], "too_many": False, "periodic": {"f0": 1.0, "strength": 0.9, "flagged": True}}, 2: {"bads": ["T3", "CZ"], "too_many": True}}.get(k)
        if side:
            (place / f"{stem}-bads.json").write_text(json.dumps(side))
    return str(top)


def test_options_choose_recordings(spark, root):
    one = builder.Corpus(spark, root, version="v1")
    paths = sorted(r.path for r in one.recordings().collect())
    assert len(paths) == 6
    assert sorted(r.path for r in builder.Corpus(spark, root, version="v1", chosen=(1, 4)).recordings().collect()) == [paths[1], paths[4]]
    assert sorted(r.path for r in builder.Corpus(spark, root, version="v1", most_recordings=2).recordings().collect()) == paths[:2]
    labels = spark.createDataFrame([(paths[0], 0, " Brain"), (paths[3], 1, "other")], "path string, ic int, label string")
    assert [r.path for r in builder.Corpus(spark, root, version="v1", keep_labels=("brain",)).recordings(labels).collect()] == [paths[0]]
    with pytest.raises(Exception, match="no recording|PATH_NOT_FOUND|FileNotFound|No such"):
        builder.Corpus(spark, root, version="v9").recordings().collect()


def test_options_mend_windows(spark, root):
    plain = builder.Corpus(spark, root, version="v1")
    whole = plain.plan(4.0, 4.0, RATIOS)
    assert whole.count() == 30
    less = builder.Corpus(spark, root, version="v1", drop_segments=True, drop_seizures=True, interpolate=True)
    left = {(r.subject, r.idx) for r in less.plan(4.0, 4.0, RATIOS).collect()}
    assert left == {(f"sub{k}", i) for k in (0, 1, 3, 4, 5) for i in range(5)} - {("sub0", 1), ("sub0", 4)}
    keys, steps = ["path", "subject", "idx"], chain.Chain(FS, n_samples=4 * FS)
    get = lambda c: {(r.subject, r.idx): np.array(r.x) for r in c.processed(whole.select("path", "subject", "idx", "start", "end"), steps, keys, 0.0).filter("ok").collect()}
    raw, mended = get(plain), get(builder.Corpus(spark, root, version="v1", interpolate=True, subtract=True))
    assert raw.keys() == mended.keys() and len(raw) == 30
    assert not np.allclose(raw["sub0", 0][1], mended["sub0", 0][1]) and np.allclose(raw["sub0", 0][[0, 2, 3]], mended["sub0", 0][[0, 2, 3]])
    assert np.allclose(mended["sub1", 2], signal.subtract_average_artifact(raw["sub1", 2], FS, 1.0)) and np.allclose(raw["sub2", 0], mended["sub2", 0])
    assert np.allclose(raw["sub5", 0], mended["sub5", 0])


def test_whole_recordings_go_through_the_chain(spark, root):
    steps = chain.Chain(FS, band=(1.0, 10.0), pick=("Fp1", "Cz"), zeros=False)
    rows = {r.subject: r for r in builder.Corpus(spark, root, version="v1").whole_recordings(steps).collect()}
    assert len(rows) == 6 and rows["sub3"].names == ["Fp1", "Cz"] and len(rows["sub3"].x[0]) == 20 * FS and rows["sub3"].age == 33
    want = signal.fir_bandpass(np.stack([wave(20, 30), wave(20, 33)]), FS, 1.0, 10.0)
    assert np.allclose(rows["sub3"].x, want, atol=0.2)
    with pytest.raises(ValueError, match="can be read"):
        builder.Corpus(spark, root, version="v1").whole_recordings(chain.Chain(FS, pick=("nowhere",), zeros=False))


def test_bags_and_regions_follow_the_options(spark, root):
    rows = [("a", 0, "brain", [1.0, -3.0], [1.0, -1.0], "Fp1", 0.05, 0.0, 0.0, 90.0), ("a", 1, "Other", [2.0, 1.0], [2.0, 2.0], "O2", -0.05, 0.0, 0.0, 5.0), ("a", 2, "brain ", [2.0, 1.0], [4.0, -4.0], "O2", 0.0, 0.0, 0.0, 60.0)]
    parts = spark.createDataFrame(rows, "path string, ic int, label string, topography array<double>, x array<double>, electrode string, dx double, dy double, dz double, gof double")
    engine = builder.Corpus(spark, root, keep_labels=("brain",), bag_slots=3, least_fit=50.0)
    assert engine.bags(parts).first().x == [[4.0, -4.0], [-1.0, 1.0], [0.0, 0.0]]
    found = {r.region: r for r in engine.regions(parts).collect()}
    assert len(found) == 7 and found["temporal_right"].x == [-1.0, 1.0] and found["posterior_right"].n == 1 and found["central_midline"].x == [4.0, -4.0]
    without = {r.region: r.n for r in builder.Corpus(spark, root, use_dipoles=False).regions(parts).collect()}
    assert without["posterior_right"] == 2 and without["frontal_left"] == 1


def test_record_sources(spark):
    rows = spark.createDataFrame([("/b", "u", True, 256.0, 900.0, 0), ("/a", "u", False, 256.001, 700.0, 0), ("/c", "v", True, 250.0, 900.0, 0), ("/d", "v", True, 256.0, 900.0, 2)], "path string, subject string, epilepsy boolean, sfreq double, duration double, n_seizure long")
    assert {r.path for r in cohort.records(rows, 256.0, True, 800.0).collect()} == {"/b"}
    assert {r.path for r in cohort.records(rows, subject="v").collect()} == {"/c", "/d"}
    assert [tuple(r) for r in cohort.by_subject(rows.filter("subject = 'u'")).collect()] == [("u", False, ["/a", "/b"])]
    plan = rows.withColumns({"start": F.lit(1.0), "end": F.lit(2.0)})
    assert cohort.records_of_plan(plan.union(plan)).count() == 4
    listed = spark.createDataFrame([("/x/a.b.edf", 1.0, 1), ("/y/a.b.edf", 0.5, 2), ("/y/c.edf", 3.0, 3)], "path string, anomaly double, line int")
    assert {tuple(r) for r in ranking.last_by_stem(listed).collect()} == {("a.b", 0.5), ("c", 3.0)}


def test_kernel_report_ranks_three_ways(spark):
    bank = features.Bank(32, 2, kernels=4, groups=2)
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, i % 2, rng.standard_normal((2, 32)).tolist()) for i in range(20)], "window_id long, y int, x array<array<double>>")
    coefficients = spark.createDataFrame([(k, float(k % 7), 1.0) for k in range(bank.width)], "k int, coef double, std double")
    report = features.kernel_report(features.win_counts(rows, bank), coefficients, bank, 32.0, n=3).toPandas()
    assert report.groupby("ranking").size().to_dict() == {"classifier": 3, "discriminative": 6, "overall": 3}
    counts = features.win_counts(rows, bank).toPandas().groupby(features.SLOT).frequency.sum()
    assert report[report.ranking == "overall"].sort_values("place").score.tolist() == sorted(counts, reverse=True)[:3]
    assert report.peak_hz.between(0, 16).all()
    hist = features.peak_histogram(spark.createDataFrame([(0.0,), (4.9,), (10.0,), (10.1,), (9.99,)], "peak_hz double"), 5.0, 10.0)
    assert {r.bin: r.n for r in hist.collect()} == {0: 2, 1: 2}


def test_remaining_sinks(spark, tmp_path):
    base = str(tmp_path)
    read = lambda name: spark.read.option("header", True).csv(f"{base}/{name}")
    metrics = spark.createDataFrame([("r1", "test", "subject", 0.7)], "run string, split string, level string, roc_auc double")
    sinks.performance(metrics, f"{base}/perf")
    sinks.performance(metrics, f"{base}/perf")
    assert [r.roc_auc for r in read("perf").collect()] == ["0.7"]
    labels, matrices = spark.createDataFrame([("a", 0, "brain")], "path string, ic int, label string"), spark.createDataFrame([("a", [[1.0]])], "path string, mixing array<array<double>>")
    series, dipoles = spark.createDataFrame([("a", 0, [1.0])], "path string, ic int, x array<double>"), spark.createDataFrame([("a", 0, 9.0)], "path string, ic int, gof double")
    for _ in range(2):
        sinks.decompositions(labels, matrices, series, dipoles, f"{base}/ica")
    assert [spark.read.parquet(f"{base}/ica/{n}").count() for n in ("labels", "matrices", "sources", "dipoles")] == [1, 1, 1, 1]
    sinks.score_dump(spark.createDataFrame([(1, 0.5)], "window_id long, s double"), spark.createDataFrame([("u", 0.5)], "subject string, s double"), f"{base}/dump", "run")
    assert dict(spark.read.parquet(f"{base}/dump/run/windows").dtypes) == {"window_id": "int", "s": "float"}
    sinks.comparison(metrics, metrics, metrics, f"{base}/cmp")
    assert all(read(f"cmp/{n}").count() == 1 for n in ("long", "focused", "by_config"))
    sinks.dipole_report(metrics, metrics, f"{base}/dip")
    assert read("dip/percentiles").count() == read("dip/regions").count() == 1
    sinks.anomalies(spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "path string, anomaly double"), f"{base}/anomalies")
    assert sorted(r.path for r in read("anomalies").collect()) == ["a", "b", "c"]
    sinks.counts(metrics, f"{base}/counts")
    assert read("counts").columns == metrics.columns
    spectra = spark.createDataFrame([("a", "psd", [1.0]), ("a", "psd-interp", [2.0])], "path string, variant string, p array<double>")
    sinks.spectra(spectra, f"{base}/psd")
    assert [r.p for r in corpus.spectra(spark, f"{base}/psd", "psd-interp").collect()] == [[2.0]]
    (tmp_path / "plots").mkdir()
    (tmp_path / "plots" / "rec1_segments.png").write_bytes(b"x")
    assert [tuple(r) for r in corpus.by_stem(spark, f"{base}/plots", "_segments.png").collect()] == [("rec1", "rec1_segments.png")]
