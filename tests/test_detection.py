"""Detection, alignment, component bags, band series, EDF pushdown and windows read in one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecohort.operators import chain, detection, signal
from tidecohort.sources import edf, windows

FS = 32


def noise(seed, channels, n, shared=1.0):
    rng = np.random.default_rng(seed)
    return shared * rng.standard_normal(n) + rng.standard_normal((channels, n))


def test_best_correlations_equal_numpy():
    x = noise(0, 5, 100)
    x[2, 20:40] = 1.0
    found = detection.best_correlations(x, 20)
    for w in range(5):
        part = x[:, 20 * w : 20 * w + 20]
        for c in range(5):
            rs = [abs(np.corrcoef(part[c], part[o])[0, 1]) if part[c].std() > 0 and part[o].std() > 0 else 0 for o in range(5) if o != c]
            assert found[w, c] == pytest.approx(max(rs))
    assert np.allclose(detection.best_correlations(np.stack([x, x * 2]), 20), found)


def test_detector_finds_planted_faults(spark):
    n = 60 * FS
    clean = noise(1, 8, n, 3.0)
    broken = clean.copy()
    broken[1] = np.random.default_rng(9).standard_normal(n)
    broken[2] *= 40
    broken[3] = 0.0
    broken[4, 10] = np.nan
    spiky = clean.copy()
    spiky[5, 10 * FS : 11 * FS] += 500 * np.sin(np.arange(FS))
    names = [f"c{i}" for i in range(8)]
    rows = [("clean", names, clean.tolist()), ("broken", names, broken.tolist()), ("spiky", names, spiky.tolist()), ("few", names[:3], clean[:3].tolist())]
    options = detection.Detector(high_pass=None, most_peak=100.0, tile_s=0.5, most_share=0.2)
    found = {r.path: r for r in detection.detected(spark.createDataFrame(rows, "path string, names array<string>, x array<array<double>>"), options, FS).collect()}
    assert found["clean"].bads == [] and not found["clean"].too_many and found["clean"].segments == []
    assert found["broken"].bads == ["c1", "c2", "c3", "c4"] and found["broken"].too_many
    assert [(s.start, s.stop) for s in found["spiky"].segments] == [(10.0, 11.0)]
    assert found["few"].too_many and found["few"].n_channels == 3


def test_periodic_artifact_is_subtracted_before_channels_are_judged():
    n = 60 * FS
    comb = np.zeros(n)
    comb[:: 2 * FS // 2] = 60.0
    x = noise(2, 6, n, 2.0) + comb
    with_it = detection.Detector(high_pass=None, strength=0.2, subtract=True, most_subtracted=2.0, most_peak=30.0).detect(x, FS)
    without = detection.Detector(high_pass=None, strength=0.2, most_peak=30.0).detect(x, FS)
    assert with_it["flagged"] and with_it["f0"] == pytest.approx(1.0, abs=0.05) and with_it["subtracted"] and not without["subtracted"]
    assert len(with_it["segments"]) < len(without["segments"])


def test_aligned_channels_equal_numpy(spark):
    x = noise(3, 4, 12)
    row = spark.createDataFrame([(["a", "b", "c", "d"], x.tolist())], "names array<string>, x array<array<double>>")
    wanted = F.array(F.lit("d"), F.lit("q"))
    out = row.select(chain.aligned(F.col("names"), F.col("x"), wanted, F.create_map(F.lit("b"), F.lit("q"))).alias("x"), chain.aligned(F.col("names"), F.col("x"), wanted).alias("none")).first()
    assert np.allclose(out.x, x[[3, 1]] - x[[3, 1]].mean(0)) and out.none is None


def test_component_bags_are_signed_ranked_and_filled_up(spark):
    rows = [("a", 0, [0.1, -2.0], [1.0, -1.0], 0.2), ("a", 1, [3.0, -2.0], [5.0, -5.0], 0.1), ("a", 2, [1.0, -1.0], [0.5, 0.5], 0.9), ("b", 0, [1.0, 0.0], [2.0, 2.0], 0.5)]
    frame = spark.createDataFrame(rows, "path string, ic int, topography array<double>, x array<double>, prob double")
    bags = {r.path: r for r in chain.component_bags(frame, 3).collect()}
    assert bags["a"].x == [[5.0, -5.0], [-1.0, 1.0], [0.5, 0.5]] and bags["b"].x == [[2.0, 2.0], [0.0, 0.0], [0.0, 0.0]]
    assert bags["a"].names == ["ic_0", "ic_1", "ic_2"] and bags["b"].n == 1
    by_prob = {r.path: r.x for r in chain.component_bags(frame, 2, "prob", sign=False).collect()}
    assert by_prob["a"] == [[0.5, 0.5], [1.0, -1.0]]


def test_hot_segments_with_few_tiles(spark):
    series = spark.createDataFrame([("a", t + 0.5, p) for t, p in enumerate([1.0, 9.0, 4.0])] + [("b", 0.5, 1.0)], "path string, t double, power double")
    lengths = spark.createDataFrame([("a", 3 * FS + 5), ("b", FS + 1)], "path string, n int")
    rows = [(r.path, r.kind, r.place, r.start) for r in chain.hot_segments(series, lengths, FS, 1.0).collect()]
    assert sorted(rows) == [("a", "baseline", 1, 0.0), ("a", "hot", 1, 1.0), ("a", "hot", 2, 2.0), ("a", "hot", 3, 0.0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("edf")
    for k in range(3):
        data = {c: 20 * noise(10 * k + i, 1, (10 + k) * FS)[0] for i, c in enumerate(("Fp1", "F7", "T3"))}
        (top / f"r{k}.edf").write_bytes(edf.edf_bytes(data, FS))
    return str(top)


def samples(k, i):
    return 20 * noise(10 * k + i, 1, (10 + k) * FS)[0]


def test_filters_reach_the_partitions(spark, folder):
    edf.register(spark)
    reader = edf.EdfReader({"path": folder, "partition_bytes": str(1 << 20)})
    left = list(reader.pushFilters([edf.EqualTo(("channel",), "F7"), edf.In(("path",), (f"{folder}/r1.edf", f"{folder}/r2.edf")), edf.StringStartsWith(("path",), f"{folder}/r1"), edf.EqualTo(("sfreq",), 32.0)]))
    assert [f.attribute for f in left] == [("sfreq",)]
    assert [(p.shares, p.channels) for p in reader.partitions()] == [(((f"{folder}/r1.edf", 0, 1),), ("F7",))]
    batches = list(reader.read(reader.partitions()[0]))
    assert len(batches) == 1 and batches[0].column("channel").to_pylist() == ["F7"] and np.allclose(batches[0].column("x")[0].as_py(), samples(1, 1), atol=0.06)
    rows = spark.read.format("edf").load(folder).filter("channel = 'F7' AND path LIKE '%r1.edf'")
    assert [(r.channel, len(r.x)) for r in rows.collect()] == [("F7", 11 * FS)]
    assert spark.read.format("edf").load(folder).filter("channel = 'F7' AND channel = 'T3'").count() == 0


def test_driver_opens_no_file(spark, folder, monkeypatch):
    monkeypatch.setattr(edf, "open_file", lambda path: pytest.fail("opened"))
    parts = edf.EdfReader({"path": folder, "partition_bytes": "1000"}).partitions()
    assert len(parts) > 3 and {path[-6:] for p in parts for path, _, _ in p.shares} == {"r0.edf", "r1.edf", "r2.edf"}


def test_small_files_share_partitions():
    parts = edf.packed([(f"f{i}", 1000) for i in range(640)] + [("big", 200 << 20)], 64 << 20)
    assert 32 <= len(parts) <= 60 and [s for p in parts for s in p] == [(f"f{i}", 0, 1) for i in range(640)] + [("big", k, 4) for k in range(4)]
    assert max(len(p) for p in parts) > 10 and edf.packed([], 10) == []


def test_shares_of_a_file_make_the_whole(spark, folder):
    edf.register(spark)
    rows = spark.read.format("edf").option("partition_bytes", "500").load(folder).filter("channel = 'T3'").collect()
    for k in range(3):
        own = sorted((r.start_s, r.x) for r in rows if r.path.endswith(f"r{k}.edf"))
        assert len(own) > 2 and np.allclose(np.concatenate([x for _, x in own]), samples(k, 2), atol=0.06)


def test_every_byte_is_read_once(folder):
    """Overlapping windows with margins: the ranges of records that are read do not overlap."""
    with edf.open_file(f"{folder}/r2.edf") as file:
        recording, seen, whole = edf.Recording(file), [], None
        whole = recording.raw
        recording.raw = lambda a, b: (seen.extend(range(a, b)), whole(a, b))[1]
        asked = [(0.0, 3.0), (0.5, 2.0), (1.0, 4.5), (7.0, 9.0), (8.5, 30.0)]
        got = list(windows.stretches(recording, asked, 1.0))
    assert len(seen) == len(set(seen)) and set(range(12)) >= set(seen) and 5 in seen and not {99} & set(seen)
    for (start, end), (names, fs, x, left, right) in zip(asked, got, strict=True):
        low, high = max(start - 1, 0), min(end + 1, 12)
        assert names == ["Fp1", "F7", "T3"] and fs == FS and left == start - low and right == pytest.approx(high - min(end, 12))
        assert np.allclose(x[1], samples(2, 1)[int(low * FS) : int(high * FS)], atol=0.06)


def test_margins_keep_filters_from_the_edges(spark, folder):
    plan = spark.createDataFrame([(f"{folder}/r{k}.edf", float(s), float(s + 2), s) for k in range(3) for s in (0, 1, 4, 8)] + [("/nowhere.edf", 0.0, 2.0, 0)], "path string, start double, end double, idx int")
    steps = chain.Chain(1.0, band=(2.0, 10.0), n_samples=2 * FS, rename={}, zeros=False)
    got = {(r.path, r.idx): r for r in windows.processed(plan, steps, ["path", "idx"], margin_s=1.5).collect()}
    assert len(got) == 13 and not got["/nowhere.edf", 0].ok and got["/nowhere.edf", 0].x is None
    for k in range(3):
        raw = np.stack([samples(k, i) for i in range(3)])
        for s in (0, 1, 4, 8):
            low, high = max(0, s - 1.5), min(10 + k, s + 3.5)
            part = signal.fir_bandpass(raw[:, int(low * FS) : int(high * FS)], FS, 2.0, 10.0)
            at = int((s - low) * FS)
            assert np.allclose(got[f"{folder}/r{k}.edf", s].x, part[:, at : at + 2 * FS], atol=0.2)
    assert all(len(r.x[0]) == 2 * FS for r in got.values() if r.ok)


def test_stacks_by_length_keep_places_and_nulls(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(40 if i % 2 else 64).tolist() if i % 5 else None) for i in range(12)]
    frame = spark.createDataFrame(rows, "id int, x array<double>").coalesce(1)
    out = {r.id: r for r in frame.select("id", signal.spectrum(F.col("x"), 32.0, 16).alias("p"), signal.without_artifact(F.col("x"), 32.0, 0.25, 3).alias("c")).collect()}
    for i, x in rows:
        if x is None:
            assert out[i].p is None and out[i].c is None
        else:
            assert np.allclose(out[i].p, signal.welch(np.array(x), 32.0, 16)[1]) and np.allclose(out[i].c, signal.subtract_average_artifact(np.array(x), 32.0, 0.25, 3))


def test_before_and_after_leave_bad_spans_out(spark):
    x = noise(6, 3, 10 * FS)
    spoilt = x.copy()
    spoilt[:, 3 * FS : 4 * FS] += 1000
    frame = spark.createDataFrame([("a", ["EEG FP1-REF", "F7", "T3"], spoilt.tolist(), [(3.0, 4.0)]), ("b", ["EEG FP1-REF", "F7", "T3"], x.tolist(), [])], "path string, names array<string>, x array<array<double>>, omit array<struct<start:double,stop:double>>")
    rows = chain.before_after(frame, chain.Chain(FS, pairs=(("Fp1", "F7"),), least_pairs=1), FS).toPandas()
    assert set(rows.channel) == {"Fp1", "F7", "T3", "Fp1-F7"} and rows[rows.channel == "Fp1-F7"].raw.isna().all() and rows[rows.channel == "T3"].repaired.isna().all()
    assert rows[rows.path == "a"].raw.max() < 20
    whole = rows[(rows.path == "b") & (rows.channel == "F7")].sort_values("k").raw
    assert np.allclose(whole, 10 * np.log10(signal.welch(x[1], FS, FS)[1]))
    assert np.isnan(signal.welch(x, FS, 64, [(0.0, 10.0)])[1]).all()


def test_windows_are_stacked_to_one_shape(spark):
    frame = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [[1.0], [3.0, 4.0]]), (3, [[1.0, 2.0]])], "id int, x array<array<double>>")
    out = frame.select("id", signal.stacked(F.col("x"), 2, 2).alias("x"))
    assert dict(out.dtypes)["x"] == "array<array<float>>" and {r.id: r.x for r in out.collect()} == {1: [[1.0, 2.0], [3.0, 4.0]], 2: None, 3: None}
