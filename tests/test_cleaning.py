"""The signal chain, detection and components against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecohort.operators import chain, cohort, detection, features, signal

FS = 64.0


def comb(period, n=640, seed=0):
    x = np.random.default_rng(seed).normal(0, 0.1, n)
    x[:: period] += 3
    return x


def loop_periodicity(x, fs, fmin, fmax):
    x = x - x.mean()
    acf = np.array([(x[: len(x) - k] * x[k:]).sum() for k in range(len(x))])
    acf = acf / acf[0]
    low, high = int(fs / fmax), int(fs / fmin)
    lag = max(range(low, high), key=lambda k: acf[k])
    for part in (5, 4, 3, 2):
        near = round(lag / part)
        if near >= low:
            best = max(range(near - 1, near + 2), key=lambda k: acf[k])
            if acf[best] >= 0.6 * acf[lag]:
                return fs / best, acf[lag]
    return fs / lag, acf[lag]


@pytest.mark.parametrize("period", [11, 16, 23, 40, 64])
def test_periodicity_finds_the_shortest_period(period):
    x = comb(period)
    f0, strength = signal.periodicity(x, FS)
    assert f0 == pytest.approx(FS / period, rel=0.1) and strength > 0.5
    assert (f0, strength) == pytest.approx(loop_periodicity(x, FS, 0.5, 6.0))
    assert signal.periodicity(np.zeros(100), FS) == (None, 0.0)


def test_chain_runs_its_steps_in_order(spark):
    rng = np.random.default_rng(1)
    names = ["EEG FP1-REF", "F7", "EEG T3-LE", "Cz"]
    x = rng.normal(size=(4, 256))
    steps = chain.Chain(FS, band=(2.0, 20.0), notch=(16.0,), target_fs=32.0, pairs=(("Fp1", "F7"), ("F7", "T3")), least_pairs=2, pick=("F7-T3",), margin_s=0.5, n_samples=120)
    by_hand = signal.resample(signal.notch(signal.fir_bandpass(x, FS, 2.0, 20.0), FS, [16.0]), FS, 32.0)
    expected = np.pad((by_hand[1] - by_hand[2])[16:-16], (0, 120))[:120]
    rows = spark.createDataFrame([(1, names, x.tolist()), (2, names[:1], x[:1].tolist()), (3, names, None)], "k long, names array<string>, x array<array<double>>")
    out = {r.k: r for r in chain.process(rows, steps, ["k"]).collect()}
    assert out[1].ok and out[1].names == ["F7-T3"] and np.allclose(out[1].x[0], expected)
    assert not out[2].ok and out[2].names == ["F7-T3"] and out[2].x == [[0.0] * 120] and not out[3].ok
    none = {r.k: r for r in chain.process(rows, chain.Chain(FS, pick=("Fz",), zeros=False), ["k"]).collect()}
    assert none[1].x is None and not none[1].ok


def test_interpolation_restores_a_smooth_field():
    names = [n for n in chain.POSITIONS if n not in ("A1", "A2")]
    place = chain.positions(names)
    field = place @ np.array([1.0, -0.5, 0.3])
    x = np.outer(field, np.ones(5))
    broken = x.copy()
    broken[names.index("C3")] = 99
    fixed = chain.interpolated(names, broken, ["C3"])
    assert np.allclose(fixed[names.index("C3")], x[names.index("C3")], atol=0.15)
    assert np.array_equal(chain.interpolated(["a", "b"], x[:2], ["a"]), x[:2])


def test_components_are_projected_out(spark):
    rng = np.random.default_rng(2)
    mixing = rng.normal(size=(3, 3))
    unmixing, x = np.linalg.inv(mixing), rng.normal(size=(3, 20))
    expected = x - mixing[:, [0, 2]] @ (unmixing[[0, 2]] @ x)
    row = spark.createDataFrame([(x.tolist(), unmixing.tolist(), mixing.tolist(), [0, 2])], "x array<array<double>>, u array<array<double>>, m array<array<double>>, drop array<int>")
    found = row.select(chain.without_components(F.col("x"), F.col("u"), F.col("m"), F.col("drop")).alias("y")).first().y
    assert np.allclose(found, expected)


def test_channels_are_matched_to_a_decomposition(spark):
    have = spark.createDataFrame([("a", "Fp1"), ("a", "Cz"), ("a", "T3"), ("b", "EEG FP1-REF"), ("b", "cz"), ("c", "Fp1")], "path string, channel string")
    wanted = spark.createDataFrame([(p, c) for p in "abc" for c in ("Fp1", "Cz")], "path string, channel string")
    out = {r.path: (r.complete, r.renames) for r in chain.match_channels(have, wanted).collect()}
    assert out == {"a": (True, {}), "b": (True, {"EEG FP1-REF": "Fp1", "cz": "Cz"}), "c": (False, {})}
    assert chain.electrode_positions(spark).count() == 23


def test_segments_join_neighbouring_tiles(spark):
    quiet = [0.1, 0.2, 0.1, 0.2] * 8
    loud = list(quiet)
    loud[4], loud[9], loud[29] = 9.0, -9.0, 9.0
    rows = spark.createDataFrame([("a", 0, loud), ("a", 1, quiet), ("a", 2, quiet), ("a", 3, quiet), ("b", 0, quiet)], "path string, ch int, x array<double>")
    flags = rows.select("path", "ch", F.lit(False).alias("bad"))
    found = sorted(tuple(r) for r in detection.bad_segments(rows, flags, 4.0, 4, 5.0).collect())
    assert found == [("a", 1.0, 3.0), ("a", 7.0, 8.0)]
    real = detection.channel_flags(rows)
    whole = {r.path: r for r in detection.too_many(real).collect()}
    assert not whole["a"].too_many and whole["b"].too_many
    side = {r.path: r for r in detection.sidecars(flags, detection.bad_segments(rows, flags, 4.0, 4, 5.0), spark.createDataFrame([("a", 1.0, 0.9, True)], "path string, f0 double, strength double, flagged boolean")).collect()}
    assert len(side["a"].segments) == 2 and side["b"].segments == [] and side["a"].periodic.flagged


def test_flat_and_loud_channels_are_bad(spark):
    rng = np.random.default_rng(3)
    data = {k: rng.normal(0, 1, 200) for k in range(12)} | {12: np.zeros(200), 13: rng.normal(0, 60, 200)}
    rows = spark.createDataFrame([("a", k, x.tolist()) for k, x in data.items()], "path string, ch int, x array<double>")
    assert {r.ch for r in detection.channel_flags(rows).filter("bad").collect()} == {12, 13}
    row = spark.range(1).select(*[detection.affected(F.array(*[F.lit(b) for b in bads]).cast("array<string>"), F.lit(many), F.lit(flag), F.lit(f0), 6.0).alias(n) for n, bads, many, flag, f0 in (("p", ["x"], False, False, 0.0), ("q", ["x"], True, True, 9.0), ("r", [], False, True, 2.0))]).first()
    assert tuple(row) == (True, False, True)


def test_spectrogram_has_its_peak_at_the_tone(spark):
    t = np.arange(512) / FS
    rows = spark.createDataFrame([(1, np.sin(2 * np.pi * 10 * t).tolist())], "vec_id long, x array<double>")
    out = chain.spectrogram(rows, FS).toPandas()
    assert (out.loc[out.groupby("t")["db"].idxmax(), "f"] == 10).all() and len(out["t"].unique()) == 15
    scale = chain.robust_scale(chain.spectrogram(rows, FS)).first()
    assert scale.lo < scale.hi


def test_plans_drop_but_do_not_refill(spark):
    rec = spark.createDataFrame([("s1", f"/c/s1/s001/{k}.edf", 250.0, True, 100.0, 0) for k in range(3)] + [("s2", "/c/s2/s001/9.edf", 250.0, False, 100.0, 0)], "subject string, path string, sfreq double, epilepsy boolean, duration double, n_seizure long")
    spans = spark.createDataFrame([("/c/s1/s001/0.edf", 0.0, 100.0, "bad"), ("/c/s1/s001/1.edf", 0.0, 5.0, "seiz")], "path string, start double, stop double, kind string")
    plan = lambda **k: cohort.data_module(rec, spans, 10.0, 10.0, {"train": 1.0}, 30, **k)
    whole = plan()
    assert whole.count() == 40 and {(r.subject, r.target) for r in whole.select("subject", "target").distinct().collect()} == {("s1", 1), ("s2", 0)}
    assert plan(drop_segments=True).count() == 30 and plan(drop_seizures=True).count() == 39
    assert plan(too_many=spark.createDataFrame([("/c/s2/s001/9.edf",)], "path string")).count() == 30
    assert cohort.permuted_files(rec, 2).count() == 2
    drawn = cohort.dictionary_windows(rec, 20.0, 4).toPandas()
    assert (drawn.groupby("subject").size() <= 4).all() and np.allclose(drawn["end"] - drawn["start"], 10) and (drawn["end"] <= 100).all()


def test_feature_columns_decode_to_their_slots(spark):
    shape, flat = (2, 2, 2, 3, 4), 0
    rows = spark.range(int(np.prod(shape))).withColumnRenamed("id", "k")
    out = rows.select("k", *[c.alias(n) for n, c in features.decoded(F.col("k"), (1, 2), 3, 4).items()]).orderBy("k").collect()
    for d, r, _, g, kernel in np.ndindex(*shape):
        assert tuple(out[flat])[1:] == ((1, 2)[d], r, g, kernel)
        flat += 1
    weights = features.by_weight(rows.withColumn("coef", F.lit(-2.0)), (1, 2), 3, 4, "sum").collect()
    assert len(weights) == 48 and {r.weight for r in weights} == {4.0}
    assert features.flat_coefficients([[1, -2]]) == [1.0, -2.0] and features.flat_coefficients([[1, -2], [3, 4]]) == [4.0, 6.0]
    assert features.sampling_rate(30720, 2) == 256.0


@pytest.mark.parametrize("down", [False, True])
def test_running_sums_over_parts_equal_one_pass(spark, down):
    from tidecohort.operators import ordered

    rng = np.random.default_rng(5)
    values = np.round(rng.normal(size=3000), 2)
    rows = spark.createDataFrame([(i, float(v), int(i % 3), int(i % 2)) for i, v in enumerate(values)], "id long, v double, w long, g int").repartition(7)
    out = ordered.running(rows, "v", {"upto": "w"}, by=["g"], ties=["id"], descending=down).toPandas()
    frame = out.sort_values(["g", "v", "id"], ascending=[True, not down, True])
    assert (frame.groupby("g")["w"].cumsum() == frame["upto"]).all()
    rank = ordered.ranked(rows, "v", "place", ["id"], down).toPandas().sort_values(["v", "id"], ascending=[not down, True])
    assert rank["place"].tolist() == list(range(1, 3001))
    lower = ordered.running(rows.select("v").distinct().withColumn("w", F.lit(1)), "v", {"n": "w"}, previous="lower").toPandas().sort_values("v")
    assert lower["n"].tolist() == list(range(1, len(lower) + 1))
    assert lower["lower"].tolist()[1:] == lower["v"].tolist()[:-1] and np.isnan(lower["lower"].iloc[0])


def test_band_lists():
    from tidecohort.operators import spectral

    assert [b[0] for b in spectral.band_list(edges=[8, 1, 4, 4])] == ["1-4", "4-8"]
    assert spectral.band_list(top=20.0)[-1] == ("beta", 13.0, 20.0) and spectral.band_list(use=False, top=9.0) == [("full", 0.0, 9.0)]
