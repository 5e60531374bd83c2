"""The signal chain over rows of windows, and its steps around component matrices.

A window is one row (key columns, ``names``: channel names, ``x``: channels of samples). Steps run in a fixed order inside one
Arrow-batched function, so nothing is shuffled and no recording is gathered: component removal, band-pass, notch, resampling,
renaming, interpolation of bad channels, artifact subtraction, bipolar pairs, choice of channels, margin, length. A window
that fails (no such channels, too few pairs) becomes zeros where ``zeros`` is set and null otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecohort.functions import scalars
from tidecohort.operators import signal

# Directions of the standard positions (unit sphere: x right, y front, z up), by azimuth and inclination in degrees.
POSITIONS = {
    "Fp1": (-18, 90), "Fpz": (0, 90), "Fp2": (18, 90), "F7": (-54, 90), "F3": (-39, 60), "Fz": (0, 45), "F4": (39, 60), "F8": (54, 90), "T3": (-90, 90), "C3": (-90, 45), "Cz": (0, 0), "C4": (90, 45),
    "T4": (90, 90), "T5": (-126, 90), "P3": (-141, 60), "Pz": (180, 45), "P4": (141, 60), "T6": (126, 90), "O1": (-162, 90), "Oz": (180, 90), "O2": (162, 90), "A1": (-90, 115), "A2": (90, 115),
}


def positions(names: list[str]) -> np.ndarray:
    """Unit vectors of channels; NaN for names without a standard position."""
    out = np.full((len(names), 3), np.nan)
    for i, name in enumerate(names):
        if name in POSITIONS:
            azimuth, inclination = np.radians(POSITIONS[name])
            out[i] = np.sin(azimuth) * np.sin(inclination), np.cos(azimuth) * np.sin(inclination), np.cos(inclination)
    return out


@dataclass(frozen=True)
class Chain:
    """What happens to a window; steps left at their default do nothing."""

    fs: float
    band: tuple[float | None, float | None] = (None, None)
    notch: tuple[float, ...] = ()
    target_fs: float | None = None
    interpolate: bool = False
    artifact_period_s: float | None = None
    n_average: int = 21
    pairs: tuple[tuple[str, str], ...] = ()
    least_pairs: int = signal.LEAST_PAIRS
    pick: tuple[str, ...] = ()
    margin_s: float = 0.0
    n_samples: int | None = None
    zeros: bool = True
    rename: dict = field(default_factory=lambda: {e.upper(): e for e in scalars.ELECTRODES})

    def canonical(self, name: str) -> str:
        bare = name.strip().upper().removeprefix("EEG ").removesuffix("-REF").removesuffix("-LE")
        return self.rename.get(bare, name.strip())

    def attempt(self, names: list[str], x, bad: list[str] = (), too_many: bool = False, **options) -> tuple[list[str] | None, np.ndarray | None, bool]:
        """Names, samples and True; or what ``failed`` gives where a step cannot be done."""
        try:
            data = np.stack([np.asarray(c, float) for c in x])
            done = self.apply(list(names), data, list(bad) if bad is not None else [], too_many, **options)
        except (ValueError, TypeError, np.linalg.LinAlgError):
            done = None
        if done is not None:
            return *done, True
        return self.failed(list(names) if names is not None else [], len(x[0]) if x is not None and len(x) and x[0] is not None else 0)

    def failed(self, names: list[str], width: int) -> tuple[list[str] | None, np.ndarray | None, bool]:
        """Zeros of the shape that the window would have, or nulls without ``zeros``."""
        if not self.zeros:
            return None, None, False
        names = list(self.pick) or [f"{a}-{c}" for a, c in self.pairs] or names
        return names, np.zeros((len(names), self.n_samples or width)), False

    def apply(self, names: list[str], x: np.ndarray, bad: list[str] = (), too_many: bool = False, fs: float | None = None, margins: tuple[float, float] | None = None, period_s: float | None = None) -> tuple[list[str], np.ndarray] | None:
        """Names and samples of the processed window, or None where a step cannot be done.

        ``fs`` is the window's own rate where it is not the chain's; ``margins`` are the seconds it has at either side beyond
        the window, where these differ from ``margin_s``; ``period_s`` is the period of its own artifact.
        """
        fs = self.fs if fs is None else fs
        if x.shape[-1] == 0:
            return None
        if any(self.band):
            x = signal.fir_bandpass(x, fs, *self.band)
        if self.notch:
            x = signal.notch(x, fs, list(self.notch))
        if self.target_fs and self.target_fs != fs:
            x, fs = signal.resample(x, fs, self.target_fs), self.target_fs
        names = [self.canonical(n) for n in names]
        if self.interpolate and not too_many:
            x = interpolated(names, x, [self.canonical(b) for b in bad])
        if period := period_s or self.artifact_period_s:
            x = signal.subtract_average_artifact(x, fs, period, self.n_average)
        if self.pairs:
            at = {n: i for i, n in enumerate(names)}
            formed = [(a, c) for a, c in self.pairs if a in at and c in at]
            if len(formed) < self.least_pairs:
                return None
            names, x = [f"{a}-{c}" for a, c in formed], np.stack([x[at[a]] - x[at[c]] for a, c in formed])
        if self.pick:
            if not set(self.pick) <= set(names):
                return None
            names, x = list(self.pick), x[[names.index(n) for n in self.pick]]
        left, right = (int(round(m * fs)) for m in margins or (self.margin_s, self.margin_s))
        x = x[:, left : x.shape[1] - right]
        if self.n_samples is not None:
            x = np.pad(x[:, : self.n_samples], ((0, 0), (0, max(0, self.n_samples - x.shape[1]))))
        return names, x


def interpolated(names: list[str], x: np.ndarray, bad: list[str]) -> np.ndarray:
    """Bad channels replaced by spherical splines over the good ones; channels without a position stay."""
    place = positions(names)
    known = ~np.isnan(place[:, 0])
    wrong = np.array([n in bad for n in names], bool) & known
    good = known & ~wrong
    if not wrong.any() or good.sum() < 4:
        return x
    out = x.copy()
    out[wrong] = signal.spherical_weights(place[good], place[wrong]) @ x[good]
    return out


def process(windows: DataFrame, chain: Chain, keys: list[str]) -> DataFrame:
    """(keys, names, x, ok) of windows (keys, names, x and, where known, bad and too_many)."""
    for name, default in (("bad", F.array().cast("array<string>")), ("too_many", F.lit(False))):
        windows = windows if name in windows.columns else windows.withColumn(name, default)
    types = {f.name: f.dataType.simpleString() for f in windows.schema}

    def run(batches):
        for frame in batches:
            found = [chain.attempt(own, x, bad, bool(many)) for own, x, bad, many in zip(frame["names"], frame["x"], frame["bad"], frame["too_many"], strict=True)]
            names, values, fine = [f[0] for f in found], [None if f[1] is None else f[1].tolist() for f in found], [f[2] for f in found]
            yield pd.DataFrame({**{k: frame[k] for k in keys}, "names": names, "x": values, "ok": fine})

    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "names array<string>", "x array<array<double>>", "ok boolean"])
    return windows.select(*keys, "names", "x", "bad", "too_many").mapInPandas(run, schema)


def pick_eeg(names: Column, x: Column) -> tuple[Column, Column]:
    """Names and samples of the channels that have a standard position (others are no EEG)."""
    known = F.array(*[F.lit(e) for e in scalars.ELECTRODES])
    both = F.filter(F.arrays_zip(F.transform(names, scalars.canonical_channel).alias("n"), x.alias("x")), lambda c: F.array_contains(known, c["n"]))
    return F.transform(both, lambda c: c["n"]), F.transform(both, lambda c: c["x"])


def electrode_positions(spark) -> DataFrame:
    """(channel, x, y, z): the standard positions as a small table to broadcast."""
    names = list(POSITIONS)
    return spark.createDataFrame([(n, *map(float, p)) for n, p in zip(names, positions(names), strict=True)], "channel string, x double, y double, z double")


def match_channels(channels: DataFrame, wanted: DataFrame, key: str = "path") -> DataFrame:
    """(key, complete, renames): how a recording's channels serve a decomposition's.

    ``channels`` and ``wanted`` have (key, channel). An exact superset needs no renames; otherwise names are matched by their
    letters and digits alone, the alphabetically first of several winning; ``complete`` is false where one has no match.
    """
    plain = lambda c: F.regexp_replace(F.lower(scalars.bare_channel(F.col(c))), "[^a-z0-9]", "")
    have = channels.select(F.col(key).alias("of"), F.col("channel").alias("mine"), plain("channel").alias("norm"))
    exact = wanted.join(have, (F.col(key) == F.col("of")) & (F.col("channel") == F.col("mine")), "left").groupBy(key).agg(F.bool_and(F.col("mine").isNotNull()).alias("exact"))
    first = have.groupBy("of", "norm").agg(F.min("mine").alias("mine"))
    by_norm = wanted.withColumn("wanted_norm", plain("channel")).join(first, (F.col(key) == F.col("of")) & (F.col("wanted_norm") == F.col("norm")), "left")
    found = by_norm.groupBy(key).agg(F.bool_and(F.col("mine").isNotNull()).alias("all_found"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("mine").isNotNull() & (F.col("mine") != F.col("channel")), F.struct("mine", "channel"))))).alias("renames"))
    nothing = F.create_map().cast("map<string,string>")
    return exact.join(found, key).select(key, (F.col("exact") | F.col("all_found")).alias("complete"), F.when(F.col("exact") | ~F.col("all_found"), nothing).otherwise(F.col("renames")).alias("renames"))


def without_components(x: Column, unmixing: Column, mixing: Column, drop: Column) -> Column:
    """Channels (C x T) without the back-projection of the components whose index is in ``drop``.

    ``unmixing`` is components x channels, ``mixing`` channels x components: x - mixing[:, drop] (unmixing[drop] x).
    """
    source = lambda k: F.aggregate(F.zip_with(F.get(unmixing, k), x, lambda w, c: F.transform(c, lambda v: v * w)), F.transform(F.get(x, F.lit(0)), lambda _: F.lit(0.0)), lambda a, c: F.zip_with(a, c, lambda p, q: p + q))
    sources = F.transform(drop, lambda k: F.struct(k.alias("k"), source(k).alias("s")))
    return F.transform(x, lambda c, i: F.aggregate(sources, c, lambda a, s: F.zip_with(a, s["s"], lambda v, u: v - F.get(F.get(mixing, i), s["k"]) * u)))


def regional_series(components: DataFrame, key: str = "path") -> DataFrame:
    """(key, region, n, x): per region the sum of its components' sources, each with the sign of its strongest topography.

    ``components`` has (key, ic, region, topography, x). All seven regions appear for each key, silent ones with zeros.
    """
    strongest = F.array_max(F.transform("topography", lambda v: F.struct(F.abs(v).alias("size"), v.alias("v"))))["v"]
    signed = components.select(key, "region", F.transform("x", lambda v: F.when(strongest < 0, -v).otherwise(v)).alias("x"))
    # Whole series are added up; the components of a decomposition bound the group.
    gathered = signed.groupBy(key, "region").agg(F.collect_list("x").alias("all"))
    zeros = F.array_repeat(F.lit(0.0), F.array_max(F.transform("all", F.size)))
    added = F.aggregate("all", zeros, lambda a, x: F.zip_with(a, x, lambda p, q: p + F.coalesce(q, F.lit(0.0))))
    series = gathered.select(key, "region", F.size("all").cast("long").alias("n"), added.alias("x"))
    lengths = components.groupBy(key).agg(F.max(F.size("x")).alias("length"))
    every = lengths.select(key, "length", F.explode(F.array(*[F.lit(r) for r in scalars.REGIONS])).alias("region"))
    return every.join(series, [key, "region"], "left").select(key, "region", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("x", F.array_repeat(F.lit(0.0), F.col("length"))).alias("x"))


def before_after(recordings: DataFrame, chain: Chain, nperseg: int, key: str = "path") -> DataFrame:
    """(key, channel, k, f, raw, repaired): spectra in decibels of each channel before and after the chain.

    ``recordings`` has (key, names, x), and ``bad``, ``too_many``, ``period_s`` and ``omit`` (spans in seconds) where known. Both
    spectra leave out the segments that touch a bad span. Pairs, which have no counterpart before, and channels of a failed
    chain have a null on the missing side.
    """
    for name, kind in (("bad", "array<string>"), ("too_many", "boolean"), ("period_s", "double"), ("omit", "array<struct<start:double,stop:double>>")):
        recordings = recordings if name in recordings.columns else recordings.withColumn(name, F.lit(None).cast(kind))
    kind = recordings.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                spans = [(s["start"], s["stop"]) for s in row["omit"] or []]
                raw = np.stack([np.asarray(c, float) for c in row["x"]])
                names, x, ok = chain.attempt(row["names"], raw, row["bad"], bool(row["too_many"]), period_s=row["period_s"])
                sides = [([chain.canonical(n) for n in row["names"]], *signal.welch(raw, chain.fs, nperseg, spans))]
                sides.append((names, *signal.welch(x, chain.target_fs or chain.fs, nperseg, spans)) if ok else ([], None, None))
                found: dict = {}
                for side, (own, freqs, power) in enumerate(sides):
                    for i, name in enumerate(own):
                        for k, (f, p) in enumerate(zip(freqs, power[i], strict=True)):
                            found.setdefault((name, k, float(f)), [None, None])[side] = None if np.isnan(p) else float(10 * np.log10(p + 1e-20))
                columns = [[row[key]] * len(found), *([list(c) for c in zip(*found, strict=True)] or [[], [], []]), [v[0] for v in found.values()], [v[1] for v in found.values()]]
                kinds = [batch.schema.field(key).type, pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "channel", "k", "f", "raw", "repaired"])

    wanted = recordings.select(key, "names", "x", "bad", "too_many", "period_s", "omit")
    return wanted.mapInArrow(run, f"`{key}` {kind}, channel string, k int, f double, raw double, repaired double")


def aligned(names: Column, x: Column, wanted: Column, renames: Column | None = None) -> Column:
    """Channels in the order of ``wanted`` (a decomposition's), renamed before, with the average reference over them.

    Null where a wanted channel is missing. ``renames`` is a map as ``match_channels`` gives it.
    """
    own = names if renames is None else F.transform(names, lambda n: F.coalesce(renames[n], n))
    place = lambda w: F.array_position(own, w).cast("int")
    picked = F.transform(wanted, lambda w: F.get(x, place(w) - 1))
    return F.when(F.forall(wanted, lambda w: place(w) > 0), signal.average_reference(picked))


def component_bags(components: DataFrame, max_k: int, rank_by: str = "variance", sign: bool = True, key: str = "path") -> DataFrame:
    """(key, n, names, x): the ``max_k`` first components of each key as a bag of fixed size, filled up with zeros.

    ``components`` has (key, ic, topography, x) and ``prob`` where bags are ranked by it. With ``sign`` a component whose
    strongest projection is negative is turned. Components rank by population variance or by ``prob``, ties by ic; a
    decomposition bounds the group.
    """
    strongest = F.array_max(F.transform("topography", lambda v, i: F.struct(F.abs(v).alias("size"), (-i).alias("first"), v.alias("v"))))["v"]
    rows = components.withColumn("x", F.when(F.lit(sign) & (strongest < 0), F.transform("x", lambda v: -v)).otherwise(F.col("x")))
    n = F.size("x")
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / n
    variance = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    rank = F.col("prob") if rank_by == "prob" and "prob" in components.columns else variance
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rank"), "ic"))
    kept = rows.withColumn("rank", rank).withColumn("place", place).filter(F.col("place") <= max_k)
    bags = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda c: c["x"]).alias("bag"))
    zeros = F.transform(F.get("bag", F.lit(0)), lambda _: F.lit(0.0))
    return bags.select(key, F.size("bag").alias("n"), F.array(*[F.lit(f"ic_{i}") for i in range(max_k)]).alias("names"), F.slice(F.concat("bag", F.array_repeat(zeros, max_k)), 1, max_k).alias("x"))


def spectrogram(windows: DataFrame, fs: float, seconds: float = 1.0, least: int = 64, taper: float = 0.25, keys: tuple[str, ...] = ("vec_id",), power: bool = False) -> DataFrame:
    """(keys, t, f, db) of signals (keys, x): half-overlapping Tukey-tapered segments of about ``seconds``; ``p`` with ``power``.

    Rows of one signal leave together; a batch is transformed signal by signal, as lengths may differ.
    """
    rows, value = windows.select(*keys, "x"), "p" if power else "db"
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "x"], "t double", "f double", f"{value} double"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.asarray(batch.column("x")[i].values).astype(float)
                n = min(max(least, int(seconds * fs)), len(x))
                ramp = np.minimum(np.arange(n), np.arange(n)[::-1]) / max(taper * (n - 1) / 2, 1e-12)
                window = np.where(ramp < 1, 0.5 * (1 - np.cos(np.pi * ramp)), 1.0)
                starts = np.arange(0, len(x) - n + 1, max(n - n // 2, 1))
                parts = np.stack([x[s : s + n] for s in starts])
                density = np.abs(np.fft.rfft((parts - parts.mean(-1, keepdims=True)) * window)) ** 2 / (fs * (window**2).sum())
                density[:, 1 : None if n % 2 else -1] *= 2
                times, freqs = (starts + n / 2) / fs, np.fft.rfftfreq(n, 1 / fs)
                out = density.ravel() if power else 10 * np.log10(density.ravel() + 1e-20)
                own = [pa.array([batch.column(k)[i].as_py()] * len(out), batch.schema.field(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.repeat(times, len(freqs))), pa.array(np.tile(freqs, len(times))), pa.array(out)], names=[*keys, "t", "f", value])

    return rows.mapInArrow(run, schema)


def band_series(spectrograms: DataFrame, low: float, high: float, key: str = "path") -> DataFrame:
    """(key, t, power): mean power of the bins of a band (ends included) over all channels, of (key, ..., t, f, p)."""
    return spectrograms.filter(F.col("f").between(low, high)).groupBy(key, "t").agg(F.avg("p").alias("power"))


def worst_channel(spectra: DataFrame, low: float, high: float, key: str = "path") -> DataFrame:
    """(key, ch, energy): the channel with the most power in a band, of spectra (key, ch, f, p); the first of equals."""
    energy = spectra.filter(F.col("f").between(low, high)).groupBy(key, "ch").agg(F.sum("p").alias("energy"))
    best = energy.groupBy(key).agg(F.max_by(F.struct("ch", "energy"), F.struct("energy", -F.col("ch"))).alias("b"))
    return best.select(key, "b.ch", "b.energy")


def hot_segments(series: DataFrame, lengths: DataFrame, fs: float, seconds: float, hottest: int = 5, key: str = "path") -> DataFrame:
    """(key, kind, place, start, power): the hottest segments of a band series and, as ``baseline``, the coldest.

    Segments are whole tiles of ``seconds`` of a recording of ``lengths`` (key, n) samples; one tile alone gives no rows, and
    with few tiles the coldest repeats. Ties go to the earlier tile.
    """
    tile = round(seconds * fs)
    tiles = series.join(lengths, key).withColumn("tile", F.floor(F.round(F.col("t") * F.lit(fs), 6) / tile)).filter((F.col("tile") < F.floor(F.col("n") / tile)) & (F.col("n") >= 2 * tile))
    means = tiles.groupBy(key, "tile").agg(F.avg("power").alias("power"))
    of = Window.partitionBy(key)
    ranked = means.withColumns({"hot": F.row_number().over(of.orderBy(F.desc("power"), "tile")), "cold": F.row_number().over(of.orderBy("power", F.desc("tile")))})
    start = (F.col("tile") * F.lit(tile / fs)).alias("start")
    hot = ranked.filter(F.col("hot") <= hottest).select(key, F.lit("hot").alias("kind"), F.col("hot").alias("place"), start, "power")
    return hot.unionByName(ranked.filter("cold = 1").select(key, F.lit("baseline").alias("kind"), F.lit(1).alias("place"), start, "power"))


def robust_scale(spectrogram: DataFrame, low: float = 0.05, high: float = 0.99) -> DataFrame:
    """(vec_id, lo, hi): percentiles between which a spectrogram's decibels are drawn."""
    return spectrogram.groupBy("vec_id").agg(F.percentile("db", low).alias("lo"), F.percentile("db", high).alias("hi"))


def decibels(p: Column) -> Column:
    """A power spectrum in dB."""
    return F.transform(p, lambda v: F.lit(10.0) * F.log10(v + F.lit(1e-20)))
