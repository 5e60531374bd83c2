"""Bad channels and bad segments: as plans over channels and tiles, and as the whole detection of a recording.

Criteria: a channel is bad when it is flat or holds a value that is no number, when its robust amplitude deviates from that of
the recording's channels, or when in too many windows it correlates with no other channel. What the analysed detector draws at
random (predicting channels from samples of others) is not built.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecohort.operators import signal
from tidecohort.operators.features import stacks

#: A recording with a larger share of bad channels, or with fewer channels than this, is beyond repair.
MOST_BAD, LEAST_CHANNELS = 0.3, 4
#: 0.7413 times the interquartile range estimates a standard deviation.
ROBUST = 0.7413


def quantile(ordered: Column, q: float) -> Column:
    """A quantile of a sorted array, between its two nearest values."""
    at = F.lit(q) * (F.size(ordered) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return a + (b - a) * (at - low)


def channel_flags(channels: DataFrame, key: str = "path", most_z: float = 5.0, flat: float = 1e-9) -> DataFrame:
    """(key, ch, amplitude, z, bad) of channels (key, ch, x).

    A channel is bad when it is flat or holds a value that is no number, or when its robust amplitude (0.7413 of the
    interquartile range) lies more than ``most_z`` robust deviations from the median of its recording's channels. Quartiles are
    taken inside the row; what is grouped is one number a channel.
    """
    ordered = channels.select(key, "ch", F.array_sort("x").alias("o"), F.exists("x", F.isnan).alias("nan"))
    sized = ordered.select(key, "ch", (F.lit(ROBUST) * (quantile(F.col("o"), 0.75) - quantile(F.col("o"), 0.25))).alias("amplitude"), "nan")
    of = sized.groupBy(key).agg(F.percentile("amplitude", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("a"))
    spread = F.lit(ROBUST) * (F.get("a", F.lit(2)) - F.get("a", F.lit(0)))
    z = F.when(spread > 0, (F.col("amplitude") - F.get("a", F.lit(1))) / spread).otherwise(F.lit(0.0))
    judged = sized.join(of, key).select(key, "ch", "amplitude", z.alias("z"), "nan")
    return judged.withColumn("bad", F.col("nan") | (F.col("amplitude") < flat) | (F.abs("z") > most_z)).drop("nan")


def best_correlations(x: np.ndarray, window: int) -> np.ndarray:
    """(..., windows, channels): the largest absolute correlation of each channel with any other, window by window.

    One matrix product for all windows of recordings (..., channels, time); a constant channel correlates with none.
    """
    n = x.shape[-1] // window
    parts = np.moveaxis(x[..., : n * window].reshape(*x.shape[:-1], n, window), -2, -3)
    parts = parts - parts.mean(-1, keepdims=True)
    norm = np.sqrt((parts**2).sum(-1, keepdims=True))
    unit = np.where(norm > 0, parts / np.where(norm > 0, norm, 1), 0.0)
    corr = np.abs(unit @ np.swapaxes(unit, -1, -2))
    corr[..., np.arange(x.shape[-2]), np.arange(x.shape[-2])] = 0.0
    return corr.max(-1, initial=0.0)


def correlation_flags(recordings: DataFrame, window: int, least: float = 0.4, most_share: float = 0.01, key: str = "path") -> DataFrame:
    """(key, ch, low, bad) of recordings (key, x: channels of samples).

    ``low`` is the share of windows in which the channel's best correlation is below ``least``; above ``most_share`` it is bad.
    """

    @F.arrow_udf("array<double>")
    def shares(x: pa.Array) -> pa.Array:
        out: list = [None] * len(x)
        for places, stack in stacks(x):
            for place, low in zip(places, (best_correlations(stack, window) < least).mean(-2), strict=True):
                out[place] = low
        return pa.array(out, pa.list_(pa.float64()))

    rows = recordings.select(key, F.posexplode(shares(F.col("x"))).alias("ch", "low"))
    return rows.withColumn("bad", F.col("low") > F.lit(most_share))


def too_many(flags: DataFrame, key: str = "path") -> DataFrame:
    """(key, n_channels, bads, too_many): bad channels by name, and whether the recording is beyond repair."""
    counted = flags.groupBy(key).agg(F.count("*").alias("n_channels"), F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("ch")))).alias("bads"))
    return counted.withColumn("too_many", (F.col("n_channels") < LEAST_CHANNELS) | (F.size("bads") > F.lit(MOST_BAD) * F.col("n_channels")))


def bad_segments(channels: DataFrame, flags: DataFrame, fs: float, tile: int, most_peak: float, least_peak: float = 0.0, key: str = "path") -> DataFrame:
    """(key, start, stop): stretches of tiles in which a good channel peaks or is flat, neighbouring tiles joined.

    Tiles are judged inside the row; only bad ones leave it. Gaps and islands: a tile opens a stretch unless the tile before it
    is bad too.
    """
    good = channels.join(flags.filter("NOT bad").select(key, "ch"), [key, "ch"])
    part = lambda i: F.slice("x", i * tile + 1, tile)
    peaks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("x") / tile).cast("int") - 1), lambda i: F.struct(i.alias("tile"), (F.array_max(part(i)) - F.array_min(part(i))).alias("peak")))
    found = good.filter(F.size("x") > 0).select(key, F.explode(F.filter(peaks, lambda p: (p["peak"] > most_peak) | (p["peak"] <= least_peak))).alias("p"))
    bad = found.select(key, F.col("p.tile").cast("long").alias("tile")).distinct()
    island = F.col("tile") - F.row_number().over(Window.partitionBy(key).orderBy("tile"))
    width = F.lit(tile / fs)
    return bad.withColumn("island", island).groupBy(key, "island").agg((F.min("tile") * width).alias("start"), ((F.max("tile") + 1) * width).alias("stop")).drop("island")


@dataclass(frozen=True)
class Detector:
    """The whole detection of one recording; frequencies in Hz, amplitudes in the signal's unit, windows and tiles in seconds."""

    high_pass: float | None = 1.0
    notch: tuple[float, ...] = ()
    fmin: float = 0.5
    fmax: float = 6.0
    strength: float = 0.5
    subtract: bool = False
    most_subtracted: float = 2.5
    most_z: float = 5.0
    flat: float = 1e-9
    window_s: float = 1.0
    least_correlation: float = 0.4
    most_share: float = 0.01
    tile_s: float = 0.1
    most_peak: float = 5e-4
    least_peak: float = 0.0

    def detect(self, x: np.ndarray, fs: float) -> dict:
        """Bad channels (places), too_many, bad segments and the periodic artifact of channels (channels, time).

        All is measured on a filtered copy. The artifact comes first: where it is strong, inside the band and slow enough it is
        subtracted, so that channels that only share it are not flagged.
        """
        if len(x) < LEAST_CHANNELS:
            return {"n_channels": len(x), "bads": [], "too_many": True, "segments": [], "f0": None, "strength": 0.0, "flagged": False, "subtracted": False}
        wrong = ~np.isfinite(x).all(-1)
        x = np.where(wrong[:, None], 0.0, x)
        if self.high_pass:
            x = signal.fir_bandpass(x, fs, self.high_pass, None)
        if self.notch:
            x = signal.notch(x, fs, list(self.notch))
        f0, strength = signal.periodicity(x, fs, self.fmin, self.fmax)
        flagged = f0 is not None and strength >= self.strength and f0 < 0.92 * self.fmax
        subtracted = bool(self.subtract and flagged and f0 <= self.most_subtracted)
        if subtracted:
            x = signal.subtract_average_artifact(x, fs, 1 / f0)
        quartiles = np.quantile(x, [0.25, 0.75], axis=-1)
        amplitude = ROBUST * (quartiles[1] - quartiles[0])
        q = np.quantile(amplitude, [0.25, 0.5, 0.75])
        spread = ROBUST * (q[2] - q[0])
        z = (amplitude - q[1]) / spread if spread > 0 else np.zeros(len(x))
        low = (best_correlations(x, max(1, round(self.window_s * fs))) < self.least_correlation)
        bad = wrong | (amplitude < self.flat) | (np.abs(z) > self.most_z) | ((low.mean(0) > self.most_share) if len(low) else False)
        return {"n_channels": len(x), "bads": np.flatnonzero(bad).tolist(), "too_many": bool(bad.mean() > MOST_BAD), "segments": self.segments(x[~bad], fs), "f0": f0, "strength": strength, "flagged": bool(flagged), "subtracted": subtracted}

    def segments(self, x: np.ndarray, fs: float) -> list[dict]:
        """Stretches of tiles in which a channel peaks or is flat."""
        tile = max(1, round(self.tile_s * fs))
        if not x.size:
            return []
        starts = np.arange(0, x.shape[1], tile)
        peak = np.maximum.reduceat(x, starts, axis=1) - np.minimum.reduceat(x, starts, axis=1)
        bad = ((peak > self.most_peak) | (peak <= self.least_peak)).any(0).astype(int)
        edges = np.diff(np.concatenate([[0], bad, [0]]))
        return [{"start": a * tile / fs, "stop": b * tile / fs} for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)]


FOUND = "n_channels int, bads array<int>, too_many boolean, segments array<struct<start:double,stop:double>>, f0 double, strength double, flagged boolean, subtracted boolean"


def detected(recordings: DataFrame, detector: Detector, fs: float, key: str = "path") -> DataFrame:
    """(key, names of bad channels and what ``FOUND`` lists) of recordings (key, names, x); a task holds one recording at a time."""
    struct = pa.struct([("start", pa.float64()), ("stop", pa.float64())])
    kinds = {"n_channels": pa.int32(), "bads": pa.list_(pa.int32()), "too_many": pa.bool_(), "segments": pa.list_(struct), "f0": pa.float64(), "strength": pa.float64(), "flagged": pa.bool_(), "subtracted": pa.bool_()}

    @F.arrow_udf(f"struct<{FOUND.replace(' ', ':').replace(',:', ',')}>")
    def find(x: pa.Array) -> pa.Array:
        out: list = [None] * len(x)
        for places, stack in stacks(x):
            for place, own in zip(places, stack, strict=True):
                out[place] = detector.detect(own, fs)
        return pa.array(out, pa.struct(list(kinds.items())))

    rows = recordings.select(key, "names", find(F.col("x")).alias("found")).select(key, "names", "found.*")
    return rows.withColumn("bads", F.array_sort(F.transform("bads", lambda i: F.get("names", i)))).drop("names")


def affected(bads: Column, too_many: Column, flagged: Column, f0: Column, fmax: float) -> Column:
    """Whether repair changes a recording: bad channels that can be interpolated, or a periodic artifact that is subtracted."""
    return F.coalesce((F.size(bads) > 0) & ~too_many, F.lit(False)) | F.coalesce(flagged & (f0 > 0) & (f0 <= F.lit(float(fmax))), F.lit(False))


def sidecars(flags: DataFrame, segments: DataFrame, periods: DataFrame | None = None, key: str = "path") -> DataFrame:
    """One row per recording as the sidecar keeps it: bads, too_many, segments and, where measured, the periodic artifact."""
    spans = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("segments"))
    whole = too_many(flags, key).join(spans, key, "left")
    if periods is not None:
        whole = whole.join(periods.select(key, F.struct("f0", "strength", "flagged").alias("periodic")), key, "left")
    return whole.withColumn("segments", F.coalesce("segments", F.array().cast("array<struct<start:double,stop:double>>")))
