"""Signals as arrays: short steps as higher-order functions, filters and spectra as Arrow-batched numpy.

Arrow functions work on one signal per row (path, ch, x) and hold one batch at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 22 bipolar pairs of the longitudinal montage.
PAIRS = [
    ("Fp1", "F7"), ("F7", "T3"), ("T3", "T5"), ("T5", "O1"), ("Fp2", "F8"), ("F8", "T4"), ("T4", "T6"), ("T6", "O2"), ("A1", "T3"), ("T3", "C3"), ("C3", "Cz"),
    ("Cz", "C4"), ("C4", "T4"), ("T4", "A2"), ("Fp1", "F3"), ("F3", "C3"), ("C3", "P3"), ("P3", "O1"), ("Fp2", "F4"), ("F4", "C4"), ("C4", "P4"), ("P4", "O2"),
]
LEAST_PAIRS = 18


def crop(x: Column, start: Column, end: Column, fs: float) -> Column:
    """Samples of [start, end) seconds, clamped to the signal (its last sample is never reached)."""
    last = (F.size(x) - 1) / F.lit(float(fs))
    low, high = F.greatest(start, F.lit(0.0)), F.least(end, last)
    first = F.bround(low * fs).cast("int")
    return F.slice(x, first + 1, F.greatest(F.bround(high * fs).cast("int") - first, F.lit(0)))


def fit_length(x: Column, n: int) -> Column:
    """Exactly n samples: cut on the right or padded with zeros."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), n)), 1, n)


def difference(x: Column) -> Column:
    """First difference, one sample shorter."""
    return F.zip_with(F.slice(x, F.lit(2), F.size(x) - 1), F.slice(x, F.lit(1), F.size(x) - 1), lambda b, a: b - a)


def average_reference(channels: Column) -> Column:
    """Every channel minus the mean of all channels, sample by sample (array of equal-length arrays)."""
    zero = F.transform(F.get(channels, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(channels, zero, lambda acc, c: F.zip_with(acc, c, lambda a, b: a + b))
    return F.transform(channels, lambda c: F.zip_with(c, total, lambda v, t: v - t / F.size(channels)))


def bipolar(signals: Column, pairs: list[tuple[str, str]] = PAIRS, least: int = LEAST_PAIRS) -> Column:
    """Map of ``anode-cathode`` differences of a map of channels; null when fewer than ``least`` pairs can be formed."""
    entries = F.array(*[F.when(signals[a].isNotNull() & signals[c].isNotNull(), F.struct(F.lit(f"{a}-{c}").alias("key"), F.zip_with(signals[a], signals[c], lambda p, q: p - q).alias("value"))) for a, c in pairs])
    formed = F.filter(entries, lambda e: e.isNotNull())
    return F.when(F.size(formed) >= least, F.map_from_entries(formed))


def by_length(x: pa.Array, transform) -> pa.Array:
    """Arrays (n, out) of ``transform`` over the signals of a batch, equal lengths stacked to (n, time); null stays null."""
    out: list = [None] * len(x)
    valid = np.flatnonzero(np.asarray(x.is_valid()))
    lengths = np.asarray(pc.list_value_length(x.drop_null())).astype(int)
    values, ends = np.asarray(x.drop_null().flatten()).astype(float), np.cumsum(lengths)
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        for place, row in zip(valid[own], transform(np.stack([values[ends[i] - n : ends[i]] for i in own])), strict=True):
            out[place] = row
    return pa.array(out, pa.list_(pa.float64()))


def without_artifact(x: Column, fs: float, period_s: float, n_avg: int = 21) -> Column:
    """Signals without their average artifact, in Arrow batches of stacked signals."""

    @F.arrow_udf("array<double>")
    def subtract(signals: pa.Array) -> pa.Array:
        return by_length(signals, lambda stack: subtract_average_artifact(stack, fs, period_s, n_avg))

    return subtract(x)


def spectrum(x: Column, fs: float, nperseg: int) -> Column:
    """Welch spectra of signals, in Arrow batches of stacked signals."""

    @F.arrow_udf("array<double>")
    def estimate(signals: pa.Array) -> pa.Array:
        return by_length(signals, lambda stack: welch(stack, fs, nperseg)[1])

    return estimate(x)


def subtract_average_artifact(x: np.ndarray, fs: float, period_s: float, n_avg: int = 21) -> np.ndarray:
    """Average artifact subtraction along the last axis: every period minus the mean of ``n_avg`` original periods around it.

    The mean starts ``n_avg // 2`` periods before, at the first period at least, and ends with the signal. Short signals come
    back unchanged, and the rest after the last whole period stays.
    """
    period = int(round(period_s * fs))
    if period < 4 or x.shape[-1] < 3 * period:
        return x
    n = x.shape[-1] // period
    tiles = x[..., : n * period].reshape(*x.shape[:-1], n, period)
    sums = np.concatenate([np.zeros_like(tiles[..., :1, :]), np.cumsum(tiles, axis=-2)], axis=-2)
    low = np.maximum(np.arange(n) - n_avg // 2, 0)
    high = np.minimum(low + n_avg, n)
    means = (sums[..., high, :] - sums[..., low, :]) / (high - low)[:, None]
    return np.concatenate([(tiles - means).reshape(*x.shape[:-1], n * period), x[..., n * period :]], axis=-1)


def fir_bandpass(x: np.ndarray, fs: float, low: float | None, high: float | None) -> np.ndarray:
    """Zero-phase windowed-sinc FIR band-pass; reflects the ends."""
    edge = min(v for v in (low, (fs / 2 - high) if high else None, fs / 4) if v)
    taps = min(int(3.3 * fs / max(edge * 0.5, 0.5)) | 1, (2 * (x.shape[-1] - 1)) - 1 | 1)
    k = np.arange(taps) - taps // 2
    window = np.hamming(taps)

    def lowpass(cut):
        h = 2 * cut / fs * np.sinc(2 * cut / fs * k) * window
        return h / h.sum()

    h = lowpass(high) if high and high < fs / 2 else (k == 0).astype(float)
    if low:
        h = h - lowpass(low)
    half = taps // 2
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(half, half)], mode="reflect" if x.shape[-1] > half else "symmetric")
    n = padded.shape[-1] + taps - 1
    out = np.fft.irfft(np.fft.rfft(padded, n) * np.fft.rfft(h, n), n)
    return out[..., 2 * half : 2 * half + x.shape[-1]]


def notch(x: np.ndarray, fs: float, freqs: list[float], width: float = 1.0) -> np.ndarray:
    """Remove narrow bands around frequencies below Nyquist in the Fourier domain."""
    spectrum, f = np.fft.rfft(x), np.fft.rfftfreq(x.shape[-1], 1 / fs)
    for freq in freqs:
        if freq < fs / 2:
            spectrum = spectrum * (1 - np.exp(-0.5 * ((f - freq) / (width / 2)) ** 8))
    return np.fft.irfft(spectrum, x.shape[-1])


def resample(x: np.ndarray, fs: float, target: float) -> np.ndarray:
    """Fourier resampling: the spectrum is cut or padded with zeros."""
    n, m = x.shape[-1], int(round(x.shape[-1] * target / fs))
    spectrum = np.fft.rfft(x)[..., : m // 2 + 1]
    if m % 2 == 0 and m < n:
        spectrum[..., -1] = spectrum[..., -1].real
    return np.fft.irfft(spectrum, m) * (m / n)


def welch(x: np.ndarray, fs: float, nperseg: int, omit: list[tuple[float, float]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Welch density: Hann segments with half overlap, constant detrend, one-sided, mean over segments.

    Segments that touch a span of ``omit`` (seconds, end exclusive) are left out; NaN where none is left.
    """
    nperseg = min(nperseg, x.shape[-1])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    step = nperseg - nperseg // 2
    starts = [s for s in range(0, x.shape[-1] - nperseg + 1, step) if not any(s < b * fs and s + nperseg > a * fs for a, b in omit)]
    if not starts:
        return np.fft.rfftfreq(nperseg, 1 / fs), np.full((*x.shape[:-1], nperseg // 2 + 1), np.nan)
    parts = np.stack([x[..., s : s + nperseg] for s in starts], axis=-2)
    parts = (parts - parts.mean(-1, keepdims=True)) * window
    power = (np.abs(np.fft.rfft(parts)) ** 2).mean(-2) / (fs * (window**2).sum())
    power[..., 1 : None if nperseg % 2 else -1] *= 2
    return np.fft.rfftfreq(nperseg, 1 / fs), power


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Biased autocorrelation of mean-free signals along the last axis, 1 at lag 0; silent signals give 0."""
    n = x.shape[-1]
    x = x - x.mean(-1, keepdims=True)
    acf = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n)) ** 2, 2 * n)[..., :n]
    energy = acf[..., :1]
    return np.where(energy > 0, acf / np.where(energy > 0, energy, 1), 0.0)


def periodicity(x: np.ndarray, fs: float, fmin: float = 0.5, fmax: float = 6.0, parts: int = 5, enough: float = 0.6) -> tuple[float | None, float]:
    """(fundamental Hz, strength) of a common period: peak of the channels' mean autocorrelation between two frequencies.

    A comb with a shorter period peaks at every multiple of it. All whole fractions of the peak's lag (down to one of
    ``parts``) are scored at once by the best of their three nearest lags; the shortest that holds ``enough`` of the peak wins.
    """
    acf = autocorrelation(np.atleast_2d(x))
    acf = acf[acf[:, 0] > 0]
    if not len(acf):
        return None, 0.0
    mean = acf.mean(0)
    low, high = max(int(fs / fmax), 1), min(len(mean), int(fs / fmin))
    if high <= low:
        return None, 0.0
    lag = low + int(mean[low:high].argmax())
    around = np.rint(lag / np.arange(parts, 0, -1)).astype(int)[:, None] + np.arange(-1, 2)
    around[-1] = lag
    held = np.where((around >= 1) & (around < len(mean)), mean[np.clip(around, 0, len(mean) - 1)], -np.inf)
    fits = (around[:, 1] >= low) & (held.max(1) >= enough * mean[lag])
    first = int(np.flatnonzero(fits)[0]) if fits.any() else parts - 1
    return fs / int(around[first, held[first].argmax()]), float(mean[lag])


def spherical_weights(known: np.ndarray, wanted: np.ndarray, stiffness: int = 4, terms: int = 50) -> np.ndarray:
    """Spline weights (wanted x known) on the unit sphere by the Legendre expansion of the spline kernel."""

    def kernel(a, b):
        cos = np.clip(a @ b.T, -1, 1)
        k = np.arange(1, terms + 1)
        factors = np.concatenate([[0], (2 * k + 1) / (k**stiffness * (k + 1.0) ** stiffness * 4 * np.pi)])
        return np.polynomial.legendre.legval(cos, factors)

    n = len(known)
    system = np.ones((n + 1, n + 1))
    system[:n, :n], system[n, n] = kernel(known, known) + 1e-5 * np.eye(n), 0
    right = np.concatenate([kernel(wanted, known), np.ones((len(wanted), 1))], axis=1)
    return (right @ np.linalg.pinv(system))[:, :n]


def spectra(signals: DataFrame, fs: float, nperseg: int) -> DataFrame:
    """(vec_id, p): Welch spectra of (vec_id, x)."""
    return signals.select("vec_id", spectrum(F.col("x"), fs, nperseg).alias("p"))


def stacked(channels: Column, n_channels: int, n: int) -> Column:
    """A window as single floats of a stated shape, for a tensor of equal windows; null where it has another shape."""
    fits = (F.size(channels) == n_channels) & F.forall(channels, lambda c: F.size(c) == n)
    return F.when(fits, F.transform(channels, lambda c: c.cast("array<float>")))


def periods(signals: DataFrame, fs: float, fmin: float = 0.5, fmax: float = 6.0) -> DataFrame:
    """(vec_id, f0, strength, cardiac_like, flagged) of (vec_id, x); flagged is strong and not at the band's upper edge."""

    def run(batches):
        for frame in batches:
            found = [periodicity(np.asarray(x, float), fs, fmin, fmax) for x in frame["x"]]
            f0, strength = [f for f, _ in found], [s for _, s in found]
            yield pd.DataFrame({"vec_id": frame["vec_id"], "f0": f0, "strength": strength, "cardiac_like": [f is not None and 0.7 <= f <= 2.0 for f in f0], "flagged": [f is not None and s >= 0.5 and f < 0.92 * fmax for f, s in found]})

    return signals.select("vec_id", "x").mapInPandas(run, "vec_id long, f0 double, strength double, cardiac_like boolean, flagged boolean")
