"""Random competing-convolution features and rankings of their kernels.

A bank holds, for each dilation and representation (raw, first difference), groups of kernels with nine taps. At every time
the kernels of a group compete: the largest response adds its value to the winner's soft slot, the smallest response counts
one in its hard slot. Kernels are drawn by numpy from a seed; they are deterministic, and equal to no other library's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAPS = 9
#: Numbers of a block of responses that is held at once.
BLOCK = 1 << 22


class Bank:
    """Kernels for signals of ``length`` samples and ``channels`` channels: weights (dilation, representation, group, kernel, tap)."""

    def __init__(self, length: int, channels: int, kernels: int = 8, groups: int = 64, most_channels: int = 8, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.dilations = 2 ** np.arange(max(int(np.log2(max((length - 1) / (TAPS - 1), 1))), 0) + 1)
        self.representations = min(2, groups)
        self.groups, self.kernels = groups // self.representations, kernels
        shape = (len(self.dilations), self.representations, self.groups)
        w = rng.standard_normal((*shape, kernels, TAPS))
        w -= w.mean(-1, keepdims=True)
        self.weights = w / np.abs(w).sum(-1, keepdims=True)
        self.channels = rng.integers(0, channels, (*shape, int(np.clip(channels // 2, 2, most_channels))))

    @property
    def width(self) -> int:
        return len(self.dilations) * self.representations * 2 * self.groups * self.kernels

    def responses(self, x: np.ndarray, d: int, r: int) -> np.ndarray:
        """(..., group, kernel, time) correlations of signals (..., channels, time), zero-padded to their length."""
        z = np.diff(x, axis=-1) if r else x
        mixed = z[..., self.channels[d, r], :].sum(-2) if x.shape[-2] > 1 else np.repeat(z, self.groups, axis=-2)
        step, n = int(self.dilations[d]), z.shape[-1]
        pad = (TAPS - 1) * step // 2
        padded = np.pad(mixed, [(0, 0)] * (mixed.ndim - 1) + [(pad, pad)])
        taps = np.stack([padded[..., k * step : k * step + n] for k in range(TAPS)], axis=-2)
        return np.einsum("gkt,...gtn->...gkn", self.weights[d, r], taps)

    def winners(self, x: np.ndarray):
        """For each dilation and representation of signals (..., channels, time): soft sums and hard counts (..., group * kernel)."""
        many, slots = int(np.prod(x.shape[:-2])), self.groups * self.kernels
        slot = np.arange(many * self.groups).reshape(*x.shape[:-2], self.groups, 1) * self.kernels
        for d in range(len(self.dilations)):
            for r in range(self.representations):
                a = self.responses(x, d, r)
                top, low = a.argmax(-2), a.argmin(-2)
                values = np.take_along_axis(a, top[..., None, :], -2)[..., 0, :]
                shaped = lambda counts: counts.reshape(*x.shape[:-2], slots)  # noqa: E731, B023
                yield d, r, shaped(np.bincount((slot + top).ravel(), values.ravel(), many * slots)), shaped(np.bincount((slot + low).ravel(), minlength=many * slots))

    def features(self, x: np.ndarray, kind: type = np.float32) -> np.ndarray:
        """(..., width) features of signals (..., channels, time); stacks are taken in blocks of bounded size."""
        if x.ndim > 2 and len(x) > (block := max(1, BLOCK // max(1, self.groups * TAPS * x.shape[-1]))):
            return np.concatenate([self.features(x[i : i + block], kind) for i in range(0, len(x), block)])
        return np.concatenate([np.concatenate([soft, hard], axis=-1) for _, _, soft, hard in self.winners(x)], axis=-1).astype(kind)

    def rows(self) -> list[tuple]:
        """(flat, dilation, diff, grp, kernel, weights) of every kernel."""
        flat = np.ndindex(*self.weights.shape[:-1])
        return [(i, int(self.dilations[d]), int(r), int(g), int(k), self.weights[d, r, g, k].tolist()) for i, (d, r, g, k) in enumerate(flat)]


def stacks(windows: pa.Array):
    """Places and samples (windows, channels, time) of an Arrow array of windows, one stack for each shape; nulls are left out."""
    places = np.flatnonzero(np.asarray(windows.is_valid()))
    channels = windows.flatten()
    n_channels = np.asarray(pc.list_value_length(windows.drop_null())).astype(int)
    lengths = np.asarray(pc.list_value_length(channels)).astype(int)
    values = np.asarray(channels.flatten()).astype(float)
    first = np.concatenate([[0], np.cumsum(n_channels)])
    at = np.concatenate([[0], np.cumsum(lengths)])
    shapes = [(c, *set(lengths[a : a + c].tolist())) for a, c in zip(first[:-1], n_channels, strict=True)]
    for shape in dict.fromkeys(shapes):
        if len(shape) != 2:
            raise ValueError(f"a window of {shape[0]} channels has channels of lengths {sorted(shape[1:])}")
        own = [i for i, s in enumerate(shapes) if s == shape]
        yield places[own], np.stack([values[at[first[i]] : at[first[i + 1]]].reshape(shape) for i in own])


def feature_column(bank: Bank, strict: tuple[int, int] | None = None, exact: bool = False):
    """A function from a column of windows to their features, in Arrow batches; a null window has null features.

    ``strict`` is the only (channels, length) allowed. Features are single floats, or doubles with ``exact``.
    """

    @F.arrow_udf("array<double>" if exact else "array<float>")
    def extract(windows: pa.Array) -> pa.Array:
        out: list = [None] * len(windows)
        for places, x in stacks(windows):
            if strict and x.shape[1:] != strict:
                raise ValueError(f"a window of {x.shape[1]} channels and {x.shape[2]} samples where {strict[0]} and {strict[1]} are asked for")
            for place, row in zip(places, bank.features(x, np.float64 if exact else np.float32), strict=True):
                out[place] = row
        return pa.array(out, pa.list_(pa.float64() if exact else pa.float32()))

    return extract


def transform(windows: DataFrame, bank: Bank, key: str = "window_id", exact: bool = False) -> DataFrame:
    """(key, features) of windows (key, x: channels of samples); the bank is a constant of the configuration's size."""
    return windows.select(key, feature_column(bank, exact=exact)(F.col("x")).alias("features"))


def win_counts(windows: DataFrame, bank: Bank, label: str = "y") -> DataFrame:
    """(cls, competition, dilation, diff, grp, kernel, frequency, magnitude): winners per class, partial sums per batch."""
    schema = "cls int, competition string, dilation int, diff int, grp int, kernel int, frequency long, magnitude double"
    slots = bank.groups * bank.kernels
    block = lambda x: max(1, BLOCK // max(1, bank.groups * TAPS * x.shape[-1]))

    def run(batches):
        for batch in batches:
            labels, sums = np.asarray(batch.column("y")), {}
            for places, stack in stacks(batch.column("x")):
                for start in range(0, len(stack), block(stack)):
                    x, y = stack[start : start + block(stack)], labels[places[start : start + block(stack)]]
                    for d, r in np.ndindex(len(bank.dilations), bank.representations):
                        a = bank.responses(x, d, r)
                        for name, at in (("max", a.argmax(-2)), ("min", a.argmin(-2))):
                            values = np.abs(np.take_along_axis(a, at[..., None, :], -2)[..., 0, :])
                            slot = np.arange(bank.groups)[:, None] * bank.kernels + at
                            for c in np.unique(y):
                                own = (slot[y == c].ravel(), values[y == c].ravel())
                                old = sums.get((int(c), name, d, r), (0, 0))
                                sums[int(c), name, d, r] = old[0] + np.bincount(own[0], minlength=slots), old[1] + np.bincount(own[0], own[1], slots)
            frames = [
                pd.DataFrame({"cls": c, "competition": name, "dilation": int(bank.dilations[d]), "diff": r, "grp": np.arange(slots) // bank.kernels, "kernel": np.arange(slots) % bank.kernels, "frequency": n, "magnitude": m})
                for (c, name, d, r), (n, m) in sums.items()
            ]
            if frames:
                kinds = [pa.int32(), pa.string(), *[pa.int32()] * 4, pa.int64(), pa.float64()]
                whole = pd.concat(frames)
                yield pa.RecordBatch.from_arrays([pa.array(whole[c].to_numpy(), k) for c, k in zip(whole, kinds, strict=True)], names=list(whole))

    counted = windows.select("x", F.col(label).cast("int").alias("y")).mapInArrow(run, schema)
    return counted.groupBy("cls", "competition", "dilation", "diff", "grp", "kernel").agg(F.sum("frequency").alias("frequency"), F.sum("magnitude").alias("magnitude"))


def bag_features(components: DataFrame, bank: Bank, key: str = "window_id") -> DataFrame:
    """(key, k, mean, most, std, n): univariate features pooled over the non-zero components of each bag; zeros for an empty bag.

    Components are rows (key, ic, x). A bag is one group of at most as many rows as a decomposition has components; vectors are
    pooled whole, not feature by feature.
    """
    energy = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v))
    rows = components.select(key, feature_column(bank, exact=True)(F.when(energy > 0, F.array("x"))).alias("f"), (energy > 0).alias("live"))
    zero = F.transform(F.sequence(F.lit(1), F.lit(bank.width)), lambda _: F.lit(0.0))
    gathered = rows.groupBy(key).agg(F.collect_list("f").alias("all"), F.count_if("live").alias("n"))
    each = lambda merge: F.aggregate("all", zero, lambda a, f: F.zip_with(a, f, merge))
    n = F.greatest(F.col("n"), F.lit(1))
    pooled = gathered.select(
        key, "n", F.transform(each(lambda a, v: a + v), lambda v: v / n).alias("mean"),
        F.when(F.col("n") > 0, F.aggregate("all", F.get("all", F.lit(0)), lambda a, f: F.zip_with(a, f, lambda p, q: F.greatest(p, q)))).otherwise(zero).alias("most"), "all",
    )
    spread = F.aggregate("all", zero, lambda a, f: F.zip_with(a, F.zip_with(f, "mean", lambda v, m: (v - m) * (v - m)), lambda s, v: s + v))
    long = pooled.select(key, "n", F.posexplode(F.arrays_zip("mean", "most", F.transform(spread, lambda v: F.sqrt(v / n)).alias("std"))).alias("k", "v"))
    return long.select(key, "k", "v.mean", "v.most", "v.std", "n")


def response(weights: Column, f: Column, fs: float, dilation: Column, diff: Column) -> Column:
    """Magnitude of a kernel's frequency response at ``f`` Hz; differenced input multiplies it by 2|sin(pi f / fs)|."""
    angle = lambda j: F.lit(2 * np.pi / fs) * f * dilation * j
    part = lambda g: F.aggregate(F.transform(weights, lambda w, j: w * g(angle(j))), F.lit(0.0), lambda a, v: a + v)
    size = F.sqrt(F.pow(part(F.cos), F.lit(2)) + F.pow(part(F.sin), F.lit(2)))
    return F.when(diff == 1, size * 2 * F.abs(F.sin(F.lit(np.pi / fs) * f))).otherwise(size)


def peaks(kernels: DataFrame, fs: float, points: int = 257) -> DataFrame:
    """``peak_hz`` and ``centroid_hz`` of each kernel: raw kernels up to fs / 2d, differenced ones up to fs / 2."""
    top = F.when(F.col("diff") == 1, F.lit(fs / 2)).otherwise(F.lit(fs / 2) / F.col("dilation"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * top / (points - 1))
    curve = F.transform(grid, lambda f: F.struct(F.round(response(F.col("weights"), f, fs, F.col("dilation"), F.col("diff")), 9).alias("h"), f.alias("f")))
    drawn = kernels.withColumn("curve", curve)
    total = F.aggregate("curve", F.lit(0.0), lambda a, c: a + c["h"])
    moment = F.aggregate("curve", F.lit(0.0), lambda a, c: a + c["h"] * c["f"])
    best = F.aggregate("curve", F.struct(F.lit(-1.0).alias("h"), F.lit(0.0).alias("f")), lambda a, c: F.when(c["h"] > a["h"], c).otherwise(a))
    return drawn.select(*kernels.columns, best["f"].alias("peak_hz"), F.when(total > 0, moment / total).otherwise(F.lit(0.0)).alias("centroid_hz"))


SLOT = ["dilation", "diff", "grp", "kernel"]


def within_group(counts: DataFrame) -> DataFrame:
    """``share``: a kernel's value over its group's total within the class; groups without wins count as one."""
    total = F.sum("value").over(Window.partitionBy("cls", "dilation", "diff", "grp"))
    return counts.withColumn("share", F.col("value") / F.when(F.abs(total) < 1e-12, F.lit(1)).otherwise(total))


def discriminative(counts: DataFrame, a: int, b: int, metric: str = "difference", eps: float = 1e-6) -> DataFrame:
    """(slot, frac_a, frac_b, score, strength, favours_a) comparing two classes' shares."""
    shares = within_group(counts).filter(F.col("cls").isin(a, b)).groupBy(*SLOT).agg(*[F.coalesce(F.max(F.when(F.col("cls") == c, F.col("share"))), F.lit(0.0)).alias(n) for c, n in ((a, "frac_a"), (b, "frac_b"))])
    x, y = F.col("frac_a"), F.col("frac_b")
    odds = lambda v: F.log((v + eps) / (1 - v + eps))
    score = {"difference": x - y, "ratio": (x + eps) / (y + eps), "logodds": odds(x) - odds(y)}[metric]
    scored = shares.withColumn("score", score)
    strength, favours = (F.abs(F.log("score")), F.col("score") >= 1) if metric == "ratio" else (F.abs("score"), F.col("score") >= 0)
    return scored.withColumns({"strength": strength, "favours_a": favours})


def top(rows: DataFrame, by: Column, n: int, keys: list[str] = SLOT) -> DataFrame:
    """The n first rows by a descending value; ties go by slot."""
    return rows.orderBy(by.desc(), *keys).limit(n)


def decoded(flat: Column, dilations: tuple[int, ...], groups: int, kernels: int, representations: int = 2) -> dict[str, Column]:
    """Slot of a feature column: the layout is dilation, representation, competition (soft, hard), group, kernel."""
    per = groups * kernels
    return {
        "dilation": F.get(F.array(*[F.lit(x) for x in dilations]), F.floor(flat / (2 * per * representations)).cast("int")), "diff": (F.floor(flat / (2 * per)) % representations).cast("int"),
        "grp": (F.floor(flat / kernels) % groups).cast("int"), "kernel": (flat % kernels).cast("int"),
    }


def by_weight(coefficients: DataFrame, dilations: tuple[int, ...], groups: int, kernels: int, combine: str = "sum", representations: int = 2) -> DataFrame:
    """(slot, weight): absolute coefficients (k, coef and, where known, std) of a kernel's two columns, summed or the larger.

    The number of columns must be that of the bank; another one means that the coefficients belong to other features.
    """
    size = F.abs("coef") * (F.col("std") if "std" in coefficients.columns else F.lit(1.0))
    width = len(dilations) * representations * 2 * groups * kernels
    checked = F.when(F.col("k") < width, F.col("k")).otherwise(F.raise_error(F.lit(f"more than {width} coefficients")).cast("int"))
    rows = coefficients.select(checked.alias("k"), size.alias("w"))
    fold = {"sum": F.sum, "max": F.max}[combine]
    return rows.withColumns(decoded(F.col("k"), dilations, groups, kernels, representations)).groupBy(*SLOT).agg(fold("w").alias("weight"))


def class_labels(rows: DataFrame, label: str = "y") -> DataFrame:
    """The sorted distinct labels with their places."""
    return rows.select(label).distinct().select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("place"))


def sampling_rate(n_timepoints: int, minutes: float) -> float:
    """Samples a second of windows of a known number of samples and minutes."""
    return n_timepoints / (minutes * 60)


def flat_coefficients(matrix) -> list[float]:
    """One coefficient per feature: of the only row, or summed absolute values over the rows of several classes."""
    rows = [list(map(float, r)) for r in matrix]
    return rows[0] if len(rows) == 1 else [sum(abs(r[i]) for r in rows) for i in range(len(rows[0]))]


def bank_rows(spark, bank: Bank) -> DataFrame:
    """(slot, weights) of every kernel of a bank."""
    rows = [(d, r, g, k, w) for _, d, r, g, k, w in bank.rows()]
    return spark.createDataFrame(rows, "dilation int, diff int, grp int, kernel int, weights array<double>")


def peak_histogram(peaks: DataFrame, width: float, most: float) -> DataFrame:
    """(bin, n, and the group columns of ``peaks``): kernels by peak frequency in bins of a width up to ``most`` Hz.

    Edges run to the first multiple of the width that is not below ``most``; the last bin is closed, what lies outside is left out.
    """
    last = int(np.ceil(most / width)) - 1
    inside = peaks.filter(F.col("peak_hz").between(0.0, (last + 1) * width))
    groups = [c for c in ("ranking", "favours_a") if c in peaks.columns]
    return inside.groupBy(*groups, F.least(F.floor(F.col("peak_hz") / width), F.lit(last)).alias("bin")).agg(F.count("*").alias("n"))


def kernel_report(counts: DataFrame, coefficients: DataFrame | None, bank: Bank, fs: float, classes: tuple[int, int] = (1, 0), n: int = 20, by: str = "frequency", metric: str = "difference") -> DataFrame:
    """(ranking, place, slot, score, favours_a, peak_hz, centroid_hz): the kernels that matter by three independent views.

    ``overall`` ranks by wins, ``discriminative`` for each of two classes by the difference of their shares, ``classifier`` by
    the absolute coefficients (k, coef, std) of a fitted model. ``counts`` is what ``win_counts`` gives.
    """
    spark = counts.sparkSession
    values = counts.groupBy("cls", *SLOT).agg(F.sum(by).alias("value"))
    place = lambda *part: Window.partitionBy(*part).orderBy(F.desc("strength"), *SLOT)
    overall = values.groupBy(*SLOT).agg(F.sum("value").cast("double").alias("score")).withColumns({"strength": F.col("score"), "favours_a": F.lit(None).cast("boolean"), "ranking": F.lit("overall")})
    told = discriminative(values, *classes, metric).select(*SLOT, "score", "strength", "favours_a", F.lit("discriminative").alias("ranking"))
    every = overall.unionByName(told)
    if coefficients is not None:
        weighted = by_weight(coefficients, tuple(int(v) for v in bank.dilations), bank.groups, bank.kernels, representations=bank.representations)
        every = every.unionByName(weighted.select(*SLOT, F.col("weight").alias("score"), F.col("weight").alias("strength"), F.lit(None).cast("boolean").alias("favours_a"), F.lit("classifier").alias("ranking")))
    kept = every.withColumn("place", F.row_number().over(place("ranking", "favours_a"))).filter(F.col("place") <= n)
    located = peaks(bank_rows(spark, bank), fs).drop("weights")
    return kept.join(F.broadcast(located), SLOT).select("ranking", "place", *SLOT, "score", "favours_a", "peak_hz", "centroid_hz")
