"""SQL table functions and vectorised SQL functions over signals; ``register`` makes all of the library's functions known.

``tide_welch(x, fs, nperseg)`` gives the rows (k, f, p) of a Welch spectrum, for use with LATERAL. ``tide_features(x, kernels,
groups, seed)`` gives the competing-convolution features of a window (channels of samples); the last three must be constants.
``tide_crop(x, from, to, fs)`` and ``tide_reference(x)`` cut windows and take the average reference.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidecohort.functions import scalars
from tidecohort.operators import features, signal


class Welch:
    """The rows of one signal's spectrum; null and empty signals have none."""

    def eval(self, x: list, fs: float, nperseg: int):
        if x:
            freqs, power = signal.welch(np.asarray(x, float), float(fs), int(nperseg))
            for k, (f, p) in enumerate(zip(freqs, power, strict=True)):
                yield k, float(f), float(p)


@lru_cache(maxsize=8)
def _bank(length: int, channels: int, kernels: int, groups: int, seed: int) -> features.Bank:
    return features.Bank(length, channels, kernels, groups, seed=seed)


def _features(windows: pa.Array, kernels: pa.Array, groups: pa.Array, seed: pa.Array) -> pa.Array:
    out: list = [None] * len(windows)
    options = [c.unique() for c in (kernels, groups, seed)]
    if any(len(c) > 1 for c in options):
        raise ValueError("kernels, groups and seed must be constants")
    for places, x in features.stacks(windows):
        bank = _bank(x.shape[2], x.shape[1], *[int(c[0].as_py()) for c in options])
        for place, row in zip(places, bank.features(x, np.float64), strict=True):
            out[place] = row
    return pa.array(out, pa.list_(pa.float64()))


def register(spark: SparkSession) -> None:
    scalars.register(spark)
    spark.udtf.register("tide_welch", F.udtf(Welch, returnType="k int, f double, p double"))
    spark.udf.register("tide_features", F.arrow_udf(_features, "array<double>"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tide_crop(x ARRAY<DOUBLE>, a DOUBLE, b DOUBLE, fs DOUBLE) RETURNS ARRAY<DOUBLE> RETURN slice(x, CAST(bround(greatest(a, 0D) * fs) AS INT) + 1, greatest(CAST(bround(least(b, (size(x) - 1) / fs) * fs) AS INT) - CAST(bround(greatest(a, 0D) * fs) AS INT), 0))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tide_reference(x ARRAY<ARRAY<DOUBLE>>) RETURNS ARRAY<ARRAY<DOUBLE>> RETURN transform(x, c -> transform(c, (v, i) -> v - aggregate(x, 0D, (a, o) -> a + o[i]) / size(x)))")
