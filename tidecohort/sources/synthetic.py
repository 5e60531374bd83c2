"""Labelled windows from seeded noise, for trying out models: each row's generator is seeded by its own id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "window_id long, subject string, y int, x array<array<double>>"


def window(seed: int, number: int, channels: int, samples: int, fs: float, rhythms: tuple[float, ...], strength: float) -> np.ndarray:
    """Gaussian noise, and on the first three channels a sinusoid of the class's frequency."""
    rng = np.random.default_rng([seed, number])
    x = rng.standard_normal((channels, samples))
    x[:3] += strength * np.sin(2 * np.pi * rhythms[number % len(rhythms)] * np.arange(samples) / fs + rng.uniform(0, 2 * np.pi))
    return x


def labelled_windows(spark: SparkSession, n: int, channels: int = 4, samples: int = 256, fs: float = 128.0, rhythms: tuple[float, ...] = (5.0, 12.0), strength: float = 1.0, per_subject: int = 8, seed: int = 0) -> DataFrame:
    """(window_id, subject, y, x): the class is the id modulo the number of rhythms, the same at any partitioning.

    A subject has ``per_subject`` windows of one class.
    """
    classes = len(rhythms)

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            labels = [i % classes for i in ids]
            subjects = [f"s{i // (per_subject * classes)}-{y}" for i, y in zip(ids, labels, strict=True)]
            x = [window(seed, i, channels, samples, fs, rhythms, strength).tolist() for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(subjects), pa.array(labels, pa.int32()), pa.array(x, pa.list_(pa.list_(pa.float64())))], names=["window_id", "subject", "y", "x"])

    return spark.range(n).mapInArrow(run, SCHEMA)
