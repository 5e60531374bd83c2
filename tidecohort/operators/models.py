"""Sparse scaling over array features, and class weights."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaler_arrays(rows: DataFrame, exponent: float = 4.0) -> DataFrame:
    """One row (mean, std): arrays over the features of square roots of clipped values, summed up as whole vectors.

    The deviation is that of a sample and grows with the share of zeros; it is null for a single row.
    """
    roots = F.transform("features", lambda v: F.sqrt(F.greatest(v.cast("double"), F.lit(0.0))))
    found = rows.filter(F.col("features").isNotNull()).select(Summarizer.metrics("mean", "std", "numNonZeros", "count").summary(array_to_vector(roots)).alias("m")).select("m.*")
    zeros = lambda k: F.pow(1 - k / F.col("count"), F.lit(exponent)) + F.lit(1e-8)
    spread = F.zip_with(vector_to_array("std"), vector_to_array("numNonZeros"), lambda s, k: F.when(F.col("count") > 1, s + zeros(k)))
    return found.select(vector_to_array("mean").alias("mean"), spread.alias("std"))


def scaler_statistics(rows: DataFrame, exponent: float = 4.0) -> DataFrame:
    """(k, mean, std) per feature."""
    zipped = scaler_arrays(rows, exponent).select(F.posexplode(F.arrays_zip("mean", "std")).alias("k", "z"))
    return zipped.select("k", "z.mean", "z.std")


def balanced(rows: DataFrame, label: str = "y") -> DataFrame:
    """``weight``: rows over twice the class size."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("k"))
    total = sizes.agg(F.sum("k").alias("n"))
    weights = sizes.join(F.broadcast(total)).select(F.col(label).alias("of"), (F.col("n") / (2 * F.col("k"))).alias("weight"))
    return rows.join(F.broadcast(weights), F.col(label) == F.col("of")).drop("of")
