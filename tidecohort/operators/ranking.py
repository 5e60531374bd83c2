"""Robust scores, rank fusion and per-rate selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecohort.operators.ordered import ranks
from tidecohort.operators.tables import stored

METRICS = ("power", "roughness", "flatness")


def robust_z(rows: DataFrame, metrics: tuple[str, ...] = METRICS, absolute: tuple[str, ...] = ("power", "flatness")) -> DataFrame:
    """``z_<metric>``: distance from the median in units of the scaled median absolute deviation.

    The metrics are stored before: medians, deviations and rows all read them.
    """
    rows = stored(rows)
    medians = rows.agg(*[F.median(m).alias(f"med_{m}") for m in metrics])
    centred = rows.join(F.broadcast(medians))
    deviations = centred.agg(*[F.median(F.abs(F.col(m) - F.col(f"med_{m}"))).alias(f"mad_{m}") for m in metrics])
    joined = centred.join(F.broadcast(deviations))
    z = lambda m: (F.col(m) - F.col(f"med_{m}")) / (F.lit(1.4826) * (F.col(f"mad_{m}") + F.lit(1e-30)))
    scored = joined.withColumns({f"z_{m}": F.abs(z(m)) if m in absolute else z(m) for m in metrics})
    return scored.drop(*[f"{p}_{m}" for p in ("med", "mad") for m in metrics])


def fused(rows: DataFrame, method: str, key: str = "path", metrics: tuple[str, ...] = METRICS, rrf_k: int = 60) -> F.Column | DataFrame:
    """``rows`` with ``anomaly``: l1, l2, borda or reciprocal-rank fusion of the z columns; ties in ranks go by ``key``."""
    z = [F.col(f"z_{m}") for m in metrics]
    total = lambda xs: sum(xs[1:], xs[0])
    if method == "l1":
        return rows.withColumn("anomaly", total(z))
    if method == "l2":
        return rows.withColumn("anomaly", F.sqrt(total([F.greatest(x, F.lit(0.0)) * F.greatest(x, F.lit(0.0)) for x in z])))
    if method in ("borda", "rrf"):
        rows = ranks(rows, {f"__rank{i}": f"z_{m}" for i, m in enumerate(metrics)}, [key], descending=method == "rrf")
        places = [F.col(f"__rank{i}") for i in range(len(z))]
        each = [(r - 1).cast("double") for r in places] if method == "borda" else [F.lit(1.0) / (F.lit(float(rrf_k)) + r) for r in places]
        return rows.withColumn("anomaly", total(each)).drop(*[f"__rank{i}" for i in range(len(z))])
    raise ValueError(f"unknown fusion method {method}")


def top_per_rate(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``n`` most anomalous rows of each wanted rate (rate, n); a row within 0.5 Hz of two rates is taken once."""
    matched = rows.join(F.broadcast(wanted.select(F.col("rate").alias("wanted"), "n")), F.abs(F.col("rate") - F.col("wanted")) <= 0.5)
    order = Window.partitionBy("wanted").orderBy(F.desc("anomaly"), "path")
    return matched.withColumn("rank", F.row_number().over(order)).filter("rank <= n").dropDuplicates(["path"])


def best_of_duplicates(rows: DataFrame) -> DataFrame:
    """One row per path, the most anomalous."""
    return rows.groupBy("path").agg(F.max("anomaly").alias("anomaly"))


def last_by_stem(rows: DataFrame, order: str = "line") -> DataFrame:
    """(stem, anomaly): one row a file stem, the last one in the order of ``order`` and the most anomalous of equals."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return rows.withColumn("stem", stem).groupBy("stem").agg(F.max_by("anomaly", F.struct(order, "anomaly")).alias("anomaly"))
