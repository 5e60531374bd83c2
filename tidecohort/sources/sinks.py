"""Typed sinks: what a pipeline writes, each as a table that can be written again without doubling rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecohort.sources.corpus import write_new


def window_manifests(windows: DataFrame, path: str) -> None:
    """A CSV folder per split; a split without windows writes nothing."""
    windows.write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def performance(metrics: DataFrame, path: str) -> None:
    """A row per split and level, by run."""
    metrics.write.mode("overwrite").option("header", True).csv(path)


def seed_sweep(results: DataFrame, path: str) -> DataFrame:
    """Results by seed, and beside them their mean and sample deviation (0 for one seed); returns the summary."""
    results.write.mode("overwrite").option("header", True).csv(f"{path}/results")
    numbers = [f.name for f in results.schema.fields if f.dataType.simpleString() == "double"]
    long = results.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in numbers])).alias("m")).select("m.*")
    summary = long.groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    return summary


def kernels(rows: DataFrame, path: str) -> None:
    """Ranked kernels with their nine weights as columns w0 to w8."""
    weights = [F.get("weights", F.lit(j)).alias(f"w{j}") for j in range(9)]
    rows.select(*[c for c in rows.columns if c != "weights"], *weights).write.mode("overwrite").option("header", True).csv(path)


def spectra(rows: DataFrame, path: str) -> DataFrame:
    """Spectra by (path, variant), a folder a variant; those already there stay. Returns the rows appended."""
    return write_new(rows, path, ["path", "variant"], "variant")


def bads(rows: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Sidecars as JSON lines by recording; kept unless ``overwrite``."""
    if overwrite:
        rows.write.mode("overwrite").json(path)
        return rows
    try:
        done = rows.sparkSession.read.json(path).select("path").distinct()
        rows = rows.join(done, "path", "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    rows.write.mode("append").json(path)
    return rows


def decompositions(labels: DataFrame, matrices: DataFrame, sources: DataFrame, dipoles: DataFrame, path: str) -> None:
    """Component labels, mixing matrices, source series and dipoles of recordings not yet written."""
    for name, rows, keys in (("labels", labels, ["path", "ic"]), ("matrices", matrices, ["path"]), ("sources", sources, ["path", "ic"]), ("dipoles", dipoles, ["path", "ic"])):
        write_new(rows, f"{path}/{name}", keys)


def score_dump(windows: DataFrame, subjects: DataFrame, path: str, tag: str) -> None:
    """Window and subject scores of a run, down-cast, as two tables."""
    small = lambda df: df.select(*[F.col(f.name).cast({"double": "float", "bigint": "int"}.get(f.dataType.simpleString(), f.dataType.simpleString())).alias(f.name) for f in df.schema.fields])
    small(windows).write.mode("overwrite").parquet(f"{path}/{tag}/windows")
    small(subjects).write.mode("overwrite").parquet(f"{path}/{tag}/subjects")


def comparison(long: DataFrame, focused: DataFrame, by_config: DataFrame, path: str) -> None:
    """The three tables of a comparison of runs."""
    for name, rows in (("long", long), ("focused", focused), ("by_config", by_config)):
        rows.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def exclusions(paths: DataFrame, path: str, provenance: list[str]) -> None:
    """A list of excluded paths under comment lines that say where it is from."""
    notes = paths.sparkSession.createDataFrame([(0, i, f"# {line}") for i, line in enumerate(provenance)], "part int, place long, value string")
    rows = paths.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("place"), F.col("path").alias("value"))
    notes.unionByName(rows).repartitionByRange("part", "place", "value").sortWithinPartitions("part", "place", "value").select("value").write.mode("overwrite").text(path)


def dipole_report(percentiles: DataFrame, regions: DataFrame, path: str) -> None:
    """Percentiles of the fit and the components of each region."""
    percentiles.write.mode("overwrite").option("header", True).csv(f"{path}/percentiles")
    regions.write.mode("overwrite").option("header", True).csv(f"{path}/regions")


def anomalies(rows: DataFrame, path: str) -> None:
    """Ranked anomalies as CSV, the most anomalous first, over range partitions."""
    rows.repartitionByRange(F.desc("anomaly"), "path").sortWithinPartitions(F.desc("anomaly"), "path").write.mode("overwrite").option("header", True).csv(path)


def counts(rows: DataFrame, path: str) -> None:
    """A table of counts by class as CSV."""
    rows.write.mode("overwrite").option("header", True).csv(path)
