"""Runs of experiments on disk: their metrics, their configurations, and both joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, roots: list[str], name: str = "performance.csv") -> DataFrame:
    """All rows of the metrics files below the roots, with ``run``: the folder relative to its root; broken lines are left out."""
    out = None
    for root in roots:
        rows = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", name).csv(root)
        folder = F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]+$", "")
        below = rows.withColumn("run", F.regexp_replace(F.regexp_replace(folder, "^[a-z]+:/+", "/"), "^" + root.rstrip("/") + "/?", ""))
        out = below if out is None else out.unionByName(below, allowMissingColumns=True)
    return out


def configurations(spark: SparkSession, root: str, name: str = "overrides.yaml", target: str = "config.yaml") -> DataFrame:
    """(run, overrides, seed, model, feature) of every run: override lines joined by ``; ``, seed from them, names from targets.

    The files are lists (``- key=value``) and flat keys, which lines express; nothing else of YAML is read.
    """
    text = lambda f: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f).text(root, wholetext=True)
    run = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/+", "/"), r"(/\.[^/]+)?/[^/]+$", ""), "^" + root.rstrip("/") + "/?", "")
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*-\s*", ""))), lambda x: (x != "") & ~x.startswith("#"))
    given = text(name).select(run.alias("run"), lines.alias("o"))
    pick = lambda key: F.get(F.filter("o", lambda x: x.startswith(f"{key}=")), F.lit(0))
    value = lambda key: F.substring_index(pick(key), "=", -1)
    overrides = given.select("run", F.array_join("o", "; ").alias("overrides"), F.coalesce(value("seed"), value("data.seed")).try_cast("int").alias("seed"))
    targets = text(target).select(run.alias("of"), F.regexp_extract_all("value", F.lit(r"_target_:\s*(\S+)"), F.lit(1)).alias("t"))
    last = lambda i: F.substring_index(F.get("t", F.lit(i)), ".", -1)
    return overrides.join(targets, F.col("run") == F.col("of"), "full_outer").select(F.coalesce("run", "of").alias("run"), "overrides", "seed", last(0).alias("model"), last(1).alias("feature"))


def with_configuration(metrics: DataFrame, configurations: DataFrame) -> DataFrame:
    """Metrics with the configuration of their run; runs without one keep nulls."""
    return metrics.join(configurations, "run", "left")


def top_spec(specs: list[str]) -> list[tuple[float, int]]:
    """``RATE:N`` pairs; N must not be negative."""
    out = []
    for spec in specs:
        rate, _, n = spec.partition(":")
        if not n.strip().isdigit():
            raise ValueError(f"{spec!r} is not RATE:N with N of 0 or more")
        out.append((float(rate), int(n)))
    return out
