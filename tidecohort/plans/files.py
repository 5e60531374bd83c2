"""Queries from EDF files: the given signals are written as recordings, and read as channels and as windows of a plan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidecohort.operators.chain import Chain
from tidecohort.operators.tables import shared_dir, stored
from tidecohort.plans.cleaning import FS, NAMES, PAIRS, total
from tidecohort.plans.register import query
from tidecohort.sources import edf, windows
from tidecohort.sources.fixtures import ctes, signals

LIMIT = 32.768
#: Samples as a recording keeps them: 65,536 steps between the limits.
STEP_SQL = f"(round_even((v + {LIMIT}::DOUBLE) / (2 * {LIMIT}::DOUBLE) * 65535 - 32768, 0) + 32768) * (2 * {LIMIT}::DOUBLE / 65535) - {LIMIT}::DOUBLE"
FILES_SQL = f"""ch AS (SELECT vec_id // 4 AS rec, CAST(vec_id % 4 AS INTEGER) AS c, list_transform(x, lambda v: {STEP_SQL}) AS x FROM signals),
files AS (SELECT rec, list(x ORDER BY c) AS x FROM ch GROUP BY rec HAVING count(*) = 4)"""


def written(spark, d):
    """(path, n_bytes) of recordings of four channels of 64 samples, a file for each four signals."""
    names = F.array(*[F.lit(n) for n in NAMES])
    rows = signals(spark, d).groupBy(F.expr("vec_id div 4").alias("rec")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("c")).filter(F.size("c") == 4)
    rows = rows.select(F.format_string("r%d.edf", "rec").alias("path"), names.alias("names"), F.transform("c", lambda c: c["x"]).alias("x"))
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    return windows.write_recordings(rows, folder, int(FS), limit=LIMIT), folder


def number() -> F.Column:
    return F.regexp_extract("path", r"r(\d+)\.edf$", 1).cast("long")


@query("edf_channels", ctes("signals") + ", " + FILES_SQL + f" SELECT rec, '{NAMES[1]}' AS channel, 16.0::DOUBLE AS sfreq, 64 AS n, round(list_sum(list_transform(x[2], lambda v: abs(v))), 6) AS size FROM files")
def edf_channels(spark, d):
    """One channel of all recordings: the filter reaches the source, which converts no other channel."""
    _, folder = written(spark, d)
    edf.register(spark)
    rows = spark.read.format("edf").load(folder).filter(F.col("channel") == NAMES[1])
    whole = rows.groupBy("path", "channel").agg(F.max("sfreq").alias("sfreq"), F.sum(F.size("x")).cast("int").alias("n"), F.sum(total(F.transform("x", lambda v: F.abs(v)))).alias("size"))
    return whole.select(number().alias("rec"), "channel", "sfreq", "n", F.round("size", 6).alias("size"))


@query("edf_windows", ctes("signals") + ", " + FILES_SQL + """, w AS (SELECT rec, CAST(idx AS INTEGER) AS idx, x, 16 * idx AS off FROM files, unnest([0, 1, 2]) AS u(idx))
SELECT rec, idx, 3 AS n_channels, 40 AS n, TRUE AS ok, round(list_sum(list_transform(range(1, 33), lambda i: abs(x[1][off + i] - x[2][off + i]))), 6) AS first, round(list_sum(list_transform(range(1, 33), lambda i: abs(x[3][off + i] - x[4][off + i]))), 6) AS last FROM w""")
def edf_windows(spark, d):
    """From files to stored windows: overlapping windows with margins, each file read once, bipolar pairs, fixed length."""
    files, _ = written(spark, d)
    plan = files.select("path", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("idx")).select("path", "idx", F.col("idx").cast("double").alias("start"), (F.col("idx") + 2).cast("double").alias("end"))
    rows = stored(windows.processed(plan, Chain(FS, pairs=PAIRS, least_pairs=3, n_samples=40), ["path", "idx"], margin_s=0.5))
    size = lambda k: F.round(total(F.transform(F.get("x", F.lit(k)), lambda v: F.abs(v))), 6)
    return rows.select(number().alias("rec"), "idx", F.size("x").alias("n_channels"), F.size(F.get("x", F.lit(0))).alias("n"), "ok", size(0).alias("first"), size(2).alias("last"))
