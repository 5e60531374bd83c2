"""Queries over signals: re-referencing, cropping, artifact subtraction, component bags, spectra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecohort.functions import scalars
from tidecohort.operators import signal
from tidecohort.plans.cohorts import REGION_SQL
from tidecohort.plans.register import query
from tidecohort.sources.fixtures import components, ctes, signals


@query("first_difference", ctes("signals") + " SELECT vec_id, len(x) - 1 AS n, round(list_sum(list_transform(range(2, len(x) + 1), lambda i: abs(x[i] - x[i - 1]))), 6) AS variation FROM signals")
def first_difference(spark, d):
    diff = signal.difference(F.col("x"))
    total = F.aggregate(F.transform(diff, lambda v: F.abs(v)), F.lit(0.0), lambda a, v: a + v)
    return signals(spark, d).select("vec_id", F.size(diff).cast("long").alias("n"), F.round(total, 6).alias("variation"))


@query("crop_window", ctes("signals") + " SELECT vec_id, len(x[9:40]) AS n, round(list_sum(x[9:40]), 6) AS total, len(x[49:63]) AS n_end FROM signals")
def crop_window(spark, d):
    part = lambda a, b: signal.crop(F.col("x"), F.lit(a), F.lit(b), 8.0)
    total = F.aggregate(part(1.0, 5.0), F.lit(0.0), lambda a, v: a + v)
    return signals(spark, d).select("vec_id", F.size(part(1.0, 5.0)).cast("long").alias("n"), F.round(total, 6).alias("total"), F.size(part(6.0, 8.0)).cast("long").alias("n_end"))


@query("harmonise_length", ctes("signals") + ", l AS (SELECT vec_id, x, CASE WHEN vec_id % 2 = 0 THEN 80 ELSE 40 END AS n FROM signals) SELECT vec_id, len(f) AS n, round(list_sum(f), 6) AS total, round(f[-1], 6) AS last FROM (SELECT vec_id, list_transform(range(1, n + 1), lambda i: coalesce(x[i], 0)) AS f FROM l)")
def harmonise_length(spark, d):
    fitted = F.when(F.col("vec_id") % 2 == 0, signal.fit_length(F.col("x"), 80)).otherwise(signal.fit_length(F.col("x"), 40))
    return signals(spark, d).select("vec_id", F.size(fitted).cast("long").alias("n"), F.round(F.aggregate(fitted, F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(F.element_at(fitted, -1), 6).alias("last"))


def four_channels():
    return F.array(*[F.slice("x", 1 + 16 * i, 16) for i in range(4)])


@query("average_reference", ctes("signals") + " SELECT vec_id, round(list_sum(list_transform(range(1, 17), lambda i: abs(x[i] - (x[i] + x[i + 16] + x[i + 32] + x[i + 48]) / 4))), 6) AS first FROM signals")
def average_reference(spark, d):
    first = F.get(signal.average_reference(four_channels()), F.lit(0))
    return signals(spark, d).select("vec_id", F.round(F.aggregate(F.transform(first, lambda v: F.abs(v)), F.lit(0.0), lambda a, v: a + v), 6).alias("first"))


@query("bipolar_pairs", ctes("signals") + " SELECT vec_id, CAST(2 AS BIGINT) AS pairs, round(list_sum(list_transform(range(1, 17), lambda i: abs(x[i] - x[i + 16]))), 6) AS first FROM signals")
def bipolar_pairs(spark, d):
    named = F.map_from_arrays(F.array(*[F.lit(n) for n in ("Fp1", "F7", "T3", "Cz")]), four_channels())
    rows = signals(spark, d).withColumn("b", signal.bipolar(named, least=2))
    return rows.select("vec_id", F.size("b").cast("long").alias("pairs"), F.round(F.aggregate(F.transform(F.col("b")["Fp1-F7"], lambda v: F.abs(v)), F.lit(0.0), lambda a, v: a + v), 6).alias("first"))


@query("artifact_subtraction", ctes("signals") + """, t AS (SELECT vec_id, CAST((i - 1) // 4 AS INTEGER) AS tile, CAST((i - 1) % 4 AS INTEGER) AS phase, x[i] AS v FROM signals, unnest(range(1, 65)) AS u(i)),
m AS (SELECT a.vec_id, a.tile, a.phase, a.v - avg(b.v) AS v FROM t a JOIN t b ON a.vec_id = b.vec_id AND a.phase = b.phase AND b.tile >= greatest(a.tile - 3, 0) AND b.tile < greatest(a.tile - 3, 0) + 7 GROUP BY a.vec_id, a.tile, a.phase, a.v)
SELECT vec_id, tile, phase, round(v, 6) AS v FROM m""")
def artifact_subtraction(spark, d):
    """Signals without the average of seven periods around each, sample by sample."""
    cleaned = signals(spark, d).select("vec_id", F.posexplode(signal.without_artifact(F.col("x"), 1.0, 4.0, 7)).alias("i", "v"))
    return cleaned.select("vec_id", F.expr("cast(i div 4 as int)").alias("tile"), (F.col("i") % 4).alias("phase"), F.round("v", 6).alias("v"))


@query("period_average", ctes("signals") + " SELECT vec_id, CAST((i - 1) % 8 AS INTEGER) AS phase, round(avg(x[i]), 6) AS v FROM signals, unnest(range(1, 65)) AS u(i) GROUP BY 1, 2")
def period_average(spark, d):
    rows = signals(spark, d).select("vec_id", F.posexplode("x").alias("i", "v"))
    return rows.groupBy("vec_id", (F.col("i") % 8).alias("phase")).agg(F.round(F.avg("v"), 6).alias("v"))


@query("component_bag", ctes("components") + " SELECT path, ic, place FROM (SELECT path, ic, row_number() OVER (PARTITION BY path ORDER BY prob DESC, ic) AS place FROM components WHERE lower(trim(label)) IN ('brain', 'other')) WHERE place <= 3")
def component_bag(spark, d):
    kept = components(spark, d).filter(F.lower(F.trim("label")).isin("brain", "other"))
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("prob"), "ic")).cast("long")
    return kept.select("path", "ic", place.alias("place")).filter("place <= 3")


@query("regional_sums", ctes("components") + f", r AS (SELECT path, {REGION_SQL} AS region, gof FROM components WHERE lower(trim(label)) = 'brain') SELECT path, region, count(*) AS n, round(sum(gof), 6) AS total FROM r GROUP BY path, region")
def regional_sums(spark, d):
    kept = components(spark, d).filter(F.lower(F.trim("label")) == "brain")
    region = scalars.dipole_region(F.col("x"), F.col("y"), F.col("z"))
    return kept.groupBy("path", region.alias("region")).agg(F.count("*").alias("n"), F.round(F.sum("gof"), 6).alias("total"))


#: Hann weights of segments of 32 samples, and their squared sum times 64 Hz.
WELCH_SQL = "hann AS (SELECT list(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 32) ORDER BY j) AS h, 64 * sum(pow(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 32), 2)) AS scale FROM range(32) AS r(j))"


def welch_sql(of: str, name: str, segments: int = 3) -> str:
    """A view (vec_id, k, p) of Welch spectra at 64 Hz of a view with signals of 64 samples, over the first segments."""
    parts = f"{name}_parts AS (SELECT vec_id, s, x[1 + 16 * s : 32 + 16 * s] AS x FROM {of}, unnest(range({segments})) AS u(s))"
    tapered = f"{name}_tapered AS (SELECT vec_id, s, scale, list_transform(range(1, 33), lambda j: (x[j] - list_avg(x)) * h[j]) AS x FROM {name}_parts, hann)"
    wave = lambda f: f"pow(list_sum(list_transform(range(0, 32), lambda j: x[j + 1] * {f}(2 * pi() * j * k / 32))), 2)"
    return f"{parts}, {tapered}, {name} AS (SELECT vec_id, CAST(k AS INTEGER) AS k, avg(({wave('cos')} + {wave('sin')}) / scale) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS p FROM {name}_tapered, unnest(range(17)) AS v(k) GROUP BY vec_id, k)"


@query("welch_spectra", ctes("signals") + ", " + WELCH_SQL + ", " + welch_sql("signals", "w") + " SELECT vec_id, k, round(p, 7) AS p FROM w")
def welch_spectra(spark, d):
    rows = signal.spectra(signals(spark, d), 64.0, 32)
    return rows.select("vec_id", F.posexplode("p").alias("k", "p")).withColumn("p", F.round("p", 7))



@query("stacked_windows", ctes("signals") + " SELECT vec_id, vec_id % 6 <> 0 AS ok, CASE WHEN vec_id % 6 <> 0 THEN 4 ELSE 0 END AS n_channels, CASE WHEN vec_id % 6 <> 0 THEN round(CAST(CAST(x[17] AS FLOAT) AS DOUBLE), 7) ELSE 0 END AS value FROM signals")
def stacked_windows(spark, d):
    """Windows as single floats of one shape; every sixth has a channel too short."""
    short = F.when(F.col("vec_id") % 6 == 0, F.array(*[F.slice("x", 1 + 16 * i, 16 - i) for i in range(4)])).otherwise(four_channels())
    rows = signals(spark, d).select("vec_id", signal.stacked(short, 4, 16).alias("x"))
    return rows.select("vec_id", F.col("x").isNotNull().alias("ok"), F.when(F.col("x").isNotNull(), F.size("x")).otherwise(0).alias("n_channels"), F.coalesce(F.round(F.get(F.get("x", F.lit(1)), F.lit(0)).cast("double"), 7), F.lit(0.0)).alias("value"))
