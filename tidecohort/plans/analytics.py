"""Queries over scores, runs, anomaly rankings and spectra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecohort.functions import scalars
from tidecohort.operators import metrics, ranking, spectral
from tidecohort.plans.register import query
from tidecohort.sources.fixtures import components, ctes, psd, recordings, runs, scores, table

r6 = lambda c: F.round(c, 6)


@query("subject_scores", ctes("scores") + " SELECT subject, round(avg(s), 6) AS s, min_by(y, window_id) AS y, count(*) AS n, CAST(round(avg(s), 6) > 0 AS INTEGER) AS predicted FROM scores GROUP BY subject")
def subject_scores(spark, d):
    rows = metrics.subject_scores(scores(spark, d)).withColumn("s", r6("s"))
    return rows.select("subject", "s", "y", "n", (F.col("s") > 0).cast("int").alias("predicted"))


METRICS_SQL = """cells AS (SELECT {by} CAST(count(*) FILTER (s > 0 AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (s > 0 AND y = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (NOT s > 0 AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT s > 0 AND y = 0) AS DOUBLE) AS tn FROM {of} {group}),
ranked AS (SELECT {by} y, s, (rank() OVER ({part} ORDER BY s) + rank() OVER ({part} ORDER BY s) + count(*) OVER ({part_s}) - 1) / 2.0::DOUBLE AS mid, CAST(sum(y) OVER ({part} ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS DOUBLE) / count(*) OVER ({part} ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS prec FROM {of}),
rk AS (SELECT {by} CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN mid END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) END AS roc_auc, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN sum(CASE WHEN y = 1 THEN prec END) / sum(y) END AS average_precision FROM ranked {group})
SELECT {out} CAST(tp + fp + fn + tn AS BIGINT) AS n, CAST(tp + fn AS BIGINT) AS n_pos, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE tn / (tn + fp) END, 6) AS balanced_accuracy,
round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END END, 6) AS mcc,
round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM cells {join}"""
METRIC_NAMES = ["accuracy", "balanced_accuracy", "precision", "f1", "mcc", "roc_auc", "average_precision"]


@query("window_metrics", ctes("scores") + ",\n" + METRICS_SQL.format(by="", of="scores", group="", part="", part_s="PARTITION BY s", out="", join="CROSS JOIN rk"))
def window_metrics(spark, d):
    return metrics.classification(scores(spark, d), []).select("n", "n_pos", *[r6(m).alias(m) for m in METRIC_NAMES])


@query("metrics_by_subject", ctes("scores") + ",\n" + METRICS_SQL.format(by="subject,", of="scores", group="GROUP BY subject", part="PARTITION BY subject", part_s="PARTITION BY subject, s", out="subject,", join="JOIN rk USING (subject)"))
def metrics_by_subject(spark, d):
    return metrics.classification(scores(spark, d), ["subject"]).select("subject", "n", "n_pos", *[r6(m).alias(m) for m in METRIC_NAMES])


@query("best_threshold", ctes("scores") + """, t AS (SELECT s, sum(y) AS p, count(*) AS n FROM scores GROUP BY s), c AS (SELECT CASE WHEN lag(s) OVER (ORDER BY s) IS NULL THEN s - 1e-6::DOUBLE ELSE (lag(s) OVER (ORDER BY s) + s) / 2 END AS threshold FROM t UNION ALL SELECT max(s) + 1e-6::DOUBLE FROM t),
b AS (SELECT threshold, (CAST(count(*) FILTER (y = 1 AND s > threshold) AS DOUBLE) / count(*) FILTER (y = 1) + CAST(count(*) FILTER (y = 0 AND NOT s > threshold) AS DOUBLE) / count(*) FILTER (y = 0)) / 2 AS b FROM c CROSS JOIN scores GROUP BY threshold)
SELECT round(threshold, 9) AS threshold, round(b, 6) AS balanced_accuracy FROM b ORDER BY round(b, 12) DESC, b.threshold LIMIT 1""")
def best_threshold(spark, d):
    return metrics.best_threshold(scores(spark, d)).select(F.round("threshold", 9).alias("threshold"), r6("balanced_accuracy").alias("balanced_accuracy"))


@query("class_weights", ctes("scores") + " SELECT y, CAST((SELECT count(*) FROM scores) AS DOUBLE) / (2 * count(*)) AS weight FROM scores GROUP BY y")
def class_weights(spark, d):
    counted = scores(spark, d).groupBy("y").agg(F.count("*").alias("n"))
    return counted.select("y", (F.sum("n").over(Window.partitionBy()).cast("double") / (2 * F.col("n"))).alias("weight"))


STRIP_SQL = "list_aggregate(list_filter(list_transform(string_split(overrides, ';'), lambda t: trim(t)), lambda t: t <> '' AND NOT regexp_matches(t, '^(seed|data\\.seed|output_dir|paths\\.output_dir)=')), 'string_agg', '; ')"


@query("strip_seed", ctes("runs") + f" SELECT run, {STRIP_SQL} AS config FROM runs")
def strip_seed(spark, d):
    return runs(spark, d).select("run", scalars.strip_seed(F.col("overrides")).alias("config"))


@query("runs_by_config", ctes("runs") + f" SELECT model, feature, {STRIP_SQL} AS config, count(*) AS n_runs, array_to_string(list_sort(list_distinct(list(CAST(seed AS VARCHAR)) FILTER (seed IS NOT NULL))), ',') AS seeds, round(avg(balanced_accuracy), 8) AS mean, round(stddev_samp(balanced_accuracy), 6) AS std FROM runs GROUP BY 1, 2, 3")
def runs_by_config(spark, d):
    rows = runs(spark, d).withColumn("config", scalars.strip_seed(F.col("overrides")))
    seeds = F.array_join(F.array_sort(F.collect_set(F.col("seed").cast("string"))), ",")
    return rows.groupBy("model", "feature", "config").agg(F.count("*").alias("n_runs"), seeds.alias("seeds"), F.round(F.avg("balanced_accuracy"), 8).alias("mean"), r6(F.stddev_samp("balanced_accuracy")).alias("std"))


@query("runs_null_seed_group", ctes("runs") + " SELECT seed, count(*) AS n, round(avg(roc_auc), 8) AS mean FROM runs GROUP BY seed")
def runs_null_seed(spark, d):
    return runs(spark, d).groupBy("seed").agg(F.count("*").alias("n"), F.round(F.avg("roc_auc"), 8).alias("mean"))


@query("focused_comparison", ctes("runs") + " SELECT run, model, balanced_accuracy, row_number() OVER (ORDER BY balanced_accuracy DESC, run) AS place FROM runs WHERE split = 'test' AND level = 'subject'")
def focused(spark, d):
    rows = runs(spark, d).filter("split = 'test' AND level = 'subject'")
    return rows.select("run", "model", "balanced_accuracy", F.row_number().over(Window.orderBy(F.desc("balanced_accuracy"), "run")).cast("long").alias("place"))


@query("runs_pivot", ctes("runs") + " SELECT model, feature, " + ", ".join(f"round(max(balanced_accuracy) FILTER (seed = {k}), 6) AS seed_{k}" for k in range(1, 7)) + " FROM runs GROUP BY model, feature")
def runs_pivot(spark, d):
    seeds = list(range(1, 7))
    wide = runs(spark, d).groupBy("model", "feature").pivot("seed", seeds).agg(r6(F.max("balanced_accuracy")))
    return wide.withColumnsRenamed({str(k): f"seed_{k}" for k in seeds})


@query("describe_scores", ctes("scores") + " SELECT count(s) AS n, count(*) - count(s) AS nulls, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, min(s) AS least, quantile_disc(s, 0.25) AS q25, quantile_disc(s, 0.5) AS q50, quantile_disc(s, 0.75) AS q75, max(s) AS most FROM scores")
def describe_scores(spark, d):
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY s)")
    return scores(spark, d).agg(F.count("s").alias("n"), (F.count("*") - F.count("s")).alias("nulls"), r6(F.avg("s")).alias("mean"), r6(F.stddev_samp("s")).alias("std"), F.min("s").alias("least"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("s").alias("most"))


@query("dipole_percentiles", ctes("components") + " SELECT unnest([1, 5, 25, 50, 75, 95, 99]) AS pct, unnest(list_transform(quantile_cont(gof, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]), lambda v: round(v, 6))) AS gof, round((SELECT avg(CAST(gof >= 20 AS INTEGER)) FROM components), 6) AS share FROM components")
def dipole_percentiles(spark, d):
    pct = [1, 5, 25, 50, 75, 95, 99]
    rows = components(spark, d).agg(F.percentile("gof", F.array(*[F.lit(p / 100) for p in pct])).alias("v"), r6(F.avg((F.col("gof") >= 20).cast("int"))).alias("share"))
    return rows.select(F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in pct]).alias("pct"), F.col("v").alias("gof"))).alias("x"), "share").select("x.pct", r6("x.gof").alias("gof"), "share")


@query("status_tally", ctes("rec") + " SELECT CASE WHEN duration < 60 THEN 'short' WHEN n_seizure > 0 THEN 'seizure' ELSE 'ok' END AS status, count(*) AS n FROM rec GROUP BY 1")
def status_tally(spark, d):
    status = F.when(F.col("duration") < 60, "short").when(F.col("n_seizure") > 0, "seizure").otherwise("ok")
    return recordings(spark, d).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


POWER_SQL = """m AS (SELECT path, rate, subject, round_even(10 * log10(list_sum(p) * 0.5::DOUBLE + 1e-30::DOUBLE), 2) AS power, round_even(list_max(p) / list_sum(p), 3) AS roughness, round_even(exp(list_avg(list_transform(p, lambda v: ln(v + 1e-30::DOUBLE)))) / (list_avg(p) + 1e-30::DOUBLE), 4) AS flatness FROM psd)"""
Z_SQL = """md AS (SELECT median(power) AS a, median(roughness) AS b, median(flatness) AS c FROM m), dv AS (SELECT median(abs(power - a)) AS da, median(abs(roughness - b)) AS db, median(abs(flatness - c)) AS dc FROM m, md),
z AS (SELECT m.*, abs((power - a) / (1.4826::DOUBLE * (da + 1e-30::DOUBLE))) AS z_power, (roughness - b) / (1.4826::DOUBLE * (db + 1e-30::DOUBLE)) AS z_roughness, abs((flatness - c) / (1.4826::DOUBLE * (dc + 1e-30::DOUBLE))) AS z_flatness FROM m, md, dv)"""


def simple_metrics(spark, d):
    """Metrics that depend on single spectra alone: total power, peak share and flatness, rounded."""
    total = F.aggregate("p", F.lit(0.0), lambda a, v: a + v)
    logs = F.aggregate("p", F.lit(0.0), lambda a, v: a + F.log(v + F.lit(1e-30)))
    n = F.size("p")
    return psd(spark, d).select("path", "rate", "subject", F.bround(F.lit(10.0) * F.log10(total * F.lit(0.5) + F.lit(1e-30)), 2).alias("power"), F.bround(F.array_max("p") / total, 3).alias("roughness"), F.bround(F.exp(logs / n) / (total / n + F.lit(1e-30)), 4).alias("flatness"))


@query("robust_z", ctes("psd") + ",\n" + POWER_SQL + ",\n" + Z_SQL + " SELECT path, power, roughness, flatness, round(z_power, 4) AS z_power, round(z_roughness, 4) AS z_roughness, round(z_flatness, 4) AS z_flatness FROM z")
def robust_z(spark, d):
    rows = ranking.robust_z(simple_metrics(spark, d))
    return rows.select("path", *ranking.METRICS, *[F.round(f"z_{m}", 4).alias(f"z_{m}") for m in ranking.METRICS])


FUSED = {
    "l1": "z_power + z_roughness + z_flatness",
    "l2": "sqrt(greatest(z_power, 0) * greatest(z_power, 0) + greatest(z_roughness, 0) * greatest(z_roughness, 0) + greatest(z_flatness, 0) * greatest(z_flatness, 0))",
    "borda": " + ".join(f"CAST(row_number() OVER (ORDER BY z_{m}, path) - 1 AS DOUBLE)" for m in ranking.METRICS),
    "rrf": " + ".join(f"1.0::DOUBLE / (60.0::DOUBLE + row_number() OVER (ORDER BY z_{m} DESC, path))" for m in ranking.METRICS),
}


def anomalies(spark, d, method):
    return ranking.fused(ranking.robust_z(simple_metrics(spark, d)), method)


for _method, _sql in FUSED.items():
    query(f"anomaly_{_method}", ctes("psd") + ",\n" + POWER_SQL + ",\n" + Z_SQL + f" SELECT path, subject, round({_sql}, 4) AS anomaly FROM z")(lambda spark, d, m=_method: anomalies(spark, d, m).select("path", "subject", F.round("anomaly", 4).alias("anomaly")))


@query("exclusion_top_per_rate", ctes("psd") + ",\n" + POWER_SQL + ",\n" + Z_SQL + f", s AS (SELECT path, rate, {FUSED['rrf']} AS anomaly FROM z), w AS (SELECT unnest([250.0::DOUBLE, 256.0::DOUBLE]) AS rate, unnest([5, 3]) AS n), k AS (SELECT s.path, w.rate, w.n, row_number() OVER (PARTITION BY w.rate ORDER BY anomaly DESC, path) AS r FROM s JOIN w ON abs(s.rate - w.rate) <= 0.5) SELECT path, rate AS wanted FROM k WHERE r <= n")
def exclusion_top(spark, d):
    wanted = spark.createDataFrame([(250.0, 5), (256.0, 3)], "rate double, n int")
    return ranking.top_per_rate(anomalies(spark, d, "rrf"), wanted).select("path", "wanted")


@query("manifest_rank", ctes("psd") + ",\n" + POWER_SQL + ",\n" + Z_SQL + f", s AS (SELECT path, subject, rate, round({FUSED['l1']}, 4) AS anomaly FROM z) SELECT path, rate, anomaly, row_number() OVER (PARTITION BY rate ORDER BY anomaly DESC, subject, path) AS place FROM s")
def manifest_rank(spark, d):
    rows = anomalies(spark, d, "l1").withColumn("anomaly", F.round("anomaly", 4))
    order = Window.partitionBy("rate").orderBy(F.desc("anomaly"), "subject", "path")
    return rows.select("path", "rate", "anomaly", F.row_number().over(order).cast("long").alias("place"))


@query("anomaly_threshold_or_top", ctes("psd") + ",\n" + POWER_SQL + ",\n" + Z_SQL + f", s AS (SELECT path, round({FUSED['l1']}, 4) AS anomaly FROM z) SELECT path, anomaly FROM s QUALIFY row_number() OVER (ORDER BY anomaly DESC, path) <= 10 OR anomaly >= 8")
def anomaly_threshold(spark, d):
    rows = anomalies(spark, d, "l1").select("path", F.round("anomaly", 4).alias("anomaly"))
    top = rows.orderBy(F.desc("anomaly"), "path").limit(10)
    return rows.filter("anomaly >= 8").union(top).distinct()


@query("dedupe_anomalies", "SELECT CAST(l_partkey AS VARCHAR) AS path, max(l_extendedprice) AS anomaly FROM lineitem GROUP BY 1")
def dedupe_anomalies(spark, d):
    return ranking.best_of_duplicates(table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("path"), F.col("l_extendedprice").alias("anomaly")))


BINS_SQL = "b AS (SELECT * EXCLUDE (p, i), CAST(i - 1 AS INTEGER) AS k, p[i] AS p FROM psd, unnest(range(1, 65)) AS t(i))"


@query("recording_metrics", ctes("psd") + ",\n" + BINS_SQL + """, l AS (SELECT path, k, p, 10 * log10(p + 1e-30::DOUBLE) AS lp FROM b), g AS (SELECT path, p, lp - sum(lp) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11 AS gap FROM l)
SELECT path, round_even(10 * log10(sum(p) * 0.5::DOUBLE + 1e-30::DOUBLE), 2) AS power, round_even(sqrt(avg(gap * gap)), 3) AS roughness, round_even(exp(avg(ln(p + 1e-30::DOUBLE))) / (avg(p) + 1e-30::DOUBLE), 4) AS flatness FROM g GROUP BY path""")
def recording_metrics(spark, d):
    return spectral.recording_metrics(psd(spark, d))


@query("subject_psd", ctes("psd") + ",\n" + BINS_SQL + " SELECT cls, subject, k, round(sum(n_times * p) / sum(n_times), 9) AS p FROM b GROUP BY cls, subject, k")
def subject_psd(spark, d):
    return spectral.subject_psd(psd(spark, d)).withColumn("p", F.round("p", 9))


SUBJECT_SQL = BINS_SQL + ", sp AS (SELECT cls, subject, k, sum(n_times * p) / sum(n_times) AS p FROM b GROUP BY cls, subject, k)"


@query("class_psd", ctes("psd") + ",\n" + SUBJECT_SQL + " SELECT cls, k, round(avg(p), 9) AS mean, round(median(p), 9) AS middle FROM sp GROUP BY cls, k")
def class_psd(spark, d):
    return spectral.class_psd(psd(spark, d)).select("cls", "k", F.round("mean", 9).alias("mean"), F.round("middle", 9).alias("middle"))


@query("class_relative_psd", ctes("psd") + ",\n" + SUBJECT_SQL + ", c AS (SELECT cls, k, avg(p) AS m FROM sp GROUP BY cls, k) SELECT cls, k, round(m / sum(m) OVER (PARTITION BY cls), 9) AS share FROM c")
def class_relative(spark, d):
    return spectral.relative(spectral.class_psd(psd(spark, d)), ["cls"], "mean").select("cls", "k", F.round("share", 9).alias("share"))


@query("unit_power", ctes("psd") + " SELECT path, round(list_max(p) / (list_sum(p) + 1e-30::DOUBLE), 9) AS peak_share FROM psd")
def unit_power(spark, d):
    total = F.aggregate("p", F.lit(0.0), lambda a, v: a + v) + F.lit(1e-30)
    return psd(spark, d).select("path", F.round(F.array_max(F.transform("p", lambda v: v / total)), 9).alias("peak_share"))


@query("high_frequency_share", ctes("psd") + " SELECT path, round(list_sum(p[33:]) / (list_sum(p) + 1e-30::DOUBLE), 9) AS hf FROM psd")
def high_frequency(spark, d):
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)
    return psd(spark, d).select("path", F.round(total(F.slice("p", 33, 64)) / (total(F.col("p")) + F.lit(1e-30)), 9).alias("hf"))


@query("band_power", ctes("psd") + ",\n" + BINS_SQL + ", bands AS (SELECT unnest(['delta', 'theta', 'alpha', 'beta', 'gamma']) AS band, unnest([1.0, 4.0, 8.0, 13.0, 30.0]) AS lo, unnest([4.0, 8.0, 13.0, 30.0, 100.0]) AS hi) SELECT path, band, round(avg(p), 9) AS mean FROM b JOIN bands ON k * 0.5 BETWEEN lo AND hi GROUP BY path, band")
def band_power(spark, d):
    bands = spark.createDataFrame(list(spectral.BANDS), "band string, lo double, hi double")
    return spectral.band_power(psd(spark, d), bands).withColumn("mean", F.round("mean", 9))


@query("auto_band", ctes("psd") + ",\n" + BINS_SQL + ", l AS (SELECT path, k, 10 * log10(p + 1e-30::DOUBLE) AS lp FROM b), g AS (SELECT path, k, round(lp - sum(lp) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11, 6) AS gap FROM l) SELECT path, greatest(k * 0.5::DOUBLE - 2, 0) AS lo, k * 0.5::DOUBLE + 2 AS hi FROM g WHERE k * 0.5 >= 1 QUALIFY row_number() OVER (PARTITION BY path ORDER BY gap DESC, k) = 1")
def auto_band(spark, d):
    near = Window.partitionBy("path").orderBy("k").rowsBetween(-5, 5)
    rows = spectral.bins(psd(spark, d)).withColumn("lp", F.lit(10.0) * F.log10(F.col("p") + F.lit(1e-30)))
    rows = rows.withColumn("gap", F.round(F.col("lp") - F.sum("lp").over(near) / 11, 6)).filter("f >= 1")
    best = rows.groupBy("path").agg(F.max_by("f", F.struct("gap", -F.col("k"))).alias("f"))
    return best.select("path", F.greatest(F.col("f") - 2, F.lit(0.0)).alias("lo"), (F.col("f") + 2).alias("hi"))


@query("hot_segments", "WITH s AS (SELECT user_id, event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS tile, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY mean DESC, tile) AS hot, row_number() OVER (PARTITION BY user_id, event_type ORDER BY mean, tile) AS cold, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM s) SELECT user_id, event_type, 'hot' AS kind, tile, mean FROM r WHERE n >= 2 AND hot <= 5 UNION ALL SELECT user_id, event_type, 'cold', tile, mean FROM r WHERE n >= 2 AND cold = 1")
def hot_segments(spark, d):
    tile = F.floor(F.col("ts").cast("timestamp").cast("long") / 86400)
    s = table(spark, d, "events").groupBy("user_id", "event_type", tile.alias("tile")).agg(r6(F.avg("value")).alias("mean"))
    part = Window.partitionBy("user_id", "event_type")
    ranked = s.withColumns({"hot": F.row_number().over(part.orderBy(F.desc("mean"), "tile")), "cold": F.row_number().over(part.orderBy("mean", "tile")), "n": F.count("*").over(part)}).filter("n >= 2")
    pick = lambda kind, rule: ranked.filter(rule).select("user_id", "event_type", F.lit(kind).alias("kind"), "tile", "mean")
    return pick("hot", "hot <= 5").union(pick("cold", "cold = 1"))


@query("stems_full_outer", "SELECT coalesce(a.s, b.s) AS stem, a.s IS NOT NULL AS has_segments, b.s IS NOT NULL AS has_spectrogram FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 50) a FULL JOIN (SELECT s_suppkey AS s FROM supplier WHERE s_acctbal > 0) b ON a.s = b.s")
def stems_full_outer(spark, d):
    a = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 50").select("l_suppkey").distinct()
    b = table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey")
    joined = a.join(b, F.col("l_suppkey") == F.col("s_suppkey"), "full_outer")
    return joined.select(F.coalesce("l_suppkey", "s_suppkey").alias("stem"), F.col("l_suppkey").isNotNull().alias("has_segments"), F.col("s_suppkey").isNotNull().alias("has_spectrogram"))


@query("recording_drilldown", ctes("psd") + ",\n" + BINS_SQL + " SELECT subject, path, k, round(p, 9) AS p FROM b UNION ALL SELECT subject, 'mean', k, round(sum(n_times * p) / sum(n_times), 9) FROM b GROUP BY subject, k")
def recording_drilldown(spark, d):
    return spectral.drilldown(psd(spark, d)).withColumn("p", F.round("p", 9))


@query("custom_band_power", ctes("psd") + ",\n" + BINS_SQL + ", bands AS (SELECT unnest(['0.5-4', '4-12', '12-30']) AS band, unnest([0.5, 4.0, 12.0]) AS lo, unnest([4.0, 12.0, 30.0]) AS hi) SELECT path, band, round(avg(p), 9) AS mean FROM b JOIN bands ON k * 0.5 BETWEEN lo AND hi GROUP BY path, band")
def custom_band_power(spark, d):
    bands = spark.createDataFrame(spectral.band_list(edges=[12, 0.5, 4, 30, 4]), "band string, lo double, hi double")
    return spectral.band_power(psd(spark, d), bands).withColumn("mean", F.round("mean", 9))


@query("subject_highlights", ctes("psd") + ",\n" + BINS_SQL + """, sp AS (SELECT subject AS path, k, sum(n_times * p) / sum(n_times) AS p FROM b GROUP BY subject, k),
l AS (SELECT path, k, p, 10 * log10(p + 1e-30::DOUBLE) AS lp FROM sp), g AS (SELECT path, k, p, lp - sum(lp) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11 AS gap FROM l),
m AS (SELECT path, round_even(10 * log10(sum(p) * 0.5::DOUBLE + 1e-30::DOUBLE), 2) AS power, round_even(sqrt(avg(gap * gap)), 3) AS roughness, round_even(exp(avg(ln(p + 1e-30::DOUBLE))) / (avg(p) + 1e-30::DOUBLE), 4) AS flatness, round(sum(p) FILTER (k >= 32) / (sum(p) + 1e-30::DOUBLE), 9) AS hf FROM g GROUP BY path),
c AS (SELECT median(power) AS a, median(roughness) AS b, median(flatness) AS c, median(hf) AS d FROM m), w AS (SELECT median(abs(power - a)) AS a2, median(abs(roughness - b)) AS b2, median(abs(flatness - c)) AS c2, median(abs(hf - d)) AS d2 FROM m, c),
z AS (SELECT path, abs(power - a) / (1.4826::DOUBLE * (a2 + 1e-30::DOUBLE)) + (roughness - b) / (1.4826::DOUBLE * (b2 + 1e-30::DOUBLE)) + abs(flatness - c) / (1.4826::DOUBLE * (c2 + 1e-30::DOUBLE)) + (hf - d) / (1.4826::DOUBLE * (d2 + 1e-30::DOUBLE)) AS anomaly FROM m, c, w)
SELECT path AS subject, round(anomaly, 4) AS anomaly FROM z QUALIFY row_number() OVER (ORDER BY anomaly DESC, path) <= 10""")
def subject_highlights(spark, d):
    """The ten most anomalous subjects by power, roughness, flatness and the share above the middle frequency."""
    whole = spectral.subject_psd(psd(spark, d).withColumn("cls", F.lit(0))).groupBy(F.col("subject").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda b: b["p"]).alias("p"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)
    hf = whole.select(F.col("path").alias("of"), F.round(total(F.slice("p", 33, 64)) / (total(F.col("p")) + F.lit(1e-30)), 9).alias("hf"))
    rows = spectral.recording_metrics(whole).join(hf, F.col("path") == F.col("of")).drop("of")
    names = ("power", "roughness", "flatness", "hf")
    fused = ranking.fused(ranking.robust_z(rows, names), "l1", metrics=names)
    return fused.orderBy(F.desc("anomaly"), "path").limit(10).select(F.col("path").alias("subject"), F.round("anomaly", 4).alias("anomaly"))


@query("anomalies_by_stem", "SELECT l_suppkey || '_s' || l_linenumber AS stem, max_by(l_extendedprice, (l_orderkey * 10 + l_linenumber, l_extendedprice)) AS anomaly FROM lineitem GROUP BY l_suppkey, l_linenumber")
def anomalies_by_stem(spark, d):
    """One score for each file stem of several lists, the last one listed."""
    rows = table(spark, d, "lineitem").select(F.format_string("/corpus/%d/%d_s%d.edf", "l_orderkey", "l_suppkey", "l_linenumber").alias("path"), F.col("l_extendedprice").alias("anomaly"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return ranking.last_by_stem(rows)
