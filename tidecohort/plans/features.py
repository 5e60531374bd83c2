"""Queries over convolution features, kernel rankings, scaling and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecohort.operators import features, models
from tidecohort.plans.register import query
from tidecohort.plans.signals import four_channels
from tidecohort.sources.fixtures import ctes, kernel_counts, psd, signals, table

SHARE_SQL = "s AS (SELECT *, CAST(value AS DOUBLE) / sum(value) OVER (PARTITION BY cls, dilation, diff, grp) AS share FROM kernel_counts)"
DISC_SQL = SHARE_SQL + ", f AS (SELECT dilation, diff, grp, kernel, coalesce(max(share) FILTER (cls = 1), 0) AS a, coalesce(max(share) FILTER (cls = 0), 0) AS b FROM s GROUP BY ALL)"


@query("within_group_share", ctes("kernel_counts") + ", " + SHARE_SQL + " SELECT cls, dilation, diff, grp, kernel, round(share, 9) AS share FROM s")
def within_group_share(spark, d):
    return features.within_group(kernel_counts(spark, d)).select("cls", *features.SLOT, F.round("share", 9).alias("share"))


@query("top_kernels", ctes("kernel_counts") + " SELECT dilation, diff, grp, kernel, CAST(sum(value) AS BIGINT) AS value FROM kernel_counts GROUP BY ALL ORDER BY value DESC, dilation, diff, grp, kernel LIMIT 20")
def top_kernels(spark, d):
    total = kernel_counts(spark, d).groupBy(*features.SLOT).agg(F.sum("value").alias("value"))
    return features.top(total, F.col("value"), 20)


for _metric, _sql in (("difference", "a - b"), ("ratio", "(a + 1e-6::DOUBLE) / (b + 1e-6::DOUBLE)"), ("logodds", "ln((a + 1e-6::DOUBLE) / (1 - a + 1e-6::DOUBLE)) - ln((b + 1e-6::DOUBLE) / (1 - b + 1e-6::DOUBLE))")):
    query(f"discriminative_{_metric}", ctes("kernel_counts") + ", " + DISC_SQL + f" SELECT dilation, diff, grp, kernel, round({_sql}, 6) AS score, {_sql} >= {1 if _metric == 'ratio' else 0} AS favours_a FROM f")(
        lambda spark, d, m=_metric: features.discriminative(kernel_counts(spark, d), 1, 0, m).select(*features.SLOT, F.round("score", 6).alias("score"), "favours_a")
    )


@query("discriminative_per_class", ctes("kernel_counts") + ", " + DISC_SQL + " SELECT dilation, diff, grp, kernel, round(a - b, 9) AS score, a - b >= 0 AS favours_a FROM f QUALIFY row_number() OVER (PARTITION BY a - b >= 0 ORDER BY round(abs(a - b), 12) DESC, dilation, diff, grp, kernel) <= 5")
def discriminative_per_class(spark, d):
    rows = features.discriminative(kernel_counts(spark, d), 1, 0)
    place = F.row_number().over(Window.partitionBy("favours_a").orderBy(F.round("strength", 12).desc(), *features.SLOT))
    return rows.withColumn("place", place).filter("place <= 5").select(*features.SLOT, F.round("score", 9).alias("score"), "favours_a")


KERNELS_SQL = "k AS (SELECT vec_id, CAST(pow(2, vec_id % 3) AS INTEGER) AS dilation, CAST(vec_id % 2 AS INTEGER) AS diff, x[1:9] AS w FROM signals)"
RESPONSE_SQL = "sqrt(pow(list_sum(list_transform(range(0, 9), lambda j: w[j + 1] * cos(2 * pi() / 250 * f * dilation * j))), 2) + pow(list_sum(list_transform(range(0, 9), lambda j: w[j + 1] * sin(2 * pi() / 250 * f * dilation * j))), 2)) * CASE WHEN diff = 1 THEN 2 * abs(sin(pi() / 250 * f)) ELSE 1 END"


def kernels(spark, d):
    return signals(spark, d).select("vec_id", F.pow(F.lit(2), F.col("vec_id") % 3).cast("int").alias("dilation"), (F.col("vec_id") % 2).cast("int").alias("diff"), F.slice("x", 1, 9).alias("weights"))


@query("kernel_response", ctes("signals") + ", " + KERNELS_SQL + f", g AS (SELECT *, unnest([0.0::DOUBLE, 5.0::DOUBLE, 12.5::DOUBLE, 40.0::DOUBLE]) AS f FROM k) SELECT vec_id, f, round({RESPONSE_SQL}, 6) AS h FROM g")
def kernel_response(spark, d):
    rows = kernels(spark, d).withColumn("f", F.explode(F.array(*[F.lit(v) for v in (0.0, 5.0, 12.5, 40.0)])))
    return rows.select("vec_id", "f", F.round(features.response(F.col("weights"), F.col("f"), 250.0, F.col("dilation"), F.col("diff")), 6).alias("h"))


@query("kernel_peaks", ctes("signals") + ", " + KERNELS_SQL + f", g AS (SELECT *, i * (CASE WHEN diff = 1 THEN 125.0::DOUBLE ELSE 125.0::DOUBLE / dilation END) / 256 AS f FROM k, unnest(range(257)) AS u(i)), h AS (SELECT vec_id, f, {RESPONSE_SQL} AS h FROM g), r AS (SELECT vec_id, f, round(h, 9) AS h FROM h) SELECT vec_id, round(max_by(f, (h, -f)), 6) AS peak_hz, round(sum(h * f) / sum(h), 4) AS centroid_hz FROM r GROUP BY vec_id")
def kernel_peaks(spark, d):
    return features.peaks(kernels(spark, d), 250.0).select("vec_id", F.round("peak_hz", 6).alias("peak_hz"), F.round("centroid_hz", 4).alias("centroid_hz"))


@query("peak_histogram", ctes("signals") + ", " + KERNELS_SQL + f", g AS (SELECT *, i * (CASE WHEN diff = 1 THEN 125.0::DOUBLE ELSE 125.0::DOUBLE / dilation END) / 256 AS f FROM k, unnest(range(257)) AS u(i)), h AS (SELECT vec_id, f, round({RESPONSE_SQL}, 9) AS h FROM g), r AS (SELECT vec_id, max_by(f, (h, -f)) AS peak_hz FROM h GROUP BY vec_id) SELECT vec_id % 2 = 0 AS favours_a, CAST(least(floor(peak_hz / 12.5::DOUBLE), 7) AS BIGINT) AS bin, count(*) AS n FROM r JOIN signals USING (vec_id) WHERE peak_hz BETWEEN 0 AND 100 GROUP BY ALL")
def peak_histogram(spark, d):
    """Kernels by the frequency they answer to most, in bins of 12.5 Hz up to 100 Hz, for two groups of kernels."""
    rows = features.peaks(kernels(spark, d), 250.0).withColumn("favours_a", F.col("vec_id") % 2 == 0)
    return features.peak_histogram(rows, 12.5, 100.0).withColumn("bin", F.col("bin").cast("long"))


@query("kernel_sensitivity", ctes("signals") + ", " + KERNELS_SQL + f", g AS (SELECT *, i * 2.0::DOUBLE AS f FROM k, unnest(range(20)) AS u(i)), h AS (SELECT f, sum(vec_id % 7 * pow({RESPONSE_SQL}, 2)) AS s FROM g GROUP BY f) SELECT f, round(s / max(s) OVER (), 6) AS sensitivity FROM h")
def kernel_sensitivity(spark, d):
    rows = kernels(spark, d).withColumn("f", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i * F.lit(2.0))))
    h = features.response(F.col("weights"), F.col("f"), 250.0, F.col("dilation"), F.col("diff"))
    summed = rows.groupBy("f").agg(F.sum(F.col("vec_id") % 7 * F.pow(h, F.lit(2))).alias("s"))
    return summed.select("f", F.round(F.col("s") / F.max("s").over(Window.partitionBy()), 6).alias("sensitivity"))


@query("scaler_statistics", ctes("psd") + ", v AS (SELECT i - 1 AS k, sqrt(greatest(p[i] - 0.01::DOUBLE, 0)) AS v FROM psd, unnest(range(1, 65)) AS u(i)) SELECT CAST(k AS INTEGER) AS k, round(avg(v), 6) AS mean, round(stddev_samp(v) + pow(avg(CAST(v = 0 AS DOUBLE)), 4) + 1e-8::DOUBLE, 6) AS std FROM v GROUP BY k")
def scaler_statistics(spark, d):
    rows = psd(spark, d).select(F.transform("p", lambda v: v - F.lit(0.01)).alias("features"))
    return models.scaler_statistics(rows).select("k", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def windows(spark, d):
    return signals(spark, d).select(F.col("vec_id").alias("window_id"), "subject", F.col("y").cast("int").alias("y"), four_channels().alias("x"))


def bank():
    return features.Bank(16, 4, kernels=4, groups=4)


def competition_sql(bank: features.Bank, source: str) -> str:
    """The competing convolution as relations over ``win (vec_id, ch)``: kernels by taps, a winner and a loser each time.

    Gives ``slots`` (all kernels with the competition), ``won`` (winners with their response) and ``lost``.
    """
    listed = ", ".join(
        f"({dil}, {r}, {g}, {k}, {[float(v) for v in w]}::DOUBLE[], {bank.channels[d, r, g].tolist()})"
        for d, dil in enumerate(bank.dilations.tolist()) for r, g, k in np.ndindex(*bank.weights.shape[1:4]) for w in [bank.weights[d, r, g, k]]
    )
    return f"""{source},
kern AS (SELECT * FROM (VALUES {listed}) AS t(dil, r, g, k, w, c)),
rep AS (SELECT vec_id, 0 AS r, ch FROM win UNION ALL SELECT vec_id, 1, list_transform(ch, lambda s: list_transform(range(1, len(s)), lambda i: s[i + 1] - s[i])) FROM win),
mixed AS (SELECT vec_id, dil, r, g, k, w, len(ch[1]) AS n, list_transform(range(1, len(ch[1]) + 1), lambda t: list_sum(list_transform(CASE WHEN len(ch) > 1 THEN c ELSE [0] END, lambda q: ch[q + 1][t]))) AS m FROM rep JOIN kern USING (r)),
times AS (SELECT *, unnest(range(1, n + 1)) AS t FROM mixed),
resp AS (SELECT vec_id, dil, r, g, k, t, list_sum(list_transform(range(9), lambda j: CASE WHEN t + (j - 4) * dil BETWEEN 1 AND n THEN w[j + 1] * m[t + (j - 4) * dil] ELSE 0 END)) AS v FROM times),
won AS (SELECT * FROM resp QUALIFY row_number() OVER (PARTITION BY vec_id, dil, r, g, t ORDER BY v DESC, k) = 1),
lost AS (SELECT * FROM resp QUALIFY row_number() OVER (PARTITION BY vec_id, dil, r, g, t ORDER BY v, k) = 1),
scored AS (SELECT vec_id, dil, r, 0 AS hard, g, k, sum(v) AS v FROM won GROUP BY ALL UNION ALL SELECT vec_id, dil, r, 1, g, k, count(*) FROM lost GROUP BY ALL),
slots AS (SELECT DISTINCT dil, r, hard, g, k FROM kern, (SELECT unnest([0, 1]) AS hard)),
dense AS (SELECT w.vec_id, s.*, coalesce(f.v, 0) AS v, row_number() OVER (PARTITION BY w.vec_id ORDER BY s.dil, s.r, s.hard, s.g, s.k) - 1 AS place
  FROM win w CROSS JOIN slots s LEFT JOIN scored f ON f.vec_id = w.vec_id AND f.dil = s.dil AND f.r = s.r AND f.hard = s.hard AND f.g = s.g AND f.k = s.k)"""


CHANNELS_SQL = "win AS (SELECT vec_id, y, [x[1:16], x[17:32], x[33:48], x[49:64]] AS ch FROM signals)"


@query("convolution_features", ctes("signals") + ", " + competition_sql(bank(), CHANNELS_SQL) + " SELECT vec_id AS window_id, CAST(place AS INTEGER) AS k, round(v, 6) AS v FROM dense")
def convolution_features(spark, d):
    """Soft and hard wins of every kernel, a row a feature; the SQL builds responses, winners and losers as relations."""
    rows = features.transform(windows(spark, d), bank(), exact=True)
    return rows.select("window_id", F.posexplode("features").alias("k", "v")).withColumn("v", F.round("v", 6))


@query("kernel_win_counts", ctes("signals") + ", " + competition_sql(bank(), CHANNELS_SQL) + """, taken AS (SELECT vec_id, 0 AS hard, dil, r, g, k, v FROM won UNION ALL SELECT vec_id, 1, dil, r, g, k, v FROM lost),
sums AS (SELECT w.y, t.hard, t.dil, t.r, t.g, t.k, count(*) AS n, sum(abs(t.v)) AS m FROM taken t JOIN win w USING (vec_id) GROUP BY ALL)
SELECT CAST(c.y AS INTEGER) AS cls, CASE WHEN s.hard = 1 THEN 'min' ELSE 'max' END AS competition, CAST(s.dil AS INTEGER) AS dilation, CAST(s.r AS INTEGER) AS "diff", CAST(s.g AS INTEGER) AS grp, CAST(s.k AS INTEGER) AS kernel, coalesce(n, 0) AS frequency, round(coalesce(m, 0), 4) AS magnitude
FROM (SELECT DISTINCT y FROM win) c CROSS JOIN slots s LEFT JOIN sums u ON u.y = c.y AND u.hard = s.hard AND u.dil = s.dil AND u.r = s.r AND u.g = s.g AND u.k = s.k""")
def kernel_win_counts(spark, d):
    counted = features.win_counts(windows(spark, d), bank())
    return counted.withColumn("magnitude", F.round("magnitude", 4))


BAG_BANK = features.Bank(64, 1, kernels=4, groups=2)
BAG_SQL = "every AS (SELECT vec_id, vec_id // 4 AS bag, vec_id % 7 = 0 OR vec_id // 4 % 5 = 0 AS silent, x FROM signals), win AS (SELECT vec_id, bag, [x] AS ch FROM every WHERE NOT silent)"


@query("bag_features", ctes("signals") + ", " + competition_sql(BAG_BANK, BAG_SQL) + f""", pooled AS (SELECT bag, place, avg(v) AS mean, max(v) AS most, stddev_pop(v) AS std, count(*) AS n FROM dense JOIN win USING (vec_id) GROUP BY ALL)
SELECT b.bag AS window_id, CAST(u.k AS INTEGER) AS k, round(coalesce(mean, 0), 4) AS mean, round(coalesce(most, 0), 4) AS most, round(coalesce(std, 0), 4) AS std, coalesce(n, 0) AS n FROM (SELECT DISTINCT bag FROM every) b CROSS JOIN unnest(range({BAG_BANK.width})) AS u(k) LEFT JOIN pooled p ON p.bag = b.bag AND p.place = u.k""")
def bag_features(spark, d):
    """Pooled features of bags of components; every seventh component is silent, and every fifth bag has no other."""
    silent = (F.col("vec_id") % 7 == 0) | (F.col("bag") % 5 == 0)
    parts = signals(spark, d).withColumn("bag", F.expr("vec_id div 4"))
    parts = parts.select(F.col("bag").alias("window_id"), F.when(silent, F.transform("x", lambda v: F.lit(0.0))).otherwise(F.col("x")).alias("x"))
    return features.bag_features(parts, BAG_BANK).withColumns({c: F.round(c, 4) for c in ("mean", "most", "std")})
