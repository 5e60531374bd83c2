"""Queries over detection, band series, alignment to decompositions, component bags, and SQL functions over signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecohort.functions import sql
from tidecohort.operators import chain, detection, features, signal
from tidecohort.plans.cleaning import FS, NAMES, REPAIR_SQL, total
from tidecohort.plans.features import CHANNELS_SQL, bank, competition_sql, windows
from tidecohort.plans.register import query
from tidecohort.plans.signals import WELCH_SQL, four_channels, welch_sql
from tidecohort.sources.fixtures import components, ctes, signals, table

LEAST, SHARE, PEAK, MOST_Z = 0.25, 0.5, 0.5, 3.0

RECS_SQL = "recs AS (SELECT vec_id // 4 AS rec, list(x ORDER BY vec_id) AS x FROM signals GROUP BY 1 HAVING count(*) = 4), samples AS (SELECT rec, CAST(c AS INTEGER) AS c, CAST(i AS INTEGER) AS i, x[c + 1][i + 1] AS v FROM recs, unnest(range(4)) AS a(c), unnest(range(64)) AS b(i))"
CORRELATION_SQL = f"""pairs AS (SELECT a.rec, a.c, b.c AS o, a.i // 16 AS w, corr(a.v, b.v) AS r FROM samples a JOIN samples b ON a.rec = b.rec AND a.i = b.i AND a.c <> b.c GROUP BY ALL),
best AS (SELECT rec, c, w, max(abs(r)) AS r FROM pairs GROUP BY ALL), low AS (SELECT rec, c, avg(CAST(r < {LEAST}::DOUBLE AS INTEGER)) AS low FROM best GROUP BY ALL)"""


def recordings(spark, d):
    """(path, names, x): four signals as the channels of a recording at 16 Hz."""
    rows = signals(spark, d).groupBy(F.expr("vec_id div 4").alias("path")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("c")).filter(F.size("c") == 4)
    return rows.select("path", F.array(*[F.lit(n) for n in NAMES]).alias("names"), F.transform("c", lambda c: c["x"]).alias("x"))


@query("correlation_flags", ctes("signals") + ", " + RECS_SQL + ", " + CORRELATION_SQL + f" SELECT rec AS path, c AS ch, round(low, 6) AS low, low > {SHARE}::DOUBLE AS bad FROM low")
def correlation_flags(spark, d):
    """Channels that correlate with no other in too many windows."""
    return detection.correlation_flags(recordings(spark, d), 16, LEAST, SHARE).withColumn("low", F.round("low", 6))


@query("detected_recordings", ctes("signals") + ", " + RECS_SQL + ", " + CORRELATION_SQL + f""",
amp AS (SELECT rec, c, CAST(0.7413 AS DOUBLE) * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS a FROM samples GROUP BY ALL),
mid AS (SELECT rec, quantile_cont(a, 0.5) AS m, CAST(0.7413 AS DOUBLE) * (quantile_cont(a, 0.75) - quantile_cont(a, 0.25)) AS s FROM amp GROUP BY rec),
bad AS (SELECT rec, c, a < 1e-9::DOUBLE OR (s > 0 AND abs((a - m) / s) > {MOST_Z}::DOUBLE) OR low > {SHARE}::DOUBLE AS bad FROM amp JOIN mid USING (rec) JOIN low USING (rec, c)),
tiles AS (SELECT rec, i // 4 AS tile, c, max(v) - min(v) AS peak FROM samples GROUP BY ALL), hit AS (SELECT DISTINCT rec, tile FROM tiles JOIN bad USING (rec, c) WHERE NOT bad AND (peak > {PEAK}::DOUBLE OR peak <= 0)),
isl AS (SELECT rec, tile, tile - row_number() OVER (PARTITION BY rec ORDER BY tile) AS island FROM hit), seg AS (SELECT rec, min(tile) * 0.25::DOUBLE AS start, (max(tile) + 1) * 0.25::DOUBLE AS stop FROM isl GROUP BY rec, island),
segs AS (SELECT rec, count(*) AS n, sum(stop - start) AS bad_s FROM seg GROUP BY rec), names AS (SELECT rec, count(*) AS n, coalesce(string_agg({list(NAMES)}[c + 1], ',' ORDER BY {list(NAMES)}[c + 1]) FILTER (bad), '') AS bads, count(*) FILTER (bad) AS k FROM bad GROUP BY rec)
SELECT rec AS path, CAST(names.n AS INTEGER) AS n_channels, bads, k > 0.3::DOUBLE * names.n AS too_many, CAST(coalesce(segs.n, 0) AS INTEGER) AS n_segments, round(coalesce(bad_s, 0), 6) AS bad_s FROM names LEFT JOIN segs USING (rec)""")
def detected_recordings(spark, d):
    """The detection of whole recordings without filters: bad channels by three criteria, segments on the good ones."""
    options = detection.Detector(high_pass=None, most_z=MOST_Z, window_s=1.0, least_correlation=LEAST, most_share=SHARE, tile_s=0.25, most_peak=PEAK)
    rows = detection.detected(recordings(spark, d), options, FS)
    length = F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["stop"] - s["start"])
    return rows.select("path", "n_channels", F.array_join("bads", ",").alias("bads"), "too_many", F.size("segments").alias("n_segments"), F.round(length, 6).alias("bad_s"))


@query("detected_filtered")
def detected_filtered(spark, d):
    """The same on the filtered copy, after the periodic artifact of each recording has been measured and subtracted."""
    options = detection.Detector(high_pass=1.0, notch=(5.0,), strength=0.1, subtract=True, most_z=MOST_Z, least_correlation=LEAST, most_share=SHARE, tile_s=0.25, most_peak=PEAK)
    return detection.detected(recordings(spark, d), options, FS).withColumns({c: F.round(c, 6) for c in ("f0", "strength")})


#: Tukey weights of segments of 16 samples, and their squared sum times 64 Hz.
TUKEY_SQL = "tukey AS (SELECT list(w ORDER BY j) AS h, 64 * sum(w * w) AS scale FROM (SELECT j, CASE WHEN least(j, 15 - j) / (0.25::DOUBLE * 15 / 2) < 1 THEN 0.5::DOUBLE * (1 - cos(pi() * least(j, 15 - j) / (0.25::DOUBLE * 15 / 2))) ELSE 1 END AS w FROM range(16) AS r(j)))"


def spectrogram_sql(of: str) -> str:
    """A view ``grams`` (vec_id, s, k, p) of half-overlapping segments of signals of 64 samples at 64 Hz."""
    wave = lambda f: f"pow(list_sum(list_transform(range(0, 16), lambda j: x[j + 1] * {f}(2 * pi() * j * k / 16))), 2)"
    return f"""{TUKEY_SQL}, cutup AS (SELECT vec_id, s, x[1 + 8 * s : 16 + 8 * s] AS x FROM {of}, unnest(range(7)) AS u(s)), bent AS (SELECT vec_id, s, scale, list_transform(range(1, 17), lambda j: (x[j] - list_avg(x)) * h[j]) AS x FROM cutup, tukey),
grams AS (SELECT vec_id, s, CAST(k AS INTEGER) AS k, ({wave('cos')} + {wave('sin')}) / scale * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END AS p FROM bent, unnest(range(9)) AS v(k))"""


@query("spectrograms", ctes("signals") + ", " + spectrogram_sql("signals") + " SELECT vec_id, (8 * s + 8) / 64.0::DOUBLE AS t, k * 4.0::DOUBLE AS f, round(10 * log10(p + 1e-20::DOUBLE), 4) AS db FROM grams")
def spectrograms(spark, d):
    return chain.spectrogram(signals(spark, d), 64.0, 0.25, 16).withColumn("db", F.round("db", 4))


@query("spectrogram_scale", ctes("signals") + ", " + spectrogram_sql("signals") + ", db AS (SELECT vec_id, 10 * log10(p + 1e-20::DOUBLE) AS db FROM grams) SELECT vec_id, round(quantile_cont(db, 0.05), 4) AS lo, round(quantile_cont(db, 0.99), 4) AS hi FROM db GROUP BY vec_id")
def spectrogram_scale(spark, d):
    rows = chain.robust_scale(chain.spectrogram(signals(spark, d), 64.0, 0.25, 16))
    return rows.withColumns({c: F.round(c, 4) for c in ("lo", "hi")})


def channel_rows(spark, d):
    """(path, ch, x) of the recordings, one row a channel."""
    return recordings(spark, d).select("path", F.posexplode("x").alias("ch", "x"))


SERIES_SQL = spectrogram_sql("(SELECT vec_id, x FROM signals WHERE vec_id // 4 IN (SELECT rec FROM recs))") + ", series AS (SELECT vec_id // 4 AS path, (8 * s + 8) / 64.0::DOUBLE AS t, avg(p) AS power FROM grams WHERE k * 4 BETWEEN 8 AND 20 GROUP BY ALL)"


def band(spark, d):
    grams = chain.spectrogram(channel_rows(spark, d), 64.0, 0.25, 16, keys=("path", "ch"), power=True)
    return chain.band_series(grams, 8.0, 20.0)


@query("band_series", ctes("signals") + ", " + RECS_SQL + ", " + SERIES_SQL + " SELECT path, t, round(power, 8) AS power FROM series")
def band_series(spark, d):
    """Power of a band over time, averaged over the channels of a recording."""
    return band(spark, d).withColumn("power", F.round("power", 8))


@query("hot_band_segments", ctes("signals") + ", " + RECS_SQL + ", " + SERIES_SQL + """, m AS (SELECT path, CAST(floor(t * 64 / 16) AS BIGINT) AS tile, avg(power) AS power FROM series WHERE t < 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY power DESC, tile) AS hot, row_number() OVER (PARTITION BY path ORDER BY power, tile DESC) AS cold FROM m)
SELECT path, 'hot' AS kind, CAST(hot AS INTEGER) AS place, tile * 0.25::DOUBLE AS start, round(power, 8) AS power FROM r WHERE hot <= 5 UNION ALL SELECT path, 'baseline', 1, tile * 0.25::DOUBLE, round(power, 8) FROM r WHERE cold = 1""")
def hot_band_segments(spark, d):
    """Quarters of a second with the most and the least power in the band."""
    lengths = recordings(spark, d).select("path", F.size(F.get("x", F.lit(0))).alias("n"))
    return chain.hot_segments(band(spark, d), lengths, 64.0, 0.25).withColumn("power", F.round("power", 8))


@query("worst_channels", ctes("signals") + ", " + RECS_SQL + ", " + WELCH_SQL + ", " + welch_sql("signals", "w") + ", e AS (SELECT vec_id // 4 AS path, CAST(vec_id % 4 AS INTEGER) AS ch, sum(p) AS energy FROM w WHERE k * 2 BETWEEN 8 AND 20 AND vec_id // 4 IN (SELECT rec FROM recs) GROUP BY ALL) SELECT path, ch, round(energy, 7) AS energy FROM e QUALIFY row_number() OVER (PARTITION BY path ORDER BY energy DESC, ch) = 1")
def worst_channels(spark, d):
    """The channel of each recording with the most power in the band."""
    spectra = signal.spectra(signals(spark, d), 64.0, 32).select(F.expr("vec_id div 4").alias("path"), (F.col("vec_id") % 4).cast("int").alias("ch"), F.posexplode("p").alias("k", "p"))
    whole = spectra.join(recordings(spark, d).select("path"), "path", "left_semi").withColumn("f", F.col("k") * 2.0)
    return chain.worst_channel(whole, 8.0, 20.0).withColumn("energy", F.round("energy", 7))


@query("aligned_channels", ctes("signals") + """, a AS (SELECT vec_id, x[33:48] AS p, x[1:16] AS q, x[17:32] AS r FROM signals)
SELECT vec_id, vec_id % 9 <> 0 AS ok, CASE WHEN vec_id % 9 <> 0 THEN round(list_sum(list_transform(range(1, 17), lambda i: abs(p[i] - (p[i] + q[i] + r[i]) / 3))), 6) END AS first, CASE WHEN vec_id % 9 <> 0 THEN round(list_sum(list_transform(range(1, 17), lambda i: abs(r[i] - (p[i] + q[i] + r[i]) / 3))), 6) END AS last FROM a""")
def aligned_channels(spark, d):
    """Permuted channels brought to a decomposition's three: renamed, restricted, ordered, average reference; every ninth lacks one."""
    names, k = F.array(*[F.lit(n) for n in NAMES]), (F.col("vec_id") % 4).cast("int")
    turned = lambda c: F.concat(F.slice(c, k + 1, 4), F.slice(c, F.lit(1), k))
    own = F.when(F.col("vec_id") % 9 == 0, F.transform(turned(names), lambda n: F.when(n == "F7", "F9").otherwise(n))).otherwise(turned(names))
    renames = F.create_map(F.lit("EEG FP1-REF"), F.lit("Fp1"), F.lit("EEG T3-LE"), F.lit("T3"))
    rows = signals(spark, d).select("vec_id", chain.aligned(own, turned(four_channels()), F.array(F.lit("T3"), F.lit("Fp1"), F.lit("F7")), renames).alias("x"))
    size = lambda i: F.round(total(F.transform(F.get("x", F.lit(i)), lambda v: F.abs(v))), 6)
    return rows.select("vec_id", F.col("x").isNotNull().alias("ok"), size(0).alias("first"), size(2).alias("last"))


@query("component_bags", ctes("signals") + """, parts AS (SELECT vec_id // 8 AS path, vec_id % 8 AS ic, x[1:6] AS topo, x[7:22] AS s FROM signals WHERE vec_id % 3 < 2),
signed AS (SELECT path, ic, CASE WHEN list_max(topo) >= -list_min(topo) THEN s ELSE list_transform(s, lambda v: -v) END AS s, list_aggregate(s, 'var_pop') AS v FROM parts),
kept AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY v DESC, ic) AS place FROM signed QUALIFY place <= 6)
SELECT p.path, CAST(slot AS INTEGER) AS slot, 16 AS n_times, round(coalesce(list_sum(list_transform(range(1, 17), lambda i: i * s[i])), 0), 6) AS moment FROM (SELECT DISTINCT path FROM parts) p CROSS JOIN unnest(range(6)) AS u(slot) LEFT JOIN kept k ON k.path = p.path AND k.place = slot + 1""")
def component_bags(spark, d):
    """Six slots for each decomposition: components by variance, turned to a positive topography, empty slots zero."""
    kept = signals(spark, d).filter("vec_id % 3 < 2").select(F.expr("vec_id div 8").alias("path"), (F.col("vec_id") % 8).alias("ic"), F.slice("x", 1, 6).alias("topography"), F.slice("x", 7, 16).alias("x"))
    slots = chain.component_bags(kept, 6).select("path", F.posexplode("x").alias("slot", "x"))
    moment = total(F.transform("x", lambda v, i: v * (i + 1)))
    return slots.select("path", "slot", F.size("x").alias("n_times"), F.round(moment, 6).alias("moment"))


@query("sql_welch", ctes("signals") + ", " + WELCH_SQL + ", " + welch_sql("signals", "w") + " SELECT vec_id, k, k * 2.0::DOUBLE AS f, round(p, 7) AS p FROM w")
def sql_welch(spark, d):
    """Spectra by a table function in SQL, joined laterally to every signal."""
    sql.register(spark)
    return spark.sql("SELECT s.vec_id, w.k, w.f, round(w.p, 7) AS p FROM {rows} s, LATERAL tide_welch(s.x, 64.0D, 32) w", rows=signals(spark, d))


@query("sql_features", ctes("signals") + ", " + competition_sql(bank(), CHANNELS_SQL) + " SELECT vec_id AS window_id, CAST(place AS INTEGER) AS k, round(v, 6) AS v FROM dense")
def sql_features(spark, d):
    """Convolution features by a vectorised function in SQL."""
    sql.register(spark)
    return spark.sql("SELECT window_id, f.k, round(f.v, 6) AS v FROM (SELECT window_id, tide_features(x, 4, 4, 42) AS features FROM {rows}) LATERAL VIEW posexplode(features) f AS k, v", rows=windows(spark, d))


@query("sql_signal_steps", ctes("signals") + " SELECT vec_id, len(x[9:40]) AS n, round(list_sum(x[9:40]), 6) AS total, round(list_sum(list_transform(range(1, 17), lambda i: abs(x[i] - (x[i] + x[i + 16] + x[i + 32] + x[i + 48]) / 4))), 6) AS referenced FROM signals")
def sql_signal_steps(spark, d):
    """Cropping and the average reference as SQL functions."""
    sql.register(spark)
    rows = signals(spark, d).select("vec_id", "x", four_channels().alias("channels"))
    return spark.sql("SELECT vec_id, CAST(size(tide_crop(x, 1D, 5D, 8D)) AS BIGINT) AS n, round(aggregate(tide_crop(x, 1D, 5D, 8D), 0D, (a, v) -> a + v), 6) AS total, round(aggregate(tide_reference(channels)[0], 0D, (a, v) -> a + abs(v)), 6) AS referenced FROM {rows}", rows=rows)


@query("recording_before_after", ctes("signals") + ", " + WELCH_SQL + ", " + REPAIR_SQL + ", " + welch_sql("signals", "a", 2) + ", " + welch_sql("repaired", "b", 2) + " SELECT a.vec_id AS path, 'Cz' AS channel, a.k, a.k * 2.0::DOUBLE AS f, round(10 * log10(a.p + 1e-20::DOUBLE), 4) AS raw, round(10 * log10(b.p + 1e-20::DOUBLE), 4) AS repaired FROM a JOIN b ON a.vec_id = b.vec_id AND a.k = b.k")
def recording_before_after(spark, d):
    """One channel's spectrum before and after artifact subtraction, without the segments that a bad span touches."""
    omit = F.array(F.struct(F.lit(0.80).alias("start"), F.lit(0.85).alias("stop")))
    rows = signals(spark, d).select(F.col("vec_id").alias("path"), F.array(F.lit("EEG CZ-REF")).alias("names"), F.array("x").alias("x"), F.lit(8 / 64).alias("period_s"), omit.alias("omit"))
    found = chain.before_after(rows, chain.Chain(64.0, n_average=5), 32)
    return found.withColumns({c: F.round(c, 4) for c in ("raw", "repaired")})


@query("eeg_channels", ctes("signals") + " SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'F7,T3,Cz' ELSE 'Fp1,F7,T3,Cz' END AS names, round(list_sum(CASE WHEN vec_id % 3 = 0 THEN x[17:32] ELSE x[1:16] END), 6) AS first FROM signals")
def eeg_channels(spark, d):
    """The channels that are EEG by their names; every third recording has a heart lead in the place of one."""
    names = F.array(*[F.lit(n) for n in NAMES])
    own = F.when(F.col("vec_id") % 3 == 0, F.transform(names, lambda n: F.when(n == NAMES[0], "EKG1").otherwise(n))).otherwise(names)
    picked, x = chain.pick_eeg(own, four_channels())
    return signals(spark, d).select("vec_id", F.array_join(picked, ",").alias("names"), F.round(total(F.get(x, F.lit(0))), 6).alias("first"))


@query("electrode_distances", ctes("components") + """, e AS (SELECT unnest(['Fp1', 'Cz', 'O2', 'T3']) AS channel, unnest([-18, 0, 162, -90]) AS a, unnest([90, 0, 90, 90]) AS i), p AS (SELECT channel, sin(radians(a)) * sin(radians(i)) AS px, cos(radians(a)) * sin(radians(i)) AS py, cos(radians(i)) AS pz FROM e),
d AS (SELECT path, ic, channel, round(sqrt(pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2)), 9) AS d FROM components, p)
SELECT path, ic, channel, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY path, ic ORDER BY d, channel) = 1""")
def electrode_distances(spark, d):
    """The nearest of four standard positions to each component's dipole, from the broadcast table of positions."""
    places = chain.electrode_positions(spark).filter(F.col("channel").isin("Fp1", "Cz", "O2", "T3")).select("channel", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    rows = components(spark, d).join(F.broadcast(places)).withColumn("distance", F.round(F.sqrt(sum((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "xyz")), 9))
    nearest = rows.groupBy("path", "ic").agg(F.min(F.struct("distance", "channel")).alias("n"))
    return nearest.select("path", "ic", "n.channel", F.round("n.distance", 6).alias("distance"))


@query("matched_channels", ctes("components") + """, names AS (SELECT ['Fp1', 'EEG F7-REF', 't3', 'C-z', 'O2', 'Pz', 'F8', 'A1'] AS n), have AS (SELECT DISTINCT path, n[1 + (ic + CAST(path AS INTEGER)) % 8] AS c FROM components, names WHERE ic < 6),
w AS (SELECT path, unnest(['Fp1', 'F7', 'T3', 'Cz']) AS want FROM (SELECT DISTINCT path FROM have)), m AS (SELECT w.path, w.want, (SELECT min(c) FROM have h WHERE h.path = w.path AND regexp_replace(lower(regexp_replace(regexp_replace(h.c, '(?i)-(REF|LE)$', ''), '(?i)^EEG ', '')), '[^a-z0-9]', '', 'g') = lower(w.want)) AS mine FROM w)
SELECT path, bool_and(mine IS NOT NULL) AS complete, CASE WHEN bool_and(mine IS NOT NULL) THEN count(*) FILTER (mine <> want) ELSE 0 END AS n_renames FROM m GROUP BY path""")
def matched_channels(spark, d):
    """How the channels of each recording serve a decomposition of four channels, by exact or by plain names."""
    names = F.array(*[F.lit(n) for n in ("Fp1", "EEG F7-REF", "t3", "C-z", "O2", "Pz", "F8", "A1")])
    have = components(spark, d).filter("ic < 6").select("path", F.get(names, ((F.col("ic") + F.col("path").cast("int")) % 8).cast("int")).alias("channel"))
    wanted = have.select("path").distinct().select("path", F.explode(F.array(*[F.lit(n) for n in ("Fp1", "F7", "T3", "Cz")])).alias("channel"))
    return chain.match_channels(have, wanted).select("path", "complete", F.size("renames").cast("long").alias("n_renames"))


@query("class_labels", "SELECT event_type AS y, row_number() OVER (ORDER BY event_type) - 1 AS place FROM (SELECT DISTINCT event_type FROM events)")
def class_labels(spark, d):
    """The labels of a table in order, with their places."""
    return features.class_labels(table(spark, d, "events").select(F.col("event_type").alias("y"))).withColumn("place", F.col("place").cast("long"))
