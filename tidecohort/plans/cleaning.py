"""Queries over the signal chain, bad channels and segments, spectra before and after repair, and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecohort.functions import scalars
from tidecohort.operators import chain, detection, features, signal, spectral
from tidecohort.plans.analytics import SUBJECT_SQL
from tidecohort.plans.cohorts import REGION_SQL
from tidecohort.plans.register import query
from tidecohort.plans.signals import WELCH_SQL, four_channels, welch_sql
from tidecohort.sources.builder import SIDECAR
from tidecohort.sources.corpus import comb_fundamentals
from tidecohort.sources.fixtures import components, ctes, psd, signals

FS, TILE, PEAK = 16.0, 4, 0.5
NAMES = ("EEG FP1-REF", "F7", "EEG T3-LE", "Cz")
PAIRS = (("Fp1", "F7"), ("F7", "T3"), ("T3", "Cz"))
total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)


def channels(spark, d):
    """(path, ch, x) of the four channels of every signal."""
    return signals(spark, d).select(F.col("vec_id").alias("path"), F.posexplode(four_channels()).alias("ch", "x"))


def flags(spark, d):
    return detection.channel_flags(channels(spark, d), most_z=3.0)


CHANNEL_SQL = "ch AS (SELECT vec_id AS path, CAST(c AS INTEGER) AS ch, CAST(i AS INTEGER) AS i, x[1 + 16 * c + i] AS v FROM signals, unnest(range(4)) AS a(c), unnest(range(16)) AS b(i))"
FLAG_SQL = CHANNEL_SQL + """,
amp AS (SELECT path, ch, CAST(0.7413 AS DOUBLE) * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS amplitude FROM ch GROUP BY path, ch),
mid AS (SELECT path, quantile_cont(amplitude, 0.5) AS m, CAST(0.7413 AS DOUBLE) * (quantile_cont(amplitude, 0.75) - quantile_cont(amplitude, 0.25)) AS s FROM amp GROUP BY path),
flags AS (SELECT path, ch, amplitude, CASE WHEN s > 0 THEN (amplitude - m) / s ELSE 0 END AS z FROM amp JOIN mid USING (path)),
judged AS (SELECT *, amplitude < CAST(1e-9 AS DOUBLE) OR abs(z) > 3 AS bad FROM flags)"""


@query("channel_flags", ctes("signals") + ", " + FLAG_SQL + " SELECT path, ch, round(amplitude, 6) AS amplitude, round(z, 4) AS z, bad FROM judged")
def channel_flags(spark, d):
    return flags(spark, d).select("path", "ch", F.round("amplitude", 6).alias("amplitude"), F.round("z", 4).alias("z"), "bad")


@query("recordings_beyond_repair", ctes("signals") + ", " + FLAG_SQL + " SELECT path, count(*) AS n_channels, CAST(count(*) FILTER (bad) AS INTEGER) AS n_bad, count(*) < 4 OR count(*) FILTER (bad) > CAST(0.3 AS DOUBLE) * count(*) AS too_many FROM judged GROUP BY path")
def beyond_repair(spark, d):
    return detection.too_many(flags(spark, d)).select("path", "n_channels", F.size("bads").alias("n_bad"), "too_many")


SEGMENT_SQL = f"""peaks AS (SELECT path, ch, i // {TILE} AS tile, max(v) - min(v) AS peak FROM ch JOIN (SELECT path, ch FROM judged WHERE NOT bad) USING (path, ch) GROUP BY ALL),
bad AS (SELECT DISTINCT path, tile FROM peaks WHERE peak > {PEAK} OR peak <= 0), isl AS (SELECT path, tile, tile - row_number() OVER (PARTITION BY path ORDER BY tile) AS island FROM bad),
segments AS (SELECT path, min(tile) * {TILE / FS}::DOUBLE AS start, (max(tile) + 1) * {TILE / FS}::DOUBLE AS stop FROM isl GROUP BY path, island)"""


@query("bad_segments", ctes("signals") + ", " + FLAG_SQL + ",\n" + SEGMENT_SQL + " SELECT path, start, stop FROM segments")
def bad_segments(spark, d):
    return detection.bad_segments(channels(spark, d), flags(spark, d), FS, TILE, PEAK)


@query("sidecar_json", ctes("signals") + ", " + FLAG_SQL + ",\n" + SEGMENT_SQL + """, n AS (SELECT path, count(*) AS n, round(sum(stop - start), 6) AS bad_s FROM segments GROUP BY path),
r AS (SELECT path, CAST(count(*) FILTER (bad) AS INTEGER) AS n_bads, count(*) < 4 OR count(*) FILTER (bad) > CAST(0.3 AS DOUBLE) * count(*) AS too_many FROM judged GROUP BY path)
SELECT path, n_bads, too_many, CAST(coalesce(n, 0) AS INTEGER) AS n_segments, coalesce(bad_s, 0) AS bad_s FROM r LEFT JOIN n USING (path)""")
def sidecar_json(spark, d):
    """Sidecars with their segments written as JSON and read again by their schema; what is missing is empty."""
    segments = detection.bad_segments(channels(spark, d), flags(spark, d), FS, TILE, PEAK)
    written = detection.sidecars(flags(spark, d), segments).select("path", F.to_json(F.struct("bads", "too_many", "segments")).alias("value"))
    read = written.select("path", F.from_json("value", SIDECAR).alias("s"))
    length = F.aggregate("s.segments", F.lit(0.0), lambda a, x: a + x["stop"] - x["start"])
    return read.select("path", F.size("s.bads").alias("n_bads"), "s.too_many", F.size("s.segments").alias("n_segments"), F.round(length, 6).alias("bad_s"))


#: The common period of a signal of 64 samples at 64 Hz: its autocorrelation's peak between 0.5 and 6 Hz, or a whole fraction of it.
PERIOD_SQL = """c0 AS (SELECT vec_id, list_transform(x, lambda v: v - list_avg(x)) AS x FROM signals), acf AS (SELECT vec_id, list_transform(range(64), lambda l: list_sum(list_transform(range(1, 65 - l), lambda t: x[t] * x[t + l]))) AS a FROM c0),
m AS (SELECT vec_id, list_transform(a, lambda v: v / a[1]) AS m FROM acf), t AS (SELECT vec_id, m, 9 + list_position(m[11:64], list_max(m[11:64])) AS lag FROM m),
tries AS (SELECT vec_id, m, lag, p, q, CASE WHEN p = 1 THEN lag ELSE CAST(round_even(lag / p, 0) AS BIGINT) + q END AS place FROM t, unnest([5, 4, 3, 2, 1]) AS u(p), unnest([-1, 0, 1]) AS w(q)),
best AS (SELECT vec_id, p, any_value(lag) AS lag, any_value(m[lag + 1]) AS top, max(CASE WHEN place BETWEEN 1 AND 63 THEN m[place + 1] END) AS held, max_by(place, (CASE WHEN place BETWEEN 1 AND 63 THEN m[place + 1] END, -q)) AS place FROM tries GROUP BY vec_id, p),
fits AS (SELECT vec_id, any_value(top) AS strength, coalesce(max(p) FILTER ((CASE WHEN p = 1 THEN lag ELSE round_even(lag / p, 0) END) >= 10 AND held >= 0.6::DOUBLE * top), 1) AS p FROM best GROUP BY vec_id),
periods AS (SELECT vec_id, 64.0::DOUBLE / place AS f0, strength, 64.0::DOUBLE / place BETWEEN 0.7::DOUBLE AND 2.0::DOUBLE AS cardiac_like, strength >= 0.5::DOUBLE AND 64.0::DOUBLE / place < 0.92::DOUBLE * 6 AS flagged FROM fits JOIN best USING (vec_id, p))"""


@query("periodicity", ctes("signals") + ", " + PERIOD_SQL + " SELECT vec_id, round(f0, 6) AS f0, round(strength, 6) AS strength, cardiac_like, flagged FROM periods")
def periodicity(spark, d):
    """The common period of every signal, by autocorrelation."""
    return signal.periods(signals(spark, d), 64.0).withColumns({c: F.round(c, 6) for c in ("f0", "strength")})


@query("comb_histogram", ctes("signals") + ", " + PERIOD_SQL + ", f AS (SELECT f0 FROM periods WHERE strength >= 0.2::DOUBLE), e AS (SELECT unnest([0, 0.5, 0.7, 1, 1.25, 1.5, 2, 2.5, 3, 4]::DOUBLE[]) AS e) SELECT low, count(*) AS n FROM (SELECT (SELECT max(e) FROM e WHERE e <= f0) AS low FROM f) GROUP BY low UNION ALL SELECT NULL, count(*) FROM f")
def comb_histogram(spark, d):
    """Fundamentals of strong periodic artifacts, as sidecars keep them, by range."""
    found = signal.periods(signals(spark, d), 64.0)
    kept = found.select(F.struct("f0", "strength", (F.col("strength") >= 0.2).alias("flagged")).alias("periodic"))
    written = kept.select(F.from_json(F.to_json(F.struct("periodic")), SIDECAR).alias("s")).select("s.*")
    return comb_fundamentals(written)


@query("affected_recordings", ctes("signals") + ", " + FLAG_SQL + ", " + PERIOD_SQL + ", r AS (SELECT path, count(*) FILTER (bad) AS n_bads, count(*) < 4 OR count(*) FILTER (bad) > CAST(0.3 AS DOUBLE) * count(*) AS too_many FROM judged GROUP BY path) SELECT path, (n_bads > 0 AND NOT too_many) OR (flagged AND f0 > 0 AND f0 <= 6) AS affected FROM r JOIN periods ON vec_id = path")
def affected_recordings(spark, d):
    """Recordings that repair changes, by their flags and their periodic artifact."""
    found = signal.periods(signals(spark, d), 64.0).withColumnRenamed("vec_id", "path")
    rows = detection.too_many(flags(spark, d)).join(found, "path")
    return rows.select("path", detection.affected(F.col("bads"), F.col("too_many"), F.col("flagged"), F.col("f0"), 6.0).alias("affected"))


@query("autocorrelation", ctes("signals") + ", c AS (SELECT vec_id, list_transform(x, lambda v: v - list_avg(x)) AS x FROM signals) SELECT vec_id, CAST(lag AS INTEGER) AS lag, round(list_sum(list_transform(range(1, 65 - lag), lambda t: x[t] * x[t + lag])) / list_sum(list_transform(x, lambda v: v * v)), 6) AS r FROM c, unnest(range(17)) AS u(lag)")
def autocorrelation(spark, d):
    """Normalised autocorrelation at the first lags."""
    mean = total(F.col("x")) / F.size("x")
    centred = signals(spark, d).select("vec_id", F.transform("x", lambda v: v - mean).alias("x"))
    rows = centred.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(16))))
    ahead = F.slice("x", F.col("lag") + 1, F.size("x") - F.col("lag"))
    products = F.zip_with(F.slice("x", F.lit(1), F.size("x") - F.col("lag")), ahead, lambda a, b: a * b)
    return rows.select("vec_id", "lag", F.round(total(products) / total(F.transform("x", lambda v: v * v)), 6).alias("r"))


@query("decibel_spectra", ctes("signals") + ", " + WELCH_SQL + ", " + welch_sql("signals", "w") + " SELECT vec_id, k, round(10 * log10(p + 1e-20::DOUBLE), 4) AS db FROM w")
def decibel_spectra(spark, d):
    rows = signal.spectra(signals(spark, d), 64.0, 32)
    return rows.select("vec_id", F.posexplode(chain.decibels(F.col("p"))).alias("k", "db")).withColumn("db", F.round("db", 4))


REPAIR_SQL = """tiles AS (SELECT vec_id, CAST((i - 1) // 8 AS INTEGER) AS tile, CAST((i - 1) % 8 AS INTEGER) AS phase, x[i] AS v FROM signals, unnest(range(1, 65)) AS u(i)),
cleaned AS (SELECT a.vec_id, a.tile * 8 + a.phase AS i, a.v - avg(b.v) AS v FROM tiles a JOIN tiles b ON a.vec_id = b.vec_id AND a.phase = b.phase AND b.tile >= greatest(a.tile - 2, 0) AND b.tile < greatest(a.tile - 2, 0) + 5 GROUP BY a.vec_id, a.tile, a.phase, a.v),
repaired AS (SELECT vec_id, list(v ORDER BY i) AS x FROM cleaned GROUP BY vec_id),
moved AS (SELECT s.vec_id, s.y, list_sum(list_transform(range(1, 65), lambda i: pow(s.x[i] - r.x[i], 2))) > CAST(0.15 AS DOUBLE) * list_sum(list_transform(s.x, lambda v: v * v)) AS affected FROM signals s JOIN repaired r USING (vec_id))"""


@query("corpus_before_after", ctes("signals") + ", " + WELCH_SQL + ", " + REPAIR_SQL + ", " + welch_sql("signals", "a") + ", " + welch_sql("repaired", "b") + """,
g AS (SELECT vec_id, y, unnest(CASE WHEN affected THEN ['all', 'affected'] ELSE ['all'] END) AS grp FROM moved)
SELECT grp, y AS cls, a.k, count(*) AS n, round(avg(a.p), 7) AS raw, round(avg(b.p), 7) AS repaired FROM g JOIN a USING (vec_id) JOIN b ON b.vec_id = a.vec_id AND b.k = a.k GROUP BY grp, y, a.k""")
def before_after(spark, d):
    """Mean spectra over recordings before and after artifact subtraction, for all and for those that it changed much."""
    both = signals(spark, d).withColumn("clean", signal.without_artifact(F.col("x"), 64.0, 8 / 64, 5))
    removed = total(F.zip_with("x", "clean", lambda a, b: (a - b) * (a - b)))
    grp = F.when(removed > F.lit(0.15) * total(F.transform("x", lambda v: v * v)), F.array(F.lit("all"), F.lit("affected"))).otherwise(F.array(F.lit("all")))
    spectra = both.withColumns({"p": signal.spectrum(F.col("x"), 64.0, 32), "q": signal.spectrum(F.col("clean"), 64.0, 32)})
    joined = spectra.select("y", F.explode(grp).alias("grp"), "p", "q")
    bins = joined.select("grp", F.col("y").alias("cls"), F.posexplode(F.arrays_zip("p", "q")).alias("k", "z"))
    return bins.groupBy("grp", "cls", "k").agg(F.count("*").alias("n"), F.round(F.avg("z.p"), 7).alias("raw"), F.round(F.avg("z.q"), 7).alias("repaired"))


KERNEL = (0.5, -0.25, 0.125, 0.75, -1.0, 0.25, -0.5, 0.0, 0.125)


@query("filtered_psd", ctes("psd") + ",\n" + SUBJECT_SQL + f""", c AS (SELECT cls, k, avg(p) AS m FROM sp GROUP BY cls, k), r AS (SELECT cls, k, m / sum(m) OVER (PARTITION BY cls) AS share FROM c),
h AS (SELECT *, pow(list_sum(list_transform(range(9), lambda j: list_extract({list(KERNEL)}, j + 1) * cos(2 * pi() / 250 * (k * 0.5) * 2 * j))), 2) + pow(list_sum(list_transform(range(9), lambda j: list_extract({list(KERNEL)}, j + 1) * sin(2 * pi() / 250 * (k * 0.5) * 2 * j))), 2) AS h2 FROM r)
SELECT cls, k, round(share * h2 / sum(share * h2) OVER (PARTITION BY cls), 9) AS share FROM h""")
def filtered_psd(spark, d):
    """Relative class spectra as a kernel hears them: times its squared response, again of sum 1."""
    rows = spectral.relative(spectral.class_psd(psd(spark, d)), ["cls"], "mean")
    weights = F.array(*[F.lit(w) for w in KERNEL])
    h = features.response(weights, F.col("k") * F.lit(spectral.BIN_HZ), 250.0, F.lit(2), F.lit(0))
    heard = rows.select("cls", "k", (F.col("share") * h * h).alias("v"))
    return spectral.relative(heard, ["cls"], "v").select("cls", "k", F.round("share", 9).alias("share"))


@query("component_removed", ctes("signals") + """, u AS (SELECT vec_id, x, [[0.5, 0.5, 0.5, 0.5], [0.5, -0.5, 0.5, -0.5], [0.5, 0.5, -0.5, -0.5], [0.5, -0.5, -0.5, 0.5]]::DOUBLE[][] AS m, 1 + CAST(vec_id % 4 AS INTEGER) AS k FROM signals)
SELECT vec_id, round(list_sum(list_transform(range(16), lambda t: abs(x[1 + t] - m[1][k] * (m[k][1] * x[1 + t] + m[k][2] * x[17 + t] + m[k][3] * x[33 + t] + m[k][4] * x[49 + t])))), 6) AS first FROM u""")
def component_removed(spark, d):
    """Channels without one component of an orthogonal decomposition."""
    rows = [[0.5, 0.5, 0.5, 0.5], [0.5, -0.5, 0.5, -0.5], [0.5, 0.5, -0.5, -0.5], [0.5, -0.5, -0.5, 0.5]]
    matrix = F.array(*[F.array(*[F.lit(v) for v in r]) for r in rows])
    cleaned = chain.without_components(four_channels(), matrix, matrix, F.array((F.col("vec_id") % 4).cast("int")))
    return signals(spark, d).select("vec_id", F.round(total(F.transform(F.get(cleaned, F.lit(0)), lambda v: F.abs(v))), 6).alias("first"))


SERIES_SQL = f"""parts AS (SELECT vec_id // 8 AS path, {REGION_SQL.replace('x <', 'x0 <').replace('abs(x)', 'abs(x0)')} AS region, CASE WHEN list_max(t) >= -list_min(t) THEN 1 ELSE -1 END AS sign, s
FROM (SELECT vec_id, x[1] * 0.35::DOUBLE AS x0, x[2] * 0.35::DOUBLE AS y, x[3] * 0.35::DOUBLE AS z, x[6:10] AS t, x[11:18] AS s FROM signals))"""


@query("regional_series", ctes("signals") + ", " + SERIES_SQL + """, sums AS (SELECT path, region, i, sum(sign * s[i]) AS v, count(*) AS n FROM parts, unnest(range(1, 9)) AS u(i) GROUP BY ALL), r AS (SELECT path, region, max(n) AS n, round(sum(abs(v)), 6) AS size FROM sums GROUP BY ALL)
SELECT p.path, g.region, coalesce(n, 0) AS n, coalesce(size, 0) AS size, 8 AS length FROM (SELECT DISTINCT path FROM parts) p CROSS JOIN (SELECT unnest(['frontal_left', 'frontal_right', 'temporal_left', 'temporal_right', 'central_midline', 'posterior_left', 'posterior_right']) AS region) g LEFT JOIN r ON r.path = p.path AND r.region = g.region""")
def regional_series(spark, d):
    """Signed sums of component sources per region, seven rows for each recording."""
    at = lambda i: F.get("x", F.lit(i)) * F.lit(0.35)
    parts = signals(spark, d).select(F.expr("vec_id div 8").alias("path"), (F.col("vec_id") % 8).alias("ic"), scalars.dipole_region(at(0), at(1), at(2)).alias("region"), F.slice("x", 6, 5).alias("topography"), F.slice("x", 11, 8).alias("x"))
    return chain.regional_series(parts).select("path", "region", "n", F.round(total(F.transform("x", lambda v: F.abs(v))), 6).alias("size"), F.size("x").alias("length"))


@query("dipole_labels", ctes("components") + ", l AS (SELECT path, ic, lower(trim(label)) AS label FROM components WHERE prob >= 0.2) SELECT c.path, c.ic, coalesce(l.label, 'unknown') AS label FROM components c LEFT JOIN l ON c.path = l.path AND c.ic = l.ic WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND gof IS NOT NULL")
def dipole_labels(spark, d):
    """Dipoles with the label of their component, ``unknown`` where there is none."""
    rows = components(spark, d)
    labels = rows.filter("prob >= 0.2").select("path", "ic", F.lower(F.trim("label")).alias("label"))
    return rows.na.drop(subset=["x", "y", "z", "gof"]).drop("label").join(labels, ["path", "ic"], "left").select("path", "ic", F.coalesce("label", F.lit("unknown")).alias("label"))


NAME_SQL = "['Fp1', 'F8', 'EEG T3-REF', 'C4', 'Pz', 'EEG O2-LE', 'FC5', 'PO4'][1 + ic]"
LOBE_SQL = "CASE WHEN starts_with(n, 'FP') OR starts_with(n, 'AF') THEN 'frontal' WHEN starts_with(n, 'FC') THEN 'central' WHEN starts_with(n, 'FT') OR starts_with(n, 'TP') THEN 'temporal' WHEN starts_with(n, 'CP') THEN 'central' WHEN starts_with(n, 'PO') THEN 'posterior' WHEN starts_with(n, 'F') THEN 'frontal' WHEN starts_with(n, 'T') THEN 'temporal' WHEN starts_with(n, 'P') OR starts_with(n, 'O') THEN 'posterior' ELSE 'central' END"


@query("component_regions", ctes("components") + f""", e AS (SELECT path, ic, upper(regexp_replace(regexp_replace({NAME_SQL}, '-(REF|LE)$', ''), '^EEG ', '')) AS n FROM components), p AS (SELECT *, {LOBE_SQL} AS lobe, regexp_extract(n, '(\\d+)$', 1) AS k FROM e),
d AS (SELECT path, ic, {REGION_SQL} AS region FROM components WHERE gof >= 50)
SELECT p.path, p.ic, coalesce(d.region, CASE WHEN k = '' OR lobe = 'central' THEN 'central_midline' ELSE lobe || '_' || CASE WHEN CAST(k AS INTEGER) % 2 = 1 THEN 'left' ELSE 'right' END END) AS region FROM p LEFT JOIN d USING (path, ic)""")
def component_regions(spark, d):
    """Region of a component: of its dipole where the fit is good, else of the electrode it is strongest at."""
    rows = components(spark, d)
    names = F.array(*[F.lit(n) for n in ("Fp1", "F8", "EEG T3-REF", "C4", "Pz", "EEG O2-LE", "FC5", "PO4")])
    dipoles = rows.filter("gof >= 50").select("path", "ic", scalars.dipole_region(F.col("x"), F.col("y"), F.col("z")).alias("found"))
    joined = rows.select("path", "ic", F.get(names, F.col("ic")).alias("name")).join(dipoles, ["path", "ic"], "left")
    return joined.select("path", "ic", F.coalesce("found", scalars.electrode_region(F.col("name"))).alias("region"))


def named_windows(spark, d):
    """Windows of four named channels; every fifth lacks one."""
    names = F.array(*[F.lit(n) for n in NAMES])
    short = lambda c: F.when(F.col("vec_id") % 5 == 0, F.slice(c, 1, 2)).otherwise(c)
    return signals(spark, d).select("vec_id", short(names).alias("names"), short(four_channels()).alias("x"))


@query("window_dataset", ctes("signals") + " SELECT vec_id, 3 AS n_channels, 20 AS n, vec_id % 5 <> 0 AS ok, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE round(list_sum(list_transform(range(1, 17), lambda i: abs(x[i] - x[i + 16]))), 6) END AS first FROM signals")
def window_dataset(spark, d):
    """Processed windows; a failed one is zeros, so that the plan keeps its length."""
    rows = chain.process(named_windows(spark, d), chain.Chain(FS, pairs=PAIRS, least_pairs=3, n_samples=20), ["vec_id"])
    first = total(F.transform(F.get("x", F.lit(0)), lambda v: F.abs(v)))
    return rows.select("vec_id", F.size("x").alias("n_channels"), F.size(F.get("x", F.lit(0))).alias("n"), "ok", F.round(first, 6).alias("first"))


@query("processed_windows")
def processed_windows(spark, d):
    """The whole chain: band-pass, notch, resampling, interpolation of the bad channel, bipolar pairs, margin and length."""
    rows = named_windows(spark, d).withColumn("bad", F.array(F.lit("F7")))
    steps = chain.Chain(FS, band=(1.0, 6.0), notch=(5.0,), target_fs=32.0, interpolate=True, artifact_period_s=0.25, pairs=PAIRS, least_pairs=3, margin_s=0.125, n_samples=24, zeros=False)
    return chain.process(rows, steps, ["vec_id"]).withColumn("x", F.transform("x", lambda c: F.transform(c, lambda v: F.round(v, 6))))
