"""Queries over recordings, windows, splits and pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecohort.functions import scalars
from tidecohort.operators import cohort
from tidecohort.plans.register import query
from tidecohort.sources.fixtures import SQL, components, ctes, recordings, spans, table

LENGTH, STRIDE, CAP = 120.0, 60.0, 20
RATIOS = {"train": 0.6, "val": 0.2, "test": 0.2}

WINDOWS_SQL = """counted AS (SELECT *, CAST(greatest(0, floor((duration - 120) / 60) + 1) AS BIGINT) AS n FROM rec),
listed AS (SELECT * EXCLUDE (n, i), CAST(i AS BIGINT) AS idx, CAST(i AS DOUBLE) * 60 AS start, CAST(i AS DOUBLE) * 60 + 120 AS "end" FROM counted, unnest(range(n)) AS t(i) WHERE n > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY md5('42|' || path || '|' || idx), path, idx) - 1 AS position FROM listed)"""
SPLITS_SQL = """labelled AS (SELECT subject, bool_or(epilepsy) AS epilepsy FROM rec GROUP BY subject),
ranked AS (SELECT subject, row_number() OVER (PARTITION BY epilepsy ORDER BY md5('42|' || subject), subject) AS r, count(*) OVER (PARTITION BY epilepsy) AS n FROM labelled),
splits AS (SELECT subject, CASE WHEN r <= floor(0.6 * n) THEN 'train' WHEN r <= floor(0.6 * n) + floor(0.2 * n) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


def subjects(rec: DataFrame) -> DataFrame:
    return rec.groupBy("subject").agg(F.bool_or("epilepsy").alias("epilepsy"))


def plan(spark: SparkSession, d: str, cap: int | None = CAP) -> DataFrame:
    rec = recordings(spark, d)
    return cohort.windows(rec, LENGTH, STRIDE, cap).join(cohort.splits(subjects(rec), RATIOS), "subject")


@query("window_plan_budget", ctes("rec") + ",\n" + WINDOWS_SQL + ",\n" + SPLITS_SQL + """
SELECT split, count(DISTINCT subject) AS subjects, count(*) AS available, count(*) FILTER (position < 20) AS kept, count(DISTINCT CASE WHEN epilepsy THEN subject END) AS positive
FROM placed JOIN splits USING (subject) GROUP BY split""")
def window_plan_budget(spark, d):
    kept = F.count_if(F.col("position") < CAP)
    return plan(spark, d, None).groupBy("split").agg(F.countDistinct("subject").alias("subjects"), F.count("*").alias("available"), kept.alias("kept"), F.countDistinct(F.when(F.col("epilepsy"), F.col("subject"))).alias("positive"))


@query("recordings", ctes("rec") + " SELECT * FROM rec")
def all_recordings(spark, d):
    return recordings(spark, d)


@query("seizure_free", ctes("rec") + " SELECT subject, path, duration FROM rec WHERE n_seizure = 0")
def seizure_free(spark, d):
    return cohort.seizure_free(recordings(spark, d)).select("subject", "path", "duration")


@query("subject_filter", ctes("rec") + " SELECT subject, path FROM rec WHERE subject IN ('1', '7', '13', '22')")
def subject_filter(spark, d):
    return recordings(spark, d).filter(F.col("subject").isin("1", "7", "13", "22")).select("subject", "path")


EXCLUDED_SQL = "excluded AS (SELECT '/corpus//' || o_custkey || '/./s001/' || o_orderkey || '.edf' AS value FROM orders WHERE o_orderkey % 11 = 0)"


@query("exclusion_anti_join", ctes("rec") + ", " + EXCLUDED_SQL + " SELECT path, epilepsy FROM rec WHERE path NOT IN (SELECT replace(replace(value, '/./', '/'), '//', '/') FROM excluded)")
def exclusion(spark, d):
    orders = table(spark, d, "orders").filter("o_orderkey % 11 = 0")
    listed = orders.select(F.concat(F.lit("/corpus//"), F.col("o_custkey").cast("string"), F.lit("/./s001/"), F.col("o_orderkey").cast("string"), F.lit(".edf")).alias("value"))
    return cohort.without_excluded(recordings(spark, d), listed).select("path", "epilepsy")


@query("require_label_semi_join", ctes("components") + " SELECT DISTINCT path FROM components c WHERE EXISTS (SELECT 1 FROM components k WHERE k.path = c.path AND lower(trim(k.label)) = 'other')")
def require_label(spark, d):
    parts = components(spark, d)
    return cohort.with_label(parts.select("path").distinct(), parts, ["other"])


@query("rate_filter", ctes("rec") + " SELECT path, sfreq, duration FROM rec WHERE abs(sfreq - 256.0) <= 1e-8 + 1e-5 * 256.0 AND duration >= 600")
def rate_filter(spark, d):
    return recordings(spark, d).filter(cohort.near(F.col("sfreq"), 256.0) & (F.col("duration") >= 600)).select("path", "sfreq", "duration")


@query("label_encoding", ctes("rec") + " SELECT path, CASE gender WHEN 'M' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS gender_code, CASE WHEN epilepsy THEN 1 ELSE 0 END AS epilepsy_code FROM rec")
def label_encoding(spark, d):
    return cohort.encode_labels(recordings(spark, d)).select("path", "gender_code", "epilepsy_code")


@query("window_counts", ctes("rec") + " SELECT subject, CAST(sum(greatest(0, floor((duration - 120) / 60) + 1)) AS BIGINT) AS n_windows FROM rec GROUP BY subject HAVING sum(greatest(0, floor((duration - 120) / 60) + 1)) > 0")
def window_counts(spark, d):
    return cohort.subject_counts(recordings(spark, d), LENGTH, STRIDE)


@query("window_counts_samples", ctes("rec") + " SELECT subject, CAST(sum(greatest(0, floor((duration - 120) * sfreq / 15000) + 1)) AS BIGINT) AS n_windows FROM rec GROUP BY subject")
def window_counts_samples(spark, d):
    n = cohort.window_count_samples(F.col("duration"), F.col("sfreq"), LENGTH, 15000)
    return recordings(spark, d).groupBy("subject").agg(F.sum(n).alias("n_windows"))


@query("window_budget_report", ctes("rec") + """, c AS (SELECT subject, CAST(sum(greatest(0, floor((duration - 120) / 60) + 1)) AS BIGINT) AS n FROM rec GROUP BY subject HAVING sum(greatest(0, floor((duration - 120) / 60) + 1)) > 0)
SELECT CAST(sum(least(n, 20)) AS BIGINT) AS kept, CAST(sum(n) AS BIGINT) AS total, round(100.0::DOUBLE * sum(least(n, 20)) / sum(n), 6) AS pct, min(n) AS least, median(n) AS middle, max(n) AS most FROM c""")
def window_budget(spark, d):
    c = cohort.subject_counts(recordings(spark, d), LENGTH, STRIDE)
    kept, total = F.sum(F.least("n_windows", F.lit(CAP))), F.sum("n_windows")
    return c.agg(kept.alias("kept"), total.alias("total"), F.round(F.lit(100.0).cast("double") * kept / total, 6).alias("pct"), F.min("n_windows").alias("least"), F.median("n_windows").alias("middle"), F.max("n_windows").alias("most"))


@query("smallest_subjects", ctes("rec") + """, c AS (SELECT subject, CAST(sum(greatest(0, floor((duration - 120) / 60) + 1)) AS BIGINT) AS n_windows FROM rec GROUP BY subject),
least AS (SELECT * FROM c WHERE n_windows > 0 ORDER BY n_windows, subject LIMIT 10) SELECT path, subject FROM rec WHERE subject IN (SELECT subject FROM least)""")
def smallest_subjects(spark, d):
    rec = recordings(spark, d)
    least = cohort.subject_counts(rec, LENGTH, STRIDE).orderBy("n_windows", "subject").limit(10)
    return rec.join(least, "subject", "left_semi").select("path", "subject")


@query("window_list", ctes("rec") + ",\n" + WINDOWS_SQL + ' SELECT subject, path, idx, start, "end", position FROM placed WHERE position < 20')
def window_list(spark, d):
    return cohort.windows(recordings(spark, d), LENGTH, STRIDE, CAP).select("subject", "path", "idx", "start", "end", "position")


@query("window_list_balanced", ctes("rec") + ",\n" + WINDOWS_SQL + " SELECT subject, path, idx, position FROM placed WHERE position < (SELECT min(k) FROM (SELECT count(*) AS k FROM placed GROUP BY subject))")
def window_list_balanced(spark, d):
    return cohort.windows(recordings(spark, d), LENGTH, STRIDE, None, balance=True).select("subject", "path", "idx", "position")


@query("subject_splits", ctes("rec") + ",\n" + SPLITS_SQL + " SELECT subject, split FROM splits")
def subject_splits(spark, d):
    return cohort.splits(subjects(recordings(spark, d)), RATIOS)


@query("window_drop_bad_spans", ctes("rec", "spans") + ",\n" + WINDOWS_SQL + ' SELECT subject, path, idx FROM placed w WHERE position < 20 AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.path = w.path AND s.start < w."end" AND s.stop > w.start)')
def window_drop(spark, d):
    return cohort.overlapping(cohort.windows(recordings(spark, d), LENGTH, STRIDE, CAP), spans(spark, d)).select("subject", "path", "idx")


@query("windows_with_seizure", ctes("rec", "spans") + ",\n" + WINDOWS_SQL + " SELECT subject, path, idx FROM placed w WHERE EXISTS (SELECT 1 FROM spans s WHERE s.kind = 'seiz' AND s.path = w.path AND s.start < w.\"end\" AND s.stop > w.start)")
def windows_with_seizure(spark, d):
    seizures = spans(spark, d).filter("kind = 'seiz'")
    return cohort.overlapping(cohort.windows(cohort.with_spans(recordings(spark, d), seizures), LENGTH, STRIDE), seizures, "left_semi").select("subject", "path", "idx")


@query("manifest_replay", ctes("rec") + ",\n" + WINDOWS_SQL + """, m AS (SELECT idx, CASE WHEN idx % 2 = 0 THEN path ELSE replace(path, '/corpus/', '/elsewhere/corpus/') END AS path, position FROM placed WHERE position < 5)
SELECT coalesce(a.path, b.path) AS path, m.idx, coalesce(a.duration, b.duration) AS duration FROM m LEFT JOIN rec a ON a.path = m.path
LEFT JOIN rec b ON regexp_extract(b.path, '([^/]+/){3}[^/]+$', 0) = regexp_extract(m.path, '([^/]+/){3}[^/]+$', 0) WHERE coalesce(a.path, b.path) IS NOT NULL""")
def manifest_replay(spark, d):
    rec = recordings(spark, d).select("path", "duration")
    moved = F.when(F.col("idx") % 2 == 0, F.col("path")).otherwise(F.replace("path", F.lit("/corpus/"), F.lit("/elsewhere/corpus/")))
    manifest = cohort.windows(recordings(spark, d), LENGTH, STRIDE, 5).select("idx", moved.alias("listed"))
    return cohort.matched(manifest, rec, "listed", "path", r"(([^/]+/){3}[^/]+)$").select("path", "idx", "duration")


@query("pool_counts", ctes("rec") + " SELECT which, count(DISTINCT subject) AS subjects, count(DISTINCT (subject, year)) AS sessions, count(*) AS recordings FROM (SELECT *, unnest([CAST(epilepsy AS VARCHAR), 'all']) AS which FROM rec) GROUP BY which")
def pool_counts(spark, d):
    return cohort.pool_counts(recordings(spark, d))


@query("pool_funnel", ctes("rec") + """ SELECT 'all' AS step, count(*) AS n FROM rec UNION ALL SELECT 'seizure_free', count(*) FROM rec WHERE n_seizure = 0
UNION ALL SELECT 'long', count(*) FROM rec WHERE n_seizure = 0 AND duration >= 300 UNION ALL SELECT 'rate', count(*) FROM rec WHERE n_seizure = 0 AND duration >= 300 AND sfreq = 256""")
def pool_funnel(spark, d):
    steps = [("all", F.lit(True)), ("seizure_free", F.col("n_seizure") == 0), ("long", F.col("duration") >= 300), ("rate", cohort.near(F.col("sfreq"), 256.0))]
    passed, counts = F.lit(True), []
    for name, condition in steps:
        passed = passed & condition
        counts.append(F.struct(F.lit(name).alias("step"), F.count_if(passed).alias("n")))
    return recordings(spark, d).agg(F.array(*counts).alias("steps")).select(F.explode("steps").alias("s")).select("s.step", "s.n")


@query("rate_crosstab", ctes("rec") + " SELECT sfreq, count(*) FILTER (epilepsy) AS positive, count(*) FILTER (NOT epilepsy) AS negative, count(DISTINCT subject) AS subjects FROM rec GROUP BY sfreq")
def rate_crosstab(spark, d):
    return recordings(spark, d).groupBy("sfreq").agg(F.count_if("epilepsy").alias("positive"), F.count_if(~F.col("epilepsy")).alias("negative"), F.countDistinct("subject").alias("subjects"))


@query("memory_estimate", ctes("rec") + ",\n" + WINDOWS_SQL + " SELECT count(*) AS n, CAST(count(*) * 22 * 120 * 256 * 4 AS DOUBLE) / 1e9::DOUBLE AS tensor_gb, CAST(count(*) * 22 * 120 * 256 * 8 AS DOUBLE) / 1e9::DOUBLE * 2.5::DOUBLE AS peak_gb FROM placed WHERE position < 20")
def memory_estimate(spark, d):
    n = F.count("*")
    gb = lambda width: (n * (22 * 120 * 256 * width)).cast("double") / F.lit(1e9)
    return cohort.windows(recordings(spark, d), LENGTH, STRIDE, CAP).agg(n.alias("n"), gb(4).alias("tensor_gb"), (gb(8) * F.lit(2.5)).alias("peak_gb"))


@query("path_parts", "WITH " + SQL["rec"] + ", p AS (SELECT replace(path, '/s001/', '/s001_' || year || '/01_tcp_ar/') AS path FROM rec) SELECT path, regexp_extract(path, '([^/]+)/(s\\d+)_([^/]+)/([^/]+)/([^/]+)\\.edf$', 1) AS subject, regexp_extract(path, '([^/]+)/(s\\d+)_([^/]+)/([^/]+)/([^/]+)\\.edf$', 3) AS year, regexp_extract(path, '([^/]+)/(s\\d+)_([^/]+)/([^/]+)/([^/]+)\\.edf$', 4) AS montage, CASE WHEN regexp_extract(path, '_t(\\d+)\\.edf$', 1) = '' THEN regexp_extract(path, '([^/]+)\\.edf$', 1) ELSE regexp_extract(path, '_t(\\d+)\\.edf$', 1) END AS t_id FROM p")
def path_parts(spark, d):
    path = F.replace(F.col("path"), F.lit("/s001/"), F.concat(F.lit("/s001_"), F.col("year").cast("string"), F.lit("/01_tcp_ar/")))
    rows = recordings(spark, d).select(path.alias("path"))
    token = F.regexp_extract("path", r"_t(\d+)\.edf$", 1)
    return rows.select("path", scalars.path_part(F.col("path"), 2).alias("subject"), scalars.path_part(F.col("path"), 4).alias("year"), scalars.path_part(F.col("path"), 5).alias("montage"), F.when(token == "", scalars.path_part(F.col("path"), 6)).otherwise(token).alias("t_id"))


HEADER_SQL = "h AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey || ' M 01-JAN-1970 Age:' || c_custkey % 90 WHEN 1 THEN 'x F y Age:3 Age:4 ' WHEN 2 THEN c_name || ' | z' ELSE ' F  M Age:' END AS header FROM customer)"


@query("header_age_gender", "WITH " + HEADER_SQL + " SELECT c_custkey, CASE WHEN len(regexp_extract_all(header, 'Age:(\\d+)', 1)) = 1 THEN CAST(regexp_extract(header, 'Age:(\\d+)', 1) AS INTEGER) ELSE -1 END AS age, CASE WHEN len(regexp_extract_all(header, '\\s([F|M])\\s', 1)) = 1 THEN regexp_extract(header, '\\s([F|M])\\s', 1) ELSE 'X' END AS gender FROM h")
def header_age_gender(spark, d):
    key = F.col("c_custkey").cast("string")
    header = F.when(F.col("c_custkey") % 4 == 0, F.concat(key, F.lit(" M 01-JAN-1970 Age:"), (F.col("c_custkey") % 90).cast("string"))).when(F.col("c_custkey") % 4 == 1, "x F y Age:3 Age:4 ").when(F.col("c_custkey") % 4 == 2, F.concat("c_name", F.lit(" | z"))).otherwise(" F  M Age:")
    return table(spark, d, "customer").select("c_custkey", scalars.header_age(header).alias("age"), scalars.header_gender(header).alias("gender"))


@query("seizure_spans", ctes("spans") + " SELECT path, round(start, 6) AS start, round(stop, 6) AS stop FROM spans WHERE kind = 'seiz'")
def seizure_spans(spark, d):
    return spans(spark, d).filter("kind = 'seiz'").select("path", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"))


@query("montage_channels", """WITH e AS (SELECT ['FP1', 'F7', 'T3', 'T5', 'O1', 'FP2', 'F8', 'T4', 'T6', 'O2'] AS names), l AS (SELECT s_nationkey AS n, s_suppkey AS k, names[1 + s_suppkey % 10] AS a, names[1 + (s_suppkey // 10 + 1 + s_suppkey) % 10] AS b FROM supplier, e WHERE s_suppkey % 5 <> 0)
SELECT 'tcp_' || n AS montage, count(*) AS n_pairs, string_agg(a || '-' || b, ' ' ORDER BY k) AS bipoles, count(DISTINCT a) + count(DISTINCT b) FILTER (NOT EXISTS (SELECT 1 FROM l o WHERE o.n = l.n AND o.a = l.b)) AS n_electrodes FROM l GROUP BY n""")
def montage_channels(spark, d):
    """Montage definitions written from suppliers, line by line, parsed: pairs after the mark, and the distinct electrodes."""
    from tidecohort.sources.corpus import montage_electrodes, parse_montage

    names = F.array(*[F.lit(n) for n in ("FP1", "F7", "T3", "T5", "O1", "FP2", "F8", "T4", "T6", "O2")])
    k = F.col("s_suppkey")
    a, b = F.get(names, (k % 10).cast("int")), F.get(names, ((F.floor(k / 10) + 1 + k) % 10).cast("int"))
    montage = F.concat(F.lit("tcp_"), F.col("s_nationkey").cast("string")).alias("montage")
    before = F.when(k % 5 == 0, -k - 1).otherwise(k + 1).alias("line")
    pairs = table(spark, d, "supplier").select(montage, before, F.format_string("montage = %d, %s-%s: EEG %s-LE  --  EEG %s-LE", k, a, b, a, b).alias("value"))
    marks = pairs.groupBy("montage").agg(F.lit(0).cast("long").alias("line")).withColumn("value", F.lit("[Montage]"))
    notes = pairs.filter("line > 0").select("montage", "line", F.concat(F.lit("# "), "value").alias("value"))
    parsed = parse_montage(pairs.unionByName(marks).unionByName(notes))
    listed = parsed.groupBy("montage").agg(F.count("*").alias("n_pairs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "bipole"))), lambda p: p["bipole"]), " ").alias("bipoles"))
    return listed.join(montage_electrodes(parsed).select("montage", F.size("channels").cast("long").alias("n_electrodes")), "montage")


@query("records_from_corpus", ctes("rec") + " SELECT subject, epilepsy, len(paths) AS n, paths[1] AS first FROM (SELECT subject, min_by(epilepsy, path) AS epilepsy, list_sort(list(DISTINCT path)) AS paths FROM rec WHERE abs(sfreq - 256) <= 1e-8::DOUBLE + 1e-5::DOUBLE * 256 AND n_seizure = 0 AND duration >= 600 GROUP BY subject)")
def records_from_corpus(spark, d):
    """Recordings of one rate without seizures and of ten minutes or more, by subject."""
    rows = cohort.by_subject(cohort.records(recordings(spark, d), 256.0, True, 600.0))
    return rows.select("subject", "epilepsy", F.size("paths").cast("long").alias("n"), F.get("paths", F.lit(0)).alias("first"))


@query("records_from_windows", ctes("rec") + ",\n" + WINDOWS_SQL + " SELECT DISTINCT path, subject, epilepsy FROM placed WHERE position < 5")
def records_from_windows(spark, d):
    """The recordings of a window plan, each once."""
    return cohort.records_of_plan(cohort.windows(recordings(spark, d), LENGTH, STRIDE, 5)).select("path", "subject", "epilepsy")


@query("common_channels", ctes("components") + " SELECT ic AS channel, count(DISTINCT path) AS n FROM components GROUP BY ic HAVING count(DISTINCT path) = (SELECT count(DISTINCT path) FROM components)")
def common_channels(spark, d):
    """Channels that every recording has."""
    rows = components(spark, d).select("path", F.col("ic").alias("channel"))
    total = rows.agg(F.countDistinct("path").alias("total"))
    return rows.groupBy("channel").agg(F.countDistinct("path").alias("n")).join(F.broadcast(total), F.col("n") == F.col("total")).select("channel", "n")


@query("channel_names", "SELECT s_suppkey, CASE WHEN upper(name) = 'FP1' THEN 'Fp1' WHEN upper(name) = 'CZ' THEN 'Cz' WHEN upper(name) = 'T3' THEN 'T3' ELSE name END AS channel FROM (SELECT s_suppkey, trim(regexp_replace(regexp_replace(['EEG FP1-REF', 'cz-LE', 'EEG T3', 'EKG1-REF'][1 + s_suppkey % 4], '-(REF|LE)$', ''), '^EEG ', '')) AS name FROM supplier)")
def channel_names(spark, d):
    names = F.array(*[F.lit(x) for x in ("EEG FP1-REF", "cz-LE", "EEG T3", "EKG1-REF")])
    return table(spark, d, "supplier").select("s_suppkey", scalars.canonical_channel(F.get(names, (F.col("s_suppkey") % 4).cast("int"))).alias("channel"))


LOBE_SQL = "CASE regexp_extract(n, '^(FP|AF|FC|FT|TP|CP|PO|F|T|C|P|O)', 1) " + " ".join(f"WHEN '{p}' THEN '{place}'" for p, place in scalars.LOBES) + " ELSE 'central' END"
ELECTRODES = ("Fp1", "T4", "Cz", "P3", "C3", "AF8", "O2", "EEG FP1-REF", "eeg t5-le", "FT9", "TP10", "CP3", "EEG EKG1-REF", "PO7", "Pz")


@query("electrode_regions", f"SELECT s_suppkey, CASE WHEN k = '' OR lobe = 'central' THEN 'central_midline' ELSE lobe || '_' || CASE WHEN CAST(k AS INTEGER) % 2 = 1 THEN 'left' ELSE 'right' END END AS region FROM (SELECT s_suppkey, regexp_extract(n, '(\\d+)$', 1) AS k, {LOBE_SQL} AS lobe FROM (SELECT s_suppkey, regexp_replace(regexp_replace(upper({list(ELECTRODES)}[1 + s_suppkey % {len(ELECTRODES)}]), '-(REF|LE)$', ''), '^EEG ', '') AS n FROM supplier))")
def electrode_regions(spark, d):
    names = F.array(*[F.lit(x) for x in ELECTRODES])
    return table(spark, d, "supplier").select("s_suppkey", scalars.electrode_region(F.get(names, (F.col("s_suppkey") % len(ELECTRODES)).cast("int"))).alias("region"))


REGION_SQL = "CASE WHEN z < 0.030 AND abs(x) > 0.035 THEN 'temporal_' || CASE WHEN x < 0 THEN 'left' ELSE 'right' END WHEN abs(x) < 0.015 THEN 'central_midline' WHEN y > 0.030 THEN 'frontal_' || CASE WHEN x < 0 THEN 'left' ELSE 'right' END WHEN y < -0.020 THEN 'posterior_' || CASE WHEN x < 0 THEN 'left' ELSE 'right' END ELSE 'central_midline' END"


@query("dipole_regions", ctes("components") + f" SELECT path, ic, {REGION_SQL} AS region FROM components WHERE NOT (gof < 5)")
def dipole_regions(spark, d):
    return components(spark, d).filter(~(F.col("gof") < 5)).select("path", "ic", scalars.dipole_region(F.col("x"), F.col("y"), F.col("z")).alias("region"))


@query("region_counts", ctes("components") + f", c AS (SELECT {REGION_SQL} AS region, gof FROM components), r AS (SELECT unnest(['frontal_left', 'frontal_right', 'temporal_left', 'temporal_right', 'central_midline', 'posterior_left', 'posterior_right']) AS region, unnest(range(7)) AS place) SELECT r.region, CAST(place AS INTEGER) AS place, count(gof) AS n FROM r LEFT JOIN c USING (region) GROUP BY ALL")
def region_counts(spark, d):
    found = components(spark, d).select(scalars.dipole_region(F.col("x"), F.col("y"), F.col("z")).alias("found"), "gof")
    regions = spark.createDataFrame([(r, i) for i, r in enumerate(scalars.REGIONS)], "region string, place int")
    return regions.join(found, F.col("region") == F.col("found"), "left").groupBy("region", "place").agg(F.count("gof").alias("n"))


@query("psd_variants", "SELECT s_suppkey, 'psd' || CASE WHEN s_suppkey % 2 = 0 THEN '-bipolar' ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN '-native' ELSE '' END || CASE WHEN s_suppkey % 5 = 0 THEN '-interp' ELSE '' END || CASE WHEN s_suppkey % 7 = 0 THEN '-aas' ELSE '' END || CASE WHEN s_suppkey % 11 < 6 THEN '-notch-60-120' ELSE '' END AS variant FROM supplier")
def psd_variants(spark, d):
    by = lambda k: F.col("s_suppkey") % k == 0
    notch = F.when(F.col("s_suppkey") % 11 < 6, F.array(F.lit(60.0), F.lit(119.8))).otherwise(F.array().cast("array<double>"))
    return table(spark, d, "supplier").select("s_suppkey", scalars.psd_variant(by(2), by(3), by(5), by(7), notch).alias("variant"))


@query("union_of_sources", "SELECT kind, count(*) AS n FROM (SELECT 'a' AS kind, l_suppkey AS k FROM lineitem UNION ALL SELECT 'b', s_suppkey FROM supplier) GROUP BY kind")
def union_of_sources(spark, d):
    a = table(spark, d, "lineitem").select(F.lit("a").alias("kind"), F.col("l_suppkey").alias("k"))
    b = table(spark, d, "supplier").select(F.lit("b").alias("kind"), F.col("s_suppkey").alias("k"), F.lit(1).alias("extra"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"))


@query("set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 UNION SELECT l_suppkey FROM lineitem WHERE l_tax > 0.07) UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_tax > 0.07) UNION ALL SELECT 'except', count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_tax > 0.07)")
def set_operations(spark, d):
    items = table(spark, d, "lineitem")
    a, b = items.filter("l_quantity > 49").select("l_suppkey"), items.filter("l_tax > 0.07").select("l_suppkey")
    counted = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return counted("union", a.union(b).distinct()).union(counted("intersect", a.intersect(b))).union(counted("except", a.subtract(b)))


@query("tumbling_windows", "SELECT user_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    from tidecohort.streaming.windows import hourly

    rows = hourly(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select("user_id", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", F.round("total", 4).alias("total"))


@query("session_windows", """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, CAST(min(ts) AS VARCHAR) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    from tidecohort.streaming.windows import sessions

    rows = sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    whole, part = F.date_format("started", "yyyy-MM-dd HH:mm:ss"), F.date_format("started", "SSSSSS")
    return rows.select("user_id", F.regexp_replace(F.concat(whole, F.lit("."), part), r"\.?0*$|(?<=\.\d{1,5})0+$", "").alias("started"), "n")
