"""Queries over whole window plans: the data module, replay of split manifests, sample modes, and event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecohort.functions import scalars
from tidecohort.operators import cohort, replayed
from tidecohort.operators.tables import shared_dir
from tidecohort.plans.cleaning import LOBE_SQL
from tidecohort.plans.cohorts import CAP, EXCLUDED_SQL, LENGTH, RATIOS, REGION_SQL, SPLITS_SQL, STRIDE, WINDOWS_SQL, plan
from tidecohort.plans.register import query
from tidecohort.sources.fixtures import SQL, ctes, recordings, spans, table

KEPT_SQL = "WITH " + SQL["rec"].replace("rec AS", "every AS", 1) + ",\n" + SQL["spans"] + ",\n" + EXCLUDED_SQL + ",\nrec AS (SELECT * FROM every WHERE path NOT IN (SELECT replace(replace(value, '/./', '/'), '//', '/') FROM excluded))"
BEYOND_SQL = "beyond AS (SELECT path FROM spans WHERE kind = 'bad' GROUP BY path HAVING count(*) >= 3)"


def excluded(spark, d):
    listed = F.concat(F.lit("/corpus//"), F.col("o_custkey").cast("string"), F.lit("/./s001/"), F.col("o_orderkey").cast("string"), F.lit(".edf"))
    return table(spark, d, "orders").filter("o_orderkey % 11 = 0").select(listed.alias("value"))


def beyond(spark, d):
    """Recordings with three bad spans or more."""
    return spans(spark, d).filter("kind = 'bad'").groupBy("path").agg(F.count("*").alias("n")).filter("n >= 3").select("path")


def module(spark, d):
    return cohort.data_module(recordings(spark, d), spans(spark, d), LENGTH, STRIDE, RATIOS, CAP, excluded=excluded(spark, d), too_many=beyond(spark, d), drop_segments=True, drop_seizures=True)


@query("data_module", KEPT_SQL + ",\n" + BEYOND_SQL + ",\n" + WINDOWS_SQL + ",\n" + SPLITS_SQL + """
SELECT split, subject, path, idx, CAST(epilepsy AS INTEGER) AS target FROM placed w JOIN splits USING (subject) WHERE position < 20 AND path NOT IN (SELECT path FROM beyond) AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.path = w.path AND s.start < w."end" AND s.stop > w.start)""")
def data_module(spark, d):
    """Windows of all splits with their targets, after exclusion, cap, split and the drop of bad windows."""
    return module(spark, d).select("split", "subject", "path", "idx", "target")


@query("data_module_sizes", KEPT_SQL + ",\n" + WINDOWS_SQL + ",\n" + SPLITS_SQL + """
SELECT split, CAST(epilepsy AS INTEGER) AS target, count(*) AS windows, count(DISTINCT subject) AS subjects FROM placed w JOIN splits USING (subject) WHERE position < 20 AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.kind = 'seiz' AND s.path = w.path AND s.start < w."end" AND s.stop > w.start) GROUP BY ALL""")
def data_module_sizes(spark, d):
    rows = cohort.data_module(recordings(spark, d), spans(spark, d), LENGTH, STRIDE, RATIOS, CAP, excluded=excluded(spark, d), drop_seizures=True)
    return rows.groupBy("split", "target").agg(F.count("*").alias("windows"), F.countDistinct("subject").alias("subjects"))


@query("split_replay", ctes("rec") + ",\n" + EXCLUDED_SQL + ",\n" + WINDOWS_SQL + ",\n" + SPLITS_SQL + """
SELECT split, path, start, "end", duration FROM placed JOIN splits USING (subject) WHERE position < 5 AND path NOT IN (SELECT replace(replace(value, '/./', '/'), '//', '/') FROM excluded)""")
def split_replay(spark, d):
    """The plan again from its manifests, of which every other row names a corpus that has moved."""
    moved = F.when(F.col("idx") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("/elsewhere"), F.col("path")))
    manifests = plan(spark, d, 5).select(moved.alias("path"), "start", "end", "split")
    return cohort.replay(recordings(spark, d), manifests, excluded(spark, d)).select("split", "path", "start", "end", "duration")


@query("permuted_files", ctes("rec") + " SELECT subject, path FROM rec ORDER BY md5('42|' || path), path LIMIT 100")
def permuted_files(spark, d):
    """Samples mode: the first hundred recordings in seeded order."""
    return cohort.permuted_files(recordings(spark, d), 100).select("subject", "path")


@query("dictionary_windows", ctes("rec") + """, n AS (SELECT *, CAST(greatest(0, floor((duration - 60) * sfreq) + 1) AS BIGINT) AS n FROM rec),
s AS (SELECT DISTINCT subject, path, sfreq, CAST('0x' || substr(md5('42|' || path || '|' || CAST(i AS VARCHAR)), 1, 12) AS BIGINT) % n AS sample FROM n, unnest(range(10)) AS t(i) WHERE n > 0)
SELECT subject, path, sample, round(sample / sfreq, 6) AS start, round(sample / sfreq + 60, 6) AS "end" FROM s QUALIFY row_number() OVER (PARTITION BY subject ORDER BY md5('42|' || path || '|' || CAST(sample AS VARCHAR)), path, sample) <= 10""")
def dictionary_windows(spark, d):
    rows = cohort.dictionary_windows(recordings(spark, d), LENGTH)
    return rows.select("subject", "path", "sample", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("measured_dates", ctes("rec") + " SELECT path, strftime(make_date(year, 1, 1), '%Y-%m-%d') AS measured FROM rec")
def measured_dates(spark, d):
    return recordings(spark, d).select("path", scalars.measured_on(F.col("year").cast("string")).cast("string").alias("measured"))


@query("sliding_windows", "SELECT user_id, strftime(time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(CAST(15 * i AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n, round(sum(value), 4) AS total FROM events, unnest(range(4)) AS t(i) GROUP BY ALL")
def sliding_windows(spark, d):
    """Hours that start every quarter of an hour."""
    from tidecohort.streaming.windows import sliding

    rows = sliding(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n", F.round("total", 4).alias("total"))


@query("running_counters", "SELECT event_id, user_id, row_number() OVER w AS n, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS most FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def running_counters(spark, d):
    """Counters after every event, in a batch window; ``keyed_state`` is the stream that keeps them."""
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, d, "events")
    return rows.select("event_id", "user_id", F.count("*").over(upto).alias("n"), F.round(F.max("value").over(upto), 6).alias("most"))


@query("keyed_state", "SELECT user_id, count(*) AS n, round(max(value), 6) AS most, list_sort(list(DISTINCT event_type))[1] AS first_kind, count(*) FILTER (event_type = (SELECT min(event_type) FROM events)) AS n_first FROM events GROUP BY user_id")
def keyed_state(spark, d):
    """The last state of each user of a stream over all events, kept as value and map state of a stateful processor."""
    from tidecohort.streaming import windows as streams

    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = streams.last_state(streams.counters(stream), f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    least = events.agg(F.min("event_type").alias("least"))
    kinds = F.array_sort(F.map_keys("kinds"))
    return rows.join(F.broadcast(least)).select("user_id", "n", F.round("most", 6).alias("most"), F.get(kinds, F.lit(0)).alias("first_kind"), F.coalesce(F.col("kinds")[F.col("least")], F.lit(0)).alias("n_first"))


@query("replayed_plan")
def replayed_plan(spark, d):
    """Windows and splits in the order of one seeded generator, replayed from the window counts of the subjects."""
    rows = replayed.plan(recordings(spark, d), LENGTH, STRIDE, RATIOS, CAP)
    return rows.select("split", "subject", "path", "idx", "position")


@query("performance_table", ctes("runs") + " SELECT model, '| ' || model || ' | ' || CASE WHEN count(*) <= 1 OR stddev_samp(balanced_accuracy) IS NULL THEN printf('%.3f (n=1)', avg(balanced_accuracy)) ELSE printf('%.3f +/- %.3f', avg(balanced_accuracy), stddev_samp(balanced_accuracy)) END || ' |' AS line FROM runs GROUP BY model")
def performance_table(spark, d):
    """A Markdown line for each model with the mean and deviation of its runs."""
    from tidecohort.sources.fixtures import runs

    rows = runs(spark, d).groupBy("model").agg(F.avg("balanced_accuracy").alias("m"), F.stddev_samp("balanced_accuracy").alias("s"), F.count("*").alias("n"))
    return rows.select("model", scalars.markdown_row(F.col("model"), scalars.mean_with_deviation(F.col("m"), F.col("s"), F.col("n"))).alias("line"))


@query("sql_functions", ctes("components") + f""", e AS (SELECT *, upper(regexp_replace(regexp_replace(['EEG FP1-REF', 'O2', 'FC3'][1 + ic % 3], '-(REF|LE)$', ''), '^EEG ', '')) AS n FROM components), p AS (SELECT *, {LOBE_SQL} AS lobe, regexp_extract(n, '(\\d+)$', 1) AS k FROM e)
SELECT path, ic, {REGION_SQL} AS region, CASE WHEN k = '' OR lobe = 'central' THEN 'central_midline' ELSE lobe || '_' || CASE WHEN CAST(k AS INTEGER) % 2 = 1 THEN 'left' ELSE 'right' END END AS electrode FROM p""")
def sql_functions(spark, d):
    """The registered SQL functions over all components."""
    from tidecohort.sources.fixtures import components

    scalars.register(spark)
    return components(spark, d).selectExpr("path", "ic", "tide_region(x, y, z) AS region", "tide_electrode_region(array('EEG FP1-REF', 'O2', 'FC3')[ic % 3]) AS electrode")


MONTAGES = {"urgent": ["Fp1-F7", "F7-T3"], "high": ["Fp1-F7", "F7-T3", "T3-T5"], "medium": ["Fp2-F8"], "low": ["Fp2-F8", "F8-T4"], "not specified": ["Fp1-F7", "Fp2-F8"]}


@query("window_channels", ctes("rec") + ",\n" + WINDOWS_SQL + ", m AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in MONTAGES.items()) + ") AS t(montage, channels)) SELECT path, idx, montage, len(channels) AS n_channels, channels[1] AS first FROM placed JOIN m USING (montage) WHERE position < 20")
def window_channels(spark, d):
    """Planned windows with the channels of their recording's montage, a small table that is broadcast."""
    montages = spark.createDataFrame(list(MONTAGES.items()), "of string, channels array<string>")
    rows = cohort.windows(recordings(spark, d), LENGTH, STRIDE, CAP).join(F.broadcast(montages), F.col("montage") == F.col("of"))
    return rows.select("path", "idx", "montage", F.size("channels").cast("long").alias("n_channels"), F.get("channels", F.lit(0)).alias("first"))
