"""Domain views over the driver's tables: recordings, spans, signals, spectra, components, scores and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sampling rates that recordings are dealt over, by key modulo 4.
RATES = (250.0, 256.0, 400.0, 1000.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per recording: subject, path, sfreq, age, gender, year, montage, epilepsy, duration, n_seizure."""
    orders, customers, items = (table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem"))
    seizures = items.filter("l_returnflag = 'R' AND l_quantity >= 49").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("n_seizure"))
    rates = F.array(*[F.lit(r) for r in RATES])
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(seizures, F.col("o_orderkey") == F.col("key"), "left")
    return joined.select(
        F.col("o_custkey").cast("string").alias("subject"),
        recording_path("o_custkey", "o_orderkey").alias("path"),
        F.get(rates, F.col("o_orderkey") % 4).alias("sfreq"),
        (F.col("c_custkey") * 7 % 90).cast("int").alias("age"),
        F.when(F.col("c_custkey") % 3 == 0, "M").when(F.col("c_custkey") % 3 == 1, "F").otherwise("X").alias("gender"),
        F.year("o_orderdate").alias("year"),
        F.lower(F.substring("o_orderpriority", 3, 20)).alias("montage"),
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("epilepsy"),
        (30 + F.col("o_orderkey") * 37 % 1771).cast("double").alias("duration"),
        F.coalesce("n_seizure", F.lit(0)).cast("long").alias("n_seizure"),
    )


def recording_path(subject: str, key: str) -> F.Column:
    return F.concat(F.lit("/corpus/"), F.col(subject).cast("string"), F.lit("/s001/"), F.col(key).cast("string"), F.lit(".edf"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad and seizure spans (path, start, stop, kind) on the recordings' clock."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    start = F.col("l_linenumber") * 60 + F.col("l_discount") * 100
    kind = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49), "seiz").when((F.col("l_linestatus") == "F") & (F.col("l_tax") >= 0.07), "bad")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter(kind.isNotNull())
    return joined.select(recording_path("o_custkey", "o_orderkey").alias("path"), start.alias("start"), (start + F.col("l_quantity") / 5).alias("stop"), kind.alias("kind"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short signals (vec_id, subject, y, x: 64 samples)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.col("vec_id") % 40).cast("string").alias("subject"), (F.col("label") >= 5).alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power spectra (path, subject, cls, rate, n_times, p: 64 bins of 0.5 Hz)."""
    e = table(spark, sf_dir, "embeddings")
    scale = (1 + F.col("vec_id") * 7 % 17).cast("double")
    power = F.transform("embedding", lambda v: v.cast("double") * v.cast("double") * scale + F.lit(1e-9))
    return e.select(F.col("vec_id").cast("string").alias("path"), (F.col("vec_id") % 40).cast("string").alias("subject"), (F.col("label") >= 5).cast("int").alias("cls"), F.get(F.array(*[F.lit(r) for r in RATES]), (F.col("vec_id") % 4).cast("int")).alias("rate"), (1000 + F.col("vec_id")).cast("long").alias("n_times"), power.alias("p"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent components with dipoles: (path, ic, x, y, z, gof, label, prob)."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    label = F.when(F.col("label") < 5, " Brain").when(F.col("label") < 7, "other ").otherwise("Muscle")
    return e.select((F.col("vec_id") / 8).cast("long").cast("string").alias("path"), (F.col("vec_id") % 8).cast("int").alias("ic"), *[(at(i) * F.lit(0.35)).alias(n) for i, n in enumerate("xyz")], F.least(F.abs(at(3)) * 100, F.lit(100.0)).alias("gof"), label.alias("label"), (F.abs(at(4)) * 3 % 1).alias("prob"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window scores (window_id, subject, y, s)."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return joined.select(F.col("doc_id").alias("window_id"), F.col("source").alias("subject"), F.col("quality").cast("int").alias("y"), ((F.col("n_chars") % 1000).cast("double") / 1000 - F.lit(0.5)).alias("s"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment runs (run, model, feature, overrides, split, level, seed, balanced_accuracy, roc_auc)."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.round(F.avg("l_discount"), 6).alias("balanced_accuracy"), F.round(F.avg("l_tax"), 6).alias("roc_auc"))
    seed = F.when(F.col("l_linenumber") != 7, F.col("l_linenumber"))
    return items.select(
        F.concat_ws("/", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("run"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("feature"),
        F.concat(F.lit("data.seed="), F.col("l_linenumber").cast("string"), F.lit("; model=lr; output_dir=/x/"), F.col("l_linenumber").cast("string"), F.lit("; n_groups=32")).alias("overrides"),
        F.when(F.col("l_linenumber") % 2 == 0, "test").otherwise("train").alias("split"), F.lit("subject").alias("level"), seed.alias("seed"), "balanced_accuracy", "roc_auc",
    )


def kernel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel win counts (cls, dilation, diff, grp, kernel, value): a fixture over line items."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy((F.col("l_returnflag") == "R").cast("int").alias("cls"), (F.col("l_linenumber") % 4).cast("int").alias("dilation"), (F.col("l_linestatus") == "F").cast("int").alias("diff"), (F.col("l_suppkey") % 4).cast("int").alias("grp"), (F.col("l_partkey") % 8).cast("int").alias("kernel")).agg(F.count("*").alias("value"))


#: The same views as DuckDB common table expressions.
SQL = {
    "rec": """rec AS (SELECT CAST(o_custkey AS VARCHAR) AS subject, '/corpus/' || o_custkey || '/s001/' || o_orderkey || '.edf' AS path,
  [250.0::DOUBLE, 256.0::DOUBLE, 400.0::DOUBLE, 1000.0::DOUBLE][1 + o_orderkey % 4] AS sfreq, CAST(c_custkey * 7 % 90 AS INTEGER) AS age,
  CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'X' END AS gender, CAST(year(o_orderdate) AS INTEGER) AS year, lower(substr(o_orderpriority, 3, 20)) AS montage,
  c_mktsegment IN ('BUILDING', 'MACHINERY') AS epilepsy, CAST(30 + o_orderkey * 37 % 1771 AS DOUBLE) AS duration, CAST(coalesce(n, 0) AS BIGINT) AS n_seizure
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49 GROUP BY 1) z ON z.l_orderkey = o_orderkey)""",
    "spans": """spans AS (SELECT '/corpus/' || o_custkey || '/s001/' || o_orderkey || '.edf' AS path, l_linenumber * 60 + l_discount * 100 AS start,
  l_linenumber * 60 + l_discount * 100 + l_quantity / 5 AS stop, CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN 'seiz' WHEN l_linestatus = 'F' AND l_tax >= 0.07 THEN 'bad' END AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (l_returnflag = 'R' AND l_quantity >= 49) OR (l_linestatus = 'F' AND l_tax >= 0.07))""",
    "signals": """signals AS (SELECT vec_id, CAST(vec_id % 40 AS VARCHAR) AS subject, label >= 5 AS y, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)""",
    "psd": """psd AS (SELECT CAST(vec_id AS VARCHAR) AS path, CAST(vec_id % 40 AS VARCHAR) AS subject, CAST(label >= 5 AS INTEGER) AS cls,
  [250.0::DOUBLE, 256.0::DOUBLE, 400.0::DOUBLE, 1000.0::DOUBLE][1 + vec_id % 4] AS rate, CAST(1000 + vec_id AS BIGINT) AS n_times,
  list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE) * CAST(1 + vec_id * 7 % 17 AS DOUBLE) + CAST(1e-9 AS DOUBLE)) AS p FROM embeddings)""",
    "components": """components AS (SELECT CAST(vec_id // 8 AS VARCHAR) AS path, CAST(vec_id % 8 AS INTEGER) AS ic, CAST(embedding[1] AS DOUBLE) * CAST(0.35 AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) * CAST(0.35 AS DOUBLE) AS y,
  CAST(embedding[3] AS DOUBLE) * CAST(0.35 AS DOUBLE) AS z, least(abs(CAST(embedding[4] AS DOUBLE)) * 100, CAST(100 AS DOUBLE)) AS gof,
  CASE WHEN label < 5 THEN ' Brain' WHEN label < 7 THEN 'other ' ELSE 'Muscle' END AS label, abs(CAST(embedding[5] AS DOUBLE)) * 3 % 1 AS prob FROM embeddings)""",
    "scores": """scores AS (SELECT doc_id AS window_id, source AS subject, CAST(quality AS INTEGER) AS y, CAST(n_chars % 1000 AS DOUBLE) / 1000 - CAST(0.5 AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id))""",
    "runs": """runs AS (SELECT l_returnflag || '/' || l_linestatus || '/' || l_linenumber AS run, l_returnflag AS model, l_linestatus AS feature,
  'data.seed=' || l_linenumber || '; model=lr; output_dir=/x/' || l_linenumber || '; n_groups=32' AS overrides, CASE WHEN l_linenumber % 2 = 0 THEN 'test' ELSE 'train' END AS split, 'subject' AS level,
  CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS seed, round(avg(l_discount), 6) AS balanced_accuracy, round(avg(l_tax), 6) AS roc_auc FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber)""",
    "kernel_counts": """kernel_counts AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS cls, CAST(l_linenumber % 4 AS INTEGER) AS dilation, CAST(l_linestatus = 'F' AS INTEGER) AS diff, CAST(l_suppkey % 4 AS INTEGER) AS grp,
  CAST(l_partkey % 8 AS INTEGER) AS kernel, count(*) AS value FROM lineitem GROUP BY 1, 2, 3, 4, 5)""",
}


def ctes(*names: str) -> str:
    """A WITH clause of the named views, to be continued by ``, more AS (...)`` or the final SELECT."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
