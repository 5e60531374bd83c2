"""Sources of a corpus: directory listings, montage files, annotation files and exclusion lists."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecohort.functions import scalars


def listing(spark: SparkSession, root: str, pattern: str = "*.edf") -> DataFrame:
    """(path, subject, session, year, montage, file, epilepsy) of all recordings below a folder, hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    part = lambda k: scalars.path_part(F.col("path"), k)
    files = files.filter(~F.col("path").rlike(r"/\.[^/]+"))
    return files.select("path", part(2).alias("subject"), part(3).alias("session"), part(4).alias("year"), part(5).alias("montage"), part(6).alias("file"), F.col("path").contains("/00_epilepsy/").alias("epilepsy"))


def headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, age, gender) from the first 88 bytes of every recording: files are listed by Spark and only their heads are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.edf").load(root).select("path")

    def heads(batches):
        from tidecohort.sources.edf import open_file

        for batch in batches:
            fields = []
            for path in batch.column("path").to_pylist():
                with open_file(path) as file:
                    fields.append(file.read(88)[8:].decode("latin-1"))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(fields, pa.string())], names=["path", "field"])

    field = F.col("field")
    return files.mapInArrow(heads, "path string, field string").select("path", scalars.header_age(field).alias("age"), scalars.header_gender(field).alias("gender"))


def parse_montage(lines: DataFrame) -> DataFrame:
    """(montage, idx, bipole, pole_a, pole_b) from (montage, line, value): pairs that follow the ``[Montage]`` mark."""
    text = F.trim("value")
    inside = F.max(text == "[Montage]").over(Window.partitionBy("montage").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    pattern = r"montage\s*=\s*(\d+)\s*,\s*([^:]+):\s*(.+?)\s*--\s*(.+)"
    got = lambda k: F.trim(F.regexp_extract("value", pattern, k))
    rows = lines.withColumn("inside", inside).filter(F.col("inside") & (text != "") & ~text.startswith("#") & F.col("value").rlike(pattern))
    return rows.select("montage", got(1).cast("int").alias("idx"), got(2).alias("bipole"), got(3).alias("pole_a"), got(4).alias("pole_b"))


def montage_electrodes(montages: DataFrame) -> DataFrame:
    """(montage, channels): distinct electrodes, all first poles before the second ones."""
    poles = F.concat(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("pole_a").alias("p")))), lambda x: x["p"]), F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("pole_b").alias("p")))), lambda x: x["p"]))
    return montages.groupBy("montage").agg(F.array_distinct(poles).alias("channels"))


def annotations(spark: SparkSession, root: str, level: str = "csv_bi") -> DataFrame:
    """(path, label, start_s, stop_s) of all annotation files of a level; comment lines are skipped."""
    schema = "channel string, start_time double, stop_time double, label string, confidence double"
    rows = spark.read.schema(schema).option("comment", "#").option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{level}").csv(root)
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), rf"\.{level}$", ".edf").alias("path"), F.trim("label").alias("label"), F.col("start_time").alias("start_s"), F.col("stop_time").alias("stop_s"))


def durations(spark: SparkSession, root: str, level: str = "csv_bi") -> DataFrame:
    """(path, duration) from the ``# duration = N secs`` line of annotation files."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{level}").text(root)
    found = F.regexp_extract("value", r"^#\s*duration\s*=\s*([0-9.]+)", 1)
    return lines.select(F.regexp_replace(F.col("_metadata.file_path"), rf"\.{level}$", ".edf").alias("path"), found.alias("d")).filter("d <> ''").select("path", F.col("d").cast("double").alias("duration"))


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an exclusion list; blanks and comments are dropped where it is used."""
    return spark.read.text(path)


def write_new(rows: DataFrame, path: str, keys: list[str], partition: str | None = None) -> DataFrame:
    """Append only rows whose keys are not yet written (idempotent sink); the rows appended."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
        rows = rows.join(done, keys, "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return rows


def by_stem(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(stem, file) of the files below a folder whose names end in a suffix; the stem is the name without it."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))
    return names.select(F.expr(f"substr(file, 1, length(file) - {len(suffix)})").alias("stem"), "file")


def spectra(spark: SparkSession, path: str, variant: str = "psd") -> DataFrame:
    """Spectra of one variant of a sink; only that variant's folder is read. Recordings without it are missing."""
    return spark.read.parquet(path).filter(F.col("variant") == variant)


#: Edges of the histogram of comb fundamentals (Hz); the last range has no upper end.
COMB_EDGES = (0.0, 0.5, 0.7, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0)


def comb_fundamentals(sidecars: DataFrame, edges: tuple[float, ...] = COMB_EDGES) -> DataFrame:
    """(low, n) of flagged fundamentals in half-open ranges, and as ``low`` null how many recordings are flagged at all."""
    flagged = sidecars.filter("periodic.flagged").select(F.col("periodic.f0").alias("f0"))
    low = F.array_max(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col("f0")))
    ranges = flagged.filter(F.col("f0").isNotNull()).groupBy(low.alias("low")).agg(F.count("*").alias("n"))
    return ranges.unionByName(flagged.agg(F.lit(None).cast("double").alias("low"), F.count("*").alias("n")))
