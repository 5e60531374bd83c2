"""Building a corpus: the listing, headers, annotations and sidecars of files joined to one table of recordings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecohort.functions import scalars
from tidecohort.operators import chain, cohort
from tidecohort.operators.chain import Chain
from tidecohort.operators.tables import stored
from tidecohort.sources import corpus, edf, windows

SIDECAR = "bads array<string>, too_many boolean, segments array<struct<start:double,stop:double>>, seizures array<struct<start:double,stop:double>>, periodic struct<f0:double,strength:double,flagged:boolean>"


def write_listing(files: DataFrame, path: str) -> None:
    """Cache a listing as text, a path a line, in case-blind order."""
    files.select(F.col("path").alias("value")).orderBy(F.lower("value"), "value").write.mode("overwrite").text(path)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, subject, session, year, montage, file, epilepsy) from a cached listing; lines of another form are left out."""
    part = lambda k: scalars.path_part(F.col("path"), k)
    rows = spark.read.text(path).select(F.trim("value").alias("path")).filter(part(2) != "")
    return rows.select("path", part(2).alias("subject"), part(3).alias("session"), part(4).alias("year"), part(5).alias("montage"), part(6).alias("file"), F.col("path").contains("/00_epilepsy/").alias("epilepsy"))


def cached_listing(spark: SparkSession, root: str, cache: str) -> DataFrame:
    """The cached listing, written first where there is none."""
    try:
        spark.read.text(cache).limit(1).count()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        write_listing(corpus.listing(spark, root), cache)
    return read_listing(spark, cache)


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(path, bads, too_many, segments, seizures, periodic) of all sidecar files; broken ones come back empty."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*-bads.json").text(root, wholetext=True)
    parsed = rows.select(plain(F.regexp_replace("_metadata.file_path", r"-bads\.json$", ".edf")).alias("path"), F.from_json("value", SIDECAR).alias("s")).select("path", "s.*")
    empty = {"bads": "array<string>", "segments": "array<struct<start:double,stop:double>>", "seizures": "array<struct<start:double,stop:double>>"}
    return parsed.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in empty.items()} | {"too_many": F.coalesce("too_many", F.lit(False))})


def plain(path: F.Column) -> F.Column:
    """A path without the scheme that Spark's readers put before it, so that paths of different readers are equal."""
    return F.regexp_replace(path, "^file:/+", "/")


def recordings(spark: SparkSession, root: str) -> DataFrame:
    """One row per recording: path, subject, session, year, montage, t_id, epilepsy, sfreq, duration, age, gender, channels, n_seizure."""
    files = corpus.listing(spark, root).withColumn("path", plain(F.col("path")))
    heads = edf.read_headers(spark, root).withColumn("path", plain(F.col("path")))
    seizures = corpus.annotations(spark, root).filter("label = 'seiz'").groupBy(plain(F.col("path")).alias("of")).agg(F.count("*").alias("n"))
    t_id = F.coalesce(F.nullif(F.regexp_extract("file", r"_(t\d+)$", 1), F.lit("")), F.col("file"))
    joined = files.join(heads, "path").join(seizures, F.col("path") == F.col("of"), "left")
    return joined.select("path", "subject", "session", "year", "montage", t_id.alias("t_id"), "epilepsy", "sfreq", "duration", "age", "gender", "channels", F.coalesce("n", F.lit(0)).alias("n_seizure"))


@dataclass(frozen=True)
class Corpus:
    """A corpus on disk, which of its recordings count, and how their windows are mended; every method returns a DataFrame.

    ``version`` is a folder below ``root``; it is an error if it holds no recording. ``chosen`` picks recordings by their place in
    path order, ``most_recordings`` the first ones. Sidecars say which channels are interpolated, which segments dropped and
    which periodic artifact subtracted (where it is flagged and at most ``most_subtracted`` Hz).
    """

    spark: SparkSession
    root: str
    version: str | None = None
    only_seizure_free: bool = False
    excluded: str | None = None
    most_recordings: int | None = None
    chosen: tuple[int, ...] | None = None
    least_rate: float | None = None
    keep_labels: tuple[str, ...] = ()
    interpolate: bool = False
    drop_segments: bool = False
    drop_seizures: bool = False
    subtract: bool = False
    most_subtracted: float = 2.5
    bag_slots: int = 20
    bag_sign: bool = True
    bag_rank: str = "variance"
    least_fit: float = 0.0
    use_dipoles: bool = True

    @property
    def folder(self) -> str:
        return f"{self.root.rstrip('/')}/{self.version}" if self.version else self.root

    def recordings(self, labels: DataFrame | None = None) -> DataFrame:
        """The recordings that pass the options; ``labels`` (path, ic, label) are needed where ``keep_labels`` are required."""
        rows = recordings(self.spark, self.folder)
        if self.version and rows.isEmpty():
            raise ValueError(f"no recording below {self.folder}")
        if self.chosen is not None or self.most_recordings:
            wanted = set(range(self.most_recordings or 0)) | set(self.chosen or ())
            first = rows.select(F.col("path").alias("of")).orderBy("of").limit(max(wanted, default=-1) + 1).withColumn("place", F.row_number().over(Window.orderBy("of")) - 1)
            rows = rows.join(first.filter(F.col("place").isin(*sorted(wanted))), F.col("path") == F.col("of"), "left_semi")
        if self.only_seizure_free:
            rows = cohort.seizure_free(rows)
        if self.excluded:
            rows = cohort.without_excluded(rows, corpus.exclusions(self.spark, self.excluded))
        if self.keep_labels and labels is not None:
            rows = cohort.with_label(rows, labels, list(self.keep_labels))
        return rows.filter(F.col("sfreq") >= self.least_rate) if self.least_rate else rows

    def spans(self) -> DataFrame:
        """(path, start, stop, kind): bad segments and seizures of the sidecars."""
        found = sidecars(self.spark, self.folder)
        each = lambda c, kind: found.select("path", F.explode(c).alias("s")).select("path", "s.start", "s.stop", F.lit(kind).alias("kind"))
        return each("segments", "bad").unionByName(each("seizures", "seiz"))

    def plan(self, length: float, stride: float, ratios: dict[str, float], cap: int | None = None, seed: int = 42, labels: DataFrame | None = None) -> DataFrame:
        """Windows of all splits; those on bad or seizure spans, and recordings beyond repair, go as the options say."""
        beyond = sidecars(self.spark, self.folder).filter("too_many").select("path") if self.interpolate else None
        return cohort.data_module(self.recordings(labels), self.spans(), length, stride, ratios, cap, seed, too_many=beyond, drop_segments=self.drop_segments, drop_seizures=self.drop_seizures)

    def bags(self, components: DataFrame) -> DataFrame:
        """Fixed-size bags of the kept components (path, ic, label, topography, x)."""
        kept = components.filter(F.lower(F.trim("label")).isin(*[k.lower() for k in self.keep_labels])) if self.keep_labels else components
        return chain.component_bags(kept, self.bag_slots, self.bag_rank, self.bag_sign)

    def regions(self, components: DataFrame) -> DataFrame:
        """Regional series of the components (path, ic, x, topography, electrode, dx, dy, dz, gof).

        A component's region is that of its dipole, unless its fit is below ``least_fit`` or dipoles are not used; else that of
        the electrode it is strongest at.
        """
        dipole = F.when(F.lit(self.use_dipoles) & (F.col("gof") >= self.least_fit), scalars.dipole_region(F.col("dx"), F.col("dy"), F.col("dz")))
        return chain.regional_series(components.withColumn("region", F.coalesce(dipole, scalars.electrode_region(F.col("electrode")))))

    def whole_signals(self, channels: list[str] | None = None) -> DataFrame:
        """(path, channel, sfreq, x, measured): recordings not cut into windows, stretches joined in order."""
        parts = edf.read_edf(self.spark, self.folder, channels).withColumn("path", plain(F.col("path")))
        kept = self.recordings().select("path", scalars.measured_on(F.col("year")).alias("measured"))
        whole = parts.join(kept, "path").groupBy("path", "channel", "sfreq", "measured").agg(F.array_sort(F.collect_list(F.struct("start_s", "x"))).alias("parts"))
        return whole.select("path", "channel", "sfreq", F.flatten(F.transform("parts", lambda p: p["x"])).alias("x"), "measured")

    def windows(self, plan: DataFrame, channels: list[str] | None = None) -> DataFrame:
        """Windows of a plan (path, start, end, ...) with ``names`` and ``x``, channels in order of their names; a file is read once."""
        rows = windows.processed(plan, Chain(fs=0.0, zeros=False, rename={}), plan.columns, channels=channels).filter("ok")
        both = F.array_sort(F.arrays_zip("names", "x"))
        return rows.select(*plan.columns, F.transform(both, lambda c: c["names"]).alias("names"), F.transform(both, lambda c: c["x"]).alias("x"))

    def processed(self, plan: DataFrame, steps: Chain, keys: list[str], margin_s: float = 4.0) -> DataFrame:
        """Windows of a plan through the chain, mended as the options and the recordings' sidecars say; ``ok`` tells which succeeded."""
        slow = F.col("periodic.flagged") & F.col("periodic.f0").between(1e-9, self.most_subtracted)
        period = F.when(F.lit(self.subtract) & slow, 1 / F.col("periodic.f0"))
        found = sidecars(self.spark, self.folder).select(F.col("path").alias("of"), F.col("bads").alias("bad"), "too_many", period.alias("period_s"))
        known = plan.drop("bad", "too_many", "period_s").join(found, F.col("path") == F.col("of"), "left").drop("of")
        known = known.withColumn("too_many", F.coalesce("too_many", F.lit(False)))
        return windows.processed(known, replace(steps, interpolate=self.interpolate), keys, margin_s)

    def whole_recordings(self, steps: Chain) -> DataFrame:
        """Recordings that are not cut, through the chain, with age, gender and date; those that cannot be read are left out.

        It is an error if none can be read.
        """
        rows = self.recordings().withColumns({"start": F.lit(0.0), "end": F.col("duration"), "measured": scalars.measured_on(F.col("year"))})
        keys = ["path", "subject", "age", "gender", "measured", "epilepsy"]
        found = stored(self.processed(rows.select(*keys, "start", "end"), steps, keys, 0.0).filter("ok").drop("ok"))
        if found.isEmpty():
            raise ValueError(f"no recording below {self.folder} can be read")
        return found
