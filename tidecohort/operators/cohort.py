"""Recordings and windows: filters, window plans, splits and pool counts, as plain DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecohort.operators.tables import stored


def seizure_free(recordings: DataFrame) -> DataFrame:
    return recordings.filter("n_seizure = 0")


def normalised(path: str) -> F.Column:
    """A path without doubled separators, single dots or a trailing separator."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(path), r"/(\./)+", "/"), "//+", "/"), "(?<=.)/$", "")


def without_excluded(recordings: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop recordings whose normalised path is listed; ``excluded`` has one path per row, blanks and comments ignored.

    An anti join would take the expressions for its keys and evaluate them at every comparison of its sort; an outer join
    sorts by what was computed once a row.
    """
    line = F.trim(F.col("value"))
    listed = excluded.select(line.alias("value")).filter("value <> '' AND NOT startswith(value, '#')").select(normalised("value").alias("gone"))
    met = recordings.withColumn("__whole", normalised("path")).join(listed.distinct(), F.col("__whole") == F.col("gone"), "left")
    return met.filter("gone IS NULL").drop("__whole", "gone")


def with_label(recordings: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """Recordings that have a component with one of the labels."""
    wanted = labels.filter(F.lower(F.trim("label")).isin(keep)).select(F.col("path").alias("of"))
    return recordings.join(wanted, F.col("path") == F.col("of"), "left_semi")


def near(a: F.Column, b: F.Column | float) -> F.Column:
    """Equality within the usual tolerance of 1e-8 plus 1e-5 of the second value."""
    b = b if isinstance(b, F.Column) else F.lit(float(b))
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def records(recordings: DataFrame, rate: float | None = None, only_seizure_free: bool = False, least_s: float | None = None, subject: str | None = None) -> DataFrame:
    """(path, subject, epilepsy) of the recordings that a report is about."""
    rows = recordings.filter(near(F.col("sfreq"), rate)) if rate is not None else recordings
    rows = seizure_free(rows) if only_seizure_free else rows
    rows = rows.filter(F.col("duration") >= least_s) if least_s is not None else rows
    rows = rows.filter(F.col("subject") == subject) if subject is not None else rows
    return rows.select("path", "subject", "epilepsy")


def records_of_plan(windows: DataFrame) -> DataFrame:
    """(path, subject, epilepsy) of the recordings of a plan, each once, with the values of its first window."""
    first = F.min_by(F.struct("subject", "epilepsy"), F.struct("start", "end", "subject"))
    return windows.groupBy("path").agg(first.alias("r")).select("path", "r.subject", "r.epilepsy")


def by_subject(rows: DataFrame) -> DataFrame:
    """(subject, epilepsy, paths): the distinct paths of a subject in order, and the label of the first."""
    return rows.groupBy("subject").agg(F.min_by("epilepsy", "path").alias("epilepsy"), F.array_sort(F.collect_set("path")).alias("paths"))


def window_count(duration: F.Column, length: float, stride: float) -> F.Column:
    return F.greatest(F.lit(0), F.floor((duration - F.lit(float(length))) / F.lit(float(stride))) + 1).cast("long")


def window_count_samples(duration: F.Column, sfreq: F.Column, length: float, stride: int) -> F.Column:
    return F.greatest(F.lit(0), F.floor((duration - F.lit(float(length))) * sfreq / F.lit(float(stride))) + 1).cast("long")


def check_plan(overlap: float, cap: int | None) -> None:
    if overlap >= 1:
        raise ValueError("overlap must be below 1")
    if cap is not None and cap < 1:
        raise ValueError("the cap must be positive")


def subject_counts(recordings: DataFrame, length: float, stride: float) -> DataFrame:
    """(subject, n_windows) of subjects that have a window."""
    counted = recordings.groupBy("subject").agg(F.sum(window_count(F.col("duration"), length, stride)).alias("n_windows"))
    return counted.filter("n_windows > 0")


def windows(recordings: DataFrame, length: float, stride: float, cap: int | None = None, balance: bool = False, seed: int = 42) -> DataFrame:
    """The window plan: per subject in seeded order (md5 of seed, path and index), at most ``cap`` windows.

    With ``balance`` and no cap the limit is the smallest count of any subject that has windows.
    """
    check_plan(1 - stride / length if stride < length else 0, cap)
    counted = recordings.withColumn("n", window_count(F.col("duration"), length, stride)).filter("n > 0")
    key = lambda i: F.md5(F.concat_ws("|", F.lit(str(seed)), "path", i.cast("string")))
    every = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    if cap is None and not balance:
        listed = counted.withColumn("idx", F.explode(every)).withColumn("key", key(F.col("idx")))
    else:
        limit = subject_counts(recordings, length, stride).agg(F.min("n_windows").alias("limit"))
        limited = counted.withColumn("limit", F.lit(cap).cast("long")) if cap is not None else counted.join(F.broadcast(limit))
        listed = first_keys(limited, F.transform(every, lambda i: F.struct(key(i).alias("key"), i.alias("idx"))))
    start = F.col("idx") * F.lit(float(stride))
    placed = listed.withColumn("position", (F.row_number().over(Window.partitionBy("subject").orderBy("key", "path", "idx")) - 1).cast("long"))
    if "limit" in listed.columns:
        placed = placed.filter(F.col("position") < F.col("limit"))
    return placed.select(*recordings.columns, "idx", start.alias("start"), (start + F.lit(float(length))).alias("end"), "position")


def first_keys(counted: DataFrame, keyed) -> DataFrame:
    """A row (key, idx) for each window that can be among the first ``limit`` of its subject, by md5 keys ``keyed`` (key, idx).

    Keys are spread evenly, so that the first ``limit`` of a subject's windows lie below a bound that its count gives. Windows
    above it are left out before they become rows, in the order of recordings dealt by subject. Where a subject has too few
    windows below its bound, all are listed: the bound decides the work, never the result.
    """
    of = Window.partitionBy("subject")
    ample = F.col("limit") + 2.5 * F.sqrt("limit") + 4
    bound = F.when(ample >= F.col("total"), "g").otherwise(F.lpad(F.lower(F.hex((ample / F.col("total") * F.lit(float(1 << 32))).cast("long"))), 8, "0"))
    below = counted.withColumn("total", F.sum("n").over(of)).withColumn("bound", bound)
    below = below.withColumn("below", F.filter(keyed, lambda w: w["key"] < F.col("bound")))
    enough = F.sum(F.size("below")).over(of) >= F.least("limit", "total")
    kept = below.withColumn("enough", enough).withColumn("w", F.explode(F.when(F.col("enough"), F.col("below")).otherwise(keyed)))
    return kept.select(*counted.columns, "w.key", "w.idx")


def splits(subjects: DataFrame, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """(subject, split): per label, subjects in seeded order cut at floors of the ratios; the rest goes to the last split.

    Subjects are ranked in 256 parts by the leading digits of their keys; what lies before a part is counted.
    """
    subjects = stored(subjects.select("subject", "epilepsy")).withColumn("key", F.md5(F.concat_ws("|", F.lit(str(seed)), "subject")))
    subjects = subjects.withColumn("part", F.substring("key", 1, 2))
    before = Window.partitionBy("label").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = subjects.groupBy(F.col("epilepsy").alias("label"), F.col("part").alias("of_part")).agg(F.count("*").alias("k"))
    parts = counts.select("label", "of_part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"), F.sum("k").over(Window.partitionBy("label")).alias("of"))
    order = Window.partitionBy("epilepsy", "part").orderBy("key", "subject")
    ranked = subjects.withColumn("place", F.row_number().over(order)).join(F.broadcast(parts), F.col("epilepsy").eqNullSafe(F.col("label")) & (F.col("part") == F.col("of_part")))
    return cut(ranked.select("subject", (F.col("before") + F.col("place")).alias("rank"), "of"), ratios)


def cut(placed: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """(subject, split) of subjects with their ``rank`` among ``of``: floors of the ratios in their order.

    The rest goes to the last split where the ratios add up to 1, else to none.
    """
    names, edge = list(ratios), F.lit(0)
    conditions = []
    for name in names:
        edge = edge + F.floor(F.lit(float(ratios[name])) * F.col("of"))
        conditions.append((F.col("rank") <= edge, name))
    out = F.lit(names[-1]) if abs(sum(ratios.values()) - 1) < 1e-6 else F.lit(None).cast("string")
    for condition, name in reversed(conditions):
        out = F.when(condition, name).otherwise(out)
    return placed.select("subject", out.alias("split"))


def overlapping(windows: DataFrame, spans: DataFrame, how: str = "left_anti") -> DataFrame:
    """Windows without (or, by ``left_semi``, with) a span of their recording; touching ends do not overlap."""
    s = spans.select(F.col("path").alias("of"), F.col("start").alias("span_start"), F.col("stop").alias("span_stop"))
    return windows.join(s, (F.col("path") == F.col("of")) & (F.col("span_start") < F.col("end")) & (F.col("span_stop") > F.col("start")), how)


def with_spans(recordings: DataFrame, spans: DataFrame) -> DataFrame:
    """Recordings that have a span; others need not list windows where only windows with a span are asked for."""
    return recordings.join(spans.select("path").distinct(), "path").select(*recordings.columns)


def pool_counts(recordings: DataFrame) -> DataFrame:
    """Subjects, sessions and recordings per class and in total (null class)."""
    rows = recordings.withColumn("which", F.explode(F.array(F.col("epilepsy").cast("string"), F.lit("all"))))
    return rows.groupBy("which").agg(F.countDistinct("subject").alias("subjects"), F.countDistinct("subject", "year").alias("sessions"), F.count("*").alias("recordings"))


def encode_labels(rows: DataFrame) -> DataFrame:
    """``gender_code`` (M 0, F 1, else 2, null -1) and ``epilepsy_code`` (null -1)."""
    gender = F.when(F.col("gender").isNull(), -1).when(F.col("gender") == "M", 0).when(F.col("gender") == "F", 1).otherwise(2)
    return rows.withColumns({"gender_code": gender, "epilepsy_code": F.when(F.col("epilepsy").isNull(), -1).when(F.col("epilepsy"), 1).otherwise(0)})


def targets(windows: DataFrame, by: str = "epilepsy") -> DataFrame:
    """``target``: the place of the label among the sorted labels of all windows, null last."""
    names = windows.select(by).distinct()
    numbered = names.select(F.col(by).alias("of"), (F.row_number().over(Window.orderBy(F.col(by).asc_nulls_last())) - 1).cast("int").alias("target"))
    return windows.join(F.broadcast(numbered), F.col(by).eqNullSafe(F.col("of"))).drop("of")


def without_bad(windows: DataFrame, spans: DataFrame, too_many: DataFrame | None = None, drop_segments: bool = False, drop_seizures: bool = False) -> DataFrame:
    """Windows of a finished plan without those that touch a bad or seizure span or belong to a recording beyond repair.

    ``too_many`` (path) is given where channels are interpolated. Counts are not refilled; without flags nothing is dropped.
    """
    kinds = [k for k, on in (("bad", drop_segments), ("seiz", drop_seizures)) if on]
    if kinds:
        windows = overlapping(windows, spans.filter(F.col("kind").isin(*kinds)))
    if too_many is not None:
        windows = windows.join(too_many.select(F.col("path").alias("gone")), F.col("path") == F.col("gone"), "left_anti")
    return windows


def replay(recordings: DataFrame, manifests: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """A plan from written manifests (path, start, end, split): one table of all splits, joined to the recordings.

    Paths are compared normalised. Manifest rows whose path is gone are matched by the path below the corpus folder, which is
    the key of the one join; of the recordings found there the row's own path has precedence. Shorter paths match as they stand.
    """
    kept = without_excluded(recordings, excluded) if excluded is not None else recordings
    rows = manifests.select(normalised("path").alias("wanted"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "split")
    return matched(rows, kept.withColumn("whole", normalised("path")), "wanted", "whole", r"([^/]+/[^/]+/[^/]+)$").drop("wanted", "whole")


def matched(rows: DataFrame, others: DataFrame, wanted: str, whole: str, tail: str) -> DataFrame:
    """``rows`` joined to ``others`` by the part of their paths that ``tail`` matches (group 1), or by the path where nothing does.

    Equal paths have equal tails, so that one join finds both: where a wanted path exists as it stands, other matches are left out.
    """
    key = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, tail, 1), F.lit("")), F.col(c))
    met = rows.withColumn("__tail", key(wanted)).join(others.withColumn("__tail", key(whole)), "__tail")
    own = F.col(wanted) == F.col(whole)
    found = met.withColumn("__own", F.max(own).over(Window.partitionBy("__tail", wanted))).filter(own | ~F.col("__own"))
    return found.drop("__tail", "__own")


def data_module(
    recordings: DataFrame, spans: DataFrame, length: float, stride: float, ratios: dict[str, float], cap: int | None = None, seed: int = 42, labels: DataFrame | None = None, keep: tuple[str, ...] = (), excluded: DataFrame | None = None,
    only_seizure_free: bool = False, rate: float | None = None, too_many: DataFrame | None = None, drop_segments: bool = False, drop_seizures: bool = False,
) -> DataFrame:
    """The whole plan (one row a window: split, target, start, end): filters, windows, subject split, targets and drops."""
    rows = seizure_free(recordings) if only_seizure_free else recordings
    rows = without_excluded(rows, excluded) if excluded is not None else rows
    rows = with_label(rows, labels, list(keep)) if labels is not None and keep else rows
    rows = rows.filter(near(F.col("sfreq"), rate)) if rate else rows
    subjects = rows.groupBy("subject").agg(F.bool_or("epilepsy").alias("epilepsy"))
    plan = windows(rows, length, stride, cap, seed=seed).join(splits(subjects, ratios, seed), "subject").filter(F.col("split").isNotNull())
    return without_bad(targets(stored(plan)), spans, too_many, drop_segments, drop_seizures)


def permuted_files(recordings: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """Samples mode: at most ``limit`` recordings in seeded order are kept before any window is planned."""
    return recordings.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "path")), "path").limit(limit)


def dictionary_windows(recordings: DataFrame, length: float, per_subject: int = 10, seed: int = 42) -> DataFrame:
    """The dictionary-learning view: windows of half the length that start at any sample, at most ``per_subject`` of a subject.

    Starting points are drawn by hash, so that the plan is never listed sample by sample.
    """
    half = length / 2
    n = window_count_samples(F.col("duration"), F.col("sfreq"), half, 1)
    tried = recordings.withColumn("n", n).filter("n > 0").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_subject - 1))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "path", F.col("draw").cast("string")))
    placed = tried.withColumn("sample", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.col("n")).dropDuplicates(["path", "sample"])
    first = F.row_number().over(Window.partitionBy("subject").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "path", F.col("sample").cast("string"))), "path", "sample"))
    start = F.col("sample") / F.col("sfreq")
    return placed.withColumn("position", first).filter(F.col("position") <= per_subject).select("subject", "path", "sample", start.alias("start"), (start + F.lit(half)).alias("end"))
