"""Window plans and subject splits in the order of one seeded generator, replayed from window counts alone.

The analysed pipeline draws every order from one Mersenne Twister: a shuffle of each subject's windows, subjects in sorted
order, then a shuffle of the subjects of each label, labels in the order in which they come up. How much of the stream a
shuffle takes depends on the length of what is shuffled only, so (subject, n_windows, label) suffices to replay it. The stream
is sequential by nature: one task reads those three values of each subject and writes places; it holds the windows of a batch
of subjects and the subjects' names. Plans without need of that order use ``cohort.windows`` and ``cohort.splits``, which hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecohort.operators import cohort
from tidecohort.operators.tables import stored

#: Windows that are placed at once, but for those of one subject, and names that are written at once.
PIECE = 1 << 16
#: Ordinals of a subject that share a row in the join of places to recordings.
CHUNK = 64
PLACES = "kind string, subject string, ordinal long, place long, size long"


def pieces(batch: pa.RecordBatch):
    """(subjects, counts, labels) of runs of rows with about ``PIECE`` windows."""
    counts = np.asarray(batch.column(1))
    part = (np.cumsum(counts) - counts) // PIECE
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=part[-1] + 1 if len(part) else 0)) if len(part) else np.zeros(0, int)
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        rows = batch.slice(low, high - low)
        yield rows.column(0), counts[low:high], rows.column(2)


def places(subjects: DataFrame, seed: int = 42, cap: int | None = None) -> DataFrame:
    """The replayed stream over (subject, n_windows, label).

    Rows of kind ``window`` say which of a subject's windows (``ordinal``) has which place from 0, up to ``cap`` places; rows of
    kind ``split`` give a subject its place from 1 among the ``size`` subjects of its label.
    """

    def rows(kind, subject, ordinal, place, size):
        return pa.RecordBatch.from_arrays([pa.array([kind]).take(pa.array(np.zeros(len(ordinal), np.int64))), subject, pa.array(ordinal), pa.array(place), pa.array(size)], names=["kind", "subject", "ordinal", "place", "size"])

    def run(batches):
        rng, by_label = np.random.RandomState(seed), {}
        for whole in batches:
            for subject, counts, labels in pieces(whole):
                orders = []
                for n in counts.tolist():
                    order = np.arange(n)
                    rng.shuffle(order)
                    orders.append(order[:cap].copy())
                kept = np.array([len(o) for o in orders])
                owner = np.repeat(np.arange(len(kept)), kept)
                yield rows("window", subject.take(pa.array(owner)), np.concatenate(orders), np.arange(len(owner)) - (np.cumsum(kept) - kept)[owner], counts[owner])
                coded = labels.dictionary_encode(null_encoding="encode")
                of = np.asarray(coded.indices)
                for k, label in enumerate(coded.dictionary.to_pylist()):
                    by_label.setdefault(label, []).append(subject.take(pa.array(np.flatnonzero(of == k))))
        for names in by_label.values():
            names = pa.chunked_array(names)
            order = np.arange(len(names))
            rng.shuffle(order)
            for at in range(0, len(order), PIECE):
                part = order[at : at + PIECE]
                yield rows("split", names.take(pa.array(part)).combine_chunks(), part, np.arange(at, at + len(part)) + 1, np.full(len(part), len(order)))

    small = subjects.select("subject", F.col("n_windows").cast("long"), F.col("label").cast("string")).filter("n_windows > 0")
    return stored(small.repartition(1).sortWithinPartitions("subject").mapInArrow(run, PLACES))


def plan(recordings: DataFrame, length: float, stride: float, ratios: dict[str, float], cap: int | None = None, balance: bool = False, seed: int = 42, stratified: bool = True) -> DataFrame:
    """``cohort.windows`` with a ``split``, in the generator's order; subjects that no split gets are left out.

    Only windows that have a place become rows: places are dealt in chunks of ordinals, and recordings to the chunks they span.
    A subject's label is that of its first recording by path. Without ``stratified`` all subjects are one group.
    """
    cohort.check_plan(1 - stride / length if stride < length else 0, cap)
    counted = recordings.withColumn("n", cohort.window_count(F.col("duration"), length, stride)).filter("n > 0")
    label = F.min_by("epilepsy", "path") if stratified else F.lit("all")
    subjects = stored(counted.groupBy("subject").agg(F.sum("n").alias("n_windows"), label.alias("label")))
    if cap is None and balance:
        cap = subjects.agg(F.min("n_windows")).first()[0]
    replay = places(subjects, seed, cap)
    before = Window.partitionBy("subject").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    ranked = replay.filter("kind = 'split'").select("subject", F.col("place").alias("rank"), F.col("size").alias("of"))
    chunk = lambda c: F.expr(f"({c}) div {CHUNK}")
    dealt = counted.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).join(cohort.cut(ranked, ratios).filter("split IS NOT NULL"), "subject")
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(chunk("first"), chunk("first + n - 1"))))
    taken = replay.filter("kind = 'window'").groupBy("subject", chunk("ordinal").alias("chunk")).agg(F.collect_list(F.struct("ordinal", "place")).alias("taken"))
    own = F.filter("taken", lambda w: (w["ordinal"] >= F.col("first")) & (w["ordinal"] < F.col("first") + F.col("n")))
    placed = dealt.join(taken, ["subject", "chunk"]).withColumn("w", F.explode(own)).withColumn("idx", F.col("w.ordinal") - F.col("first"))
    start = F.col("idx") * F.lit(float(stride))
    others = [c for c in recordings.columns if c != "subject"]
    return placed.select("subject", *others, "idx", start.alias("start"), (start + F.lit(float(length))).alias("end"), F.col("w.place").alias("position"), "split")
