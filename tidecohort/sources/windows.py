"""Windows of a plan straight from recordings: every byte of a file is read once, and each window leaves processed.

A plan has a row a window (path, start, end in seconds, any key columns; ``bad``, ``too_many`` and ``period_s`` where known). Windows of one
recording are dealt to one task, which opens the file once and moves through it with a buffer from the first sample that a
later window needs to the last one the present window needs. Overlapping windows and the margins that filters want at either
side come from that buffer. A task holds one window with its margins, never a recording.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidecohort.operators.chain import Chain
from tidecohort.operators.tables import stored
from tidecohort.sources.edf import Recording, edf_bytes, open_file, save_file


def stretches(recording: Recording, windows: list[tuple[float, float]], margin_s: float, channels: set[str] | None = None):
    """(names, rate, samples, left, right) of windows (start, end) in order of their start; left and right are the margins got.

    Channels are those with the recording's most common rate; ends beyond the recording are cut off. Records are read in order,
    each once: the buffer drops what lies before the present window's margin, as no later window starts earlier.
    """
    rates, amounts = np.unique(recording.counts[[n != "EDF Annotations" for n in recording.names]], return_counts=True)
    chosen = [i for i, n in enumerate(recording.names) if len(rates) and recording.counts[i] == rates[amounts.argmax()] and n != "EDF Annotations" and (channels is None or n in channels)]
    names, record_s = [recording.names[i] for i in chosen], recording.record_s
    fs = recording.rate(chosen[0]) if chosen else 0.0
    per = int(recording.counts[chosen[0]]) if chosen else 0
    total = recording.n_records * per
    held, first, last = np.zeros((len(chosen), 0)), 0, 0
    for start, end in windows:
        low, high = (min(max(int(round(t * fs)), 0), total) for t in (start, end))
        margin = int(round(margin_s * fs))
        begin, stop = max(low - margin, 0), min(high + margin, total)
        if chosen and stop > begin:
            want_first, want_last = begin // per, -(-stop // per)
            if want_first >= last:
                held, first, last = held[:, :0], want_first, want_first
            elif want_first > first:
                held, first = held[:, (want_first - first) * per :], want_first
            if want_last > last:
                raw = recording.raw(last, want_last)
                held, last = np.concatenate([held, np.stack([recording.physical(raw, i) for i in chosen])], axis=1), want_last
        x = held[:, begin - first * per : stop - first * per] if stop > begin else held[:, :0]
        yield names, fs, x, (low - begin) / fs if fs else 0.0, (stop - high) / fs if fs else 0.0


def processed(plan: DataFrame, chain: Chain, keys: list[str], margin_s: float = 0.0, channels: list[str] | None = None, seconds_per_task: float = 3600.0) -> DataFrame:
    """(keys, names, x, ok) of the windows of a plan; a window that fails is zeros or null, as the chain says.

    The plan is small beside the samples, so the number of tasks follows from the planned seconds, not from its bytes; a
    recording is the least that a task gets. The rate is that of each file.
    """
    spark = plan.sparkSession
    for name, default in (("bad", F.array().cast("array<string>")), ("too_many", F.lit(False)), ("period_s", F.lit(None).cast("double"))):
        plan = plan if name in plan.columns else plan.withColumn(name, default)
    columns = list(dict.fromkeys(["start", "end", *keys, "bad", "too_many", "period_s"]))
    plan = stored(plan.select("path", *[c for c in columns if c != "path"]))
    size = plan.agg(F.sum(F.col("end") - F.col("start")).alias("s"), F.approx_count_distinct("path").alias("n")).first()
    tasks = max(1, min(size["n"], max(spark.sparkContext.defaultParallelism, int((size["s"] or 0) / seconds_per_task) + 1)))
    grouped = plan.repartition(tasks, "path").groupBy("path").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in columns]))).alias("windows"))
    types = {f.name: f.dataType for f in plan.schema}
    schema = ", ".join([*[f"`{k}` {types[k].simpleString()}" for k in keys], "names array<string>", "x array<array<double>>", "ok boolean"])
    kinds = [*[to_arrow_type(types[k]) for k in keys], pa.list_(pa.string()), pa.list_(pa.list_(pa.float64())), pa.bool_()]
    wanted = set(channels) if channels else None

    def results(path, rows):
        done = 0
        try:
            with open_file(path) as file:
                found = stretches(Recording(file), [(r["start"], r["end"]) for r in rows], margin_s, wanted)
                for r, (names, fs, x, left, right) in zip(rows, found, strict=True):
                    yield r, chain.attempt(names, x, r["bad"], bool(r["too_many"]), fs=fs, margins=(left, right), period_s=r["period_s"])
                    done += 1
        except (OSError, ValueError):  # no such file, or cut off: what could not be read has failed
            for r in rows[done:]:
                yield r, chain.failed([], 0)

    def run(batches):
        for batch in batches:
            for path, rows in zip(batch.column("path").to_pylist(), batch.column("windows").to_pylist(), strict=True):
                for r, (names, x, ok) in results(path, rows):
                    values = [*[path if k == "path" else r[k] for k in keys], names, None if x is None else list(x), ok]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[*keys, "names", "x", "ok"])

    return grouped.mapInArrow(run, schema)


def write_recordings(rows: DataFrame, folder: str, fs: int, limit: float = 3276.8) -> DataFrame:
    """Writes (path, names, x) as EDF files below a folder, a task its rows; gives (path, n_bytes) of the files."""
    def run(batches):
        for batch in batches:
            paths, sizes = [], []
            for path, names, x in zip(*[batch.column(c).to_pylist() for c in ("path", "names", "x")], strict=True):
                data = edf_bytes(dict(zip(names, x, strict=True)), fs, limit=limit)
                save_file(f"{folder}/{path}", data)
                paths.append(f"{folder}/{path}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "n_bytes"])

    return stored(rows.select("path", "names", "x").mapInArrow(run, "path string, n_bytes long"))
