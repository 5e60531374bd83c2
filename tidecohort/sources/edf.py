"""Recordings in the European Data Format as a Spark data source.

``spark.read.format("edf")`` gives one row per channel and stretch of records; files are read through Arrow's file systems, so
a path may lie in any store these know. The driver only lists files with their sizes; headers are read where the samples are.
A partition holds even shares of files' records, ``partition_bytes`` together at most. Filters on ``path`` and ``channel`` (equal,
in a list, prefix of a path) are pushed down: files and channels that are not asked for appear in no partition and no batch.
``header_only`` reads the headers alone: 256 bytes and 256 for each channel.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from tidecohort.functions import scalars

HEADERS = "path string, patient string, recording string, started string, n_records long, record_s double, channel string, dimension string, sfreq double"
SAMPLES = "path string, channel string, sfreq double, start_s double, x array<double>"
# Names and widths of the header's fields, for the file and for every signal.
FILE_FIELDS = [("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("header_bytes", 8), ("reserved", 44), ("n_records", 8), ("record_s", 8), ("n_signals", 4)]
SIGNAL_FIELDS = [("label", 16), ("transducer", 80), ("dimension", 8), ("phys_min", 8), ("phys_max", 8), ("dig_min", 8), ("dig_max", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32)]


def open_file(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if re.match(r"^[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def save_file(path: str, data: bytes) -> None:
    """Write a file where Arrow's file systems find it; folders are made, a file that is there is replaced."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if re.match(r"^[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(data)


def _fields(raw: bytes, layout: list[tuple[str, int]], n: int = 1) -> dict:
    out, at = {}, 0
    for name, width in layout:
        out[name] = [raw[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)]
        at += n * width
    return out


def read_header(file) -> tuple[dict, dict]:
    """Fields of the file and of its signals."""
    head = {k: v[0] for k, v in _fields(file.read(256), FILE_FIELDS).items()}
    n = int(head["n_signals"])
    return head, _fields(file.read(256 * n), SIGNAL_FIELDS, n)


class Recording:
    """An open file: its header, and physical values of ranges of its records."""

    def __init__(self, file):
        self.file = file
        self.head, signals = read_header(file)
        self.names, self.dimensions = signals["label"], signals["dimension"]
        self.counts = np.array([int(n) for n in signals["samples"]], int)
        self.record_s = float(self.head["record_s"]) or 1.0
        self.n_records, self.start = int(self.head["n_records"]), int(self.head["header_bytes"])
        low, high, dig_low, dig_high = (np.array([float(v) for v in signals[k]]) for k in ("phys_min", "phys_max", "dig_min", "dig_max"))
        span = dig_high - dig_low
        self.scale = np.where(span != 0, (high - low) / np.where(span != 0, span, 1), 1.0)
        self.low, self.dig_low = low, dig_low
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])

    def rate(self, i: int) -> float:
        return self.counts[i] / self.record_s

    def raw(self, first: int, last: int) -> np.ndarray:
        """Digital samples (records, all signals) of the records [first, last), in one read."""
        size = 2 * int(self.offsets[-1])
        self.file.seek(self.start + first * size)
        return np.frombuffer(self.file.read((last - first) * size), "<i2").reshape(-1, int(self.offsets[-1]))

    def physical(self, raw: np.ndarray, i: int) -> np.ndarray:
        own = raw[:, self.offsets[i] : self.offsets[i + 1]].astype(float).ravel()
        return (own - self.dig_low[i]) * self.scale[i] + self.low[i]


#: What opening a file counts as when small files are packed into partitions, and how many partitions are wanted at least.
OPEN_COST, LEAST_PARTITIONS = 4 << 20, 32


@dataclass
class Shares(InputPartition):
    """Shares (path, k, n) of files, each part ``k`` of ``n`` of a file's records, and the channels asked for (None: all)."""

    shares: tuple[tuple[str, int, int], ...]
    channels: tuple[str, ...] | None


def packed(files: list[tuple[str, int]], most_bytes: int, header_only: bool = False) -> list[tuple[tuple[str, int, int], ...]]:
    """Files cut into shares of at most ``most_bytes``, small ones packed together as long as there are enough partitions."""
    cost = lambda size: (0 if header_only else size) + OPEN_COST
    target = min(most_bytes, max(OPEN_COST, sum(cost(size) for _, size in files) // LEAST_PARTITIONS))
    out, held, room = [], [], target
    for path, size in files:
        n = 1 if header_only else max(1, -(-size // most_bytes))
        for k in range(n):
            if held and cost(size // n) > room:
                out.append(tuple(held))
                held, room = [], target
            held.append((path, k, n))
            room -= cost(size // n)
    return [*out, tuple(held)] if held else out


class EdfReader(DataSourceReader):
    def __init__(self, options):
        self.header_only = str(options.get("header_only", "false")).lower() == "true"
        self.bytes = int(options.get("partition_bytes", 64 << 20))
        listed = [c for c in options.get("channels", "").split(",") if c]
        self.channels: set[str] | None = set(listed) if listed else None
        self.files = sorted(_listed(options.get("path", "")))
        self.kept: list[Callable[[str], bool]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Takes filters on path and channel; gives back what Spark must still check."""
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute in (("path",), ("channel",)):
                continue
            if isinstance(f, EqualTo | In) and f.attribute in (("path",), ("channel",)):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                if f.attribute == ("channel",):
                    self.channels = wanted if self.channels is None else self.channels & wanted
                else:
                    self.kept.append(wanted.__contains__)
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.kept.append(lambda path, prefix=f.value: path.startswith(prefix))
            else:
                yield f

    def partitions(self):
        channels = None if self.channels is None else tuple(sorted(self.channels))
        files = [(path, size) for path, size in self.files if all(keep(path) for keep in self.kept)] if channels != () else []
        return [Shares(shares, channels) for shares in packed(files, self.bytes, self.header_only)] or [Shares((), channels)]

    def read(self, partition):
        wanted = None if partition.channels is None else set(partition.channels)
        for path, k, n in partition.shares:
            with open_file(path) as file:
                recording = Recording(file)
                chosen = [i for i, name in enumerate(recording.names) if wanted is None or name in wanted]
                if self.header_only:
                    yield self._headers(path, recording, chosen)
                    continue
                first, last = (recording.n_records * part // n for part in (k, k + 1))
                chosen = [i for i in chosen if recording.names[i] != "EDF Annotations"] if last > first else []
                raw = recording.raw(first, last) if chosen else None
                for i in chosen:
                    x = recording.physical(raw, i)
                    columns = [pa.array([path]), pa.array([recording.names[i]]), pa.array([recording.rate(i)]), pa.array([first * recording.record_s]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "channel", "sfreq", "start_s", "x"])

    @staticmethod
    def _headers(path: str, recording: Recording, chosen: list[int]) -> pa.RecordBatch:
        head, n = recording.head, len(chosen)
        rows = {
            "path": [path] * n, "patient": [head["patient"]] * n, "recording": [head["recording"]] * n, "started": [f"{head['date']} {head['time']}"] * n, "n_records": [recording.n_records] * n,
            "record_s": [recording.record_s] * n, "channel": [recording.names[i] for i in chosen], "dimension": [recording.dimensions[i] for i in chosen], "sfreq": [recording.rate(i) for i in chosen],
        }
        kinds = [*[pa.string()] * 4, pa.int64(), pa.float64(), pa.string(), pa.string(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def _listed(path: str) -> list[tuple[str, int]]:
    """The files at a path with their sizes: itself, or all ``.edf`` files below a folder, hidden ones left out."""
    from pyarrow import fs

    scheme = re.match(r"^([a-z0-9]+:/{1,2})", path)
    system, inner = fs.FileSystem.from_uri(path) if scheme else (fs.LocalFileSystem(), path)
    if path.endswith(".edf"):
        return [(path, system.get_file_info(inner).size or 0)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return [((scheme[1] if scheme else "") + f.path, f.size or 0) for f in found if f.is_file and f.path.endswith(".edf") and "/." not in f.path]


class EdfDataSource(DataSource):
    @classmethod
    def name(cls):
        return "edf"

    def schema(self):
        return HEADERS if str(self.options.get("header_only", "false")).lower() == "true" else SAMPLES

    def reader(self, schema):
        return EdfReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known, and let Spark push filters into Python data sources."""
    spark.dataSource.register(EdfDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_edf(spark: SparkSession, root: str, channels: list[str] | None = None) -> DataFrame:
    """(path, channel, sfreq, start_s, x) of all recordings below a folder."""
    register(spark)
    return spark.read.format("edf").option("channels", ",".join(channels or [])).load(root)


def read_headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, age, gender, sfreq, duration, channels) of every recording, from its header alone."""
    register(spark)
    rows = spark.read.format("edf").option("header_only", "true").load(root).filter("channel <> 'EDF Annotations'")
    patient = F.concat(F.lit(" "), F.col("patient"), F.lit(" "))
    return rows.groupBy("path").agg(F.first(scalars.header_age(patient)).alias("age"), F.first(scalars.header_gender(patient)).alias("gender"), F.max("sfreq").alias("sfreq"), F.max(F.col("n_records") * F.col("record_s")).alias("duration"), F.array_sort(F.collect_list("channel")).alias("channels"))


def edf_bytes(channels: dict[str, np.ndarray], fs: int, patient: str = "X X X X", record_s: int = 1, limit: float = 3276.8) -> bytes:
    """A small recording, for tests and exports: physical values within ``limit`` are kept to its 65,536th part."""
    n = len(next(iter(channels.values()))) // (fs * record_s)
    pad = lambda values, width: b"".join(str(v)[:width].ljust(width).encode("latin-1") for v in values)
    k = len(channels)
    head = pad(["0"], 8) + pad([patient], 80) + pad(["Startdate 01-JAN-2010"], 80) + pad(["01.01.10"], 8) + pad(["00.00.00"], 8) + pad([256 * (k + 1)], 8) + pad([""], 44) + pad([n], 8) + pad([record_s], 8) + pad([k], 4)
    head += pad(channels, 16) + pad([""] * k, 80) + pad(["uV"] * k, 8) + pad([-limit] * k, 8) + pad([limit] * k, 8) + pad([-32768] * k, 8) + pad([32767] * k, 8) + pad([""] * k, 80) + pad([fs * record_s] * k, 8) + pad([""] * k, 32)
    digital = {c: np.clip(np.rint((np.asarray(v, float) + limit) / (2 * limit) * 65535 - 32768), -32768, 32767).astype("<i2") for c, v in channels.items()}
    step = fs * record_s
    return head + b"".join(struct.pack(f"<{step}h", *v[r * step : (r + 1) * step]) for r in range(n) for v in digital.values())
