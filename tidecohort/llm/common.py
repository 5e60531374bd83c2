"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecohort.llm.vectext import slices

#: A word is a maximal run of characters other than ASCII blank, tab, LF, VT, FF and CR.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: Shuffle files of a write go when it ends; what it wrote does not need them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine (master ``local``) gets a temporary folder; on a cluster that is an
    error, as executors would write where neither the driver nor other executors can read.
    """
    context = spark.sparkContext
    if (path := spark.conf.get("spark.checkpoint.dir", None)) is None and (path := context.getCheckpointDir()) is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidecohort-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for this DataFrame; only for tables that no unfinished plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text) -> F.Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def add_struct(docs: DataFrame, name: str, fields: T.StructType, annotate: Callable[[pa.RecordBatch], pa.StructArray]) -> DataFrame:
    """``docs`` with a struct column computed from ``text`` in Arrow batches of bounded bytes; replaces a column of that name."""
    kept = [c for c in docs.columns if c != name]
    docs = docs.select(*kept)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*piece.columns, annotate(piece)], names=[*kept, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, fields)]))


def shielded(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with every column but the used ones renamed by place, so that no name clashes with a working column."""
    return docs.toDF(*[c if c in used else f"__{i}" for i, c in enumerate(docs.columns)])


def struct_array(fields: T.StructType, columns: list) -> pa.StructArray:
    """A struct array of the given Spark fields from one array per field."""
    types = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.BinaryType: pa.binary()}
    kind = lambda t: pa.list_(types[type(t.elementType)]) if isinstance(t, T.ArrayType) else types[type(t)]
    arrays = [pa.array(c, kind(f.dataType)) for f, c in zip(fields, columns, strict=True)]
    return pa.StructArray.from_arrays(arrays, names=fields.names)


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows: those with the smallest hash of ``key``, the same on every run."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(most)


def remainder(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 4; rows with remainder 2 are held out of training. Null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4
