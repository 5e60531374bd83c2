"""Importance resampling towards a target distribution, by a dictionary of distinct features.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; features are all runs of 1 to ``max_n`` consecutive
words, joined by one space, repeats counted. A feature's bucket is the crc32 of its UTF-8 bytes modulo ``buckets``. With s of S
features of all documents and t of T features of the target in a bucket, its gain is
floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))). A document's weight is the sum of its features' gains;
Gumbel noise from its id makes drawing the highest scores a weighted sample without replacement.

1. One scan cuts the corpus into slices of about 8 MB of text. A slice lists its distinct features once, with totals, and holds
   its documents as counts of positions in that list, packed. Nothing else is read from the texts.
2. The lists of all slices and of the target are summed into one dictionary of distinct strings; each is hashed once, and
   buckets are sums over it. Gains are one row a bucket, which bounds their broadcast.
3. Dictionary and slices meet by feature: a feature has at most one row a slice, however common it is, so no key is hot. The
   gains go back to their slices, where one array lookup gives the weight of every document.
4. Ranks come from range partitions of (score, doc_id), sorted, with the number of rows before each partition.

Defined results: null text has no feature; an empty target has T = 0; an id is read as text, null as empty text; repeated rows
are separate documents, equal in score, with ranks of their own; null ids come last among equal scores; an empty table gives an
empty result. Extra columns of any name are ignored by ``report`` and pass through ``resample``.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecohort.llm.common import materialize, shielded
from tidecohort.llm.vectext import slices

#: Bytes of words once A-Z are lower-cased: digits, a-z, and all bytes of characters beyond ASCII.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
SLICE_BYTES = 8 << 20
SLICE = "slice long, features array<string>, totals array<long>, ids array<string>, n_words array<int>, n_features array<int>, distinct array<int>, codes binary, counts binary"


def packed(values: np.ndarray) -> bytes:
    """Small integers byte plane by byte plane, compressed: the upper planes are nearly all zeros."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def features(text: str, max_n: int) -> tuple[int, list[bytes]]:
    """The number of words, and all runs of up to ``max_n`` of them."""
    words = WORDS.findall(text.encode().lower())
    found = list(words)
    for n in range(2, max_n + 1):
        found += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), found


def sliced(rows: DataFrame, max_n: int) -> DataFrame:
    """One row a slice of (key, text): its distinct features with totals, and its documents as counts of places in that list."""

    def one(piece, number):
        codes: dict[bytes, int] = {}
        places, counts, n_words, n_features, distinct = [], [], [], [], []
        for text in piece.column("text"):
            n, found = features(text.as_py() or "", max_n)
            own = Counter(found)
            places.extend(codes.setdefault(f, len(codes)) for f in own)
            counts.extend(own.values())
            n_words.append(n)
            n_features.append(len(found))
            distinct.append(len(own))
        places, counts = np.array(places, np.int64), np.array(counts, np.int64)
        totals = np.bincount(places, counts, len(codes)).astype(np.int64)
        # Common features get small numbers, which pack well.
        by_total = np.argsort(-totals, kind="stable")
        rank = np.empty_like(by_total)
        rank[by_total] = np.arange(len(by_total))
        names = pa.array(list(codes), pa.binary()).cast(pa.string()).take(pa.array(by_total))
        column = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        lists = [names, totals[by_total], piece.column("key"), n_words, n_features, distinct]
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int32()] * 3]
        binary = [pa.array([packed(v)], pa.binary()) for v in (rank[places], counts)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[column(v, k) for v, k in zip(lists, kinds, strict=True)], *binary], names=[c.split()[0] for c in SLICE.split(", ")])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                yield one(piece, number)
                number += 1

    return rows.select(F.col("key").cast("string").alias("key"), "text").mapInArrow(run, SLICE)


def totals(found: DataFrame, name: str) -> DataFrame:
    """(feature, name): the features of all slices with the number of their occurrences."""
    return found.select(F.explode(F.arrays_zip("features", "totals")).alias("f")).select("f.features", F.col("f.totals").alias(name)).withColumnRenamed("features", "feature")


def gains_by_feature(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(feature, gain) for every distinct feature of the corpus; both inputs are slices."""
    none = F.lit(0).cast("long")
    both = totals(corpus, "s").withColumn("t", none).unionByName(totals(target, "t").withColumn("s", none))
    dictionary = materialize(both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).withColumn("bucket", F.crc32(F.encode("feature", "UTF-8")) % buckets))
    sums = dictionary.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    everything = sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    real = lambda c, plus: F.col(c).cast("double") + F.lit(float(plus))
    ratio = real("t", 1) * real("all_s", buckets) / (real("s", 1) * real("all_t", buckets))
    # At most one row a bucket.
    gains = F.broadcast(sums.join(F.broadcast(everything)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")))
    return dictionary.filter("s > 0").join(gains, "bucket").select("feature", "gain")


def weights(rows: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(key, n_words, n_features, weight) for each row of (key, text); ``target`` has a column text."""
    corpus = materialize(sliced(rows, max_n))
    gained = gains_by_feature(corpus, sliced(target.select(F.lit("").alias("key"), "text"), max_n), buckets)
    wanted = corpus.select("slice", F.posexplode("features").alias("code", "feature"))
    back = wanted.join(gained, "feature").groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("code", "gain"))).alias("found"))
    held = corpus.select("slice", "ids", "n_words", "n_features", "distinct", "codes", "counts")
    met = held.join(back.select(F.col("slice"), F.col("found.gain").alias("gains")), "slice", "left")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda c: batch.column(c)[i].values  # noqa: E731, B023
                ids, distinct = of("ids"), np.asarray(of("distinct"))
                gains = np.asarray(of("gains")) if batch.column("gains")[i].is_valid else np.zeros(0, np.int64)
                codes, counts = (unpacked(batch.column(c)[i].as_py(), int(distinct.sum())) for c in ("codes", "counts"))
                sums = np.concatenate([[0], np.cumsum(gains[codes] * counts)]).astype(np.int64)
                ends = np.cumsum(distinct)
                weight = sums[ends] - sums[ends - distinct]
                yield pa.RecordBatch.from_arrays([ids, pc.cast(of("n_words"), pa.int64()), pc.cast(of("n_features"), pa.int64()), pa.array(weight)], names=["key", "n_words", "n_features", "weight"])

    return met.mapInArrow(run, "key string, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) with u from the first 8 hexadecimal digits of the sha256 of ``seed:key``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their place from 1 in a total order: sorted range partitions and the number of rows before each."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = materialize(dealt)
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    # One row a range partition.
    met = dealt.withColumn("__part", part).join(F.broadcast(before), "__part")
    return met.select(*rows.columns, (F.col("__before") + inside + 1).alias("place"))


def report(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): rank is null where a document is not drawn."""
    found = weights(docs.select(F.col("doc_id").alias("key"), "text"), target, max_n, buckets)
    kind = dict(docs.dtypes)["doc_id"]
    scored = materialize(found.select(F.col("key").cast(kind).alias("doc_id"), "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("key"), seed)).alias("score")))
    able = F.col("n_words") >= min_words
    ranked = placed(scored.filter(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    drawn = scored.filter(able).agg(F.floor(F.count("*") * F.lit(percent) / 100).alias("__drawn"))
    columns = ["doc_id", "n_features", "weight", "score"]
    judged = ranked.join(F.broadcast(drawn)).select(*columns, F.when(F.col("place") <= F.col("__drawn"), F.col("place")).alias("rank"))
    return judged.unionByName(scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with their ``sample_rank``; ids that repeat are drawn by their best place."""
    drawn = report(docs, target, **options).filter(F.col("rank").isNotNull()).groupBy("doc_id").agg(F.min("rank").alias("__rank"))
    inner = shielded(docs, "doc_id")
    met = inner.join(drawn.withColumnRenamed("doc_id", "__drawn_id"), F.col("doc_id").eqNullSafe(F.col("__drawn_id")))
    return met.select(*inner.columns, "__rank").toDF(*docs.columns, "sample_rank")
