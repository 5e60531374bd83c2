"""Suffix-array dedup: every byte covered by a 50-byte string that also starts in a document with a smaller doc_id goes.

Sorting the suffixes at all positions would move many times the corpus, so most positions are settled by hashes first and
only those that can still matter become suffixes:

1. *Runs.* Of every 50-byte string the leftmost smallest ``gram``-byte hash is its anchor. Neighbouring strings with the same
   anchor form a run (about 17 strings, whose bytes are one stretch of text). Equal strings have equal anchors at equal
   offsets, so only runs with the same anchor can share a string. Of equal runs in one piece of text only that of the
   smallest doc_id goes on (the bytes are compared); the others are covered. What is left goes to hash buckets as packed
   arrays. Equal runs are settled in the bucket: all but those of the smallest doc_id are covered. A string of another run is
   undecided when a run of another document shares the anchor and the bytes around it, as far as hashes at quarters of the
   margin tell.
   Anchors that a sample of the documents shows to be hot (more than an eighth of an even bucket, and ``LEAST_HITS`` of the
   sample) go to no bucket, as their group would grow with the corpus: all their strings are undecided at once. Every run of
   the sample counts, also where equal runs of a piece leave one. The sample grows with the corpus (``SAMPLE_SHARE``), so that
   the runs of an anchor that it misses have a limit of their own, about ``LEAST_HITS / SAMPLE_SHARE``, at any size. The
   sample decides only the way, not the result.
2. *Suffixes.* The strings of undecided runs, read back from the documents, are the suffixes to sort (by their leading 50
   bytes, all that matters here). Spark samples splitters and range-partitions them by leading bytes; doc_id and offset break
   ties, so a string that occurs in a third of all documents is spread over many buckets. Each bucket is sorted by multikey
   quicksort on eight-byte characters. In sorted order the first suffix of a run of equal ones has the smallest doc_id, and
   the others with larger ids are covered; the first run of a bucket is compared with the last ones of the buckets before it.
   There are at most ``MOST_RANGES`` buckets, or as many as the session has shuffle partitions; the driver sees the first
   and last string of each. What a bucket covers is packed by hash parts of the documents and gathered there, so that a
   document whose strings lie in many buckets has no row in each.
3. *Removal.* Covered stretches are joined to the documents and cut out.

Defined results: null text is empty; strings shorter than ``length`` never match; repeated rows with one doc_id do not cover
each other; rows with null doc_id keep everything and cover nothing; an empty table gives an empty result; extra columns
are ignored by ``report``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecohort.llm.common import materialize
from tidecohort.llm.vectext import Batch, lookup, mix, slices

U = np.uint64
BUCKET_BYTES = 4 << 20
#: Text for each range partition of suffixes; there are at most ``MOST_RANGES``, unless the session asks for more shuffle partitions.
RANGE_BYTES = 16 << 20
MOST_RANGES = 20_000
#: Least bytes and least share of the text that tell which anchors are hot, and hits that make one hot: a sample of n runs has
#: at most n / ``LEAST_HITS`` hot anchors.
SAMPLE_BYTES = 64 << 20
SAMPLE_SHARE = 1e-5
LEAST_HITS = 32
STRETCHES = "doc_id long, row long, undecided boolean, stretches binary"
SIDES = ("left_1", "left_2", "left_3", "right_1", "right_2", "right_3")
RECORD = np.dtype([("g", "u1", 5), *[(side, "u1", 2) for side in SIDES], ("whole", "u1", 4), ("doc", "<u2"), ("at", "<u4"), ("n", "u1"), ("lead", "u1")])


def runs(b: Batch, length: int, gram: int) -> dict[str, np.ndarray]:
    """Maximal runs of ``length``-byte strings with one anchor: hashes, document, offset, count and bytes before the anchor."""
    n, wide = len(b.data), length - gram + 1
    if n < length:
        return {}
    place = np.arange(n - gram + 1)
    hashes = b.hashes(place, place + gram)
    least, size = (hashes & U(0xFFFFFFFF00000000)) | place.astype(U), 1
    del hashes, place
    while size * 2 <= wide:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    anchor = (least & U(0xFFFFFFFF)).astype(np.uint32)
    del least
    mark, long = np.zeros(n + 1, np.int32), b.lengths >= length
    np.add.at(mark, b.offsets[:-1][long], 1)
    np.add.at(mark, (b.offsets[1:] - length + 1)[long], -1)
    inside = np.cumsum(mark, out=mark)[: len(anchor)] > 0
    del mark
    changed = anchor[1:] != anchor[:-1]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= changed | ~inside[:-1]
    ends[:-1] &= changed | ~inside[1:]
    low, high = np.flatnonzero(begins), np.flatnonzero(ends)
    p = anchor[low].astype(np.int64)
    doc = np.searchsorted(b.offsets, low, "right") - 1
    clip = lambda x: np.clip(x, b.offsets[doc], b.offsets[doc + 1])
    sides = {f"left_{i}": b.hashes(clip(p - e), p + gram) for i, e in enumerate(extents(length, gram), 1)}
    sides |= {f"right_{i}": b.hashes(p, clip(p + gram + e)) for i, e in enumerate(extents(length, gram), 1)}
    return {"g": b.hashes(p, p + gram), **sides, "whole": b.hashes(low, high + length), "doc": doc, "at": low - b.offsets[doc], "n": high - low + 1, "lead": p - low}


def extents(length: int, gram: int) -> tuple[int, int, int]:
    """Quarter, half and three quarters of the bytes of a string that its anchor leaves."""
    return (length - gram) // 4, (length - gram) // 2, 3 * (length - gram) // 4


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    return values.view(np.uint8).reshape(-1, 8)[:, :width]


def _unpack(packed: np.ndarray) -> np.ndarray:
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(U).ravel()


def _same_as_first(b: Batch, r: dict[str, np.ndarray], ids: np.ndarray, length: int) -> np.ndarray:
    """Mask of the runs whose bytes equal those of a run of a smaller doc_id in the batch; hashes propose, bytes decide."""
    with np.errstate(over="ignore"):
        key = r["whole"] * U(0x9E3779B97F4A7C15) + (r["lead"].astype(U) << U(8)) + r["n"].astype(U)
    own = ids[r["doc"]]
    order = np.lexsort((own, key))
    fresh = _groups(key[order])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    twins = np.flatnonzero(own[first] < own)
    wide = int(r["n"].max()) + length - 1
    start = b.offsets[r["doc"]] + r["at"]
    padded = np.concatenate([b.data, np.zeros(wide, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, wide)
    ends = np.arange(wide) >= (r["n"][twins] + length - 1)[:, None]
    same = ((view[start[twins]] == view[start[first[twins]]]) | ends).all(1) & (r["n"][twins] == r["n"][first[twins]])
    out = np.zeros(len(own), bool)
    out[twins[same]] = True
    return out


def _hot_anchors(docs: DataFrame, size: int, buckets: int, length: int, gram: int) -> np.ndarray:
    """Packed anchor hashes that occur in too many runs for one bucket, as far as a sample of the documents shows."""
    share = min(1.0, max(SAMPLE_BYTES / max(size, 1), SAMPLE_SHARE))
    sampled = docs.filter(F.pmod(F.xxhash64("doc_id", "row", F.lit("hot")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def count(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                b = Batch(batch.column("text"))
                if r := runs(b, length, gram):
                    keep = ~_same_as_first(b, r, np.asarray(batch.column("doc_id")), length)
                    found, n = np.unique(r["g"][keep] & U((1 << 40) - 1), return_counts=True)
                    total = pa.array(np.append(n, n.sum()).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(found.astype(np.int64), -1)), total], names=["g", "n"])

    counts = materialize(sampled.select("doc_id", "text").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).filter((F.col("g") < 0) | (F.col("n") > LEAST_HITS)))
    everything = (counts.filter("g < 0").first() or {"n": 0})["n"]
    least = max(everything / (8 * buckets), LEAST_HITS)
    return np.array(sorted(r["g"] for r in counts.filter((F.col("g") >= 0) & (F.col("n") > least)).select("g").collect()), U)


def _deal(docs: DataFrame, buckets: int, length: int, gram: int, hot: np.ndarray) -> DataFrame:
    """(bucket, docs, records, decided): packed runs of a stretch of documents for each hash bucket.

    Rows with ``decided`` have no records but what needs no bucket: covered runs and those of hot anchors.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def pack(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                b = Batch(batch.column("text"))
                r = runs(b, length, gram)
                if not r:
                    continue
                ids = np.stack([np.asarray(batch.column("doc_id")), np.asarray(batch.column("row"))])
                covered = _same_as_first(b, r, ids[0], length)
                undecided = ~covered & (lookup(shared.value, r["g"] & U((1 << 40) - 1)) >= 0)
                bucket = ((r["g"] >> U(40)) % U(buckets)).astype(np.int64)
                known = np.flatnonzero(covered | undecided)
                decided = np.stack([ids[0][r["doc"][known]], ids[1][r["doc"][known]], r["at"][known], r["n"][known], undecided[known]]).astype("<i8")
                out = ([int(ids[1][0] % buckets)] if len(known) else [], [b""] if len(known) else [], [b""] if len(known) else [], [decided.tobytes()] if len(known) else [])
                going = np.flatnonzero(~(covered | undecided))
                order = going[np.argsort(bucket[going], kind="stable")]
                names, starts = np.unique(bucket[order], return_index=True)
                for k, own in zip(names, np.split(order, starts[1:]) if len(order) else (), strict=True):
                    used, short = np.unique(r["doc"][own], return_inverse=True)
                    records = np.zeros(len(own), RECORD)
                    for name, width in (("g", 5), *[(side, 2) for side in SIDES], ("whole", 4)):
                        records[name] = _pack(r[name][own], width)
                    records["doc"], records["at"], records["n"], records["lead"] = short, r["at"][own], r["n"][own], r["lead"][own]
                    out[0].append(int(k))
                    out[1].append(np.ascontiguousarray(ids[:, used]).tobytes())
                    out[2].append(b"".join(np.ascontiguousarray(records[f]).tobytes() for f in RECORD.names))
                    out[3].append(b"")
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "docs", "records", "decided"])

    return docs.mapInArrow(pack, "bucket long, docs binary, records binary, decided binary")


def _read_records(ids: bytes, packed: bytes) -> dict[str, np.ndarray]:
    n, at, out = len(packed) // RECORD.itemsize, 0, {}
    for name in RECORD.names:
        kind = RECORD[name]
        size = kind.itemsize * n
        out[name] = np.frombuffer(packed[at : at + size], kind.base).reshape(n, *kind.shape)
        at += size
    table = np.frombuffer(ids, np.int64).reshape(2, -1)
    out["id"], out["row"] = table[0][out["doc"]], table[1][out["doc"]]
    return out


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _several(docs: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Mask of the rows whose keys occur with more than one document."""
    order = np.lexsort(keys)
    starts = np.flatnonzero(_groups(*[k[order] for k in keys]))
    out = np.zeros(len(docs), bool)
    if len(starts):
        many = np.minimum.reduceat(docs[order], starts) != np.maximum.reduceat(docs[order], starts)
        out[order] = np.repeat(many, np.diff(np.append(starts, len(docs))))
    return out


def _stretches(ids, rows, at, n, undecided: bool) -> pd.DataFrame:
    """One row per document row with its (offset, count) pairs."""
    order = np.lexsort((at, rows, ids))
    ids, rows, pairs = ids[order], rows[order], np.stack([at[order], n[order]], axis=1).astype("<i8")
    starts = np.flatnonzero(_groups(ids, rows)) if len(ids) else np.zeros(0, np.int64)
    blobs = [x.tobytes() for x in np.split(pairs, starts[1:])] if len(starts) else []
    return pd.DataFrame({"doc_id": ids[starts], "row": rows[starts], "undecided": undecided, "stretches": blobs})


def settle(length: int, gram: int):
    """The function that settles one bucket of runs: covered stretches and undecided ones."""
    one, two, three = extents(length, gram)
    # Bytes before the anchor (from, below) of a string, and the sides that equal strings must share then.
    zones = ((three, length, ("left_3",)), (two, three, ("left_2", "right_1")), (one, two, ("left_1", "right_2")), (0, one, ("right_3",)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        done = np.concatenate([np.frombuffer(x, "<i8").reshape(5, -1) for x in frame["decided"]], axis=1)
        known = [_stretches(*done[:4, done[4] == k], bool(k)) for k in (0, 1)]
        frame = frame[frame["records"].str.len() > 0]
        if not len(frame):
            return pd.concat(known, ignore_index=True)
        parts = [_read_records(d, r) for d, r in zip(frame["docs"], frame["records"], strict=True)]
        c = {k: np.concatenate([_unpack(p[k]) for p in parts]) for k in ("g", *SIDES, "whole")}
        c |= {k: np.concatenate([p[k] for p in parts]).astype(np.int64) for k in ("id", "row", "at", "n", "lead")}
        left, right = (c[f"{x}_1"] | (c[f"{x}_2"] << U(16)) | (c[f"{x}_3"] << U(32)) for x in ("left", "right"))
        order = np.lexsort((c["id"], c["whole"], right, left, c["g"]))
        c, left, right = {k: v[order] for k, v in c.items()}, left[order], right[order]
        first = _groups(c["g"], left, right, c["whole"], c["n"], c["lead"])
        covered = c["id"] > c["id"][np.flatnonzero(first)][np.cumsum(first) - 1]
        out = [*known, _stretches(c["id"][covered], c["row"][covered], c["at"][covered], c["n"][covered], False)]
        c = {k: v[~covered] for k, v in c.items()}
        for least, below, sides in zones:
            start, end = np.clip(c["lead"] - below + 1, 0, c["n"]), np.clip(c["lead"] - least + 1, 0, c["n"])
            own = {k: v[end > start] for k, v in (c | {"start": c["at"] + start, "count": end - start}).items()}
            own = (lambda mask, own=own: {k: v[mask] for k, v in own.items()})(_several(own["id"], *[own[x] for x in sides], own["g"]))
            out.append(_stretches(own["id"], own["row"], own["start"], own["count"], True))
        return pd.concat(out, ignore_index=True)

    return run


def multikey_order(strings: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix: multikey quicksort with eight-byte characters.

    A pass splits the rows still tied by one character; only ties go on to the next.
    """
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    characters = padded.view(">u8").byteswap(inplace=True).view(U)
    order, tied, group = np.arange(n), np.arange(n), np.zeros(n, np.int64)
    for c in range(characters.shape[1]):
        if len(tied) < 2:
            break
        part = order[tied]
        ranks = np.lexsort((characters[part, c], group[tied]))
        order[tied] = part[ranks]
        values = characters[order[tied], c]
        fresh = _groups(group[tied], values)
        group[tied] = tied[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
    return order


def _packed(ids, rows, places, parts: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """(part, documents, counts, offsets): strings packed for each hash part of their document."""
    if not len(ids):
        return []
    with np.errstate(over="ignore"):
        part = (mix(ids.astype(U) ^ mix(rows.astype(U))) % U(parts)).astype(np.int64)
    order = np.lexsort((places, rows, ids, part))
    part, ids, rows, places = part[order], ids[order], rows[order], places[order].astype("<u4")
    starts = np.flatnonzero(_groups(part, ids, rows))
    docs, counts = np.stack([ids[starts], rows[starts]]).astype("<i8"), np.diff(np.append(starts, len(ids))).astype("<u4")
    firsts = np.flatnonzero(_groups(part[starts]))
    cuts = zip(firsts, np.append(firsts[1:], len(starts)), starts[firsts], np.append(starts[firsts[1:]], len(ids)), strict=True)
    return [(int(part[k]), docs[:, i:j].tobytes(), counts[i:j].tobytes(), places[k:m].tobytes()) for i, j, k, m in cuts]


def _sorted_buckets(suffixes: DataFrame, length: int, parts: int) -> DataFrame:
    """What the sorted range partitions find.

    For each bucket a head row (first and last string, smallest doc_id of each), the members of its first string with ``edge``
    true, and the covered ones among the others with ``edge`` false. Strings are packed by the hash part of their document, so
    that there are as many rows as pairs of buckets and parts at most, and not one for each document that a bucket touches.
    """
    kinds = (("bucket", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("edge", pa.bool_()), ("part", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()))
    schema = pa.schema(list(kinds))

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables).combine_chunks()
        tables.clear()
        # All have the same length, so that their bytes lie in one buffer without gaps.
        suffix = table.column("suffix").chunk(0).cast(pa.binary())
        first = np.frombuffer(suffix.buffers()[1], "<i4", 1, 4 * suffix.offset)[0]
        strings = np.frombuffer(suffix.buffers()[2], np.uint8, len(suffix) * length, first).reshape(-1, length)
        ids, rows, places = (np.asarray(table.column(c)) for c in ("doc_id", "row", "at"))
        by_id = np.lexsort((places, rows, ids))
        order = by_id[multikey_order(strings[by_id])]
        strings, ids, rows, places = strings[order], ids[order], rows[order], places[order]
        del table, suffix, by_id, order
        new = np.ones(len(ids), bool)
        for at in range(1, len(ids), 1 << 16):
            part = strings[at - 1 : at + (1 << 16)]
            new[at : at + (1 << 16)] = (part[1:] != part[:-1]).any(1)
        starts, of = np.flatnonzero(new), np.cumsum(new) - 1
        smallest, bucket = ids[starts], TaskContext.get().partitionId()
        del new
        head = [[bucket], [strings[0].tobytes()], [strings[-1].tobytes()], [int(smallest[0])], [int(smallest[-1])], *[[None]] * 5]
        del strings
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(head, kinds, strict=True)], schema=schema)
        for edge, mask in ((True, of == 0), (False, (of > 0) & (ids > smallest[of]))):
            found = _packed(ids[mask], rows[mask], places[mask], parts)
            n = len(found)
            columns = [[bucket] * n, *[[None] * n] * 4, [edge] * n, *(zip(*found, strict=True) if n else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, kinds, strict=True)], schema=schema)

    return suffixes.mapInArrow(run, "bucket int, first binary, last binary, first_id long, last_id long, edge boolean, part long, docs binary, counts binary, places binary")


def _edges(found: DataFrame) -> list[tuple[int, int]]:
    """For each bucket the smallest doc_id of its first string, which earlier buckets may end with. One head row a bucket."""
    out, last, smallest = [], None, None
    for r in sorted(found.filter("first IS NOT NULL").select("bucket", "first", "last", "first_id", "last_id").collect(), key=lambda r: r["bucket"]):
        least = min(r["first_id"], smallest) if last == r["first"] else r["first_id"]
        out.append((r["bucket"], least))
        last, smallest = r["last"], least if r["last"] == r["first"] else r["last_id"]
    return out


def _unpacked(frame: pd.DataFrame) -> pd.DataFrame:
    """The packed strings of a part as stretches; of those at an edge, the ones of documents after the smallest."""
    parts = []
    for docs, counts, places, edge, smallest in zip(frame["docs"], frame["counts"], frame["places"], frame["edge"], frame["smallest"], strict=True):
        ids, rows = np.frombuffer(docs, "<i8").reshape(2, -1)
        n = np.frombuffer(counts, "<u4")
        kept = np.repeat(ids > smallest if edge else np.ones(len(ids), bool), n)
        parts.append([np.repeat(ids, n)[kept], np.repeat(rows, n)[kept], np.frombuffer(places, "<u4")[kept]])
    ids, rows, places = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((places, rows, ids))
    ids, rows, places = ids[order], rows[order], places[order].astype(np.int64)
    # Neighbouring strings become one stretch.
    fresh = np.flatnonzero(_groups(ids, rows, places - np.arange(len(places)))) if len(ids) else np.zeros(0, np.int64)
    return _stretches(ids[fresh], rows[fresh], places[fresh], np.diff(np.append(fresh, len(ids))), False)


def covered_suffixes(suffixes: DataFrame, length: int, partitions: int) -> DataFrame:
    """Covered strings among (suffix, doc_id, row, at), as stretches: one row for each document row."""
    dealt = suffixes.repartitionByRange(partitions, "suffix", "doc_id", "row", "at")
    found = materialize(_sorted_buckets(dealt, length, partitions))
    smallest = found.sparkSession.createDataFrame(_edges(found), "of int, smallest long")
    packed = found.filter("part IS NOT NULL").join(F.broadcast(smallest), F.col("bucket") == F.col("of"))
    return packed.select("part", "docs", "counts", "places", "edge", "smallest").groupBy("part").applyInPandas(_unpacked, STRETCHES)


def find(docs: DataFrame, length: int = 50, gram: int = 16) -> DataFrame:
    """(doc_id, row, stretches): for each document row the covered strings, as packed (offset, count) pairs."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-size // BUCKET_BYTES))
    dealt = _deal(docs, buckets, length, gram, _hot_anchors(docs, size, buckets, length, gram))
    settled = materialize(dealt.groupBy("bucket").applyInPandas(settle(length, gram), STRETCHES))
    asked = settled.filter("undecided").groupBy("doc_id", "row").agg(F.collect_list("stretches").alias("stretches"))

    def spell(batches):
        for batch in batches:
            for piece in slices(batch, "text", 1 << 18):
                strings, ids, rows, places = [], [], [], []
                for r in piece.to_pylist():
                    data = np.frombuffer(r["text"].encode(), np.uint8)
                    pairs = np.frombuffer(b"".join(r["stretches"]), "<i8").reshape(-1, 2)
                    at = np.unique(np.repeat(pairs[:, 0] - np.cumsum(pairs[:, 1]) + pairs[:, 1], pairs[:, 1]) + np.arange(pairs[:, 1].sum()))
                    strings.append(np.lib.stride_tricks.sliding_window_view(data, length)[at].tobytes())
                    places.append(at)
                    ids.append(np.full(len(at), r["doc_id"]))
                    rows.append(np.full(len(at), r["row"]))
                ids, rows, places = (np.concatenate(x) for x in (ids, rows, places))
                suffix = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(ids), [None, pa.py_buffer(b"".join(strings))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([suffix, pa.array(ids), pa.array(rows), pa.array(places)], names=["suffix", "doc_id", "row", "at"])

    undecided = docs.join(asked, ["doc_id", "row"]).select("doc_id", "row", "text", "stretches").mapInArrow(spell, "suffix binary, doc_id long, row long, at long")
    sorted_out = covered_suffixes(undecided, length, max(partitions, min(-(-size // RANGE_BYTES), MOST_RANGES)))
    whole = settled.filter("NOT undecided").unionByName(sorted_out)
    return whole.groupBy("doc_id", "row").agg(F.collect_list("stretches").alias("stretches"))


def _cut(text: str | None, stretches: list[bytes] | None, length: int) -> tuple[bytes, int, int, int]:
    """Remaining bytes, size, bytes removed and number of maximal removed stretches."""
    data = (text or "").encode()
    if not stretches:
        return data, len(data), 0, 0
    pairs = np.frombuffer(b"".join(stretches), "<i8").reshape(-1, 2)
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 0] + pairs[:, 1] - 1 + length, -1)
    gone = np.cumsum(edge)[:-1] > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), len(data), int(gone.sum()), spans


def remove(docs: DataFrame, length: int = 50, gram: int = 16) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): every document with its remaining bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.filter("doc_id IS NOT NULL").withColumn("row", F.xxhash64("text"))
    found = find(named, length, gram)
    joined = named.join(found, ["doc_id", "row"], "left").select("doc_id", "text", "stretches")
    nameless = rows.filter("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("stretches"))

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                done = [_cut(t, s, length) for t, s in zip(batch.column("text").to_pylist(), batch.column("stretches").to_pylist(), strict=True)]
                kept, size, gone, spans = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.unionByName(nameless).mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    return remove(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
