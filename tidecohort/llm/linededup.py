"""Line dedup: hashes of lines in range partitions, sorted by document and position, decided in one streaming pass.

A line's key is the line without ASCII blanks at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code points found
in at least ``min_docs`` documents lose all their lines except those of the largest doc_id that holds the key.

1. One scan cuts the texts into lines and writes a record (128-bit hash of the key, document, position) for each long line.
2. Records are range-partitioned by (hash, document descending, position), so that a line in a third of all documents spreads
   over a third of the partitions, and sorted. One pass over a partition sees a key's keeper first and holds rows only until
   the ``min_docs``-th document of a run has come; from there on it emits every row as it streams by.
3. A run may cross partitions at a partition's first and last run only. Rows of those that are still open go out as open, with
   a summary of the run (its first ``min_docs`` documents); summaries of a hash, two for each partition at most, settle them.
4. Dropped positions are grouped by document into a zlib-compressed bitmap of the lines to keep. The texts move once, to meet
   their bitmaps, and only where a text or its digest is asked for.

Defined results: null or empty text is one empty line; an id is a number, null counts as one document below all others; rows
that share an id are one document when documents are counted, and each keeps or loses its own lines; of such rows under the
largest id all keep theirs. A key's repetitions inside its keeper stay. A document that loses all lines has an empty text. An
empty table gives an empty result. Extra columns of any name pass through ``clean`` and are ignored by ``report``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecohort.llm.common import materialize, shielded
from tidecohort.llm.vectext import slices

BLANKS = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)
RECORD = "a long, b long, id long, t long, n_lines int, pos int"
DROP, OPEN, EDGE = 0, 1, 2


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, id, t): ``id`` is never null, ``t`` tells the texts of rows that share an id apart."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("t"))


def line_records(docs: DataFrame, min_chars: int) -> DataFrame:
    """A record for each line whose key has at least ``min_chars`` code points."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                lines = pc.split_pattern(pc.fill_null(piece.column("text"), ""), "\n")
                counts = np.asarray(pc.list_value_length(lines)).astype(np.int64)
                keys = pc.utf8_trim(lines.flatten(), characters=BLANKS)
                long = np.flatnonzero(np.asarray(pc.utf8_length(keys)) >= min_chars)
                doc = np.repeat(np.arange(len(counts)), counts)[long]
                pos = long - (np.cumsum(counts) - counts)[doc]
                folded = pc.ascii_lower(keys.take(pa.array(long))).cast(pa.binary())
                digest = np.frombuffer(b"".join(hashlib.blake2b(k.as_buffer(), digest_size=16).digest() for k in folded), "<i8").reshape(-1, 2)
                of = lambda c: np.asarray(piece.column(c))[doc]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digest[:, 0], digest[:, 1], of("id"), of("t"), counts[doc].astype(np.int32), pos.astype(np.int32))], names=names)

    return keyed(docs).select("id", "t", "text").mapInArrow(run, RECORD)


class _Runs:
    """Streams sorted records of one partition; ``feed`` and ``finish`` give (kind, records, documents of a summary)."""

    def __init__(self, min_docs: int):
        self.min_docs, self.first, self.last, self.docs, self.kind, self.held = min_docs, None, None, [], None, None

    def _summary(self):
        row = np.array([[*self.last, 0, 0, 0, 0]], np.int64)
        return EDGE, row, list(self.docs)

    def _see(self, ids: np.ndarray) -> None:
        for d in dict.fromkeys(ids[np.concatenate([[True], ids[1:] != ids[:-1]])][: self.min_docs + 1].tolist()):
            if d not in self.docs and len(self.docs) < self.min_docs:
                self.docs.append(d)

    def feed(self, rows: np.ndarray):
        if self.held is not None:
            rows, self.held = np.concatenate([self.held, rows]), None
            self.docs = []
        if not len(rows):
            return
        new_run = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        starts = np.flatnonzero(new_run)
        # The run that the last batch ended in goes on, or ends here.
        head = (int(starts[1]) if len(starts) > 1 else len(rows)) if self.last == tuple(rows[0, :2]) and self.kind is not None else 0
        if head:
            yield (OPEN if self.kind == "first" else DROP), rows[:head], None
            self._see(rows[:head, 2])
            rows, starts = rows[head:], starts[1:] - head
        if not len(rows):
            return
        if self.kind == "first":
            yield self._summary()
        if self.first is None:
            self.first = self.last = tuple(rows[0, :2])
            end = int(starts[1]) if len(starts) > 1 else len(rows)
            self.kind, self.docs = "first", []
            yield OPEN, rows[:end], None
            self._see(rows[:end, 2])
            rows, starts = rows[end:], starts[1:] - end
            if not len(rows):
                return
            yield self._summary()
        # Every run but the last of the batch is whole now; of the last one enough may have come.
        sizes = np.diff(np.append(starts, len(rows)))
        run = np.repeat(np.arange(len(starts)), sizes)
        new_doc = np.concatenate([[True], rows[1:, 2] != rows[:-1, 2]])
        new_doc[starts] = True
        seen = np.cumsum(new_doc)
        place = seen - seen[starts][run]
        common = (place[np.append(starts[1:], len(rows)) - 1] + 1 >= self.min_docs)[run]
        dropped = common & (place > 0)
        if dropped.any():
            yield DROP, rows[dropped], None
        tail = rows[starts[-1] :]
        self.last, self.docs = tuple(tail[0, :2]), []
        self._see(tail[:, 2])
        if common[-1]:
            self.kind = "decided"
        else:
            self.kind, self.held = None, tail

    def finish(self):
        if self.held is not None:
            yield OPEN, self.held, None
        if self.last is not None:
            yield self._summary()


def dropped_lines(records: DataFrame, min_docs: int) -> DataFrame:
    """(id, t, n_lines, pos) of every record that goes."""
    order = [F.col("a"), F.col("b"), F.col("id").desc(), F.col("t"), F.col("pos")]
    names = ["kind", "a", "b", "id", "t", "n_lines", "pos", "docs"]

    def out(kind, rows, docs):
        n = len(rows)
        columns = [pa.array(np.full(n, kind, np.int32)), *[pa.array(rows[:, i]) for i in range(4)], *[pa.array(rows[:, i].astype(np.int32)) for i in (4, 5)]]
        return pa.RecordBatch.from_arrays([*columns, pa.array([docs] * n, pa.list_(pa.int64()))], names=names)

    def run(batches):
        runs = _Runs(min_docs)
        for batch in batches:
            for found in runs.feed(np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1)):
                yield out(*found)
        for found in runs.finish():
            yield out(*found)

    judged = materialize(records.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"kind int, {RECORD}, docs array<long>"))
    every = F.array_distinct(F.flatten(F.collect_list("docs")))
    edges = judged.filter(F.col("kind") == EDGE).groupBy("a", "b").agg(every.alias("docs")).filter(F.size("docs") >= min_docs)
    # Two summaries for each range partition at most.
    edges = F.broadcast(edges.select("a", "b", F.array_max("docs").alias("keeper")))
    settled = judged.filter(F.col("kind") == OPEN).join(edges, ["a", "b"]).filter(F.col("id") != F.col("keeper"))
    columns = ["id", "t", "n_lines", "pos"]
    return judged.filter(F.col("kind") == DROP).select(*columns).unionAll(settled.select(*columns))


def bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(id, t, n_lines, n_dropped, keep) of every document that loses lines; all others keep theirs.

    ``keep`` holds one bit a line, first line first, compressed by zlib; ``unpack`` reads it.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    gone = dropped_lines(materialize(line_records(docs, min_chars)), min_docs)
    # Rows that repeat another row have the same lines.
    grouped = gone.groupBy("id", "t").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))

    def pack(batches):
        for batch in batches:
            dropped, keep = [], []
            for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("gone"), strict=True):
                bits = np.ones(n, bool)
                bits[np.asarray(places.values)] = False
                dropped.append(n - int(bits.sum()))
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            columns = [batch.column(c) for c in ("id", "t", "n_lines")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dropped, pa.int32()), pa.array(keep, pa.binary())], names=["id", "t", "n_lines", "n_dropped", "keep"])

    return grouped.mapInArrow(pack, "id long, t long, n_lines int, n_dropped int, keep binary")


def unpack(keep: bytes, n_lines: int) -> np.ndarray:
    """The lines to keep as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def _kept_text(text: str, keep: bytes | None, n_lines: int) -> str:
    if keep is None:
        return text
    return "\n".join(line for line, stays in zip(text.split("\n"), unpack(keep, n_lines), strict=True) if stays)


def report(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): the bitmaps' effect on every document."""
    met = keyed(docs).join(bitmaps(docs, min_chars, min_docs).select("id", "t", "n_dropped", "keep"), ["id", "t"], "left").select("doc_id", "text", "n_dropped", "keep")

    def run(batches):
        for batch in batches:
            lines, gone, digests = [], [], []
            for text, n, keep in zip(*[batch.column(c) for c in ("text", "n_dropped", "keep")], strict=True):
                text = text.as_py() or ""
                lines.append(text.count("\n") + 1)
                gone.append(n.as_py() or 0)
                digests.append(hashlib.sha256(_kept_text(text, keep.as_py(), lines[-1]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return met.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def clean(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; texts that lose nothing stay as they are, null among them."""
    inner = shielded(docs, "doc_id", "text")
    found = bitmaps(docs, min_chars, min_docs).select("id", "t", "n_lines", "keep")
    names = inner.columns
    met = inner.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "t": F.xxhash64("text")}).join(found, ["id", "t"], "left").select(*names, "n_lines", "keep")

    def run(batches):
        for batch in batches:
            texts = [_kept_text(t.as_py(), k.as_py(), n.as_py()) for t, n, k in zip(*[batch.column(c) for c in ("text", "n_lines", "keep")], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    return met.mapInArrow(run, inner.schema).toDF(*docs.columns)
