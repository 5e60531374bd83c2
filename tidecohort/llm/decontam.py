"""Benchmark decontamination: n-gram seeds join documents to test items, Smith-Waterman scores the alignment.

Words are runs of letters and digits, lower-cased. The score of a document and an item is the best Smith-Waterman alignment
over words, as a share of the item's perfect score, so edited and paraphrased copies score below 1 and accidental phrases
near 0. Seeds are pairs of words at most two apart, in the item as in the document: neighbours, or with one word between.
They lose nothing. Matched words that follow each other with two edits or more between them cost what they earn, so that an
alignment of ``threshold`` over an item of L words has at least ``threshold * L - 1`` close pairs of matched words, each
with its own first word in the item. Of the L - 1 places a pair can begin at, an item may therefore leave out as many as that
less one: it leaves out the most frequent ones, and the rare ones are its seeds. The words of a block of items are counted
in all documents. The counts decide how many stretches are looked at, not what is found, and no seed is too common to be followed.

Where a seed of an item occurs in a document, the stretch that an alignment at the threshold can reach is aligned with the
item. An alignment matches no more words than the item has in the document, or in the stretch; where these are too few for
the threshold, it is not computed, which changes no result.

The test items are a stated query set. They are taken in blocks of about ``block_bytes`` of text; each block is broadcast and
meets all documents. One block at a time passes through the driver; where there are several, what a block finds is written
and its broadcast dropped before the next one comes. Documents are not shuffled, but for a last join of ``clean`` by the digest
of texts where there are several blocks.

Defined results: null and word-less texts hold nothing; items without a word match nothing; items of one or two words match
only as they stand; items without an id are reported with a null id; repeated rows are judged alike; repeated items are reported
each; rows with a null doc_id are judged like others; empty tables give empty results; extra columns are ignored by ``report`` and kept by ``clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecohort.llm.common import add_struct, materialize, shielded, struct_array
from tidecohort.llm.vectext import Batch, lookup, mix, slices

U = np.uint64
FIELDS = T.StructType([T.StructField("items", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])
#: Every ASCII byte that is neither letter nor digit.
NO_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
MATCH, MISMATCH, GAP = 2, -1, -1
#: Places of n-grams in items that are held at once.
MOST_PLACES = 1 << 20


def _words(texts: pa.Array) -> tuple[Batch, np.ndarray]:
    b = Batch(pc.utf8_lower(texts))
    b.words(NO_WORD)
    return b, b.word_hashes()


def align(item: np.ndarray, passage: np.ndarray) -> float:
    """Smith-Waterman score of two word sequences as a share of the item's perfect score; a row of the table at a time."""
    if not len(item) or not len(passage):
        return 0.0
    steps = -GAP * np.arange(1, len(passage) + 1)
    row, best = np.zeros(len(passage) + 1, np.int64), 0
    for word in item:
        here = np.maximum(np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP), 0)
        row[1:] = np.maximum.accumulate(here + steps) - steps
        best = max(best, int(row[1:].max()))
    return best / (MATCH * len(item))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first * U(0x9E3779B97F4A7C15) + mix(second))


def counted_words(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """How often each of the given words (sorted hashes) occurs in all documents; a task keeps one count a word."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        totals = np.zeros(len(shared.value) + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                totals += np.bincount(lookup(shared.value, _words(batch.column("text"))[1]) + 1, minlength=len(totals))
        at = np.flatnonzero(totals[1:])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[1:][at])], names=["at", "n"])

    found = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    out = np.zeros(len(words), np.int64)
    out[np.asarray(found["at"])] = np.asarray(found["n"])
    return out


def _blocks(docs: DataFrame, benchmark: DataFrame, threshold: float, block_bytes: int):
    """Blocks of items: ids, words and, by kind of seed, sorted hashes with the places (item, position) of each."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        held.append(row)
        size += len(row["text"])
        if size >= block_bytes:
            yield _block(held, threshold, docs)
            held, size = [], 0
    if held:
        yield _block(held, threshold, docs)


def _seeds(own: np.ndarray, threshold: float, counted: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the rarest close pairs of an item, as many as no alignment at the threshold can avoid."""
    n = len(own) - 1
    counts = counted[1][lookup(counted[0], own)].astype(float)
    follows = np.append(counts[2:], np.inf)
    common = counts[:-1] * np.maximum(counts[1:], np.where(np.isinf(follows), 0, follows))
    left_out = max(1, int(np.ceil(threshold * len(own) - 1 - 1e-9))) - 1
    place = np.sort(np.argsort(common, kind="stable")[: max(1, n - left_out)])
    wide = place[place + 2 < len(own)]
    return np.concatenate([_pair(own[place], own[place + 1]), _pair(own[wide], own[wide + 2])]), np.concatenate([place, wide])


def _block(rows: list, threshold: float, docs: DataFrame) -> dict:
    b, hashes = _words(pa.array([r["text"] for r in rows], pa.string()))
    words = [hashes[b.first[i] : b.first[i + 1]] for i in range(b.n)]
    known = np.unique(hashes)
    counted = known, counted_words(docs, known)
    kinds: dict = {}
    for item, own in enumerate(words):
        if len(own) > 2:
            found, place = _seeds(own, threshold, counted)
            kinds.setdefault(0, []).append((found, np.full(len(found), item), place))
        elif len(own):
            kinds.setdefault(len(own), []).append((own if len(own) == 1 else _pair(own[:1], own[1:]), np.array([item]), np.array([0])))
    block = {"ids": [r["item_id"] for r in rows], "words": words, "flat": hashes, "first": b.first[:-1], "sizes": np.diff(b.first), "seeds": {}}
    for kind, parts in kinds.items():
        found, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(found, kind="stable")
        block["seeds"][kind] = {"keys": np.unique(found), "hash": found[order], "item": item[order], "place": place[order]}
    return block


def _hits(b: Batch, hashes: np.ndarray, keys: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into keys, document, word position) of the seeds of a kind in the documents, by document."""
    if kind == 1:
        found, place = hashes, np.arange(len(hashes))
    else:
        parts = []
        for step in (1, 2) if kind == 0 else (1,):
            if len(hashes) > step:
                at = np.flatnonzero(b.doc[step:] == b.doc[:-step])
                parts.append((_pair(hashes[at], hashes[at + step]), at))
        found, place = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, U), np.zeros(0, np.int64))
    at = lookup(keys, found)
    hit = np.flatnonzero(at >= 0)
    hit = hit[np.argsort(place[hit], kind="stable")]
    return at[hit], b.doc[place[hit]], place[hit]


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place in the owner's run) of the members of runs of the given lengths."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def _places(b: Batch, hashes: np.ndarray, block: dict):
    """(document, item, word position where the item would start), distinct and sorted; all of a document are in one piece."""
    for kind, g in block["seeds"].items():
        key, doc, word = _hits(b, hashes, g["keys"], kind)
        low = np.searchsorted(g["hash"], g["keys"][key])
        counts = np.searchsorted(g["hash"], g["keys"][key], "right") - low
        edges = np.flatnonzero(np.diff(doc, prepend=-1, append=b.n))
        sums, at = np.concatenate([[0], np.cumsum(counts)])[edges], 0
        while at < len(edges) - 1:
            to = max(at + 1, int(np.searchsorted(sums, sums[at] + MOST_PLACES, "right")) - 1)
            part = slice(edges[at], edges[to])
            owner, step = _runs(counts[part])
            place = low[part][owner] + step
            found = doc[part][owner], g["item"][place], word[part][owner] - g["place"][place]
            order = np.lexsort(found[::-1])
            found = [x[order] for x in found]
            fresh = np.ones(len(order), bool)
            fresh[1:] = np.any([x[1:] != x[:-1] for x in found], axis=0)
            yield tuple(x[fresh] for x in found)
            at = to


def _possible(own: np.ndarray, doc: np.ndarray, item: np.ndarray, block: dict, threshold: float) -> np.ndarray:
    """Whether a document, by its keys in ``own``, holds as many words of the item as a score at the threshold needs."""
    out, at = np.zeros(len(doc), bool), 0
    ends = np.cumsum(block["sizes"][item])
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_PLACES, "right")))
        size = block["sizes"][item[at:to]]
        owner, step = _runs(size)
        word = block["flat"][block["first"][item[at:to]][owner] + step]
        held = np.bincount(owner, lookup(own, _of_document(word, doc[at:to][owner])) >= 0, minlength=to - at)
        out[at:to] = held >= threshold * size - 1e-6
        at = to
    return out


def _of_document(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(word + mix(doc.astype(np.uint64)))


def _matches(b: Batch, hashes: np.ndarray, block: dict, threshold: float) -> list[tuple[int, int, float]]:
    """(document, item, best score) for every document and item that share a seed and score the threshold or more."""
    out, own = [], None
    for doc, item, start in _places(b, hashes, block):
        own = np.unique(_of_document(hashes, b.doc)) if own is None else own
        first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
        last = np.append(first[1:], len(doc))
        good = _possible(own, doc[first], item[first], block, threshold)
        for x, y in zip(first[good].tolist(), last[good].tolist(), strict=True):
            d, i = int(doc[x]), int(item[x])
            score = _best(block["words"][i], hashes, int(b.first[d]), int(b.first[d + 1]), start[x:y].tolist(), threshold)
            if score >= (threshold if len(block["words"][i]) > 2 else 1):
                out.append((d, i, score))
    return out


def _best(item: np.ndarray, hashes: np.ndarray, low: int, high: int, starts: list[int], threshold: float) -> float:
    """Best score of the item in the stretches around the given starts; 0 where no stretch can reach the threshold."""
    margin, best, done, stretches = int(np.ceil(2 * len(item) * (1 - threshold))) + 1, 0.0, None, []
    for s in starts:
        left, right = max(low, s - margin), min(high, s + len(item) + margin)
        if stretches and left <= stretches[-1][1] and right - stretches[-1][0] <= 4 * (len(item) + margin):
            stretches[-1][1] = right
        else:
            stretches.append([left, right])
    for left, right in stretches:
        text = hashes[left:right].tobytes()
        if text != done:
            done = text
            if (lookup(np.sort(hashes[left:right]), item) >= 0).sum() >= threshold * len(item) - 1e-6:
                best = max(best, align(item, hashes[left:right]))
    return best


def _judged(docs: DataFrame, block, threshold: float) -> DataFrame:
    """``docs`` with the struct column ``leaks``: items (ids) and scores of a broadcast block's items that a document holds."""

    def judge(batch: pa.RecordBatch) -> pa.StructArray:
        b, hashes = _words(batch.column("text"))
        items, scores = [[] for _ in range(b.n)], [[] for _ in range(b.n)]
        for d, i, score in sorted(_matches(b, hashes, block.value, threshold)):
            items[d].append(block.value["ids"][i])
            scores[d].append(score)
        return struct_array(FIELDS, [items, scores])

    return add_struct(docs, "leaks", FIELDS, judge)


def _by_block(docs: DataFrame, benchmark: DataFrame, threshold: float, block_bytes: int):
    """For each block of items the documents that hold some, with ``leaks``; ``last`` is true for the only block.

    Of several blocks each is written before the next is read, and its broadcast goes: the driver and a task hold one block,
    and no plan has more than one. A single block stays a plan, which runs with what uses it.
    """
    context, blocks = docs.sparkSession.sparkContext, _blocks(docs, benchmark, threshold, block_bytes)
    held, alone = next(blocks, None), True
    while held is not None:
        following = next(blocks, None)
        alone = alone and following is None
        shared = context.broadcast(held)
        found = _judged(docs, shared, threshold)
        if alone:
            yield found, True
        else:
            yield materialize(found.filter(F.size("leaks.items") > 0)), False
            shared.unpersist()
        held = following


def report(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, score) of every document and test item aligned at the threshold or above."""
    pairs = F.explode(F.arrays_zip(F.col("leaks.items").alias("items"), F.col("leaks.scores").alias("scores"))).alias("x")
    out = None
    for found, _ in _by_block(docs.select("doc_id", F.col("text")), benchmark, threshold, block_bytes):
        rows = found.filter(F.size("leaks.items") > 0).select("doc_id", pairs).select("doc_id", F.col("x.items").alias("item_id"), F.col("x.scores").alias("score"))
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score")).limit(0)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents that hold no test item.

    What a document holds follows from its text alone; with several blocks the digests of texts that hold an item are joined.
    """
    inner, out, digests = shielded(docs, "doc_id", "text"), None, None
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    for found, alone in _by_block(inner, benchmark, threshold, block_bytes):
        if alone:
            out = found.filter(F.size("leaks.items") == 0).drop("leaks")
        else:
            gone = found.select(digest.alias("__gone"))
            digests = gone if digests is None else digests.unionAll(gone)
    if digests is not None:
        out = inner.join(digests.distinct(), digest == F.col("__gone"), "left_anti")
    return (inner if out is None else out).toDF(*docs.columns)
