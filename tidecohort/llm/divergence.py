"""Source divergence audit: how far the sources of a language differ in their terms, exactly, by sorted runs.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A language keeps the V terms found in at least ``min_docs``
of its documents. A term with ``count`` of a group's N kept occurrences has p = 1 + floor(10^9 (count + 2) / (N + 2V)) there;
two groups differ in it by f(p, q) = floor((p - q)^2 / (p + q)).

1. One scan numbers the terms of its texts and sorts (document, term) and then (lang, term, source) as integers, ``HELD`` words
   at a time; run lengths give the documents and occurrences of a term. It leaves one record a term and language for each sort,
   with its sources and their counts, so that a term has no more records than there are sorts, however common it is.
2. Records are repartitioned by (lang, term) and sorted. A run-length scan adds up each run source by source as it streams by,
   and emits the terms that are kept. Of a run that goes on no more than one count a source is held.
3. Kept terms get p of their group and q of their language. Terms of a group are ranked by f where p > q.
4. Sources of a language are compared as if no term occurred (V times f of the two smallest p), corrected for the terms that
   one of them holds (from the number of terms by p), and for the terms that both hold: a run-length scan over (lang, term)
   emits the corrections of pairs of sources, added up within the task. All are integers, so the sum is exact.

Defined results: null text, lang and source count as empty strings, which are a language and a source like any other; every
row is a document, also if rows repeat; a group without kept terms has count 0 for each of them; without kept terms in a
language its pairs have the value 0; a language with one source has no pairs; ties rank by item; an empty table gives an empty
result. Extra columns of any name are ignored. Groups are broadcast up to ``MOST_GROUPS`` of them and joined by key beyond.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecohort.llm.common import materialize

#: Bytes of terms once A-Z are lower-cased: a-z and all bytes of characters beyond ASCII.
TERMS = re.compile(rb"[a-z\x80-\xff]+")
HELD = 4_000_000
MOST_TERMS = 1_000_000
PIECE = 1 << 20
MOST_GROUPS = 100_000
MOST_PAIRS = 1_000_000
COUNTS = "lang string, term string, df long, sources array<string>, counts array<long>"
KEPT = "lang string, term string, total long, sources array<string>, counts array<long>"
SCALE = 1_000_000_000


def pieces(data: bytes):
    """``data`` in pieces of about ``PIECE`` bytes that end at a byte outside terms."""
    at = 0
    while len(data) - at > PIECE:
        end = at + PIECE
        while end < len(data) and TERMS.match(data, end, end + 1):
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


class _Counted:
    """Words of documents as numbers, until they are sorted and leave as one record a term and language."""

    def __init__(self):
        self.terms: dict[bytes, int] = defaultdict(lambda: len(self.terms))
        self.groups: dict[tuple[str, str], int] = {}
        self.codes, self.group, self.size = [], [], 0

    def add(self, text: bytes, lang: str, source: str) -> None:
        found = [np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words)) for piece in pieces(text) for words in [TERMS.findall(piece)]]
        self.codes.append(np.concatenate(found))
        self.group.append(self.groups.setdefault((lang, source), len(self.groups)))
        self.size += len(self.codes[-1])

    def full(self) -> bool:
        return self.size >= HELD or len(self.terms) >= MOST_TERMS

    def records(self) -> pa.RecordBatch:
        named = [np.unique(np.array([g[i] for g in self.groups], object), return_inverse=True) for i in (0, 1)]
        (langs, lang_of), (sources, source_of) = [(list(names), place.astype(np.int64)) for names, place in named]
        v, n_sources, group = max(len(self.terms), 1), max(len(sources), 1), np.array(self.group, np.int64)
        lengths = np.array([len(c) for c in self.codes], np.int64)
        words = np.concatenate([*self.codes, np.zeros(0, np.int64)]) + np.repeat(np.arange(len(group)), lengths) * v
        words, occurrences = np.unique(words, return_counts=True)
        of = group[words // v]
        keys = (lang_of[of] * v + words % v) * n_sources + source_of[of]
        order = np.argsort(keys, kind="stable")
        keys, occurrences = keys[order], occurrences[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts, in_docs, keys = np.add.reduceat(occurrences, starts) if len(keys) else keys, np.diff(np.append(starts, len(keys))), keys[starts]
        runs = keys // n_sources
        heads = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.zeros(0, np.int64)
        df = np.add.reduceat(in_docs, heads) if len(runs) else in_docs
        offsets = pa.array(np.append(heads, len(runs)).astype(np.int32))
        name = lambda names, at: pa.array(names, pa.string()).take(pa.array(at))
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string()).take(pa.array(runs[heads] % v))
        lists = [pa.ListArray.from_arrays(offsets, name(sources, keys % n_sources)), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))]
        return pa.RecordBatch.from_arrays([name(langs, runs[heads] // v), terms, pa.array(df.astype(np.int64)), *lists], names=["lang", "term", "df", "sources", "counts"])


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial (lang, term, df, sources, counts): sums over the documents that one task has seen since its last sort."""

    def run(batches):
        held = _Counted()
        for batch in batches:
            for text, lang, source in zip(*[batch.column(c) for c in ("text", "lang", "source")], strict=True):
                held.add(text.as_py().encode().lower(), lang.as_py(), source.as_py())
                if held.full():
                    yield held.records()
                    held = _Counted()
        yield held.records()

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select(empty("text"), empty("lang"), empty("source")).mapInArrow(run, COUNTS)


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it."""
    return np.asarray(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))).astype(bool)


def _summed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One record a run of (lang, term), with the sums by source."""
    lang, term = batch.column("lang"), batch.column("term")
    new = np.concatenate([[True], _changes(lang) | _changes(term)])
    starts = np.flatnonzero(new)
    sizes = np.asarray(pc.list_value_length(batch.column("sources"))).astype(np.int64)
    coded = batch.column("sources").flatten().dictionary_encode()
    names = coded.dictionary
    keys = np.repeat(np.cumsum(new) - 1, sizes) * max(len(names), 1) + np.asarray(coded.indices)
    keys, place = np.unique(keys, return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, place, np.asarray(batch.column("counts").flatten()))
    runs = keys // max(len(names), 1)
    offsets = pa.array(np.searchsorted(runs, np.arange(len(starts) + 1)).astype(np.int32))
    heads = pa.array(starts)
    lists = [pa.ListArray.from_arrays(offsets, names.take(pa.array(keys % max(len(names), 1)))), pa.ListArray.from_arrays(offsets, pa.array(counts))]
    return pa.RecordBatch.from_arrays([lang.take(heads), term.take(heads), pa.array(np.add.reduceat(np.asarray(batch.column("df")), starts)), *lists], names=["lang", "term", "df", "sources", "counts"])


def kept_terms(counted: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, total, sources, counts) of terms in at least ``min_docs`` documents of their language."""

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pc.greater_equal(batch.column("df"), min_docs))
        lists = batch.column("counts")
        sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(np.asarray(lists.flatten()))])
        ends = np.cumsum(sizes)
        total = sums[ends] - sums[ends - sizes]
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("term"), pa.array(total.astype(np.int64)), batch.column("sources"), lists], names=["lang", "term", "total", "sources", "counts"])

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                whole = _summed(pa.concat_batches([held, batch]) if held is not None else batch)
                # The last run may go on in the next batch.
                held = whole.slice(whole.num_rows - 1)
                yield kept(whole.slice(0, whole.num_rows - 1))
        if held is not None:
            yield kept(held)

    return counted.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, KEPT)


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a count among n occurrences and v terms; null without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    over, under = (wide(count + 2) * F.lit(SCALE).cast("decimal(10,0)")).alias("o"), wide(n + 2 * v)
    return F.when(v > 0, F.lit(1) + F.call_function("div", over, under)).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def shared_corrections(kept: DataFrame) -> DataFrame:
    """Partial (lang, source, item, value) from the terms that two sources both hold; rows have sources, p and p0 as arrays.

    For each such term f(p, q) takes the place of what was counted for either source alone. Pairs are added up in the task and
    leave it when ``MOST_PAIRS`` have come together.
    """

    def out(codes, keys, sums):
        names = list(codes)
        left, right = np.divmod(keys, 1 << 31)
        text = lambda at, i: pa.array([names[k][i] for k in at.tolist()], pa.string())
        ways = [(left, right), (right, left)]
        return pa.concat_batches([pa.RecordBatch.from_arrays([text(a, 0), text(a, 1), text(b, 1), pa.array(sums)], names=["lang", "source", "item", "value"]) for a, b in ways])

    def merged(keys, sums):
        keys, place = np.unique(keys, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, place, sums)
        return keys, total

    def run(batches):
        codes: dict = {}
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            lists = batch.column("held")
            offsets = np.asarray(lists.offsets)
            fields = lists.values
            source, p, p0 = fields.field("source").to_pylist(), np.asarray(fields.field("p")), np.asarray(fields.field("p0"))
            sizes = np.diff(offsets)
            langs = np.repeat(np.array(batch.column("lang").to_pylist(), object), sizes)
            base = int(offsets[0])
            code = np.fromiter((codes.setdefault((g, s), len(codes)) for g, s in zip(langs, source[base : int(offsets[-1])], strict=True)), np.int64, int(offsets[-1]) - base)
            # The m-th source of every term with the next ones, one distance at a time: as many pairs as there are entries.
            for step in range(1, int(sizes.max(initial=0))):
                first = np.flatnonzero(np.arange(base, int(offsets[-1])) + step < np.repeat(offsets[1:], sizes))
                a, b = first, first + step
                pa_, pb, za, zb = p[base + a], p[base + b], p0[base + a], p0[base + b]
                d = _f(pa_, pb) - _f(pa_, zb) - _f(za, pb) + _f(za, zb)
                more = merged((code[a] << 31) + code[b], d)
                keys, sums = merged(np.concatenate([keys, more[0]]), np.concatenate([sums, more[1]]))
                if len(keys) > MOST_PAIRS:
                    yield out(codes, keys, sums)
                    keys, sums = keys[:0], sums[:0]
        if len(keys):
            yield out(codes, keys, sums)

    return kept.mapInArrow(run, "lang string, source string, item string, value long")


def report(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): sources by distance (part pair) and the terms that mark a source (part term)."""
    kept = materialize(kept_terms(term_counts(docs), min_docs))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    long = kept.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("g")).select("lang", "term", "total", F.col("g.sources").alias("source"), F.col("g.counts").alias("n"))
    sums = long.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    groups = docs.select(empty("lang"), empty("source")).groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("held"), zero("v"), zero("lang_n"))
    groups = materialize(groups.withColumn("p0", share(F.lit(0), F.col("held"), F.col("v"))))
    sized = F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups
    rated = materialize(
        long.join(sized, ["lang", "source"])
        .select("lang", "term", "source", share(F.col("n"), F.col("held"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"), "p0")
    )
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marks = rated.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    marks = marks.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)

    others = sized.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    paired = lambda rows: rows.join(others, "lang").filter(F.col("source") != F.col("item"))
    pair = ["lang", "source", "item"]
    none = paired(groups).select(*pair, F.when(F.col("v") > 0, F.col("v") * distance(F.col("p0"), F.col("q0"))).otherwise(F.lit(0)).alias("value"))
    alike = rated.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    alone = paired(alike).select(*pair, (F.col("terms") * (distance(F.col("p"), F.col("q0")) - distance(F.col("p0"), F.col("q0")))).alias("value"))
    alone = alone.groupBy(*pair).agg(F.sum("value").alias("value"))
    turned = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    both = shared_corrections(rated.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("held")))
    pairs = none.unionByName(alone).unionByName(turned).unionByName(both).groupBy(*pair).agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(first).alias("rank"))
    return pairs.unionByName(marks)
