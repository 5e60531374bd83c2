"""Near-duplicate groups by ProbMinHash signatures, banding and verification.

A text is a multiset of five-word shingles (texts of one to four words are one shingle). ProbMinHash gives each register the
shingle that arrives first in an exponential race whose rates are the shingles' weights; two texts agree in a register with
their probability Jaccard similarity J_P. Arrivals of a shingle come in increasing order and stop as soon as one exceeds the
largest register, so most shingles draw only a few numbers. Registers are cut into bands; texts that agree in a whole band
share a bucket. With 120 registers in 24 bands of 5, a pair at J_P = 0.8 meets in no bucket with probability 7e-5.

Texts with the same words are one class first (smallest doc_id represents it). Candidate links between classes are then
verified by the exact J_P of both texts, in two rounds that lose no pair of a bucket whose signatures agree enough:

1. Every class is compared with the smallest class of its bucket (a join that adaptive execution splits for crowded
   buckets) and, in the largest of its crowded buckets, with the next two classes in a random order of salted parts of the
   bucket. Verified links are merged into components; in a large group of mutual near copies this connects almost all of it.
2. In buckets that still hold several components, every class outside the bucket's largest component is compared with all
   classes of other components; pairs inside one component could not change the result. Small buckets list these pairs. A
   crowded bucket is dealt into blocks of about ``BLOCK`` classes, those outside the largest component apart; each pair of
   blocks is one small task that compares signatures, then texts, and emits only the links it verifies, so no pairs are
   written out. Of n classes with o outside, about n * (1 + o / ``BLOCK``) + o * (1 + n / ``BLOCK``) rows are dealt: in
   proportion to n while few are outside, but each of o classes unlike all others is still compared with n.
   A pair that shares several buckets is compared in the first of them only.

Joins by bucket take the few hottest buckets (of more than ``HOT`` classes, and of one in a million of all hits) from a
broadcast, so that none is gathered in one task.

Before texts are read, pairs whose signatures agree in too few registers for 0.8 (four standard deviations below the
mean) are left out: of pairs at exactly 0.8 that share a bucket this loses one in ten thousand. Components come from min-label propagation with pointer jumping over tables in the shared folder; nothing is collected.

Defined results: null and word-less texts are groups of their own; rows that share a doc_id are one document (ids are meant
to be unique: where such rows differ in text, candidates are sought by one of the texts, the one with the smallest
signature); rows with null doc_id keep a null group; an empty table gives an empty result; extra columns are ignored by
``groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecohort.llm.common import add_struct, discard, materialize, struct_array
from tidecohort.llm.vectext import Batch, mix, shingles, slices

SHINGLE = 5
#: Buckets with more classes than this are compared by blocks.
CROWD = 50
BLOCK = 500
#: Buckets with more classes than this may be broadcast in joins by bucket.
HOT = 1000
NEIGHBOURS = 2
#: Of a class's crowded buckets, so many of the largest take part in the first round's random neighbours.
CROWDS = 4
#: At most so many ids (16 MB) are broadcast.
BROADCAST_IDS = 2_000_000
U = np.uint64


class Shingled:
    """Distinct shingles of each text with their weights, ordered by text and hash."""

    def __init__(self, texts: pa.Array, k: int = SHINGLE):
        b = Batch(texts)
        b.words()
        words = b.word_hashes()
        counts = np.bincount(b.doc, minlength=b.n)
        with np.errstate(over="ignore"):
            place = np.arange(len(words)) - b.first[:-1][b.doc]
            mixed = mix(words + mix(place.astype(U) + U(1)))
            sums = np.concatenate([[U(0)], np.cumsum(mixed)])
            self.sequence = mix((sums[b.first[1:]] - sums[b.first[:-1]]) ^ mix(counts.astype(U)))
            # Other hashes of the words than those above, so that both halves of the identity differ independently.
            sums = np.concatenate([[U(0)], np.cumsum(mix(b.word_hashes(salt=1) + mix(place.astype(U) + U(3))))])
            self.second = mix(sums[b.first[1:]] - sums[b.first[:-1]])
        hashes, doc = shingles(words, b.doc, k)
        short = np.flatnonzero((counts > 0) & (counts < k))
        hashes, doc = np.concatenate([hashes, self.sequence[short]]), np.concatenate([doc, short])
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.n, self.words = b.n, counts
        self.hash, self.doc, self.weight = hashes[at], doc[at], np.diff(np.append(at, len(doc)))
        self.bounds = np.searchsorted(self.doc, np.arange(self.n + 1))

    def own(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles and weights of one text."""
        part = slice(self.bounds[i], self.bounds[i + 1])
        return self.hash[part], self.weight[part]

    def pair(self, i: int, j: int) -> float:
        return probability_jaccard(*self.own(i), *self.own(j))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(s: Shingled, registers: int) -> np.ndarray:
    """(texts x registers) winning shingles; the Poisson process of each shingle stops beyond its text's largest register."""
    best = np.full(s.n * registers, np.inf)
    winner = np.zeros(s.n * registers, U)
    active, time, seed = np.arange(len(s.hash)), np.zeros(len(s.hash)), s.hash
    while len(active):
        with np.errstate(over="ignore"):
            seed = mix(seed + U(0x9E3779B97F4A7C15))
            register = (mix(seed ^ U(0x5DEECE66D)) % U(registers)).astype(np.int64)
        doc = s.doc[active]
        time = time - np.log(_uniform(seed)) / s.weight[active]
        slot = doc * registers + register
        order = np.lexsort((time, slot))
        first = order[np.concatenate([[True], slot[order][1:] != slot[order][:-1]])]
        first = first[time[first] < best[slot[first]]]
        best[slot[first]], winner[slot[first]] = time[first], s.hash[active[first]]
        going = time < best.reshape(s.n, registers).max(1)[doc]
        active, time, seed = active[going], time[going], seed[going]
    return winner.reshape(s.n, registers)


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Exact J_P of two weighted sets: over common shingles i, the sum of 1 / sum_j max(a_j/a_i, b_j/b_i)."""
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    if (wa == 1).all() and (wb == 1).all():
        return len(ia) / (len(ha) + len(hb) - len(ia))
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    sum_x, sum_y = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    cut = np.searchsorted(ratio, ratio, "right")
    total = (only_a + sum_x[-1] - sum_x[cut]) / x + (only_b + sum_y[cut]) / y
    return float((1 / total).sum())


def similarity(a: Shingled, b: Shingled) -> np.ndarray:
    """Exact probability Jaccard of the i-th texts of both."""
    return np.array([probability_jaccard(*a.own(i), *b.own(i)) for i in range(a.n)])


def classes(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, same: identity of the word sequence or null without words, buckets: one hash per band, sketch: a byte per register)."""
    fields = T.StructType([T.StructField("same", T.BinaryType()), T.StructField("buckets", T.BinaryType()), T.StructField("sketch", T.BinaryType())])

    def sign(batch: pa.RecordBatch) -> pa.StructArray:
        s = Shingled(batch.column("text"))
        winners = signatures(s, bands * rows)
        grid, sketch = winners.reshape(s.n, bands, rows), (mix(winners) & U(255)).astype(np.uint8)
        out = np.full((s.n, bands), 0, U)
        with np.errstate(over="ignore"):
            out += mix(np.arange(bands, dtype=U) + U(77))
            for r in range(rows):
                out = mix(out * U(31) + grid[:, :, r])
        same = [a.tobytes() + b.tobytes() if n else None for a, b, n in zip(s.sequence, s.second, s.words, strict=True)]
        return struct_array(fields, [same, [x.tobytes() for x in out], [x.tobytes() for x in sketch]])

    signed = add_struct(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"), "signature", fields, sign)
    return signed.select("doc_id", "signature.same", "signature.buckets", "signature.sketch")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is listed; a list of up to ``BROADCAST_IDS`` ids is broadcast, so texts stay in place."""
    ids = materialize(ids.select(F.col("id").alias("listed")))
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("listed"), "left_semi")


def _on_bucket(rows: DataFrame, other: DataFrame, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``other`` by bucket; what belongs to the listed hot buckets is broadcast and not shuffled."""
    listed = F.broadcast(hot)
    some = F.broadcast(other.join(listed, "bucket", "left_semi"))
    rest = rows.join(listed, "bucket", "left_anti").join(other.join(listed, "bucket", "left_anti"), "bucket", how)
    return rows.join(some, "bucket", how).unionByName(rest)


def _likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree in about as many registers as the threshold asks, less four deviations."""
    of = lambda name: reps.select(F.col("id").alias(name), F.col("sketch").alias(f"of_{name}"))

    def agree(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("of_a", "of_b"))
            if batch.num_rows:
                registers = x.shape[1]
                least = registers * threshold - 4 * np.sqrt(registers * threshold * (1 - threshold))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(agree, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have J_P of at least ``threshold``."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def compare(batches):
        for whole in batches:
            for batch in slices(whole, "text_a", 1 << 20):
                close = similarity(Shingled(batch.column("text_a")), Shingled(batch.column("text_b"))) >= threshold - 1e-12
                yield batch.select(["a", "b"]).filter(pa.array(close))

    return both.mapInArrow(compare, "a long, b long").distinct()


def _across(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids with one key and different components; of a key's largest component only with the others."""
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("kinds"), F.max_by("component", F.struct("n", "component")).alias("largest")).filter("kinds > 1")
    placed = placed.join(mixed.select("key", "largest"), "key")
    outside = placed.filter("component <> largest").select("key", F.col("id").alias("x"), F.col("component").alias("cx"))
    across = outside.join(placed, "key").filter("cx <> component AND (component = largest OR x < id)")
    return across.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))


def _dealt(placed: DataFrame, hot: DataFrame) -> DataFrame:
    """(bucket, band, id, component, p, q, left, outside): the classes of each pair of blocks of a crowded bucket.

    Block p has some of the classes outside the largest component, block q some of all classes; each kind has as many blocks as
    its own number of classes asks.
    """
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.max("k").alias("most"))
    rows = _on_bucket(placed, largest, hot).withColumn("outside", F.col("component") != F.col("largest"))
    rows = rows.withColumns({"ps": F.expr(f"cast((n - most) div {BLOCK} + 1 as int)"), "qs": F.expr(f"cast(n div {BLOCK} + 1 as int)")})
    of = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    common = ["bucket", "band", "id", "component"]
    left = rows.filter("outside").select(*common, of("ps").alias("p"), every("qs").alias("q"), F.lit(True).alias("left"), "outside")
    right = rows.select(*common, every("ps").alias("p"), of("qs").alias("q"), F.lit(False).alias("left"), "outside")
    return left.union(right)


def _blocked(placed: DataFrame, hot: DataFrame, reps: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) between components of crowded buckets; placed has bucket, band, id, n, component."""
    own = placed.select("id").distinct()
    payload = texts.join(own, F.col("doc_id") == F.col("id")).select(F.col("id").alias("of"), "text").join(reps.groupBy("id").agg(F.min_by("buckets", "sketch").alias("buckets"), F.min("sketch").alias("sketch")), F.col("of") == F.col("id")).drop("id")
    dealt = _dealt(placed, hot).join(payload, F.col("id") == F.col("of")).drop("of")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("id", "ascending"), ("text", "ascending")])
        side = np.asarray(table.column("left"))
        ids, component, outside = (np.asarray(table.column(c)) for c in ("id", "component", "outside"))
        sketch, buckets = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(len(ids), -1) for c, kind in (("sketch", np.uint8), ("buckets", U)))
        shingled = Shingled(table.column("text"))
        band, registers = int(table.column("band")[0].as_py()), sketch.shape[1]
        least = registers * threshold - 4 * np.sqrt(registers * threshold * (1 - threshold))
        head = {int(c): int(c) for c in np.unique(component)}

        def top(c):
            while head[c] != c:
                head[c] = head[head[c]]
                c = head[c]
            return c

        found, others = ([], []), np.flatnonzero(~side)
        for x in np.flatnonzero(side):
            near = others[(component[others] != component[x]) & (~outside[others] | (ids[others] > ids[x]))]
            near = near[(sketch[near] == sketch[x]).sum(1) >= least]
            near = near[(buckets[near] == buckets[x]).argmax(1) == band]
            for y in near:
                cx, cy = top(int(component[x])), top(int(component[y]))
                if cx != cy and shingled.pair(x, y) >= threshold - 1e-12:
                    head[max(cx, cy)] = min(cx, cy)
                    found[0].append(int(min(ids[x], ids[y])))
                    found[1].append(int(max(ids[x], ids[y])))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return dealt.groupBy("bucket", "p", "q").applyInArrow(compare, "a long, b long").distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over ``links`` (a, b), by min-label rounds with pointer jumping."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    linked = both.select(F.col("a").alias("id")).distinct()
    labels = last = materialize(linked.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("least")).withColumnRenamed("a", "id")
        hooked = labels.join(near, "id").select("id", "component", F.least("component", "least").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("far"))
        moved = materialize(hooked.join(jump, "new").select("id", "component", F.least("new", "far").alias("new")))
        done = moved.filter("new < component").isEmpty()
        discard(last)
        labels, last = moved.select("id", F.col("new").alias("component")), moved
        if done:
            return nodes.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def groups(docs: DataFrame, threshold: float = 0.8, bands: int = 24, rows: int = 5) -> DataFrame:
    """(doc_id, class_id, group_id): identical-words class and near-duplicate group of each row, as smallest doc_ids."""
    signed = materialize(classes(docs, bands, rows))
    reps = signed.filter("same IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("id"), F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch"))
    reps = materialize(reps)
    nodes = reps.select("id").distinct()
    width = 8
    hits = reps.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.conv(F.hex(F.substring("buckets", i * width + 1, F.lit(width))), 16, -10).cast("long"))).alias("band", "bucket"))
    hits = materialize(hits)
    crowded = materialize(hits.groupBy("bucket").agg(F.min("id").alias("top"), F.count("*").alias("n")).filter("n > 1"))
    most = crowded.agg(F.sum("n")).first()[0] or 0
    hot = materialize(crowded.filter(F.col("n") > max(HOT, most // 1_000_000)).select("bucket"))
    hits = materialize(_on_bucket(hits, crowded, hot))

    sketches = reps.groupBy("id").agg(F.min("sketch").alias("sketch"))
    stars = hits.filter("id > top").select(F.col("top").alias("a"), F.col("id").alias("b"))
    part = F.pmod(F.xxhash64("id"), F.expr(f"n div {CROWD} + 1")).cast("int")
    beside = Window.partitionBy("bucket", "part").orderBy(F.xxhash64("bucket", "id"), "id")
    largest = F.slice(F.sort_array(F.collect_set(F.struct("n", "bucket")), asc=False), 1, CROWDS)
    crowded_hits = hits.filter(F.col("n") > CROWD).groupBy("id").agg(largest.alias("largest"))
    crowded_hits = crowded_hits.select("id", F.explode("largest").alias("hit")).select("id", "hit.n", "hit.bucket").withColumn("part", part)
    chains = crowded_hits.select("id", F.array(*[F.lead("id", i).over(beside) for i in range(1, NEIGHBOURS + 1)]).alias("after")).select("id", F.explode("after").alias("next")).filter("next <> id")
    chains = chains.select(F.least("id", "next").alias("a"), F.greatest("id", "next").alias("b"))
    pairs = materialize(_likely(stars.union(chains).distinct(), sketches, threshold))
    texts = materialize(_only(docs.select("doc_id", "text"), hits.select("id").distinct()))
    links = materialize(_verified(pairs, texts, threshold))

    parts = materialize(components(nodes, links))
    placed = hits.select("bucket", "band", "id", "n").join(parts, "id")
    kinds = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("bucket")
    placed = materialize(_on_bucket(placed, kinds, hot, "left_semi"))
    few = _across(placed.filter(F.col("n") <= CROWD).select(F.col("bucket").alias("key"), "id", "component"))
    more = _likely(few.distinct().join(pairs, ["a", "b"], "left_anti"), sketches, threshold)
    crowds = _blocked(placed.filter(F.col("n") > CROWD), hot, reps, texts, threshold)
    found = materialize(_verified(more, texts, threshold).union(crowds))
    ends = found.join(parts.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(parts.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
    merged = components(parts.select(F.col("component").alias("id")).distinct(), ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct())
    parts = parts.join(merged.select(F.col("id").alias("component"), F.col("component").alias("group")), "component").select("id", F.col("group").alias("component"))
    reps = reps.select("same", "id").join(parts, "id").select(F.col("same").alias("of"), F.col("id").alias("class_id"), F.col("component").alias("group_id"))
    worded = signed.filter("same IS NOT NULL").join(reps, F.col("same") == F.col("of")).select("doc_id", "class_id", "group_id")
    alone = signed.filter("same IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"))
    nameless = docs.filter("doc_id IS NULL").select("doc_id", *[F.lit(None).cast("long").alias(c) for c in ("class_id", "group_id")])
    return worded.unionByName(alone).unionByName(nameless)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group: the one with the smallest doc_id (of its repeated rows, one). Null ids stay."""
    kept = groups(docs, **options).filter("doc_id = group_id").select("doc_id").distinct()
    first = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    return first.dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id IS NULL"))
