"""Toxicity by class-conditional Kneser-Ney language models.

Two models spell words byte by byte, one as toxic and one as ordinary documents do: interpolated Kneser-Ney over the last
``ORDER`` bytes of a lower-cased word and its edges. The highest order holds counts; the orders below hold continuation counts
(before how many distinct bytes an n-gram occurs; n-grams at the edge of a word, which nothing precedes, keep their counts).
Discounts are estimated for each order from counts of counts and lie below 1 for an n-gram seen once. Orders above ``SHARED``
belong to each class; from ``SHARED`` downwards both classes back off to the same continuation counts, gathered from all
documents that are not held out, so a rare expression costs both models the same until a class shows how it goes on. A word
that training never saw is judged by the parts that it shares with toxic or ordinary words.

A document is the length-normalised difference of its toxic and ordinary log-likelihood, as a whole and for its strongest
line, with the excess of clearly toxic words; a logistic fit on labelled rows that the counts did not use (remainder 3) turns
these into a probability.

N-grams of up to seven bytes are exact keys: the bytes themselves and their number in one long. Class counts come from a
bounded sample of labelled rows (remainders 0 and 1, at most ``docs_per_class`` of up to ``max_train_bytes`` each), the fit from at
most ``max_fit_docs``. The counts of the corpus are tables that Spark groups; only those of n-grams that a class can distinguish
are broadcast, so what is broadcast is as large as the n-grams of the sample: where neither class holds an n-gram, its
shared probability cancels.

Defined results: null and word-less texts get the score of the base rate alone; without labelled rows of both classes every
score is 0; rows labelled both ways count as toxic; repeated rows are judged alike; an empty table gives an empty result;
rows with a null doc_id are scored, and count as not held out as the empty id is; extra columns are ignored by ``report`` and
passed through by ``annotate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecohort.llm.common import add_struct, bounded_sample, materialize, remainder, struct_array
from tidecohort.llm.vectext import NO_LETTER, Batch, lookup, slices

U = np.uint64
#: Longest n-gram in bytes; with the number of its bytes it fills a long.
ORDER = 7
#: Orders up to this have one table of continuation counts for both classes.
SHARED = 2
#: The edge of a word.
EDGE = 32
#: A word is clearly toxic when its log-likelihoods differ by more than this.
CLEAR = 2.0
KINDS = ("toxic", "ordinary")
FIELDS = T.StructType([T.StructField("score", T.DoubleType())])
N_FEATURES = 6


class Words:
    """Word positions of a batch of texts; ``distinct`` are the places of one word of each spelling, ``which`` maps words to them."""

    def __init__(self, texts: pa.Array):
        b = Batch(pc.utf8_lower(texts))
        b.words(NO_LETTER)
        self.batch, self.n = b, len(b.starts)
        self.hashes, self.distinct, self.which = np.unique(b.word_hashes(), return_index=True, return_inverse=True)

    def spelled(self, chosen: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with an edge on both sides, owner: index into the chosen, place in the word) of the chosen distinct words."""
        at = self.distinct[chosen]
        starts, sizes = self.batch.starts[at], (self.batch.ends - self.batch.starts)[at] + 2
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
        edge = (place == 0) | (place == sizes[owner] - 1)
        inner = np.where(edge, 0, starts[owner] + place - 1)
        return np.where(edge, EDGE, self.batch.data[inner]).astype(U), owner, place


def grams(symbols: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that end at each symbol: their bytes, and n in the highest byte."""
    key = np.full(len(symbols), U(n) << U(56))
    for k in range(min(n, len(symbols))):
        key[k:] |= symbols[: len(symbols) - k] << U(8 * k)
    return key


def _suffix(key: Column, n: int) -> Column:
    """The n-gram without its first byte."""
    return key.bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)).bitwiseOR(F.lit((n - 1) << 56))


def _context(key: Column, n: int) -> Column:
    """The n-gram without its last byte."""
    return F.shiftright(key.bitwiseAND(F.lit((1 << 56) - 1)), 8).bitwiseOR(F.lit((n - 1) << 56))


def counted(rows: DataFrame, order: int, weights: list[str]) -> DataFrame:
    """(key, *weights): counts of the n-grams of the highest order and of the shorter ones at the edge of a word.

    ``rows`` has ``text`` and, for each weight, a column that says how much one occurrence in the row counts.
    """

    def count(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(batch.column("text"))
                symbols, owner, place = w.spelled()
                factor = [np.asarray(batch.column(c)).astype(np.int64) for c in weights]
                often = [np.bincount(w.which, f[w.batch.doc], minlength=len(w.distinct)).astype(np.int64) for f in factor]
                at_edge = [np.flatnonzero(place == n - 1) for n in range(2, order)]
                places = np.concatenate([*at_edge, np.flatnonzero(place >= order - 1)])
                keys = np.concatenate([*[grams(symbols, n)[at] for n, at in zip(range(2, order), at_edge, strict=True)], grams(symbols, order)[place >= order - 1]])
                found, of = np.unique(keys, return_inverse=True)
                sums = [np.bincount(of, o[owner[places]], minlength=len(found)).astype(np.int64) for o in often]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *[pa.array(s) for s in sums]], names=["key", *weights])

    out = rows.mapInArrow(count, ", ".join(f"{c} long" for c in ("key", *weights)))
    return out.groupBy("key").agg(*[F.sum(c).alias(c) for c in weights])


def _of_order(table: DataFrame, n: int) -> DataFrame:
    return table.filter(F.shiftright("key", 56) == n)


def continued(above: DataFrame, edges: DataFrame, n: int, weights: list[str]) -> DataFrame:
    """(key, *weights) of order ``n``: continuation counts from the n-grams of the order above, counts at the edge of a word."""
    follow = above.select(_suffix(F.col("key"), n + 1).alias("key"), *[(F.col(c) > 0).cast("long").alias(c) for c in weights])
    both = follow.unionByName(_of_order(edges, n).select("key", *weights)) if n > 1 else follow
    return both.groupBy("key").agg(*[F.sum(c).alias(c) for c in weights])


def _discount(seen: list[int]) -> tuple[float, float, float]:
    n = [0, *seen]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    rule = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i * y for i in (1, 2, 3)]
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(rule, 1))


def discounts(table: DataFrame, weights: list[str]) -> list[tuple[float, float, float]]:
    """For each weight the discounts of counts 1, 2 and above, from the numbers of n-grams seen once to four times."""
    seen = table.agg(*[F.count_if(F.col(c) == i).alias(f"{c}_{i}") for c in weights for i in (1, 2, 3, 4)]).first()
    return [_discount([seen[f"{c}_{i}"] for i in (1, 2, 3, 4)]) for c in weights]


def _level(table: DataFrame, n: int, weights: list[str]) -> tuple[DataFrame, DataFrame]:
    """What an order of a model is made of: (key, count less discount) and (context, total, discounted share)."""
    spare = [F.when(F.col(c) <= 0, 0.0).when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2]) for c, d in zip(weights, discounts(table, weights), strict=True)]
    kept = table.select("key", *[(F.col(c) - s).alias(f"{c}_left") for c, s in zip(weights, spare, strict=True)], *[F.col(c).alias(f"{c}_all") for c in weights], *[s.alias(f"{c}_spare") for c, s in zip(weights, spare, strict=True)])
    sums = [F.sum(f"{c}_all").cast("double").alias(f"{c}_total") for c in weights] + [F.sum(f"{c}_spare").alias(f"{c}_freed") for c in weights]
    contexts = kept.groupBy(_context(F.col("key"), n).alias("context")).agg(*sums)
    return kept.select("key", *[f"{c}_left" for c in weights]), contexts


def _collect(rows: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and the other columns (one row a column) with one element more: the 0 of absent keys."""
    found = rows.toArrow()
    keys = np.asarray(found[key]).view(U)
    order, values = np.argsort(keys), [c for c in rows.columns if c != key]
    out = np.zeros((len(values), len(keys) + 1))
    for i, value in enumerate(values):
        out[i, :-1] = np.asarray(found[value])[order]
    return keys[order], out


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of the values (one row a kind) of each."""
    found, of = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(of, v, minlength=len(found)) for v in values])


def class_levels(keys: np.ndarray, counts: np.ndarray) -> dict:
    """The orders above ``SHARED`` of both classes from the n-grams that ``counted`` gives for the bounded sample."""
    order_of, out, kinds = (keys >> U(56)).astype(int), {}, len(counts)
    above, held = keys[order_of == ORDER], counts[:, order_of == ORDER]
    for n in range(ORDER, SHARED, -1):
        if n < ORDER:
            follow = (above & U((1 << 8 * n) - 1)) | (U(n) << U(56))
            above, held = _sums(np.concatenate([follow, keys[order_of == n]]), np.concatenate([held > 0, counts[:, order_of == n]], axis=1))
        cut = np.stack([np.append(0.0, _discount([int((c == i).sum()) for i in (1, 2, 3, 4)])) for c in held])
        spare = np.stack([cut[k][np.minimum(held[k], 3).astype(int)] for k in range(kinds)])
        contexts, sums = _sums(((above & U((1 << 56) - 1)) >> U(8)) | (U(n - 1) << U(56)), np.concatenate([held, spare]))
        order, wide = np.argsort(above), ((0, 0), (0, 1))
        out[n] = (above[order], np.pad((held - spare)[:, order], wide)), (contexts, np.pad(sums, wide))
    return out


def _probability(level: tuple, keys: np.ndarray, n: int, below: np.ndarray) -> np.ndarray:
    """Interpolated probability, by kind, of the n-grams ``keys`` from one order and the probability ``below`` of their suffixes."""
    (held, left), (contexts, sums) = level
    context, key = lookup(contexts, ((keys & U((1 << 56) - 1)) >> U(8)) | (U(n - 1) << U(56))), lookup(held, keys)
    total, freed = np.split(sums[:, context], 2)
    there = np.maximum(total, 1)
    return np.where(total > 0, (left[:, key] + freed * below) / there, below)


def _sample(docs: DataFrame, labels: DataFrame, rule: str, per_class: int, max_train_bytes: int) -> DataFrame:
    """(text, toxic, ordinary) of at most ``per_class`` labelled documents of each class, by a hash of their id; their ids are broadcast."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("r", remainder()).filter(rule)
    ids = bounded_sample(known.filter("toxic > 0"), "doc_id", per_class).union(bounded_sample(known.filter("toxic <= 0"), "doc_id", per_class))
    ids = ids.select(F.col("doc_id").alias("of"), (F.col("toxic") > 0).alias("toxic"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= max_train_bytes)
    chosen = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("of"))
    return chosen.select("text", F.col("toxic").cast("long").alias("toxic"), (~F.col("toxic")).cast("long").alias("ordinary"))


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = 10_000, max_train_bytes: int = 1 << 20, max_fit_docs: int = 4000) -> dict | None:
    """Both models and their shared backoff (broadcast) and the logistic fit; None without labelled rows of both classes."""
    rows = counted(_sample(docs, labels, "r < 2", docs_per_class, max_train_bytes), ORDER, list(KINDS)).toArrow()
    keys, counts = np.asarray(rows["key"]).view(U), np.stack([np.asarray(rows[k]) for k in KINDS]).astype(float)
    if not counts.any(1).all():
        return None
    model = class_levels(keys, counts)
    told = [(k & U((1 << 8 * SHARED) - 1)) | (U(SHARED) << U(56)) for k in (model[SHARED + 1][0][0],)]
    asked = np.unique(np.concatenate([*told, keys[keys >> U(56) == SHARED]]))
    model["base_keys"], model["base"] = shared_backoff(docs, asked)
    fit_rows = _sample(docs, labels, "r = 3", max_fit_docs // 2, max_train_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                f = features(batch.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(f[:, i]) for i in range(1, N_FEATURES)]], names=["toxic", *names])

    names = [f"f{i}" for i in range(1, N_FEATURES)]
    seen = fit_rows.select("text", "toxic").mapInArrow(measure, "toxic long, " + ", ".join(f"{c} double" for c in names)).toArrow().to_pandas().sort_values([*names, "toxic"])
    learned = labels.filter(F.col("toxic").isNotNull() & (remainder() != 2)).agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count("*").alias("rows")).first()
    rate = (learned["toxic"] + 1) / (learned["rows"] + 2)
    fit = _logistic(seen[names].to_numpy(), (seen["toxic"] > 0).to_numpy(), rate)
    return {"shared": shared, "fit": fit}


def shared_backoff(docs: DataFrame, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each of the asked n-grams of order ``SHARED`` by continuation counts of all documents not held out.

    The n-grams of the corpus stay tables; those asked for, of which the sample has so many, and the shorter ones they need
    reach the driver.
    """
    corpus = docs.filter(remainder() != 2).select(F.coalesce("text", F.lit("")).alias("text"), F.lit(1).cast("long").alias("n"))
    edges = materialize(counted(corpus, SHARED + 1, ["n"]))
    above, levels = _of_order(edges, SHARED + 1), {}
    needed = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"asked": pa.array(asked.view(np.int64))})))
    for n in range(SHARED, 0, -1):
        above = materialize(continued(above, edges, n, ["n"]))
        held, contexts = _level(above, n, ["n"])
        here = needed.select(_context(F.col("asked"), n).alias("of"))
        levels[n] = (_collect(held.join(needed, F.col("key") == F.col("asked"), "left_semi"), "key"), _collect(contexts.join(here, F.col("context") == F.col("of"), "left_semi"), "context"))
        needed = needed.select(_suffix(F.col("asked"), n).alias("asked")) if n > 1 else needed
    out = np.full(len(asked), 1 / 256)
    for n in range(1, SHARED + 1):
        out = _probability(levels[n], (asked & U((1 << 8 * n) - 1)) | (U(n) << U(56)), n, out)[0]
    return asked, np.append(out, 1.0)


def _logistic(x: np.ndarray, y: np.ndarray, rate: float, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the penalised likelihood; rows weigh so that classes have their share of the corpus."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9)) if len(y) else np.zeros(0)
    theta = np.zeros(N_FEATURES)
    theta[0] = np.log(rate / (1 - rate))
    for _ in range(25 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * theta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(N_FEATURES)
        theta = theta + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return theta


class Judged:
    """Log-likelihood differences of the words that a task has met, by hash; forgotten beyond ``most`` words."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.keys, self.gains = most, np.zeros(0, U), np.zeros(1)

    def of(self, words: Words, model: dict) -> np.ndarray:
        """The difference of each distinct word of a batch."""
        if len(self.keys) > self.most:
            self.keys, self.gains = np.zeros(0, U), np.zeros(1)
        new = np.flatnonzero(lookup(self.keys, words.hashes) < 0)
        if len(new):
            toxic, ordinary = log_likelihoods(words, model, new)
            keys = np.concatenate([self.keys, words.hashes[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.gains = keys[order], np.append(np.concatenate([self.gains[:-1], toxic - ordinary])[order], 0.0)
        return self.gains[lookup(self.keys, words.hashes)]


def log_likelihoods(words: Words, model: dict, chosen: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
    """For both classes the log-likelihood of each of the chosen distinct words.

    The first ``SHARED`` bytes of a word cost both classes the same and are left out, as are shared factors that cancel.
    """
    symbols, owner, place = words.spelled(chosen)
    told = np.flatnonzero(place >= SHARED)
    base = model["base"][lookup(model["base_keys"], grams(symbols, SHARED)[told])]
    p = np.repeat(base[None], len(KINDS), axis=0)
    for n in range(SHARED + 1, ORDER + 1):
        at = np.flatnonzero(place[told] >= n - 1)
        p[:, at] = _probability(model[n], grams(symbols, n)[told[at]], n, p[:, at])
    return [np.bincount(owner[told], x, minlength=len(words.distinct[chosen])) for x in np.log(p)]


def features(texts: pa.Array, model: dict, judged: Judged | None = None) -> np.ndarray:
    """Per document: 1, mean difference per word, strongest line by mean and by clear words, all clear words: their log and per word."""
    w = Words(texts)
    b, out = w.batch, np.zeros((w.batch.n, N_FEATURES))
    out[:, 0] = 1
    if not w.n:
        return out
    gain = np.clip((judged or Judged()).of(w, model), -20, 20)[w.which]
    lines = np.cumsum(b.data == 10)
    _, line = np.unique(lines[b.starts] + b.doc, return_inverse=True)
    n_line = np.bincount(line)
    excess = np.maximum(gain - CLEAR, 0)
    of = np.zeros(len(n_line), np.int64)
    of[line] = b.doc
    words = np.bincount(b.doc, minlength=b.n)
    out[:, 1] = np.bincount(b.doc, gain, minlength=b.n) / (words + 4)
    np.maximum.at(out[:, 2], of, np.bincount(line, gain) / (n_line + 4))
    np.maximum.at(out[:, 3], of, np.bincount(line, excess) / (n_line + 4))
    total = np.bincount(b.doc, excess, minlength=b.n)
    out[:, 4], out[:, 5] = np.log1p(total), total / (words + 4)
    return out


def annotate(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with the struct column ``toxicity``: score."""

    judged = Judged()

    def judge(batch: pa.RecordBatch) -> pa.StructArray:
        if model is None:
            return struct_array(FIELDS, [np.zeros(batch.num_rows)])
        z = features(batch.column("text"), model["shared"].value, judged) @ model["fit"]
        return struct_array(FIELDS, [1 / (1 + np.exp(-np.clip(z, -30, 30)))])

    return add_struct(docs, "toxicity", FIELDS, judge)


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    judged = annotate(docs.select("doc_id", "text"), train(docs, labels, **options))
    score = F.col("toxicity.score")
    return judged.select("doc_id", (remainder() == 2).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
