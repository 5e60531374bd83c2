"""Language identification by word-first backoff.

A word that training saw is scored by its log frequency in each language. A word that it did not see falls back to its
character 4-grams, of which the known ones are averaged; if none is known, to 3-grams, 2-grams and single characters. The
document's language has the highest sum over words; ``score`` is its posterior under that sum.

The model is a classifier on a bounded sample: about ``docs_per_lang`` documents of every language, chosen by hash of doc_id
among rows that are not held out and have at most ``max_train_bytes`` of text. All languages are learned; frequencies are kept
sparsely (only the languages that hold a word or n-gram), so that the model is as large as the n-grams of the sample. Words
seen once in the sample are left to the n-grams.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text with letters of which nothing is
known gets the most frequent language, and of languages with equal scores the more frequent one (by name, if that is equal
too); repeated rows are judged alike; an empty table gives an empty result; an untrained model answers ``und``; rows with a
null doc_id count as not held out, as the empty id does; extra columns are ignored by ``report`` and passed through by
``annotate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecohort.llm.common import add_struct, remainder, struct_array
from tidecohort.llm.vectext import NO_LETTER, Batch, lookup, slices

FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
LONGEST = 4
#: What an n-gram that a language does not hold counts.
UNSEEN = 0.1
#: Cells of the words x languages table that are held at once.
CELLS = 1 << 21


class Words:
    """Words of a batch of lower-cased texts; ``distinct`` are the places of one word of each spelling, ``which`` maps words to them."""

    def __init__(self, texts: pa.Array):
        b = Batch(pc.utf8_lower(texts))
        b.words(NO_LETTER)
        self.batch = b
        self.hashes, self.distinct, self.which = np.unique(b.word_hashes(), return_index=True, return_inverse=True)
        self.points = np.append(np.flatnonzero((b.data & 0xC0) != 0x80), len(b.data))

    def grams(self, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index into ``chosen``) of all n-grams of characters inside the chosen distinct words."""
        b, at = self.batch, self.distinct[chosen]
        low, high = np.searchsorted(self.points, b.starts[at]), np.searchsorted(self.points, b.ends[at])
        counts = np.maximum(high - low - n + 1, 0)
        owner = np.repeat(np.arange(len(chosen)), counts)
        place = low[owner] + np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        return b.hashes(self.points[place], self.points[place + n]), owner


def sample(docs: DataFrame, docs_per_lang: int, max_train_bytes: int) -> tuple[DataFrame, list[str]]:
    """Training rows (text, lang number) and all languages, most frequent first: a row for each language reaches the driver."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder() != 2))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    langs = [r["lang"] for r in sizes]
    rows = [(r["lang"], i, min(1.0, docs_per_lang / r["count"])) for i, r in enumerate(sizes)]
    rates = F.broadcast(docs.sparkSession.createDataFrame(rows, "of string, number int, rate double"))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(10)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = known.join(rates, F.col("lang") == F.col("of")).filter(share < F.col("rate"))
    return chosen.filter(F.octet_length("text") <= max_train_bytes).select("text", "number"), langs


def train(docs: DataFrame, docs_per_lang: int = 1000, max_train_bytes: int = 1 << 20) -> dict:
    """Log frequencies per language of the sample's words and of its character n-grams, by level: 0 for words, else n."""
    rows, langs = sample(docs, docs_per_lang, max_train_bytes)

    def count(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(batch.column("text"))
                number = np.asarray(batch.column("number"))[w.batch.doc].astype(np.int64)
                pairs, often = np.unique(number * len(w.distinct) + w.which, return_counts=True)
                word, number = pairs % max(len(w.distinct), 1), pairs // max(len(w.distinct), 1)
                for n in range(LONGEST + 1):
                    hashes, owner = (w.hashes[word], np.arange(len(word))) if n == 0 else w.grams(word, n)
                    order = np.lexsort((hashes, number[owner]))
                    h, lang, weight = hashes[order], number[owner][order], often[owner][order]
                    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])])) if len(h) else np.zeros(0, np.int64)
                    sums = np.add.reduceat(weight, first) if len(h) else weight
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), n, np.int32)), pa.array(h[first].view(np.int64)), pa.array(lang[first].astype(np.int32)), pa.array(sums.astype(np.int64))], names=["n", "h", "number", "c"])

    counts = rows.mapInArrow(count, "n int, h long, number int, c long").groupBy("n", "h", "number").agg(F.sum("c").alias("c"))
    seen = F.sum("c").over(Window.partitionBy("n", "h"))
    table = counts.withColumn("seen", seen).filter("n > 0 OR seen > 1").drop("seen").toArrow().to_pandas()
    return {"langs": langs} | {n: _level(table[table["n"] == n], len(langs)) for n in range(LONGEST + 1)}


def _level(own, langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, bounds of their entries, language and gain over an unseen n-gram of each entry, and what that scores."""
    h, number, c = own["h"].to_numpy().view(np.uint64), own["number"].to_numpy(), own["c"].to_numpy().astype(float)
    order = np.lexsort((number, h))
    h, number, c = h[order], number[order], c[order]
    keys, starts = np.unique(h, return_index=True)
    sizes = np.bincount(number, c, minlength=langs)
    floor = np.log(UNSEEN / (sizes + UNSEEN * max(len(keys), 1)))
    return keys, np.append(starts, len(h)), number, np.log((c + UNSEEN) / UNSEEN), floor


def _entries(bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``at``, place of an entry) of all entries of the keys ``at``."""
    counts = bounds[at + 1] - bounds[at]
    owner = np.repeat(np.arange(len(at)), counts)
    return owner, bounds[at][owner] + np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]


def word_scores(w: Words, chosen: np.ndarray, model: dict) -> np.ndarray:
    """Log scores of the chosen distinct words (words x languages); 0 where nothing is known."""
    langs = len(model["langs"])
    out = np.zeros((len(chosen), langs))
    keys, bounds, lang, gain, floor = model[0]
    at = lookup(keys, w.hashes[chosen])
    hit = np.flatnonzero(at >= 0)
    owner, entry = _entries(bounds, at[hit])
    out[hit[owner], lang[entry]] = gain[entry]
    out[hit] += floor
    left = np.flatnonzero(at < 0)
    for n in range(LONGEST, 0, -1):
        if not len(left):
            break
        keys, bounds, lang, gain, floor = model[n]
        hashes, of = w.grams(chosen[left], n)
        at = lookup(keys, hashes)
        of, at = of[at >= 0], at[at >= 0]
        hits = np.bincount(of, minlength=len(left))
        owner, entry = _entries(bounds, at)
        sums = np.bincount(of[owner] * langs + lang[entry], gain[entry], minlength=len(left) * langs).reshape(-1, langs)
        known = hits > 0
        out[left[known]] = sums[known] / hits[known, None] + floor
        left = left[~known]
    return out


def scores(w: Words, model: dict) -> np.ndarray:
    """Summed log scores (documents x languages)."""
    langs, b = len(model["langs"]), w.batch
    total = np.zeros((b.n, langs))
    if not len(b.starts) or not langs:
        return total
    by_word = np.argsort(w.which, kind="stable")
    bounds = np.searchsorted(w.which[by_word], np.arange(len(w.distinct) + 1))
    step = max(1, CELLS // langs)
    for low in range(0, len(w.distinct), step):
        high = min(low + step, len(w.distinct))
        table = word_scores(w, np.arange(low, high), model)
        own = by_word[bounds[low] : bounds[high]]
        for k in range(langs):
            total[:, k] += np.bincount(b.doc[own], table[w.which[own] - low, k], minlength=b.n)
    return total


def annotate(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with the struct column ``language``: lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> pa.StructArray:
        model, texts = shared.value, batch.column("text")
        w = Words(texts)
        b = w.batch
        lettered = np.bincount(b.doc[(b.data[b.starts] < 128)], minlength=b.n) > 0 if len(b.starts) else np.zeros(b.n, bool)
        for i in np.flatnonzero(~lettered & (b.lengths > 0)):
            lettered[i] = any(c.isalpha() for c in texts[int(i)].as_py())
        if not model["langs"]:
            return struct_array(FIELDS, [["und"] * b.n, np.zeros(b.n)])
        total = scores(w, model)
        posterior = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        names = np.array(model["langs"], object)[total.argmax(1)]
        return struct_array(FIELDS, [np.where(lettered, names, "und").tolist(), np.where(lettered, posterior, 0.0)])

    return add_struct(docs, "language", FIELDS, judge)


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document."""
    judged = annotate(docs.select("doc_id", "text"), train(docs, **options))
    return judged.select("doc_id", (remainder() == 2).alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))
