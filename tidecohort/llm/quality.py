"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Every line with a word becomes a feature vector (length, symbols, capitals, punctuation, repetition). A two-label chain CRF
scores label sequences by weighted features plus transition weights; Viterbi decoding gives the best sequence, and a text is
kept when at least ``min_content`` of its words stand in content lines and no base rule fails (fewer than 50 words, or more
than half of the words in three-word windows that occur twice in the text).

The CRF is fitted on the driver by gradient ascent on the likelihood, over a bounded sample of labelled documents
(``max_train_docs``, none above ``max_train_bytes``). Labels are of whole documents, so lines of bad documents start as boilerplate and are relabelled
between fits by the model itself, except that at least the worse half of a bad document stays boilerplate.

Defined results: null and word-less texts have zeros everywhere, fail the base rule and are not kept; repeated rows are
judged alike; of two labels with equal scores a line is boilerplate; without labelled documents of both kinds only the base
rules decide; rows with a null doc_id are judged but never trained on; an empty table gives an empty result; extra columns
are passed through by ``annotate`` and ``keep`` and ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecohort.llm.common import add_struct, bounded_sample, shielded, struct_array
from tidecohort.llm.vectext import Batch, shingles, slices

FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())])
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
STOPS = np.isin(np.arange(256), np.frombuffer(b".?:;", np.uint8))
N_FEATURES = 11


def _per(ids: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(ids, weights, minlength=n)


def _not_first(*keys: np.ndarray) -> np.ndarray:
    """Mask of the rows whose keys all equal those of an earlier row."""
    order = np.lexsort(keys)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    return out


class Lines:
    """Base statistics of each text and a feature row for each line with a word."""

    def __init__(self, texts: pa.Array):
        b = Batch(texts)
        b.words()
        data, n = b.data, b.n
        breaks = np.flatnonzero(data == 10)
        starts = np.union1d(b.offsets[:-1][b.lengths > 0], breaks + 1)
        starts = starts[starts < len(data)].astype(np.int64)
        line_doc = np.searchsorted(b.offsets, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(data)), b.offsets[line_doc + 1])
        ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10))
        of_word = np.searchsorted(starts, b.starts, "right") - 1
        has = _per(of_word, len(starts)) > 0
        number = np.cumsum(has) - 1
        starts, ends, self.doc = starts[has], ends[has], line_doc[has]
        of_word, m = number[of_word] if len(of_word) else of_word, int(has.sum())
        doubled = _not_first(b.segment_hashes(starts, ends), b.segment_hashes(starts, ends, salt=1), self.doc)

        hashes = b.word_hashes()
        windows, window_doc = shingles(hashes, b.doc, 3)
        places = np.flatnonzero(b.doc[: max(len(hashes) - 2, 0)] == b.doc[2:]) if len(hashes) > 2 else np.zeros(0, np.int64)
        order = np.lexsort((windows, window_doc))
        w, d = windows[order], window_doc[order]
        twin = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
        many = np.zeros(len(w), bool)
        many[1:] |= twin
        many[:-1] |= twin
        repeated = np.zeros(len(hashes) + 2, bool)
        hit = places[order[many]]
        for i in range(3):
            repeated[hit + i] = True
        repeated = repeated[: len(hashes)]

        counted = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        chars = counted[b.ends] - counted[b.starts]
        self.words = _per(of_word, m)
        self.n_words, self.word_chars = _per(b.doc, n), _per(b.doc, n, chars).astype(np.int64)
        total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        symbols = total(SYMBOLS[data])
        self.n_symbols = symbols[b.offsets[1:]] - symbols[b.offsets[:-1]]
        self.n_dup_lines = _per(self.doc[doubled], n)
        self.n_repeat_words = _per(b.doc[repeated], n)

        within = lambda mask: (lambda c: c[ends] - c[starts])(total(mask))
        size = np.maximum(counted[ends] - counted[starts], 1)
        again = _per(of_word[_not_first(hashes, of_word)], m) if m else np.zeros(0)
        upper = within((data >= 65) & (data <= 90))
        letters = np.maximum(within(((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 0xC3)), 1)
        count = np.maximum(self.words, 1)
        self.x = np.stack([
            np.ones(m),
            np.log1p(self.words) / 4,
            np.minimum(within(SYMBOLS[data]) / count, 3),
            upper / letters,
            np.minimum(within(data == 33) / count, 3),
            _per(of_word, m, chars) / count / 10,
            doubled.astype(float),
            again / count,
            _per(of_word, m, repeated.astype(float)) / count,
            np.minimum(within((data >= 48) & (data <= 57)) / size, 1),
            STOPS[data[np.maximum(ends - 1, 0)]].astype(float) if m else np.zeros(0),
        ], axis=1) if m else np.zeros((0, N_FEATURES))
        self.n = n
        self.base_failed = (self.n_words < 50) | (100 * self.n_repeat_words > 50 * self.n_words)


def _padded(doc: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each line in a (sequence, position) grid; ``longest`` cuts sequences into pieces."""
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0)) if len(doc) else doc
    column = np.arange(len(doc)) - begin
    if longest:
        first, column = first | (column % longest == 0), column % longest
    return np.cumsum(first) - 1, column


def viterbi(x: np.ndarray, doc: np.ndarray, model: dict) -> np.ndarray:
    """Best labels (1 content, 0 boilerplate) of all lines; all texts advance together, position by position."""
    if not len(x):
        return np.zeros(0, np.int64)
    row, column = _padded(doc)
    scores = x @ model["weights"].T
    order = np.lexsort((row, column))
    bounds = np.searchsorted(column[order], np.arange(column.max() + 2))
    best, back = np.zeros((row.max() + 1, 2)), np.zeros((len(x), 2), np.int8)
    for p in range(column.max() + 1):
        lines = order[bounds[p] : bounds[p + 1]]
        r = row[lines]
        if p:
            arrive = best[r][:, :, None] + model["moves"][None]
            back[lines] = arrive.argmax(1)
            best[r] = arrive.max(1) + scores[lines]
        else:
            best[r] = scores[lines]
    labels = np.zeros(len(x), np.int64)
    last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
    state = np.zeros(row.max() + 1, np.int64)
    state[row[last]] = best[row[last]].argmax(1)
    for p in range(column.max(), -1, -1):
        lines = order[bounds[p] : bounds[p + 1]]
        labels[lines] = state[row[lines]]
        state[row[lines]] = back[lines, labels[lines]]
    return labels


def fit(x: np.ndarray, doc: np.ndarray, y: np.ndarray, rounds: int = 80, ridge: float = 1e-3, longest: int = 32) -> dict:
    """Maximum-likelihood weights of the chain CRF by Adam steps; gradients come from the forward-backward recursion."""
    row, column = _padded(doc, longest)
    n, length = row.max() + 1, column.max() + 1
    grid, mask, gold = np.zeros((length, n, x.shape[1])), np.zeros((length, n)), np.zeros((length, n), np.int64)
    grid[column, row], mask[column, row], gold[column, row] = x, 1, y
    weights, moves = np.zeros((2, x.shape[1])), np.zeros((2, 2))
    one = np.eye(2)[gold] * mask[..., None]
    steps = mask[1:] * mask[:-1]
    seen = np.einsum("tni,tnj,tn->ij", one[:-1], one[1:], steps)
    m, v = [0, 0], [0, 0]
    lse = lambda a, axis: (lambda top: np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis)) + top)(a.max(axis))
    for t in range(1, rounds + 1):
        s = grid @ weights.T
        forward, backward = np.zeros((length, n, 2)), np.zeros((length, n, 2))
        forward[0] = s[0]
        for p in range(1, length):
            forward[p] = np.where(mask[p][:, None] > 0, lse(forward[p - 1][:, :, None] + moves, 1) + s[p], forward[p - 1])
        for p in range(length - 2, -1, -1):
            backward[p] = np.where(mask[p + 1][:, None] > 0, lse(moves + (s[p + 1] + backward[p + 1])[:, None, :], 2), backward[p + 1])
        norm = lse(forward[-1], 1)
        marginal = np.exp(np.minimum(forward + backward - norm[None, :, None], 0)) * mask[..., None]
        pair = forward[:-1][..., None] + moves + (s[1:] + backward[1:])[:, :, None, :] - norm[None, :, None, None]
        expected = (np.exp(np.minimum(pair, 0)) * steps[..., None, None]).sum((0, 1))
        total = mask.sum()
        for i, (theta, gradient) in enumerate(((weights, np.einsum("tnk,tnf->kf", one - marginal, grid) / total - ridge * weights), (moves, (seen - expected) / total - ridge * moves))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * gradient, 0.99 * v[i] + 0.01 * gradient**2
            theta += 0.2 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return {"weights": weights, "moves": moves}


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 1200, max_train_bytes: int = 1 << 17, passes: int = 2) -> dict | None:
    """The fitted CRF, or None without labelled documents of both kinds. Only features of the sample reach the driver."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    kinds = [bounded_sample(known.filter(rule), "doc_id", max_train_docs // 2) for rule in ("quality > 0", "quality <= 0")]
    sample = kinds[0].union(kinds[1]).select(F.col("doc_id").alias("of"), F.col("quality").cast("int").alias("good"))
    chosen = docs.select("doc_id", "text").filter(F.octet_length("text") <= max_train_bytes).join(F.broadcast(sample), F.col("doc_id") == F.col("of")).select("text", "good")

    def features(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                lines = Lines(batch.column("text"))
                edges = np.searchsorted(lines.doc, np.arange(lines.n + 1))
                x = lines.x.astype("<f4")
                blobs = [x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(blobs, pa.binary())], names=["good", "x"])

    rows = chosen.mapInArrow(features, "good int, x binary").collect()
    rows = sorted((r for r in rows if r.x), key=lambda r: (r.good, bytes(r.x)))
    if {r.good > 0 for r in rows} != {True, False}:
        return None
    parts = [np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES).astype(float) for r in rows]
    x, doc = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    good = np.repeat([r.good > 0 for r in rows], [len(p) for p in parts])
    y = good.astype(np.int64)
    for i in range(passes):
        model = fit(x, doc, y)
        if i + 1 < passes:
            margin = x @ (model["weights"][1] - model["weights"][0])
            order = np.lexsort((margin, doc))
            place = np.zeros(len(x), np.int64)
            place[order] = _padded(doc)[1]
            worse = place < (np.bincount(doc)[doc] + 1) // 2
            y = np.where(good, 1, np.where(worse, 0, viterbi(x, doc, model)))
    return model


def annotate(docs: DataFrame, model: dict | None, min_content: float = 0.5) -> DataFrame:
    """``docs`` with the struct column ``quality``: base statistics, content share and verdict."""

    def judge(batch: pa.RecordBatch) -> pa.StructArray:
        lines = Lines(batch.column("text"))
        label = viterbi(lines.x, lines.doc, model) if model else np.ones(len(lines.x), np.int64)
        share = _per(lines.doc, lines.n, lines.words * label) / np.maximum(lines.n_words, 1)
        kept = ~lines.base_failed & (share >= min_content)
        return struct_array(FIELDS, [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words, lines.base_failed, share, kept])

    return add_struct(docs, "quality", FIELDS, judge)


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, base statistics, base_failed, kept, content_share) of each document."""
    judged = annotate(docs.select("doc_id", "text"), train(docs, labels, **options))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
    return judged.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    columns = docs.columns
    model = train(docs, labels, **options)
    return annotate(shielded(docs, "doc_id", "text"), model).filter("quality.kept").drop("quality").toDF(*columns)
