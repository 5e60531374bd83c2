"""Line dedup, source divergence and importance resampling against brute force over small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidecohort.llm import divergence, linededup, resample

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOC)


def texts(spark, rows):
    return frame(spark, [(i, t, "en", "s") for i, t in rows])


def deduplicated(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    rank = lambda i: -(2**63) if i is None else i
    for i, found in lines:
        for line in found:
            holders[key(line)].add(rank(i))
    out = []
    for i, found in lines:
        kept = [x for x in found if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and rank(i) != max(holders[key(x)]))]
        out.append((i, len(found), len(found) - len(kept), "\n".join(kept)))
    return out


def digested(rows):
    return sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in rows), key=repr)


def some_lines(seed, n):
    rng = np.random.default_rng(seed)
    pool = [f"line number {k} of the shared pool" for k in range(40)] + ["  Licensed under the Same Terms \t", "licensed under the same terms", "short", "", "ÄÖ überall gleiche Zeile hier", "äÖ überall gleiche Zeile hier"]
    out = []
    for i in range(n):
        chosen = [pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 12))]
        out.append((int(rng.permutation(n)[0]) if i % 17 == 5 else i, "\n".join([*chosen, "the one line that every document holds"] if i % 3 else chosen)))
    return out


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_line_dedup_equals_brute_force(spark, partitions):
    rows = [*some_lines(1, 200), (None, "the one line that every document holds"), (None, None), (7, ""), (900, "\n\n"), *[(901, "the one line that every document holds\nx")] * 3, (5, "\x85 not a blank that is stripped here \x85")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = linededup.report(texts(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted([tuple(r) for r in found], key=repr) == digested(deduplicated(rows))


@pytest.mark.parametrize("seed", range(12))
def test_runs_across_batches_and_partitions(seed):
    """Records cut anywhere into batches and partitions: the same lines go."""
    rng = np.random.default_rng(seed)
    n, least = int(rng.integers(1, 120)), int(rng.integers(2, 5))
    rows = np.stack([rng.choice(5, n, p=[0.6, 0.1, 0.1, 0.1, 0.1]), np.zeros(n), rng.integers(0, rng.integers(1, 9) + 1, n), rng.integers(0, 2, n), np.full(n, 9), rng.integers(0, 9, n)], axis=1).astype(np.int64)
    rows = rows[np.lexsort([rows[:, 5], rows[:, 3], -rows[:, 2], rows[:, 0]])]
    gone, opened, docs = [], [], defaultdict(set)
    for part in np.split(rows, np.sort(rng.integers(0, n + 1, 4))):
        runs = linededup._Runs(least)
        found = [f for piece in np.split(part, np.sort(rng.integers(0, len(part) + 1, 3))) for f in runs.feed(piece)] + list(runs.finish())
        for kind, records, seen in found:
            if kind == linededup.EDGE:
                docs[records[0, 0]] |= set(seen)
            (gone if kind == linededup.DROP else opened if kind == linededup.OPEN else []).extend(map(tuple, records))
    gone += [r for r in opened if len(docs[r[0]]) >= least and r[2] != max(docs[r[0]])]
    holders = defaultdict(set)
    for r in rows:
        holders[r[0]].add(r[2])
    assert sorted(gone) == sorted(tuple(r) for r in rows if len(holders[r[0]]) >= least and r[2] != max(holders[r[0]]))


def test_line_bitmaps_and_texts(spark):
    rows = some_lines(2, 60)
    docs = texts(spark, rows).selectExpr("*", "1 AS id", "2 AS t", "3 AS keep", "4 AS n_lines")
    expected = {(i, t) for i, _, _, t in deduplicated(rows)}
    cleaned = linededup.clean(docs)
    assert cleaned.columns == docs.columns and {(r.doc_id, r.text) for r in cleaned.collect()} == expected
    maps = linededup.bitmaps(docs).collect()
    assert maps and all(r.n_lines - linededup.unpack(r.keep, r.n_lines).sum() == r.n_dropped > 0 for r in maps)
    assert len(max((r.keep for r in maps), key=len)) < 40


def test_line_dedup_edges(spark):
    assert linededup.report(texts(spark, [])).count() == 0 and linededup.clean(texts(spark, [])).count() == 0
    long = "\n".join(["a line that repeats without an end"] * 100_000)
    rows = [(1, long), (2, long), (3, "a line that repeats without an end\nx"), (4, "y" * 2_000_000)]
    found = {r.doc_id: r for r in linededup.report(texts(spark, rows)).collect()}
    assert [found[i].n_dropped for i in (1, 2, 3, 4)] == [100_000, 100_000, 0, 0]
    assert found[1].kept_sha256 == hashlib.sha256(b"").hexdigest() and found[4].n_lines == 1
    with pytest.raises(ValueError, match="min_docs"):
        linededup.bitmaps(texts(spark, rows), min_docs=1)


TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def diverging(rows, min_docs=10, top=10):
    """The contract's sums, term by term over dense counts."""
    rows = [((t or "").translate(LOWER), lang or "", source or "") for _, t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(Counter(TERM.findall(t)), s) for t, g, s in rows if g == lang]
        kept = [t for t, n in Counter(t for c, _ in own for t in c).items() if n >= min_docs]
        counts = {s: Counter() for _, s in own}
        for c, s in own:
            counts[s].update({t: n for t, n in c.items() if t in set(kept)})
        v = len(kept)
        n_of = {s: sum(c.values()) for s, c in counts.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (n_of[s] + 2 * v) for t in kept} for s, c in counts.items()}
        q = {t: 1 + 10**9 * (sum(c[t] for c in counts.values()) + 2) // (sum(n_of.values()) + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [("term", t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for found, most in ((pairs, None), (terms, top)):
                ordered = sorted(found, key=lambda r: (-r[2], r[1].encode()))[:most]
                out += [(lang, s, *r, k + 1) for k, r in enumerate(ordered)]
    return sorted(out)


def audited(seed, n=300):
    rng = np.random.default_rng(seed)
    words = np.array(["Tide", "moon", "naïve", "ÄÖ", "über", "x1y", "RIVER", "stone-cold", "日本", "a", *[f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]])
    weights = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, rng.integers(0, 40), p=weights / weights.sum()))
        rows.append((i, text, [None, "", "en", "de", "xx"][rng.integers(0, 5)], [None, "s1", "s2", "zé", "hot", "hot", "hot"][rng.integers(0, 7)]))
    return [*rows, (1, None, "en", "s1"), (2, "", "only", "one"), (3, "once", "two", "a"), (3, None, "two", "b"), (None, "tide", "en", "no terms kept here")]


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(divergence, "HELD", 300)
    rows = audited(seed)
    found = divergence.report(frame(spark, rows).selectExpr("*", "1 AS term", "2 AS n", "3 AS p")).collect()
    assert sorted(tuple(r) for r in found) == diverging(rows)
    assert {r.part for r in found} == {"pair", "term"} and any(r.part == "pair" and r.value == 0 for r in found)


def test_divergence_without_broadcast_and_with_few_pairs_held(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_GROUPS", 0)
    monkeypatch.setattr(divergence, "MOST_PAIRS", 3)
    rows = audited(3)
    assert sorted(tuple(r) for r in divergence.report(frame(spark, rows)).collect()) == diverging(rows)


def test_divergence_edges(spark):
    assert divergence.report(frame(spark, [])).count() == 0
    long = "tide " * 400_000 + "x" * 1_500_000
    rows = [(i, long if i < 12 else "moon", "en", f"s{i % 2}") for i in range(24)]
    found = {(r.source, r.part, r.item): r.value for r in divergence.report(frame(spark, rows)).collect()}
    assert found["s0", "pair", "s1"] == found["s1", "pair", "s0"] == 0
    assert next(divergence.pieces(b"a" * 3_000_000)) == b"a" * 3_000_000
    cut = list(divergence.pieces(b"tide moon " * 300_000))
    assert b"".join(cut) == b"tide moon " * 300_000 and len(cut) > 2 and not any(c.startswith((b"ide", b"oon")) for c in cut)


def test_shares_are_exact_beyond_long(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(10**15, 3 * 10**15, 10**6), (0, 0, 0)], "n long, held long, v long")
    found = [r[0] for r in rows.select(divergence.share(F.col("n"), F.col("held"), F.col("v"))).collect()]
    assert found == [1 + 10**9 * (10**15 + 2) // (3 * 10**15 + 2 * 10**6), None]


def resampled(rows, target, min_words=20, percent=10, seed=2024, buckets=10_000, max_n=1):
    def features(t):
        words = WORD.findall((t or "").translate(LOWER))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in rows:
        n, found = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def shelf(seed, n=150):
    rng = np.random.default_rng(seed)
    words = [*"the Tide of moon and 42 river2 naïve ÄÖ 日本 x_y".split(), *[f"w{k}" for k in range(80)]]
    return [(int(i), " ".join(rng.choice(words, rng.integers(0, 60)))) for i in rng.permutation(n)]


@pytest.mark.parametrize("max_n", [1, 2])
def test_resampling_equals_brute_force(spark, monkeypatch, max_n):
    monkeypatch.setattr(resample, "SLICE_BYTES", 500)
    rows = [*shelf(1), (None, "tide " * 30), (None, None), (900, ""), *[(901, "moon and river " * 10)] * 2]
    target = ["The tide of w1 w2 w3", "naïve moon w1", None]
    docs = texts(spark, rows).selectExpr("*", "1 AS key", "2 AS score", "3 AS slice")
    found = resample.report(docs, spark.createDataFrame([(t,) for t in target], "text string"), max_n=max_n, percent=40)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == resampled(rows, target, max_n=max_n, percent=40)


def test_resampling_edges(spark):
    items = spark.createDataFrame([("tide",)], "text string")
    assert resample.report(texts(spark, []), items).count() == 0
    rows = [(i, "tide moon river stone " * 6) for i in range(30)]
    assert sorted((tuple(r) for r in resample.report(texts(spark, rows), items.limit(0)).collect()), key=repr) == resampled(rows, [])
    long = [(1, "word " * 500_000), (2, "y" * 2_000_000), (3, "tide " * 25)]
    assert sorted((tuple(r) for r in resample.report(texts(spark, long), items, percent=67).collect()), key=repr) == resampled(long, ["tide"], percent=67)


def test_drawn_documents_are_near_the_target(spark):
    rng = np.random.default_rng(3)
    near, far = [f"n{k}" for k in range(50)], [f"f{k}" for k in range(50)]
    rows = [(i, " ".join(rng.choice(near if i % 5 == 0 else far, 40))) for i in range(400)]
    items = spark.createDataFrame([(" ".join(rng.choice(near, 200)),)], "text string")
    drawn = resample.resample(texts(spark, rows).selectExpr("*", "7 AS rank"), items)
    assert drawn.columns[-2:] == ["rank", "sample_rank"]
    ids = [r.doc_id for r in drawn.collect()]
    assert len(ids) == 40 and all(i % 5 == 0 for i in ids)
