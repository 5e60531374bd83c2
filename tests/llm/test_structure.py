"""Near-dedup, suffix dedup, chat repair, WARC and the pipeline against brute force and exact round trips."""

import base64
import hashlib
import io
import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from tidecohort.llm import chat, decontam, minhash, queries, secrets, substrings, warc
from tidecohort.llm.common import materialize

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def texts(spark, *values):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(values)], DOC)


def bag(text):
    words = WORD.findall(text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def weighted(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in set(a) & set(b))


def near_groups(rows, threshold=0.8):
    bags, head = {i: bag(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for x, y in itertools.combinations(sorted(bags), 2):
        a, b = bags[x], bags[y]
        if a and b and sum((a & b).values()) >= 0.5 * max(sum(a.values()), sum(b.values())) and weighted(a, b) >= threshold:
            head[max(top(x), top(y))] = min(top(x), top(y))
    return {i: top(i) for i in bags}


def copies(seed, groups, size, edits, words=120):
    rng, out = np.random.default_rng(seed), []
    for g in range(groups):
        text = [f"w{x}" for x in rng.integers(0, 3000, words)]
        for _ in range(size):
            changed = list(text)
            for at in rng.choice(words, edits, replace=False):
                changed[at] = f"e{rng.integers(0, 10**6)}"
            out.append(" ".join(changed))
        out.append(" ".join(f"w{x}" for x in rng.integers(0, 3000, words)))
    return out


def test_near_groups_equal_brute_force(spark):
    docs = table(spark, "documents").union(spark.createDataFrame([(10_000 + i, t, "en", "s", 0) for i, t in enumerate([None, "", "a b", "a b", "a  b", "a b c", *copies(1, 6, 5, 2), *copies(2, 4, 4, 4)])], DOC))
    found = {r.doc_id: r.group_id for r in minhash.groups(docs).collect()}
    assert found == near_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD", 4)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    docs = texts(spark, *copies(3, 2, 40, 3), *copies(4, 3, 6, 2))
    found = {r.doc_id: r.group_id for r in minhash.groups(docs).collect()}
    assert found == near_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_probability_jaccard_and_registers():
    rng = np.random.default_rng(0)
    a, b = Counter(dict(zip("abcdefg", (1, 2, 3, 1, 5, 1, 2), strict=True))), Counter(dict(zip("cdefgxy", (2, 1, 4, 1, 2, 3, 1), strict=True)))
    names = sorted(set(a) | set(b))
    keys = {n: np.uint64(k) for n, k in zip(names, np.sort(rng.integers(1, 1 << 60, len(names))), strict=True)}
    arrays = lambda c: (np.array([keys[n] for n in names if n in c]), np.array([c[n] for n in names if n in c]))
    assert minhash.probability_jaccard(*arrays(a), *arrays(b)) == pytest.approx(weighted(a, b))
    long = ["x y z w v " * 3 + " ".join(f"t{k}" for k in range(60)), "x y z w v " * 2 + " ".join(f"t{k}" for k in range(4, 60))]
    s = minhash.Shingled(pa.array(long))
    rows = minhash.signatures(s, 4000)
    assert abs((rows[0] == rows[1]).mean() - weighted(bag(long[0]), bag(long[1]))) < 0.04


def test_keep_one_and_edges(spark):
    docs = texts(spark, "a b c d e f", "a b c d e f", None, "").union(spark.createDataFrame([(None, "a b c d e f", None, None, None), (7, "q r s", None, None, None), (7, "q r s", None, None, None)], DOC)).selectExpr("*", "1 AS component", "2 AS id")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [0, 2, 3, 7, None]
    assert minhash.groups(docs.limit(0)).count() == 0 and len(minhash.groups(docs).collect()) == 7


def cut(rows, length=50):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def planted(seed=0):
    rng = np.random.default_rng(seed)
    piece = lambda n: "".join(rng.choice(list("abcdé "), n))
    passages = [piece(n) for n in (49, 50, 51, 80, 300)]
    out = [piece(rng.integers(0, 60)) + "".join(rng.choice(passages) + piece(rng.integers(0, 5)) for _ in range(rng.integers(0, 4))) + piece(rng.integers(0, 90)) for _ in range(60)]
    return [*out, None, "", "é" * 25, "é" * 25, "z" * 400, "z" * 400, "z" * 120]


def test_suffix_dedup_equals_brute_force(spark):
    small = table(spark, "documents").select("doc_id", "text")
    for docs in (small, texts(spark, *planted())):
        rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.report(docs).collect()}
        assert rows == cut([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_suffix_buckets_compare_across_boundaries(spark):
    text = "".join(chr(97 + (k * k) % 23) for k in range(200))
    rows = [(text.encode()[p : p + 50], d, 0, p) for d in range(40) for p in range(0, 150, 30)]
    found = substrings.covered_suffixes(spark.createDataFrame(rows, "suffix binary, doc_id long, row long, at long"), 50, 12).collect()
    covered = {(r.doc_id, int(p)) for r in found for p in np.frombuffer(r.stretches, "<i8").reshape(-1, 2)[:, 0]}
    assert covered == {(d, p) for _, d, _, p in rows if d}


def test_suffix_buckets_pack_what_they_cover(spark):
    """A bucket had a row for each document that it touches before, which is one for each string once there are many buckets."""
    rng = np.random.default_rng(5)
    strings = [bytes(x) for x in rng.integers(0, 256, (60, 50)).astype(np.uint8)]
    rows = [(x, d, 7 - d, at) for d in range(80) for at, x in enumerate(strings)]
    suffixes = spark.createDataFrame(rows, "suffix binary, doc_id long, row long, at long")
    dealt = substrings._sorted_buckets(suffixes.repartitionByRange(10, "suffix", "doc_id", "row", "at"), 50, 3)
    assert dealt.count() <= 10 * (1 + 2 * 3)
    found = substrings.covered_suffixes(suffixes, 50, 10).collect()
    assert sorted((r.doc_id, r.row, r.undecided) for r in found) == [(d, 7 - d, False) for d in range(1, 80)]
    assert all(np.frombuffer(r.stretches, "<i8").tolist() == [0, 60] for r in found)


def test_multikey_order_sorts():
    rng = np.random.default_rng(1)
    strings = rng.integers(0, 3, (500, 20)).astype(np.uint8)
    assert [tuple(x) for x in strings[substrings.multikey_order(strings)]] == sorted(map(tuple, strings))


def test_suffix_dedup_edges(spark):
    docs = spark.createDataFrame([(None, "k" * 90), (3, "k" * 90), (3, "k" * 90), (5, "k" * 90)], "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS stretches")
    rows = sorted(((r.doc_id, r.n_removed) for r in substrings.report(docs).collect()), key=str)
    assert rows == [(3, 0), (3, 0), (5, 90), (None, 0)]
    assert substrings.report(docs.limit(0)).count() == 0


def cheapest(roles, costs):
    """Least cost of a repair, by trying every choice of states and insertions."""
    best = float("inf")
    for states in itertools.product((1, 2, 3), repeat=len(roles)):
        total = sum(costs.price(r, s) for r, s in zip(roles, states, strict=True))
        for a, b in zip((0, *states), states):
            total += min([m[4] for m in costs.moves if m[:2] == (a, b)], default=float("inf"))
        best = min(best, total + costs.closing[states[-1]])
    return best


def test_repair_is_cheapest_and_legal(spark):
    rng, rows = np.random.default_rng(8), []
    names = ["system", "user", "assistant", "User ", "tool", None]
    for conv in range(60):
        rows += [(conv, t, names[rng.integers(0, 6)], f"t{t}") for t in range(rng.integers(1, 7))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "2 AS n")
    out = chat.repair(frame).toPandas().sort_values(["conv_id", "position"])
    costs = chat.Costs()
    for conv, own in out.groupby("conv_id"):
        paid = sum((1.0 if "merge" in a else 0.0) + (2.0 if "relabel" in a else 0.0) for a in own["action"]) + 3.0 * own["inserted_before"].notna().sum() + 3.0 * sum(len(x.split(",")) for x in own["inserted_after"].dropna())
        assert paid == cheapest([r for c, _, r, _ in rows if c == conv], costs)
        roles = re.findall(r"<\|(system|user|assistant)\|>\n", "".join(own["rendered"]))
        turns = roles[1:] if roles[0] == "system" else roles
        assert turns == ["user", "assistant"] * (len(turns) // 2) and turns
        assert re.findall(r"t\d+", "".join(own["rendered"])) == [t for c, _, _, t in rows if c == conv]


def test_one_long_conversation_crosses_partitions(spark):
    rng = np.random.default_rng(9)
    rows = [(1, t, str(rng.choice(["user", "assistant", "system", "x"])), "") for t in range(700)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = chat.repair(frame).toPandas().sort_values("position")
        found.append(sum(("merge" in a) + 2 * ("relabel" in a) for a in out["action"]) + 3 * out["inserted_before"].notna().sum())
        assert out["position"].tolist() == list(range(700))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]
    assert chat.repair(frame.limit(0)).count() == 0


def test_warc_round_trip_equals_sql(spark):
    rows = queries.QUERIES["op5_warc"](spark, SMALL).toPandas().sort_values("page_id").reset_index(drop=True)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    theirs = duck.sql(queries.ORACLES["op5_warc"]).df().sort_values("page_id").reset_index(drop=True)[list(rows.columns)]
    pd.testing.assert_frame_equal(rows, theirs, check_dtype=False)


def test_warc_payloads_and_references(spark):
    pages = spark.createDataFrame([(3, "u", "x"), (1, "v w", "x"), (2, None, "é" * 5000), (5, "u", None), (6, "u", ""), (None, "n", "x"), (9, "big", "\r\n\r\n" * 90_000)], "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first")
    out = {r.page_id: r for r in warc.read(warc.write(pages, max_archive_bytes=100), payloads=True).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in out.items()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 5: ("response", None), 6: ("revisit", 5), None: ("revisit", 1), 9: ("response", None)}
    for k, html in ((1, "x"), (2, "é" * 5000), (5, ""), (9, "\r\n\r\n" * 90_000)):
        assert bytes(out[k].payload) == html.encode() and out[k].payload_bytes == len(html.encode())
        assert out[k].payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert all(r.verified for r in out.values())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_reports_damage():
    good = [warc.record(i, "u", b"payload" * 50, None, "2024-01-01T00:00:00Z") for i in range(3)]
    assert [r[0] for r in warc.records(io.BytesIO(b"".join(good)))] == [0, 1, 2]
    bad = warc.zlib.compressobj(6, warc.zlib.DEFLATED, 31)
    plain = warc.zlib.decompress(good[0], 31).replace(b"payloadpayload", b"payloadPAYLOAD", 1)
    assert [r[6] for r in warc.records(io.BytesIO(bad.compress(plain) + bad.flush() + good[1]))] == [False, True]
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(b"".join(good)[:-20])))


def test_pipeline_stages(spark):
    docs = table(spark, "documents")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(materialize(stage(spark, seen[-1], SMALL)))
        assert seen[-1].columns == columns
    rows = [{r.doc_id: r.text for r in d.collect()} for d in seen]
    judged = queries.QUERIES["op4_quality_rules"](spark, SMALL).filter("kept")
    assert set(rows[1]) == {r.doc_id for r in judged.collect()}
    groups = near_groups(list(rows[1].items()))
    assert set(rows[2]) == set(groups.values())
    leaks = {r.doc_id for r in decontam.report(seen[2], table(spark, "benchmark")).collect()}
    assert set(rows[3]) == set(rows[2]) - leaks and leaks
    assert set(rows[4]) == set(rows[3]) and all(rows[4][i] == rows[3][i] for i in rows[4] if "[SECRET]" not in rows[4][i])
    masked = {r.doc_id for r in secrets.report(seen[3]).filter("spans <> ''").collect()}
    assert {i for i in rows[4] if rows[4][i] != rows[3][i]} == masked
    last = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(last["doc_id"]) == set(rows[4]) and (last["taken"] <= 2 * last["size"]).all()
