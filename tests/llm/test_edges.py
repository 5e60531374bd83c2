"""Edge cases that all training-data operators share: empty tables, null ids, very long texts, ties, hash patterns, hot groups."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidecohort.llm import chat, common, decontam, langid, minhash, mixing, quality, secrets, substrings, toxicity, warc
from tidecohort.llm.vectext import Batch

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


def reports(spark, docs, labels, items):
    """Every operator's report over documents, by name."""
    return {
        "secrets": secrets.report(docs), "near": minhash.groups(docs), "quality": quality.report(docs, labels), "substrings": substrings.report(docs), "mixing": mixing.mix(docs),
        "toxicity": toxicity.report(docs, labels), "leaks": decontam.report(docs, items), "language": langid.report(docs),
    }


@pytest.fixture(scope="module")
def small(spark):
    words = np.random.default_rng(1).choice(["tide", "moon", "river", "stone", "idiot", "quiet", "harbour"], (40, 70))
    docs = frame(spark, [(i, " ".join(w)) for i, w in enumerate(words)])
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(40)], LABEL)
    return docs, labels, spark.createDataFrame([(1, "tide moon river stone quiet harbour bell rope sand")], ITEMS)


def test_empty_documents_give_empty_results(spark, small):
    docs, labels, items = small
    for name, found in reports(spark, docs.limit(0), labels, items).items():
        assert found.count() == 0, name
    assert decontam.report(docs, items.limit(0)).count() == 0
    assert quality.keep(docs.limit(0), labels).count() == 0 and secrets.redact(docs.limit(0)).count() == 0
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_null_ids_and_repeated_rows_have_results(spark, small):
    docs, labels, items = small
    odd = docs.union(frame(spark, [(None, "tide moon river stone quiet harbour bell rope sand"), (None, None), (3, "again"), (3, "again")]))
    for name, found in reports(spark, odd, labels, items).items():
        rows = found.collect()
        assert len(rows) == 44 or name == "leaks", name
        assert any(r.doc_id is None for r in rows), name
    assert toxicity.report(odd, labels).filter("doc_id IS NULL AND NOT held_out").count() == 2


def test_very_long_texts(spark, small):
    docs, labels, items = small
    rng = np.random.default_rng(2)
    long = " ".join(rng.choice([f"word{i}" for i in range(5000)], 400_000))
    one_word, one_line = "x" * 3_000_000, "tide moon river stone quiet harbour bell rope sand " + "tide " * 600_000
    big = docs.union(frame(spark, [(100, long), (101, one_word), (102, one_line), (103, long)]))
    found = {name: {r.doc_id: r for r in df.collect()} for name, df in reports(spark, big, labels, items).items()}
    assert found["near"][103].group_id == 100 and found["near"][101].group_id == 101
    assert found["substrings"][103].n_removed == len(long) and found["substrings"][101].n_removed == 0
    assert found["quality"][100].n_words == 400_000 and not found["quality"][102].kept
    assert found["leaks"].keys() >= {102} and found["leaks"][102].score == 1
    assert found["mixing"][102].size == 600_009 and found["secrets"][101].n_hex == 0
    assert found["language"][100].lang_pred == "en" and 0 <= found["toxicity"][100].score <= 1


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


def test_patterns_that_cancel_in_polynomials_are_told_apart(spark):
    a, b = thue_morse(2048)
    lines = quality.Lines(pa.array([f"{a}\n{b}", f"{a}\n{a}"]))
    assert lines.n_dup_lines.tolist() == [0, 1]
    s = minhash.Shingled(pa.array([a, b, a]))
    assert s.sequence[0] != s.sequence[1] and s.second[0] != s.second[1]
    assert (s.sequence[0], s.second[0]) == (s.sequence[2], s.second[2])
    assert {r.doc_id: r.class_id for r in minhash.groups(frame(spark, [(1, a), (2, b), (3, a)])).collect()} == {1: 1, 2: 2, 3: 1}


def test_word_hashes_do_not_depend_on_their_place():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abé"), rng.integers(1, 30))) for _ in range(300)]
    b = Batch(pa.array([" ".join(words), "  ".join(reversed(words))]))
    b.words()
    for salt in (0, 1):
        h = b.word_hashes(salt)
        assert h[:300].tolist() == h[300:][::-1].tolist()
        assert len(set(h[:300].tolist())) == len(set(words))


def test_all_of_many_languages_can_be_predicted(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(201):
        own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(6)]
        rows += [(8 * k + i, " ".join(rng.permutation(own)), f"l{k:03d}", "s", 0) for i in range(8)]
    docs = spark.createDataFrame(rows, DOC)
    model = langid.train(docs)
    assert len(model["langs"]) == 201
    out = langid.annotate(docs, model).select("lang", "language.lang_pred").toPandas()
    assert (out["lang"] == out["lang_pred"]).all()


def test_language_scores_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = {lang: ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(30)] for lang, letters in (("aa", "abcdeé"), ("bb", "cdefgß"))}
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang, "s", 0) for i in range(60) for lang in ("aa" if i % 3 else "bb",)]
    docs = spark.createDataFrame(rows, DOC)
    model = langid.train(docs)
    held = [r for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 4 != 2]
    counts = {n: {} for n in range(5)}
    for _, text, lang, _, _ in held:
        for w in text.split():
            for n in range(5):
                for g in [w] if n == 0 else [w[i : i + n] for i in range(len(w) - n + 1)]:
                    counts[n].setdefault(g, {}).setdefault(lang, 0)
                    counts[n][g][lang] += 1
    counts[0] = {w: c for w, c in counts[0].items() if sum(c.values()) > 1}
    total = {n: {lang: sum(c.get(lang, 0) for c in counts[n].values()) for lang in ("aa", "bb")} for n in counts}
    log = lambda n, g, lang: np.log((counts[n][g].get(lang, 0) + langid.UNSEEN) / (total[n][lang] + langid.UNSEEN * len(counts[n])))

    def score(text, lang):
        out = 0.0
        for w in text.split():
            if w in counts[0]:
                out += log(0, w, lang)
                continue
            for n in range(4, 0, -1):
                known = [w[i : i + n] for i in range(len(w) - n + 1) if w[i : i + n] in counts[n]]
                if known:
                    out += np.mean([log(n, g, lang) for g in known])
                    break
        return out

    asked = [t for _, t, *_ in rows[:20]] + ["abcd cdef zzz", "éé ßg", "abzcd"]
    ours = langid.scores(langid.Words(pa.array(asked)), model)
    for i, text in enumerate(asked):
        for k, lang in enumerate(model["langs"]):
            assert ours[i, k] == pytest.approx(score(text, lang), abs=1e-6)


def cut(rows, length=50):
    first = {}
    for i, t in rows:
        for p in range(len(t) - length + 1):
            first[t[p : p + length]] = min(first.get(t[p : p + length], i), i)
    out = {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = True
        out[i] = (int(gone.sum()), hashlib.sha256("".join(c for c, g in zip(t, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_a_line_in_a_third_of_all_documents_goes_to_no_bucket(spark, monkeypatch):
    rng = np.random.default_rng(6)
    prose = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line = prose(180)
    rows = [(i, prose(60) + (line if i % 3 == 0 else "") + prose(40)) for i in range(600)]
    docs = frame(spark, rows).repartition(6)
    dealt, settle = [], substrings._deal
    monkeypatch.setattr(substrings, "_deal", lambda d, buckets, length, gram, hot: dealt.append((buckets, hot)) or settle(d, buckets, length, gram, hot))
    found = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.report(docs).collect()}
    assert found == cut(rows)
    buckets, hot = dealt[0]
    assert len(hot), "the runs around the line's edges are hot"
    named = docs.selectExpr("doc_id", "text", "xxhash64(text) AS row")
    record = substrings.RECORD.itemsize
    sizes = settle(named, buckets, 50, 16, hot).groupBy("bucket").agg({"records": "count"}).count(), [sum(len(r.records) for r in rows) / record for rows in [settle(named, buckets, 50, 16, hot).collect()]]
    per = {}
    for r in settle(named, buckets, 50, 16, hot).collect():
        for g in np.frombuffer(bytes(r.records)[: len(r.records) // record * 5], np.uint8).reshape(-1, 5) if r.records else ():
            per[bytes(g)] = per.get(bytes(g), 0) + 1
    assert sizes and max(per.values()) <= 200 / 4, "no anchor keeps a record for every document that holds the line"


def test_a_line_once_in_every_piece_of_text_is_hot(spark):
    """Equal runs of a piece leave one; an anchor with one run in each of many pieces must not fill a bucket either."""
    rng = np.random.default_rng(9)
    prose = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line = prose(400)
    rows = [(i, prose(60) + line + prose(60)) for i in range(48)]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "xxhash64(text) AS row").repartition(48, "doc_id")
    size, buckets = sum(len(t) for _, t in rows), 4
    hot = substrings._hot_anchors(docs, size, buckets * 40, 50, 16)
    inside = substrings.runs(Batch(pa.array([line])), 50, 16)["g"] & np.uint64((1 << 40) - 1)
    assert len(inside) > 10 and np.isin(inside, hot).mean() > 0.9
    dealt = substrings._deal(docs, buckets, 50, 16, hot).collect()
    per = {}
    for r in dealt:
        n = len(r.records) // substrings.RECORD.itemsize
        for g in np.frombuffer(bytes(r.records)[: 5 * n], np.uint8).reshape(-1, 5):
            per[bytes(g)] = per.get(bytes(g), 0) + 1
    assert max(per.values()) <= substrings.LEAST_HITS
    found = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.report(frame(spark, rows)).collect()}
    assert found == cut(rows)


def test_hot_buckets_of_near_copies_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT", 5)
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 500, 100)]
    copies = [" ".join("edit" if k == at else w for k, w in enumerate(base)) for at in range(30)]
    other = [" ".join(f"w{x}" for x in rng.integers(0, 500, 100)) for _ in range(30)]
    found = {r.doc_id: r.group_id for r in minhash.groups(frame(spark, list(enumerate(copies + other)))).collect()}
    assert {found[i] for i in range(30)} == {0} and all(found[i] == i for i in range(30, 60))


def test_a_crowded_bucket_is_dealt_by_its_outsiders(spark, monkeypatch):
    """Blocks for every outsider cost n * n / BLOCK rows before, also where almost all classes were one component."""
    monkeypatch.setattr(minhash, "BLOCK", 50)
    hot = spark.createDataFrame([], "bucket long")
    for n, outside in ((1000, 10), (2000, 10), (600, 120)):
        placed = spark.createDataFrame([(5, 0, i, n, i if i < outside else n) for i in range(n)], "bucket long, band int, id long, n long, component long")
        dealt = minhash._dealt(placed, hot).collect()
        blocks = outside // 50 + 1
        assert len(dealt) == n * blocks + outside * (n // 50 + 1)
        left, right = ({(r.id, r.p, r.q) for r in dealt if r.left == side} for side in (True, False))
        met = {(p, q): ([], []) for _, p, q in right}
        for side, rows in enumerate((left, right)):
            for i, p, q in rows:
                met[p, q][side].append(i)
        pairs = [(x, y) for xs, ys in met.values() for x in xs for y in ys]
        assert len(pairs) == len(set(pairs)) == n * outside, "each outsider meets each class once"


def test_hot_payloads_are_broadcast(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "same" if i % 2 else ("twin" if i % 4 else f"own{i}")) for i in range(100)], "page_id long, url string, html string")
    few, many = (sorted(tuple(r) for r in warc.with_references(pages, crowd=c).collect()) for c in (10_000, 5))
    assert few == many and sum(r[3] == 1 for r in many) == 49 and sum(r[3] == 2 for r in many) == 24


def test_warc_reader_sees_wrong_lengths_and_digests():
    import io

    good = warc.record(1, "u", b"payload" * 20, None, "2024-01-01T00:00:00Z")
    pack = lambda raw: (lambda z: z.compress(raw) + z.flush())(warc.zlib.compressobj(6, warc.zlib.DEFLATED, 31))
    plain = warc.zlib.decompress(good, 31)
    length = int(warc.re.search(rb"\r\nContent-Length: (\d+)\r\n\r\nHTTP", plain)[1])
    short = plain.replace(b"\r\nContent-Length: %d\r\n\r\nHTTP" % length, b"\r\nContent-Length: %d\r\n\r\nHTTP" % (length + 40))
    with pytest.raises((EOFError, ValueError)):
        assert not all(r[6] for r in warc.records(io.BytesIO(pack(short))))
        raise ValueError("reported as not verified")


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_pipeline_with_nulls_repeats_and_clashing_columns(spark, small, monkeypatch):
    docs, labels, items = small
    odd = docs.union(frame(spark, [(None, None), (50, ""), (51, None), (3, "again"), (3, "again"), (52, "key=1 " + "password: hunter22 " * 60)])).selectExpr("*", "1 AS quality", "2 AS secrets", "3 AS bucket", "4 AS leaks")
    tables = {"labels": labels, "benchmark": items}
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: tables[name])
    seen = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = common.materialize(stage(spark, seen, ""))
        assert seen.columns == odd.columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, seen, "")
    assert last.count() == seen.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), "").count() == 0
