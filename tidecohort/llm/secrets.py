"""Secret scans: base patterns plus a randomness test battery (built-in expressions only).

Base kinds, leftmost and non-overlapping within a kind: ``assign`` (a keyword assigned a value of six or more characters),
``access`` (an ``AKIA`` key of twenty or more characters) and ``hex`` (24 or more lower-case hexadecimal digits).

The battery judges what base spans leave of every token of 20 or more key-alphabet characters: the whole token, or pieces of
``PIECE`` characters and more where base spans cut it. The encoding is inferred from the character classes (hexadecimal, base
32, lower-case alphanumeric, base 62, base 64; letters of one case are a word and have none). Four statistics tell how far
the token is from uniform over that alphabet: chi-squared over its characters and over its classes (digits, vowels and
consonants of either case, symbols), the number of runs above and below the alphabet's middle, and the lag-1 serial
correlation. Fisher's method combines them.

A finding is a token that looks more random than ordinary ones do, by two measures:

* Letter predictability, learned from the table itself. Every distinct token, whatever its class, is cut into words at changes
  of case and class; the letters of words, given the two before them, are counted over tokens (each token once, however often
  it is copied). That model and a few bits for each word code a token; a token's own counts are left out. A code cannot shorten
  a uniformly random token by ``spared`` bits or more but with a probability of 2 ** -spared, so that tokens which it shortens
  that much are ordinary: identifiers and paths whose parts recur in the table, in any language and however abbreviated.
* The battery's statistic against ordinary text: how often an ordinary token of the same encoding and length reaches it, by
  tokens made by rule from common words (``decoys``) and by the table's own ordinary tokens, whichever reach it more often.
  Over these p-values the false discoveries are held to ``q`` by a Benjamini-Hochberg step for every encoding and band of
  lengths, over the tokens that are not ordinary by their letters.

What is reported of a token thus depends on the table: an identifier whose parts occur nowhere else is judged by the battery
alone, and may be reported in a small table and not in a larger one. The counts that reach the driver are bounded: 27 ** 3
letter counts, and a row for each encoding and band.

Defined results: null text counts as empty; spans are code points, end exclusive; texts without findings have empty
``spans`` and the digest of the empty string; repeated rows give repeated results (each counts as a token of its own); rows
with a null doc_id are scanned like others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecohort.llm.common import materialize, shielded

# The base patterns.
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

# The alphabets that encodings draw from, in the order of their digits' values.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + UPPER[:6],
    "base32": UPPER + DIGITS[2:8],
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
BLOCK = 64
#: Least characters of a piece that base spans leave of a token.
PIECE = 14
#: Upper ends of the bands of lengths.
BANDS = (19, 23, 27, 31, 39, 55)
#: Shares of ordinary tokens at which the statistic's quantiles are kept.
LEVELS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05)
#: Bits for the class and case of a word of a token.
WORD_BITS = math.log2(5)
CLASSES = (DIGITS, "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "aeiou", "bcdfghjklmnpqrstvwxyz", "+/-_")
#: Words of ordinary identifiers; those of the letters a to f also make hexadecimal ones.
WORDS = (
    "get set user name id from cache file path index value key data list map config load save read write open close start stop run test main src lib java org com http server client request response header body token count size "
    "max min sum item node tree graph edge table row column query result error message event handler listener manager factory service controller model view template string number integer double float byte char array buffer "
    "stream channel socket thread process task job queue stack heap memory disk network page image color font style layout window button label text input output system version build release update create delete remove find "
    "search sort filter reduce merge split join group order by the and for with into over under access public private static final class interface method function return internationalization configuration"
).split()
HEX_WORDS = "face bead deed cafe decade added facade fade dead beef feed ace bed cab dab ebb".split()


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _prefix_sums(lengths: Column) -> Column:
    """Running sums of an array of integers, by blocks so that long arrays cost little more than their length."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    whole = F.transform(blocks, lambda x, b: _sum(F.slice(blocks, F.lit(1), b)))
    return F.transform(lengths, lambda x, i: F.get(whole, F.floor(i / BLOCK).cast("int")) + _sum(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)))


def _found(text: Column, matches: Column, pattern: str, kind: str) -> Column:
    """Array of (s, e, k, v) for the matches of a pattern: split() gives the gaps between them, and lengths give offsets."""
    gaps = F.split(text, pattern, -1)
    starts = _prefix_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), F.concat(F.array(F.lit(0)), F.transform(F.slice(matches, F.lit(1), F.size(matches) - 1), lambda m: F.length(m))), lambda g, m: F.length(g) + m))
    spans = F.zip_with(matches, starts, lambda m, s: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), F.lit(KINDS.index(kind)).alias("k"), m.alias("v")))
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast("array<struct<s:int,e:int,k:int,v:string>>"))


def _upper_tail(z: Column) -> Column:
    """Normal tail by Page's logistic form (error below 2e-4)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))


def _encoding(v: Column) -> Column:
    """Name of the smallest alphabet that fits the token; null for words of one case and mere numbers."""
    has = lambda p: v.rlike(p)
    return (
        F.when(~has("[0-9]") & (~has("[a-z]") | ~has("[A-Z]") | has("^[A-Z][a-z]+$")), None)
        .when(~has("[A-Za-z]"), None)
        .when(has("^[0-9a-f]+$"), "hex")
        .when(has("^[0-9A-F]+$"), "HEX")
        .when(has("^[A-Z2-7]+$"), "base32")
        .when(has("^[a-z0-9]+$"), "base36")
        .when(has("^[A-Z0-9]+$"), "BASE36")
        .when(has("^[A-Za-z0-9]+$"), "base62")
        .when(~has("[A-Z]") | ~has("[a-z]"), None)
        .when(has("^[A-Za-z0-9+/]+$"), "base64")
        .when(has("^[A-Za-z0-9_-]+$"), "base64url")
    )


def _alphabet(encoding: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair]), encoding)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def departure(token: Column, encoding: Column) -> Column:
    """How far a token is from uniform over the encoding's alphabet: half of Fisher's statistic of the battery."""
    shares = {name: [len(set(alphabet) & set(letters)) / len(alphabet) for letters in CLASSES] for name, alphabet in ALPHABETS.items()}
    table = F.create_map(*[x for name, own in shares.items() for x in (F.lit(name), F.array(*[F.lit(v) for v in own]))])
    n = F.length(token).cast("double")
    clip = lambda p: F.greatest(p, F.lit(1e-30))

    def by_class(own: Column) -> Column:
        terms, groups = F.lit(0.0), F.lit(-1.0)
        for i, letters in enumerate(CLASSES):
            expected = n * F.get(own, F.lit(i))
            seen = (F.length(token) - F.length(F.translate(token, letters, ""))).cast("double")
            terms = terms + F.when(expected > 0, F.pow(seen - expected, F.lit(2)) / expected).otherwise(F.lit(0.0))
            groups = groups + (expected > 0).cast("double")
        ninth = lambda g: F.lit(2.0) / (9 * g)
        return _let(groups, lambda g: F.log(clip(_upper_tail((F.pow(terms / g, F.lit(1 / 3)) - (1 - ninth(g))) / F.sqrt(ninth(g))))))

    def by_place(alphabet: Column) -> Column:
        size = F.length(alphabet).cast("double")
        squares = F.aggregate(F.transform(F.split(alphabet, ""), lambda a: F.length(token) - F.length(F.replace(token, a, F.lit("")))), F.lit(0.0), lambda s, x: s + x * x)
        z_chi = (squares * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        middle, variance = (size - 1) / 2, (size * size - 1) / 12
        start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("product"))

        def step(acc, c):
            v = (F.instr(alphabet, c) - 1).cast("double") - middle
            turned = ((acc["last"] >= 0) != (v >= 0)).cast("double")
            return F.struct(v.alias("last"), (acc["runs"] + F.coalesce(turned, F.lit(0.0))).alias("runs"), (acc["product"] + F.coalesce(acc["last"] * v, F.lit(0.0))).alias("product"))

        walked = F.aggregate(F.split(token, ""), start, step)
        two_sided = lambda z: F.log(clip(F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))))
        return _let(walked, lambda w: F.log(clip(_upper_tail(z_chi))) + two_sided((w["runs"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)) + two_sided(w["product"] / variance / F.sqrt(n - 1)))

    return -(_let(F.element_at(table, encoding), by_class) + _let(_alphabet(encoding), by_place))


def _band(length: Column) -> Column:
    out = F.lit(len(BANDS))
    for i, top in reversed(list(enumerate(BANDS))):
        out = F.when(length <= top, F.lit(i)).otherwise(out)
    return out


def _cell(token: Column, encoding: Column) -> Column:
    return F.concat(encoding, F.lit("/"), _band(F.length(token)).cast("string"))


def decoys(spark, n: int = 40_000) -> DataFrame:
    """(v): ordinary tokens by rule. Words are drawn by hash; a style joins them, changes their case and adds numbers."""
    draw = lambda *salt: F.xxhash64("id", *[s if isinstance(s, Column) else F.lit(s) for s in salt])
    pick = lambda words, i: F.get(F.array(*[F.lit(w) for w in words]), F.pmod(draw("word", i), F.lit(len(words))).cast("int"))
    style = F.pmod(F.col("id"), F.lit(10))
    upto = F.sequence(F.lit(1), F.pmod(draw("n"), F.lit(9)).cast("int") + 2)
    words = F.transform(upto, lambda i: F.when(style >= 8, pick(HEX_WORDS, i)).otherwise(pick(WORDS, i)))
    number = lambda salt, top: F.pmod(draw(salt), F.lit(top)).cast("string")
    digits = F.transform(words, lambda w, i: F.when(F.pmod(draw("digit", i), F.lit(4)) == 0, F.concat(w, F.pmod(draw("which", i), F.lit(100)).cast("string"))).otherwise(w))
    camel = F.transform(words, lambda w, i: F.when(i > 0, F.initcap(w)).otherwise(w))
    joined = (
        F.when(style == 0, F.array_join(camel, ""))
        .when(style == 1, F.array_join(F.transform(digits, F.initcap), ""))
        .when(style == 2, F.concat(F.array_join(camel, ""), number("tail", 10_000)))
        .when(style == 3, F.concat(F.array_join(words, "/"), F.lit("/"), F.initcap(pick(WORDS, F.lit(50))), number("tail", 10)))
        .when(style == 4, F.concat(F.array_join(F.transform(words, lambda w, i: F.when(i % 2 == 0, F.initcap(w)).otherwise(w)), "_"), F.lit("-"), number("tail", 100)))
        .when(style == 5, F.array_join(digits, ""))
        .when(style == 6, F.upper(F.array_join(digits, "")))
        .when(style == 7, F.concat(F.array_join(camel, ""), F.lit("20"), F.lpad(number("date", 9_999_999), 7, "0")))
        .when(style == 8, F.concat(F.array_join(F.slice(words, 1, 3), ""), F.lit("20"), F.lpad(number("date", 10_000), 4, "1"), F.array_join(F.slice(words, 4, 3), ""), number("tail", 10_000)))
        .otherwise(F.upper(F.concat(F.array_join(F.slice(words, 1, 4), ""), number("tail", 10_000), F.array_join(F.slice(words, 5, 2), ""))))
    )
    return spark.range(n).select(joined.alias("v")).filter(F.length("v").between(PIECE, 120))


@functools.cache
def ordinary_quantiles() -> dict[str, list[float]]:
    """For each encoding and band the departures that so many ordinary tokens stay below; a row for each reaches the driver.

    They follow from the constants above alone, so that one process computes them once.
    """
    spark = SparkSession.active()
    judged = decoys(spark).withColumn("enc", _encoding(F.col("v"))).filter("enc IS NOT NULL")
    rows = judged.groupBy(_cell(F.col("v"), F.col("enc")).alias("cell"), "enc").agg(F.count("*").alias("n"), F.percentile(departure(F.col("v"), F.col("enc")), F.array(*[F.lit(x) for x in LEVELS])).alias("q")).collect()
    return {r["cell"]: [q if r["n"] * level >= 1 else -1.0 for q, level in zip(r["q"], LEVELS, strict=True)] for r in rows}


def _level(cell: Column, value: Column, quantiles: dict[str, list[float]]) -> Column:
    """Index of the smallest level whose quantile the departure stays below; the number of levels where there is none.

    A cell in which no ordinary token fell uses the median cell: all known quantiles' middle at each level.
    """
    if not quantiles:
        return F.lit(len(LEVELS))
    middle = [sorted(q[i] for q in quantiles.values())[len(quantiles) // 2] for i in range(len(LEVELS))]
    table = F.create_map(*[x for c, q in sorted(quantiles.items()) for x in (F.lit(c), F.array(*[F.lit(v) for v in q]))])
    limits = F.coalesce(F.element_at(table, cell), F.array(*[F.lit(v) for v in middle]))
    return F.size(F.filter(limits, lambda limit: limit < value))


def _pieces(token: Column, base: Column) -> Column:
    """What the base spans, in order, leave of a token: itself, or pieces of ``PIECE`` characters or more."""
    inside = F.filter(base, lambda b: (b["s"] < token["e"]) & (b["e"] > token["s"]))
    starts = F.concat(F.array(token["s"]), F.transform(inside, lambda b: b["e"]))
    ends = F.concat(F.transform(inside, lambda b: b["s"]), F.array(token["e"]))
    # A span inside an earlier one must not reopen text: each piece starts after all spans so far.
    reached = F.transform(starts, lambda x, i: F.array_max(F.slice(starts, F.lit(1), i + 1)))
    cut = F.zip_with(reached, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"), token["k"].alias("k"), F.substring(token["v"], s - token["s"] + 1, F.greatest(e - s, F.lit(0))).alias("v")))
    return F.when(F.size(inside) == 0, F.array(token)).otherwise(F.filter(cut, lambda p: p["e"] - p["s"] >= PIECE))


def _marked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` (base spans in order) and ``_piece`` (what they leave of tokens, with the encoding)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    nothing = F.array().cast("array<string>")
    hits = docs.withColumns({
        "_assign": F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)),
        "_access": F.when(text.contains("AKIA"), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0))).otherwise(nothing),
        "_hex": F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
        "_token": F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)),
    })
    found = hits.withColumns({f"_{k}": _found(text, F.col(f"_{k}"), p, n) for k, p, n in (("assign", ASSIGN, "assign"), ("access", ACCESS, "access"), ("hex", HEX, "hex"), ("token", TOKEN, "random"))})
    long_value = lambda x: F.length(F.regexp_replace(x["v"], "^" + ASSIGN_HEAD, "")) >= 6
    base = found.withColumn("_base", F.array_sort(F.concat(F.filter("_assign", long_value), "_access", "_hex")))
    pieces = base.withColumn("_piece", F.flatten(F.transform("_token", lambda t: _pieces(t, F.col("_base")))))
    return pieces.withColumn("_piece", F.transform("_piece", lambda t: t.withField("enc", _encoding(t["v"])))).drop("_assign", "_access", "_hex", "_token")


def _words(token: Column) -> Column:
    """A token's words: letters of one case, a capital with small letters, digits, or symbols."""
    return F.regexp_extract_all(token, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[+/_-]+"), F.lit(0))


def _letter_keys(word: Column) -> Column:
    """For each letter of a word and its end: the number of the letter with the two before it, of 27 ** 3."""
    codes = F.transform(F.split(F.lower(word), ""), lambda c: F.ascii(c) - 96)
    padded = F.concat(F.array(F.lit(0), F.lit(0)), codes, F.array(F.lit(0)))
    return _let(padded, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 3), lambda i: (F.get(p, i) * 27 + F.get(p, i + 1)) * 27 + F.get(p, i + 2)))


def letter_costs(tokens: DataFrame) -> list[float]:
    """Bits of each of 27 ** 3 letter contexts, learned from distinct tokens (v); a token's own count is left out.

    Trigrams back off to bigrams, and these to a uniform letter. At most 27 ** 3 counts reach the driver.
    """
    letters = F.filter(_words(F.col("v")), lambda w: w.rlike("^[A-Za-z]"))
    keys = tokens.select(F.explode(F.array_distinct(F.flatten(F.transform(letters, _letter_keys)))).alias("key"))
    counts = {r["key"]: r["count"] for r in keys.groupBy("key").count().collect()}
    three, context, two, one = [counts.get(k, 0) for k in range(27**3)], [0] * 27**2, [0] * 27**2, [0] * 27
    for key, n in counts.items():
        context[key // 27] += n
        two[key % 27**2] += n
        one[key // 27 % 27] += n
    others = lambda n: max(n - 1, 0)
    shorter = [(others(two[k]) + 1) / (others(one[k // 27]) + 27) for k in range(27**2)]
    return [round(-math.log2((others(three[k]) + 4 * shorter[k % 27**2]) / (others(context[k // 27]) + 4)), 3) for k in range(27**3)]


def spared_bits(token: Column, encoding: Column, costs: list[float]) -> Column:
    """How many bits the learned code of words spares against a uniform draw from the encoding's alphabet."""
    table = F.split(F.lit(",".join(map(str, costs))), ",").cast("array<double>")
    add = lambda a, x: a + x
    spelled = lambda w: F.aggregate(_letter_keys(w), F.lit(0.0), lambda a, k: a + F.get(table, k))
    each = F.transform(_words(token), lambda w: F.lit(WORD_BITS) + F.when(w.rlike("^[A-Za-z]"), spelled(w)).when(w.rlike("^[0-9]"), F.length(w) * (1 + math.log2(10))).otherwise(F.length(w) * 3.0))
    return F.length(token) * F.log2(F.length(_alphabet(encoding))) - F.aggregate(each, F.lit(0.0), add)


class _Null:
    """What is ordinary in a table: letter costs, quantiles of the battery by cell, and the level that each cell accepts."""

    def __init__(self, pieces: DataFrame, q: float, min_bits: float, spared: float):
        """``pieces`` is a stored table with ``_piece``; every distinct token is judged once."""
        self.min_bits, self.spared = min_bits, spared
        tokens = materialize(pieces.select(F.explode("_piece").alias("t")).groupBy(F.col("t.v").alias("v"), F.col("t.enc").alias("enc")).agg(F.count("*").alias("n")))
        self.costs = letter_costs(tokens)
        bits = F.length("v") * F.log2(F.length(_alphabet(F.col("enc"))))
        able = tokens.filter(F.col("enc").isNotNull() & (bits >= min_bits))
        judged = materialize(able.select("n", _cell(F.col("v"), F.col("enc")).alias("cell"), departure(F.col("v"), F.col("enc")).alias("d"), self._ordinary(F.col("v"), F.col("enc")).alias("ordinary")))
        own = judged.filter("ordinary").groupBy("cell").agg(F.count("*").alias("n"), F.percentile("d", F.array(*[F.lit(x) for x in LEVELS])).alias("q")).collect()
        self.quantiles = dict(ordinary_quantiles())
        for r in own:
            # The statistic is small where a token is random: the lower quantile is the stricter one.
            there = self.quantiles.get(r["cell"])
            mine = [x if r["n"] * level >= 1 else None for x, level in zip(r["q"], LEVELS, strict=True)]
            if there is not None:
                self.quantiles[r["cell"]] = [a if b is None else min(a, b) for a, b in zip(there, mine, strict=True)]
        counted = judged.filter("NOT ordinary").groupBy("cell")
        level = _level(F.col("cell"), F.col("d"), self.quantiles)
        rows = counted.agg(F.sum("n").alias("n"), *[F.sum(F.when(level <= i, F.col("n")).otherwise(0)).alias(f"l{i}") for i in range(len(LEVELS))]).collect()
        accepted = {r["cell"]: [i for i, p in enumerate(LEVELS) if r[f"l{i}"] and r["n"] * p <= q * r[f"l{i}"]] for r in rows}
        self.cuts = {cell: max(levels) for cell, levels in accepted.items() if levels}

    def _ordinary(self, v: Column, enc: Column) -> Column:
        return spared_bits(v, enc, self.costs) >= self.spared

    def found(self, pieces: Column) -> Column:
        """The pieces that are findings, as spans (s, e, k, v)."""
        if not self.cuts:
            return F.array().cast("array<struct<s:int,e:int,k:int,v:string>>")
        limit = F.create_map(*[F.lit(x) for pair in sorted(self.cuts.items()) for x in pair])
        bits = lambda t: F.length(t["v"]) * F.log2(F.length(_alphabet(t["enc"])))
        able = F.filter(pieces, lambda t: t["enc"].isNotNull() & (bits(t) >= self.min_bits))
        celled = F.transform(able, lambda t: t.withField("cell", _cell(t["v"], t["enc"])))
        random = F.filter(celled, lambda t: _level(t["cell"], departure(t["v"], t["enc"]), self.quantiles) <= F.coalesce(F.element_at(limit, t["cell"]), F.lit(-1)))
        kept = F.filter(random, lambda t: ~self._ordinary(t["v"], t["enc"]))
        return F.transform(kept, lambda t: F.struct(t["s"], t["e"], t["k"], t["v"]))


def scan(docs: DataFrame, q: float = 0.05, min_bits: float = 80.0, spared: float = 10.0) -> DataFrame:
    """``docs`` with ``secrets``: array of (s, e, k, v), base kinds and battery findings, by start and then kind.

    ``q`` bounds the share of ordinary tokens among the findings of the battery, ``min_bits`` is the least information of one,
    and what the table's letters shorten by ``spared`` bits is none. The texts are read twice: once for their tokens, which are
    stored, and once for the spans.
    """
    null = _Null(materialize(_marked(docs.select("text")).select("_piece")), q, min_bits, spared)
    return _with_secrets(_marked(docs), null)


def _with_secrets(marked: DataFrame, null: _Null) -> DataFrame:
    return marked.withColumn("secrets", F.array_sort(F.concat("_base", null.found(F.col("_piece"))))).drop("_base", "_piece")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["s"].cast("string"), s["e"].cast("string"))))


def report(docs: DataFrame, q: float = 0.05, min_bits: float = 80.0, spared: float = 10.0) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of each document; its text is read once."""
    stored = materialize(_marked(docs.select("doc_id", "text")).drop("text"))
    found = _with_secrets(stored, _Null(stored, q, min_bits, spared))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["k"] < KINDS.index("random"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"), count("random"))


def redact(docs: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every found span replaced by ``mask`` (overlapping spans by one); ``n_chars`` follows where present."""
    found = scan(shielded(docs, "doc_id", "text", "n_chars"), **options)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(acc, span):
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(span["s"] - acc["at"], F.lit(0))), F.when(span["s"] >= acc["at"], F.lit(mask)).otherwise(F.lit("")))
        return F.struct(F.greatest(span["e"], acc["at"]).alias("at"), kept.alias("out"))

    done = F.aggregate("secrets", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = found.withColumn("text", F.when(F.size("secrets") > 0, done).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("secrets").toDF(*docs.columns)
