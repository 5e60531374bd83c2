"""Mixing sources to target weights by capped water-filling (built-in expressions only).

Each source has a weight and a size in words. Filling raises one water level: a source's target is its weight times the
level, clamped at ``max_epochs`` times its size. Clamped sources hand their excess to the others in proportion to weight,
until none is above its cap. The level has a closed form over sources ordered by cap/weight, so no loop is needed.

Targets become whole repetitions of every document plus one more repetition of a fraction of the documents. The fraction is
a seeded systematic sample: documents of a source are ranked by size, and every rank at which ``fraction * rank`` passes an
integer is taken once more. Neighbours in rank have nearly equal sizes, so the words taken stay within about one document
of the target; of sixteen starting points the nearest is used. Ranks come from cells (source, size band, salt): prefix sums
over the bands of a source, then over the salts of a band, so that no task holds a source or its cells.

Defined results: null text has size 0; null source is a source of its own, last in order; a source without words has target
0 and takes nothing; repeated rows are separate documents; documents of equal size and digest rank by doc_id; rows with a
null doc_id count like others; an empty table gives an empty result. Extra columns are ignored. All sources meet in one task
when the level is computed: a row of four numbers for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecohort.llm.common import materialize, word_count

WEIGHTS = (5, 2, 1)
#: Starting points of the systematic sample that are tried for each source; the one nearest the target is used.
OFFSETS = 16


def source_targets(sized: DataFrame, budget_share: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, n_docs, source_size, target) from (source, size). ``budget_share`` is the mix's share of all words."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = sources.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)).cast("long"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0))
    filled = (
        sources.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumns({"total": F.sum("source_size").over(everything) * F.lit(float(budget_share)), "weight_sum": F.sum("weight").over(everything), "cap_before": before("cap"), "weight_before": before("weight")})
        .withColumn("capped", F.col("cap").cast("double") * (F.col("weight_sum") - F.col("weight_before")) <= F.col("weight") * (F.col("total") - F.col("cap_before")))
        .withColumns({"capped_size": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything), "capped_weight": F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything)})
    )
    level = (F.col("total") - F.col("capped_size")) / (F.col("weight_sum") - F.col("capped_weight"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return filled.select("source", "n_docs", "source_size", target.alias("target"))


def mix(docs: DataFrame, budget_share: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each document, repeats counted."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = source_targets(sized, budget_share, max_epochs, weights)
    repeats = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select(F.col("source").alias("of"), "source_size", "target", F.floor(repeats).alias("whole"), (repeats - F.floor(repeats)).alias("fraction"), F.floor(F.sqrt("n_docs")).cast("long").alias("salts"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("digest", digest)
        .withColumns({"band": F.floor(F.sqrt("size")).cast("long"), "salt": F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % F.col("salts")})
        .select("doc_id", "size", "source_size", "target", "whole", "fraction", "digest", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("key"), "band", "salt")
    )
    cell = ["key", "band", "salt"]
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda *by: F.coalesce(F.sum("n").over(upto(*by)), F.lit(0))
    cells = materialize(rows.groupBy(*cell).agg(F.count("*").alias("n")))
    bands = materialize(cells.groupBy("key", "band").agg(F.sum("n").alias("n"))).select("key", "band", running("key", "band").alias("below"))
    inner = cells.select(*cell, running("key", "band", "salt").alias("inside"))
    cells = inner.join(bands, ["key", "band"]).select(*cell, (F.col("below") + F.col("inside")).alias("before"))
    in_cell = F.row_number().over(Window.partitionBy(*cell).orderBy("size", "digest", "doc_id"))
    ranked = rows.withColumn("in_cell", in_cell).join(cells, cell).withColumn("rank", F.col("before") + F.col("in_cell"))
    ranked = materialize(ranked.select("key", "doc_id", "size", "source_size", "target", "whole", "fraction", "rank"))
    passed = lambda rank, start: F.floor(F.col("fraction") * rank + start)
    extra = lambda start: passed(F.col("rank"), start) - passed(F.col("rank") - 1, start)
    starts = [F.lit((2 * i + 1) / (2 * OFFSETS)) for i in range(OFFSETS)]
    gaps = [F.struct(F.abs(F.sum(F.col("size") * (F.col("whole") + extra(s))) - F.max("target")).alias("gap"), s.alias("start")) for s in starts]
    chosen = ranked.groupBy("key").agg(F.array_min(F.array(*gaps))["start"].alias("start"))
    taken = (F.col("size") * (F.col("whole") + extra(F.col("start")))).cast("long")
    return ranked.join(chosen, "key").select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, with ``copy`` numbering its repetitions."""
    taken = mix(docs, **options).filter(F.col("size") > 0).select(F.col("doc_id").alias("taken_id"), F.expr("taken div size").alias("copies"))
    out = docs.join(taken.filter("copies > 0").dropDuplicates(["taken_id"]), F.col("doc_id") == F.col("taken_id"))
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
