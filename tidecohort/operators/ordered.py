"""Ranks and running sums over a whole table without gathering it: parts by value, sums inside each, offsets between them.

All of them read their rows several times: for the cuts between parts, for the totals of parts and for the rows themselves. A
mean of doubles that is computed again may differ in its last bit and fall into another part, so the rows are stored first,
and every branch reads the stored values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecohort.operators.tables import stored

PARTS = 64


def cuts(rows: DataFrame, columns: list[str], parts: int = PARTS) -> dict[str, list]:
    """Approximate quantiles of stored rows' columns, a few literals each; all columns in one pass."""
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in columns]).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def part_of(column: str, edges: list) -> Column:
    """Between which of the edges a value lies; equal values share a part."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(column)))


def _before(rows: DataFrame, sums: dict[str, str], by: list[str], descending: bool, part: str) -> DataFrame:
    """(__of, __by*, __name...): what lies before each part, a row a part and group."""
    totals = rows.groupBy(part, *by).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    window = Window.partitionBy(*by).orderBy(F.col(part).desc() if descending else F.col(part).asc()).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col(part).alias("__of"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], *[F.coalesce(F.sum(f"__{n}").over(window), F.lit(0)).alias(f"__{n}") for n in sums])


def running(rows: DataFrame, column: str, sums: dict[str, str], by: list[str] = (), ties: list[str] = (), descending: bool = False, previous: str | None = None) -> DataFrame:
    """``rows`` with ``sums`` (new column -> summed column): the sum over the rows up to the row itself, in the column's order.

    Ties go by the further columns, which must make the order total within a group of ``by``. A window sums inside each part;
    the totals of the parts before it (one row a part and group) are joined. ``previous`` names a column for the next smaller
    value, null for the smallest (rows distinct in ``column``, no groups).
    """
    turned = lambda c: c.desc() if descending else c.asc()
    rows = stored(rows)
    names = rows.columns
    dealt = rows.withColumn("__part", part_of(column, cuts(rows, [column])[column]))
    order = Window.partitionBy("__part", *by).orderBy(turned(F.col(column)), *ties)
    inside = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = _before(dealt, sums, list(by), descending, "__part")
    added = {n: F.sum(c).over(inside) for n, c in sums.items()}
    if previous:
        tops = dealt.groupBy("__part").agg(F.max(column).alias("__top"))
        last = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = offsets.join(F.broadcast(tops.select(F.col("__part").alias("__of"), F.max("__top").over(last).alias("__last"))), "__of")
        added["__lag"] = F.lag(column).over(order)
    same = F.col("__part") == F.col("__of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    out = dealt.withColumns(added).join(F.broadcast(offsets) if not by else offsets, same)
    extra = [F.coalesce("__lag", "__last").alias(previous)] if previous else []
    return out.select(*names, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums], *extra)


def ranks(rows: DataFrame, columns: dict[str, str], ties: list[str], descending: bool = False) -> DataFrame:
    """``rows`` with a place from 1 in the order of each column (new column -> ordering column), ties by the further columns.

    All orders start from one stored table; their cuts come from one pass, their offsets from one small aggregation each.
    """
    rows = stored(rows)
    edges = cuts(rows, list(columns.values()))
    out = rows
    for name, column in columns.items():
        part = part_of(column, edges[column])
        offsets = _before(rows.withColumn("__part", part).withColumn("__one", F.lit(1).cast("long")), {"before": "__one"}, [], descending, "__part")
        order = Window.partitionBy("__part").orderBy(F.col(column).desc() if descending else F.col(column).asc(), *ties)
        met = out.withColumn("__part", part).withColumn("__place", F.row_number().over(order)).join(F.broadcast(offsets), F.col("__part") == F.col("__of"))
        out = met.withColumn(name, F.col("__before") + F.col("__place")).drop("__part", "__place", "__of", "__before")
    return out


def ranked(rows: DataFrame, column: str, name: str, ties: list[str], descending: bool = False) -> DataFrame:
    """``rows`` with their place from 1 in the order of a column, ties by the further columns."""
    return ranks(rows, {name: column}, ties, descending)
