"""Exact order statistics and running totals without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.shared import stored

#: Ranges of a round, and the accuracy of the quantiles that part them.
RANGES, ACCURACY = 256, 10_000
#: Values that are sorted at once at the end.
FEW = 10_000


def range_counts(df: DataFrame, column: str, cuts: list[float]) -> np.ndarray:
    """Rows below the first cut, equal to it, between it and the second, and so on, and above the last; a row a range leaves a task."""
    size = 2 * len(cuts) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            n += np.bincount(np.searchsorted(cuts, v, side="left") + np.searchsorted(cuts, v, side="right"), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(n)], names=["range", "n"])

    out = np.zeros(size, np.int64)
    for r in df.select(column).mapInArrow(run, "range int, n long").groupBy("range").agg(F.sum("n").alias("n")).collect():
        out[r.range] = r.n
    return out


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at the given places (from 0) of the sorted column, as doubles; nulls and NaN are left out.

    A round parts the values between two bounds by approximate quantiles, counts the ranges and the cuts exactly, and
    goes on between the two cuts where the place is, if it is not a cut itself.  Only counts move, until few values are left.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    points = [k / RANGES for k in range(1, RANGES)]
    out = []
    for rank in ranks:
        low, high, below = None, None, 0
        while True:
            inside = values if low is None else values.where(F.col("v") > low)
            inside = inside if high is None else inside.where(F.col("v") < high)
            row = inside.agg(F.percentile_approx("v", points, ACCURACY).alias("q"), F.count(F.lit(1)).alias("n")).first()
            if not 0 <= rank - below < row.n:
                raise IndexError(f"no value at place {rank}")
            if row.n <= FEW:
                out.append(sorted(r.v for r in inside.collect())[rank - below])
                break
            cuts = sorted(set(row.q))
            ends = below + np.cumsum(range_counts(inside, "v", cuts))
            at = int(np.searchsorted(ends, rank, side="right"))
            if at % 2:
                out.append(cuts[at // 2])
                break
            below = int(ends[at - 1]) if at else below
            low, high = cuts[at // 2 - 1] if at else low, cuts[at // 2] if at // 2 < len(cuts) else high
    return out


def median(df: DataFrame, column: str) -> float | None:
    """The middle value, or the mean of the two; null without values."""
    n = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if not n:
        return None
    places = sorted({(n - 1) // 2, n // 2})
    return float(np.mean(order_statistics(df, column, places)))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes not to be columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = "__" + n
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


#: Ranges up to which they may be as small as asked for, and rows of one beyond: each adds samples and sizes on the driver.
MOST_RANGES, LARGE = 1000, 1_000_000


def range_parts(n: int, rows: int) -> int:
    """Ranges of about ``rows`` rows each, larger ones where that would make more than :data:`MOST_RANGES`."""
    return max(1, min(-(-n // rows), max(MOST_RANGES, -(-n // LARGE))))


def running_total(df: DataFrame, order: str | list[str], value: str, rows: int = 1_000_000, out: str = "total") -> DataFrame:
    """``df`` plus the sum of ``value`` up to each row and its sequence number, by the ``order`` columns.

    Rows are dealt by ranges of the order columns and a hash of the whole row, so equal values of a column are split too
    and have one order whatever the run; rows that are equal in all columns follow each other.  Two passes: sums of the ranges are ordered as a
    whole, one row each, and every range is then summed on its own.
    """
    order = [order] if isinstance(order, str) else order
    tie, part, key, sums_, count = free(df, "tie", "range", "key", "sum", "count")
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    parts = range_parts(df.count(), rows)
    by = [*order, tie]
    ranged = stored(df.withColumn(tie, F.xxhash64(*plain)).repartitionByRange(parts, *by).withColumn(part, F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(F.col(part).alias(key)).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = sums.select(key, F.coalesce(F.sum("s").over(before), F.lit(0)).alias(sums_), F.coalesce(F.sum("c").over(before), F.lit(0)).alias(count))
    w = Window.partitionBy(part).orderBy(*by, value).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(base), F.col(part) == F.col(key))
    total = F.col(sums_) + F.coalesce(F.sum(value).over(w), F.lit(0))
    return joined.withColumn(out, total).withColumn("seq", F.col(count) + F.count(F.lit(1)).over(w)).drop(tie, part, key, sums_, count)


#: Rows of a key up to which its window is one task's.
HOT = 5_000_000


def hot(df: DataFrame, keys: list[str]) -> bool:
    """Whether a key has more rows than one task should sort; counts alone move."""
    return (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > HOT


def by_ranges(df: DataFrame, by: list[str], rows: int, part: str, tie: str) -> DataFrame:
    """``df`` as a table dealt by ranges of ``by`` and a hash of the row, with the range and the hash."""
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    parts = range_parts(df.count(), rows)
    return stored(df.withColumn(tie, F.xxhash64(*plain)).repartitionByRange(parts, *by, tie).withColumn(part, F.spark_partition_id()), "ranges")


def carried(ranged: DataFrame, edges: DataFrame, part: str, keys: list[str], few: int = 100_000) -> DataFrame:
    """``ranged`` with what ``edges`` has for its range and key; null keys are keys too."""
    other = edges.select(*[F.col(c).alias(f"{c}__e") for c in (part, *keys)], *[c for c in edges.columns if c not in (part, *keys)])
    same = F.lit(True)
    for c in (part, *keys):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__e"))
    side = F.broadcast(other) if other.limit(few + 1).count() <= few else other
    return ranged.join(side, same, "left").drop(*[f"{c}__e" for c in (part, *keys)])


def neighbours(df: DataFrame, keys: list[str], order: list[str], columns: list[str], step: int, rows: int = 1_000_000) -> DataFrame:
    """``df`` plus ``near_<column>``: the columns' values in the row before (``step`` -1) or after (1) of the same keys, null at the end.

    If a key is :func:`hot` its rows are sorted in ranges, and the rows where ranges meet are told to each other: one a key and range.
    """
    name = [f"near_{c}" for c in columns]
    next_ = F.lag if step < 0 else F.lead
    if not hot(df, keys):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[next_(c).over(w).alias(n) for c, n in zip(columns, name, strict=True)])
    part, tie, inside, edge, carry = free(df, "range", "tie", "inside", "edge", "carry")
    ranged = by_ranges(df, [*keys, *order], rows, part, tie)
    w = Window.partitionBy(part, *keys).orderBy(*order, tie)
    values = F.struct(*[F.col(c).alias(n) for c, n in zip(columns, name, strict=True)])
    found = ranged.withColumn(inside, next_(values).over(w))
    pick = F.max_by if step < 0 else F.min_by
    edges = ranged.groupBy(part, *keys).agg(pick(values, F.struct(*order, tie)).alias(edge))
    edges = edges.select(part, *keys, next_(edge).over(Window.partitionBy(*keys).orderBy(part)).alias(carry))  # a row a range and key
    near = F.coalesce(F.col(inside), F.col(carry))  # a struct is null only where the range ends
    return carried(found, edges, part, keys).select(*df.columns, *[near[n].alias(n) for n in name])


def keyed_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, rows: int = 1_000_000) -> DataFrame:
    """``df`` plus the sum of ``value`` up to each row of its keys, in ranges if a key is :func:`hot`."""
    if not hot(df, keys):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(w))
    part, tie, own, carry = free(df, "range", "tie", "own", "carry")
    ranged = by_ranges(df, [*keys, *order], rows, part, tie)
    w = Window.partitionBy(part, *keys).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy(part, *keys).agg(F.sum(value).alias(own))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    edges = sums.select(part, *keys, F.coalesce(F.sum(own).over(before), F.lit(0)).alias(carry))
    total = F.sum(value).over(w) + F.col(carry)
    return carried(ranged, edges, part, keys).withColumn(out, total).select(*df.columns, out)
