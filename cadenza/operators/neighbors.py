"""Exact cosine neighbours by block matrix products.

Vectors are dealt to parts of bounded size; every query part meets every base part in
a group of its own, block by block, which keeps the best of each query row.  No row pair
is ever a Spark row, and no side is broadcast.  The work is rows times rows: 10**8
vectors of 100 values against themselves are 2 * 10**18 operations, some thousand
core-hours; each vector is shuffled once a part of the other side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cadenza.operators.ranks import median
from cadenza.operators.shared import stored

#: Vectors of a block, and bytes of one that goes to every task.
BLOCK, SMALL_BYTES = 2048, 8 << 20
#: Vectors of up to ``WIDTH`` values in a part, which is sent once a part of the other side, and parts of a side that has fewer.
PART, WIDTH, SPREAD = 65_536, 64, 8


def sides(left: int, right: int, width: int = 0) -> tuple[int, int]:
    """Parts that either side of so many rows is dealt to: enough pairs of parts to keep the cores busy, and about :data:`PART` rows in one, or fewer longer ones."""
    part = max(1, PART * WIDTH // max(WIDTH, width))
    return tuple(max(1, min(SPREAD, -(-n // BLOCK)), -(-n // part)) for n in (left, right))


def units(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ids and unit vectors of those that have a direction, and which rows these are."""
    flat, size = rows.field("vec").flatten(), pc.list_value_length(rows.field("vec")).to_numpy(zero_copy_only=False)
    if len(size) and (size != size[0]).any():
        raise ValueError("vectors differ in length")
    m = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).reshape(len(size), -1)
    n = np.sqrt((m * m).sum(1))
    kept = np.flatnonzero(n > 0)
    return rows.field("id").take(pa.array(kept)), m[kept] / n[kept, None], kept


def doubles(vec: pa.ListArray) -> pa.ListArray:
    return vec.cast(pa.list_(pa.float64()))


Product = Callable[[pa.StructArray, pa.StructArray], pa.RecordBatch | None]


def beside(rows: DataFrame, side: pa.Table, of: Product, to: T.StructType) -> DataFrame:
    """What ``of`` makes of all rows (id, vec) and one measured block that goes to every task; the rows are not shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(side.combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value.to_batches()
        if not block:
            return
        other = pa.StructArray.from_arrays(block[0].columns, names=block[0].schema.names)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                out = of(pa.StructArray.from_arrays(part.columns, names=["id", "vec"]), other)
                if out is not None:
                    yield out

    return rows.mapInArrow(run, to)


def products(left: DataFrame, right: DataFrame, ident: tuple[str, str], vec: tuple[str, str], of: Product, to: T.StructType, more: tuple[str, ...] = (), fold: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """What ``of`` makes of every pair of a left and a right block (arrays of structs); ``more`` are columns of the right side.

    What a left block got from the right blocks of a part may be made less by ``fold``."""
    head = right.where(F.size(vec[1]) > 0).select(F.col(ident[1]).alias("id"), F.col(vec[1]).cast("array<double>").alias("vec"), *more)
    side = head.limit(BLOCK + 1).toArrow()
    if side.num_rows <= BLOCK and side.nbytes <= SMALL_BYTES:
        return beside(left.where(F.size(vec[0]) > 0).select(F.col(ident[0]).alias("id"), F.col(vec[0]).cast("array<double>").alias("vec")), side, of, to)
    counts = sides(left.count(), right.count(), len(side["vec"][0]))

    def dealt(df: DataFrame, k: int, *columns: str) -> DataFrame:
        rows = df.where(F.size(vec[k]) > 0).select(F.col(ident[k]).alias("id"), F.col(vec[k]).alias("vec"), *columns)
        own, other = F.pmod(F.xxhash64("id"), F.lit(counts[k])).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(counts[1 - k] - 1)))
        return rows.select((own if k == 0 else other).alias("i"), (other if k == 0 else own).alias("j"), "id", "vec", *columns)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = [
            [pa.StructArray.from_arrays([t[c].combine_chunks() if c != "vec" else doubles(t[c].combine_chunks()) for c in t.column_names[2:]], names=t.column_names[2:]) for t in (whole.slice(k, BLOCK) for k in range(0, whole.num_rows, BLOCK))]
            for whole in (a, b)
        ]
        found = []
        for q in rows[0]:
            some = [out for o in rows[1] if (out := of(q, o)) is not None]
            if some:
                found.append(fold(pa.Table.from_batches(some)) if fold else pa.Table.from_batches(some))
        return pa.concat_tables(found) if found else pa.table({f.name: pa.array([], f.type) for f in empty})

    empty = to_arrow_schema(to)
    one, two = dealt(left, 0).groupBy("i", "j"), dealt(right, 1, *more).groupBy("i", "j")
    return one.cogroup(two).applyInArrow(run, to)


def most(found: pa.Table) -> pa.Table:
    """The best row of each id: the highest similarity, the smallest neighbour of equals."""
    found = found.sort_by([("id", "ascending"), ("similarity", "descending"), ("neighbor", "ascending")])
    codes = found["id"].combine_chunks().dictionary_encode().indices.to_numpy()
    return found.take(pa.array(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])))) if found.num_rows else found


def nearest(queries: DataFrame, base: DataFrame, ident: str = "id", vec: str = "embedding", decimals: int = 9, base_ident: str = "", base_vec: str = "", own: bool = False) -> DataFrame:
    """``id, neighbor, similarity``: for every query vector the most similar other base vector (with ``own``: of any id).

    Ids may be of any type that sorts.  Vectors without length take no part.
    Similarities are rounded to ``decimals`` before they are compared, and the smallest
    id wins a tie.
    """
    base_ident, base_vec = base_ident or ident, base_vec or vec
    kinds = queries.schema[ident].dataType, base.schema[base_ident].dataType
    to = T.StructType([T.StructField("id", kinds[0]), T.StructField("neighbor", kinds[1]), T.StructField("similarity", T.DoubleType())])

    def best(q: pa.StructArray, b: pa.StructArray) -> pa.RecordBatch | None:
        (qi, qm, _), (bi, bm, _) = units(q), units(b)
        if not len(qi) or not len(bi):
            return None
        order = pc.sort_indices(bi)
        bi, bm = bi.take(order), bm[order.to_numpy()]
        s = np.round(qm @ bm.T, decimals)
        if not own:
            at = pc.index_in(qi, value_set=bi)
            same = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            s[same, at.drop_null().to_numpy()] = -np.inf
        top = s.argmax(1)
        most = s[np.arange(len(qi)), top]
        ok = pa.array(np.isfinite(most))
        return pa.RecordBatch.from_arrays([qi.filter(ok), bi.take(pa.array(top)).filter(ok), pa.array(most).filter(ok)], names=to.names)

    found = products(queries, base, (ident, base_ident), (vec, base_vec), best, to, fold=most)
    top = F.min(F.struct((-F.col("similarity")).alias("s"), "neighbor")).alias("m")
    return found.groupBy("id").agg(top).select("id", F.col("m.neighbor").alias("neighbor"), (-F.col("m.s")).alias("similarity"))


def top_pairs(nn: DataFrame, n: int) -> DataFrame:
    """The ``n`` most similar unordered pairs among nearest-neighbour rows."""
    pairs = nn.select(F.least("id", "neighbor").alias("a"), F.greatest("id", "neighbor").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return pairs.orderBy(F.desc("similarity"), "a", "b").limit(n)


def statistics(nn: DataFrame) -> DataFrame:
    """One row of figures; the median is exact and found by counts, see :mod:`cadenza.operators.ranks`."""
    nn, s = stored(nn.select("similarity"), "similarities"), F.col("similarity")
    middle = median(nn, "similarity")
    return nn.agg(
        F.count(F.lit(1)).alias("n"), F.min(s).alias("least"), F.max(s).alias("most"), F.avg(s).alias("mean"), F.lit(middle).cast("double").alias("median"),
        F.stddev_pop(s).alias("std"), F.count_if(s == 1.0).alias("exact"), F.count_if(s >= 1 - 1e-5).alias("almost"),
    )


def histogram(nn: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n`` from the least similarity to 1 in equal steps; equal similarities are counted before the least is known, so the rows are made once."""
    counts = nn.groupBy("similarity").agg(F.count(F.lit(1)).alias("c"))
    low = counts.agg(F.min("similarity").alias("low"))
    at = F.least(F.lit(buckets - 1), F.floor((F.col("similarity") - F.col("low")) / ((1.0 - F.col("low")) / buckets))).cast("int")
    return counts.crossJoin(F.broadcast(low)).select(F.when(F.col("low") < 1.0, at).otherwise(0).alias("bucket"), "c").groupBy("bucket").agg(F.sum("c").alias("n"))  # low is one row


def duplicate_class(similarity: Column, certain: float = 0.99992, likely: float = 0.99990) -> Column:
    return F.when(similarity >= certain, "duplicate").when(similarity >= likely, "ask").otherwise("new")
