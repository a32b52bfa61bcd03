"""Exact cosine neighbours with pruning: a metric index over blocks of vectors.

Angles between vectors obey the triangle inequality.  Every vector is dealt to the nearest of some
pivots, and each pivot's vectors are cut by their angle to it into blocks: rings, each known by its pivot and
its least and greatest angle.  Two blocks whose rings are further apart than the worst best
neighbour found so far cannot hold a better one, so their vectors never meet.

A first pass joins each query block with the few base blocks that are nearest by their rings; it gives
the bounds.  The second joins it with the blocks that are left.  Blocks travel in bundles that lie
together, as large as the parts of :mod:`cadenza.operators.neighbors`, so a bundle is sent once for each bundle it has something to do with, not once a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.neighbors import BLOCK, doubles, most, sides, units
from cadenza.operators.shared import stored

#: Bytes of pivots that go to every task, rings that a pivot's angles are counted in.
PIVOT_BYTES, RINGS = 8 << 20, 64
#: Base blocks of the first pass for each query block.
FIRST = 3
#: Similarities are compared after rounding, so a bound prunes only what is lower by more than this.
SLACK = 1e-8


def chosen_pivots(base: DataFrame, ident: str, vec: str, count: int) -> np.ndarray:
    """Unit vectors of ``count`` rows, the first in the order of a hash, as far as :data:`PIVOT_BYTES` goes."""
    rows = base.where(F.size(vec) > 0).select(F.col(ident).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    one = rows.first()
    if one is None:
        return np.zeros((0, 0))
    count = max(1, min(count, PIVOT_BYTES // (8 * len(one.vec))))
    table = pa.Table.from_pylist([{"id": None, "vec": r.vec} for r in rows.orderBy(F.xxhash64("id"), "id").limit(count).collect()], pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.float64()))]))
    return units(pa.StructArray.from_arrays([table["id"].combine_chunks(), table["vec"].combine_chunks()], names=["id", "vec"]))[1]


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def placed(df: DataFrame, ident: str, vec: str, pivots: np.ndarray) -> DataFrame:
    """``id, vec, cell, angle, ring``: the nearest pivot of each vector that has a direction."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    kind = df.schema[ident].dataType
    to = T.StructType([T.StructField("id", kind), T.StructField("vec", df.schema[vec].dataType), T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m, kept = units(pa.StructArray.from_arrays([batch.column(0), doubles(batch.column(1))], names=["id", "vec"]))
            angle = angles(m, shared.value)
            cell = angle.argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, batch.column(1).take(pa.array(kept)), pa.array(cell), pa.array(angle[np.arange(len(cell)), cell])], names=to.names)

    rows = df.where(F.size(vec) > 0).select(F.col(ident).alias("id"), F.col(vec).alias("vec"))
    return rows.mapInArrow(run, to).withColumn("ring", F.least(F.lit(RINGS - 1), F.floor(F.col("angle") * (RINGS / np.pi))).cast("int"))


def blocked(rows: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """The rows with their block, and (cell, least angle, greatest angle, rows) of each block.

    Neighbouring rings of a cell are put together up to ``size`` rows; a ring of more, such as many copies, is
    split by a hash of the ids.  What is on the driver are counts: at most :data:`RINGS` a cell, and a row a block.
    """
    counts = rows.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n")).collect()
    first, table, last, room = 0, [], None, 0
    for r in sorted(counts, key=lambda r: (r.cell, r.ring)):
        parts = -(-r.n // size)
        if parts > 1 or r.cell != last or r.n > room:
            start, room, first = first, parts * size, first + parts
        table.append((r.cell, r.ring, start, parts))
        last, room = r.cell, 0 if parts > 1 else room - r.n
    spark = rows.sparkSession
    names = spark.createDataFrame(table, "c int, g int, start int, parts int")
    dealt = rows.join(F.broadcast(names), (F.col("cell") == F.col("c")) & (F.col("ring") == F.col("g")))
    dealt = stored(dealt.withColumn("block", (F.col("start") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")).select("block", "id", "vec", "cell", "angle"), "blocks")
    rings = dealt.groupBy("block").agg(F.first("cell").alias("cell"), F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    out = np.zeros((first, 4))
    out[:, 3] = 0
    for r in rings:
        out[r.block] = r.cell, r.lo, r.hi, r.n
    return dealt, out


def gaps(rings: np.ndarray, others: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The least angle that a vector of each of ``rings`` can have to one of each of ``others``."""
    between = angles(pivots[rings[:, 0].astype(int)], pivots[others[:, 0].astype(int)])
    lo, hi = rings[:, 1:2], rings[:, 2:3]
    gap = np.maximum(between - hi - others[:, 2], np.maximum(others[:, 1] - between - hi, lo - between - others[:, 2]))
    return np.maximum(gap, 0.0)


def block_pairs(spark: SparkSession, rings: np.ndarray, others: np.ndarray, pivots: np.ndarray, bounds: dict[int, float] | None = None) -> DataFrame:
    """``q, b``: without bounds the :data:`FIRST` nearest base blocks of each query block, with them the others that may hold a better neighbour."""
    shared = spark.sparkContext.broadcast((rings, others, pivots, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, base, points, known = shared.value
        some = np.flatnonzero(base[:, 3] > 0)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                if not mine[k, 3]:
                    continue
                gap = gaps(mine[k : k + 1], base[some], points)[0]
                near = np.lexsort((some, angles(points[int(mine[k, 0])][None], points[base[some, 0].astype(int)])[0], gap))[:FIRST]
                if known is not None:
                    open_ = np.cos(gap) >= known.get(k, -2.0) - SLACK
                    open_[near] = False
                    near = np.flatnonzero(open_)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), k, np.int32)), pa.array(some[near].astype(np.int32))], names=["q", "b"])

    return spark.range(len(rings)).repartition(max(1, min(len(rings) // 64 + 1, 2000))).mapInArrow(run, "q int, b int")


def bundles(rings: np.ndarray, parts: int) -> int:
    """Blocks of a bundle if there are to be so many bundles."""
    return -(-len(rings) // parts)


def met(pairs: DataFrame, queries: DataFrame, base: DataFrame, to: T.StructType, decimals: int, own: bool, size: tuple[int, int]) -> DataFrame:
    """``id, neighbor, similarity, block``: the best of each query vector in each of the bundles its block meets; ``size`` are the blocks of a bundle of either side."""
    bundle = lambda c, n: F.floor(F.col(c) / n).cast("int")
    pairs = pairs.select("q", "b", bundle("q", size[0]).alias("i"), bundle("b", size[1]).alias("j"))
    wanted = pairs.groupBy("i", "j", "q").agg(F.collect_list("b").alias("others"))
    left = queries.join(wanted.select("i", "j", "q"), F.col("block") == F.col("q")).select("i", "j", "block", F.lit(None).cast("array<int>").alias("others"), "id", "vec")
    none = [F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in ("id", "vec")]
    left = left.unionByName(wanted.select("i", "j", F.col("q").alias("block"), "others", *none))  # what a block meets is sent once, not with every row
    right = base.join(pairs.select("i", "j", "b").distinct(), F.col("block") == F.col("b")).select(*[F.col(c).alias(c) for c in ("i", "j", "block", "id", "vec")])
    whole = T.StructType([*to.fields, T.StructField("block", T.IntegerType())])

    def struct(t: pa.Table, own_rows: np.ndarray) -> pa.StructArray:
        part = t.take(pa.array(own_rows))
        return pa.StructArray.from_arrays([part["id"].combine_chunks(), doubles(part["vec"].combine_chunks())], names=["id", "vec"])

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = []
        told = a.filter(pc.is_valid(a["others"]))
        others = dict(zip(told["block"].to_pylist(), told["others"].to_pylist(), strict=True))
        a = a.filter(pc.is_null(a["others"]))
        if a.num_rows and b.num_rows:
            rows = {int(k): np.flatnonzero(b["block"].to_numpy() == k) for k in np.unique(b["block"].to_numpy())}
            held = {k: units(struct(b, v))[:2] for k, v in rows.items()}
            mine = a["block"].to_numpy()
            for k in np.unique(mine):
                at = np.flatnonzero(mine == k)
                ids, m, _ = units(struct(a, at))
                top = None
                for other in others[int(k)]:
                    names, v = held[other]
                    order = pc.sort_indices(names)
                    names, s = names.take(order), np.round(m @ v[order.to_numpy()].T, decimals)
                    if not own:
                        same = pc.index_in(ids, value_set=names)
                        s[np.flatnonzero(same.is_valid().to_numpy(zero_copy_only=False)), same.drop_null().to_numpy()] = -np.inf
                    first = s.argmax(1)
                    found = pa.table([ids, names.take(pa.array(first)), pa.array(s[np.arange(len(ids)), first])], names=["id", "neighbor", "similarity"])
                    top = found if top is None else pa.concat_tables([top, found])
                top = most(top.filter(pc.is_finite(top["similarity"])))
                if top.num_rows:
                    parts.append(top.append_column("block", pa.array(np.full(top.num_rows, k, np.int32))))
        return pa.concat_tables(parts) if parts else pa.table({n: pa.array([], t) for n, t in zip(whole.names, (a["id"].type, b["id"].type, pa.float64(), pa.int32()), strict=True)})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, whole)


def nearest_pruned(queries: DataFrame, base: DataFrame, ident: str = "id", vec: str = "embedding", decimals: int = 9, block: int = BLOCK, own: bool = False) -> DataFrame:
    """The rows of :func:`cadenza.operators.neighbors.nearest`, without comparing blocks that cannot hold a neighbour.

    Vectors without length take no part; ties go to the smallest id.  The less the vectors lie in clusters, the fewer pairs of
    blocks go; in the worst case all of them meet.
    """
    spark = queries.sparkSession
    kinds = queries.schema[ident].dataType, base.schema[ident].dataType
    to = T.StructType([T.StructField("id", kinds[0]), T.StructField("neighbor", kinds[1]), T.StructField("similarity", T.DoubleType())])
    pivots = chosen_pivots(base, ident, vec, -(-base.count() // block))
    if not len(pivots):
        return spark.createDataFrame([], to)
    two, others = blocked(stored(placed(base, ident, vec, pivots), "placed"), block)
    one, rings = (two, others) if queries is base else blocked(stored(placed(queries, ident, vec, pivots), "placed"), block)
    size = tuple(bundles(r, n) for r, n in zip((rings, others), sides(int(rings[:, 3].sum()), int(others[:, 3].sum()), pivots.shape[1]), strict=True))
    first = stored(met(block_pairs(spark, rings, others, pivots), one, two, to, decimals, own, size), "first")
    per_row = first.groupBy("block", "id").agg(F.max("similarity").alias("s")).groupBy("block").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n"))
    bounds = {r.block: r.s for r in per_row.collect() if r.n == rings[r.block, 3]}
    rest = met(block_pairs(spark, rings, others, pivots, bounds), one, two, to, decimals, own, size)
    found = first.unionByName(rest)
    top = F.min(F.struct((-F.col("similarity")).alias("s"), "neighbor")).alias("m")
    return found.groupBy("id").agg(top).select("id", F.col("m.neighbor").alias("neighbor"), (-F.col("m.s")).alias("similarity"))
