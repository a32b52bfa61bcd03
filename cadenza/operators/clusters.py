"""Clusters of vectors: centroids, breadth, refinement, merging, chains, recommendation, TF-IDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cadenza.functions import vectors as V
from cadenza.operators import neighbors
from cadenza.operators.shared import stored

#: Clusters whose centroids may be broadcast, and bytes; beyond that the join is left to Spark.
FEW, FEW_BYTES = 10_000, 32 << 20


def means(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``key, pos, mean``: partial sums a key and position, so a hot key costs no more than others."""
    return df.select(key, F.posexplode(V.doubles(F.col(vec))).alias("pos", "v")).groupBy(key, "pos").agg(F.avg("v").alias("mean"))


def as_vectors(long: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Long rows (key, pos, value) as arrays in order of position."""
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias(out))


def centroids(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``key, centroid``; keys without any vector have a null centroid."""
    return df.select(key).distinct().join(as_vectors(means(df, key, vec), key, "mean", "centroid"), key, "left")


def few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows are at most :data:`FEW` and its values, as JSON, at most :data:`FEW_BYTES`."""
    size = df.limit(FEW + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("b")).first()
    return F.broadcast(df) if size.n <= FEW and (size.b or 0) <= FEW_BYTES else df


def breadth(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``key, breadth``: the mean distance of members from their centroid."""
    joined = df.join(few(centroids(df, key, vec)), key)
    return joined.groupBy(key).agg(F.avg(V.l2(F.col(vec), F.col("centroid"))).alias("breadth"))


def refine(df: DataFrame, ident: str, key: str, vec: str, limit: float = 0.4, decimals: int = 9) -> DataFrame:
    """``id, cluster, distance``: the nearest centroid by cosine distance if within ``limit``, else ``outliers``.

    Rows meet the centroids in block products, however many there are; ties go to the
    smallest key.  A vector without direction is an outlier without a distance.
    """
    centers = centroids(df, key, vec).withColumnRenamed("centroid", "__centroid")
    near = neighbors.nearest(df, centers, ident, vec, decimals, key, "__centroid", own=True).withColumnRenamed("id", "__id")
    rows = df.select(F.col(ident).alias("id")).join(near, F.col("id") == F.col("__id"), "left")
    d = F.round(1 - F.col("similarity"), decimals)
    return rows.select("id", F.when(d <= limit, F.col("neighbor").cast("string")).otherwise("outliers").alias("cluster"), d.alias("distance"))


def merge_plan(stats: list[tuple], threshold: float = 0.97, tolerance: float = 0.5) -> dict:
    """Which cluster each joins: leaders in the given order take later ones whose centroid
    cosine is above ``threshold``, whose breadth differs by at most ``tolerance`` of the mean, and that
    share a token.  ``stats``: (key, centroid, breadth, tokens); centroids are not recomputed."""
    root = {s[0]: s[0] for s in stats}
    for i, (k, c, b, t) in enumerate(stats):
        if root[k] != k or c is None:
            continue
        for k2, c2, b2, t2 in stats[i + 1 :]:
            if root[k2] != k2 or c2 is None:
                continue
            x, y = np.array(c), np.array(c2)
            n = np.linalg.norm(x) * np.linalg.norm(y)
            mean = (b + b2) / 2
            if n > 0 and x @ y / n > threshold and (mean == 0 or abs(b - b2) / mean <= tolerance) and set(t) & set(t2):
                root[k2] = k
    return root


def merge(df: DataFrame, key: str, vec: str, tokens: str, threshold: float = 0.97, tolerance: float = 0.5) -> DataFrame:
    """``key, merged_into``.  The greedy pass runs over one row a cluster on the driver, at most :data:`FEW`."""
    words = df.groupBy(key).agg(F.sort_array(F.collect_set(tokens)).alias("tokens"))
    stats = centroids(df, key, vec).join(breadth(df, key, vec), key, "left").join(words, key).orderBy(key).limit(FEW + 1).collect()
    if len(stats) > FEW:
        raise ValueError(f"more than {FEW} clusters")
    root = merge_plan([(r[key], r["centroid"], r["breadth"] or 0.0, r["tokens"]) for r in stats], threshold, tolerance)
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame(list(root.items()), f"{key} {kind}, merged_into {kind}")


def chain(df: DataFrame, ident: str, key: str, vec: str, decimals: int = 9) -> DataFrame:
    """``key, id, pos``: from the smallest id on, always the most similar one not yet taken; the smallest of equals.

    Ids and keys may be of any type that sorts.  Inherently one task a cluster; memory is the cluster's vectors, time its size squared.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        m = np.array(pdf["v"].tolist(), np.float64)
        n = np.sqrt((m * m).sum(1)) if len(m) else np.zeros(0)
        ids, m = pdf["id"].to_numpy()[n > 0], m[n > 0] / n[n > 0, None]
        left, out, at = np.ones(len(ids), bool), [], 0
        while left.any():
            out.append(ids[at])
            left[at] = False
            s = np.where(left, np.round(m @ m[at], decimals), -np.inf)
            at = int(s.argmax())
        return pd.DataFrame({"k": [pdf["k"].iloc[0]] * len(out), "id": out, "pos": np.arange(1, len(out) + 1)})

    to = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("id", df.schema[ident].dataType), T.StructField("pos", T.IntegerType())])
    rows = df.where(F.size(vec) > 0).select(F.col(key).alias("k"), F.col(ident).alias("id"), V.doubles(F.col(vec)).alias("v"))
    return rows.groupBy("k").applyInPandas(order, to).withColumnRenamed("k", key)


def chain_plan(first: np.ndarray, last: np.ndarray, start: np.ndarray | None, decimals: int = 9) -> list[int]:
    """The order of items (entered by their ``first`` vector, left by their ``last``): from ``start``, or else the first
    item, always the most similar one left; the first of equals.  Items without direction are left out."""
    sizes = [np.sqrt((x * x).sum(1)) for x in (first, last)]
    good = (sizes[0] > 0) & (sizes[1] > 0)
    one, two = (x / np.where(n > 0, n, 1)[:, None] for x, n in zip((first, last), sizes, strict=True))
    left, out, at = good.copy(), [], start
    while left.any():
        if at is None:
            k = int(np.flatnonzero(left)[0])
        else:
            k = int(np.where(left, np.round(one @ (at / np.linalg.norm(at)), decimals), -np.inf).argmax())
        out.append(k)
        left[k] = False
        at = two[k]
    return out


def curate(df: DataFrame, ident: str, key: str, vec: str, album: str, order: DataFrame, decimals: int = 9) -> DataFrame:
    """``cluster_ord, key, pos, id, album``: the chains of all clusters in the order of ``order`` (key, cluster_ord), each
    begun with what is nearest to the end of the one before.

    Rows with an ``album`` enter and leave their chain together, as a block: by its first
    row and by its last, in order of the ids.  The whole list is one sequence, so one cluster is chained after
    another, each in a task that has its blocks' first and last vectors; what goes from one to the next is the vector it ends with.
    """
    unit = F.coalesce(F.col(album).cast("string"), F.concat(F.lit("\0"), F.col(ident).cast("string"))).alias("unit")
    rows = df.where(V.usable(F.col(vec))).select(F.col(key).alias("k"), F.col(ident).alias("id"), F.col(album).alias("album"), V.doubles(F.col(vec)).alias("v"), unit)
    ends = rows.groupBy("k", "unit").agg(F.min(F.struct("id", "v")).alias("a"), F.max(F.struct("id", "v")).alias("z"))
    ends = stored(ends.select("k", "unit", F.col("a.id").alias("id"), F.col("a.v").alias("first"), F.col("z.v").alias("last")), "ends")
    placed, at, kind = None, None, df.schema[key].dataType
    to = T.StructType([T.StructField("cluster_ord", T.IntegerType()), T.StructField("c", kind), T.StructField("u", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("end", T.ArrayType(T.DoubleType()))])

    def chained(number: int, begin: np.ndarray | None):
        def run(units: pa.Table) -> pa.Table:
            units = units.sort_by("id").combine_chunks()
            first, last = (np.array(units[c].to_pylist(), np.float64) for c in ("first", "last"))
            plan = chain_plan(first, last, begin, decimals)
            order = pa.array(plan, pa.int64())
            n, ends_ = len(plan), [None] * (len(plan) - 1) + [last[plan[-1]].tolist()]
            return pa.Table.from_arrays([pa.array([number] * n, pa.int32()), units["k"].take(order), units["unit"].take(order), pa.array(np.arange(n), pa.int32()), pa.array(ends_, pa.list_(pa.float64()))], names=to.names)

        return run

    for name, number in sorted(((r[0], r[1]) for r in order.select(key, "cluster_ord").collect()), key=lambda x: x[1]):
        done = stored(ends.where(F.col("k") == name).groupBy("k").applyInArrow(chained(number, at), to), "chained")
        end = done.where("end is not null").select("end").first()
        if end is not None:
            at = np.array(end[0])
            placed = done if placed is None else placed.unionByName(done)
    if placed is None:
        placed = df.sparkSession.createDataFrame([], to)
    joined = rows.join(placed.drop("end"), (F.col("k") == F.col("c")) & (F.col("unit") == F.col("u")))
    w = Window.partitionBy("k").orderBy("at", "id")
    return joined.select("cluster_ord", F.col("k").alias(key), F.row_number().over(w).alias("pos"), "id", "album")


def cluster_order(sizes: DataFrame, key: str, related: DataFrame | None = None) -> DataFrame:
    """``key, cluster_ord`` of ``key, n``: the largest first, then always the first unused of ``related`` (key, other, rank)
    to the one before, else the next largest; names sort equals.

    Genres are few: the loop runs over one row each on the driver, after their number was checked.
    """
    rows = sizes.orderBy(F.desc("n"), key).limit(FEW + 1).collect()
    if len(rows) > FEW:
        raise ValueError(f"more than {FEW} clusters")
    names, links = [r[key] for r in rows], {}
    for r in related.where(F.col(key).isin(names) & F.col("other").isin(names)).orderBy(key, "rank").collect() if related is not None else ():
        links.setdefault(r[key], []).append(r["other"])
    left, out = dict.fromkeys(names), []
    while left:
        at = next((x for x in links.get(out[-1], ()) if x in left), None) if out else None
        at = next(iter(left)) if at is None else at
        out.append(at)
        del left[at]
    to = T.StructType([T.StructField(key, sizes.schema[key].dataType), T.StructField("cluster_ord", T.IntegerType())])
    return sizes.sparkSession.createDataFrame(list(zip(out, range(1, len(out) + 1), strict=True)), to)


def custom_order(base: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """``key, cluster_ord``: those of ``saved`` (key, ord) in its order, then the others in the order of ``base``."""
    both = base.join(saved.select(F.col(key).alias("__k"), F.col("ord")), F.col(key) == F.col("__k"), "left")
    # one row a cluster
    w = Window.orderBy(F.asc_nulls_last("ord"), "cluster_ord")
    return both.select(key, F.row_number().over(w).alias("cluster_ord"))


def alphabetical_order(sizes: DataFrame, key: str, last: str = "outliers") -> DataFrame:
    """``key, cluster_ord`` by name, ``last`` at the end; one row a cluster."""
    return sizes.select(key, F.row_number().over(Window.orderBy(F.col(key) == last, key)).alias("cluster_ord"))


def cluster_keys(df: DataFrame, code: str, genre: str) -> Column:
    """The cluster of a row: its genre code, else its genre, else ``unknown``."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(some(F.col(code)), some(F.col(genre)), F.lit("unknown"))


def token_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tokens``: the distinct lower-case comma-separated parts of all texts of a key, sorted."""
    parts = df.select(key, F.explode(F.split(F.lower(text), ",")).alias("t")).select(key, F.trim("t").alias("t")).where("t <> ''").distinct()
    return parts.groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("tokens"))


def like(df: DataFrame, rated: DataFrame, ident: str, vec: str, sigma: float = 0.15, least: float = 1e-3, decimals: int = 6, rating: str | None = None) -> DataFrame:
    """``id, rated, score``: rated ids keep their ``rating`` (1 or -1; without that column 1); the others
    1 - weighted mean distance to the rated vectors, weights Gaussian in the distance, 0 for opposite ones
    or where they sum to less than ``least``.  The value of a rating does not weigh.

    Blocks of rows and of rated vectors meet as matrices, and each pair's two sums a row
    are added up by id, so neither side is broadcast whole.
    """
    to = T.StructType([T.StructField("id", df.schema[ident].dataType), T.StructField("w", T.DoubleType()), T.StructField("wd", T.DoubleType())])

    def weigh(q: pa.StructArray, b: pa.StructArray) -> pa.RecordBatch | None:
        (qi, qm, _), (_, bm, _) = neighbors.units(q), neighbors.units(b)
        if not len(qi) or not len(bm):
            return None
        s = qm @ bm.T
        d = 1 - s
        w = np.where(s < 0, 0.0, np.exp(-(d * d) / (2 * sigma * sigma)))
        return pa.RecordBatch.from_arrays([qi, pa.array(w.sum(1)), pa.array((w * d).sum(1))], names=to.names)

    fold = lambda t: t.group_by("id").aggregate([("w", "sum"), ("wd", "sum")]).select(["id", "w_sum", "wd_sum"]).rename_columns(to.names)
    found = neighbors.products(df, rated, (ident, ident), (vec, vec), weigh, to, fold=fold)
    sums = found.groupBy(F.col("id").alias("s_id")).agg(F.sum("w").alias("w"), F.sum("wd").alias("wd"))
    value = F.col(rating).cast("double") if rating else F.lit(1.0)
    chosen = rated.select(F.col(ident).alias("r_id"), value.alias("value")).groupBy("r_id").agg(F.max("value").alias("value"))
    out = df.select(F.col(ident).alias("id")).join(sums, F.col("id") == F.col("s_id"), "left").join(chosen, F.col("id") == F.col("r_id"), "left")
    score = F.when(F.col("value").isNotNull(), F.col("value")).when(F.coalesce("w", F.lit(0.0)) < least, 0.0).otherwise(1 - F.col("wd") / F.col("w"))
    return out.select("id", F.col("value").isNotNull().alias("rated"), F.round(score, decimals).alias("score"))


def recommend(scores: DataFrame, threshold: float = 0.98) -> DataFrame:
    return scores.where(~F.col("rated") & (F.col("score") >= threshold) & (F.col("score") < 1)).select("id", "score")


def tfidf(df: DataFrame, track: str, vec: str, present: float = 1e-5) -> DataFrame:
    """``track, pos, tf, df, tfidf``: mean of a track's snippet vectors times -ln((df + 1e-10) / tracks), where df
    counts the tracks with any snippet above ``present`` in that dimension."""
    long = df.select(F.col(track).alias("track"), F.posexplode(V.doubles(F.col(vec))).alias("pos", "v"))
    per = long.groupBy("track", "pos").agg(F.avg("v").alias("tf"), (F.max("v") > present).cast("int").alias("has"))
    dims = per.groupBy("pos").agg(F.sum("has").alias("df"), F.count(F.lit(1)).alias("n"))
    return per.join(few(dims), "pos").select("track", "pos", "tf", "df", (F.col("tf") * -F.log((F.col("df") + 1e-10) / F.col("n"))).alias("tfidf"))


def assign_albums(df: DataFrame, ident: str, album: str, cluster: str, vec: str, token: str, threshold: float = 0.0, decimals: int = 9) -> DataFrame:
    """``album, cluster, overlap, similarity``: the cluster that shares most tokens with an album, then the
    most similar, then the smallest; ``outliers`` unless a token is shared and the similarity is at least
    ``threshold``.  An album that shares no token has overlap 0 and no similarity.

    Albums of one set of tokens are one row until the clusters that share most with the set are known, so a
    token that half of all albums have meets the clusters once a set.  Among several such clusters the most similar one is found in a
    matrix product with their centroids, if these are few; else by a join.
    """
    pairs = lambda k, name: df.select(F.col(k).alias(name), F.col(token).alias("t")).where("t is not null").distinct()
    sets = stored(pairs(album, "a").groupBy("a").agg(F.sort_array(F.collect_set("t")).alias("set")), "token-sets")
    each = sets.select("set").distinct().select("set", F.explode("set").alias("t"))
    shared = each.join(pairs(cluster, "c"), "t").groupBy("set", "c").agg(F.count(F.lit(1)).cast("int").alias("o"))
    most = shared.groupBy("set").agg(F.max("o").alias("o"))
    best = shared.join(most, ["set", "o"]).groupBy("set", "o").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    one = centroids(df, album, vec).select(F.col(album).alias("o_a"), F.col("centroid").alias("ac"))
    two = stored(centroids(df, cluster, vec).select(F.col(cluster).alias("o_c"), F.col("centroid").alias("cc")).where("cc is not null and o_c is not null"), "centroids")
    met = sets.join(best, "set").join(one, F.col("a") == F.col("o_a")).select("a", "o", "cs", "ac")
    size = two.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("cc") * 8).alias("b")).first()
    if size.n <= FEW and (size.b or 0) <= FEW_BYTES:
        alike = most_alike(met, two.orderBy("o_c").collect(), decimals, df.schema[cluster].dataType)
    else:
        every = met.select("a", "o", "ac", F.explode("cs").alias("c")).join(two, F.col("c") == F.col("o_c"))
        alike = every.select("a", "o", "c", F.round(V.cosine(F.col("ac"), F.col("cc")), decimals).alias("s"))
    top = alike.groupBy("a").agg(F.min(F.struct((-F.col("s")).alias("s"), "c", "o")).alias("b"))
    s, o = -F.col("b.s"), F.coalesce("b.o", F.lit(0))
    joined = df.select(album).distinct().join(top, F.col(album) == F.col("a"), "left")
    return joined.select(album, F.when(s >= threshold, F.col("b.c").cast("string")).otherwise("outliers").alias("cluster"), o.alias("overlap"), s.alias("similarity"))


def most_alike(met: DataFrame, clusters: list, decimals: int, kind: T.DataType) -> DataFrame:
    """``a, o, c, s`` of ``a, o, cs, ac``: the cluster of ``cs`` whose centroid is most like ``ac``, the first of equals."""
    centers = np.array([r.cc for r in clusters], np.float64)
    centers = centers / np.maximum(np.sqrt((centers * centers).sum(1, keepdims=True)), 1e-300) if len(centers) else centers
    shared = met.sparkSession.sparkContext.broadcast(([r.o_c for r in clusters], centers))
    to = T.StructType([met.schema["a"], met.schema["o"], T.StructField("c", kind), T.StructField("s", T.DoubleType())])

    def run(batches):
        names, m = shared.value
        place = {c: k for k, c in enumerate(names)}
        for batch in batches:
            out = []
            for a, o, cs, v in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                at = [place[c] for c in cs if c in place]
                n = np.linalg.norm(v) if v is not None else 0.0
                if at and n > 0:
                    s = np.round(m[at] @ (np.array(v) / n), decimals)
                    k = int(s.argmax())
                    out.append((a, o, names[at[k]], float(s[k])))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(to.names, r, strict=True)) for r in out], schema=pa.schema([(f.name, t) for f, t in zip(to, arrow, strict=True)]))

    arrow = [to_arrow_type(f.dataType) for f in to]
    return met.mapInArrow(run, to)


def pool_max(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(key, F.posexplode(V.doubles(F.col(vec))).alias("pos", "v")).groupBy(key, "pos").agg(F.max("v").alias("most"))


def pool(df: DataFrame, key: str, vec: str, how: str = "average") -> DataFrame:
    """``key, pos, value``: the vectors of a key (as of a track's slices) pooled by ``average`` or ``max``."""
    if how not in ("average", "max"):
        raise ValueError("vectors are pooled by average or max")
    out = means(df, key, vec) if how == "average" else pool_max(df, key, vec)
    return out.select(key, "pos", F.col("mean" if how == "average" else "most").alias("value"))


def project_2d(df: DataFrame, ident: str, vec: str) -> DataFrame:
    """``id, x, y``: the first two principal components, each with the sign that makes its largest loading positive.

    One pass sums what the covariance needs, a matrix of the vectors' dimension squared a
    task; only that matrix is on the driver.  Vectors that are null are left out.
    """
    rows = df.where(F.size(vec) > 0).select(F.col(ident).alias("id"), V.doubles(F.col(vec)).alias("v"))

    def sums(batches):
        total = None
        for b in batches:
            m = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            m = np.column_stack((np.ones(len(m)), m))
            total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size)), pa.array(total.ravel())], names=["at", "s"])

    found = rows.select("v").mapInArrow(sums, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    to = T.StructType([T.StructField("id", df.schema[ident].dataType), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    if not found:
        return df.sparkSession.createDataFrame([], to)
    m = np.array([r["s"] for r in found])
    m = m.reshape(int(len(m) ** 0.5), -1)
    mean = m[0, 1:] / m[0, 0]
    axes = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))[1][:, ::-1][:, :2]
    axes = np.column_stack((axes, np.zeros((len(axes), 2 - axes.shape[1])))) * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])

    def place(batches):
        for b in batches:
            p = (b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - mean) @ axes
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p[:, 0]), pa.array(p[:, 1])], names=to.names)

    return rows.mapInArrow(place, to)


def chain_blocks(df: DataFrame, ident: str, album: str, key: str, vec: str) -> DataFrame:
    """``album, key, first, last, tracks``: albums as units of a chain; those whose first and last track have vectors."""
    item = F.struct(F.col(ident).alias("id"), V.usable(F.col(vec)).alias("ok"))
    blocks = df.groupBy(key, album).agg(F.array_sort(F.collect_list(item)).alias("t"))
    ends = blocks.withColumn("a", F.element_at("t", 1)).withColumn("z", F.element_at("t", -1))
    return ends.where("a.ok and z.ok").select(album, key, F.col("a.id").alias("first"), F.col("z.id").alias("last"), F.size("t").alias("tracks"))


def winners(df: DataFrame, ident: str, vec: str, classes: int) -> DataFrame:
    """``class, wins, percent, share_percent``: how often each of the first values is a row's largest, and its share of their sum."""
    long = df.select(F.col(ident).alias("id"), F.posexplode(F.slice(V.doubles(F.col(vec)), 1, classes)).alias("class", "v"))
    w = Window.partitionBy("id").orderBy(F.desc("v"), "class")
    ranked = long.withColumn("r", F.row_number().over(w))
    per = ranked.groupBy("class").agg(F.count_if(F.col("r") == 1).alias("wins"), F.sum(F.abs("v")).alias("s"))
    total = per.agg(F.sum("wins").alias("n"), F.sum("s").alias("t"))
    return per.crossJoin(F.broadcast(total)).select("class", "wins", F.round(100 * F.col("wins") / F.col("n"), 4).alias("percent"), F.round(100 * F.col("s") / F.col("t"), 4).alias("share_percent"))
