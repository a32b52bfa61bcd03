"""Embedding near-dedup by NN-descent.

Equal vectors are one node.  A node carries a sketch, the signs of its vector on ``BITS`` random
directions; sketches of two vectors differ in a share of bits that is their angle, so lists of
neighbours are kept by differing bits and 32 bytes move where a vector would have to.

1. *Seeds.*  Nodes are sorted by some of their bits in several random orders; in each window of
   ``WINDOW`` nodes in a row the nearest meet, and a spanning forest of all close ones is noted too,
   so that a list full of nearer copies does not hide that two groups are linked.
2. *Descent.*  At each node the neighbours it has, and those that have it, are compared with one another, if
   one of the two is new to its list; every node keeps the nearest it has heard of.  This repeats
   until next to no list changes.
3. *Threshold.*  Close pairs are compared in double precision; connected components of the links follow.
4. *Saturation.*  A list that is full of close nodes may leave out others.  It is enlarged to all of
   its component by block products that only count, so no pair of a large group becomes a row.
5. *Audit.*  A sample of nodes is compared with all nodes.  If links are missing, more seeds are sown
   and the descent goes on from the lists that are there.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import forget, read, small, stored, tidy
from cadenza.llm.graph import components

THRESHOLD = 0.95
BITS = 256
WORDS = BITS // 64
SKETCH = [f"s{k}" for k in range(WORDS)]
#: Neighbours of a list, and how many nodes that have a node in their lists it takes up at a time.
LIST, REVERSE = 8, 8
#: Random orders, nodes of a window, and neighbours that a node takes from one.
ORDERS, WINDOW, NEAREST = 6, 64, 4
#: Rounds of descent at most, and the shares of list entries, and of close ones, below which changes count as none.
ROUNDS, SETTLED, CLOSE_SETTLED = 10, 0.02, 0.001
#: Nodes of the audit's sample, the recall it asks for, and how often seeds are sown.
AUDIT, RECALL, PASSES = 1024, 0.995, 4
#: Vectors of a block of a component: eight times the root of its size, within these bounds.
BLOCK = 256, 2048
FAR = 1 << 14


def reach(threshold: float) -> int:
    """Differing bits that a pair at the threshold exceeds about once in ten million times."""
    p = math.acos(threshold) / math.pi
    return math.ceil(BITS * p + 5.2 * math.sqrt(BITS * p * (1 - p)))


@cache
def directions(size: int) -> np.ndarray:
    return np.random.default_rng(size).standard_normal((size, BITS))


def padded(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix, padded by zeros, and their lengths; null components are NaN, null vectors empty."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(vectors.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def unit(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that have a direction as unit vectors, and their lengths."""
    m, size = padded(vectors)
    m = m / np.abs(m).max(1, initial=0, keepdims=True) if m.size else m
    return m / np.sqrt((m * m).sum(1, keepdims=True)), size


def linked(left: pa.Array, right: pa.Array, threshold: float) -> np.ndarray:
    """Which of the left vectors reach the threshold with which of the right ones; lengths have to agree."""
    (a, m), (b, n) = unit(left), unit(right)
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    return (a @ b.T >= threshold) & (m[:, None] == n)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of sketches along the last axis."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the job that made them ends, as everything that is used again is a stored table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sketched(vectors: DataFrame, ident: str, vec: str) -> DataFrame:
    """``id, key, vec, s0..``: a digest of each vector's components and its sketch, null where it has no direction or no id."""
    exact = "array<float>" if vectors.schema[vec].dataType.simpleString() == "array<float>" else "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, size = padded(batch.column(1))
            valid = np.isfinite(m).all(1) & (m != 0).any(1) & pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)
            keys, bits = [None] * len(m), np.zeros((len(m), WORDS), np.int64)
            for n in np.unique(size[valid]).tolist():
                own = np.flatnonzero(valid & (size == n))
                part = m[own, :n] + 0.0
                for i, row in zip(own.tolist(), part, strict=True):
                    keys[i] = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
                signs = (part / np.abs(part).max(1, keepdims=True)) @ directions(n) > 0
                bits[own] = np.ascontiguousarray(np.packbits(signs, axis=1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1), *[pa.array(bits[:, k]) for k in range(WORDS)]], names=["id", "key", "vec", *SKETCH])

    kind = vectors.schema[ident].dataType.simpleString()
    rows = vectors.select(F.col(ident).alias("id"), F.col(vec).cast(exact).alias("vec"))
    return rows.mapInArrow(tidy(run), f"id {kind}, key binary, vec {exact}, " + ", ".join(f"{s} long" for s in SKETCH))


def nodes_of(rows: DataFrame) -> DataFrame:
    """``node, id, key, weight, vec, s0..``: one row a distinct vector; nodes are numbered in the order of their smallest ids."""
    same = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), *[F.first(c).alias(c) for c in ("vec", *SKETCH)])
    return same.repartitionByRange("id").sortWithinPartitions("id").withColumn("node", F.monotonically_increasing_id())


def sketch_matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(s).to_numpy() for s in SKETCH], axis=1).view(np.uint64)


def nearest_and_forest(node: np.ndarray, sketch: np.ndarray, near: int) -> tuple[np.ndarray, ...]:
    """Of windows (window, node): each node's nearest, and a forest that spans the nodes at most ``near`` bits apart: u, v, bits, forest."""
    g, m = node.shape
    d = differing(sketch[:, :, None], sketch[:, None]).astype(np.int16)
    d[:, np.arange(m), np.arange(m)] = FAR
    k = min(NEAREST, m - 1)
    best = np.argpartition(d, k - 1, axis=2)[:, :, :k]
    w, u = np.repeat(np.arange(g), m * k), np.tile(np.repeat(np.arange(m), k), g)
    v = best.ravel()
    root, parent = np.tile(np.arange(m), (g, 1)), np.tile(np.arange(m), (g, 1))
    active = np.flatnonzero((d <= near).any((1, 2)))
    while len(active):
        seen = np.where(d[active] <= near, root[active][:, None, :], m)
        least, via = seen.min(2), seen.argmin(2)
        lower = least < root[active]
        parent[active] = np.where(lower, via, parent[active])
        root[active] = np.where(lower, least, root[active])
        active = active[lower.any(1)]
    fw, fu = np.nonzero(parent != np.arange(m))
    fv = parent[fw, fu]
    w, u, v = np.append(w, fw), np.append(u, fu), np.append(v, fv)
    return node[w, u], node[w, v], d[w, u, v], np.arange(len(w)) >= len(v) - len(fv)


def sown(nodes: DataFrame, seed: int, near: int) -> DataFrame:
    """``u, v, bits, forest``: pairs that meet in windows of the nodes in random orders."""
    bits = [np.random.default_rng((seed, k)).permutation(BITS)[:64] for k in range(ORDERS)]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = np.unpackbits(sketch_matrix(batch).view(np.uint8).reshape(-1, BITS // 8), axis=1)
            for k, chosen in enumerate(bits):
                key = np.packbits(np.ascontiguousarray(flags[:, chosen]), axis=1).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key.view(np.int64)), *batch.columns], names=["way", "key", "node", *SKETCH])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                if held.num_rows < 16 * WINDOW:
                    continue
            if held is None:
                return
            held = held.combine_chunks()
            way, node, sketch = held["way"].to_numpy(), held["node"].to_numpy(), sketch_matrix(held)
            ends = [*(np.flatnonzero(np.diff(way)) + 1).tolist(), len(way)]
            start = 0
            for end in ends:
                whole = (end - start) // WINDOW * WINDOW
                parts = [(start, start + whole, WINDOW)] if whole else []
                if end - start > whole + 1 and (batch is None or end < len(way)):
                    parts.append((start + whole, end, end - start - whole))
                for a, b, m in parts:
                    for x in range(a, b, 64 * m):
                        y = min(b, x + 64 * m)
                        u, v, d, forest = nearest_and_forest(node[x:y].reshape(-1, m), sketch[x:y].reshape(-1, m, WORDS), near)
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d.astype(np.int16)), pa.array(forest)], names=["u", "v", "bits", "forest"])
                rest = start + whole
                start = end
            held = held.slice(rest) if batch is not None else None

    columns = ", ".join(f"{s} long" for s in SKETCH)
    ordered = nodes.select("node", *SKETCH).mapInArrow(tidy(order), f"way int, key long, node long, {columns}")
    ordered = ordered.repartitionByRange("way", "key", "node").sortWithinPartitions("way", "key", "node")
    return ordered.mapInArrow(tidy(meet), "u long, v long, bits short, forest boolean")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, then None."""
    yield from (b for b in batches if b.num_rows)
    yield None


def lists(pairs: DataFrame) -> DataFrame:
    """The ``LIST`` nearest of each ``u`` in ``u, v, bits, new``; a pair that is there more than once counts once, and as old if any is."""
    tie = F.xxhash64("v", "u")
    near = pairs.withColumn("place", F.dense_rank().over(Window.partitionBy("u").orderBy("bits", tie))).where(F.col("place") <= LIST)
    once = near.withColumn("again", F.row_number().over(Window.partitionBy("u", "v").orderBy("new"))).where("again = 1")
    return once.select("u", "v", "bits", "new")


def descended(edges: DataFrame, nodes: DataFrame, spread: int) -> DataFrame:
    """One round: the members of each node's neighbourhood meet, and every list takes what is nearer."""
    full = edges.groupBy("u").agg(F.max("bits").alias("bits"), F.count(F.lit(1)).alias("n")).select("u", F.when(F.col("n") >= LIST, F.col("bits")).alias("worst"))
    state = nodes.select("node", *SKETCH).join(full, F.col("node") == F.col("u"), "left").drop("u")
    forward = edges.select(F.col("u").alias("center"), F.col("v").alias("member"), "new")
    back = edges.select(F.col("v").alias("center"), F.col("u").alias("member"), "new")
    some = Window.partitionBy("center").orderBy(F.desc("new"), F.xxhash64("member", "center", F.lit(spread)))
    back = back.withColumn("place", F.row_number().over(some)).where(F.col("place") <= REVERSE).drop("place")
    members = forward.unionByName(back).join(state, F.col("member") == F.col("node")).select("center", "member", "new", F.coalesce("worst", F.lit(FAR)).cast("short").alias("worst"), *SKETCH)
    size = LIST + REVERSE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held is None:
                return
            held = held.combine_chunks()
            center = held["center"].to_numpy()
            start = np.flatnonzero(np.append(True, np.diff(center) != 0))
            stop = held.num_rows if batch is None else int(start[-1])
            if not stop:
                continue
            count = np.diff(np.append(start[start < stop], stop))
            row = np.full((len(count), size), -1)
            row[np.repeat(np.arange(len(count)), count), np.arange(stop) - np.repeat(start[: len(count)], count)] = np.arange(stop)
            member, new, worst, sketch = held["member"].to_numpy(), held["new"].to_numpy(), held["worst"].to_numpy(), sketch_matrix(held)
            out = []
            for a in range(0, len(row), 4096):
                r = row[a : a + 4096]
                for k in range(size - 1):
                    p, q = np.broadcast_to(r[:, k : k + 1], r[:, k + 1 :].shape).ravel(), r[:, k + 1 :].ravel()
                    both = np.flatnonzero((p >= 0) & (q >= 0))
                    p, q = p[both], q[both]
                    both = (new[p] | new[q]) & (member[p] != member[q])
                    p, q = p[both], q[both]
                    d = differing(sketch[p], sketch[q])
                    for x, y in ((p, q), (q, p)):
                        better = d < worst[x]
                        out.append(np.stack([member[x[better]], member[y[better]], d[better]]))
            u, v, d = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d.astype(np.int16))], names=["u", "v", "bits"])
            held = held.slice(stop)

    met = members.repartition("center").sortWithinPartitions("center").mapInArrow(tidy(run), "u long, v long, bits short")
    return lists(edges.select("u", "v", "bits", F.lit(False).alias("new")).unionByName(met.withColumn("new", F.lit(True))))


def descent(edges: DataFrame, nodes: DataFrame, near: int) -> DataFrame:
    """Rounds until few lists change and next to none by a close node; each is a stored table, the one before is deleted.

    What is kept in the end are close pairs, so lists of nodes far from all others need not be perfect.
    """
    for k in range(ROUNDS):
        last, edges = edges, stored(descended(edges, nodes, k), "lists")
        forget(last)
        close = F.col("bits") <= near
        n = edges.agg(F.count(F.lit(1)).alias("all"), F.count_if("new").alias("new"), F.count_if(close).alias("close"), F.count_if(close & F.col("new")).alias("new_close")).first()
        if n.new <= SETTLED * n["all"] and n.new_close <= CLOSE_SETTLED * n.close:
            break
    return edges


def checked(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``a, b, wa, wb``: the pairs that reach the threshold in double precision, with the weights of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, m), (b, n) = unit(batch.column(4)), unit(batch.column(5))
            wide = max(a.shape[1], b.shape[1])
            a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
            close = ((a * b).sum(1) >= threshold) & (m == n)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "wa", "wb"]).filter(pa.array(close))

    one = nodes.select(F.col("node").alias("a"), F.col("weight").alias("wa"), F.col("vec").alias("va"))
    two = nodes.select(F.col("node").alias("b"), F.col("weight").alias("wb"), F.col("vec").alias("vb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "wa", "wb", "va", "vb")
    return both.mapInArrow(tidy(run), "a long, b long, wa long, wb long")


def enlarged(groups: DataFrame, full: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``node, n``: links of nodes with full lists to all of their component, and of its other nodes to these.

    Both sides of a component are dealt in blocks; a task counts the links between two blocks.
    """
    members = groups.join(full.withColumn("full", F.lit(True)), groups.node == full.u, "left").select("node", "root", F.coalesce("full", F.lit(False)).alias("full"))
    size = stored(members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("full").alias("any")).where("any").select(F.col("root").alias("r"), F.ceil(F.col("n") / F.greatest(F.lit(BLOCK[0]), F.least(F.lit(BLOCK[1]), 8 * F.sqrt("n")))).cast("int").alias("blocks")), "sizes")
    whole = members.join(F.broadcast(size) if small(size) else size, F.col("root") == F.col("r")).join(nodes.select(F.col("node").alias("m"), "weight", "vec"), F.col("node") == F.col("m"))
    whole = whole.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    whole = stored(whole.select("root", "own", "blocks", "node", "weight", "full", "vec"), "dealt")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = whole.where("full").select("root", F.col("own").alias("i"), other.alias("j"), "node", "weight", "vec")
    named = [F.col(c).alias(c) for c in ("root", "node", "weight", "full", "vec")]
    right = whole.select(other.alias("i"), F.col("own").alias("j"), *named)

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        na, nb = a["node"].to_numpy(), b["node"].to_numpy()
        if not len(na) or not len(nb):
            return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        close = linked(a["vec"].combine_chunks(), b["vec"].combine_chunks(), threshold) & (na[:, None] != nb)
        rest = np.flatnonzero(~b["full"].to_numpy())
        n = np.append(close @ b["weight"].to_numpy(), a["weight"].to_numpy() @ close[:, rest])
        some = n > 0
        return pa.table({"node": np.append(na, nb[rest])[some], "n": n[some].astype(np.int64)})

    keys = ("root", "i", "j")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(count, "node long, n long")


def audited(nodes: DataFrame, degrees: DataFrame, threshold: float, seed: int) -> float:
    """The share of a sample's links that were found: ``AUDIT`` nodes against all nodes."""
    chosen = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(AUDIT).select("node", "vec").collect()
    if not chosen:
        return 1.0
    names = np.array([r.node for r in chosen])
    shared = nodes.sparkSession.sparkContext.broadcast(pa.array([r.vec for r in chosen], pa.list_(pa.float64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(names), np.int64)
        for batch in batches:
            close = linked(shared.value, batch.column(2), threshold) & (names[:, None] != batch.column(0).to_numpy())
            n += close @ batch.column(1).to_numpy()
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(n[some])], names=["node", "true"])

    truth = nodes.select("node", "weight", "vec").mapInArrow(tidy(run), "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    found = truth.join(degrees, "node", "left").agg(F.sum(F.least("true", F.coalesce("n", F.lit(0)))).alias("found"), F.sum("true").alias("true")).first()
    return found["found"] / found["true"] if found["true"] else 1.0


def embedding_dedup(vectors: DataFrame, ident: str = "vec_id", vec: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``id, n_links, component_id, kept`` for each row of vectors.

    Vectors that are null, empty or zero, or hold a null or a component that is not finite, link with nothing, nor do
    vectors of different lengths or rows without an id (these are kept, their component is null).
    Rows of one id are vectors of their own.  An empty table gives no rows.
    """
    spark, near = vectors.sparkSession, reach(threshold)
    with swept(spark):
        rows = stored(sketched(vectors, ident, vec), "vectors")
        nodes = stored(nodes_of(rows), "nodes")
        edges, forest = None, None
        for attempt in range(PASSES):
            seeds = stored(sown(nodes, attempt, near), "seeds")
            first = seeds.where("not forest").select("u", "v", "bits", F.lit(True).alias("new"))
            old, edges = edges, stored(lists(first if edges is None else first.unionByName(edges.withColumn("new", F.lit(False)))), "lists")
            bridges = stored(seeds.where("forest").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "bridges")
            forest = bridges if forest is None else forest.unionByName(bridges)
            forget(seeds, *([old] if old is not None else []))
            edges = descent(edges, nodes, near)
            close = edges.where(F.col("bits") <= near)
            pairs = close.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).unionByName(forest).distinct()
            links = stored(checked(pairs, nodes, threshold), "links")
            full = stored(close.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LIST).select("u"), "full")
            groups = stored(components(links), "groups")
            both = links.select(F.col("a").alias("node"), F.col("b").alias("other"), F.col("wb").alias("n")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"), F.col("wa").alias("n")))
            side = F.broadcast(full) if small(full) else full
            open_ = both.join(side, both.node == full.u, "left_anti").join(side, F.col("other") == full.u, "left_anti").select("node", "n")
            degrees = stored(open_.unionByName(enlarged(groups, full, nodes, threshold)).groupBy("node").agg(F.sum("n").alias("n")), "degrees")
            if audited(nodes, degrees, threshold, attempt) >= RECALL:
                break
        roots = groups.select("root").distinct().join(nodes.select(F.col("node").alias("root"), F.col("id").alias("component")), "root")
        roots = stored(roots, "roots")
        named = groups.join(F.broadcast(roots) if small(roots) else roots, "root").select("node", "component")
        some = nodes.select("node", "id", "key", "weight").join(degrees, "node", "left").join(named, "node", "left").where("weight > 1 or component is not null")
        known = stored(some.select(F.col("key").alias("k"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("component")), "known")
    out = rows.select("id", "key").join(F.broadcast(known) if small(known) else known, F.col("key") == F.col("k"), "left")
    out = out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")


SQL = rf"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0, false) AS ok
  FROM embeddings),
u AS (SELECT vec_id, list_transform(x, lambda c: c / sqrt(list_inner_product(x, x))) AS x FROM v WHERE ok),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) >= {THRESHOLD}),
reached(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, links.b FROM reached r JOIN links ON r.b = links.a),
g AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, g.component_id, v.vec_id = g.component_id AS kept
FROM v JOIN g ON v.vec_id = g.vec_id LEFT JOIN n ON v.vec_id = n.vec_id
"""
