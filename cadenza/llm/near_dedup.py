"""Near-duplicate documents by DartMinHash signatures and banded joining.

Sketch.  Every element (five-word shingle) owns a strip of the plane of weight and
rank; hashed darts fall on it as a Poisson process, the same for each document that
has the element.  A document collects the darts inside its element's weight and
below a rank in inverse proportion to its total weight; each dart belongs to one of
the signature's coordinates, and the earliest of a coordinate is its value.  The
work is about one dart a coordinate and log of their number, not elements times coordinates.

Candidates.  Documents with equal shingle sets fold into one.  Of the others each
band of coordinates is a key; every document of a key is linked with the key's
smallest one only, so a key of any size costs its own size.  The components of these
links hold every pair that shares a band.

Check.  The shingle sets of a component's documents are first compared with that of its
smallest one, which costs a group of near copies one row a document.  Those that are
not at least 0.8 alike with it (Jaccard) are open: pieces of them meet all pieces of
their component, and are linked by a search that drops a document from the index as
soon as it is linked.  Classes are the components of these exact links.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import hashing
from cadenza.llm.common import annotate, raw, read, small, stored
from cadenza.llm.graph import components

SIMILARITY = 0.8
#: A pair at 0.8 shares none of these bands once in 70,000 times.
BANDS, ROWS = 28, 5
COORDINATES = BANDS * ROWS
#: Darts of a signature: enough that all coordinates are hit but once in 150 documents, which throw on.
DARTS = COORDINATES * (np.log(COORDINATES) + 5)
#: Bytes of text sketched at once; its darts take some hundred times as much.
STEP = 384 << 10
#: Darts of an element drawn at once.
DRAW = 8
#: Documents and shingles that one checking task holds of a piece.
GROUP, GROUP_SHINGLES = 150, 500_000
SKETCH = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType(), False))]
)


def signatures(elements: np.ndarray, weights: np.ndarray, offsets: np.ndarray, coordinates: int = COORDINATES, darts: float = DARTS) -> np.ndarray:
    """The signature of each weighted set; a set without weight has zeros.

    Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.
    """
    rows = len(offsets) - 1
    out = np.zeros((rows, coordinates), np.uint64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    weight = np.bincount(row, weights, rows)
    # strips of unit width: a weight of 2.5 owns two whole ones and half of the third
    strips = np.ceil(weights).astype(np.int64)
    strip_of = np.repeat(np.arange(len(elements)), strips)
    level = np.arange(len(strip_of)) - np.repeat(np.cumsum(strips) - strips, strips)
    seed = hashing.mix(elements[strip_of] + level.astype(np.uint64) * np.uint64(hashing.BASE))
    room = weights[strip_of] - level
    owner = row[strip_of]
    todo = np.flatnonzero(weight > 0)
    reach = darts
    while len(todo):
        chosen = np.zeros(rows, bool)
        chosen[todo] = True
        live = np.flatnonzero(chosen[owner])
        limit = reach / weight
        rank, draw = np.zeros(len(live)), 0
        slots, ranks, values = [], [], []
        while len(live):
            names = hashing.mix(seed[live][:, None] + (draw + np.arange(1, DRAW + 1)).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            gaps = -np.log(((names >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53)
            when = rank[:, None] + np.cumsum(gaps, 1)
            more = hashing.mix(names)
            inside = (when <= limit[owner[live]][:, None]) & ((more & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32 < room[live][:, None])
            where = np.nonzero(inside)
            slots.append(owner[live][where[0]] * coordinates + ((more[where] >> np.uint64(32)) % np.uint64(coordinates)).astype(np.int64))
            ranks.append(when[where])
            values.append(names[where])
            stay = when[:, -1] <= limit[owner[live]]
            live, rank, draw = live[stay], when[stay, -1], draw + DRAW
        slots, ranks, values = np.concatenate(slots), np.concatenate(ranks), np.concatenate(values)
        order = np.argsort(ranks, kind="stable")[::-1]
        flat = np.zeros(rows * coordinates, np.uint64)
        flat[slots[order]] = values[order]  # the earliest is written last
        hit = np.zeros(rows * coordinates, bool)
        hit[slots] = True
        out[todo] = flat.reshape(rows, coordinates)[todo]
        todo = todo[~hit.reshape(rows, coordinates)[todo].all(1)]
        reach *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(hashing.BASE) + np.zeros((len(signature), BANDS), np.uint64)
    for k in range(ROWS):
        total = hashing.mix(total + parts[:, :, k])
    return total


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return hashing.distinct(*hashing.shingles(*hashing.words(*raw(texts))))


def sketcher() -> Callable[[pa.Array], list]:
    def judge(texts: pa.Array) -> list:
        values, counts, offsets = shingle_sets(texts)
        keys = band_keys(signatures(values, np.ones(len(values)), offsets))
        n = np.diff(offsets)
        sums = []
        for salt in (1, 2):
            total = np.append(np.uint64(0), np.cumsum(hashing.mix(values + np.uint64(salt))))
            sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
        flat = keys.view(np.int64)[n > 0].ravel()
        bounds = np.append(0, np.cumsum(np.where(n > 0, BANDS, 0))).astype(np.int32)
        return [pa.array(n, pa.int64()), *(pa.array(s, pa.int64()) for s in sums), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))]

    return judge


def setter() -> Callable[[pa.Array], list]:
    def judge(texts: pa.Array) -> list:
        values, _, offsets = shingle_sets(texts)
        return [pa.array([values[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())]

    return judge


def link(ids: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY, closed: np.ndarray | None = None, root: int | None = None) -> list[tuple[int, int]]:
    """Edges (member, first of its class) of the exact similarity graph's components; ``closed`` ones are known to be of the class of ``root``.

    A document leaves the index when it is reached; the index is built anew whenever
    half of it has left.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    waiting = np.ones(n, bool) if closed is None else ~closed
    left, held = int(waiting.sum()), 0
    starts = [([k], int(ids[k])) for k in np.argsort(ids, kind="stable").tolist() if waiting[k]]
    if closed is not None and closed.any():
        starts.insert(0, (np.flatnonzero(closed).tolist(), root))
    out: list[tuple[int, int]] = []
    for queue, first in starts:
        if not left:
            break
        if len(queue) == 1 and waiting[queue[0]]:
            waiting[queue[0]], left = False, left - 1
        elif closed is None or not closed[queue[0]]:
            continue  # reached before
        while queue and left:
            if not held or left <= held // 2:
                rest = np.flatnonzero(waiting)
                flat = np.concatenate([sets[i] for i in rest])
                by = np.argsort(flat, kind="stable")
                index, doc, held = flat[by], np.repeat(rest, sizes[rest])[by], left
            x = queue.pop()
            lo, hi = np.searchsorted(index, sets[x], "left"), np.searchsorted(index, sets[x], "right")
            count = hi - lo
            place = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
            shared = np.bincount(doc[place], minlength=n)
            near = np.flatnonzero(waiting & (shared > 0) & (shared >= similarity * (sizes + sizes[x] - shared) - 1e-9))
            waiting[near] = False
            left -= len(near)
            queue += near.tolist()
            out += [(int(ids[i]), first) for i in near]
    return out


def grouped(run: Callable[[np.ndarray, list[np.ndarray], pa.Table], list[tuple[int, int]]]) -> Callable[[pa.Table], pa.Table]:
    def edges(table: pa.Table) -> pa.Table:
        found = run(table.column("node").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")], table)
        return pa.table({"a": pa.array([e[0] for e in found], pa.int64()), "b": pa.array([e[1] for e in found], pa.int64())})

    return edges


def jaccard(one: np.ndarray, two: np.ndarray) -> float:
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return shared / (len(one) + len(two) - shared)


def root_links(sets: DataFrame) -> DataFrame:
    """Exact links ``a, b`` with the smallest document, in groups of ``root, part, node, set``; the root's own sets are in each."""

    def run(ids: np.ndarray, each: list[np.ndarray], table: pa.Table) -> list[tuple[int, int]]:
        root = table.column("root")[0].as_py()
        own = [x for i, x in zip(ids, each, strict=True) if i == root]
        return [(int(i), root) for i, x in zip(ids, each, strict=True) if i != root and any(jaccard(x, o) >= SIMILARITY - 1e-9 for o in own)]

    return sets.groupBy("root", "part").applyInArrow(grouped(run), "a long, b long")


def open_links(sets: DataFrame) -> DataFrame:
    """Exact links ``a, b`` inside the groups of ``root, one, two, node, closed, set``."""

    def run(ids: np.ndarray, each: list[np.ndarray], table: pa.Table) -> list[tuple[int, int]]:
        closed = table.column("closed").to_numpy()
        return link(ids, each, SIMILARITY, closed, table.column("root")[0].as_py())

    return sets.groupBy("root", "one", "two").applyInArrow(grouped(run), "a long, b long")


def either_side(table: DataFrame, *text: str) -> DataFrame:
    """``table``, broadcast if it was measured as small."""
    return F.broadcast(table) if small(table, *text) else table


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``id, class_id, kept``.

    ``class_id`` is the smallest id of the documents connected by chains of pairs with a
    Jaccard similarity of at least 0.8 of their five-word shingles (a text of fewer
    words is one shingle).  ``kept`` marks rows whose id is the class id.  Null texts
    and texts without words are alone; a row with a null id is kept, its class is null.
    Rows with one id are one document: all their texts count, and they share its class.
    An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sketch = stored(annotate(slim, "text", SKETCH, sketcher, limit=STEP), "sketch")
    whole = sketch.where(F.col("id").isNotNull() & (F.col("n") > 0))
    reps = stored(
        whole.groupBy("h1", "h2").agg(F.min(F.struct("id", "n", "keys")).alias("r")).select("h1", "h2", F.col("r.id").alias("rep"), F.col("r.n").alias("size"), F.col("r.keys").alias("keys")),
        "reps",
    )
    bands = reps.select("rep", F.explode("keys").alias("key"))
    leads = bands.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("lead")).where("c > 1").select("k", "lead")
    stars = bands.join(leads, F.col("key") == F.col("k")).where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
    nodes = stored(components(stars.distinct()), "nodes")

    counted = reps.select("rep", "size").join(nodes, F.col("rep") == F.col("node")).groupBy(F.col("root").alias("r")).agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(GROUP), F.sum("size") / F.lit(GROUP_SHINGLES))).cast("int").alias("pieces")
    )
    dealt = nodes.join(counted, F.col("root") == F.col("r")).select("node", "root", "pieces", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("own"))
    dealt = stored(dealt, "dealt")
    texts = slim.join(either_side(dealt), F.col("id") == F.col("node"))
    texts = texts.dropDuplicates(["node", "text"]) if repeated(sketch) else texts
    sets = stored(annotate(texts.select("node", "root", "pieces", "own", "text"), "text", T.StructType([T.StructField("set", T.BinaryType())]), setter), "sets")
    every = F.explode(F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array("own"))).alias("part")
    first = stored(root_links(sets.select("root", "node", "set", every)), "root-links")

    closed = first.select(F.col("a").alias("c")).distinct()
    marked = dealt.join(either_side(closed), F.col("node") == F.col("c"), "left")
    marked = marked.select("node", "root", "pieces", "own", (F.col("c").isNotNull() | (F.col("node") == F.col("root"))).alias("closed"))
    opens = marked.where("not closed").groupBy(F.col("root").alias("o_root")).agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).cast("int").alias("open_pieces"))
    todo = stored(marked.join(either_side(stored(opens, "open-roots")), F.col("root") == F.col("o_root")).select(F.col("node").alias("t_node"), "closed", "open_pieces"), "open")
    held = sets.join(either_side(todo), F.col("node") == F.col("t_node")).select("root", "node", "closed", "set", "pieces", "own", "open_pieces")
    one, two = F.pmod(F.xxhash64("node", F.lit(1)), F.col("open_pieces")).cast("int"), F.col("own")
    every_two = held.where("not closed").select("root", "node", "closed", "set", one.alias("one"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("two"))
    every_one = held.select("root", "node", "closed", "set", F.explode(F.sequence(F.lit(0), F.col("open_pieces") - 1)).alias("one"), two.alias("two"))
    twice = ~F.col("closed") & (one == F.col("one"))  # an open document that is in both pieces
    links = first.unionByName(open_links(every_two.unionByName(every_one.where(~twice))))
    classes = components(stored(links, "checked")).withColumnRenamed("root", "class")

    named = reps.select("h1", "h2", "rep").join(classes, F.col("rep") == F.col("node"), "left").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.coalesce("class", "rep").alias("class"))
    least = F.coalesce("class", "id")
    joined = sketch.join(stored(named, "classes"), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    return joined.select(F.col("id").alias(id_col), least.alias("class_id"), F.coalesce(F.col("id") == least, F.lit(True)).alias("kept"))


def repeated(sketch: DataFrame) -> bool:
    """Whether an id stands in several rows."""
    return sketch.where(F.col("id").isNotNull()).groupBy("id").count().where("count > 1").limit(1).count() > 0


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
