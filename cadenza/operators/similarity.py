"""Joins of texts that are alike, by inverted indexes over grams and tokens.

A ratio of c leaves at most (1 - c) of both lengths T = l + m unmatched, so at least c T / 2 characters match, in at most
(1 - c) T + 1 runs.  Two texts thus share at least c T / 2 characters (a one-gram is a character) and, as a run of n has n - 1
two-grams, c T / 2 - (1 - c) T - 1 two-grams.  If a text has n grams and must share r of them, any partner shares one of its
n - r + 1 rarest, so only these go into the join; whether r are shared is counted before anything is compared.

Two-grams serve pairs long enough for a bound of 1, one-grams the shorter ones and cutoffs of 2/3 or less.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import length_bound, token_set_ratio
from cadenza.operators.shared import stored

#: Grams up to which their counts are broadcast.
FEW_GRAMS = 100_000
EPSILON = 1e-9
#: Names of a block in the first round of a search and in the second, texts and bytes of a block of the other side.
SOUGHT, SOUGHT_AGAIN, HELD, HELD_BYTES = 8192, 32_768, 131_072, 8 << 20
#: Texts of a leaf and leaves that are opened at once, classes of characters and of two-grams.
LEAF, AT_ONCE, CHARACTERS, TWOS = 64, 8, 97, 251


def numbered(items: Column) -> Column:
    """A sorted bag as a set: every item with how often it came before, so equal items differ."""
    return F.transform(items, lambda x, i: F.concat(x, F.lit("\x00"), (i - F.array_position(items, x)).cast("string")))


def grams_of(text: Column, size: int) -> Column:
    """The bag of a text's grams of ``size`` characters, as a set."""
    n = F.length(text) - (size - 1)
    all_ = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array())
    return F.transform(F.array(F.sort_array(all_)), numbered).getItem(0)


def needed(total: Column, cutoff: float, size: int) -> Column:
    """Grams that two texts of ``total`` characters share at least if their ratio reaches the cutoff."""
    return F.ceil(total * (cutoff / 2 - (size - 1) * (1 - cutoff)) - (size - 1) - EPSILON).cast("int")


def shortest_for_pairs(cutoff: float) -> int:
    """Total length from which two-grams have a bound of at least 1."""
    slope = 1.5 * cutoff - 1
    return math.ceil(2 / slope) if slope > 1e-6 else 1 << 30


def indexed(texts: DataFrame, cutoff: float, any_order: bool) -> DataFrame:
    """``text, size, grams, keep``: the grams of a text for each kind of pair it can be in, and how many of the rarest of them to look up."""
    n, two = F.length("text"), shortest_for_pairs(cutoff)
    least = 2.0 * n / (2 - cutoff)  # total length with the shortest partner there can be
    padded = F.concat(F.lit(" "), "text", F.lit(" ")) if any_order else F.col("text")
    grams = grams_of(padded, 2)
    long = texts.where(2.0 * n / cutoff >= two - EPSILON).select("text", F.lit(2).alias("size"), grams.alias("grams"), F.greatest(needed(F.greatest(least, F.lit(float(two))), cutoff, 2), F.lit(1)).alias("r"))
    empty = F.array(F.lit(""))
    ones = F.when(n > 0, grams_of(F.col("text"), 1)).otherwise(empty)
    short = texts.where(least < two).select("text", F.lit(1).alias("size"), ones.alias("grams"), F.greatest(needed(least, cutoff, 1), F.lit(1)).alias("r"))
    both = long.unionByName(short)
    return both.select("text", "size", "grams", F.greatest(F.size("grams") - F.col("r") + 1, F.lit(1)).alias("keep")).where(F.size("grams") > 0)


def rare_first(rows: DataFrame, counts: DataFrame, few: bool, more: list[str]) -> DataFrame:
    """``rows`` (text, size, grams and ``more``) with the grams in the order of how many texts have them."""
    each = rows.select("text", "size", *more, F.explode("grams").alias("gram"))
    known = each.join(F.broadcast(counts) if few else counts, ["size", "gram"])
    return known.groupBy("text", "size", *more).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "gram"))), lambda x: x["gram"]).alias("grams"))


def alike_texts(left: DataFrame, right: DataFrame, cutoff: float, any_order: bool = False) -> DataFrame:
    """``a, b``: all pairs of distinct texts (``text`` of either side) whose ratio can reach ``cutoff`` (above 0), and some whose ratio does not.

    With ``any_order`` also if the words of one side may be put in another order.  Every pair comes once.
    """
    one, two = (indexed(d.select("text").where(F.col("text").isNotNull()).distinct(), cutoff, any_order) for d in (left, right))
    counts = one.unionByName(two).select("size", F.explode("grams").alias("gram")).groupBy("size", "gram").agg(F.count(F.lit(1)).alias("n"))
    few = counts.limit(FEW_GRAMS + 1).count() <= FEW_GRAMS
    sides = []
    for rows, name in ((one, "a"), (two, "b")):
        ordered = rare_first(rows, counts, few, ["keep"])
        sides.append(ordered.select(F.col("text").alias(name), F.col("size").alias(f"{name}_size"), F.col("grams").alias(f"{name}_grams"), F.slice("grams", F.lit(1), F.col("keep")).alias(f"{name}_rare")))
    a = sides[0].withColumn("a_gram", F.explode("a_rare"))
    b = sides[1].withColumn("b_gram", F.explode("b_rare"))
    total = F.length("a") + F.length("b")
    met = a.join(b, (F.col("a_size") == F.col("b_size")) & (F.col("a_gram") == F.col("b_gram")))
    kind = F.when(total >= shortest_for_pairs(cutoff), 2).otherwise(1) == F.col("a_size")
    first = F.element_at(F.array_intersect("a_rare", "b_rare"), 1) == F.col("a_gram")  # a pair may meet at several grams
    shared = F.size(F.array_intersect("a_grams", "b_grams"))
    enough = shared >= F.when(F.col("a_size") == 2, needed(total, cutoff, 2)).otherwise(needed(total, cutoff, 1))
    return met.where(kind & (length_bound(F.col("a"), F.col("b")) >= cutoff - EPSILON)).where(first).where(enough).select("a", "b")


def alike_pairs(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float) -> DataFrame:
    """All pairs of rows whose texts can be ``cutoff`` (above 0) alike, and some that are not; rows without a text are in none."""
    pairs = alike_texts(left.select(F.col(a).alias("text")), right.select(F.col(b).alias("text")), cutoff).select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    return left.join(pairs, F.col(a) == F.col("__a")).join(right, F.col("__b") == F.col(b)).drop("__a", "__b")


def token_weight(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0), lambda n, t: n + F.length(t) + 1)


def contained(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """``a, b``: pairs in which the shared tokens are so much of ``a`` that they alone reach the cutoff against all of it.

    They must have cutoff / (2 - cutoff) of its characters; so one of them is among its rarest tokens, as many as leave less than that.
    """
    counts = right.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    each = left.select("text", F.explode("tokens").alias("t")).join(counts, "t")  # tokens that no partner has are shared with none
    known = each.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("known"), F.sum(F.length("t") + 1).alias("held"))
    rows = left.join(known, "text")
    share = cutoff / (2 - cutoff)
    need = share * (token_weight(F.col("tokens")) - 1) + 1 - EPSILON
    # the tokens before which less than what may be missing has gone by
    spare = F.col("held") - need
    walk = F.aggregate(
        "known", F.struct(F.lit(0).cast("long").alias("gone"), F.array().cast("array<string>").alias("rare")),
        lambda s, x: F.struct((s["gone"] + F.length(x["t"]) + 1).alias("gone"), F.when(s["gone"] <= spare, F.concat(s["rare"], F.array(x["t"]))).otherwise(s["rare"]).alias("rare")),
    )
    rare = rows.where(spare >= 0).select(F.col("text").alias("a"), F.col("tokens").alias("a_tokens"), need.alias("need"), walk["rare"].alias("rare")).withColumn("t", F.explode("rare"))
    other = right.select(F.col("text").alias("b"), F.col("tokens").alias("b_tokens"), F.explode("tokens").alias("u"))
    met = rare.join(other, F.col("t") == F.col("u")).where(F.element_at(F.array_intersect("rare", "b_tokens"), 1) == F.col("t"))
    return met.where(token_weight(F.array_intersect("a_tokens", "b_tokens")) >= F.col("need")).select("a", "b")


def token_set_pairs(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: int = 80) -> DataFrame:
    """``a, b, score`` of distinct texts whose token-set ratio (0 to 100) is at least ``cutoff`` (above 0).

    The ratio is the best of three: the shared tokens against all tokens of either side, found by the rarest tokens that must
    then be shared, and both sides in full, found by grams that do not depend on the order of words.  Texts without a token equal nothing.
    The rows are read once: what follows is done on distinct texts, whose tokens are stored.
    """
    least = (cutoff - 0.5) / 100

    def tokens(d: DataFrame, c: str) -> DataFrame:
        words = F.sort_array(F.array_distinct(F.array_remove(F.split(F.regexp_replace(F.lower("raw"), r"(?U)\s+", " "), " "), "")))
        return d.select(F.col(c).alias("raw")).distinct().withColumn("tokens", words).where(F.size("tokens") > 0).withColumn("text", F.array_join("tokens", " "))

    one, two = stored(tokens(left, a), "tokens"), stored(tokens(right, b), "tokens")
    l_keys, r_keys = (d.select("text", "tokens").distinct() for d in (one, two))
    pairs = contained(l_keys, r_keys, least).unionByName(contained(r_keys, l_keys, least).select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(alike_texts(l_keys, r_keys, least, any_order=True))
    scored = pairs.distinct().withColumn("score", token_set_ratio(F.col("a"), F.col("b"))).where(F.col("score") >= cutoff)
    names = [d.select(F.col("raw").alias(c), F.col("text").alias(k)) for d, c, k in ((one, a, "a_key"), (two, b, "b_key"))]
    met = scored.select(F.col("a").alias("x"), F.col("b").alias("y"), "score")
    return names[0].join(met, F.col("a_key") == F.col("x")).join(names[1], F.col("y") == F.col("b_key")).select(a, b, "score")


def bags(texts: list[str], size: int) -> np.ndarray:
    """How often each class of grams of ``size`` (1 or 2) characters comes in each text, a row a text."""
    classes = CHARACTERS if size == 1 else TWOS
    parts = [np.zeros((0, classes), np.uint8)]
    for a in range(0, len(texts), 8192):
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in texts[a : a + 8192]]
        if size == 2:
            codes = [c[:-1] * 31 + c[1:] for c in codes]
        row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        n = np.bincount(row * classes + np.concatenate(codes) % classes, minlength=len(codes) * classes).reshape(len(codes), classes)
        parts.append(n.astype(np.min_scalar_type(n.max(initial=0))))
    return np.concatenate(parts)


def in_common(rows: np.ndarray, bag: np.ndarray, axis: int) -> np.ndarray:
    return np.minimum(rows, bag).sum(axis, dtype=np.int64)


def highest(ones: np.ndarray, twos: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest ratio (0 to 100) that a text of ``n`` characters can have to others of ``low`` to ``high``, by how many characters and two-grams they share at most.

    M matched characters in r runs share M - r two-grams, and r is at most one more than the T - 2 M unmatched ones of T in all, so 3 M <= two-grams + T + 1.
    """
    matched = np.minimum(ones, high)
    first = 200.0 * matched / np.maximum(n + np.maximum(low, matched), 1)
    total = np.maximum(n + low, 1)
    second = 200.0 * (twos + total + 1) / (3 * total)
    return np.where(n + low > 0, np.floor(np.minimum(np.minimum(first, second), 100) + 0.5 + EPSILON), 100).astype(np.int64)


def most_alike(names: list[str], others: list[str], cutoff: int, known: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, int]]:
    """Name, the first of the other texts most like it, and their ratio from 0 to 100, if that is more than ``cutoff``.

    With ``known``, a ratio for each name and a place, only a higher ratio counts, or the same one before that place.  The other texts lie in leaves of neighbours in the
    order of the alphabet.  What a leaf shares with a name at most bounds all of it; leaves are opened, and their texts compared, from the highest bound down and at equal
    ones from the first place on, until none can be better.
    """
    if not others:
        return
    by_text = np.array(sorted(range(len(others)), key=others.__getitem__))
    texts = [others[j] for j in by_text.tolist()]
    length, starts = np.array([len(t) for t in texts]), np.arange(0, len(texts), LEAF)
    ones, twos, names_ones, names_twos = bags(texts, 1), bags(texts, 2), bags(names, 1), bags(names, 2)
    leaf_ones, leaf_twos = (np.ascontiguousarray(np.maximum.reduceat(b, starts).T) for b in (ones, twos))
    low, high, first = np.minimum.reduceat(length, starts), np.maximum.reduceat(length, starts), np.minimum.reduceat(by_text, starts)
    inside, size = np.arange(LEAF), len(others)
    for i, name in enumerate(names):
        n, (best, at) = len(name), known[i] if known else (cutoff, -1)
        found = -1
        ratio = lambda j, name=name: round(100 * SequenceMatcher(None, name, others[j]).ratio())
        c, d = np.flatnonzero(names_ones[i]), np.flatnonzero(names_twos[i])
        mine, my_twos = names_ones[i, c], names_twos[i, d]

        def bounds(rows: np.ndarray, n=n, c=c, d=d, mine=mine, my_twos=my_twos) -> np.ndarray:
            return highest(in_common(ones[rows[:, None], c], mine, 1), in_common(twos[rows[:, None], d], my_twos, 1), n, length[rows], length[rows])

        if not known:  # the neighbours by alphabet are a start
            k = bisect.bisect_left(texts, name)
            rows = np.arange(max(k - 1, 0), min(k + 1, size))
            for bound, j in zip(bounds(rows).tolist(), by_text[rows].tolist(), strict=True):
                score = ratio(j) if bound > best or bound == best and j < at else -1
                if score > best or score == best and j < at:
                    best, at, found = score, j, j
        bound = highest(in_common(leaf_ones[c], mine[:, None], 0), in_common(leaf_twos[d], my_twos[:, None], 0), n, low, high)
        able = np.flatnonzero((bound > best) | (bound == best) & (first < at))
        order = (100 - bound[able]) * size + first[able]
        by = np.argsort(order)
        able, order = able[by], order[by].tolist()
        nearest: list[int] = []
        start = 0
        while start < len(able) or nearest:
            if start < len(able) and (not nearest or order[start] <= nearest[0]):
                if order[start] >= (100 - best) * size + max(at, 0):
                    start = len(able)
                    continue
                rows = (starts[able[start : start + AT_ONCE], None] + inside).ravel()
                rows = rows[rows < size]
                start += AT_ONCE
                keys = (100 - bounds(rows)) * size + by_text[rows]
                for key in keys[keys < (100 - best) * size + max(at, 0)].tolist():
                    heapq.heappush(nearest, key)
                continue
            key = heapq.heappop(nearest)
            if key >= (100 - best) * size + max(at, 0):
                break
            j = key % size
            score = ratio(j)
            if score > best or score == best and j < at:
                best, at, found = score, j, j
        if found >= 0:
            yield i, found, best


def best_alike(left: DataFrame, right: DataFrame, cutoff: int) -> DataFrame:
    """``name, id, score``: for each distinct ``name`` of the left the right's ``id`` whose ``low`` is most like it, the smallest of
    equals, if the ratio (0 to 100) is more than ``cutoff``.

    The right is dealt to blocks by ranges of ``low``.  A name is sought first in the block where it would lie, and then in all others, where only something better than
    what the first has counts, so most of a block is ruled out by leaves.  Blocks meet as groups of rows and both sides' are bounded, so memory is too.
    """
    spark, kind = right.sparkSession, right.schema["id"].dataType.simpleString()
    n, width = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("low")), F.lit(0))).first()
    blocks = max(1, -(-n // HELD), -(-width // HELD_BYTES))
    held = stored(right.select("low", "id").where("low is not null").repartitionByRange(blocks, "low").withColumn("part", F.spark_partition_id()), "held")
    starts = sorted((r.part, r.low) for r in held.groupBy("part").agg(F.min("low").alias("low")).collect())
    if not starts:
        return spark.createDataFrame([], f"name string, id {kind}, score int")
    parts, lows = F.lit([p for p, _ in starts]), F.lit([s for _, s in starts])
    own = F.element_at(parts, F.greatest(F.size(F.filter(lows, lambda s: s <= F.col("name"))), F.lit(1)))
    names = stored(left.select("name").where("name is not null").withColumn("part", own), "sought")
    counts = {r.part: -(-r["count"] // SOUGHT) for r in names.groupBy("part").count().collect()}
    if not counts:
        return spark.createDataFrame([], f"name string, id {kind}, score int")

    def met(one: DataFrame, two: DataFrame, groups: int, again: bool) -> DataFrame:
        def run(names: pa.Table, held: pa.Table) -> pa.Table:
            held = held.sort_by([("id", "ascending"), ("low", "ascending")])
            ids, known = held["id"].to_pylist(), None
            if again:
                known = [(cutoff, -1) if i is None else (s, bisect.bisect_left(ids, i)) for s, i in zip(names["score"].to_pylist(), names["id"].to_pylist(), strict=True)]
            found = list(most_alike(names["name"].to_pylist(), held["low"].to_pylist(), cutoff, known)) if names.num_rows else []
            at = {i: (j, s) for i, j, s in found}
            rows = [f[0] for f in found] if again else range(names.num_rows)
            some = [at.get(i, (None, None)) for i in rows]
            kept = names.take(pa.array(rows, pa.int64()))
            columns = [kept["name"], kept["part"], held["id"].take(pa.array([x[0] for x in some], pa.int64())), pa.array([x[1] for x in some], pa.int32())]
            return pa.Table.from_arrays(columns, names=["name", "part", "id", "score"])

        n = min(2 * groups, 2000)
        one, two = (d.repartition(n, "part", "slice").groupBy("part", "slice") for d in (one, two))
        return one.cogroup(two).applyInArrow(run, f"name string, part int, id {kind}, score int")

    def deal(slices) -> Column:
        return F.pmod(F.xxhash64("name"), slices).cast("int").alias("slice")

    slices = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[F.col("part")]
    first = met(names.select("part", deal(slices), "name"), held.where(slices > 0).select("part", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "low", "id"), sum(counts.values()), False)
    first = found = stored(first, "best")
    if len(starts) > 1:
        again = max(1, -(-names.count() // SOUGHT_AGAIN))
        one = first.select(F.explode(F.array_remove(parts, F.col("part"))).alias("part"), deal(F.lit(again)), "name", "score", "id")
        two = held.select("part", F.explode(F.sequence(F.lit(0), F.lit(again - 1))).alias("slice"), "low", "id")
        found = first.unionByName(met(one, two, again * len(starts), True))
    top = F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("m")
    return found.where("score is not null").groupBy("name").agg(top).select("name", F.col("m.id").alias("id"), (-F.col("m.s")).alias("score"))
