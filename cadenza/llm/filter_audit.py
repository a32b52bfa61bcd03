"""Filter interaction audit by a packed bitmap index.

Every task packs the filters and labels of its rows into NumPy bitsets, one bit a row.  Rows
lie in the order of their part and each part begins a new word, so the bitset of a part is
a run of words.  For each of the 32 sets of filters that may stand before another one, AND-NOT
of the set's bitsets and popcount say how many rows of a part, good ones and toxic ones, are
left.  These counts are summed over tasks; all 120 orders follow from them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import let, read, small, stored, tidy

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
LEAST_WORDS = 50
LEAST_DISTINCT, MOST_CAPITALS = 65, 5
#: Parts whose counts a task holds before it hands them on.
HELD_PARTS = 4096
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)


def failures(docs: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``id, part, fails, digest``: bits of the filters A to D that a row fails, and its text's SHA-256."""
    said = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split("t", r"[\x20\x09-\x0D]+", -1), "")
    bit = lambda test, n: F.when(test, F.lit(1 << n)).otherwise(F.lit(0))
    of_words = let(words, lambda w: bit(F.size(w) < LEAST_WORDS, 0) + bit(F.size(F.array_distinct(w)) * 100 < F.size(w).cast("long") * LEAST_DISTINCT, 1))
    capitals = F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long") * 100 > F.length("t").cast("long") * MOST_CAPITALS
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), said.alias("t"))
    return rows.select("id", "part", (of_words + bit(capitals, 2) + bit(F.col("t").rlike(r"[#$%&*|]"), 3)).alias("fails"), F.unhex(F.sha2("t", 256)).alias("digest"))


def marked(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part, bits``: filters A to E that a row fails, whether it is labelled good, and toxic.

    The smallest id of a text is found by an aggregate over digests and met on digest and id
    together, so a text that a third of all rows have is no hot key of the join.
    """
    base = stored(failures(docs, ident, text, part), "failures")
    first = base.where("id is not null").groupBy("digest").agg(F.min("id").alias("first")).withColumnRenamed("digest", "d")
    seen = base.join(first, (F.col("digest") == F.col("d")) & (F.col("id") == F.col("first")), "left")
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("known"))
    known = known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    side = F.broadcast(known) if small(known) else known
    repeated = F.col("id").isNotNull() & F.col("first").isNull()
    extra = [F.when(test, F.lit(value)).otherwise(F.lit(0)) for test, value in ((repeated, 16), (F.col("good"), GOOD), (F.col("toxic"), TOXIC))]
    return seen.join(side, F.col("id") == F.col("known"), "left").select("part", (F.col("fails") + extra[0] + extra[1] + extra[2]).cast("int").alias("bits"))


class Index:
    """Bitsets over some rows; those of a part are a run of words that begins with the part."""

    def __init__(self, part: np.ndarray, bits: np.ndarray, parts: int) -> None:
        count = np.bincount(part, minlength=parts)
        words = (count + 63) // 64
        self.start = np.cumsum(words) - words
        order = np.argsort(part, kind="stable")
        within = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
        self.slot = np.repeat(self.start * 64, count) + within
        self.size = int(words.sum()) * 64
        self.rows = bits[order]
        self.live = self.packed(np.ones(len(part), bool))
        self.fails = [self.packed(self.rows >> k & 1) for k in range(len(FILTERS))]
        self.good, self.toxic = self.packed(self.rows & GOOD), self.packed(self.rows & TOXIC)

    def packed(self, values: np.ndarray) -> np.ndarray:
        flags = np.zeros(self.size, bool)
        flags[self.slot] = values != 0
        return np.packbits(flags).view(np.uint64)

    def of_parts(self, bitset: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(bitset).astype(np.int64), self.start)

    def left(self) -> np.ndarray:
        """Rows, good rows and toxic rows of each part that pass each set of filters: (part, set, 3)."""
        out = np.zeros((len(self.start), SETS, 3), np.int64)
        gone = [np.zeros_like(self.live)]
        for s in range(SETS):
            if s:
                low = (s & -s).bit_length() - 1
                gone.append(gone[s & (s - 1)] | self.fails[low])
            kept = self.live & ~gone[s]
            for k, held in enumerate((kept, kept & self.good, kept & self.toxic)):
                out[:, s, k] = self.of_parts(held)
        return out


def counted(rows: DataFrame) -> DataFrame:
    """``part, counts``: for each part an array with kept, good and toxic rows by set of filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            names, sums = list(held), np.concatenate([held[n] for n in held])
            held.clear()
            columns = [pa.array(np.tile(np.arange(SETS, dtype=np.int32), len(names))), *[pa.array(sums[:, k]) for k in range(3)]]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), SETS))), *columns], names=["part", "set", "kept", "good", "toxic"])

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            left = Index(coded.indices.to_numpy(), batch.column(1).to_numpy(), len(coded.dictionary)).left()
            for name, counts in zip(coded.dictionary.to_pylist(), left, strict=True):
                held[name] = held[name] + counts if name in held else counts
            if len(held) >= HELD_PARTS:
                yield flush()
        if held:
            yield flush()

    sums = rows.mapInArrow(tidy(run), "part string, set int, kept long, good long, toxic long")
    sums = sums.groupBy("part", "set").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])
    return sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("set", "kept", "good", "toxic"))).alias("counts"))


def orders() -> Column:
    """All orders of the filters, a struct a step: the letters, the step, its filter and the set before it."""
    steps = []
    for p in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(p, 1):
            steps.append({"filter_order": "".join(FILTERS[k] for k in p), "step": step, "f": f, "before": before})
            before |= 1 << f
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, f: int, before: int>>")


def filter_audit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row a part, order of the filters and step, with what the step's filter does there.

    Null texts are empty, null parts the empty one.  A row without an id repeats no text and is
    nobody's original; rows of one id and text repeat each other not.  A document counts as good or toxic if any of its label rows
    says so.  Empty tables give no rows.
    """
    at = lambda s, what="kept": F.col("counts")[s][what]
    shares = []
    for f in range(len(FILTERS)):
        gains = [(at(F.lit(s)) - at(F.lit(s | 1 << f))) * factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) for s in range(SETS) if not s >> f & 1]
        shares.append(sum(gains[1:], gains[0]))
    per_part = counted(marked(docs, labels, ident, text, part)).withColumn("shares", F.array(*shares))
    steps = per_part.select("part", "counts", "shares", F.explode(orders()).alias("o")).select("part", "counts", "shares", "o.*")
    steps = steps.withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("f"))).withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    before, after = F.col("before"), F.col("after")
    removed = at(before) - at(after)
    return steps.select(
        "part", "filter_order", "step", at(after).alias("kept"), removed.alias("removed"), (at(F.lit(0)) - at(F.col("bit")) - removed).alias("redundant"),
        (at(F.lit(SETS - 1) - F.col("bit")) - at(F.lit(SETS - 1))).alias("unique_fails"), (at(before, "good") - at(after, "good")).alias("good_lost"),
        (at(before, "toxic") - at(after, "toxic")).alias("toxic_lost"), F.col("shares")[F.col("f")].alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), read(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
r AS (
  SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > first, false)] AS fails
  FROM d JOIN m USING (t) LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM r GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e
  WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i) AND c.i NOT IN (d.i, e.i) AND d.i <> e.i),
s AS (SELECT p, i AS step, p[i] AS f, p[1:i-1] AS earlier FROM o, x),
j AS (
  SELECT part, p, step, f, n, good, toxic, fails[f] AS fail, len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone,
         len(list_filter(fails, lambda k: k)) = 1 AS alone
  FROM g, s),
a AS (
  SELECT part, p, step, f, sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fail AND alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END) AS toxic_lost
  FROM j GROUP BY part, p, step, f)
SELECT part, array_to_string(list_transform(p, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM a
"""
