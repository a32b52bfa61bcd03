"""Benchmark decontamination by suffix arrays of the training text.

A shard is the text of one vectorised step.  Its words are numbered by the
benchmark's vocabulary and only runs of known words long enough for a match are kept
(nothing else can match).  A suffix array over these runs, sorted as deep as the
longest item, is searched for every test suffix at once: at each depth the interval
of suffixes that agree so far shrinks by two binary searches.  The interval at the
window's depth gives all places of the window, the deepest non-empty one the longest
match.

The benchmark goes to the workers in blocks of at most ``BLOCK_BYTES``; a larger
benchmark takes more passes, each adding to the spans of the one before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import fresh, read, small_batches, steps, stored, tidy

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
BLOCK_BYTES = 16 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words after lowering A-Z; every byte of a character beyond ASCII is part of a word."""
    return WORD.findall((text or "").encode().lower())


class Block:
    """Items of a benchmark, numbered, with all their suffixes that hold a window."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.ids: list[str] = []
        self.vocab: dict[bytes, int] = {}
        flat, start, size, item, need = [], [], [], [], []
        for name, text in items:
            words = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if not words:
                continue
            window = min(WINDOW, len(words))
            for o in range(len(words) - window + 1):
                start.append(len(flat) + o)
                size.append(len(words) - o)
                item.append(len(self.ids))
                need.append(window)
            self.ids.append(name)
            flat += words
        self.flat, self.start, self.size = np.array(flat + [0], np.int64), np.array(start, np.int64), np.array(size, np.int64)
        self.item, self.need = np.array(item, np.int64), np.array(need, np.int64)
        self.shortest = int(self.need.min(initial=WINDOW))
        self.deepest = int(self.size.max(initial=1))


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` words, by prefix doubling."""
    rank, k = words.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        ahead = np.zeros_like(rank)
        ahead[:-k or None] = rank[k:]
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(key, kind="stable")
        moved = np.append(0, np.diff(key[order]) != 0)
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(moved) + 1
        k *= 2
        if k >= depth or k >= len(words) or rank.max(initial=0) == len(words):
            return order


def search(block: Block, words: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every test suffix: the interval of ``order`` that matches its window, the longest match and a suffix that has it."""
    padded = np.append(words, np.zeros(block.deepest + 1, np.int64))
    n = len(block.start)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    at, to = np.zeros(n, np.int64), np.zeros(n, np.int64)
    longest, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    live = np.arange(n)
    for d in range(block.deepest):
        live = live[(block.size[live] > d) & (lo[live] < hi[live])]
        if not len(live):
            break
        wanted = block.flat[block.start[live] + d]
        ends = []
        for strict in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                seen = padded[order[np.minimum(mid, len(order) - 1)] + d]
                right = ((seen <= wanted) if strict else (seen < wanted)) & open_
                a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
            ends.append(a)
        lo[live], hi[live] = ends
        some = live[lo[live] < hi[live]]
        longest[some], place[some] = d + 1, order[lo[some]]
        whole = some[block.need[some] == d + 1]
        at[whole], to[whole] = lo[whole], hi[whole]
    return at, to, longest, place


class Shard:
    """The runs of known words of some texts."""

    def __init__(self, block: Block, texts: list[str | None]) -> None:
        get = block.vocab.get
        numbers, counts = [], []
        for t in texts:
            ws = words_of(t)
            counts.append(len(ws))
            numbers += [get(w, 0) for w in ws]
            numbers.append(0)
        self.counts = np.array(counts, np.int64)
        numbers = np.array(numbers, np.int64)
        first = np.cumsum(self.counts + 1) - self.counts - 1
        edge = np.diff(np.concatenate(([0], (numbers > 0).astype(np.int8), [0])))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = b - a >= block.shortest
        a, b = a[long], b[long] + 1  # with the 0 that ends the run
        size = b - a
        #: of each kept word: its place among all words, its text, its place in the text
        source = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.words = numbers[source]
        self.row = np.searchsorted(first, source, side="right") - 1
        self.at = source - first[self.row] if len(source) else source


def hits(block: Block, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
    """Per text: its number of words, the hit places of words, the items found."""
    shard = Shard(block, texts)
    spans: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    found: list[set[str]] = [set() for _ in texts]
    if not len(shard.words) or not len(block.start):
        return shard.counts, spans, found
    order = suffix_array(shard.words, block.deepest)
    lo, hi, _, _ = search(block, shard.words, order)
    cover = np.zeros(len(shard.words) + 1, np.int64)
    some = np.flatnonzero(lo < hi)
    for k in some.tolist():
        places = order[lo[k] : hi[k]]
        np.add.at(cover, places, 1)
        np.add.at(cover, places + block.need[k], -1)
        for r in np.unique(shard.row[places]).tolist():
            found[r].add(block.ids[block.item[k]])
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    rows, starts = np.unique(shard.row[hit], return_index=True)
    for r, a, b in zip(rows.tolist(), starts.tolist(), [*starts[1:].tolist(), len(hit)], strict=False):
        spans[r] = shard.at[hit[a:b]]
    return shard.counts, spans, found


def blocks_of(benchmark: DataFrame, item: str, text: str) -> Iterator[Block]:
    """The benchmark, row by row, in blocks of bounded size."""
    held, size = [], 0
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len(r.t or "") * 4 + 64
        if held and size + n > BLOCK_BYTES:
            yield Block(held)
            held, size = [], 0
        held.append(("null" if r.i is None else r.i, r.t or ""))
        size += n
    yield Block(held)


RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")]
    + [T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` plus ``n_words, n_hit, n_items, items_sha256, contaminated``.

    A window is 13 consecutive words of an item, or all of a shorter one.  A word of a
    document inside an occurrence of a window is hit.  Null and empty texts have no
    words; items without words have no windows; a null item id reads ``null``; rows
    are independent; columns named like a result are replaced.  The text goes unless
    ``keep_text``.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in RESULT.names and c != text]
    held, hit, items = fresh(docs, "__text", "__hit", "__items")
    passed = [T.StructField(hit, T.ArrayType(T.LongType())), T.StructField(items, T.ArrayType(T.StringType()))]
    schema = [docs.schema[c] for c in kept]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(held), F.array().cast("array<bigint>").alias(hit), F.array().cast("array<string>").alias(items))
    small_batches(spark)
    blocks = blocks_of(benchmark, item, item_text)
    block, after = next(blocks), next(blocks, None)
    while block is not None:  # two blocks are on the driver at once
        texts = [T.StructField(held, T.StringType())] if keep_text or after is not None else []
        to = T.StructType(schema + texts + (passed if after is not None else list(RESULT)))
        out = out.mapInArrow(scan(spark.sparkContext.broadcast(block), len(kept), bool(texts), after is None, to.names), to)
        out = out if after is None else stored(out, "contamination")  # one worker and one block in a task at a time
        block, after = after, next(blocks, None) if after is not None else None
    order = [c for c in docs.columns if c not in RESULT.names and (keep_text or c != text)] + RESULT.names
    return out.select(*[F.col(held).alias(text) if c == text else F.col(f"`{c}`") for c in order])


def scan(block, width: int, with_text: bool, last: bool, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(width)], np.int64)
            for a, b in steps(sizes):
                part = batch.slice(a, b - a)
                counts, spans, found = hits(block.value, part.column(width).to_pylist())
                spans = [np.union1d(x, np.array(y, np.int64)) for x, y in zip(spans, part.column(width + 1).to_pylist(), strict=True)]
                found = [x | set(y) for x, y in zip(found, part.column(width + 2).to_pylist(), strict=True)]
                columns = [*part.columns[: width + with_text]]
                if last:
                    hit = [len(x) for x in spans]
                    columns += [pa.array(counts), pa.array(hit, pa.int64()), pa.array([len(x) for x in found], pa.int64())]
                    columns += [pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found], pa.string())]
                    columns += [pa.array([h > 0 and SHARE * h >= n for h, n in zip(hit, counts.tolist(), strict=True)], pa.bool_())]
                else:
                    columns += [pa.array([x.tolist() for x in spans], pa.list_(pa.int64())), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return tidy(run)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, n_words, doc_id, doc_word``: each item's longest verbatim match of a
    window or more in all shards, and one place of it.  Ties go to the smallest id, of any
    type that sorts, and place; rows without an id are left out."""
    out = None
    small_batches(docs.sparkSession)
    to = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("doc_word", T.LongType())])
    slim = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    for block in blocks_of(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            block = shared.value
            for batch in batches:
                texts, ids = batch.column(1), batch.column(0)
                for a, b in steps(np.array([len(t.as_buffer()) for t in texts], np.int64)):
                    shard = Shard(block, texts.slice(a, b - a).to_pylist())
                    if not len(shard.words) or not len(block.start):
                        continue
                    order = suffix_array(shard.words, block.deepest)
                    _, _, longest, place = search(block, shard.words, order)
                    best: dict[int, int] = {}
                    for k in np.flatnonzero(longest >= block.need).tolist():
                        i = int(block.item[k])
                        if i not in best or longest[k] > longest[best[i]]:
                            best[i] = k
                    rows = [(block.ids[i], int(longest[k]), int(place[k])) for i, k in best.items()]
                    if rows:
                        at = np.array([r[2] for r in rows])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), ids.slice(a, b - a).take(pa.array(shard.row[at])), pa.array(shard.at[at], pa.int64())], names=to.names
                        )

        found = stored(slim.mapInArrow(tidy(run), to), "longest")  # a row an item and task
        out = found if out is None else out.unionByName(found)
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_word")).alias("b")
    return out.groupBy("item_id").agg(best).select("item_id", (-F.col("b.n")).alias("n_words"), "b.doc_id", "b.doc_word")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = rf"""
WITH lowered AS (SELECT 'd' AS k, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT k, id, regexp_extract_all(coalesce(t, ''), '{WORDS}') AS ws FROM lowered),
items AS (SELECT id, ws, least({WINDOW}, len(ws)) AS n FROM w WHERE k = 'b' AND len(ws) > 0),
windows AS (SELECT DISTINCT id, n, array_to_string(ws[i:i+n-1], ' ') AS g FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM items),
grams AS (
  SELECT id, i, n, array_to_string(ws[i:i+n-1], ' ') AS g
  FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE k = 'd' AND len(ws) >= n)),
found AS (SELECT grams.id, i, grams.n, windows.id AS item FROM grams JOIN windows ON grams.g = windows.g AND grams.n = windows.n),
hit AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM found) GROUP BY id),
named AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, coalesce(item::VARCHAR, 'null') AS item FROM found) GROUP BY id)
SELECT w.id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND {SHARE} * n_hit >= len(ws), false) AS contaminated
FROM w LEFT JOIN hit ON w.id = hit.id LEFT JOIN named ON w.id = named.id WHERE k = 'd'
"""
