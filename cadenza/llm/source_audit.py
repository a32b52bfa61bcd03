"""Source divergence audit by integer-dictionary encoding.

Words are counted by language, source and term.  The terms that a language keeps are sorted
and cut into chunks, arrays of at most ``CHUNK`` terms in UTF-8 order; the place of a term in its
array is its id, so ids order as terms do and break ties.  Each chunk's counts are encoded by
``searchsorted`` in its array.  A task then adds up the counts of a chunk by source as dense vectors and
compares them with integers alone; sums over chunks make the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import STEP_BYTES, raw, read, small_batches, steps, stored, tidy

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Terms of a chunk; sources that one task compares with all others; values of a dense matrix.
CHUNK, BLOCK, DENSE = 4096, 512, 1 << 22
#: What ends a term, and what bytes become: A-Z small, all others as they are.
LETTERS = np.ones(256, bool)
LETTERS[np.r_[0x00:0x41, 0x5B:0x61, 0x7B:0x80]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts one after another, and the number of the text of each."""
    data, offsets = raw(texts)
    held = LETTERS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text's end ends a term
    start = np.flatnonzero(held & (edge[:-1] | ~np.append(False, held[:-1])))
    end = np.flatnonzero(held & (edge[1:] | ~np.append(held[1:], False))) + 1
    ends = np.append(0, np.cumsum(end - start))
    terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(LOWER[data[held]].tobytes())])
    return terms, np.searchsorted(offsets, start, side="right") - 1


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents with the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources, texts = (batch.column(k) for k in range(3))
            for a, b in steps(pc.binary_length(texts).to_numpy(zero_copy_only=False), STEP_BYTES):
                terms, doc = terms_of(texts.slice(a, b - a))
                if not len(terms):
                    continue
                coded, lang, source = terms.dictionary_encode(), langs.slice(a, b - a).dictionary_encode(), sources.slice(a, b - a).dictionary_encode()
                k, wide = len(coded.dictionary), len(source.dictionary)
                group = lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy()
                once, times = np.unique(doc * k + coded.indices.to_numpy(), return_counts=True)
                keys, place = np.unique(group[once // k] * k + once % k, return_inverse=True)
                n = np.zeros(len(keys), np.int64)
                np.add.at(n, place, times)
                of = keys // k
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(of // wide)), source.dictionary.take(pa.array(of % wide)), coded.dictionary.take(pa.array(keys % k)).cast(pa.large_string()).cast(pa.string()),
                        pa.array(n), pa.array(np.bincount(place, minlength=len(keys)).astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    small_batches(docs.sparkSession)
    found = docs.select("lang", "source", "text").mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def dictionary(kept: DataFrame, size: int = CHUNK) -> DataFrame:
    """``lang, first, terms`` of ``lang, term``: the sorted terms of a language in arrays of at most ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([held[0]]), pa.array([held], pa.list_(pa.string()))], names=["lang", "first", "terms"])
        for batch in batches:
            for lang, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (lang != at or len(held) == size):
                    yield out()
                    held = []
                at = lang
                held.append(term)
        if held:
            yield out()

    sorted_terms = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return stored(sorted_terms.mapInArrow(tidy(run), "lang string, first string, terms array<string>"), "chunks")


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * count / total), exact for totals below 2**53 as three long divisions by a thousandth."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def numbered(chunks: DataFrame) -> tuple[DataFrame, list]:
    """The chunks with numbers by language, and (lang, first term, number) of each: a row for some thousand terms, on the driver."""
    firsts = sorted((r.lang, r.first) for r in chunks.select("lang", "first").collect())
    rows, last = [], None
    for lang, first in firsts:
        rows.append((lang, first, 0 if lang != last else rows[-1][2] + 1))
        last = lang
    names = chunks.sparkSession.createDataFrame(rows, "l string, f string, chunk int")
    return chunks.join(F.broadcast(names), (F.col("lang") == F.col("l")) & (F.col("first") == F.col("f"))).select("lang", "chunk", "terms"), rows


def dealt(counts: DataFrame, bounds: list) -> DataFrame:
    """The counts with the chunk of each term, found by a binary search in the chunks' first terms."""
    by_lang: dict[str, list] = {}
    for lang, first, _ in bounds:
        by_lang.setdefault(lang, []).append(first)
    shared = counts.sparkSession.sparkContext.broadcast(by_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {lang: np.array(v, object) for lang, v in shared.value.items()}
        for batch in batches:
            lang, term = batch.column(0).dictionary_encode(), batch.column(2).to_numpy(zero_copy_only=False)
            codes, chunk = lang.indices.to_numpy(), np.zeros(batch.num_rows, np.int32)
            for k, name in enumerate(lang.dictionary.to_pylist()):
                own = codes == k
                chunk[own] = np.searchsorted(firsts[name], term[own], side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk)], names=[*batch.schema.names, "chunk"])

    return counts.select("lang", "source", "term", "n").mapInArrow(tidy(run), "lang string, source string, term string, n long, chunk int")


def encoded(counts: DataFrame, chunks: DataFrame) -> DataFrame:
    """``lang, chunk, source, ids, counts, terms``: a row a source and chunk, and one without source that has the chunk's terms."""
    names = ["lang", "chunk", "source", "ids", "counts", "terms"]

    def encode(own: pa.Table, chunk: pa.Table) -> pa.Table:
        words = chunk["terms"].combine_chunks().flatten()
        lang, number = chunk["lang"][0].as_py(), chunk["chunk"][0].as_py()
        ids = np.searchsorted(words.to_numpy(zero_copy_only=False), own["term"].to_numpy()).astype(np.int32)
        source = own["source"].combine_chunks().dictionary_encode()
        codes, size = source.indices.to_numpy(), len(source.dictionary)
        order = np.lexsort((ids, codes))
        ends = pa.array(np.append(np.append(0, np.cumsum(np.bincount(codes, minlength=size))), own.num_rows).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (ids, own["n"].to_numpy())]
        terms = pa.ListArray.from_arrays(pa.array(np.append(np.zeros(size + 1), len(words)).astype(np.int32)), words)
        return pa.Table.from_arrays([pa.array([lang] * (size + 1)), pa.array([number] * (size + 1), pa.int32()), pa.array([*source.dictionary.to_pylist(), None], pa.string()), *lists, terms], names=names)

    both = counts.groupBy("lang", "chunk").cogroup(chunks.groupBy("lang", "chunk"))
    return both.applyInArrow(encode, "lang string, chunk int, source string, ids array<int>, counts array<long>, terms array<string>")


def compared(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``lang, source, part, item, value``: a chunk's sums for pairs of sources and its best terms of each source.

    Both sides come once a chunk and block of sources; a task compares its block with all sources of the language.
    """

    def compare(group: pa.Table, chunk: pa.Table) -> pa.Table:
        group = group.sort_by("source")
        lang, sources = group["lang"][0].as_py(), np.array(group["source"].to_pylist(), object)
        mine = np.flatnonzero(group["mine"].to_numpy())
        totals, kept, whole = group["total"].to_numpy(), int(group["kept"][0].as_py()), int(group["whole"][0].as_py())
        named = chunk.filter(pc.is_null(chunk["source"]))
        words = named["terms"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if named.num_rows else np.zeros(0, object)
        held = chunk.filter(pc.is_valid(chunk["source"]))
        row_of = np.searchsorted(sources, np.array(held["source"].to_pylist(), object))
        sizes = pc.list_value_length(held["ids"]).to_numpy().astype(np.int64)
        at = np.repeat(row_of, sizes) if len(sizes) else np.zeros(0, np.int64)
        ids, counts = (held[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "counts"))
        sums, best = np.zeros((len(mine), len(sources)), np.int64), []
        wide = max(64, DENSE // max(1, len(sources)))
        for lo in range(0, len(words), wide):
            n = min(wide, len(words) - lo)
            own = (ids >= lo) & (ids < lo + n)
            dense = np.zeros((len(sources), n), np.int64)
            np.add.at(dense, (at[own], ids[own] - lo), counts[own])
            p = np.stack([share(c + 1, int(t) + kept) for c, t in zip(dense, totals, strict=True)])
            q = share(dense.sum(0) + 1, whole + kept)
            for k, i in enumerate(mine):
                sums[k] += excess(p[i], p).sum(1)
                more = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                gain = excess(p[i, more], q[more])
                first = np.lexsort((more, -gain))[:TOP]
                best.append((np.full(len(first), i), more[first] + lo, gain[first]))
        pairs = [(i, np.delete(np.arange(len(sources)), i), np.delete(sums[k], i)) for k, i in enumerate(mine)]
        who = np.concatenate([np.full(len(o), i) for i, o, _ in pairs] + [b[0] for b in best] + [np.zeros(0)]).astype(np.int64)
        item = np.concatenate([sources[o] for _, o, _ in pairs] + [words[b[1]] for b in best] + [np.zeros(0, object)])
        value = np.concatenate([v for *_, v in pairs] + [b[2] for b in best] + [np.zeros(0)]).astype(np.int64)
        n_pairs = sum(len(o) for _, o, _ in pairs)
        part = np.array(["pair", "term"], object)[(np.arange(len(who)) >= n_pairs).astype(int)]
        return pa.Table.from_arrays([pa.array([lang] * len(who), pa.string()), pa.array(sources[who], pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value)], names=["lang", "source", "part", "item", "value"])

    keys = ("lang", "chunk", "block")
    return groups.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(compare, "lang string, source string, part string, item string, value long")


def source_audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source's terms depart from other sources of its language and from the language.

    Null language, source and text count as empty.  Every row is a document of its own, repeated
    rows too.  A language without kept terms has pairs of value 0.  An empty table gives no rows.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    counts = stored(term_counts(docs), "terms")
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).select("lang", "term"), "kept")
    chunks, bounds = numbered(dictionary(kept, chunk))
    rows = stored(encoded(dealt(counts.join(kept, ["lang", "term"]), bounds), chunks), "encoded")
    totals = rows.where("source is not null").select("lang", "source", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0).cast("long")).alias("total"))
    groups = stored(groups, "groups")
    size = rows.where("source is null").groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"), F.count(F.lit(1)).cast("int").alias("chunks"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("whole"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).join(size, "lang", "left").fillna(0, ["kept", "chunks"])
    langs = stored(langs, "langs")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    dealt_groups = groups.join(langs, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    dealt_groups = dealt_groups.withColumn("chunk", every(F.col("chunks"))).withColumn("block", every(F.col("blocks"))).withColumn("mine", F.col("own") == F.col("block"))
    dealt_rows = rows.join(langs.select("lang", "blocks"), "lang").withColumn("block", every(F.col("blocks"))).drop("blocks")
    found = stored(compared(dealt_groups.select("lang", "source", "total", "kept", "whole", "chunk", "block", "mine"), dealt_rows), "compared")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(read(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
m AS (SELECT lang, sum(n) AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS cnt,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
q AS (
  SELECT x.lang, x.term, 1 + (1000000000::HUGEINT * (x.n + 1)) // (m.n + v.v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) x JOIN m USING (lang) JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (((p - q) * (p - q)) // q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE cnt > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM both_parts)
WHERE part = 'pair' OR rank <= 200
"""
