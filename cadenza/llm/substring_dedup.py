"""Passages that repeat across documents, by compact windows.

Windows.  The Cartesian tree of a text's shingle hashes splits it at its minimum, then
both sides at theirs, down to the shortest run of interest.  Every node is a compact
window: all subsequences inside it that hold its anchor have the anchor as their
min-hash, which is their signature.  There are about two windows a run's length, not
one a subsequence.

Enough hashes.  Two passages of 50 words or more at a similarity of 0.8 have 25 words
in a row that are equal: g edits leave u >= 9 g unshared shingles, s >= 4 u shared ones
in g + 1 runs, and the longest run has 25 words or more.  Windows are therefore taken of
21 shingles, which makes one hash function enough: both texts have a window over the
run with the same anchor.  A window has two keys, its anchor with the ten words after
it and with the ten before it, as one of these is inside the run too.

Interval join.  All documents of a key meet the smallest one, and are compared with it
if the intervals around their anchors overlap in 21 shingles.  That is one row a
document and key, however many have it.

The rest.  All documents that met one smallest document are then looked at in pairs, in
blocks.  Only those meet that share a shingle beside the most common ones, which are too few for a
passage, or, in one class, a shingle outside the passages that the document has already.  By the
places of what they share a pair is ruled out if no stretch of it is long and dense enough for a
passage, in both texts, that adds to the classes or passages.  The others are compared, all of a
document at once where their runs follow one another.  Nothing is left out by this but links
that change no class and no passage; classes are made of the links that join two of them.

Check.  All runs of equal words of a pair's texts, on every alignment, are joined over
gaps of any length as long as the Jaccard similarity of the two passages' five-word
shingles is 0.8 or more in the end; passages of at least 50 words are reported for the
document that is not the smaller.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import hashing
from cadenza.llm.common import fresh, raw, read, rested, small, small_batches, steps, stored, tidy
from cadenza.llm.graph import components

PASSAGE = 50
SIMILARITY = 0.8
#: Hash functions; with windows of ``RUN`` words one finds every pair.
HASHES = 1
#: Words in a row that two near-alike passages have in common at least.
RUN = 25
#: Words of a window's key: the anchor and those on one side of it.
CONTEXT = (RUN + hashing.SHINGLE) // 2
#: The longest extent that is kept.
OPEN = 127
#: Equal shingles of a pair of texts held at once.
MATCHES = 1 << 19
#: Runs up to which a pair's chains are followed one by one; beyond, joins of runs that overlap are left out.
CHAINED = 600
#: Runs of shared shingles up to which a pair is bounded by the places in both texts.
RUNS = 16
#: Documents compared with one smallest document in a task.
GROUP = 64
#: Documents of one smallest document in a block; all pairs of two blocks are looked at in a task.
BLOCK = 256
#: Low bits of a hash that give way to a word's place; more in a batch with a longer text.
PLACE_BITS = 24
FOUND = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("lead", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("link", pa.bool_())])
FOUND_TYPE = "id long, tag long, lead long, spans array<struct<a:int,b:int>>, link boolean"


def compact_windows(values: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``row, from, anchor, to`` of all windows of ``least`` values or more; the leftmost of equal minima is the anchor.

    All texts are split at once, level by level of their trees.
    """
    rows = np.flatnonzero(np.diff(offsets) >= least)
    base = np.repeat(offsets[:-1], np.diff(offsets))
    place = (np.arange(len(values)) - base).astype(np.uint64)
    bits = max(PLACE_BITS, int(np.diff(offsets).max(initial=0)).bit_length())
    tagged = (values & ~np.uint64((1 << bits) - 1)) | place
    tagged = np.append(tagged, np.uint64(0))
    a, b = offsets[:-1][rows], offsets[1:][rows]
    found = []
    while len(a):
        low = np.minimum.reduceat(tagged, np.column_stack((a, b)).ravel())[::2]
        k = offsets[rows] + (low & np.uint64((1 << bits) - 1)).astype(np.int64)
        found.append((rows, a, k, b))
        rows, a, b = np.concatenate((rows, rows)), np.concatenate((a, k + 1)), np.concatenate((k, b))
        long = b - a >= least
        order = np.argsort(a[long], kind="stable")
        rows, a, b = rows[long][order], a[long][order], b[long][order]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def run_hash(words: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(len(start), np.uint64)
    for k in range(n):
        total = hashing.mix(total + words[start + k])
    return total


def window_keys(words: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``row, key, left, right``: the keys of all windows, by row, and how far the windows reach around their anchors."""
    values, at = hashing.shingles(words, word_at)
    out = []
    for f in range(HASHES):
        row, a, k, b = compact_windows(hashing.mix(values + np.uint64((f + 1) * hashing.BASE % 2**64)), at, RUN - hashing.SHINGLE + 1)
        word = word_at[row] + k - at[row]
        left, right = np.minimum(k - a, OPEN), np.minimum(b - k - 1, OPEN)
        for side, start in ((0, word), (1, word + hashing.SHINGLE - CONTEXT)):
            inside = (start >= word_at[row]) & (start + CONTEXT <= word_at[row + 1])
            key = run_hash(words, start[inside], CONTEXT)
            out.append((row[inside], hashing.mix(key + np.uint64(2 * f + side + 1)), left[inside], right[inside]))
    row, key, left, right = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], key[order], left[order], right[order]


def text_hashes(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two hashes of every text's sequence of words."""
    place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
    out = []
    for salt in (3, 4):
        total = np.append(np.uint64(0), np.cumsum(hashing.mix(words + hashing.mix(place.astype(np.uint64) * np.uint64(8) + np.uint64(salt)))))
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out


def window_rows(docs: DataFrame) -> DataFrame:
    """``id, h1, h2, n`` of every row of ``id, text``: hashes of the words and their number; and ``keys, left, right`` of its windows."""
    keys = [T.StructField(c, T.ArrayType(t, False)) for c, t in (("keys", T.LongType()), ("left", T.ByteType()), ("right", T.ByteType()))]
    to = T.StructType([docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("h1", "h2", "n")), *keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in steps(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                words, at = hashing.words(*raw(texts.slice(a, b - a)))
                row, key, left, right = window_keys(words, at)
                bounds = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (key.view(np.int64), left.astype(np.int8), right.astype(np.int8))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, text_hashes(words, at)), pa.array(np.diff(at)), *lists], names=to.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), to)


def in_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingles in the order of their hashes, and their places."""
    values, _ = hashing.shingles(words, np.array([0, len(words)]))
    order = np.argsort(values, kind="stable")
    return values[order], order


def equal_runs(one: np.ndarray, two: np.ndarray, ordered: tuple[np.ndarray, np.ndarray], values: np.ndarray | None = None) -> np.ndarray:
    """Rows (start in one, start in two, words) of all runs of a shingle's length or more; ``ordered`` is of ``two``, ``values`` are the shingles of ``one``.

    The equal shingles of a stretch of ``one`` are held at a time, ``MATCHES`` of them; runs
    that go on in the next stretch are put together in the end.
    """
    if min(len(one), len(two)) < hashing.SHINGLE:
        return np.zeros((0, 3), np.int64)
    values = hashing.shingles(one, np.array([0, len(one)]))[0] if values is None else values
    low = np.searchsorted(ordered[0], values, "left")
    both = np.flatnonzero(ordered[0][np.minimum(low, len(ordered[0]) - 1)] == values)
    if not len(both):
        return np.zeros((0, 3), np.int64)
    high = low.copy()
    high[both] = np.searchsorted(ordered[0], values[both], "right")
    count, bits = high - low, len(one).bit_length()
    found = [np.zeros((2, 0), np.int64)]
    for a, b in steps(count, MATCHES):
        c = count[a:b]
        if not c.any():
            continue
        i = np.repeat(np.arange(a, b), c)
        j = ordered[1][np.repeat(low[a:b] - np.append(0, np.cumsum(c)[:-1]), c) + np.arange(len(i))]
        line = (i - j + len(two)) << bits | i
        line.sort()  # alignment by alignment, then by place
        first = np.flatnonzero(np.diff(line, prepend=-2) != 1)
        found.append(np.stack((line[first], np.diff(np.append(first, len(line))))))
    line, n = np.concatenate(found, 1)
    order = np.argsort(line, kind="stable")
    line, n = line[order], n[order]
    first = np.flatnonzero(np.diff(line, prepend=-2) != np.append(1, n[:-1]))
    n = np.add.reduceat(n, first) if len(first) else n
    a = line[first] & ((1 << bits) - 1)
    return np.column_stack((a, a - (line[first] >> bits) + len(two), n + hashing.SHINGLE - 1))


def joins(end: np.ndarray, start: np.ndarray, n: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """What it costs to go on from runs that end at ``end`` with runs of ``n`` words from ``start``, and whether one can.

    Words that both runs hold count for the first.  A gap of x and y words leaves x + y + 8 shingles unshared.
    """
    over = np.maximum(0, (end - start).max(-1))
    unshared = (start + over[..., None] - end).sum(-1) + 2 * (hashing.SHINGLE - 1)
    return over + weight * unshared, n - over >= hashing.SHINGLE


def best_sums(start: np.ndarray, n: np.ndarray, weight: float) -> np.ndarray:
    """The best sum (shared shingles less ``weight`` times the others) of the chains that end with each run; ordered by ``start``."""
    best = (n - hashing.SHINGLE + 1).astype(float)
    own = best.copy()
    pays = np.zeros(len(n), bool)
    pays[payable(start, n, own, np.zeros(len(n)), weight, weight)[0]] = True
    for i in range(len(n)) if pays.any() else ():
        if pays[i] or best[i] > own[i]:
            reach = np.searchsorted(start[:, 0], start[i, 0] + n[i] + best[i] / weight, "right")
            to = slice(i + 1, reach)
            cost, can = joins(start[i] + n[i], start[to], n[to], weight)
            can &= (start[to] > start[i]).all(1)
            best[to] = np.where(can, np.maximum(best[to], own[to] + best[i] - cost), best[to])
    return best


def payable(start: np.ndarray, n: np.ndarray, ahead: np.ndarray, back: np.ndarray, weight: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, next run, cost) of the joins that the best chains before and after them pay for; one of both pays half, ``least``."""
    end, shift = start + n[:, None], start[:, 0] - start[:, 1]
    order = np.argsort(shift, kind="stable")
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for sums, others in ((ahead, back), (back, ahead)):
        gap = (sums + others.max() + 1e-9) / weight - 2 * (hashing.SHINGLE - 1)  # words that a join may skip in both texts
        paying = np.flatnonzero((sums >= least - 1e-9) & (gap >= 1))
        low, high = np.searchsorted(shift[order], shift[paying] - gap[paying], "left"), np.searchsorted(shift[order], shift[paying] + gap[paying], "right")
        for a, b in steps(high - low, MATCHES):
            count = (high - low)[a:b]
            k = np.repeat(paying[a:b], count)
            x = order[np.repeat(low[a:b] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(len(k))]
            i, j = (k, x) if sums is ahead else (x, k)
            near = (start[j, 0] > start[i, 0]) & (start[j, 1] > start[i, 1]) & (start[j, 0] - end[i, 0] <= gap[k])
            i, j = i[near], j[near]
            cost, can = joins(end[i], start[j], n[j], weight)
            can &= ahead[i] + back[j] - cost >= -1e-9
            found.append((i[can], j[can], cost[can]))
    i, j, cost = (np.concatenate(x) for x in zip(*found, strict=True))
    _, first = np.unique(i * len(n) + j, return_index=True)
    return i[first], j[first], cost[first]


def passages(one: np.ndarray, two: np.ndarray, passage: int = PASSAGE, similarity: float = SIMILARITY, ordered: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Disjoint word spans of ``one`` that ``two`` has too, exactly or nearly.

    A chain of runs is a passage if s / (s + u) >= similarity for its s shared and u
    unshared shingles, that is s - weight * u >= 0.
    """
    weight = similarity / (1 - similarity)
    runs = equal_runs(one, two, in_order(two) if ordered is None else ordered)
    return spans_of(runs, len(one), passage, weight)


def spans_of(runs: np.ndarray, size: int, passage: int, weight: float, limits: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """The passages that the equal runs make: those of one alignment first, then chains over the runs that can still add to them.

    No passage leaves the ``limits``, if these are given.
    If every run begins behind the one before it in both texts, a chain that leaves out a run is worth less than with it,
    so sums over all runs tell everything.
    """
    if not len(runs):
        return []
    least = weight * (2 * hashing.SHINGLE - 1)
    if runs[:, 2].max() < passage and (runs[:, 2] - hashing.SHINGLE + 1).sum() < least:
        return []  # nothing pays for a join
    if len(runs) == 1:
        return [(int(a), int(a + k)) for a, _, k in runs if k >= passage]
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    alone = [(a, a + k) for a, k in runs[runs[:, 2] >= passage][:, [0, 2]].tolist()]
    if (runs[1:, :2] >= runs[:-1, :2] + runs[:-1, 2:]).all():
        return merged(alone + in_turn(runs, passage, weight))
    spans = merged(alone + aligned(runs, passage, weight))
    if limits and inside(spans, np.array(limits)).all():
        return spans
    rest = runs[joinable(runs, spans, size, weight)]
    start, n = rest[:, :2], rest[:, 2]
    if len(n) > 1 and (n - hashing.SHINGLE + 1 >= min(least / 2, passage - hashing.SHINGLE + 1) - 1e-9).any():
        spans += chains(start, n, passage, weight, least / 2, spans) if len(n) <= CHAINED else swept(start, n, passage, weight)
    return merged(spans)


def in_turn(runs: np.ndarray, passage: int, weight: float) -> list[tuple[int, int]]:
    """The longest passages from each run on, of runs that follow one another in both texts."""
    start, n = runs[:, :2], runs[:, 2]
    end = start + n[:, None]
    own = (n - hashing.SHINGLE + 1).astype(float)
    sums = np.cumsum(own)
    sums[1:] -= weight * np.cumsum((start[1:] - end[:-1]).sum(1) + 2 * (hashing.SHINGLE - 1))
    best = np.maximum.accumulate(sums[::-1])[::-1]
    last = np.maximum(np.searchsorted(-best, own - sums + 1e-9, "right") - 1, np.arange(len(n)))
    long = (last > np.arange(len(n))) & (end[last] - start >= passage).all(1)
    return list(zip(start[long, 0].tolist(), end[last[long], 0].tolist(), strict=True))


def aligned(runs: np.ndarray, passage: int, weight: float) -> list[tuple[int, int]]:
    """The longest passages from each run on that keep to one alignment, that is, whose edits replace words by as many."""
    shift = runs[:, 0] - runs[:, 1]
    order = np.lexsort((runs[:, 0], shift))
    a, n, shift = runs[order, 0], runs[order, 2], shift[order]
    if len(a) < 2:
        return []
    own = (n - hashing.SHINGLE + 1).astype(float)
    goes_on = shift[1:] == shift[:-1]
    cost = np.append(0.0, np.where(goes_on, 2 * weight * (a[1:] - a[:-1] - n[:-1] + hashing.SHINGLE - 1), 0.0))
    line = np.append(0, np.cumsum(~goes_on))
    sums = np.cumsum(own - cost)
    # one falling staircase over all alignments: the best sum from each run on
    step = np.ptp(sums) + own.max() + 1
    best = np.maximum.accumulate((sums - line * step)[::-1])[::-1]
    last = np.searchsorted(-best, -(sums - own - line * step) + 1e-9, "right") - 1
    last = np.maximum(last, np.arange(len(a)))
    end = a[last] + n[last]
    long = (last > np.arange(len(a))) & (line[last] == line) & (end - a >= passage)
    return list(zip(a[long].tolist(), end[long].tolist(), strict=True))


def numbers(values: np.ndarray) -> array:
    """An array that is quick to index one by one and takes eight bytes a value."""
    out = array("d" if values.dtype.kind == "f" else "q")
    out.frombytes(np.ascontiguousarray(values, np.float64 if values.dtype.kind == "f" else np.int64).tobytes())
    return out


def sums_before(start: np.ndarray, n: np.ndarray, weight: float) -> tuple[array, array, array, array]:
    """For each run: the best sum of a chain that ends with it, what its best join from a run before adds (maybe below 0),
    that run (-1: none), and the run that the best chain begins with.  Runs of a join do not overlap.

    A gap costs in proportion to its words in either text, so a run's worth to all that follow is one number,
    and the best of those that end before is a prefix maximum: runs times log of runs.
    """
    end = start + n[:, None]
    ranks = np.unique(end[:, 1])
    at, ask = numbers(np.searchsorted(ranks, end[:, 1]) + 1), numbers(np.searchsorted(ranks, start[:, 1], "right"))
    tree, who = numbers(np.full(len(ranks) + 1, -np.inf)), numbers(np.full(len(ranks) + 1, -1))
    own, worth_of, cost_of = (n - hashing.SHINGLE + 1).astype(float), weight * end.sum(1), numbers(weight * (start.sum(1) + 2.0 * (hashing.SHINGLE - 1)))
    worth_of, best, join = numbers(worth_of.astype(float)), numbers(own), numbers(np.full(len(n), -np.inf))
    before, first = numbers(np.full(len(n), -1)), numbers(np.arange(len(n)))
    a, e = numbers(start[:, 0]), numbers(end[:, 0])
    closing, done, size = numbers(np.argsort(end[:, 0], kind="stable")), 0, len(ranks) + 1
    for k in numbers(np.argsort(start[:, 0], kind="stable")):
        while e[closing[done]] <= a[k]:
            j = closing[done]
            done += 1
            worth, i = best[j] + worth_of[j], at[j]
            while i < size:
                if worth > tree[i]:
                    tree[i], who[i] = worth, j
                i += i & -i
        i, top = ask[k], -np.inf
        while i:
            if tree[i] > top:
                top, before[k] = tree[i], who[i]
            i -= i & -i
        join[k] = top - cost_of[k]
        if join[k] > 0:
            best[k], first[k] = best[k] + join[k], first[before[k]]
    return best, join, before, first


def swept(start: np.ndarray, n: np.ndarray, passage: int, weight: float) -> list[tuple[int, int]]:
    """Like :func:`chains` for any number of runs: the best chain over each run's best joins, if it is a passage."""
    end = start + n[:, None]
    forward = [np.array(x) for x in sums_before(start, n, weight)]
    backward = [np.array(x) for x in sums_before(-end, n, weight)]
    out, k = [], np.arange(len(n))
    for (_, join, other, first), (best, _, _, last), turned in ((forward, backward, False), (backward, forward, True)):
        some = k[(other >= 0) & (join + best >= -1e-9)]  # the run, its best join and the best chain beyond it
        head, tail = first[other[some]], last[some]
        head, tail = (tail, head) if turned else (head, tail)
        long = (end[tail] - start[head] >= passage).all(1)
        out += zip(start[head[long], 0].tolist(), end[tail[long], 0].tolist(), strict=True)
    return merged(out)


def chains(start: np.ndarray, n: np.ndarray, passage: int, weight: float, least: float, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the chains of two runs or more that are passages and leave ``spans``; of each first run the longest."""
    end = start + n[:, None]
    ahead = best_sums(start, n, weight)
    turned = np.lexsort((-end[:, 1], -end[:, 0]))
    back = np.empty(len(n))
    back[turned] = best_sums(-end[turned], n[turned], weight)
    after: dict[int, list[tuple[int, float]]] = {}
    ones, twos, costs = payable(start, n, ahead, back, weight, least)
    for i, j, cost in zip(ones.tolist(), twos.tolist(), costs.tolist(), strict=True):
        after.setdefault(i, []).append((j, cost))
    own, rest, out = (n - hashing.SHINGLE + 1).tolist(), back.tolist(), []
    at, to = start.tolist(), end.tolist()
    far = [x for x, _ in to]
    for i in sorted(after, reverse=True):
        far[i] = max(far[i], *(far[j] for j, _ in after[i]))
    for i in sorted(after):
        if any(a <= at[i][0] and far[i] <= b for a, b in spans):
            continue
        sums, todo, last = {i: float(own[i])}, [i], -1
        while todo:
            k = heapq.heappop(todo)
            for j, cost in after.get(k, ()):
                total = sums[k] - cost + own[j]
                if total - own[j] + rest[j] < -1e-9:  # no way back to a passage
                    continue
                if j not in sums:
                    heapq.heappush(todo, j)
                sums[j] = max(total, sums.get(j, total))
        for j, total in sums.items():
            if j != i and total >= -1e-9 and min(to[j][0] - at[i][0], to[j][1] - at[i][1]) >= passage:
                last = max(last, to[j][0])
        if last >= 0:
            out.append((at[i][0], last))
            spans = merged([*spans, out[-1]])
    return out


def joinable(runs: np.ndarray, spans: list[tuple[int, int]], size: int, weight: float) -> np.ndarray:
    """The runs outside ``spans``, and those in a span that is near enough to something outside it for a join.

    A chain adds to the spans only if it leaves one, over a gap that all equal words of the text could pay for.
    """
    a, b = runs[:, 0], runs[:, 0] + runs[:, 2]
    edge = np.bincount(a, minlength=size + 1) - np.bincount(b - hashing.SHINGLE + 1, minlength=size + 1)
    gap = np.count_nonzero(np.cumsum(edge)) / weight - 2 * (hashing.SHINGLE - 1)
    low, high = np.array([s[0] for s in spans], np.int64), np.array([s[1] for s in spans], np.int64)
    own = np.searchsorted(low, a, "right") - 1
    inside = (own >= 0) & (b <= high[own]) if spans else np.zeros(len(runs), bool)
    left, right = np.sort(np.append(a[~inside], low)), np.sort(np.append(b[~inside], high))
    after = np.append(left, 2 * size + 1e9)[np.searchsorted(left, low, "right")]  # begins after the span's begin
    before = np.append(-1e9, right)[np.searchsorted(right, high, "left")]  # ends before the span's end
    reached = (after - high <= gap) | (low - before <= gap)
    return ~inside | reached[own] if spans else ~inside


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def meetings(keyed: DataFrame, name: str) -> DataFrame:
    """``id, lead, near``: every document of a key of ``key, id, left, right`` and the smallest one that has it; ``near``: their windows overlap enough for a run."""
    leads = keyed.groupBy(F.col("key").alias("k")).agg(F.min("id").alias("lead"), F.max("id").alias("most")).where("lead < most")
    # stored, so that the joins deal both sides anew and a hot key can be split
    leads = stored(leads.select("k", "lead"), f"{name}-leads")
    met = stored(keyed.join(leads, F.col("key") == F.col("k")).select("key", "id", "left", "right", "lead"), f"{name}-met")
    own = stored(met.where("id = lead").groupBy(F.col("key").alias("k")).agg(F.max("left").alias("l_left"), F.max("right").alias("l_right")), f"{name}-own")
    common = F.least("left", "l_left").cast("int") + F.least("right", "l_right") + F.lit(1)
    star = met.where("id > lead").join(own, F.col("key") == F.col("k")).select("id", "lead", (common >= RUN - hashing.SHINGLE + 1).alias("near"))
    return star.groupBy("id", "lead").agg(F.max("near").alias("near"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", passage: int = PASSAGE, sketch: DataFrame | None = None) -> DataFrame:
    """``id, tag, lead, spans, link, first``: for a document and a smaller one, the word spans of the first that the second has too.

    ``first``: the second is the smallest document of a key or a text; all such pairs are there, of the others those that add something.
    ``link``: the pair is needed for the classes; of the others the classes come of themselves.
    ``tag`` is the hash of the words that the spans are of, in case rows with one id have
    different texts.  A document whose words are those of a smaller one entirely has one
    row, of its whole text, with the smallest of these.  Null ids, null texts and texts of
    fewer words than a passage have none; repeats inside one document do not count.
    """
    slim = keyed_texts(docs, id_col, text)
    sketch = stored(window_rows(slim), "windows") if sketch is None else sketch
    whole = sketch.where(F.col("id").isNotNull() & (F.col("n") >= passage))
    firsts = whole.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.min("id").alias("lead"), F.max("id").alias("most")).where("lead < most")
    firsts = stored(firsts.select("g1", "g2", "lead"), "texts")
    copies = whole.join(firsts, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("id") > F.col("lead")))
    span = F.array(F.struct(F.lit(0).alias("a"), F.col("n").cast("int").alias("b")))
    copies = stored(copies.select("id", F.col("h1").alias("tag"), "lead", span.alias("spans"), F.lit(True).alias("link")), "copies")
    gone = copies.select(F.col("id").alias("g_id"), "tag")
    own = whole.join(F.broadcast(gone) if small(gone) else gone, (F.col("id") == F.col("g_id")) & (F.col("h1") == F.col("tag")), "left_anti")
    keyed = own.select("id", F.explode(F.arrays_zip("keys", "left", "right")).alias("w")).select(F.col("w.keys").alias("key"), "id", F.col("w.left").alias("left"), F.col("w.right").alias("right"))
    pairs = stored(meetings(keyed, "passage"), "passage-pairs")
    rested(docs.sparkSession)  # the joins' heap is not needed beside the workers that compare texts
    found = checked(slim, pairs.where("near").select("id", "lead"), passage)
    rest = checked_rest(slim, pairs, found, passage)
    found = found.withColumn("first", F.lit(True)).unionByName(rest.withColumn("first", F.lit(False)))
    return found.distinct().unionByName(copies.withColumn("first", F.lit(True)))


def keyed_texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def checked(slim: DataFrame, pairs: DataFrame, passage: int) -> DataFrame:
    """``id, tag, lead, spans, link`` of the pairs ``id, lead`` whose texts share passages."""
    groups = pairs.groupBy(F.col("lead").alias("l")).agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).cast("int").alias("groups")).where("groups > 1")
    # stored and measured: if broadcast, pairs stay where they are; else a hot smallest document can be split
    groups = stored(groups, "passage-groups")
    side = F.broadcast(groups) if small(groups) else groups
    part = F.pmod(F.xxhash64("id"), F.coalesce("groups", F.lit(1))).cast("int").alias("part")
    dealt = pairs.join(side, F.col("lead") == F.col("l"), "left").select("id", "lead", part, F.lit(False).alias("own"))
    owns = dealt.select(F.col("lead").alias("id"), "lead", "part", F.lit(True).alias("own")).distinct()
    needed = stored(dealt.unionByName(owns).withColumnRenamed("id", "wanted"), "passage-texts")
    texts = slim.join(F.broadcast(needed) if small(needed) else needed, F.col("id") == F.col("wanted")).select("id", "lead", "part", "own", "text")

    def run(table: pa.Table) -> pa.Table:
        words, at, tags = words_of(table)
        ids, leads_, own = table.column("id").to_pylist(), table.column("lead").to_pylist(), table.column("own").to_numpy()
        out, rows = [], np.flatnonzero(~own)
        for k in {int(tags[i]): i for i in np.flatnonzero(own).tolist()}.values():
            out += [found_row(ids[i], tags[i], leads_[i], spans) for i, spans in passages_of_one(words, at, rows, k, passage)]
        return pa.Table.from_pylist(out, FOUND)

    return stored(texts.groupBy("lead", "part").applyInArrow(run, FOUND_TYPE), "passages")


def passages_of_one(words: np.ndarray, at: np.ndarray, texts: np.ndarray, two: int, passage: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """``i, spans`` of ``texts`` that have :func:`passages` of the text ``two``."""
    weight, least = SIMILARITY / (1 - SIMILARITY), least_shared(passage)
    hashes, offsets = hashing.shingles(words, at)
    ordered, wholes = in_order(words[at[two] : at[two + 1]]), None
    if len(ordered[0]) < least:
        return
    once = (ordered[0][1:] != ordered[0][:-1]).all()
    for x, y in steps(np.diff(offsets)[texts], MATCHES):
        some = texts[x:y]
        row, one = ranges(offsets[some], offsets[some + 1])
        low = np.minimum(np.searchsorted(ordered[0], hashes[one]), len(ordered[0]) - 1)
        held = np.flatnonzero(ordered[0][low] == hashes[one])
        held = held[(np.bincount(row[held], minlength=len(some)) >= least)[row[held]]]
        row, one, low, high = row[held], one[held] - offsets[some][row[held]], low[held], np.searchsorted(ordered[0], hashes[one[held]], "right") - 1
        if once:
            runs, turned, spans = runs_in_turn(row, one, ordered[1][low], len(some), passage)
            at_spans, at_runs = (np.searchsorted(z[:, 0], np.arange(len(some) + 1)) for z in (spans, runs))
        limits = tight_stretches(row, one, ordered[1][low], ordered[1][high], passage)
        at_most = np.searchsorted(limits[:, 0], np.arange(len(some) + 1))
        for r in np.unique(limits[:, 0]).tolist():
            i, most = int(some[r]), merged(list(map(tuple, limits[at_most[r] : at_most[r + 1], 1:].tolist())))
            if once and turned[r]:
                found = merged(list(map(tuple, spans[at_spans[r] : at_spans[r + 1], 1:].tolist())))
            elif once:
                found = spans_of(runs[at_runs[r] : at_runs[r + 1], 1:], at[i + 1] - at[i], passage, weight, most)
            else:
                wholes = whole_windows(words, at, passage) if wholes is None else wholes
                found = equal_parts(wholes[i], wholes[two], passage)
                if not inside(found, np.array(most)).all():
                    runs = equal_runs(words[at[i] : at[i + 1]], words[at[two] : at[two + 1]], ordered, hashes[offsets[i] : offsets[i + 1]])
                    found = spans_of(runs, at[i + 1] - at[i], passage, weight, most)
            if found:
                yield i, found


def words_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the column ``text``, the texts' offsets among them and the hashes of the texts."""
    texts = table.column("text").cast(pa.large_string()).combine_chunks()  # together they may be longer than 32 bits tell
    words, at = hashing.words(*raw(texts))
    return words, at, text_hashes(words, at)[0]


def found_row(id_: int, tag: int, lead: int, spans: list[tuple[int, int]], link: bool = True) -> dict:
    return {"id": id_, "tag": int(tag), "lead": lead, "spans": [{"a": a, "b": b} for a, b in spans], "link": link}


def checked_rest(slim: DataFrame, pairs: DataFrame, found: DataFrame, passage: int) -> DataFrame:
    """``id, tag, lead, spans, link`` of pairs of documents that met one smallest document of ``id, lead``, as far as they add to the classes or passages ``found``.

    Every two blocks of such documents are a group, so a group is bounded and their number grows with the square of the documents that share a smallest one.
    """
    groups = pairs.groupBy(F.col("lead").alias("l")).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("l", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int").alias("blocks"))
    groups = stored(groups, "passage-groups")
    member = pairs.select("id", "lead").join(F.broadcast(groups) if small(groups) else groups, F.col("lead") == F.col("l"))
    known = found.groupBy(F.col("id").alias("k_id"), F.col("lead").alias("k_lead")).agg(F.collect_list(F.struct("tag", "spans")).alias("known"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = member.join(known, (F.col("id") == F.col("k_id")) & (F.col("lead") == F.col("k_lead")), "left").select(
        F.col("id").alias("wanted"), "lead", block.alias("block"), "known", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    needed = stored(dealt.select("wanted", "lead", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "known"), "passage-texts")
    size = needed.withColumn("s", F.repeat(F.lit("x"), F.coalesce(F.aggregate("known", F.lit(0), lambda n, x: n + 16 + 8 * F.size(x["spans"])), F.lit(0))))
    texts = slim.join(F.broadcast(needed) if small(size, "s") else needed, F.col("id") == F.col("wanted")).select("id", "lead", "low", "high", "block", "known", "text")

    def run(table: pa.Table) -> pa.Table:
        words, at, tags = words_of(table)
        known = [next(([(x["a"], x["b"]) for x in k["spans"]] for k in ks or () if k["tag"] == tag), []) for ks, tag in zip(table.column("known").to_pylist(), tags.tolist(), strict=True)]
        low = (table.column("block").to_numpy() == table.column("low").to_numpy()).astype(int)
        both = table.column("low")[0] == table.column("high")[0]
        sides = [np.arange(len(low))] if both else [np.flatnonzero(low == k) for k in (0, 1)]
        ids, label = table.column("id").to_pylist(), labels(known)
        pairs = rest_of_pairs(words, at, table.column("id").to_numpy(), known, sides, passage, label)
        return pa.Table.from_pylist([found_row(ids[i], tags[i], ids[j], spans, bool(label[i] != label[j])) for i, j, spans in pairs], FOUND)

    return stored(texts.groupBy("lead", "low", "high").applyInArrow(run, FOUND_TYPE), "passages")


def rest_of_pairs(words: np.ndarray, at: np.ndarray, ids: np.ndarray, known: list[list[tuple[int, int]]], sides: list[np.ndarray], passage: int, label: np.ndarray | None = None) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """``i, j, spans`` of the pairs of texts, one of either of two sides (or both of one), that are passages of text i in the text j of a smaller id
    and add to the classes or to the passages ``known`` of i; ``label``: the texts' classes, joined after each pair, by default those with known passages in one."""
    hashes, offsets = hashing.shingles(words, at)
    values = np.unique(hashes, return_inverse=True)[1]
    each = [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
    indexes = [shingle_index(each, side, values) for side in sides]
    ordered, place = {}, np.full(int(values.max(initial=-1)) + 1, -1)
    label = labels(known) if label is None else label
    least, weight, wholes = least_shared(passage), SIMILARITY / (1 - SIMILARITY), None

    def added(i: int, j: int, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        if spans and (label[i] != label[j] or not inside(known[i], np.array(spans)).all()):
            yield i, j, spans
            label[label == label[j]] = label[i]
            known[i] = merged(known[i] + spans)

    for k, side in enumerate(sides):
        others, index = sides[len(sides) - 1 - k], indexes[len(sides) - 1 - k]
        for i in side.tolist():
            if len(each[i]) < least:
                continue
            some = others[candidates(each[i], index, ids[others] < ids[i], label[others] == label[i], outside(known[i], len(each[i])), least)]
            if not len(some):
                continue
            place[each[i]] = np.arange(len(each[i]))
            own = place[each[i]]  # of equal shingles the last place
            once = (own == np.arange(len(own))).all()
            for x, y in steps(np.diff(offsets)[some] + (0 if once else len(own)), MATCHES):
                js = some[x:y]
                row, one, two = shared_places(place, values, offsets, js, least)
                if once:
                    runs, turned, spans = runs_in_turn(row, one, two, len(js), passage)
                    new = spans
                    while len(new := new[~inside(known[i], new[:, 1:]) | (label[js[new[:, 0]]] != label[i])]):
                        best = new[np.argmax(new[:, 2] - new[:, 1]), 0]
                        yield from added(i, int(js[best]), merged([(a, b) for a, b in spans[spans[:, 0] == best, 1:].tolist()]))
                        new = new[new[:, 0] != best]
                    row, one, two = (z[~turned[row]] for z in (row, one, two))
                    each_row = np.searchsorted(runs[:, 0], np.arange(len(js) + 1))
                low, high, cell = np.full(len(js) * len(own), len(values)), np.full(len(js) * len(own), -1), row * len(own) + one
                np.minimum.at(low, cell, two)
                np.maximum.at(high, cell, two)
                line, spot = np.nonzero(high.reshape(len(js), len(own))[:, own] >= 0)
                cell = line * len(own) + own[spot]
                limits = tight_stretches(line, spot, low[cell], high[cell], passage)
                order = np.argsort(limits[:, 1] - limits[:, 2], kind="stable")
                order = order[~inside(known[i], limits[order, 1:]) | (label[js[limits[order, 0]]] != label[i])]
                done = np.zeros(len(js), bool)
                for r, a, b in limits[order].tolist():
                    j = int(js[r])
                    if done[r] or label[i] == label[j] and any(x <= a and b <= y for x, y in known[i]):
                        continue
                    done[r] = True
                    most = merged(list(map(tuple, limits[limits[:, 0] == r, 1:].tolist())))
                    if once:
                        spans = spans_of(runs[each_row[r] : each_row[r + 1], 1:], at[i + 1] - at[i], passage, weight, most)
                    else:
                        back = np.flatnonzero(place[each[j]] >= 0)  # the other text must have a stretch as well
                        if not len(stretches(np.zeros_like(back), back, passage)[0]):
                            continue
                        wholes = whole_windows(words, at, passage) if wholes is None else wholes
                        spans = equal_parts(wholes[i], wholes[j], passage)
                        if not inside(spans, np.array(most)).all():
                            if j not in ordered:
                                ordered[j] = in_order(words[at[j] : at[j + 1]])
                            found = equal_runs(words[at[i] : at[i + 1]], words[at[j] : at[j + 1]], ordered[j], hashes[offsets[i] : offsets[i + 1]])
                            spans = spans_of(found, at[i + 1] - at[i], passage, weight, most)
                    yield from added(i, j, spans)
            place[each[i]] = -1


def labels(known: list[list[tuple[int, int]]]) -> np.ndarray:
    """A class for each text; those with ``known`` passages have one."""
    label, linked = np.arange(len(known)), [i for i, spans in enumerate(known) if spans]
    label[linked] = linked[:1]
    return label


def candidates(own: np.ndarray, index: tuple[np.ndarray, np.ndarray], open_: np.ndarray, same: np.ndarray, new: np.ndarray, least: float) -> np.ndarray:
    """The ``open_`` texts of an index that may share ``least`` shingles with a text, if not of the ``same`` class, else one of the ``new`` ones.

    Who shares so many shares one beside as many of the most common ones as do not suffice, so a line that all have brings no two texts together.
    """
    from_, texts = index
    count = from_[own + 1] - from_[own]
    met = np.zeros(len(open_), bool)
    rare = np.argsort(count, kind="stable")[: len(own) - int(np.ceil(least)) + 1]
    for places, which in ((rare, open_ & ~same), (np.flatnonzero(new), open_ & same)):
        if not which.any():
            continue
        places, here = places[count[places] > 0], np.zeros(len(open_), bool)
        n = count[places]
        for a, b in steps(n, MATCHES) if n.sum() > MATCHES else [(0, len(n))]:
            here[texts[ranges(from_[own[places[a:b]]], from_[own[places[a:b]] + 1])[1]]] = True
        met |= here & which
    return np.flatnonzero(met)


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start up to its end, one range behind the other, and before them the numbers of the ranges."""
    n = end - start
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) + (start - np.append(0, np.cumsum(n)[:-1]))[row]


def shared_places(place: np.ndarray, values: np.ndarray, offsets: np.ndarray, texts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, one, two``: for each of ``texts`` that has ``least`` of them, the shingles that have a ``place``, and the places there and in the text, in the text's order."""
    row, two = ranges(offsets[texts], offsets[texts + 1])
    one = place[values[two]]
    held = np.flatnonzero(one >= 0)
    held = held[(np.bincount(row[held], minlength=len(texts)) >= least)[row[held]]]
    return row[held], one[held], two[held] - offsets[texts][row[held]]


def runs_in_turn(row: np.ndarray, one: np.ndarray, two: np.ndarray, rows: int, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``runs, turned, spans`` of many pairs at once: rows (pair, start in one, start in two, words); which pairs' runs follow one another in both texts;
    and the passages (pair, begin, end) in the first text of these, as :func:`in_turn` and single runs give them, by pair.

    Of ``one`` no shingle may be there twice.
    """
    weight, more = SIMILARITY / (1 - SIMILARITY), hashing.SHINGLE - 1
    first = np.flatnonzero((row[1:] != row[:-1]) | (one[1:] - one[:-1] != 1) | (two[1:] - two[:-1] != 1)) + 1
    first = np.append(0, first) if len(row) else first
    line, a, b, n = row[first], one[first], two[first], np.diff(np.append(first, len(row)))
    runs, turned = np.column_stack((line, a, b, n + more)), np.ones(rows, bool)
    gap_a, gap_b, on = a[1:] - a[:-1] - n[:-1] - more, b[1:] - b[:-1] - n[:-1] - more, line[1:] == line[:-1]
    turned[line[1:][on & ((gap_a < 0) | (gap_b < 0))]] = False
    cost = np.append(0.0, np.where(on, weight * (gap_a + gap_b + 2 * more), 0.0))[: len(n)]
    kept = turned[line]
    line, a, b, n, cost = line[kept], a[kept], b[kept], n[kept], cost[kept]
    if not len(line):
        return runs, turned, np.zeros((0, 3), np.int64)
    head = np.append(True, line[1:] != line[:-1])
    number = np.cumsum(head) - 1
    sums = np.cumsum(n - cost)
    sums -= (sums - n)[head][number]
    # one falling staircase over all pairs: the best sum from each run on
    step = np.ptp(sums) + n.max() + 1
    best = np.maximum.accumulate((sums - number * step)[::-1])[::-1]
    last = np.searchsorted(-best, n - sums + number * step + 1e-6, "right") - 1
    last = np.maximum(last, np.arange(len(n)))
    end_a, end_b = (a + n + more)[last], (b + n + more)[last]
    long = (end_a - a >= passage) & (end_b - b >= passage)
    alone = n + more >= passage
    spans = np.concatenate((np.column_stack((line, a, end_a))[long], np.column_stack((line, a, a + n + more))[alone & ~long]))
    return runs, turned, spans[np.argsort(spans[:, 0], kind="stable")]


def whole_windows(words: np.ndarray, at: np.ndarray, passage: int) -> list[np.ndarray]:
    """Numbers of every run of a passage's words of each text; equal runs have one number."""
    total, width = words, 1
    while 2 * width <= passage:
        total, width = hashing.mix(total[:-width] * np.uint64(hashing.BASE) + total[width:]), 2 * width
    if passage > width:
        total = hashing.mix(total[: width - passage] * np.uint64(hashing.BASE) + total[passage - width :])
    return [total[a : max(a, b - passage + 1)] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


def equal_parts(one: np.ndarray, two: np.ndarray, passage: int) -> list[tuple[int, int]]:
    """The spans of words of a text that runs of a passage's length cover which another has, by both texts' :func:`whole_windows`."""
    begin = np.flatnonzero(np.isin(one, two))
    first = np.flatnonzero(np.diff(begin, prepend=-2 - passage) > passage)
    last = np.append(first[1:], len(begin))[: len(first)] - 1
    return list(zip(begin[first].tolist(), (begin[last] + passage).tolist(), strict=True))


def inside(spans: list[tuple[int, int]], some: np.ndarray) -> np.ndarray:
    """Which of ``some`` spans (rows of begin, end) lie in one of the disjoint ``spans``."""
    if not spans:
        return np.zeros(len(some), bool)
    begin, end = np.array(sorted(spans)).T
    at = np.searchsorted(begin, some[:, 0], "right") - 1
    return (at >= 0) & (some[:, 1] <= end[at])


def runs_by_place(place: np.ndarray) -> np.ndarray:
    """Like :func:`equal_runs` with a text that has no shingle twice; ``place`` says where it has each shingle of the other text, or -1."""
    two = np.flatnonzero(place >= 0)
    one = place[two]
    first = np.flatnonzero((np.diff(one, prepend=-2) != 1) | (np.diff(two, prepend=-2) != 1))
    return np.column_stack((one[first], two[first], np.diff(np.append(first, len(two))) + hashing.SHINGLE - 1))


def outside(spans: list[tuple[int, int]], size: int) -> np.ndarray:
    """Which of ``size`` shingles are in none of the disjoint spans of words."""
    out = np.ones(size, bool)
    for a, b in spans:
        out[a : max(a, b - hashing.SHINGLE + 1)] = False
    return out


def shingle_index(each: list[np.ndarray], side: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each shingle's number the begin of its texts in a list, and the list: places in ``side``."""
    held = [np.unique(each[i]) for i in side.tolist()]
    value = np.concatenate([*held, np.zeros(0, np.int64)]).astype(np.int64)
    text = np.repeat(np.arange(len(side)), [len(h) for h in held])
    order = np.argsort(value, kind="stable")
    return np.append(0, np.cumsum(np.bincount(value, minlength=int(values.max(initial=-1)) + 1))), text[order]


def least_shared(passage: int) -> float:
    """Shared shingles that are one run as long as a passage, or pay for a join."""
    return min(passage - hashing.SHINGLE + 1, SIMILARITY / (1 - SIMILARITY) * (2 * hashing.SHINGLE - 1)) - 1e-9


def stretches(line: np.ndarray, place: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line, begin, end`` of the longest stretches of words, from each run on, that may hold a passage, by the places of shared shingles, line by line.

    A join leaves as many shingles unshared as a text has between the runs, and four more of the other's.  Leaving a run out costs less than
    its joins only if it is short, and is made up for by counting such a run for more; so all runs of a stretch are taken.
    """
    if len(place) < least_shared(passage):
        return line[:0], place[:0], place[:0]
    weight = SIMILARITY / (1 - SIMILARITY)
    begin = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 1))
    n = np.diff(np.append(begin, len(line)))
    line, first = line[begin], place[begin]
    last = first + n
    worth = n + np.maximum(0, weight * (hashing.SHINGLE - 1) - (weight + 1) * n)
    missing = np.append(0, first[1:] - last[:-1] + hashing.SHINGLE - 1)
    sums = np.cumsum(worth - np.where(np.diff(line, prepend=-1) == 0, weight * missing, 0.0))
    # one falling staircase over all lines: the last run up to which a stretch pays for its joins
    step = np.ptp(sums) + worth.max() + 1
    best = np.maximum.accumulate((sums - line * step)[::-1])[::-1]
    end = np.searchsorted(-best, -(sums - worth - line * step) + 1e-9, "right") - 1
    end = last[np.maximum(end, np.arange(len(n)))] + hashing.SHINGLE - 1
    long = np.flatnonzero(end - first >= passage)
    return line[long], first[long], end[long]


def tight_stretches(line: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, passage: int) -> np.ndarray:
    """Rows (line, begin, end) like :func:`stretches`, by the first and last places that the shared shingles have in the other text as well.

    A run of shared places is worth its shingles, fewer if they have fewer places in the other text; a join costs the words between
    two runs in one text and those that are at least between them in the other. The best sums from every run to every other tell
    what a passage may reach. Lines of more than ``RUNS`` runs have the plain stretches.
    """
    weight, more = SIMILARITY / (1 - SIMILARITY), hashing.SHINGLE - 1
    if not len(line):
        return np.zeros((0, 3), np.int64)
    first = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 1))
    of, n = line[first], np.diff(np.append(first, len(line)))
    runs = np.bincount(of)
    out = [np.column_stack(stretches(*(x[runs[line] > RUNS] for x in (line, place)), passage))]
    lines = np.flatnonzero((runs > 0) & (runs <= RUNS))
    nth = np.arange(len(of)) - np.append(0, np.cumsum(runs)[:-1])[of]
    begin, end = place[first], place[first] + n + more
    low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
    worth = np.minimum(n, high - low + 1)
    for a, b in steps(runs[lines] ** 2, MATCHES):
        some = lines[a:b]
        here = np.flatnonzero((of >= some[0]) & (of <= some[-1]) & (runs[of] <= RUNS))
        row, column, k = np.searchsorted(some, of[here]), nth[here], int(runs[some].max())
        tables = np.zeros((5, len(some), k))
        tables[:, row, column] = begin[here], end[here], low[here], high[here], worth[here]
        begins, ends, lows, highs, worths = tables
        gap = np.maximum(0, begins[:, None, :] - ends[:, :, None]) + np.maximum(0, lows[:, None, :] - highs[:, :, None] - hashing.SHINGLE)
        cost = np.where(highs[:, None, :] > lows[:, :, None], weight * (gap + 2 * more), np.inf)
        best = np.full((len(some), k, k), -np.inf)
        best[:, range(k), range(k)] = worths
        for x in range(1, k):
            best[:, :x, x] = worths[:, x, None] + (best[:, :x, :x] - cost[:, None, :x, x]).max(2)
        long = (best >= -1e-6) & (ends[:, None, :] - begins[:, :, None] >= passage) & (worths > 0)[:, :, None] & (worths > 0)[:, None, :]
        r, f = np.nonzero(long.any(2))
        to = k - 1 - long[r, f, ::-1].argmax(1)
        out.append(np.column_stack((some[r], begins[r, f], ends[r, to])).astype(np.int64))
    out = np.concatenate(out)
    return out[np.argsort(out[:, 0], kind="stable")]


def span_sets(found: DataFrame) -> DataFrame:
    """``id, tag, spans``: all spans of a document's text, disjoint and in order, as structs (a, b)."""
    every = F.sort_array(F.flatten(F.collect_list("spans")))
    start = F.array().cast("array<struct<a:int,b:int>>")

    def fold(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (x["a"] <= last["b"]), joined).otherwise(F.concat(acc, F.array(x)))

    return found.groupBy("id", "tag").agg(every.alias("p")).select("id", "tag", F.aggregate("p", start, fold).alias("spans"))


def cut(text: str, spans: list[int]) -> str:
    """The text without the words of the spans (start, end, ...) and the separators after them."""
    data, _ = raw(pa.array([text]))
    held = ~hashing.SPACES[data]
    starts = np.flatnonzero(held & ~np.append(False, held[:-1]))
    starts = np.append(starts, len(data))
    keep = np.ones(len(data), bool)
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        keep[starts[a] : starts[b]] = False
    return data[keep].tobytes().decode()


def without_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut from every text but the smallest document's;
    documents that lose all their words go."""
    at, cuts, gone_ = fresh(docs, "__id", "__spans", "__gone")
    spans = span_sets(found).select(F.col("id").alias(at), F.struct("tag", F.flatten(F.transform("spans", lambda x: F.array(x["a"], x["b"]))).alias("spans")).alias("s"))
    spans = stored(spans.groupBy(at).agg(F.collect_list("s").alias(cuts)), "spans")
    flat = F.array_join(F.flatten(F.transform(cuts, lambda s: s["spans"])), ",")
    side = F.broadcast(spans) if small(spans.withColumn("s", flat), "s") else spans
    joined = docs.join(side, F.col(f"`{id_col}`").cast("long") == F.col(at), "left").drop(at)
    kept = [c for c in docs.columns if c != text]
    to = T.StructType([docs.schema[c] for c in kept] + [T.StructField(text, T.StringType()), T.StructField(gone_, T.BooleanType())])

    def left(text: str, spans: list[dict]) -> str:
        tag = int(text_hashes(*hashing.words(*raw(pa.array([text]))))[0][0])
        return next((cut(text, s["spans"]) for s in spans if s["tag"] == tag), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(len(kept)).to_pylist(), b.column(len(kept) + 1).to_pylist()
            new = [left(t, s) if s and t else t for t, s in zip(texts, spans, strict=True)]
            gone = [t != n and not n.strip(" \t\n\v\f\r") for t, n in zip(texts, new, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(new, pa.string()), pa.array(gone, pa.bool_())], names=to.names)

    small_batches(docs.sparkSession)
    out = joined.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"), F.col(cuts)).mapInArrow(tidy(run), to)
    return out.where(~F.col(gone_)).select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", passage: int = PASSAGE) -> DataFrame:
    """One row per input row: ``id, class_id, n_links, dup_words, spans``.

    ``class_id`` is the smallest id among the documents connected by shared passages
    (a document without any is alone), ``n_links`` its links with the smallest document of
    a key, as either, and 1 if its class has others that it meets otherwise (a text that
    stands in several rows has its links from the smallest of them, and the others one
    to that), ``dup_words`` the words of its passages that a smaller document has,
    ``spans`` their word places as ``a-b,a-b``.  A null id has a null class; rows with one
    id share class and links, and have the passages of their own text; an empty table
    gives no rows.
    """
    sketch = stored(window_rows(keyed_texts(docs, id_col, text)), "windows")
    found = repeated_passages(docs, id_col, text, passage, sketch)
    spans = span_sets(found).select(
        F.col("id").alias("s_id"), "tag",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"]).alias("dup_words"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["a"], x["b"])), ",").alias("spans"),
    )
    classes = components(found.where("link").select(F.col("id").alias("a"), F.col("lead").alias("b"))).select(F.col("node").alias("c_id"), "root")
    linked = found.where("first").select("id", "lead").distinct()
    ends = linked.select(F.col("id").alias("l_id")).unionByName(linked.select(F.col("lead").alias("l_id")))
    links = ends.groupBy("l_id").agg(F.count(F.lit(1)).alias("n_links"))
    about = stored(classes.join(links, F.col("c_id") == F.col("l_id"), "left").select("c_id", "root", F.coalesce("n_links", F.lit(1)).alias("n_links")), "passage-classes")
    spans = stored(spans, "passage-spans")
    rows = sketch.select("id", "h1").join(F.broadcast(about) if small(about) else about, F.col("id") == F.col("c_id"), "left")
    side = F.broadcast(spans) if small(spans, "spans") else spans
    return rows.join(side, (F.col("id") == F.col("s_id")) & (F.col("h1") == F.col("tag")), "left").select(
        F.col("id").alias(id_col), F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("dup_words", F.lit(0)).alias("dup_words"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))
