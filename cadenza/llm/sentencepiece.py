"""SentencePiece encoding and decoding by suffix-array matching.

The distinct unseen words of a step are laid out as one text and indexed by a suffix
array; every piece is binary-searched in it, and the ranges give all places where a
piece occurs, the edges.  Edges are sorted by where they end and relaxed from left
to right, all words in step: of the edges that end at a place exactly one continues
the encoding of the prefix before it, the one that BPE would not have merged
otherwise across the seam.  Following the chosen edges back gives the pieces.

No piece holds a space mark after another character (checked when a model is read),
so words are encoded on their own.  Words that begin with several space marks, whose
pieces tie in score, are merged directly.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cadenza.llm.common import annotate, raw, read, remembered, small_batches, steps, tidy

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words whose pieces a worker remembers of each of two generations.
REMEMBERED = 120_000
#: Words indexed at once, which bounds the memory of the suffix array and the edges.
INDEXED = 30_000
CODE_BITS = 21
#: Beyond all ranks.
NEVER = np.iinfo(np.int64).max
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
FIELDS = T.StructType(
    [T.StructField("n_bytes", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
)
IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])


def proto(data: bytes) -> Iterator[tuple[int, object]]:
    """The (number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        value = data[at : at + n]
        at += n
        yield key >> 3, struct.unpack("<f", value)[0] if kind == 5 else value


class PairTable:
    """Numbers below 65536 by keys below 2**46, in one open hash table that whole arrays are looked up in."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(8 * len(keys)).bit_length())
        self.slots = np.full((1 << self.bits) + 64, -1, np.int64)
        todo, at = keys << 16 | values, self.slot(keys)
        while len(todo):
            _, first = np.unique(at, return_index=True)
            put = first[self.slots[at[first]] == -1]
            self.slots[at[put]] = todo[put]
            rest = self.slots[at] != todo
            todo, at = todo[rest], at[rest] + 1
            if len(at) and at.max() >= len(self.slots):
                self.slots = np.append(self.slots, np.full(64, -1, np.int64))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, missing: int) -> np.ndarray:
        """The number of each key, or ``missing``."""
        out = np.full(len(keys), missing, np.int64)
        at = self.slot(keys)
        held = self.slots[at]
        hit = held >> 16 == keys
        out[hit] = held[hit] & 0xFFFF
        live = np.flatnonzero(~hit & (held >= 0))
        while len(live):  # a slot that another key took
            at = at[live] if len(at) == len(keys) else at
            at = at + 1
            held = self.slots[at]
            hit = held >> 16 == keys[live]
            out[live[hit]] = held[hit] & 0xFFFF
            stay = ~hit & (held >= 0)
            live, at = live[stay], at[stay]
        return out


class PieceModel:
    """Pieces numbered so that single characters come first, then the others by falling score."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            data = f.read()
        fields = list(proto(data))
        self.name = hashlib.sha256(data).hexdigest()
        pieces = []
        for number, value in fields:
            if number == 1:
                d = dict(proto(value))
                pieces.append((d[1].decode(), d.get(2, 0.0), d.get(3, NORMAL)))
        trainer, norm = (dict(proto(b"".join(v for n, v in fields if n == k))) for k in (2, 3))
        if trainer.get(3, 1) != 2 or norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or any(k == USER for _, _, k in pieces):
            raise ValueError("only BPE models with a dummy prefix and without normalisation or user-defined pieces are read")
        self.texts = [p for p, _, _ in pieces]
        self.byte_ids = [0] * 256
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        normal = {p: (s, i) for i, (p, s, k) in enumerate(pieces) if k == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece goes on after a space mark")
        self.score = {p: s for p, (s, _) in normal.items()}
        self.id = {p: i for p, (_, i) in normal.items()}
        decoded = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k != NORMAL else p.replace(MARK, " ").encode() for p, _, k in pieces]
        self.bytes = np.frombuffer(b"".join(decoded), np.uint8)
        self.byte_sizes = np.fromiter(map(len, decoded), np.int64, len(decoded))
        self.byte_at = np.cumsum(self.byte_sizes) - self.byte_sizes

        letters = sorted(p for p in normal if len(p) == 1)
        longer = sorted((p for p in normal if len(p) > 1 and not p.startswith(MARK * 2)), key=lambda p: -normal[p][0])
        longer = [p for p in longer if self.merge(p) == [p]]  # the others never come out
        self.names = ["\0", *letters, *longer]  # 0 is a character without a piece
        self.number = {p: i for i, p in enumerate(self.names)}
        self.sizes = np.array([len(p) for p in self.names], np.int64)
        self.ids = np.array([0, *(self.id[p] for p in self.names[1:])], np.int64)
        n = len(self.names)
        self.left, self.right = np.arange(n), np.arange(n)
        keys, made = [], []
        for p in longer:
            a, b = self.merge(p, p)
            self.left[self.number[p]], self.right[self.number[p]] = self.number[a], self.number[b]
            for k in range(1, len(p)):
                if p[:k] in self.number and p[k:] in self.number:
                    keys.append(self.number[p[:k]] * n + self.number[p[k:]])
                    made.append(self.number[p])
        self.pairs = PairTable(np.array(keys, np.int64), np.array(made, np.int64))
        # every piece as characters, for the search
        self.long = np.arange(len(letters) + 1, n)
        self.chars = np.frombuffer("".join(longer).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.at = np.cumsum(self.sizes[self.long]) - self.sizes[self.long]
        heads = [[ord(c) for c in p[:3]] for p in longer]
        self.head_low, self.head_high = (np.array([sum(c << CODE_BITS * (2 - i) for i, c in enumerate(h + [fill] * (3 - len(h)))) for h in heads], np.int64) for fill in (0, (1 << CODE_BITS) - 1))
        self.letter_codes = np.array([ord(p) for p in letters], np.int64)

    def merge(self, text: str, without: str | None = None) -> list[str]:
        """BPE as the library does it: the best score first, then the leftmost; ``without`` counts as no piece."""
        parts: list[str] = list(text)
        after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            if a >= 0 and (b := after[a]) >= 0:
                both = parts[a] + parts[b]
                if both in self.score and both != without:
                    heapq.heappush(heap, (-self.score[both], a, b, both))

        for a in range(len(parts)):
            offer(a)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not parts[a] or after[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, ""
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(before[a])
            offer(a)
        return [p for p in parts if p]

    def holds(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair of pieces as it is: undo merges towards the seam,
        later ones first, and look for a pair across it that would have been merged before."""
        n = len(self.names)
        out, live = np.ones(len(left), bool), np.arange(len(left))
        a, b, limit = left.copy(), right.copy(), np.full(len(left), NEVER)
        while len(live):
            bad = self.pairs.find(a * n + b, NEVER) < limit
            out[live[bad]] = False
            below_a, below_b = self.right[a], self.left[b]
            split_a, split_b = below_a != a, below_b != b
            first = split_a & ((a > b) | ~split_b)
            second = split_b & ~first
            limit = np.where(first, a, np.where(second, b + 1, limit))
            a, b = np.where(first, below_a, a), np.where(second, below_b, b)
            stay = (first | second) & ~bad
            live, a, b, limit = live[stay], a[stay], b[stay], limit[stay]
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of a piece of several characters."""
        deep = int(self.sizes.max())
        order = order_of_suffixes(codes, deep)
        padded = np.append(codes, np.zeros(deep + 1, np.int64))
        size = self.sizes[self.long]
        # the first three characters in one search
        heads = padded[order] << 2 * CODE_BITS | padded[order + 1] << CODE_BITS | padded[order + 2]
        lo, hi = np.searchsorted(heads, self.head_low, "left"), np.searchsorted(heads, self.head_high, "right")
        for d in range(3, deep):
            live = np.flatnonzero((size > d) & (lo < hi))
            if not len(live):
                break
            wanted = self.chars[self.at[live] + d]
            ends = []
            for strict in (False, True):
                a, b = lo[live].copy(), hi[live].copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    seen = padded[order[np.minimum(mid, len(order) - 1)] + d]
                    up = ((seen <= wanted) if strict else (seen < wanted)) & open_
                    a, b = np.where(up, mid + 1, a), np.where(open_ & ~up, mid, b)
                ends.append(a)
            lo[live], hi[live] = ends
        count = hi - lo
        place = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return order[place], np.repeat(self.long, count)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words' pieces, and the offsets of the words among them."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("\0".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        word = np.repeat(np.arange(len(words)), sizes + 1)[: len(codes)]
        at = np.searchsorted(self.letter_codes, codes)
        single = np.where(self.letter_codes[np.minimum(at, len(self.letter_codes) - 1)] == codes, at + 1, 0)
        places = np.flatnonzero(np.arange(len(codes)) - first[word] < sizes[word])
        start, piece = self.edges(codes)
        start, piece = np.concatenate((places, start)), np.concatenate((single[places], piece))
        end = start + self.sizes[piece]
        step = end - first[word[start]]
        order = np.argsort(step, kind="stable")
        start, piece, end, step = start[order], piece[order], end[order], step[order]
        last = np.full(len(codes) + 2, -1, np.int64)
        bounds = np.searchsorted(step, np.arange(1, int(step.max(initial=0)) + 2))
        begins = first[word[start]] == start
        for a, b in zip(bounds, bounds[1:], strict=False):
            s, p = start[a:b], piece[a:b]
            ok = begins[a:b].copy()
            rest = np.flatnonzero(~ok)
            ok[rest] = self.holds(last[s[rest]], p[rest])
            last[end[a:b][ok]] = p[ok]
        # back from the ends, all words in step
        found, of = [], []
        open_, at_ = np.flatnonzero(sizes > 0), (first + sizes)[sizes > 0]
        while len(open_):
            p = last[at_]
            found.append(p)
            of.append(open_)
            at_ = at_ - self.sizes[p]
            more = at_ > first[open_]
            open_, at_ = open_[more], at_[more]
        flat, of = np.concatenate(found[::-1]), np.concatenate(of[::-1])
        return flat[np.argsort(of, kind="stable")], np.append(0, np.cumsum(np.bincount(of, minlength=len(words))))

    def pieces_of(self, word: str, numbers: list[int]) -> list[int]:
        """Vocabulary ids; a character without a piece becomes its UTF-8 bytes."""
        out, at = [], 0
        for n in numbers:
            out += [self.byte_ids[b] for b in word[at].encode()] if n == 0 else [int(self.ids[n])]
            at += int(self.sizes[n])
        return out

    def merged_ids(self, word: str) -> list[int]:
        return [i for p in self.merge(word) for i in ([self.id[p]] if p in self.id else [self.byte_ids[b] for b in p.encode()])]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, marks as spaces, without the space that encoding put in front."""
        back, _ = self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))
        return back.tobytes().removeprefix(b" ").decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids' pieces, and the offsets of the texts, which have theirs in ``at``, among them; nothing is taken away in front."""
        size = self.byte_sizes[ids]
        ends = np.append(0, np.cumsum(size))
        return self.bytes[np.repeat(self.byte_at[ids] - ends[:-1], size) + np.arange(ends[-1])], ends[at]


def order_of_suffixes(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array by prefix doubling, sorted as deep as ``depth`` characters."""
    rank, k = codes, 1
    while True:
        ahead = np.zeros_like(rank)
        ahead[:-k or None] = rank[k:]
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(key)
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.append(1, np.diff(key[order]) != 0))
        rank, k = new, 2 * k
        if k >= depth:
            return order


MEMORY = "sentencepiece"


Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def encoder(model: PieceModel) -> Encoder:
    """The model's encoder in this process; its memory of words outlives the task."""
    name, encode = remembered(MEMORY, lambda: (model.name, batch_encoder(model)))
    return encode if name == model.name else batch_encoder(model)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, each with the space that ends it, and the offsets of the texts among them.

    A space that begins a text, or follows another, belongs to the word after it.
    """
    space = data == 0x20
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    ends = ends[~np.isin(ends, offsets)]
    full = np.diff(offsets) > 0
    starts = np.sort(np.concatenate((offsets[:-1][full], ends + 1)), kind="stable")
    counts = full + np.bincount(np.searchsorted(offsets, ends, "right") - 1, minlength=len(full))
    bounds = np.append(starts, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return words, np.append(0, np.cumsum(counts))


def batch_encoder(model: PieceModel) -> Encoder:
    """From texts to all their ids and the offsets of the texts among these, with a memory of words in two generations."""
    known: dict[bytes, bytes] = {}
    older: dict[bytes, bytes] = {}

    def learn(new: list[bytes]) -> None:
        """Adds words to the memory."""
        names = [MARK + w.removesuffix(b" ").decode().replace(" ", MARK) if w.strip(b" ") else MARK * (len(w) + 1) for w in new]
        odd = [i for i, w in enumerate(names) if w.startswith(MARK * 2) or "\0" in w]
        known.update((new[i], np.array(model.merged_ids(names[i]), np.int32).tobytes()) for i in odd)
        every = np.setdiff1d(np.arange(len(new)), odd, assume_unique=True).tolist()
        for i in range(0, len(every), INDEXED):
            part = every[i : i + INDEXED]
            plain = [names[k] for k in part]
            flat, at = model.encode_words(plain)
            data, bounds = model.ids[flat].astype(np.int32).tobytes(), (4 * at).tolist()
            known.update(zip((new[k] for k in part), (data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)), strict=True))
            for k in np.unique(np.searchsorted(at, np.flatnonzero(flat == 0), side="right") - 1).tolist():
                known[new[part[k]]] = np.array(model.pieces_of(plain[k], flat[at[k] : at[k + 1]].tolist()), np.int32).tobytes()

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        nonlocal known, older
        if len(known) > REMEMBERED:
            known, older = {}, known
        words, at = words_of(*raw(pc.replace_substring(texts, MARK, " ")))
        coded = words.dictionary_encode()
        distinct, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        missing = [w for w in distinct if w not in known]
        known.update((w, older[w]) for w in missing if w in older)
        learn([w for w in missing if w not in older])
        pieces = [known[w] for w in distinct]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) >> 2
        count = size[of]
        ends = np.append(0, np.cumsum(count))
        first = (np.cumsum(size) - size)[of] - ends[:-1]
        return np.frombuffer(b"".join(pieces), np.int32)[np.repeat(first, count) + np.arange(ends[-1])], ends[at]

    return encode


def new_encoder(model: PieceModel) -> Callable[[list[str]], list[np.ndarray]]:
    """From texts to the ids of each."""
    run = batch_encoder(model)

    def encode(texts: list[str]) -> list[np.ndarray]:
        ids, at = run(pa.array(texts, pa.string()))
        return np.split(ids, at[1:-1])

    return encode


def judge_round_trips(model: PieceModel) -> Callable[[pa.Array], list]:
    encode = encoder(model)

    def judge(texts: pa.Array) -> list:
        ids, at = encode(texts)
        data, offsets = raw(pc.replace_substring(texts, MARK, " "))
        back, ends = model.decode_all(ids, at)
        rows = list(zip(at, at[1:], strict=False))
        same = [np.array_equal(back[a + (b > a) : b], data[c:d]) for a, b, c, d in zip(ends, ends[1:], offsets, offsets[1:], strict=False)]
        return [
            pc.binary_length(texts).cast(pa.int64()),
            pa.array(np.diff(at), pa.int64()),
            pa.array([hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in rows], pa.string()),
            pa.array(same, pa.bool_()),
        ]

    return judge


def encode(docs: DataFrame, model: PieceModel, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` plus ``ids``.  Null counts as empty, which has no pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def worker() -> Callable[[pa.Array], list]:
        run = encoder(shared.value)

        def ids_of(texts: pa.Array) -> list:
            ids, at = run(texts)
            return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))]

        return ids_of

    return annotate(docs, text, IDS, worker, keep_text, memory=MEMORY)


def decode(docs: DataFrame, model: PieceModel, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` decoded into ``text``; null ids give an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (ids, text)]
    to = T.StructType([docs.schema[c] for c in kept] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.list_value_length(whole.column(len(kept))), 0).to_numpy(zero_copy_only=False)
            for a, b in steps(4 * sizes):
                part = whole.slice(a, b - a)
                flat = part.column(len(kept)).flatten().to_numpy(zero_copy_only=False)
                back, ends = shared.value.decode_all(flat, np.append(0, np.cumsum(sizes[a:b])))
                rows = [back[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)]
                texts = pa.array([x.removeprefix(b" ").decode("utf-8", "replace") for x in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=to.names)

    small_batches(docs.sparkSession)
    return docs.select(*[f"`{c}`" for c in kept], f"`{ids}`").mapInArrow(tidy(run, MEMORY), to)


def round_trips(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``n_bytes, n_pieces, ids_sha256`` (of little-endian
    32-bit ids) and ``round_trip``: whether decoding gives the text back (a space mark in
    it as a space)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, text, FIELDS, lambda: judge_round_trips(shared.value), memory=MEMORY)


def production_model() -> PieceModel:
    import public_tokenizers

    return PieceModel(public_tokenizers.path(MODEL))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(read(spark, sf_dir, "documents").select("doc_id", "text"), production_model())
