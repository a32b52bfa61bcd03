"""Token counts by rank-synchronous merging.

The distinct pre-tokens of a step are held as one ragged array of symbols.  Each
round looks up the rank of every adjacent pair, finds each pre-token's lowest rank
and applies that pair wherever it occurs in the pre-token, all pre-tokens at once.
The symbols that survive are its tokens.  The text is never shuffled.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import annotate, read, remembered

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000
#: The White_Space property.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
FIELDS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeTable:
    """The vocabulary and the merges of a BPE file with an end-of-word mark."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int64)
        self.last = np.array([ids[x + end] for x in letters], np.int64)
        self.width = max(ids.values()) + 1
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([ids[a] * self.width + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, len(keys))
        self.made = np.array([ids[a + b] for a, b in merges] + [0], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of merges where there is none."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.made) - 1)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word (of one byte at least)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        out, none = np.zeros(len(words), np.int64), len(self.made) - 1
        while len(symbols):
            rank = np.full(len(symbols), none, np.int64)
            same = word[1:] == word[:-1]
            rank[:-1][same] = self.rank(symbols[:-1][same], symbols[1:][same])
            starts = np.flatnonzero(np.append(True, ~same))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            done = best == none
            out[word[starts[done]]] = sizes[done]
            hit = (rank == np.repeat(best, sizes)) & (rank < none)
            # a run of hits is one repeated symbol: merge its first, third, fifth pair
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            hit &= (place - run) % 2 == 0
            symbols = np.where(hit, self.made[rank], symbols)
            stay = ~np.append(False, hit[:-1]) & np.repeat(~done, sizes)
            symbols, word = symbols[stay], word[stay]
        return out


MEMORY = "token counts"


def counter(path: str) -> Callable[[pa.Array], list]:
    """The counter of a file in this process; its memory of pre-tokens outlives the task."""
    name, count = remembered(MEMORY, lambda: (path, new_counter(path)))
    return count if name == path else new_counter(path)


def new_counter(path: str) -> Callable[[pa.Array], list]:
    table = MergeTable(path)
    special = regex.compile("|".join(map(regex.escape, table.special)))
    pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
    known: dict[str, int] = {}

    def words_of(text: str) -> list[str]:
        # one letter at a time, as the library lowers: no final sigma
        return pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def judge(texts: pa.Array) -> list:
        nonlocal known
        rows = texts.to_pylist()
        split = []
        for text in rows:
            parts = special.split(text) if "<|" in text else [text]
            split.append((len(parts) - 1, [w for p in parts for w in words_of(p)]))
        if len(known) > REMEMBERED:
            known = {}
        new = list(set().union(*(ws for _, ws in split)).difference(known))
        if new:
            known.update(zip(new, table.count([w.encode() for w in new]).tolist(), strict=True))
        n = [k + sum(map(known.__getitem__, ws)) for k, ws in split]
        return [pa.array([len(t.encode()) for t in rows], pa.int64()), pa.array(n, pa.int64())]

    return judge


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` without its text, plus ``n_bytes, n_tokens, over_limit``.

    Null counts as empty: no bytes, no tokens.  Special strings inside a text are one
    token each, as the library has it by default.  Rows are independent.
    """
    out = annotate(docs, text, FIELDS, lambda: counter(tokenizer_path), memory=MEMORY)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
