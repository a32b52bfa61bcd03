"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of eight bytes run at every fourth byte over
overlapping chunks that cover the whole document, each filter's maximum over a chunk
goes through a small hidden layer to the chunk's logit of low quality, and the
largest chunk logit is the document's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import annotate, labelled_sample, raw, read, trim

#: Bounds of the labelled sample: documents and bytes a class.
PER_CLASS, SAMPLE_BYTES = 1200, 4 << 20
HELD = (3, 1)
CHUNK, STEP, HOP = 512, 448, 4
EMBED, FILTERS, HIDDEN = 8, 40, 16
EPOCHS, BATCH, RATE, SEED = 12, 24, 4e-3, 7
#: Chunks computed at once.
BLOCK = 192
FIELDS = T.StructType([T.StructField("score", T.DoubleType())])


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All chunks of all texts: their first byte, their length, their text.  An empty text has one empty chunk."""
    size = np.diff(offsets)
    n = np.maximum(1, -(-(size - (CHUNK - STEP)) // STEP))
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][row] + k * STEP
    return start, np.minimum(CHUNK, offsets[1:][row] - start), row


def cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The chunks' bytes, 0 where a chunk is shorter."""
    place = np.arange(CHUNK)
    inside = place < size[:, None]
    return np.where(inside, data[np.minimum(start[:, None] + place, max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8)


class ByteNet:
    """The network's arrays; ``logits`` are those of low quality."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        n = HOP * EMBED
        self.p = {
            "e": r.normal(0, 0.5, (256, EMBED)),
            "w": r.normal(0, (2 * n) ** -0.5, (n, 2 * FILTERS)),
            "b": np.zeros(FILTERS),
            "u": r.normal(0, FILTERS**-0.5, (FILTERS + 1, HIDDEN)),
            "c": np.zeros(HIDDEN),
            "v": r.normal(0, HIDDEN**-0.5, HIDDEN),
            "d": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pooled(self, x: np.ndarray, size: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's maximum over its chunk, and its place; positions past the text count as 0."""
        p = self.p
        z = p["e"][x].reshape(len(x) * CHUNK // HOP, HOP * EMBED) @ p["w"]
        z = z.reshape(len(x), CHUNK // HOP, 2 * FILTERS)
        z = z[:, :-1, :FILTERS] + z[:, 1:, FILTERS:]
        z[np.arange(CHUNK // HOP - 1) * HOP >= size[:, None]] = -1e9
        if where:
            at = z.argmax(1)
            return np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + p["b"], 0), at
        return np.maximum(z.max(1) + p["b"], 0), None

    def head(self, pooled: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = np.concatenate((pooled, (size / CHUNK)[:, None].astype(np.float32)), 1)
        hidden = np.maximum(full @ self.p["u"] + self.p["c"], 0)
        return full, hidden, hidden @ self.p["v"] + self.p["d"][0]

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        start, size, row = chunks(data, offsets)
        out = np.full(len(offsets) - 1, -np.inf)
        for i in range(0, len(start), BLOCK):
            s = size[i : i + BLOCK]
            z = self.head(self.pooled(cut(data, start[i : i + BLOCK], s), s)[0], s)[2]
            np.maximum.at(out, row[i : i + BLOCK], z)
        return out

    def gradients(self, x: np.ndarray, size: np.ndarray, row: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; ``row`` is sorted, ``y`` is 1 for low quality.  Only each document's top chunk learns."""
        p = self.p
        pooled, at = self.pooled(x, size, True)
        full, hidden, z = self.head(pooled, size)
        order = np.lexsort((z, row))
        top = order[np.append(row[order][1:] != row[order][:-1], True)]
        x, at, full, hidden, z, pooled = x[top], at[top], full[top], hidden[top], z[top], pooled[top]
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
        out = {"v": hidden.T @ g, "d": np.array([g.sum()])}
        gh = g[:, None] * p["v"] * (hidden > 0)
        out |= {"u": full.T @ gh, "c": gh.sum(0)}
        gp = (gh @ p["u"].T)[:, :FILTERS] * (pooled > 0)
        out["b"] = gp.sum(0)
        seen = x[np.arange(len(x))[:, None, None], at[:, :, None] * HOP + np.arange(2 * HOP)]  # chunk, filter, byte
        felt = p["e"][seen].reshape(len(x), FILTERS, 2 * HOP * EMBED)
        gw = np.einsum("nf,nfk->kf", gp, felt)
        out["w"] = np.concatenate((gw[: HOP * EMBED], gw[HOP * EMBED :]), 1)
        wide = np.concatenate((p["w"][:, :FILTERS], p["w"][:, FILTERS:])).T.reshape(FILTERS, 2 * HOP, EMBED)
        ge = np.zeros_like(p["e"])
        np.add.at(ge, seen, gp[:, :, None, None] * wide)
        out["e"] = ge
        return out

    def scorer(self) -> Callable[[pa.Array], list]:
        def judge(texts: pa.Array) -> list:
            z = self.logits(*raw(texts)).astype(np.float64)
            return [pa.array(np.round(1 / (1 + np.exp(np.clip(z, -30, 30))), 6), pa.float64())]

        return judge


def batches(n: int, r: np.random.Generator) -> Iterator[np.ndarray]:
    order = r.permutation(n)
    for i in range(0, n, BATCH):
        yield order[i : i + BATCH]


def fit(sample: list[tuple[str, int]]) -> ByteNet:
    """Adam over documents."""
    net = ByteNet()
    y = np.array([1 - v for _, v in sample], np.float32)
    if len(set(y.tolist())) < 2:
        net.p["v"][:] = 0
        return net
    r = np.random.default_rng(SEED)
    data, offsets = raw(pa.array([t for t, _ in sample]))
    start, size, row = chunks(data, offsets)
    first = np.searchsorted(row, np.arange(len(sample) + 1))
    m, s, k = ({n: np.zeros_like(v) for n, v in net.p.items()} for _ in range(2)), None, 0
    m, s = m
    total = EPOCHS * -(-len(sample) // BATCH)
    for _ in range(EPOCHS):
        for docs in batches(len(sample), r):
            docs = np.sort(docs)
            own = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            g = net.gradients(cut(data, start[own], size[own]), size[own], row[own], y[docs])
            k += 1
            rate = RATE * (1 - k / (total + 1))
            for n, v in g.items():
                m[n] = 0.9 * m[n] + 0.1 * v
                s[n] = 0.99 * s[n] + 0.01 * v * v
                net.p[n] -= (rate * (m[n] / (1 - 0.9**k)) / (np.sqrt(s[n] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = HELD) -> ByteNet:
    sample = labelled_sample(docs, labels, "quality", *held, PER_CLASS, SAMPLE_BYTES)
    net = fit(sample)
    del sample
    trim()
    return net


def quality_scores(docs: DataFrame, net: ByteNet, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` plus ``score``, the probability of high quality, and ``predicted``.

    Null counts as empty, which is one chunk without bytes.  Without labels of both
    kinds every score is the same.  Rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    out = annotate(docs, text, FIELDS, lambda: shared.value.scorer(), keep_text)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, read(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD[0])) == HELD[1]
    return quality_scores(docs, net).select("doc_id", held.alias("held_out"), "score", "predicted")
