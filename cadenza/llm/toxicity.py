"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary and one on windows
of toxic text.  A document is cut into overlapping windows; each is compressed with the
ordinary dictionary alone and with the toxic one before it, and the bytes that the
toxic one saves are its distance.  The largest distances of a document and how many pass
the threshold that few ordinary windows pass, weighed by a calibrated logistic curve,
are its score.

Toxic documents are mostly ordinary words, and the library's trainer takes what is
frequent.  So training goes in rounds: the toxic dictionary is trained anew on those
windows of toxic documents that the last one saved most on, narrowed to where it
did, and the ordinary dictionary gets what was saved on windows of ordinary documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import annotate, labelled_sample, read, trim

#: Bounds of the labelled sample: documents and bytes a class, and distinct windows a class to train dictionaries on.
PER_CLASS, SAMPLE_BYTES, MOST_WINDOWS = 1800, 8 << 20, 150_000
HELD = (5, 0)
WINDOW, STRIDE = 48, 24
#: Bytes of the dictionaries: the ordinary one, what is added to it for what ordinary windows saved, the first toxic one and the later ones.
ORDINARY, ADDED, FIRST, TOXIC = 65536, 8192, 16384, 2048
#: Bytes of a segment that the trainer picks, in the first and in later dictionaries, and of what it counts.
FIRST_SEGMENT, SEGMENT, COUNTED = 8, 12, 6
ROUNDS = 6
#: Bytes that a window is narrowed to, and the steps between candidates.
NARROW, NARROW_STEP = 20, 4
#: Percent of ordinary windows whose distance is not above the threshold.
PERCENT = 99.5
#: Where a window that shows a distance is cut again to confirm it: shifts of its two ends.
SHIFTS = ((-9, -5), (-4, 7), (-15, 15), (3, 4))
TOP = 3
FEATURES = TOP + 5
FIELDS = T.StructType([T.StructField("score", T.DoubleType())])


def windows(text: bytes) -> list[bytes]:
    n = max(1, -(-(len(text) - WINDOW + STRIDE) // STRIDE))
    return [text[i : i + WINDOW] for i in range(0, n * STRIDE, STRIDE)]


def distinct_windows(texts: list[str]) -> list[bytes]:
    """The distinct windows of all texts, so that copies count once, in an order that says nothing of the texts."""
    found = {w for t in texts for w in windows(t.encode()) if w}
    return sorted(found, key=lambda w: (zlib.crc32(w), w))[:MOST_WINDOWS]


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary by the library's trainer; of samples too few or too alike for it, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=COUNTED).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=17, search_log=8, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    held = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def distance(toxic: bytes, ordinary: bytes) -> Callable[[bytes], int]:
    """How many bytes the toxic dictionary saves on a window."""
    # the ordinary dictionary has blanks where the toxic one is: all other offsets agree
    usual, marked = compressor(bytes(len(toxic)) + ordinary), compressor(toxic + ordinary)
    return lambda window: len(usual.compress(window)) - len(marked.compress(window))


def narrowed(window: bytes, saved: Callable[[bytes], int]) -> bytes:
    """The part of a window that the toxic dictionary saves most on."""
    return max((window[i : i + NARROW] for i in range(0, max(1, len(window) - NARROW + 1), NARROW_STEP)), key=saved)


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, float]:
    """The toxic and the ordinary dictionary, and the threshold of a distance."""
    tox, plain = distinct_windows(toxic), distinct_windows(ordinary)
    base, rest = trained(plain[::2], ORDINARY, FIRST_SEGMENT), plain[1::2] or plain
    content, added, usual, threshold = trained(tox, FIRST, FIRST_SEGMENT), b"", [], 1.0
    for k in range(ROUNDS + 1):
        saved = distance(content, added + base)
        own, other = np.array([saved(w) for w in tox]), np.array([saved(w) for w in rest])
        threshold = max(1.0, float(np.percentile(other, PERCENT))) if len(other) else 1.0
        chosen = [narrowed(tox[i], saved) for i in np.flatnonzero(own >= threshold).tolist()]
        if k == ROUNDS or len(chosen) < 8:
            break
        usual += [narrowed(rest[i], saved) for i in np.flatnonzero(other >= max(1.0, threshold - 1)).tolist()]
        added = trained(usual, ADDED, SEGMENT) if len(usual) >= 8 else added
        content = trained(chosen, TOXIC, SEGMENT)
    return content, added + base, threshold


class ToxicityModel:
    """Dictionaries, threshold and calibration; small enough to travel with the task."""

    def __init__(self, toxic: bytes, ordinary: bytes, threshold: float, weights: np.ndarray) -> None:
        self.toxic, self.ordinary, self.threshold, self.weights = toxic, ordinary, threshold, weights

    def measure(self) -> Callable[[str], np.ndarray]:
        saved, threshold = distance(self.toxic, self.ordinary), self.threshold

        def features(text: str) -> np.ndarray:
            b, tops = text.lower().encode(), [0.0] * TOP
            cut = windows(b)
            for k, w in enumerate(cut):
                d = saved(w)
                if d > 0:
                    i = k * STRIDE
                    again = sorted([d, *(saved(b[max(0, i + x) : i + WINDOW + y]) for x, y in SHIFTS)])
                    tops.append(sum(again[1:4]) / 3)
            top = sorted(tops)[-TOP:]
            passed = sum(d >= threshold for d in tops)
            return np.array([1.0, *top, max(0.0, top[-1] - threshold - 1), np.log1p(len(cut)), np.log1p(passed), 10 * passed / len(cut)])

        return features

    def scorer(self) -> Callable[[pa.Array], list]:
        if not self.toxic:
            return lambda texts: [pa.array([0.0] * len(texts), pa.float64())]
        features = self.measure()

        def judge(texts: pa.Array) -> list:
            x = np.array([features(t) for t in texts.to_pylist()])
            return [pa.array(np.round(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))), 9), pa.float64())]

        return judge


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(sample: list[tuple[str, int]], odds: float = 1.0) -> ToxicityModel:
    """Dictionaries from every text but each third, calibration on those.

    ``odds``: ordinary documents to toxic ones in the corpus' labels, against the
    odds in the sample, so that 0.5 is the even point in the corpus.
    """
    parts = [[(t, y) for i, (t, y) in enumerate(s) if (i % 3 == 2) == k] for k in (False, True) for s in [[x for x in sample if x[1] == 1], [x for x in sample if x[1] == 0]]]
    tox, plain, tox_rest, plain_rest = parts
    if not tox or not plain:
        return ToxicityModel(b"", b"", 1.0, np.zeros(FEATURES))
    model = ToxicityModel(*dictionaries([t.lower() for t, _ in tox], [t.lower() for t, _ in plain]), np.zeros(FEATURES))
    if model.toxic:
        features, rest = model.measure(), tox_rest + plain_rest
        x, y = np.array([features(t) for t, _ in rest]).reshape(-1, FEATURES), np.array([float(v) for _, v in rest])
        model.weights = logistic(x, y)
        model.weights[0] -= np.log(odds)
    return model


def train(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = HELD) -> ToxicityModel:
    sample = labelled_sample(docs, labels, "toxic", *held, PER_CLASS, SAMPLE_BYTES)
    count = {r["toxic"]: r["count"] for r in labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(held[0])) != held[1]).groupBy("toxic").count().collect()}
    n = Counter(y for _, y in sample)
    odds = (count.get(0, 1) / max(1, count.get(1, 1))) / (max(1, n[0]) / max(1, n[1]))
    model = fit(sample, max(1.0, odds))
    del sample
    trim()
    return model


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted``.

    Null and empty texts are scored as a text without windows.  Without labels of
    both kinds every score is 0.  Rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = annotate(docs, text, FIELDS, lambda: shared.value.scorer(), keep_text)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD[0])) == HELD[1]
    return toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
