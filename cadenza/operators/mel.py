"""Mel spectra of snippets, and slices for an encoder, from samples as rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples of audio that one vectorised step frames.
STEP = 1 << 18


def mel_of(hertz: np.ndarray) -> np.ndarray:
    """Slaney's scale: linear to 1000 Hz, logarithmic above."""
    hertz = np.asarray(hertz, float)
    return np.where(hertz < 1000, hertz * 3 / 200, 15 + np.log(np.maximum(hertz, 1e-9) / 1000) * 27 / np.log(6.4))


def hertz_of(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@cache
def filters(rate: int, size: int, bands: int) -> np.ndarray:
    """Triangles between equally spaced mels from 0 to half the rate, each of unit area: (bands, size // 2 + 1)."""
    at = np.linspace(0, rate / 2, size // 2 + 1)
    edges = hertz_of(np.linspace(mel_of(0.0), mel_of(rate / 2), bands + 2))
    up = (at - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - at) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mean_spectrum(samples: np.ndarray, rate: int, size: int, hop: int, bands: int) -> np.ndarray:
    """The mean over time of the mel power spectrum, frames centred at multiples of the hop, zeros beyond the ends."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    padded = np.pad(samples, size // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    power = np.zeros(size // 2 + 1)
    for a in range(0, len(frames), max(1, STEP // size)):
        power += (np.abs(np.fft.rfft(frames[a : a + max(1, STEP // size)] * window, axis=1)) ** 2).sum(0)
    return filters(rate, size, bands) @ (power / len(frames))


def mel_snippets(df: DataFrame, track: str, at: str, value: str, rate: int = 22050, seconds: float = 5.0, size: int = 2048, hop: int = 512, bands: int = 40) -> DataFrame:
    """``track, snippet, vector``: mean mel spectra of a track's snippets, the shorter last one kept.

    Samples are rows (track, place from 0, value) in any order, each place once; null values and missing places are silence.  A snippet is framed by itself, so it
    is all that comes together in one row, whatever the length of the track.
    """
    length = int(rate * seconds)
    rows = df.where(F.col(track).isNotNull() & (F.col(at) >= 0)).select(F.col(track).alias("track"), F.floor(F.col(at) / length).cast("long").alias("snippet"), (F.col(at) % length).cast("int").alias("k"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    whole = rows.groupBy("track", "snippet").agg(F.collect_list(F.struct("k", "v")).alias("s"))
    to = T.StructType([df.schema[track], T.StructField("snippet", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    to[0].name = "track"
    to.names[0] = "track"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(2):
                places, values = (row.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                samples = np.zeros(int(places.max()) + 1)
                samples[places] = values
                out.append(mean_spectrum(samples, rate, size, hop, bands).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=to.names)

    return whole.mapInArrow(run, to)


def slices(df: DataFrame, track: str, at: str, columns: int = 216, hop: int = 512) -> DataFrame:
    """``df`` plus ``slice`` and ``slice_at``: what an encoder takes of a track, slices of ``columns * hop - 1`` samples one after another.

    Samples beyond the last whole slice are left out, but a track shorter than one slice has that one, to be padded with silence.
    """
    length = columns * hop - 1
    sizes = df.groupBy(F.col(track).alias("__t")).agg((F.max(at) + 1).cast("long").alias("__n"))
    rows = df.join(sizes, F.col(track) == F.col("__t")).withColumn("slice", F.floor(F.col(at) / length).cast("long")).withColumn("slice_at", (F.col(at) % length).cast("long"))
    return rows.where(F.col("slice") < F.greatest(F.lit(1), F.floor(F.col("__n") / length))).drop("__t", "__n")
