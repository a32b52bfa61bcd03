"""Vectors out of pickled maps of ids, converted once to a table."""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: All that a file may ask for: arrays and their element types.
ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), *((m, f) for m in ("numpy.core.multiarray", "numpy._core.multiarray") for f in ("_reconstruct", "scalar")), *((m, "_frombuffer") for m in ("numpy.core.numeric", "numpy._core.numeric"))}


class Plain(pickle.Unpickler):
    """Reads plain containers, numbers, texts and numeric arrays; whatever else a file names is refused."""

    def find_class(self, module: str, name: str) -> object:
        if (module, name) not in ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} is not read")
        return super().find_class(module, name)


def numbers(value: object) -> list[float] | None:
    """A flat vector: an array or list of numbers, or one of those in a row by itself; else null."""
    try:
        a = np.asarray(value, dtype=float)
    except (TypeError, ValueError):
        return None
    a = a[0] if a.ndim == 2 and a.shape[0] == 1 else a
    return a.tolist() if a.ndim == 1 and a.size else None


def pickled_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``file, id, part, embedding, error`` of files that each hold a map of ids to a vector, or to a list of vectors (``part`` numbers these from 0).

    Values of another shape are left out.  A file that is damaged, holds no map or asks for more than numbers is one row with ``error``.
    Each file is read in one task and has to fit into it; to be written as Parquet and read from there.
    """
    names, types = ["file", "id", "part", "embedding", "error"], [pa.string(), pa.string(), pa.int32(), pa.list_(pa.float32()), pa.string()]

    def vectors(content: bytes) -> Iterator[tuple]:
        held = Plain(io.BytesIO(content)).load()
        if not isinstance(held, dict):
            raise pickle.UnpicklingError("no map of ids")
        for ident, value in held.items():
            one = numbers(value)
            many = [one] if one is not None else [numbers(v) for v in value] if isinstance(value, list | tuple) else []
            yield from ((str(ident), k, v, None) for k, v in enumerate(many) if v is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = list(vectors(content.as_py() or b""))
                except Exception as e:  # noqa: BLE001  a damaged file can fail in any way
                    rows = [(None, None, None, f"{type(e).__name__}: {e}")]
                for a in range(0, len(rows), 10_000):
                    columns = [[file] * len(rows[a : a + 10_000]), *zip(*rows[a : a + 10_000], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "file string, id string, part int, embedding array<float>, error string")
