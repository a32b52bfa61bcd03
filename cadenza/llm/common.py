"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a measured side of a join is broadcast.
BROADCAST_BYTES = 8 << 20

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees (``spark.checkpoint.dir``).

    Only a local session may go without it; then a temporary folder stands in.
    """
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="cadenza-")
    return _local_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, never a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cadenza/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of :func:`stored` tables that nothing will read again."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def rested(spark: SparkSession) -> None:
    """Has the executors collect garbage, after which their JVMs give unused heap back to the system.

    A stage of a pipeline then starts with its own needs, not with the heap that the
    stages before it had to touch beside what Python workers take.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often it is used."""
    return F.transform(F.array(value), body).getItem(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes not to be a column of ``df``, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def small(df: DataFrame, *text: str) -> bool:
    """Whether a measured table stays under :data:`BROADCAST_BYTES` (64 bytes a row plus its strings)."""
    size = F.lit(64)
    for c in text:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of an Arrow batch on its way to a worker.
BATCH_BYTES = 4 << 20
#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 2 << 20


def steps(lengths: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts rows of the given byte lengths into (start, end) runs of about ``limit`` bytes."""
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the offsets of the texts; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)


#: What a worker process keeps from task to task, by operator; only one operator's at a time.
_memories: dict[str, object] = {}


def remembered(name: str, build: Callable[[], object]) -> object:
    """``build()`` once in this process for as long as no other operator runs in it."""
    if name not in _memories:
        _memories.clear()
        _memories[name] = build()
    return _memories[name]


def trim() -> None:
    """Hands memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator], keep: str = "") -> Callable[[Iterator], Iterator]:
    """A worker function that drops other operators' memories before and trims after it ran."""

    def tidied(batches: Iterator) -> Iterator:
        if others := [n for n in _memories if n != keep]:
            for name in others:
                del _memories[name]
            trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes as well, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def annotate(df: DataFrame, text: str, fields: T.StructType, worker: Callable[[], Callable[[pa.Array], list]], keep_text: bool = False, limit: int = STEP_BYTES, memory: str = "") -> DataFrame:
    """``df`` plus the columns ``fields`` that a Python worker derives from each text.

    ``worker()`` is called once a task and gives a function from an Arrow array of
    whole texts to one Arrow array a field.  Batches are cut to about ``limit`` bytes
    of text, so memory stays flat.  ``memory`` names what the worker remembers.  Columns of ``df`` named like a field are replaced.
    """
    kept = [c for c in df.columns if c not in fields.names and (keep_text or c != text)]
    out = T.StructType([df.schema[c] for c in kept] + list(fields))
    names = out.names
    plain = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(fresh(df, "__text")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = worker()
        for batch in batches:
            texts = batch.column(len(kept))
            for a, b in steps(pc.binary_length(texts).to_numpy(zero_copy_only=False), limit):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *judge(texts.slice(a, b - a))], names=names)

    small_batches(df.sparkSession)
    return plain.mapInArrow(tidy(run, memory), out)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int, max_bytes: int) -> list[tuple[str, int]]:
    """A bounded sample of (text, label) for fitting, the same for the same tables.

    At most ``per_class`` documents of either label, the first in the order of the
    CRC of their id, without those whose CRC modulo ``modulus`` is ``held``; of these
    the ones that fit, in that order, into ``max_bytes`` a class.  A text of more than a
    quarter of ``max_bytes`` is not fitted on, so that one text does not take all the room.
    """
    crc = F.crc32(F.col("doc_id").cast("string"))
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    rows = rows.withColumn("c", crc).where(F.pmod("c", F.lit(modulus)) != held)
    ids = [r for y in (0, 1) for r in rows.where(F.col("y") == y).orderBy("c", "doc_id").limit(per_class).collect()]
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r.doc_id, r.y, r.c) for r in ids], "id long, y int, c long")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).where(F.octet_length("text") <= max_bytes // 4)
    texts = texts.select("y", "c", "id", "text").dropDuplicates(["id"])
    ordered = texts.withColumn("n", F.octet_length("text"))
    fits = ordered.withColumn("sum", F.sum("n").over(Window.partitionBy("y").orderBy("c", "id")))
    return [(r.text, r.y) for r in sorted(fits.where(F.col("sum") <= max_bytes).collect(), key=lambda r: (r.c, r.id))]
