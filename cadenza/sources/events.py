"""Musical event files (Standard MIDI): read into rows of events, written from them, and what is noted in them.

Files are read as bytes by Spark, so any store that Spark reads will do, and each is decoded in the task that has
read it.  Files are written by a data source of its own: a task writes whole files to a temporary folder of the
job, and only the commit moves them into place.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

EVENT = "track int, seq int, delta long, tick long, type string, channel int, control int, value int, text string, data binary"
FILE = f"path string, beat int, {EVENT}, error string"
#: Fixed values of the format: channel messages by the high half of their status byte, and the kinds of notes between them.
MESSAGES = {0x8: "note_off", 0x9: "note_on", 0xA: "polytouch", 0xB: "control_change", 0xC: "program_change", 0xD: "aftertouch", 0xE: "pitchwheel"}
TEXTS = {0x01: "text", 0x02: "copyright", 0x03: "track_name", 0x04: "instrument_name", 0x05: "lyrics", 0x06: "marker", 0x07: "cue_marker"}
TEMPO, END, SYSEX, ESCAPE, META = 0x51, 0x2F, 0xF0, 0xF7, 0xFF
ONE_BYTE = ("program_change", "aftertouch")
DEFAULT_TEMPO = 500_000


class Damaged(ValueError):
    """A file that does not keep to the format."""


def take_number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, the last byte without its top bit, and where it ends."""
    n = 0
    for k in range(4):
        if at + k >= len(data):
            raise Damaged("a number is cut off")
        n = n << 7 | data[at + k] & 0x7F
        if not data[at + k] & 0x80:
            return n, at + k + 1
    raise Damaged("a number of more than four bytes")


def put_number(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def events_of(data: bytes, track: int) -> Iterator[tuple]:
    """The events of a track in the order of :data:`EVENT`; a status byte that is left out is that of the message before."""
    at = tick = seq = 0
    status = None
    while at < len(data):
        delta, at = take_number(data, at)
        tick += delta
        if at >= len(data):
            raise Damaged("an event is cut off")
        if data[at] & 0x80:
            status, at = data[at], at + 1
        elif status is None or status >= SYSEX:
            raise Damaged("data without a status")
        kind = channel = control = value = text = raw = None
        if status >= SYSEX:
            if status not in (SYSEX, ESCAPE, META):
                raise Damaged(f"unknown status {status:#x}")
            if status == META:
                meta, at = data[at] if at < len(data) else -1, at + 1
            size, at = take_number(data, at)
            raw, at = data[at : at + size], at + size
            if len(raw) < size:
                raise Damaged("an event is cut off")
            if status != META:
                kind = "sysex" if status == SYSEX else "escape"
            elif meta in TEXTS:
                kind, text, raw = TEXTS[meta], raw.decode("latin-1"), None
            elif meta == TEMPO and size == 3:
                kind, value, raw = "set_tempo", int.from_bytes(raw, "big"), None
            elif meta == END:
                kind, raw = "end_of_track", None
            else:
                kind, control = "meta", meta
            status = None
        else:
            kind, channel = MESSAGES[status >> 4], status & 0x0F
            need = 1 if kind in ONE_BYTE else 2
            body, at = data[at : at + need], at + need
            if len(body) < need or any(b & 0x80 for b in body):
                raise Damaged("a message is cut off")
            if kind == "pitchwheel":
                value = (body[1] << 7 | body[0]) - 8192
            elif need == 1:
                value = body[0]
            else:
                control, value = body
        yield track, seq, delta, tick, kind, channel, control, value, text, raw
        seq += 1
        if kind == "end_of_track":
            return


def decoded(data: bytes) -> tuple[int, list[tuple]]:
    """Ticks a beat and the events of a file."""
    if len(data) < 14 or data[:4] != b"MThd":
        raise Damaged("no header")
    size, _, count, beat = struct.unpack(">IHHH", data[4:14])
    if beat & 0x8000 or not beat:
        raise Damaged("time is not in ticks a beat")
    at, out, track = 8 + size, [], 0
    while track < count:
        if at + 8 > len(data):
            raise Damaged("a track is missing")
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "big")
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        if name == b"MTrk":
            if len(body) < size:
                raise Damaged("a track is cut off")
            out += events_of(body, track)
            track += 1
    return beat, out


def encoded(event: Row) -> bytes:
    """An event behind its delta; every message with its status byte."""
    kind, head = event.type, put_number(max(0, event.delta or 0))
    named = {v: k for k, v in MESSAGES.items()}
    if kind in named:
        status = bytes([named[kind] << 4 | (event.channel or 0)])
        if kind == "pitchwheel":
            n = event.value + 8192
            return head + status + bytes([n & 0x7F, n >> 7])
        return head + status + bytes([event.value] if kind in ONE_BYTE else [event.control, event.value])
    if kind in ("sysex", "escape"):
        raw = bytes(event.data or b"")
        return head + bytes([SYSEX if kind == "sysex" else ESCAPE]) + put_number(len(raw)) + raw
    texts = {v: k for k, v in TEXTS.items()}
    if kind in texts:
        meta, raw = texts[kind], (event.text or "").encode("latin-1", "replace")
    elif kind == "set_tempo":
        meta, raw = TEMPO, event.value.to_bytes(3, "big")
    elif kind == "meta":
        meta, raw = event.control, bytes(event.data or b"")
    else:
        raise Damaged(f"unknown event {kind}")
    return head + bytes([META, meta]) + put_number(len(raw)) + raw


def file_of(events: list[Row], beat: int) -> bytes:
    """A file of all tracks from 0 to the last that has an event; every track gets its end."""
    tracks: list[list[bytes]] = [[] for _ in range(max((e.track for e in events), default=0) + 1)]
    for e in events:
        if e.type != "end_of_track":
            tracks[e.track].append(encoded(e))
    bodies = [b"".join(t) + b"\0" + bytes([META, END, 0]) for t in tracks]
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(bodies), beat) + b"".join(b"MTrk" + struct.pack(">I", len(b)) + b for b in bodies)


def read_events(spark: SparkSession, path: str, pattern: str = "*.mid") -> DataFrame:
    """The events of all files below a folder, :data:`FILE`; a damaged file is one row with ``error`` and without events.  Spark skips empty files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    beat, events = decoded(content.as_py() or b"")
                    rows = [(name, beat, *e, None) for e in events]
                except Damaged as e:
                    rows = [(name, *[None] * 11, str(e))]
                for a in range(0, len(rows), 10_000):
                    columns = zip(*rows[a : a + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names = [c.split()[0] for c in FILE.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in FILE.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, FILE)


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class EventWriter(DataSourceWriter):
    """Writes files to a folder of the job's own; the commit moves what tasks have reported, an abort deletes the folder."""

    def __init__(self, path: str, beat: int) -> None:
        self.path, self.beat = path, beat
        self.work = posixpath.join(path, f"_temporary-{uuid.uuid4().hex}")

    def write(self, rows: Iterator[Row]) -> Written:
        store, base = fs.FileSystem.from_uri(self.work) if "://" in self.work else (fs.LocalFileSystem(), self.work)
        folder, out, name, held = posixpath.join(base, uuid.uuid4().hex), [], None, []
        store.create_dir(folder)

        def flush() -> None:
            if held:
                target = posixpath.join(folder, f"{len(out)}.mid")
                with store.open_output_stream(target) as f:
                    f.write(file_of(held, self.beat))
                out.append((target, name))

        for row in rows:
            if row.file != name:
                flush()
                name, held = row.file, []
            held.append(row)
        flush()
        return Written(out)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        for message in messages:
            for source, name in message.names if message else []:
                store.move(source, posixpath.join(base, name))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.work) if "://" in self.work else (fs.LocalFileSystem(), self.work)
        if store.get_file_info(base).type != fs.FileType.NotFound:
            store.delete_dir(base)


class EventFiles(DataSource):
    """``df.write.format("event_files")``: rows (file, track, seq, ...), whole files a task."""

    @classmethod
    def name(cls) -> str:
        return "event_files"

    def schema(self) -> str:
        return f"file string, {EVENT}"

    def writer(self, schema, overwrite) -> EventWriter:  # noqa: ANN001
        return EventWriter(self.options["path"], int(self.options.get("beat", "480")))


def write_events(events: DataFrame, path: str, file: Column, beat: int = 480) -> None:
    """One file a name: tracks in order, events by ``seq``; names with characters of a path are refused.

    ``path`` has to be a folder that all executors share.  If a task fails for good, no file of the job appears.
    """
    events.sparkSession.dataSource.register(EventFiles)
    fields = [f.split()[0] for f in EVENT.split(", ")]
    rows = events.select(file.alias("file"), *fields)
    bad = F.when(F.col("file").rlike(r"[/\\]"), F.raise_error(F.lit("a file name holds a separator"))).otherwise(F.col("file"))
    rows = rows.withColumn("file", bad.cast("string")).repartition("file").sortWithinPartitions("file", "track", "seq")
    rows.write.format("event_files").option("beat", str(beat)).mode("append").save(path)


def event_deltas(events: DataFrame, keys: list[str], order: list[str], tick: str = "tick", least: int = 0) -> DataFrame:
    """``events`` plus ``delta``: ticks since the event before of its keys, at least ``least`` each (the first counts from 0)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("delta", F.greatest(F.lit(least), F.col(tick) - F.coalesce(F.lag(tick).over(w), F.lit(0))).cast("long"))


def noted(events: DataFrame) -> DataFrame:
    """``path, kind, seconds, value, label``: beats, strengths, pulses, loudness, chords, numerals and regions noted in event files.

    Seconds are ticks at the tempo that track 0 has at that place, in other tracks at its last one.  A chord
    or numeral is the first text of its kind after its marker.  Loudness levels for a whole file have no seconds.
    """
    e = events.where("error is null")
    before = Window.partitionBy("path", "track").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tempos = e.where("track = 0 and type = 'set_tempo'").groupBy("path").agg(F.max_by("value", "seq").alias("last_tempo"))
    timed = e.join(tempos, "path", "left").withColumn("own", F.last(F.when(F.col("type") == "set_tempo", F.col("value")), ignorenulls=True).over(before))
    pace = F.when(F.col("track") == 0, F.coalesce("own", F.lit(DEFAULT_TEMPO))).otherwise(F.coalesce("last_tempo", F.lit(DEFAULT_TEMPO)))
    timed = timed.withColumn("seconds", F.col("tick") / F.col("beat") * (pace / 1e6))
    is_ = lambda track, control, channel=None: (F.col("track") == track) & (F.col("type") == "control_change") & (F.col("control") == control) & (F.lit(True) if channel is None else F.col("channel") == channel)
    simple = (
        F.when((F.col("track") == 0) & (F.col("type") == "marker") & (F.col("text") == "Beat"), "beat").when(is_(0, 21), "strength").when(is_(0, 22), "pulse")
        .when(is_(1, 20, 14), "loudness").when(is_(1, 20, 13), "level_pyloudnorm").when(is_(1, 20, 12), "level_rsgain")
    )
    whole = F.col("kind").startswith("level_")
    plain = timed.withColumn("kind", simple).where("kind is not null").select(
        "path", "kind", F.when(~whole, F.col("seconds")).alias("seconds"), F.when(whole, -F.col("value")).otherwise(F.col("value")).cast("double").alias("value"), F.lit(None).cast("string").alias("label")
    )
    marker = F.when(is_(2, 29, 14), "chord").when(is_(2, 30, 14), "numeral")
    said = F.when((F.col("type") == "text") & F.col("text").startswith("Chord:"), "chord").when((F.col("type") == "text") & F.col("text").startswith("Roman:"), "numeral")
    named = timed.where("track = 2").withColumn("marker", marker).withColumn("said", said)
    named = named.withColumn("context", F.last("marker", ignorenulls=True).over(before)).withColumn("turn", F.count("marker").over(before)).where(F.col("said") == F.col("context"))
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("path", "turn").orderBy("seq"))).where("n = 1")
    labels = first.select("path", F.col("context").alias("kind"), "seconds", F.lit(None).cast("double").alias("value"), F.trim(F.regexp_replace("text", "Chord:|Roman:", "")).alias("label"))
    regions = None
    for word in ("Speech", "Applause"):
        ends = timed.where((F.col("track") == 3) & (F.col("type") == "text") & F.col("text").isin(f"{word} Start", f"{word} End"))
        ends = ends.withColumn("before", F.lag("text").over(Window.partitionBy("path").orderBy("seq"))).withColumn("start", F.lag("seconds").over(Window.partitionBy("path").orderBy("seq")))
        pairs = ends.where((F.col("text") == f"{word} End") & (F.col("before") == f"{word} Start"))
        pairs = pairs.select("path", F.lit(word.lower()).alias("kind"), F.col("start").alias("seconds"), (F.col("seconds") - F.col("start")).alias("value"), F.lit(None).cast("string").alias("label"))
        regions = pairs if regions is None else regions.unionByName(pairs)
    return plain.unionByName(labels).unionByName(regions)
