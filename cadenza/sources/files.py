"""Text and database sources."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line``: every playlist file whole (``wholetext``), its lines in order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("l"))
    return whole.select("file", F.posexplode("l").alias("line_no", "line"))


def playlist_paths(text: DataFrame) -> DataFrame:
    """The lines that are neither blank nor comments."""
    return text.where((F.trim("line") != "") & ~F.col("line").startswith("#"))


def playlist_entries(text: DataFrame) -> DataFrame:
    """``file, line_no, seconds, name, path`` of every ``#EXTINF`` line that a path follows."""
    w = Window.partitionBy("file").orderBy("line_no")
    led = text.withColumn("path", F.lead("line").over(w))
    head = r"^#EXTINF:(-?\d+)[^,]*,(.*)$"
    kept = led.where(F.col("line").rlike(head) & (F.trim("path") != "") & ~F.col("path").startswith("#"))
    return kept.select("file", "line_no", F.regexp_extract("line", head, 1).try_cast("int").alias("seconds"), F.trim(F.regexp_extract("line", head, 2)).alias("name"), F.trim("path").alias("path"))


def media_files(spark: SparkSession, path: str, *extensions: str) -> DataFrame:
    """``path, length, modificationTime`` of files below a folder with one of the extensions, in any case; hidden files and
    whatever is below a hidden folder are left out.  Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    ends = F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*[e.lower() for e in extensions])
    base = F.regexp_replace(F.lit(path.rstrip("/")), "^file:/*", "/")
    below = F.substr(F.col("path"), F.instr("path", path.rstrip("/").removeprefix("file:").lstrip("/")) + F.length(base) - 1)
    return found.where(ends & ~below.contains("/."))


def json_rows(spark: SparkSession, path: str, schema: str, mode: str = "PERMISSIVE") -> DataFrame:
    """The records of files that hold one array, or one record a line; which it is shows in the first line that is not blank."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    whole = first is not None and not (first[0].strip().startswith("{") and first[0].strip().endswith("}"))
    return spark.read.schema(schema).option("multiLine", whole).option("mode", mode).json(path)


def id_list(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """``id``: a list of ids, from JSON records with that ``column``, or one a line of text (a first comma-separated field);
    trimmed, empty ones left out, each once."""
    if column:
        rows = json_rows(spark, path, f"`{column}` string").select(F.col(f"`{column}`").alias("id"))
    else:
        rows = spark.read.text(path).select(F.split("value", ",")[0].alias("id"))
    return rows.select(F.trim("id").alias("id")).where("id <> ''").distinct()


def xml_tracks(spark: SparkSession, path: str, row: str = "Track", fields: tuple[str, ...] = ("ratingKey", "title", "parentTitle", "grandparentTitle", "duration", "file")) -> DataFrame:
    """The attributes of every ``row`` element of XML files as strings; missing ones are null."""
    schema = ", ".join(f"`_{f}` string" for f in fields)
    rows = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    return rows.select(*[F.col(f"_{f}").alias(f) for f in fields])


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """``file, guid`` of a JSON map of files to ids, or of lines of such records."""
    return json_rows(spark, path, "file string, guid string").where("file is not null").groupBy("file").agg(F.min("guid").alias("guid"))


def with_ids(entries: DataFrame, ids: DataFrame, path: str = "path") -> DataFrame:
    """Playlist entries with the ``guid`` that a map (file, guid) has for their path, in any case; null if it has none."""
    table = ids.select(F.lower("file").alias("__f"), "guid").groupBy("__f").agg(F.min("guid").alias("guid"))
    return entries.join(table, F.lower(path) == F.col("__f"), "left").drop("__f")


def ids_of(tracks: DataFrame, ident: str = "track_id") -> DataFrame:
    """The ids alone: no other column is read."""
    return tracks.where(F.col(ident).isNotNull()).select(ident)


def flat_vectors(df: DataFrame, ident: str, vec: str) -> DataFrame:
    """``id, embedding`` with vectors of one row (an array of one array) flattened; other shapes and empty ones are left out."""
    nested = df.schema[vec].dataType.simpleString().startswith("array<array")
    flat = F.when(F.size(vec) == 1, F.flatten(vec)) if nested else F.col(vec)
    return df.select(F.col(ident).alias("id"), flat.cast("array<float>").alias("embedding")).where(F.size("embedding") > 0)


#: Lines of a task.
LINES = 250_000


def gains(text: DataFrame, lines: int | None = None) -> DataFrame:
    """``file, section, name, value``: ``name: value`` lines of analysis texts (file, line_no, line), under the last ``[section]`` above; numbers without their unit.

    Files are dealt to tasks of a bounded number of ``lines`` (how many there are at most; counted if not known), so a task is no larger for more files.
    """
    text = text.repartition(max(1, -(-(text.count() if lines is None else lines) // LINES)), "file")
    w = Window.partitionBy("file").orderBy("line_no")
    head = F.regexp_extract("line", r"^\s*\[(.+?)\]\s*$", 1)
    marked = text.withColumn("section", F.last(F.when(head != "", head), ignorenulls=True).over(w))
    pair = r"^\s*([^:\[]+?)\s*:\s*(-?\d+(?:\.\d+)?)"
    kept = marked.where(F.col("line").rlike(pair))
    return kept.select("file", "section", F.regexp_extract("line", pair, 1).alias("name"), F.regexp_extract("line", pair, 2).try_cast("double").alias("value"))


def tables(spark: SparkSession, database: str = "default") -> list[tuple[str, list[str]]]:
    """The tables of a database with their columns."""
    found = sorted(t.name for t in spark.catalog.listTables(database))
    return [(t, [c.name for c in spark.catalog.listColumns(t)]) for t in found]


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or lines of records with a fixed schema; damaged files give no rows."""
    return json_rows(spark, path, schema, "DROPMALFORMED")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """A list of labels with a header; quotes inside quoted names are doubled."""
    return spark.read.csv(path, header=True, escape='"', schema="index int, mid string, display_name string")


class Rows(InputPartition):
    """Rows of a table by their row numbers, both included."""

    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], kinds: list[str]) -> None:
        self.path, self.name, self.kinds = options["path"], options["dbtable"].replace('"', '""'), kinds
        self.parts = int(options.get("numpartitions", "8"))

    def open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[Rows]:
        with self.open() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.name}"').fetchone()  # noqa: S608
        if low is None:
            return [Rows(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows):
        with self.open() as db:
            rows = db.execute(f'SELECT * FROM "{self.name}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))  # noqa: S608
            for row in rows:
                yield tuple(typed(v, k) for v, k in zip(row, self.kinds, strict=True))


def typed(value: object, kind: str) -> object:
    """A value as its column's type has it; null where it does not fit."""
    if value is None:
        return None
    try:
        if kind == "binary":
            return value if isinstance(value, bytes) else str(value).encode()
        if kind == "string":
            return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
        return int(value) if kind == "bigint" else float(value)
    except (TypeError, ValueError):
        return None


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", ...).option("dbtable", ...)``: a table of a database file that all executors see.

    Columns have the type they are declared with (whole numbers, numbers, bytes, else strings), and ``numPartitions`` tasks (8)
    read ranges of row numbers.  Tables without row numbers cannot be read.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def columns(self) -> list[tuple[str, str]]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            declared = [(r[1], r[2].upper()) for r in db.execute("SELECT * FROM pragma_table_info(?)", [self.options["dbtable"]])]
        kinds = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
        return [(n, next((k for mark, k in kinds if mark in t), "string")) for n, t in declared]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in self.columns())

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, [k for _, k in self.columns()])
