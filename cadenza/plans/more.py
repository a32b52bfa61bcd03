"""Queries of stored tables, event files, order statistics, nested documents and spectra, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import catalogue, documents, matching, mel, ranks, sinks
from cadenza.operators.shared import shared_folder
from cadenza.plans.queries import query, read
from cadenza.sources import events
from cadenza.sources.table import Table


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/cadenza/{name}-{uuid.uuid4().hex}"


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS p_size
FROM part WHERE p_size % 7 <> 0 UNION ALL SELECT -p_partkey, 'new', p_size FROM part WHERE p_size % 4 = 1""")
def q_stored_table(spark, sf_dir):
    """A stored table filled, changed and cut in three versions, read back."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    table = Table(spark, scratch(spark, "table"), ["p_partkey"])
    table.create(p.schema, 16)
    table.upsert(p)
    changed = p.where("p_size % 4 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), F.lit(0).cast(p.schema["p_size"].dataType).alias("p_size"))
    added = p.where("p_size % 4 = 1").select((-F.col("p_partkey")).alias("p_partkey"), F.lit("new").alias("p_name"), "p_size")
    table.upsert(changed.unionByName(added))
    table.delete(p.where("p_size % 7 = 0"))
    return table.read()


TICKS = "(epoch_us(ts::TIMESTAMP) // 1000000 - 1704067200)::BIGINT"


@query(f"""WITH e AS (SELECT user_id, event_id, {TICKS} AS tick, CASE WHEN event_type = 'click' THEN 21 ELSE 22 END AS control, least(127, floor(abs(value)))::INT AS v FROM events),
d AS (SELECT *, greatest(0, tick - coalesce(lag(tick) OVER (PARTITION BY user_id ORDER BY tick, event_id), 0)) AS delta FROM e)
SELECT 'u' || user_id || '.mid' AS file, count(*) AS n, sum(delta)::BIGINT AS ticks, sum(v)::BIGINT AS total, count(*) FILTER (control = 21) AS clicks FROM d GROUP BY 1""")
def q_event_files(spark, sf_dir):
    """A file of events a user, written and read back."""
    e = read(spark, sf_dir, "events").withColumn("tick", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long") - 1704067200)
    order = ["tick", "event_id"]
    none = lambda t: F.lit(None).cast(t)
    timed = events.event_deltas(e, ["user_id"], order).withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - 1)
    rows = timed.select(
        "user_id", F.lit(0).alias("track"), "seq", "delta", "tick", F.lit("control_change").alias("type"), F.lit(14).alias("channel"), F.when(F.col("event_type") == "click", 21).otherwise(22).alias("control"),
        F.least(F.lit(127), F.floor(F.abs("value"))).cast("int").alias("value"), none("string").alias("text"), none("binary").alias("data"),
    )
    path = scratch(spark, "events")
    events.write_events(rows, path, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".mid")))
    back = events.read_events(spark, path).where("type = 'control_change'")
    return back.groupBy(F.regexp_extract("path", "([^/]*)$", 1).alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum("delta").alias("ticks"), F.sum("value").alias("total"), F.count_if(F.col("control") == 21).alias("clicks"))


@query("""WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT x::DOUBLE AS share, v AS value FROM (VALUES (0.0), (0.1), (0.5), (0.9), (0.99), (1.0)) s(x), r WHERE i = floor(x * (n - 1))""")
def q_order_statistics(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_extendedprice")
    n, shares = rows.count(), (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)
    found = ranks.order_statistics(rows, "l_extendedprice", [int(s * (n - 1)) for s in shares]) if n else []
    return spark.createDataFrame(list(zip(shares, found, strict=False)), "share double, value double")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, sum(l_quantity) OVER w AS total, row_number() OVER w AS seq FROM lineitem
WINDOW w AS (ORDER BY l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING)""")
def q_running_total(spark, sf_dir):
    """Totals in an order whose first column has three values, each range a few thousand rows."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    done = ranks.running_total(rows, ["l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], "l_quantity", rows=5000)
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "total", "seq")


@query("""SELECT p_partkey AS id, 'brand/name' AS path, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'brand/sizes/0', p_size::VARCHAR FROM part
UNION ALL SELECT p_partkey, 'brand/sizes/1/a~1b', p_type FROM part UNION ALL SELECT p_partkey, 'title', p_name FROM part""")
def q_nested_tags(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    wrapped = F.concat(F.lit("b'"), F.col("p_name"), F.lit("'"))
    said = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.lit('{"brand": {"name": '), said(F.col("p_brand")), F.lit(', "sizes": ['), size, F.lit(', {"a/b": '), said(F.col("p_type")), F.lit(', "COVR": [1]}], "covr": "x"}, "title": '), said(wrapped), F.lit("}"),
    )
    return documents.leaves(p.select("p_partkey", text.alias("doc")), "p_partkey", "doc")


@query()
def q_mel_snippets(spark, sf_dir):
    """Spectra of the values of each user's events as a signal."""
    e = read(spark, sf_dir, "events").withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    found = mel.mel_snippets(e, "user_id", "at", "value", rate=64, seconds=2.0, size=32, hop=8, bands=6)
    return found.select("track", "snippet", F.posexplode("vector").alias("band", "power")).withColumn("power", F.round("power", 6))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, k // 31 AS slice, k % 31 AS slice_at FROM e WHERE k // 31 < greatest(1, n // 31)""")
def q_slices(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1)
    return mel.slices(e.select("user_id", "event_id", "at"), "user_id", "at", columns=4, hop=8).select("user_id", "event_id", "slice", "slice_at")


@query()
def q_file_ids(spark, sf_dir):
    """File names that hold an id, are one, are nearly one, or mean none."""
    p = read(spark, sf_dir, "part").withColumn("id", F.concat_ws("-", "p_name", F.lpad(F.col("p_partkey").cast("string"), 6, "0")))
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("x ["), F.lpad(F.hex("p_partkey"), 8, "0"), F.lit("]"))).when(k == 1, F.upper("id")).when(k == 2, F.concat(F.col("id"), F.lit("!"))).otherwise("p_type")
    files = p.select(F.concat(F.lit("/music/a.b/"), name, F.lit(".m4a")).alias("path"))
    return matching.file_ids(files, p.where("p_size % 2 = 0").select(F.col("id").alias("track_id")))


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 2 = 0 AS known, p_size % 3 = 0 AS whole, upper(p_name) AS t, p_name AS n FROM part)
SELECT k, 'title' AS key, CASE WHEN known THEN t ELSE n END AS value, 'file' AS rule FROM p
UNION ALL SELECT k, 'Acoustid Id', 'file', 'file' FROM p
UNION ALL SELECT k, 'genre', CASE WHEN known THEN '["house"]' ELSE 'old' END, 'file' FROM p
UNION ALL SELECT k, 'metadata_rev', CASE WHEN known THEN '"ABC"' ELSE '"AAA"' END, 'file' FROM p
UNION ALL SELECT k, 'genres', '["house","dub"]', 'file' FROM p WHERE known
UNION ALL SELECT k, 'ids', '3', 'file' FROM p WHERE known AND whole
UNION ALL SELECT k, 'ids', '2', 'file' FROM p WHERE known AND NOT whole
UNION ALL SELECT k, 'title', n, 'ids' FROM p UNION ALL SELECT k, 'Acoustid Id', 'file', 'ids' FROM p UNION ALL SELECT k, 'writer', 'w', 'ids' FROM p
UNION ALL SELECT k, 'genre', 'old', 'ids' FROM p
UNION ALL SELECT k, 'genres', '["house","dub"]', 'ids' FROM p WHERE known AND whole UNION ALL SELECT k, 'ids', '3', 'ids' FROM p WHERE known AND whole""")
def q_overlays(spark, sf_dir):
    """What a file's tags become by either rule; the ids are told as their number.

    Files are dealt by key before their tags are exploded, so a task has some tens of thousands of files however small the table's own files are.
    """
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    p = p.repartition(-(-p.count() // 25_000) or 1, "p_partkey")
    short = {catalogue.GENRE: "genre", catalogue.WRITER: "writer", catalogue.REVISION: "metadata_rev", catalogue.FILE_KEYS[1]: "Acoustid Id"}
    file = F.create_map(*[x for k, v in (("title", F.col("p_name")), (catalogue.GENRE, F.lit("old")), (catalogue.WRITER, F.lit("w")), (catalogue.FILE_KEYS[1], F.lit("file"))) for x in (F.lit(k), v)])
    ids = [x for i, k in enumerate(catalogue.ID_KEYS) for x in (F.lit(k), F.when((F.col("p_size") % 3 == 0) | F.lit(i < 2), F.lit("i")).otherwise(F.lit("N/A")))]
    all_ = F.create_map(F.lit("title"), F.upper("p_name"), F.lit("genres"), F.lit('["house","dub"]'), F.lit(catalogue.FILE_KEYS[1]), F.lit("known"), F.lit(catalogue.REVISION), F.lit('"ABC"'), *ids)
    known = F.when(F.col("p_size") % 2 == 0, all_).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))
    out = None
    for rule, tags in (("file", catalogue.file_overlay(file, known, "genres")), ("ids", catalogue.id_overlay(file, known, ["genres"]))):
        each = p.select(F.col("p_partkey").alias("k"), F.explode(tags).alias("key", "value")).where("value <> 'N/A'")
        each = each.withColumn("key", F.coalesce(F.create_map(*[F.lit(x) for kv in short.items() for x in kv])[F.col("key")], F.when(F.col("key").isin(catalogue.ID_KEYS), "ids").otherwise(F.col("key"))))
        told = each.groupBy("k", "key").agg(F.when(F.col("key") == "ids", F.count(F.lit(1)).cast("string")).otherwise(F.max("value")).alias("value")).withColumn("rule", F.lit(rule))
        out = told if out is None else out.unionByName(told)
    return out


@query("""SELECT n.name, row_number() OVER (ORDER BY lower(n.name), n.name, n.k) AS pos FROM (SELECT n_name AS name, n_nationkey AS k FROM nation UNION ALL SELECT r_name, 100 + r_regionkey FROM region) n""")
def q_playlists_by_title(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("k"))
    both = n.unionByName(read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 100).cast("long").alias("k")))
    ordered = sinks.by_title(both, "name", "k").withColumn("at", F.monotonically_increasing_id())
    return ranks.running_total(ordered.select("name", "k", "at"), "at", "at").select("name", F.col("seq").alias("pos"))


@query("""WITH d AS (SELECT count(*) AS old FROM part WHERE p_size % 2 = 0), n AS (SELECT count(*) AS new FROM part WHERE p_size % 2 = 1)
SELECT old + new AS tracks, lpad((old + new)::VARCHAR, 9, '0') || '.AA' AS revision FROM d, n""")
def q_import_revision(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("K"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("track_id"), "p_name", "p_size")
    have, new = p.where("p_size % 2 = 0"), p.where("p_size % 2 = 1")
    return catalogue.import_run(have, new, ["p_name"], (0, "AB"))[2]
