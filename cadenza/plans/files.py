"""Queries that write files of the standard tables and read them back by the sources, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import genres, text
from cadenza.operators import catalogue, matching, sinks
from cadenza.plans.more import scratch
from cadenza.plans.queries import query, read
from cadenza.sources import files


def customer_lists(spark, sf_dir):
    """A playlist of customers a nation, in a folder."""
    c = read(spark, sf_dir, "customer").withColumn("path", F.concat_ws("/", F.lit("/music"), "c_mktsegment", "c_name")).withColumn("s", F.floor(F.abs("c_acctbal")).cast("int"))
    path = scratch(spark, "playlists")
    sinks.write_playlists(sinks.playlist_lines(c, "c_nationkey", ["c_custkey"], "s", "c_name", "path"), path, "c_nationkey")
    return path


def nation_of(file):
    return F.regexp_extract(file, r"c_nationkey=(\d+)", 1).cast("int").alias("nation")


@query("""SELECT c_nationkey::INT AS nation, floor(abs(c_acctbal))::INT AS seconds, trim(c_name) AS name, '/music/' || c_mktsegment || '/' || c_name AS path, 2 * row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS line_no FROM customer""")
def q_playlist_files(spark, sf_dir):
    rows = files.playlist_entries(files.lines(spark, customer_lists(spark, sf_dir)))
    return rows.select(nation_of(F.col("file")), "seconds", "name", "path", F.col("line_no").cast("long").alias("line_no"))


@query("""SELECT c_nationkey::INT AS nation, '/music/' || c_mktsegment || '/' || c_name AS path FROM customer""")
def q_playlist_paths(spark, sf_dir):
    return files.playlist_paths(files.lines(spark, customer_lists(spark, sf_dir))).select(nation_of(F.col("file")), F.trim("line").alias("path"))


@query("SELECT count(DISTINCT c_nationkey) AS files, 0::BIGINT AS others FROM customer")
def q_media_files(spark, sf_dir):
    path = customer_lists(spark, sf_dir)
    return files.media_files(spark, path, "TXT").agg(F.count_if(F.col("length") > 0).alias("files"), F.count_if(~F.lower("path").endswith(".txt")).alias("others"))


@query("""WITH m AS (SELECT lower(p_name) AS f, min('g' || p_partkey) AS guid FROM part WHERE p_size % 2 = 0 GROUP BY 1) SELECT p_partkey, m.guid FROM part LEFT JOIN m ON lower(p_name) = f""")
def q_id_map(spark, sf_dir):
    """Playlist entries and a saved map of files to ids."""
    p = read(spark, sf_dir, "part")
    path = scratch(spark, "id-map")
    sinks.write_json(p.where("p_size % 2 = 0").select(F.upper("p_name").alias("file"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("guid")), path)
    return files.with_ids(p.select("p_partkey", F.col("p_name").alias("path")), files.id_map(spark, path)).select("p_partkey", "guid")


@query("SELECT p_brand AS artist, p_type AS album, p_name AS track, p_size AS rating FROM part")
def q_favourites_json(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), F.col("p_name").alias("track"), F.col("p_size").alias("rating"))
    path = scratch(spark, "favourites")
    sinks.write_json(p, path, ["artist", "album", "track"])
    return files.json_records(spark, path, p.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


@query("""SELECT user_id, event_type, epoch_us(ts::TIMESTAMP) AS at, value FROM events""")
def q_play_log_json(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    path = scratch(spark, "play-log")
    sinks.write_json(e, path)
    return files.json_records(spark, path, "user_id long, event_type string, at long, value double")


@query("SELECT DISTINCT 'K' || p_size AS id, 'csv' AS kind FROM part UNION ALL SELECT DISTINCT p_type, 'json' FROM part")
def q_id_lists(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    one, two = scratch(spark, "ids"), scratch(spark, "ids")
    p.select(F.concat(F.lit(" K"), F.col("p_size").cast("string"), F.lit(" ,"), "p_name").alias("value")).unionByName(spark.createDataFrame([(" ,x",), ("",)], "value string")).write.text(one)
    p.select(F.concat(F.lit(" "), "p_type").alias("track_id")).write.json(two)
    return files.id_list(spark, one).withColumn("kind", F.lit("csv")).unionByName(files.id_list(spark, two, "track_id").withColumn("kind", F.lit("json")))


@query("SELECT p_partkey, p_name AS title, p_type AS parent, NULL::VARCHAR AS duration FROM part")
def q_xml_tracks(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("_ratingKey"), F.col("p_name").alias("_title"), F.col("p_type").alias("_parentTitle"))
    path = scratch(spark, "xml")
    p.write.format("xml").option("rootTag", "MediaContainer").option("rowTag", "Track").save(path)
    back = files.xml_tracks(spark, path)
    return back.select(F.col("ratingKey").cast("long").alias("p_partkey"), "title", F.col("parentTitle").alias("parent"), "duration")


@query("""SELECT p_partkey::INT AS "index", p_brand AS mid, p_name || ', "' || p_type || '"' AS display_name FROM part""")
def q_label_csv(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("index"), F.col("p_brand").alias("mid"), F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("display_name"))
    path = scratch(spark, "labels")
    p.write.option("header", True).option("escape", '"').csv(path)
    return files.labels(spark, path)


@query("SELECT doc_id FROM labels WHERE doc_id IS NOT NULL")
def q_ids(spark, sf_dir):
    return files.ids_of(read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT vec_id AS id, len(embedding)::INT AS n, embedding[1]::DOUBLE AS first FROM embeddings WHERE vec_id % 5 <> 2")
def q_flat_vectors(spark, sf_dir):
    """Vectors saved as one row each, some of them of another shape."""
    v = read(spark, sf_dir, "embeddings")
    nested = F.when(F.col("vec_id") % 5 == 2, F.array("embedding", "embedding")).otherwise(F.array("embedding"))
    return files.flat_vectors(v.select("vec_id", nested.alias("v")), "vec_id", "v").select("id", F.size("embedding").alias("n"), F.col("embedding")[0].cast("double").alias("first"))


@query("SELECT label, (row_number() OVER (ORDER BY count(*) DESC, label))::INT AS ord FROM embeddings GROUP BY label")
def q_saved_order(spark, sf_dir):
    from cadenza.operators.ranks import running_total

    sizes = read(spark, sf_dir, "embeddings").groupBy("label").agg((-F.count(F.lit(1))).alias("n"))
    order = running_total(sizes, ["n", "label"], "n").select("label", F.col("seq").cast("int").alias("ord"))
    path = scratch(spark, "order")
    sinks.save_order(order, path)
    return sinks.load_order(order, path)


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE lower(p_name) END AS title, CASE WHEN p_size % 5 IN (0, 1) THEN NULL ELSE p_type END AS genre FROM part""")
def q_recovered_tags(spark, sf_dir):
    """Tag documents with control characters, lists and values alone, and damaged ones."""
    p = read(spark, sf_dir, "part")
    body = F.concat(F.lit('{"title": "'), F.lit(" \x01"), "p_name", F.lit('\x7f"'), F.when(F.col("p_size") % 5 == 1, "").otherwise(F.concat(F.lit(', "gen": ["'), "p_type", F.lit('", "x"]'))), F.lit("}"))
    tags = catalogue.parse_tags(p.withColumn("tag_data", F.when(F.col("p_size") % 5 == 0, F.lit('{"title": ')).otherwise(body)))
    first = lambda k: catalogue.first_value(F.col("tags"), k)
    return tags.select("p_partkey", text.normalize_tag(first("title")).alias("title"), first("gen").alias("genre"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[\\/:*?"<>|]', '', 'g'), '\s+', ' ', 'g') AS tag, page_id % 7 AS num, CASE WHEN page_id % 2 = 0 THEN page_id % 11 ELSE 0 END AS total,
-(page_id % 13) / 4.0 AS gain, [x FOR x IN [trim(y) FOR y IN string_split(url, '/')] IF x <> ''] AS parts FROM pages WHERE url IS NOT NULL""".replace("-(page_id % 13) / 4.0 AS gain", "(-(page_id % 13) / 4.0)::DOUBLE AS gain").replace("page_id % 7 AS num", "(page_id % 7)::INT AS num").replace("page_id % 11 ELSE 0 END AS total", "(page_id % 11)::INT ELSE 0 END AS total"))
def q_text_rules(spark, sf_dir):
    p = read(spark, sf_dir, "pages").where("url is not null")
    k = F.col("page_id")
    numbers = text.parse_of_total(F.concat((k % 7).cast("string"), F.when(k % 2 == 0, F.concat(F.lit(" / "), (k % 11).cast("string"))).otherwise("/x")))
    gain = text.parse_gain(F.concat(F.lit("gain "), (-(k % 13) / 4.0).cast("string"), F.lit(" dB")))
    return p.select("page_id", text.normalize_tag(F.col("url")).alias("tag"), numbers["num"].alias("num"), numbers["total"].alias("total"), gain.alias("gain"), genres.split_list(F.regexp_replace("url", "/", ",")).alias("parts"))


@query("""SELECT l_orderkey, CASE WHEN l_linenumber < 3 THEN 'Track' ELSE 'Album' END AS section, 'Gain ' || l_linenumber AS name, 1 + round(l_discount * 100) AS value, count(*) AS n FROM lineitem GROUP BY ALL""")
def q_gains(spark, sf_dir):
    """Analysis texts of an order each: sections, names, values with their units."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (1 + F.round(F.col("l_discount") * 100)).alias("v"))
    part = F.when(F.col("l_linenumber") < 3, 0).otherwise(1)
    line = F.concat(F.lit("  Gain "), F.col("l_linenumber").cast("string"), F.lit(" : "), F.col("v").cast("string"), F.lit(" dB"))
    rows = li.select("l_orderkey", (part * 1_000_000 + F.col("l_linenumber")).cast("long").alias("at"), line.alias("line"))
    lines = li.count()
    heads = li.select("l_orderkey", part.alias("p")).repartition(-(-lines // files.LINES) or 1, "l_orderkey").distinct().select("l_orderkey", (F.col("p") * 1_000_000).cast("long").alias("at"), F.when(F.col("p") == 0, "[Track]").otherwise(" [Album] ").alias("line"))
    texts = rows.unionByName(heads).select(F.col("l_orderkey").cast("string").alias("file"), F.col("at").alias("line_no"), "line")
    counts = files.gains(texts, 2 * lines).groupBy("file", "section", "name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("file").cast("long").alias("l_orderkey"), "section", "name", "value", "n")


@query("""WITH f AS (SELECT p_partkey AS k, p_name AS name, row_number() OVER (ORDER BY p_name, p_partkey) AS r FROM part WHERE p_size % 3 = 0 AND p_partkey % 2 = 0)
SELECT 0::BIGINT AS line_no, '#EXTM3U' AS line UNION ALL SELECT 2 * r - 1, '#EXTINF:-1,' || name FROM f UNION ALL SELECT 2 * r, '/music/' || k || '.m4a' FROM f""")
def q_favourites_playlist(spark, sf_dir):
    """Favourite ids joined to their files; those without a file are left out."""
    p = read(spark, sf_dir, "part")
    favourites = p.where("p_size % 3 = 0").select(F.upper(F.concat(F.lit("k"), F.col("p_partkey").cast("string"))).alias("track_id"), F.col("p_name").alias("name"), "p_partkey")
    have = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("/music/"), F.col("p_partkey").cast("string"), F.lit(".m4a")).alias("path"))
    return sinks.favourites_playlist(favourites, have, "name", ["name", "p_partkey"])


@query()
def q_valid_matches(spark, sf_dir):
    """Whether the parts next to each other by key are taken for one."""
    p = read(spark, sf_dir, "part")
    other = p.select((F.col("p_partkey") - 1).alias("k"), F.concat("p_name", F.lit(" x")).alias("t"), F.col("p_brand").alias("b"))
    both = p.join(other, F.col("p_partkey") == F.col("k"))
    return both.select("p_partkey", matching.valid_match(F.upper("p_name"), F.col("t"), F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))).alias("verdict"))
