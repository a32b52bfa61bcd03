"""More registered queries of the library operators over the standard tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import genres, text
from cadenza.operators import catalogue, clusters, matching, sinks, timeseries
from cadenza.plans import files, more  # noqa: F401  these register the rest
from cadenza.plans.queries import LIKE, query, read, vectors
from cadenza.streaming import playlog

# ---------------------------------------------------------------- ratings, clusters
@query(f"""WITH {LIKE.replace("SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1", "SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1.0 ELSE -1.0 END) AS rating FROM labels GROUP BY 1")
.replace("r AS (SELECT e.id, v FROM e", "r AS (SELECT e.id, v, rating FROM e").replace("WHEN r.id IS NOT NULL THEN 1.0", "WHEN r.id IS NOT NULL THEN rating")} SELECT * FROM score""")
def q_like_rated(spark, sf_dir):
    rating = F.max(F.when(F.col("quality") == 1, 1.0).otherwise(-1.0)).alias("rating")
    v, rated = vectors(spark, sf_dir), read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("r_id")).agg(rating)
    return clusters.like(v, v.join(rated, F.col("id") == F.col("r_id")), "id", "embedding", 0.3, rating="rating")


SIZES = "s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), o AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) AS r FROM s)"
WALK = f"""RECURSIVE {SIZES}, rel AS (SELECT label, (label + 2) % 10 AS other, 1 AS rank FROM s UNION ALL SELECT label, (label + 5) % 10, 2 FROM s),
walk AS (SELECT label, 1 AS cluster_ord, [label] AS seen FROM o WHERE r = 1 UNION ALL
  SELECT n.id, cluster_ord + 1, list_append(seen, n.id) FROM walk w, LATERAL (SELECT coalesce(
    (SELECT arg_min(other, rank) FROM rel WHERE rel.label = w.label AND NOT list_contains(w.seen, other) AND other IN (SELECT label FROM s)),
    (SELECT arg_min(label, r) FROM o WHERE NOT list_contains(w.seen, label))) AS id) n WHERE n.id IS NOT NULL)"""


def label_sizes(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def walked(spark, sf_dir):
    sizes = label_sizes(spark, sf_dir)
    other = F.explode(F.array(*[F.struct(((F.col("label") + k) % 10).alias("other"), F.lit(r).alias("rank")) for r, k in ((1, 2), (2, 5))])).alias("o")
    return clusters.cluster_order(sizes, "label", sizes.select("label", other).select("label", "o.*"))


@query(f"WITH {WALK} SELECT label, cluster_ord FROM walk")
def q_cluster_order(spark, sf_dir):
    return walked(spark, sf_dir)


@query(f"WITH {WALK}, c(label, ord) AS (VALUES (7, 1), (3, 2), (99, 3)) SELECT w.label, row_number() OVER (ORDER BY ord NULLS LAST, cluster_ord)::INT AS cluster_ord FROM walk w LEFT JOIN c ON w.label = c.label")
def q_custom_order(spark, sf_dir):
    return clusters.custom_order(walked(spark, sf_dir), spark.createDataFrame([(7, 1), (3, 2), (99, 3)], "label int, ord int"), "label")


@query("SELECT segment, row_number() OVER (ORDER BY segment = 'BUILDING', segment)::INT AS cluster_ord FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer)")
def q_alphabetical_order(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    return clusters.alphabetical_order(c, "segment", "BUILDING")


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN lower(to_hex(p_size)) WHEN p_size % 2 > 0 THEN p_type ELSE 'unknown' END AS cluster FROM part")
def q_cluster_keys(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    coded = p.withColumn("code", F.when(F.col("p_size") % 3 > 0, F.lower(F.hex(F.col("p_size").cast("long"))))).withColumn("genre", F.when(F.col("p_size") % 2 > 0, F.col("p_type")).otherwise(" "))
    return coded.select("p_partkey", clusters.cluster_keys(coded, "code", "genre").alias("cluster"))


@query("WITH t AS (SELECT DISTINCT p_brand, trim(unnest(string_split(lower(p_type || ', ' || p_name), ','))) AS t FROM part) SELECT p_brand, list_sort(list(t)) AS tokens FROM t WHERE t <> '' GROUP BY 1")
def q_token_sets(spark, sf_dir):
    return clusters.token_sets(read(spark, sf_dir, "part").withColumn("g", F.concat_ws(", ", "p_type", "p_name")), "p_brand", "g")


@query("WITH l AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INT AS pos FROM embeddings) SELECT label, pos, round(avg(x), 6) AS average, round(max(x), 6) AS most FROM l GROUP BY ALL")
def q_pool(spark, sf_dir):
    v = vectors(spark, sf_dir)
    one, two = (clusters.pool(v, "label", "embedding", how) for how in ("average", "max"))
    return one.withColumnRenamed("value", "average").join(two.withColumnRenamed("value", "most"), ["label", "pos"]).select("label", "pos", F.round("average", 6).alias("average"), F.round("most", 6).alias("most"))


@query()
def q_project_2d(spark, sf_dir):
    return clusters.project_2d(vectors(spark, sf_dir), "id", "embedding")


# ---------------------------------------------------------------- genres
NAMES = ("economy", "small", "promo", "large", "ring", "widget")
SYNONYMS = (("medium", "large"), ("gear", "widget"))


def taxonomy(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "name string"), spark.createDataFrame(SYNONYMS, "name string, genre string")


KNOWN = f"""n(name) AS (VALUES {", ".join(f"('{n}')" for n in NAMES)}), y(name, genre) AS (VALUES {", ".join(map(str, SYNONYMS))})"""


@query(f"WITH {KNOWN} SELECT p_partkey, coalesce(n.name, '') AS genre FROM part LEFT JOIN y ON lower(trim(p_type)) = y.name LEFT JOIN n ON coalesce(y.genre, lower(trim(p_type))) = n.name")
def q_normalized_genre(spark, sf_dir):
    return genres.normalized(read(spark, sf_dir, "part"), "p_type", *taxonomy(spark)).select("p_partkey", "genre")


@query(f"""WITH {KNOWN}, s AS (SELECT p_brand, string_split(p_name, ' ')[2] AS g, 0 AS s, p_partkey AS p FROM part UNION ALL SELECT p_brand, p_type, 1, p_partkey FROM part),
v AS (SELECT p_brand, n.name AS genre, s, p FROM s LEFT JOIN y ON lower(trim(g)) = y.name JOIN n ON coalesce(y.genre, lower(trim(g))) = n.name),
c AS (SELECT p_brand, genre, count(*) AS votes, min((s, p)) AS first FROM v GROUP BY ALL)
SELECT p_brand, genre, votes, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY votes DESC, first, genre)::INT AS rank FROM c) WHERE rank <= 5""")
def q_combined_genres(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("pos", F.col("p_partkey"))
    one, two = p.select("p_brand", F.try_element_at(F.split("p_name", " "), F.lit(2)).alias("g"), "pos"), p.select("p_brand", F.col("p_type").alias("g"), "pos")
    return genres.combined_vote([one, two], "p_brand", "g", *taxonomy(spark)).withColumnRenamed("__genre", "genre")


# ---------------------------------------------------------------- catalogue
@query("SELECT p_partkey, 'exact' AS how FROM part WHERE p_name = 'red ring' UNION ALL SELECT p_partkey, 'prefix' FROM part WHERE p_name LIKE 'red%' UNION ALL SELECT p_partkey, 'part' FROM part WHERE p_name LIKE '%ring%'")
def q_lookup_name(spark, sf_dir):
    p, out = read(spark, sf_dir, "part"), None
    for how, value in (("exact", "red ring"), ("prefix", "RED"), ("part", "Ring")):
        one = catalogue.lookup(p, "p_name", value, how).select("p_partkey", F.lit(how).alias("how"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def q_delete(spark, sf_dir):
    gone = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalogue.delete(read(spark, sf_dir, "orders").select("o_orderkey"), gone, "o_orderkey")


@query("SELECT event_id, CASE WHEN value > 90 THEN 'high' ELSE props::JSON ->> 'k' END AS k, CASE WHEN value > 90 THEN event_type END AS state FROM events")
def q_set_fields(spark, sf_dir):
    e = catalogue.parse_tags(read(spark, sf_dir, "events"), "props")
    changes = e.where("value > 90").select("event_id", F.create_map(F.lit("k"), F.lit("high"), F.lit("state"), F.col("event_type")).alias("tags"))
    return catalogue.set_fields(e.select("event_id", "tags"), changes, "event_id", "tags").select("event_id", F.col("tags")["k"].alias("k"), F.col("tags")["state"].alias("state"))


@query("SELECT event_id, ['K'] AS names, [event_type, props::JSON ->> 'k'] AS k FROM events")
def q_aliases(spark, sf_dir):
    e = catalogue.parse_tags(read(spark, sf_dir, "events"), "props")
    both = F.map_concat(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("Covr"), F.lit("b'x'")), F.col("tags"))
    out = catalogue.aliased(catalogue.listed(catalogue.decoded(both)), {"k": "K", "kind": "K"})
    return e.select("event_id", out.alias("t")).select("event_id", F.map_keys("t").alias("names"), F.col("t")["K"].alias("k"))


@query("""WITH o AS (SELECT coalesce(vec_id, doc_id) AS id, vec_id, doc_id FROM embeddings FULL JOIN (SELECT DISTINCT doc_id FROM labels) ON vec_id = doc_id),
k AS (SELECT id, CASE WHEN vec_id IS NOT NULL AND doc_id IS NOT NULL THEN 'both' WHEN vec_id IS NOT NULL THEN 'cat' ELSE 'lib' END AS source FROM o)
SELECT kind, count(*) AS n, sum(id)::BIGINT AS ids FROM k JOIN (VALUES ('cat', 'cat'), ('cat', 'both'), ('lib', 'lib'), ('lib', 'both'), ('mat', 'both'), ('nom', 'lib'), ('noo', 'cat')) w(kind, source) USING (source) GROUP BY 1""")
def q_owned(spark, sf_dir):
    cat = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cat"))
    lib = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("lib")).distinct()
    both = cat.join(lib, F.col("cat") == F.col("lib"), "full_outer").select(F.coalesce("cat", "lib").alias("id"), catalogue.origin(F.col("cat"), F.col("lib")).alias("source"))
    out = None
    for kind in ("cat", "lib", "mat", "nom", "noo"):
        one = catalogue.owned(both, "source", kind).groupBy(F.lit(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT doc_id FROM documents WHERE source || '/' || doc_id IN (SELECT 'web/' || doc_id FROM labels UNION ALL SELECT 'en/' || doc_id FROM labels)
OR lang || '/' || doc_id IN (SELECT 'web/' || doc_id FROM labels UNION ALL SELECT 'en/' || doc_id FROM labels)""")
def q_existing_files(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    files = read(spark, sf_dir, "labels").select(F.explode(F.array(F.concat_ws("/", F.lit("web"), key), F.concat_ws("/", F.lit("en"), key))).alias("path"))
    return catalogue.existing(read(spark, sf_dir, "documents"), F.concat_ws("/", "source", key), F.concat_ws("/", "lang", key), files).select("doc_id")


@query("SELECT doc_id, doc_id + 1 AS target FROM labels WHERE doc_id + 1 NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def q_broken_links(spark, sf_dir):
    links = read(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") + 1).alias("target"))
    return catalogue.broken_links(links, read(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("path")))


@query("""SELECT doc_id AS path, 'untagged' AS state FROM documents WHERE doc_id % 3 = 0 UNION ALL
SELECT doc_id, 'unmatched' FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_unmatched_files(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("track_id"))
    return catalogue.unmatched_files(files, read(spark, sf_dir, "labels").select(F.col("doc_id").alias("track_id")))


@query("""SELECT o_orderkey, (o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)) AS hit FROM orders""")
def q_either(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    big = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalogue.either(read(spark, sf_dir, "orders"), [(["o_custkey"], c), (["o_orderkey"], big)], "hit").select("o_orderkey", "hit")


WANTED = """w AS (SELECT p_partkey AS qid, CASE WHEN p_partkey % 3 > 0 THEN upper(p_brand) END AS artist, CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE '' END AS track, CASE WHEN p_partkey % 2 > 0 THEN p_type END AS album FROM part)"""


def wanted_parts(spark, sf_dir):
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part")
    wanted = p.select(k.alias("qid"), F.when(k % 3 > 0, F.upper("p_brand")).alias("artist"), F.when(k % 5 > 0, F.col("p_name")).otherwise("").alias("track"), F.when(k % 2 > 0, F.col("p_type")).alias("album"))
    return wanted, p.select(k.alias("hid"), *[F.array(c).alias(f"h_{n}") for n, c in (("artist", "p_brand"), ("track", "p_name"), ("album", "p_type"))])


@query(f"""WITH {WANTED} SELECT qid, count(*) AS n, min(p_partkey) AS hid FROM w JOIN part ON (artist IS NULL OR lower(artist) = lower(p_brand)) AND (coalesce(track, '') = '' OR lower(track) = lower(p_name))
AND (album IS NULL OR lower(album) = lower(p_type)) WHERE artist IS NOT NULL OR track <> '' OR album IS NOT NULL GROUP BY 1""")
def q_optional_keys(spark, sf_dir):
    return matching.optional_key_counts(*wanted_parts(spark, sf_dir), ["artist", "track", "album"])


KEYED = "lower(regexp_replace({0}, '\\W+', '', 'g')) || '|' || lower(regexp_replace({1}, '\\W+', '', 'g')) || '|' || lower(regexp_replace({2}, '\\W+', '', 'g'))"


@query(f"""WITH s AS (SELECT p_brand AS artist, p_type AS album, p_name AS track, p_partkey AS id FROM part WHERE p_size = 7),
i AS (SELECT p_brand AS artist, p_type AS album, upper(p_name) AS track, p_partkey AS pos, {KEYED.format("p_brand", "p_type", "p_name")} AS k FROM part WHERE p_size BETWEEN 5 AND 9),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS r FROM i) WHERE r = 1),
c AS (SELECT lower(p_brand) AS a, lower(p_type) AS b, lower(p_name) AS t, min(p_partkey) AS id FROM part WHERE p_size % 2 = 1 GROUP BY ALL),
n AS (SELECT f.*, c.id FROM f LEFT JOIN c ON lower(artist) = a AND lower(album) = b AND lower(track) = t)
SELECT artist, album, track, id AS track_id FROM s UNION ALL
SELECT artist, album, track, id FROM n WHERE k NOT IN (SELECT {KEYED.format("artist", "album", "track")} FROM s) AND (id IS NULL OR id NOT IN (SELECT id FROM s))""")
def q_import_favourites(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), F.col("p_name").alias("track"), F.col("p_partkey").alias("track_id"), "p_size")
    saved = p.where("p_size = 7").drop("p_size")
    incoming = p.where("p_size between 5 and 9").select("artist", "album", F.upper("track").alias("track"), F.col("track_id").alias("pos"))
    have = p.where("p_size % 2 = 1").select(F.array("artist").alias("artists"), F.array("album").alias("albums"), F.array("track").alias("tracks"), "track_id")
    return catalogue.import_favourites(saved, incoming, have)


@query("""SELECT c_name, 'old' AS state FROM customer WHERE c_custkey % 10 > 0 UNION ALL SELECT upper(c_name), 'new' FROM customer WHERE c_custkey % 10 = 0""")
def q_save_favourites(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    old, new = c.select("c_name", F.lit("old").alias("state")), c.where("c_custkey % 10 = 0").select(F.upper("c_name").alias("c_name"), F.lit("new").alias("state"))
    return catalogue.save_favourites(old, new, ["c_name"])


@query("""WITH c AS (SELECT lower(trim(p_name)) AS n, lower(trim(p_brand)) AS b, min(p_partkey) AS id, count(*) AS k FROM part WHERE p_size % 2 = 0 GROUP BY ALL), i AS (SELECT lower(trim(p_name)) AS n, lower(trim(p_brand)) AS b FROM part WHERE p_size % 5 = 0),
d AS (SELECT i.*, c.id FROM i LEFT JOIN c ON i.n = c.n AND i.b = c.b)
SELECT kind, (SELECT count(*) FROM d WHERE id IS NOT NULL) AS duplicates, (SELECT count(*) FROM part WHERE p_size % 2 = 0) + CASE kind WHEN 'new_id' THEN (SELECT count(*) FROM d) ELSE (SELECT count(*) FROM d WHERE id IS NULL) END AS tracks,
0 AS clashes, CASE kind WHEN 'update' THEN (SELECT count(DISTINCT id) FROM d) ELSE 0 END AS changed FROM (VALUES ('new_id'), ('update'), ('keep')) k(kind)""")
def q_import_batch(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    have = p.where("p_size % 2 = 0").select(F.concat(F.lit("K"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("track_id"), "p_name", "p_brand", F.lit("old").alias("state"))
    new = p.where("p_size % 5 = 0").select(F.lit(None).cast("string").alias("track_id"), F.upper("p_name").alias("p_name"), "p_brand", F.lit("new").alias("state"))
    out = None
    for kind in catalogue.CONFLICTS:
        after, twice = catalogue.import_batch(have, new, ["p_name", "p_brand"], kind)
        one = after.agg(F.count(F.lit(1)).alias("tracks"), F.countDistinct("track_id").alias("ids"), F.count_if((F.col("state") == "new") & F.col("track_id").startswith("K")).alias("changed"))
        one = one.crossJoin(twice.agg(F.count(F.lit(1)).alias("duplicates"))).select(F.lit(kind).alias("kind"), "duplicates", "tracks", (F.col("tracks") - F.col("ids")).alias("clashes"), "changed")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH d AS (SELECT l_orderkey, 1 + l_suppkey % 2 AS d, l_linenumber AS n FROM lineitem), h AS (SELECT l_orderkey, d, list(DISTINCT n) AS have FROM d GROUP BY ALL),
m AS (SELECT l_orderkey, d, have, [x FOR x IN range(1, 4) IF NOT list_contains(have, x)] AS miss, [x FOR x IN list_sort(have) IF x > 3] AS extra FROM h),
t AS (SELECT l_orderkey, len(have) AS p, CASE WHEN d = 1 THEN miss::VARCHAR[] ELSE [d || '-' || x FOR x IN miss] END AS miss, CASE WHEN d = 1 THEN extra::VARCHAR[] ELSE [d || '-' || x FOR x IN extra] END AS extra, d FROM m)
SELECT l_orderkey, (3 * count(*))::INT AS expected, sum(p)::INT AS present, array_to_string(flatten(list(miss ORDER BY d)), ',') AS missing, array_to_string(flatten(list(extra ORDER BY d)), ',') AS extra,
CASE WHEN sum(len(miss)) = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM t GROUP BY 1""")
def q_completeness_discs(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumn("disc", 1 + F.col("l_suppkey") % 2).withColumn("total", F.lit(3))
    return catalogue.completeness(lines, "l_orderkey", "l_linenumber", "disc", "total")


@query("SELECT p_brand, p_type, arg_min(p_partkey, p_partkey) AS p_partkey FROM part GROUP BY ALL")
def q_keep_first(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey")
    return catalogue.first_of(p, [F.lower("p_brand"), F.lower("p_type")], ["p_partkey"])


@query("SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(nullif(l_suppkey % 3, 0), 1), coalesce(l_linenumber, 0), l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS pos FROM lineitem")
def q_album_order(spark, sf_dir):
    from pyspark.sql import Window

    lines = read(spark, sf_dir, "lineitem").withColumn("disc", F.nullif(F.col("l_suppkey") % 3, F.lit(0)))
    w = Window.partitionBy("l_orderkey").orderBy(*catalogue.album_order("disc", "l_linenumber"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lines.select("l_orderkey", "l_linenumber", "l_suppkey", F.row_number().over(w).alias("pos"))


@query("SELECT o_custkey, min(strftime(o_orderdate, '%Y')) AS year FROM orders GROUP BY 1")
def q_oldest_year(spark, sf_dir):
    years = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.date_format("o_orderdate", "yyyy")).alias("y"))
    return years.select("o_custkey", catalogue.oldest_year(F.array_append("y", F.lit("unknown"))).alias("year"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, max(l_tax) OVER (PARTITION BY l_orderkey) AS l_tax, max(l_discount) OVER (PARTITION BY l_orderkey) AS l_discount FROM lineitem")
def q_shared_values(spark, sf_dir):
    return catalogue.shared(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount"), "l_orderkey", ["l_tax", "l_discount"])


@query("SELECT regexp_replace(url, '/[^/]*$', '') AS folder, count(*) AS files, min(url) AS first FROM pages GROUP BY 1")
def q_folders(spark, sf_dir):
    return catalogue.folders(read(spark, sf_dir, "pages"), "url")


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer WHERE c_acctbal > 0) WHERE r = 1")
def q_best_score(spark, sf_dir):
    return catalogue.best_score(read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_acctbal", "c_custkey")


@query("""WITH g AS (SELECT p_brand AS k, p_partkey AS ident, CASE p_type WHEN 'SMALL' THEN 'Single' WHEN 'LARGE' THEN 'Album' WHEN 'MEDIUM' THEN 'EP' ELSE 'Other' END AS kind, p_size % 5 AS score, p_size % 4 = 0 AS live, p_name FROM part),
f AS (SELECT * FROM g WHERE kind <> 'Other' AND NOT live AND contains(p_name, 'ring'))
SELECT k, ident FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, kind, ident) AS r FROM f) WHERE r = 1""")
def q_release_groups(spark, sf_dir):
    kind = F.when(F.col("p_type") == "SMALL", "Single").when(F.col("p_type") == "LARGE", "Album").when(F.col("p_type") == "MEDIUM", "EP").otherwise("Other")
    second = F.when(F.col("p_size") % 4 == 0, F.array(F.lit(" Live"))).otherwise(F.array(F.lit("Demo")))
    g = read(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("ident"), kind.alias("primary"), second.alias("secondary"), F.col("p_name").alias("credit"), (F.col("p_size") % 5).alias("score"), F.lit(None).cast("string").alias("first_date"))
    return catalogue.chosen_groups(catalogue.release_groups(g, F.lit("Ring")), "k").select("k", "ident")


@query("""SELECT k, ident FROM (SELECT p_brand AS k, p_partkey AS ident, row_number() OVER (PARTITION BY p_brand ORDER BY p_type NOT IN ('SMALL', 'LARGE'), 1950 + p_size, p_partkey) AS r FROM part) WHERE r = 1""")
def q_earliest_release(spark, sf_dir):
    medium = F.when(F.col("p_type") == "SMALL", F.array(F.lit("CD "))).when(F.col("p_type") == "LARGE", F.array(F.lit("Vinyl"), F.lit("Digital Media"))).otherwise(F.array(F.lit("Vinyl")))
    g = read(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("ident"), medium.alias("formats"), (1950 + F.col("p_size")).alias("year"))
    return catalogue.earliest_release(g, "k", "formats", "year", "ident").select("k", "ident")


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN 'xxx' || vec_id END AS local_id, label FROM embeddings WHERE vec_id % 4 < 2
UNION ALL SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'xxx' || vec_id END, NULL FROM embeddings WHERE vec_id % 4 >= 2""")
def q_attach_vectors(spark, sf_dir):
    v = vectors(spark, sf_dir)
    own = F.when(F.col("id") % 4 == 0, F.concat(F.lit("xxx"), F.col("id")))
    tracks = v.select("id", F.concat(F.lit(" T"), F.col("id")).alias("track_id"), own.alias("local_id"))
    some = v.where("id % 4 < 2").select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("XXX"), F.col("id"))).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("id"), F.array("label").alias("embedding"))
    return catalogue.attach_vectors(tracks, some).select("id", "local_id", F.col("embedding")[0].alias("label"))


@query("SELECT 'cat' AS origin, vec_id::VARCHAR AS track_id, NULL AS local_id FROM embeddings UNION ALL SELECT 'lib', 'xxx' || doc_id, 'xxx' || doc_id FROM labels")
def q_with_origin(spark, sf_dir):
    cat = vectors(spark, sf_dir).select(F.col("id").cast("string").alias("track_id"))
    lib = read(spark, sf_dir, "labels").select(F.concat(F.lit("xxx"), F.col("doc_id")).alias("track_id"))
    return catalogue.with_origin(cat, lib).select("origin", "track_id", "local_id")


# ---------------------------------------------------------------- playlists
@query("""SELECT section, pos, name, path FROM (SELECT 'new' AS section, row_number() OVER (ORDER BY lower(string_split(url, '/')[-1]), url)::INT AS pos, page_id AS name, url AS path FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT 'old', row_number() OVER (ORDER BY lower(string_split(url, '/')[-1]), url)::INT, page_id, url FROM pages WHERE page_id % 2 = 1)""")
def q_sections(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return sinks.sections([("new", p.where("page_id % 2 = 0")), ("old", p.where("page_id % 2 = 1"))], "page_id", "url")


@query("SELECT conv_id, turn, row FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS row FROM conversations) WHERE row BETWEEN 3 AND 22")
def q_excerpt(spark, sf_dir):
    return sinks.excerpt(read(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], 3)


@query("SELECT conv_id, turn, next FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL")
def q_segments(spark, sf_dir):
    return sinks.segments(read(spark, sf_dir, "conversations"), "conv_id", ["turn"], "turn")


@query("SELECT label, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id)::INT AS pos FROM embeddings")
def q_shuffled(spark, sf_dir):
    return sinks.shuffled(vectors(spark, sf_dir), "label", "id", 7)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 5 > 0 THEN ts END DESC NULLS LAST, event_id)::INT AS pos FROM events")
def q_latest_first(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    shown = F.when(F.col("event_id") % 5 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("N/A")
    return sinks.latest_first(e.withColumn("shown", shown), "user_id", F.try_to_timestamp("shown", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), "event_id")


# ---------------------------------------------------------------- time series
@query("""WITH l AS (SELECT vec_id // 7 AS track, vec_id % 7 AS k, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INT AS pos FROM embeddings)
SELECT track, k // 3 AS snippet, pos, round(avg(x), 6) AS mean FROM l GROUP BY ALL""")
def q_snippets(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("track", F.floor(F.col("id") / 7)).withColumn("at", F.col("id") % 7)
    return timeseries.snippets(v, "track", "at", "embedding", 3).withColumn("mean", F.round("mean", 6))


def count_windows(last: bool) -> str:
    return f"""WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, value FROM events), n AS (SELECT user_id, count(*) AS n FROM x GROUP BY 1),
w AS (SELECT user_id, unnest(range(0, n - 10 + {int(last)}, 2)) AS start FROM n)
SELECT w.user_id, start, count(value) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM w JOIN x ON w.user_id = x.user_id AND k >= start AND k < start + 10 GROUP BY ALL"""


def counted(spark, sf_dir):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read(spark, sf_dir, "events").select("user_id", "value", at.alias("at"))


def rounded(df):
    return df.select("user_id", "start", "n", F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"))


@query(count_windows(True))
def q_windows_to_the_end(spark, sf_dir):
    return rounded(timeseries.windows(counted(spark, sf_dir), "user_id", "at", "value", 10, 2))


@query(count_windows(False))
def q_windows_before_the_end(spark, sf_dir):
    return rounded(timeseries.windows(counted(spark, sf_dir), "user_id", "at", "value", 10, 2, last=False))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_id % 50 AS d, CASE WHEN event_type = 'error' THEN 300000 + event_id % 7 * 100000 END AS tempo FROM events),
p AS (SELECT *, coalesce(last_value(tempo IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 500000) AS pace FROM e)
SELECT event_id, round(sum(d * pace / (480 * 1e6)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS seconds FROM p""")
def q_tempo(spark, sf_dir):
    tempo = F.when(F.col("event_type") == "error", 300_000 + F.col("event_id") % 7 * 100_000)
    e = read(spark, sf_dir, "events").withColumn("d", F.col("event_id") % 50).withColumn("tempo", tempo)
    return timeseries.tempo_seconds(e, "user_id", ["ts", "event_id"], "d", "tempo", 480).select("event_id", F.round("seconds", 6).alias("seconds"))


# ---------------------------------------------------------------- play logs: the functions that run on streams, over a table
@query("SELECT epoch_us(ts) // 3600000000 * 3600 AS start, event_type, count(*) AS plays, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def q_play_counts(spark, sf_dir):
    counts = playlog.play_counts(read(spark, sf_dir, "events"), "ts")
    return counts.select(F.unix_seconds("window.start").alias("start"), "event_type", "plays", F.round("value", 6).alias("value"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS stop, count(*) AS plays FROM s GROUP BY user_id, k""")
def q_sessions(spark, sf_dir):
    out = playlog.sessions(read(spark, sf_dir, "events"), "ts", "user_id")
    return out.select("user_id", F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("stop"), "plays")


# ---------------------------------------------------------------- text and dates
@query("""SELECT event_id, strftime(make_timestamp(event_id * 86400000000), '%Y-%m-%d %H:%M:%S') AS text, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_us(make_timestamp(event_id * 86400000000)) // 1000000 END AS seconds,
event_id * 777 // 1000 AS whole, CASE WHEN (event_id // 2) % 2 = 0 OR event_id % 2 = 0 THEN event_id // 2 ELSE event_id // 2 + 1 END AS half, trunc(event_id * 0.375 * 960)::BIGINT AS ticks, (event_id % 9) * 1073741824 AS bytes, round(event_id * 1234567.0 / 1e9, 2) AS gb,
strftime(make_timestamp(event_id * 86400000000), '%Y%m%d_%H%M%S') AS stamp, CASE WHEN event_id % 3 = 0 THEN 9999 ELSE year(make_timestamp(event_id * 86400000000)) END::INT AS year FROM events""")
def q_dates(spark, sf_dir):
    e = F.col("event_id")
    shown = text.epoch_text((e * 86400).cast("string"))
    broken = F.when(e % 3 == 0, F.lit("N/A")).otherwise(shown)
    when = text.parse_time(broken)
    return read(spark, sf_dir, "events").select(
        "event_id", shown.alias("text"), F.unix_seconds(when).alias("seconds"), text.whole_seconds(e * 777).alias("whole"), text.rounded_seconds(e / 2).alias("half"), text.ticks(e * 0.375, 960).alias("ticks"),
        text.bytes_of(e % 9).alias("bytes"), text.shown_gb(e * 1234567.0).alias("gb"), text.stamp(F.timestamp_seconds(e * 86400), file=True).alias("stamp"), text.year_or_last(broken).alias("year"),
    )


@query(r"""SELECT p_partkey, regexp_replace(lower(p_name) || ' - #' || p_size || ' a/b: c!', '[^\w\s#/:.-]', '', 'g') AS title, regexp_replace(p_name, ' ', '_', 'g') AS file, split_part(p_name, ' ', 1) AS artist, regexp_replace(p_name, '^\S+ ', '') AS track,
left(repeat(p_name, 40), 247) || '...' AS short, '../../' || p_name AS rel, upper(to_hex(p_partkey + 268435456)) AS ident, CASE p_size % 4 WHEN 0 THEN 'ALAC' WHEN 1 THEN 'AAC' WHEN 2 THEN 'FLAC' ELSE 'Unknown' END AS codec,
CASE p_size % 2 WHEN 0 THEN 'C#' END AS root, list_aggregate([upper(x[1]) || x[2:] FOR x IN string_split(p_name, ' ')], 'string_agg', ' ') AS shown FROM part""")
def q_names(spark, sf_dir):
    n, k, size = F.col("p_name"), F.col("p_partkey"), F.col("p_size")
    raw = F.concat(F.upper(n), F.lit(" -  Number "), size, F.lit(" a⁄b∶ c!"))
    parts = text.split_artist_title(F.regexp_replace(n, " ", " - "))
    names = F.concat(F.lit("1-02 ["), F.hex(k + 268435456), F.lit("] - x.m4a"))
    probe = F.when(size % 4 == 0, "Stream #0: Audio: ALAC, 44100").when(size % 4 == 1, "audio:  mp4a (x)").when(size % 4 == 2, "Audio: flac").otherwise("Video: h264")
    return read(spark, sf_dir, "part").select(
        "p_partkey", text.normalize_title(raw).alias("title"), text.sanitize_filename(F.concat(F.lit(" "), F.regexp_replace(n, " ", "?"))).alias("file"), parts["artist"].alias("artist"), parts["title"].alias("track"),
        text.shortened(F.repeat(n, 40)).alias("short"), text.relative_path(F.concat(F.lit("/srv/music/"), n), "/srv/music").alias("rel"), text.id_in_name(names).alias("ident"), text.codec(probe).alias("codec"),
        text.chord_root(F.when(size % 2 == 0, "C#m7/G").otherwise("N")).alias("root"), text.title_case(F.regexp_replace(n, " ", "_")).alias("shown"),
    )


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'own' ELSE regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') END AS title, string_split(url, '/')[-2] AS album, string_split(url, '/')[-3] AS artist FROM pages""")
def q_fill_from_path(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    null = F.lit(None).cast("string")
    filled = text.filled_from_path(F.when(F.col("page_id") % 2 == 0, "own").otherwise(" "), null, null, F.col("url"))
    return p.select("page_id", filled.alias("f")).select("page_id", "f.title", "f.album", "f.artist")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'parent' WHEN 'click' THEN '' ELSE 'grand' END AS artist, CASE event_type WHEN 'view' THEN 'T' || event_id WHEN 'click' THEN '' ELSE 'parent' END AS album,
CASE event_type WHEN 'view' THEN '' ELSE 'T' || event_id END AS track, strftime(make_timestamp(event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS last_played, CASE event_type WHEN 'view' THEN 'album' WHEN 'click' THEN 'playlist' ELSE 'track' END AS media_type FROM events""")
def q_remote_items(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "album").when(F.col("event_type") == "click", "playlist").otherwise("track")
    item = text.remote_item(kind, F.concat(F.lit("T"), F.col("event_id")), F.lit("parent"), F.lit("grand"), F.lit(None).cast("long"), F.col("event_id"))
    return e.select("event_id", item.alias("i")).select("event_id", "i.*")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 = 0 AND l_suppkey % 3 = 0 THEN 'unset' WHEN l_linenumber % 4 <> 1 THEN 'full' WHEN l_suppkey % 3 <> 2 THEN 'partial' ELSE 'none' END AS mismatch FROM lineitem""")
def q_number_mismatch(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    zero, one = F.lit(0), F.lit(1)
    return line.select("l_orderkey", "l_linenumber", "l_partkey", text.number_mismatch(F.col("l_linenumber") % 4, F.col("l_suppkey") % 3, zero, zero, one, F.lit(2), zero, zero).alias("mismatch"))


@query("SELECT page_id, CASE WHEN NOT starts_with(url, 'http://') THEN 'outside' WHEN page_id % 3 = 0 THEN 'missing' ELSE 'ok' END AS kind FROM pages")
def q_failures(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.failure_kind(F.col("url"), "http:/", F.col("page_id") % 3 != 0).alias("kind"))


# ---------------------------------------------------------------- without SQL: one chain over all clusters, and difflib semantics
@query()
def q_curated(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("album", F.when(F.col("id") % 10 < 3, F.floor(F.col("id") / 10)))
    return clusters.curate(v, "id", "label", "embedding", "album", walked(spark, sf_dir))


@query()
def q_name_matches(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("hid"), F.col("p_brand").alias("artist"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25).alias("artist"), F.concat(F.lit("red ring "), F.when(F.col("s_suppkey") % 2 == 0, "SMALL").otherwise("LARG")).alias("title"))
    return matching.name_matches(s, p).withColumn("score", F.round("score", 6))
