"""The registered queries of the library operators over the standard tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import genres, text
from cadenza.operators import catalogue, clusters, matching, metric, neighbors, similarity, sinks, timeseries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


# ---------------------------------------------------------------- vectors
E_ = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
SIM = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
NN = f"""{E_},
sims AS (SELECT a.id, b.id AS neighbor, round({SIM.format(a="a.v", b="b.v")}, 9) AS s FROM e a JOIN e b ON a.id <> b.id),
nn AS (SELECT id, neighbor, s AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbor) AS r FROM sims) WHERE r = 1)"""


@query(f"WITH {NN} SELECT id, neighbor, round(similarity, 6) AS similarity FROM nn")
def q_nearest_neighbor(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return neighbors.nearest(v, v).withColumn("similarity", F.round("similarity", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_nearest_neighbor(spark, sf_dir)


@query(f"""WITH {NN} SELECT least(id, neighbor) AS a, greatest(id, neighbor) AS b, round(max(similarity), 6) AS similarity
FROM nn GROUP BY 1, 2 ORDER BY max(similarity) DESC, 1, 2 LIMIT 100""")
def q_top_pairs(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return neighbors.top_pairs(neighbors.nearest(v, v), 100).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {NN} SELECT count(*) AS n, round(min(similarity), 6) AS least, round(max(similarity), 6) AS most, round(avg(similarity), 6) AS mean,
round(median(similarity), 6) AS median, round(stddev_pop(similarity), 6) AS std, count(*) FILTER (similarity = 1.0) AS exact,
count(*) FILTER (similarity >= 1 - 1e-5) AS almost FROM nn""")
def q_nn_statistics(spark, sf_dir):
    v = vectors(spark, sf_dir)
    s = neighbors.statistics(neighbors.nearest(v, v))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("least", "most", "mean", "median", "std")], "exact", "almost")


@query(f"""WITH {NN}, l AS (SELECT min(similarity) AS low FROM nn)
SELECT CASE WHEN low < 1 THEN least(19, floor((similarity - low) / ((1.0 - low) / 20)))::INT ELSE 0 END AS bucket, count(*) AS n FROM nn, l GROUP BY 1""")
def q_nn_histogram(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return neighbors.histogram(neighbors.nearest(v, v), 20)


@query(f"WITH {NN} SELECT id, neighbor, round(similarity, 6) AS similarity FROM nn")
def q_nearest_pruned(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return metric.nearest_pruned(v, v, block=256).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {NN} SELECT id, neighbor, round(similarity, 6) AS similarity,
CASE WHEN similarity >= 0.45 THEN 'duplicate' WHEN similarity >= 0.40 THEN 'ask' ELSE 'new' END AS class FROM nn""")
def q_near_duplicates(spark, sf_dir):
    v = vectors(spark, sf_dir)
    nn = neighbors.nearest(v, v)
    return nn.select("id", "neighbor", F.round("similarity", 6).alias("similarity"), neighbors.duplicate_class(F.col("similarity"), 0.45, 0.40).alias("class"))


LONG = f"{E_}, long AS (SELECT id, label, unnest(v) AS x, unnest(range(0, len(v)))::INT AS pos FROM e)"
CENT = f"{LONG}, m AS (SELECT label, pos, avg(x) AS mean FROM long GROUP BY ALL), c AS (SELECT label, list(mean ORDER BY pos) AS c FROM m GROUP BY label)"


@query(f"WITH {CENT} SELECT label, pos, round(mean, 6) AS mean FROM m")
def q_centroids(spark, sf_dir):
    return clusters.means(vectors(spark, sf_dir), "label", "embedding").withColumn("mean", F.round("mean", 6))


@query(f"WITH {CENT} SELECT e.label, round(avg(list_distance(v, c)), 6) AS breadth FROM e JOIN c USING (label) GROUP BY 1")
def q_breadth(spark, sf_dir):
    return clusters.breadth(vectors(spark, sf_dir), "label", "embedding").withColumn("breadth", F.round("breadth", 6))


@query(f"""WITH {CENT}, d AS (SELECT e.id, c.label AS k, round(1 - {SIM.format(a="v", b="c")}, 9) AS d FROM e, c),
b AS (SELECT id, k, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS r FROM d) WHERE r = 1)
SELECT id, CASE WHEN d <= 0.7 THEN k::VARCHAR ELSE 'outliers' END AS cluster, round(d, 6) AS distance FROM b""")
def q_refine(spark, sf_dir):
    return clusters.refine(vectors(spark, sf_dir), "id", "label", "embedding", 0.7).withColumn("distance", F.round("distance", 6))


MERGE = f"""RECURSIVE {CENT}, b AS (SELECT e.label, avg(list_distance(v, c)) AS b FROM e JOIN c USING (label) GROUP BY 1),
k AS MATERIALIZED (SELECT label, c, b, row_number() OVER (ORDER BY label) AS i FROM c JOIN b USING (label)),
pairs AS MATERIALIZED (SELECT x.i, list(y.i ORDER BY y.i) FILTER ({SIM.format(a="x.c", b="y.c")} > 0.2 AND (x.b + y.b = 0 OR abs(x.b - y.b) / ((x.b + y.b) / 2) <= 0.5) AND x.label % 2 = y.label % 2 AND y.i > x.i) AS near FROM k x, k y GROUP BY x.i),
walk AS (SELECT 1 AS step, list_transform(range(1, (SELECT count(*) FROM k) + 1), lambda j: j) AS root UNION ALL
  SELECT step + 1, list_transform(range(1, len(root) + 1), lambda j: CASE WHEN root[step] = step AND root[j] = j AND list_contains(near, j) THEN step ELSE root[j] END) FROM walk JOIN pairs ON pairs.i = step)"""


@query(f"WITH {MERGE}, last AS (SELECT arg_max(root, step) AS root FROM walk) SELECT k.label, l.label AS merged_into FROM k, last, k l WHERE l.i = last.root[k.i]")
def q_merge(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("token", F.col("label") % 2)
    return clusters.merge(v, "label", "embedding", "token", 0.2, 0.5)


LIKE = f"""{E_}, rated AS (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1), r AS (SELECT e.id, v FROM e JOIN rated USING (id)),
s AS (SELECT e.id, {SIM.format(a="e.v", b="r.v")} AS s FROM e, r),
w AS (SELECT id, 1 - s AS d, CASE WHEN s < 0 THEN 0 ELSE exp(-((1 - s) * (1 - s)) / (2 * 0.3 * 0.3)) END AS w FROM s),
t AS (SELECT id, sum(w) AS w, sum(w * d) AS wd FROM w GROUP BY id),
score AS (SELECT e.id, r.id IS NOT NULL AS rated, round(CASE WHEN r.id IS NOT NULL THEN 1.0 WHEN coalesce(w, 0) < 1e-3 THEN 0.0 ELSE 1 - wd / w END, 6) AS score
  FROM e LEFT JOIN t USING (id) LEFT JOIN r ON r.id = e.id)"""


def scores(spark, sf_dir):
    v = vectors(spark, sf_dir)
    rated = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    return clusters.like(v, v.join(rated, "id", "left_semi"), "id", "embedding", 0.3)


@query(f"WITH {LIKE} SELECT * FROM score")
def q_like(spark, sf_dir):
    return scores(spark, sf_dir)


@query(f"WITH {LIKE} SELECT id, score FROM score WHERE NOT rated AND score >= 0.15 AND score < 1")
def q_recommend(spark, sf_dir):
    return clusters.recommend(scores(spark, sf_dir), 0.15)


@query(f"""WITH RECURSIVE {E_},
s AS MATERIALIZED (SELECT a.label, a.id AS a, b.id AS b, round({SIM.format(a="a.v", b="b.v")}, 9) AS s FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id),
chain AS (SELECT label, min(id) AS id, 1 AS pos, [min(id)] AS seen FROM e GROUP BY label
  UNION ALL SELECT label, n.id, pos + 1, list_append(seen, n.id) FROM chain c,
  LATERAL (SELECT arg_max(b, (s, -b)) AS id FROM s WHERE s.label = c.label AND s.a = c.id AND NOT list_contains(c.seen, s.b)) n WHERE n.id IS NOT NULL)
SELECT label, id, pos FROM chain""")
def q_chain(spark, sf_dir):
    return clusters.chain(vectors(spark, sf_dir), "id", "label", "embedding")


def albums(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("album", F.floor(F.col("id") / 5).cast("long")).withColumn("token", F.col("label") % 3)


@query("""WITH x AS (SELECT vec_id AS id, vec_id // 5 AS album, label FROM embeddings)
SELECT album, label, min(id) AS first, max(id) AS last, count(*)::INT AS tracks FROM x GROUP BY ALL""")
def q_chain_blocks(spark, sf_dir):
    return clusters.chain_blocks(albums(spark, sf_dir), "id", "album", "label", "embedding")


@query(f"""WITH {CENT}, al AS (SELECT id // 5 AS album, pos, avg(x) AS mean FROM long GROUP BY ALL),
a AS (SELECT album, list(mean ORDER BY pos) AS ac FROM al GROUP BY album),
ak AS (SELECT id // 5 AS album, list(DISTINCT label % 3) AS k1 FROM e GROUP BY 1), ck AS (SELECT label, list(DISTINCT label % 3) AS k2 FROM e GROUP BY 1),
p AS (SELECT a.album, c.label, len(list_intersect(k1, k2)) AS o, round({SIM.format(a="ac", b="c")}, 9) AS s FROM a JOIN ak USING (album) CROSS JOIN c JOIN ck USING (label)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY album ORDER BY o DESC, s DESC, label) AS r FROM p) WHERE r = 1)
SELECT album, CASE WHEN o > 0 AND s >= 0.3 THEN label::VARCHAR ELSE 'outliers' END AS cluster, o::INT AS overlap, round(s, 6) AS similarity FROM b""")
def q_assign_albums(spark, sf_dir):
    return clusters.assign_albums(albums(spark, sf_dir), "id", "album", "label", "embedding", "token", 0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {LONG}, p AS (SELECT id // 5 AS track, pos, avg(x) AS tf, (max(x) > 0.2)::INT AS has FROM long GROUP BY ALL),
d AS (SELECT pos, sum(has)::BIGINT AS df, count(*) AS n FROM p GROUP BY pos)
SELECT track, pos, round(tf, 6) AS tf, df, round(tf * -ln((df + 1e-10) / n), 6) AS tfidf FROM p JOIN d USING (pos)""")
def q_tfidf(spark, sf_dir):
    out = clusters.tfidf(albums(spark, sf_dir), "album", "embedding", 0.2)
    return out.select("track", "pos", F.round("tf", 6).alias("tf"), "df", F.round("tfidf", 6).alias("tfidf"))


@query(f"WITH {LONG} SELECT label, pos, round(max(x), 6) AS most FROM long GROUP BY ALL")
def q_pool_max(spark, sf_dir):
    return clusters.pool_max(vectors(spark, sf_dir), "label", "embedding").withColumn("most", F.round("most", 6))


@query(f"""WITH {LONG}, f AS (SELECT id, pos AS class, x FROM long WHERE pos < 3),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, class) AS r FROM f),
p AS (SELECT class, count(*) FILTER (r = 1) AS wins, sum(abs(x)) AS s FROM r GROUP BY class)
SELECT class, wins, round(100 * wins / sum(wins) OVER (), 4) AS percent, round(100 * s / sum(s) OVER (), 4) AS share_percent FROM p""")
def q_winner_share(spark, sf_dir):
    return clusters.winners(vectors(spark, sf_dir), "id", "embedding", 3)


#: How well each of twelve pitch classes fits a major and a minor key. Fixed values.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


@query(f"""WITH {LONG}, p AS (SELECT 0 AS mode, unnest({list(MAJOR)}) AS w, unnest(range(0, 12)) AS i UNION ALL SELECT 1, unnest({list(MINOR)}), unnest(range(0, 12))), k AS (SELECT unnest(range(0, 12)) AS key),
c AS (SELECT id, key, mode, round(corr(x, w), 9) AS r FROM long JOIN k ON true JOIN p ON (pos - key + 12) % 12 = i WHERE pos < 12 GROUP BY ALL)
SELECT id, key::INT AS key, CASE mode WHEN 0 THEN 'major' ELSE 'minor' END AS mode, round(r, 6) AS fit FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r DESC, key, mode) AS n FROM c) WHERE n = 1""")
def q_key_fit(spark, sf_dir):
    profiles = F.array(*[F.array(*map(F.lit, p)) for p in (MAJOR, MINOR)])
    long = vectors(spark, sf_dir).select("id", F.posexplode(F.slice(F.col("embedding").cast("array<double>"), 1, 12)).alias("pos", "x"))
    keyed = long.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("mode", F.explode(F.array(F.lit(0), F.lit(1))))
    fits = keyed.withColumn("w", F.get(F.get(profiles, F.col("mode")), (F.col("pos") - F.col("key") + 12) % 12)).groupBy("id", "key", "mode").agg(F.round(F.corr("x", "w"), 9).alias("r"))
    best = fits.groupBy("id").agg(F.min(F.struct((-F.col("r")).alias("r"), "key", "mode")).alias("b"))
    return best.select("id", F.col("b.key").alias("key"), F.when(F.col("b.mode") == 0, "major").otherwise("minor").alias("mode"), F.round(-F.col("b.r"), 6).alias("fit"))


# ---------------------------------------------------------------- genres
VOTES = """v AS (SELECT p_brand AS artist, lower(trim(p_type)) AS genre, l_orderkey AS ord FROM part JOIN lineitem ON p_partkey = l_partkey),
n AS (SELECT artist, genre, count(*) AS votes, min(ord) AS first FROM v GROUP BY ALL)"""


def votes(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("artist"), F.col("p_type").alias("genre"))
    sold = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("ord"))
    return part.join(sold, F.col("p_partkey") == F.col("l_partkey"))


@query(f"WITH {VOTES} SELECT artist, genre, votes, rank FROM (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY votes DESC, first, genre)::INT AS rank FROM n) WHERE rank <= 5")
def q_genre_vote(spark, sf_dir):
    return genres.vote(votes(spark, sf_dir), "artist", "genre", "ord")


@query("""WITH n AS (SELECT p_brand AS artist, p_type AS genre, count(*) AS votes FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL)
SELECT artist, genre, votes FROM (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY votes DESC, genre) AS r FROM n) WHERE r = 1""")
def q_artist_genre(spark, sf_dir):
    return catalogue.argmax_genre(votes(spark, sf_dir), "artist", "genre")


TAXONOMY = (("00", "rock"), ("01", "pop"), ("02", "jazz"), ("03", "folk"), ("04", "blues"), ("05", "soul"))


@query(f"""WITH t(hex, name) AS (VALUES {", ".join(map(str, TAXONOMY))}),
c AS (SELECT p_partkey, 'x' || lpad(lower(to_hex(p_partkey % 8)), 2, '0') || lpad(lower(to_hex(p_size % 8)), 2, '0') || lpad(lower(to_hex(p_size)), 2, '0') AS code FROM part),
p AS (SELECT p_partkey, unnest(regexp_extract_all(code, '[0-9a-f]{{2}}')) AS pair, unnest([1, 2, 3]) AS pos FROM c)
SELECT p_partkey, any_value(code) AS code, string_agg(coalesce(name, 'Unknown(0x' || pair || ')'), ', ' ORDER BY pos) AS genres
FROM p LEFT JOIN t ON pair = hex JOIN c USING (p_partkey) GROUP BY p_partkey""")
def q_genre_codes(spark, sf_dir):
    taxonomy = spark.createDataFrame(TAXONOMY, "hex string, name string")
    pair = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    coded = read(spark, sf_dir, "part").select("p_partkey", genres.encode(F.array(pair(F.col("p_partkey") % 8), pair(F.col("p_size").cast("long") % 8), pair(F.col("p_size").cast("long")))).alias("code"))
    return genres.decode(coded, "code", "p_partkey", taxonomy).join(coded, "p_partkey").select("p_partkey", "code", "genres")


# ---------------------------------------------------------------- catalogue
@query("""SELECT o_orderkey, (c_mktsegment = 'BUILDING' OR o_orderkey % 7 = 0) AND NOT o_orderstatus = 'P' AS kept
FROM orders JOIN customer ON o_custkey = c_custkey""")
def q_favourites(spark, sf_dir):
    fav = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(True).alias("fav"))
    every = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(every, F.col("o_custkey") == F.col("k"), "left_semi")
    rows = o.join(fav, F.col("o_custkey") == F.col("c_custkey"), "left")
    keep = catalogue.favourites(rows, F.coalesce("fav", F.lit(False)), F.col("o_orderstatus") == "P", F.col("o_orderkey") % 7 == 0, {1, 2, 3})
    return rows.select("o_orderkey", keep.alias("kept"))


@query("""SELECT vec_id AS id, CASE WHEN doc_id IS NULL THEN 'cat' ELSE 'both' END AS owner FROM embeddings LEFT JOIN (SELECT DISTINCT doc_id FROM labels) ON vec_id = doc_id
UNION ALL SELECT DISTINCT doc_id, 'lib' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def q_ownership(spark, sf_dir):
    cat = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("cat"))
    lib = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct().withColumn("lib", F.lit(True))
    both = cat.join(lib, "id", "full_outer")
    owner = F.when(F.col("cat") & F.col("lib"), "both").when(F.col("cat"), "cat").otherwise("lib")
    return both.select("id", owner.alias("owner"))


@query("""SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def q_reconcile(spark, sf_dir):
    return catalogue.differences(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q_duplicate_ids(spark, sf_dir):
    return catalogue.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH h AS (SELECT l_orderkey, max(l_linenumber)::INT AS expected, list(DISTINCT l_linenumber::INT) AS have FROM lineitem GROUP BY 1),
m AS (SELECT l_orderkey, expected, have, list_filter(range(1, expected + 1), lambda n: NOT list_contains(have, n)) AS miss FROM h)
SELECT l_orderkey, expected, len(have)::INT AS present, array_to_string(miss, ',') AS missing, CASE WHEN len(miss) = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM m WHERE expected >= 1""")
def q_completeness(spark, sf_dir):
    return catalogue.completeness(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""WITH c AS (SELECT o_custkey, year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, arg_max(year, (n, -year)) AS year, count(*) AS distinct_values FROM c GROUP BY o_custkey""")
def q_year_mode(spark, sf_dir):
    return catalogue.modal(read(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year")), "o_custkey", "year")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def q_latest(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return catalogue.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT o_orderkey, o_custkey, 'old' AS state FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT o_orderkey, -o_custkey, 'new' FROM orders WHERE o_orderkey % 10 = 0""")
def q_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit("old").alias("state"))
    new = old.where("o_orderkey % 10 = 0").select("o_orderkey", (-F.col("o_custkey")).alias("o_custkey"), F.lit("new").alias("state"))
    return catalogue.upsert(old, new, "o_orderkey")


@query("""SELECT event_id, coalesce(props <> prev, true) AS changed FROM (SELECT event_id, props, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)""")
def q_map_changes(spark, sf_dir):
    e = catalogue.parse_tags(read(spark, sf_dir, "events"), "props")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    one = catalogue.canonical(F.col("tags"))
    return e.select("event_id", "user_id", "ts", one.alias("now")).withColumn("prev", F.lag("now").over(w)).select("event_id", F.coalesce(F.col("now") != F.col("prev"), F.lit(True)).alias("changed"))


LOG = ["user_id", "event_type", "props"]


@query("""WITH o AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15'), n AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15')
SELECT event_id, user_id, event_type, props FROM o UNION ALL
SELECT event_id, user_id, event_type, props FROM n WHERE (user_id, event_type, props) NOT IN (SELECT (user_id, event_type, props) FROM o)""")
def q_log_merge(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "ts", *LOG)
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return catalogue.merge_logs(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), LOG).select("event_id", *LOG)


@query("""WITH t AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS tier FROM orders), b AS (SELECT o_custkey, min(tier) AS tier FROM t GROUP BY 1)
SELECT o_custkey, o_orderkey, t.tier::INT AS tier, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey)::INT AS rank FROM t JOIN b USING (o_custkey, tier)""")
def q_rank_candidates(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    tier = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return catalogue.best_tier(o, "o_custkey", tier, [F.desc("o_totalprice"), "o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "tier", "rank")


@query("""SELECT source, bool_or(quality = 1) AS any_good, bool_or(toxic = 1) AS any_toxic, CASE WHEN bool_or(toxic = 1) THEN 'mixed' ELSE 'clean' END AS state
FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def q_flags(spark, sf_dir):
    j = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    g = j.groupBy("source").agg(F.bool_or(F.col("quality") == 1).alias("any_good"), F.bool_or(F.col("toxic") == 1).alias("any_toxic"))
    return g.withColumn("state", F.when(F.col("any_toxic"), "mixed").otherwise("clean"))


@query("""SELECT o_orderstatus, lpad(count(*)::VARCHAR, 9, '0') || '.' || CASE o_orderstatus WHEN 'F' THEN 'BA' ELSE 'AA' END AS revision FROM orders GROUP BY 1""")
def q_revision(spark, sf_dir):
    g = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    before = F.when(F.col("o_orderstatus") == "F", F.col("n")).otherwise(F.col("n") - 1)
    return g.select("o_orderstatus", catalogue.next_revision(F.col("n"), before, F.lit("AZ")).alias("revision"))


@query("""SELECT event_id, (props::JSON ->> 'k')::VARCHAR AS k FROM events""")
def q_widen(spark, sf_dir):
    return catalogue.widen(catalogue.parse_tags(read(spark, sf_dir, "events"), "props").select("event_id", "tags"), "tags")


@query("""WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents), c AS (SELECT lang, token, count(*) AS uses FROM t GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY uses DESC, token)::INT AS rank FROM c) WHERE rank <= 5""")
def q_top_tokens(spark, sf_dir):
    return catalogue.top_tokens(read(spark, sf_dir, "documents"), "lang", "text")


@query("SELECT p_brand, list_sort(list(DISTINCT p_type)) AS types, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1")
def q_album_metadata(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("types"), F.countDistinct("p_size").alias("sizes"))


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1 AND count(DISTINCT o_orderpriority) = 1")
def q_uniform(spark, sf_dir):
    g = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("a"), F.countDistinct("o_orderpriority").alias("b"))
    return g.where("a = 1 and b = 1").select("o_custkey")


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id = 42")
def q_lookup(spark, sf_dir):
    return vectors(spark, sf_dir).where("id = 42").select("id", "label")


@query("SELECT vec_id AS id, embedding[1:4]::DOUBLE[] AS head FROM embeddings")
def q_vector_head(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("head"))


# ---------------------------------------------------------------- time series
@query("""WITH f AS (SELECT *, coalesce(value >= 50, false) AS f FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, f ORDER BY ts, event_id) AS g FROM f)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS rows FROM r WHERE f GROUP BY user_id, g""")
def q_islands(spark, sf_dir):
    return timeseries.islands(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") >= 50, "event_id", "event_id")


@query("""SELECT conv_id, turn, text AS said, next_text AS answered FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")
def q_pairing(spark, sf_dir):
    p = timeseries.pairing(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "user", "assistant", "text")
    return p.select("conv_id", "turn", F.col("text").alias("said"), F.col("next_text").alias("answered"))


@query("""WITH x AS (SELECT epoch_us(ts) AS t, value AS v FROM events), r AS (SELECT v, unnest(range((t - 172800000000) // 86400000000 + 1, t // 86400000000 + 1)) AS w FROM x)
SELECT w * 86400 AS start, count(*) AS n, round(avg(v), 6) AS mean, round(max(v), 6) AS most FROM r GROUP BY w""")
def q_sliding(spark, sf_dir):
    return timeseries.sliding(read(spark, sf_dir, "events"), "ts", "value", 172800, 86400).select("start", "n", F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"))


@query("""WITH m AS (SELECT epoch_us(ts) // 3600000000 * 3600 AS start, max(value) AS most FROM events GROUP BY 1)
SELECT start, round(most, 6) AS most, round(round_even((greatest(0, least(100, most)) - 0) / (100.0 / 64), 0) * (100.0 / 64), 6) AS level FROM m""")
def q_tumbling(spark, sf_dir):
    m = timeseries.tumbling_max(read(spark, sf_dir, "events"), "ts", "value", 3600)
    return m.select("start", F.round("most", 6).alias("most"), F.round(timeseries.quantise(F.col("most"), 0.0, 100.0), 6).alias("level"))


@query("""WITH d AS (SELECT event_id, user_id, ts, coalesce(greatest(0, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0) AS delta FROM events)
SELECT event_id, delta, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS elapsed FROM d""")
def q_ticks(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("tick"))
    return timeseries.deltas(e, "user_id", ["ts", "event_id"], "tick").select("event_id", "delta", "elapsed")


@query("""SELECT doc_id, total::BIGINT AS total, lpad(seq::VARCHAR, 6, '0') AS label FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) AS total, row_number() OVER (ORDER BY doc_id) AS seq FROM documents) WHERE total <= 1000000""")
def q_budget(spark, sf_dir):
    return timeseries.within_budget(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 1_000_000).select("doc_id", "total", "label")


@query("""WITH g AS (SELECT user_id, sqrt(avg(value * value)) AS rms FROM events GROUP BY 1)
SELECT user_id, round(rms, 6) AS rms, round(20 * log10(rms + 1e-9), 6) AS db, round(greatest(0.0, least(1.0, (20 * log10(rms + 1e-9) + 60) / 60)), 6) AS level FROM g""")
def q_energy(spark, sf_dir):
    g = timeseries.energy_db(read(spark, sf_dir, "events"), "user_id", "value")
    return g.select("user_id", *[F.round(c, 6).alias(c) for c in ("rms", "db", "level")])


# ---------------------------------------------------------------- text
@query("""SELECT p_partkey, (contains(lower(p_name), 'small') AND contains(lower(p_name), 'ring')) AS both, (contains(t, 'red') OR contains(t, 'blue')) AS either, contains(lower(p_type), 'promo') AS genre
FROM (SELECT *, lower(p_name || ' ' || p_brand) AS t FROM part)""")
def q_search(spark, sf_dir):
    s = lambda x: matching.search(x, ["p_name", "p_brand"], "p_type")
    return read(spark, sf_dir, "part").select("p_partkey", s("small + ring").alias("both"), s("red, the blue").alias("either"), s("@gen promo").alias("genre"))


@query("""SELECT p_partkey, printf('%d-%02d [%s] - %s.m4a', p_size % 3 + 1, p_size, lpad(upper(to_hex(p_partkey)), 8, '0'),
CASE WHEN length(s) > 12 THEN regexp_replace(left(s, 12), '[_ -]+$', '') ELSE s END) AS filename FROM (SELECT *, regexp_replace(p_name, '[^A-Za-z0-9 _-]+', '_', 'g') AS s FROM part)""")
def q_filename(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", text.track_filename(F.col("p_size") % 3 + 1, F.col("p_size"), F.lpad(F.hex("p_partkey"), 8, "0"), text.safe_name(F.col("p_name"), 12)).alias("filename"))


@query(r"""SELECT page_id, regexp_replace(lower(trim(url)), '[\\/:*?"<>|]', '', 'g') AS value, regexp_replace(trim(url), '(?i)^the ', '') AS plain FROM pages""")
def q_normalize(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", text.normalize_value(F.col("url")).alias("value"), text.without_article(F.col("url")).alias("plain"))


@query("""SELECT page_id, string_split(url, '/')[3] AS artist, string_split(url, '/')[-2] AS album, string_split(url, '/')[-1] AS title FROM pages""")
def q_path_parts(spark, sf_dir):
    parts = F.split("url", "/")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return read(spark, sf_dir, "pages").select("page_id", at(3).alias("artist"), at(-2).alias("album"), at(-1).alias("title"))


@query("""SELECT o_orderkey, regexp_extract(strftime(o_orderdate, '%Y-%m-%d'), '^(\\d{4})', 1)::INT AS year FROM orders""".replace("\\\\", "\\"))
def q_leading_year(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.leading_year(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))


@query("""SELECT conv_id, count(*) AS tracks, sum(length(text))::BIGINT AS duration, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def q_playlist_document(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("long"))
    d = sinks.playlist_document(c, "conv_id", ["turn"], ["role", "n"], "n")
    roles = F.array_join(F.from_json(F.get_json_object("document", "$.playlist.track[*].role"), "array<string>"), ",")
    one = F.concat(F.lit("["), F.regexp_replace(F.get_json_object("document", "$.playlist.track[*].role"), r"^\[|\]$", ""), F.lit("]"))
    return d.select("conv_id", "tracks", "duration", F.coalesce(roles, F.array_join(F.from_json(one, "array<string>"), ",")).alias("roles"))


@query("""SELECT lang, 0 AS line_no, '#EXTM3U' AS line FROM documents GROUP BY lang UNION ALL
SELECT lang, 2 * r - 1, '#EXTINF:' || n_chars || ',' || source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) UNION ALL
SELECT lang, 2 * r, source || '/' || doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents)""")
def q_playlist_lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", "source").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return sinks.playlist_lines(d, "lang", ["doc_id"], "n_chars", "source", "path").withColumn("line_no", F.col("line_no").cast("long"))


# ---------------------------------------------------------------- fuzzy matching (no SQL: difflib semantics)
@query()
def q_fuzzy_pairs(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_name").distinct()
    pairs = matching.fuzzy_pairs(p.withColumnRenamed("p_name", "a"), p.withColumnRenamed("p_name", "b"), "a", "b", 0.8)
    return pairs.where("a < b").withColumn("score", F.round("score", 6))


@query()
def q_token_set_pairs(spark, sf_dir):
    """Part names against their descriptions in another order of words."""
    p = read(spark, sf_dir, "part")
    return similarity.token_set_pairs(p.select(F.concat_ws(" ", "p_name", "p_type").alias("a")), p.select(F.concat_ws(" ", "p_type", "p_brand", F.upper("p_name")).alias("b")), "a", "b")


def named_parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("album"), F.col("p_brand").alias("artist"))


@query()
def q_tiered_match(spark, sf_dir):
    p = named_parts(spark, sf_dir)
    return matching.tiered(p.withColumnRenamed("p_partkey", "qid"), p.withColumnRenamed("p_partkey", "hid"), others=True)


@query()
def q_playlist_difference(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    one, two = (p.where(F.col("p_partkey") % 2 == k).select(F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct() for k in (0, 1))
    return matching.playlist_difference(one, two, "name")
