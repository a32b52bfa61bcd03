"""URL filters by a sort-merge range join of rule prefixes and urls.

Keys.  A url becomes a point ``(suffix of its host, path)`` for each host suffix that
some rule names; a rule becomes the interval of all paths that start with its own.
Intervals of prefixes are nested or disjoint.

Sweep.  Points and interval starts are sorted by (host key, path).  Each start
carries the stack of intervals open at that place (its own and all that enclose
it); the sweep hands every point the stack of the last start before it, and the
point pops the intervals that ended meanwhile.  What is left on top is the longest
fitting rule of that host key.

Scale.  The sweep is a window over (host key, salt).  Points of a host key are dealt
over as many salts as its share of all points demands, and its rules are copied to
each, so ``com`` does not land in one task.  Only distinct (host, path) pairs are swept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import fresh, read, small, stored

#: (host, path, verdict) of the production list.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(df: DataFrame, url: str, host: str = "host", path: str = "path") -> DataFrame:
    """Adds host and path; both are empty where the url is null or has no ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    return df.withColumn(
        host, F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    ).withColumn(path, F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1))


def reversed_host(host: Column) -> Column:
    """Labels from the top down, the sort key of hosts: ``a.example.org`` -> ``org.example.a``."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``key, rpath, stack`` of each distinct rule place; ``stack`` holds the rules of
    that key whose path is a prefix of ``rpath``, shortest first.

    Of rules with equal host and path ``block`` wins.
    """
    distinct = rules.groupBy(reversed_host(F.col("rhost")).alias("key"), "rhost", "rpath").agg(F.max("rverdict").alias("rverdict"))
    item = F.struct(
        F.length("rpath").alias("n"), F.col("rpath").alias("path"), F.concat("rhost", "rpath").alias("rule"), F.col("rverdict").alias("verdict")
    )
    prefixes = distinct.select("key", "rpath", F.explode(F.sequence(F.lit(0), F.length("rpath"))).alias("k")).select(
        "key", "rpath", F.substr(F.col("rpath"), F.lit(1), F.col("k")).alias("prefix")
    )
    enclosing = distinct.select(F.col("key").alias("k2"), F.col("rpath").alias("p2"), item.alias("item"))
    found = prefixes.join(enclosing, (F.col("key") == F.col("k2")) & (F.col("prefix") == F.col("p2")))
    return found.groupBy("key", "rpath").agg(F.sort_array(F.collect_list("item")).alias("stack"))


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` plus ``host, path, rule, verdict``.

    ``rules`` has the strings ``host, path, verdict``.  A rule fits its host and all
    subdomains if the url's path starts with the rule's.  The rule with the longest
    host and path together wins, then the longest host.  ``rule`` is null and
    ``verdict`` the default where none fits.  Null urls have empty host and path;
    repeated rows stay; columns of ``pages`` named like an added one are replaced.
    """
    spark = pages.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    clean = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rhost"),
        F.coalesce("path", F.lit("")).alias("rpath"),
        F.col("verdict").alias("rverdict"),
    )
    stacks = stored(rule_stacks(clean), "url-rules")
    depth = clean.agg(F.max(F.size(F.split("rhost", r"\."))).alias("d")).first()["d"] or 0

    parsed = with_host_path(pages, url)
    bhost, bpath, found = fresh(parsed, "bhost", "bpath", "best")
    places = parsed.select(F.col("host").alias("uhost"), F.col("path").alias("upath")).distinct()
    labels = F.reverse(F.split("uhost", r"\."))
    keys = F.transform(F.sequence(F.lit(1), F.least(F.lit(max(depth, 1)), F.size(labels))), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))
    points = places.select("uhost", "upath", F.explode(keys).alias("key"))
    named = stacks.select(F.col("key").alias("rkey")).distinct()
    named = F.broadcast(named) if small(named, "rkey") else named
    points = stored(points.join(named, F.col("key") == F.col("rkey"), "left_semi"), "url-points")

    total = max(1, points.count())
    salts = points.groupBy(F.col("key").alias("skey")).agg(
        F.greatest(F.lit(1), F.least(F.lit(tasks), F.ceil(F.count(F.lit(1)) * F.lit(2 * tasks) / F.lit(total)).cast("int"))).alias("salts")
    )
    salts = stored(salts, "url-salts")
    dealt = F.broadcast(salts) if small(salts, "skey") else salts
    point_rows = points.join(dealt, F.col("key") == F.col("skey")).select(
        "key", F.pmod(F.xxhash64("uhost", "upath"), F.col("salts")).cast("int").alias("salt"), F.col("upath").alias("at"), F.lit(1).alias("point"), "uhost", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack")
    )
    rule_rows = stacks.join(dealt, F.col("key") == F.col("skey")).select(
        "key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("rpath").alias("at"), F.lit(0).alias("point"), F.lit(None).cast("string").alias("uhost"), "stack"
    )
    sweep = Window.partitionBy("key", "salt").orderBy("at", "point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = (
        point_rows.unionByName(rule_rows)
        .withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
        .where("point = 1")
        .withColumn("top", F.try_element_at(F.filter("stack", lambda r: F.col("at").startswith(r["path"])), F.lit(-1)))
        .where(F.col("top").isNotNull())
    )
    rank = F.struct(F.length("top.rule").alias("n"), F.length("key").alias("h"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))
    best = swept.groupBy(F.col("uhost").alias(bhost), F.col("at").alias(bpath)).agg(F.max(rank).alias(found))
    return (
        parsed.join(best, (F.col("host") == F.col(bhost)) & (F.col("path") == F.col(bpath)), "left")
        .withColumn("rule", F.col(f"{found}.rule"))
        .withColumn("verdict", F.coalesce(F.col(f"{found}.verdict"), F.lit(default)))
        .drop(bhost, bpath, found)
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL = rf"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT page_id, arg_max((rhost || rpath, rverdict), (length(rhost || rpath), length(rhost))) AS best
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], '{DEFAULT}') AS verdict
FROM parsed LEFT JOIN fits USING (page_id)
"""
