"""Quality rules judged per document and per host.

Main path: DataFrame functions only.  Word and line counts are array expressions
inside one projection over the text, so the text is read once and never shuffled.
Only the counts (a few numbers a row) are stored, aggregated by host and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import let, read, small, stored

#: Java and RE2 both read this: the separators of words.
SPACE = r"[ \t-\r]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host whose shrunk failure rate exceeds this is rejected with all its documents.
HOST_LIMIT = 0.5
#: Strength of the prior when the hosts' rates do not vary at all.
FLAT_STRENGTH = 1e6


def words_of(text: Column) -> Column:
    """The runs of characters other than U+0020 and U+0009 to U+000D."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _repeat_words(words: Column) -> Column:
    """How many words lie in a five-word window that the text holds twice or more.

    Windows are compared by 64-bit hash within one text.
    """

    def covered(h: Column) -> Column:
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda e, i: F.coalesce(F.get(s, i)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(tagged, places), length)

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus the struct ``q`` of counts and ``base_failed``.

    A null or empty text has no words, so it fails.  Rows are independent: repeated
    ids, null ids and extra columns change nothing.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(source, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    counted = let(words_of(F.col(text)), counts)
    out = docs.withColumn("q", counted)
    q = F.col("q")
    out = out.withColumn(
        "q",
        F.struct(
            q["n_words"].alias("n_words"),
            q["word_chars"].alias("word_chars"),
            (F.length(source) - F.length(F.regexp_replace(source, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            q["n_repeat_words"].alias("n_repeat_words"),
            ((q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])).alias("base_failed"),
        ),
    )
    return out.drop(text)


def host_rates(counted: DataFrame, host: str, failed: Column) -> DataFrame:
    """Per host: ``host, host_docs, host_failed, host_rate``.

    The prior is a beta distribution fitted to the hosts' rates by moments: mean m =
    all failures / all documents, variance v = document-weighted variance of the
    rates, strength s = m (1 - m) / v - 1, at least 1 and ``FLAT_STRENGTH`` where v
    is 0.  The shrunk rate is (m s + failures) / (s + documents).  A null host is a
    host of its own.
    """
    hosts = counted.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(failed.cast("long")).alias("host_failed")
    )
    rate = F.col("host_failed") / F.col("host_docs")
    mean = hosts.agg((F.sum("host_failed") / F.sum("host_docs")).alias("m"))
    prior = (
        hosts.crossJoin(F.broadcast(mean))  # one row
        .agg(F.max("m").alias("m"), (F.sum(F.col("host_docs") * (rate - F.col("m")) * (rate - F.col("m"))) / F.sum("host_docs")).alias("v"))
        .select(
            "m",
            F.when(F.col("v") > 0, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0)))
            .otherwise(F.lit(FLAT_STRENGTH))
            .alias("s"),
        )
    )
    return hosts.crossJoin(F.broadcast(prior)).select(
        "host",
        "host_docs",
        "host_failed",
        ((F.col("m") * F.col("s") + F.col("host_failed")) / (F.col("s") + F.col("host_docs"))).alias("host_rate"),
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per input row: id, counts, ``base_failed``, ``host_rate``, ``kept``.

    A document is kept if it passes the base rules and its host's shrunk failure
    rate is at most ``HOST_LIMIT``.  An empty table gives an empty result.  Only the
    three named columns are read, so others may clash with any name used here.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(host).alias("host"), F.col(text).alias("text"))
    counted = stored(base_counts(slim), "quality-counts")
    hosts = stored(host_rates(counted, "host", F.col("q.base_failed")), "quality-hosts")
    verdicts = hosts.select(F.col("host").alias("h"), "host_rate")
    if small(verdicts, "h"):
        joined = counted.join(F.broadcast(verdicts), F.col("host").eqNullSafe(F.col("h")), "left")
    else:
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total = hosts.agg(F.sum("host_docs")).first()[0]
        # hosts with more than half a task's share: at most 2 * tasks of them
        salts = F.ceil(F.col("host_docs") * F.lit(2 * tasks) / F.lit(total)).cast("int")
        hot = F.broadcast(hosts.where(F.col("host_docs") * F.lit(2 * tasks) > F.lit(total)).select(F.col("host").alias("hot"), salts.alias("salts")))
        dealt = F.coalesce("salts", F.lit(1))
        salted = verdicts.join(hot, F.col("h").eqNullSafe(F.col("hot")), "left").select("h", "host_rate", F.explode(F.sequence(F.lit(0), dealt - 1)).alias("s"))
        keyed = counted.join(hot, F.col("host").eqNullSafe(F.col("hot")), "left").withColumn("salt", F.pmod(F.xxhash64("id", "q"), dealt).cast("int")).drop("hot", "salts")
        joined = keyed.join(salted, F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("s")), "left")
    return joined.select(
        F.col("id").alias(id_col),
        "q.*",
        F.round("host_rate", 6).alias("host_rate"),
        (~F.col("q.base_failed") & (F.col("host_rate") <= HOST_LIMIT)).alias("kept"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


SQL = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
grams AS (
  SELECT doc_id, i, words[i:i+4] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeats, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM judged GROUP BY source),
mean AS (SELECT sum(f)::DOUBLE / sum(n) AS m FROM hosts),
prior AS (
  SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE {FLAT_STRENGTH} END AS s
  FROM (SELECT max(m) AS m, sum(n * (f::DOUBLE / n - m) * (f::DOUBLE / n - m)) / sum(n) AS v FROM hosts, mean)),
rates AS (SELECT source, (m * s + f) / (s + n) AS host_rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(host_rate, 6) AS host_rate, (NOT base_failed AND host_rate <= {HOST_LIMIT}) AS kept
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""
