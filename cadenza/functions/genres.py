"""Genre codes: ``x`` and up to five pairs of hex digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 5


def code_pairs(code: Column) -> Column:
    return F.regexp_extract_all(F.lower(code), F.lit("([0-9a-f]{2})"), F.lit(1))


def encode(pairs: Column) -> Column:
    """An array of hex pairs as a code, cut to five."""
    return F.concat(F.lit("x"), F.array_join(F.slice(pairs, 1, MOST), ""))


def decode(df: DataFrame, code: str, key: str, taxonomy: DataFrame, out: str = "genres") -> DataFrame:
    """``key, out``: the comma-joined names of a code's pairs in order; a pair without a
    name reads ``Unknown(0x..)``.  ``taxonomy`` has ``hex`` and ``name``; codes that are not two
    hex digits cannot match, and of several names of one code the first counts, so at most
    256 rows are broadcast."""
    names = taxonomy.select(F.lower("hex").alias("pair"), "name").where(F.col("pair").rlike("^[0-9a-f]{2}$")).groupBy("pair").agg(F.min("name").alias("name"))
    pairs = df.select(F.col(key), F.posexplode(code_pairs(F.col(code))).alias("pos", "pair"))
    named = pairs.join(F.broadcast(names), "pair", "left")
    name = F.coalesce("name", F.concat(F.lit("Unknown(0x"), F.col("pair"), F.lit(")")))
    lists = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", name.alias("n")))).alias("l"))
    return lists.select(key, F.array_join(F.transform("l", lambda x: x["n"]), ", ").alias(out))


def split_list(c: Column) -> Column:
    """Comma-separated parts, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def normalized(df: DataFrame, genre: str, taxonomy: DataFrame, synonyms: DataFrame, out: str = "genre") -> DataFrame:
    """``df`` plus ``out``: the taxonomy's name (lower case) of a genre or of what ``synonyms`` (name, genre) says for it; ``''`` if it has none.

    Both tables are left for Spark to place: it broadcasts what it measured as small.
    """
    syn = synonyms.select(F.lower(F.trim("name")).alias("__s"), F.lower(F.trim("genre")).alias("__g")).groupBy("__s").agg(F.min("__g").alias("__g"))
    known = taxonomy.select(F.lower("name").alias("__k")).distinct()
    raw = df.withColumn("__r", F.lower(F.trim(genre))).join(syn, F.col("__r") == F.col("__s"), "left").withColumn("__r", F.coalesce("__g", "__r")).drop("__s", "__g")
    return raw.join(known, F.col("__r") == F.col("__k"), "left").withColumn(out, F.coalesce("__k", F.lit(""))).drop("__r", "__k")


def combined_vote(sources: list[DataFrame], key: str, genre: str, taxonomy: DataFrame, synonyms: DataFrame, top: int = MOST) -> DataFrame:
    """``key, genre, votes, rank`` of several sources (key, genre, pos): recognised genres by votes, then by where they came
    first, earlier sources before later ones and smaller ``pos`` first."""
    every = None
    for i, s in enumerate(sources):
        rows = s.select(key, F.col(genre).alias("__raw"), F.struct(F.lit(i).alias("s"), F.col("pos").cast("long").alias("p")).alias("__first"))
        every = rows if every is None else every.unionByName(rows)
    return vote(normalized(every, "__raw", taxonomy, synonyms, "__genre"), key, "__genre", "__first", top)


def vote(votes: DataFrame, key: str, genre: str, order: str, top: int = MOST) -> DataFrame:
    """``key, genre, votes, rank``: the ``top`` genres by votes, then by the first ``order`` they came with, then by name.

    Votes are counted before any row moves; a window sees one row a key and genre.
    """
    from pyspark.sql import Window

    counted = votes.where(F.col(genre).isNotNull() & (F.trim(genre) != "")).groupBy(key, F.lower(F.trim(genre)).alias("genre")).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), "first", "genre")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("first")
