"""Fuzzy and tiered matching of names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import length_bound, ratio
from cadenza.operators.similarity import alike_pairs, best_alike
from cadenza.sources.files import lines, playlist_paths

def fuzzy_pairs(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float) -> DataFrame:
    """``a, b, score`` of names at least ``cutoff`` alike; pairs whose lengths rule that out are not compared."""
    pairs = alike_pairs(left.select(a).where(F.col(a).isNotNull()).distinct(), right.select(b).where(F.col(b).isNotNull()).distinct(), a, b, cutoff)
    return pairs.withColumn("score", ratio(F.col(a), F.col(b))).where(F.col("score") >= cutoff)


def best_match(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float) -> DataFrame:
    """For every ``a`` its best ``b``, the first of equals; names without one stay with nulls."""
    w = Window.partitionBy(a).orderBy(F.desc("score"), b)
    best = fuzzy_pairs(left, right, a, b, cutoff).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return left.select(a).distinct().join(best, a, "left")


def playlist_difference(one: DataFrame, two: DataFrame, name: str, cutoff: float = 0.6) -> DataFrame:
    """``name, match, score, side``: for every name of the second list its best in the first, and the first's names that none took."""
    best = best_match(two.select(F.col(name).alias("name")), one.select(F.col(name).alias("match")), "name", "match", cutoff).withColumn("side", F.lit("second"))
    rest = one.select(F.col(name).alias("name")).distinct().join(best.select(F.col("match").alias("name")), "name", "left_anti")
    return best.unionByName(rest.select("name", F.lit(None).cast("string").alias("match"), F.lit(None).cast("double").alias("score"), F.lit("first").alias("side")))


def tiered(wanted: DataFrame, have: DataFrame, cutoff: float = 0.85, others: bool = False) -> DataFrame:
    """``qid, hid, tier, score``: each wanted (title, album, artist) by all three, else by title and
    artist, else by 0.7 title and 0.3 album similarity above ``cutoff``; the smallest ``hid`` of equals.
    With ``others`` both are of one table and no row is its own match.

    Of the rows of ``have`` that no tier can tell apart the two smallest ids stay, before anything meets; each exact tier
    is an equi-join with these, and only what they leave is compared fuzzily, with titles that can make the cutoff."""
    names = ["title", "album", "artist"]

    def least(rows: DataFrame, keys: list[str], p: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("hid")
        return rows.withColumn("__n", F.row_number().over(w)).where("__n <= 2").select("hid", *[F.col(c).alias(p + c) for c in keys])

    other = F.col("qid") != F.col("hid") if others else F.lit(True)
    rows = have.select("hid", *names)
    three = least(rows, names, "h_")
    same = (F.col("title") == F.col("h_title")) & (F.col("artist") == F.col("h_artist"))
    score = F.lit(1.0).alias("score")
    first = wanted.join(three, same & F.col("album").eqNullSafe(F.col("h_album")) & other).select("qid", "hid", F.lit(1).alias("tier"), score)
    second = wanted.join(least(rows, ["title", "artist"], "h_"), same & other).select("qid", "hid", F.lit(2).alias("tier"), score)
    exact = first.unionByName(second)
    rest = wanted.join(exact.select("qid").distinct(), "qid", "left_anti")
    # a pair of (title, album) is compared once, however many rows have either
    pairs = alike_pairs(rest.select("title", "album").distinct(), rows.select(F.col("title").alias("h_title"), F.col("album").alias("h_album")).distinct(), "title", "h_title", (cutoff - 0.3) / 0.7)
    scored = pairs.withColumn("score", 0.7 * ratio(F.col("title"), F.col("h_title")) + 0.3 * ratio(F.col("album"), F.col("h_album"))).where(F.col("score") > cutoff)
    scored = scored.select(F.col("title").alias("t"), F.col("album").alias("l"), "h_title", "h_album", "score")
    ids = least(rows, ["title", "album"], "o_")
    near = rest.join(scored, (F.col("title") == F.col("t")) & F.col("album").eqNullSafe(F.col("l"))).join(ids, (F.col("h_title") == F.col("o_title")) & F.col("h_album").eqNullSafe(F.col("o_album")) & other)
    found = exact.unionByName(near.select("qid", "hid", F.lit(3).alias("tier"), "score"))
    w = Window.partitionBy("qid").orderBy("tier", F.desc("score"), "hid")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").select("qid", "hid", "tier", F.round("score", 6).alias("score"))


def name_matches(incoming: DataFrame, have: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """``qid, hid, score``: for each incoming (qid, artist, title) its best of ``have`` (hid, artist, title), if the mean of
    the artists' and the titles' ratios (lower case) is at least ``cutoff``; the smallest ``hid`` of equals."""
    low = lambda d, k, p: d.select(k, *[F.lower(F.coalesce(c, F.lit(""))).alias(p + c) for c in ("artist", "title")])
    new, old = low(incoming, "qid", "q_"), low(have, "hid", "h_")
    # every spelling is compared once, however many rows have it
    pairs = alike_pairs(new.select("q_artist", "q_title").distinct(), old.groupBy("h_artist", "h_title").agg(F.min("hid").alias("hid")), "q_title", "h_title", 2 * cutoff - 1)
    bound = length_bound(F.col("q_artist"), F.col("h_artist")) + length_bound(F.col("q_title"), F.col("h_title")) >= 2 * cutoff
    likely = pairs.where(bound)
    scored = likely.withColumn("score", (ratio(F.col("q_artist"), F.col("h_artist")) + ratio(F.col("q_title"), F.col("h_title"))) / 2)
    best = scored.where(F.col("score") >= cutoff).groupBy("q_artist", "q_title").agg(F.min(F.struct((-F.col("score")).alias("s"), "hid")).alias("b"))
    named = new.join(best.select(F.col("q_artist").alias("a"), F.col("q_title").alias("t"), "b"), (F.col("q_artist") == F.col("a")) & (F.col("q_title") == F.col("t")))
    return named.select("qid", F.col("b.hid").alias("hid"), (-F.col("b.s")).alias("score"))


def valid_match(title: Column, other_title: Column, artist_id: Column, other_artist_id: Column, cutoff: float = 0.8) -> Column:
    """Whether a found track is the wanted one: ``ok``, or what is wrong with it."""
    return F.when(~artist_id.eqNullSafe(other_artist_id), "artist").when(ratio(F.lower(title), F.lower(other_title)) < cutoff, "title").otherwise("ok")


def kinds_of(wanted: DataFrame, have: DataFrame, keys: list[str]) -> list[tuple[DataFrame, DataFrame, Column, list[str]]]:
    """Wanted rows by which keys they give, each with ``have`` exploded by these, the condition that both agree, and the exploded columns."""
    out = []
    given = {k: F.coalesce(F.col(k) != "", F.lit(False)) for k in keys}
    for kind in range(1, 1 << len(keys)):
        used = [k for i, k in enumerate(keys) if kind >> i & 1]
        rows = wanted.where(F.array_compact(F.array(*[F.when(given[k], F.lit(k)) for k in keys])) == F.array(*map(F.lit, used)))
        side, same = have, F.lit(True)
        for k in used:
            side = side.withColumn(f"__{k}", F.explode(F.array_distinct(F.transform(f"h_{k}", F.lower))))
            same = same & (F.lower(k) == F.col(f"__{k}"))
        out.append((rows, side, same, [f"__{k}" for k in used]))
    return out


def optional_keys(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of ``wanted`` and ``have`` (arrays of values a key) whose given keys agree, lower case; a null or empty wanted key fits all.

    Wanted rows are split by which keys they give, and each kind is an equi-join on its keys;
    a row that gives none matches nothing.
    """
    out = None
    for rows, side, same, inner in kinds_of(wanted, have, keys):
        met = rows.join(side, same).drop(*inner)
        out = met if out is None else out.unionByName(met)
    return out


def optional_key_counts(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """``qid, n, hid``: how many rows of ``have`` each wanted row finds by :func:`optional_keys`, and the smallest.

    ``have`` is counted by the keys of each kind before it meets anything, so a key that many rows share is one row.
    """
    out = None
    for rows, side, same, inner in kinds_of(wanted, have, keys):
        counts = side.groupBy(*inner).agg(F.count(F.lit(1)).alias("n"), F.min("hid").alias("hid"))
        met = rows.join(counts, same).select("qid", "n", "hid")
        out = met if out is None else out.unionByName(met)
    return out.groupBy("qid").agg(F.sum("n").alias("n"), F.min("hid").alias("hid"))


def search(query: str, fields: list[str], genre_field: str, artist_field: str = "") -> Column:
    """A search line as a predicate: ``,`` is or, ``+`` is and, ``@gen`` looks at the genre only and ``@art`` (if that
    field is named) at the artist; a leading "the " and empty terms are dropped."""
    mark = query.strip()[:4].lower()
    field = {"@gen": genre_field, "@art": artist_field or None}.get(mark)
    text = query.strip()[4:] if field else query
    haystack = F.lower(F.col(field) if field else F.concat_ws(" ", *fields))
    out = F.lit(False)
    for group in text.split(","):
        terms = [t.removeprefix("the ") for t in (x.strip().lower() for x in group.split("+")) if t]
        if terms:
            hit = F.lit(True)
            for t in terms:
                hit = hit & haystack.contains(t)
            out = out | hit
    return out


def playlist_query(query: str) -> tuple[int | None, str] | None:
    """The (first row, path) of ``@m3u path`` or ``@m3u-N path``; None if it is another query.  See :func:`cadenza.operators.sinks.excerpt`."""
    m = re.match(r"\s*@m3u(?:-(\d+))?\s+(.+?)\s*$", query, re.IGNORECASE)
    return (int(m[1]) if m[1] else None, m[2]) if m else None


def file_ids(files: DataFrame, tracks: DataFrame, path: str = "path", ident: str = "track_id", cutoff: int = 70) -> DataFrame:
    """``path, track_id, how``: the track that each file name means, null if none.

    An id of eight hex digits in brackets counts as it is; else a track whose id is the name without its ending, in any
    case; else the one whose id is most like the name, if more than ``cutoff`` (0 to 100); the smallest of equals.
    """
    base = F.regexp_extract(path, r"([^/\\\\]*)$", 1)
    stem = F.lower(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""))
    names = files.select(F.col(path).alias("path"), F.nullif(F.regexp_extract(base, r"\[([0-9A-Fa-f]{8})\]", 1), F.lit("")).alias("given"), stem.alias("name")).distinct()
    ids = tracks.select(F.col(ident).alias("id"), F.lower(ident).alias("low")).where("id is not null").groupBy("low").agg(F.min("id").alias("id"))
    rest = names.where("given is null").join(ids.withColumnRenamed("id", "same"), F.col("name") == F.col("low"), "left").drop("low")
    left = rest.where("same is null").select("name").distinct()
    best = best_alike(left, ids, cutoff).select(F.col("name").alias("n"), F.col("id").alias("alike"))
    found = rest.join(best, F.col("name") == F.col("n"), "left").select("path", F.coalesce("same", "alike").alias("track_id"), F.when(F.col("same").isNotNull(), "name").when(F.col("alike").isNotNull(), "alike").alias("how"))
    return names.where("given is not null").select("path", F.col("given").alias("track_id"), F.lit("given").alias("how")).unionByName(found)


def playlist_search(query: str, tracks: DataFrame, ident: str = "track_id") -> DataFrame | None:
    """The tracks of ``@m3u path`` (``@m3u-N path``: from its Nth file on) in the playlist's order: ``pos, path, track_id``; None if it is another query."""
    found = playlist_query(query)
    if found is None:
        return None
    first, path = found
    paths = playlist_paths(lines(tracks.sparkSession, path))
    rows = paths.select(F.row_number().over(Window.partitionBy("file").orderBy("line_no")).alias("pos"), F.trim("line").alias("path")).where(F.col("pos") >= (first or 1))
    named = file_ids(rows, tracks, "path", ident).select(F.col("path").alias("p"), "track_id")
    return rows.join(named, F.col("path") == F.col("p")).where("track_id is not null").select("pos", "path", "track_id")
