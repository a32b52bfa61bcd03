"""Playlist and document writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.ranks import running_total


def playlist_lines(df: DataFrame, playlist: str, order: list[str], seconds: str, name: str, path: str) -> DataFrame:
    """``playlist, line_no, line``: a header, then an ``#EXTINF`` line and a path a track, in a sort that can spill.

    The header is exploded with the first track, not added by a union: all lines of a playlist are in one partition then and stay there.
    """
    n = F.row_number().over(Window.partitionBy(playlist).orderBy(*order)).cast("long")
    info = F.concat(F.lit("#EXTINF:"), F.col(seconds).cast("string"), F.lit(","), F.col(name))
    tracks = df.select(playlist, n.alias("n"), info.alias("i"), F.col(path).alias("p"))
    line = lambda no, text: F.struct(no.cast("long").alias("line_no"), text.alias("line"))
    both = F.array(line(2 * F.col("n") - 1, F.col("i")), line(2 * F.col("n"), F.col("p")))
    head = F.array(line(F.lit(0), F.lit("#EXTM3U")))
    return tracks.select(playlist, F.explode(F.when(F.col("n") == 1, F.concat(head, both)).otherwise(both)).alias("l")).select(playlist, "l.*")


def favourites_playlist(favourites: DataFrame, have: DataFrame, name: str, order: list[str], ident: str = "track_id") -> DataFrame:
    """``line_no, line`` of a playlist of the favourites that have a file (``have``: id, path; ids in any case, the smallest path of several), in order."""
    paths = have.select(F.lower("id").alias("__i"), "path").groupBy("__i").agg(F.min("path").alias("__path"))
    known = favourites.join(paths, F.lower(ident) == F.col("__i")).withColumn("__s", F.lit(-1))
    plain = [c for c in favourites.columns]
    numbered = running_total(known.select(*plain, "__path", "__s"), order, "__s", out="__t")
    info = F.concat(F.lit("#EXTINF:-1,"), F.col(name))
    both = F.explode(F.array(F.struct((2 * F.col("seq") - 1).alias("line_no"), info.alias("line")), F.struct((2 * F.col("seq")).alias("line_no"), F.col("__path").alias("line")))).alias("l")
    head = favourites.sparkSession.createDataFrame([(0, "#EXTM3U")], "line_no long, line string")
    return head.unionByName(numbered.select(both).select("l.*"))


def sections(parts: list[tuple[str, DataFrame]], name: str, path: str) -> DataFrame:
    """``section, pos, name, path`` of several lists one after another, each in order of the lower-case file name, then of the path, then of the name; rows without a path come last."""
    out = None
    for i, (title, rows) in enumerate(parts):
        base = F.lower(F.element_at(F.split(path, "/"), -1))
        one = rows.select(F.lit(i).alias("__i"), F.lit(title).alias("section"), F.col(name).alias("name"), F.col(path).alias("path"), F.col(path).isNull().alias("__e"), base.alias("__b"))
        out = one if out is None else out.unionByName(one)
    numbered = running_total(out.withColumn("__n", F.lit(1)), ["__i", "__e", "__b", "path", "name"], "__n", out="__t")  # by ranges, so a long section is no one task's
    first = out.groupBy(F.col("__i").alias("__k")).agg(F.count(F.lit(1)).alias("__c"))
    start = first.withColumn("__a", F.coalesce(F.sum("__c").over(Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a section
    joined = numbered.join(F.broadcast(start), F.col("__i") == F.col("__k"))
    return joined.select("section", (F.col("seq") - F.col("__a")).cast("int").alias("pos"), "name", "path")


def excerpt(df: DataFrame, playlist: str, order: list[str], start: int, n: int = 20) -> DataFrame:
    """The ``n`` rows of each playlist from row ``start`` (1 is the first) on, with ``row``."""
    w = Window.partitionBy(playlist).orderBy(*order)
    return df.withColumn("row", F.row_number().over(w)).where(F.col("row").between(start, start + n - 1))


def segments(df: DataFrame, playlist: str, order: list[str], value: str) -> DataFrame:
    """``playlist, value, next``: each row with the one after it."""
    w = Window.partitionBy(playlist).orderBy(*order)
    return df.select(playlist, F.col(value), F.lead(value).over(w).alias("next")).where("next is not null")


def write_lines(rows: DataFrame, path: str, value: str, order: list[str]) -> None:
    """One text file in order."""
    rows.orderBy(*order).select(F.col(value).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Lines of JSON, in order if asked; used for favourites, play logs and id maps."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").json(path)


def save_order(rows: DataFrame, path: str) -> None:
    """A cluster order (key, ord) as JSON, for :func:`load_order`."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def load_order(like: DataFrame, path: str) -> DataFrame:
    """A saved cluster order with the columns of ``like``."""
    return like.sparkSession.read.schema(like.schema).json(path)


def playlist_document(df: DataFrame, playlist: str, order: list[str], fields: list[str], duration: str) -> DataFrame:
    """``playlist, tracks, duration, document``: a JSON document a playlist, tracks in order."""
    item = F.struct(*order, *[c for c in fields if c not in order])
    per = df.groupBy(playlist).agg(F.array_sort(F.collect_list(item)).alias("t"), F.count(F.lit(1)).alias("tracks"), F.sum(duration).alias("duration"))
    return per.select(playlist, "tracks", "duration", F.to_json(F.struct(F.struct(F.col(playlist).cast("string").alias("title"), F.col("t").alias("track")).alias("playlist"))).alias("document"))


def write_playlists(rows: DataFrame, path: str, playlist: str) -> None:
    """One folder a playlist, its lines in order."""
    rows.repartition(playlist).sortWithinPartitions(playlist, "line_no").select(playlist, F.col("line").alias("value")).write.partitionBy(playlist).mode("overwrite").text(path)


def shuffled(df: DataFrame, key: str, ident: str, seed: int) -> DataFrame:
    """``key, id, pos``: each key's rows in an order that looks random and depends on the seed alone."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")))
    w = Window.partitionBy(key).orderBy(order, ident)
    return df.select(key, F.col(ident).alias("id"), F.row_number().over(w).alias("pos"))


def latest_first(df: DataFrame, key: str, time: Column, ident: str) -> DataFrame:
    """``key, id, pos``: by falling time, rows without one at the end."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(time), ident)
    return df.select(key, F.col(ident), F.row_number().over(w).alias("pos"))


def by_title(df: DataFrame, title: str, ident: str) -> DataFrame:
    """Playlists in the order of their titles, capitals like small letters; equal titles by id."""
    return df.orderBy(F.lower(title), title, ident)
