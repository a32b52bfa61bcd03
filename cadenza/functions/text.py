"""Text normalisation, parsing and string similarity."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_value(c: Column) -> Column:
    r"""Trimmed, lower case, without ``\ / : * ? " < > |``."""
    return F.regexp_replace(F.lower(F.trim(c)), r'[\\/:*?"<>|]', "")


def normalize_tag(c: Column) -> Column:
    """As :func:`normalize_value`, with runs of white space as one space."""
    return F.trim(F.regexp_replace(normalize_value(c), r"\s+", " "))


def without_article(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "(?i)^the ", "")


def safe_name(c: Column, limit: int) -> Column:
    """A file or folder name: runs of other characters as ``_``, at most ``limit`` long, no ``_``, ``-`` or space at a cut end."""
    plain = F.regexp_replace(c, r"[^A-Za-z0-9 _-]+", "_")
    return F.when(F.length(plain) > limit, F.regexp_replace(F.left(plain, F.lit(limit)), "[_ -]+$", "")).otherwise(plain)


def track_filename(disc: Column, track: Column, ident: Column, title: Column) -> Column:
    return F.format_string("%d-%02d [%s] - %s.m4a", disc, track, ident, title)


def leading_year(c: Column) -> Column:
    """The four digits a date begins with, or null."""
    return F.regexp_extract(c, r"^(\d{4})", 1).try_cast("int")


def parse_of_total(c: Column) -> Column:
    """``n/total`` as a struct of two integers, 0 where missing."""
    part = lambda k: F.coalesce(F.trim(F.split_part(c, F.lit("/"), F.lit(k))).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("num"), part(2).alias("total"))


def parse_gain(c: Column) -> Column:
    """The number of ``-7.3 dB`` or ``0.98``."""
    return F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def unwrap_bytes(c: Column) -> Column:
    """``b'...'`` without its wrapper."""
    return F.regexp_replace(c, r"^b(['\"])(.*)\1$", "$2")


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """NFKD without what is not ASCII."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def match_key(c: Column) -> Column:
    """The key that favourites are compared by: ASCII, lower case, letters, digits and ``_`` only."""
    return F.regexp_replace(F.lower(ascii_fold(c)), r"\W+", "")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity, 0 to 1, in the given order."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def token_set(a: str, b: str) -> float:
    one, two = set(a.lower().split()), set(b.lower().split())
    both = " ".join(sorted(one & two))
    left, right = (" ".join([both, *sorted(x)]).strip() for x in (one - two, two - one))
    if both and (not one - two or not two - one):
        return 1.0
    pairs = ((both, left), (both, right), (left, right))
    return max(SequenceMatcher(None, x, y).ratio() for x, y in pairs if x or y) if left or right else 0.0


@F.pandas_udf(T.IntegerType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: the best ratio among the shared tokens and either side's sorted tokens."""
    return pd.Series([None if x is None or y is None else round(100 * token_set(x, y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def length_bound(a: Column, b: Column) -> Column:
    """The most that :func:`ratio` can be, from the lengths."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 2.0 * F.least(F.length(a), F.length(b)) / total).otherwise(1.0)


@F.pandas_udf(T.StringType())
def compatible(s: pd.Series) -> pd.Series:
    """NFKD."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def normalize_title(c: Column) -> Column:
    """A title to compare by: lower case, NFKD, ``number N`` as ``#N``, typographic signs as plain ones, single spaces, and only
    letters, digits, ``_ # / : . -`` and spaces; null as empty."""
    out = compatible(F.lower(F.coalesce(c, F.lit(""))))
    folds = ((r"number\s+(\d+)", "#$1"), ("\u2044", "/"), ("\u2236", ":"), ("\u2024\u2024\u2024", "..."), ("\u2019", "'"), ("[\u201c\u201d]", '"'), (r"(?U)\s+", " "))
    for pattern, by in folds:
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_replace(F.regexp_replace(out, "^ | $", ""), r"(?U)[^\w\s#/:.-]", "")


def directory_name(c: Column, limit: int = 50, plain: bool = False) -> Column:
    """A folder name as :func:`safe_name`; with ``plain`` from the ASCII letters only."""
    return safe_name(ascii_fold(c) if plain else c, limit)


def sanitize_filename(c: Column, strip: bool = True) -> Column:
    r"""A file name with ``_`` for each of ``\ / * ? : " < > |``."""
    out = F.regexp_replace(c, r'[\\/*?:"<>|]', "_")
    return F.trim(out) if strip else out


@F.pandas_udf(T.IntegerType())
def percent_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`ratio` from 0 to 100, rounded half to even."""
    return pd.Series([None if x is None or y is None else round(100 * SequenceMatcher(None, x, y).ratio()) for x, y in zip(a, b, strict=True)], dtype="Int32")


def split_artist_title(c: Column) -> Column:
    """``Artist - Title`` as a struct (artist, title), split at the first ``" - "``; without one all is the artist."""
    parts = F.split(c, " - ", 2)
    return F.struct(F.trim(F.element_at(parts, 1)).alias("artist"), F.trim(F.try_element_at(parts, F.lit(2))).alias("title"))


def guess_artist_title(one: Column, two: Column, file: Column, dir1: Column, dir2: Column) -> Column:
    """Which of two names is the artist, as a struct (artist, title).

    The artist is more like the two folders (weight 2) and less like the file.  A single
    name is the title if it is at least as like the file as either folder.  Nulls where undecided.
    """
    like = lambda a, b: ratio(F.lower(a), F.lower(F.coalesce(b, F.lit(""))))
    score = lambda x: 2.0 * (like(x, dir1) + like(x, dir2)) + 1.0 - like(x, file)
    some = lambda x: F.when(x != "", x)
    single = F.coalesce(some(one), some(two))
    is_title = like(single, file) >= F.greatest(like(single, dir1), like(single, dir2))
    none = F.lit(None).cast("string")
    pair = lambda a, t: F.struct(a.alias("artist"), t.alias("title"))
    alone = F.when(single.isNull(), pair(none, none)).when(is_title, pair(none, single)).otherwise(pair(single, none))
    both = F.when(F.lower(F.trim(one)) == F.lower(F.trim(two)), pair(one, two)).when(score(one) > score(two), pair(one, two)).when(score(two) > score(one), pair(two, one)).otherwise(pair(none, none))
    return F.when(some(one).isNull() | some(two).isNull(), alone).otherwise(both)


def title_case(c: Column) -> Column:
    """A key for display: spaces for ``_``, and every run of cased letters with a capital first, also after an apostrophe or a digit."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    parts = F.regexp_extract_all(F.regexp_replace(c, "_", " "), F.lit(f"([{cased}]+|[^{cased}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, F.initcap), "")


def shortened(c: Column, limit: int = 250) -> Column:
    """At most ``limit`` characters, longer texts with ``...`` at the end."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))).otherwise(c)


def relative_path(path: Column, root: str, up: str = "../..") -> Column:
    """A path below ``root`` as seen from a folder beside it; other paths as they are."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.concat(F.lit(up + "/"), F.substr(path, F.lit(len(base) + 1)))).otherwise(path)


def chord_root(c: Column) -> Column:
    """The root of a chord label, as ``C#`` of ``C#m7/G``; null if there is none."""
    root = F.regexp_extract(c, "^([A-G](?:#|b)?)", 1)
    return F.when(root != "", root)


def year_or_last(c: Column) -> Column:
    """:func:`leading_year`, or all of a longer year before a ``-``; 9999 where there is none, so that it sorts last."""
    return F.coalesce(F.regexp_extract(c, r"^(\d{5,})-", 1).try_cast("int"), leading_year(c), F.lit(9999))


def shown_time(c: Column, pattern: str) -> Column:
    """A time by the pattern, without the sign that it puts before years of more than four digits."""
    return F.regexp_replace(F.date_format(c, pattern), r"^\+", "")


def epoch_text(c: Column) -> Column:
    """Seconds since 1970 as ``yyyy-MM-dd HH:mm:ss`` in the session's time zone; null if they are no number."""
    return shown_time(F.timestamp_seconds(c.try_cast("long")), "yyyy-MM-dd HH:mm:ss")


def parse_time(c: Column) -> Column:
    """A ``yyyy-MM-dd HH:mm:ss`` text as a timestamp, years of more than four digits too; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(c, r"^(?=\d{5,}-)", "+"), F.lit("yyyy-MM-dd HH:mm:ss"))


def stamp(c: Column, file: bool = False) -> Column:
    """A timestamp in ISO form, or as part of a file name."""
    return shown_time(c, "yyyyMMdd_HHmmss" if file else "yyyy-MM-dd'T'HH:mm:ss'Z'")


def whole_seconds(ms: Column) -> Column:
    return F.floor(ms / 1000).cast("long")


def rounded_seconds(seconds: Column) -> Column:
    """Half to even."""
    return F.bround(seconds).cast("long")


def ticks(seconds: Column, per_second: Column | float) -> Column:
    """Whole ticks, cut."""
    return (seconds * per_second).cast("long")


def bytes_of(gigabytes: Column) -> Column:
    """A limit in GB as bytes, in powers of 1024; what is shown (:func:`shown_gb`) is in powers of 1000."""
    return (gigabytes * 1024**3).cast("long")


def shown_gb(size: Column) -> Column:
    return F.round(size / 1e9, 2)


def id_in_name(c: Column) -> Column:
    """The eight hex digits in brackets of a file name, in capitals; null if there are none."""
    found = F.regexp_extract(c, r"\[([0-9A-Fa-f]{8})\]", 1)
    return F.when(found != "", F.upper(found))


def codec(c: Column) -> Column:
    """The codec that a probe's text names after ``Audio:``."""
    name = F.lower(F.regexp_extract(c, r"(?i)Audio:\s+([^\s,]+)", 1))
    return F.when(name.contains("alac"), "ALAC").when(name.contains("aac") | name.contains("mp4a"), "AAC").when(name.contains("flac"), "FLAC").otherwise("Unknown")


def path_part(path: Column, back: int) -> Column:
    """The part of a path that is ``back`` parts from its end (1: the file name); null if it is not that deep."""
    return F.try_element_at(F.split(path, "/"), F.lit(-back))


def filled_from_path(title: Column, album: Column, artist: Column, path: Column) -> Column:
    """Missing (null or empty) title, album and artist from the file name without its extension and the two folders above."""
    some = lambda c: F.when(F.trim(c) != "", c)
    name = F.regexp_replace(path_part(path, 1), r"\.[^.]*$", "")
    return F.struct(F.coalesce(some(title), name).alias("title"), F.coalesce(some(album), path_part(path, 2)).alias("album"), F.coalesce(some(artist), path_part(path, 3)).alias("artist"))


def artist_title_of_path(path: Column) -> Column:
    """Artist (the folder two above) and title (what follows the last ``" - "`` in the file name) of a path."""
    name = F.regexp_replace(path_part(path, 1), r"\.[^.]*$", "")
    return F.struct(path_part(path, 3).alias("artist"), F.trim(F.element_at(F.split(name, " - "), -1)).alias("title"))


def remote_item(kind: Column, title: Column, parent: Column, grandparent: Column, updated: Column, added: Column) -> Column:
    """A remote item as a struct (artist, album, track, last_played, media_type), by its type."""
    text = lambda c: F.coalesce(c, F.lit(""))
    album, playlist, empty = kind == "album", kind == "playlist", F.lit("")
    return F.struct(
        F.when(album, text(parent)).when(playlist, empty).otherwise(text(grandparent)).alias("artist"),
        F.when(album, text(title)).when(playlist, empty).otherwise(text(parent)).alias("album"),
        F.when(album, empty).otherwise(text(title)).alias("track"),
        epoch_text(F.coalesce(updated, added)).alias("last_played"),
        text(kind).alias("media_type"),
    )


def number_mismatch(track: Column, tracks: Column, disc: Column, discs: Column, new_track: Column, new_tracks: Column, new_disc: Column, new_discs: Column) -> Column:
    """``unset`` if nothing was set, ``full`` if a number differs, ``partial`` if only a total does, else ``none``."""
    unset = (track == 0) & (tracks == 0) & (disc == 0) & (discs == 0)
    full, partial = (track != new_track) | (disc != new_disc), (tracks != new_tracks) | (discs != new_discs)
    return F.when(unset, "unset").when(full, "full").when(partial, "partial").otherwise("none")


def failure_kind(path: Column, root: str, exists: Column) -> Column:
    return F.when(~path.startswith(root.rstrip("/") + "/"), "outside").when(~exists, "missing").otherwise("ok")


def without_prefix(c: Column, prefix: str = "plex://track/") -> Column:
    """An id without the prefix of the service that gave it; others as they are."""
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)
