"""Catalogue operations: loading, upserts, reconciliation, completeness, voting, revisions, favourites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.shared import stored

TAGS = "map<string,string>"
#: Numbers of a disc that are listed one by one.
LISTED = 1000


def parse_tags(df: DataFrame, column: str = "tag_data", out: str = "tags") -> DataFrame:
    """JSON documents as a map of JSON texts; a damaged document gives an empty map."""
    clean = F.regexp_replace(column, r"[\x00-\x1F\x7F]", " ")
    return df.withColumn(out, F.coalesce(F.from_json(clean, TAGS), F.from_json(F.lit("{}"), TAGS)))


def first_value(tags: Column, key: str) -> Column:
    """A tag's first value, whether it is stored alone or in a list; null if missing."""
    value = F.try_element_at(tags, F.lit(key))
    return F.coalesce(F.try_element_at(F.from_json(value, "array<string>"), F.lit(1)), value)


def with_origin(catalogue: DataFrame, library: DataFrame, ident: str = "track_id") -> DataFrame:
    """Both tables with ``origin`` (cat, lib) and ``local_id``, which ids that start with ``xxx`` are."""
    both = catalogue.withColumn("origin", F.lit("cat")).unionByName(library.withColumn("origin", F.lit("lib")), allowMissingColumns=True)
    return both.withColumn("local_id", F.when(F.col(ident).startswith("xxx"), F.col(ident)))


def attach_vectors(tracks: DataFrame, vectors: DataFrame, ident: str = "track_id", fallback: str = "local_id") -> DataFrame:
    """Tracks with the vector of their id or, failing that, of their local id."""
    v = vectors.select(F.lower(F.trim("id")).alias("vid"), "embedding")
    one = tracks.join(v, F.lower(F.trim(ident)) == F.col("vid"), "left").drop("vid")
    two = v.select(F.col("vid").alias("vid2"), F.col("embedding").alias("other"))
    out = one.join(two, F.col("embedding").isNull() & (F.lower(F.trim(fallback)) == F.col("vid2")), "left")
    return out.withColumn("embedding", F.coalesce("embedding", "other")).drop("vid2", "other")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: partial aggregation, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(top).select(*keys, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def overlay(base: Column, over: Column, keep: list[str]) -> Column:
    """A map overlaid by another, but for the keys in ``keep``."""
    put = F.map_filter(over, lambda k, _: ~k.isin(keep))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(put), k)), put)


#: The keys that belong to a file and not to the track, and the ids that must all be there.
FILE_KEYS = [
    "----:com.apple.iTunes:Acoustid Fingerprint", "----:com.apple.iTunes:Acoustid Id", "----:com.apple.iTunes:replaygain_album_gain",
    "----:com.apple.iTunes:replaygain_album_peak", "----:com.apple.iTunes:replaygain_track_gain", "----:com.apple.iTunes:replaygain_track_peak",
]
ID_KEYS = ["----:com.apple.iTunes:MusicBrainz Artist Id", "----:com.apple.iTunes:MusicBrainz Track Id", "----:com.apple.iTunes:MusicBrainz Release Group Id"]
GENRE, WRITER, REVISION = "\u00a9gen", "\u00a9wrt", "----:com.apple.iTunes:metadata_rev"


def file_overlay(file: Column, known: Column, genres: str) -> Column:
    """A file's tags (map of JSON texts) overlaid by the catalogue's, but for :data:`FILE_KEYS`.

    The genre becomes the first of the catalogue's list ``genres``, the writer goes, and the revision is the catalogue's or ``AAA``.
    """
    out = overlay(file, known, FILE_KEYS)
    listed = F.from_json(F.try_element_at(known, F.lit(genres)), "array<string>")
    top = F.try_element_at(listed, F.lit(1))
    out = F.when(top.isNotNull(), overlay(out, F.create_map(F.lit(GENRE), F.to_json(F.array(top))), [])).otherwise(out)
    out = F.map_filter(out, lambda k, _: k != WRITER)
    return overlay(out, F.create_map(F.lit(REVISION), F.coalesce(F.try_element_at(known, F.lit(REVISION)), F.lit('"AAA"'))), [])


def id_overlay(file: Column, known: Column, more: list[str]) -> Column:
    """A file's tags with the catalogue's :data:`ID_KEYS`, genre and ``more`` keys, if the catalogue has all three ids; else as they are."""
    whole = F.lit(True)
    for k in ID_KEYS:
        whole = whole & ~F.coalesce(F.try_element_at(known, F.lit(k)), F.lit("")).isin("", '""', "null", "N/A", '"N/A"')
    put = F.map_filter(known, lambda k, _: k.isin([*ID_KEYS, GENRE, *more]))
    return F.when(whole, overlay(file, put, [])).otherwise(file)


def canonical(tags: Column, ignore: tuple[str, ...] = ()) -> Column:
    """A map as JSON with sorted keys, to compare by."""
    kept = F.map_filter(tags, lambda k, _: ~F.lower(k).isin(*ignore)) if ignore else tags
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, side``: keys that only one side has, ``missing`` on the right or ``extra`` there."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def completeness(df: DataFrame, album: str, number: str, disc: str | None = None, total: str | None = None) -> DataFrame:
    """``album, expected, present, missing, extra, status``.

    Each disc (null or no column: 1) is expected to have the numbers 1 to its declared
    ``total``, or, where nothing is declared, to its largest number.  ``missing`` and ``extra``
    list numbers, those of later discs as ``disc-number``; extra ones (bonus tracks) do not
    make an album incomplete, and there is no such column if no ``total`` is named.  Albums
    that expect nothing are left out.  Of a disc only the first :data:`LISTED` numbers are listed as
    missing, and ``...`` stands for the others, so one wrong number makes no long list; counts are of all.
    """
    d = F.coalesce(F.col(disc).cast("int"), F.lit(1)) if disc else F.lit(1)
    n = F.col(number).cast("int")
    declared = F.when(F.col(total).cast("int") > 0, F.col(total).cast("int")) if total else F.lit(None).cast("int")
    per = df.select(album, d.alias("d"), n.alias("n"), declared.alias("t")).where("n is not null").groupBy(album, "d").agg(F.max("t").alias("t"), F.max("n").alias("m"), F.collect_set("n").alias("have"))
    size = F.coalesce("t", "m")
    want = F.when(size >= 1, F.sequence(F.lit(1), F.least(size, F.lit(LISTED)))).otherwise(F.array().cast("array<int>"))
    name = lambda a: F.transform(F.array_sort(a), lambda x: F.struct(F.col("d"), x.alias("n")))
    fit = F.size(F.filter("have", lambda x: (x >= 1) & (x <= F.col("size"))))
    discs = per.withColumn("size", F.greatest(size, F.lit(0)).cast("long")).select(
        album, "have", "size", (F.col("size") - fit).alias("gone"), name(F.array_except(want, F.col("have"))).alias("miss"),
        name(F.filter("have", lambda x: (x > 0) & (x > F.col("size")))).alias("extra"),
    )
    sums = discs.groupBy(album).agg(
        F.sum("size").alias("expected"), F.sum(F.size("have")).cast("int").alias("present"), F.sum("gone").alias("gone"),
        F.array_sort(F.flatten(F.collect_list("miss"))).alias("miss"), F.array_sort(F.flatten(F.collect_list("extra"))).alias("more"),
    )
    sums = sums.withColumn("expected", F.least("expected", F.lit(2**31 - 1)).cast("int"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.when(x["d"] == 1, x["n"].cast("string")).otherwise(F.concat_ws("-", x["d"], x["n"]))), ",")
    cut = F.when(F.col("gone") > F.size("miss"), F.concat(text("miss"), F.lit(",..."))).otherwise(text("miss"))
    more = [text("more").alias("extra")] if total else []
    return sums.where("expected >= 1").select(album, "expected", "present", cut.alias("missing"), *more, F.when(F.col("gone") == 0, "complete").otherwise("incomplete").alias("status"))


def modal(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, distinct_values``: the commonest value, the least of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), value)).getField(value).alias(value), F.count(F.lit(1)).alias("distinct_values"))


def argmax_genre(votes: DataFrame, key: str, genre: str) -> DataFrame:
    """``key, genre, votes``: the genre with most votes, the alphabetically first of equals."""
    counts = votes.groupBy(key, genre).agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), genre)
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def next_revision(count: Column, previous_count: Column, alpha: Column) -> Column:
    """``nnnnnnnnn.AA``: the letters go up while the count stays (Z carries), else back to AA."""
    a, b = F.ascii(F.substr(alpha, F.lit(1), F.lit(1))), F.ascii(F.substr(alpha, F.lit(2), F.lit(1)))
    up = F.when(b < 90, F.concat(F.char(a), F.char(b + 1))).when(a < 90, F.concat(F.char(a + 1), F.lit("A"))).otherwise("AA")
    letters = F.when(count == previous_count, up).otherwise("AA")
    return F.concat_ws(".", F.lpad(count.cast("string"), 9, "0"), letters)


def favourites(df: DataFrame, artist: Column, album: Column, track: Column, options: set[int]) -> Column:
    """Which rows a choice of favourites keeps: 1 artists, 3 tracks, 2 takes favourite albums out (alone: keeps them only)."""
    if options == {2}:
        return album
    keep = F.lit(False)
    if 1 in options:
        keep = keep | artist
    if 3 in options:
        keep = keep | track
    return keep & ~album if 2 in options else keep


def merge_logs(old: DataFrame, new: DataFrame, keys: list[str], dedupe_new: bool = False) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks (nulls are equal); copies among the new ones stay unless ``dedupe_new``."""
    seen = old.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    fresh = new.join(seen, same, "left_anti")
    return old.unionByName(fresh.dropDuplicates(keys) if dedupe_new else fresh)


def best_tier(df: DataFrame, key: str, tier: Column, order: list) -> DataFrame:
    """``df`` plus ``tier`` and ``rank`` of the rows in each key's best tier."""
    w = Window.partitionBy(key).orderBy(*order)
    tiered = df.withColumn("tier", tier)
    best = tiered.groupBy(F.col(key).alias("tk")).agg(F.min("tier").alias("bt"))
    kept = tiered.join(best, (F.col(key) == F.col("tk")) & (F.col("tier") == F.col("bt"))).drop("tk", "bt")
    return kept.withColumn("rank", F.row_number().over(w))


def widen(df: DataFrame, tags: str) -> DataFrame:
    """One column a tag key, in order of the keys; the keys are collected first, at most 2000."""
    names = sorted(r[0] for r in df.select(F.explode(F.map_keys(tags))).distinct().limit(2001).collect())
    if len(names) > 2000:
        raise ValueError("more than 2000 tag keys")
    return df.select(*[c for c in df.columns if c != tags], *[F.col(tags)[n].alias(n) for n in names])


def write_csv(df: DataFrame, tags: str, path: str) -> None:
    """A table with one column a tag key (:func:`widen`) as CSV files with a header; missing tags are empty."""
    widen(df, tags).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def top_tokens(df: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """``key, token, uses, rank``: the ``n`` commonest lower-case words, the alphabetically first of equals."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))).alias("token"))
    counts = words.groupBy(key, "token").agg(F.count(F.lit(1)).alias("uses"))
    w = Window.partitionBy(key).orderBy(F.desc("uses"), "token")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def lookup(df: DataFrame, column: str, value: str, how: str = "exact") -> DataFrame:
    """The rows whose column equals, begins with (``prefix``) or holds (``part``) a value, in any case for the latter two."""
    if how == "exact":
        return df.where(F.col(column) == value)
    low = F.lower(F.col(column))
    return df.where(low.startswith(value.lower()) if how == "prefix" else low.contains(value.lower()))


def delete(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``df`` without the keys of ``gone``."""
    return df.join(gone.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def set_fields(df: DataFrame, changes: DataFrame, key: str, tags: str) -> DataFrame:
    """``df`` with the fields of ``changes`` (key, tags) put into its tag maps; keys without changes stay."""
    new = changes.select(F.col(key).alias("__k"), F.col(tags).alias("__t"))
    joined = df.join(new, F.col(key) == F.col("__k"), "left")
    merged = F.when(F.col("__t").isNull(), F.col(tags)).otherwise(overlay(F.coalesce(tags, F.from_json(F.lit("{}"), TAGS)), F.col("__t"), []))
    return joined.select(*[merged.alias(c) if c == tags else F.col(c) for c in df.columns])


def aliased(tags: Column, aliases: dict[str, str]) -> Column:
    """A map of arrays with each key in its canonical spelling (``aliases``: lower-case spelling to key); arrays that meet in one key are joined."""
    table = F.create_map(*[F.lit(x) for p in aliases.items() for x in p])
    named = F.transform(F.map_entries(tags), lambda e: F.struct(F.coalesce(F.try_element_at(table, F.lower(e["key"])), e["key"]).alias("key"), e["value"].alias("value")))
    keys = F.array_distinct(F.transform(named, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.flatten(F.transform(F.filter(named, lambda e: e["key"] == k), lambda e: e["value"])).alias("value"))))


def listed(tags: Column) -> Column:
    """A map of JSON texts as a map of arrays: a value that is no list becomes a list of one."""
    return F.transform_values(tags, lambda _, v: F.coalesce(F.from_json(v, "array<string>"), F.array(v)))


def decoded(tags: Column) -> Column:
    """A map of texts without cover art and without byte wrappers."""
    kept = F.map_filter(tags, lambda k, _: F.lower(k) != "covr")
    return F.transform_values(kept, lambda _, v: F.regexp_replace(v, r"^b(['\"])(.*)\1$", "$2"))


def origin(cat: Column, lib: Column) -> Column:
    """Where a row is from, by which of two ids it has: both, cat, lib or unknown."""
    return F.when(cat.isNotNull() & lib.isNotNull(), "both").when(cat.isNotNull(), "cat").when(lib.isNotNull(), "lib").otherwise("unknown")


def owned(df: DataFrame, column: str, kind: str) -> DataFrame:
    """The rows of an ownership: ``cat`` or ``lib`` (in one, wherever else), ``mat`` (in both), ``nom`` (in the library only), ``noo`` (in the catalogue, not owned)."""
    kinds = {"cat": ("cat", "both"), "lib": ("lib", "both"), "mat": ("both",), "nom": ("lib",), "noo": ("cat",)}
    return df.where(F.col(column).isin(*kinds[kind]))


def existing(df: DataFrame, path: Column, other: Column, files: DataFrame) -> DataFrame:
    """The rows whose path, in either spelling, is among ``files`` (path)."""
    have = files.select(F.col("path").alias("__f")).where("__f is not null").distinct()
    named = df.withColumn("__p", path).withColumn("__o", other)
    one = named.join(have, F.col("__p") == F.col("__f"), "left_semi")
    rest = named.join(have, F.col("__p") == F.col("__f"), "left_anti").join(have, F.col("__o") == F.col("__f"), "left_semi")
    return one.unionByName(rest).drop("__p", "__o")


def either(df: DataFrame, tests: list[tuple[list[str], DataFrame]], out: str) -> DataFrame:
    """``df`` plus whether a row's keys are in any of several tables: one semi-join a test, not a join with OR.  Null keys are in none."""
    hit = F.lit(False)
    for i, (keys, table) in enumerate(tests):
        side = table.select(*[F.col(k).alias(f"__{i}_{k}") for k in keys]).distinct().withColumn(f"__h{i}", F.lit(True))
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"__{i}_{k}"))
        df = df.join(side, same, "left").drop(*[f"__{i}_{k}" for k in keys])
        hit = hit | F.coalesce(F.col(f"__h{i}"), F.lit(False))
    return df.withColumn(out, hit).drop(*[f"__h{i}" for i in range(len(tests))])


def first_of(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each key; partial aggregation."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    top = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(*named).agg(top).select("r.*")


def album_order(disc: str, track: str) -> list[Column]:
    """The order of an album's tracks: disc (1 if there is none), then track (0)."""
    return [F.coalesce(F.col(disc), F.lit(1)), F.coalesce(F.col(track), F.lit(0))]


def oldest_year(years: Column) -> Column:
    """The least of an array's four-digit years."""
    return F.array_min(F.filter(years, lambda y: y.rlike(r"^\d{4}$")))


def shared(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``df`` with each of ``values`` (as of an album) replaced by the largest of its key, so that all members have it."""
    tops = df.groupBy(F.col(key).alias("__k")).agg(*[F.max(v).alias(f"__{v}") for v in values])
    return df.join(tops, F.col(key).eqNullSafe(F.col("__k"))).select(*[F.col(f"__{c}").alias(c) if c in values else F.col(c) for c in df.columns])


def folders(df: DataFrame, path: str) -> DataFrame:
    """``folder, files, first``: how many files each folder holds, and the first by name."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    return df.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.min(path).alias("first"))


def best_score(df: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """The row of each key with the highest score above 0, the first by ``order`` of equals; keys without one are left out."""
    rest = [c for c in df.columns if c != key]
    top = F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), order)).alias("r")
    return df.where(F.col(score) > 0).groupBy(key).agg(top).select(key, "r.*")


def release_groups(df: DataFrame, artist: Column) -> DataFrame:
    """The candidates (primary, secondary, credit) that can be an artist's own album, EP or single: none of the secondary types
    live, remix, compilation, video, and the artist in the credit."""
    second = F.transform(F.coalesce("secondary", F.array().cast("array<string>")), lambda s: F.lower(F.trim(s)))
    own = F.coalesce(F.lower("credit"), F.lit("")).contains(F.lower(artist))
    return df.where(~F.arrays_overlap(second, F.array(*map(F.lit, ("live", "remix", "compilation", "video")))) & F.lower(F.trim("primary")).isin("album", "ep", "single") & own)


def earliest_release(df: DataFrame, key: str, formats: str, year: str, ident: str) -> DataFrame:
    """Each key's release: those with a medium ``digital media`` or ``cd`` first, then the earliest year, then the smallest id."""
    wanted = F.arrays_overlap(F.transform(F.coalesce(formats, F.array().cast("array<string>")), lambda f: F.lower(F.trim(f))), F.array(F.lit("digital media"), F.lit("cd")))
    rest = [c for c in df.columns if c != key]
    rank = F.struct((~wanted).alias("w"), F.coalesce(F.col(year), F.lit(9999)).alias("y"), F.col(ident).alias("i"))
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("r")).select(key, "r.*")


def chosen_groups(df: DataFrame, key: str) -> DataFrame:
    """Of :func:`release_groups` (score, primary, first_date, ident) the best of each key: score, then album before EP before single, then date."""
    kind = F.array_position(F.array(*map(F.lit, ("album", "ep", "single"))), F.lower(F.trim("primary")))
    rank = F.struct((-F.col("score")).alias("s"), kind.alias("k"), F.coalesce("first_date", F.lit("9999-99-99")).alias("d"), F.col("ident").alias("i"))
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("r")).select(key, "r.*")


# ---------------------------------------------------------------- imports
CONFLICTS = ("new_id", "update", "keep")


def make_ids(df: DataFrame, keys: list[str], taken: DataFrame, ident: str = "track_id", digits: int = 8) -> DataFrame:
    """``df`` plus ``ident``: the first ``digits`` hex digits, in capitals, of a hash of the keys and of a row's number among equal keys.

    Ids that are taken, or that two rows get, are made anew with the next salt until none is left.  Every round is stored, so a
    round costs its own rows only; more rows than half of all ids are refused before the first.
    """
    by = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes if c not in keys]  # maps have no order of their own
    w = Window.partitionBy(*keys).orderBy(*(by or [F.lit(1)]))
    text = F.concat_ws("\0", *[F.coalesce(F.col(k).cast("string"), F.lit("\1")) for k in keys], F.row_number().over(w).cast("string"))
    rows = stored(df.withColumn("__t", text), "unnamed")
    used = stored(taken.select(F.col(ident).alias("__u")), "used")
    if rows.count() + used.count() > 16**digits // 2:
        raise ValueError(f"too many rows for ids of {digits} digits")
    done, salt = None, 0
    while True:
        made = rows.withColumn(ident, F.upper(F.left(F.sha2(F.concat_ws("\0", "__t", F.lit(str(salt))), 256), F.lit(digits))))
        first = made.groupBy(ident).agg(F.min("__t").alias("__f"))
        free = first.join(used, F.col(ident) == F.col("__u"), "left_anti").withColumnRenamed(ident, "__i")
        named = made.join(free, (F.col(ident) == F.col("__i")) & (F.col("__t") == F.col("__f")), "left").drop("__f")
        named = stored(named, "named")
        good = named.where("__i is not null").drop("__i")
        done = good if done is None else done.unionByName(good)
        rows = named.where("__i is null").drop("__i", ident)
        if rows.isEmpty():
            return done.drop("__t")
        used, salt = used.unionByName(good.select(F.col(ident).alias("__u"))), salt + 1


def import_batch(catalogue: DataFrame, incoming: DataFrame, keys: list[str], on_conflict: str = "new_id", ident: str = "track_id", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalogue after the import, incoming rows that were there already, with ``existing``).

    A row is there if its keys, lower case and trimmed, are; the smallest id counts.  ``on_conflict``:
    ``new_id`` adds it as another track, ``update`` puts its values under the id there, ``keep``
    leaves the catalogue as it is.  Without keys (all null or empty) a row is always new.  Both
    tables have the same columns; ids of incoming rows are made here.  Of several incoming rows for one
    id the last by ``order`` (a further column of ``incoming``) is put there; without it, or of equals, the greatest by its values.
    """
    if on_conflict not in CONFLICTS:
        raise ValueError(f"on_conflict is one of {CONFLICTS}")
    norm = [F.lower(F.trim(F.coalesce(F.col(k).cast("string"), F.lit("")))) for k in keys]
    name = F.when(F.concat(*norm) != "", F.concat_ws("\0", *norm))
    have = catalogue.select(name.alias("__n"), ident).where("__n is not null").groupBy("__n").agg(F.min(ident).alias("existing"))
    plain = incoming.drop(ident)
    matched = plain.withColumn("__m", name).join(have, F.col("__m") == F.col("__n"), "left").drop("__m", "__n")
    duplicates = matched.where("existing is not null")
    matched = matched.drop(order) if order else matched
    new = (matched if on_conflict == "new_id" else matched.where("existing is null")).drop("existing")
    out = catalogue.unionByName(make_ids(new, [c for c in plain.columns if c in keys], catalogue, ident).select(*catalogue.columns))
    if on_conflict == "update":
        rest = [c for c in plain.columns if c != order]
        by = F.struct(*([order] if order else []), *[F.to_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in plain.dtypes if c != order])
        last = duplicates.groupBy(F.col("existing").alias(ident)).agg(F.max_by(F.struct(*rest), by).alias("r")).select(ident, "r.*").select(*catalogue.columns)
        out = upsert(out, last, ident)
    return out, duplicates


def import_run(catalogue: DataFrame, incoming: DataFrame, keys: list[str], previous: tuple[int, str], on_conflict: str = "new_id", ident: str = "track_id", order: str | None = None, known: DataFrame | None = None, tags: str = "tags", genres: str = "genres") -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`import_batch` of rows that are enriched first, and the catalogue's next revision: one row (tracks, revision), from the count and letters before.

    ``known`` has ``tags`` (maps) for the same keys, from wherever: they are put over those of the incoming rows by
    :func:`file_overlay`; of several rows of a key the first in order of its tags as JSON.
    """
    if known is not None:
        norm = F.concat_ws("\0", *[F.lower(F.trim(F.coalesce(F.col(k).cast("string"), F.lit("")))) for k in keys])
        found = known.select(norm.alias("__k"), F.col(tags).alias("__t")).groupBy("__k").agg(F.min_by("__t", canonical(F.col("__t"))).alias("__t"))
        joined = incoming.withColumn("__n", norm).join(found, F.col("__n") == F.col("__k"), "left")
        richer = F.when(F.col("__t").isNull(), F.col(tags)).otherwise(file_overlay(F.coalesce(F.col(tags), F.from_json(F.lit("{}"), TAGS)), F.col("__t"), genres))
        incoming = joined.select(*[richer.alias(c) if c == tags else F.col(c) for c in incoming.columns])
    after, twice = import_batch(catalogue, incoming, keys, on_conflict, ident, order)
    revision = after.agg(F.count(F.lit(1)).alias("tracks")).select("tracks", next_revision(F.col("tracks"), F.lit(previous[0]), F.lit(previous[1])).alias("revision"))
    return after, twice, revision


def import_favourites(saved: DataFrame, incoming: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``artist, album, track, track_id`` of saved favourites and of those that a playlist adds.

    Of incoming rows (artist, album, track, pos) the first of each key (:func:`text.match_key`) counts.  Each gets the smallest
    catalogue id (artists, albums, tracks, track_id) whose given fields agree; null if none does.  Rows whose key or
    id is saved already are left out.
    """
    from cadenza.functions.text import match_key
    from cadenza.operators.matching import optional_key_counts

    fields = ["artist", "album", "track"]
    first = first_of(incoming.select(*fields, "pos"), [match_key(F.coalesce(F.col(c), F.lit(""))) for c in fields], ["pos", *fields])
    have = catalogue.select(F.col("track_id").alias("hid"), F.col("artists").alias("h_artist"), F.col("albums").alias("h_album"), F.col("tracks").alias("h_track"))
    found = optional_key_counts(first.withColumnRenamed("pos", "qid"), have, fields).select(F.col("qid").alias("__p"), F.col("hid").alias("track_id"))
    named = first.join(found, F.col("pos") == F.col("__p"), "left").drop("__p")
    key = lambda d: F.concat_ws("\0", *[match_key(F.coalesce(d[c], F.lit(""))) for c in fields])
    new = named.withColumn("__k", key(named)).join(saved.select(key(saved).alias("__s")).distinct(), F.col("__k") == F.col("__s"), "left_anti")
    new = new.join(saved.select(F.col("track_id").alias("__i")).where("__i is not null").distinct(), F.col("track_id") == F.col("__i"), "left_anti")
    return saved.select(*fields, "track_id").unionByName(new.select(*fields, "track_id"))


def save_favourites(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Favourites after an update, the new ones in place of the old of the same keys, in lower-case order of the keys."""
    same = F.lit(True)
    for k in keys:
        same = same & F.lower(F.col(k)).eqNullSafe(F.col(f"__{k}"))
    kept = old.join(new.select(*[F.lower(k).alias(f"__{k}") for k in keys]).distinct(), same, "left_anti")
    return kept.unionByName(new).orderBy(*[F.lower(k) for k in keys], *keys)


def broken_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """The links (link, target) whose target is no file (path)."""
    return links.join(files.select(F.col("path").alias("__f")).distinct(), F.col("target") == F.col("__f"), "left_anti")


def unmatched_files(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """``path, state``: files (path, track_id) without an id (``untagged``) or with one that no track has (``unmatched``)."""
    lone = files.where("track_id is not null").join(tracks.select(F.col("track_id").alias("__t")).distinct(), F.col("track_id") == F.col("__t"), "left_anti")
    return files.where("track_id is null").select("path", F.lit("untagged").alias("state")).unionByName(lone.select("path", F.lit("unmatched").alias("state")))
