"""Operators on small fixtures with answers worked out by hand."""

from __future__ import annotations

import random
import sqlite3
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import genres, text
from cadenza.operators import catalogue, clusters, matching, neighbors, sinks, timeseries
from cadenza.plans import library, queries
from cadenza.sources import files
from cadenza.streaming import playlog

VECTORS = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "id long, embedding array<double>").withColumn("k", F.lit("a"))


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_nearest(vectors):
    assert rows(neighbors.nearest(vectors, vectors), "id") == [(1, 2, 0.8), (2, 1, 0.8), (3, 2, 0.6)]


def test_nearest_of_nothing(vectors):
    assert rows(neighbors.nearest(vectors, vectors.where("false"))) == []


def test_centroid_and_breadth(vectors):
    some = vectors.where("id in (1, 3)")
    assert rows(clusters.centroids(some, "k", "embedding")) == [("a", [0.5, 0.5])]
    assert rows(clusters.breadth(some, "k", "embedding"))[0][1] == pytest.approx(0.5**0.5)


def test_like(vectors):
    got = dict((r[0], r[2]) for r in rows(clusters.like(vectors, vectors.where("id = 1"), "id", "embedding")))
    assert got == {1: 1.0, 2: 0.8, 3: 0.0, 4: 0.0, 5: 0.0}
    none = clusters.like(vectors, vectors.where("false"), "id", "embedding")
    assert {r[2] for r in rows(none)} == {0.0}


def test_chain(vectors):
    assert rows(clusters.chain(vectors, "id", "k", "embedding").select("id", "pos"), "pos") == [(1, 1), (2, 2), (3, 3)]


def test_refine_limits(spark):
    df = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 1.0]), (3, None, [0.8, 0.6]), (4, None, None)], "id long, k string, v array<double>")
    got = dict((r[0], r[1]) for r in rows(clusters.refine(df, "id", "k", "v", 0.2)))
    assert got == {1: "x", 2: "y", 3: "x", 4: "outliers"}


def test_merge_is_strict():
    c = [("a", [1.0, 0.0], 1.0, ["t"]), ("b", [0.8, 0.6], 1.5, ["t"]), ("c", [1.0, 0.0], 1.0, ["u"])]
    assert clusters.merge_plan(c, 0.7, 0.4) == {"a": "a", "b": "a", "c": "c"}
    assert clusters.merge_plan(c, 0.8, 0.4)["b"] in ("b",)


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 1)], "p long, s long")
    assert rows(timeseries.within_budget(df, "p", "s", 9).select("p", "label")) == [(1, "000001")]


def test_islands(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1, 1, 0, 1])], "k string, t long, f int")
    assert rows(timeseries.islands(df, "k", ["t"], F.col("f") == 1, "t", "t"), "first") == [("a", 0, 1, 2), ("a", 3, 3, 1)]


def test_completeness(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 1)], "al string, n int")
    assert rows(catalogue.completeness(df, "al", "n"), "al") == [("a", 4, 3, "3", "incomplete"), ("b", 1, 1, "", "complete")]


def test_revision(spark):
    df = spark.createDataFrame([(2, 2, "AA"), (2, 2, "AZ"), (3, 2, "AB")], "n long, p long, a string")
    got = df.select(catalogue.next_revision(F.col("n"), F.col("p"), F.col("a")).alias("r"))
    assert [r[0] for r in got.collect()] == ["000000002.AB", "000000002.BA", "000000003.AA"]


def test_tags(spark):
    df = spark.createDataFrame([('{"a":["x","y"],"b":"z"}',), ("{bad",)], "tag_data string")
    got = catalogue.parse_tags(df).select(catalogue.first_value(F.col("tags"), "a"), catalogue.first_value(F.col("tags"), "b"), catalogue.first_value(F.col("tags"), "c"))
    assert rows(got) == [("x", "z", None), (None, None, None)]


def test_log_keeps_copies_among_new(spark):
    old, new = (spark.createDataFrame(x, "k string") for x in ([("a",)], [("a",), ("b",), ("b",)]))
    assert sorted(rows(catalogue.merge_logs(old, new, ["k"]))) == [("a",), ("b",), ("b",)]
    assert sorted(rows(catalogue.merge_logs(old, new, ["k"], True))) == [("a",), ("b",)]


def test_genre_codes(spark):
    taxonomy = spark.createDataFrame([("01", "classic rock"), ("a2", "blues"), ("48", "jazz")], "hex string, name string")
    df = spark.createDataFrame([("t", ["01", "a2", "48", "ff", "01", "01"])], "id string, p array<string>").select("id", genres.encode(F.col("p")).alias("code"))
    assert df.first()["code"] == "x01a248ff01"
    assert rows(genres.decode(df, "code", "id", taxonomy)) == [("t", "classic rock, blues, jazz, Unknown(0xff), classic rock")]


def test_text(spark):
    df = spark.createDataFrame([(" A/b: C? ", "1999-10-12", "3/12", "-7.3 dB", "b'x'")], "a string, d string, n string, g string, w string")
    got = df.select(text.normalize_value(F.col("a")), text.leading_year(F.col("d")), text.parse_of_total(F.col("n")), text.parse_gain(F.col("g")), text.unwrap_bytes(F.col("w")), text.match_key(F.lit("Æé ñ!"))).first()
    assert (got[0], got[1], tuple(got[2]), got[3], got[4], got[5]) == ("ab c", 1999, (3, 12), -7.3, "x", "en")


def test_fuzzy(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in (["abcd", "zzz"], ["abcx", "qq"]))
    got = {r[0]: (r[1], r[3]) for r in rows(matching.playlist_difference(a, b, "name"))}
    assert got == {"abcx": ("abcd", "second"), "qq": (None, "second"), "zzz": (None, "first")}
    assert text.token_set("the big band", "band big the") == 1.0


def test_search_terms(spark):
    df = spark.createDataFrame([("The Red Band", "rock")], "n string, g string")
    s = lambda q: df.select(matching.search(q, ["n"], "g")).first()[0]
    assert (s("red + band"), s("blue, band"), s("@gen rock"), s("@gen red"), s(" , ")) == (True, True, True, False, False)


def test_playlist_source(spark, tmp_path):
    (tmp_path / "a.m3u").write_text("#EXTM3U\n#EXTINF:12,A - B\nx/y.m4a\n\n#EXTINF:5,lost\n#c\nz.m4a")
    t = files.lines(spark, str(tmp_path))
    assert rows(files.playlist_entries(t).select("seconds", "name", "path")) == [(12, "A - B", "x/y.m4a")]
    assert [r["line"] for r in files.playlist_paths(t).orderBy("line_no").collect()] == ["x/y.m4a", "z.m4a"]


def test_sqlite_source(spark, tmp_path):
    with sqlite3.connect(tmp_path / "c.db") as db:
        db.execute("CREATE TABLE tracks (track_id TEXT, tag_data TEXT)")
        db.execute("INSERT INTO tracks VALUES ('A', '{}')")
    db.close()
    spark.dataSource.register(files.SqliteSource)
    got = spark.read.format("sqlite").option("path", str(tmp_path / "c.db")).option("dbtable", "tracks").load()
    assert rows(got) == [("A", "{}")]


def test_tiered_query_searches_all_rows(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_name", "p_type", "p_brand").collect()
    want = {}
    for q in part:
        same = [(1 if h.p_type == q.p_type else 2, h.p_partkey) for h in part if h.p_partkey != q.p_partkey and (h.p_name, h.p_brand) == (q.p_name, q.p_brand)]
        if same:
            want[q.p_partkey] = min(same)
    rows = queries.QUERIES["q_tiered_match"](spark, "/root/testdata/sf0.001").collect()
    assert {r.qid: (r.tier, r.hid) for r in rows if r.tier < 3} == want
    assert all(r.qid != r.hid and (r.tier < 3 or r.score > 0.85) for r in rows)


HEX = [("0A3F77B1", "rock", [1.0, 0.0]), ("0A3F77B2", "rock", [0.8, 0.6]), ("FF000001", "jazz", [0.0, 1.0]), ("FF000002", "jazz", [0.1, 1.0])]


def test_keys_of_other_types(spark):
    """Eight hex digits as ids, genres as clusters."""
    df = spark.createDataFrame(HEX, "id string, genre string, embedding array<double>").withColumn("album", F.left("id", F.lit(2))).withColumn("token", F.lit("t"))
    assert [r[:2] for r in rows(neighbors.nearest(df, df), "id")] == [("0A3F77B1", "0A3F77B2"), ("0A3F77B2", "0A3F77B1"), ("FF000001", "FF000002"), ("FF000002", "FF000001")]
    assert rows(clusters.chain(df, "id", "genre", "embedding"), "genre", "pos") == [("jazz", "FF000001", 1), ("jazz", "FF000002", 2), ("rock", "0A3F77B1", 1), ("rock", "0A3F77B2", 2)]
    assert [r[:3] for r in rows(clusters.assign_albums(df, "id", "album", "genre", "embedding", "token"), "album")] == [("0A", "rock", 1), ("FF", "jazz", 1)]
    assert rows(catalogue.modal(df, "token", "genre")) == [("t", "jazz", 2)]


def test_ties_go_to_the_smallest_id(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [1.0, 0.0])], "id string, embedding array<double>")
    assert [r[:2] for r in rows(neighbors.nearest(df, df), "id")] == [("a", "b"), ("b", "a"), ("c", "a")]


def test_ratings(vectors):
    rated = vectors.where("id in (1, 3)").withColumn("rating", F.when(F.col("id") == 1, 1).otherwise(-1))
    got = {r[0]: r[1:] for r in rows(clusters.like(vectors, rated, "id", "embedding", rating="rating"))}
    assert got[1] == (True, 1.0) and got[3] == (True, -1.0) and got[4] == (False, 0.0)
    d = np.array([0.2, 0.4])
    w = np.exp(-(d**2) / (2 * 0.15**2))
    assert got[2][1] == pytest.approx(1 - (w * d).sum() / w.sum(), abs=1e-6)


def test_albums_without_a_shared_token(spark):
    df = spark.createDataFrame([(1, "x", "k1", "t1", [1.0, 0.0]), (2, "y", "k2", None, [0.0, 1.0])], "id long, album string, cluster string, token string, v array<double>")
    assert rows(clusters.assign_albums(df, "id", "album", "cluster", "v", "token"), "album") == [("x", "k1", 1, 1.0), ("y", "outliers", 0, None)]


def test_curated_chain(spark):
    """Every choice by hand: the nearest to what was left by, albums as blocks, one list over all clusters."""
    r = random.Random(3)
    made = [(i, "ab"[i % 2], [r.gauss(0, 1) for _ in range(4)], f"al{i % 2}" if i in (4, 6, 8, 5, 9) else None) for i in range(20)]
    df = spark.createDataFrame(made, "id long, k string, v array<double>, album string")
    order = spark.createDataFrame([("b", 1), ("a", 2)], "k string, cluster_ord int")
    got = [x[3] for x in rows(clusters.curate(df, "id", "k", "v", "album", order).select("cluster_ord", "pos", "k", "id"), "cluster_ord", "pos")]
    vec = {i: np.array(v) / np.linalg.norm(v) for i, _, v, _ in made}
    want, at = [], None
    for k in "ba":
        units = {}
        for i, c, _, al in made:
            if c == k:
                units.setdefault(al or i, []).append(i)
        left = sorted(units.values(), key=lambda u: u[0])
        while left:
            best = left[0] if at is None else max(left, key=lambda u: (round(float(vec[u[0]] @ at), 9), -u[0]))
            want += best
            at = vec[best[-1]]
            left.remove(best)
    assert got == want


def test_cluster_order(spark):
    sizes = spark.createDataFrame([("rock", 5), ("pop", 5), ("jazz", 9), ("folk", 1)], "k string, n long")
    related = spark.createDataFrame([("jazz", "none", 1), ("jazz", "folk", 2), ("folk", "jazz", 1)], "k string, other string, rank int")
    assert rows(clusters.cluster_order(sizes, "k", related), "cluster_ord") == [("jazz", 1), ("folk", 2), ("pop", 3), ("rock", 4)]
    assert clusters.cluster_order(sizes.where("false"), "k").count() == 0


def test_completeness_of_declared_totals(spark):
    df = spark.createDataFrame([("a", 1, n, 4) for n in (1, 2, 3, 4, 5)] + [("b", 1, 1, 1), ("b", 2, 2, 2), ("c", None, 1, None)], "al string, d int, n int, t int")
    assert rows(catalogue.completeness(df, "al", "n", "d", "t"), "al") == [("a", 4, 5, "", "5", "complete"), ("b", 3, 2, "2-1", "", "incomplete"), ("c", 1, 1, "", "", "complete")]


def test_logs_with_null_keys(spark):
    one = spark.createDataFrame([("a", None), ("b", 1)], "k string, v int")
    assert catalogue.merge_logs(one, one, ["k", "v"]).count() == 2


def test_taxonomy_is_read_whole(spark):
    names = [("zz", "no code")] * 300 + [("0a", "rock"), ("0A", "also")]
    df = spark.createDataFrame([(1, "x0a0b")], "id long, code string")
    assert rows(genres.decode(df, "code", "id", spark.createDataFrame(names, "hex string, name string"))) == [(1, "also, Unknown(0x0b)")]


def test_fuzzy_pairs_against_all_pairs(spark):
    r = random.Random(5)
    names = list({"".join(r.choices("abcd ", k=r.randint(0, 14))) for _ in range(120)})
    df = spark.createDataFrame([(n,) for n in names], "a string")
    for cutoff in (0.5, 0.8):
        got = {(x[0], x[1]) for x in rows(matching.fuzzy_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", cutoff))}
        assert got == {(a, b) for a in names for b in names if SequenceMatcher(None, a, b).ratio() >= cutoff}


def test_name_matches(spark):
    have = spark.createDataFrame([(1, "The Band", "A Song"), (2, "The Bands", "A Song"), (3, None, "Other")], "hid long, artist string, title string")
    new = spark.createDataFrame([(10, "the band", "a song"), (11, "Someone", "A Song"), (12, "", "Other")], "qid long, artist string, title string")
    assert rows(matching.name_matches(new, have), "qid") == [(10, 1, 1.0), (12, 3, 1.0)]


def test_search_marks(spark):
    df = spark.createDataFrame([("Red Band", "Song", "jazz"), ("Blue", "Red Song", "rock")], "artist string, title string, genre string")
    s = lambda q: [r[0] for r in df.select(matching.search(q, ["artist", "title"], "genre", "artist")).collect()]
    assert s("@art red") == [True, False] and s("red") == [True, True] and s("@gen rock") == [False, True] and s("") == [False, False]
    assert matching.playlist_query(" @m3u-12 a/b c.m3u ") == (12, "a/b c.m3u") and matching.playlist_query("@m3u x") == (None, "x") and matching.playlist_query("x") is None


def test_guessed_artist(spark):
    made = [("Song", "Band", "01 Song", "Album", "Band"), ("Band", "Song", "01 Song", "Album", "Band"), ("Same", "same ", "x", "y", "z"), ("Song", None, "Song", "Album", "Band"), (None, "Band", "Song", "Album", "Band"), (None, "", "a", "b", "c")]
    df = spark.createDataFrame(made, "a string, b string, f string, d1 string, d2 string")
    got = [tuple(r[0]) for r in df.select(text.guess_artist_title(F.col("a"), F.col("b"), F.col("f"), F.col("d1"), F.col("d2"))).collect()]
    assert got == [("Band", "Song"), ("Band", "Song"), ("Same", "same "), (None, "Song"), ("Band", None), (None, None)]


def test_ratios(spark):
    df = spark.createDataFrame([("abcd", "abce"), ("a", None), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(text.percent_ratio("a", "b")).collect()] == [75, None, 100]
    one = F.lit("x")
    assert [r[0] for r in df.limit(1).select(matching.valid_match(F.col("a"), F.col("b"), one, one, 0.7)).collect()] == ["ok"]
    assert [r[0] for r in df.limit(1).select(matching.valid_match(F.col("a"), F.col("b"), one, F.lit("y"))).collect()] == ["artist"]


def test_ids_are_made_anew_until_they_differ(spark):
    df = spark.createDataFrame([(str(i),) for i in range(40)] * 2, "k string")
    made = catalogue.make_ids(df, ["k"], spark.createDataFrame([("0",), ("1",)], "track_id string"), digits=2)
    ids = [r["track_id"] for r in made.collect()]
    assert len(ids) == 80 == len(set(ids)) and not {"0", "1"} & set(ids)


@pytest.mark.parametrize(("kind", "tracks", "state"), [("new_id", 4, "old"), ("update", 3, "new"), ("keep", 3, "old")])
def test_import_conflicts(spark, kind, tracks, state):
    have = spark.createDataFrame([("K1", "Song", "old"), ("K2", "Other", "old")], "track_id string, name string, state string")
    new = spark.createDataFrame([(None, " song", "new"), (None, "Third", "new")], have.schema)
    after, twice = catalogue.import_batch(have, new, ["name"], kind)
    assert after.count() == tracks and [r["existing"] for r in twice.collect()] == ["K1"]
    assert [r["state"] for r in after.where("track_id = 'K1'").collect()] == [state]
    with pytest.raises(ValueError, match="on_conflict"):
        catalogue.import_batch(have, new, ["name"], "ask")


def test_running_total_of_sparse_keys(spark):
    r = random.Random(8)
    made = [(r.randrange(10**12), r.randrange(100)) for _ in range(400)]
    got = rows(timeseries.running_total(spark.createDataFrame(made, "p long, s long"), "p", "s", rows=50).select("p", "total", "seq"), "p")
    total, want = 0, []
    for k, (p, v) in enumerate(sorted(made)):
        total += v
        want.append((p, total, k + 1))
    assert got == want


def test_playlists_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([("one", 1, 60, "A - x", "m/a.mp3"), ("one", 2, 61, "B - y", "m/b.mp3"), ("two", 1, 5, "C - z", "m/c.mp3")], "pl string, n int, s int, t string, f string")
    lines = sinks.playlist_lines(df, "pl", ["n"], "s", "t", "f")
    sinks.write_playlists(lines, str(tmp_path / "lists"), "pl")
    back = files.playlist_entries(files.lines(spark, str(tmp_path / "lists" / "pl=one")))
    assert rows(back.select("seconds", "name", "path"), "path") == [(60, "A - x", "m/a.mp3"), (61, "B - y", "m/b.mp3")]
    sinks.write_lines(lines.where("pl = 'two'"), str(tmp_path / "one"), "line", ["line_no"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "one")).collect()] == ["#EXTM3U", "#EXTINF:5,C - z", "m/c.mp3"]
    sinks.write_json(df, str(tmp_path / "json"), ["n"])
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    order = spark.createDataFrame([("rock", 2), ("jazz", 1)], "k string, ord int")
    sinks.save_order(order, str(tmp_path / "order"))
    assert rows(sinks.load_order(order, str(tmp_path / "order")), "ord") == [("jazz", 1), ("rock", 2)]


def test_sources(spark, tmp_path):
    for name in ("a.MP3", "b.flac", "c.txt", ".d.mp3", ".hid/e.mp3", "sub/f.mp3"):
        (tmp_path / "music" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "music" / name).write_text("x")
    found = files.media_files(spark, str(tmp_path / "music"), "mp3", "flac")
    assert [r[0].rsplit("/", 1)[1] for r in rows(found.select("path"), "path")] == ["a.MP3", "b.flac", "f.mp3"]
    (tmp_path / "ids.csv").write_text(" 0A ,x\n\n0B\n0A\n")
    assert rows(files.id_list(spark, str(tmp_path / "ids.csv")), "id") == [("0A",), ("0B",)]
    (tmp_path / "ids.json").write_text('[{"spid": "0A"}, {"spid": " "}, {"other": 1}]')
    assert rows(files.id_list(spark, str(tmp_path / "ids.json"), "spid")) == [("0A",)]
    (tmp_path / "list.xml").write_text('<MediaContainer><Track ratingKey="7" title="T" duration="1500"/><Track title="U"/></MediaContainer>')
    assert rows(files.xml_tracks(spark, str(tmp_path / "list.xml")).select("ratingKey", "title", "duration", "file"), "title") == [("7", "T", "1500", None), (None, "U", None, None)]
    (tmp_path / "map.json").write_text('[{"file": "M/a.mp3", "guid": "g1"}]')
    entries = spark.createDataFrame([("m/A.mp3",), ("x",)], "path string")
    assert rows(files.with_ids(entries, files.id_map(spark, str(tmp_path / "map.json"))), "path") == [("m/A.mp3", "g1"), ("x", None)]
    assert rows(files.json_records(spark, str(tmp_path / "map.json"), "file string")) == [("M/a.mp3",)]
    (tmp_path / "labels.csv").write_text("index,mid,display_name\n0,/m/1,Speech\n")
    assert rows(files.labels(spark, str(tmp_path / "labels.csv"))) == [(0, "/m/1", "Speech")]
    nested = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, [[1.0], [2.0]]), (3, [])], "k long, v array<array<double>>")
    assert rows(files.flat_vectors(nested, "k", "v")) == [(1, [1.0, 2.0])]
    assert rows(files.ids_of(nested, "k"), "k") == [(1,), (2,), (3,)]
    text_ = spark.createDataFrame([("f", 0, "[Album]"), ("f", 1, "Gain: -7.25 dB"), ("f", 2, "[Track 1]"), ("f", 3, " Peak : 0.98"), ("f", 4, "done")], "file string, line_no int, line string")
    assert rows(files.gains(text_), "name") == [("f", "Album", "Gain", -7.25), ("f", "Track 1", "Peak", 0.98)]
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("shown_table")
    assert ("shown_table", ["x"]) in files.tables(spark)


def test_streams(spark, tmp_path):
    """The streaming functions over a folder of JSON files, against batches."""
    rows_ = [("2024-01-01 00:10:00", "view", 1, 2.0), ("2024-01-01 00:20:00", "view", 1, 3.0), ("2024-01-01 02:30:00", "click", 2, 1.0), ("2024-01-01 00:20:00", "view", 1, 3.0)]
    df = spark.createDataFrame(rows_, "ts string, event_type string, user_id long, value double")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).json(str(tmp_path / "in"))

    def run(out, name, mode="complete"):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert rows(run(playlog.play_counts(stream(), "ts"), "counts").select("event_type", "plays", "value"), "event_type") == [("click", 1, 1.0), ("view", 3, 8.0)]
    assert rows(run(playlog.sessions(stream(), "ts", "user_id"), "sessions").select("user_id", "plays"), "user_id") == [(1, 3), (2, 1)]
    assert run(playlog.once(stream(), ["ts", "user_id"], "ts"), "once", "append").count() == 3
    for _ in range(2):
        playlog.merge_into(stream(), str(tmp_path / "log"), ["ts", "user_id"], str(tmp_path / "log-check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    playlog.merge_into(stream(), str(tmp_path / "log"), ["ts", "user_id"], str(tmp_path / "other")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_empty_tables(spark):
    """No rows in, no rows out."""
    v = spark.createDataFrame([], "id string, k string, v array<double>, album string, token string")
    for out in (
        neighbors.nearest(v, v, vec="v"), clusters.chain(v, "id", "k", "v"), clusters.refine(v, "id", "k", "v"), clusters.like(v, v, "id", "v"), clusters.assign_albums(v, "id", "album", "k", "v", "token"),
        catalogue.completeness(v.withColumn("n", F.lit(1)), "album", "n"), matching.fuzzy_pairs(v, v.withColumnRenamed("k", "b"), "k", "b", 0.8), catalogue.first_of(v, [F.col("k")], ["id"]),
    ):
        assert out.count() == 0


def test_projection(spark):
    r = np.random.default_rng(9)
    m = r.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    df = spark.createDataFrame([(f"{i:02x}", v) for i, v in enumerate(m.tolist())] + [("zz", None)], "id string, v array<double>")
    got = np.array([x[1:] for x in rows(clusters.project_2d(df, "id", "v"), "id")])
    u, s, _ = np.linalg.svd(m - m.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    assert clusters.project_2d(df.where("false"), "id", "v").count() == 0


def test_names_and_paths(spark):
    df = spark.createDataFrame([(' The  "Best" / of: ', "é" * 3 + "x" * 60 + "- _", "b a c", "c a d", "m/Band/Album/01 - Other - Song.mp3", " rock, ,pop ,")], "a string, b string, c string, d string, p string, g string")
    got = df.select(
        text.normalize_tag(F.col("a")), text.directory_name(F.col("b"), 20), text.directory_name(F.col("b"), 20, plain=True), text.token_set_ratio("c", "d"), text.artist_title_of_path(F.col("p")), genres.split_list(F.col("g")),
    ).collect()[0]
    assert got[0] == "the best of" and got[1] == "_" + "x" * 19 and got[2] == "eee" + "x" * 17
    assert got[3] == 80
    assert tuple(got[4]) == ("Band", "Song") and got[5] == ["rock", "pop"]


def test_years_of_five_digits(spark):
    df = spark.createDataFrame([("253402300800",), ("253402300799",), ("0",)], "s string").withColumn("t", text.epoch_text(F.col("s")))
    got = df.select("t", F.unix_seconds(text.parse_time(F.col("t"))).alias("s"), text.stamp(F.timestamp_seconds(F.col("s").cast("long")), file=True).alias("f"), text.year_or_last(F.col("t")).alias("y"))
    assert rows(got) == [
        ("10000-01-01 00:00:00", 253402300800, "100000101_000000", 10000), ("9999-12-31 23:59:59", 253402300799, "99991231_235959", 9999), ("1970-01-01 00:00:00", 0, "19700101_000000", 1970),
    ]


def test_sections_of_equal_paths_go_by_name(spark):
    df = spark.createDataFrame([(k, "/m/x.m4a") for k in range(40, 0, -1)], "k long, path string")
    assert [r.name for r in sinks.sections([("a", df)], "k", "path").orderBy("pos").collect()] == list(range(1, 41))


def test_sections_without_paths_come_last_as_in_their_sql(spark, tmp_path):
    """Paths are all different here: the SQL leaves the order of equal ones open."""
    urls = [None, "http://a/B.html", "http://a/a.html", None, "http://b/", "http://c/é", "http://b/a.html"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(rows(library.q_sections(spark, str(tmp_path)).select("section", "pos", "name", "path")), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT section, pos, name, path FROM ({queries.SQL['q_sections']})").fetchall(), key=repr)
