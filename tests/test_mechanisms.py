"""Stored tables, event files, streams with state, order statistics, prefix sums, nested documents, spectra."""

from __future__ import annotations

import json
import os
import pickle
import random
import re
import sqlite3
import struct
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.sources import files as files_source
from cadenza.operators import catalogue, clusters, documents, matching, mel, neighbors, ranks, sinks, timeseries
from cadenza.sources import events, files, vectors
from cadenza.sources.table import Conflict, Table
from cadenza.streaming import playlog, votes


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- stored tables
@pytest.fixture
def table(spark, tmp_path):
    out = Table(spark, str(tmp_path / "t"), ["k"])
    out.create(spark.createDataFrame([], "k long, v string, m map<string,string>").schema, 8)
    out.upsert(spark.createDataFrame([(i, f"v{i}", {"a": str(i)}) for i in range(50)], "k long, v string, m map<string,string>"))
    return out


def test_changes_make_versions_and_nothing_makes_none(spark, table):
    schema = "k long, v string, m map<string,string>, at int"
    assert table.versions() == [0, 1]
    change = spark.createDataFrame([(3, "old", {}, 1), (3, "new", {"b": "1"}, 2), (99, "more", None, 1)], schema)
    assert table.upsert(change, "at") == 2 == table.upsert(change, "at")
    assert rows(table.read().where("k in (3, 99)"), "k", "v") == [(3, "new"), (99, "more")]
    assert table.delete(spark.createDataFrame([(3,), (1000,)], "k long")) == 3 == table.delete(spark.createDataFrame([(3,)], "k long"))
    assert table.read().count() == 50 and table.read(2).count() == 51 and table.read(0).count() == 0
    assert table.read(1).where("k = 3").first().v == "v3"


def test_only_touched_buckets_are_written(spark, table):
    before = table._manifest()["folders"]
    table.upsert(spark.createDataFrame([(7, "x", {})], "k long, v string, m map<string,string>"))
    after = table._manifest()["folders"]
    assert len([b for b in after if after[b] != before.get(b)]) == 1


def test_a_write_that_dies_leaves_the_version_as_it_was(spark, table, monkeypatch):
    old = rows(table.read(), "k", "v")
    monkeypatch.setattr(table, "_publish", lambda manifest: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        table.upsert(spark.createDataFrame([(7, "x", {})], "k long, v string, m map<string,string>"))
    again = Table(spark, table.path, ["k"])
    assert rows(again.read(), "k", "v") == old and again.versions() == [0, 1]
    again.expire()
    assert rows(again.read(), "k", "v") == old and again.versions() == [1]


def test_of_two_changes_at_once_the_second_is_refused(spark, table):
    manifest = table._manifest()
    table.upsert(spark.createDataFrame([(7, "x", {})], "k long, v string, m map<string,string>"))
    with pytest.raises(Conflict):
        table._replace(manifest, {0}, table.read(1).where("false"))


# ---------------------------------------------------------------- event files
def header(tracks, beat=96):
    return b"MThd" + struct.pack(">IHHH", 6, 1, tracks, beat)


def chunk(body, name=b"MTrk"):
    return name + struct.pack(">I", len(body)) + body


def test_bytes_become_events(spark, tmp_path):
    body = bytes([0x00, 0x90, 60, 100, 0x81, 0x00, 62, 0, 0x00, 0xFF, 0x51, 3, 0x07, 0xA1, 0x20, 0x00, 0xC2, 5, 0x83, 0xFF, 0x7F, 0xE1, 0x00, 0x40, 0x00, 0xF0, 2, 1, 0xF7, 0x00, 0xFF, 0x06, 2]) + b"Hi" + bytes([0, 0xFF, 0x2F, 0])
    (tmp_path / "a.mid").write_bytes(header(1) + chunk(b"xx", b"Junk") + chunk(body))
    damaged = {"b.mid": b"M", "c.mid": b"RIFF" + bytes(20), "d.mid": header(1), "e.mid": header(1) + chunk(bytes([0x00, 0x40, 1])), "f.mid": header(1) + chunk(body)[:-9], "g.mid": header(1) + chunk(bytes([0xFF] * 5)), "h.mid": header(1, 0x8000) + chunk(body)}
    for name, content in damaged.items():
        (tmp_path / name).write_bytes(content)
    read = events.read_events(spark, str(tmp_path))
    got = rows(read.where("error is null"), "seq", "delta", "tick", "type", "channel", "control", "value", "text", "data")
    assert got == [
        (0, 0, 0, "note_on", 0, 60, 100, None, None), (1, 128, 128, "note_on", 0, 62, 0, None, None), (2, 0, 128, "set_tempo", None, None, 500000, None, None), (3, 0, 128, "program_change", 2, None, 5, None, None),
        (4, 65535, 65663, "pitchwheel", 1, None, 0, None, None), (5, 0, 65663, "sysex", None, None, None, None, b"\x01\xf7"), (6, 0, 65663, "marker", None, None, None, "Hi", None), (7, 0, 65663, "end_of_track", None, None, None, None, None),
    ]
    bad = read.where("error is not null")
    assert sorted(os.path.basename(r.path) for r in bad.collect()) == sorted(damaged) and bad.where("track is not null").count() == 0


def made_events(n):
    r = random.Random(n)
    kinds = ["note_on", "note_off", "polytouch", "control_change", "program_change", "aftertouch", "pitchwheel", "text", "marker", "sysex", "meta", "set_tempo"]
    out = []
    for track in range(3):
        tick = 0
        for seq in range(r.randrange(40)):
            kind, delta = r.choice(kinds), r.choice([0, 1, 127, 128, 20_000, 2_097_152])
            tick += delta
            channel = r.randrange(16) if kind in events.MESSAGES.values() else None
            control = r.randrange(128) if kind in ("note_on", "note_off", "polytouch", "control_change") else 0x7F if kind == "meta" else None
            value = r.randrange(-8192, 8192) if kind == "pitchwheel" else r.randrange(1 << 24) if kind == "set_tempo" else r.randrange(128) if channel is not None else None
            words = "".join(r.choice("aé ") for _ in range(200)) if kind in ("text", "marker") else None
            data = bytearray(r.randrange(256) for _ in range(r.randrange(9))) if kind in ("sysex", "meta") else None
            out.append((f"f{n}.mid", track, seq, delta, tick, kind, channel, control, value, words, data))
    return out


SCHEMA = "file string, " + events.EVENT


def test_written_events_read_back(spark, tmp_path):
    made = [e for n in range(5) for e in made_events(n)]
    events.write_events(spark.createDataFrame(made, SCHEMA), str(tmp_path / "out"), F.col("file"))
    back = events.read_events(spark, str(tmp_path / "out")).where("type <> 'end_of_track'").withColumn("file", F.regexp_extract("path", "[^/]*$", 0))
    names = ["file", *[c.split()[0] for c in events.EVENT.split(", ")]]
    want = sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in e) for e in made), key=repr)
    assert sorted((tuple(bytes(r[n]) if isinstance(r[n], (bytes, bytearray)) else r[n] for n in names) for r in back.collect()), key=repr) == want
    assert not [f for f in os.listdir(tmp_path / "out") if "temporary" in f]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    made = [*made_events(1), ("bad.mid", 0, 0, 0, 0, "no such kind", None, None, None, None, None)]
    with pytest.raises(Exception, match="unknown event"):
        events.write_events(spark.createDataFrame(made, SCHEMA), str(tmp_path / "out"), F.col("file"))
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []
    with pytest.raises(Exception, match="separator"):
        events.write_events(spark.createDataFrame(made_events(1), SCHEMA), str(tmp_path / "up"), F.lit("../x.mid"))


def test_what_is_noted_in_event_files(spark):
    none = None
    e = [
        (0, "set_tempo", none, none, 250_000, none, 0), (0, "marker", none, none, none, "Beat", 960), (0, "control_change", 14, 21, 90, none, 960), (0, "control_change", 14, 22, 8, none, 1440),
        (1, "control_change", 14, 20, 5, none, 480), (1, "control_change", 13, 20, 14, none, 480), (1, "control_change", 12, 20, 9, none, 480), (1, "control_change", 3, 20, 9, none, 480),
        (2, "text", none, none, none, "Chord: early", 0), (2, "control_change", 14, 29, 0, none, 480), (2, "text", none, none, none, "Roman: no", 480), (2, "text", none, none, none, "Chord: C:maj", 480),
        (2, "text", none, none, none, "Chord: again", 480), (2, "control_change", 14, 30, 0, none, 960), (2, "text", none, none, none, "Roman: IV", 960),
        (3, "text", none, none, none, "Speech End", 0), (3, "text", none, none, none, "Speech Start", 480), (3, "text", none, none, none, "Applause Start", 960), (3, "text", none, none, none, "Speech End", 1920), (3, "text", none, none, none, "Speech End", 1930),
    ]
    made = [("p", 480, t, i, 0, tick, kind, ch, co, v, tx, None, None) for i, (t, kind, ch, co, v, tx, tick) in enumerate(e)]
    got = rows(events.noted(spark.createDataFrame(made, events.FILE)), "kind", "seconds", "value", "label")
    assert got == sorted(
        [("beat", 0.5, None, None), ("strength", 0.5, 90.0, None), ("pulse", 0.75, 8.0, None), ("loudness", 0.25, 5.0, None), ("level_pyloudnorm", None, -14.0, None), ("level_rsgain", None, -9.0, None),
         ("chord", 0.25, None, "C:maj"), ("numeral", 0.5, None, "IV"), ("speech", 0.25, 0.75, None)], key=repr,
    )


def test_event_deltas_have_a_least(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 9)], "k int, tick long").withColumn("i", F.monotonically_increasing_id())
    assert rows(events.event_deltas(df, ["k"], ["tick", "i"], least=1), "delta") == [(1,), (4,), (5,)]


# ---------------------------------------------------------------- streams
def test_votes_of_batches_are_votes_of_all(spark, tmp_path):
    src, r, last, seen = str(tmp_path / "in"), random.Random(5), {}, []
    for _ in range(3):  # a query of its own each time, from the checkpoint of the one before
        batch = [(r.choice("abc"), r.choice(["house", "dub", "rock", None])) for _ in range(25)]
        seen += batch
        spark.createDataFrame(batch, "k string, v string").coalesce(1).write.mode("append").parquet(src)
        out = votes.winning(spark.readStream.schema("k string, v string").parquet(src), "k", "v")
        step = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        query = step.foreachBatch(lambda b, _: last.update({x.key: (x.value, x.votes) for x in b.collect()})).start()
        query.awaitTermination(120)
        whole = spark.createDataFrame([s for s in seen if s[1]], "k string, v string")
        assert last == {x.k: (x.v, x.votes) for x in catalogue.argmax_genre(whole, "k", "v").collect()}


def test_a_folder_lists_each_file_once(spark, tmp_path):
    src = tmp_path / "music"
    src.mkdir()
    for names in (["a.m3u", "b.m3u"], ["c.m3u", "d.txt"], []):
        for n in names:
            (src / n).write_text(n)
        votes.list_new(votes.growing_folder(spark, str(src), "*.m3u"), str(tmp_path / "seen"), str(tmp_path / "cp")).awaitTermination(120)
        found = [os.path.basename(r.path) for r in spark.read.parquet(str(tmp_path / "seen")).collect()]
        assert sorted(found) == sorted(n for n in os.listdir(src) if n.endswith(".m3u"))


def test_a_log_has_one_row_a_key_however_batches_are_cut(spark, tmp_path):
    schema = "ts string, user_id long, value double"
    made = [("t1", 1, 1.0), ("t1", 1, 0.5), ("t2", 1, 2.0), ("t1", 2, 3.0), ("t2", 1, 9.0)]
    want = [("t1", 1, 0.5), ("t1", 2, 3.0), ("t2", 1, 2.0)]
    for name, cuts in (("one", [made]), ("many", [made[:2], made[2:4], made[4:], []])):
        log = Table(spark, str(tmp_path / name / "log"), ["ts", "user_id"])
        for k, rows_ in enumerate(cuts):
            spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").json(str(tmp_path / name / "in"))
            stream = spark.readStream.schema(schema).json(str(tmp_path / name / "in"))
            playlog.merge_into_table(stream, log, "value", str(tmp_path / name / "cp")).awaitTermination(120)
            playlog.merge_into_table(stream, log, "value", str(tmp_path / name / f"again{k}")).awaitTermination(120)
        assert rows(log.read()) == want
        assert len(log.versions()) <= len(cuts) + 1


def test_database_tables_are_read_in_ranges_with_their_types(spark, tmp_path):
    with sqlite3.connect(tmp_path / "c.db") as db:
        db.execute("CREATE TABLE t (id INTEGER, name VARCHAR(9), size REAL, raw BLOB, odd)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", [(i, f"n{i}", i / 2, bytes([i % 256]), "x") for i in range(1000)] + [(None, None, None, None, None), ("no number", 5, "1.5", "text", b"\xff")])
        db.execute("DELETE FROM t WHERE id BETWEEN 100 AND 899")
        db.execute("CREATE TABLE empty (id INTEGER)")
    db.close()
    spark.dataSource.register(files.SqliteSource)
    read = lambda name, n: spark.read.format("sqlite").option("path", str(tmp_path / "c.db")).option("dbtable", name).option("numPartitions", n).load()
    got = read("t", 7)
    assert got.dtypes == [("id", "bigint"), ("name", "string"), ("size", "double"), ("raw", "binary"), ("odd", "string")]
    assert got.rdd.getNumPartitions() == 7 and got.count() == 202 and got.where("id between 100 and 899").count() == 0
    assert rows(got.where("id is null"), "id", "name", "size", "odd") == [(None, "5", 1.5, "\ufffd"), (None, None, None, None)]
    assert read("empty", 3).count() == 0


def test_json_is_an_array_or_lines(spark, tmp_path):
    for name, content in (("a", '[{"id": "x"},\n {"id": "y"}]'), ("l", '\n{"id": "x"}\n{"id": "y"}\n'), ("o", '{\n"id": "x"\n}'), ("e", "")):
        (tmp_path / name).write_text(content)
        assert sorted(r.id for r in files.json_records(spark, str(tmp_path / name), "id string").collect()) == {"a": ["x", "y"], "l": ["x", "y"], "o": ["x"], "e": []}[name]


# ---------------------------------------------------------------- ranks
@pytest.mark.parametrize("kind", ["spread", "one value", "few values", "far apart", "mostly one"])
def test_order_statistics_are_exact(spark, kind, monkeypatch):
    rng = np.random.default_rng(3)
    n = 3000
    made = {"spread": rng.standard_normal(n), "one value": np.full(n, 2.5), "few values": rng.integers(0, 3, n) * 1.0, "far apart": 10.0 ** rng.integers(-300, 300, n), "mostly one": np.where(rng.random(n) < 0.9, 7.0, rng.standard_normal(n))}[kind]
    monkeypatch.setattr(ranks, "FEW", 20)
    df = spark.createDataFrame([(float(v),) for v in made] + [(None,), (float("nan"),)], "v double")
    places = [0, 1, n // 3, n // 2, n - 2, n - 1]
    assert ranks.order_statistics(df, "v", places) == [sorted(made.tolist())[k] for k in places]
    assert ranks.median(df, "v") == pytest.approx(float(np.median(made)))


def test_no_median_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert ranks.median(df, "v") is None
    with pytest.raises(IndexError):
        ranks.order_statistics(df, "v", [0])


def test_running_totals_where_half_of_the_rows_tie(spark):
    r = random.Random(8)
    made = [(5 if i % 2 else r.randrange(100), r.randrange(100), i) for i in range(600)] + [(None, 3, 1000), (7, None, 1001), (5, 1, 3), (5, 1, 3)]
    df = spark.createDataFrame(made, "p long, s long, i long")
    got = [tuple(x) for x in ranks.running_total(df, "p", "s", rows=40).orderBy("seq").collect()]
    assert [g[4] for g in got] == list(range(1, len(made) + 1)) and sorted((g[:3] for g in got), key=repr) == sorted(made, key=repr)
    total = 0
    for p, s, _, t, _ in got:
        total += s or 0
        assert t == total
    assert [g[0] for g in got] == sorted((g[0] for g in got), key=lambda p: (p is not None, p or 0))
    parts = ranks.stored(df.withColumn("__tie", F.xxhash64("p", "s", "i")).repartitionByRange(15, "p", "__tie").withColumn("r", F.spark_partition_id()), "t").groupBy("r").count()
    assert parts.agg(F.max("count")).first()[0] < 150  # the ties are in several ranges
    assert [x[:5] for x in (tuple(y) for y in ranks.running_total(df, "p", "s", rows=40).orderBy("seq").collect())] == got


@pytest.mark.parametrize("limit", [0, 10**9])
def test_windows_of_a_hot_key_in_ranges(spark, monkeypatch, limit):
    """Islands, deltas and pairs are those of one window a key, whether it is sorted in ranges or not."""
    r = random.Random(12)
    made = [(None if i % 50 == 0 else "hot" if i % 4 else r.choice("ab"), i * 3 % 700 + i / 1000, r.random() < 0.7, r.choice(["play", "stop"]), None if i % 9 == 0 else r.randrange(100)) for i in range(700)]
    r.shuffle(made)
    df = spark.createDataFrame(made, "k string, t double, f boolean, kind string, tick long")
    monkeypatch.setattr(ranks, "HOT", limit)
    if not limit:  # so that a key is in many ranges
        whole = ranks.by_ranges
        monkeypatch.setattr(ranks, "by_ranges", lambda df, by, rows, part, tie: whole(df, by, 30, part, tie))
    keyed = {}
    for m in sorted(made, key=lambda m: m[1]):
        keyed.setdefault(m[0], []).append(m)
    islands, deltas, pairs = [], [], []
    for k, ms in keyed.items():
        run, total, last = [], 0, None
        for i, m in enumerate(ms):
            if m[2]:
                run.append(m[1])
            if run and (not m[2] or i == len(ms) - 1):
                islands.append((k, run[0], run[-1], len(run)))
                run = []
            d = max(0, m[4] - last) if i and m[4] is not None and last is not None else 0
            total += d
            deltas.append((k, m[1], d, total))
            last = m[4]
            if i + 1 < len(ms) and (m[3], ms[i + 1][3]) == ("play", "stop"):
                pairs.append((k, m[1], ms[i + 1][1]))
    assert rows(timeseries.islands(df, "k", ["t"], F.col("f"), "t", "t"), "k", "first", "last", "rows") == sorted(islands, key=repr)
    assert rows(timeseries.deltas(df, "k", ["t"], "tick"), "k", "t", "delta", "elapsed") == sorted(deltas, key=repr)
    assert rows(timeseries.pairing(df, "k", "t", "kind", "play", "stop", "t"), "k", "t", "next_t") == sorted(pairs, key=repr)


# ---------------------------------------------------------------- documents
def plain_leaves(v, path=()):
    unwrap = lambda s: m[2] if isinstance(s, str) and (m := re.fullmatch(r"b(['\"])(.*)\1", s, re.DOTALL)) else s
    if isinstance(v, dict):
        return [x for k, y in v.items() if unwrap(k).lower() != "covr" for x in plain_leaves(y, (*path, unwrap(k)))]
    if isinstance(v, list):
        return [x for k, y in enumerate(v) for x in plain_leaves(y, (*path, str(k)))]
    name = "/".join(p.replace("~", "~0").replace("/", "~1") for p in path)
    v = unwrap(v)
    return [(name, v if v is None or isinstance(v, str) else json.dumps(v))]


def test_leaves_of_nested_documents(spark):
    r = random.Random(4)

    def made(depth):
        kind = r.random()
        if depth and kind < 0.4:
            return {r.choice(["a", "b/c", "~", "COVR", "b'k'", "x y"]) + r.choice(["", "1"]): made(depth - 1) for _ in range(3)}
        if depth and kind < 0.7:
            return [made(depth - 1) for _ in range(r.randrange(4))]
        return r.choice(["b'in'", 'b"q"', "plain", "b'", None, 3, True, "", "a\nb", 'b\'two\nlines\''])

    docs = [made(4) for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(100, "{bad"), (101, None), (102, "")], "id long, doc string")
    want = sorted(((i, *x) for i, d in enumerate(docs) for x in plain_leaves(d)), key=repr)
    assert rows(documents.leaves(df, "id", "doc"), "id", "path", "value") == want
    maps = {x.id: x.tags for x in documents.tag_maps(df, "id", "doc").collect()}
    assert all(set(m.values()) <= {v for i, _, v in want if i == k} and set(m) == {p for i, p, _ in want if i == k} for k, m in maps.items())
    deep = spark.createDataFrame([(1, "[" * 70 + "1" + "]" * 70)], "id long, doc string")
    with pytest.raises(ValueError, match="levels"):
        documents.leaves(deep, "id", "doc")


# ---------------------------------------------------------------- spectra
def loop_spectrum(y, rate, size, hop, bands):
    """As written in the books: one frame and one band at a time."""
    y = np.concatenate([np.zeros(size // 2), y, np.zeros(size // 2)])
    hann = np.array([0.5 - 0.5 * np.cos(2 * np.pi * k / size) for k in range(size)])
    edges = mel.hertz_of(np.linspace(0, mel.mel_of(rate / 2), bands + 2))
    out, n = np.zeros(bands), 0
    for a in range(0, len(y) - size + 1, hop):
        power = np.abs(np.array([np.sum(y[a : a + size] * hann * np.exp(-2j * np.pi * k * np.arange(size) / size)) for k in range(size // 2 + 1)])) ** 2
        n += 1
        for b in range(bands):
            lo, mid, hi = edges[b : b + 3]
            for k in range(size // 2 + 1):
                f = k * rate / size
                out[b] += power[k] * max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) * 2 / (hi - lo)
    return out / n


def test_mel_snippets_are_those_of_a_loop(spark):
    rng = np.random.default_rng(6)
    tracks = {"a": rng.standard_normal(230), "b": rng.standard_normal(100), "c": rng.standard_normal(3)}
    made = [(t, int(i), float(v)) for t, y in tracks.items() for i, v in enumerate(y)] + [(None, 0, 1.0), ("d", 5, None)]
    rng.shuffle(made)
    df = spark.createDataFrame([(t, int(i), v if v is None else float(v)) for t, i, v in made], "t string, i long, v double")
    got = {(r.track, r.snippet): r.vector for r in mel.mel_snippets(df, "t", "i", "v", rate=1000, seconds=0.1, size=64, hop=16, bands=8).collect()}
    want = {(t, k): loop_spectrum(y[k * 100 : k * 100 + 100], 1000, 64, 16, 8) for t, y in tracks.items() for k in range(-(-len(y) // 100))} | {("d", 0): np.zeros(8)}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


# ---------------------------------------------------------------- what was wrong
def test_file_ids_are_the_best_of_all(spark):
    r = random.Random(2)
    ids = ["".join(r.choice("abc") for _ in range(8)) for _ in range(60)] + ["ABCABCAB", "abcabcab"]
    names = ["x [0011aaFF].m4a", "abcABCab.mp3", "zzzz", ".hidden", "noending", *[i[:6] + "x.m4a" for i in ids[:20]], *[i + "yy.m4a" for i in ids[20:30]]]
    files, tracks = spark.createDataFrame([("/m.x/" + n,) for n in names], "path string"), spark.createDataFrame([(i,) for i in ids], "track_id string")
    want = []
    for n in names:
        stem = (n.rsplit(".", 1)[0] if "." in n[1:] else n).lower()
        if m := re.search(r"\[([0-9A-Fa-f]{8})\]", n):
            want.append(("/m.x/" + n, m[1], "given"))
        elif same := [i for i in ids if i.lower() == stem]:
            want.append(("/m.x/" + n, min(same), "name"))
        else:
            best = min(((-round(100 * SequenceMatcher(None, stem, i.lower()).ratio()), i) for i in ids), default=(0, None))
            want.append(("/m.x/" + n, *((best[1], "alike") if best[0] < -70 else (None, None))))
    assert rows(matching.file_ids(files, tracks)) == sorted(want, key=repr)


def test_playlist_search_runs(spark, tmp_path):
    (tmp_path / "p.m3u").write_text("#EXTM3U\n/a/one.m4a\n\n/b/nothing like it.m4a\n/c/[00000abc].m4a\n/a/one.m4a\n")
    tracks = spark.createDataFrame([("ONE",), ("two",)], "track_id string")
    assert rows(matching.playlist_search(f"@m3u {tmp_path}/p.m3u", tracks)) == [(1, "/a/one.m4a", "ONE"), (3, "/c/[00000abc].m4a", "00000abc"), (4, "/a/one.m4a", "ONE")]
    assert [x[0] for x in rows(matching.playlist_search(f" @M3U-3 {tmp_path}/p.m3u", tracks))] == [3, 4]
    assert matching.playlist_search("red, blue", tracks) is None


def test_existing_by_either_spelling(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z"), ("c", None), ("a", "x")], "p string, o string")
    files = spark.createDataFrame([("a",), ("y",), ("z",), (None,)], "path string")
    assert rows(catalogue.existing(df, F.col("p"), F.col("o"), files)) == [("a", "x"), ("a", "x"), ("b", "y"), (None, "z")]


def test_the_last_of_several_updates_wins(spark):
    have = spark.createDataFrame([("K1", "song", "old")], "track_id string, name string, state string")
    new = spark.createDataFrame([(None, "Song", "zz", 1), (None, "song ", "aa", 2)], "track_id string, name string, state string, at int")
    after, twice, revision = catalogue.import_run(have, new, ["name"], (1, "AZ"), "update", order="at")
    assert rows(after) == [("K1", "song ", "aa")] and twice.count() == 2 and rows(revision) == [(1, "000000001.BA")]


def test_ids_are_refused_if_there_are_too_few(spark):
    df = spark.range(20).select(F.col("id").alias("k"))
    taken = spark.createDataFrame([], "track_id string")
    made = catalogue.make_ids(df.limit(8), ["k"], taken, digits=1)
    assert made.count() == made.select("track_id").distinct().count() == 8
    with pytest.raises(ValueError, match="too many"):
        catalogue.make_ids(df, ["k"], taken, digits=1)


def test_one_wrong_number_makes_no_long_list(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1_000_000_000), ("b", 1)], "al string, n long")
    got = {r.al: r for r in catalogue.completeness(df, "al", "n").collect()}
    assert got["a"].expected == 1_000_000_000 and got["a"].missing.startswith("2,3,") and got["a"].missing.endswith(",1000,...") and got["a"].status == "incomplete"
    assert got["b"].status == "complete"


def test_few_goes_by_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(i, [0.5] * 100) for i in range(20)], "k long, v array<double>")
    broadcast = lambda d: "BroadcastHint" in d._jdf.queryExecution().logical().toString() or "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert broadcast(clusters.few(df))
    monkeypatch.setattr(clusters, "FEW_BYTES", 1000)
    assert not broadcast(clusters.few(df))


def test_a_small_side_moves_no_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(300)], "id long, embedding array<double>")
    plan = neighbors.products(v, v.limit(10), ("id", "id"), ("embedding", "embedding"), lambda a, b: None, v.schema)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_small_rules(spark):
    df = spark.createDataFrame([("plex://track/abc", "b"), ("abc", "B"), (None, "a")], "c string, t string")
    assert rows(df.select(text.without_prefix(F.col("c")).alias("x"))) == [("abc",), ("abc",), (None,)]
    assert [r.t for r in sinks.by_title(df, "t", "c").collect()] == ["a", "B", "b"]


def test_csv_with_a_column_a_tag(spark, tmp_path):
    df = spark.createDataFrame([(1, {"b": 'x,"y"', "a": "1"}), (2, {}), (3, {"a": "2"})], "id long, tags map<string,string>")
    catalogue.write_csv(df, "tags", str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == ["id", "a", "b"] and rows(back) == [("1", "1", 'x,"y"'), ("2", None, None), ("3", "2", None)]


def test_imports_are_enriched_first(spark):
    schema = "track_id string, name string, tags map<string,string>"
    have = spark.createDataFrame([("K1", "old", {"a": "1"})], schema)
    new = spark.createDataFrame([(None, "Song", {"a": "file", catalogue.WRITER: "w"}), (None, "other", None), (None, "bare", None)], schema)
    known = spark.createDataFrame([("song ", {"a": "known", "genres": '["dub"]', catalogue.FILE_KEYS[0]: "x"}), ("other", {"b": "2"})], "name string, tags map<string,string>")
    after, _, revision = catalogue.import_run(have, new, ["name"], (1, "AA"), known=known)
    got = {r.name: r.tags for r in after.collect()}
    assert got == {
        "old": {"a": "1"}, "Song": {"a": "known", "genres": '["dub"]', catalogue.GENRE: '["dub"]', catalogue.REVISION: '"AAA"'}, "other": {"b": "2", catalogue.REVISION: '"AAA"'}, "bare": None,
    }
    assert rows(revision) == [(4, "000000004.AA")]
    changed, twice, _ = catalogue.import_run(have, spark.createDataFrame([(None, "Old", {"a": "2"}), (None, "old", {"a": "3"})], schema), ["name"], (1, "AA"), "update")
    assert {r.track_id: r.tags for r in changed.collect()} == {"K1": {"a": "3"}} and twice.count() == 2


def test_pickled_vectors_and_nothing_else(spark, tmp_path):
    (tmp_path / "a.p").write_bytes(pickle.dumps({"x": np.arange(3.0), 7: [[1, 2]], "many": [np.ones(2), [0.5, 0.5], "no"], "bad": "text", "deep": np.zeros((2, 2)), "none": None}))
    (tmp_path / "b.p").write_bytes(pickle.dumps({"x": os.system}))
    (tmp_path / "c.p").write_bytes(b"\x80")
    (tmp_path / "d.p").write_bytes(pickle.dumps([1, 2]))
    got = vectors.pickled_vectors(spark, str(tmp_path))
    assert rows(got.where("error is null"), "id", "part", "embedding") == [("7", 0, [1.0, 2.0]), ("many", 0, [1.0, 1.0]), ("many", 1, [0.5, 0.5]), ("x", 0, [0.0, 1.0, 2.0])]
    assert sorted(os.path.basename(r.file) for r in got.where("error is not null").collect()) == ["b.p", "c.p", "d.p"]


def test_title_case_begins_words_after_any_sign(spark):
    df = spark.createDataFrame([("don't_stop 2nd o'NEILL",), (None,), ("",)], "c string")
    assert [r.x for r in df.select(text.title_case(F.col("c")).alias("x")).collect()] == ["Don'T Stop 2Nd O'Neill", None, ""]


def test_overlays_are_dealt_before_they_are_exploded(spark):
    from cadenza.plans import more

    plan = more.q_overlays(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange " in x]
    assert exchanges and all("REPARTITION_BY_NUM" in x for x in exchanges)  # no exploded row is sorted before a shuffle


def test_ranges_are_bounded():
    assert [ranks.range_parts(n, 5000) for n in (0, 1, 5001, 36_000_000, 216_000_000, 3_000_000_000)] == [1, 1, 2, 1000, 1000, 3000]


def test_gains_are_dealt_by_files(spark, monkeypatch):
    monkeypatch.setattr(files_source, "LINES", 10)
    text = spark.createDataFrame([(f"f{k}", n, "[Track]" if n == 0 else f" Gain {n}: {k}.5 dB") for k in range(40) for n in range(3)], "file string, line_no long, line string")
    got = files_source.gains(text)
    assert sorted(tuple(r) for r in got.collect()) == sorted((f"f{k}", "Track", f"Gain {n}", k + 0.5) for k in range(40) for n in (1, 2))
    plan = got.groupBy("file", "section", "name", "value").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(file" in plan and ", 12)" in plan
