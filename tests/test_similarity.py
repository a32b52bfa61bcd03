"""Pruned neighbours and joins of alike texts against comparing everything with everything."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.text import token_set
from cadenza.operators import matching, metric, neighbors, similarity

SYLLABLES = "ka ro mi ta ne lo si ve du an el or in st ch th wa by".split()


def name(rng):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5)))


def edited(rng, s):
    out = list(s)
    for _ in range(rng.randint(1, 4)):
        at, kind = rng.randrange(len(out) + 1), rng.random()
        if kind < 0.4 and out:
            out.pop(min(at, len(out) - 1))
        elif kind < 0.8:
            out.insert(at, rng.choice("abcdeé "))
        elif out:
            out[min(at, len(out) - 1)] = rng.choice("xyzÄ")
    return "".join(out)


def turned(rng, s):
    words = s.split()
    rng.shuffle(words)
    return " ".join([*words, *([name(rng)] if rng.random() < 0.5 else [])]).title()


@pytest.fixture(scope="module")
def names():
    rng = random.Random(3)
    base = [name(rng) for _ in range(250)]
    other = [edited(rng, rng.choice(base)) for _ in range(150)] + [name(rng) for _ in range(100)] + [turned(rng, rng.choice(base)) for _ in range(100)]
    return sorted({*base, "", "a", "ab", "aaaa", "aaaaaaaaaaaaaaa"}), sorted({*other, "", "ab", "aaab", "aaaaaaaaaaaaaaab", "  "})


@pytest.fixture(scope="module")
def sides(spark, names):
    return [spark.createDataFrame([(x,) for x in [*xs, xs[5], None]], f"{c} string") for xs, c in zip(names, "ab", strict=True)]


@pytest.mark.parametrize("cutoff", [0.95, 0.8, 0.7, 0.55])
def test_fuzzy_pairs_are_all_pairs(names, sides, cutoff):
    got = {(r.a, r.b): r.score for r in matching.fuzzy_pairs(*sides, "a", "b", cutoff).collect()}
    every = {(a, b): SequenceMatcher(None, a, b).ratio() for a in names[0] for b in names[1]}
    assert got == {k: v for k, v in every.items() if v >= cutoff}


def test_candidates_are_few(names, sides):
    one, two = (d.select(F.col(c).alias("text")) for d, c in zip(sides, "ab", strict=True))
    pairs = similarity.alike_texts(one, two, 0.9)
    assert pairs.count() == pairs.distinct().count() < len(names[0]) * len(names[1]) / 200


def test_token_set_pairs_are_all_pairs(names, sides):
    got = {(r.a, r.b): r.score for r in similarity.token_set_pairs(*sides, "a", "b", 80).collect()}
    every = {(a, b): round(100 * token_set(a, b)) for a in names[0] for b in names[1] if a.split() and b.split()}
    assert got == {k: v for k, v in every.items() if v >= 80}
    empty = sides[0].where("false")
    assert similarity.token_set_pairs(empty, sides[1], "a", "b").count() == 0 == matching.fuzzy_pairs(sides[0], sides[1].where("false"), "a", "b", 0.8).count()


def test_token_set_pairs_read_the_rows_once(spark, tmp_path):
    """Repeated rows are met once, when their distinct texts are stored; what follows reads these."""
    spark.createDataFrame([("red ring", "RING red big")] * 50 + [("old cog", "cog")] * 50, "a string, b string").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    pairs = similarity.token_set_pairs(rows, rows, "a", "b", 80)
    assert not [f for f in pairs.inputFiles() if "/rows/" in f]
    assert sorted(map(tuple, pairs.collect())) == [("old cog", "cog", 100), ("red ring", "RING red big", 100)]


@pytest.mark.parametrize("others", [False, True])
def test_tiered_is_the_best_of_all_pairs(spark, others):
    rng = random.Random(7)
    rows = [(i, rng.choice(["red ring", "red rings", "blue bolt", "old cog", None]), rng.choice(["promo one", "promo two", "x", None]), rng.choice(["A", "B"])) for i in range(80)]
    have = spark.createDataFrame(rows, "hid long, title string, album string, artist string")
    wanted = rows if others else [(100 + i, t and t.replace("r", "R", 1) if i % 3 else t, al, ar) for i, t, al, ar in rows[:40]]
    got = sorted(tuple(r) for r in matching.tiered(spark.createDataFrame(wanted, "qid long, title string, album string, artist string"), have, others=others).collect())
    want = []
    for q, t, al, ar in wanted:
        best = []
        for h, ht, hal, har in rows:
            if t is None or ht is None or others and h == q:
                continue
            if t == ht and ar == har:
                best.append((1 if al == hal else 2, -1.0, h))
            elif al is not None and hal is not None:
                score = 0.7 * SequenceMatcher(None, t, ht).ratio() + 0.3 * SequenceMatcher(None, al, hal).ratio()
                if score > 0.85:
                    best.append((3, -score, h))
        if best:
            tier, score, h = min(best)
            want.append((q, h, tier, round(-score, 6)))
    assert got == sorted(want)


def test_optional_key_counts_are_those_of_the_pairs(spark):
    rng = random.Random(1)
    wanted = spark.createDataFrame([(i, rng.choice(["A", "b", None]), rng.choice(["x", "", "Y"])) for i in range(40)], "qid long, artist string, track string")
    have = spark.createDataFrame([(i, rng.choice([["a"], ["B", "b"], ["a", "c"], []]), rng.choice([["X"], ["y", "x"]])) for i in range(60)], "hid long, h_artist array<string>, h_track array<string>")
    pairs = matching.optional_keys(wanted, have, ["artist", "track"]).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("hid").alias("hid"))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, matching.optional_key_counts(wanted, have, ["artist", "track"]).collect()))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<double>")


@pytest.fixture(scope="module")
def clustered(spark):
    """Forty clusters, one of them with many equal vectors, and rows without a direction."""
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((40, 16))
    rows = [(i, (centers[i % 40] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(1600)] + [(5000 + i, centers[0].tolist()) for i in range(200)]
    return vectors(spark, [*rows, (9000, [0.0] * 16), (9001, None), (9002, [])])


def test_pruned_neighbours_are_the_neighbours(spark, clustered):
    plain = sorted(map(tuple, neighbors.nearest(clustered, clustered).collect()))
    assert sorted(map(tuple, metric.nearest_pruned(clustered, clustered, block=64).collect())) == plain
    some = clustered.where("id % 20 = 0")
    assert sorted(map(tuple, metric.nearest_pruned(some, clustered, block=64).collect())) == sorted(map(tuple, neighbors.nearest(some, clustered).collect()))
    assert metric.nearest_pruned(clustered.where("false"), clustered, block=64).count() == 0 == metric.nearest_pruned(clustered, clustered.where("false"), block=64).count()
    assert sorted(map(tuple, metric.nearest_pruned(some, clustered, block=64, own=True).collect())) == sorted(map(tuple, neighbors.nearest(some, clustered, own=True).collect()))


def test_most_pairs_of_blocks_of_clusters_never_meet(spark, clustered, monkeypatch):
    met = []
    whole = metric.block_pairs
    monkeypatch.setattr(metric, "block_pairs", lambda spark, rings, others, *more: met.append((whole(spark, rings, others, *more).count(), len(rings) * len(others))) or whole(spark, rings, others, *more))
    metric.nearest_pruned(clustered, clustered, block=32).count()
    assert len(met) == 2 and sum(n for n, _ in met) < 0.15 * met[0][1]


def test_no_block_is_larger_than_asked_for(spark, clustered):
    pivots = metric.chosen_pivots(clustered, "id", "embedding", 20)
    dealt, rings = metric.blocked(metric.placed(clustered, "id", "embedding", pivots), 50)
    assert rings[:, 3].sum() == dealt.count() == 1800
    assert rings[:, 3].max() <= 100  # a ring that is split by a hash is split unevenly


def test_playlist_difference_is_the_best_of_all_pairs(names, sides):
    one, two = sides[0].withColumnRenamed("a", "name"), sides[1].withColumnRenamed("b", "name")
    got = sorted(((r.name, r.match, r.score, r.side) for r in matching.playlist_difference(one.where("name is not null"), two.where("name is not null"), "name").collect()), key=repr)
    want, taken = [], set()
    for b in names[1]:
        best = min(((-SequenceMatcher(None, b, a).ratio(), a) for a in names[0]), default=(0, None))
        if -best[0] >= 0.6:
            want.append((b, best[1], -best[0], "second"))
            taken.add(best[1])
        else:
            want.append((b, None, None, "second"))
    want += [(a, None, None, "first") for a in names[0] if a not in taken]
    assert got == sorted(want, key=repr)


def test_name_matches_are_the_best_of_all_pairs(spark):
    rng = random.Random(9)
    have = [(i, name(rng) if i % 7 else None, rng.choice([name(rng), "the same"])) for i in range(150)]
    wanted = [(i, a if a is None or i % 3 else edited(rng, a), t.upper() if i % 2 else edited(rng, t)) for i, a, t in rng.sample(have, 80)] + [(900, None, None)]
    schema = "long, artist string, title string"
    got = sorted((r.qid, r.hid, round(r.score, 9)) for r in matching.name_matches(spark.createDataFrame(wanted, "qid " + schema), spark.createDataFrame(have, "hid " + schema)).collect())
    want = []
    low = lambda s: (s or "").lower()
    for q, a, t in wanted:
        best = min((-(SequenceMatcher(None, low(a), low(b)).ratio() + SequenceMatcher(None, low(t), low(u)).ratio()) / 2, h) for h, b, u in have)
        if -best[0] >= 0.9:
            want.append((q, best[1], round(-best[0], 9)))
    assert got == sorted(want)


def test_best_alike_compares_few_and_loses_none(spark, names, monkeypatch):
    a, b = sorted({x for x in names[0]}), sorted({x.lower() for x in names[1]})
    score = lambda x, y: round(100 * SequenceMatcher(None, x, y).ratio())
    want = []
    for x in a:
        s, y = min((-score(x, y), y) for y in b)
        if s < -70:
            want.append((x, y, -s))
    monkeypatch.setattr(similarity, "SOUGHT", 100)
    monkeypatch.setattr(similarity, "HELD", 70)
    left, right = spark.createDataFrame([(x,) for x in a], "name string"), spark.createDataFrame([(y, y) for y in b], "low string, id string")
    assert sorted(tuple(r) for r in similarity.best_alike(left, right, 70).collect()) == want
    compared = []
    monkeypatch.setattr(similarity, "SequenceMatcher", lambda n, x, y: compared.append(1) or SequenceMatcher(n, x, y))
    assert [(a[i], b[j], s) for i, j, s in similarity.most_alike(a, b, 70)] == want
    assert len(compared) < len(a) * len(b) / 50


def test_parts_meet_without_a_join(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 6)).round(2)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>")
    for name, n in (("BLOCK", 16), ("PART", 64), ("SPREAD", 3), ("SMALL_BYTES", 0)):
        monkeypatch.setattr(neighbors, name, n)
    assert neighbors.sides(10, 100) == (1, 3) and neighbors.sides(300, 640) == (5, 10)
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -np.inf)
    got = neighbors.nearest(v, v)
    assert sorted((r.id, r.neighbor, r.similarity) for r in got.collect()) == [(i, int(x.argmax()), float(x.max())) for i, x in enumerate(s)]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(metric, "BLOCK", 16)
    assert sorted(tuple(r) for r in metric.nearest_pruned(v, v, block=16).collect()) == sorted(tuple(r) for r in got.collect())


def test_near_duplicates_take_every_vector(spark):
    from cadenza.plans import queries

    assert queries.q_near_duplicates(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()


def test_like_is_the_same_in_small_parts(spark, monkeypatch):
    from cadenza.operators import clusters

    rng = np.random.default_rng(6)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(200, 5)))], "id long, embedding array<float>")
    rated = v.where("id % 3 = 0").withColumn("rating", F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0))
    want = sorted(tuple(r) for r in clusters.like(v, rated, "id", "embedding", 0.3, rating="rating").collect())
    for name, n in (("BLOCK", 16), ("PART", 64), ("SPREAD", 2), ("SMALL_BYTES", 0)):
        monkeypatch.setattr(neighbors, name, n)
    assert neighbors.sides(200, 200) == (4, 4) and neighbors.sides(200, 200, 4 * neighbors.WIDTH) == (13, 13)
    assert sorted(tuple(r) for r in clusters.like(v, rated, "id", "embedding", 0.3, rating="rating").collect()) == want


def test_best_alike_of_long_texts_and_no_row_with_a_block(spark, monkeypatch):
    """Ratios of texts that share more than 327 characters, in blocks that know what the ones before found."""
    r = random.Random(26)
    texts = ["x" * 250 + str(i) * r.randint(1, 99) for i in range(60)]
    a, b = texts[:9], sorted(set(texts[9:]))
    want = []
    for x in a:
        s, y = min((-round(100 * SequenceMatcher(None, x, y).ratio()), y) for y in b)
        if s < -70:
            want.append((x, y, -s))
    assert [(a[i], b[j], s) for i, j, s in similarity.most_alike(a, b, 70)] == want
    monkeypatch.setattr(similarity, "HELD", 10)
    left, right = spark.createDataFrame([(x,) for x in a], "name string"), spark.createDataFrame([(y, y) for y in b], "low string, id string")
    found = similarity.best_alike(left, right, 70)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_best_alike_without_rows(spark):
    left, right = spark.createDataFrame([("a",), (None,)], "name string"), spark.createDataFrame([("a", "A")], "low string, id string")
    assert similarity.best_alike(left, right.where("false"), 70).collect() == []
    assert similarity.best_alike(left.where("false"), right, 70).collect() == []
    assert [tuple(r) for r in similarity.best_alike(left, right, 70).collect()] == [("a", "A", 100)]
