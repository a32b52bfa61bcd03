"""The audits of filters and sources on small tables, against plain Python."""

from __future__ import annotations

import collections
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import embedding_dedup, filter_audit, source_audit

SCHEMA = "doc_id long, text string, lang string, source string"
LONG = "word " * 30_000
ROWS = [
    (1, "a b c", "en", "x"), (2, "a b c", "en", "x"), (2, "a b c", "en", "x"), (None, "a b c", "en", None), (3, None, None, "x"), (4, "", "", ""), (5, LONG, "en", "y"), (6, LONG, "en", "y"),
    (7, " ".join(f"w{i}" for i in range(60)), "en", "y"), (8, " ".join(f"w{i}" for i in range(60)) + " ÄÖ $", "de", "Z"), (9, "THE Big # " * 3, "de", "Z"), (10, "\x0b\x1c  ", "de", "q"), (11, "a\U0001f600b", "de", "q"),
    (12, "a\U0001f600b ", "de", "x"), (13, "c a\U0001f600b", "de", "q"),
]


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("id", "part", "t", "n", "kept", "digest", "value", "chunk", "first"):
        out = out.withColumn(c, F.lit("own"))
    return out


def plain_audit(rows, labels):
    first, out = {}, []
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    marks = collections.defaultdict(list)
    for i, t, _, source in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        known = [x for x in labels if i is not None and x[0] == i]
        marks[source or ""].append((fails, any(x[1] == 1 for x in known), any(x[2] == 1 for x in known)))
    for part, docs in marks.items():
        removed, shapley = {}, collections.Counter()
        for p in permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(p, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                shapley[f] += len(gone)
                removed[p, step] = (len(left), len(gone), sum(d[0][f] for d in docs) - len(gone), sum(d[0][f] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))
        out += [(part, "".join(p), step, *v, shapley[p[step - 1]]) for (p, step), v in removed.items()]
    return sorted(out)


def test_filter_audit_against_python(spark, docs):
    labels = [(1, 1, 0), (2, 0, 1), (2, None, None), (5, 1, 1), (6, 1, None), (None, 1, 1), (9, 0, 1), (9, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r[n] for n in names) for r in filter_audit.filter_audit(docs, table).collect()) == plain_audit(ROWS, labels)
    assert filter_audit.filter_audit(docs.where("false"), table).count() == 0
    assert filter_audit.filter_audit(docs, table.where("false")).where("good_lost <> 0 or toxic_lost <> 0").count() == 0


def test_index_counts_parts_of_any_size():
    rng = np.random.default_rng(1)
    part, bits = rng.choice(7, 1000, p=[0.7, 0.1, 0.1, 0.07, 0.01, 0.01, 0.01]), rng.integers(0, 128, 1000)
    left = filter_audit.Index(part, bits, 8 - 1).left()
    for p in range(7):
        for s in range(filter_audit.SETS):
            own = (part == p) & (bits & s == 0)
            assert left[p, s].tolist() == [own.sum(), (own & (bits & 32 > 0)).sum(), (own & (bits & 64 > 0)).sum()]


def plain_sources(rows):
    counts, seen, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= 3]
        others = [s for g, s in groups if g == lang]

        def p_of(names, lang=lang, kept=kept):
            n = {t: sum(counts[lang, s][t] for s in names) for t in kept}
            return {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}

        p, q = p_of([source]), p_of(others)
        pairs = []
        for o in others:
            if o != source:
                r = p_of([o])
                pairs.append((-sum((p[t] - r[t]) ** 2 // r[t] for t in kept), o.encode()))
        best = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:200])):
            out += [(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def audited(df, **how):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in source_audit.source_audit(df, **how).collect())


def test_source_audit_against_python(spark, docs, monkeypatch):
    assert audited(docs) == plain_sources(ROWS)
    monkeypatch.setattr(source_audit, "BLOCK", 1)
    assert audited(docs, chunk=3) == plain_sources(ROWS)
    assert audited(docs.where("false")) == []
    assert audited(docs.where("doc_id = 3")) == []


def test_shares_are_exact():
    rng = np.random.default_rng(2)
    for top in (10, 10**6, 2**52):
        count = rng.integers(1, top, 1000)
        total = int(count.max()) + int(rng.integers(0, top))
        assert source_audit.share(count, total).tolist() == [1 + 10**9 * int(c) // total for c in count]


def plain_links(rows, threshold=embedding_dedup.THRESHOLD):
    """Links and components by comparing all rows with all."""
    unit = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    near = [[b for b in range(len(rows)) if b != a and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold] for a in range(len(rows))]
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((rows[b][0] for b in seen), default=None) if i is not None else None
        out.append((i, len(near[a]), least, i == least))
    return sorted(out, key=repr)


def linked(df, **how):
    return sorted(((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_dedup(df, **how).collect()), key=repr)


def groups(rng, size, dims, spread):
    """Vectors around one direction."""
    return rng.standard_normal(dims) * 1.0 + rng.standard_normal((size, dims)) * spread


def test_embedding_dedup_against_all_pairs(spark):
    """Pairs, groups larger than a list and a block, scaled and equal vectors, chains, odd values and ties."""
    rng = np.random.default_rng(4)
    parts = [rng.standard_normal((1500, 32)), *[groups(rng, n, 32, 0.12) for n in (2, 2, 2, 3, 9, 40, 300)]]
    axis = rng.standard_normal((2, 32))
    chain = np.array([axis[0] * np.cos(a) + axis[1] * np.sin(a) for a in np.arange(0, 3, 0.25)])
    vectors = [list(map(float, v)) for v in np.concatenate([*parts, chain, np.repeat(parts[1], 12, axis=0), parts[1] * 3.5, parts[2][:1] * 1e-30])]
    vectors += [None, [], [0.0] * 32, [1.0, None] + [0.0] * 30, [float("nan")] * 32, [float("inf")] + [0.0] * 31, [1.0, 0.0], [2.0, 0.0], [1.0, -0.0], [1e300, 1e300]]
    order = rng.permutation(len(vectors))
    rows = [(int(i) * 3, vectors[k]) for i, k in enumerate(order)] + [(None, vectors[0]), (3, vectors[0]), (3, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("own")).withColumn("node", F.lit("own"))
    assert linked(df) == plain_links(rows)
    assert linked(df.where("false")) == [] and linked(df.where("vec_id is null")) == [(None, 0, None, True)]
    assert linked(df.where("vec_id = 3").limit(1))[0][1:] == (0, 3, True)


def test_two_tight_groups_that_hide_each_other(spark):
    """All lists are full of nearer copies, yet the link between the groups is found."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal(48)
    side = rng.standard_normal(48)
    b = a + side * 0.25 * np.linalg.norm(a) / np.linalg.norm(side)
    vectors = np.concatenate([v + rng.standard_normal((200, 48)) * 0.01 for v in (a, b)] + [rng.standard_normal((600, 48))])
    rows = [(i, list(map(float, v))) for i, v in enumerate(vectors)]
    assert linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == plain_links(rows)


def test_forest_spans_close_nodes():
    sketch = np.zeros((1, 6, embedding_dedup.WORDS), np.uint64)
    sketch[0, :, 0] = [0, 1, 3, 2**30 - 1, 2**31 - 1, 2**62 - 1]
    u, v, d, forest = embedding_dedup.nearest_and_forest(np.arange(6)[None] + 10, sketch, 1)
    assert sorted(zip(u[forest].tolist(), v[forest].tolist(), strict=True)) == [(11, 10), (12, 11), (14, 13)]
    assert all(bin(int(sketch[0, a - 10, 0] ^ sketch[0, b - 10, 0])).count("1") == n for a, b, n in zip(u, v, d, strict=True))


def test_audit_counts_what_is_missing(spark):
    rows = [(i, [1.0, 0.001 * i]) for i in range(20)]
    nodes = embedding_dedup.nodes_of(embedding_dedup.sketched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")).cache()
    half = nodes.select("node", F.lit(9).cast("long").alias("n")).limit(10)
    assert embedding_dedup.audited(nodes, half, 0.95, 0) == pytest.approx(90 / 380)
