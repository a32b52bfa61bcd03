"""The training-data operators against brute force, the libraries, round trips and edge cases."""

from __future__ import annotations

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import (
    chat_format, decontaminate, hashing, near_dedup, quality_classifier, quality_rules, queries, sentencepiece, substring_dedup, token_counts, toxicity, url_filter,
)

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = ["", None, " \n\t", "a", "x" * 70_000, "word " * 9_000, "<|endoftext|> ▁▁ é\x00 日本 😀", "one two three four five six"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, empty and long texts, and columns named like results."""
    rows = [(i, t, "s", "en", 1) for i, t in enumerate(ODD)] + [(None, "null id", None, None, None), (7, ODD[7], "s", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumn("score", F.lit("own")).withColumn("n_words", F.lit("own")).withColumn("class_id", F.lit("own"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.connect().execute(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = db.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = sorted(names)
    assert sorted((tuple(r[c] for c in key) for r in df.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in key) for r in cur.fetchall()), key=repr)


def by_id(df, *names):
    return sorted((tuple(r[n] for n in ("doc_id", *names)) for r in df.collect()), key=repr)


def test_edge_cases(spark, odd, labels):
    model, net = toxicity.fit([]), quality_classifier.ByteNet()
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (None, "")], "item_id long, text string")
    pieces = sentencepiece.production_model()
    empty = odd.where("false")
    for run in (
        quality_rules.quality_rules, lambda d: quality_classifier.quality_scores(d, net), substring_dedup.substring_dedup, lambda d: token_counts.token_counts(d, public_tokenizers.path(token_counts.TOKENIZER)),
        lambda d: toxicity.toxicity(d, model), lambda d: decontaminate.contamination(d, bench), near_dedup.near_duplicates, lambda d: sentencepiece.round_trips(d, pieces),
    ):
        assert run(empty).count() == 0
    ids = [*range(len(ODD)), None, 7]
    words = [len(WORD.findall(t or "")) for t in ODD]
    got = by_id(quality_rules.quality_rules(odd), "n_words", "base_failed")
    assert got == sorted([(i, n, True if i != 5 else True) for i, n in enumerate(words)] + [(None, 2, True), (7, words[7], True)], key=repr)
    assert {r[1] for r in by_id(toxicity.toxicity(odd, model), "score")} == {0.0}
    assert all(0 <= r[1] <= 1 for r in by_id(quality_classifier.quality_scores(odd, net), "score"))
    assert by_id(substring_dedup.substring_dedup(odd), "class_id", "n_links", "dup_words", "spans") == sorted([(i, i, 0, 0, "") for i in ids], key=repr)
    assert by_id(near_dedup.near_duplicates(odd), "class_id", "kept") == sorted([(i, i, True) for i in ids], key=repr)
    hits = by_id(decontaminate.contamination(odd, bench), "n_hit", "contaminated")
    assert hits == sorted([(i, 3 if i == 7 else 0, i == 7) for i in ids], key=repr)
    counts = by_id(token_counts.token_counts(odd, public_tokenizers.path(token_counts.TOKENIZER)), "n_bytes", "over_limit")
    texts = [(i, t or "") for i, t in [*enumerate(ODD), (None, "null id"), (7, ODD[7])]]
    assert [c[:2] for c in counts] == [c[:2] for c in sorted([(i, len(t.encode()), None) for i, t in texts], key=repr)] and any(c[2] for c in counts)
    trips = by_id(sentencepiece.round_trips(odd, pieces), "n_bytes", "round_trip")
    assert trips == sorted([(i, len(t.encode()), True) for i, t in texts], key=repr)


def test_columns_named_like_inner_ones(spark):
    """Columns that the operators use inside are kept."""
    df = spark.createDataFrame([(1, "one two three", "http://org/x")], "doc_id long, text string, url string")
    own = ["best", "bhost", "bpath", "__text", "__hit", "__items", "key", "id", "set"]
    for c in own:
        df = df.withColumn(c, F.lit("own"))
    bench = spark.createDataFrame([("1", "one two three")], "item_id string, text string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    outs = (
        url_filter.url_filter(df, rules), decontaminate.contamination(df, bench), token_counts.token_counts(df, public_tokenizers.path(token_counts.TOKENIZER)),
        sentencepiece.encode(df, sentencepiece.production_model()), toxicity.toxicity(df, toxicity.fit([])), decontaminate.contamination(df, bench, keep_text=True),
    )
    for out in outs:
        row = out.collect()[0]
        assert all(row[c] == "own" for c in own)
    assert near_dedup.near_duplicates(df).collect() and substring_dedup.substring_dedup(df).collect() and quality_rules.quality_rules(df.withColumn("source", F.lit("s"))).collect()


def test_url_filter_odd_tables(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    urls = ["http://org/" + "x/" * 100_000, "http://org/a", "http://org/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], len(r["path"])) for r in url_filter.url_filter(pages, rules).collect()}
    assert got == {0: ("org/", 200_001), 1: ("org/", 2), 2: ("org/", 2)}
    assert url_filter.url_filter(pages.where("false"), rules).count() == 0
    assert url_filter.url_filter(pages.unionByName(pages), rules).count() == 6


def test_chat_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, None, "system", "s")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("own"))
    got = chat_format.digests(chat_format.format_turns(turns)).collect()
    seg = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    context = [len(seg("system", "s") + seg("user", "a") + seg("user", "b")), len(seg("assistant", "x"))]
    assert len(got) == 1 and (got[0]["n_turns"], got[0]["loss_chars"], got[0]["n_examples"], got[0]["context_chars"]) == (5, 2, 2, 2 * context[0] + context[1])
    assert chat_format.digests(chat_format.format_turns(turns.where("false"))).count() == 0


def test_sentencepiece_tables(spark):
    """The encoding and decoding of a whole column, there and back."""
    import sentencepiece as library

    other, model = library.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece.MODEL)), sentencepiece.production_model()
    some = [t or "" for t in ODD] + [" a  b ", "über 日本 語"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)] + [(99, None)], "id long, text string")
    coded = sentencepiece.encode(df, model)
    got = {r["id"]: list(r["ids"]) for r in coded.collect()}
    assert got == {**{i: other.encode(t) for i, t in enumerate(some)}, 99: []}
    back = {r["id"]: r["text"] for r in sentencepiece.decode(coded, model).collect()}
    assert back == {**{i: t.replace("▁", " ") for i, t in enumerate(some)}, 99: ""}
    assert sentencepiece.decode(coded.withColumn("ids", F.lit(None).cast("array<int>")), model).where("text = ''").count() == len(some) + 1


def test_ids_with_several_texts(spark):
    """All texts of an id count, none is lost or cut by another's passages."""
    r = random.Random(31)
    own = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    a, b, c = own(80), own(80), own(70)
    rows = [(1, a), (1, b), (2, b + " " + own(5)), (3, c), (3, c), (4, a + " " + c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    got = sorted((x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicates_out(spark, docs, SF).collect())
    assert got == sorted([(1, a), (1, b), (3, c), (4, a + " " + c)])
    left = {(x["doc_id"], x["text"].strip()) for x in corpus_pipeline.passages_out(spark, docs, SF).collect()}
    assert {(1, a), (1, b), (3, c)} <= left and not any(i == 4 for i, _ in left)


def test_longest_match_with_text_ids(spark):
    bench = spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    same = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([("0a3f", same), ("0a3e", "x " + same), (None, same)], "doc_id string, text string")
    assert [tuple(r) for r in decontaminate.longest_matches(df, bench).collect()] == [("5", 20, "0a3e", 1)]


def test_repeated_words(spark):
    def brute(text):
        w = WORD.findall(text)
        n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        return len({i + k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(5)})

    r = random.Random(3)
    made = [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "id long, text string")
    got = {x["id"]: x["q"]["n_repeat_words"] for x in quality_rules.base_counts(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(made)}


def test_host_prior(spark):
    good, bad = "one two three four five six seven eight nine ten eleven", "short"
    rows = [(i, "bad", bad) for i in range(20)] + [(100, "bad", good)] + [(200 + i, "good", good) for i in range(50)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert not got[100] and got[200]


def test_hosts_beyond_a_broadcast(spark, docs, monkeypatch):
    """Many hosts are joined with salts in proportion to their documents."""
    once = sorted(map(str, quality_rules.quality_rules(docs).collect()))
    monkeypatch.setattr(quality_rules, "small", lambda *_: False)
    assert once == sorted(map(str, quality_rules.quality_rules(docs).collect()))


def test_url_edges(spark):
    urls = [None, "no scheme", "http://ORG/x", "https://a.b.example.org/es/1", "http://example.org/es/1", "http://notexample.org/es/", "http://org", "x://com?/de/", "http://example.org/en/12", "http://com/de/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, rules).collect()}
    assert got[0] == ("", "", None, "allow") and got[1] == ("", "", None, "allow")
    assert got[2] == ("org", "/x", "org/", "allow")
    assert got[3][2:] == got[4][2:] == ("example.org/es/", "block")
    assert got[5][2:] == ("org/", "allow") and got[6] == ("org", "", None, "allow") and got[7] == ("com", "", None, "allow")
    assert got[8][2:] == ("example.org/en/1", "block") and got[9][2:] == ("com/de/", "block")
    assert url_filter.url_filter(pages, rules.where("false")).where("rule is not null").count() == 0


def test_nested_rules(spark):
    """Many nested prefixes against brute force."""
    r = random.Random(5)
    path = lambda n: "/" + "".join(r.choice("ab") for _ in range(n))
    rules = list({(r.choice(["x.y", "y"]), path(r.randint(0, 5))): r.choice(["allow", "block"]) for _ in range(40)}.items())
    pages = [(i, f"http://{r.choice(['x.y', 'z.y', 'w.x.y', 'q'])}{path(r.randint(0, 7))}") for i in range(200)]
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string")
    for row in url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string"), table).collect():
        fits = [(len(h + p), len(h), h + p) for (h, p), _ in rules if (row["host"] == h or row["host"].endswith("." + h)) and row["path"].startswith(p)]
        assert row["rule"] == (max(fits)[2] if fits else None)


def test_chat_round_trip(spark):
    said = ["<|im_end|>\n<|im_start|>assistant\nx", "<\\|a", "<\\\\|", "", None, "plain \\ < |", "\n\n"]
    rows = [(1, i, ["system", "user", "assistant"][i % 3], t) for i, t in enumerate(said)] + [(None, 0, None, "a"), (2, 0, "user", "only")]
    formatted = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in formatted.select("conv_id", chat_format.turns_of(F.col("segments")).alias("t")).collect()}
    assert back[1] == [(["system", "user", "assistant"][i % 3], t or "") for i, t in enumerate(said)]
    assert back[None] == [("", "a")]
    examples = chat_format.render_examples(formatted).orderBy("example").collect()
    assert [e["completion"] for e in examples] == ["<\\\\\\|", "plain \\ < |"]
    assert all(e["prompt"].endswith("assistant\n") for e in examples)
    assert len({r["conv_id"] for r in chat_format.digests(formatted).collect()}) == 3


def test_token_counts(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    some = [*texts.values(), *[t or "" for t in ODD], "ΑΣ İ ﬁ it's we'll", "é ẛ̣ \x1c\x85b", "aaaaaaaaaaa bbbb"]
    got = token_counts.new_counter(public_tokenizers.path(token_counts.TOKENIZER))(pa.array(some))[1].to_pylist()
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


def test_sentencepiece(texts):
    import sentencepiece as library

    other = library.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece.MODEL))
    model = sentencepiece.production_model()
    r = random.Random(1)
    bits = ["a", "e", "t", "in", "the", " ", "  ", "\n", "é", "ß", "ing", "日", "😀", ".", "T", "qu", "▁", "\0"]
    some = [*texts.values(), *[t or "" for t in ODD], *("".join(r.choices(bits, k=r.randint(0, 40))) for _ in range(500))]
    got = [x.tolist() for x in sentencepiece.new_encoder(model)(some)]
    assert got == other.encode(some)
    assert [model.decode(x) for x in got] == [other.decode(x) for x in got]


def test_decontamination_blocks(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    once = sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert once == sorted(map(str, decontaminate.contamination(docs, bench).collect()))


def test_candidate_runs_without_a_hit():
    block = decontaminate.Block([("1", " ".join(f"w{i}" for i in range(20)))])
    counts, spans, found = decontaminate.hits(block, [" ".join(f"w{i}" for i in reversed(range(20)))])
    assert counts.tolist() == [20] and not len(spans[0]) and not found[0]


def test_longest_match(spark):
    bench = spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b " + " ".join(f"w{i}" for i in range(3, 20))), (2, " ".join(f"w{i}" for i in range(25)))], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate.longest_matches(df, bench).collect()] == [("5", 25, 2, 0)]


def test_dart_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    pool = hashing.mix(np.arange(1, 2001, dtype=np.uint64))
    for shared in (200, 800):
        one, two = pool[:1000], np.concatenate((pool[:shared], pool[1000 : 2000 - shared]))
        sigs = near_dedup.signatures(np.concatenate((one, two)), np.ones(2000), np.array([0, 1000, 2000]), 512, 512 * (np.log(512) + 5))
        assert abs((sigs[0] == sigs[1]).mean() - shared / (2000 - shared)) < 0.09
    weights = np.concatenate((r.uniform(0.1, 3, 300), r.uniform(0.1, 3, 300)))
    sigs = near_dedup.signatures(np.concatenate((pool[:300], pool[:300])), weights, np.array([0, 300, 600]), 512, 512 * (np.log(512) + 5))
    assert abs((sigs[0] == sigs[1]).mean() - np.minimum(weights[:300], weights[300:]).sum() / np.maximum(weights[:300], weights[300:]).sum()) < 0.09


def brute_classes(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := WORD.findall(t)) else set() for i, t in texts.items()}
    root, met = {i: i for i in texts}, collections.Counter()
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for l in by.values():
        met.update((l[b], l[a]) for a in range(len(l)) for b in range(a))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in met.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_near_duplicates(docs, texts):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes(texts)


def test_near_duplicates_of_a_larger_table(spark):
    """All pairs of different texts that are 0.8 alike in 10,000 documents share a class."""
    sf = "/root/testdata/sf0.1"
    found = duckdb.connect().execute(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet' ORDER BY 1").fetchall()
    values, _, at = near_dedup.shingle_sets(pa.array([t for _, t in found]))
    sets = {values[a:b].tobytes(): (found[k][0], values[a:b]) for k, (a, b) in reversed(list(enumerate(zip(at, at[1:], strict=False)))) if b > a}
    ids, each = zip(*sets.values(), strict=True)
    size = np.array([len(x) for x in each])
    flat, who = np.concatenate(each), np.repeat(np.arange(len(each)), size)
    order = np.argsort(flat, kind="stable")
    index, owner, pairs = flat[order], who[order], []
    for x, s in enumerate(each):
        lo, hi = np.searchsorted(index, s, "left"), np.searchsorted(index, s, "right")
        shared = np.bincount(np.concatenate([owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]), minlength=len(each))
        pairs += [(x, int(k)) for k in np.flatnonzero(shared >= 0.8 * (size + len(s) - shared) - 1e-9) if k < x]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert len(pairs) >= 40 and all(got[ids[a]] == got[ids[b]] for a, b in pairs)


def test_near_duplicates_in_pieces(spark, monkeypatch):
    """A class larger than a task's group."""
    r = random.Random(2)
    base = [f"w{r.randint(0, 999)}" for _ in range(200)]
    made = {i: " ".join(w if r.random() > 0.004 else "new" + str(i) for w in base) for i in range(60)}
    monkeypatch.setattr(near_dedup, "GROUP", 12)
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(df).collect()} == brute_classes(made)


def test_compact_windows():
    r = np.random.default_rng(1)
    values = r.integers(0, 2**63, 300).astype(np.uint64)
    row, a, k, b = substring_dedup.compact_windows(values, np.array([0, 120, 300]), 10)
    for start in range(0, 290):
        end = start + 10
        if start < 120 < end:
            continue
        at = start + int(values[start:end].argmin())
        assert ((a <= start) & (end <= b) & (k == at)).sum() == 1


def test_passages(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    own = lambda n: [word() for _ in range(n)]
    shared = own(60)
    near = shared[:30] + ["edit"] + shared[31:]
    made = {1: own(80) + shared + own(9), 2: own(7) + shared + own(50), 3: near + own(90), 4: own(200), 5: shared[:20] + own(100)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in made.items()], "doc_id long, text string")
    got = {x["doc_id"]: x for x in substring_dedup.substring_dedup(df).collect()}
    assert {i: x["class_id"] for i, x in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert (got[2]["spans"], got[3]["spans"], got[1]["spans"]) == ("7-67", "0-60", "")
    found = substring_dedup.repeated_passages(df)
    left = {x["doc_id"]: x["text"].split() for x in substring_dedup.without_passages(df, found).collect()}
    assert left[1] == made[1] and left[2] == made[2][:7] + made[2][67:] and left[3] == made[3][60:] and left[4] == made[4]


def test_passage_behind_a_shorter_line(spark):
    """The smallest document has most of a passage, too little to share it, as do many others; two share the whole."""
    r = random.Random(7)
    own = lambda n: ["".join(r.choices("abcdefgh", k=6)) for _ in range(n)]
    made = {}
    for k in range(10):
        shared = own(50)
        line = shared[3:47]
        made |= {10 * k: own(30) + line + own(30), 10 * k + 1: own(9) + line + own(40), 10 * k + 2: own(20) + shared + own(5), 10 * k + 3: own(4) + line + own(60) + shared}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in made.items()], "doc_id long, text string")
    got = {x["doc_id"]: x for x in substring_dedup.substring_dedup(df).collect()}
    assert {i: x["class_id"] for i, x in got.items()} == {i: i - 1 if i % 10 == 3 else i for i in made}
    assert all(x["spans"] == ("108-158" if i % 10 == 3 else "") and x["n_links"] == (i % 10 > 1) for i, x in got.items())


def auc(scores, truth):
    """How often a positive scores above a negative; ties count half."""
    order = np.sort(scores)
    rank = (np.searchsorted(order, scores, "left") + np.searchsorted(order, scores, "right") + 1) / 2
    n1, n0 = truth.sum(), (~truth).sum()
    return (rank[truth].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def judged(spark, sf, name, label):
    """Scores, decisions and labels of the held-out documents."""
    truth = dict(duckdb.connect().execute(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall())
    rows = [r for r in queries.QUERIES[name](spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    mod, held = (toxicity if label == "toxic" else quality_classifier).HELD
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % mod == held for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    return np.array([r["score"] for r in rows]), np.array([r["predicted"] == 1 for r in rows]), np.array([truth[r["doc_id"]] == 1 for r in rows])


def test_toxicity_on_held_out_rows(spark):
    """A constant answer has an AUC of 0.5 and no recall.  A quarter of this table's toxic labels are noise."""
    score, said, truth = judged(spark, "/root/testdata/sf0.1", "op8_toxicity", "toxic")
    assert auc(score, truth) >= 0.7 and said[truth].mean() >= 0.4 and said[~truth].mean() <= 0.02


def test_quality_on_held_out_rows(spark):
    score, said, truth = judged(spark, "/root/testdata/sf0.01", "op2_quality_classifier", "quality")
    assert auc(score, truth) >= 0.9 and said[truth].mean() >= 0.9 and said[~truth].mean() <= 0.5


def test_toxicity_finds_planted_words():
    """Words of toxic training texts in new surroundings."""
    r = random.Random(21)
    syllables = ["lo", "ra", "men", "ti", "ver", "sch", "un", "pa", "ke", "den", "or", "ist"]
    prose = lambda n: " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n))
    bad = ["grubnik", "zworfel", "quixpard", "hythmox"]

    def rude():
        words = prose(120).split()
        for _ in range(4):
            words[r.randrange(len(words))] = r.choice(bad)
        return " ".join(words)

    model = toxicity.fit([(rude(), 1) for _ in range(250)] + [(prose(120), 0) for _ in range(250)])
    truth = np.array([True] * 60 + [False] * 60)
    score = np.array(model.scorer()(pa.array([rude() for _ in range(60)] + [prose(120) for _ in range(60)]))[0])
    assert auc(score, truth) >= 0.97 and (score[truth] >= 0.5).mean() >= 0.85 and (score[~truth] >= 0.5).mean() <= 0.1
    assert any(w.encode()[1:5] in model.toxic for w in bad)


def test_pipeline_odd_rows(spark, odd, labels):
    """Null texts and ids, empty texts and repeated rows pass all stages without a crash; exact repeats go."""
    df = odd.select(*corpus_pipeline.COLUMNS)
    for c in ("gone", "twice", "id", "__id", "__spans", "__gone", "predicted", "n_words"):
        df = df.withColumn(c, F.lit("own"))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        df = stage(spark, df, SF)
    left = sorted((r["doc_id"] for r in df.collect()), key=repr)
    assert left == sorted([*range(len(ODD)), None], key=repr)
    assert corpus_pipeline.STAGES[4][1](spark, df, SF).where("round_trip").count() == len(ODD) + 1


def test_pipeline(spark, docs, texts):
    df, before = docs, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, SF).cache()
        assert 0 < df.count() <= before
        before = df.count()
        if k < 4:
            assert df.columns == docs.columns
    assert df.where("not round_trip").count() == 0


def edited(r: random.Random, n: int, at: int, cut: int, put: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` words, and the same with ``cut`` words from ``at`` replaced by ``put`` others."""
    w = np.array([r.getrandbits(63) for _ in range(n + put)], np.uint64)
    return w[:n], np.concatenate((w[:at], w[n:], w[at + cut : n]))


def test_passages_over_long_edits():
    r = random.Random(11)
    both = [(0, 100)]
    cases = {(4, 4): both, (5, 5): both, (6, 6): both, (7, 7): [], (0, 15): both, (0, 16): [(47, 100)], (10, 0): both, (13, 0): [], (3, 10): both}
    for (cut, put), spans in cases.items():
        one, two = edited(r, 100, 47, cut, put)
        assert substring_dedup.passages(one, two) == spans, (cut, put)
    one, two = edited(r, 1000, 500, 80, 80)
    assert substring_dedup.passages(one, two) == [(0, 1000)]


def brute_spans(one, two, passage):
    """All chains of equal runs, without any bound."""
    one, two, runs = one.tolist(), two.tolist(), []
    for i in range(len(one)):
        for j in range(len(two)):
            n = 0
            while i + n < len(one) and j + n < len(two) and one[i + n] == two[j + n]:
                n += 1
            if n >= 5 and not (i and j and one[i - 1] == two[j - 1]):
                runs.append((i, j, n))
    out = set()
    for k, (a, b, n) in enumerate(runs):
        sums = {k: n - 4}
        for t in range(k, len(runs)):
            x, y, m = runs[t]
            for f, total in list(sums.items()):
                u, v, w = runs[f]
                over = max(0, u + w - x, v + w - y)
                if t != f and x > u and y > v and m - over >= 5:
                    sums[t] = max(sums.get(t, -(10**9)), total + m - over - 4 - 4 * (x + y + 2 * over - u - w - v - w + 8))
            if sums.get(t, -1) >= 0 and min(x + m - a, y + m - b) >= passage:
                out.add((a, x + m))
    return substring_dedup.merged(list(out))


def test_passages_against_all_chains(monkeypatch):
    r = random.Random(12)
    for k in range(150):
        words = [r.getrandbits(63) for _ in range(r.choice((6, 40, 300)))]
        base = [r.choice(words) for _ in range(20)] + words[:120] + [r.choice(words) for _ in range(20)] + words[5:30] * r.choice((0, 1, 2))
        two = list(base)
        for _ in range(r.choice((1, 2, 3, 4))):
            at = r.randrange(len(two))
            two[at : at + r.choice((0, 1, 2, 7))] = [r.getrandbits(63) for _ in range(r.choice((0, 1, 3, 8)))]
        one, two = np.array(base, np.uint64), np.array(two, np.uint64)
        monkeypatch.setattr(substring_dedup, "MATCHES", 1 << 20 if k % 2 else 0)
        assert substring_dedup.passages(one, two, 50) == brute_spans(one, two, 50)


def test_passage_after_repeated_lines():
    """A line that repeats at a regular distance in both texts opens many chains before the passage that has it too."""
    r = random.Random(13)
    own = lambda n: [r.getrandbits(63) for _ in range(n)]
    line, passage = own(7), own(62)
    passage[20:27] = line
    near = passage[:31] + own(1) + passage[32:]
    for repeats in (8, 9, 12, 20, 200):
        texts = [np.array(sum((line + own(5) for _ in range(repeats)), []) + p + own(9), np.uint64) for p in (passage, near)]
        assert substring_dedup.passages(*texts) == [(12 * repeats, 12 * repeats + 62)]


def test_near_passage_behind_a_piece_of_it(spark):
    """The smallest document has 49 words of a passage, others have the whole, one with an edit in the middle; several families share a line."""
    r = random.Random(14)
    own = lambda n: ["".join(r.choices("abcdefgh", k=6)) for _ in range(n)]
    made = {}
    for k in range(40):
        shared = own(54)
        near = shared[:27] + own(1) + shared[28:]
        piece = shared[:49] if k % 2 else shared[5:]
        made |= {10 * k: own(30) + piece + own(30), 10 * k + 1: own(9) + shared + own(40), 10 * k + 2: own(20) + near + own(5)}
        made |= {10 * k + 3: own(10) + piece[:30] + own(10)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in made.items()], "doc_id long, text string")
    got = {x["doc_id"]: x for x in substring_dedup.substring_dedup(df).collect()}
    assert {i: x["class_id"] for i, x in got.items()} == {i: i - 1 if i % 10 == 2 else i for i in made}
    assert all(x["spans"] == ("20-74" if i % 10 == 2 else "") for i, x in got.items())


def test_passage_longer_than_the_smallest_document_has(spark):
    """The smallest document has 60 words of a passage, two others some more words before and after them."""
    r = random.Random(15)
    own = lambda n: ["".join(r.choices("abcdefgh", k=6)) for _ in range(n)]
    made, want = {}, {}
    for k in range(36):
        before, shared, after = own((0, 5)[k % 2]), own(60), own((5, 10, 20)[k % 3])
        more = before + shared + after
        made |= {10 * k: own(30) + shared + own(30), 10 * k + 1: own(9) + more + own(40), 10 * k + 2: own(20) + more + own(5)}
        want |= {10 * k: "", 10 * k + 1: f"{9 + len(before)}-{69 + len(before)}", 10 * k + 2: f"20-{20 + len(more)}"}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in made.items()], "doc_id long, text string")
    assert {x["doc_id"]: x["spans"] for x in substring_dedup.substring_dedup(df).collect()} == want


PROBES = {
    "two documents, one edit in 50 words": lambda own: (lambda p: {1: own(30) + p + own(30), 2: own(7) + p[:25] + own(1) + p[26:] + own(40)})(own(50)),
    "the smallest has 47 of 60 words": lambda own: (lambda p: {0: own(30) + p[:47] + own(30), 1: own(9) + p + own(40), 2: own(7) + p[:30] + own(1) + p[31:] + own(40)})(own(60)),
    "the smallest has both halves apart": lambda own: (lambda p: {0: own(30) + p[:30] + own(30) + p[30:] + own(9), 1: own(9) + p + own(40), 2: own(7) + p[:18] + own(1) + p[19:] + own(40)})(own(60)),
    "five words put into 80": lambda own: (lambda p: {1: own(30) + p + own(30), 2: own(7) + p[:40] + own(5) + p[40:] + own(20)})(own(80)),
}


def test_recall_of_near_alike_passages(spark):
    """Each case 40 times in one table, together with a line of 30 words that stands in every twelfth document."""
    r = random.Random(41)
    own = lambda n: ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]
    line, made, wanted = own(30), {}, []
    for k, case in enumerate(PROBES.values()):
        for j in range(40):
            base = 10_000 * k + 10 * j
            made |= {base + i: (line if (j + i) % 12 == 0 else []) + w for i, w in case(own).items()}
            wanted.append((k, base + 1, base + 2))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in made.items()], "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in substring_dedup.substring_dedup(df).collect()}
    for k in range(len(PROBES)):
        assert np.mean([got[a] == got[b] for q, a, b in wanted if q == k]) >= 0.95, list(PROBES)[k]


def test_passages_in_many_documents(spark):
    """More documents share a line than meet in full; of some of them more than the line is shared, exactly or nearly."""
    r = random.Random(42)
    own = lambda n: ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]
    line, made, pairs = own(40), {}, []
    for k in range(60):
        made[k] = own(30) + line + own(30)
    for k in range(100, 140, 2):
        more = own(25)
        near = more if k % 4 else [*more[:12], *own(1), *more[13:]]
        made |= {k: own(20) + line + more + own(20), k + 1: own(5) + line + near + own(20)}
        pairs.append((k, k + 1))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in made.items()], "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in substring_dedup.substring_dedup(df).collect()}
    assert np.mean([got[a] == got[b] for a, b in pairs]) >= 0.9
    assert all(got[k] == k for k in range(60))


def test_passages_against_brute_force(spark):
    """All pairs of the documents of a table that have five words in a row in common, compared one by one."""
    sf = "/root/testdata/sf0.01"
    texts = dict(duckdb.connect().execute(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall())
    words = {i: hashing.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for i, t in texts.items()}
    ordered = {i: substring_dedup.in_order(w) for i, w in words.items()}
    having, root = collections.defaultdict(set), {i: i for i in texts}
    for i, (values, _) in ordered.items():
        for v in set(values.tolist()):
            having[v].add(i)
    pairs = {(i, j) for ids in having.values() for i in ids for j in ids if j < i}

    def find(x):
        return x if root[x] == x else find(root[x])

    brute = collections.defaultdict(list)
    for i, j in sorted(pairs):
        if found := substring_dedup.passages(words[i], words[j], ordered=ordered[j]):
            brute[i] += found
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    got = {x["doc_id"]: x for x in substring_dedup.substring_dedup(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert {i for i in brute} == {i for i, x in got.items() if x["dup_words"]}
    assert np.mean([got[i]["class_id"] == find(i) for i in texts]) >= 0.995
    want = sum(b - a for i in brute for a, b in substring_dedup.merged(brute[i]))
    assert 0.98 * want <= sum(x["dup_words"] for x in got.values()) <= want


def test_chains_at_any_number_of_runs(monkeypatch):
    """Chains by prefix maxima find what following them one by one finds, but for runs that overlap."""
    r, same = random.Random(43), 0
    for _ in range(60):
        base = [r.getrandbits(63) for _ in range(160)] + [r.getrandbits(63) for _ in range(30)] * r.choice((1, 2))
        two = list(base)
        for _ in range(r.choice((1, 2, 3, 4))):
            at = r.randrange(len(two))
            two[at : at + r.choice((0, 1, 2, 7))] = [r.getrandbits(63) for _ in range(r.choice((1, 3, 8)))]
        one, two = np.array(base, np.uint64), np.array(two, np.uint64)
        monkeypatch.setattr(substring_dedup, "CHAINED", 600)
        exact = substring_dedup.passages(one, two)
        monkeypatch.setattr(substring_dedup, "CHAINED", 0)
        same += substring_dedup.passages(one, two) == exact
    assert same >= 57


def test_near_copies_of_a_hot_document(spark, monkeypatch):
    """Most documents are near the smallest, some only near others, in several pieces."""
    r = random.Random(44)
    base = [f"w{r.randint(0, 9999)}" for _ in range(120)]
    made = {0: " ".join(base)}
    for i in range(1, 50):
        w = list(base)
        w[r.randrange(120)] = f"new{i}"
        made[i] = " ".join(w)
    far = list(base)
    for k in (10, 40, 70):
        far[k] = f"far{k}"
    for i in range(50, 60):  # near one another and near what lies between, not near the smallest
        w = list(far)
        w[i] = f"own{i}"
        made[i] = " ".join(w)
    monkeypatch.setattr(near_dedup, "GROUP", 7)
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(df).collect()} == brute_classes(made)


def test_quality_network_against_loops():
    """The vectorised convolution against single steps, and the gradients against finite differences."""
    q = quality_classifier
    net = q.ByteNet()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    p, r = net.p, random.Random(51)
    p["b"] += 0.05
    p["c"] += 0.1  # off the kinks that an empty text would meet
    texts = ["".join(r.choices("abc dé.", k=n)) for n in (900, 30, 0)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))

    def logit(chunk):
        bytes_ = list(chunk) + [0] * (q.CHUNK - len(chunk))
        out = []
        for f in range(q.FILTERS):
            best = -1e9
            for k in range(q.CHUNK // q.HOP - 1):
                if k * q.HOP < len(chunk):
                    z = sum(p["e"][bytes_[k * q.HOP + j], c] * p["w"][(j % q.HOP) * q.EMBED + c, f + q.FILTERS * (j // q.HOP)] for j in range(2 * q.HOP) for c in range(q.EMBED))
                    best = max(best, z)
            out.append(max(0.0, best + p["b"][f]))
        hidden = np.maximum(np.array([*out, len(chunk) / q.CHUNK]) @ p["u"] + p["c"], 0)
        return hidden @ p["v"] + p["d"][0]

    want = []
    for t in texts:
        b = t.encode()
        want.append(max(logit(b[i : i + q.CHUNK]) for i in range(0, max(1, len(b) - (q.CHUNK - q.STEP)), q.STEP)))
    assert np.allclose(net.logits(data, offsets), want, atol=1e-4)

    start, size, row = q.chunks(data, offsets)
    x, y = q.cut(data, start, size), np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.logits(data, offsets)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    found = net.gradients(x, size, row, y)
    for name in p:
        at = tuple(r.randrange(n) for n in p[name].shape) if name != "e" else (ord("a"), 3)
        old, step = p[name][at], 1e-5
        p[name][at] = old + step
        up = loss()
        p[name][at] = old - step
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * step) - found[name][at]) < 1e-4, name


def test_passages_that_go_on_after_an_edit_behind_a_common_part(spark):
    """Eleven documents share 40 words of a passage; two more share all of its 58, one of them with a word edited near the end of the common part."""
    rows, want = [], {}
    for place in range(36, 48):
        for family in range(4):
            rng = random.Random(place * 100 + family)
            words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]  # noqa: B023, E731
            passage = words(58)
            rows += [(len(rows) + k, " ".join(words(60) + passage[:40] + words(60))) for k in range(11)]
            edited = [*passage[:place], "edit", *passage[place + 1 :]]
            want.setdefault(place, set()).add((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(words(60) + passage + words(60))), (len(rows) + 1, " ".join(words(60) + edited + words(60)))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    pairs = {(r["lead"], r["id"]) for r in found.select("lead", "id").collect()}
    assert all(pairs >= some for some in want.values())


def test_texts_of_several_megabytes_are_compared(spark):
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = words(80)
    texts = [f"{words(250_000)} {passage} {words(250_000)}", f"{passage} {words(300_000)}", words(300_000)]
    found = substring_dedup.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["spans"]) for r in found.collect()) == [(0, 0, 1, ""), (1, 0, 1, "0-80"), (2, 2, 0, "")]


def test_pipeline_stages_against_brute_force(spark):
    """Every stage's decisions on what its predecessor kept, made again by comparing all with all, by SQL or by the library."""
    import sentencepiece as library

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    text_of = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}

    # toxicity: what the query of operator 8 rejects goes, and nothing else
    plain = stages["toxicity"](spark, rows, sf).cache()
    judged = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op8_toxicity"](spark, sf).collect()}
    before, kept = text_of(rows), text_of(plain)
    assert kept == {i: t for i, t in before.items() if not judged[i]}

    # near duplicates: all pairs of shingle sets
    split = lambda t: WORD.findall(t or "")
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in kept.items() if (w := split(t))}
    root = {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= 0.8 * large and len(s := sets[i] & sets[j]) >= 0.8 * (small + large - len(s)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    single = stages["near_dedup"](spark, plain, sf).cache()
    kept = text_of(single)
    assert set(kept) == {i for i in root if find(i) == i}

    # passages: all pairs that have a shingle in common
    words = {i: hashing.words(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for i, t in kept.items()}
    ordered = {i: substring_dedup.in_order(w) for i, w in words.items()}
    having = collections.defaultdict(list)
    for i in sorted(ordered):
        for v in set(ordered[i][0].tolist()):
            having[v].append(i)
    pairs = {(i, j) for them in having.values() for i in them for j in them if j < i}
    spans = collections.defaultdict(list)
    for i, j in pairs:
        spans[i] += substring_dedup.passages(words[i], words[j], ordered=ordered[j])
    want = {}
    for i, t in kept.items():
        flat = [x for s in substring_dedup.merged(spans[i]) for x in s]
        want[i] = substring_dedup.cut(t, flat) if flat else t
    once = stages["substring_dedup"](spark, single, sf).cache()
    got = text_of(once)
    want = {i: t for i, t in want.items() if i in got or t == kept[i] or t.strip(" \t\n\v\f\r")}
    assert set(got) == set(want)
    assert np.mean([got[i] == want[i] for i in want]) >= 0.99
    assert all(r["n_chars"] == len(r["text"]) for r in once.where("text is not null").collect())

    # decontamination: the operator's SQL over these documents
    db = duckdb.connect()
    db.register("documents", once.select("doc_id", "text").toArrow())
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    clean = {r[0] for r in db.execute(f"SELECT doc_id FROM ({queries.SQL['op7_decontaminate']}) WHERE NOT contaminated").fetchall()}
    left = stages["decontamination"](spark, once, sf).cache()
    assert text_of(left) == {i: t for i, t in got.items() if i in clean}

    # encoding: the library's pieces, there and back
    model = library.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece.MODEL))
    texts = text_of(left)
    coded = stages["sentencepiece"](spark, left, sf).collect()
    assert {r["doc_id"]: r["n_pieces"] for r in coded} == {i: len(model.encode(t or "")) for i, t in texts.items()} and all(r["round_trip"] for r in coded)


def test_passages_of_parts_that_many_documents_have_apart(spark):
    """Eleven documents have both parts of a passage in different places; two have them behind one another, with a word between."""
    r = random.Random(45)
    own = lambda n: ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]
    made, want = {}, {}
    for family in range(8):
        one, two, base = own(30), own(24), 100 * family
        made |= {base + k: own(20) + one + own(40) + two + own(9) for k in range(11)}
        made |= {base + k: own(k) + one + own(1) + two + own(30) for k in (20, 30)}
        want[base + 30] = (base + 20, 1, "30-85")
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in made.items()], "doc_id long, text string")
    got = {x["doc_id"]: (x["class_id"], x["n_links"], x["spans"]) for x in substring_dedup.substring_dedup(df).collect()}
    assert got == {i: (i, i % 100 == 20, "") for i in made} | want


def test_rest_of_pairs_against_all_pairs():
    """What is ruled out adds to no class and to no passage; in one block and in two."""
    r = random.Random(46)
    base = [r.getrandbits(63) for _ in range(160)]
    texts = []
    for _ in range(40):
        text = base[r.randrange(60) : r.randrange(90, 160)]
        for _ in range(r.choice((0, 1, 3, 6))):
            at = r.randrange(len(text))
            text[at : at + r.choice((0, 1, 2))] = [r.getrandbits(63) for _ in range(r.choice((0, 1, 2)))]
        texts.append(np.array(text * r.choice((1, 1, 2)), np.uint64))
    want, root = collections.defaultdict(list), list(range(40))
    for i in range(40):
        for j in range(i):
            if spans := substring_dedup.passages(texts[i], texts[j]):
                want[i] += spans
                root = [root[j] if x == root[i] else x for x in root]
    words, at = np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts]))
    for sides in ([[range(40)]], [[range(20)], [range(20, 40)], [range(20), range(20, 40)]]):
        got, near = collections.defaultdict(list), list(range(40))
        for side in sides:
            for i, j, spans in substring_dedup.rest_of_pairs(words, at, np.arange(40), [[] for _ in texts], [np.array(x) for x in side], 50):
                assert spans == substring_dedup.passages(texts[i], texts[j])
                got[i] += spans
                near = [near[j] if x == near[i] else x for x in near]
        assert {i: substring_dedup.merged(x) for i, x in got.items()} == {i: substring_dedup.merged(x) for i, x in want.items()}
        assert len({(a, b) for a, b in zip(root, near, strict=True)}) == len(set(root)) == len(set(near))


def test_runs_in_turn_need_no_chains(monkeypatch):
    """Sums over runs that follow one another find what following their chains finds."""
    r, pairs = random.Random(47), []
    for _ in range(60):
        one = [r.getrandbits(63) for _ in range(200)]
        two = list(one)
        for _ in range(r.choice((2, 5, 9))):
            at = r.randrange(len(two))
            two[at : at + r.choice((0, 1, 4))] = [r.getrandbits(63) for _ in range(r.choice((1, 3, 6)))]
        pairs.append((np.array(one, np.uint64), np.array(two, np.uint64)))
    want = [brute_spans(one, two, 50) for one, two in pairs]
    monkeypatch.setattr(substring_dedup, "chains", None)
    assert [substring_dedup.passages(one, two) for one, two in pairs] == want
    for one, two in pairs:
        place = {v: k for k, v in enumerate(hashing.shingles(one, np.array([0, len(one)]))[0].tolist())}
        runs = substring_dedup.runs_by_place(np.array([place.get(v, -1) for v in hashing.shingles(two, np.array([0, len(two)]))[0].tolist()]))
        assert sorted(runs.tolist()) == sorted(substring_dedup.equal_runs(one, two, substring_dedup.in_order(two)).tolist())


def test_links_do_not_depend_on_blocks(spark, monkeypatch):
    r = random.Random(48)
    base = [f"w{r.randint(0, 9999)}" for _ in range(120)]
    texts = []
    for i in range(40):
        words = list(base)
        for k in range(r.choice((1, 3, 6))):
            words[r.randrange(120)] = f"new{i}-{k}"
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = []
    for n in (256, 4):
        monkeypatch.setattr(substring_dedup, "BLOCK", n)
        got.append(sorted(map(tuple, substring_dedup.substring_dedup(df).collect())))
    assert got[0] == got[1]


def test_chat_examples_hold_their_prefix(spark):
    """Every example has the text of all turns before it; a conversation without a reply has none."""
    rows = [(1, 0, "user", "a<|b"), (1, 1, "assistant", "c"), (1, 2, "user", "d"), (1, 3, "assistant", "e"), (2, 0, "user", "f")]
    formatted = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    segments = {r["conv_id"]: r["segments"] for r in formatted.collect()}[1]
    got = {(r["conv_id"], r["example"]): (r["n_context"], r["prefix"], r["target"]) for r in chat_format.expanded(formatted).where("target is not null").collect()}
    assert got == {(1, 0): (1, segments[0], segments[1]), (1, 1): (3, "".join(segments[:3]), segments[3])}
    digest = {r["conv_id"]: (r["n_examples"], r["context_chars"]) for r in chat_format.digests(formatted).collect()}
    assert digest == {1: (2, len(segments[0]) + len("".join(segments[:3]))), 2: (0, 0)}


def test_pairs_that_add_nothing_are_not_compared(monkeypatch):
    """A line and a repeated word that all have bring no two texts to a comparison, and one of ten copies is enough."""
    r, calls = random.Random(49), []
    own = lambda n: [r.getrandbits(63) for _ in range(n)]
    line, again, part = own(12), own(2) * 100, own(70)
    compare = substring_dedup.spans_of
    monkeypatch.setattr(substring_dedup, "spans_of", lambda *x: calls.append(1) or compare(*x))

    def pairs(texts, known):
        words, at = np.concatenate([np.array(t, np.uint64) for t in texts]), np.append(0, np.cumsum([len(t) for t in texts]))
        return list(substring_dedup.rest_of_pairs(words, at, np.arange(len(texts)), known, [np.arange(len(texts))], 50))

    lines = [own(30) + line + own(40) + again for _ in range(40)]
    assert pairs(lines, [[(82, 282)] for _ in lines]) == [] and not calls
    copies = [[*part[:k], *own(1), *part[k + 1 :]] for k in range(60, 70)] + [part + own(20)]
    assert pairs(copies, [[(0, 70)]] * 10 + [[(5, 60)]]) == [(10, 0, [(0, 70)])]


def test_passages_of_one_text_against_pairs():
    """Many texts compared at once with one, whether it has a shingle twice or not, have the passages of each pair."""
    r, some = random.Random(50), 0
    for repeat in (1, 2):
        for _ in range(12):
            base = [r.getrandbits(63) for _ in range(120)] * repeat
            texts = [base]
            for _ in range(20):
                text = base[r.randrange(60) :] + base[: r.choice((0, 30, 60))]
                for _ in range(r.choice((0, 1, 3, 6))):
                    at = r.randrange(len(text))
                    text[at : at + r.choice((0, 1, 4))] = [r.getrandbits(63) for _ in range(r.choice((0, 1, 4)))]
                texts.append(text)
            texts = [np.array(t, np.uint64) for t in texts]
            words, at = np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts]))
            got = dict(substring_dedup.passages_of_one(words, at, np.arange(1, 21), 0, 50))
            want = {i: spans for i in range(1, 21) if (spans := substring_dedup.passages(texts[i], texts[0]))}
            some += len(want)
            assert got == want
    assert some > 300
