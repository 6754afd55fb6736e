"""Each operator against a brute-force version, and on awkward input: nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns whose names clash with the operators' own."""

from __future__ import annotations

import collections
import hashlib
import html.parser
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import bwt, decontaminate, exact_dedup, html_extract, langid, line_dedup, minhash, minimizers, packing, suffix_dedup, tokens, toxicity
from tracewell.llm.common import join_keyed, partitions

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, kept string, n_lines long"
LONG_LINE = "this very common licence line is long enough to be counted"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda"]) + str(rng.randrange(40)) for _ in range(n))


def awkward() -> list[tuple]:
    rng = random.Random(7)
    base = words(rng, 120)
    edited = base.split()
    edited[60] = "changed"
    texts = [
        None, "", "   \n\t", "a", "one two three", base, base, base.replace(" ", "\n"), " ".join(edited), "é ü ñ – “quote” ½ ٣", "<|endoftext|> x <|startoftext|>",
        *[f"{words(rng, 10)}\n  {LONG_LINE.upper() if k % 2 else LONG_LINE}\t\n{words(rng, 5)}" for k in range(6)], words(rng, 30_000), LONG_LINE, f"{LONG_LINE}\n{LONG_LINE}", "aaaa" * 200,
    ]
    return [(k, t, None if k % 5 == 0 else "en", None, None, "clash", "clash", -1) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup(docs, none, spark):
    got = by_id(exact_dedup.exact_duplicates(docs))
    groups = collections.defaultdict(list)
    for r in awkward():
        groups[squeezed(r[1])].append((-len(r[1] or ""), r[0]))
    for r in awkward():
        g = groups[squeezed(r[1])]
        x = got[r[0]]
        assert (x["keep_id"], x["group_size"], x["kept"]) == (min(g)[1], len(g), min(g)[1] == r[0])
        assert x["text_sha256"] == hashlib.sha256(squeezed(r[1]).encode()).hexdigest()
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_digest_index_outlives_its_catalog_entry_and_compacts(spark, tmp_path):
    def entries(x):
        return {(r["keep_id"], r["batch"]) for r in x.best().collect()}

    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, path, buckets=2)
    a = exact_dedup.digests(spark.createDataFrame([(5, "x y"), (6, "z"), (None, "z"), (None, "lone")], "doc_id long, text string"))
    b = exact_dedup.digests(spark.createDataFrame([(1, "x  y"), (2, "new"), (3, "n e w "), (7, "z"), (9, "lone")], "doc_id long, text string"))
    index.add(a)
    assert entries(index) == {(5, 0), (6, 0), (None, 0)}
    fresh = index.fresh(index.candidates(b))
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") <= 2  # bucketed: none on the index's side
    assert {r["keep_id"] for r in fresh.collect()} == {1, 3, 9}  # a longer copy, a new text, and an id where there was none
    spark.sql(f"DROP TABLE {index.table}")  # another session knows the folder only
    again = exact_dedup.DigestIndex(spark, path)
    assert (again.buckets, again.batches) == (2, 1)
    again.add(b)
    assert entries(again) == {(1, 1), (6, 0), (3, 1), (9, 1)}
    again.compact()
    assert entries(again) == {(1, 1), (6, 0), (3, 1), (9, 1)} and again.read().count() == 4 and again.generation == 1
    again.add(a)
    assert again.read().count() == 4  # nothing better in it
    assert entries(exact_dedup.DigestIndex(spark, path)) == {(1, 1), (6, 0), (3, 1), (9, 1)}
    again.drop()
    assert not (tmp_path / "index").exists()


def test_exact_dedup_is_the_same_however_it_is_delivered(spark):
    rng = random.Random(3)
    rows = [(k if k % 7 else None, rng.choice(["a b", "ab", "a  b", "c", "", None, "d d"])) for k in range(60)] + [(3, "ab"), (3, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    one, three = (sorted(map(repr, exact_dedup.exact_duplicates(df, batches=n).select(*columns).collect())) for n in (1, 3))
    assert one == three and len(one) == 62


def brute_lines(rows, least=40, often=5):
    where = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                where[key(x)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(where.get(key(x), ())) >= often and d != max(where[key(x)]))]
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_line_dedup(docs, none):
    got = by_id(line_dedup.dedup_lines(docs))
    want = brute_lines([(r[0], r[1]) for r in awkward()])
    assert {d: (r["text"], r["tw_n_lines"], r["tw_n_dropped"]) for d, r in got.items()} == want
    assert any(v[2] for v in want.values()) and got[0]["source"] is None and got[0]["key"] == "clash" and got[0]["n_lines"] == -1
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_of_repeated_ids_null_ids_and_clashing_names(spark):
    rows = [(k, f"{LONG_LINE}\nown {k}") for k in (1, 2, 2, 3, None, None, 4)] + [(4, "another text"), (9, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS tw_keys", "'b' AS tw_doc", "'c' AS tw_own_0", "'d' AS doc", "1.5D AS seq")
    got = line_dedup.dedup_lines(df)
    assert got.columns[:-2] == df.columns and {(r["tw_keys"], r["tw_doc"], r["tw_own_0"], r["doc"], r["seq"]) for r in got.collect()} == {("a", "b", "c", "d", 1.5)}
    # five documents: null, 1, 2, 3, 4; the largest keeps the line
    want = [(k, t if k == 4 else t.replace(f"{LONG_LINE}\n", "")) for k, t in rows]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in got.collect())
    three = line_dedup.dedup_lines(df, batches=3).select("doc_id", "text").collect()
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in three)


def test_line_index_is_reversible(spark):
    rows = [(k, f"{LONG_LINE} number {k % 7}\n{LONG_LINE}") for k in range(40)]
    df = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = line_dedup.LineIndex(spark, shards=3)
    index.insert(df(rows[:15]))
    counts = lambda: {bytes(r["key"]): (r["n_docs"], r["last_doc"]) for r in index.counts.collect()}

    def members():
        held = {r["shard"]: line_dedup.CuckooFilter.from_bytes(r["filter"]) for r in index.filters.collect()}
        probe = index._shard(spark.createDataFrame([(line_dedup.line_key(f"{LONG_LINE} number {k}".encode(), 40),) for k in range(7)], "key binary")).collect()
        return [r["shard"] in held and bool(held[r["shard"]].contains(line_dedup._hashes([bytes(r["key"])]))[0]) for r in probe]

    before, known = counts(), members()
    index.insert(df(rows[15:]))
    assert counts() == {line_dedup.line_key(k.encode(), 40): v for k, v in {f"{LONG_LINE} number {j}": (len([i for i in range(40) if i % 7 == j]), max(i for i in range(40) if i % 7 == j)) for j in range(7)}.items()} | {line_dedup.line_key(LONG_LINE.encode(), 40): (40, 39)}
    full = counts()
    index.insert(df(rows[10:20]))  # held already
    assert counts() == full and index.keys == 8
    index.delete(df(rows[15:]).select("doc_id"))
    assert counts() == before and members() == known
    index.insert(df(rows[15:]))
    assert counts() == full and all(members())
    index.delete(df(rows[15:]).select("doc_id"))
    assert counts() == before and members() == known
    index.delete(df(rows[:15]).select("doc_id"))
    assert counts() == {} and not any(members())


def test_line_index_deals_its_keys_to_more_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    index = line_dedup.LineIndex(spark, shards=2)
    df = lambda ids: spark.createDataFrame([(k, f"{LONG_LINE} number {k}") for k in ids], "doc_id long, text string")
    index.insert(df(range(70)))
    index.insert(df(range(60, 130)))
    assert index.shards == 4 and index.keys == 130 and index.counts.count() == 130
    assert {r["shard"] for r in index.filters.collect()} == {0, 1, 2, 3}
    index.delete(df(range(130)).select("doc_id"))
    assert index.keys == 0 and index.counts.count() == 0
    assert not any(np.frombuffer(r["filter"], dtype=np.uint16).any() for r in index.filters.collect())


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    f = line_dedup.CuckooFilter.build(h)
    assert f.contains(h).all() and f.contains(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.001
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    f.delete(h[:10_000])
    assert f.contains(h[10_000:]).all() and f.contains(h[:10_000]).mean() < 0.001


def test_token_counts(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = by_id(tokens.token_counts(docs, path))
    for r in awkward():
        n = len(lib.encode(r[1] or "", add_special_tokens=False))
        assert (got[r[0]]["n_bytes"], got[r[0]]["n_tokens"], got[r[0]]["over_limit"]) == (len((r[1] or "").encode()), n, n > 512)
    assert tokens.token_counts(none, path).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_pretokens_and_words_give_the_library_ids(text):
    byte_level, word_level = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    if tokens.UNSURE.search(text):
        return
    found = tokens.regex.findall(tokens.BYTE_LEVEL, text)
    assert [i for w in found for i in byte_level.encode(w, add_special_tokens=False).ids] == byte_level.encode(text, add_special_tokens=False).ids
    memo = packing.Ids(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    run = text.lower().split()
    memo.learn(set(run))
    assert np.frombuffer(b"".join(memo[w] for w in run), dtype="<u4").tolist() == word_level.encode(text, add_special_tokens=False).ids


def test_a_pre_token_goes_through_the_model_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    memo, calls = packing.Ids(open(path, encoding="utf-8").read()), []
    run = memo.tokenize
    memo.tokenize = lambda word: calls.append(word) or run(word)
    words = ["walk", "walk.", "walk's", "(walk", "ñu", "ñu.", "walk."]
    lib = Tokenizer.from_file(path)
    assert [np.frombuffer(memo[w], dtype="<u4").tolist() for w in words] == [lib.encode(w, add_special_tokens=False).ids for w in words]
    assert sorted(calls) == sorted(["walk", ".", "'s", "(", "Ã±u"])


def test_packing_is_a_gapless_round_trip(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    ids = {r[0]: np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4") for r in awkward()}
    per_doc, per_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        per_doc[r["doc_id"]].append((r["start"], r["length"]))
        per_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, total in [*((sorted(v), len(ids[d])) for d, v in per_doc.items()), *((sorted(v), None) for v in per_sequence.values())]:
        at = 0
        for start, length in parts:
            assert start == at
            at += length
        assert at == total if total is not None else at <= 4096
    assert set(per_doc) == set(ids) and sorted(per_sequence) == list(range(len(per_sequence)))
    assert packing.pack(none, path).count() == 0


def test_closest_multiset_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(6)}
        room = rng.randint(0, 90)
        picked = packing.closest_multiset(counts, room)
        assert all(picked[x] <= counts[x] for x in picked)
        reach = {0}
        for x, n in counts.items():
            reach = {a + k * x for a in reach for k in range(n + 1) if a + k * x <= room}
        assert sum(x * n for x, n in picked.items()) == max(reach)


def test_min_bin_slack_places_every_piece_once():
    rng = random.Random(5)
    histogram = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(30)} | {64: 7}
    plan = packing.min_bin_slack(histogram, 64)
    filled = collections.Counter()
    for length, n in histogram.items():
        window, offset = plan.place(np.full(n, length), np.arange(n))
        for w, o in zip(window.tolist(), offset.tolist(), strict=True):
            for k in range(length):
                filled[w, o + k] += 1
    assert max(filled.values()) == 1 and len({w for w, _ in filled}) == plan.windows
    bins: list[int] = []  # against first fit decreasing
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            k = next((k for k, room in enumerate(bins) if room >= length), None)
            if k is None:
                bins.append(64 - length)
            else:
                bins[k] -= length
    assert plan.windows <= 1.01 * len(bins)


def test_language_id(spark, docs, none):
    rng = random.Random(2)
    make = {"xx": lambda: " ".join(rng.choice(["kra", "tok", "zun", "mip"]) for _ in range(30)), "yy": lambda: " ".join(rng.choice(["élu", "ona", "ira", "çaf"]) for _ in range(30))}
    rows = [(k, make["xx" if k % 3 else "yy"](), "xx" if k % 3 else "yy") for k in range(120)]
    got = by_id(langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[k]["lang_pred"] == lang and 0 <= got[k]["score"] <= 1 and got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, lang in rows)
    got = by_id(langid.identify(docs))
    assert [got[k]["lang_pred"] for k in (0, 1, 2)] == ["und"] * 3 and got[5]["lang_pred"] == "en"
    assert langid.identify(none).count() == 0
    kept = langid.keep_identified(docs, langid.train(docs.select("doc_id", "text", "lang")))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in awkward()} - {0, 1, 2, 10, 20}  # and two strings of no language


def test_scores_are_naive_bayes_counted_by_hand(spark):
    rng = random.Random(9)
    make = lambda lang: " ".join(rng.choice({"xx": ["Kra", "tok", "zun"], "yy": ["élu", "ona", "tok"]}[lang]) for _ in range(rng.randrange(1, 9)))
    rows = [(k, make(lang), lang) for k, lang in enumerate(rng.choice(["xx", "yy"]) for _ in range(60))] + [(60, "tok tok", "xx"), (60, "ona", None)]

    def features(t):
        codes = np.frombuffer(t.lower().encode("utf-32-le"), "<u4").astype(np.uint64)
        return [f for order in langid.ORDERS for f in langid.hashed(codes, order).tolist()]

    fits = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    counts = {lang: collections.Counter(f for _, t, x in fits if x == lang for f in features(t)) for lang in ("xx", "yy")}
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect())
    want = []
    for k, t, _ in rows:
        logs = {x: sum(np.log((counts[x][f] + 0.1) / (totals[x] + 0.1 * langid.SIZE)) for f in features(t)) for x in counts}
        ease = min(1.0, langid.EVIDENCE / (3 * len(t)))
        best = max(sorted(logs), key=logs.get)
        want.append((k, best, 1 / sum(np.exp(ease * (v - logs[best])) for v in logs.values())))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4


def test_texts_of_other_scripts_and_unsure_ones_are_not_kept(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["the", "house", "of", "water", "and", "stone"]) for _ in range(40)), "en") for k in range(30)]
    rows += [(100, "съешь ещё этих мягких французских булок да выпей чаю", None), (101, "the water", None), (102, "水と石の家があります", None), (100, "the stone house", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.filter("doc_id < 30"))
    kept = langid.keep_identified(df, model).collect()
    assert sorted(r["doc_id"] for r in kept) == [*range(30), 100, 101] and {r["text"] for r in kept if r["doc_id"] == 100} == {"the stone house"}
    assert langid.keep_identified(df, model, least=1.01).count() == 0


def test_long_texts_count_each_ngram_once(monkeypatch):
    texts = ["abcdefgh" * 40, "", "a", "ab", "xyz" * 50]
    monkeypatch.setattr(langid, "WINDOW", 37)
    got = np.zeros((len(texts), langid.SIZE + 1), dtype=int)
    for which, starts, codes, counted in langid.windows(texts):
        for order in langid.ORDERS:
            np.add.at(got, (np.repeat(which, np.diff(starts)), langid.grams(starts, codes, counted, order)), 1)
    for k, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.uint64)
        want = np.zeros(langid.SIZE + 1, dtype=int)
        for order in langid.ORDERS:
            np.add.at(want, langid.hashed(codes, order), 1)
        assert (got[k, : langid.SIZE] == want[: langid.SIZE]).all()


def test_decontamination_of_changed_parameters(spark, docs, none):
    item = "A train travels 120 km in 3 hours and then rests for 45 minutes before Alice boards it again with 120 bags"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id long, text string")
    same = f"Intro words here. {item} And more words follow."
    moved = same.replace("120", "90").replace("3 hours", "5 hours").replace("Alice", "Bob")
    clash = same.replace("120 km", "90 km").replace("120 bags", "70 bags")
    half = same[: len(same) // 2]
    rows = spark.createDataFrame([(1, same, 0), (2, moved, 0), (3, clash, 0), (4, half, 0), (5, None, 0), (6, "", 0), (7, moved.upper(), 0)], "doc_id long, text string, item_id int")
    got = by_id(decontaminate.contaminated(rows, bench))
    assert (got[1]["item_id"], got[1]["contaminated"], got[1]["changed"]) == (1, True, False)
    assert got[2]["contaminated"] and got[2]["changed"]
    assert not any(got[k]["contaminated"] for k in (3, 4, 5, 6))
    assert decontaminate.contaminated(none, bench).count() == 0
    assert not by_id(decontaminate.contaminated(docs, bench))[0]["contaminated"]
    assert decontaminate.contaminated(rows, bench.limit(0)).filter("contaminated").count() == 0
    plan = decontaminate.contaminated(rows, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination_of_names_in_other_case_and_of_short_items(spark):
    item = "we saw how Alice walked to the old market before lunch and asked Robert for some bread while later that day Maria sold him two apples"
    bench = spark.createDataFrame([(1, item), (2, "purple walrus paradox"), (3, "\u8fd9\u662f\u4e00\u4e2a\u6d4b\u8bd5"), (4, "take 7 steps")], "item_id long, text string")
    texts = [item.lower(), item.upper(), item.replace(" Alice", "\nAlice").replace(" Robert", "  Robert").replace(" Maria", "\tMaria"),
             item.replace("Alice", "Bob"), "the Purple Walrus paradox is here", "\u8fd9\u662f\u4e00\u4e2a\u6d4b\u8bd5", "now take 7 steps", "now take 9 steps", "purple paradox walrus"]
    got = by_id(decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench))
    assert [got[k]["item_id"] if got[k]["contaminated"] else None for k in range(9)] == [1, 1, 1, 1, 2, 3, 4, None, None]
    assert all(got[k]["n_matched"] == got[k]["n_windows"] for k in range(7)) and [got[k]["changed"] for k in range(4)] == [False, False, False, True]


def test_the_decontamination_query_matches_as_its_sql_does(spark, tmp_path):
    import duckdb

    from tracewell.llm import queries

    item = "we saw how Alice walked to the old market before lunch and asked Robert for some bread while later that day Maria sold him two apples"
    texts = [item, item.lower(), item.upper(), item.replace(" Alice", "\nAlice"), item.replace("Alice", "Bob"), item.replace("two", "3"), "the purple walrus paradox", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "purple walrus paradox")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op5_decontamination"]).fetchall()
    assert sorted(map(tuple, queries.op5_decontamination(spark, str(tmp_path)).collect())) == sorted(want)


def brute_spans(rows, width=100):
    first, out = {}, {}
    data = sorted((d, (t or "").encode()) for d, t in rows)
    for d, b in data:
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], (d, i))
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < (d, i):
                gone[i : i + width] = b"\1" * width
        out[d] = (bytes(x for x, g in zip(b, gone, strict=True) if not g), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))))
    return out


def test_suffix_dedup(spark, docs, none, monkeypatch):
    rng = random.Random(11)
    passage = words(rng, 40)
    rows = [(k, f"{words(rng, 15)} {passage if k % 2 else passage[k:250 + k]} {words(rng, 15)}") for k in range(40)] + [(k + 100, r[1]) for k, r in enumerate(awkward()) if r[1] is None or len(r[1]) < 5000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_spans(rows)
    for hot in (20_000, 3):  # with and without names that have very many runs
        monkeypatch.setattr(suffix_dedup, "HOT_NAME", hot)
        got = by_id(suffix_dedup.remove_repeats(df.repartition(5)))
        assert {d: (bytes(r["kept"]), r["n_bytes"], r["n_removed"], len(r["spans"])) for d, r in got.items()} == want
    assert sum(v[2] for v in want.values()) > 1000
    assert suffix_dedup.remove_repeats(none).count() == 0 and suffix_dedup.remove_repeats(docs).count() == len(awkward())


def test_runs_cover_every_window_once():
    rng = np.random.default_rng(4)
    for data in (rng.integers(0, 3, 1000), np.zeros(500), rng.integers(0, 256, 100), np.zeros(99)):
        _, _, start, count = minimizers.runs(data.astype(np.uint8))
        assert np.array_equal(np.concatenate([np.arange(a, a + n) for a, n in zip(start, count, strict=True)]) if len(start) else [], np.arange(max(0, len(data) - 99)))
        assert count.max(initial=0) < suffix_dedup.PLACE


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=9), st.integers(20, 400))
def test_merged_transforms_find_all_repeats(strings, shard):
    width = 12
    string, place, interval = bwt.repeated(strings, width, shard)
    got = collections.defaultdict(set)
    for s, p, k in zip(string.tolist(), place.tolist(), interval.tolist(), strict=True):
        got[k].add((s, p))
    want = collections.defaultdict(set)
    for k, s in enumerate(strings):
        for i in range(len(s) - width + 1):
            want[s[i : i + width]].add((k, i))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_interleave_gives_common_prefixes():
    strings = [b"banana", b"bandana", b"ananas"]
    shards = [bwt.Shard.build([s], 16) for s in strings]
    which, common = bwt.merge(shards, 8)
    suffixes = sorted((s[i:] + b"\0", k) for k, s in enumerate(strings) for i in range(len(s) + 1))
    plain = [x for x, _ in suffixes]
    assert len(which) == len(plain)
    for k in range(1, len(plain)):
        a, b = plain[k - 1], plain[k]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        if b"\0" not in a[:n]:  # beyond the terminator rotations go on differently
            assert common[k] == min(n, 8)


def brute_components(rows, percent=75):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        n = min(5, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates(spark, docs, none):
    rng = random.Random(13)
    rows = [(r[0], r[1]) for r in awkward()]
    for family in range(6):
        base = words(rng, rng.choice([6, 40, 200])).split()
        for k in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(9)}"
            rows.append((1000 + family * 100 + k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = by_id(minhash.near_duplicates(df))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute_components(rows)
    assert all(r["kept"] == (r["component_id"] == d) for d, r in got.items())
    assert minhash.near_duplicates(none).count() == 0 and minhash.near_duplicates(docs).count() == len(awkward())
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(odd).collect() if r["doc_id"] is not None) == [(4, 4), (4, 4)]


def test_no_link_is_lost_in_a_family_just_under_the_threshold(spark):
    base, tail = [f"w{k}" for k in range(204)], 39  # 200 shingles in common, 39 of their own: similarity 0.72
    rows = []
    for k in range(400):
        own = [f"t{k}x{j}" for j in range(tail)]
        if k < 20:  # pairs that share 8 of them: 208 of 270
            own[:8] = [f"pair{k // 2}x{j}" for j in range(8)]
        rows.append((k, " ".join(base + own)))
    random.Random(4).shuffle(rows)
    rows = [(7 * k, text) for k, (_, text) in enumerate(rows)]
    want = brute_components(rows)
    assert sum(c != d for d, (_, c) in want.items()) == 10
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want


def test_open_families_of_mixed_sizes_match_brute_force(spark):
    rng = random.Random(31)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(500):  # eight changed words each: just under the threshold to one another
        copy = list(base)
        for j in rng.sample(range(300), 8 if k % 3 else 5):
            copy[j] = f"v{k}x{j}"
        rows.append(copy)
        if k < 30:  # one closer mate
            mate = list(copy)
            for j in rng.sample(range(300), rng.choice([2, 6, 10])):
                mate[j] = f"m{k}x{j}"
            rows.append(mate if k % 2 else mate + [f"tail{k}x{j}" for j in range(rng.randrange(60))])
    rows = [(11 * k, " ".join(t)) for k, t in enumerate(rng.sample(rows, len(rows)))]
    want = brute_components(rows)
    assert sum(c != d for d, (_, c) in want.items()) >= 20
    job = minhash.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in by_id(job.run()).items()} == want
    assert job.finish[0] < 140_000 / 2


def test_parities_bound_the_difference(spark):
    rng = np.random.default_rng(8)
    rows = []
    for n in (3, 200, 255, 260, 700, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for gone in (0, 1, n // 5):
            y = np.unique(np.append(x[gone:], rng.integers(0, 1 << 63, gone // 2, dtype=np.uint64)))
            rows.append((minhash.parity(x).tolist(), minhash.parity(y).tolist(), len(np.setxor1d(x, y))))
    got = spark.createDataFrame(rows, "x array<long>, y array<long>, d long").select("d", minhash.differing("x", "y").alias("k")).collect()
    assert all(r["k"] <= r["d"] and r["k"] >= 0.7 * r["d"] for r in got) and any(len(a) != len(b) for a, b, _ in rows)


def test_rows_that_repeat_an_id_with_other_texts_are_judged_by_their_own(spark):
    text, other = words(random.Random(1), 60), words(random.Random(2), 60)
    rows = [(1, text), (2, text + " more"), (2, other), (3, other), (3, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_shingles"] > 0, r["kept"]) for r in got) == [(1, 1, True, True), (2, 1, True, False), (2, 2, True, True), (3, 2, True, False), (3, 3, False, True)]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(6)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 50, 50))
    s = minhash.signatures([np.unique(np.concatenate([common, x])) for x in (a, b)])
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.15
    small = minhash.signatures([np.unique(common[:3]), np.unique(common[:3])])
    assert (small[0] == small[1]).all() and set(small[0].tolist()) <= set(common[:3].tolist())


def test_toxicity(spark, docs, none):
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "sit"]) for _ in range(20))
    rows = [(k, f"{filler()}. {filler()} {'you idiot' if k % 4 == 0 else 'grumbelwort' if k % 4 == 1 else 'table'} {filler()}.") for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 < 2)) for k, _ in rows] + [(3, 1, None)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.classify(d, labels))
    assert all(got[k]["predicted"] == int(k % 4 < 2) for k, _ in rows if got[k]["held_out"])
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    out = toxicity.classify(docs, labels.filter("doc_id < 0"))
    assert out.count() == len(awkward()) and toxicity.classify(none, labels).count() == 0


def test_grammar_tells_negation_speech_and_target_apart():
    g = toxicity.Grammar()
    m = toxicity.ToxicityModel(*toxicity._lexicon([], g), toxicity.prior(g))

    def score(t):
        return float(m.features(t, g)[0] @ m.weights)

    assert score("you are an idiot") > score("an idiot") > score("you are not an idiot") > score("hello there")
    assert score("you are an idiot") > score("she said you are an idiot")
    assert [g.patterns[p] for p in m.clauses("he said you are not an idiot", g)[0][1]] == ["INSULT-negated-reported-aimed"]
    assert [c for c, _ in m.features("One fine clause. You idiot! Another.", g)[1]] == ["you idiot"]


@given(st.lists(st.sampled_from([*toxicity.SYMBOLS[:6], "OTHER"]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_composed_grammar_is_the_rules_one_by_one(symbols):
    g = toxicity.Grammar()
    want, total = collections.Counter(), 0.0
    for k, s in enumerate(symbols):
        hit = s in ("INSULT", "THREAT")
        if s == "TARGET" and "TARGET" not in symbols[:k] and {"INSULT", "THREAT"} & set(symbols[:k]):
            want["AIMED-BACK"] += 1
            total += 0.5
        if hit:
            name, weight = s, 4.0 if s == "INSULT" else 3.0
            for mark, applies, change in (("negated", "NEGATION" in symbols[max(0, k - 3) : k], -2.0), ("reported", "SPEECH" in symbols[:k], -1.5), ("aimed", "TARGET" in symbols[:k], 1.0)):
                if applies:
                    name, weight = f"{name}-{mark}", weight + change
            want[name] += 1
            total += weight
    found, weight = g.clause(symbols, {s: g.index[s] for s in symbols})
    assert {g.patterns[p]: n for p, n in found.items()} == want and abs(weight - total) < 1e-9


def test_fitted_weights_stand_on_the_arcs():
    g = toxicity.Grammar()
    w = toxicity.prior(g)
    w[g.patterns.index("INSULT-aimed")] = 7.5
    fitted = toxicity.Grammar(w)
    lexicon, _ = toxicity._lexicon([], g)
    assert fitted.clause(["you", "idiot"], lexicon)[1] == 7.5 and g.clause(["you", "idiot"], lexicon)[1] == 5.0


PIECES = st.recursive(
    st.sampled_from(["plain words", "a &amp; b", "x&nbsp;y", "<b>bold</b> text", "line<br>break", "<script>no()</script>", "<!-- none -->", "&#233;t&eacute;", "  \n "]),
    lambda inner: st.tuples(st.sampled_from(["p", "div", "ul", "li", "h2", "span", "nav", "aside", "form", "section", 'div class="ad"', 'p class="lead"', 'div id="comments"']), st.lists(inner, max_size=3)).map(
        lambda x: f"<{x[0]}>{''.join(x[1])}</{x[0].split()[0]}>"),
    max_leaves=12,
)


@given(st.lists(PIECES, max_size=5), st.lists(PIECES, max_size=2))
@settings(max_examples=200, deadline=None)
def test_article_text_is_that_of_a_plain_parser(inside, outside):
    class Plain(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.blocks, self.now = [], [], ""

        def end_block(self):
            if text := " ".join(self.now.split()):
                self.blocks.append(text)
            self.now = ""

        def shown(self):
            names = [n for n, _ in self.stack]
            return "article" in names and not any(hidden for _, hidden in self.stack)

        def handle_starttag(self, tag, attrs):
            hidden = tag in ("nav", "aside", "form", "script") or dict(attrs).get("class") == "ad" or dict(attrs).get("id") == "comments"
            if tag == "br":
                self.now += " "
            elif tag not in ("b", "span", "script"):
                self.end_block()
            if tag != "br":
                self.stack.append((tag, hidden))

        def handle_endtag(self, tag):
            if tag not in ("b", "span", "script"):
                self.end_block()
            self.stack.pop()

        def handle_data(self, data):
            if self.shown():
                self.now += data

    page = f"<html><body>{''.join(outside)}<article>{''.join(inside)}</article>{''.join(outside)}</body></html>"
    parser = Plain()
    parser.feed(page)
    found = html_extract.blocks(page)
    assert [t for r, t in found if r == html_extract.ARTICLE] == parser.blocks


def test_html_extraction(spark):
    shared = "<div class='x'><p>Shared line one</p><p>Shared line two</p></div>"
    pages = [
        (1, "http://h.org/a/1", f"<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav>menu</nav>{shared}<p>Own &amp; first&nbsp;text<br>goes on</p><footer>f</footer></body>"),
        (2, "http://h.org/a/2", f"<body>{shared}<p>Second page</p>"),
        (3, "http://h.org/b", "<main><h1>T</h1><div class='comments'><p>c</p></div><p>m</p></main><p>out</p>"),
        (4, "http://h.org/c", "<article><header><h1>Head</h1></header><p>One<p>Two<div class=ad>ad</div><aside>s</aside></article><p>after</p>"),
        (5, "http://h.org/c", "<article><header><h1>Head</h1></header><p>One<p>Two</article>"),
        (6, None, None), (7, "::bad::", ""), (8, "http://h.org/d", "<p>cut &amp; off &am"), (9, "http://h.org/d", "<article><p>x</article"), (10, "http://h.org/e", "<div class=ad><article><p>kept</p></article>"),
    ]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(spark.createDataFrame([(*p, 7) for p in pages], "page_id long, url string, html string, text int")).collect()}
    want = {1: "Own & first text goes on", 2: "Second page", 3: "T\n\nm", 4: "Head\n\nOne\n\nTwo", 5: "Head\n\nOne\n\nTwo", 6: "", 7: "", 8: "cut & off &am", 9: "x", 10: "kept"}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    found = [a[i] for i in sorted(html_extract.common_lines(a, b))]
    rest = iter(b)
    assert len(found) == table[-1][-1] and all(any(x == y for y in rest) for x in found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14), st.integers(1, 40))
def test_common_lines_of_long_pages_are_as_long(a, b, cells):
    want = len(html_extract.common_lines(a, b))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(html_extract, "CELLS", cells)
        found = sorted(html_extract.common_lines(a, b))
    rest = iter(b)
    assert len(found) == want and all(a[k] in rest for k in found)


def test_long_pages_share_lines_that_occur_twice_or_out_of_order():
    x, y = [-1 - k for k in range(2100)], [-5000 - k for k in range(2100)]
    menu = list(range(1, 30))
    assert len(html_extract.common_lines(x[:1] + menu + x[1:] + menu, y[:1] + menu + y[1:] + menu + y[:1])) == 58
    assert len(html_extract.common_lines([99, *x, *menu, -3], [-9000, *y, *menu, -9001, 99])) == 29


def test_hot_keys_join_like_others(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m"))
    out = join_keyed(rows, keyed, "k", "n", 5000)
    assert out.count() == 5000 and out.filter("k = 0 and m = 0").count() == 3000 and out.columns == ["k", "id", "m"]
    assert partitions(spark, 10, 100) == int(spark.conf.get("spark.sql.shuffle.partitions"))
