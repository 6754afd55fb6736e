"""The pipeline stage by stage against brute force, on a small corpus with planted cases."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .test_text_operators import LONG_LINE, brute_components, brute_lines, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    item = words(rng, 30)
    near = words(rng, 150).split()
    texts = [words(rng, 40) for _ in range(20)] + [f"{words(rng, 8)}\n{LONG_LINE}" for _ in range(7)]
    texts += [" ".join(near), " ".join([*near[:-1], "other"]), f"{words(rng, 20)} {item} {words(rng, 20)}", None, "123 !!", ""]
    path = tmp_path_factory.mktemp("sf")
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, item


def test_each_stage_against_brute_force(spark, corpus, tmp_path):
    sf, rows, item = corpus
    left = {r[0]: r[1] for r in rows}
    want = []
    left = {d: t for d, t in left.items() if t and any(c.isalpha() for c in t)}
    want.append(dict(left))
    left = {d: v[0] for d, v in brute_lines(list(left.items())).items()}
    want.append(dict(left))
    left = {d: left[d] for d, (_, c) in brute_components(list(left.items())).items() if c == d}
    want.append(dict(left))
    left = {d: t for d, t in left.items() if item not in t}
    want.append(dict(left))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == docs.columns, name
            assert {r["doc_id"]: r["text"] for r in out.collect()} == want[k], name
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        docs = out
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {d: len(lib.encode(t, add_special_tokens=False).ids) + 1 for d, t in want[3].items()}
    got = {}
    for r in docs.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == tokens
    assert len(want[0]) == len(rows) - 3 and len(want[2]) < len(want[1]) and len(want[3]) == len(want[2]) - 1


def test_run_and_odd_rows(spark, corpus, tmp_path):
    sf, rows, _ = corpus
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and int(np.max([r["offset"] + r["length"] for r in out.collect()])) <= 4096
    odd = [(None, "Some words without an id", None, None, None), *[(5, "The same row again and again", "en", None, None)] * 2, (6, None, None, None, None)]
    extra = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(odd, extra).selectExpr("*", "'x' AS n_lines", "1 AS bucket").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r["doc_id"] or -1 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [-1, 5, 5]
    empty = tmp_path / "empty"
    spark.createDataFrame([], SCHEMA).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
