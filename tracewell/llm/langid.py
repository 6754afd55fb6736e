"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded, documented sample of labelled rows, whole texts; the log-probability matrix, 0.25 MB
a language, is broadcast. Scoring gathers matrix rows by hashed n-gram and sums them per document in numpy. No text is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n-gram lengths, and bits of their hash.
ORDERS, BITS = (1, 2, 3), 16
SIZE = 1 << BITS
#: Labelled rows a language that training takes, in expectation, chosen by the hash of their id. A bound of the fit, not of scoring.
TRAIN_ROWS = 4000
#: Characters worked on at once; longer texts go through in windows that overlap by the longest n-gram.
WINDOW = 1_000_000
#: n-grams that count as independent evidence in a score; beyond that the evidence is averaged.
EVIDENCE = 200
#: A filter keeps texts whose best language has this probability, and whose n-grams are likelier in it than drawn evenly.
LEAST_SCORE, UNLIKE = 0.5, -BITS * math.log(2)
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def hashed(codes: np.ndarray, order: int) -> np.ndarray:
    """The hashed n-grams that start at each position with `order` characters left."""
    n = len(codes) - order + 1
    h = np.full(max(0, n), order * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64)
    for k in range(order):
        h = (h ^ codes[k : n + k]) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(document, start, codes of the documents end to end, order's overlap): blocks of about WINDOW characters.

    Yields (which, starts, codes, n) where which[k] is the text of the k-th run and starts its first code.
    """
    which: list[int] = []
    parts: list[str] = []
    size = 0
    reach = max(ORDERS) - 1
    for i, t in enumerate(texts):
        low = t.lower()
        for at in range(0, max(1, len(low)), WINDOW):
            part = low[at : at + WINDOW + reach]
            which.append(i)
            parts.append(part)
            size += len(part)
            if size >= WINDOW:
                yield _block(which, parts)
                which, parts, size = [], [], 0
    if parts:
        yield _block(which, parts)


def _block(which: list[int], parts: list[str]):
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    # a run longer than WINDOW repeats its last characters in the next run, so it counts n-grams that start before them
    starts_at = np.minimum(lengths, np.where(lengths > WINDOW, WINDOW, lengths))
    return np.array(which), np.append(0, np.cumsum(lengths)), codes, starts_at


def grams(starts: np.ndarray, codes: np.ndarray, counted: np.ndarray, order: int) -> np.ndarray:
    """Hashed n-grams by position; SIZE, a row of zeros, where none starts."""
    out = np.full(len(codes), SIZE, dtype=np.int64)
    h = hashed(codes, order)
    out[: len(h)] = h
    lengths = np.diff(starts)
    last = np.minimum(counted, lengths - order + 1).clip(0)  # n-grams that start in each run
    for back in range(int((lengths - last).max(initial=0))):
        at = starts[1:] - 1 - back
        out[at[(lengths - last > back)]] = SIZE
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    logs: np.ndarray  # (SIZE + 1, languages), float32; the last row is zero

    def score(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """The best language and its probability, and the mean log probability of the text's n-grams in it."""
        total = np.zeros((len(texts), len(self.langs)))
        n = np.zeros(len(texts))
        for which, starts, codes, counted in windows(texts):
            filled = np.flatnonzero(np.diff(starts))
            for order in ORDERS:
                g = grams(starts, codes, counted, order)
                if len(filled):
                    np.add.at(total, which[filled], np.add.reduceat(self.logs[g], starts[:-1][filled], axis=0, dtype=np.float64))
            np.add.at(n, which, np.diff(starts) * len(ORDERS))
        eased = total * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
        p = np.exp(eased - eased.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        known = [bool(LETTER.search(t)) for t in texts]
        return (
            [self.langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)],
            [float(p[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))],
            [float(total[i, b] / max(1.0, n[i])) for i, b in enumerate(best)],
        )


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS, alpha: float = 0.1) -> LanguageModel:
    """Fit on labelled(doc_id, text, lang), null langs left out. An empty table gives a model that knows no language."""
    rows = labelled.filter("lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((SIZE + 1, 0), dtype=np.float32))
    million = 1 << 20
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(min(million, million * train_rows // sizes[k] + 1))))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(million)) < share[F.col("lang")])
    index = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), SIZE + 1), dtype=np.int64)
        for batch in batches:
            label = np.array([index[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for which, starts, codes, counted in windows([t or "" for t in batch.column(0).to_pylist()]):
                own = np.repeat(label[which], np.diff(starts)) * (SIZE + 1)
                for order in ORDERS:
                    counts += np.bincount(own + grams(starts, codes, counted, order), minlength=counts.size).reshape(counts.shape)
        lang, feature = np.nonzero(counts[:, :SIZE])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(feature, pa.int32()), pa.array(counts[lang, feature], pa.int64())], names=["lang", "feature", "n"])

    summed = sample.select("text", "lang").mapInArrow(count, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((SIZE, len(langs)))
    counts[summed["feature"].to_numpy(), summed["lang"].to_numpy()] = summed["n"].to_numpy()
    logs = np.log((counts + alpha) / (counts.sum(axis=0) + alpha * SIZE))
    return LanguageModel(langs, np.vstack([logs, np.zeros((1, len(langs)))]).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs(doc_id, text).

    `und` with score 0 where the text is null or has no letter, or the model knows no language. Texts of any length are scored whole, in
    windows. Repeated rows, ids that repeat with other texts and null ids pass through, each predicted from its own text; of equally
    likely languages the first by name is given. Other columns are ignored, an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            langs, scores = sent.value.score(texts)[:2] if sent.value.langs else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = LEAST_SCORE, unlike: float = UNLIKE) -> DataFrame:
    """The rows of docs, all columns, whose text the model takes for one of its languages.

    A row goes if its text is null or has no letter, if the best language has a probability under `least`, or if the text's n-grams are, on
    average, less likely in it than n-grams drawn evenly (mean log probability under `unlike`): texts of other languages and scripts, and
    strings of no language. Each row is judged by its own text, whatever its id. A model that knows no language rejects nothing but texts
    without a letter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if sent.value.langs:
                good = [x != UNDETERMINED and p >= least and m >= unlike for x, p, m in zip(*sent.value.score(texts), strict=True)]
            else:
                good = [bool(LETTER.search(t)) for t in texts]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(fold: int, folds: int = 4):
    """Whether crc32 of doc_id as text is `fold` modulo `folds`; a null doc_id is hashed as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents outside the held-out fold (crc32 mod 4 = 2), predict all: doc_id, held_out, lang_pred, score."""
    model = train(docs.filter(~held_out(2)).select("doc_id", "text", "lang"))
    return predict(docs, model).withColumn("held_out", held_out(2)).select("doc_id", "held_out", "lang_pred", "score")
