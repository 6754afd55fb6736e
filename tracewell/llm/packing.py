"""Packing by minimum bin slack.

Texts are tokenised once and cut into full windows and one remainder each. Only the counts of piece
lengths, at most `capacity` numbers whatever the corpus' size, reach the driver; there a bitset subset-sum
picks for the longest piece left the multiset of further lengths that comes closest to a full window,
and uses that pattern as often as the counts allow. Pieces then find their window by their rank within
their length, so nothing but (document, length, checksum) is ever shuffled.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import materialize
from tracewell.llm.tokens import MEMO, UNSURE, WORD_LEVEL, blocks, tokenizer

#: Rows of a rank chunk, so that one common length is ranked by many tasks.
CHUNK = 2000


#: The vocabulary's names of the bytes that it doesn't show as themselves.
HIDDEN = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b > 173))}


class Ids(dict):
    """Word to its ids as little-endian unsigned 32-bit bytes, worked out on first sight. No token of the vocabulary spans white space, so a
    run without any stands alone. A word of several pre-tokens is made of theirs, so each pre-token goes through the model once."""

    def __init__(self, blob: str):
        super().__init__()
        self.tokenize = tokenizer(blob).model.tokenize  # words come split and in lower case, so only the model is left to run
        self.find = regex.compile(WORD_LEVEL).findall

    def split(self, word: str) -> list[str]:
        """Pre-tokens of a word; the two common shapes need no pattern."""
        if word.isalpha():
            return [word]
        if word[:-1].isalpha() and not word[-1].isalnum():
            return [word[:-1], word[-1]]
        return self.find(word)

    def __missing__(self, word: str) -> bytes:
        found = self.split(word)
        if len(found) == 1:
            piece = found[0]
            ids = [t.id for t in self.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(HIDDEN))]
            coded = struct.pack(f"<{len(ids)}I", *ids)
        else:
            coded = b"".join(map(self.__getitem__, found))
        self[word] = coded
        return coded

    def learn(self, words: Iterable[str] = ()) -> None:
        """Start anew if too much is remembered, then work out these words."""
        if len(self) > MEMO:
            self.clear()
        for word in words:
            self[word]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Cut each document's ids, with end_id behind them, into windows of `capacity` and a remainder:
    doc_id, start, length, ids_crc32, doc_tokens."""
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(blob.value)
        memo = Ids(blob.value)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            docs_left = iter(batch.column(0).to_pylist())
            for block in blocks(batch.column(1).to_pylist(), 1_000_000):
                memo.learn()
                for t in block:
                    if UNSURE.search(t):
                        coded = np.asarray(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() + end
                    else:
                        coded = b"".join(map(memo.__getitem__, t.lower().split())) + end
                    doc, n = next(docs_left), len(coded) // 4
                    for start in range(0, n, capacity):
                        part = coded[4 * start : 4 * (start + capacity)]
                        for column, v in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                            column.append(v)
            types = [batch.schema.field(0).type, *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(cut, f"doc_id {rows.schema[0].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def closest_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the counted lengths with the largest sum within room, by bitset subset sums.

    Each length enters in binary portions, so a layer is one shift; the set bits are the sums that can be
    reached. It stops at an exact fit. Walking the layers back gives the counts.
    """
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, portion = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            n = min(portion, left)
            layers.append((length, n, reach))
            reach |= reach << (n * length) & mask
            left -= n
            portion *= 2
        if reach >> room & 1:
            break
    best, picked = reach.bit_length() - 1, {}
    for length, n, before in reversed(layers):
        if not before >> best & 1:
            picked[length] = picked.get(length, 0) + n
            best -= n * length
    return picked


@dataclass
class Plan:
    """Where ranks go: for each length, runs of ranks that fill one pattern. Arrays are sorted by (length, first)."""

    length: np.ndarray
    first: np.ndarray
    per_window: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    windows: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and offset of the rank-th piece of a length."""
        big = np.int64(1) << 44
        k = np.searchsorted(self.length * big + self.first, length * big + rank, side="right") - 1
        within = rank - self.first[k]
        return self.window[k] + within // self.per_window[k], self.offset[k] + within % self.per_window[k] * length


def min_bin_slack(histogram: dict[int, int], capacity: int) -> Plan:
    """Fill windows from the longest length down; repeat each pattern while the counts last."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(counts, 0)
    runs, windows = [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        picked = closest_multiset(counts, capacity - longest) if longest < capacity else {}
        counts[longest] += 1
        picked[longest] = picked.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in picked.items())
        at = 0
        for x, n in sorted(picked.items(), reverse=True):
            runs.append((x, used[x], n, windows, at))
            used[x] += n * times
            counts[x] -= n * times
            at += n * x
            if not counts[x]:
                del counts[x]
        windows += times
    a = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    return Plan(a[:, 0], a[:, 1], a[:, 2], a[:, 3], a[:, 4], windows)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the single id end_id. Rows that repeat a doc_id are packed like others; equal
    rows are interchangeable. Other columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.sparkContext.broadcast(min_bin_slack(histogram, capacity))
    chunks = max(1, sum(histogram.values()) // CHUNK)
    chunked = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        chunked.withColumn("rn", F.row_number().over(inside))
        .join(offsets, ["length", "chunk"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("rn") - 1).alias("rank"))
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [batch.column(k) for k in range(5)] + [pa.array(window, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(assign, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
