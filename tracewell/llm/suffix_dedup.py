"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

Three steps. (1) Pruning: every window of 100 bytes belongs to a run named by its least 16-byte hash (minimizers.py). Runs
that equal an earlier run are repeats as a whole; runs that share a name with no other run hold no repeat; only the first run of
each distinct content under a shared name is left. (2) The bytes of those runs are brought together by name. Windows
whose hash repeats are cut out and handed, in shards, to the Burrows-Wheeler merge (bwt.py), whose intervals with a common prefix of
100 bytes are the repeats; the earliest of each stays. (3) Each document is cut by its repeats.

Runs are equal if their 64-bit hashes under a 48-bit name are; equal texts have equal hashes, so pruning loses nothing. Two different runs
under one name are taken for equal with probability 2^-64: with 10^10 distinct runs, at most 20,000 under a name, 5e-6 are to be expected in all.
Names with more runs (HOT_NAME) leave the merge, which takes whole names: their windows are compared over all tasks by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.bwt import repeated
from tracewell.llm.common import join_keyed, materialize, partitions, tidy
from tracewell.llm.minimizers import WIDTH, runs, window_hashes

#: A place is start * 128 + number of windows.
PLACE = 128
#: Bytes of candidate text from which one Burrows-Wheeler merge takes no further name; a merge takes some 120 bytes of memory a byte.
CHUNK = 1 << 20
#: Rows of a name with very many runs that are digested at a time.
SLICE = 1_000
#: Runs under one name beyond which its windows are compared one by one, by their 128-bit digests, over all tasks.
HOT_NAME = 20_000
#: Partition sizes: text bytes for runs, in documents.
ROWS_A_TASK = 5_000


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each document: (name, identity, doc, place). Within a batch, later equals of a run are told apart as repeats at once:
    identity null. So a run that all documents share leaves one row a batch, not one a document."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            parts: list[list[np.ndarray]] = [[], [], [], []]
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for doc, text in zip(docs, batch.column(1).cast(pa.binary()), strict=True):
                name, identity, start, count = runs(np.frombuffer(text.as_py() or b"", dtype=np.uint8))
                for column, v in zip(parts, (name >> np.uint64(16), identity, np.full(len(name), doc, dtype=np.int64), start * PLACE + count), strict=True):
                    column.append(v)
            if not parts[0]:
                continue
            name, identity, doc, place = (np.concatenate(p) for p in parts)
            order = np.lexsort((place, doc, identity, name))
            name, identity, doc, place = name[order].astype(np.int64), identity[order].view(np.int64), doc[order], place[order]
            again = np.append(False, (name[1:] == name[:-1]) & (identity[1:] == identity[:-1]))[: len(name)]
            same_place = np.append(False, (doc[1:] == doc[:-1]) & (place[1:] == place[:-1]))[: len(name)] & again
            keep = ~same_place
            spread = np.where(again, place * 31 + doc, name)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread[keep]), pa.array(identity[keep], mask=again[keep]), pa.array(doc[keep]), pa.array(place[keep])],
                names=["name", "identity", "doc", "place"],
            )


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (name, identity, doc, place). Gives (name, doc, place): repeats with a null name, and the first run of each
    identity where a name has several. Holds one row, however many share a name."""
    held: tuple[int, int, int, int] | None = None  # first run of the one identity seen so far under the last name
    last: tuple[int, int] | None = None
    several = False
    for batch in batches:
        identity_column = batch.column(1)
        done = identity_column.is_null().to_numpy(zero_copy_only=False)
        out_name, out_doc, out_place = [], [batch.column(2).to_numpy(zero_copy_only=False)[done]], [batch.column(3).to_numpy(zero_copy_only=False)[done]]
        out_name.append(np.full(int(done.sum()), -1, dtype=np.int64))
        live = batch.filter(pa.array(~done))
        name, identity, doc, place = (live.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        n = len(name)
        if n:
            new_name, new_run = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
            new_name[1:] = name[1:] != name[:-1]
            new_run[1:] = new_name[1:] | (identity[1:] != identity[:-1])
            if last is not None and last[0] == name[0]:
                new_name[0] = False
                new_run[0] = identity[0] != last[1]
            group = np.cumsum(new_name)  # 0: goes on from the batch before
            distinct = np.bincount(group, new_run, minlength=group[-1] + 1)
            if not new_name[0]:
                if several or distinct[0]:
                    if not several and held is not None:
                        out_name.append(np.array([held[0]])), out_doc.append(np.array([held[2]])), out_place.append(np.array([held[3]]))
                    distinct[0] = 2
                    several_first = True
                else:
                    several_first = False
            chosen = new_run & (distinct[group] > 1)
            repeats = ~new_run
            out_name += [name[chosen], np.full(int(repeats.sum()), -1, dtype=np.int64)]
            out_doc += [doc[chosen], doc[repeats]]
            out_place += [place[chosen], place[repeats]]
            end = group[-1]
            if end == 0 and not new_name[0]:
                several = several_first
                held = None if several else held
            else:
                several = bool(distinct[end] > 1)
                k = int(np.flatnonzero(new_name)[-1])
                held = None if several else (int(name[k]), int(identity[k]), int(doc[k]), int(place[k]))
            last = (int(name[-1]), int(identity[-1]))
        names = np.concatenate(out_name)
        yield pa.RecordBatch.from_arrays([pa.array(names, mask=names < 0), pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_place))], names=["name", "doc", "place"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted run: (name, doc, place, bytes)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            out: list[list] = [[], [], [], []]
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                data = text.as_py() or b""
                for w in wanted:
                    start, count = divmod(w["place"], PLACE)
                    for column, v in zip(out, (w["name"], doc, w["place"], data[start : start + count + WIDTH - 1]), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["name", "doc", "place", "bytes"])


def _intervals(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive windows of a document as places, at most PLACE - 1 windows each."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    cut = np.ones(len(doc), dtype=bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(cut)
    within = np.arange(len(doc)) - first[np.cumsum(cut) - 1]
    cut |= within % (PLACE - 1) == 0
    first = np.flatnonzero(cut)
    return doc[first], start[first] * PLACE + np.diff(np.append(first, len(doc)))


def _compare(rows: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, place) of windows under these names that equal an earlier window."""
    docs, starts, cut = [], [], []
    size = np.array([len(r[3]) for r in rows], dtype=np.int64)
    at = np.append(0, np.cumsum(size))
    data = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
    hashes = window_hashes(data)[1]
    valid = np.concatenate([np.arange(a, a + n - WIDTH + 1) for a, n in zip(at, size, strict=False)])
    name = np.repeat(np.array([r[0] for r in rows], dtype=np.int64), size - WIDTH + 1).view(np.uint64)
    key = hashes[valid] ^ name * np.uint64(0x9E3779B97F4A7C15)
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    often = np.zeros(len(data), dtype=bool)
    often[valid[times[inverse] > 1]] = True
    for k, (_, doc, place, raw) in enumerate(rows):
        marks = np.flatnonzero(often[at[k] : at[k + 1]])
        if len(marks):
            for part in np.split(marks, np.flatnonzero(np.diff(marks) > 1) + 1):
                docs.append(doc)
                starts.append(place // PLACE + part[0])
                cut.append(raw[part[0] : part[-1] + WIDTH])
    if not cut:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    string, offset, interval = repeated(cut, WIDTH)
    doc, start = np.array(docs, dtype=np.int64)[string], np.array(starts, dtype=np.int64)[string] + offset
    order = np.lexsort((start, doc, interval))
    doc, start, interval = doc[order], start[order], interval[order]
    later = np.append(False, interval[1:] == interval[:-1])[: len(interval)]
    return _intervals(doc[later], start[later])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by name. Gives (doc, place, h): repeats with a null h; and, for names with very many runs, each window
    with its 128-bit digest instead."""
    names = ["doc", "place", "h"]

    def found(rows: list[tuple]) -> pa.RecordBatch:
        doc, place = _compare(rows)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.nulls(len(doc), pa.binary())], names=names)

    def each(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), SLICE):
            doc, place, h = [], [], []
            for _, d, p, raw in rows[at : at + SLICE]:
                n = len(raw) - WIDTH + 1
                doc.append(np.full(n, d, dtype=np.int64))
                place.append((p // PLACE + np.arange(n)) * PLACE + 1)
                h += [blake2b(raw[k : k + WIDTH], digest_size=16).digest() for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(doc)), pa.array(np.concatenate(place)), pa.array(h, pa.binary())], names=names)

    ready: list[tuple] = []  # rows of whole names
    open_: list[tuple] = []  # rows of the name being read
    size, current, hot = 0, None, False
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if row[0] != current:
                if not hot:
                    ready += open_
                elif open_:
                    yield from each(open_)
                if size >= CHUNK and ready:
                    yield found(ready)
                    ready, size = [], 0
                open_, current, hot = [], row[0], False
            open_.append(row)
            size += len(row[3])
            if len(open_) > (SLICE if hot else HOT_NAME):
                yield from each(open_)
                open_, hot = [], True
    if not hot:
        ready += open_
    elif open_:
        yield from each(open_)
    if ready:
        yield found(ready)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            out: list[list] = [[], [], [], []]
            for text, places in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                data = np.frombuffer(text.as_py() or b"", dtype=np.uint8)
                p = np.array(places.as_py() or [], dtype=np.int64)
                start, count = p // PLACE, p % PLACE
                change = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(change, start, 1)
                np.add.at(change, start + count + WIDTH - 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                edges = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
                out[0].append(data[~gone].tobytes())
                out[1].append(len(data))
                out[2].append(int(gone.sum()))
                out[3].append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)])
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names=["doc_id", "kept", "n_bytes", "n_removed", "spans"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, spans (start, end of each removed run) for each row of docs(doc_id, text).

    doc_id is a whole number; null counts as the smallest. Null and empty texts have no bytes. A text of any length is named whole in
    one task, in some 60 bytes of memory a byte of text. Rows that repeat a doc_id count as one
    document whose positions compare by their start alone, so equal starts are equally early. Other columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("doc"), "text", F.col("doc_id").alias("given"))
    n = partitions(spark, docs.count(), ROWS_A_TASK)
    named = rows.select("doc", "text").mapInArrow(_names, "name long, identity long, doc long, place long")
    order = ["name", "identity", "doc", "place"]
    judged = named.repartition(n, "name").sortWithinPartitions(*order).mapInArrow(_judge, "name long, doc long, place long")
    judged = materialize(judged, "runs")
    del named
    tidy(spark)
    wanted = judged.filter("name is not null").groupBy("doc").agg(F.collect_list(F.struct("name", "place")).alias("wanted"))
    contexts = rows.select("doc", "text").join(wanted.hint("shuffle_hash"), "doc").mapInArrow(_contexts, "name long, doc long, place long, bytes binary")
    merged = contexts.repartition(n, "name").sortWithinPartitions("name").mapInArrow(_merge, "doc long, place long, h binary")
    merged = materialize(merged, "repeats")
    del wanted, contexts
    tidy(spark)
    places = judged.filter("name is null").select("doc", "place").union(merged.filter("h is null").select("doc", "place"))
    single = merged.filter("h is not null")
    firsts = materialize(
        single.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "place")).alias("first")).filter("n > 1"), "hot-windows")
    total = max(1, single.count())
    hot = join_keyed(single, firsts, "h", "n", total).filter(F.struct("doc", "place") != F.col("first")).select("doc", "place")
    per_doc = places.union(hot).groupBy("doc").agg(F.collect_list("place").alias("places"))
    held = rows.join(per_doc.hint("shuffle_hash"), "doc", "left").select("given", "text", "places")
    return held.mapInArrow(_cut, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>")
