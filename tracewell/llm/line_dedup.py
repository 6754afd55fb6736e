"""Line dedup: exact reference-count tables with sharded cuckoo filters in front of them.

A line's key is a 128-bit digest of the stripped, lower-cased line. The index keeps tables in the shared folder. Each change
appends a segment with its number and rewrites none, so a lost executor only repeats a read:

- postings (key, doc, seq): which document holds which key; gone (doc, seq) takes a document's older postings out;
- counts (key, n_docs, last_doc, seq): in how many documents a key occurs, and the largest of them; a key's last entry holds;
- filters (shard, filter): one cuckoo filter of 16-bit fingerprints a shard, holding the shard's keys.

An insertion asks the filters first: keys they don't know are new and are appended without a look at the counts;
only keys they may know are joined with them. A deletion recounts the keys the documents held, and removes keys that no
document holds any more from the filters, which a Bloom filter could not do. So
inserting a batch and deleting it again restores counts and memberships. When the shards have grown to twice their keys, there
are twice as many of them, filled from the counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import join_keyed, materialize, partitions

SLOTS = 4
#: Deliveries in which a query inserts a table.
BATCHES = 2
#: Keys a shard is meant for: 400,000 keys are 1 MB of filter and 6 MB of digests in a task.
SHARD_KEYS = 200_000


class CuckooFilter:
    """A cuckoo filter over 64-bit hashes, filled and emptied in bulk with numpy. insert() returns False if it is full;
    a larger one is then built from the exact keys."""

    def __init__(self, buckets: int):
        self.mask = np.uint64(buckets - 1)
        self.slots = np.zeros((buckets, SLOTS), dtype=np.uint16)

    @classmethod
    def build(cls, hashes: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, len(hashes)) / (SLOTS * 0.6)))))
        while True:
            out = cls(buckets)
            if out.insert(hashes):
                return out
            buckets *= 2

    def _where(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.astype(np.uint64)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (h & self.mask).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        jump = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return ((bucket.astype(np.uint64) ^ jump) & self.mask).astype(np.int64)

    def _put(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Place what finds a free slot, one a bucket and round; which ones were placed."""
        placed = np.zeros(len(bucket), dtype=bool)
        for _ in range(SLOTS):
            left = np.flatnonzero(~placed)
            if not len(left):
                break
            first, k = np.unique(bucket[left], return_index=True)
            free = self.slots[first] == 0
            has = free.any(axis=1)
            self.slots[first[has], free[has].argmax(axis=1)] = mark[left[k[has]]]
            placed[left[k[has]]] = True
            if not has.any():
                break
        return placed

    def insert(self, hashes: np.ndarray, rounds: int = 200) -> bool:
        """All or nothing is not promised: on False the filter is to be built anew."""
        mark, bucket = self._where(hashes)
        rng = np.random.default_rng(7)
        for _ in range(rounds):
            left = ~self._put(bucket, mark)
            mark, bucket = mark[left], bucket[left]
            if not len(mark):
                return True
            bucket = self._other(bucket, mark)
            left = ~self._put(bucket, mark)
            mark, bucket = mark[left], bucket[left]
            if not len(mark):
                return True
            # kick one resident out of each full bucket and carry it on to its other bucket
            kicked, k = np.unique(bucket, return_index=True)
            slot = rng.integers(0, SLOTS, len(kicked))
            out = self.slots[kicked, slot].copy()
            self.slots[kicked, slot] = mark[k]
            mark, bucket = mark.copy(), bucket.copy()
            mark[k] = out
            bucket[k] = self._other(kicked, out)
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, bucket = self._where(hashes)
        m = mark[:, None]
        return ((self.slots[bucket] == m) | (self.slots[self._other(bucket, mark)] == m)).any(axis=1)

    def delete(self, hashes: np.ndarray) -> bool:
        """Take out hashes that were inserted; equal fingerprints leave one slot each. True."""
        mark, bucket = self._where(hashes)
        other = self._other(bucket, mark)
        pending = np.arange(len(mark))
        for where in (bucket, other):
            while len(pending):
                b, m = where[pending], mark[pending]
                _, k = np.unique(b * np.int64(65536) + m, return_index=True)
                hit = self.slots[b[k]] == m[k][:, None]
                has = hit.any(axis=1)
                self.slots[b[k[has]], hit[has].argmax(axis=1)] = 0
                gone = k[has]
                if not len(gone):
                    break
                pending = np.delete(pending, gone)
        return True

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        slots = np.frombuffer(raw, dtype=np.uint16).reshape(-1, SLOTS).copy()
        out = cls(len(slots))
        out.slots = slots
        return out


def line_key(line: bytes, least: int) -> bytes | None:
    """Digest of a line without blanks at its ends, A-Z lower-cased; None if it has fewer than `least` code points.

    On bytes, strip() takes exactly U+0020 and U+0009 to U+000D, and lower() changes exactly A to Z.
    """
    key = line.strip().lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _postings(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                found = {line_key(x, least) for x in (text.as_py() or b"").split(b"\n")}
                found.discard(None)
                keys.extend(found)
                rows.extend([k] * len(found))
            docs = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), docs], names=["key", "doc"])

    return run


def _hashes(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys) + b"\0" * 16, dtype="<u8").reshape(-1, 2)[:-1, 1]


def _build(keys: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "filter": [CuckooFilter.build(_hashes(keys["key"])).to_bytes()]})


def _ask(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """For one shard: the batch's keys that the filter may know, and the filter with the others put in, null if they don't fit."""
    shard = int((old if len(old) else new)["shard"].iloc[0])
    hashes = _hashes(new["key"])
    if len(old):
        state = CuckooFilter.from_bytes(old["filter"].iloc[0])
        known = state.contains(hashes)
        raw = state.to_bytes() if state.insert(hashes[~known]) else None
    else:
        known, raw = np.zeros(len(hashes), dtype=bool), CuckooFilter.build(hashes).to_bytes()
    return pd.DataFrame({"shard": shard, "key": [*new["key"][known], None], "filter": [*[None] * int(known.sum()), raw]})


class LineIndex:
    """The index described above. `least` code points make a line long enough, keys in `often` documents are dropped."""

    def __init__(self, spark: SparkSession, least: int = 40, often: int = 5, shards: int | None = None):
        self.spark, self.least, self.often, self.shards = spark, least, often, shards
        self.seq = 0
        self.keys = 0  # that the filters hold, false alarms of theirs left out
        self.posted: DataFrame | None = None  # segments
        self.gone: DataFrame | None = None
        self.counted: DataFrame | None = None
        self.filters: DataFrame | None = None

    def _lines(self, docs: DataFrame) -> DataFrame:
        rows = docs.select("doc_id", "text")
        kind = rows.schema["doc_id"].dataType.simpleString()
        found = rows.mapInArrow(_postings(self.least), f"key binary, doc {kind}")
        return found.distinct()

    def _count(self, postings: DataFrame) -> DataFrame:
        return postings.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))

    def _shard(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int"))

    @property
    def postings(self) -> DataFrame:
        """(key, doc) of the documents that the index holds now."""
        if self.gone is None:
            return self.posted.select("key", "doc")
        gone = self.gone.groupBy("doc").agg(F.max("seq").alias("until")).withColumnRenamed("doc", "out")
        return self.posted.join(gone, F.col("doc").eqNullSafe(F.col("out")) & (F.col("seq") <= F.col("until")), "left_anti").select("key", "doc")

    def _last(self, counted: DataFrame) -> DataFrame:
        last = counted.groupBy("key").agg(F.max(F.struct("seq", "n_docs", "last_doc")).alias("c")).filter("c.n_docs > 0")
        return last.select("key", "c.n_docs", "c.last_doc")

    @property
    def counts(self) -> DataFrame:
        """(key, n_docs, last_doc) as they are now."""
        return self._last(self.counted)

    def _append(self, counts: DataFrame) -> None:
        segment = materialize(counts.select("key", "n_docs", "last_doc", F.lit(self.seq).alias("seq")), "line-counts")
        self.counted = segment if self.counted is None else self.counted.unionByName(segment)

    def insert(self, docs: DataFrame) -> None:
        """Add docs(doc_id, text). A doc_id that the index already holds adds only the keys it lacked."""
        self.seq += 1
        new = materialize(self._lines(docs), "line-postings")
        if self.posted is not None:
            held = self.postings
            met = held.select(F.col("doc").alias("held")).distinct()
            again = materialize(new.select("doc").distinct().join(met, F.col("doc").eqNullSafe(F.col("held")), "left_semi"), "line-again")
            if not again.isEmpty():
                there = held.select(F.col("key").alias("k"), F.col("doc").alias("d"))
                new = materialize(new.join(there, (F.col("key") == F.col("k")) & F.col("doc").eqNullSafe(F.col("d")), "left_anti"), "line-postings-new")
        delta = materialize(self._count(new), "line-delta")
        size = delta.count()
        if self.shards is None:
            self.shards = partitions(self.spark, size, SHARD_KEYS)
        empty = self.spark.createDataFrame([], "shard int, filter binary")
        told = materialize(
            (self.filters if self.filters is not None else empty).groupBy("shard")
            .cogroup(self._shard(delta.select("key")).groupBy("shard"))
            .applyInPandas(_ask, "shard int, key binary, filter binary"),
            "line-filters",
        )
        state = told.filter("key is null").select("shard", "filter")
        segment = new.withColumn("seq", F.lit(self.seq))
        self.posted = segment if self.posted is None else self.posted.unionByName(segment)
        if self.filters is None:
            self._append(delta)
            self.filters, self.keys = state, size
            return
        maybe = told.filter("key is not null").select("key")
        known = self._last(self.counted.join(maybe, "key", "left_semi")).unionByName(delta.join(maybe, "key", "left_semi"))
        merged = known.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.count(F.lit(1)).alias("sides"))
        merged = materialize(merged, "line-merged")
        self._append(delta.join(maybe, "key", "left_anti").unionByName(merged.drop("sides")))
        # keys that the filters took for known and that aren't: still to be put in
        self.filters = self._refresh(state, merged.filter("sides = 1").select("key"), adding=True)
        self.keys += size - merged.filter("sides = 2").count()
        if self.keys > 2 * SHARD_KEYS * self.shards:
            self.shards *= 2
            self.filters = materialize(self._shard(self.counts.select("key")).groupBy("shard").applyInPandas(_build, "shard int, filter binary"), "line-filters")

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents out; doc_ids has one column doc_id. Unknown ids change nothing."""
        self.seq += 1
        gone = materialize(doc_ids.select(F.col("doc_id").alias("doc"), F.lit(self.seq).alias("seq")).distinct(), "line-gone")
        out = materialize(self.postings.join(gone.select(F.col("doc").alias("out")), F.col("doc").eqNullSafe(F.col("out")), "left_semi").select("key").distinct(), "line-touched")
        self.gone = gone if self.gone is None else self.gone.unionByName(gone)
        recounted = materialize(self._count(self.postings.join(out, "key", "left_semi")), "line-recounted")
        kind = recounted.schema["last_doc"].dataType
        nobody = out.join(recounted, "key", "left_anti").select("key", F.lit(0).cast("long").alias("n_docs"), F.lit(None).cast(kind).alias("last_doc"))
        nobody = materialize(nobody, "line-nobody")
        self._append(recounted.unionByName(nobody))
        self.filters = self._refresh(self.filters, nobody.select("key"), adding=False)
        self.keys -= nobody.count()

    def _refresh(self, filters: DataFrame, keys: DataFrame, adding: bool) -> DataFrame:
        """Put keys into the filters or take them out. A filter that is full is built anew, larger, from the exact counts."""

        def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            if len(old) and len(new) and old["filter"].iloc[0] is not None:
                state = CuckooFilter.from_bytes(old["filter"].iloc[0])
                done = state.insert(_hashes(new["key"])) if adding else state.delete(_hashes(new["key"]))
                return pd.DataFrame({"shard": [int(old["shard"].iloc[0])], "filter": [state.to_bytes() if done else None]})
            return old[["shard", "filter"]]

        state = materialize(
            filters.groupBy("shard").cogroup(self._shard(keys.select("key")).groupBy("shard")).applyInPandas(run, "shard int, filter binary"),
            "line-filters",
        )
        full = state.filter("filter is null").select("shard")
        anew = self._shard(self.counts.select("key")).join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_build, "shard int, filter binary")
        return materialize(state.filter("filter is not null").union(anew), "line-filters")

    def drops(self) -> DataFrame:
        """(doc, keys): the keys whose lines the document loses; only documents that lose any."""
        frequent = materialize(self.counts.filter(F.col("n_docs") >= self.often), "line-frequent")
        postings = self.postings
        total = postings.count()
        lost = join_keyed(postings, frequent, "key", "n_docs", total).filter(~F.col("doc").eqNullSafe(F.col("last_doc")))
        return lost.groupBy("doc").agg(F.collect_list("key").alias("keys"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with `text` reduced to the lines that stay, joined by newline, and tw_n_lines and tw_n_dropped behind its own columns.

        docs must have been inserted, and must not have columns of these two names.
        """
        own = docs.columns
        drops = self.drops()
        # numbered names on the way, so that no column of docs can clash
        base = docs.select(*[F.col(f"`{c}`").alias(f"tw_own_{k}") for k, c in enumerate(own)])
        drops = drops.select(F.col("doc").alias("tw_doc"), F.col("keys").alias("tw_keys"))
        rows = base.join(drops.hint("shuffle_hash"), F.col(f"tw_own_{own.index('doc_id')}").eqNullSafe(drops["tw_doc"]), "left").drop("tw_doc")
        least, at = self.least, own.index("text")
        names = [*base.columns, "tw_n_lines", "tw_n_dropped"]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, n_lines, n_dropped = [], [], []
                for text, keys in zip(batch.column(at).cast(pa.binary()), batch.column(len(own)), strict=True):
                    lines = (text.as_py() or b"").split(b"\n")
                    gone = set(keys.as_py() or ())
                    kept = [x for x in lines if line_key(x, least) not in gone] if gone else lines
                    texts.append(b"\n".join(kept).decode("utf-8", "replace"))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                columns = [batch.column(k) for k in range(len(own))]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=names)

        schema = T.StructType([*base.schema.fields, T.StructField("tw_n_lines", T.LongType()), T.StructField("tw_n_dropped", T.LongType())])
        return rows.mapInArrow(cut, schema).toDF(*own, "tw_n_lines", "tw_n_dropped")


def dedup_lines(docs: DataFrame, least: int = 40, often: int = 5, batches: int = BATCHES) -> DataFrame:
    """docs without the lines that `often` documents share, but for the largest doc_id holding them; see LineIndex.apply.

    docs are inserted in `batches` deliveries, dealt by a hash of doc_id; the result doesn't depend on how they are dealt. Null and
    empty texts are one empty line; texts of any length are split whole, one at a time. Rows that repeat a doc_id count as one document, and
    each loses or keeps the line alike; a null doc_id counts as one document too, smaller than any id. There are no ties, as one doc_id is the
    largest. All of docs' columns stay as they are, whatever their names. An empty table gives an empty result.
    """
    index = LineIndex(docs.sparkSession, least, often)
    for k in range(batches):
        index.insert(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return index.apply(docs)
