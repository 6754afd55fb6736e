"""Exact dedup: a persistent digest index, bucketed and sorted by digest.

New rows are reduced to one candidate per digest, deduplicated against the index by a sort-merge
anti-join in which the index side needs no shuffle, and appended. DataFrame functions only.

The index is a folder: files of one generation, bucketed by digest and sorted within, and a marker that completes the generation. A
session that finds the folder registers its files as a table again, so the index outlives sessions and catalogs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import HOT, delete_path, materialize, scratch_path

#: Deleted before texts are compared (fixed values): space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Deliveries in which a query adds a table to its index.
BATCHES = 2
ENTRY = "digest binary, keep_chars long, null_id boolean, keep_id {}, batch int"


def normalized(text: Column) -> Column:
    """text without BLANKS; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, chars): the only columns that ever move; texts stay where they are read."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(normalized(F.col(text_col)).cast("binary"), 256)).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"),
    )


class DigestIndex:
    """Entries (digest, keep_chars, null_id, keep_id, batch) in the folder `path`, which should be one that all executors share.

    An entry is the row that stays for a digest, as far as its batch knew; a later batch with a better row (more code points, then the
    smaller id, null ids last) appends an entry that supersedes it. `buckets` should give buckets of 100 to 500 MB at the final
    size; an index that exists keeps its own number. Batches are added by one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.generation, self.batches, self.table = 0, 0, None
        found = self._generations()
        if found:
            self.generation, self.buckets = found[-1]
            self._register()
            self.batches = (self.read().agg(F.max("batch")).first()[0] or 0) + 1

    def _fs(self, name: str = ""):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _generations(self) -> list[tuple[int, int]]:
        """(generation, buckets) of the complete ones, by the markers complete-<generation>-<buckets>; the last one holds."""
        fs, folder = self._fs()
        if not fs.exists(folder):
            return []
        names = [str(f.getPath().getName()) for f in fs.listStatus(folder)]
        return sorted(tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("complete-"))

    def _complete(self) -> None:
        fs, marker = self._fs(f"complete-{self.generation}-{self.buckets}")
        fs.create(marker, True).close()

    def _files(self) -> str:
        return f"{self.path}/g{self.generation}"

    def _register(self) -> None:
        """A name in the session's catalog for the generation's files; dropping it leaves them."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        columns = ENTRY.format(self.id_type)
        self.spark.sql(
            f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._files()}'")

    def _write(self, entries: DataFrame) -> None:
        columns = [c.split()[0] for c in ENTRY.split(", ")]
        entries.repartition(self.buckets, "digest").select(*columns).write.insertInto(self.table)  # into the table's buckets, sorted

    def exists(self) -> bool:
        return self.table is not None

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        """Take the index away, files and all."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            self.table = None
        delete_path(self.spark, self.path)

    def candidates(self, rows: DataFrame) -> DataFrame:
        """One entry a digest of rows(id, digest, chars): the row that stays among them."""
        rank = F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("null_id"), F.col("id"))
        best = rows.groupBy("digest").agg(F.min(rank).alias("best"))
        return best.select("digest", (-F.col("best.less")).alias("keep_chars"), F.col("best.null_id").alias("null_id"), F.col("best.id").alias("keep_id"))

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The candidates that the index holds no equal or better row for: a sort-merge anti-join, without a shuffle of the index."""
        if not self.exists():
            return groups
        held = self.read().select(F.col("digest").alias("held"), F.col("keep_chars").alias("c"), F.col("null_id").alias("z"), F.col("keep_id").alias("k"))
        as_good = (F.col("c") > F.col("keep_chars")) | (F.col("c") == F.col("keep_chars")) & (
            (~F.col("z") & F.col("null_id")) | (F.col("z") & F.col("null_id")) | (~F.col("z") & ~F.col("null_id") & (F.col("k") <= F.col("keep_id"))))
        return groups.hint("merge").join(held.hint("merge"), (F.col("digest") == F.col("held")) & as_good, "left_anti")

    def add(self, rows: DataFrame) -> None:
        """Append the rows(id, digest, chars), given by digests(), that stay. An empty batch changes nothing but the count of batches."""
        groups = self.candidates(rows).withColumn("batch", F.lit(self.batches))
        if self.exists():
            self._write(self.fresh(groups))
        else:
            delete_path(self.spark, self._files())  # left by a first batch that didn't end
            self._register()
            self._write(groups)
            self._complete()
        self.batches += 1

    def best(self) -> DataFrame:
        """(digest, keep_id, batch): the row that stays for each digest, and the batch that brought it."""
        rank = F.struct((-F.col("keep_chars")).alias("less"), "null_id", "keep_id", "batch")
        return self.read().groupBy("digest").agg(F.min(rank).alias("b")).select("digest", F.col("b.keep_id").alias("keep_id"), F.col("b.batch").alias("batch"))

    def compact(self) -> None:
        """Rewrite the index with one sorted file per bucket and one entry per digest, after many appends.

        The new generation holds once its marker is there; a crash before that leaves the old one in force.
        """
        rank = F.struct((-F.col("keep_chars")).alias("less"), "null_id", "keep_id", "batch")
        kept = self.read().groupBy("digest").agg(F.min(rank).alias("b"))
        kept = kept.select("digest", (-F.col("b.less")).alias("keep_chars"), F.col("b.null_id").alias("null_id"), F.col("b.keep_id").alias("keep_id"), F.col("b.batch").alias("batch"))
        old, table = self._generations()[-1], self.table
        self.generation, self.table = old[0] + 1, None
        delete_path(self.spark, self._files())  # left by a compaction that didn't end
        self._register()
        self._write(kept)
        self._complete()
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete_path(self.spark, f"{self.path}/complete-{old[0]}-{old[1]}")
        delete_path(self.spark, f"{self.path}/g{old[0]}")


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    The rows are added to the index in `batches` deliveries, dealt by a hash of doc_id; what stays doesn't depend on how they are dealt.
    Of equal texts the row with the most code points stays, then the smallest doc_id, null ids last, whether the index had it before or
    not; group_size counts docs' own rows. Empty and null texts are equal to one another. Texts of any length are digested whole, on the
    JVM. Rows that repeat a doc_id are told apart by their texts only: equal ones are all kept or all dropped. An empty table gives
    an empty result. Other columns are ignored. Without an index a fresh one is made, and dropped behind the result.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark, scratch_path(spark, "digest-index"), id_type=docs.schema["doc_id"].dataType.simpleString())
    rows = materialize(digests(docs.select("doc_id", "text")), "digests")
    for k in range(batches):
        index.add(rows.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == k))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    settled = materialize(sizes.hint("merge").join(index.best().select("digest", "keep_id"), "digest"), "digest-groups")
    if own:
        index.drop()
    # at most HOT digests hold more than total / HOT rows each; they are joined map-side
    is_hot = F.col("group_size") * HOT > F.lit(max(1, rows.count()))
    hot = settled.filter(is_hot)
    out_hot = rows.join(F.broadcast(hot), "digest")
    out_rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(settled.filter(~is_hot).hint("merge"), "digest")
    both = out_hot.unionByName(out_rest)
    return both.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
