"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct word shingles, as 64-bit hashes. One permutation is cut into BINS bins that
keep their least value each; an empty bin takes over the value of the first non-empty bin in a random
sequence that all documents share (optimal densification). Bands of ROWS bins are hashed into buckets.
Documents with equal sets collapse to one representative first. Each bucket links its members to its smallest
and its largest representative only, so pairs grow with the members. Links are confirmed on the full sets.

What the stars leave open is finished exactly. A member of a bucket that still holds several components is written as its
difference from the bucket's smallest member, the centre: shingles that one of the two lacks. Two members are a link if and only if their
differences overlap enough, so the differences go through a prefix join: ordered from rare to frequent, those of a link meet in a shingle
which, in both, has the needed overlap at or behind it. Copies of one text with other edits each have little but rare shingles
in front, and don't meet. Only pairs in different components that meet so are confirmed. So every link between two
members of one bucket is found, without a comparison of all pairs. At a similarity of 0.75, 32 bands of 4 put a pair into no common
bucket with probability 5e-6.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import join_keyed, materialize, scratch_path, tidy

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: A shared random sequence of donors for each bin.
DONORS = np.random.default_rng(11).integers(0, BINS, (BINS, 4 * BINS))
#: Words a worker remembers the hash of.
MEMO = 1_000_000
#: Rows of a frequent shingle in one block, where its pairs are dealt out by pairs of blocks.
BLOCK = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes, sorted, of a text in UTF-8. Words are runs without U+0020 and U+0009 to U+000D."""

    def __init__(self, size: int):
        self.size, self.words = size, {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        memo = self.words
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        n = min(self.size, len(words))
        w = self.ids(words)
        h = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = mix(h + w[k : len(words) - n + 1 + k])
        return np.unique(h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """BINS values for each non-empty set."""
    out = np.zeros((len(sets), BINS), dtype=np.uint64)
    full = np.zeros((len(sets), BINS), dtype=bool)
    edges = (np.arange(BINS, dtype=np.uint64) << np.uint64(57)).astype(np.uint64)
    for k, s in enumerate(sets):
        first = np.searchsorted(s, edges)
        there = np.flatnonzero(np.diff(np.append(first, len(s))))
        out[k, there] = s[first[there]]
        full[k, there] = True
    row, column = np.nonzero(~full)
    for t in range(DONORS.shape[1]):
        if not len(row):
            break
        donor = DONORS[column, t]
        has = full[row, donor]
        out[row[has], column[has]] = out[row[has], donor[has]]
        row, column = row[~has], column[~has]
    for r, c in zip(row, column, strict=True):  # a set of few values that no donor in the sequence has met
        out[r, c] = sets[r][0]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One bucket id a band, the band's number included."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        h = mix(h + parts[:, :, k])
    return h.view(np.int64)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingle(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                found = bands(signatures([s for s in sets if len(s)])) if any(map(len, sets)) else np.zeros((0, BANDS), dtype=np.int64)
                offsets = np.append(0, np.cumsum([BANDS * bool(len(s)) for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.reshape(-1), pa.int64()))],
                    names=["doc_id", "text_hash", "n_shingles", "digest", "bands"],
                )

    return run


def parity(values: np.ndarray) -> np.ndarray:
    """A bit for each residue of the values, set if an odd number of them has it; at least four bits a value, a power of two in all.

    The bits in which two of them differ are at most as many as the values that only one of the two sets has. A longer one, its halves
    combined by exclusive or, is the same set's shorter one.
    """
    n = 1024
    while n < 4 * len(values):
        n *= 2
    return np.packbits(np.bincount((values & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).view(np.int64)


def differing(x: str, y: str) -> Column:
    """Bits in which two parity columns differ, a longer one folded to the other's length (links' sizes differ by a third at most)."""
    fold = lambda c: F.zip_with(F.slice(c, 1, F.expr(f"size({c}) div 2")), F.slice(c, F.expr(f"size({c}) div 2 + 1"), F.expr(f"size({c}) div 2")), lambda a, b: a.bitwiseXOR(b))
    a = F.when(F.size(x) > F.size(y), fold(x)).otherwise(F.col(x))
    b = F.when(F.size(y) > F.size(x), fold(y)).otherwise(F.col(y))
    return F.aggregate(F.zip_with(a, b, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, u: t + F.coalesce(u, F.lit(0)))


#: Columns of the stored sets.
STORED = "id binary, n long, bits array<long>, hashes array<long>"


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingle(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
                offsets = np.append(0, np.cumsum([len(s) for s in sets]))
                values = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)
                bits = [parity(s) for s in sets]
                bit_offsets = np.append(0, np.cumsum([len(b) for b in bits]))
                all_bits = np.concatenate([*bits, np.zeros(0, dtype=np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(bit_offsets, pa.int32()), pa.array(all_bits, pa.int64())),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))],
                    names=["id", "n", "bits", "hashes"],
                )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges(a, b), for each id that has an edge.

    Each round gives every id the least label among its own and its neighbours', then that label's label. Rounds are
    written and read back: that cuts the lineage, and keeps plans' size estimates from growing round by round.
    """
    spark = edges.sparkSession
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).select(F.col("a").alias("id"), "l"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("l").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("l").alias("old"), F.least("l", "near").alias("l"))
        step = materialize(step, "labels")
        jump = step.select(F.col("id").alias("via"), F.col("l").alias("far"))
        after = materialize(step.join(jump, step["l"] == jump["via"]).select("id", "old", F.least("l", "far").alias("l")), "labels")
        labels = after.select("id", "l")
        if after.filter(F.col("old") != F.col("l")).isEmpty():
            return labels.select("id", F.col("l").alias("component"))
        del near, step, jump
        tidy(spark)


def absorb(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(id, component) with further links(a, b) taken in: only the components that they join are worked on."""
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    fresh = ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
    labels = materialize(labels.union(fresh), "labels")
    side = lambda end, name: labels.select(F.col("id").alias(end), F.col("component").alias(name))
    joined = links.join(side("a", "x"), "a").join(side("b", "y"), "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    renamed = components(joined).select(F.col("id").alias("component"), F.col("component").alias("smaller"))
    return materialize(labels.join(renamed, "component", "left").select("id", F.coalesce("smaller", "component").alias("component")), "labels")


class NearDuplicates:
    """Near-duplicate components of docs(doc_id, text): links where 100 * intersection >= 100 * similarity * union."""

    def __init__(self, docs: DataFrame, size: int = 5, percent: int = 75):
        self.docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        self.size, self.percent = size, percent
        self.kind = self.docs.schema["doc_id"].dataType.simpleString()
        self.finish = (0, 0)  # pairs compared, and links found, after the stars

    def gather(self, members: DataFrame, groups: DataFrame) -> None:
        """The sets of all representatives that share a bucket, worked out once from one document each and stored by their digest: joins
        that look up a pair's one side need no shuffle of them."""
        spark = self.docs.sparkSession
        shared = members.select("rep").distinct()
        wanted = groups.join(shared, groups["digest"] == shared["rep"], "left_semi").select(F.col("first_doc").alias("wanted")).distinct()
        texts = self.docs.join(wanted.hint("shuffle_hash"), self.docs["doc_id"] == wanted["wanted"], "left_semi").select("doc_id", "text")
        self.path, self.table = scratch_path(spark, "sets"), f"shingle_sets_{uuid.uuid4().hex}"
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sets = texts.mapInArrow(_sets(self.size), STORED).dropDuplicates(["id"])
        sets.repartition(n, "id").write.option("path", self.path).bucketBy(n, "id").sortBy("id").saveAsTable(self.table)

    def meet(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """The pairs (centre, member) with these columns of their stored sets, centre's ones prefixed c_ and member's m_.

        A member has at most two centres a band, so its set is met in its buckets; a centre may have very many members, so there
        both sides are shuffled and adaptive execution splits what is skewed.
        """
        spark = self.docs.sparkSession
        stored = spark.table(self.table).select(F.col("id").alias("member"), *[F.col(c).alias(f"m_{c}") for c in columns])
        plain = spark.read.schema(STORED).parquet(self.path).select(F.col("id").alias("centre"), *[F.col(c).alias(f"c_{c}") for c in columns])
        return pairs.join(stored.hint("merge"), "member").join(plain.hint("merge"), "centre")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs (centre, member) that are a link on the full sets; sizes and parities rule most others out, never a link."""
        up, down = 100 + self.percent, 100 - self.percent
        likely = self.meet(pairs, "n", "bits").filter(F.least("c_n", "m_n") * 100 >= F.greatest("c_n", "m_n") * self.percent)
        likely = likely.filter(differing("c_bits", "m_bits") * up <= (F.col("c_n") + F.col("m_n")) * down).select("centre", "member")
        common = self.meet(materialize(likely, "likely"), "n", "hashes").select("centre", "member", F.size(F.array_intersect("c_hashes", "m_hashes")).alias("common"), (F.col("c_n") + F.col("m_n")).alias("both"))
        linked = common.filter(F.col("common") * 100 >= (F.col("both") - F.col("common")) * self.percent)
        return materialize(linked.select(F.least("centre", "member").alias("a"), F.greatest("centre", "member").alias("b")), "links")

    def frames(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """(centre, member, component, main) for the buckets whose members, besides the two that all have met, are in several
        components: the bucket's smallest member, whose component is main, and each of the others."""
        held = members.join(labels, members["rep"] == labels["id"], "left").select("bucket", "rep", "low", "high", F.coalesce("component", "rep").alias("component"))
        held = materialize(held, "held")
        inner = (F.col("rep") != F.col("low")) & (F.col("rep") != F.col("high"))
        of_inner = F.when(inner, F.col("component"))
        still = held.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("m"), F.min(of_inner).alias("x"), F.max(of_inner).alias("y"), F.max(F.when(F.col("rep") == F.col("low"), F.col("component"))).alias("main"))
        still = materialize(still.filter("x < y").select("bucket", "m", "main"), "open")
        total = max(1, still.agg(F.sum("m")).first()[0] or 0)
        rows = join_keyed(held, still, "bucket", "m", total).filter(inner)
        return materialize(rows.select(F.col("low").alias("centre"), F.col("rep").alias("member"), "component", "main").distinct(), "frames")

    def prefixes(self, frames: DataFrame) -> DataFrame:
        """(token, member, component, excess, rest): the shingles by which a member's difference from its centre can meet another's.

        With differences of k and l shingles, o of them common, and sets of n and m, the pair is a link if and only if
        (100 + percent) * (k + l - 2 * o) <= (100 - percent) * (n + m). excess is (100 + percent) * k - (100 - percent) * n, so a link
        needs 2 * (100 + percent) * o >= the sum of both's excess. rest counts the difference's shingles from this one on, in the order from rare
        to frequent. No excess is under -(100 - percent) * (the centre's size), and that of a member in another component than the centre's is
        over (100 - percent) * (that size), or it were linked to the centre: shingles whose rest can't do with any partner aren't given.
        """
        up, down = 100 + self.percent, 100 - self.percent
        difference = F.concat(F.array_except("m_hashes", "c_hashes"), F.array_except("c_hashes", "m_hashes"))
        rows = self.meet(frames, "n", "hashes").select("centre", "member", "component", "main", F.col("m_n").alias("n"), F.col("c_n").alias("nc"), difference.alias("d"))
        rows = rows.select("centre", "member", "component", "main", "n", "nc", F.size("d").alias("k"), F.explode("d").alias("token"))
        # one number for a shingle of a centre's frame; were two ever equal, a pair more would be confirmed
        rows = materialize(rows.withColumn("token", F.xxhash64("centre", "token")), "differences")
        shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
        # shingles of one member only come first in its order, whatever their hashes: just their number counts
        known = rows.join(shared.hint("merge"), "token")
        ordered = known.groupBy("centre", "member").agg(
            *[F.first(c).alias(c) for c in ("component", "main", "n", "nc", "k")], F.sort_array(F.collect_list(F.struct("f", "token"))).alias("tokens"))
        each = ordered.select("member", "component", "main", "nc", (F.col("k") * up - F.col("n") * down).alias("excess"), F.size("tokens").alias("s"), F.posexplode("tokens").alias("at", "t"))
        each = each.select(F.col("t.token").alias("token"), "member", "component", "excess", (F.col("s") - F.col("at")).alias("rest"), (F.when(F.col("component") == F.col("main"), down).otherwise(-down) * F.col("nc")).alias("least"))
        return each.filter(F.col("rest") * 2 * up >= F.col("excess") + F.col("least")).drop("least")

    def rest(self, frames: DataFrame) -> DataFrame:
        """(centre, member): the pairs of members in different components whose differences from a centre meet in a prefix.

        Pairs inside a shingle's largest component aren't looked at: one side is the members outside it. Both sides are dealt into
        blocks, and pairs of blocks spread over all tasks, so a shingle that very many share isn't one task's.
        """
        rows = materialize(self.prefixes(frames), "prefixes")
        parts = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
        most = parts.groupBy("token").agg(F.max(F.struct("n", "component")).alias("c"), F.sum("n").alias("m")).filter("m > c.n")
        most = most.select("token", F.col("c.component").alias("main"), F.ceil((F.col("m") - F.col("c.n")) / BLOCK).alias("deep"), F.ceil(F.col("m") / BLOCK).alias("wide"), "m")
        most = materialize(most, "prefix-tokens")
        total = max(1, most.agg(F.sum("m")).first()[0] or 0)
        rows = materialize(join_keyed(rows, most, "token", "m", total), "prefix-rows").withColumn("outer", F.col("component") != F.col("main"))
        salt = lambda n: F.pmod(F.xxhash64("member", "token"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
        one = rows.filter("outer").select(
            "token", F.col("member").alias("centre"), F.col("component").alias("cc"), F.col("excess").alias("c_excess"), F.col("rest").alias("c_rest"), salt("deep").alias("i"), every("wide").alias("j"))
        two = rows.select("token", "member", "component", "excess", "rest", "outer", salt("wide").alias("j"), every("deep").alias("i"))
        met = (F.least("rest", "c_rest") * (2 * (100 + self.percent)) >= F.col("excess") + F.col("c_excess")) & (F.col("component") != F.col("cc")) & (
            ~F.col("outer") | (F.col("centre") < F.col("member")))
        left, right = two.alias("two"), one.alias("one")
        keys = [F.col(f"two.{c}") == F.col(f"one.{c}") for c in ("token", "i", "j")]
        return left.join(right, [*keys, met]).select("centre", "member").distinct()

    def run(self) -> DataFrame:
        """One row per row of docs: doc_id, text_hash, n_shingles, component_id, kept."""
        spark = self.docs.sparkSession
        rows = materialize(self.docs.mapInArrow(_sketch(self.size), f"doc_id {self.kind}, text_hash long, n_shingles long, digest binary, bands array<long>"), "sketches")
        sound = rows.filter("doc_id is not null and digest is not null")
        # a set is known by its 128-bit digest from here on, so rows that repeat a doc_id with other texts are told apart
        groups = materialize(sound.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")), "reps")
        exploded = groups.select(F.col("digest").alias("rep"), F.explode("bands").alias("bucket"))
        shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("low"), F.max("rep").alias("high")).filter("m > 1")
        shared = materialize(shared, "buckets")
        members = join_keyed(exploded, shared, "bucket", "m", max(1, shared.agg(F.sum("m")).first()[0] or 0))
        members = materialize(members, "members")
        star = members.filter("rep <> low").select(F.col("low").alias("centre"), F.col("rep").alias("member"))
        star = star.union(members.filter("rep <> low and rep <> high").select(F.col("high").alias("centre"), F.col("rep").alias("member")))
        self.gather(members, groups)
        labels = components(self.confirm(materialize(star.distinct(), "star")))
        tidy(spark)
        more = materialize(self.rest(self.frames(members, labels)), "more")
        found = self.confirm(more)
        self.finish = (more.count(), found.count())
        if self.finish[1]:
            labels = absorb(labels, found)
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")  # the catalog's entry; the files are scratch
        linked = materialize(labels.join(groups, labels["id"] == groups["digest"]).select("component", "digest", "first_doc"), "linked")
        least = linked.groupBy("component").agg(F.min("first_doc").alias("component_id"), F.count(F.lit(1)).alias("m"))
        named = join_keyed(linked, materialize(least, "least"), "component", "m", max(1, linked.count())).select("digest", "component_id")
        classes = groups.select("digest", "n", "first_doc").join(named, "digest", "left").select("digest", "n", F.coalesce("component_id", "first_doc").alias("component_id"))
        classes = materialize(classes, "classes")
        light = sound.select("doc_id", "text_hash", "n_shingles", "digest")
        columns = ["doc_id", "text_hash", "n_shingles", "component_id"]
        known = join_keyed(light, classes, "digest", "n", max(1, light.count())).select(*columns)
        alone = rows.filter("doc_id is null or digest is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
        return known.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles, component_id, kept for each row of docs(doc_id, text).

    Null, empty and blank texts have no shingles and stay alone; texts with fewer words than `size` are one shingle. Texts of any length
    are shingled whole, in memory for one text at a time. Rows with a null doc_id stay alone, with a null component_id. Equal rows are all
    kept or all dropped; rows that repeat a doc_id with another text are judged each by its own text. Ties don't arise: a component's
    smallest doc_id stays. An empty table gives an empty result. Other columns are ignored.
    """
    return NearDuplicates(docs, size, percent).run()
