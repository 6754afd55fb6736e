"""All pairs of a recording's rows by cells of two blocks: each block travels once for every other block, a cell's pairs are
computed as matrices, and nothing of the size of the pairs is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tracewell.functions import pairwise
from tracewell.scratch import cut

#: Rows of a block, and the most tasks that cells are dealt to.
BLOCK, MOST_TASKS = 2048, 2000


def in_cells(rows: DataFrame, keys: list[str], node: str, run: Callable[[pa.Table, pa.Table, bool], Iterator[dict]], schema: StructType, size: int = BLOCK) -> DataFrame:
    """What run(a, b, same) yields, as columns by name behind the keys, for every cell of two blocks of rows(keys.., node, ...) that have equal keys.

    Blocks are `size` rows in node order, so all nodes of a come before those of b; where a cell is a block with itself, a and b
    are the same rows in node order. Rows without a key are left out.
    """
    ranked = rows.withColumn("block_", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(node)) - 1) / size))
    ranked = cut(ranked.dropna(subset=keys))
    blocks = ranked.groupBy(*keys).agg((F.max("block_") + 1).alias("blocks_"))
    n = blocks.agg(F.sum(F.col("blocks_") * (F.col("blocks_") + 1) / 2)).first()[0] or 1
    each = ranked.join(blocks, keys).withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1))).drop("blocks_")
    each = each.withColumns({"p_": F.least("block_", "other_"), "q_": F.greatest("block_", "other_")}).drop("other_")
    out = StructType([*[StructField(k, rows.schema[k].dataType) for k in keys], *schema.fields])
    arrow = to_arrow_schema(out)

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        block, p, q = (table[c].to_numpy() for c in ("block_", "p_", "q_"))
        same = p[0] == q[0]
        key = [table[k][0] for k in keys]
        a = table.sort_by(node) if same else table.filter(pa.array(block == p))
        b = a if same else table.filter(pa.array(block == q))
        for columns in run(a.combine_chunks(), b.combine_chunks(), same):
            yield _batch(key, columns, schema, arrow)

    return _deal(each, keys, n).groupBy(*keys, "p_", "q_").applyInArrow(cell, out)


def _deal(each: DataFrame, keys: list[str], cells: float) -> DataFrame:
    return each.repartition(int(min(max(cells, 1), MOST_TASKS)), *keys, "p_", "q_")


def across(left: DataFrame, right: DataFrame, keys: list[str], node: str, run: Callable[[pa.Table, pa.Table], Iterator[dict]], schema: StructType, size: int = BLOCK) -> DataFrame:
    """in_cells() for every cell of a block of left and a block of right, which have the same columns (keys.., node, ...)."""
    order = F.row_number().over(Window.partitionBy(*keys, "side_").orderBy(node)) - 1
    both = left.withColumn("side_", F.lit(0)).unionByName(right.withColumn("side_", F.lit(1))).dropna(subset=keys)
    ranked = cut(both.withColumn("block_", F.floor(order / size)))
    count = lambda side: (F.max(F.when(F.col("side_") == side, F.col("block_"))) + 1)
    blocks = ranked.groupBy(*keys).agg(count(0).alias("l_"), count(1).alias("r_")).dropna()  # keys that both sides have
    n = blocks.agg(F.sum(F.col("l_") * F.col("r_"))).first()[0] or 1
    each = ranked.join(blocks, keys).withColumn("other_", F.explode(F.sequence(F.lit(0), F.when(F.col("side_") == 0, F.col("r_")).otherwise(F.col("l_")) - 1))).drop("l_", "r_")
    each = each.withColumns({"p_": F.when(F.col("side_") == 0, F.col("block_")).otherwise(F.col("other_")), "q_": F.when(F.col("side_") == 0, F.col("other_")).otherwise(F.col("block_"))}).drop("other_", "block_")
    out = StructType([*[StructField(k, left.schema[k].dataType) for k in keys], *schema.fields])
    arrow = to_arrow_schema(out)

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        side, key = table["side_"].to_numpy(), [table[k][0] for k in keys]
        for columns in run(*(table.filter(pa.array(side == k)).combine_chunks() for k in (0, 1))):
            yield _batch(key, columns, schema, arrow)

    return _deal(each, keys, n).groupBy(*keys, "p_", "q_").applyInArrow(cell, out)


def _batch(key: list, columns: dict, schema: StructType, arrow: pa.Schema) -> pa.RecordBatch:
    count = len(columns[schema.fields[0].name])
    values = [columns[f.name] for f in schema.fields]
    own = [pa.array(v, arrow.field(f.name).type, from_pandas=True) if isinstance(v, np.ndarray) else v for f, v in zip(schema.fields, values, strict=True)]
    return pa.RecordBatch.from_arrays([*[pa.repeat(v, count) for v in key], *own], schema=arrow)


def fields(text: str) -> StructType:
    return _parse_datatype_string(text)


def flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def all_pairs(rows: DataFrame, keys: list[str], node: str, measure: pairwise.Measure, columns: str = "value double", keep: Callable[[dict], np.ndarray] | None = None, size: int = BLOCK) -> DataFrame:
    """(keys.., i, j, columns..) of all pairs i < j of rows(keys.., node, ...) with equal keys, as `measure` gives them; keep(values) says which pairs stay.
    What the measure leaves undefined (NaN) is null."""
    kind = rows.schema[node].dataType
    schema = StructType([StructField("i", kind), StructField("j", kind), *fields(columns).fields])

    def run(a: pa.Table, b: pa.Table, same: bool) -> Iterator[dict]:
        right = measure.prepare(b)
        left_nodes, right_nodes = flat(a[node]), flat(b[node])
        for at in range(0, len(a), measure.rows):
            strip = a.slice(at, measure.rows).combine_chunks()
            values = measure(measure.prepare(strip), right)
            here = np.ones((len(strip), len(b)), dtype=bool) if keep is None else np.array(keep(values), dtype=bool)
            if same:
                here &= np.arange(at, at + len(strip))[:, None] < np.arange(len(b))[None, :]
            if here.all():
                i, j = np.repeat(np.arange(at, at + len(strip)), len(b)), np.tile(np.arange(len(b)), len(strip))
                yield {"i": left_nodes.take(pa.array(i)), "j": right_nodes.take(pa.array(j)), **{c: np.ascontiguousarray(v).ravel() for c, v in values.items()}}
            else:
                i, j = np.nonzero(here)
                yield {"i": left_nodes.take(pa.array(i + at)), "j": right_nodes.take(pa.array(j)), **{c: v[here] for c, v in values.items()}}

    return in_cells(rows, keys, node, run, schema, size)
