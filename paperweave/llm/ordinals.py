"""Places of rows in sorted groups of any size, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.session import landed


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, the place from 0 in its group by ``order`` (null first), and ``n``, the group's size.

    Rows are dealt by ranges of group and order, so a group of any size takes as many tasks as it fills; each range
    counts its own rows, and the ranges' counts, at most ranges plus groups of them, give the offsets. ``group`` must
    not be null. Rows that are equal in all of ``order`` stand in any order and stay in one range.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("range", T.LongType()), T.StructField("nth", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(group))
            fresh = np.ones(batch.num_rows, dtype=bool)
            fresh[1:] = pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            if column[0].as_py() == last:
                fresh[0] = False
            index = np.arange(batch.num_rows)
            head = np.maximum.accumulate(np.where(fresh, index, -1))
            nth = np.where(head < 0, index + seen, index - head)
            last, seen = column[-1].as_py(), int(nth[-1]) + 1
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, here, dtype=np.int64)), pa.array(nth.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    local = landed(ranged.mapInArrow(count, schema), name)
    sizes = local.groupBy(group, "range").agg((F.max("nth") + 1).alias("size"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        group, "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(Window.partitionBy(group)).alias("n")
    )
    found = local.join(offsets, [group, "range"])
    return found.select(*rows.columns, (F.col("offset") + F.col("nth")).alias("idx"), "n")
