"""Cutting sorted entries into blocks and runs by bytes.

The exact rules are sequential: the sum starts anew at each cut. They are folded group by group over
Arrow batches, so a group may be longer than memory. For writing, ranges are cut by size instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T


def starts(sizes: np.ndarray, filled: int, target: int, before: bool) -> tuple[list[int], int]:
    """Rows at which new pieces start, and the bytes of the last piece. The first row belongs to a piece with ``filled`` bytes, or (-1) to a new one."""
    total = np.cumsum(sizes) + max(0, filled)
    out, begin, base = [], 0 if filled < 0 else -1, 0
    while target:
        if before:
            at = int(np.searchsorted(total, base + target, "right"))
            at += at == begin  # an entry that is too large alone has a piece of its own
        elif begin < 0 and filled >= target:
            at = 0
        else:
            at = int(np.searchsorted(total, base + target, "left")) + 1
        if at >= len(sizes):
            break
        out.append(at)
        begin, base = at, int(total[at] - sizes[at])
    return out, int(total[-1]) - base


def _numbered(target: int, before: bool):
    """Number rows of a sorted partition by group: a new piece at each group, and where bytes say so.

    With ``before`` a piece is cut before the row that would exceed ``target`` (unless the piece is
    empty); else it is cut after the row that reaches it. A target of 0 makes one piece. Python steps from cut to cut, not from row to row.
    """

    def run(batches):
        group, piece, filled = object(), 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            runs = pc.run_end_encode(batch.column(0))
            sizes, out, low = batch.column(1).to_numpy(zero_copy_only=False), np.empty(n, np.int32), 0
            for g, high in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if g != group:
                    group, piece, filled = g, 0, -1
                cuts, filled = starts(sizes[low:high], filled, target, before)
                marks = np.zeros(high - low, np.int32)
                marks[cuts] = 1
                out[low:high] = piece + np.cumsum(marks)
                piece, low = int(out[high - 1]), high
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "piece"])

    return run


def pieces(df: DataFrame, group: str, order: Sequence[str], size: str, target: int, *, before: bool) -> DataFrame:
    """``df`` with ``piece``, numbered from 0 in each group along ``order``.

    A group is processed by one task, cut after cut, since each depends on the one before;
    rows stream through, they aren't gathered. NULL sizes count as 0, a NULL group is a group.
    """
    rest = [c for c in df.columns if c not in (group, size)]
    cols = df.select(F.col(group), F.coalesce(F.col(size), F.lit(0)).cast("long").alias(size), *rest)
    schema = T.StructType([*cols.schema.fields, T.StructField("piece", T.IntegerType())])
    return cols.repartition(group).sortWithinPartitions(group, *order).mapInArrow(_numbered(target, before), schema)


def output_split(df: DataFrame, group: str, order: Sequence[str], size: str, target: int) -> DataFrame:
    """Output runs: cut before an entry that would exceed ``target``; an entry larger than it has a run of its own."""
    return pieces(df, group, order, size, target, before=True)


def block_cut(df: DataFrame, group: str, order: Sequence[str], size: str, target: int) -> DataFrame:
    """Blocks: closed once they have ``target`` bytes; the entry that crosses the mark stays in its block."""
    return pieces(df, group, order, size, target, before=False)


def run_stats(df: DataFrame, run: str, key: str = "key", size: str = "size") -> DataFrame:
    """``(run, record_count, data_length, min_key, max_key)`` of each run."""
    return df.groupBy(run).agg(F.count("*").alias("record_count"), F.sum(size).alias("data_length"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))
