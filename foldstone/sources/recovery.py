"""Taking over the folder of an embedded store: its manifest, its sorted files and its log segments."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import Corrupt
from ..operators import fold
from ..plans.compaction import RunMeta
from ..shared import Folder
from ..store import Store
from . import binary

#: Names and fields of the embedded store's manifest.
MANIFEST = "MANIFEST"
RUN_FIELDS = ("id", "level", "path", "file_size", "record_count", "data_length")


@dataclass(frozen=True)
class Listed:
    """What an embedded store has published; a folder without a manifest has published nothing."""

    next_id: int = 1
    flushed_segment: int = 0
    runs: tuple[RunMeta, ...] = ()


def read_manifest(spark: SparkSession, path: str) -> Listed:
    folder = Folder(spark, path)
    if not folder.exists(MANIFEST):
        return Listed()
    try:
        d = json.loads(folder.read(MANIFEST))
        key = lambda k: base64.b64decode(k) if k else None
        runs = tuple(RunMeta(*(r[c] for c in RUN_FIELDS), key(r["min_key"]), key(r["max_key"])) for r in d.get("tables") or ())
        return Listed(d.get("next_sst_id") or 1, d.get("flushed_wal_segment") or 0, runs)
    except (ValueError, KeyError, TypeError) as e:
        raise Corrupt(f"unreadable manifest: {e}") from e


def replayed(log: DataFrame) -> DataFrame:
    """Puts and deletes in force of ``(segment, lsn, type, key, value)``, in the order of segment and number; batches go on over segments."""
    return fold.closed_batches(log, "segment", "lsn", "type")


def recover(store: Store, path: str) -> int:
    """Write what an embedded store's folder holds into an empty store, in one commit; returns the last flushed segment.

    Files that its manifest doesn't list (of flushes that died before publishing) are ignored, and so are segments
    that are flushed already and torn ends of segments. Of several versions of a key the log's newest wins,
    then the run of the upper level, then the greater id. Missing listed files raise ``Corrupt``.
    """
    spark, listed = store.spark, read_manifest(store.spark, path)
    folder = Folder(spark, path)
    logs = any(n.endswith(".wal") for n in folder.list())
    op, at = F.when(F.col("type") == "P", 1).otherwise(0), F.struct(F.lit(1).alias("log"), F.col("segment").cast("long").alias("a"), F.col("lsn").alias("b"))
    parts = [replayed(binary.read_log(spark, path, listed.flushed_segment + 1)).select("key", op.cast("byte").alias("op"), "value", at.alias("at"))] if logs else []
    if listed.runs:
        there = folder.list()
        if missing := [r.id for r in listed.runs if r.path.rpartition("/")[2] not in there]:
            raise Corrupt(f"listed files are missing: {missing[:3]}")
        levels = spark.createDataFrame([(r.id, r.level) for r in listed.runs], "id long, level long")
        order = F.struct(F.lit(0).alias("log"), (-F.col("level")).alias("a"), F.col("id").alias("b"))
        parts.append(binary.read_sorted(spark, path).join(levels, "id").select("key", "op", "value", order.alias("at")))
    for rows in parts[:1]:
        for more in parts[1:]:
            rows = rows.unionByName(more)
        store.write_rows(rows, order="at")
    return listed.flushed_segment
