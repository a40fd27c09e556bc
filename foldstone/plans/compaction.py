"""Choosing runs to compact: over a manifest's runs on the driver, and over metadata tables of any size.

A manifest lists at most some thousand runs, so its planner is plain Python. The same rules as
DataFrames serve tables of the metadata of very many stores.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..model import Options
from ..shared import materialize


@dataclass(frozen=True)
class RunMeta:
    """A published run. Bounds are None only for an empty run."""

    id: int
    level: int
    path: str
    file_size: int
    record_count: int
    data_length: int
    min_key: bytes | None
    max_key: bytes | None
    max_seq: int = 0
    files: dict[str, int] = field(default_factory=dict, hash=False, compare=False)


@dataclass(frozen=True)
class Plan:
    inputs: tuple[RunMeta, ...]
    source_level: int
    output_level: int
    min_key: bytes | None
    max_key: bytes | None
    bottommost: bool


def ranges_overlap(a_min, a_max, b_min, b_max) -> bool:
    """Whether two closed key ranges share a key. None means that there is no key at all; the empty key is a key."""
    return None not in (a_min, a_max, b_min, b_max) and a_max >= b_min and b_max >= a_min


def hull(runs) -> tuple[bytes | None, bytes | None]:
    """Least and greatest key of all runs."""
    lows, highs = [r.min_key for r in runs if r.min_key is not None], [r.max_key for r in runs if r.max_key is not None]
    return min(lows, default=None), max(highs, default=None)


def level_target(level: int, options: Options) -> int:
    """Bytes that a level may hold: the base for level 1, and each level a multiple of the one above."""
    return max(1, options.level_base) * max(1, options.level_mult or 10) ** (level - 1)


def pick(runs: list[RunMeta], options: Options = Options()) -> Plan | None:
    """The next compaction, or None.

    Level 0 goes first, once it has ``l0_trigger`` runs (0 or less: never): all of it, with the runs of
    level 1 that overlap its hull. Otherwise the level with the greatest score (bytes over target,
    above 1; the first of equals) gives its oldest run to the next level. The deepest level gives
    nothing.
    """
    levels = max(2, options.max_levels)
    by_level = {n: [r for r in runs if r.level == n] for n in {r.level for r in runs}}
    if options.l0_trigger > 0 and len(by_level.get(0, [])) >= options.l0_trigger:
        return _plan(by_level[0], 0, runs)
    scores = [(sum(r.file_size for r in by_level.get(n, [])) / level_target(n, options), -n) for n in range(1, levels - 1)]
    best, n = max(scores, default=(0, 0))
    if best <= 1:
        return None
    oldest = min(by_level[-n], key=lambda r: (r.max_seq, r.id))
    return _plan([oldest], -n, runs)


def _plan(sources: list[RunMeta], level: int, runs: list[RunMeta]) -> Plan:
    low, high = hull(sources)
    below = [r for r in runs if r.level == level + 1 and ranges_overlap(low, high, r.min_key, r.max_key)]
    inputs = tuple(dict.fromkeys([*sources, *below]))
    low, high = hull(inputs)
    chosen = {r.id for r in inputs}
    deeper = any(r.level > level + 1 and r.id not in chosen and ranges_overlap(low, high, r.min_key, r.max_key) for r in runs)
    return Plan(inputs, level, level + 1, low, high, not deeper)


# The same rules over tables with store_id, id, level, file_size, min_key and max_key.


def level_scores(meta: DataFrame, options: Options = Options(), store: str = "store_id") -> DataFrame:
    """``(store, level, bytes, target, score)`` of levels that may give runs to the next. NULL sizes count as nothing."""
    rows = meta.where(F.col("level").between(1, max(2, options.max_levels) - 2)).groupBy(store, "level").agg(F.sum(F.coalesce("file_size", F.lit(0))).alias("bytes"))
    target = F.lit(float(max(1, options.level_base))) * F.pow(F.lit(float(options.level_mult or 10)), F.col("level") - 1)
    return rows.withColumn("target", target).withColumn("score", F.col("bytes") / target)


def pick_level(meta: DataFrame, options: Options = Options(), store: str = "store_id") -> DataFrame:
    """``(store, level)`` with the greatest score above 1 of each store, the first of equals."""
    best = F.max(F.struct("score", (-F.col("level")).alias("negated"))).alias("b")
    return level_scores(meta, options, store).where("score > 1").groupBy(store).agg(best).select(store, (-F.col("b.negated")).cast("int").alias("level"))


def pick_l0(meta: DataFrame, options: Options = Options(), store: str = "store_id") -> DataFrame:
    """``(store, id, level)`` of the inputs of each store's level-0 compaction.

    Hulls are one row a store and are joined on the store, so no run meets another run.
    """
    zero = meta.where("level = 0")
    hulls = zero.groupBy(store).agg(F.count("*").alias("n"), F.min("min_key").alias("low"), F.max("max_key").alias("high")).where(F.col("n") >= options.l0_trigger)
    below = meta.where("level = 1").join(hulls, store).where("max_key >= low and min_key <= high").select(store, "id", "level")
    return zero.join(hulls.select(store), store, "left_semi").select(store, "id", "level").unionByName(below)


def overlap_counts(left: DataFrame, right: DataFrame, by: list[str], left_id: str = "id") -> DataFrame:
    """``(*by, left_id, overlapping)``: with how many right runs of the same group each left run shares a key.

    That is the right runs that start by the left one's end, less those that end before its start;
    both are running counts along the sorted bounds, so no pair of runs is formed. Runs without bounds
    overlap nothing and give no row.
    """
    good = "min_key is not null and max_key is not null"
    row = lambda df, key, at, starts, ends, sign: df.where(good).select(*by, F.col(key).alias("k"), F.lit(at).alias("at"), F.lit(starts).alias("s"), F.lit(ends).alias("e"), *sign)
    none = [F.lit(None).cast("long").alias("q"), F.lit(0).alias("kind")]
    asks = lambda kind: [F.col(left_id).cast("long").alias("q"), F.lit(kind).alias("kind")]
    line = row(right, "min_key", 0, 1, 0, none).unionByName(row(left, "max_key", 1, 0, 0, asks(1))).unionByName(row(right, "max_key", 2, 0, 1, none)).unionByName(row(left, "min_key", 1, 0, 0, asks(-1)))
    # cut into ranges, so that no store's line is one task; what came before a range is carried into it. Written, as it is read twice
    ranged = materialize(line.repartitionByRange(*by, "k", "at").withColumn("part", F.spark_partition_id()), "overlap-line")
    # as many rows as groups in ranges
    sums = ranged.groupBy(*(F.col(c).alias(f"_{c}") for c in by), F.col("part").alias("_part")).agg(F.sum("s").alias("s_here"), F.sum("e").alias("e_here"))
    earlier = Window.partitionBy(*(f"_{c}" for c in by)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*(f"_{c}" for c in by), "_part", *(F.coalesce(F.sum(f"{c}_here").over(earlier), F.lit(0)).alias(f"{c}_before") for c in "se"))
    along = Window.partitionBy(*by, "part").orderBy("k", "at").rowsBetween(Window.unboundedPreceding, 0)
    near = ranged.select("*", *(F.sum(c).over(along).alias(f"{c}_near") for c in "se")).where("q is not null")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "part"]])
    counted = near.join(carried, same).select(*by, "q", F.when(F.col("kind") == 1, F.col("s_near") + F.col("s_before")).otherwise(-F.col("e_near") - F.col("e_before")).alias("n"))
    return counted.groupBy(*by, "q").agg(F.sum("n").alias("overlapping")).withColumnRenamed("q", left_id)


def pick_next(meta: DataFrame, options: Options = Options(), store: str = "store_id") -> DataFrame:
    """``(store, id, level)`` of the inputs of each store's compaction from its level with the greatest score to the next one.

    The source is the oldest run of that level (the least id), and with it go the runs of the next level that
    share a key with it. One source a store is joined on the store, so no run meets another run.
    """
    rows = meta.select(store, "id", "level", "min_key", "max_key")
    chosen = pick_level(meta, options, store).select(F.col(store).alias("_s"), F.col("level").alias("_l"))
    here = rows.join(chosen, F.col(store).eqNullSafe(F.col("_s")) & (F.col("level") == F.col("_l")))
    oldest = here.groupBy("_s", "_l").agg(F.min(F.struct("id", "min_key", "max_key")).alias("o")).select("_s", "_l", "o.id", F.col("o.min_key").alias("low"), F.col("o.max_key").alias("high"))
    below = rows.join(oldest.select("_s", "_l", "low", "high"), F.col(store).eqNullSafe(F.col("_s")) & (F.col("level") == F.col("_l") + 1)).where("max_key >= low and min_key <= high")
    return oldest.select(F.col("_s").alias(store), "id", F.col("_l").alias("level")).unionByName(below.select(store, "id", "level"))


def bottommost(plans: DataFrame, meta: DataFrame, store: str = "store_id") -> DataFrame:
    """``(store, output_level, bottommost)`` of plans ``(store, output_level, low, high)``: whether no deeper run of the store shares a key with them."""
    deeper = meta.select(store, "level", "min_key", "max_key").where("level is not null")
    met = plans.join(deeper, store).where((F.col("level") > F.col("output_level")) & (F.col("max_key") >= F.col("low")) & (F.col("min_key") <= F.col("high")))
    return plans.join(met.select(store, "output_level").distinct().withColumn("_deeper", F.lit(True)), [store, "output_level"], "left").select(store, "output_level", F.col("_deeper").isNull().alias("bottommost"))
