import random

from foldstone.model import Options
from foldstone.plans import compaction as c
from tables import order, rows


def run(id, level, low, high, size=10, seq=0):
    return c.RunMeta(id, level, f"r{id}", size, 1, size, low, high, seq)


def test_level_zero_goes_with_what_its_hull_overlaps():
    runs = [run(1, 0, b"a", b"a"), run(2, 0, b"m", b"m"), run(3, 0, b"z", b"z"), run(4, 0, b"t", b"t"), run(5, 1, b"p", b"p"), run(6, 1, b"zzzz", b"zzzz")]
    plan = c.pick(runs)
    assert {r.id for r in plan.inputs} == {1, 2, 3, 4, 5} and (plan.source_level, plan.output_level) == (0, 1)
    assert plan.bottommost and c.pick(runs, Options(l0_trigger=0)) is None and c.pick(runs[:3]) is None


def test_score_picks_the_oldest_run_of_the_fullest_level():
    runs = [run(1, 1, b"a", b"c", 5, seq=9), run(2, 1, b"x", b"z", 5, seq=3), run(3, 2, b"y", b"y"), run(4, 3, b"x1", b"x1")]
    plan = c.pick(runs, Options(level_base=1, level_mult=2))
    assert [r.id for r in plan.inputs] == [2, 3] and plan.output_level == 2 and not plan.bottommost
    assert c.pick(runs, Options(level_base=1000)) is None


def test_deepest_level_is_never_a_source():
    assert c.pick([run(1, 2, b"a", b"b", 10**9)], Options(max_levels=3, level_base=1)) is None


def test_empty_key_is_a_key():
    assert c.ranges_overlap(b"", b"a", b"", b"") and not c.ranges_overlap(None, b"a", b"", b"z")


def table(spark, runs):
    return spark.createDataFrame([(1, r.id, r.level, r.file_size, None if r.min_key is None else bytearray(r.min_key), None if r.max_key is None else bytearray(r.max_key)) for r in runs], "store_id int, id long, level int, file_size long, min_key binary, max_key binary")


def test_tables_follow_the_same_rules(spark):
    rng = random.Random(5)
    options = Options(l0_trigger=3, level_base=50, level_mult=2)
    for seed in range(4):
        runs = []
        for i in range(30):
            low, high = sorted(rng.choices(range(256), k=2))
            runs.append(run(i, rng.randrange(5), bytes([low]), bytes([high]), rng.randrange(1, 60)))
        df = table(spark, runs)
        plan = c.pick(runs, options)
        zero = [r for r in runs if r.level == 0]
        if len(zero) >= 3:
            assert rows(c.pick_l0(df, options), "id") == order((r.id,) for r in plan.inputs)
        level = c.pick([r for r in runs if r.level], options)
        assert rows(c.pick_level(df, options), "level") == ([(level.source_level,)] if level else [])
        overlapping = [(r.id, sum(q.level == r.level + 1 and c.ranges_overlap(r.min_key, r.max_key, q.min_key, q.max_key) for q in runs)) for r in runs]
        from pyspark.sql import functions as F

        assert rows(c.overlap_counts(df, df.withColumn("level", F.col("level") - 1), ["store_id", "level"]), "id", "overlapping") == order(overlapping)


def test_bounds_that_are_missing(spark):
    df = table(spark, [run(1, 0, None, None), run(2, 1, b"a", b"b")])
    assert rows(c.overlap_counts(df, df, ["store_id"]), "id", "overlapping") == [(2, 1)]
    assert c.level_scores(df.where("false")).count() == 0


def test_pruning_counts_runs_of_every_level(spark, tmp_path):
    from foldstone.plans import catalog

    runs = [run(i, level, b"a", b"m") for i, level in enumerate([0, 0, 1, 2, 3, 4, None])] + [run(7, 0, b"n", b"z"), run(8, 1, None, None)]
    table(spark, runs).selectExpr("*", "timestamp'2026-01-01' AS recorded_at").write.parquet(f"{tmp_path}/run_meta.parquet")
    keys = [(1, bytearray(b"a")), (1, bytearray(b"m")), (1, bytearray(b"m")), (1, bytearray(b"p")), (1, bytearray(b"zz")), (2, bytearray(b"a")), (None, bytearray(b"a")), (1, None)]
    spark.createDataFrame(keys, "store_id int, key binary").write.parquet(f"{tmp_path}/memtable_ops.parquet")
    got = catalog.queries()["run_prune"](spark, str(tmp_path))
    hexed = lambda k: k.hex().upper()
    assert rows(got, "store_id", "key_hex", "may_hold") == order([(1, hexed(b"a"), 7), (1, hexed(b"m"), 7), (1, hexed(b"p"), 1), (1, hexed(b"zz"), 0), (2, hexed(b"a"), 0), (None, hexed(b"a"), 0)])


def test_partial_merges_cover_every_run(spark, tmp_path):
    from foldstone.plans import catalog

    events = [(e, e % 2, "error" if e == 5001 else "view", "x") for e in (10, 1010, 3011, 4001, 5001, 5002, 9003)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["compact_keep"](spark, str(tmp_path))
    assert rows(got, "run", "seq", "op") == order([(0, 1010, 1), (0, 3011, 1), (1, 5001, 0), (1, 5002, 1), (2, 9003, 1)])
