import random

import pytest
from pyspark.sql import functions as F

from foldstone.model import OPS
from foldstone.operators import fold
from tables import b, order, rows


def ops(spark, *commands):
    """(key, value or None for a delete) numbered from 1."""
    return spark.createDataFrame([(b(k), i, 0 if v is None else 1, b(v)) for i, (k, v) in enumerate(commands, 1)], OPS)


def test_newest_wins_and_tombstones_hide(spark):
    df = ops(spark, ("a", "v1"), ("a", "v2"), ("b", "v1"), ("b", None), ("c", "v1"), ("c", None), ("c", "v2"))
    assert rows(fold.visible(df), "key", "value") == [(b"a", b"v2"), (b"c", b"v2")]
    assert rows(fold.latest(df), "key", "op") == [(b"a", 1), (b"b", 0), (b"c", 1)]
    assert rows(fold.latest(df)) == rows(fold.latest_by_window(df))


def test_delete_of_a_missing_key_and_of_an_empty_value(spark):
    df = ops(spark, ("c", None), ("", "root"), ("e", ""))
    assert rows(fold.latest(df), "key", "op", "value") == [(b"", 1, b"root"), (b"c", 0, None), (b"e", 1, b"")]


@pytest.mark.parametrize("start,end,expected", [(b"b", b"d", "bc"), (b"c", None, "cde"), (None, b"c", "ab"), (b"d", b"d", ""), (b"", b"", ""), (b"bb", b"e", "cd"), (None, None, "abcde")])
def test_ranges_are_half_open(spark, start, end, expected):
    df = ops(spark, *((k, "1") for k in "abcde"))
    assert "".join(r[0].decode() for r in rows(fold.in_range(fold.visible(df), start, end), "key")) == expected


def test_keys_are_ordered_as_unsigned_bytes(spark):
    keys = [b"", b"a", b"a\x00", b"\x7f", b"\xff"]
    df = spark.createDataFrame([(bytearray(k), 1, 1, None) for k in random.sample(keys, 5)], OPS)
    assert [bytes(r.key) for r in df.orderBy("key").collect()] == keys


def test_nulls_repeats_extra_columns_and_empty_input(spark):
    df = spark.createDataFrame([(None, 1, 1, "x", "s"), ("a", None, 1, "x", "s"), ("a", 1, 1, None, None), ("a", 1, 1, None, None)], "key string, seq long, op int, value string, _newest string")
    assert rows(fold.latest(df), "key", "seq", "_newest") == [("a", 1, None)]
    assert fold.latest(df.where("false")).count() == 0
    assert fold.visible(df.where("false")).count() == 0


def test_fold_is_the_same_after_any_split_into_runs(spark):
    rng = random.Random(7)
    df = ops(spark, *((rng.choice("abcdefgh"), rng.choice(["x", "y", None])) for _ in range(200))).withColumn("run", F.col("seq") % 5)
    runs = [fold.latest(df.where(F.col("run") == n).drop("run")) for n in range(5)]
    assert rows(fold.merge_runs(runs)) == rows(fold.latest(df.drop("run"))) == rows(fold.merge_runs(runs[::-1]))


def test_as_of(spark):
    df = ops(spark, ("a", "1"), ("a", None), ("a", "2"))
    assert [rows(fold.visible(fold.as_of(df, n)), "value") for n in (1, 2, 3)] == [[(b"1",)], [], [(b"2",)]]


def test_lower_bound(spark):
    rng = random.Random(3)
    keys, probes = {rng.randrange(1000) for _ in range(80)}, [rng.randrange(1100) for _ in range(60)]
    t = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key int")
    p = spark.createDataFrame([(k,) for k in probes] + [(None,)], "probe int")
    assert rows(fold.lower_bound(t, p), "probe", "found") == order((q, min((k for k in keys if k >= q), default=None)) for q in set(probes))
    assert rows(fold.lower_bound(t.where("false"), p.limit(1)), "found") == [(None,)]


def test_multi_get(spark):
    df = ops(spark, ("a", "1"), ("b", "2"), ("b", None))
    want = spark.createDataFrame([(b("a"), 1), (b("b"), 2), (b("z"), 3), (b("a"), 4), (None, 5)], "key binary, value int")
    assert rows(fold.multi_get(df, want), "key", "status", "value") == [(b"a", "value", b"1"), (b"b", "deleted", None), (b"z", "missing", None)]


def test_members(spark):
    t, p = spark.createDataFrame([(1,), (1,), (None,)], "key int"), spark.createDataFrame([(1,), (2,), (None,)], "key int")
    assert rows(fold.members(p, t)) == [(1,)]
    assert rows(fold.members(p, t, absent=True)) == [(None,), (2,)]


def applied(trace):
    """The batch rule as a machine: commands of a batch count once it ends, a new begin drops the open one."""
    out, pending = [], None
    for i, kind in enumerate(trace):
        if kind == "B":
            pending = []
        elif kind == "E":
            out += pending or []
            pending = None
        elif pending is None:
            out.append(i)
        else:
            pending.append(i)
    return sorted(out)


def test_closed_batches_match_the_machine(spark):
    rng = random.Random(11)
    traces = ["".join(rng.choice("PPDBE") for _ in range(rng.randrange(1, 30))) for _ in range(25)]
    df = spark.createDataFrame([(s, i, k) for s, t in enumerate(traces) for i, k in enumerate(t)], "segment int, at int, kind string")
    flat = [(s, i, k) for s, t in enumerate(traces) for i, k in enumerate(t)]  # batches go on over segments
    assert rows(fold.closed_batches(df, "segment", "at", "kind"), "segment", "at") == order((flat[i][0], flat[i][1]) for i in applied([x[2] for x in flat]))


def test_valid_prefix(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, False), (None, 1, True), (3, 5, True)], "segment int, at int, bad boolean")
    assert rows(fold.valid_prefix(df, "segment", "at", F.col("bad")), "segment", "at") == [(1, 1), (2, 1)]


@pytest.mark.parametrize("percent", [0, 50, 95, 100])
def test_nearest_rank_truncates(spark, percent):
    rng = random.Random(percent)
    data = [(g, rng.randrange(50)) for g in "aab" for _ in range(37)]
    df = spark.createDataFrame([*data, ("a", None)], "g string, v int")
    pick = lambda vs: sorted(vs)[(len(vs) - 1) * percent // 100]
    assert rows(fold.nearest_rank(df, "v", percent, ["g"])) == order((g, pick([v for h, v in data if h == g])) for g in "ab")
    assert rows(fold.nearest_rank(df, "v", percent)) == [(pick([v for _, v in data]),)]
    assert fold.nearest_rank(df.where("false"), "v", percent).count() == 0
