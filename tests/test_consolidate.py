import random

import pytest
from pyspark.sql import functions as F

from foldstone.operators import consolidate as cs
from tables import b, order, rows

META = "id long, store_id int, level int, file_size long, recorded_at int, g_store int"
ENTRIES = "run_id long, key binary, value binary, op tinyint, id string, size string"


def meta(spark, runs):
    return spark.createDataFrame([(*r, 0) for r in runs], META)


def entries(spark, data):
    return spark.createDataFrame([(r, b(k), b(v), op, "clash", "clash") for r, k, v, op in data], ENTRIES)


def small(runs):
    newest = {}
    for r in sorted(runs, key=lambda r: (r[4] is not None, r[4] or 0)):
        newest[r[0]] = r
    good = [r for i, r in newest.items() if i is not None and r[2] is not None and (r[3] or 0) > 0 and r[3] < 512 * 2 ** max(0, r[2] - 1)]
    groups = [(r[1], r[2]) for r in good]
    return order((r[0],) for r in good if groups.count((r[1], r[2])) > 1)


def test_choice_of_small_runs(spark):
    rng = random.Random(3)
    runs = [(rng.randrange(90), rng.choice([1, 1, 2, None]), rng.choice([None, 0, 1, 2, 3, 4]), rng.choice([None, 0, -1, 1, 511, 512, 1023, 1024, 2047, 5000]), rng.choice([1, 2, 3, None])) for _ in range(120)]
    runs = list({(r[0], r[4]): r for r in runs}.values())
    runs += runs[:10] + [(None, 1, 1, 1, 1)]
    assert rows(cs.small_runs(meta(spark, runs)), "id") == small(runs)


def test_merge_keeps_every_entry_and_sorts(spark):
    rng = random.Random(8)
    runs = [(i, 1 if i < 8 else 2, i % 3, 100, 1) for i in range(16)]
    data = [(rng.randrange(18), b"hot" if rng.random() < 0.35 else rng.choice([b"", b"a", b"zz", None]), rng.choice([b"v" * 20, b"", None]), rng.choice([0, 1, None])) for _ in range(400)]
    data += data[:100]  # repeated as they are
    got = cs.consolidate(meta(spark, runs), entries(spark, data), target_run=300, range_bytes=1500)
    ids = {r[0] for r in small(runs)}
    assert rows(got.inputs, "id") == order((i,) for i in ids)
    assert rows(got.entries, "run_id", "key", "value", "op") == order(d for d in data if d[0] in ids)
    new = got.runs.collect()
    assert len({r.new_run for r in new}) == len(new) and len(new) > 6
    assert sum(r.record_count for r in new) == sum(d[0] in ids for d in data)
    # per group the new runs' ranges follow one another
    for group in {(r.store_id, r.level) for r in new}:
        own = sorted((bytes(r.min_key or b""), bytes(r.max_key or b"")) for r in new if (r.store_id, r.level) == group)
        assert all(x[1] <= y[0] for x, y in zip(own, own[1:]))
    held = got.entries.groupBy("new_run").agg(F.min("key").alias("a"), F.max("key").alias("z"), F.count("*").alias("n"))
    assert rows(held, "new_run", "a", "z", "n") == rows(got.runs, "new_run", "min_key", "max_key", "record_count")


def test_outputs_are_few_and_rolled_by_bytes(spark):
    runs = [(i, 1, 0, 10, 1) for i in range(40)]
    data = [(i, b"k%03d" % i, b"v" * 91, 1) for i in range(40)]
    one = cs.consolidate(meta(spark, runs), entries(spark, data)).runs.collect()
    assert [(r.record_count, r.inputs, bytes(r.min_key), bytes(r.max_key)) for r in one] == [(40, 40, b"k000", b"k039")]
    sizes = [r.data_length for r in cs.consolidate(meta(spark, runs), entries(spark, data), target_run=1000).runs.collect()]
    assert sum(s >= 1000 for s in sizes) >= len(sizes) - 1 and max(sizes) < 1000 + 104


def test_empty_tables(spark):
    for runs, data in (([], []), ([(1, 1, 0, 10, 1), (2, 1, 0, 10, 1)], []), ([], [(1, b"a", b"b", 1)])):
        got = cs.consolidate(meta(spark, runs), entries(spark, data))
        assert got.entries.count() == got.runs.count() == 0 and got.inputs.count() == len(runs)


def test_a_changed_entry_is_refused(spark, monkeypatch):
    cut = cs._cut

    def lossy(target):
        whole = cut(target)

        def run(batches):
            for number, rows in whole(batches):
                yield number, rows.slice(1)

        return run

    monkeypatch.setattr(cs, "_cut", lossy)
    with pytest.raises(RuntimeError):
        cs.consolidate(meta(spark, [(1, 1, 0, 10, 1), (2, 1, 0, 10, 1)]), entries(spark, [(1, b"a", b"b", 1), (2, b"a", b"b", 1)]))


def test_one_sorted_file_a_run_and_the_exchange(spark):
    rng = random.Random(9)
    runs = [(i, i % 3, i % 2, 100, 1) for i in range(18)] + [(99, 0, 0, 100, 1), (50, 1, 1, 90_000, 1)]
    data = [(rng.randrange(18), b"%03d" % rng.randrange(300), b"v" * rng.randrange(40), 1) for _ in range(600)]
    got = cs.consolidate(meta(spark, runs), entries(spark, data), target_run=700)
    new = {r.file: r for r in got.runs.collect()}
    assert got.entries.sparkSession.read.parquet(got.path).count() == 600 and len(new) > 12
    for r in spark.read.parquet(got.path).select(F.input_file_name().alias("f")).distinct().collect():
        name = r.f.rpartition("/")[2]
        held = spark.read.parquet(f"{got.path}/{name}").collect()
        assert [(bytes(x.key), x.run_id) for x in held] == sorted((bytes(x.key), x.run_id) for x in held)
        assert (len(held), bytes(held[0].key), bytes(held[-1].key)) == (new[name].record_count, bytes(new[name].min_key), bytes(new[name].max_key)) and new[name].file_size > 0
        del new[name]
    assert not new
    assert (99, None) in rows(got.replaced, "id", "new_run") and rows(got.replaced.select("id").distinct()) == order((i,) for i in [*range(18), 99])
    left = rows(got.swapped(meta(spark, runs)), "id")
    assert (50,) in left and len(left) == 1 + got.runs.count() and min(left)[0] == 50
