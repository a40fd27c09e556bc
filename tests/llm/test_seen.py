import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.llm import seen, xorfilter
from foldstone.shared import work_dir
from tables import b, order, rows

INCOMING, HISTORY = "probe_id long, key binary, value binary, h string", "run_id long, key binary, parts string"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_filter_holds_every_member_and_few_strangers(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63 - 1, n)
    seed, cells = xorfilter.build(np.concatenate([keys, keys[: n // 2]]))
    assert xorfilter.contains(seed, cells, keys).all()
    strangers = rng.integers(-(2**63), 2**63 - 1, 200_000)
    assert xorfilter.contains(seed, cells, strangers).mean() < 6 * xorfilter.FALSE_POSITIVE
    assert n < 1000 or len(cells) * 8 / n < 20.5


def test_error_rates_compound():
    e = xorfilter.FALSE_POSITIVE
    assert xorfilter.compounded(0) == 0 and abs(xorfilter.compounded(1) - e) < 1e-12 and abs(xorfilter.compounded(2) - (2 * e - e * e)) < 1e-12


def brute(incoming, history):
    old, first, out = {k for _, k in history if k is not None}, {}, set()
    for i, k in sorted({(i, k) for i, k in incoming if k is not None and i is not None}):
        if k in old or first.setdefault(k, i) < i:
            out.add((i,))
    return order(out)


def run(spark, incoming, history, **sizes):
    i = spark.createDataFrame([(n, b(k), None, "x") for n, k in incoming], INCOMING)
    h = spark.createDataFrame([(n, b(k), "y") for n, k in history], HISTORY)
    return seen.seen_before(i, h, **sizes)


def test_matches_brute_force_with_a_hot_key(spark):
    rng = random.Random(1)
    name = lambda: b"hot" if rng.random() < 0.35 else bytes([rng.randrange(256) for _ in range(rng.choice([0, 1, 2]))])
    incoming = [(i * 3, name()) for i in range(600)]
    incoming += [(i, None) for i in range(5)] + incoming[:50]
    history = [(rng.randrange(40), name()) for _ in range(200)] + [(None, b"null run"), (3, None)]
    incoming.append((10_000, b"null run"))
    rng.shuffle(incoming)
    got = run(spark, incoming, history, bucket_keys=10)
    assert rows(seen.found(got)) == brute(incoming, history)
    rates = seen.error_rates(got).orderBy("batch").collect()
    assert [r.filters for r in rates] == sorted(r.filters for r in rates) and all(r.wrong <= r.new_keys for r in rates)
    sizes = seen.filter_sizes(got).collect()
    assert {r.part for r in sizes} <= set(range(seen.GENERATIONS + seen.BATCHES - 1))


@pytest.mark.parametrize("incoming,history", [([], []), ([(1, b"a"), (2, b"a"), (1, b"a")], []), ([], [(1, b"a")]), ([(5, None)], [(1, None)]), ([(7, b"")], [(1, b"")])])
def test_small_and_empty_tables(spark, incoming, history):
    assert rows(seen.found(run(spark, incoming, history))) == brute(incoming, history)


def test_one_wrong_positive_is_caught(spark):
    got = run(spark, [(1, b"new"), (2, b"old")], [(1, b"old")])
    lied = seen.Seen(got.arrivals, got.firsts.withColumn("part_hits", F.lit(1)), got.filters, got.generations, got.batches)
    assert rows(seen.found(lied)) == [(2,)] and sum(r.wrong for r in seen.error_rates(lied).collect()) == 1


def test_a_second_run_builds_only_the_new_generation(spark):
    rng = random.Random(2)
    key = lambda: bytes([rng.randrange(256) for _ in range(2)])
    first = [(i % 40, key()) for i in range(300)] + [(None, b"null run")]
    more = first + [(40 + i % 7, key()) for i in range(50)]
    incoming = [(i, key()) for i in range(400)] + [(900, b"null run")]
    table = lambda t: spark.createDataFrame([(n, b(k), "y") for n, k in t], HISTORY)
    i = spark.createDataFrame([(n, b(k), None, "x") for n, k in incoming], INCOMING)
    sealed = seen.Sealed(spark, work_dir(spark, "sealed"))
    assert rows(seen.found(seen.seen_before(i, table(first), sealed=sealed, bucket_keys=20))) == brute(incoming, first)
    before = {(r.part, r.bucket): bytes(r.cells) for r in sealed.filters().collect()}
    borders = sealed.parts()
    assert rows(seen.found(seen.seen_before(i, table(more), sealed=sealed, bucket_keys=20))) == brute(incoming, more)
    after = {(r.part, r.bucket): bytes(r.cells) for r in sealed.filters().collect()}
    assert before.items() <= after.items() and {p for p, _ in after.keys() - before.keys()} == {4}
    assert sealed.parts()[:4] == borders and sealed.parts()[4]["above"] == borders[3]["through"] == 39
    assert sealed.seal(table(more)) == []


def test_parts_of_very_unequal_size(spark):
    history = [(0, b"a"), (100, b"b")] + [(50, b"%d" % i) for i in range(500)]
    incoming = [(i, b"%d" % (i * 3)) for i in range(300)] + [(1000, b"a"), (1001, b"b"), (1002, b"c")]
    got = run(spark, incoming, history, bucket_keys=10)
    assert rows(seen.found(got)) == brute(incoming, history)
    assert len({r.bits for r in got.filters.collect()}) > 2


def test_many_positives_are_joined(spark, monkeypatch):
    monkeypatch.setattr(seen, "SENT_BYTES", 0)
    incoming, history = [(i, b"%d" % (i % 30)) for i in range(90)], [(i, b"%d" % (2 * i)) for i in range(20)] * 3
    assert rows(seen.found(run(spark, incoming, history))) == brute(incoming, history)
