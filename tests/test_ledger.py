import random

import pytest

from foldstone.operators import ledger as lg
from foldstone.shared import work_dir
from tables import b, order, rows

WAL = "store_id int, segment int, lsn long, type string, key binary, value binary, item string"
MANIFEST = "store_id int, manifest_version long, flushed_wal_segment int, outcome string"


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def ledger(spark, clock):
    return lg.Ledger(spark, work_dir(spark, "test-ledger"), clock, clock.sleep)


def test_states_leases_and_fencing(ledger, clock):
    assert ledger.add({"a": {}, "b": {}}) == ["a", "b"] and ledger.add({"a": {}}) == []
    one, = ledger.lease("first", seconds=10, limit=1)
    assert one == lg.Lease("a", 1) and [x.item for x in ledger.lease("second", 10)] == ["b"] and ledger.lease("third") == []
    clock.now += 11
    assert {v["state"] for v in ledger.items().values()} == {"pending"}
    again = ledger.lease("third", 10)
    assert [(x.item, x.token) for x in again] == [("a", 2), ("b", 2)]
    with pytest.raises(lg.StaleToken):
        ledger.finish([one])
    ledger.finish(again)
    assert {v["state"] for v in ledger.items().values()} == {"done"}
    with pytest.raises(lg.StaleToken):
        ledger.finish(again)
    clock.now += 100
    assert ledger.lease("fourth") == []


def test_two_writers_of_one_ledger(spark, ledger, clock):
    other = lg.Ledger(spark, ledger.path, clock)
    ledger.add({"a": {}})
    taken = ledger.lease("x") + other.lease("y")
    assert len(taken) == 1
    assert not ledger.folder.create("log/000000000.json", "{}")


def table(spark, records):
    return spark.createDataFrame([(s, g, n, t, b(k), b(v), "clash") for s, g, n, t, k, v in records], WAL)


def marks(spark, saves):
    return spark.createDataFrame(saves, MANIFEST)


def brute(records, saves):
    good = [x for x in saves if x[3] == "committed" and x[2] is not None]
    mark = {s: max((v, f) for t, v, f, _ in good if t == s)[1] for s in {x[0] for x in good}}
    letter = lambda t: t and (t.strip()[:1].upper() or "")
    old = {(s, n, letter(t), k, v) for s, g, n, t, k, v in records if g is not None and g <= mark.get(s, 0)}
    new = {(s, n) for s, g, n, t, k, v in records if n is not None and g is not None and g > mark.get(s, 0) and (s, n, letter(t), k, v) not in old}
    return order(new)


def trace(rng, segments=6):
    return [(rng.choice([1, 1, 1, 2, None]), rng.choice([*range(1, segments), None]), rng.choice([*range(30), None]), rng.choice(["P", " put", "d", None, "E"]), rng.choice([b"k", b"", None]), rng.choice([b"v", None])) for _ in range(150)]


def test_matches_brute_force(spark):
    rng = random.Random(4)
    for _ in range(2):
        records = trace(rng)
        saves = [(rng.choice([1, 2]), v, rng.choice([1, 2, 3, None]), rng.choice(["committed", "failed", None])) for v in range(8)]
        got = lg.take_up(table(spark, records), marks(spark, saves), work_dir(spark, "l"))
        assert rows(got, "store_id", "lsn") == brute(records, saves)


def test_second_run_takes_only_what_came_since(spark, ledger):
    first = [(1, 1, n, "P", b"k", b"v") for n in range(5)]
    more = [(1, 2, 5, "P", b"k", b"v"), (1, 2, 3, "P", b"k", b"v"), (1, 2, 4, "P", b"k", b"other"), (2, 1, 1, "D", b"k", None)]
    empty = marks(spark, [])
    assert rows(lg.take_up(table(spark, first), empty, ledger.path), "lsn") == [(n,) for n in range(5)]
    assert lg.plan_flush(ledger, table(spark, first), empty) == []
    everything = table(spark, first + more)
    before = set(ledger.items())
    assert lg.plan_flush(ledger, everything, empty)
    assert lg.run_items(ledger, everything, "again") == 1
    fresh = ledger.done_output().where(~lg.F.col("item").isin(list(before)))
    assert rows(fresh, "store_id", "lsn") == [(1, 4), (1, 5), (2, 1)]


def test_a_run_that_died_is_repeated_without_repeats(spark, ledger, clock):
    wal = table(spark, [(s, 1, n, "P", b"k", b"v") for s in range(4) for n in range(3)])
    assert len(lg.plan_flush(ledger, wal, marks(spark, []), item_rows=5)) == 3
    dead = ledger.lease("dead", seconds=10)
    late = lg.write_items(ledger, wal, dead)
    assert ledger.done_output() is None  # written but not finished: readers see nothing
    assert lg.run_items(ledger, wal, "too early") == 0
    clock.now += 11
    assert lg.run_items(ledger, wal, "next") == len(dead)
    everything = order((s, n) for s in range(4) for n in range(3))
    assert rows(ledger.done_output(), "store_id", "lsn") == everything
    lg.write_items(ledger, wal.where("false"), dead)  # a stale writer that is still busy replaces nothing that is published
    with pytest.raises(lg.StaleToken):
        ledger.finish(dead, late)
    assert rows(ledger.done_output(), "store_id", "lsn") == everything


def test_an_unfinished_ledger_gives_no_part_of_the_result(spark, ledger, clock):
    wal = table(spark, [(s, 1, n, "P", b"k", b"v") for s in range(4) for n in range(3)])
    lg.plan_flush(ledger, wal, marks(spark, []), item_rows=5)
    ledger.lease("other", seconds=100, limit=1)
    with pytest.raises(lg.Incomplete):
        lg.take_up(wal, marks(spark, []), ledger, patience=20)
    assert len(rows(lg.take_up(wal, marks(spark, []), ledger, patience=200))) == 12  # the lease expires


def test_lost_output_is_an_error(spark, ledger):
    wal = table(spark, [(1, 1, 1, "P", b"k", b"v")])
    lg.take_up(wal, marks(spark, []), ledger)
    done, = ledger.items().values()
    ledger.folder.delete(done["path"])
    with pytest.raises(lg.LostOutput):
        ledger.done_output()


def test_records_appended_to_the_last_planned_segment(spark, ledger):
    first = [(1, 1, n, "P", b"k", b"v") for n in range(3)]
    assert len(rows(lg.take_up(table(spark, first), marks(spark, []), ledger))) == 3
    more = first + [(1, 1, n, "P", b"k", b"v") for n in range(3, 5)]
    assert rows(lg.take_up(table(spark, more), marks(spark, []), ledger), "lsn") == [(n,) for n in range(5)]
    assert len(ledger.items()) == 2


def test_the_log_of_states_is_trimmed(ledger, monkeypatch):
    monkeypatch.setattr(lg, "KEPT", 4)
    for i in range(23):
        ledger.add({f"{i:03d}": {"plan": "p"}})
    assert len(ledger.items()) == 23 and len([n for n in ledger.folder.list("log") if n.endswith(".json")]) <= 9


def test_two_planners(spark, ledger):
    wal = table(spark, [(1, 1, 1, "P", b"k", b"v")])
    assert ledger.add({"x": {"plan": "other"}}, {"unknown"}) == []
    assert len(lg.plan_flush(ledger, wal, marks(spark, []))) == 1 and lg.plan_flush(ledger, wal, marks(spark, [])) == []


def test_empty_tables(spark):
    assert lg.take_up(table(spark, []), marks(spark, []), work_dir(spark, "l")).count() == 0
    assert lg.take_up(table(spark, [(1, 1, None, "P", b"k", None)]), marks(spark, []), work_dir(spark, "l")).count() == 0
