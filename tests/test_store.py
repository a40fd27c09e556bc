"""The store against literal cases, a dictionary, crashes and damage."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foldstone import store as st
from foldstone.model import Closed, Conflict, Corrupt, Failed, InvalidBatch, InvalidWrite, NotFound, Options
from tables import b, rows

QUIET = Options(auto_flush=False, auto_compact=False)


@pytest.fixture
def store(spark, tmp_path):
    return st.open_store(spark, f"file://{tmp_path}/s", QUIET)


def again(store, options=QUIET):
    """As after a crash: another handle, the first one never closed."""
    return st.open_store(store.spark, store.path, options)


def bulk(store, commands):
    """(key, value or None) in order, in one commit."""
    df = store.spark.createDataFrame([(b(k), b(v), 0 if v is None else 1, i) for i, (k, v) in enumerate(commands)], "key binary, value binary, op int, i int")
    store.write_rows(df, order="i")


def test_put_get_delete_and_resurrection(store):
    store.put(b"k1", b"v1")
    assert store.get(b"k1") == b"v1"
    store.delete(b"k1")
    with pytest.raises(NotFound):
        store.get(b"k1")
    store.put(b"k1", None)
    assert store.get(b"k1") == b"" and store.command_count() == 3
    with pytest.raises(NotFound):
        store.get(b"k")


def test_batch_is_atomic_and_ordered(store):
    batch = store.new_batch()
    batch.put(b"a", b"1")
    batch.put(b"b", b"2")
    batch.delete(b"a")
    store.write(batch)
    assert len(batch) == 3 and list(store.iterator()) == [(b"b", b"2")]
    batch.reset()
    store.write(batch)
    assert len(batch) == 0 and store.snapshot().version == 1
    with pytest.raises(InvalidBatch):
        store.write(None)
    with pytest.raises(InvalidBatch):
        store.write(st.Batch(again(store)))


def test_ordered_scan_with_bounds(store):
    bulk(store, [("m", "1"), ("a", "1"), ("z", "1"), ("k", "1"), ("c", "1"), ("m", "2"), ("a", "2"), ("k", None), ("k", "2"), ("z", None), ("ghost", None)])
    store.flush()
    assert list(store.iterator()) == [(b"a", b"2"), (b"c", b"1"), (b"k", b"2"), (b"m", b"2")]
    assert [k for k, _ in store.iterator(b"b", b"n")] == [b"c", b"k", b"m"]
    assert list(store.iterator(b"l", b"m")) == list(store.iterator(b"m", b"m")) == []


def test_closed_store_refuses(store):
    batch = store.new_batch()
    store.close()
    store.close()
    for act in (lambda: store.put(b"a", b"b"), lambda: store.get(b"a"), lambda: store.write(None), lambda: store.write(batch), store.flush):
        with pytest.raises(Closed):
            act()
    assert store.iterator() is None


def test_refused_writes_publish_nothing(spark, tmp_path):
    store = st.open_store(spark, f"file://{tmp_path}/s", Options(max_record=10))
    with pytest.raises(InvalidWrite):
        store.put(b"k", b"x" * 10)
    for data in ([(None, b("x"))], [(b("k"), b("x")), (b("k"), b("y"))]):
        with pytest.raises(InvalidWrite):
            store.write_rows(spark.createDataFrame(data, "key binary, value binary"))
    store.write_rows(spark.createDataFrame([], "key binary, value binary"))
    assert store.snapshot().version == 0


def test_recovery_without_close(store):
    store.put(b"a", b"1")
    store.put(b"b", b"2")
    store.delete(b"a")
    batch = store.new_batch()
    batch.put(b"c", b"3")
    batch.delete(b"b")
    batch.put(b"a", b"4")
    store.write(batch)
    assert list(again(store).iterator()) == [(b"a", b"4"), (b"c", b"3")]


def test_writers_that_died_before_publishing_leave_nothing(store):
    store.put(b"k", b"old")
    st.run_files.write_rows(store.spark.createDataFrame([(b("k"), 99, 1, b("orphan"))], st.OPS), store.path, "runs", rows_in_file=1)
    st.run_files.write_rows(store.spark.createDataFrame([(b("z"), 99, 1, b("half"))], st.OPS), store.path, "log", rows_in_file=1)
    Path(store.path[7:], "manifest", ".x.tmp").write_text("junk")
    other = again(store)
    assert list(other.iterator()) == [(b"k", b"old")]
    assert len(other.vacuum(older_than=0)) == 2 and list(other.iterator()) == [(b"k", b"old")]


def test_tombstones_hide_across_runs_and_go_at_the_bottom(spark, tmp_path):
    store = st.open_store(spark, f"file://{tmp_path}/s", Options(auto_flush=False, l0_trigger=4))
    for n, commands in enumerate(([("victim", "v1")], [("victim", "v2")], [("victim", None)], [("keeper", "keep")])):
        bulk(store, commands)
        if n == 3:
            with pytest.raises(NotFound):
                again(store).get(b"victim")
        store.flush()
    assert rows(store.entries(), "key", "op") == [(b"keeper", 1)]
    assert [r.level for r in store.snapshot().runs] == [1]
    store.verify()


def test_tombstones_stay_above_deeper_runs(spark, tmp_path):
    store = st.open_store(spark, f"file://{tmp_path}/s", Options(auto_flush=False, l0_trigger=1, level_base=1, level_mult=1))
    bulk(store, [("a", "old"), ("c", "old")])
    store.flush()
    store.compact()
    assert [r.level for r in store.snapshot().runs] == [2]
    bulk(store, [("a", None)])
    store.flush()  # to level 1, above the old value
    assert rows(store.entries(), "key", "op") == [(b"a", 0), (b"c", 1)]
    assert list(store.iterator()) == [(b"c", b"old")]


def test_newer_versions_win_whatever_the_order_of_runs(store):
    bulk(store, [("a", "1")])
    store.flush()
    bulk(store, [("a", "2")])
    store.flush()
    at = store.snapshot()
    store.manifest.commit(at, runs=at.runs[::-1])
    assert store.get(b"a") == b"2"


def test_past_snapshots_stay_readable(store):
    store.put(b"a", b"1")
    store.put(b"a", b"2")
    store.flush()
    assert store.get(b"a", version=1) == b"1" and store.get(b"a") == b"2"
    store.vacuum(keep_versions=1, older_than=0)
    with pytest.raises(Corrupt):
        store.get(b"a", version=1)


def test_a_reader_keeps_its_snapshot(store):
    store.put(b"a", b"1")
    reader = store.scan()
    store.put(b"a", b"2")
    store.flush()
    assert rows(reader) == [(b"a", b"1")]


def test_second_writer_is_refused_and_numbers_never_return(store):
    other = again(store)
    base = store.snapshot()
    other.put(b"a", b"1")
    with pytest.raises(Conflict):
        store.manifest.commit(base, next_seq=5)
    store.put(b"a", b"2")
    assert other.get(b"a") == b"2" and store.snapshot().next_seq == 3
    store.flush()
    first = store.snapshot().next_run_id
    assert again(store).snapshot().next_run_id == first == 2


@pytest.mark.parametrize("damage", ["missing", "size", "manifest", "format"])
def test_damage_is_found_on_opening(store, damage):
    store.put(b"a", b"1")
    store.flush()
    root = Path(store.path[7:])
    run, = (root / "runs").rglob("part-*.parquet")
    newest = sorted((root / "manifest").glob("*.json"))[-1]
    if damage == "missing":
        run.unlink()
    elif damage == "size":
        run.write_bytes(run.read_bytes() + b"x")
    elif damage == "manifest":
        newest.write_text("{")
    else:
        newest.write_text(json.dumps(json.loads(newest.read_text()) | {"format": 99}))
    for crc in root.rglob(".*.crc"):
        crc.unlink()
    with pytest.raises(Corrupt):
        again(store)


@pytest.mark.parametrize("field,value", [("record_count", 7), ("min_key", "eg=="), ("max_key", "eg==")])
def test_wrong_metadata_is_found_by_verify(store, field, value):
    store.put(b"a", b"1")
    store.flush()
    newest = sorted(Path(store.path[7:], "manifest").glob("*.json"))[-1]
    text = json.loads(newest.read_text())
    text["runs"][0][field] = value
    newest.write_text(json.dumps(text))
    for crc in newest.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Corrupt):
        again(store).verify()


def test_pruning_by_bounds(store):
    for low in (b"a", b"h", b"p"):
        bulk(store, [(low, "x"), (low + b"z", "y")])
        store.flush()
    runs = store.snapshot().runs
    kept = lambda s, e: sorted(r.min_key for r in st.run_files.prune(runs, s, e))
    assert kept(b"h", b"h\x00") == [b"h"] and kept(b"b", b"h") == [] and kept(None, b"h") == [b"a"] and kept(b"hz", None) == [b"h", b"p"] and len(kept(None, None)) == 3


def test_key_filters_reach_the_scan(store):
    bulk(store, [("a", "1"), ("b", "2")])
    store.flush()
    plan = store.scan(b"a", b"b")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan


def test_random_commands_match_a_dictionary(spark, tmp_path):
    rng = random.Random(20)
    options = Options(memtable=1500, l0_trigger=3, file_base=400, level_base=700, level_mult=2)
    store, model = st.open_store(spark, f"file://{tmp_path}/s", options), {}
    for step in range(9):
        commands = [(f"k{rng.randrange(40):03d}", None if rng.random() < 0.25 else f"v{step}-{i}" * rng.randrange(1, 4)) for i in range(30)]
        bulk(store, commands)
        for k, v in commands:
            model.pop(k, None) if v is None else model.__setitem__(k, v)
        if rng.random() < 0.5:
            store = again(store, options)
        assert list(store.iterator()) == [(k.encode(), v.encode()) for k, v in sorted(model.items())]
    assert {r.level for r in store.snapshot().runs} - {0}
    store.verify()
    store.vacuum(older_than=0)
    assert store.scan().count() == len(model)
    want = spark.createDataFrame([(b(f"k{i:03d}"),) for i in range(45)], "key binary")
    got = {r.key.decode(): r.value for r in store.multi_get(want).where(F.col("status") == "value").collect()}
    assert {k: v.decode() for k, v in got.items()} == model


def test_view_can_be_queried_with_sql(store):
    bulk(store, [("a", "1"), ("b", "22")])
    store.view("kv_live")
    assert store.spark.sql("SELECT sum(length(value)) AS n FROM kv_live").first().n == 3


def test_memory_store_is_gone_when_closed(spark):
    store = st.open_store(spark)
    store.put(b"a", b"1")
    path = Path(store.path.removeprefix("file://"))
    assert path.exists()
    store.close()
    assert not path.exists()


def test_a_compaction_inside_a_flush(spark, tmp_path, monkeypatch):
    """Run ids stay unique and nothing is lost when a compaction publishes between a flush's reading and its commit."""
    options = Options(auto_flush=False, auto_compact=False, l0_trigger=2)
    store, other = (st.open_store(spark, f"file://{tmp_path}/s", options) for _ in range(2))
    for i in range(2):
        bulk(store, [(f"k{i}", "old"), ("z", "1")])
        store.flush()
    bulk(store, [("new", "1")])
    write = store._write_run

    def slow(*args):
        made = write(*args)
        if args[3] == 0:
            other.compact()
        return made

    monkeypatch.setattr(store, "_write_run", slow)
    store.flush()
    ids = [r.id for r in store.snapshot().runs]
    assert len(set(ids)) == len(ids) == 2
    bulk(store, [("more", "1")])
    monkeypatch.undo()
    store.flush()
    store.compact()
    assert [k for k, _ in store.iterator()] == [b"k0", b"k1", b"more", b"new", b"z"]


def test_a_flush_inside_a_compaction(spark, tmp_path, monkeypatch):
    options = Options(auto_flush=False, auto_compact=False, l0_trigger=2)
    store, other = (st.open_store(spark, f"file://{tmp_path}/s", options) for _ in range(2))
    for i in range(2):
        bulk(store, [(f"k{i}", "old")])
        store.flush()
    write = store._write_run

    def slow(*args):
        made = write(*args)
        bulk(other, [("k0", "new")])
        other.flush()
        return made

    monkeypatch.setattr(store, "_write_run", slow)
    store.compact()
    assert dict(store.iterator()) == {b"k0": b"new", b"k1": b"old"} and len({r.id for r in store.snapshot().runs}) == 2


def test_repeated_run_ids_are_refused(store):
    bulk(store, [("a", "1")])
    store.flush()
    at = store.snapshot()
    with pytest.raises(Corrupt):
        store.manifest.commit(at, runs=(*at.runs, *at.runs))


def test_multi_get_of_few_and_many_keys(store):
    bulk(store, [(f"k{i:02d}", str(i)) for i in range(40)] + [("k05", None)])
    store.flush()
    bulk(store, [("k07", "x")])
    for wanted in ([], ["k05", "k07", "nope"], [f"k{i:02d}" for i in range(0, 60)]):
        got = {r.key.decode(): r.status for r in store.multi_get(store.spark.createDataFrame([(b(k),) for k in wanted] * 2, "key binary")).collect()}
        assert got == {k: "deleted" if k == "k05" else "value" if k < "k40" else "missing" for k in wanted}


def test_a_failed_flush_stops_writing_but_not_reading(spark, tmp_path, monkeypatch):
    store = st.open_store(spark, f"file://{tmp_path}/s", Options(memtable=10))
    monkeypatch.setattr(store, "_write_run", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.put(b"a", b"x" * 20)
    monkeypatch.undo()
    with pytest.raises(Failed):
        store.put(b"b", b"1")
    assert store.get(b"a") == b"x" * 20
    opened = again(store, Options(memtable=10))
    opened.put(b"b", b"1")
    assert [k for k, _ in opened.iterator()] == [b"a", b"b"] and opened.command_count() <= 1


def test_writing_waits_for_the_flush_of_what_others_left(spark, tmp_path):
    left, store = st.open_store(spark, f"file://{tmp_path}/s", QUIET), st.open_store(spark, f"file://{tmp_path}/s", Options(memtable=20))
    for i in range(3):
        left.put(b"k%d" % i, b"v" * 20)
    store.put(b"z", b"")
    assert store.command_count() == 1 and len(store.snapshot().runs) == 1 and len(list(store.iterator())) == 4
