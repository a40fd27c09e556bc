import random

import pytest
from pyspark.sql import functions as F

from foldstone.shared import work_dir
from foldstone.streaming import cdc
from tables import b, order, rows

WAL = "store_id int, segment int, lsn long, type string, key binary, value binary, chunk string, marker string"
OPS = "store_id int, key binary, seq long, op int, value binary, feed string"


def log(spark, records):
    return spark.createDataFrame([(s, g, n, t, b(k), b(v), "c", "m") for s, g, n, t, k, v in records], WAL)


def commands(spark, records):
    return spark.createDataFrame([(s, b(k), n, op, b(v), "clash") for s, k, n, op, v in records], OPS)


def in_force(records):
    out = []
    for s in {r[0] for r in records}:
        newest = {}
        for r in records:
            if r[0] == s and r[2] is not None and (r[2] not in newest or (r[1] or -1) >= (newest[r[2]][1] or -1)):
                newest[r[2]] = r
        line = [newest[n] for n in sorted(newest)]
        kinds = [(r[3] or "").strip()[:1].upper() for r in line]
        for i, r in enumerate(line):
            before = next((k for k in kinds[:i][::-1] if k in "BE" and k), None)
            after = next((k for k in kinds[i + 1 :] if k in "BE" and k), None)
            if kinds[i] in ("P", "D") and r[4] is not None and (before in (None, "E") or after == "E"):
                out.append((s, r[2], kinds[i], r[4]))
    return order(out)


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_log_rules_hold_across_chunks(spark, chunk):
    rng = random.Random(chunk)
    records = []
    for s in (1, 2):
        for n in range(60):
            kind = rng.choice(["P", " put", "D", "b", "E", "x", None, "\tBegin"])
            for g in rng.sample(range(1, 6), rng.choice([1, 1, 2])):
                records.append((s, rng.choice([g, g, None]) if rng.random() < 0.1 else g, n, kind if rng.random() < 0.8 else "P", rng.choice([b"a", b"b", None]), b"v%d" % g))
    records = list({(r[0], r[1], r[2]): r for r in records}.values())
    records += records[:10] + [(1, 1, None, "P", b"a", b"v")]
    rng.shuffle(records)
    assert rows(cdc.effective_log(log(spark, records), chunk), "store_id", "lsn", "letter", "key") == in_force(records)


@pytest.mark.parametrize("chunk", [2, 1000])
def test_rows_without_a_store_are_a_log_of_their_own(spark, chunk):
    line = [(1, "P"), (3, "B"), (4, "P"), (6, "D"), (8, "E"), (9, "P"), (12, "B"), (13, "P")]
    records = [(None, 1, n, t, b"a", b"v") for n, t in line] + [(0, 1, n, "P", b"a", b"z") for n in (2, 5, 14)]
    records += [(0, 1, 11, "B", None, None)]
    assert rows(cdc.effective_log(log(spark, records), chunk), "store_id", "lsn", "letter", "key") == in_force(records)
    assert {r[1] for r in in_force(records) if r[0] is None} == {1, 4, 6, 9}


def folded(records):
    newest = {}
    for s, k, n, op, v in records:
        if None not in (k, n, op):
            rank = (n, op == 1, v or b"")
            if (s, k) not in newest or rank >= newest[s, k][0]:
                newest[s, k] = rank, op == 1, v if op == 1 else None
    return order((s, k, r[0], live, v) for (s, k), (r, live, v) in newest.items())


def test_rebuilt_table_matches_a_fold(spark):
    rng = random.Random(9)
    records = [(rng.choice([1, 2]), b"hot" if rng.random() < 0.4 else rng.choice([b"a", b"", b"c", None]), rng.choice([*range(1000), None]), rng.choice([0, 1, 1, 2, None]), b"x") for _ in range(300)]
    records = list({(r[0], r[1], r[2]): r for r in records}.values())
    records += records[:60]
    rng.shuffle(records)
    got = cdc.rebuild(cdc.command_changes(commands(spark, records)), batch_bytes=2000)
    assert rows(got, "store_id", "key", "seq", "live", "value") == folded(records)


def test_late_changes_across_batches_and_restarts(spark):
    """Each step is a new run of the stream over the same folders, as after a failure."""
    base = work_dir(spark, "t")
    assert cdc.current_table(spark, f"{base}/table").count() == 0
    steps = [[(1, b"k", 5, 1, b"five")], [(1, b"k", 3, 1, b"three"), (1, b"n", 1, 1, b"one")], [(1, b"k", 6, 0, None)], [(1, b"k", 5, 1, b"five")], [(1, b"k", 7, 1, b"")]]
    seen = []
    for step in steps:
        cdc.command_changes(commands(spark, step)).write.mode("append").parquet(f"{base}/feed")
        for _ in range(2):
            stream = spark.readStream.schema(cdc.CHANGES).parquet(f"{base}/feed")
            cdc.apply_changes(stream, f"{base}/table", f"{base}/checkpoint")
        if len(seen) in (1, 3):  # merged batches and later ones are one table
            before = rows(cdc.current_table(spark, f"{base}/table"))
            assert cdc.merge_batches(spark, f"{base}/table") == cdc.merge_batches(spark, f"{base}/table")
            assert rows(cdc.current_table(spark, f"{base}/table")) == before
        seen.append(rows(cdc.current_table(spark, f"{base}/table").where(F.col("key") == F.lit(b"k")), "seq", "live", "value"))
    assert seen == [[(5, True, b"five")], [(5, True, b"five")], [(6, False, None)], [(6, False, None)], [(7, True, b"")]]


def test_empty_feed(spark):
    assert cdc.rebuild(cdc.log_changes(log(spark, []))).count() == 0


def test_session_settings_are_restored(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    cdc.rebuild(cdc.command_changes(commands(spark, [(1, b"k", 1, 1, b"v")])))
    assert spark.conf.get(key) == before


def table_of(records):
    """The live keys of the whole log at once."""
    newest = {}
    for s, n, kind, key in in_force(records):
        if n >= newest.get((s, key), (-1,))[0]:
            newest[s, key] = n, kind
    return order((s, k, n) for (s, k), (n, kind) in newest.items() if kind == "P")


def test_a_log_that_grows(spark):
    rng = random.Random(21)
    feed, records, got = cdc.Feed(spark, work_dir(spark, "feed")), [], []
    assert feed.advance(log(spark, [])).count() == 0  # an empty log is a step too
    for step in range(5):
        for s in (1, 2, None):
            if s == 2 and step == 2:
                continue  # nothing new
            for n in range(step * 12, step * 12 + 12):
                records.append((s, step + 1, n, rng.choice("PPPDBE"), rng.choice([b"a", b"b", b"c", b"d", None]), b"v"))
        if step in (1, 3):  # delivered again as it was, in a later segment
            records += [(r[0], step + 1, *r[2:]) for r in rng.sample([r for r in records if r[1] <= step], 6)]
        if step == 3:  # delivered again with other content: a begin becomes an end and the other way round, a put a delete
            old = [r for r in records if r[0] == 1 and r[1] == 1]
            records += [(1, 4, r[2], {"B": "E", "E": "B", "P": "D", "D": "P"}[r[3]], r[4], b"other") for r in old]
        before = feed.advance(log(spark, records), commands(spark, [(9, b"k", step, 1, b"c")]))
        now = before.where("live and feed = 'wal'")
        assert rows(now, "store_id", "key", "seq") == table_of(records), step
        got.append(rows(before.where("feed = 'mem'"), "seq"))
        if step == 2:
            cdc.merge_batches(spark, f"{feed.path}/table")
    assert got == [[(n,)] for n in range(5)]
    version = feed.folder.list()
    assert rows(feed.advance(log(spark, records)).where("live and feed = 'wal'"), "store_id", "key", "seq") == table_of(records)
    assert len([n for n in feed.folder.list() if n.startswith("marks-")]) == len([n for n in version if n.startswith("marks-")]) + 1


def test_only_the_open_end_of_a_log_is_resolved_again(spark, monkeypatch):
    feed, seen = cdc.Feed(spark, work_dir(spark, "feed")), []
    resolve = cdc.effective_log
    monkeypatch.setattr(cdc, "effective_log", lambda wal, *a, **k: seen.append(rows(wal, "lsn")) or resolve(wal, *a, **k))
    first = [(1, 1, 1, "P", b"a", b"1"), (1, 1, 2, "B", None, None), (1, 1, 3, "P", b"b", b"1"), (1, 1, 4, "E", None, None), (1, 1, 5, "B", None, None), (1, 1, 6, "P", b"a", b"2")]
    more = [(1, 2, 3, "P", b"b", b"1"), (1, 2, 7, "E", None, None), (1, 2, 8, "D", b"b", None)]
    assert rows(feed.advance(log(spark, first)).where("live"), "key", "seq") == [(b"a", 1), (b"b", 3)]
    assert rows(feed.advance(log(spark, first + more)).where("live"), "key", "seq") == [(b"a", 6)]
    assert seen[1] == [(5,), (6,), (7,), (8,)]
    assert rows(feed.advance(log(spark, [])).where("live"), "key", "seq") == [(b"a", 6)]


def test_changes_of_a_step_that_died_are_fed_by_the_next(spark, monkeypatch):
    feed = cdc.Feed(spark, work_dir(spark, "feed"))
    stream = cdc._stream

    def dies(*args):
        raise RuntimeError("dead")

    monkeypatch.setattr(cdc, "_stream", dies)
    with pytest.raises(RuntimeError):
        feed.advance(log(spark, [(1, 1, 1, "P", b"a", b"1")]))
    monkeypatch.setattr(cdc, "_stream", stream)
    assert rows(feed.advance(log(spark, [(1, 1, 1, "P", b"a", b"1"), (1, 2, 2, "P", b"b", b"1")])), "key", "seq") == [(b"a", 1), (b"b", 2)]
