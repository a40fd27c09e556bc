import base64
import json
import random

import pytest

from foldstone.model import Corrupt, Options
from foldstone.sources import binary, recovery
from foldstone.store import open_store
from tables import b

LOG = binary.LOG_SCHEMA


def log(spark, path, records):
    binary.write_log(spark.createDataFrame([(s, n, t, b(k), b(v)) for s, n, t, k, v in records], LOG), path)


@pytest.fixture
def store(spark, tmp_path):
    return open_store(spark, f"file://{tmp_path}/store", Options(auto_flush=False))


def replay(records):
    """What the log's commands leave: a batch counts once it ends, in whatever segment that is; a new begin drops the open one."""
    state, pending = {}, None
    for _, _, kind, key, value in sorted(records, key=lambda r: r[:2]):
        if kind == "B":
            pending = []
        elif kind == "E":
            state.update(pending or [])
            pending = None
        elif pending is None:
            state[key] = value if kind == "P" else None
        else:
            pending.append((key, value if kind == "P" else None))
    return {k: v for k, v in state.items() if v is not None}


def test_log_alone(spark, store, tmp_path):
    rng = random.Random(3)
    records = []
    for segment in (1, 2, 9, 10, 11):  # by number, not by name
        for _ in range(40):
            kind = rng.choice("PPPDBE")
            records.append((segment, len(records), kind, b"k%d" % rng.randrange(12) if kind in "PD" else None, b"%d" % len(records) if kind == "P" else None))
    log(spark, f"file://{tmp_path}/old", records)
    assert recovery.recover(store, f"file://{tmp_path}/old") == 0
    assert dict(store.iterator()) == replay(records)


def test_files_and_log(spark, store, tmp_path):
    path = f"file://{tmp_path}/old"
    runs = [(3, b"a", 1, b"l1"), (3, b"c", 1, b"l1"), (3, b"d", 1, b"l1"), (5, b"a", 1, b"l0 old"), (5, b"b", 1, b"l0 old"), (6, b"b", 1, b"l0"), (6, b"c", 0, None), (7, b"ghost", 1, b"unlisted")]
    binary.write_sorted(spark.createDataFrame([(i, b(k), op, b(v)) for i, k, op, v in runs], "id long, key binary, op byte, value binary"), path)
    log(spark, path, [(1, 1, "P", b"flushed", b"gone"), (2, 2, "P", b"d", b"log"), (2, 3, "B", None, None), (2, 4, "P", b"open", b"never")])
    key = lambda k: base64.b64encode(k).decode()
    listed = [{"id": i, "level": level, "path": f"/somewhere/{i:06d}.sst", "file_size": 1, "record_count": 1, "data_length": 1, "min_key": key(b"a"), "max_key": key(b"d")} for i, level in ((3, 1), (5, 0), (6, 0))]
    manifest = tmp_path / "old" / "MANIFEST"
    manifest.write_text(json.dumps({"next_sst_id": 8, "flushed_wal_segment": 1, "tables": listed}))
    assert recovery.read_manifest(spark, path).next_id == 8
    assert recovery.recover(store, path) == 1
    assert dict(store.iterator()) == {b"a": b"l0 old", b"b": b"l0", b"d": b"log"}
    (tmp_path / "old" / "000005.sst").unlink()
    with pytest.raises(Corrupt):
        recovery.recover(store, path)
    manifest.write_text("{")
    with pytest.raises(Corrupt):
        recovery.recover(store, path)


def test_an_empty_folder_gives_nothing(spark, store, tmp_path):
    assert recovery.recover(store, f"file://{tmp_path}/none") == 0 and store.snapshot().version == 0
