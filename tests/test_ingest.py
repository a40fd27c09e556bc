from foldstone.model import Options
from foldstone.store import open_store
from foldstone.streaming.ingest import ingest
from tables import b


def test_batches_become_commits_once(spark, tmp_path):
    schema = "key binary, value binary, op int, n int"
    store = open_store(spark, f"file://{tmp_path}/s", Options(auto_flush=False))
    feed = f"file://{tmp_path}/feed"
    for part in ([("a", "1", 1, 1), ("a", "2", 1, 2), ("b", "1", 1, 3)], [("a", None, 0, 4), ("c", "3", 1, 5)], []):
        spark.createDataFrame([(b(k), b(v), op, n) for k, v, op, n in part], schema).coalesce(1).write.mode("append").parquet(feed)
        ingest(spark.readStream.schema(schema).parquet(feed), store, f"file://{tmp_path}/c", order="n")
    assert list(store.iterator()) == [(b"b", b"1"), (b"c", b"3")]
    assert store.snapshot().version == 2
    name, = store.snapshot().streams
    for batch in (0, 1):  # repeated after a failure
        store.write_rows(spark.createDataFrame([(b("z"), b("9"), 1, 9)], schema), order="n", stream=(name, batch))
    assert store.snapshot().version == 2


def test_two_streams_into_one_store(spark, tmp_path):
    schema = "key binary, value binary"
    store = open_store(spark, f"file://{tmp_path}/s", Options(auto_flush=False))
    for name in "ab":
        spark.createDataFrame([(b(name), b("1"))], schema).write.parquet(f"file://{tmp_path}/{name}")
        ingest(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/{name}"), store, f"file://{tmp_path}/c{name}")
    assert list(store.iterator()) == [(b"a", b"1"), (b"b", b"1")] and len(store.snapshot().streams) == 2
