"""Processing only new records, by a ledger of work items.

A plan says, for each group (a store's log), from which position on records are new and through which position
they are planned; a position is a segment and an LSN. A work item is a shard of a plan, so its
content never changes once it is planned. It is pending, leased or done. A lease has a time of
expiry, after which the item counts as pending again, and a fencing token that grows with each
lease; whoever finishes with an older token is refused. Each lease writes below a path made from its
first item and token, so that a stale writer never touches what others wrote, and it is finishing that publishes
the path together with the number of rows; readers take published paths only.

The ledger is a folder of numbered JSON files, each created exclusively (compare and set on the
number). Every ``KEPT`` changes the whole state is written and older files go. An item has about
``ITEM_ROWS`` records, so the state has few entries even for very long logs; what a plan covers is a
Parquet table beside it.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shared import Folder, dump

#: Records of an item, about; items of one lease, which is one job; LSNs that stay in one item; changes from one whole state to the next.
ITEM_ROWS, LEASED, CHUNK, KEPT = 4_000_000, 64, 4096, 32
TAKEN = "store_id int, lsn long"


class StaleToken(RuntimeError):
    """The item was leased to someone else meanwhile, or is done."""


class Incomplete(RuntimeError):
    """Items are still leased to others."""


class LostOutput(RuntimeError):
    """What a done item has published isn't there."""


@dataclass(frozen=True)
class Lease:
    item: str
    token: int


class Ledger:
    """Work items below one shared folder. ``clock`` gives seconds and ``sleep`` waits; both can be replaced in tests."""

    def __init__(self, spark: SparkSession, path: str, clock=time.time, sleep=time.sleep):
        self.spark, self.path, self.clock, self.sleep = spark, path.rstrip("/"), clock, sleep
        self.folder = Folder(spark, self.path)

    def _read(self) -> tuple[int, dict[str, dict]]:
        """The next number and the state of all items."""
        while True:
            numbers = sorted(int(n[:-5]) for n in self.folder.list("log") if n.endswith(".json") and not n.startswith("."))
            if not numbers:
                return 0, {}
            items: dict[str, dict] = {}
            try:
                for n in range(numbers[-1] - numbers[-1] % KEPT, numbers[-1] + 1):
                    items |= json.loads(self.folder.read(f"log/{n:09d}.json"))
                return numbers[-1] + 1, items
            except Exception:
                if self.folder.exists(f"log/{numbers[-1]:09d}.json"):
                    raise
                # trimmed while it was read; a newer whole state is there

    def _commit(self, change) -> dict[str, dict]:
        """Apply ``change(items) -> changed items`` to the newest state; try again if another writer was faster."""
        while True:
            version, items = self._read()
            changed = change(items)
            whole = version % KEPT == 0
            if not changed:
                return changed
            if self.folder.create(f"log/{version:09d}.json", dump(items | changed if whole else changed)):
                if whole:
                    for n in self.folder.list("log"):
                        if n.endswith(".json") and not n.startswith(".") and int(n[:-5]) < version - KEPT:
                            self.folder.delete(f"log/{n}")
                return changed

    def state(self, item: dict) -> str:
        """pending, leased or done, as of now."""
        if item["state"] == "leased" and item["expires"] <= self.clock():
            return "pending"
        return item["state"]

    def items(self) -> dict[str, dict]:
        return {k: v | {"state": self.state(v)} for k, v in self._read()[1].items()}

    def add(self, items: dict[str, dict], plans: set[str] | None = None) -> list[str]:
        """Enter items that aren't there yet as pending; returns their names. With ``plans`` only if the ledger has these plans and no others."""

        def change(old):
            if plans is not None and plans != {v["plan"] for v in old.values()}:
                return {}
            return {k: v | {"state": "pending", "token": 0} for k, v in items.items() if k not in old}

        return list(self._commit(change))

    def lease(self, owner: str, seconds: float = 600, limit: int | None = None) -> list[Lease]:
        def change(items):
            free = [k for k, v in sorted(items.items()) if self.state(v) == "pending"][:limit]
            return {k: items[k] | {"state": "leased", "owner": owner, "token": items[k]["token"] + 1, "expires": self.clock() + seconds} for k in free}

        return [Lease(k, v["token"]) for k, v in self._commit(change).items()]

    def finish(self, leases: list[Lease], published: dict[str, dict] | None = None) -> None:
        """Mark leased items done and publish their ``path`` and ``rows``, all or none."""

        def change(items):
            for x in leases:
                if items[x.item]["token"] != x.token or items[x.item]["state"] == "done":
                    raise StaleToken(x.item)
            return {x.item: items[x.item] | {"state": "done"} | (published or {}).get(x.item, {"path": "", "rows": 0}) for x in leases}

        self._commit(change)

    def done_output(self, schema: str = TAKEN) -> DataFrame | None:
        """Rows of done items, with their ``item``; None while there are none. Raises ``LostOutput`` if published rows are gone."""
        done = {k: v for k, v in self._read()[1].items() if v["state"] == "done" and v["rows"]}
        if lost := [k for k, v in done.items() if not self.folder.exists(v["path"])]:
            raise LostOutput(f"items {lost[:3]}")
        if not done:
            return None
        rows = None
        for base in sorted({v["path"].rpartition("/")[0] for v in done.values()}):  # one for each lease
            own = [f"{self.path}/{v['path']}" for v in done.values() if v["path"].startswith(base + "/")]
            part = self.spark.read.schema(f"{schema}, item string").option("basePath", f"{self.path}/{base}").parquet(*own)
            rows = part if rows is None else rows.unionByName(part)
        return rows


def last_saved_marks(manifest: DataFrame) -> DataFrame:
    """``(store_id, mark)`` of each store's newest committed save that has a segment."""
    newest = F.max(F.struct("manifest_version", "flushed_wal_segment"))
    return manifest.where("outcome = 'committed' and flushed_wal_segment is not null").groupBy("store_id").agg(newest["flushed_wal_segment"].alias("mark"))


def type_letter(col: Column) -> Column:
    """The letter that decides a log record's type: P, D, B or E."""
    return F.upper(F.substring(F.regexp_replace(col, r"^\s+", ""), 1, 1))


def _after(at: Column, position: Column) -> Column:
    """Whether a record at a (segment, lsn) lies beyond a position; NULL for a record without either."""
    return (at["segment"] > position["segment"]) | ((at["segment"] == position["segment"]) & (at["lsn"] > position["lsn"]))


def plan_flush(ledger: Ledger, wal: DataFrame, manifest: DataFrame, item_rows: int = ITEM_ROWS) -> list[str]:
    """Enter what the log has beyond each store's mark; returns the new items.

    The mark is the end of the last successfully saved segment or, if that is further, the position (segment and
    LSN) through which the ledger has planned already, so a second run over the same log plans nothing, and records that
    were appended to the last planned segment are new. Within a segment LSNs are expected to ascend. NULL store ids are a
    store of their own.
    """
    spark = ledger.spark
    while True:
        plans = {v["plan"] for v in ledger.items().values()}
        position = lambda a, b: F.struct(F.col(a).cast("int").alias("segment"), b.cast("long").alias("lsn"))
        marks = last_saved_marks(manifest).select("store_id", position("mark", F.lit(2**63 - 1)).alias("mark"))
        if plans:
            planned = spark.read.parquet(*(f"{ledger.path}/plans/{p}" for p in sorted(plans)))
            marks = marks.unionByName(planned.select("store_id", F.col("through").alias("mark"))).groupBy("store_id").agg(F.max("mark").alias("mark"))
        w, m = wal.where("segment is not null and lsn is not null").select("store_id", position("segment", F.col("lsn")).alias("at")).alias("w"), marks.alias("m")
        start = F.coalesce(F.col("m.mark"), F.struct(F.lit(0).alias("segment"), F.lit(2**63 - 1).alias("lsn")))
        beyond = w.join(m, F.col("w.store_id").eqNullSafe(F.col("m.store_id")), "left").select("w.store_id", start.alias("mark"), "at").where(_after(F.col("at"), F.col("mark")))
        plan = uuid.uuid4().hex[:12]
        # written before its items are entered; a plan that no item names is ignored
        beyond.groupBy("store_id", "mark").agg(F.max("at").alias("through"), F.count("*").alias("records")).write.parquet(f"{ledger.path}/plans/{plan}")
        rows = spark.read.parquet(f"{ledger.path}/plans/{plan}").agg(F.sum("records")).first()[0]
        if not rows:
            return []
        shards = -(-rows // item_rows)
        added = ledger.add({f"{plan}-{i:06d}": {"plan": plan, "shard": i, "shards": shards} for i in range(shards)}, plans)
        if added:
            return added  # else someone else has planned meanwhile; what is left is planned anew


def fresh_records(wal: DataFrame, plan: DataFrame, name: str, shards: int, wanted: list[int] | None = None) -> DataFrame:
    """``(item, store_id, lsn)``: distinct records delivered beyond a store's mark with a content new to it.

    The content is type letter, key and value, NULL equal to NULL; it is new unless the same LSN
    came with it up to the mark. Records without LSN or segment don't count, nor
    those beyond the plan's end. Rows are spread by store and LSN, so a large store isn't one item or task.
    """
    at = F.struct(F.col("segment").cast("int").alias("segment"), F.col("lsn").alias("lsn"))
    w, p = wal.where("lsn is not null and segment is not null").select("store_id", "lsn", "type", "key", "value", at.alias("at")).alias("w"), plan.alias("p")
    shard = F.pmod(F.xxhash64("w.store_id", F.floor(F.col("w.lsn") / CHUNK)), F.lit(shards)).cast("int")
    near = w.join(p, F.col("w.store_id").eqNullSafe(F.col("p.store_id"))).where(~_after(F.col("at"), F.col("through")))
    content = near.select(shard.alias("shard"), "w.store_id", "w.lsn", type_letter(F.col("w.type")).alias("letter"), "w.key", "w.value", _after(F.col("at"), F.col("mark")).alias("new"))
    if wanted is not None and len(wanted) < shards:
        content = content.where(F.col("shard").isin(wanted))
    fresh = content.groupBy("shard", "store_id", "lsn", "letter", "key", "value").agg(F.bool_and("new").alias("new")).where("new")
    return fresh.select("shard", "store_id", "lsn").distinct().select(F.concat(F.lit(f"{name}-"), F.lpad(F.col("shard").cast("string"), 6, "0")).alias("item"), "store_id", "lsn")


def write_items(ledger: Ledger, wal: DataFrame, leases: list[Lease]) -> dict[str, dict]:
    """Write the records of leased items, one job for each plan; returns what finishing publishes."""
    entries, tokens, published = ledger.items(), {x.item: x.token for x in leases}, {}
    for plan in sorted({entries[x.item]["plan"] for x in leases}):
        own = sorted(x.item for x in leases if entries[x.item]["plan"] == plan)
        base = f"out/{own[0]}.{tokens[own[0]]}"
        table = ledger.spark.read.parquet(f"{ledger.path}/plans/{plan}")
        rows = fresh_records(wal, table, plan, entries[own[0]]["shards"], [entries[k]["shard"] for k in own])
        rows.write.mode("overwrite").partitionBy("item").parquet(f"{ledger.path}/{base}")
        there = ledger.folder.list(base)
        counts = {}
        if any(n.startswith("item=") for n in there):
            counts = {r.item: r["count"] for r in ledger.spark.read.schema(f"{TAKEN}, item string").parquet(f"{ledger.path}/{base}").groupBy("item").count().collect()}
        published |= {k: {"path": f"{base}/item={k}", "rows": counts.get(k, 0)} for k in own}
    return published


def run_items(ledger: Ledger, wal: DataFrame, owner: str, seconds: float = 3600, limit: int | None = LEASED) -> int:
    """Lease pending items, write their records and mark them done; returns how many items.

    A run that died half-way is simply repeated: its leases expire, and nothing of what it wrote was published.
    """
    leases = ledger.lease(owner, seconds, limit)
    if leases:
        ledger.finish(leases, write_items(ledger, wal, leases))
    return len(leases)


def take_up(wal: DataFrame, manifest: DataFrame, path: str | Ledger, owner: str = "flush", patience: float = 3600) -> DataFrame:
    """``(store_id, lsn)`` that the next flush takes up, by a run of the ledger at ``path``. Empty tables give no rows.

    Items that are leased to others are waited for, as they are finished or expire; after ``patience`` seconds
    ``Incomplete`` is raised, so a result is never a part.
    """
    ledger = path if isinstance(path, Ledger) else Ledger(wal.sparkSession, path)
    plan_flush(ledger, wal, manifest)
    until = ledger.clock() + patience
    while True:
        while run_items(ledger, wal, owner):
            pass
        open_items = [k for k, v in ledger.items().items() if v["state"] != "done"]
        if not open_items:
            break
        if ledger.clock() >= until:
            raise Incomplete(f"{len(open_items)} items, {open_items[0]} among them")
        ledger.sleep(1)
    out = ledger.done_output()
    return out.select("store_id", "lsn") if out is not None else wal.sparkSession.createDataFrame([], TAKEN)
