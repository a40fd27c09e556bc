"""The manifest: numbered snapshots of what is published, and the only thing that readers trust.

A snapshot lists the runs and the log commits that aren't in a run yet, the next version
number, the next run id and the last flushed segment. A snapshot is created exclusively under
the next number, so of two writers that started from one snapshot the second gets ``Conflict``. Old snapshots stay
for reading the past until ``vacuum`` drops them.
"""

from __future__ import annotations

import base64
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import SparkSession

from ..model import Conflict, Corrupt
from ..plans.compaction import RunMeta
from ..shared import Folder, dump

FORMAT = 1


@dataclass(frozen=True)
class LogCommit:
    """Rows of one atomic write that aren't in a run yet. ``data_length`` is what they take up in a run."""

    segment: int
    path: str
    record_count: int
    data_length: int
    min_seq: int
    max_seq: int
    files: dict[str, int] = field(default_factory=dict, hash=False, compare=False)


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    next_seq: int = 1
    next_run_id: int = 1
    next_segment: int = 1
    flushed_segment: int = 0
    #: of each stream that is fed into the store, its last published batch
    streams: dict[str, int] = field(default_factory=dict, hash=False)
    log: tuple[LogCommit, ...] = ()
    runs: tuple[RunMeta, ...] = ()

    def to_json(self) -> str:
        text = lambda k: None if k is None else base64.b64encode(k).decode()
        runs = [asdict(r) | {"min_key": text(r.min_key), "max_key": text(r.max_key)} for r in self.runs]
        return dump({"format": FORMAT, **{k: v for k, v in asdict(self).items() if k not in ("log", "runs")}, "log": [asdict(c) for c in self.log], "runs": runs})

    @staticmethod
    def from_json(text: str) -> Snapshot:
        try:
            d = json.loads(text)
            if d.pop("format") != FORMAT:
                raise Corrupt("manifest of an unknown format")
            key = lambda k: None if k is None else base64.b64decode(k)
            runs = tuple(RunMeta(**r | {"min_key": key(r["min_key"]), "max_key": key(r["max_key"])}) for r in d.pop("runs"))
            return Snapshot(**d | {"log": tuple(LogCommit(**c) for c in d["log"]), "runs": runs})
        except (ValueError, KeyError, TypeError) as e:
            raise Corrupt(f"unreadable manifest: {e}") from e


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def versions(self) -> list[int]:
        names = self.folder.list("manifest")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def load(self, version: int | None = None) -> Snapshot:
        """A snapshot, by default the newest; version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Snapshot()
        name = f"manifest/{version:012d}.json"
        if not self.folder.exists(name):
            raise Corrupt(f"no manifest of version {version}")
        return Snapshot.from_json(self.folder.read(name))

    def commit(self, base: Snapshot, **changes) -> Snapshot:
        """Publish what follows ``base``."""
        new = replace(base, version=base.version + 1, **changes)
        if len({r.id for r in new.runs}) < len(new.runs) or len({r.path for r in new.runs}) < len(new.runs):
            raise Corrupt("a run would be listed twice")
        if not self.folder.create(f"manifest/{new.version:012d}.json", new.to_json()):
            raise Conflict(f"version {new.version} was published by another writer")
        return new

    def forget(self, before: int) -> None:
        for v in self.versions():
            if v < before:
                self.folder.delete(f"manifest/{v:012d}.json")
