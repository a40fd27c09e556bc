"""Schemas, options and errors of the versioned key-value store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Codes of an operation. A delete is kept as a tombstone: it hides older puts.
PUT, DELETE = 1, 0

#: One write command. ``value`` is NULL exactly for deletes; an empty value is a value.
OPS = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("op", T.ByteType(), False), T.StructField("value", T.BinaryType())])


class StoreError(Exception):
    """Base of the store's errors."""


class NotFound(StoreError, KeyError):
    """The key is missing or deleted."""


class Closed(StoreError):
    """The store is closed."""


class InvalidBatch(StoreError):
    """The batch is None or belongs to another store."""


class InvalidWrite(StoreError, ValueError):
    """The rows to be written break a rule of the store."""


class Failed(StoreError):
    """A flush or compaction after an earlier write failed; this handle takes no more writes."""


class Corrupt(StoreError):
    """A manifest or a run isn't what was published."""


class Conflict(StoreError):
    """Another writer published first."""


@dataclass(frozen=True)
class Options:
    """Sizes in bytes. The defaults are fixed values of the store that this one takes the place of."""

    max_levels: int = 7
    l0_trigger: int = 4
    level_base: int = 512 << 20
    level_mult: int = 10
    file_base: int = 64 << 20
    file_mult: int = 2
    memtable: int = 64 << 20
    block: int = 64 << 10
    max_record: int = 16 << 20
    auto_flush: bool = True
    auto_compact: bool = True

    def file_target(self, level: int) -> int:
        """Size at which a run of ``level`` is cut; it doubles with each level beyond the first."""
        return self.file_base * self.file_mult ** max(0, level - 1)
