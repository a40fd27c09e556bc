"""Comparing results with SQL and with each other."""

import math


def plain(v):
    if isinstance(v, (bytearray, memoryview)):
        return bytes(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(df, *columns):
    """Sorted rows as tuples, in the order of the named columns (or of all, by name)."""
    columns = columns or sorted(df.columns)
    return order(tuple(plain(v) for v in r) for r in df.select(*columns).collect())


def order(found):
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: tuple((v is not None, str(v)) for v in r))


def b(text):
    return None if text is None else bytearray(text.encode() if isinstance(text, str) else text)
