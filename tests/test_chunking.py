import random

import pytest

from foldstone.operators import chunking
from tables import order, rows


def split(sizes, target):
    out, piece, filled = [], 0, 0
    for i, s in enumerate(sizes):
        if i and target and filled + s > target:
            piece, filled = piece + 1, 0
        filled += s
        out.append(piece)
    return out


def cut(sizes, target):
    out, piece, filled = [], 0, 0
    for i, s in enumerate(sizes):
        if i and target and filled >= target:
            piece, filled = piece + 1, 0
        filled += s
        out.append(piece)
    return out


@pytest.mark.parametrize("target", [0, 1, 50, 10_000])
def test_cuts_match_the_sequential_rules(spark, target):
    rng = random.Random(target)
    groups = {g: [rng.choice([1, 5, 20, 49, 50, 51, 200]) for _ in range(rng.randrange(1, 60))] for g in (1, 2, None)}
    df = spark.createDataFrame([(g, i, s, "x") for g, sizes in groups.items() for i, s in enumerate(sizes)], "run int, k int, size int, piece_ string")
    expected = lambda rule: order((g, i, p) for g, sizes in groups.items() for i, p in enumerate(rule(sizes, target)))
    assert rows(chunking.output_split(df, "run", ["k"], "size", target), "run", "k", "piece") == expected(split)
    assert rows(chunking.block_cut(df, "run", ["k"], "size", target), "run", "k", "piece") == expected(cut)


def test_nothing_to_cut(spark):
    df = spark.createDataFrame([], "run int, k int, size int")
    assert chunking.output_split(df, "run", ["k"], "size", 5).count() == 0
    assert chunking.run_stats(df, "run", "k").count() == 0
