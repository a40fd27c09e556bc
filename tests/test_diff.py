import random

from foldstone.operators import diff
from tables import b, order, rows

SCHEMA = "id long, at int, a long, k binary, bucket int, mask int, here string"
FIELDS = ["a", "k", "mask"]


def brute(main, copy):
    def current(t):
        out = {}
        for r in sorted(t, key=lambda r: (r[1] is not None, r[1] or 0)):
            if r[0] is not None:
                out[r[0]] = r
        return out

    x, y = current(main), current(copy)
    out = [(i, "missing_in_copy") for i in x.keys() - y.keys()] + [(i, "missing_in_main") for i in y.keys() - x.keys()]
    for i in x.keys() & y.keys():
        out += [(i, f) for f, c in (("a", 2), ("k", 3), ("mask", 5)) if x[i][c] != y[i][c]]
    return order(out)


def compare(spark, main, copy, **kw):
    make = lambda t: spark.createDataFrame([(r[0], r[1], r[2], b(r[3]), *r[4:]) for r in t], SCHEMA)
    return diff.differences(make(main), make(copy), key="id", order="at", fields=FIELDS, **kw)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    for size in (1, 4, 1000):
        main = [(i, 5, rng.choice([1, 2, None]), rng.choice([b"", b"x", None]), 0, rng.choice([0, None]), "s") for i in range(120)]
        copy = [(r[0], 9, r[2] if rng.random() < 0.95 else 7, r[3] if rng.random() < 0.95 else b"", 1, r[5] if rng.random() < 0.9 else 1, "t") for r in main if rng.random() < 0.95]
        copy += [(500 + i, 1, 1, b"x", 0, 0, None) for i in range(3)]
        old = [(r[0], 1, 99, b"old", 0, 0, None) for r in main[:30]] + main[:20] + [(None, 1, 1, b"x", 0, 0, None)] + [(3, None, 98, None, 0, 0, None)]
        assert rows(compare(spark, main + old, copy, bucket_rows=size), "id", "field_name") == brute(main + old, copy)


def test_values_are_given_as_text(spark):
    got = compare(spark, [(1, 1, None, b"\x00\xff", 0, 1, None)], [(1, 1, 5, b"", 0, 1, None)])
    assert rows(got, "field_name", "main_value", "copy_value") == [("a", None, "5"), ("k", "00FF", "")]


def test_equal_and_empty_tables(spark):
    same = [(i, 1, i, b"x", 0, 0, None) for i in range(50)] * 2
    assert compare(spark, same, same[::-1]).count() == 0
    assert compare(spark, [], []).count() == 0
    assert rows(compare(spark, same[:1], []), "id", "field_name") == [(0, "missing_in_copy")]
    assert rows(compare(spark, [], same[:1]), "id", "field_name") == [(0, "missing_in_main")]


def test_only_unequal_buckets_are_marked(spark):
    main = spark.range(1000).selectExpr("id as k", "id as f0", "id * 2 as f1")
    copy = main.selectExpr("k", "f0", "if(k = 17, 0, f1) as f1")
    cells = diff.unequal_cells(main, copy, ["f0", "f1"], 50).collect()
    assert len(cells) == 1 and cells[0].mask == 4


def test_few_differences_leave_most_buckets_equal(spark):
    main = [(i, 1, i, b"x", 0, 0, None) for i in range(1600)]
    copy = [(*r[:2], -1, *r[3:]) if r[0] % 100 == 0 else r for r in main]
    make = lambda t: spark.createDataFrame([(r[0], r[1], r[2], b(r[3]), *r[4:]) for r in t], SCHEMA)
    got = {r.field_name: (r.buckets, r.unequal) for r in diff.pruned(make(main), make(copy), key="id", order="at", fields=FIELDS).collect()}
    assert got["_keys"] == got["k"] == got["mask"] == (200, 0) and 10 <= got["a"][1] <= 16
    assert rows(compare(spark, main, copy), "id", "field_name") == order((i, "a") for i in range(0, 1600, 100))
