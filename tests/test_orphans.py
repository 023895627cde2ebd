import datetime

import pytest

from graphloom.operators import orphans

T0 = datetime.datetime(2024, 1, 1)


def at(n):
    return None if n is None else T0 + datetime.timedelta(n)


@pytest.fixture(scope="module")
def tables(spark):
    targets = spark.createDataFrame([(1, at(0)), (2, at(5)), (3, at(0)), (3, at(20)), (4, at(0)), (5, at(0)), (5, at(30)), (None, at(0))], "id bigint, loaded_at timestamp_ntz")
    gone = spark.createDataFrame([(3, at(10)), (4, at(10)), (9, at(1)), (5, at(10)), (5, at(40)), (None, at(1))], "row_id bigint, deleted_at timestamp_ntz")
    rows = spark.createDataFrame(
        [(10, 1, at(1)), (11, 2, at(1)), (12, 2, at(9)), (12, 2, at(6)), (13, 3, at(1)), (14, 4, at(1)), (15, 8, at(1)), (16, 9, at(1)), (17, None, at(1)), (15, 8, at(2)), (18, 5, at(1)), (11, 2, at(7)), (19, 2, at(5))],
        "id bigint, ref bigint, seen timestamp_ntz",
    )
    return rows, targets, gone


WANT = {(11, "late"), (14, "deleted"), (15, "missing"), (16, "deleted"), (18, "deleted")}


def found(tables, **more):
    rows, targets, gone = tables
    out = orphans.unresolved(rows, "id", "seen", {"ref": orphans.Reference(("ref",), targets, ("id",), gone)}).collect()
    assert len({(r.row_id, r.first_seen) for r in out}) == len(out)
    return {(r.row_id, r.kind) for r in out}


def test_kinds(tables):
    assert found(tables) == WANT


def test_salted_join_gives_the_same(tables, monkeypatch):
    monkeypatch.setattr(orphans, "BROADCAST_BYTES", 0)
    assert found(tables) == WANT


def test_empty_sides(spark, tables):
    rows, targets, gone = tables
    assert orphans.unresolved(rows.limit(0), "id", "seen", {"ref": orphans.Reference(("ref",), targets, ("id",), gone)}).count() == 0
    none = orphans.unresolved(rows, "id", "seen", {"ref": orphans.Reference(("ref",), targets.limit(0), ("id",))}).collect()
    assert {r.kind for r in none} == {"missing"} and len(none) == 9


@pytest.mark.parametrize("match, want", [("simple", {(1, 9)}), ("full", {(1, 9), (1, None), (None, 7), (None, 2)}), ("partial", {(1, 9), (None, 7)})])
def test_match_semantics_by_null_mask(spark, match, want):
    refs = spark.createDataFrame([(1, 2, at(0)), (1, 9, at(0)), (1, None, at(0)), (None, 2, at(0)), (None, 7, at(0)), (None, None, at(0))], "a bigint, b bigint, seen timestamp_ntz")
    targets = spark.createDataFrame([(1, 2, at(0))], "a bigint, b bigint, loaded_at timestamp_ntz")
    keys = orphans.referenced_keys(refs, ["a", "b"], "seen")
    assert {(r.a, r.b) for r in orphans.faulty_keys(keys, ["a", "b"], targets, match=match).collect()} == want


def test_unknown_semantics(spark):
    with pytest.raises(ValueError):
        orphans.faulty_keys(None, ["a"], None, match="odd")


@pytest.mark.parametrize("limit", [orphans.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("match, want", [("simple", {(2, 3, "missing"), (6, 3, "deleted")}), ("full", {(2, 3, "missing"), (3, 1, "partial"), (4, 2, "partial"), (5, 2, "partial"), (6, 3, "deleted")}), ("partial", {(2, 3, "missing"), (5, 2, "missing"), (6, 3, "deleted")})])
def test_two_columns_with_nulls(spark, monkeypatch, limit, match, want):
    monkeypatch.setattr(orphans, "BROADCAST_BYTES", limit)
    rows = [(1, 1, 2), (2, 1, 9), (3, 1, None), (4, None, 2), (5, None, 7), (6, 3, 3), (7, None, None), (2, 1, 9)]
    refs = spark.createDataFrame([(i, a, b, at(1), "clash") for i, a, b in rows], "id bigint, a bigint, b bigint, seen timestamp_ntz, mask string")
    targets = spark.createDataFrame([(1, 2, at(0)), (1, 2, at(3)), (3, 3, at(0)), (None, None, at(0))], "x bigint, y bigint, loaded_at timestamp_ntz")
    gone = spark.createDataFrame([(3, 3, at(1))], "p bigint, q bigint, deleted_at timestamp_ntz")
    found = orphans.unresolved(refs, "id", "seen", {"pair": orphans.Reference(("a", "b"), targets, ("x", "y"), gone, ("p", "q"), match)})
    assert {(r.row_id, r["mask"], r.kind) for r in found.collect()} == want and found.count() == len(want)
