"""Merges: policies, tombstones, and the same target however a log is split."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import merge

CHANGE = "_key string, op string, seq bigint, v string"


def target(spark, rows):
    return spark.createDataFrame(rows, "_key string, v string, kept int, _seq bigint, _deleted boolean")


def docs(df):
    return {r._key: r.v for r in merge.live(df).collect()}


def test_newest_change_wins_and_tombstones_stay(spark):
    old = target(spark, [("a", "old", 1, 5, False), ("b", "old", 2, None, False), ("c", "old", 3, 50, False)])
    new = spark.createDataFrame([("a", "REPLACE", 6, "x"), ("a", "REPLACE", 4, "stale"), ("b", "DELETE", 7, None), ("c", "REPLACE", 9, "late"), ("d", "INSERT", 8, "y"), (None, "INSERT", 9, "z"), ("e", "INSERT", None, "z"), ("f", "odd", 1, "z")], CHANGE)
    out = merge.apply_changes(old, new)
    assert docs(out) == {"a": "x", "c": "old", "d": "y"}
    assert {(r._key, r._seq) for r in out.where("_deleted").collect()} == {("b", 7)}
    assert {r._key: r.kept for r in out.collect()} == {"a": 1, "b": 2, "c": 3, "d": None}
    late = spark.createDataFrame([("b", "REPLACE", 6, "revived")], CHANGE)
    assert "b" not in docs(merge.apply_changes(out, late))


@pytest.mark.parametrize("policy", ["source_wins", "last_write_wins"])
def test_any_split_of_a_log_gives_the_same_target(spark, policy):
    pick = random.Random(11)
    log = [(f"k{pick.randrange(6)}", pick.choice(["INSERT", "REPLACE", "DELETE"]), i, f"v{i}") for i in range(80)]
    whole = merge.apply_changes(target(spark, []), spark.createDataFrame(log, CHANGE), policy)
    want = docs(whole)
    for size in (7, 40):
        shuffled = log[:] + log[10:30]
        pick.shuffle(shuffled)
        now = target(spark, [])
        for at in range(0, len(shuffled), size):
            step = merge.apply_changes(now, spark.createDataFrame(shuffled[at : at + size], CHANGE), policy)
            now = spark.createDataFrame(step.collect(), now.schema)
        assert docs(now) == want


def test_log_and_skip_follows_the_order(spark):
    old = target(spark, [("a", "old", 1, None, False)])
    new = spark.createDataFrame(
        [("a", "INSERT", 1, "dup"), ("b", "REPLACE", 1, "missing"), ("b", "INSERT", 2, "in"), ("b", "DELETE", 3, None), ("b", "REPLACE", 4, "missing"), ("b", "INSERT", 5, "again"), ("b", "INSERT", 6, "dup"), ("c", "REPLACE", 1, "x")], CHANGE
    )
    assert docs(merge.apply_changes(old, new, "log_and_skip")) == {"a": "old", "b": "again"}
    found = {(r._key, r.seq, r.conflict_type) for r in merge.conflicts(old, new, "log_and_skip").collect()}
    assert found == {("a", 1, "INSERT_DUPLICATE"), ("b", 1, "REPLACE_MISSING"), ("b", 4, "REPLACE_MISSING"), ("b", 6, "INSERT_DUPLICATE"), ("c", 1, "REPLACE_MISSING")}
    counts = {(r.conflict_type, r.resolution): r.conflicts for r in merge.conflict_counts(merge.conflicts(old, new)).collect()}
    assert counts == {("INSERT_DUPLICATE", "replaced"): 2, ("REPLACE_MISSING", "inserted"): 3}
    with pytest.raises(merge.ConflictError):
        merge.apply_changes(old, new, "fail")
    assert docs(merge.apply_changes(old, new.where("_key = 'none'"), "fail")) == {"a": "old"}


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        merge.apply_changes(None, None, "odd")


def test_load_modes(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], "_key string, v string, w int")
    rows = spark.createDataFrame([("a", None, "clash"), ("c", "3", "clash"), ("c", "3", "clash"), (None, "x", "")], "_key string, v string, other string")
    got = lambda mode: {r._key: (r.v, r.w) for r in merge.load(old, rows, mode).collect()}
    assert got("replace") == {"a": (None, None), "b": ("2", 2), "c": ("3", None)}
    assert got("update") == {"a": ("1", 1), "b": ("2", 2), "c": ("3", None)}
    assert got("ignore") == {"a": ("1", 1), "b": ("2", 2), "c": ("3", None)}
    with pytest.raises(merge.ConflictError):
        merge.load(old, rows, "error")
    assert merge.load(old, rows.where("_key = 'c'").limit(1), "error").count() == 3
    with pytest.raises(ValueError):
        merge.load(old, rows, "odd")


def test_empty_sides(spark):
    none = spark.createDataFrame([], CHANGE)
    old = target(spark, [("a", "old", 1, 5, False)])
    assert docs(merge.apply_changes(old, none)) == {"a": "old"}
    assert docs(merge.apply_changes(merge.empty_target(none), none, "log_and_skip")) == {}
    assert merge.conflicts(old, none).count() == 0
    assert merge.empty_target(none.withColumn("x", F.lit(1))).columns == ["_key", "v", "x", "_seq", "_deleted"]
