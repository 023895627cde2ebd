"""Scans over sorted partitions against plain Python, with groups that span many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators.scan import annotate_groups, previous_in_group


def brute(rows):
    out = {}
    for g, o, v in rows:
        mine = sorted(r for r in rows if r[0] == g)
        at = mine.index((g, o, v))
        before = [r[2] for r in mine[:at] if r[2] is not None]
        out[g, o] = (at, mine[at + 1][2] if at + 1 < len(mine) else None, before[-1] if before else None)
    return out


@pytest.mark.parametrize("seed, groups", [(1, 1), (2, 3), (3, 40), (4, 2)])
def test_annotate_groups(spark, seed, groups):
    pick = random.Random(seed)
    # group 0 holds more than a third of the rows
    rows = [(0 if pick.random() < 0.4 else pick.randrange(groups), i, pick.choice([None, pick.randrange(9)])) for i in range(200)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "g bigint, o bigint, v bigint").withColumn("payload", F.concat(F.lit("p"), "o")).repartition(6)
    out = annotate_groups(df, "g", ["o"], number="n", lead={"v": "next"}, carry={"v": "last"}).collect()
    assert len(out) == len(rows)
    want = brute([r for r in rows])
    assert {(r.g, r.o): (r.n, r.next, r.last) for r in out} == want
    assert all(r.payload == f"p{r.o}" for r in out)


def test_annotate_text_and_null_groups(spark):
    rows = [("a", 1, 5), (None, 1, 6), (None, 2, 7), ("a", 2, None), ("b", 1, 1)]
    out = annotate_groups(spark.createDataFrame(rows, "g string, o bigint, v bigint"), "g", ["o"], number="n", lead={"v": "next"}).collect()
    assert {(r.g, r.o): (r.n, r.next) for r in out} == {("a", 1): (0, None), ("a", 2): (1, None), (None, 1): (0, 7), (None, 2): (1, None), ("b", 1): (0, None)}


def test_empty(spark):
    df = spark.createDataFrame([], "g bigint, o bigint, v bigint")
    assert annotate_groups(df, "g", ["o"], number="n", lead={"v": "next"}).count() == 0
    assert previous_in_group(df, "g", ["o"], "v", "before").count() == 0


def test_previous_in_group(spark):
    rows = [(f"g{i % 3}" if i % 5 else None, i, i * 10) for i in range(60)]
    out = previous_in_group(spark.createDataFrame(rows, "g string, o bigint, v bigint").repartition(5), "g", ["o"], "v", "before").collect()
    for r in out:
        earlier = [v for g, o, v in rows if g == r.g and o < r.o]
        assert r.before == (earlier[-1] if earlier else None)
