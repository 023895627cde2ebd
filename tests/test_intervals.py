"""Periods and gaps against a day-by-day count."""

import datetime
import random
from collections import Counter

import pytest

from graphloom.operators.intervals import holding_rows, periods_and_gaps

DAY = datetime.date(2024, 1, 1)


def day(n):
    return None if n is None else DAY + datetime.timedelta(n)


def brute(rows, horizon=100):
    out = set()
    for e in {r[0] for r in rows if r[0] is not None}:
        cover = Counter()
        for _, a, b in (r for r in rows if r[0] == e and r[1] is not None and (r[2] is None or r[2] >= r[1])):
            for d in range(a, (horizon if b is None else b) + 1):
                cover[d] += 1
        days = sorted(cover)
        runs, start = [], 0
        for i in range(1, len(days) + 1):
            if i == len(days) or days[i] != days[i - 1] + 1:
                runs.append((days[start], days[i - 1]))
                start = i
        for i, (a, b) in enumerate(runs):
            out.add((e, "period", str(day(a)), "open" if b == horizon else str(day(b)), any(cover[d] > 1 for d in range(a, b + 1))))
            if i:
                out.add((e, "gap", str(day(runs[i - 1][1] + 1)), str(day(a - 1)), False))
    return out


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(e, day(a), day(b), "clash") for e, a, b in rows], "book bigint, a date, b date, entity string").repartition(parts)
    found = [tuple(r) for r in periods_and_gaps(df, "book", "a", "b").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("seed", range(4))
def test_random_intervals(spark, seed):
    pick = random.Random(seed)
    rows = []
    for _ in range(250):
        a = pick.choice([None, *range(60)]) if pick.random() < 0.1 else pick.randrange(60)
        b = None if pick.random() < 0.02 else (a or 0) + pick.randrange(-2, 5)
        rows.append((1 if pick.random() < 0.4 else pick.choice([None, *range(2, 40)]), a, b))
    rows += rows[:20]
    assert run(spark, rows) == brute(rows)


def test_one_hot_entity_over_all_partitions(spark):
    rows = [(7, i * 3 % 97, i * 3 % 97 + i % 4) for i in range(97)]
    assert run(spark, rows) == brute(rows, 300)


def test_touching_nested_open_and_empty(spark):
    assert run(spark, [(1, 0, 2), (1, 3, 5), (1, 9, 9)]) == {(1, "period", "2024-01-01", "2024-01-06", False), (1, "gap", "2024-01-07", "2024-01-09", False), (1, "period", "2024-01-10", "2024-01-10", False)}
    assert run(spark, [(1, 0, 9), (1, 2, 3)]) == {(1, "period", "2024-01-01", "2024-01-10", True)}
    assert run(spark, [(1, 0, None), (1, 50, 60)]) == {(1, "period", "2024-01-01", "open", True)}
    assert run(spark, []) == set() and run(spark, [(None, 1, 2), (1, None, 2), (1, 5, 2)]) == set()


def test_holding_rows(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, None, "x"), (None, 1, "n"), (2, None, "x")], "id bigint, at bigint, v string")
    assert sorted((r.id or 0, r.v) for r in holding_rows(df, "id", "at", ["v"]).collect()) == [(0, "n"), (1, "c"), (2, "x")]
