"""Overlapping and gapped time intervals (problem 4).

Intervals are first combined per entity and start, which bounds an entity's rows by the calendar.
They are then sorted globally by entity and start; each partition's largest end is summarised, the
summaries are prefix-combined, and a rescan with the carried end labels islands and finds gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.scan import prefix_scan, range_sort

#: The end of an interval that does not end, in days since 1970-01-01; later than any date.
OPEN_END = 1 << 40


def holding_rows(versions: DataFrame, key: str, latest: str, columns: list[str]) -> DataFrame:
    """The row of each key with the latest `latest`, as key and columns.

    Ties are broken by the largest column values in order, so the result does not depend on the
    order of arrival. A NULL `latest` is earlier than any; NULL keys form one key.
    """
    ranked = F.struct(latest, *columns)
    return versions.groupBy(key).agg(F.max(ranked).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def _step(island: tuple | None, batch: pd.DataFrame) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], tuple]:
    """Advance over sorted rows: islands that close, gaps before islands that start, and the island
    left open. An island is (entity, first, last, shared)."""
    entity, first, last, many = (batch[c].to_numpy(dtype=np.int64) for c in ("entity", "first", "last", "many"))
    n = len(entity)
    new = np.ones(n, dtype=bool)
    new[1:] = entity[1:] != entity[:-1]
    group = np.cumsum(new)
    lift = np.int64(1) << np.int64(42)  # above any end, so that a running maximum restarts per entity
    carried = island is not None and int(entity[0]) == island[0]
    top = group * lift + last
    if carried:
        top[0] = max(top[0], lift + island[2])
        new[0] = False
    top = np.maximum.accumulate(top)
    before = np.empty(n, dtype=np.int64)
    before[1:] = top[:-1] - group[:-1] * lift
    before[0] = island[2] if carried else 0
    starts = new | (first > before + 1)
    shared = (many > 1) | (~new & (first <= before))
    at = np.flatnonzero(starts)
    head = np.array([0]) if not len(at) or at[0] > 0 else np.array([], dtype=np.int64)
    bounds = np.concatenate([head, at]).astype(np.int64)
    parts = [entity[bounds], first[bounds], np.maximum.reduceat(last, bounds), np.logical_or.reduceat(shared, bounds)]
    if island is not None:
        if len(head):  # the rows before the first start belong to the island left open
            parts[1][0] = island[1]
            parts[2][0] = max(int(parts[2][0]), island[2])
            parts[3][0] = bool(parts[3][0]) or island[3]
        else:
            parts = [np.concatenate([[x], p]) for x, p in zip(island, parts)]
    gap = np.flatnonzero(starts & ~new)
    closed = dict(zip(("entity", "first", "last", "shared"), (p[:-1] for p in parts)))
    gaps = {"entity": entity[gap], "first": before[gap] + 1, "last": first[gap] - 1}
    return closed, gaps, (int(parts[0][-1]), int(parts[1][-1]), int(parts[2][-1]), bool(parts[3][-1]))


def _summarise(batches: Iterator[pd.DataFrame]) -> tuple:
    """(open island, first day and any sharing of its entity's rows here): what the partition
    adds to the state, whatever state it meets."""
    island, first, any_shared = None, None, False
    for batch in batches:
        was = island
        closed, _, island = _step(island, batch)
        if was is None or was[0] != island[0]:
            first, any_shared = None, False
        if first is None:
            first = int(batch["first"].to_numpy()[np.argmax(batch["entity"].to_numpy() == island[0])])
        any_shared = any_shared or island[3] or bool(closed["shared"][closed["entity"] == island[0]].any())
    return island, first, any_shared


def _combine(state: tuple | None, summary: tuple) -> tuple:
    (entity, start, end, shared), first, any_shared = summary
    if state is None or state[0] != entity:
        return entity, start, end, shared
    if start <= state[2] + 1:  # then the carried island reaches every island of the partition
        return entity, state[1], max(state[2], end), state[3] or any_shared or first <= state[2]
    return entity, start, end, shared


def _emit(state: tuple | None, batches: Iterator[pd.DataFrame], is_last: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        closed, gaps, state = _step(state, batch)
        yield pd.DataFrame(closed).assign(kind="period")
        yield pd.DataFrame(gaps).assign(shared=False, kind="gap")
    if is_last:
        yield pd.DataFrame([state], columns=["entity", "first", "last", "shared"]).assign(kind="period")


def periods_and_gaps(intervals: DataFrame, entity: str, first: str, last: str) -> DataFrame:
    """(entity, kind, from_day, to_day, shared): a `period` for each longest run of covered days
    of an entity, and a `gap` for each run of free days between two of them.

    `intervals` has an integer entity and dates, both ends included; a NULL last is open. Rows
    with a NULL entity or first, or that end before they start, do not count. Touching intervals
    join. Days are YYYY-MM-DD, 'open' for a period that does not end; shared tells whether two
    rows of the period have a day in common, repeated rows included. Other columns are ignored;
    an empty table gives an empty result.
    """
    days = intervals.where(
        F.col(entity).isNotNull() & F.col(first).isNotNull() & (F.col(last).isNull() | (F.col(last) >= F.col(first)))
    ).select(
        F.col(entity).cast("bigint").alias("entity"),
        F.unix_date(first).cast("bigint").alias("first"),
        F.coalesce(F.unix_date(last).cast("bigint"), F.lit(OPEN_END)).alias("last"),
    )
    starts = days.groupBy("entity", "first").agg(F.max("last").alias("last"), F.count(F.lit(1)).alias("many"))
    found = prefix_scan(
        range_sort(starts, ["entity", "first"]),
        _summarise,
        _combine,
        _emit,
        "entity bigint, kind string, first bigint, last bigint, shared boolean",
    )
    day = "CASE WHEN {0} >= %d THEN 'open' ELSE date_format(date_from_unix_date(CAST({0} AS INT)), 'yyyy-MM-dd') END" % OPEN_END
    return found.select(
        "entity", "kind", F.expr(day.format("first")).alias("from_day"), F.expr(day.format("last")).alias("to_day"), "shared"
    )
