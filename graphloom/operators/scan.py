"""Prefix scan over a globally range-sorted table.

Rows are range-partitioned and sorted by entity and order, so an entity may span any number of
partitions and no partition depends on the size of one entity. One pass reduces each partition to
a summary; the summaries (one per partition, so bounded by the number of partitions) are combined
in order; a second pass rescans each partition with the state that the rows before it leave.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.runtime import cut, parallelism

SCAN_PARTITION = "__scan_partition"


def range_sort(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """df range-partitioned and sorted by keys, with its partition number kept as a column.

    The result is checkpointed: both passes then see the same boundaries, also after the loss of
    an executor, which a repeated sampling of the boundaries would not guarantee.
    """
    n = partitions or parallelism(df.sparkSession)
    ordered = df.repartitionByRange(n, *[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return cut(ordered.withColumn(SCAN_PARTITION, F.spark_partition_id()))


def prefix_scan(
    ordered: DataFrame,
    summarise: Callable[[Iterator[pd.DataFrame]], Any],
    combine: Callable[[Any, Any], Any],
    rescan: Callable[[Any, Iterator[pd.DataFrame], bool], Iterator[pd.DataFrame]],
    schema: str,
    start: Any = None,
) -> DataFrame:
    """Run both passes over the result of range_sort.

    summarise(batches) -> summary of one partition; combine(state, summary) -> state after it;
    rescan(state, batches, is_last) -> result batches of `schema`, is_last for the last partition
    that has rows. Empty partitions have no summary.
    """

    def first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number: list[int] = []

        def noting() -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    if not number:
                        number.append(int(batch[SCAN_PARTITION].iloc[0]))
                    yield batch

        summary = summarise(noting())
        if number:
            yield pd.DataFrame({"part": number, "summary": [pickle.dumps(summary)]})

    found = ordered.mapInPandas(first_pass, "part int, summary binary").collect()  # one row per partition
    states, state = {}, start
    for row in sorted(found, key=lambda r: r["part"]):
        states[row["part"]] = state
        state = combine(state, pickle.loads(row["summary"]))
    end = max(states, default=None)

    def second_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = (b for b in batches if len(b))
        first = next(full, None)
        if first is None:
            return

        def again() -> Iterator[pd.DataFrame]:
            yield first
            yield from full

        number = int(first[SCAN_PARTITION].iloc[0])
        yield from rescan(states[number], again(), number == end)

    return ordered.mapInPandas(second_pass, schema)


def previous_in_group(df: DataFrame, group: str, order: list[str], carry: str, as_name: str) -> DataFrame:
    """df with the `carry` value (bigint) of the row before it in its group as `as_name`, by a
    prefix scan, so that one group may hold any share of the rows.

    The first row of a group gets NULL; rows with a NULL group form one group.
    """
    columns = [c for c in df.columns]
    ordered = range_sort(df, [group, *order])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{as_name}` bigint"

    def last(batches: Iterator[pd.DataFrame]) -> tuple | None:
        row = None
        for b in batches:
            row = (None if pd.isna(b[group].iloc[-1]) else b[group].iloc[-1], int(b[carry].iloc[-1]))
        return row

    def lag(state: tuple | None, batches: Iterator[pd.DataFrame], is_last: bool) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [None if pd.isna(k) else k for k in b[group]]
            values = [int(v) for v in b[carry]]
            before_k = [state[0] if state else object(), *keys[:-1]]
            before_v = [state[1] if state else None, *values[:-1]]
            out = b[columns].copy()
            out[as_name] = pd.array([v if k == p else None for k, p, v in zip(keys, before_k, before_v)], dtype="Int64")
            state = (keys[-1], values[-1])
            yield out

    return prefix_scan(ordered, last, lambda state, summary: summary, lag, schema)


def annotate_groups(df: DataFrame, group: str, order: list[str], number: str | None = None, lead: dict[str, str] | None = None, carry: dict[str, str] | None = None, counted: str | None = None) -> DataFrame:
    """df with columns that depend on the rows before and after in a group, without a window per
    group: one group may hold any share of the rows.

    number: name of a 0-based count of the earlier rows of the group, of those with a 1 in `counted`
    (a bigint column of 0 and 1) if it is given. lead: {bigint column: name}
    of its value in the next row of the group. carry: {bigint column: name} of its last value that
    is not NULL in the earlier rows of the group. Values are NULL where there is no such row. Rows
    with a NULL group form one group. Ties in `order` are numbered in an arbitrary order.
    """
    import numpy as np
    import pyarrow as pa

    lead, carry = lead or {}, carry or {}
    added = ([number] if number else []) + [*lead.values(), *carry.values()]
    columns = df.columns
    ordered = range_sort(df, [group, *order])
    light = ordered.select(group, *dict.fromkeys([*lead, *carry, *([counted] if counted else [])]), SCAN_PARTITION)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{name}` bigint" for name in added])

    def values(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return np.array(batch.column(name).to_pylist(), dtype=object)

    def weights(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(counted).to_numpy(zero_copy_only=False).astype(np.int64) if counted else np.ones(batch.num_rows, dtype=np.int64)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = head = head_lead = tail = None
        count, single, last = 0, True, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = values(batch, group)
            if part is None:
                part, head = batch.column(SCAN_PARTITION)[0].as_py(), groups[0]
                head_lead = {c: batch.column(c)[0].as_py() for c in lead}
                tail = groups[0]
            change = np.flatnonzero(groups[1:] != groups[:-1]) + 1
            first_new = groups[0] != tail
            at = int(change[-1]) if len(change) else 0
            if first_new or len(change):
                count, single, last = 0, False, {}
            tail = groups[-1]
            count += int(weights(batch)[at:].sum())
            for c in carry:
                kept = [v for v in values(batch, c)[at:] if v is not None]
                if kept:
                    last[c] = kept[-1]
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "info": pa.array([pickle.dumps((head, head_lead, tail, count, single, last))], pa.binary())})

    found = sorted(light.mapInArrow(edges, "part int, info binary").collect(), key=lambda r: r["part"])  # one row per partition
    before, after = {}, {}
    state: tuple = (object(), 0, {})
    for row in found:
        head, _, tail, count, single, last = pickle.loads(row["info"])
        before[row["part"]] = state
        if single and head == state[0]:
            state = (tail, state[1] + count, {**state[2], **last})
        else:
            state = (tail, count, last)
    for row, following in zip(found, found[1:]):
        after[row["part"]] = pickle.loads(following["info"])[:2]
    ends = {k: (None if type(v[0]) is object else v[0], type(v[0]) is object, v[1], v[2]) for k, v in before.items()}

    def annotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = count = carried = part = held = None
        fresh = True

        def finish(held: tuple, head: object, head_lead: dict, there: bool) -> pa.RecordBatch:
            batch, groups, extra = held
            arrays = [batch.column(c) for c in columns]
            if number:
                arrays.append(pa.array(extra["n"], pa.int64()))
            for c in lead:
                own = values(batch, c)
                moved = np.full(len(own), None, dtype=object)
                same = groups[1:] == groups[:-1]
                moved[:-1][same] = own[1:][same]
                if there and groups[-1] == head:
                    moved[-1] = head_lead[c]
                arrays.append(pa.array(moved.tolist(), pa.int64()))
            arrays += [pa.array(extra[c].tolist(), pa.int64()) for c in carry]
            return pa.RecordBatch.from_arrays(arrays, names=[*columns, *added])

        for batch in batches:
            if not batch.num_rows:
                continue
            groups = values(batch, group)
            if part is None:
                part = batch.column(SCAN_PARTITION)[0].as_py()
                tail, fresh, count, carried = ends[part]
                carried = dict(carried)
            if held is not None:
                yield finish(held, groups[0], {c: batch.column(c)[0].as_py() for c in lead}, True)
            new = np.ones(len(groups), dtype=bool)
            new[1:] = groups[1:] != groups[:-1]
            new[0] = fresh or groups[0] != tail
            index = np.arange(len(groups))
            starts = np.maximum.accumulate(np.where(new, index, -1))
            weight = weights(batch)
            before_row = np.cumsum(weight) - weight
            extra = {"n": np.where(starts >= 0, before_row - before_row[np.maximum(starts, 0)], before_row + (count or 0))}
            for c in carry:
                out, last = [], carried.get(c)
                for value, is_new in zip(values(batch, c), new):
                    last = None if is_new else last
                    out.append(last)
                    last = value if value is not None else last
                extra[c] = np.array([*out, None], dtype=object)[:-1]
                carried[c] = last
            tail, fresh, count = groups[-1], False, int(extra["n"][-1] + weight[-1])
            held = (batch, groups, extra)
        if held is not None:
            there = part in after
            head, head_lead = after.get(part, (None, {}))
            yield finish(held, head, head_lead, there)

    return ordered.mapInArrow(annotate, schema)
