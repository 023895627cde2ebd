"""From events to changes of vertex and edge sets, and their application batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from graphloom import model
from graphloom.operators import merge, project
from graphloom.plans import governance
from graphloom.sources.store import GraphStore
from graphloom.streaming.changelog import lsn_number

#: Log operation -> operation on a document.
OPS = {"INSERT": "INSERT", "UPDATE": "REPLACE", "DELETE": "DELETE"}


def sequenced(events: DataFrame) -> DataFrame:
    """events with `seq`: 1024 times the numeric log position; where events have a place in their
    transaction, a decimal whose digits after the point are that place, so that no number of
    changes in a transaction is too large. Never the order of arrival."""
    at = lsn_number(F.col("lsn"))
    if "ordinal" not in events.columns:
        return events.withColumn("seq", at * 1024)
    place = F.coalesce("ordinal", F.lit(0)).cast("decimal(10,0)") * F.lit(merge.PLACE_UNIT)
    return events.withColumn("seq", (at.cast("decimal(19,0)") * 1024 + place).cast(merge.PLACED_SEQ))


def _rows(events: DataFrame, table: model.Table, side: str) -> DataFrame:
    """The named side's columns of the events of a table, as text, with seq and op."""
    shape = T.StructType([T.StructField(n, T.StringType()) for n in table.names])
    parsed = events.withColumn("__r", F.from_json(F.col(side), shape)).where("__r is not null")
    return parsed.select(F.col("seq").alias("__seq"), F.col("op").alias("__op"), *[F.col(f"__r.`{n}`").alias(n) for n in table.names])


def vertex_changes(events: DataFrame, table: model.Table, mapping: model.CollectionMapping, config: model.MappingConfig) -> DataFrame:
    """Changes (`_key`, op, seq, document columns) of a table's vertex set. A DELETE is keyed by
    its old row."""
    of_table = events.where(F.col("table_name") == table.name)
    effective = of_table.withColumn("__row", F.when(F.col("op") == "DELETE", F.coalesce("old_row", "new_row")).otherwise(F.col("new_row")))
    return _projected(_rows(effective, table, "__row"), lambda df: project.vertices(df, table, mapping, config))


def _projected(rows: DataFrame, shape: Callable) -> DataFrame:
    """shape(rows) with op and seq of each row kept beside its result."""
    op = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])[F.col("__op")]
    tagged = rows.withColumn("op", op).withColumnRenamed("__seq", "seq").drop("__op")
    return shape(_PassengerFrame(tagged, ["op", "seq"]))._df


class _PassengerFrame:
    """A DataFrame whose select() adds the passengers, so that projections need not know them."""

    def __init__(self, df: DataFrame, passengers: list[str]):
        self._df, self._passengers = df, passengers

    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if c not in self._passengers]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self._df.schema.fields if f.name not in self._passengers])

    def __getitem__(self, name: str):
        return self._df[name]

    def where(self, test) -> _PassengerFrame:
        return _PassengerFrame(self._df.where(test), self._passengers)

    def select(self, *columns) -> _PassengerFrame:
        return _PassengerFrame(self._df.select(*columns, *self._passengers), self._passengers)


def edge_changes(events: DataFrame, edge: model.EdgeDefinition, table: model.Table, config: model.MappingConfig, reference_compat: bool = False) -> DataFrame:
    """Changes (`_key`, op, seq, _from, _to, _label) of an edge set.

    An UPDATE also deletes the edge of its old row where the new row has another or none; with
    reference_compat it only writes the new one."""
    of_table = events.where(F.col("table_name") == table.name)
    shape = lambda df: project.edges(df, edge, table, config)
    effective = of_table.withColumn("__row", F.when(F.col("op") == "DELETE", F.coalesce("old_row", "new_row")).otherwise(F.col("new_row")))
    now = _projected(_rows(effective, table, "__row"), shape)
    if reference_compat:
        return now
    old = _projected(_rows(of_table.where("op = 'UPDATE' and old_row is not null"), table, "old_row"), shape).withColumn("op", F.lit("DELETE"))
    kept = now.select("_key", "seq").distinct()
    return now.unionByName(old.join(kept, ["_key", "seq"], "left_anti"))


def deltas(events: DataFrame, schema: model.Schema, config: model.MappingConfig, reference_compat: bool = False) -> DataFrame:
    """(seq, collection, is_edge, op, _key, doc) of all changes, documents as JSON text. Events of
    unmapped tables give none."""
    parts = []
    for mapping in config.collections.values():
        table = schema.tables.get(mapping.source_table)
        if table is not None and table.primary_key:
            parts.append(_packed(vertex_changes(events, table, mapping, config), mapping.target_collection, False))
    for edge in config.edges:
        table = schema.tables.get(edge.from_collection)
        if table is not None and table.primary_key:
            parts.append(_packed(edge_changes(events, edge, table, config, reference_compat), edge.edge_collection, True))
    return reduce(DataFrame.unionByName, parts)


def _packed(changes: DataFrame, collection: str, is_edge: bool) -> DataFrame:
    doc = F.to_json(F.struct("_key", *[F.col(f"`{c}`") for c in merge.fields_of(changes)]), {"ignoreNullFields": "false"})
    return changes.select("seq", F.lit(collection).alias("collection"), F.lit(is_edge).alias("is_edge"), "op", "_key", F.when(F.col("op") != "DELETE", doc).alias("doc"))


@dataclass
class BatchStats:
    """What became of a batch: its events and transactions, its last position, and the changes
    applied and failed by collection."""

    events: int = 0
    transactions: int = 0
    last_seq: Decimal | int | None = None
    applied: dict[str, int] = field(default_factory=dict)
    failed: dict[str, int] = field(default_factory=dict)
    skipped: bool = False


def apply_events(
    store: GraphStore, events: DataFrame, schema: model.Schema, config: model.MappingConfig, policy: str = "source_wins", batch: object = None, dead_letters: Callable[[DataFrame], None] | None = None
) -> dict[str, int]:
    """Apply a batch of events to a store; returns the number of changes per collection. A batch
    id that was applied already changes nothing, and neither does a batch that comes again under
    another id, as documents keep the sequence they were written at. See apply_batch."""
    return apply_batch(store, events, schema, config, policy, batch, dead_letters).applied


def apply_batch(
    store: GraphStore, events: DataFrame, schema: model.Schema, config: model.MappingConfig, policy: str = "source_wins", batch: object = None, dead_letters: Callable[[DataFrame], None] | None = None
) -> BatchStats:
    """apply_events with statistics. With `dead_letters` the changes of a collection that cannot be
    applied go there (batch, collection, seq, op, _key, doc, error), and the batch goes on; without
    it the error ends the batch, which is then not noted as applied."""
    stats = BatchStats()
    if batch is not None and store.has_batch(batch):
        stats.skipped = True
        return stats
    ready = sequenced(events).where("seq is not null")
    told = ready.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("transaction_id" if "transaction_id" in ready.columns else F.lit(None)).alias("t"), F.max("seq").alias("last")).first()
    stats.events, stats.transactions, stats.last_seq = told["n"], told["t"], told["last"]

    def put(collection: str, changes: DataFrame, is_edge: bool) -> None:
        try:
            stats.applied[collection] = store.merge(collection, changes, policy)
        except Exception as error:
            if dead_letters is None:
                raise
            lost = _packed(changes, collection, is_edge).select(F.lit(str(batch)).alias("batch"), "collection", "seq", "op", "_key", "doc", F.lit(str(error)[:2000]).alias("error"))
            dead_letters(lost)
            stats.failed[collection] = changes.count()

    for mapping in config.collections.values():
        table = schema.tables.get(mapping.source_table)
        if table is not None and table.primary_key:
            put(mapping.target_collection, vertex_changes(ready, table, mapping, config), False)
    for edge in config.edges:
        table = schema.tables.get(edge.from_collection)
        if table is not None and table.primary_key:
            put(edge.edge_collection, edge_changes(ready, edge, table, config), True)
    if batch is not None:
        store.note_batch(batch)
    return stats


def dead_letter_folder(path: str) -> Callable[[DataFrame], None]:
    """Dead letters as JSON lines appended to a folder."""
    return lambda lost: lost.withColumn("recorded_at", F.current_timestamp()).write.mode("append").json(path)


def governed(schema: model.Schema, config: model.MappingConfig, threshold: str) -> model.MappingConfig:
    """The mapping without what reaches a level of sensitivity, for a stream as for a load."""
    return governance.gate(config, governance.report(config, schema, threshold))[0]


def run_stream(
    source: DataFrame,
    format: str,
    store: GraphStore,
    schema: model.Schema,
    config: model.MappingConfig,
    checkpoint: str,
    *,
    policy: str = "source_wins",
    value: str = "value",
    available_now: bool = True,
    threshold: str | None = None,
    dead_letters: str | None = None,
    on_stats: Callable[[int, BatchStats], None] | None = None,
) -> StreamingQuery:
    """Start a Structured Streaming query that parses a change log and merges it into a store.

    With a `threshold` the mapping passes the gate first. Changes that cannot be applied go to the
    folder `dead_letters`, if there is one, and the log goes on."""
    from graphloom.streaming.changelog import PARSERS

    mapped = config if threshold is None else governed(schema, config, threshold)
    lost = None if dead_letters is None else dead_letter_folder(dead_letters)

    def each(batch: DataFrame, number: int) -> None:
        cached = PARSERS[format](batch, value).persist()
        try:
            stats = apply_batch(store, cached, schema, mapped, policy, number, lost)
            if on_stats is not None:
                on_stats(number, stats)
        finally:
            cached.unpersist()

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def replay_suppressed(events: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """An addition for streams with an event time: events without repeats of (table, lsn, op, rows)
    within a watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["table_name", "lsn", "op", "new_row", "old_row"])
