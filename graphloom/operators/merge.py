"""Keyed merges: bulk loads by on_duplicate, and change batches under a conflict policy.

A change has `_key`, `op` (INSERT, REPLACE, DELETE), `seq` (bigint or PLACED_SEQ, the order of the
log) and the document's columns. A target keeps, besides its documents, `_seq` (the last sequence applied to
the key) and `_deleted` (a tombstone), so that late or repeated changes cannot undo newer ones and
any split of a log into batches gives the same target.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.scan import annotate_groups

META = ("_key", "_seq", "_deleted")
POLICIES = ("source_wins", "last_write_wins", "log_and_skip", "fail")
#: Policies under which the newest change of a key holds, whatever there was.
LATEST_POLICIES = ("source_wins", "last_write_wins")
#: A sequence with a place behind the point, and the step from place to place. Any int fits.
PLACED_SEQ, PLACE_UNIT = "decimal(38,10)", Decimal("0.0000000001")
ON_DUPLICATE = ("error", "update", "replace", "ignore")


class ConflictError(RuntimeError):
    """A conflict under the policy `fail`, or a duplicate key in a load with on_duplicate error."""


def fields_of(df: DataFrame, *but: str) -> list[str]:
    return [c for c in df.columns if c not in (*META, "op", "seq", *but)]


def empty_target(changes: DataFrame) -> DataFrame:
    """An empty target for the documents of a change table."""
    return changes.select("_key", *[F.col(f"`{c}`") for c in fields_of(changes)], F.col("seq").alias("_seq"), F.lit(False).alias("_deleted")).limit(0)


def live(target: DataFrame) -> DataFrame:
    """The documents of a target, without tombstones and sequences."""
    return target.where("not coalesce(_deleted, false)").drop("_seq", "_deleted")


def _latest(changes: DataFrame, fields: list[str]) -> DataFrame:
    """The last change per key: combined on the map side, so a hot key is cheap. Of changes of the
    same sequence a DELETE, then the largest document, holds."""
    ranked = F.struct("seq", (F.col("op") == "DELETE").alias("gone"), *[F.col(f"`{c}`") for c in fields])
    last = changes.groupBy("_key").agg(F.max(ranked).alias("r"))
    return last.select("_key", F.col("r.seq").alias("_seq"), F.col("r.gone").alias("_deleted"), *[F.col(f"r.`{c}`").alias(c) for c in fields])


def latest(changes: DataFrame) -> DataFrame:
    """The rows that a batch of changes alone leaves, tombstones included."""
    sound = changes.where("_key is not null and seq is not null and op in ('INSERT', 'REPLACE', 'DELETE')")
    return _latest(sound, fields_of(changes))


def newest(target: DataFrame, later: DataFrame, order: str) -> DataFrame:
    """A target with rows of the same kind that came later merged in: of a key the row with the
    highest sequence holds, of equal sequences the earlier one (`order` numbers them)."""
    fields = [c for c in later.columns if c not in ("_key", order)]
    record = F.struct("_seq", (-F.col(order)).alias("__early"), *[F.col(f"`{c}`") for c in fields if c != "_seq"])
    last = later.groupBy("_key").agg(F.max(record).alias("c")).select(F.col("_key").alias("k"), "c")
    old = target.select("_key", F.struct(*[F.col(f"`{c}`") for c in target.columns if c != "_key"]).alias("t"))
    both = old.join(last, F.col("_key") == F.col("k"), "full_outer")
    newer = F.col("c").isNotNull() & (F.col("t").isNull() | F.col("t._seq").isNull() | (F.col("c._seq") > F.col("t._seq")))
    pick = lambda c: F.when(newer, F.col(f"c.`{c}`") if c in fields else F.lit(None)).otherwise(F.col(f"t.`{c}`")).alias(c)
    return both.select(F.coalesce("_key", "k").alias("_key"), *[pick(c) for c in target.columns if c != "_key"])


def with_existence(target: DataFrame, changes: DataFrame) -> DataFrame:
    """changes with `existed`: whether the key had a document when the change arrived in order.

    An INSERT leaves a document, a DELETE none, a REPLACE what there was, whether or not the
    policy lets a conflicting change through."""
    sets = changes.withColumn("__sets", F.when(F.col("op") == "INSERT", 1).when(F.col("op") == "DELETE", 0).cast("bigint"))
    seen = annotate_groups(sets, "_key", ["seq"], carry={"__sets": "__before"})
    there = target.where("not coalesce(_deleted, false)").select("_key", F.lit(True).alias("__there"))
    return (
        seen.join(there, "_key", "left")
        .withColumn("existed", F.coalesce(F.col("__before") == 1, F.col("__there"), F.lit(False)))
        .drop("__sets", "__before", "__there")
    )


def conflicts(target: DataFrame, changes: DataFrame, policy: str = "source_wins") -> DataFrame:
    """(_key, seq, op, conflict_type, resolution): INSERTs of keys that exist and REPLACEs of keys
    that do not, each with what the policy does about it."""
    outcome = {
        "source_wins": {"INSERT_DUPLICATE": "replaced", "REPLACE_MISSING": "inserted"},
        "last_write_wins": {"INSERT_DUPLICATE": "newest kept", "REPLACE_MISSING": "inserted"},
        "log_and_skip": {"INSERT_DUPLICATE": "skipped", "REPLACE_MISSING": "skipped"},
        "fail": {"INSERT_DUPLICATE": "failed", "REPLACE_MISSING": "failed"},
    }[policy]
    kind = F.when((F.col("op") == "INSERT") & F.col("existed"), "INSERT_DUPLICATE").when((F.col("op") == "REPLACE") & ~F.col("existed"), "REPLACE_MISSING")
    found = with_existence(target, changes).select("_key", "seq", "op", kind.alias("conflict_type")).where("conflict_type is not null")
    return found.withColumn("resolution", F.when(F.col("conflict_type") == "INSERT_DUPLICATE", outcome["INSERT_DUPLICATE"]).otherwise(outcome["REPLACE_MISSING"]))


def conflict_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("conflict_type", "resolution").agg(F.count(F.lit(1)).alias("conflicts"))


def apply_changes(target: DataFrame, changes: DataFrame, policy: str = "source_wins") -> DataFrame:
    """The target after a batch of changes, tombstones included (`live` gives the documents).

    source_wins and last_write_wins keep the newest change of each key by sequence, against the
    target's own too; log_and_skip leaves conflicting changes out; fail raises ConflictError if
    there is one. Changes with a NULL key or sequence are left out. Repeated changes change
    nothing; documents of the target keep their columns, and columns only the changes have are
    ignored.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; one of {', '.join(POLICIES)}")
    changes = changes.where("_key is not null and seq is not null and op in ('INSERT', 'REPLACE', 'DELETE')")
    fields = [c for c in fields_of(target) if c in changes.columns]
    if policy in ("log_and_skip", "fail"):
        seen = with_existence(target, changes)
        clash = "(op = 'INSERT' and existed) or (op = 'REPLACE' and not existed)"
        if policy == "fail":
            first = seen.where(clash).select("_key", "op").head(1)
            if first:
                raise ConflictError(f"{first[0]['op']} of key {first[0]['_key']!r}")
        changes = seen.where(f"not ({clash})").drop("existed")
    last = _latest(changes, fields).select(F.col("_key").alias("k"), F.struct("_seq", "_deleted", *[F.col(f"`{c}`") for c in fields]).alias("c"))
    old = target.select("_key", F.struct(*[F.col(f"`{c}`") for c in target.columns if c != "_key"]).alias("t"))
    both = old.join(last, F.col("_key") == F.col("k"), "full_outer")
    newer = F.col("c").isNotNull() & (F.col("t").isNull() | F.col("t._seq").isNull() | (F.col("c._seq") > F.col("t._seq")))
    pick = lambda c: F.when(newer, F.col(f"c.`{c}`")).otherwise(F.col(f"t.`{c}`")).alias(c)
    return both.select(
        F.coalesce("_key", "k").alias("_key"),
        *[pick(c) if c in (*fields, "_seq", "_deleted") else F.col(f"t.`{c}`").alias(c) for c in target.columns if c != "_key"],
    )


def load(target: DataFrame, rows: DataFrame, on_duplicate: str = "replace") -> DataFrame:
    """The documents after a bulk load by `_key`: ignore keeps what is there, replace overrides it,
    update overrides it where the new value is not NULL, error raises if a key is there already or
    comes twice. Of rows of one key the largest holds (ignore: the smallest). Rows with a NULL key
    are left out."""
    state = target.withColumn("_seq", F.lit(None).cast("bigint")).withColumn("_deleted", F.lit(False))
    return live(load_state(state, rows, on_duplicate))


def load_state(state: DataFrame, rows: DataFrame, on_duplicate: str = "replace", sequence: int | None = None) -> DataFrame:
    """load() into rows with `_seq` and `_deleted`, which it keeps: a change older than a key's last
    one stays without effect after the load.

    A tombstone counts as no document; a loaded row brings the key back. With a `sequence` (of the
    log at the time of the snapshot that is loaded) the loaded rows have it, and rows and
    tombstones of the state that are newer stay as they are."""
    if on_duplicate not in ON_DUPLICATE:
        raise ValueError(f"unknown on_duplicate {on_duplicate!r}; one of {', '.join(ON_DUPLICATE)}")
    fields = fields_of(state)
    rows = rows.where("_key is not null")
    record = F.struct(*[F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast(state.schema[c].dataType).alias(c) for c in fields])
    grouped = rows.groupBy("_key").agg((F.min if on_duplicate == "ignore" else F.max)(record).alias("n"), F.count(F.lit(1)).alias("times"))
    gone = F.coalesce("_deleted", F.lit(False))
    old = state.select("_key", F.when(~gone, F.struct(*[F.col(f"`{c}`") for c in fields])).alias("o"), "_seq", gone.alias("gone"))
    both = old.join(grouped, "_key", "full_outer")
    if on_duplicate == "error":
        clash = both.where("n is not null and (o is not null or times > 1)").head(1)
        if clash:
            raise ConflictError(f"duplicate key {clash[0]['_key']!r}")
    taken = F.col("n").isNotNull()
    if sequence is not None:
        taken = taken & ~F.coalesce(F.col("_seq") > sequence, F.lit(False))
    if on_duplicate == "ignore":
        taken = taken & F.col("o").isNull()
    new = (lambda c: F.coalesce(F.col(f"n.`{c}`"), F.col(f"o.`{c}`"))) if on_duplicate == "update" else (lambda c: F.col(f"n.`{c}`"))
    seq = F.col("_seq") if sequence is None else F.when(taken, F.lit(sequence).cast(state.schema["_seq"].dataType)).otherwise(F.col("_seq"))
    return both.select(
        "_key", *[F.when(taken, new(c)).otherwise(F.col(f"o.`{c}`")).alias(c) for c in fields], seq.alias("_seq"), F.when(taken, False).otherwise(F.coalesce("gone", F.lit(False))).alias("_deleted")
    )
