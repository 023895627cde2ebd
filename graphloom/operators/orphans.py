"""References to records that do not exist (problem 5).

References are grouped by their null mask and each mask is matched on its non-null columns, by the
declared semantics. Distinct referenced keys are judged first (a hot key is one row after the
map-side combine), and only the keys at fault meet the referring rows again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.runtime import cut

#: Copies of a key that cannot be broadcast: a hot key's referring rows spread over so many tasks.
SALTS = 16
#: Faulty keys are broadcast while their counted rows, at KEY_BYTES each, stay under this size.
BROADCAST_BYTES, KEY_BYTES = 16 << 20, 160
#: How a reference that is NULL in part is matched.
MATCHES = ("simple", "full", "partial")


@dataclass(frozen=True)
class Reference:
    """Columns that refer to the `keys` of `targets` (with `loaded_at`). `deletions` has
    `deleted_keys` in the same order and `deleted_at`. match: `simple` ignores a reference with any
    NULL; `full` reports one that is NULL in part as `partial`; `partial` matches it on its
    non-null columns. A reference that is NULL throughout refers to nothing."""

    columns: tuple[str, ...]
    targets: DataFrame
    keys: tuple[str, ...]
    deletions: DataFrame | None = None
    deleted_keys: tuple[str, ...] = ("row_id",)
    match: str = "simple"


def _mask(columns: list[str]) -> Column:
    """Bit i is set where column i is not NULL."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)])


def referenced_keys(references: DataFrame, columns: list[str], seen: str) -> DataFrame:
    """Distinct reference keys with their null mask and the earliest `seen`."""
    return references.groupBy(*columns).agg(F.min(seen).alias("first_seen")).withColumn("mask", _mask(columns))


def faulty_keys(keys: DataFrame, columns: list[str], targets: DataFrame, deletions: DataFrame | None = None, match: str = "simple") -> DataFrame:
    """The keys of referenced_keys that do not resolve: columns, mask, kind, appeared.

    `targets` has the same key columns and `loaded_at`; `deletions` the key columns and
    `deleted_at`. Kinds: `deleted` (a deletion names the key and no row of it is loaded after the
    last one), `missing`, `late` (a row referred before `appeared`, the first load of the key) and
    `partial` (see Reference). Each null mask is anti-joined on its own non-null columns.
    """
    if match not in MATCHES:
        raise ValueError(f"unknown match semantics: {match}")
    whole = (1 << len(columns)) - 1
    masks = [whole] if match == "simple" else range(1, whole + 1)
    if match != "simple":
        keys = cut(keys)  # each mask reads what was grouped once
    nothing = F.lit(None).cast("timestamp_ntz")
    found = []
    for mask in masks:
        of_mask = keys.where(F.col("mask") == mask)
        if mask != whole and match == "full":
            found.append(of_mask.select(*columns, "mask", F.lit("partial").alias("kind"), nothing.alias("appeared")))
            continue
        on = [c for i, c in enumerate(columns) if mask >> i & 1]
        state = targets.groupBy(*on).agg(F.min("loaded_at").alias("appeared"), F.max("loaded_at").alias("renewed"))
        gone = None if deletions is None else deletions.groupBy(*on).agg(F.max("deleted_at").alias("deleted_at"))
        known = state.withColumn("deleted_at", nothing) if gone is None else state.join(gone, on, "full_outer")
        deleted = F.col("deleted_at").isNotNull() & ~F.coalesce(F.col("renewed") > F.col("deleted_at"), F.lit(False))
        known = known.select(*on, "appeared", deleted.alias("deleted"))
        # A key resolves if the target has it, not deleted, from before the first reference to it.
        sound = known.where("not deleted and appeared is not null").select(*[F.col(c).alias(f"to_{c}") for c in on], F.col("appeared").alias("since"))
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"to_{c}") for c in on])
        lost = of_mask.join(sound, same & ~(F.col("since") > F.col("first_seen")), "left_anti")
        kind = F.when(F.coalesce("deleted", F.lit(False)), "deleted").when(F.col("appeared").isNull(), "missing").otherwise("late")
        found.append(lost.join(known, on, "left").select(*columns, "mask", kind.alias("kind"), "appeared"))
    return reduce(DataFrame.unionByName, found)


def unresolved(rows: DataFrame, row_key: str, seen: str, references: dict[str, Reference]) -> DataFrame:
    """(column_name, row_id, mask, kind, first_seen) for each id of `rows` and named reference that
    does not resolve; bit i of mask is set where the reference's column i is not NULL.

    An id with several rows counts once for each key it refers to, with the earliest `seen`. NULL
    ids form one id. Repeated rows change nothing; empty tables give an empty result, or all
    references missing.
    """
    parts = []
    for name, reference in references.items():
        columns = [f"key_{i}" for i in range(len(reference.columns))]
        named = lambda df, names: [F.col(f"`{n}`").alias(c) for n, c in zip(names, columns)]  # noqa: E731, B023
        refs = rows.select(F.col(row_key).alias("row_id"), F.col(seen).alias("seen"), *named(rows, reference.columns))
        refs = refs.where(F.coalesce(*columns).isNotNull()) if len(columns) == 1 else refs.where(_mask(columns) > 0)
        to = reference.targets.select(*named(reference.targets, reference.keys), "loaded_at")
        gone = None if reference.deletions is None else reference.deletions.select(*named(reference.deletions, reference.deleted_keys), "deleted_at")
        if len(columns) == 1:
            to = to.where("key_0 is not null")
            gone = gone if gone is None else gone.where("key_0 is not null")
        bad = cut(faulty_keys(referenced_keys(refs, columns, "seen"), columns, to, gone, reference.match)).alias("b")
        same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) if len(columns) > 1 else F.col(f"r.{c}") == F.col(f"b.{c}") for c in columns])
        if bad.count() * KEY_BYTES <= BROADCAST_BYTES:
            hit = refs.alias("r").join(F.broadcast(bad), same)
        else:  # too many to broadcast: hot keys are salted on both sides
            salted = bad.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))).alias("b")
            left = refs.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).alias("r")
            hit = left.join(salted, same & (F.col("r.salt") == F.col("b.salt")))
        own = [f"r.{c}" for c in columns]
        per_id = hit.groupBy("row_id", *own, "mask", "kind", "appeared").agg(F.min("seen").alias("first_seen"))
        parts.append(per_id.where("kind <> 'late' OR appeared > first_seen").select(F.lit(name).alias("column_name"), "row_id", "mask", "kind", "first_seen"))
    return reduce(DataFrame.unionByName, parts)
