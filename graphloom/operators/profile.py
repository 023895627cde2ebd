"""Data probes behind the inference of keys and dependencies: whole columns, one job per table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import as_text

#: Delimiters of multi-valued text, in order of preference.
DELIMITERS = (",", ";", "|", "\t")


def _text(df: DataFrame, column: str):
    return as_text(F.col(f"`{column}`"), df.schema[column].dataType)


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) of every cell that is not NULL, as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), _text(df, c).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("c")).select("c.*").where("value is not null")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of child whose reference is not in parent (SQL's simple match: a reference that is
    NULL in part refers to nothing; blank text counts as NULL). Text and numbers compare as text."""
    there = parent.select(*[_text(parent, k).alias(f"__{i}") for i, k in enumerate(keys)]).distinct()
    refs = child
    for i, c in enumerate(columns):
        refs = refs.withColumn(f"__{i}", F.btrim(_text(child, c))).where(F.col(f"__{i}") != "")
    names = [f"__{i}" for i in range(len(columns))]
    return refs.join(there, names, "left_anti").drop(*names)


def orphan_summary(checks: dict[str, tuple[DataFrame, list[str], DataFrame, list[str]]]) -> DataFrame:
    """(check, rows_scanned, references, orphans, orphan_values) per named reference.

    Distinct references are judged, so a value that many rows share meets the parent once."""
    out = None
    for name, (child, columns, parent, keys) in checks.items():
        texts = [F.nullif(F.btrim(_text(child, c)), F.lit("")).alias(f"__{i}") for i, c in enumerate(columns)]
        counted = child.select(*texts).groupBy(*[f"__{i}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias("n"))
        there = parent.select(*[_text(parent, k).alias(f"__{i}") for i, k in enumerate(keys)]).distinct().withColumn("__there", F.lit(True))
        given = F.lit(True)
        for i in range(len(columns)):
            given = given & F.col(f"__{i}").isNotNull()
        judged = counted.join(there, [f"__{i}" for i in range(len(columns))], "left").withColumn("given", given)
        lost = F.col("given") & F.col("__there").isNull()
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        row = judged.agg(
            total("n").alias("rows_scanned"), total(F.when(F.col("given"), F.col("n"))).alias("references"), total(F.when(lost, F.col("n"))).alias("orphans"), total(F.when(lost, 1)).alias("orphan_values")
        ).select(F.lit(name).alias("check"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def orphan_issues(checks: dict[str, tuple[DataFrame, list[str], DataFrame, list[str]]], row_keys: dict[str, list[str]], most: int | None = None) -> DataFrame:
    """(check, row_key, value) of each row whose reference leads nowhere; parts of keys are joined
    by commas. `row_keys` names the columns that tell a check's rows apart. `most` is the length
    of a report: so many rows of each check, in no order."""
    parts = []
    for name, (child, columns, parent, keys) in checks.items():
        text = lambda names: F.concat_ws(",", *[F.coalesce(_text(child, c), F.lit("")) for c in names])  # noqa: E731, B023
        lost = orphans(child, columns, parent, keys).select(F.lit(name).alias("check"), text(row_keys[name]).alias("row_key"), text(columns).alias("value"))
        parts.append(lost if most is None else lost.limit(most))
    return reduce(DataFrame.unionByName, parts)


def value_overlap(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(distinct_values, found, overlap): share of the distinct values of a column, as text, that
    are in a key column; overlap is NULL where there are none."""
    values = child.select(F.btrim(_text(child, column)).alias("v")).where("v <> ''").distinct()
    there = parent.select(F.btrim(_text(parent, key)).alias("v")).where("v is not null").distinct().withColumn("hit", F.lit(1))
    return values.join(there, "v", "left").agg(F.count(F.lit(1)).alias("distinct_values"), F.count("hit").alias("found")).withColumn(
        "overlap", F.try_divide(F.col("found").cast("double"), F.col("distinct_values").cast("double"))
    )


def distinct_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, filled, distinct_values, ratio) of each column that has a value: distinct
    values among the rows that are not NULL. A value repeats as one row after the map side."""
    counts = _cells(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column_name").agg(F.sum("n").alias("filled"), F.count(F.lit(1)).alias("distinct_values")).withColumn(
        "ratio", F.col("distinct_values") / F.col("filled")
    )


def fd_strengths(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(determinant, dependent, groups, strength): share of a determinant's values with exactly one
    value of the dependent, all pairs in one job. NULL is no value on either side."""
    cells = F.array(*[F.struct(F.lit(a).alias("determinant"), F.lit(b).alias("dependent"), _text(df, a).alias("a"), _text(df, b).alias("b")) for a, b in pairs])
    distinct = df.select(F.explode(cells).alias("c")).select("c.*").where("a is not null").distinct()
    groups = distinct.groupBy("determinant", "dependent", "a").agg(F.count("b").alias("n"))
    return groups.groupBy("determinant", "dependent").agg(F.count(F.lit(1)).alias("groups"), F.avg((F.col("n") == 1).cast("double")).alias("strength"))


def delimiter_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, delimiter, rate): share of the values of a column that hold each delimiter."""
    cells = _cells(df, columns)
    rates = cells.groupBy("column_name").agg(*[F.avg(F.contains("value", F.lit(d)).cast("double")).alias(f"r{i}") for i, d in enumerate(DELIMITERS)])
    return rates.select("column_name", F.explode(F.array(*[F.struct(F.lit(d).alias("delimiter"), F.col(f"r{i}").alias("rate")) for i, d in enumerate(DELIMITERS)])).alias("x")).select("column_name", "x.*")


def key_candidates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name): columns that are unique and have no NULL; of an empty table, all of them."""
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    total = df.count()
    found = names.join(distinct_ratios(df, columns), "column_name", "left").where(F.lit(total == 0) | ((F.col("filled") == total) & (F.col("distinct_values") == total)))
    return found.select("column_name")


def sample_values(df: DataFrame, column: str, n: int = 100) -> DataFrame:
    """Up to n distinct values of a column that are not NULL: a sampling operator."""
    return df.select(F.col(f"`{column}`").alias("value")).where("value is not null").distinct().limit(n)
