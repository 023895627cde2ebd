"""Queries of problems 1 to 5 over the library tables."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import drift, intervals, orphans, quality, rejects
from graphloom.plans.runtime import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.rejected_records(read_table(spark, folder, "raw_books"))


def p1_books(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.sound_records(read_table(spark, folder, "raw_books"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.field_changes(read_table(spark, folder, "reference_schema"))


def p2_table(spark: SparkSession, folder: str) -> DataFrame:
    return drift.ingest(read_table(spark, folder, "reference_schema"))


def p2_typed(spark: SparkSession, folder: str) -> DataFrame:
    return drift.typed_summary(drift.ingest(read_table(spark, folder, "reference_schema")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    path = lambda t: os.path.join(folder, f"{t}.parquet")
    return quality.table_findings(
        spark,
        {("members", "city"): path("members"), ("books", "genre"): path("books"), ("authors", "country"): path("authors")},
    )


#: Columns of the profile with their rule for malformed values.
PROFILED = {
    "members": {"id": "any", "name": "text", "city": "name", "joined": "any", "feed": "any", "load_no": "any", "loaded_at": "any"},
    "books": {"id": "any", "title": "text", "author_id": "any", "genre": "name", "published": "any", "feed": "any", "load_no": "any", "loaded_at": "any"},
    "authors": {"id": "any", "name": "text", "country": "name", "born": "any", "feed": "any", "load_no": "any", "loaded_at": "any"},
}


def p3_profile(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        quality.profile(spark, os.path.join(folder, f"{t}.parquet"), columns).drop("chunks_footer", "chunks_scanned").select(F.lit(t).alias("table_name"), "*")
        for t, columns in PROFILED.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _loans(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.holding_rows(read_table(spark, folder, "loans"), "id", "recorded_at", ["book_id", "loaned_on", "returned_on"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = intervals.periods_and_gaps(_loans(spark, folder), "book_id", "loaned_on", "returned_on")
    return runs.where("kind = 'gap' OR shared").select(F.col("entity").alias("book_id"), "kind", "from_day", "to_day")


def p4_periods(spark: SparkSession, folder: str) -> DataFrame:
    runs = intervals.periods_and_gaps(_loans(spark, folder), "book_id", "loaned_on", "returned_on")
    return runs.select(F.col("entity").alias("book_id"), "kind", "from_day", "to_day", "shared")


def _unresolved(spark: SparkSession, folder: str) -> DataFrame:
    authors, books, members, loans, deletions = (read_table(spark, folder, t) for t in ("authors", "books", "members", "loans", "deletions"))
    gone = lambda t: deletions.where(F.col("table_name") == t)
    to = lambda column, target, name: orphans.Reference((column,), target, ("id",), gone(name))
    of_loans = orphans.unresolved(loans, "id", "recorded_at", {"book_id": to("book_id", books, "books"), "member_id": to("member_id", members, "members")})
    of_books = orphans.unresolved(books, "id", "loaded_at", {"author_id": to("author_id", authors, "authors")})
    return of_loans.select(F.lit("loans").alias("table_name"), "*").unionByName(of_books.select(F.lit("books").alias("table_name"), "*"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _unresolved(spark, folder).select("table_name", "column_name", "row_id", "kind").distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _unresolved(spark, folder)
        .groupBy("table_name", "column_name", "kind", F.date_format("first_seen", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("references"))
    )


def p5_composite(spark: SparkSession, folder: str) -> DataFrame:
    """Loans whose book and member, or the one of them that is given, have no returned loan, by
    null mask: a reference of two columns with partial match."""
    loans = read_table(spark, folder, "loans")
    ended = loans.where("returned_on is not null and book_id is not null and member_id is not null").withColumn("loaded_at", F.col("recorded_at"))
    found = orphans.unresolved(loans, "id", "recorded_at", {"pair": orphans.Reference(("book_id", "member_id"), ended, ("book_id", "member_id"), match="partial")})
    return found.groupBy("mask", "kind").agg(F.count(F.lit(1)).alias("references"))


QUERIES = {f.__name__: f for f in (p1_found, p1_books, p2_found, p2_table, p2_typed, p3_found, p3_profile, p4_found, p4_periods, p5_found, p5_report, p5_composite)}
