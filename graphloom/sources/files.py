"""Directories of delimited files and JSON lines as tables and graphs."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom import model
from graphloom.functions.types import source_type
from graphloom.operators.profile import key_candidates
from graphloom.operators.project import Graph
from graphloom.plans.naming import singularize

#: Endings of delimited files (compressed ones too).
ENDINGS = (".csv", ".tsv", ".txt", ".csv.gz", ".tsv.gz", ".txt.gz")


class OutsideBase(ValueError):
    """A folder that is not within the allowed base folder."""


class DelimitedFolder:
    """A folder with one table per delimited file.

    A session in the sense of the other sources: schema(), rows(table), count(table), preview,
    dump. All columns that look like text stay text, so that leading zeros survive in keys. A file
    without line breaks inside fields may be read with multi_line off: it is then split over tasks.
    """

    def __init__(self, spark: SparkSession, folder: str, *, delimiter: str | None = None, header: bool = True, base: str | None = None, multi_line: bool = True):
        if base is not None:
            inner, outer = os.path.realpath(folder), os.path.realpath(base)
            if inner != outer and not inner.startswith(outer + os.sep):
                raise OutsideBase(f"{folder} is outside {base}")
        self.spark, self.folder, self.delimiter, self.header, self.multi_line = spark, folder, delimiter, header, multi_line
        self._types: dict[tuple[str, float], StructType] = {}

    def tables(self) -> dict[str, str]:
        if not os.path.isdir(self.folder):
            raise FileNotFoundError(self.folder)
        out: dict[str, str] = {}
        for name in sorted(os.listdir(self.folder)):
            ending = next((e for e in sorted(ENDINGS, key=len, reverse=True) if name.lower().endswith(e)), None)
            if ending:
                out.setdefault(name[: -len(ending)], os.path.join(self.folder, name))
        return out

    def _reader(self, path: str):
        mark = self.delimiter or ("\t" if ".tsv" in os.path.basename(path).lower() else ",")
        return self.spark.read.option("header", self.header).option("sep", mark).option("escape", '"').option("multiLine", self.multi_line).option("nullValue", "")

    def rows(self, table: str, typed: bool = True, since_value: object = None, since_column: str | None = None) -> DataFrame:
        """Rows by header name, by place ("0", "1", ...) without header; typed by their values, or
        as text. The types of a file are inferred once, by a pass over all of it, until it changes."""
        from graphloom.operators.project import since

        path = self.tables()[table]
        reader, known = self._reader(path).option("preferDate", True), (path, os.path.getmtime(path))
        if typed and known in self._types:
            df = reader.schema(self._types[known]).csv(path)
        else:
            df = reader.option("inferSchema", typed).csv(path)
            if typed:
                self._types[known] = df.schema
        if not self.header:
            df = df.toDF(*[str(i) for i in range(len(df.columns))])
        return since(df, since_value, since_column)

    def count(self, table: str) -> int:
        return self.rows(table, typed=False).count()

    def preview(self, table: str, n: int = 20) -> DataFrame:
        return self.rows(table).limit(n)

    def schema(self) -> model.Schema:
        """Tables with inferred types and a guessed primary key: the first of id, {table}_id,
        {singular}_id, {table}id, {singular}id that is unique and not NULL in all rows."""
        out = model.Schema()
        for name in self.tables():
            df = self.rows(name)
            low, one = name.lower(), singularize(name.lower())
            guesses = list(dict.fromkeys(["id", f"{low}_id", f"{one}_id", f"{low}id", f"{one}id"]))
            at = {c.lower(): c for c in df.columns}
            named = [at[g] for g in guesses if g in at]
            keys = {r["column_name"] for r in key_candidates(df, named).collect()} if named else set()  # a row per guess
            pk = [c for c in named if c in keys][:1]
            out.tables[name] = model.Table(name, [model.Column(f.name, source_type(f.dataType), f.name not in pk, f.name in pk) for f in df.schema.fields], pk)
        return out


def write_graph(graph: Graph, folder: str, format: str = "json") -> None:
    """Each vertex and edge set to its own folder; JSON keeps NULL fields."""
    for name, df in {**graph.vertices, **graph.edges}.items():
        writer = df.write.mode("overwrite")
        if format == "json":
            writer = writer.option("ignoreNullFields", "false")
        writer.format(format).save(os.path.join(folder, name))


def dump_table(df: DataFrame, path: str, header: bool = True) -> None:
    """A table as delimited text, NULL as empty."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct", "variant")) else F.col(f"`{c}`") for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", header).option("nullValue", "").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def record_failures(rejects: DataFrame, path: str, load_id: str) -> None:
    """Append rejected rows to the dead letters of a load."""
    rejects.withColumn("load_id", F.lit(load_id)).withColumn("recorded_at", F.current_timestamp()).write.mode("append").json(os.path.join(path, load_id))


def read_failures(spark: SparkSession, path: str, load_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the dead letters of a load, in order of time."""
    return spark.read.json(os.path.join(path, load_id)).orderBy("recorded_at", "source_table", "row_json").offset(offset).limit(limit)


def list_failures(path: str) -> list[str]:
    return sorted(n for n in os.listdir(path) if os.path.isdir(os.path.join(path, n))) if os.path.isdir(path) else []


def tables_from_parquet(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(os.path.join(folder, f"{n}.parquet")) for n in names}
