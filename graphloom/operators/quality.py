"""Column-level data quality profile (problem 3).

Footers give exact nulls and extrema, dictionaries the distinct candidates; only the chunks whose
statistics do not suffice are scanned. Work is spread by file for the footers and by row group for
the scans, so neither a large file nor a large load falls to one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.runtime import cut, parallelism
from graphloom.sources.parquet_stats import column_bytes, dictionary_values, footer_stats, open_file

#: The limits of the findings.
MIN_ROWS, PATTERN_SHARE, NULL_RISE, DISTINCT_FACTOR, SHIFT = 30, 0.10, 0.153, 2, 0.452
#: Compressed bytes of the looked-at columns that one task reads at a time, at least a row group.
SPAN_BYTES = 8 << 20


def well_formed(value: str) -> bool:
    """3 or more characters, an upper-case letter first, letters, spaces, hyphens, apostrophes and
    full stops only, no double space and none at either end."""
    return (
        len(value) >= 3
        and value[0].isupper()
        and value[0].isalpha()
        and not value.endswith(" ")
        and "  " not in value
        and all(c.isalpha() or c in " -'." for c in value)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")


def spans(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(path, groups) of a Parquet file or folder: runs of row groups of a file whose named columns
    have about SPAN_BYTES in all, so that a footer is read once for each run and not for each row
    group. They are spread over the tasks by number."""

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                with open_file(name) as source:
                    meta = pq.ParquetFile(source).metadata
                sizes = column_bytes(meta, columns)
                run = np.cumsum(sizes) // SPAN_BYTES if len(sizes) else np.array([])
                runs = [np.flatnonzero(run == r).tolist() for r in np.unique(run)]
                yield pd.DataFrame({"path": name, "groups": pd.Series(runs, dtype=object)})

    return _files(spark, path).mapInPandas(groups, "path string, groups array<int>").repartition(parallelism(spark), "path", F.col("groups")[0])


def _chunk_counts(spark: SparkSession, path: str, column: str, feed: str = "feed", load: str = "load_no") -> DataFrame:
    """(feed, load_no, value, n) of each chunk: its rows per load and value, NULL values included.

    A chunk of one load whose column is NULL throughout, or has one value and no NULL, is counted
    from its footer; of the others feed, load and column are read, the column as dictionary
    indexes, so that values are handled once per chunk.
    """

    def footer_counts(stats: dict) -> pd.DataFrame | None:
        one = [s.low if s.low is not None and s.low == s.high and s.nulls == 0 else None for s in (stats[feed], stats[load])]
        own = stats[column]
        whole = own.nulls == own.rows or (own.nulls == 0 and own.low is not None and own.low == own.high)
        if None in one or own.nulls is None or not whole:
            return None
        value = None if own.nulls == own.rows else own.low
        return pd.DataFrame({"feed": [one[0]], "load_no": [one[1]], "value": [value.decode() if isinstance(value, bytes) else value], "n": [own.rows]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, groups in zip(batch["path"], batch["groups"]):
                with open_file(name) as source:
                    file = pq.ParquetFile(source, read_dictionary=[column])
                    for group in groups:
                        stats = {s.column: s for s in footer_stats(file.metadata, [column, feed, load], [int(group)])}
                        known = footer_counts(stats)
                        if known is not None:
                            yield known
                            continue
                        table = file.read_row_group(int(group), columns=[feed, load, column]).combine_chunks()
                        coded = table.column(column)
                        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
                        if not pa.types.is_dictionary(coded.type):
                            coded = pc.dictionary_encode(coded)
                        index = pc.fill_null(coded.indices, -1)
                        frame = pa.table({"feed": table.column(feed), "load_no": table.column(load), "code": index})
                        summed = frame.group_by(["feed", "load_no", "code"]).aggregate([([], "count_all")]).to_pandas()
                        values = np.array([*coded.dictionary.to_pylist(), None], dtype=object)
                        yield pd.DataFrame({"feed": summed["feed"], "load_no": summed["load_no"], "value": values[summed["code"].to_numpy()], "n": summed["count_all"]})

    return spans(spark, path, [column, feed, load]).mapInPandas(count, "feed bigint, load_no bigint, value string, n bigint")


def value_counts(spark: SparkSession, path: str, column: str, feed: str = "feed", load: str = "load_no") -> DataFrame:
    """(feed, load_no, value, n): rows per load and value, NULL values included."""
    return _chunk_counts(spark, path, column, feed, load).groupBy("feed", "load_no", "value").agg(F.sum("n").alias("n"))


def load_profile(counts: DataFrame) -> DataFrame:
    """(feed, load_no, value, n, blank, ok): value_counts judged once per load and value."""

    @F.pandas_udf("boolean")
    def formed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v is not None and well_formed(v)).astype(bool)

    @F.pandas_udf("boolean")
    def blank(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v is None or not v.strip()).astype(bool)

    return counts.withColumn("blank", blank("value")).withColumn("ok", formed("value"))


def load_findings(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(feed, load_no, finding) by the limits above, for each value of `keys`.

    Loads of under MIN_ROWS rows are not judged, nor compared with; `nulls`, `distinct` and
    `shift` need the load before (load_no - 1 of the feed) and values that are not blank in both.
    NULL feeds or load numbers belong to no load.
    """
    # Judged once per load and value, and kept: the counts of loads and the shares of values both use it.
    judged = cut(load_profile(counts.where("feed is not null and load_no is not null")))
    of_feed = [*keys, "feed"]
    of_load = [*of_feed, "load_no"]
    loads = judged.groupBy(*of_load).agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blanks"),
        F.sum(F.when(~F.col("blank") & ~F.col("ok"), F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(~F.col("blank"), 1).otherwise(0)).alias("distinct_values"),
    ).where(F.col("rows") >= MIN_ROWS)
    share = judged.where("not blank").join(loads.select(*of_load, "rows", "blanks"), of_load).select(
        *of_load, "value", (F.col("n") / (F.col("rows") - F.col("blanks"))).alias("p")
    )
    # A load's shares count for itself and, with the other sign, for the load after it.
    moved = (
        share.select(*of_feed, F.explode(F.array(F.struct("load_no", F.col("p").alias("d")), F.struct((F.col("load_no") + 1).alias("load_no"), (-F.col("p")).alias("d")))).alias("s"), "value")
        .groupBy(*of_feed, "s.load_no", "value")
        .agg(F.sum("s.d").alias("d"))
        .groupBy(*of_load)
        .agg((F.sum(F.abs("d")) / 2).alias("shift"))
    )
    before = loads.select(*of_feed, (F.col("load_no") + 1).alias("load_no"), F.col("rows").alias("rows0"), F.col("blanks").alias("blanks0"), F.col("distinct_values").alias("distinct0"))
    both = loads.join(before, of_load, "left").join(moved, of_load, "left")
    filled = F.col("rows") - F.col("blanks")
    compared = F.coalesce((filled > 0) & (F.col("rows0") - F.col("blanks0") > 0), F.lit(False))
    tests = {
        "pattern": (filled > 0) & (F.col("bad") / F.nullif(filled, F.lit(0)) > PATTERN_SHARE),
        "nulls": compared & (F.col("blanks") / F.col("rows") - F.col("blanks0") / F.col("rows0") > NULL_RISE),
        "distinct": compared & ((F.col("distinct_values") * DISTINCT_FACTOR < F.col("distinct0")) | (F.col("distinct_values") > F.col("distinct0") * DISTINCT_FACTOR)),
        "shift": compared & (F.col("shift") > SHIFT),
    }
    findings = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return both.select(*of_load, F.explode(findings).alias("finding"))


def table_findings(spark: SparkSession, paths: dict[tuple[str, str], str]) -> DataFrame:
    """(table_name, column_name, feed, load_no, finding) for (table, column) -> Parquet path."""
    keys = ("table_name", "column_name")
    parts = [_chunk_counts(spark, path, column).select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "*") for (table, column), path in paths.items()]
    counts = reduce(DataFrame.unionByName, parts).groupBy(*keys, "feed", "load_no", "value").agg(F.sum("n").alias("n"))
    return load_findings(counts, keys).select(*keys, "feed", "load_no", "finding")


def profile(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """One row per column: rows, nulls, null_rate, distinct_count, low, high, malformed,
    chunks_footer (chunks whose nulls and extrema came from the footer), chunks_scanned.

    `columns` maps each column to its rule for malformed values: `name` (well_formed), `text`
    (non-blank) or `any`. Values are compared as text for distinct counts; low and high are the
    text of the typed extrema. Distinct counts are exact where writers enter into a dictionary only
    values that they meet: dictionaries give the candidates of a chunk, other chunks their scanned values, and the candidates of all chunks are combined by a
    shuffle on the value. A column that a file lacks is skipped there; no rows give no row.
    """
    names = list(columns)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, groups in zip(batch["path"], batch["groups"]):
                with open_file(name) as source:
                    file = pq.ParquetFile(source)
                    for s in footer_stats(file.metadata, names, [int(g) for g in groups]):
                        known = dictionary_values(source, file.metadata, s.row_group, s.column)
                        enough = s.nulls is not None and (s.nulls == s.rows or s.low is not None)
                        nulls, low, high, scanned = s.nulls, s.low, s.high, not (enough and known is not None)
                        if scanned:
                            data = file.read_row_group(s.row_group, columns=[s.column]).column(0)
                            nulls = data.null_count
                            ends = pc.min_max(data)
                            low, high = ends["min"].as_py(), ends["max"].as_py()
                            known = pc.unique(data).drop_null().to_pylist()
                        text = [str(v) for v in known]
                        yield pd.DataFrame(
                            {
                                "column_name": s.column,
                                "kind": ["chunk", *["value"] * len(text)],
                                "value": [None, *text],
                                "rows": [s.rows, *[0] * len(text)],
                                "nulls": [nulls, *[0] * len(text)],
                                "low": [None if low is None else str(low), *[None] * len(text)],
                                "high": [None if high is None else str(high), *[None] * len(text)],
                                "numeric": not isinstance(low, (str, bytes, type(None))) and hasattr(low, "__float__"),
                                "scanned": [int(scanned), *[0] * len(text)],
                            }
                        )

    # Kept, so that a chunk is looked at once for its sizes and its values.
    found = cut(
        spans(spark, path, names).mapInPandas(
            look, "column_name string, kind string, value string, rows bigint, nulls bigint, low string, high string, numeric boolean, scanned int"
        )
    )

    @F.pandas_udf("boolean")
    def malformed(column: pd.Series, values: pd.Series) -> pd.Series:
        test = {"name": lambda v: not well_formed(v), "text": lambda v: not v.strip() or v != v.strip(), "any": lambda v: False}
        return pd.Series([v is not None and test[columns[c]](v) for c, v in zip(column, values)], dtype=bool)

    number = lambda c: F.when(F.col("numeric"), F.expr(f"try_cast({c} AS double)"))
    sizes = found.where("kind = 'chunk'").groupBy("column_name").agg(
        F.sum("rows").alias("row_count"),
        F.sum("nulls").alias("null_count"),
        F.coalesce(F.min_by("low", number("low")), F.min("low")).alias("low"),
        F.coalesce(F.max_by("high", number("high")), F.max("high")).alias("high"),
        F.sum(1 - F.col("scanned")).alias("chunks_footer"),
        F.sum("scanned").alias("chunks_scanned"),
    )
    values = found.where("kind = 'value'").groupBy("column_name", "value").agg(F.lit(1).alias("one"))
    distinct = values.withColumn("bad", malformed("column_name", "value")).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_count"), F.sum(F.col("bad").cast("bigint")).alias("malformed_values")
    )
    return sizes.join(distinct, "column_name", "left").select(
        "column_name",
        "row_count",
        "null_count",
        (F.col("null_count") / F.col("row_count")).alias("null_rate"),
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
        "low",
        "high",
        F.coalesce("malformed_values", F.lit(0)).alias("malformed_values"),
        "chunks_footer",
        "chunks_scanned",
    )
