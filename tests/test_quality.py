import datetime
import itertools

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from graphloom.operators import quality
from graphloom.sources.parquet_stats import dictionary_values, footer_stats


@pytest.mark.parametrize("value, ok", [("Ultonia", True), ("St. Al-Mo's", True), ("Öresta", True), ("ul", False), ("Ul", False), ("ultonia", False), ("Ul  to", False), ("Ulto ", False), (" Ulto", False), ("Ult0", False), ("Ult o", False), ("-Ulto", False), ("", False)])
def test_well_formed(value, ok):
    assert quality.well_formed(value) is ok


def write(path, loads, **options):
    rows = [(f, n, v) for (f, n), values in loads.items() for v in values]
    table = pa.table({"feed": pa.array([r[0] for r in rows], pa.int64()), "load_no": pa.array([r[1] for r in rows], pa.int32()), "city": pa.array([r[2] for r in rows], pa.string()), "n": pa.array([1] * len(rows), pa.int64())})
    pq.write_table(table, path, **options)
    return str(path)


def loads():
    good = ["Alba", "Bree", "Corda", "Delft"]
    many = [f"Name{chr(97 + i)}{chr(97 + j)}" for i, j in itertools.product(range(5), range(4))]
    return {
        (1, 1): good * 10,
        (1, 2): good * 8 + [None] * 5 + ["  "] * 5,
        (1, 3): ["x"] * 5 + good * 9,
        (1, 4): many * 2,
        (1, 5): good[:1] * 29,
        (1, 6): good * 10,
        (2, 1): [None] * 40,
        (2, 2): good * 10,
        (2, 3): ["Alba"] * 40,
        (3, 1): ["bad "] * 31,
    }


WANT = {(1, 2, "nulls"), (1, 3, "pattern"), (1, 4, "distinct"), (1, 4, "shift"), (2, 3, "distinct"), (2, 3, "shift"), (3, 1, "pattern")}


@pytest.mark.parametrize("options", [{}, {"row_group_size": 40}, {"use_dictionary": False, "row_group_size": 17}, {"compression": "zstd", "data_page_version": "2.0", "row_group_size": 100}])
def test_findings(spark, tmp_path, options):
    path = write(tmp_path / "t.parquet", loads(), **options)
    counts = quality.value_counts(spark, path, "city")
    assert counts.agg({"n": "sum"}).first()[0] == sum(map(len, loads().values()))
    assert {tuple(r) for r in quality.load_findings(counts).collect()} == WANT


def test_folder_of_files_and_empty(spark, tmp_path):
    folder = tmp_path / "t.parquet"
    folder.mkdir()
    items = list(loads().items())
    for i in range(0, len(items), 3):
        write(folder / f"p{i}.parquet", dict(items[i : i + 3]))
    assert {tuple(r) for r in quality.load_findings(quality.value_counts(spark, str(folder), "city")).collect()} == WANT
    empty = write(tmp_path / "e.parquet", {})
    assert quality.load_findings(quality.value_counts(spark, empty, "city")).count() == 0


def test_rows_of_no_load(spark, tmp_path):
    table = pa.table({"feed": pa.array([1] * 40 + [None] * 40, pa.int64()), "load_no": pa.array([1] * 20 + [None] * 20 + [1] * 40, pa.int32()), "city": ["x", None] * 40, "value": ["clash"] * 80})
    pq.write_table(table, tmp_path / "t.parquet")
    counts = quality.value_counts(spark, str(tmp_path / "t.parquet"), "city")
    assert sorted((str(r.feed), str(r.load_no), str(r.value), r.n) for r in counts.collect()) == [
        ("1", "1", "None", 10), ("1", "1", "x", 10), ("1", "None", "None", 10), ("1", "None", "x", 10), ("None", "1", "None", 20), ("None", "1", "x", 20),
    ]
    assert quality.load_findings(counts).count() == 0


def test_one_value_chunks_are_counted_from_the_footer(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "t.parquet", {(1, 1): ["Alba"] * 50, (1, 2): [None] * 50}, row_group_size=50)
    rows = {(r.feed, r.load_no, r.value, r.n) for r in quality.value_counts(spark, path, "city").collect()}
    assert rows == {(1, 1, "Alba", 50), (1, 2, None, 50)}


def test_dictionary_pages(tmp_path):
    path = write(tmp_path / "t.parquet", loads(), row_group_size=60)
    meta = pq.ParquetFile(path).metadata
    table = pq.read_table(path)
    with pa.OSFile(path) as source:
        for group in range(meta.num_row_groups):
            part = pq.ParquetFile(path).read_row_group(group, columns=["city"])["city"]
            assert set(dictionary_values(source, meta, group, "city")) == set(part.drop_null().to_pylist())
        assert dictionary_values(source, meta, 0, "n") is None
    assert sum(s.nulls for s in footer_stats(meta, ["city"])) == table["city"].null_count
    plain = write(tmp_path / "p.parquet", loads(), use_dictionary=False)
    with pa.OSFile(plain) as source:
        assert dictionary_values(source, pq.ParquetFile(plain).metadata, 0, "city") is None


def test_profile(spark, tmp_path):
    table = pa.table({"city": ["Alba", None, "alba", "Alba", " x"], "n": pa.array([5, 12, None, 7, 7], pa.int64()), "d": [datetime.date(2024, 1, i + 1) for i in range(5)], "blank": pa.array([None] * 5, pa.string())})
    pq.write_table(table, tmp_path / "t.parquet", row_group_size=2)
    out = {r.column_name: r for r in quality.profile(spark, str(tmp_path / "t.parquet"), {"city": "name", "n": "any", "d": "any", "blank": "text", "absent": "any"}).collect()}
    assert set(out) == {"city", "n", "d", "blank"}
    c, n = out["city"], out["n"]
    assert (c.row_count, c.null_count, c.distinct_count, c.malformed_values, c.low, c.high) == (5, 1, 3, 2, " x", "alba")
    assert (n.null_count, n.distinct_count, n.low, n.high) == (1, 3, "5", "12")
    assert (out["d"].low, out["d"].high) == ("2024-01-01", "2024-01-05")
    assert (out["blank"].null_rate, out["blank"].distinct_count, out["blank"].low) == (1.0, 0, None)
    assert c.chunks_footer == 3 and c.chunks_scanned == 0
