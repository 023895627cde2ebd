import gzip
import json
import os

import pytest

from graphloom import model
from graphloom.operators import project
from graphloom.plans import loading
from graphloom.plans.mapping import auto_map
from graphloom.sources import databases, files
from graphloom.sources.files import DelimitedFolder
from graphloom.sources.store import GraphStore


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "dumps"
    d.mkdir()
    (d / "users.csv").write_text('id,name,email,age,active\n1,"A, b",a@x,30,true\n2,"Line\nbreak",,,false\n')
    (d / "orders.tsv").write_text("order_id\tuser_id\tcreated_at\n1\t1\t2024-01-01\n1\t2\t2024-03-01\n")
    (d / "empty.txt").write_text("id,x\n")
    with gzip.open(d / "codes.csv.gz", "wt") as f:
        f.write("code_id,label\n007,x\n008,y\n")
    (d / "notes.md").write_text("no table")
    return d


def test_delimited_folder(spark, folder):
    source = DelimitedFolder(spark, str(folder))
    assert set(source.tables()) == {"users", "orders", "empty", "codes"}
    users = source.rows("users")
    assert dict(users.dtypes) == {"id": "int", "name": "string", "email": "string", "age": "int", "active": "boolean"}
    assert {r.name: r.email for r in users.collect()} == {"A, b": "a@x", "Line\nbreak": None}
    assert source.rows("codes", typed=False).first()["code_id"] == "007"
    assert source.count("orders") == 2 and source.rows("orders", since_value="2024-02-01").count() == 1 and source.preview("users", 1).count() == 1
    schema = source.schema()
    assert {n: t.primary_key for n, t in schema.tables.items()} == {"users": ["id"], "orders": [], "empty": ["id"], "codes": ["code_id"]}


def test_types_are_inferred_once(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,d,code\n1,2024-01-01,007\n2,,008\n")
    source = DelimitedFolder(spark, str(tmp_path), multi_line=False)
    first, again = source.rows("t"), source.rows("t")
    assert first.dtypes == again.dtypes and [tuple(r) for r in first.collect()] == [tuple(r) for r in again.collect()] and len(source._types) == 1
    path.write_text("id,d\nx,1.5\n")
    os.utime(path, (1, 1))
    assert source.rows("t").dtypes == [("id", "string"), ("d", "double")]


def test_no_header_and_base(spark, folder):
    assert DelimitedFolder(spark, str(folder), header=False).rows("users").columns[:2] == ["0", "1"]
    DelimitedFolder(spark, str(folder), base=str(folder.parent))
    with pytest.raises(files.OutsideBase):
        DelimitedFolder(spark, str(folder) + "/..", base=str(folder))
    with pytest.raises(FileNotFoundError):
        DelimitedFolder(spark, str(folder / "nope")).tables()


def test_folder_to_graph_to_files(spark, folder, tmp_path):
    source = DelimitedFolder(spark, str(folder))
    schema = model.Schema({n: t for n, t in source.schema().tables.items() if n in ("users", "orders")})
    schema.tables["orders"].primary_key = ["order_id", "user_id"]
    schema.tables["orders"].foreign_keys = [model.ForeignKey(["user_id"], "users", ["id"])]
    graph = project.build_graph(schema, auto_map(schema), source.rows)
    files.write_graph(graph, str(tmp_path / "out"))
    texts = [json.loads(x) for p in (tmp_path / "out/users").glob("*.json") for x in p.read_text().splitlines()]
    assert {d["_key"]: d["email"] for d in texts} == {"1": "a@x", "2": None}
    assert spark.read.json(str(tmp_path / "out/orders_to_users")).count() == 2
    files.dump_table(graph.vertices["users"], str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "csv")).count() == 2


def test_dead_letters(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "5")], "id int, n string")
    table = model.Table("t", [model.Column("id", "int", False, True), model.Column("n", "int")], ["id"])
    bad = project.rejects(df, table, model.CollectionMapping("t", "t"))
    path = str(tmp_path / "dlq")
    files.record_failures(bad, path, "load1")
    files.record_failures(bad, path, "load1")
    assert files.list_failures(path) == ["load1"] and files.list_failures(path + "x") == []
    assert files.read_failures(spark, path, "load1").count() == 2 and files.read_failures(spark, path, "load1", 1, 1).first()["raw"] == "x"


def test_catalog_rows_to_schema():
    columns = [("users", "id", "integer", "NO"), ("users", "ok", "bit", "YES"), ("e", "a", "integer", "NO"), ("e", "b", "integer", "NO"), ("e1", "a", "integer", "NO")]
    keys = [("users", "id"), ("e", "b"), ("e", "a")]
    refs = [("e1", "fk1", "a", "p", "x"), ("e1", "fk1", "b", "p", "y"), ("gone", "f", "a", "p", "x")]
    schema = databases.build_schema("sqlserver", columns, keys, refs, [("e1", "e")])
    assert schema.tables["e"].primary_key == ["b", "a"] and schema.tables["users"].column("ok").data_type == "boolean" and not schema.tables["users"].column("id").is_nullable
    assert schema.tables["e"].foreign_keys[0].columns == ["a", "b"] and schema.tables["e1"].partition_of == "e" and schema.tables["e"].is_partitioned
    house = databases.build_schema("clickhouse", [("t", "a", "Nullable(UInt8)", "YES"), ("t", "b", "LowCardinality(String)", "YES")], [("t", "b")], [])
    assert [(c.data_type, c.is_nullable) for c in house.tables["t"].columns] == [("UInt8", True), ("String", False)]


def test_topic_schemas():
    avro = {"type": "record", "name": "u", "fields": [{"name": "id", "type": "long"}, {"name": "at", "type": ["null", {"type": "long", "logicalType": "timestamp-millis"}]}, {"name": "d", "type": {"type": "bytes", "logicalType": "decimal"}}, {"name": "m", "type": {"type": "map", "values": "int"}}, {"name": "s", "type": "string"}]}
    t = databases.topic_table("users", json.dumps(avro))
    assert [(c.name, c.data_type, c.is_nullable) for c in t.columns] == [("id", "integer", False), ("at", "timestamp", True), ("d", "double precision", False), ("m", "object", False), ("s", "text", False)]
    t = databases.topic_table("t", json.dumps({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": ["null", "number"]}, "c": {}}}))
    assert [(c.data_type, c.is_nullable) for c in t.columns] == [("integer", False), ("double precision", True), ("text", True)]
    assert databases.topic_table("t", '"string"').names == ["value"]
    with pytest.raises(ValueError):
        databases.topic_table("t", "{")


def test_factory(spark, folder, monkeypatch):
    monkeypatch.setenv("DUMPS", str(folder))
    assert isinstance(databases.create_source(spark, "csv", "$DUMPS"), DelimitedFolder) and databases.create_source(spark, "csv", "$DUMPS").count("users") == 2
    assert databases.create_source(spark, "postgresql", "jdbc:postgresql://h/$DUMPS").url.endswith(str(folder))
    with pytest.raises(ValueError):
        databases.create_source(spark, "odd", "x")


def test_key_holds_in_the_whole_file(spark, tmp_path):
    numbers = [*range(1500), 3, 4]
    (tmp_path / "t.csv").write_text("id,t_id,x\n" + "".join(f"{n},{i},v{i}\n" for i, n in enumerate(numbers)))
    (tmp_path / "late.csv").write_text("id,x\n" + "".join(f"{n if n < 1200 else ''},v\n" for n in range(1300)))
    source = DelimitedFolder(spark, str(tmp_path))
    schema = source.schema()
    assert schema.tables["t"].primary_key == ["t_id"] and schema.tables["late"].primary_key == []
    store = GraphStore(spark, str(tmp_path / "store"), buckets=2)
    done = loading.load_graph(store, schema, auto_map(schema), source.rows)
    assert done.errors == {} and done.documents == {"t": len(numbers), "late": 1300}
    assert store.documents("t").count() == len(numbers) and store.documents("late").count() == 1300


def test_snowflake_keys_come_from_show(spark, monkeypatch):
    asked = []
    answers = {
        "information_schema": [("users", "id", "NUMBER", "NO"), ("orders", "id", "NUMBER", "NO"), ("orders", "user_id", "NUMBER", "YES")],
        "key_sequence": [("users", "id"), ("orders", "id")],
        "fk_name": [("orders", "fk1", "user_id", "users", "id")],
    }

    def read(self, **options):
        asked.append(options)
        found = next(v for k, v in reversed(answers.items()) if k in options["query"])
        return spark.createDataFrame(found, ", ".join(f"c{i} string" for i in range(len(found[0]))))

    monkeypatch.setattr(databases.Database, "_read", read)
    schema = databases.create_source(spark, "snowflake", "jdbc:snowflake://h/?db=d", "shop").schema()
    assert {n: t.primary_key for n, t in schema.tables.items()} == {"users": ["id"], "orders": ["id"]}
    assert [(fk.columns, fk.foreign_table, fk.foreign_columns) for fk in schema.tables["orders"].foreign_keys] == [(["user_id"], "users", ["id"])]
    assert "sessionInitStatement" not in asked[0] and "BASE TABLE" in asked[0]["query"]
    assert [o["sessionInitStatement"] for o in asked[1:]] == ["SHOW PRIMARY KEYS IN SCHEMA shop", "SHOW IMPORTED KEYS IN SCHEMA shop"]


def test_topics_have_tables_by_their_schemas(spark):
    text = json.dumps({"type": "record", "name": "u", "fields": [{"name": "id", "type": "long"}]})
    topics = databases.create_source(spark, "kafka", "broker:9092", params={"schemas": {"users": text}})
    assert isinstance(topics, databases.Topics) and topics.schema().tables["users"].names == ["id"]
