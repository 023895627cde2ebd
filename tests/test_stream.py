"""Change logs applied batch by batch: replay, order, edges that move, and a file stream."""

import copy
import itertools
import json

import pytest

from graphloom import model
from graphloom.plans.mapping import auto_map
from graphloom.sources.store import GraphStore
from graphloom.streaming import apply, changelog

USERS = model.Table("users", [model.Column("id", "integer", False, True), model.Column("name", "text")], ["id"])
ORDERS = model.Table("orders", [model.Column("id", "integer", False, True), model.Column("user_id", "integer"), model.Column("total", "numeric")], ["id"], [model.ForeignKey(["user_id"], "users", ["id"])])
SCHEMA = model.Schema({"users": USERS, "orders": ORDERS})
CONFIG = auto_map(SCHEMA)

EVENTS = [
    {"operation": "INSERT", "table_name": "users", "new_row": {"id": 1, "name": "a"}, "lsn": "0/9"},
    {"operation": "INSERT", "table_name": "orders", "new_row": {"id": 10, "user_id": 1, "total": "5.5"}, "lsn": "0/A"},
    {"operation": "UPDATE", "table_name": "orders", "new_row": {"id": 10, "user_id": 2, "total": 6}, "old_row": {"id": 10, "user_id": 1}, "lsn": "0/10"},
    {"operation": "UPDATE", "table_name": "users", "new_row": {"id": 1, "name": "b"}, "lsn": "0/16"},
    {"operation": "INSERT", "table_name": "orders", "new_row": {"id": 11, "user_id": 1, "total": 1}, "lsn": "0/17"},
    {"operation": "UPDATE", "table_name": "orders", "new_row": {"id": 11, "user_id": None, "total": 1}, "old_row": {"id": 11, "user_id": 1}, "lsn": "0/18"},
    {"operation": "INSERT", "table_name": "orders", "new_row": {"id": 12, "user_id": 1, "total": None}, "lsn": "0/19"},
    {"operation": "DELETE", "table_name": "orders", "old_row": {"id": 12, "user_id": 1}, "lsn": "0/20"},
    {"operation": "INSERT", "table_name": "nowhere", "new_row": {"id": 1}, "lsn": "0/21"},
]
ORDERS_END, EDGES_END = {("10", 2, 6.0), ("11", None, 1.0)}, {("10_2", "orders/10", "users/2")}


def events(spark, some):
    return changelog.parse_flat(spark.createDataFrame([(json.dumps(e),) for e in some], "value string"))


def state(store):
    orders = {(r._key, r.user_id, r.total) for r in store.documents("orders").collect()}
    edges = {(r._key, r._from, r._to) for r in store.documents("orders_to_users").collect()}
    return orders, edges, {r.name for r in store.documents("users").collect()}


@pytest.mark.parametrize("split", [[EVENTS], [EVENTS[5:], EVENTS[:5]], [EVENTS[::2], EVENTS[1::2], EVENTS]])
def test_any_batches_give_the_same_graph(spark, tmp_path, split):
    store = GraphStore(spark, str(tmp_path / "graph"), buckets=4)
    for batch in split:
        apply.apply_events(store, events(spark, batch), SCHEMA, CONFIG)
    assert state(store) == (ORDERS_END, EDGES_END, {"b"})
    assert store.collections() == ["orders", "orders_to_users", "users"]


def test_a_batch_counts_once(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"), buckets=4)
    first = apply.apply_events(store, events(spark, EVENTS), SCHEMA, CONFIG, batch=3)
    assert first["orders"] == 6 and apply.apply_events(store, events(spark, EVENTS), SCHEMA, CONFIG, batch=3) == {}
    assert store.manifest("orders")["version"] == 1


def test_old_edges_stay_in_compatible_mode(spark):
    ready = apply.sequenced(events(spark, EVENTS))
    old = {(r.op, r._key) for r in apply.edge_changes(ready, CONFIG.edges[0], ORDERS, CONFIG, reference_compat=True).collect()}
    new = {(r.op, r._key) for r in apply.edge_changes(ready, CONFIG.edges[0], ORDERS, CONFIG).collect()}
    assert new - old == {("DELETE", "10_1"), ("DELETE", "11_1")}


def test_file_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, e in enumerate(itertools.chain(EVENTS[4:], EVENTS[:4])):
        (source / f"{i}.txt").write_text(json.dumps(e) + "\n")
    lines = spark.readStream.option("maxFilesPerTrigger", 3).text(str(source))
    store = GraphStore(spark, str(tmp_path / "graph"), buckets=2)
    query = apply.run_stream(lines, "flat", store, SCHEMA, CONFIG, str(tmp_path / "ckpt"))
    query.awaitTermination(240)
    query.stop()
    assert state(store) == (ORDERS_END, EDGES_END, {"b"})


def test_store_replace_rename_drop_and_graph(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"), buckets=2)
    store.replace("a", spark.createDataFrame([("1", 5), ("2", 6)], "_key string, v int"))
    store.replace("a", spark.createDataFrame([("3", 7)], "_key string, v int"))
    assert [tuple(r)[:2] for r in store.documents("a").select("_key", "v").collect()] == [("3", 7)]
    store.rename("a", "b")
    assert store.documents("b").count() == 1 and store.documents("a") is None
    store.write_graph("g", CONFIG.graph_definition())
    assert store.graph("g")["edge_definitions"][0]["edge_collection"] == "orders_to_users" and store.graph("h") is None
    store.drop("b")
    assert store.documents("b") is None


def wal(kind, table, row, old=None):
    entry = {"kind": kind, "schema": "public", "table": table}
    if row:
        entry |= {"columnnames": list(row), "columnvalues": list(row.values())}
    return entry | ({"oldkeys": {"keynames": list(old), "keyvalues": list(old.values())}} if old else {})


def large_transaction(lsn):
    changes = [wal("insert", "users", {"id": 1000 + i, "name": "x"}) for i in range(1100)]
    changes += [wal("insert", "users", {"id": 1, "name": "old"}), wal("delete", "users", None, {"id": 1}), wal("insert", "users", {"id": 1, "name": "again"})]
    changes += [wal("insert", "users", {"id": 2, "name": "Y"}), wal("update", "users", {"id": 2, "name": "Z"}), wal("update", "users", {"id": 2, "name": "A"})]
    changes += [wal("insert", "users", {"id": 3, "name": "gone"}), wal("delete", "users", None, {"id": 3})]
    return json.dumps({"xid": 7, "nextlsn": lsn, "change": changes})


@pytest.mark.parametrize("policy", ["source_wins", "log_and_skip"])
def test_large_transaction_keeps_its_order(spark, tmp_path, policy):
    store = GraphStore(spark, str(tmp_path / "graph"), buckets=3)
    apply.apply_events(store, events(spark, [EVENTS[0], EVENTS[3]]), SCHEMA, CONFIG)  # buckets with whole sequences only
    before = changelog.parse_wal2json(spark.createDataFrame([(large_transaction("0/8"),)], "value string"))
    log = changelog.parse_wal2json(spark.createDataFrame([(large_transaction("FF/30"),)], "value string"))
    names = lambda: {r._key: r.name for r in store.documents("users").collect() if int(r._key) < 1000}
    apply.apply_events(store, before, SCHEMA, CONFIG)
    assert names() == {"1": "b", "2": "A"}
    for _ in range(2):
        apply.apply_events(store, log, SCHEMA, CONFIG, policy)
        assert names() == {"1": "again", "2": "A"} and store.documents("users").count() == 1102
    apply.apply_events(store, events(spark, [{**EVENTS[3], "lsn": "FF/31"}]), SCHEMA, CONFIG)
    assert names() == {"1": "b", "2": "A"}
    assert {r._seq for r in store.state("users").where("_key = '1'").collect()} == {0xFF00000031 * 1024}


def test_versions_of_a_large_transaction(spark):
    from pyspark.sql import functions as F

    from graphloom.operators import temporal

    log = apply.sequenced(changelog.parse_wal2json(spark.createDataFrame([(large_transaction("FF/30"),)], "value string")))
    changes = apply.vertex_changes(log, USERS, CONFIG.collections["users"], CONFIG).withColumn("ts", F.lit(5))
    found = [(r._version, r.name) for r in temporal.versions_from_log(changes.where("_key = '2'")).orderBy("_version").collect()]
    assert found == [(0, "Y"), (1, "Z"), (2, "A")]
    assert log.agg(F.max("seq")).first()[0] % 1 * 10**10 == 1107


def changes(spark, rows):
    return spark.createDataFrame(rows, "_key string, op string, seq bigint, v string")


def test_a_load_keeps_sequences_and_tombstones(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"), buckets=3)
    store.merge("a", changes(spark, [("1", "INSERT", 10, "new"), ("2", "INSERT", 10, "x"), ("2", "DELETE", 11, None), ("3", "DELETE", 12, None)]))
    store.load("a", spark.createDataFrame([("1", "loaded"), ("3", "back"), ("4", "fresh")], "_key string, v string"))
    live = lambda: {r._key: r.v for r in store.documents("a").collect()}
    assert live() == {"1": "loaded", "3": "back", "4": "fresh"}
    store.merge("a", changes(spark, [("1", "INSERT", 3, "older"), ("2", "INSERT", 3, "older"), ("3", "INSERT", 3, "older"), ("4", "INSERT", 1, "first")]))
    assert live() == {"1": "loaded", "3": "back", "4": "first"}
    store.load("a", spark.createDataFrame([("1", "at 5"), ("2", "at 5"), ("5", "at 5")], "_key string, v string"), sequence=5)
    assert live() == {"1": "loaded", "3": "back", "4": "first", "5": "at 5"}
    store.merge("a", changes(spark, [("5", "DELETE", 4, None), ("5", "REPLACE", 6, "later")]))
    assert live()["5"] == "later"


def test_rename_moves_the_data(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"), buckets=2)
    store.merge("a", changes(spark, [("1", "INSERT", 10, "x"), ("2", "DELETE", 10, None)]))
    store.rename("a", "b")
    store.replace("a", spark.createDataFrame([("9", "other")], "_key string, v string"))
    with pytest.raises(ValueError):
        store.rename("a", "b")
    store.drop("a")
    store.merge("b", changes(spark, [("1", "INSERT", 3, "older"), ("2", "INSERT", 3, "older")]))
    assert [(r._key, r.v) for r in store.documents("b").collect()] == [("1", "x")] and store.documents("a") is None


def test_a_lost_commit_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, str(tmp_path / "graph"), buckets=2)
    store.merge("a", changes(spark, [("1", "INSERT", 1, "x")]))

    def lost(name, data):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(store, "_write", lost)
        with pytest.raises(OSError):
            store.merge("a", changes(spark, [("1", "REPLACE", 2, "y")]))
    (tmp_path / "graph" / "a" / "manifest.0123abc-new").write_text("{")
    assert [(r._key, r.v) for r in store.documents("a").collect()] == [("1", "x")]
    store.merge("a", changes(spark, [("1", "REPLACE", 2, "y")]))
    assert [(r._key, r.v) for r in store.documents("a").collect()] == [("1", "y")]
    assert store.vacuum("a") == 1 and store.documents("a").count() == 1


def test_deltas_are_merged_and_compacted(spark, tmp_path, monkeypatch):
    from graphloom.sources import store as module

    monkeypatch.setattr(module, "MAX_DELTAS", 2)
    store = GraphStore(spark, str(tmp_path / "graph"), buckets=2)
    wanted, seen = {}, []
    for i in range(5):
        store.merge("a", changes(spark, [(str(k), "DELETE" if (k + i) % 5 == 0 else "REPLACE", 10 * i + k % 3, f"{i}-{k}") for k in range(i, 20)]))
        for k in range(i, 20):
            wanted[str(k)] = None if (k + i) % 5 == 0 else f"{i}-{k}"
        seen.append(len(store.manifest("a")["deltas"]))
        assert {r._key: r.v for r in store.documents("a").collect()} == {k: v for k, v in wanted.items() if v}
    assert seen == [0, 1, 2, 0, 1]
    store.merge("a", changes(spark, [("0", "INSERT", 99, "skipped"), ("77", "INSERT", 99, "in")]), "log_and_skip")
    assert store.manifest("a")["deltas"] == [] and store.documents("a").where("_key = '77'").count() == 1
    store.merge("a", spark.createDataFrame([("77", "REPLACE", 100, 5)], "_key string, op string, seq bigint, w int"))
    assert [(r.v, r.w) for r in store.documents("a").where("_key = '77'").collect()] == [("in", 5)]


def test_applied_batches_are_all_remembered(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"))
    for i in [*range(30), 40, "x"]:
        store.note_batch(i)
    assert all(store.has_batch(i) for i in [*range(30), 40, "x"]) and not any(store.has_batch(i) for i in (30, 41, "y"))
    assert store._batches() == {"before": 30, "done": ["40", "x"]}


def test_failed_changes_go_to_dead_letters(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, str(tmp_path / "graph"), buckets=2)
    merge_, seen = store.merge, []

    def failing(collection, changes, policy):
        if collection == "orders":
            raise OSError("disk full")
        return merge_(collection, changes, policy)

    monkeypatch.setattr(store, "merge", failing)
    with pytest.raises(OSError):
        apply.apply_events(store, events(spark, EVENTS), SCHEMA, CONFIG, batch=1)
    assert not store.has_batch(1)
    stats = apply.apply_batch(store, events(spark, EVENTS), SCHEMA, CONFIG, batch=2, dead_letters=apply.dead_letter_folder(str(tmp_path / "dead")))
    assert stats.failed == {"orders": 6} and set(stats.applied) == {"users", "orders_to_users"} and stats.events == len(EVENTS) and store.has_batch(2)
    lost = spark.read.json(str(tmp_path / "dead")).collect()
    assert len(lost) == 6 and {r.collection for r in lost} == {"orders"} and {r.error for r in lost} == {"disk full"} and {r.batch for r in lost} == {"2"}


def test_governed_stream_with_statistics(spark, tmp_path):
    from graphloom import model
    from graphloom.plans import governance

    schema = copy.deepcopy(SCHEMA)
    governance.annotate(schema, {"users": {"name": model.Classification(["PII.Sensitive"])}})
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("".join(json.dumps(e) + "\n" for e in EVENTS))
    store, told = GraphStore(spark, str(tmp_path / "graph"), buckets=2), []
    query = apply.run_stream(spark.readStream.text(str(source)), "flat", store, schema, CONFIG, str(tmp_path / "ckpt"), threshold="confidential", on_stats=lambda n, s: told.append((n, s.events)))
    query.awaitTermination(240)
    query.stop()
    assert "name" not in store.documents("users").columns and "total" in store.documents("orders").columns and told == [(0, len(EVENTS))]


def test_landed_slot(spark, tmp_path, monkeypatch):
    from graphloom.sources import databases

    lines = [("0/10", 1, "table public.users: INSERT: id[integer]:1 name[text]:'a'"), ("0/18", 1, "table public.users: INSERT: id[integer]:2 name[text]:'b'"), ("0/9", 1, "BEGIN 1")]
    waiting, moved = [list(lines)], []
    slot = databases.Slot(databases.Database(spark, "postgresql", "jdbc:postgresql://h/d"), "s")
    monkeypatch.setattr(slot, "peek", lambda most: spark.createDataFrame(waiting[0], "lsn string, xid bigint, value string"))
    monkeypatch.setattr(slot, "advance", lambda lsn: moved.append(lsn))
    assert slot.land(str(tmp_path / "wal")) == 3 and moved == ["0/18"]
    assert slot.land(str(tmp_path / "wal")) == 3  # lost before the slot moved: landed again
    store = GraphStore(spark, str(tmp_path / "graph"), buckets=2)
    query = apply.run_stream(databases.landed_changes(spark, str(tmp_path / "wal")), "test_decoding", store, SCHEMA, CONFIG, str(tmp_path / "ckpt"))
    query.awaitTermination(240)
    query.stop()
    assert {(r._key, r.name) for r in store.documents("users").collect()} == {("1", "a"), ("2", "b")}
