import json

from graphloom.operators.drift import Target, field_changes, ingest, replay

SCHEMA = "file_id bigint, origin string, captured_at timestamp, received_at timestamp, body string, name string"


def files(spark, rows):
    texts = [(i, o, t, body if isinstance(body, str) or body is None else json.dumps({"tables": body})) for i, o, t, body in rows]
    return spark.createDataFrame(texts, "file_id bigint, origin string, t string, body string").selectExpr("file_id", "origin", "cast(t as timestamp_ntz) captured_at", "cast(t as timestamp_ntz) received_at", "body", "'clash' as name")


def changes(spark, rows):
    return sorted(tuple(r) for r in field_changes(files(spark, rows)).collect())


def test_kinds(spark):
    a = {"u": {"name": "u", "pk": ["id"], "flag": True, "gone": 1, "n": None, "list": [], "same": 1}}
    b = {"u": {"name": "u", "primary_key": ["id"], "flag": "yes", "new": 2, "n": 5, "list": ["x"], "same": 2.5}}
    assert changes(spark, [(2, "o", "2024-01-02", b), (1, "o", "2024-01-01", a)]) == [
        (2, "u", "", "new", "added"), (2, "u", "flag", "flag", "retyped"), (2, "u", "gone", "", "removed"), (2, "u", "pk", "primary_key", "renamed"),
    ]


def test_renames_need_a_value_of_their_own(spark):
    a = {"u": {"a": 1, "b": 1, "x": None, "o": {"k": 1, "l": [2]}}}
    b = {"u": {"c": 1, "d": 2, "y": None, "p": {"l": [2], "k": 1}}}
    assert changes(spark, [(1, "o", "2024-01-01", a), (2, "o", "2024-01-02", b)]) == [
        (2, "u", "", "c", "added"), (2, "u", "", "d", "added"), (2, "u", "", "y", "added"), (2, "u", "a", "", "removed"), (2, "u", "b", "", "removed"), (2, "u", "o", "p", "renamed"), (2, "u", "x", "", "removed"),
    ]


def test_order_is_by_capture_then_id_and_per_origin(spark):
    a, b, c = ({"u": {"k": v}} for v in (1, "1", [1]))
    rows = [(5, "o", "2024-01-01", a), (3, "o", "2024-01-02", b), (4, "o", "2024-01-02", c), (9, "p", "2024-01-03", a), (8, None, "2024-01-03", b), (7, None, "2024-01-02", a)]
    assert changes(spark, rows) == [(3, "u", "k", "k", "retyped"), (4, "u", "k", "k", "retyped"), (8, "u", "k", "k", "retyped")]


def test_element_types_and_table_changes(spark):
    a = {"u": {"l": [1, "x"], "m": [None]}, "v": {"k": 1}}
    b = {"u": {"l": ["1"], "m": [1]}, "w": {"k": 1}}
    assert changes(spark, [(1, "o", "2024-01-01", a), (2, "o", "2024-01-02", b)]) == [(2, "u", "l", "l", "retyped")]


def test_odd_bodies_and_repeats(spark):
    a = {"u": {"k": 1}, "odd": 5}
    rows = [(1, "o", "2024-01-01", a), (2, "o", "2024-01-02", "{"), (3, "o", "2024-01-03", None), (4, "o", "2024-01-04", a), (4, "o", "2024-01-04", a), (5, "o", None, a), (None, "o", "2024-01-05", {"u": {"k": "x"}})]
    assert changes(spark, rows) == []
    assert changes(spark, [(1, "o", "2024-01-01", a)]) == []
    assert field_changes(files(spark, rows).limit(0)).count() == 0


def test_ingest_promotes_and_rescues(spark):
    body = {
        "u": {"name": "u", "columns": [{"name": "id"}], "primaryKey": "id, part", "is_partitioned": "yes", "owner": "me", "partition_of": None},
        "v": {"name": 7, "primary_key": {"columns": ["a"]}, "pk": ["b"], "is_partitioned": {"odd": 1}, "partitioned": 0, "columns": None},
        "w": 5,
    }
    out = {r.table_name: r for r in ingest(files(spark, [(1, "o", "2024-01-01", body), (2, "o", "2024-01-01", "[]"), (3, None, None, None)])).collect()}
    assert set(out) == {"u", "v", "w"}
    assert (out["u"].primary_key, out["u"].is_partitioned, out["u"].promoted_from, json.loads(out["u"].rescued)) == (["id", "part"], True, "primary_key<-primaryKey", {"owner": "me"})
    assert json.loads(out["u"].tbl_columns) == [{"name": "id"}]
    assert (out["v"].primary_key, out["v"].is_partitioned, out["v"].name) == (["a"], False, "7")
    assert json.loads(out["v"].rescued) == {"pk": ["b"], "is_partitioned": {"odd": 1}}
    assert out["w"].rescued == "5"


def test_replay_from_the_stored_table(spark, tmp_path):
    known = {"name": "string", "primary_key": "array<string>"}
    bodies = [(1, "o", "2024-01-01", {"u": {"name": "u", "pk": ["a", "b"], "x": 1}, "v": {"key": "c"}, "w": {"primary_key": ["d"], "pk": ["e"]}, "odd": 3}), (2, "o", "2024-01-02", {"u": {"pk": {"no": 1}, "key": "f"}})]
    ingest(files(spark, bodies), Target(known)).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.where("promoted_from is not null").count() == 0
    out = {(r.file_id, r.table_name): r for r in replay(stored, Target(known, {"primary_key": ("pk", "key")})).collect()}
    assert {k: (r.primary_key, r.promoted_from) for k, r in out.items()} == {
        (1, "u"): (["a", "b"], "primary_key<-pk"), (1, "v"): (["c"], "primary_key<-key"), (1, "w"): (["d"], None), (1, "odd"): (None, None), (2, "u"): (["f"], "primary_key<-key"),
    }
    assert {k: r.rescued and json.loads(r.rescued) for k, r in out.items()} == {(1, "u"): {"x": 1}, (1, "v"): None, (1, "w"): {"pk": ["e"]}, (1, "odd"): 3, (2, "u"): {"pk": {"no": 1}}}
    assert {f.name for f in out[1, "u"].received} == {"name", "pk", "x"}


def test_one_id_with_two_bodies_counts_once(spark):
    first, other = {"u": {"k": 1}, "v": {"k": 1}}, {"u": {"k": "x"}, "w": {"k": 1}}
    rows = [(1, "o", "2024-01-01", first), (2, "o", "2024-01-02", first), (2, "p", "2024-01-03", other), (3, "o", "2024-01-04", {"u": {"k": True}, "w": {"k": "y"}})]
    assert changes(spark, rows) == changes(spark, rows[::-1]) == [(3, "u", "k", "k", "retyped")]


def test_shuffled_places_give_the_same(spark, monkeypatch):
    from graphloom.operators import drift

    rows = [(i, f"o{i % 3}", f"2024-01-{1 + i:02d}", {"u": {"k": i if i % 2 else str(i), f"f{i % 4}": [i % 2]}}) for i in range(12)]
    want = changes(spark, rows)
    monkeypatch.setattr(drift, "BROADCAST_BYTES", 0)
    assert changes(spark, rows) == want and len(want) > 12
