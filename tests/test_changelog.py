import json

import pytest

from graphloom.streaming import changelog
from graphloom.streaming.changelog import lsn_number


def run(spark, parser, texts, schema="value string"):
    rows = [t if isinstance(t, tuple) else (t if isinstance(t, (str, bytes)) or t is None else json.dumps(t),) for t in texts]
    out = parser(spark.createDataFrame(rows, schema)).collect()
    return [(r.op, r.schema_name, r.table_name, json.loads(r.new_row) if r.new_row else None, json.loads(r.old_row) if r.old_row else None, r.lsn, r.transaction_id) for r in out]


def test_debezium(spark):
    source = {"schema": "public", "table": "users", "lsn": 77, "txId": 5}
    texts = [
        {"before": None, "after": {"id": 1, "n": None}, "source": source, "op": "c"},
        {"payload": {"before": {"id": 1}, "after": {"id": 1, "n": "x"}, "source": source, "op": "u", "ts_ms": 1}},
        {"op": "d", "before": {"id": 1}, "after": {}, "source": {"table": "users"}},
        {"op": "r", "after": {"id": 2}, "source": source},
        {"op": "x", "after": {"id": 2}, "source": source},
        {"after": {"id": 2}, "source": source},
        {"op": "c", "after": {"id": 2}, "source": {}},
        "{", None, "[1]", "5",
    ]
    assert run(spark, changelog.parse_debezium, texts) == [
        ("INSERT", "public", "users", {"id": 1, "n": None}, None, "77", 5),
        ("UPDATE", "public", "users", {"id": 1, "n": "x"}, {"id": 1}, "77", 5),
        ("DELETE", None, "users", None, {"id": 1}, None, None),
        ("INSERT", "public", "users", {"id": 2}, None, "77", 5),
    ]


def test_debezium_bytes(spark):
    text = json.dumps({"op": "c", "after": {"id": 1}, "source": {"table": "t"}}).encode()
    assert len(run(spark, changelog.parse_debezium, [(bytearray(text),)], "value binary")) == 1


def test_flat(spark):
    texts = [
        {"operation": "insert", "schema_name": "s", "table_name": "t", "new_row": {"a": 1}, "lsn": "0/16", "transaction_id": 3},
        {"operation": "Delete", "table_name": "t", "old_row": {"a": 1}, "new_row": {}},
        {"operation": "insert", "new_row": {"a": 1}}, {"operation": "truncate", "table_name": "t"}, "no",
    ]
    assert run(spark, changelog.parse_flat, texts) == [("INSERT", "s", "t", {"a": 1}, None, "0/16", 3), ("DELETE", None, "t", None, {"a": 1}, None, None)]


def test_test_decoding(spark):
    texts = [
        ("BEGIN 5", "0/1", 5),
        ("table public.users: INSERT: id[integer]:1 name[text]:'O''Brien \"x\"' ok[boolean]:true score[numeric]:1.50 none[text]:null tags[text[]]:'{a,b}' at[timestamp without time zone]:'2024-01-01 10:00:00'", "0/2", 5),
        ("table public.users: UPDATE: old-key: id[integer]:1 new-tuple: id[integer]:2 name[text]:'a: b'", "0/3", 5),
        ("table public.users: UPDATE: id[integer]:2 name[text]:'two\nlines'", "0/4", 5),
        ("table public.users: DELETE: id[integer]:2", "0/5", 5),
        ("COMMIT 5", "0/6", 5), ("nonsense", "0/7", 5), (None, "0/8", 5),
    ]
    assert run(spark, changelog.parse_test_decoding, texts, "value string, lsn string, xid bigint") == [
        ("INSERT", "public", "users", {"id": 1, "name": "O'Brien \"x\"", "ok": True, "score": 1.5, "none": None, "tags": "{a,b}", "at": "2024-01-01 10:00:00"}, None, "0/2", 5),
        ("UPDATE", "public", "users", {"id": 2, "name": "a: b"}, {"id": 1}, "0/3", 5),
        ("UPDATE", "public", "users", {"id": 2, "name": "two\nlines"}, None, "0/4", 5),
        ("DELETE", "public", "users", None, {"id": 2}, "0/5", 5),
    ]


def test_wal2json(spark):
    change = [
        {"kind": "insert", "schema": "s", "table": "t", "columnnames": ["a", "b"], "columnvalues": [1, None]},
        {"kind": "update", "schema": "s", "table": "t", "columnnames": ["a"], "columnvalues": ["x"], "oldkeys": {"keynames": ["a"], "keyvalues": [1]}},
        {"kind": "delete", "schema": "s", "table": "t", "oldkeys": {"keynames": ["a"], "keyvalues": [1]}},
        {"kind": "message"}, {"kind": "insert", "schema": "s"},
    ]
    assert run(spark, changelog.parse_wal2json, [{"xid": 9, "nextlsn": "0/9", "change": change}, {"xid": 1, "change": []}, "{"]) == [
        ("INSERT", "s", "t", {"a": 1, "b": None}, None, "0/9", 9),
        ("UPDATE", "s", "t", {"a": "x"}, {"a": 1}, "0/9", 9),
        ("DELETE", "s", "t", None, {"a": 1}, "0/9", 9),
    ]


@pytest.mark.parametrize("lsn, number", [("0/9", 9), ("0/16", 22), ("1/0", 1 << 32), ("16/B374D848", (0x16 << 32) + 0xB374D848), ("77", 77), ("x", None), ("", None), (None, None)])
def test_lsn_number(spark, lsn, number):
    df = spark.createDataFrame([(lsn,)], "l string")
    assert df.select(lsn_number(df.l)).first()[0] == number
