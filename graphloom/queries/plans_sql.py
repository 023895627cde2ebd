"""SQL counterparts (DuckDB) of the queries of stores, files and plans. Results that follow from the
tables' columns are read from the catalogue; the others are stated as the rules give them."""

from __future__ import annotations

_NEWEST_BOOKS = """
WITH b AS (
  SELECT id, max(struct_pack(a := loaded_at, b := title, c := author_id, d := genre, e := published, f := feed, g := load_no)) AS r FROM books WHERE id IS NOT NULL GROUP BY id
)
"""
_STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: References between the star tables: table, column, target.
_REFERENCES = [
    ("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("orders", "o_custkey", "customer"),
    ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"), ("events", "user_id", "customer"),
]


def _values(columns: str, rows: list[tuple]) -> str:
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({columns})"


def _columns(*tables: str) -> str:
    return f"(SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in tables)}))"


def sql() -> dict[str, str]:
    """Query name -> SQL."""
    levels = {"region": "public", "orders": "public", "nation": "internal", "nation_to_region": "internal", "customer": "restricted", "customer_to_nation": "restricted", "orders_to_customer": "restricted"}
    order = ["public", "internal", "confidential", "restricted"]
    capital = "upper(left(replace(column_name, '_', ' '), 1))"
    pascal = f"{capital} || upper(column_name[3:3]) || column_name[4:]"
    return {
        "store_load": _NEWEST_BOOKS + "SELECT id::VARCHAR AS _key, CASE WHEN regexp_full_match(r.b, '\\s*') THEN NULL ELSE r.b END AS title, r.e AS published, r.c::VARCHAR AS author FROM b",
        "store_describe": _NEWEST_BOOKS
        + "SELECT 'authors' AS collection, count(DISTINCT id) AS documents, 'born,country,feed,id,load_no,loaded_at,name' AS properties FROM authors "
        "UNION ALL SELECT 'books', count(*), 'author_id,feed,genre,id,load_no,loaded_at,published,title' FROM b UNION ALL SELECT 'books_to_authors', count(r.c), '' FROM b",
        "store_merge_deltas": "SELECT o_orderkey::VARCHAR AS _key, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'late' ELSE 'second' END AS status FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 7 <> 0",
        "files_dump_and_read": "SELECT id, nullif(name, '') AS name, nullif(city, '') AS city, strftime(joined, '%Y-%m-%d') AS joined FROM members",
        "files_json_graph": "SELECT c_custkey || '_' || c_nationkey AS _key, 'customer/' || c_custkey AS _from, 'nation/' || c_nationkey AS _to, c_mktsegment FROM customer WHERE c_nationkey IS NOT NULL",
        "dead_letters": "SELECT 'books' AS source_table, 'published' AS column_name, 'unknown' AS raw, 'not castable' AS reason, id FROM books WHERE id % 9 = 0",
        "expr_casts": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::VARCHAR AS shown, l_returnflag AS first, NULL::VARCHAR AS none, l_quantity <> 0 AS truth, l_linenumber + 0.5::DOUBLE AS number, l_orderkey || '-' || l_partkey AS glued FROM lineitem",
        "vertex_expression_engines": "SELECT c_custkey::VARCHAR AS _key, c_custkey, c_name AS named, c_mktsegment, c_nationkey AS other FROM customer",
        "bind_rewrites": f"SELECT table_name, column_name, 'CONCAT(\"@' || column_name || '\", row.`' || column_name || '`)' AS rewritten FROM {_columns('orders', 'customer')}",
        "edge_names": _values("edge_set, from_table, to_table, columns", [("customer_to_nation", "customer", "nation", "c_nationkey"), ("customer_to_nation_c_custkey", "customer", "nation", "c_custkey")]),
        "temporal_sharded": "SELECT event_type || ':' || user_id || '-' || n AS _key, event_type || ':' || user_id AS _proxy, n AS _version, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)",
        "conflict_errors": _values(
            '"case", outcome',
            [("load error, keys there", "conflict"), ("load error, new keys", ""), ("fail, INSERT of keys there", "conflict"), ("fail, REPLACE of keys there", ""), ("fail, REPLACE of new keys", "conflict"), ("fail, DELETE of new keys", "")],
        ),
        "plan_auto_map": f"SELECT 'collection' AS kind, table_name AS name, count(*)::INT AS columns FROM {_columns(*_STAR)} GROUP BY table_name UNION ALL "
        + _values("kind, name, columns", [("edge", f"{t}_to_{f}", 1) for t, _, f in _REFERENCES]),
        "plan_load_order": _values("table_name, foreign_table, target_first", [(t, f, True) for t, _, f in _REFERENCES]),
        "plan_validate": "SELECT 'Collection ''' || t || ''': exclude_field ''gone'' is not a column in table ''' || t || '''' AS issue FROM (VALUES ('region'), ('nation'), ('customer')) AS x(t) "
        "UNION ALL SELECT 'Collection ''nation'': field_mapping target ''_id'' is a reserved attribute' UNION ALL SELECT 'Collection ''extra'': source_table ''extra'' not found in schema'",
        "plan_schema_diff": _values("change, table_name, column_name", [("added_table", "part", ""), ("removed_table", "supplier", ""), ("removed_column", "customer", "c_mktsegment"), ("type_change", "customer", "c_acctbal")]),
        "plan_migration": _values("what, name", [("added", "part"), ("orphaned", "supplier"), ("removed_edge", "supplier_to_nation"), ("kept_mapping", "c_name")]),
        "plan_reload": _values("step, target", [("reload", "customer"), ("rename", "Regions"), ("reload_edge", "nation_to_region"), ("rebuild_graph", "graph")]),
        "plan_names": f"SELECT column_name, {pascal} AS pascal, lower(left(column_name, 1)) || ({pascal})[2:] AS camel, column_name AS snake, lower(left(column_name, 1)) || ({pascal})[2:] AS property FROM {_columns('region', 'nation', 'orders')}",
        "plan_plurals": "SELECT t AS table_name, left(t, length(t) - 1) AS one, t AS many FROM (VALUES ('authors'), ('books'), ('members'), ('loans'), ('deletions')) AS x(t)",
        "plan_model": "WITH names(t, e) AS (SELECT t, upper(left(t, 1)) || CASE WHEN t LIKE '%s' THEN t[2:-2] ELSE t[2:] END FROM (VALUES "
        + ", ".join(f"('{t}')" for t in _STAR)
        + ") AS x(t)), refs(a, b) AS (VALUES "
        + ", ".join(f"('{t}', '{f}')" for t, _, f in _REFERENCES)
        + ") SELECT 'entity' AS kind, e AS name, '' AS start, '' AS \"end\" FROM names UNION ALL SELECT 'relationship', '', x.e, y.e FROM refs JOIN names x ON x.t = a JOIN names y ON y.t = b",
        "plan_r2rml": f"SELECT table_name, count(*)::INT AS properties, (count(*) FILTER (column_name IN ('n_regionkey', 'c_nationkey', 's_nationkey')))::INT AS \"references\" FROM {_columns('region', 'nation', 'customer', 'supplier')} GROUP BY table_name",
        "plan_outcomes": f"SELECT column_name AS property, CASE WHEN column_name IN ('c_name', 'c_acctbal') THEN 'excluded' ELSE 'loaded' END AS outcome FROM {_columns('customer')} UNION ALL SELECT 'greeting', 'excluded'",
        "plan_roles": _values("clearance, readable", [(c, n) for c in order if c in levels.values() for n, level in levels.items() if order.index(level) <= order.index(c)]),
        "plan_layout": _values("name, level", list(levels.items())),
        "plan_classification_drift": _values("table_name, column_name, old_level, new_level", [("nation", "n_name", "internal", "public"), ("orders", "o_totalprice", "public", "confidential")]),
        "plan_denormalization": _values("kind, columns, confidence", [("one_to_one", "r_regionkey", 0.8), ("repeating_group", "phone_1,phone_2,phone_3", 0.7)]),
    }
