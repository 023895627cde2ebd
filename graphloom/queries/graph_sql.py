"""SQL counterparts (DuckDB) of the queries over the star tables, written from the semantics."""

from __future__ import annotations

_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond({0}) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(microsecond({0}) % 1000000 AS VARCHAR), 6, '0') END"

_TEXTS = """
WITH t AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '1.5' WHEN o_orderkey % 5 = 0 THEN '' ELSE o_custkey::VARCHAR END AS number,
         ['true', 'T', 'on', '0', 'YES'][o_orderkey % 5 + 1] AS flag, o_orderkey % 2 = 0 AS even
  FROM orders
)
"""

_LOG = """
WITH log AS (
  SELECT o_orderkey, 0 AS n, 'INSERT' AS op, o_custkey, o_orderstatus FROM orders
  UNION ALL SELECT o_orderkey, 1, 'UPDATE', o_custkey + 1, 'U' FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 2, 'DELETE', o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, 3, 'INSERT', o_custkey + 2, 'N' FROM orders WHERE o_orderkey % 10 = 0
), old AS (
  SELECT CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE o_orderkey + 1000000000 END AS o_orderkey, o_custkey, 'T' AS o_orderstatus, CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey * 10 + 1 END AS s FROM orders
), fresh AS (
  SELECT CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey ELSE o_orderkey + 2000000000 END AS o_orderkey, NULL::BIGINT AS o_custkey, o_orderstatus FROM orders
)
"""

#: Newest change per key against what was there.
_NEWEST = """, last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY n DESC) AS r FROM {log}) WHERE r = 1
)
SELECT coalesce(l.o_orderkey, o.o_orderkey)::VARCHAR AS _key, coalesce(l.o_orderkey, o.o_orderkey) AS o_orderkey,
       CASE WHEN {newer} THEN l.o_custkey ELSE o.o_custkey END AS o_custkey, CASE WHEN {newer} THEN l.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus
FROM last l FULL JOIN old o ON l.o_orderkey = o.o_orderkey
WHERE NOT (CASE WHEN {newer} THEN l.op = 'DELETE' ELSE false END)
"""
_NEWER = "(l.o_orderkey IS NOT NULL AND (o.o_orderkey IS NULL OR o.s IS NULL OR l.o_orderkey * 10 + l.n > o.s))"

_SEEN = """, seen AS (
  SELECT log.*, coalesce((SELECT arg_max(b.op, b.n) FROM log b WHERE b.o_orderkey = log.o_orderkey AND b.n < log.n AND b.op IN ('INSERT', 'DELETE')) = 'INSERT',
                         log.o_orderkey % 4 = 0) AS was0,
         (SELECT arg_max(b.op, b.n) FROM log b WHERE b.o_orderkey = log.o_orderkey AND b.n < log.n AND b.op IN ('INSERT', 'DELETE')) AS before
  FROM log
), judged AS (
  SELECT *, CASE WHEN before IS NULL THEN o_orderkey % 4 = 0 ELSE before = 'INSERT' END AS was FROM seen
)
"""

#: A bulk load of the fresh rows into what was there.
_JOINED = """
SELECT coalesce(n.o_orderkey, o.o_orderkey)::VARCHAR AS _key, coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, {custkey} AS o_custkey, {status} AS o_orderstatus
FROM fresh n FULL JOIN {old} o ON n.o_orderkey = o.o_orderkey
"""
_LOADED = _LOG + _JOINED

_PARSED = _LOG + "SELECT op, 'public' AS schema_name, 'orders' AS table_name, {lsn} AS lsn, o_orderkey AS transaction_id, o_orderkey, o_custkey, {status} AS o_orderstatus, op = 'DELETE' AS has_old FROM log"

_VERSIONS = """
WITH log AS (
  SELECT user_id::VARCHAR AS k, CASE WHEN event_id % 17 = 0 THEN 'D' ELSE 'W' END AS op, epoch_us(ts) AS ts, epoch_us(ts) * 1000 + event_id % 1000 AS seq, event_type, event_id FROM events
), nexts AS (
  SELECT *, lead(ts) OVER (PARTITION BY k ORDER BY seq) AS nx FROM log
), v AS (
  SELECT k || '-' || (row_number() OVER (PARTITION BY k ORDER BY seq) - 1) AS _key, k AS _proxy, row_number() OVER (PARTITION BY k ORDER BY seq) - 1 AS _version, ts AS created,
         coalesce(nx, 9223372036854775807) AS expired, CASE WHEN nx IS NOT NULL THEN nx // 1000000 + 2592000 END AS "ttlExpireAt", event_type, event_id
  FROM nexts WHERE op = 'W'
)
"""
_MOMENT, _LATER = 1704067200000000 + 10 * 86400000000, 1704067200000000 + 24 * 86400000000

_CUSTOMER_NATION = "WITH x AS (SELECT c_custkey, c_nationkey::VARCHAR AS c_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)\n"


def _edge(table: str, key: str, column: str, target: str) -> str:
    name = f"{table}_to_{target}"
    return f"SELECT {key} || '_' || {column} AS _key, '{table}/' || {key} AS _from, '{target}/' || {column} AS _to, '{name}' AS _label FROM {table} WHERE {column} IS NOT NULL"


def _fd(a: str, b: str) -> str:
    return f"SELECT '{a}' AS determinant, '{b}' AS dependent, count(*) AS groups, avg((n = 1)::INT) AS strength FROM (SELECT {a}, count(DISTINCT {b}) AS n FROM x WHERE {a} IS NOT NULL GROUP BY 1)"


def _ratio(c: str) -> str:
    return f"SELECT '{c}' AS column_name, count({c}) AS filled, count(DISTINCT {c}) AS distinct_values, count(DISTINCT {c}) / count({c}) AS ratio FROM customer"


def _orphans(name: str, child: str, column: str, parent: str, key: str) -> str:
    lost = f"{column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent} WHERE {key} IS NOT NULL)"
    return f"SELECT '{name}' AS check, count(*) AS rows_scanned, count({column}) AS \"references\", count(*) FILTER ({lost}) AS orphans, count(DISTINCT {column}) FILTER ({lost}) AS orphan_values FROM {child}"


def _keys(table: str, column: str) -> str:
    return f"SELECT '{table}' AS table_name, '{column}' AS column_name FROM {table} HAVING count(*) = count({column}) AND count(*) = count(DISTINCT {column})"


_EDGES = [("orders", "o_orderkey", "o_custkey", "customer"), ("customer", "c_custkey", "c_nationkey", "nation"), ("nation", "n_nationkey", "n_regionkey", "region"), ("supplier", "s_suppkey", "s_nationkey", "nation"), ("events", "event_id", "user_id", "customer")]


#: Rows of lineitem have no key of their own; the whole row is it.
_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE_KEY = f"md5(concat_ws(chr(31), {', '.join(f'coalesce({c}::VARCHAR, chr(30))' for c in _LINE_COLUMNS)}))"
_LINE_EDGES = [("lineitem", _LINE_KEY, "l_orderkey", "orders"), ("lineitem", _LINE_KEY, "l_partkey", "part"), ("lineitem", _LINE_KEY, "l_suppkey", "supplier")]


def _encoded(column: str) -> str:
    """Percent-encoding of every byte that a key may not hold, byte by byte."""
    kept = "[A-Za-z0-9_:.@()+,=;$!*''-]"
    return f"array_to_string(list_transform(string_split({column}, ''), lambda ch: CASE WHEN regexp_full_match(ch, '{kept}') THEN ch ELSE regexp_replace(hex(encode(ch)), '(..)', '%\\1', 'g') END), '')"


def _embedded_lookups() -> str:
    columns = ["c_nationkey", "n_name", "n_regionkey", "c_mktsegment"]
    ratios = " UNION ALL ".join(f"SELECT '{c}' AS a, count(DISTINCT {c}) / count({c}) AS ratio FROM x" for c in columns)
    strengths = " UNION ALL ".join(_fd(a, b) for a in columns for b in columns if a != b)
    return (
        _CUSTOMER_NATION
        + f", r AS ({ratios}), s AS ({strengths}), h AS (SELECT determinant, string_agg(dependent, ',' ORDER BY dependent) AS dependents, count(*) AS n, avg(strength) AS mean FROM s WHERE strength >= 0.98 GROUP BY 1) "
        "SELECT 'embedded_lookup' AS kind, determinant, dependents, least(0.95, round(0.5 + 0.1 * least(n, 3) + CASE WHEN ratio <= 0.2 THEN 0.1 ELSE 0 END + CASE WHEN mean >= 0.999 THEN 0.1 ELSE 0 END, 3)) AS confidence "
        "FROM h JOIN r ON a = determinant WHERE ratio > 0 AND ratio <= 0.5"
    )


def _shared_keys() -> str:
    def share(table: str, column: str, target: str) -> str:
        return f"(SELECT count(*) FILTER (v IN (SELECT id FROM {target})) / count(*) FROM (SELECT DISTINCT {column} AS v FROM {table} WHERE {column} IS NOT NULL))"

    def row(key: str, target: str, concept: str, column: str) -> str:
        return (
            f"SELECT '{key}' AS key, 'catalogue.{target}.{key}' AS hub, '{concept}' AS concept, 'desk.loans.{key};reviews.documents.{key}' AS \"references\", 'hub_primary_key' AS method, "
            f"greatest({share('loans', key, target)}, {share('documents', column, target)}) AS most"
        )

    return f"SELECT key, hub, concept, \"references\", method, round(0.9 + CASE WHEN most >= 0.9 THEN 0.08 WHEN most >= 0.5 THEN 0.04 ELSE 0 END, 4) AS confidence FROM ({row('book_id', 'books', 'Book', 'item_id')} UNION ALL {row('member_id', 'members', 'Member', 'reviewer_id')})"


#: Levels of the classified columns, and the references between the classified tables.
_MOSAIC = """
WITH levels(level, r) AS (VALUES ('public', 0), ('internal', 1), ('confidential', 2), ('restricted', 3)
), marked(t, c, r) AS (VALUES ('customer', 'c_name', 3), ('customer', 'c_acctbal', 2), ('nation', 'n_name', 1)
), fks(t, c, f, k) AS (VALUES ('nation', 'n_regionkey', 'region', 'r_regionkey'), ('customer', 'c_nationkey', 'nation', 'n_nationkey'), ('orders', 'o_custkey', 'customer', 'c_custkey')
), sets AS (SELECT n AS name, coalesce((SELECT max(r) FROM marked WHERE t = n), 0) AS r FROM (VALUES ('region'), ('nation'), ('customer'), ('orders')) AS x(n)
), edges AS (
  SELECT t || '_to_' || f AS name, greatest((SELECT r FROM sets WHERE name = t), (SELECT r FROM sets WHERE name = f), coalesce((SELECT r FROM marked m WHERE m.t = fks.t AND m.c = fks.c), 0)) AS r FROM fks
)
SELECT 'collection' AS kind, name, level FROM sets JOIN levels USING (r) UNION ALL SELECT 'edge', name, level FROM edges JOIN levels USING (r)
"""

_FK_CANDIDATES = """
SELECT c.table_name, c.column_name AS columns, t.table_name AS foreign_table, 'name_suffix' AS method, 0.85::DOUBLE AS confidence
FROM information_schema.columns c JOIN information_schema.columns t ON t.table_name = left(c.column_name, length(c.column_name) - 3) || 's' AND t.column_name = 'id' AND t.data_type = c.data_type
WHERE c.table_name IN ('authors', 'books', 'members', 'loans') AND t.table_name IN ('authors', 'books', 'members', 'loans') AND c.column_name LIKE '%_id' AND c.table_name <> t.table_name
"""


def _lost(table: str, columns: list[str], parent: str, keys: list[str], row_key: str) -> str:
    value = " || ',' || ".join(f"{c}::VARCHAR" for c in columns)
    same = " AND ".join(f"p.{k} = c.{c}" for c, k in zip(columns, keys))
    given = " AND ".join(f"c.{c} IS NOT NULL" for c in columns)
    return f"SELECT '{table}' AS check, {row_key} AS row_key, {value} AS value FROM {table} c WHERE {given} AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {same})"


def sql() -> dict[str, str]:
    """Query name -> SQL."""
    stamp = _STAMP.format
    out = {
        "flagship": "SELECT 'orders/' || o_orderkey AS _from, 'customer/' || o_custkey AS _to, o_orderkey || '_' || o_custkey AS _key, 'orders_to_customer' AS _label, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
        "vertex_customer": "SELECT c_custkey::VARCHAR AS _key, * FROM customer",
        "vertex_orders": f"SELECT o_orderkey::VARCHAR AS _key, o_orderkey, o_custkey, o_orderstatus, o_totalprice AS total, {stamp('o_orderdate')} AS ordered_at, o_orderpriority FROM orders",
        "vertex_excludes_and_renames": "SELECT p_partkey::VARCHAR AS _key, p_partkey, p_name AS name, '<' || p_brand || '>' AS brand, p_size FROM part",
        "vertex_composite_key": "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS _key, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem",
        "vertex_key_sanitized_timestamp": f"SELECT replace({stamp('ts')}, ' ', '%20') || '_' || event_type || '_' || event_id AS _key, event_id FROM events",
        "vertex_key_sanitized_text": f"SELECT {_encoded('name')} || '_' || id AS _key, id FROM authors WHERE name IS NOT NULL",
        "vertex_without_mapping": "SELECT n_nationkey::VARCHAR AS _key, * FROM nation",
        "vertex_without_key": "SELECT l_orderkey, l_quantity FROM lineitem",
        "coerce_types": _TEXTS
        + "SELECT o_orderkey::VARCHAR AS _key, o_orderkey, o_orderkey AS whole, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE TRY_CAST(nullif(number, '') AS BIGINT) END AS number, lower(flag) IN ('true', '1', 't', 'yes') AS flag, CASE WHEN even THEN 'a+b+c' ELSE 'a+b' END AS tags FROM t",
        "coerce_rejects": _TEXTS + "SELECT 'orders' AS source_table, 'orders' AS collection, 'number' AS column_name, number AS raw, 'not castable' AS reason, o_orderkey::VARCHAR AS o_orderkey FROM t WHERE o_orderkey % 7 = 0",
        "coerce_event_props": "SELECT event_id::VARCHAR AS _key, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "edge_null_fk_dropped": "SELECT o_orderkey || '_' || o_custkey AS _key, 'orders/' || o_orderkey AS _from, 'customer/' || o_custkey AS _to, 'orders_to_customer' AS _label FROM orders WHERE o_custkey % 3 = 1",
        "edge_join_table": "SELECT DISTINCT l_partkey || '_' || l_suppkey AS _key, 'part/' || l_partkey AS _from, 'supplier/' || l_suppkey AS _to, 'supplied_by' AS _label FROM lineitem",
        "edge_composite": "SELECT DISTINCT concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey, l_suppkey) AS _key, 'lineitem/' || concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS _from, 'stock/' || l_partkey || '_' || l_suppkey AS _to, 'lineitem_to_stock' AS _label FROM lineitem",
        "edge_nonpk_target": "SELECT o_orderkey || '_Customer%23' || lpad(o_custkey::VARCHAR, 9, '0') AS _key, 'orders/' || o_orderkey AS _from, 'customer/' || c_custkey AS _to, 'orders_to_customer' AS _label FROM orders JOIN customer ON o_custkey = c_custkey",
        "graph_all_edges": " UNION ALL ".join(f"SELECT '{t}_to_{x}' AS edge_set, count(*) AS edges, min({k} || '_' || {c}) AS least, max({k} || '_' || {c}) AS most FROM {t}" for t, k, c, x in [*_EDGES, *_LINE_EDGES]),
        "since_incremental": "SELECT o_orderkey::VARCHAR AS _key, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'",
        "degree_distribution": "SELECT degree, count(*) AS vertices FROM (SELECT o_custkey, count(*) AS degree FROM orders GROUP BY 1) GROUP BY 1",
        "two_hop_region_orders": "SELECT r_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
        "dangling_edges": "SELECT DISTINCT id || '_' || book_id AS _key, 'loans/' || id AS _from, 'books/' || book_id AS _to, 'loans_to_books' AS _label FROM loans WHERE book_id IS NOT NULL AND book_id NOT IN (SELECT id FROM books)",
        "expr_arith": "SELECT o_orderkey, o_orderkey + 5 AS total, o_orderkey / 4.0::DOUBLE AS halved, NULL::DOUBLE AS by_zero, ((o_orderkey - 50) % 7 + 7) % 7 AS floor_mod, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 7 - 7 END AS neg_mod, NULL::BIGINT AS mod_zero, -o_custkey AS negated, 25.0::DOUBLE AS from_text, o_orderkey || '#' AS joined FROM orders",
        "expr_strings": "SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, substr(c_name, 3, 4) AS part, right(c_name, 3) AS last, length(c_name) AS size, c_name || '/' || c_custkey AS joined, c_custkey || '--' || c_mktsegment AS parts, contains(c_mktsegment, 'BUILD') AS has, 'x' AS bare, length(c_custkey::VARCHAR) AS digits FROM customer",
        "expr_null_logic": "SELECT id, recorded_at, coalesce(book_id, member_id, -1) AS either, book_id IS NOT DISTINCT FROM member_id AS same, returned_on IS NULL AS none, book_id < member_id AS less, coalesce(book_id, 0) <> 0 AND coalesce(member_id, 0) <> 0 AS both, coalesce(book_id, 0) <> 0 OR coalesce(member_id, 0) <> 0 AS any, coalesce(book_id, 0) = 0 AS not_book, false AS mixed, true AS truth FROM loans",
        "expr_ternary": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 30 THEN 'large' WHEN l_quantity > 10 THEN 'middle' ELSE 'small' END AS size, (l_returnflag = 'R' AND l_quantity >= 10)::INT AS returned FROM lineitem",
        "mask_hash": "SELECT c_custkey::VARCHAR AS _key, c_custkey, md5(c_name) AS c_name FROM customer",
        "mask_redact": "SELECT c_custkey::VARCHAR AS _key, c_custkey, '***' AS c_name FROM customer",
        "mask_nullify": "SELECT c_custkey::VARCHAR AS _key, c_custkey, NULL::VARCHAR AS c_name FROM customer",
        "orphan_check": "SELECT o_orderkey, o_custkey + 100000000 AS ref FROM orders WHERE o_orderkey % 11 = 0",
        "embedded_lookup_candidates": _embedded_lookups(),
        "shared_key_candidates": _shared_keys(),
        "mosaic_levels": _MOSAIC,
        "fk_candidates": _FK_CANDIDATES,
        "orphan_issues": " UNION ALL ".join(
            [
                _lost("loans", ["book_id"], "books", ["id"], f"id || ',' || {stamp('recorded_at')}"),
                _lost("books", ["author_id"], "authors", ["id"], "id::VARCHAR"),
                _lost("lineitem", ["l_orderkey", "l_linenumber"], "(SELECT * FROM lineitem WHERE l_quantity > 25)", ["l_orderkey", "l_linenumber"], "l_orderkey || ',' || l_partkey || ',' || l_suppkey"),
            ]
        ),
        "orphan_summary": " UNION ALL ".join(
            _orphans(*x) for x in (("loans.book_id", "loans", "book_id", "books", "id"), ("loans.member_id", "loans", "member_id", "members", "id"), ("books.author_id", "books", "author_id", "authors", "id"), ("lineitem.l_orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"))
        ),
        "value_overlap": "SELECT count(*) AS distinct_values, count(m) AS found, count(m) / count(*) AS overlap FROM (SELECT DISTINCT member_id AS v FROM loans WHERE member_id IS NOT NULL) LEFT JOIN (SELECT DISTINCT id AS m FROM members) ON v = m",
        "distinct_ratio": " UNION ALL ".join(map(_ratio, ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))),
        "fd_strength": _CUSTOMER_NATION + " UNION ALL ".join(_fd(*x) for x in (("c_nationkey", "n_name"), ("c_nationkey", "n_regionkey"), ("n_regionkey", "n_name"), ("c_nationkey", "c_mktsegment"), ("n_name", "c_nationkey"))),
        "delimiter_rate": " UNION ALL ".join(f"SELECT '{c}' AS column_name, {d} AS delimiter, avg(contains({c}, {d})::INT) AS rate FROM books WHERE {c} IS NOT NULL" for c in ("title", "genre") for d in ("','", "';'", "'|'", "chr(9)")),
        "pk_candidates": " UNION ALL ".join(
            _keys(t, c)
            for t, columns in {
                "region": "r_regionkey r_name",
                "nation": "n_nationkey n_name n_regionkey",
                "customer": "c_custkey c_name c_nationkey c_mktsegment",
                "supplier": "s_suppkey s_name s_nationkey",
                "part": "p_partkey p_name p_brand p_type p_size",
                "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority",
                "events": "event_id user_id event_type props",
            }.items()
            for c in columns.split()
        ),
        "gate_excludes": "SELECT c_custkey::VARCHAR AS _key, c_custkey, c_nationkey, c_mktsegment FROM customer",
        "cdc_debezium_parse": _PARSED.format(lsn="(o_orderkey * 10 + n)::VARCHAR", status="o_orderstatus"),
        "cdc_flat_parse": _PARSED.format(lsn="(o_orderkey * 10 + n)::VARCHAR", status="o_orderstatus"),
        "cdc_wal2json_parse": _PARSED.format(lsn="(o_orderkey * 10)::VARCHAR", status="o_orderstatus"),
        "cdc_test_decoding_parse": _PARSED.format(lsn="(o_orderkey * 10 + n)::VARCHAR", status="'it''s ' || o_orderstatus"),
        "cdc_apply_source_wins": _LOG + _NEWEST.format(log="log", newer=_NEWER),
        "cdc_apply_lww": _LOG + _NEWEST.format(log="log", newer=_NEWER),
        "cdc_apply_log_and_skip": _LOG + _SEEN + _NEWEST.format(log="(SELECT o_orderkey, n, op, o_custkey, o_orderstatus FROM judged WHERE NOT ((op = 'INSERT' AND was) OR (op = 'UPDATE' AND NOT was)))", newer=_NEWER),
        "conflict_counts": _LOG + _SEEN + "SELECT CASE op WHEN 'INSERT' THEN 'INSERT_DUPLICATE' ELSE 'REPLACE_MISSING' END AS conflict_type, 'skipped' AS resolution, count(*) AS conflicts FROM judged WHERE (op = 'INSERT' AND was) OR (op = 'UPDATE' AND NOT was) GROUP BY ALL",
        "load_replace": _LOADED.format(old="old", custkey="CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_custkey ELSE o.o_custkey END", status="CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderstatus ELSE o.o_orderstatus END"),
        "load_update": _LOADED.format(old="old", custkey="coalesce(n.o_custkey, o.o_custkey)", status="coalesce(n.o_orderstatus, o.o_orderstatus)"),
        "load_ignore": _LOADED.format(old="old", custkey="CASE WHEN o.o_orderkey IS NOT NULL THEN o.o_custkey ELSE n.o_custkey END", status="CASE WHEN o.o_orderkey IS NOT NULL THEN o.o_orderstatus ELSE n.o_orderstatus END"),
        "load_then_late_change": _LOG
        + ", last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY n DESC) AS r FROM log) WHERE r = 1 AND op <> 'DELETE')"
        + _JOINED.format(old="last", custkey="CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_custkey ELSE o.o_custkey END", status="CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderstatus ELSE o.o_orderstatus END"),
        "cdc_long_transaction": _LOG
        + "SELECT o_orderkey::VARCHAR AS _key, o_orderkey, o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY n DESC) AS r FROM log) WHERE r = 1 AND op <> 'DELETE'",
        "cdc_deltas": _LOG
        + """, d AS (SELECT *, (o_orderkey * 10 + n) * 1024 AS seq, CASE op WHEN 'UPDATE' THEN 'REPLACE' ELSE op END AS o FROM log)
SELECT seq, 'orders' AS collection, false AS is_edge, o AS op, o_orderkey::VARCHAR AS _key, CASE WHEN op <> 'DELETE' THEN o_custkey END AS o_custkey, NULL::VARCHAR AS _to FROM d
UNION ALL SELECT seq, 'orders_to_customer', true, o, o_orderkey || '_' || o_custkey, NULL, CASE WHEN op <> 'DELETE' THEN 'customer/' || o_custkey END FROM d
UNION ALL SELECT seq, 'orders_to_customer', true, 'DELETE', o_orderkey || '_' || (o_custkey - 1), NULL, NULL FROM d WHERE op = 'UPDATE'""",
        "cdc_edge_rewire": _LOG
        + """, w AS (SELECT o_orderkey, o_custkey, n FROM log WHERE op <> 'DELETE'), g AS (
  SELECT o_orderkey, o_custkey, n FROM log WHERE op = 'DELETE' UNION ALL SELECT o_orderkey, o_custkey - 1, n FROM log WHERE op = 'UPDATE'
)
SELECT o_orderkey || '_' || o_custkey AS _key, 'orders/' || o_orderkey AS _from, 'customer/' || o_custkey AS _to, 'orders_to_customer' AS _label
FROM w WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.o_orderkey = w.o_orderkey AND g.o_custkey = w.o_custkey AND g.n > w.n)""",
        "temporal_versions": _VERSIONS + "SELECT * FROM v",
        "temporal_snapshot_at": _VERSIONS + f"SELECT _key, _proxy, event_id FROM v WHERE created <= {_MOMENT} AND expired > {_MOMENT}",
        "temporal_snapshots_at": _VERSIONS + f"SELECT {_MOMENT} + i * 86400000000 AS t, count(*) AS alive FROM v, range(8) r(i) WHERE created <= {_MOMENT} + i * 86400000000 AND expired > {_MOMENT} + i * 86400000000 GROUP BY 1",
        "temporal_overlap": _VERSIONS + f"SELECT _key FROM v WHERE created <= {_LATER} AND expired >= {_MOMENT}",
        "temporal_changed_between": _VERSIONS
        + f"SELECT _key, created > {_MOMENT} AND created <= {_LATER} AS created_in, expired > {_MOMENT} AND expired <= {_LATER} AS expired_in FROM v WHERE (created > {_MOMENT} AND created <= {_LATER}) OR (expired > {_MOMENT} AND expired <= {_LATER})",
        "temporal_current": _VERSIONS + "SELECT _key, _version, event_id FROM v WHERE expired = 9223372036854775807",
        "temporal_history": _VERSIONS + "SELECT _key, _version, created, expired FROM v WHERE _proxy = '7'",
        "temporal_has_version_edges": _VERSIONS
        + "SELECT _key || '-in' AS _key, 'userProxyIn/' || _proxy AS _from, 'user/' || _key AS _to, 'hasVersion' AS _label FROM v UNION ALL SELECT _key || '-out', 'user/' || _key, 'userProxyOut/' || _proxy, 'hasVersion' FROM v",
        "temporal_ttl": _VERSIONS + f"SELECT _key, \"ttlExpireAt\" FROM v WHERE \"ttlExpireAt\" IS NULL OR \"ttlExpireAt\" > {_LATER // 1000000 + 2592000}",
        "temporal_proxied_edges": "SELECT c_custkey || '_' || c_nationkey AS _key, 'customerProxyOut/' || c_custkey AS _from, 'nationProxyIn/' || c_nationkey AS _to, 'customer_to_nation' AS _label FROM customer",
    }
    return out | {f"edge_{t}_{x}": _edge(t, k, c, x) for t, k, c, x in _EDGES}
