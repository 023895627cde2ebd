"""SQL counterparts (DuckDB) of the queries of problems 1 to 5, written from the problem statements."""

from __future__ import annotations

_P1 = r"""
WITH heads AS (
  SELECT file_name, min(regexp_extract(replace(raw_line, '"', ''), '[^\w \x{FEFF}]')) AS d FROM raw_books WHERE line_no = 1 GROUP BY 1
), recs AS (
  SELECT r.line_id, r.file_name, coalesce(r.raw_line, '') AS raw, coalesce(h.d, ',') AS d,
         CASE coalesce(h.d, ',') WHEN '|' THEN '\|' ELSE coalesce(h.d, ',') END AS e
  FROM raw_books r LEFT JOIN heads h USING (file_name) WHERE r.line_no <> 1
), pats AS (
  SELECT *, '(?:"(?:[^"]|"")*"|[^"' || e || ']*)' AS f FROM recs
), judged AS (
  SELECT *, regexp_full_match(raw, f || '(?:' || e || f || ')*') AS sound,
         length(regexp_replace(regexp_replace(raw, '"(?:[^"]|"")*"', 'q', 'g'), '[^' || e || ']', '', 'g')) + 1 AS n,
         regexp_extract(raw, '^' || f || e || '(' || f || ')' || e, 1) AS t0,
         regexp_extract(raw, e || '(' || f || ')$', 1) AS p0,
         regexp_extract(raw, '^(' || f || ')' || e, 1) AS i0,
         regexp_extract(raw, '^' || f || e || f || e || '(' || f || ')' || e, 1) AS a0,
         regexp_extract(raw, '^' || f || e || f || e || f || e || '(' || f || ')' || e, 1) AS g0
  FROM pats
), vals AS (
  SELECT line_id, file_name, sound, n,
         CASE WHEN t0 LIKE '"%' THEN replace(t0[2:-2], '""', '"') ELSE t0 END AS title,
         trim(CASE WHEN p0 LIKE '"%' THEN p0[2:-2] ELSE p0 END) AS published,
         CASE WHEN i0 LIKE '"%' THEN i0[2:-2] ELSE i0 END AS id,
         CASE WHEN a0 LIKE '"%' THEN a0[2:-2] ELSE a0 END AS author_id,
         CASE WHEN g0 LIKE '"%' THEN replace(g0[2:-2], '""', '"') ELSE g0 END AS genre
  FROM judged
), why AS (
  SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN n <> 5 THEN 'column_count'
    WHEN regexp_full_match(title, '[\s\p{Z}]*') OR regexp_matches(title, '[\x00-\x08\x0b-\x1f\x7f\x{FFFD}]') THEN 'bad_title'
    WHEN published <> '' AND NOT (regexp_full_match(published, '[0-9]{4}') AND CASE WHEN regexp_full_match(published, '[0-9]{4}') THEN published::INT BETWEEN 1400 AND 2026 END) THEN 'bad_published' END AS reason
  FROM vals
)
"""

_P2 = r"""
WITH files AS (
  SELECT DISTINCT file_id, origin, captured_at, body FROM reference_schema
), steps AS (
  SELECT *, lag(body) OVER w AS prev FROM files WINDOW w AS (PARTITION BY origin ORDER BY captured_at, file_id)
), keyed AS (
  SELECT file_id, unnest(json_keys(body, '$.tables')) AS t, body, prev FROM steps WHERE prev IS NOT NULL
), pairs AS (
  SELECT file_id, t, json_extract(body, '$.tables."' || t || '"') AS n, json_extract(prev, '$.tables."' || t || '"') AS o FROM keyed
), cells AS (
  SELECT file_id, t, unnest(list_distinct(list_concat(json_keys(o), json_keys(n)))) AS f, o, n FROM pairs WHERE o IS NOT NULL AND json_type(o) = 'OBJECT' AND json_type(n) = 'OBJECT'
), vals AS (
  SELECT file_id, t, f, list_contains(json_keys(o), f) AS was, list_contains(json_keys(n), f) AS now,
         json_extract(o, '$."' || f || '"') AS ov, json_extract(n, '$."' || f || '"') AS nv FROM cells
), typed AS (
  SELECT *, k(ov) AS ok, k(nv) AS nk, k(json_extract(ov, '$[0]')) AS oe, k(json_extract(nv, '$[0]')) AS ne,
         CASE WHEN was AND NOT now THEN c(ov) WHEN now AND NOT was THEN c(nv) END AS v
  FROM vals
), moved AS (
  SELECT *, sum(was::INT) OVER w AS gone, sum(now::INT) OVER w AS come,
         max(CASE WHEN was THEN f END) OVER w AS old_f, max(CASE WHEN now THEN f END) OVER w AS new_f
  FROM typed WHERE was <> now WINDOW w AS (PARTITION BY file_id, t, v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT file_id, t AS table_name, f AS old_field, f AS new_field, 'retyped' AS change_kind FROM typed
WHERE was AND now AND ok <> 'null' AND nk <> 'null' AND (ok <> nk OR (ok = 'array' AND oe IS NOT NULL AND ne IS NOT NULL AND oe <> 'null' AND ne <> 'null' AND oe <> ne))
UNION ALL SELECT DISTINCT file_id, t, old_f, new_f, 'renamed' FROM moved WHERE gone = 1 AND come = 1 AND v <> 'null'
UNION ALL SELECT file_id, t, CASE WHEN was THEN f ELSE '' END, CASE WHEN now THEN f ELSE '' END, CASE WHEN was THEN 'removed' ELSE 'added' END
FROM moved WHERE NOT (gone = 1 AND come = 1 AND v <> 'null')
"""


def _p2() -> str:
    """k(x) and c(x) written out: the kind of a JSON value, and its text with object keys in order.

    Objects nest one level in the fields of table objects other than columns and foreign_keys,
    which never move; for those the text is used as it is."""
    import re

    kind = (
        "(CASE WHEN {0} IS NULL THEN NULL WHEN json_type({0}) IN ('UBIGINT','BIGINT','DOUBLE') THEN 'number' WHEN json_type({0}) = 'VARCHAR' THEN 'string' ELSE lower(json_type({0})) END)"
    )
    canon = (
        "(CASE WHEN json_type({0}) = 'OBJECT' THEN (SELECT string_agg(q || ':' || json_extract({0}, '$.\"' || q || '\"')::VARCHAR, ',' ORDER BY q) FROM (SELECT unnest(json_keys({0})) AS q)) ELSE {0}::VARCHAR END)"
    )
    text = re.sub(r"\bk\((json_extract\(\w+, '\$\[0\]'\)|ov|nv)\)", lambda m: kind.format(m[1]), _P2)
    return re.sub(r"\bc\((ov|nv)\)", lambda m: canon.format(m[1]), text)


def _p2_typed() -> str:
    """The ingested table with the approved aliases, in DuckDB's JSON functions."""
    from graphloom.operators.drift import SNAPSHOT_TARGET as target

    def cast(x: str, kind: str) -> str:
        i = f"(CASE WHEN json_type({x}) = 'OBJECT' THEN coalesce(json_extract({x}, '$.columns'), json_extract({x}, '$.value'), {x}) ELSE {x} END)"
        if kind == "array<string>":
            return (
                f"CASE json_type({i}) WHEN 'VARCHAR' THEN array_to_string(list_transform(string_split({i}->>'$', ','), lambda p: trim(p)), ',') "
                f"WHEN 'ARRAY' THEN array_to_string(CAST({i} AS VARCHAR[]), ',') END"
            )
        if kind == "boolean":
            return (
                f"CASE json_type({i}) WHEN 'BOOLEAN' THEN CAST({i} AS BOOLEAN) WHEN 'VARCHAR' THEN CASE WHEN lower({i}->>'$') IN ('true','t','yes','y','1') THEN true "
                f"WHEN lower({i}->>'$') IN ('false','f','no','n','0') THEN false END WHEN 'UBIGINT' THEN CAST({i}->>'$' AS BIGINT) <> 0 WHEN 'BIGINT' THEN CAST({i}->>'$' AS BIGINT) <> 0 END"
            )
        if kind == "json":
            return f"CASE WHEN json_type({x}) <> 'NULL' THEN 'there' END"
        return f"CASE WHEN json_type({x}) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {x}->>'$' END"

    get = lambda field: f"json_extract(o, '$.\"{field}\"')"
    own = [f"{cast(get(n), kind)} AS own_{n}" for n, kind in target.columns.items()]
    own += [f"{cast(get(a), target.columns[n])} AS alias_{a}" for n, aliases in target.promoted.items() for a in aliases]
    picked = [f"CASE {' '.join(f'WHEN own_{n} IS NULL AND alias_{a} IS NOT NULL THEN {chr(39)}{a}{chr(39)}' for a in aliases)} END AS from_{n}" for n, aliases in target.promoted.items()]
    value = lambda n: f"CASE from_{n} {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN alias_{a}' for a in target.promoted[n])} ELSE own_{n} END" if n in target.promoted else f"own_{n}"
    cells = ", ".join(f"{value(n)} AS {n}" for n, kind in target.columns.items() if kind != "json")
    typed = " OR ".join(f"(k = '{n}' AND (own_{n} IS NOT NULL OR json_type({get(n)}) = 'NULL'))" for n in target.columns)
    used = " OR ".join(f"coalesce(k = from_{n}, false)" for n in target.promoted)
    notes = ", ".join(f"'{n}<-' || from_{n}" for n in target.promoted)
    return f"""
WITH t AS (
  SELECT file_id, origin, captured_at, unnest(json_keys(body, '$.tables')) AS table_name, body FROM reference_schema WHERE json_valid(body)
), j AS (
  SELECT file_id, origin, captured_at, table_name, json_extract(body, '$.tables."' || table_name || '"') AS o FROM t
), c AS (
  SELECT *, CASE WHEN json_type(o) = 'OBJECT' THEN list_sort(json_keys(o)) ELSE [] END AS ks, {', '.join(own)} FROM j
), p AS (SELECT *, {', '.join(picked)} FROM c)
SELECT file_id, origin, captured_at, table_name, {cells}, array_to_string(list_filter(ks, lambda k: NOT ({typed} OR {used})), ',') AS rescued_fields,
  array_to_string(ks, ',') AS received_fields, concat_ws(',', {notes}) AS promoted_from FROM p"""


def _p3_found(table: str, column: str) -> str:
    return rf"""
SELECT '{table}' AS table_name, '{column}' AS column_name, feed, CAST(load_no AS BIGINT) AS load_no, finding FROM (
  WITH v AS (
    SELECT feed, load_no, {column} AS x, count(*) AS n, coalesce(regexp_full_match({column}, '[\s\p{{Z}}]*'), true) AS blank,
           coalesce(regexp_full_match({column}, '\p{{Lu}}[\p{{L}} .''-]{{2,}}') AND {column} NOT LIKE '%  %' AND {column} NOT LIKE '% ', false) AS ok
    FROM {table} WHERE feed IS NOT NULL AND load_no IS NOT NULL GROUP BY ALL
  ), l AS (
    SELECT feed, load_no, sum(n) AS rows, coalesce(sum(n) FILTER (blank), 0) AS blanks, coalesce(sum(n) FILTER (NOT blank AND NOT ok), 0) AS bad,
           count(*) FILTER (NOT blank) AS dist FROM v GROUP BY 1, 2 HAVING sum(n) >= 30
  ), s AS (
    SELECT v.feed, v.load_no, x, n / (rows - blanks) AS p FROM v JOIN l USING (feed, load_no) WHERE NOT blank
  ), c AS (
    SELECT a.*, b.rows AS rows0, b.blanks AS blanks0, b.dist AS dist0 FROM l a JOIN l b ON a.feed = b.feed AND a.load_no = b.load_no + 1
    WHERE a.rows > a.blanks AND b.rows > b.blanks
  ), d AS (
    SELECT c.feed, c.load_no, (SELECT sum(abs(coalesce(e.p, 0) - coalesce(g.p, 0))) / 2 FROM (SELECT * FROM s WHERE s.feed = c.feed AND s.load_no = c.load_no) e
      FULL JOIN (SELECT * FROM s WHERE s.feed = c.feed AND s.load_no = c.load_no - 1) g ON e.x = g.x) AS shift FROM c
  )
  SELECT feed, load_no, 'pattern' AS finding FROM l WHERE rows > blanks AND bad / (rows - blanks) > 0.10
  UNION ALL SELECT feed, load_no, 'nulls' FROM c WHERE blanks / rows - blanks0 / rows0 > 0.153
  UNION ALL SELECT feed, load_no, 'distinct' FROM c WHERE dist * 2 < dist0 OR dist > 2 * dist0
  UNION ALL SELECT feed, load_no, 'shift' FROM d WHERE shift > 0.452
)"""


def _p3_profile() -> str:
    from graphloom.queries.data_quality import PROFILED

    bad = {
        "any": "false",
        "text": r"regexp_full_match({0}, '[\s\p{{Z}}]*') OR regexp_matches({0}, '^[\s\p{{Z}}]|[\s\p{{Z}}]$')",
        "name": r"NOT (regexp_full_match({0}, '\p{{Lu}}[\p{{L}} .''-]{{2,}}') AND {0} NOT LIKE '%  %' AND {0} NOT LIKE '% ')",
    }
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        f"(count(*) - count({c})) / count(*) AS null_rate, count(DISTINCT {c}) AS distinct_count, min({c})::VARCHAR AS low, max({c})::VARCHAR AS high, "
        f"count(DISTINCT {c}) FILTER ({bad[rule].format(c)}) AS malformed_values FROM {t}"
        for t, columns in PROFILED.items()
        for c, rule in columns.items()
    )


_P4 = """
WITH held AS (
  SELECT id, max(struct_pack(r := recorded_at, b := book_id, f := loaned_on, t := returned_on)) AS h FROM loans GROUP BY id
), l AS (
  SELECT h.b AS book_id, h.f AS f, coalesce(h.t, DATE '9999-12-31') AS t FROM held WHERE h.b IS NOT NULL AND h.f IS NOT NULL AND (h.t IS NULL OR h.t >= h.f)
), o AS (
  SELECT *, max(t) OVER (PARTITION BY book_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l
), i AS (
  SELECT *, sum(CASE WHEN before IS NULL OR f > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS isle FROM o
), p AS (
  SELECT book_id, isle, min(f) AS f, max(t) AS t, bool_or(before IS NOT NULL AND f <= before) AS shared FROM i GROUP BY 1, 2
), x AS (
  SELECT book_id, 'period' AS kind, strftime(f, '%Y-%m-%d') AS from_day, CASE WHEN t = DATE '9999-12-31' THEN 'open' ELSE strftime(t, '%Y-%m-%d') END AS to_day, shared FROM p
  UNION ALL
  SELECT book_id, 'gap', strftime(before + 1, '%Y-%m-%d'), strftime(f - 1, '%Y-%m-%d'), false FROM i WHERE f > before + 1
)
"""

_P5 = """
WITH refs AS (
  SELECT 'loans' AS table_name, 'book_id' AS column_name, 'books' AS target, id AS row_id, book_id AS ref, min(recorded_at) AS seen FROM loans WHERE book_id IS NOT NULL GROUP BY id, book_id
  UNION ALL SELECT 'loans', 'member_id', 'members', id, member_id, min(recorded_at) FROM loans WHERE member_id IS NOT NULL GROUP BY id, member_id
  UNION ALL SELECT 'books', 'author_id', 'authors', id, author_id, min(loaded_at) FROM books WHERE author_id IS NOT NULL GROUP BY id, author_id
), rows AS (
  SELECT 'books' AS target, id AS ref, min(loaded_at) AS lo, max(loaded_at) AS hi FROM books GROUP BY id
  UNION ALL SELECT 'members', id, min(loaded_at), max(loaded_at) FROM members GROUP BY id
  UNION ALL SELECT 'authors', id, min(loaded_at), max(loaded_at) FROM authors GROUP BY id
), gone AS (
  SELECT table_name AS target, row_id AS ref, max(deleted_at) AS d FROM deletions GROUP BY 1, 2
), f AS (
  SELECT r.*, CASE WHEN d IS NOT NULL AND NOT coalesce(hi > d, false) THEN 'deleted' WHEN lo IS NULL THEN 'missing' WHEN lo > seen THEN 'late' END AS kind
  FROM refs r LEFT JOIN rows USING (target, ref) LEFT JOIN gone USING (target, ref)
)
"""


_P5_COMPOSITE = """
WITH refs AS (
  SELECT id, book_id, member_id, min(recorded_at) AS seen FROM loans WHERE book_id IS NOT NULL OR member_id IS NOT NULL GROUP BY ALL
), ended AS (
  SELECT book_id AS b, member_id AS m, min(recorded_at) AS lo FROM loans WHERE returned_on IS NOT NULL AND book_id IS NOT NULL AND member_id IS NOT NULL GROUP BY ALL
), by_b AS (SELECT b, min(lo) AS lo FROM ended GROUP BY b), by_m AS (SELECT m, min(lo) AS lo FROM ended GROUP BY m
), f AS (
  SELECT (book_id IS NOT NULL)::INT + 2 * (member_id IS NOT NULL)::INT AS mask, seen,
         CASE WHEN book_id IS NULL THEN by_m.lo WHEN member_id IS NULL THEN by_b.lo ELSE e.lo END AS lo
  FROM refs LEFT JOIN ended e ON e.b = book_id AND e.m = member_id LEFT JOIN by_b ON by_b.b = book_id LEFT JOIN by_m ON by_m.m = member_id
)
SELECT mask, CASE WHEN lo IS NULL THEN 'missing' ELSE 'late' END AS kind, count(*) AS "references" FROM f WHERE lo IS NULL OR lo > seen GROUP BY ALL
"""


def sql() -> dict[str, str]:
    """Query name -> SQL."""
    return {
        "p1_found": _P1 + "SELECT DISTINCT line_id, reason FROM why WHERE reason IS NOT NULL",
        "p1_books": _P1
        + "SELECT line_id, file_name, try_cast(trim(id) AS BIGINT) AS id, title, try_cast(trim(author_id) AS BIGINT) AS author_id, nullif(genre, '') AS genre, try_cast(published AS INT) AS published FROM why WHERE reason IS NULL",
        "p2_found": _p2(),
        "p2_typed": _p2_typed(),
        "p3_found": " UNION ALL ".join(_p3_found(*x) for x in (("members", "city"), ("books", "genre"), ("authors", "country"))),
        "p3_profile": _p3_profile(),
        "p4_found": _P4 + "SELECT book_id, kind, from_day, to_day FROM x WHERE kind = 'gap' OR shared",
        "p4_periods": _P4 + "SELECT * FROM x",
        "p5_found": _P5 + "SELECT DISTINCT table_name, column_name, row_id, kind FROM f WHERE kind IS NOT NULL",
        "p5_composite": _P5_COMPOSITE,
        "p5_report": _P5 + "SELECT table_name, column_name, kind, strftime(seen, '%Y-%m') AS month, count(*) AS \"references\" FROM f WHERE kind IS NOT NULL GROUP BY ALL",
    }
