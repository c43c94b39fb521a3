"""DuckDB SQL for the queries of queries.py, from the same test tables."""

from __future__ import annotations

from catlas.plans.queries import _CELLS, _NAMES
from catlas.plans.workload import with_views

# RE2 spellings of the patterns in functions/redaction.py and functions/text.py.
_WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_EQ, _VAL = r"(\s*=\s*)", r"""(?:''[^''\n]*''|"[^"\n]*"|[^\s,;''")]+)"""
_REDACT = (
    ("password", r"(?i)\b(\w*(?:password|pwd))" + _EQ + _VAL, r"\1\2<redacted>"),
    ("connection-string", r"(?i)\b(data source|initial catalog|integrated security)" + _EQ + r"""[^;''"\n]+""", r"\1\2<redacted>"),
    ("api-key", r"(?i)\b(api[_-]?key|access[_-]?token|client[_-]?secret|secret[_-]?key)" + _EQ + _VAL, r"\1\2<redacted>"),
    ("bearer-token", r"(?i)\bBearer\s+[A-Za-z0-9._\-]{12,}", "Bearer <redacted>"),
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "<email>"),
)
_PERSONAL = (
    ("email", "e?mail"), ("phone", "phone|mobile|fax"), ("government-id", "ssn|socialsecurity|nationalid|taxid|vatid"), ("birth", r"birth|dob\b"),
    ("password", "password|secret|token"), ("name", "first_?name|last_?name|middle_?name|full_?name|maiden"), ("address", "address|street|city|zip|postal|county|province"),
    ("financial", "card|cvv|ccnum|iban|routing|accountnumber"), ("location", "latitude|longitude|geoloc"), ("biometric", "signature|photo|avatar"),
)


def _redacted() -> str:
    """t0 is the text, t5 what is left; n0 to n4 count each rule's matches."""
    out = "SELECT *, text AS t0 FROM bodies"
    for i, (_, pattern, replacement) in enumerate(_REDACT):
        out = f"SELECT *, len(regexp_extract_all(t{i}, '{pattern}')) AS n{i}, regexp_replace(t{i}, '{pattern}', '{replacement}', 'g') AS t{i + 1} FROM ({out})"
    return out


def _class(name: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({name}, '(?i){p}') THEN '{c}'" for c, p in _PERSONAL) + " END"


_REASON = """CASE WHEN s.key IS NULL THEN 'new'
  WHEN NOT coalesce(o.modified <> '' AND o.modified = s.modified, false) THEN 'modified'
  WHEN o.kind = 'table' AND greatest(least(o.rows, 25), 0) <> greatest(least(s.rows, 25), 0) THEN 'sample' END"""
_PLAN = f""", plan AS (
  SELECT o.key, CASE WHEN ({_REASON}) IS NULL THEN 'reuse' ELSE 'fetch' END AS action, {_REASON} AS reason
  FROM objects o LEFT JOIN state s USING (key)
  UNION ALL SELECT key, 'dropped', NULL FROM state WHERE key NOT IN (SELECT key FROM objects))"""

_SIZE = """CASE WHEN kb >= 1048576 THEN round(kb / 1048576.0)::BIGINT || ' GB' WHEN kb >= 1024 THEN round(kb / 1024.0)::BIGINT || ' MB' ELSE kb || ' KB' END"""

# The workload's tables with their columns, keys and indexes as text.
_ENTRIES = r""", ixrows AS (
  SELECT key, ord, 'ix' || name[1:4] AS ix, name = 'Email' AS prim, computed AS uniq, 'c' || ord AS col FROM columns),
ix AS (
  SELECT key, ix, min(ord) AS seen_at, arg_min(prim, ord) AS prim, arg_min(uniq, ord) AS uniq, string_agg(col, ',' ORDER BY ord) AS cols, string_agg(col, ', ' ORDER BY ord) AS shown
  FROM ixrows GROUP BY key, ix),
cols AS (
  SELECT key, count(*) AS n, string_agg('c ' || name || ' ' || type || length || CASE WHEN nullable THEN ' null' ELSE ' notnull' END || CASE WHEN identity THEN ' id' ELSE '' END || CASE WHEN computed THEN ' gen' ELSE '' END, chr(10) ORDER BY ord) AS canon,
         string_agg(name || chr(9) || type || length || chr(9) || CASE WHEN nullable THEN 'null' ELSE 'not null' END || chr(9) || concat_ws(' ', CASE WHEN identity THEN 'identity' END, CASE WHEN computed THEN 'computed' END), chr(10) ORDER BY ord) AS shown
  FROM columns GROUP BY key),
parts AS (
  SELECT key, max(CASE WHEN prim THEN 'pk ' || replace(cols, ',', chr(10) || 'pk ') END) AS pk_lines, max(CASE WHEN prim THEN cols END) AS pk_cols,
         string_agg(CASE WHEN NOT prim THEN 'ix ' || ix || ' ' || cols || CASE WHEN uniq THEN ' u' ELSE '' END END, chr(10) ORDER BY seen_at) AS ixs,
         string_agg(CASE WHEN NOT prim THEN ix || '(' || cols || ')' || CASE WHEN uniq THEN 'u' ELSE '' END END, ';' ORDER BY seen_at) AS ix_short,
         string_agg(CASE WHEN NOT prim THEN '# index ' || ix || ' (' || shown || ')' || CASE WHEN uniq THEN ' unique' ELSE '' END END, chr(10) ORDER BY seen_at) AS ix_shown,
         max(CASE WHEN prim THEN shown END) AS pk_shown
  FROM ix GROUP BY key),
entries AS (
  SELECT o.*, coalesce(c.n, 0) AS n, c.shown, p.pk_shown, p.ix_shown, CASE WHEN o.pk % 2 = 0 THEN 'One row.' ELSE '' END AS description,
         sha256(concat_ws(chr(10), c.canon, p.pk_lines, p.ixs, 'tg ' || triggers, 'rows ' || greatest(least(rows, 25), 0)))[1:16] AS fingerprint
  FROM objects o LEFT JOIN cols c USING (key) LEFT JOIN parts p USING (key) WHERE kind = 'table')"""

_OLD = """, olds AS (
  SELECT key, pk, rows, modified, fingerprint, description FROM state WHERE pk % 13 NOT IN (2, 3))"""

_PROJECTED = f""", judged AS (
  SELECT key, ord, name, CASE WHEN {_class("name")} IS NOT NULL THEN 'pii' WHEN lower(trim(type)) IN ('image', 'varbinary', 'binary', 'bytea', 'geography', 'geometry', 'hierarchyid', 'sql_variant', 'timestamp', 'rowversion') THEN 'unsampleable' END AS why FROM columns),
projected AS (
  SELECT o.key, o.rows, string_agg(CASE WHEN why IS NULL THEN judged.name END, ',' ORDER BY ord) AS readable, o.rows <= 25 AS complete,
         concat_ws(chr(10), '# not sampled (pii): ' || string_agg(CASE WHEN why = 'pii' THEN judged.name END, ', ' ORDER BY ord), '# not sampled (unsampleable): ' || string_agg(CASE WHEN why = 'unsampleable' THEN judged.name END, ', ' ORDER BY ord)) AS note
  FROM objects o JOIN judged USING (key) WHERE kind = 'table' GROUP BY o.key, o.rows HAVING count(*) FILTER (why IS NULL) > 0)"""

_RESOLVED = """, given AS (
  SELECT pk % 50 AS batch, lower(CASE WHEN pk % 3 = 0 THEN key WHEN pk % 3 = 1 THEN name ELSE 'no.' || name END) AS told, pk AS pos, 'Holds ' || name AS sentence FROM objects WHERE pk % 10 <> 0),
asked AS (SELECT pk % 50 AS batch, key, lower(key) AS low FROM objects),
exact AS (SELECT g.*, a.key FROM given g JOIN asked a ON g.batch = a.batch AND g.told = a.low),
near AS (
  SELECT g.*, a.key, count(*) OVER (PARTITION BY g.batch, g.pos) AS n FROM given g JOIN asked a ON g.batch = a.batch AND a.low LIKE '%.' || g.told
  WHERE (g.batch, g.pos) NOT IN (SELECT (batch, pos) FROM exact)),
resolved AS (
  SELECT batch, key, arg_max(sentence, pos) AS sentence FROM (SELECT batch, key, sentence, pos FROM exact UNION ALL SELECT batch, key, sentence, pos FROM near WHERE n = 1) GROUP BY batch, key)"""

_STAMPED = """WITH s AS (
  SELECT o_orderkey AS pos, o_orderpriority AS tree, o_orderstatus AS connection, 'db' || o_custkey AS database, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS built, o_orderdate AS seen_at
  FROM orders WHERE o_orderkey % 5 <> 0)"""

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()

ORACLE_SQL = {
    "manifest_parse": with_views(
        rf""", raw AS (SELECT pk, {', '.join(f'{c} AS c{i}' for i, c in enumerate(_CELLS))} FROM objects WHERE pk % 19 <> 0),
kinded AS (SELECT trim(c0) AS schema, c1 AS name, CASE c2 WHEN 'rel:r' THEN 'table' WHEN 'rel:m' THEN 'view' WHEN 'pro:f' THEN 'function' WHEN 'pro:p' THEN 'procedure' END AS kind,
  greatest(coalesce(try_cast(c3 AS BIGINT), 0), 0)::BIGINT AS rows, c4::BIGINT AS kb, c5::INT AS triggers FROM raw)
SELECT schema, name, kind, rows, kb, triggers, '' AS modified, schema || '.' || name AS key FROM kinded WHERE kind IS NOT NULL""",
        "objects",
    ),
    "local_manifest": " UNION ALL ".join(f"SELECT 'main.{t}' AS key, 'table' AS kind, (SELECT count(*) FROM {t})::BIGINT AS rows, 0 AS triggers" for t in _TABLES),
    "sqlserver_manifest": """
WITH o AS (SELECT c_custkey AS id, n_name AS schema, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'procedure' END AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey <> 3),
p AS (SELECT o_custkey AS id, sum(CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 1000 ELSE 0 END) AS rows, sum(o_orderkey % 50) * 8 AS kb, count(*) FILTER (o_orderstatus = 'F') AS fired FROM orders GROUP BY 1)
SELECT schema, name, kind, coalesce(rows, 0)::BIGINT AS rows, coalesce(kb, 0)::BIGINT AS kb, coalesce(fired, 0)::INT AS triggers, '2026-01-02T03:04:05' AS modified, schema || '.' || name AS key
FROM o LEFT JOIN p USING (id) WHERE kind IS NOT NULL""",
    "overloads": """
WITH r AS (SELECT DISTINCT lower(n_name) || '.f' || (s_suppkey % 2) AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey > 1)
SELECT key, ord::BIGINT AS ord, name, type, output FROM r CROSS JOIN (VALUES (0, '(returns)', 'integer', false), (1, '$1', 'text', false), (2, '$2', 'integer', true)) v(ord, name, type, output)""",
    "postgres_columns": """
WITH r AS (SELECT s_suppkey AS id, lower(n_name) || '.t' || s_suppkey AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey > 0 AND s_suppkey % 4 <> 2)
SELECT key, (l_orderkey * 10 + l_linenumber)::BIGINT AS ord, 'c' || l_linenumber AS name, CASE l_linenumber WHEN 4 THEN 'character varying' ELSE 'integer' END AS type, CASE l_linenumber WHEN 4 THEN '(20)' ELSE '' END AS length,
  l_returnflag = 'N' AS nullable, l_linenumber = 2 OR (l_linenumber = 3 AND l_orderkey % 2 = 0) AS identity, l_linestatus = 'F' AS computed
FROM lineitem JOIN r ON l_suppkey = r.id""",
    "sqlserver_columns": """
SELECT n_name || '.' || s_name AS key, (l_orderkey * 10 + l_linenumber)::BIGINT AS ord, 'c' || l_linenumber AS name,
  CASE l_linenumber WHEN 1 THEN 'varchar' WHEN 2 THEN 'nvarchar' WHEN 3 THEN 'decimal' ELSE 'int' END AS type,
  CASE WHEN l_linenumber = 3 THEN '(12,3)' WHEN l_linenumber > 3 THEN '' WHEN l_returnflag = 'R' THEN '(max)' WHEN l_linenumber = 1 THEN '(2)' ELSE '(2)' END AS length,
  l_returnflag = 'N' AS nullable, l_linenumber = 1 AS identity, l_linestatus = 'F' AS computed
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey <> 3""",
    "structure_fold": with_views(" SELECT key, count(*)::BIGINT AS n, string_agg(name || ' ' || type || length, ',' ORDER BY ord) AS names FROM columns GROUP BY key", "columns"),
    "index_fold": with_views(_ENTRIES + " SELECT key, coalesce(pk_cols, '') AS pk, coalesce(ix_short, '') AS indexes FROM parts", "objects", "columns"),
    "split_types": """SELECT * FROM (VALUES ('integer', 'integer', ''), ('character varying(50)', 'character varying', '(50)'), ('numeric(18,2)', 'numeric', '(18,2)'),
  ('timestamp(3) without time zone', 'timestamp without time zone', '(3)'), ('integer[]', 'integer[]', ''), ('text', 'text', ''), ('odd(', 'odd(', ''), ('a()b', 'ab', '()')) v(rendered, type, length)""",
    "widths": """SELECT * FROM (VALUES ('int', '4', ''), ('varchar', '50', '(50)'), ('nvarchar', '100', '(50)'), ('nvarchar', '-1', '(max)'), ('varbinary', '-1', '(max)'),
  ('decimal', '9', '(18,2)'), ('numeric', '9', '(10,4)'), ('nchar', '7', '(3)'), ('char', 'x', '')) v(type, bytes, width)""",
    "fetch_plan": with_views(_PLAN + " SELECT key, action, reason FROM plan", "objects", "state"),
    "dropped": with_views(" SELECT key FROM state WHERE key NOT IN (SELECT key FROM objects)", "objects", "state"),
    "reason_counts": with_views(_PLAN + " SELECT reason, count(*) AS n FROM plan WHERE action = 'fetch' AND contains(lower(key), 'obj1') GROUP BY reason", "objects", "state"),
    "narrow": with_views(" SELECT schema, name, key FROM objects WHERE contains(lower(key), 'p3.obj1') ORDER BY schema, name LIMIT 40", "objects"),
    "describe_plan": with_views(
        """, f AS (SELECT key, kind, CASE WHEN pk % 5 = 0 THEN 'moved' ELSE sha256(name)[1:16] END AS fingerprint FROM objects WHERE kind <> 'synonym'),
k AS (SELECT key, description, sha256('obj' || pk)[1:16] AS fp FROM state)
SELECT f.key, f.kind, f.fingerprint, k.description AS prior_description, CASE WHEN f.fingerprint = k.fp AND k.description <> '' THEN 'unchanged' ELSE 'describe' END AS action
FROM f LEFT JOIN k USING (key)""",
        "objects",
        "state",
    ),
    "cache_hits": with_views(" SELECT o.key, o.modified, coalesce(o.modified <> '' AND o.modified = s.modified, false) AS hit FROM objects o LEFT JOIN state s USING (key)", "objects", "state"),
    "fetch_stage": with_views(
        _PLAN + """, held AS (SELECT key, CASE WHEN pk % 5 = 0 THEN '2025-11-30' ELSE modified END AS signal FROM state WHERE pk % 3 <> 1)
SELECT o.key, o.kind, CASE WHEN p.action = 'reuse' AND o.modified <> '' AND o.modified = h.signal THEN 'store' ELSE 'database' END AS origin
FROM objects o JOIN plan p USING (key) LEFT JOIN held h USING (key)""",
        "objects",
        "state",
    ),
    "key_batches": with_views(" SELECT key, ((row_number() OVER (ORDER BY key) - 1) // 40)::BIGINT AS batch FROM objects", "objects"),
    "plan_summary": with_views(_PLAN + " SELECT count(*) FILTER (action = 'fetch') AS fetch, count(*) FILTER (action = 'reuse') AS reuse, count(*) FILTER (action = 'dropped') AS dropped, count(*) FILTER (reason = 'new') AS new FROM plan", "objects", "state"),
    "module_fingerprints": with_views(
        rf""", n AS (SELECT key, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?m)[{_WS.replace(chr(92) + 'n', '')}]+$', '', 'g') AS t FROM bodies)
SELECT key, sha256(regexp_replace(t, '\A[{_WS}]+|[{_WS}]+\z', '', 'g'))[1:16] AS fingerprint FROM n""",
        "bodies",
    ),
    "table_fingerprints": with_views(_ENTRIES + " SELECT key, greatest(least(rows, 25), 0)::BIGINT AS depth, fingerprint FROM entries", "objects", "columns"),
    "redacted_bodies": with_views(
        f""", r AS ({_redacted()})
SELECT key, md5(t5) AS text_md5, coalesce(nullif(concat_ws(', ', {', '.join(f"CASE WHEN n{i} > 0 THEN '{c} ' || n{i} END" for c, i in sorted((c, i) for i, (c, _, _) in enumerate(_REDACT)))}), ''), 'none') AS counts FROM r""",
        "bodies",
    ),
    "redaction_totals": with_views(f", r AS ({_redacted()}) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS class, sum(n{i})::BIGINT AS n FROM r" for i, (c, _, _) in enumerate(_REDACT)) + ") WHERE n > 0", "bodies"),
    "personal_columns": f"SELECT name, {_class('name')} AS class FROM (SELECT unnest([{', '.join(repr(n) for n in _NAMES)}]) AS name)",
    "sample_projection": with_views(_PROJECTED + " SELECT key, readable, note, complete FROM projected", "objects", "columns"),
    "sample_order": with_views(_PROJECTED + ", cut AS (SELECT * FROM projected ORDER BY complete DESC, rows, key LIMIT 50) SELECT key, complete, rows, row_number() OVER (ORDER BY complete DESC, rows, key) AS place, count(*) OVER () AS \"of\" FROM cut", "objects", "columns"),
    "sample_rows": "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name[1:200] AS n_name FROM nation",
    "cost_batches": """
WITH RECURSIVE i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS seen_at, strlen(text) AS cost FROM documents),
b AS (
  SELECT doc_id, seen_at, 0::BIGINT AS batch, cost AS spent, 1 AS held FROM i WHERE seen_at = 1
  UNION ALL
  SELECT i.doc_id, i.seen_at, CASE WHEN spent + cost > 40000 OR held >= 12 THEN batch + 1 ELSE batch END, CASE WHEN spent + cost > 40000 OR held >= 12 THEN cost ELSE spent + cost END, CASE WHEN spent + cost > 40000 OR held >= 12 THEN 1 ELSE held + 1 END
  FROM b JOIN i ON i.seen_at = b.seen_at + 1)
SELECT doc_id::VARCHAR AS key, batch FROM b""",
    "resolve_answers": with_views(_RESOLVED + " SELECT batch, key, sentence FROM resolved", "objects"),
    "missing_answers": with_views(_RESOLVED + " SELECT key FROM asked WHERE key NOT IN (SELECT key FROM resolved)", "objects"),
    "descriptions": with_views(_RESOLVED + " SELECT o.key, coalesce(r.sentence, s.description, '') AS description FROM objects o LEFT JOIN resolved r USING (key) LEFT JOIN state s USING (key)", "objects", "state"),
    "prompts": with_views(
        _ENTRIES + """, told AS (
  SELECT key, string_agg('  ' || name || ' ' || type || length || CASE WHEN nullable THEN '' ELSE ' not null' END, chr(10) ORDER BY ord) AS told FROM columns GROUP BY key)
SELECT e.key, concat_ws(chr(10), 'Table ' || e.key || ' in the test database.', e.rows || ' rows.', '', 'Columns:', coalesce(t.told, '  (none recorded)'),
  chr(10) || 'Primary key: ' || e.pk_shown, '',
  'Say in one sentence what the table holds and what one row of it is. For a lookup of codes, say that. Don''t list its columns.', 'Begin with a verb, in the present tense.') AS prompt
FROM entries e LEFT JOIN told t USING (key)""",
        "objects",
        "columns",
    ),
    "catalog_rows": with_views(_ENTRIES + f" SELECT key, kind, array_to_string([key, rows::VARCHAR, {_SIZE}, triggers::VARCHAR, n::VARCHAR, modified, fingerprint, description], chr(9)) AS line FROM entries", "objects", "columns"),
    "parse_state": with_views(_OLD + " SELECT key, 'table' AS kind, modified, fingerprint, description, rows FROM olds", "state"),
    "catalog_merge": with_views(
        _ENTRIES + _OLD + """, fresh AS (SELECT key, rows::VARCHAR AS rows, description FROM entries WHERE pk % 4 < 2)
SELECT key, rows, description FROM fresh UNION ALL
SELECT key, rows::VARCHAR, description FROM olds WHERE key NOT IN (SELECT key FROM fresh) AND key IN (SELECT key FROM objects)""",
        "objects", "columns", "state",
    ),
    "size_texts": with_views(f" SELECT key, {_SIZE} AS size FROM objects", "objects"),
    "column_files": with_views(
        _ENTRIES + rf""" SELECT key, concat_ws(chr(10), '# ' || key || ' @' || fingerprint, '# rows ' || rows || '  size ' || {_SIZE} || '  triggers ' || triggers, CASE WHEN description <> '' THEN '# ' || description END,
  regexp_replace('column' || chr(9) || 'type' || chr(9) || 'null' || chr(9) || 'extra' || chr(10) || shown, '\s+\z', ''), '# pk ' || pk_shown, ix_shown) || chr(10) AS text FROM entries WHERE n > 0""",
        "objects", "columns",
    ),
    "body_files": with_views(
        r""", b AS (SELECT *, regexp_replace(text, '[ \t\n\r]+\z', '') AS body FROM bodies)
SELECT key, md5(concat_ws(chr(10), '-- ' || key || ' @0123456789abcdef', CASE WHEN doc_id % 2 = 0 THEN '-- modified 2026-01-01' END, '-- Says things.', '', body, CASE WHEN strlen(body) >= 50000 THEN '-- definition cut' END) || chr(10)) AS file_md5 FROM b""",
        "bodies",
    ),
    "roster": with_views(
        """, n AS (SELECT kind, count(*) AS n FROM objects GROUP BY kind)
SELECT 'prod/core' AS key, array_to_string(['prod', 'core', 'postgres', '5', '', '', '', '', ''], chr(9)) AS line UNION ALL
SELECT 'stage/test', 'stage' || chr(9) || 'test' || chr(9) || 'spark' || chr(9) || (SELECT string_agg(coalesce(n, 0)::VARCHAR, chr(9) ORDER BY i) FROM (VALUES (0, 'table'), (1, 'view'), (2, 'procedure'), (3, 'function'), (4, 'synonym')) v(i, kind) LEFT JOIN n USING (kind)) || chr(9) || '2026-03-05T09:00:00Z'""",
        "objects",
    ),
    "mentions": with_views(" SELECT key FROM bodies WHERE contains(text, 'app3.obj3')", "bodies"),
    "writers": with_views(r" SELECT DISTINCT key FROM (SELECT key, unnest(string_split(text, chr(10))) AS line FROM bodies) WHERE regexp_matches(line, '(?i)(insert|update|delete|merge)[^;]{0,40}app3\.obj3')", "bodies"),
    "all_mentions": with_views(" SELECT o.key, b.key AS body FROM objects o JOIN bodies b ON contains(b.text, o.key)", "objects", "bodies"),
    "all_writers": with_views(
        r""", lines AS (SELECT key AS body, unnest(string_split(text, chr(10))) AS line FROM bodies),
said AS (SELECT DISTINCT body, line FROM lines WHERE regexp_matches(line, '(?i)insert|update|delete|merge') AND contains(line, '.'))
SELECT DISTINCT o.key, body FROM objects o JOIN said ON contains(lower(line), lower(o.key)) WHERE regexp_matches(line, '(?i)(insert|update|delete|merge)[^;]{0,40}' || replace(o.key, '.', '\.'))""",
        "objects",
        "bodies",
    ),
    "server_health": r"""
WITH r AS (
  SELECT s_suppkey AS server, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 2 = 0 END AS seen, floor(s_acctbal / 100) / 4 AS gb,
         CASE WHEN s_nationkey % 5 = 0 THEN 'memory is Low' ELSE 'memory is fine' END AS state, s_suppkey % 11 = 0 AS low, s_suppkey % 9 AS waiting FROM supplier),
w AS (
  SELECT server, seen IS NOT NULL AS known,
         CASE WHEN seen IS NULL THEN 'server memory state could not be read' WHEN seen AND gb < 2 THEN 'only ' || regexp_replace(gb::VARCHAR, '\.0$', '') || ' GB of OS memory free (floor is 2 GB)'
              WHEN seen AND contains(lower(state), 'low') THEN 'the server reports "' || state || '"' WHEN low THEN 'the server signalled physical memory low'
              WHEN waiting > 5 THEN waiting || ' queries are queued waiting for a resource' ELSE '' END AS reason FROM r)
SELECT server, reason = '' AS ok, known, reason FROM w""",
    "oldest_build": _STAMPED + " SELECT connection, database, built FROM s ORDER BY seen_at, pos LIMIT 1",
    "tree_ages": _STAMPED + """, f AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY seen_at, pos) AS n FROM s),
h AS (SELECT *, date_diff('second', seen_at, TIMESTAMP '2026-03-05 09:30:00') / 3600.0 AS hours FROM f WHERE n = 1)
SELECT tree, connection, database, built, hours::DOUBLE AS hours, CASE WHEN hours >= 24 THEN floor(hours / 24)::BIGINT || CASE WHEN floor(hours / 24) = 1 THEN ' day' ELSE ' days' END ELSE floor(hours)::BIGINT || CASE WHEN floor(hours) = 1 THEN ' hour' ELSE ' hours' END END AS age FROM h""",
    "health_verdicts": """SELECT * FROM (VALUES (true, 0, true, true, ''), (true, 0, false, true, 'only 1.5 GB of OS memory free (floor is 2 GB)'), (true, 0, false, true, 'the server reports "Memory is LOW"'),
  (true, 9, false, true, 'the server signalled physical memory low'), (false, 6, false, true, '6 queries are queued waiting for a resource'), (false, 5, true, true, ''),
  (NULL, NULL, false, false, 'server memory state could not be read')) v(memory_visible, waiting, ok, known, reason)""",
}
