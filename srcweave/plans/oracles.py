"""The expected result of each query as plain SQL over the supplied tables.

For the derived corpora the expectation is arithmetic on the part table: it knows
which lines a module has, and never looks at the text a parser would read.
"""

from __future__ import annotations

from srcweave.functions.severity import SARIF_LEVEL, SEVERITY_RANK, SEVERITY_WEIGHT
from srcweave.operators.findings import SECRET_IN_TEXT
from srcweave.operators.rules import RULE_TABLE
from srcweave.plans import corpus_text as CT
from srcweave.plans.corpus_text import PY_LINES, content_sql, count_sql, line_sql, st

# Expected values, stated here on their own: rule, name and description.
PY_RULE_TEXTS = (
    ("py-001", "SQL Injection", "A SQL text with interpolated, possibly tainted parts is executed"),
    ("py-002", "Command Injection", "Possibly tainted text is run as a command or as code"),
    ("py-003", "Path Traversal", "A possibly tainted path is opened without validation"),
    ("py-004", "Hardcoded Secrets", "A password, key or token is a literal in the code"),
    ("py-005", "Unsafe Deserialization", "Bytes are turned into objects by a loader that can run code"),
    ("py-006", "Missing Authentication", "A route handler has no authentication decorator"),
)

# Pieces -----------------------------------------------------------------------


def cid(kind: str, path: str, name: str) -> str:
    """Component id."""
    return (
        f"('{kind}-' || lower(regexp_replace({name}, '[^a-zA-Z0-9]', '-', 'g')) || '-' || "
        f"substr(sha256(lower('{kind}:' || {path} || ':' || {name})), 1, 8))"
    )


def rid(source: str, target: str, kind: str) -> str:
    """Relationship id; ``kind`` is a SQL expression."""
    return (
        f"('rel-' || {kind} || '-' || "
        f"substr(sha256({source} || ':' || {target} || ':' || {kind}), 1, 8))"
    )


def path_of(key: str, ext: str = "py") -> str:
    if ext == "py":
        return (
            f"('/corpus/proj' || {st(f'({key}) % 4')} || '/pkg' || {st(f'({key}) % 20')} "
            f"|| '/m' || {st(key)} || '.py')"
        )
    return (
        f"('/tscorpus/web' || {st(f'({key}) % 4')} || '/src/d' || {st(f'({key}) % 20')} "
        f"|| '/m' || {st(key)} || '.ts')"
    )


def file_id(key: str, ext: str = "py") -> str:
    return cid("file", path_of(key, ext), f"('m' || {st(key)} || '.{ext}')")


def class_id(key: str, ext: str = "py") -> str:
    return cid("class", path_of(key, ext), f"('C' || {st(key)})")


def func_id(key: str) -> str:
    return cid("function", path_of(key), f"('f' || {st(key)})")


def ln(tag: str) -> str:
    return line_sql(PY_LINES, tag)


_N_LINES = f"CAST({count_sql(PY_LINES)} AS INTEGER)"

#: Module rows with path and project.
C = (
    f"WITH keys AS ({CT.keys_sql('part')}), c AS (SELECT *, {CT.PY_PROJECT} AS project_id, "
    f"{CT.PY_MAIN} AS file_path, {CT.PY_DIR} AS dir FROM keys)"
)


def _extra(kind: str) -> str:
    _, when, path, text = next(e for e in CT.PY_EXTRAS if e[0] == kind)
    return (
        f"SELECT k, s, '{kind}' AS kind, project_id, dir || {path} AS file_path, dir, "
        f"{text} AS content FROM c WHERE {when}"
    )


#: All scanned files with their text.
FILES = (
    C + f", files AS (SELECT k, s, 'main' AS kind, project_id, file_path, dir, "
    f"{content_sql(PY_LINES)} AS content FROM c UNION ALL {_extra('data')} UNION ALL "
    f"{_extra('broken')} UNION ALL {_extra('ui')})"
)
_LINES_OF = "CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INTEGER)"
_BASE = "regexp_extract(file_path, '[^/]*$')"

#: Components of the Python files.
COMPS = FILES + f""", comps AS (
  SELECT project_id, k, {_BASE} AS name, 'file' AS type, file_path, dir, 1 AS start_line,
    {_LINES_OF} AS end_line, false AS is_exported FROM files WHERE kind <> 'ui'
  UNION ALL SELECT project_id, k, 'C' || {st('k')}, 'class', file_path, dir,
    CASE WHEN s % 4 = 0 THEN {ln('class2')} ELSE {ln('class1')} END,
    CASE WHEN s % 25 = 0 THEN {ln('step7')} WHEN k % 2 = 1 THEN {ln('poll')} + 1
      ELSE {ln('make_call')} END, true FROM c
  UNION ALL SELECT project_id, k, 'setup', 'function', file_path, dir, {ln('setup')},
    {ln('setup')} + 1, true FROM c
  UNION ALL SELECT project_id, k, '_h' || {st('k')}, 'function', file_path, dir,
    {ln('private')}, {ln('private')} + 1, false FROM c WHERE k % 2 = 0
  UNION ALL SELECT project_id, k, 'f' || {st('k')}, 'function', file_path, dir,
    CASE WHEN k % 17 = 0 THEN {ln('def5')} ELSE {ln('def1')} END, {ln('ret')}, true FROM c
), components AS (SELECT *, end_line - start_line + 1 AS loc,
  type || '-' || lower(regexp_replace(name, '[^a-zA-Z0-9]', '-', 'g')) || '-' ||
  substr(sha256(lower(type || ':' || file_path || ':' || name)), 1, 8) AS id FROM comps)"""

#: Relationships; the module whose path is last owns the shared name ``setup``.
RELS = COMPS + f""", last AS (SELECT project_id, max(file_path) AS path FROM c GROUP BY 1),
setups AS (SELECT project_id, {cid('function', 'path', "'setup'")} AS id FROM last),
imp AS (SELECT project_id, k, i, {file_id('k')} AS source, {file_id('i')} AS target,
  'imports' AS type, 'C' || {st('i')} AS specifiers FROM c),
inh AS (SELECT project_id, {class_id('k')} AS source, {class_id('b')} AS target,
    'extends' AS type, CAST(NULL AS STRING) AS specifiers FROM c
  UNION ALL SELECT project_id, {class_id('k')}, {class_id('b2')}, 'implements', NULL
    FROM c WHERE s % 4 = 0),
cal AS (SELECT project_id, {class_id('k')} AS source, {func_id('c')} AS target, 'calls' AS type,
    CAST(NULL AS STRING) AS specifiers FROM c
  UNION ALL SELECT c.project_id, {class_id('c.k')}, id, 'calls', NULL
    FROM c JOIN setups USING (project_id)
  UNION ALL SELECT c.project_id, {func_id('c.k')}, id, 'calls', NULL
    FROM c JOIN setups USING (project_id)),
rels AS (SELECT *, {rid('source', 'target', 'type')} AS id FROM (
  SELECT project_id, source, target, type, specifiers FROM imp
  UNION ALL SELECT * FROM inh UNION ALL SELECT * FROM cal) q)"""

_TAINTED = "k % 13 <> 0"


def _rule(rule: str, slug: str, severity: str, when: str, first: str, last: str, title: str,
          snippet: str) -> str:
    return (
        f"SELECT project_id, k, dir, file_path, '{rule}' AS rule_id, '{severity}' AS severity, "
        f"{first} AS start_line, {last} AS end_line, '{slug}' AS slug, {title} AS title, "
        f"{snippet} AS snippet FROM c WHERE {when}"
    )


_ROUTE_LINE = f"CASE WHEN k % 10 = 3 THEN {ln('health')} ELSE {ln('route')} END"
_V = CT.VAR
_ROUTE_TEXT = "concat_ws(chr(10), " + ", ".join(
    f"CASE WHEN {line.when} THEN {line.text} END" if line.when else line.text
    for line in PY_LINES[[x.tag for x in PY_LINES].index("health"):
                         [x.tag for x in PY_LINES].index("pad")]
) + ")"


def findings_sql(prefix: str = C, name: str = "found") -> str:
    """CTEs up to ``found``: the expected findings."""
    rules = [
        _rule("py-001", "py-sql-injection", "high", f"s % 5 = 0 AND {_TAINTED}", ln("sink0"),
              ln("sink0"), "'SQL injection via string interpolation'",
              f"'db.execute(f\"SELECT * FROM t WHERE id = {{' || {_V} || '}}\")'"),
        _rule("py-002", "py-cmd-injection", "critical", f"s % 5 = 1 AND {_TAINTED}", ln("sink1"),
              ln("sink1"), "'Command injection via os.system()'",
              f"'os.system(\"ls \" + ' || {_V} || ')'"),
        _rule("py-003", "py-path-traversal", "high",
              f"s % 5 = 2 AND k % 7 <> 0 AND {_TAINTED}", ln("sink2"), ln("sink2"),
              "'Path traversal via open()'", f"'open(' || {_V} || ')'"),
        _rule("py-004", "py-hardcoded-secret", "medium", "s % 7 = 0", ln("secret"), ln("secret"),
              "'Hardcoded secret detected'",
              f"'password = ' || substr('\"pw-' || {st('k')} || '\"', 1, 20) || '...'"),
        _rule("py-005", "py-unsafe-deser", "critical", "s % 5 = 3 AND k % 2 = 0", ln("sink3"),
              ln("sink3"), "'Unsafe deserialization via pickle.loads()'",
              f"'pickle.loads(' || {_V} || ')'"),
        _rule("py-006", "py-missing-auth", "medium", "k % 10 <> 3 AND s % 3 <> 0", ln("route"),
              ln("ret"),
              f"'Route handler \"f' || {st('k')} || '\" missing authentication'",
              f"substr({_ROUTE_TEXT}, 1, 200)"),
    ]
    body = " UNION ALL ".join(rules)
    named = (
        "'finding-' || slug || '-' || CAST(start_line AS STRING) || '-' || substr(sha256(lower("
        "'finding:' || file_path || ':' || slug || '-' || CAST(start_line AS STRING))), 1, 8)"
    )
    return f"{prefix}, {name}_rows AS ({body}), {name} AS (SELECT *, {named} AS id FROM {name}_rows)"


FOUND = findings_sql()
_RANK = "CASE severity " + " ".join(
    f"WHEN '{s}' THEN {r}" for s, r in SEVERITY_RANK.items()) + " END"
_WEIGHT = "CASE severity " + " ".join(
    f"WHEN '{s}' THEN {w}" for s, w in SEVERITY_WEIGHT.items()) + " END"
_HIT = "project_id, id, rule_id, severity, file_path, start_line, end_line"
_PY_FILES = (
    "(SELECT file_path AS project_id FROM files WHERE kind <> 'ui')"
)
_GRADE = (
    "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' "
    "WHEN score >= 60 THEN 'D' ELSE 'F' END"
)


def posture_sql(prefix: str, projects: str, key: str = "project_id", found: str = "found") -> str:
    """CTEs up to ``posture``."""
    return f"""{prefix}, tally AS (SELECT p.project_id, count(f.severity) AS total,
  count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'high') AS high,
  count(*) FILTER (WHERE severity = 'medium') AS medium,
  count(*) FILTER (WHERE severity = 'low') AS low,
  CAST(greatest(0, least(100, 100 - coalesce(sum({_WEIGHT}), 0))) AS INTEGER) AS score
  FROM {projects} p LEFT JOIN (SELECT {key} AS project_id, severity FROM {found}) f
  USING (project_id) GROUP BY 1), posture AS (SELECT *, {_GRADE} AS grade,
  CASE WHEN total = 0
    THEN 'No security findings detected. Static analysis passed all Python rules.'
    ELSE 'Found ' || total || ' security issues: ' || critical || ' critical, ' || high ||
      ' high, ' || medium || ' medium, ' || low || ' low. Score: ' || score || '/100 (' ||
      {_GRADE} || ').' END AS summary FROM tally)"""


_PROJECTS = "(SELECT DISTINCT project_id FROM c)"

EVENT_EDGES = """WITH edges AS (SELECT DISTINCT 'events' AS project_id,
  'u' || CAST(user_id AS STRING) AS source, 'u' || json_extract_string(props, '$.k') AS target,
  event_type AS type FROM events)"""
EVENT_DEGREE = EVENT_EDGES + """, deg AS (SELECT project_id, id, CAST(sum(i) AS BIGINT) AS in_degree,
  CAST(sum(o) AS BIGINT) AS out_degree FROM (
  SELECT project_id, source AS id, 0 AS i, 1 AS o FROM edges UNION ALL
  SELECT project_id, target, 1, 0 FROM edges) q GROUP BY 1, 2)"""
REL_DEGREE = RELS + """, deg AS (SELECT project_id, id, CAST(sum(i) AS BIGINT) AS in_degree,
  CAST(sum(o) AS BIGINT) AS out_degree FROM (
  SELECT project_id, source AS id, 0 AS i, 1 AS o FROM rels UNION ALL
  SELECT project_id, target, 1, 0 FROM rels) q GROUP BY 1, 2)"""

TRADE = """WITH nodes AS (
  SELECT 'trade' AS project_id, 'c' || c_custkey AS id, n_name AS cluster
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'trade', 's' || s_suppkey, n_name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'trade', 'p' || p_partkey, p_brand FROM part),
edges AS (SELECT DISTINCT 'trade' AS project_id, 'c' || o_custkey AS source,
  's' || l_suppkey AS target, 'buys' AS type FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
placed AS (SELECT e.*, a.cluster AS source_cluster, b.cluster AS target_cluster FROM edges e
  JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target),
crossing AS (SELECT * FROM placed WHERE source_cluster <> target_cluster)"""

#: Import edges with the folder of both ends.
IMPORT_DIRS = C + f""", placed AS (SELECT DISTINCT project_id, k, i, dir AS source_cluster,
  '/corpus/proj' || {st('i % 4')} || '/pkg' || {st('i % 20')} AS target_cluster FROM c),
crossing AS (SELECT * FROM placed WHERE source_cluster <> target_cluster),
pairs AS (SELECT project_id, source_cluster, target_cluster, count(*) AS n FROM crossing
  GROUP BY 1, 2, 3)"""


def _recursive(body: str, rest: str) -> str:
    return f"{C.replace('WITH ', 'WITH RECURSIVE ', 1)}, {body} {rest}"


GRAPH_REACH = C.replace("WITH ", "WITH RECURSIVE ", 1) + """,
closure AS (SELECT k AS a, i AS z FROM c UNION SELECT closure.a, c.i FROM closure
  JOIN c ON c.k = closure.z)"""

_METHODS = f"""methods AS (
  SELECT k, s, project_id, 'C' || {st('k')} AS class_name, * FROM c,
  (VALUES ('__init__', 'private', false, false, 'unknown', 'all'),
          ('run', 'public', false, false, 'int', 'all'),
          ('make', 'public', true, false, 'unknown', 'all'),
          ('_poll', 'private', false, true, 'unknown', 'odd'),
          {', '.join(f"('step{j}', 'public', false, false, 'unknown', 'steps')" for j in range(8))})
  v(name, visibility, is_static, is_async, return_type, on_)
  WHERE on_ = 'all' OR (on_ = 'odd' AND k % 2 = 1) OR (on_ = 'steps' AND s % 25 = 0))"""


def _secret_regex() -> str:
    return SECRET_IN_TEXT.replace("'", "''")


ORACLES: dict[str, str] = {
    # Scans
    "scan_corpus": FILES + f""" SELECT project_id, file_path, dir, {_BASE} AS base_name,
      regexp_extract(file_path, '\\.[^./]*$') AS ext,
      CASE WHEN kind = 'ui' THEN 'typescript' ELSE 'python' END AS language,
      {_LINES_OF} AS n_lines FROM files""",
    "filter_vendored": f"""WITH keys AS ({CT.keys_sql('part')}) SELECT {CT.TS_PROJECT} AS project_id,
      {CT.TS_MAIN} AS file_path FROM keys""",
    "explode_lines": FILES + """ SELECT project_id, file_path, CAST(u.n AS INTEGER) AS line_no,
      u.line FROM (SELECT project_id, file_path, unnest(string_split(content, chr(10))) AS line,
      generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files) u""",
    "file_loc": FILES + f" SELECT project_id, file_path, {_LINES_OF} AS loc FROM files",
    "path_parts": FILES + f""" SELECT file_path, dir, {_BASE} AS base,
      'pkg' || {st('k % 20')} AS grp, 3 AS depth FROM files""",
    "detect_language": FILES + f""", ts AS (SELECT {CT.TS_PROJECT} AS project_id, k, s FROM keys),
      counted AS (SELECT project_id, count(*) FILTER (WHERE kind = 'ui') AS n_ts,
        count(*) FILTER (WHERE kind <> 'ui') AS n_py FROM files GROUP BY 1
      UNION ALL SELECT project_id, count(*) + count(*) FILTER (WHERE s % 10 = 2), 0
        FROM ts GROUP BY 1)
      SELECT *, CASE WHEN n_py > n_ts THEN 'python' ELSE 'typescript' END AS language
      FROM counted""",
    "parse_errors": FILES + " SELECT project_id, file_path FROM files WHERE kind = 'broken'",
    "py_facts": C + f""", facts AS (
      SELECT project_id, file_path, 'decl' AS fact, 'setup' AS name, {ln('setup')} AS line FROM c
      UNION ALL SELECT project_id, file_path, 'decl', '_h' || {st('k')}, {ln('private')} FROM c WHERE k % 2 = 0
      UNION ALL SELECT project_id, file_path, 'decl', 'C' || {st('k')},
        CASE WHEN s % 4 = 0 THEN {ln('class2')} ELSE {ln('class1')} END FROM c
      UNION ALL SELECT project_id, file_path, 'decl', 'f' || {st('k')},
        CASE WHEN k % 17 = 0 THEN {ln('def5')} ELSE {ln('def1')} END FROM c
      UNION ALL SELECT project_id, file_path, 'import', unnest(['os', 'pickle', 'yaml']), 1 FROM c
      UNION ALL SELECT project_id, file_path, 'import',
        CASE WHEN k % 3 = 0 THEN 'pkg' || {st('i % 20')} || '.m' || {st('i')} ELSE 'm' || {st('i')} END, 2 FROM c
      UNION ALL SELECT project_id, file_path, 'call', 'setup', {ln('init_cache')} FROM c
      UNION ALL SELECT project_id, file_path, 'call', 'f' || {st('c')}, {ln('run_call')} FROM c
      UNION ALL SELECT project_id, file_path, 'call', 'C' || {st('k')}, {ln('make_call')} FROM c
      UNION ALL SELECT project_id, file_path, 'call', 'app.route', {_ROUTE_LINE} FROM c
      UNION ALL SELECT project_id, file_path, 'call', 'int', {ln('v0_clean')} FROM c WHERE k % 13 = 0
      UNION ALL SELECT project_id, file_path, 'call', 'os.path.abspath', {ln('check')} FROM c WHERE s % 5 = 2 AND k % 7 = 0
      UNION ALL SELECT project_id, file_path, 'call', 'db.execute', {ln('sink0')} FROM c WHERE s % 5 = 0
      UNION ALL SELECT project_id, file_path, 'call', 'os.system', {ln('sink1')} FROM c WHERE s % 5 = 1
      UNION ALL SELECT project_id, file_path, 'call', 'open', {ln('sink2')} FROM c WHERE s % 5 = 2
      UNION ALL SELECT project_id, file_path, 'call', 'pickle.loads', {ln('sink3')} FROM c WHERE s % 5 = 3 AND k % 2 = 0
      UNION ALL SELECT project_id, file_path, 'call', 'yaml.load', {ln('sink3_safe')} FROM c WHERE s % 5 = 3 AND k % 2 = 1
      UNION ALL SELECT project_id, file_path, 'call', 'db.execute', {ln('sink4')} FROM c WHERE s % 5 = 4
      UNION ALL SELECT project_id, file_path, 'call', 'setup', {ln('ret')} FROM c
      UNION ALL SELECT project_id, file_path, 'assign', 'password', {ln('secret')} FROM c WHERE s % 7 = 0
      UNION ALL SELECT project_id, file_path, 'assign', 'token', {ln('placeholder')} FROM c WHERE k % 5 = 0
      UNION ALL SELECT project_id, file_path, 'assign', 'db_password', {ln('other_name')} FROM c WHERE k % 11 = 0
      UNION ALL SELECT project_id, file_path, 'assign', 'kind', {ln('prop_kind')} FROM c
      UNION ALL SELECT project_id, file_path, 'assign', '_size', {ln('prop_size')} FROM c
      UNION ALL SELECT project_id, file_path, 'assign', 'self.n', {ln('init_n')} FROM c
      UNION ALL SELECT project_id, file_path, 'assign', 'self._cache', {ln('init_cache')} FROM c
      UNION ALL SELECT project_id, file_path, 'assign', 'v0', CASE WHEN k % 13 = 0 THEN {ln('v0_clean')} ELSE {ln('v0')} END FROM c
      UNION ALL SELECT project_id, file_path, 'assign', 'v1', {ln('v1')} FROM c WHERE k % 3 >= 1
      UNION ALL SELECT project_id, file_path, 'assign', 'v2', {ln('v2')} FROM c WHERE k % 3 = 2
      UNION ALL SELECT project_id, dir || '/data' || {st('k')} || '.py', 'assign', 'VALUE', 1 FROM c WHERE s % 10 = 0)
      SELECT * FROM facts""",
    # Components
    "all_components": COMPS + """ SELECT project_id, id, name, type, file_path, start_line, end_line,
      loc, is_exported FROM components""",
    "component_ids": f"SELECT p_partkey, {cid('class', 'p_brand', 'p_name')} AS id FROM part",
    "relationship_ids": EVENT_EDGES
    + f" SELECT source, target, type, {rid('source', 'target', 'type')} AS id FROM edges",
    "components_by_type": COMPS + " SELECT project_id, id, name FROM components WHERE type = 'class'",
    "count_by_type": COMPS + " SELECT project_id, type, count(*) AS n FROM components GROUP BY 1, 2",
    "count_edge_types": RELS + " SELECT project_id, type, count(*) AS n FROM rels GROUP BY 1, 2",
    "exported_functions": COMPS
    + " SELECT project_id, id, name FROM components WHERE type = 'function' AND is_exported",
    "large_classes": C + f""" SELECT project_id, {class_id('k')} AS id, 'C' || {st('k')} AS name,
      file_path, CAST(11 + k % 2 AS INTEGER) AS n_methods FROM c WHERE s % 25 = 0""",
    "complex_functions": C + f""" SELECT project_id, {func_id('k')} AS id, 'f' || {st('k')} AS name,
      file_path, 5 AS n_params FROM c WHERE k % 17 = 0""",
    "large_files": C + f""" SELECT project_id, {file_id('k')} AS id, 'm' || {st('k')} || '.py' AS name,
      file_path, {_N_LINES} AS loc FROM c WHERE s = 50""",
    "large_documents": "SELECT doc_id, source, n_chars FROM documents WHERE n_chars >= 3000",
    "leaf_files": COMPS + """ SELECT project_id, id, name FROM components x WHERE type = 'file' AND
      NOT EXISTS (SELECT 1 FROM components y WHERE y.file_path = x.file_path AND y.type <> 'file')""",
    "py_visibility": C + f", {_METHODS}" + """ SELECT project_id, class_name, name, visibility,
      is_static, is_async, return_type FROM methods""",
    "method_params": C + f""" SELECT project_id, 'C' || {st('k')} AS class_name, method_name,
      CAST(pos AS INTEGER) AS pos, name, type, is_optional FROM c,
      (VALUES ('__init__', 0, 'n', 'unknown', false), ('run', 0, 'n', 'int', true),
        ('run', 1, '*rest', 'unknown', true), ('make', 0, 'x', 'unknown', false))
      v(method_name, pos, name, type, is_optional)""",
    "class_properties": C + f""" SELECT project_id, 'C' || {st('k')} AS class_name,
      CAST(pos AS INTEGER) AS pos, name, type, visibility FROM c,
      (VALUES (0, 'kind', 'str', 'public'), (1, '_size', 'unknown', 'private'),
        (2, 'n', 'unknown', 'public'), (3, '_cache', 'unknown', 'private'))
      v(pos, name, type, visibility)""",
    "class_bases": C + f""" SELECT project_id, 'C' || {st('k')} AS name, 'C' || {st('b')} AS extends,
      CASE WHEN s % 4 = 0 THEN 'C' || {st('b2')} ELSE '' END AS implements FROM c""",
    # Resolution
    "module_names": FILES + """, stems AS (SELECT project_id, file_path,
        string_split(regexp_replace(file_path, '\\.py$', ''), '/') AS p FROM files WHERE kind <> 'ui'),
      names AS (SELECT project_id, file_path, array_to_string(p[j:], '.') AS module
        FROM stems, generate_series(2, 5) g(j))
      SELECT project_id, module, max(file_path) AS target_path FROM names GROUP BY 1, 2""",
    "import_edges": RELS + f""" SELECT project_id, {rid('source', 'target', 'type')} AS id, source,
      target, type, specifiers FROM imp""",
    "relative_imports": C + f""" SELECT project_id, file_path,
      'pkg' || {st('i % 20')} || '.m' || {st('i')} AS module, 2 AS level,
      {path_of('i')} AS target_path FROM c WHERE k % 3 = 0""",
    "import_specifiers": RELS + f""" SELECT project_id, {rid('source', 'target', 'type')} AS id,
      0 AS pos, specifiers AS name FROM imp""",
    "inherit_edges": RELS + f""" SELECT project_id, {rid('source', 'target', 'type')} AS id, source,
      target, type, specifiers FROM inh""",
    "call_edges": RELS + f""" SELECT project_id, {rid('source', 'target', 'type')} AS id, source,
      target, type, specifiers FROM cal""",
    "all_relationships": RELS + " SELECT project_id, id, source, target, type, specifiers FROM rels",
    "resolve_ids": C + f""" SELECT project_id, 'c' || {st('k')} AS ref_name, 'class-c' || {st('k')} || '-' ||
      substr(sha256(lower('class:' || file_path || ':C' || {st('k')})), 1, 8) AS id,
      'C' || {st('k')} AS found_name FROM c""",
    "name_map": COMPS + """ SELECT project_id, name, id, file_path FROM components x
      WHERE type <> 'file' AND file_path = (SELECT max(file_path) FROM components y
        WHERE y.project_id = x.project_id AND y.name = x.name AND y.type <> 'file')""",
    "dedup_first": """SELECT l_partkey, l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_quantity,
      l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY
      l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS r FROM lineitem) q
      WHERE r = 1""",
    "dup_check": """SELECT project_id, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys,
      count(*) FILTER (WHERE n > 1) AS n_repeated FROM (SELECT l_returnflag AS project_id,
      l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) q GROUP BY 1""",
    # Graph
    "graph_nodes": REL_DEGREE + """ SELECT x.project_id, x.id, name AS label, type,
      regexp_extract(dir, '[^/]*$') AS "group", round(greatest(1.0, log2(loc + 1) +
      coalesce(in_degree + out_degree, 0)), 6) AS size, loc FROM components x
      LEFT JOIN deg ON deg.id = x.id AND deg.project_id = x.project_id""",
    "graph_edges": RELS + """ SELECT project_id, id, source, target, type, CASE type
      WHEN 'imports' THEN 2 WHEN 'calls' THEN 1 ELSE 3 END AS weight FROM rels""",
    "clusters": COMPS + """ SELECT project_id, dir, 'cluster-' || regexp_extract(dir, '[^/]*$') AS
      cluster_id, regexp_extract(dir, '[^/]*$') AS label, count(*) AS n_nodes FROM components
      GROUP BY ALL""",
    "cluster_node_lists": COMPS + """, sized AS (SELECT *, CAST(ceil(count(*) OVER
      (PARTITION BY project_id, dir) / 50.0) AS BIGINT) AS nb FROM components)
      SELECT project_id, dir, CAST('0x' || substr(sha256(id), 1, 8) AS BIGINT) % nb AS bucket,
      string_agg(id, ',' ORDER BY id) AS node_ids FROM sized GROUP BY 1, 2, 3""",
    "import_subset": RELS + " SELECT project_id, source AS from_id, target AS to_id FROM imp",
    "node_degree": EVENT_DEGREE + " SELECT project_id, id, in_degree + out_degree AS degree FROM deg",
    "in_out_degree": EVENT_DEGREE + " SELECT * FROM deg",
    "node_size": REL_DEGREE + """ SELECT x.project_id, x.id,
      coalesce(in_degree + out_degree, 0) AS degree, round(greatest(1.0, log2(loc + 1) +
      coalesce(in_degree + out_degree, 0)), 6) AS size FROM components x
      LEFT JOIN deg ON deg.id = x.id AND deg.project_id = x.project_id""",
    "hub_topk": EVENT_DEGREE + """ SELECT *, in_degree + out_degree AS degree FROM deg
      ORDER BY degree DESC, project_id, id LIMIT 10""",
    "hub_topk_per_project": REL_DEGREE + """ SELECT * FROM (SELECT *, in_degree + out_degree AS degree,
      CAST(row_number() OVER (PARTITION BY project_id ORDER BY in_degree + out_degree DESC, id) AS
      INTEGER) AS rank FROM deg) q WHERE rank <= 5""",
    "god_objects": EVENT_DEGREE + """ SELECT *, in_degree + out_degree AS degree, CASE
      WHEN out_degree >= 20 THEN 'orchestrator' WHEN in_degree >= 3.0 * out_degree THEN 'utility'
      ELSE 'mixed' END AS role FROM deg WHERE in_degree + out_degree >= 10""",
    "island_nodes": TRADE + """ SELECT project_id, id, cluster FROM nodes WHERE id NOT IN
      (SELECT source FROM edges UNION ALL SELECT target FROM edges)""",
    "facade_nodes": REL_DEGREE + " SELECT * FROM deg WHERE in_degree >= 5 AND out_degree <= 1",
    "subgraph": RELS + " SELECT project_id, id, source, target, type FROM rels WHERE type <> 'imports'",
    "cluster_coupling": TRADE + """ SELECT project_id, least(source_cluster, target_cluster) AS cluster_a,
      greatest(source_cluster, target_cluster) AS cluster_b, count(*) AS n_edges,
      count(*) FILTER (WHERE source_cluster < target_cluster) AS a_to_b,
      count(*) FILTER (WHERE source_cluster > target_cluster) AS b_to_a,
      count(*) >= 5 AS high_coupling FROM crossing GROUP BY 1, 2, 3""",
    "cross_cluster_edges": TRADE + " SELECT * FROM crossing",
    "isolated_clusters": TRADE + """ SELECT project_id, cluster, count(*) AS n_nodes FROM nodes
      WHERE cluster NOT IN (SELECT source_cluster FROM crossing UNION ALL
      SELECT target_cluster FROM crossing) GROUP BY 1, 2""",
    "one_way_pairs": IMPORT_DIRS + """ SELECT project_id, source_cluster AS from_cluster,
      target_cluster AS to_cluster, n AS n_edges FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs q
      WHERE q.source_cluster = p.target_cluster AND q.target_cluster = p.source_cluster)""",
    "star_clusters": IMPORT_DIRS + """ SELECT project_id, target_cluster AS cluster,
      count(*) AS n_satellites, CAST(sum(n) AS BIGINT) AS n_edges FROM pairs GROUP BY 1, 2
      HAVING count(*) >= 2""",
    "cluster_stats": TRADE + """, sides AS (
      SELECT project_id, cluster, 1 AS node, 0 AS inn, 0.0 AS crs FROM nodes
      UNION ALL SELECT project_id, source_cluster, 0, 1, 0 FROM placed
        WHERE source_cluster = target_cluster
      UNION ALL SELECT project_id, unnest([source_cluster, target_cluster]), 0, 0, 1 FROM crossing)
      SELECT project_id, cluster, CAST(sum(node) AS BIGINT) AS n_nodes,
        CAST(sum(inn) AS BIGINT) AS n_inner, CAST(sum(crs) AS BIGINT) AS n_cross FROM sides
        GROUP BY 1, 2
      UNION ALL SELECT project_id, NULL, CAST(sum(node) AS BIGINT), CAST(sum(inn) AS BIGINT),
        CAST(sum(crs) / 2 AS BIGINT) FROM sides GROUP BY 1""",
    "document_clusters": """SELECT source, count(*) AS n_nodes, CAST(sum(n_chars) AS BIGINT) AS n_chars
      FROM documents GROUP BY ROLLUP (source)""",
    "cyclic_components": GRAPH_REACH + f""", member AS (SELECT x.a AS k, min({path_of('y.a')}) AS scc
      FROM closure x JOIN closure y ON y.a = x.z AND y.z = x.a GROUP BY 1)
      SELECT 'proj' || {st('k % 4')} AS project_id, {path_of('k')} AS id, scc,
      count(*) OVER (PARTITION BY scc) AS size FROM member""",
    "short_cycles": C + f""", s2 AS (SELECT x.k, x.i AS a1, y.i AS a2, z.i AS a3, w.i AS a4
      FROM c x JOIN c y ON y.k = x.i JOIN c z ON z.k = y.i JOIN c w ON w.k = z.i),
      p AS (SELECT {path_of('k')} AS p0, {path_of('a1')} AS p1, {path_of('a2')} AS p2,
        {path_of('a3')} AS p3, 'proj' || {st('k % 4')} AS project_id,
        CASE WHEN a1 = k THEN 1 WHEN a2 = k THEN 2 WHEN a3 = k THEN 3 WHEN a4 = k THEN 4 END AS length
        FROM s2)
      SELECT project_id, CASE length WHEN 1 THEN p0 || ' -> ' || p0
        WHEN 2 THEN p0 || ' -> ' || p1 || ' -> ' || p0
        WHEN 3 THEN p0 || ' -> ' || p1 || ' -> ' || p2 || ' -> ' || p0
        ELSE p0 || ' -> ' || p1 || ' -> ' || p2 || ' -> ' || p3 || ' -> ' || p0 END AS path,
        CAST(length AS INTEGER) AS length,
        CASE WHEN length <= 2 THEN 'high' ELSE 'medium' END AS severity FROM p
      WHERE length IS NOT NULL AND (length = 1 OR p0 < p1) AND (length < 3 OR p0 < p2)
        AND (length < 4 OR p0 < p3)""",
    "dependency_chain": C + f""", hops AS (SELECT x.k, x.i AS a1, y.i AS a2, z.i AS a3 FROM c x
        JOIN c y ON y.k = x.i JOIN c z ON z.k = y.i),
      p AS (SELECT *, CASE WHEN a3 = k THEN 0 WHEN a3 = a1 THEN 1 WHEN a3 = a2 THEN 2 ELSE 3 END
        AS length FROM hops)
      SELECT 'proj' || {st('k % 4')} AS project_id, {path_of('k')} AS source,
      {path_of('a3')} AS target, CAST(length AS INTEGER) AS length,
      {path_of('k')} || CASE WHEN length > 0 THEN ' -> ' || {path_of('a1')} ELSE '' END
        || CASE WHEN length > 1 THEN ' -> ' || {path_of('a2')} ELSE '' END
        || CASE WHEN length > 2 THEN ' -> ' || {path_of('a3')} ELSE '' END AS path FROM p""",
    "reachable": _recursive(
        "walk AS (SELECT k AS seed, k AS node, 0 AS depth FROM c WHERE s % 7 = 0 UNION ALL "
        "SELECT w.seed, c.i, w.depth + 1 FROM walk w JOIN c ON c.k = w.node WHERE w.depth < 40)",
        f"""SELECT 'proj' || {st('seed % 4')} AS project_id, {path_of('seed')} AS seed,
        {path_of('node')} AS id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY walk.seed, walk.node"""),
    "impact_set": _recursive(
        "walk AS (SELECT k AS top, k AS node, 0 AS depth FROM c UNION ALL "
        "SELECT w.top, c.i, w.depth + 1 FROM walk w JOIN c ON c.k = w.node WHERE w.depth < 40)",
        f"""SELECT 'proj' || {st('node % 4')} AS project_id, {path_of('node')} AS seed,
        {path_of('top')} AS id, CAST(min(depth) AS INTEGER) AS depth FROM walk
        WHERE node IN (SELECT k FROM c WHERE s % 7 = 0) GROUP BY walk.node, walk.top"""),
    # Taint
    "taint_closure": C + f""", vars AS (SELECT *, unnest(range(0, k % 3 + 1)) AS j FROM c
        WHERE {_TAINTED}) SELECT project_id, file_path, 'f' || {st('k')} AS func_name,
      'v' || {st('j')} AS var, 'request.args' AS source FROM vars""",
    "taint_paths": C + f""", vars AS (SELECT *, unnest(range(0, k % 3 + 1)) AS j FROM c
        WHERE {_TAINTED}) SELECT project_id, file_path, 'v' || {st('j')} AS var,
      'request.args -> v0' || CASE WHEN j >= 1 THEN ' -> v1' ELSE '' END ||
      CASE WHEN j = 2 THEN ' -> f-string -> v2' ELSE '' END AS path FROM vars""",
    "tainted_sinks": C + f""", calls AS (
      SELECT project_id, file_path, 'setup' AS callee, {ln('ret')} AS line FROM c WHERE {_TAINTED}
      UNION ALL SELECT project_id, file_path, 'int', {ln('v0_clean')} FROM c WHERE NOT ({_TAINTED})
      UNION ALL SELECT project_id, file_path, 'os.path.abspath', {ln('check')} FROM c
        WHERE s % 5 = 2 AND k % 7 = 0 AND {_TAINTED}
      UNION ALL SELECT project_id, file_path, 'db.execute', {ln('sink0')} FROM c WHERE s % 5 = 0 AND {_TAINTED}
      UNION ALL SELECT project_id, file_path, 'os.system', {ln('sink1')} FROM c WHERE s % 5 = 1 AND {_TAINTED}
      UNION ALL SELECT project_id, file_path, 'open', {ln('sink2')} FROM c WHERE s % 5 = 2 AND {_TAINTED}
      UNION ALL SELECT project_id, file_path, 'pickle.loads', {ln('sink3')} FROM c
        WHERE s % 5 = 3 AND k % 2 = 0 AND {_TAINTED}
      UNION ALL SELECT project_id, file_path, 'yaml.load', {ln('sink3_safe')} FROM c
        WHERE s % 5 = 3 AND k % 2 = 1 AND {_TAINTED}
      UNION ALL SELECT project_id, file_path, 'db.execute', {ln('sink4')} FROM c WHERE s % 5 = 4 AND {_TAINTED}) SELECT * FROM calls""",
    # Rules
    **{
        name: FOUND + f" SELECT {_HIT} FROM found WHERE rule_id = '{rule}'"
        for name, rule in {
            "py_sql_injection": "py-001", "py_command_injection": "py-002",
            "py_path_traversal": "py-003", "py_hardcoded_secrets": "py-004",
            "py_unsafe_deser": "py-005", "py_missing_auth": "py-006"}.items()
    },
    "secret_lines": C + f""" SELECT project_id, file_path, {ln('secret')} AS line_no, 'password' AS name,
      '"pw-' || {st('k')} || '"' AS value FROM c WHERE s % 7 = 0""",
    "secret_scan": f"""WITH hits AS (SELECT doc_id, source,
        unnest(regexp_extract_all(text, '{_secret_regex()}')) AS hit FROM documents),
      named AS (SELECT doc_id, source, regexp_extract(hit, '^(\\w+)', 1) AS name,
        regexp_extract(hit, '[:=]\\s*(.*)$', 1) AS value FROM hits)
      SELECT * FROM named WHERE length(value) > 4 AND NOT contains(value, 'os.environ')
      AND NOT contains(value, 'os.getenv')
      AND NOT regexp_matches(value, '^[''"](<.*?>|\\*+|x+|\\.\\.\\.|\\$\\{{.*?\\}})[''"]$')""",
    "all_findings": FOUND + f" SELECT {_HIT} FROM found",
    "finding_snippets": FOUND
    + " SELECT project_id, rule_id, file_path, start_line, title, snippet FROM found",
    "findings_by_rule": FOUND + """ SELECT project_id, rule_id, count(*) AS n,
      min(severity) AS severity FROM found GROUP BY 1, 2""",
    "severity_counts": FOUND + " SELECT project_id, count(*) AS total, " + ", ".join(
        f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in SEVERITY_RANK)
    + " FROM found GROUP BY 1",
    "findings_min_severity": FOUND
    + f" SELECT {_HIT} FROM found WHERE severity IN ('critical', 'high')",
    **{
        name: FOUND + f""" SELECT project_id, id, rule_id, CASE rule_id WHEN 'py-004' THEN 'critical'
        ELSE severity END AS severity, file_path, start_line, end_line FROM found
        WHERE rule_id NOT IN ('py-006', 'py-001')"""
        for name in ("findings_rule_config", "findings_config_table")
    },
    "rules_without_findings": FOUND + f""" SELECT project_id, rule_id, name FROM {_PROJECTS} p,
      (VALUES {', '.join(f"('{r}', '{v[0]}')" for r, v in RULE_TABLE.items() if r[:2] == 'py')})
      v(rule_id, name) WHERE (project_id, rule_id) NOT IN
      (SELECT (project_id, rule_id) FROM found)""",
    "finding_share": FOUND + """ SELECT project_id, rule_id, count(*) AS n, round(count(*) /
      sum(count(*)) OVER (PARTITION BY project_id), 9) AS share FROM found GROUP BY 1, 2""",
    "findings_ranked": FOUND
    + f" SELECT {_RANK} AS rank, project_id, file_path, start_line, rule_id FROM found",
    "action_list": FOUND + """, share AS (SELECT project_id, rule_id, count(*) /
      sum(count(*)) OVER (PARTITION BY project_id) AS share FROM found GROUP BY 1, 2)
      SELECT CASE WHEN severity = 'critical' THEN 1 WHEN share >= 0.3 THEN 2 ELSE 3 END AS priority,
      project_id, file_path, start_line, rule_id, severity FROM found
      JOIN share USING (project_id, rule_id)""",
    "clean_clusters": f"""WITH hits AS (SELECT source,
        unnest(regexp_extract_all(text, '{_secret_regex()}')) AS hit FROM documents),
      named AS (SELECT source, regexp_extract(hit, '[:=]\\s*(.*)$', 1) AS value FROM hits)
      SELECT 'documents' AS project_id, source AS dir, count(*) AS n_nodes FROM documents
      WHERE source NOT IN (SELECT source FROM named WHERE length(value) > 4
        AND NOT contains(value, 'os.environ') AND NOT contains(value, 'os.getenv')
        AND NOT regexp_matches(value, '^[''"](<.*?>|\\*+|x+|\\.\\.\\.|\\$\\{{.*?\\}})[''"]$'))
      GROUP BY 2""",
    "clean_files": findings_sql(FILES) + """ SELECT project_id, file_path FROM files
      WHERE kind <> 'ui' AND file_path NOT IN (SELECT file_path FROM found)""",
    # Posture
    "project_posture": posture_sql(FOUND, _PROJECTS) + """ SELECT project_id, total, critical, high,
      medium, low, score, grade FROM posture""",
    "file_posture": posture_sql(findings_sql(FILES), _PY_FILES, "file_path")
    + " SELECT project_id, total, score, grade FROM posture",
    "posture_summary": posture_sql(findings_sql(FILES), _PY_FILES, "file_path")
    + " SELECT project_id, summary FROM posture",
    "security_gate": posture_sql(findings_sql(FILES), _PY_FILES, "file_path") + """ SELECT project_id,
      critical + high AS n_blocking, critical + high > 0 AS failed,
      CASE WHEN critical + high > 0 THEN 2 ELSE 0 END AS exit_code FROM posture""",
    # Growth
    "growth_snapshot": """SELECT 'events' AS project_id, CAST(CAST(ts AS DATE) AS STRING) AS snapshot,
      event_type AS type, count(*) AS n FROM events GROUP BY ALL""",
    "component_snapshot": COMPS + """ SELECT project_id, count(*) AS total,
      count(*) FILTER (WHERE type = 'file') AS files,
      count(*) FILTER (WHERE type = 'class') AS classes,
      count(*) FILTER (WHERE type = 'function') AS functions, '2024-01-01' AS snapshot
      FROM components GROUP BY 1""",
    "growth_delta": """WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type AS type, count(*) AS n
      FROM events GROUP BY ALL) SELECT 'events' AS project_id, CAST(day AS STRING) AS snapshot, type, n,
      lag(n) OVER w AS n_before, n - lag(n) OVER w AS delta FROM d
      WINDOW w AS (PARTITION BY type ORDER BY day)""",
    # Reports
    "report_summary": RELS + """ SELECT * FROM (SELECT project_id,
      count(*) FILTER (WHERE type = 'file') AS total_files, count(*) AS total_components
      FROM components GROUP BY 1) q JOIN (SELECT project_id, count(*) AS total_relationships
      FROM rels GROUP BY 1) r USING (project_id)""",
    "report_findings": FOUND + """ SELECT project_id, upper(severity) AS severity, rule_id AS rule, title,
      file_path AS file, start_line AS line FROM found""",
    "report_json": posture_sql(findings_sql(RELS), _PROJECTS) + """, totals AS (SELECT * FROM
      (SELECT project_id, count(*) FILTER (WHERE type = 'file') AS f, count(*) AS n
        FROM components GROUP BY 1) q JOIN (SELECT project_id, count(*) AS r FROM rels GROUP BY 1) w
        USING (project_id))
      SELECT project_id, '{"metadata":{"version":"0.1.0","analyzedPath":"' || project_id ||
      '","totalFiles":' || f || ',"totalComponents":' || n || ',"totalRelationships":' || r ||
      '},"security":{"score":' || score || ',"grade":"' || grade || '","summary":"' || summary ||
      '"}}' AS json FROM totals JOIN posture USING (project_id)""",
    "report_sections": RELS + f""", e AS (SELECT project_id, {rid('source', 'target', 'type')} AS id,
        source, target, type, CAST(ceil(count(*) OVER (PARTITION BY project_id) / 100.0) AS BIGINT)
        AS np FROM imp)
      SELECT project_id, 'relationships' AS section,
      CAST('0x' || substr(sha256(id), 1, 8) AS BIGINT) % np AS part,
      '[' || string_agg('{{"project_id":"' || project_id || '","id":"' || id || '","source":"' ||
        source || '","target":"' || target || '","type":"' || type || '"}}', ',' ORDER BY id) || ']'
      AS json FROM e GROUP BY 1, 2, 3""",
    "sarif_results": FOUND + " SELECT project_id, rule_id AS \"ruleId\", CASE severity " + " ".join(
        f"WHEN '{s}' THEN '{v}'" for s, v in SARIF_LEVEL.items())
    + " END AS level, CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{text}'" for r, _, text in PY_RULE_TEXTS)
    + """ END || ' (line ' || CAST(start_line AS STRING) || ')' AS message,
      file_path AS uri, start_line AS "startLine", end_line AS "endLine" FROM found""",
    "sarif_rules": "WITH p AS (SELECT DISTINCT 'proj' || CAST(p_partkey % 4 AS STRING) AS project_id FROM part) "
    "SELECT project_id, v.* FROM p, (VALUES " + ", ".join(f"('{r}', '{name}', '{text}')" for r, name, text in PY_RULE_TEXTS)
    + """) v(id, "shortDescription", "fullDescription")""",
    "contract_check": COMPS + """, t AS (SELECT count(*) AS n,
        count(*) FILTER (WHERE name LIKE '%7') AS bad FROM components)
      SELECT 'components' AS "table", n AS n_rows, "check",
        CASE WHEN "check" = 'type not in list' THEN bad ELSE 0 END AS n_violations FROM t,
      (VALUES ('project_id is null'), ('id is null'), ('name is null'), ('type is null'),
        ('file_path is null'), ('type not in list'), ('lines out of order')) v("check")""",
    "contract_check_findings": FOUND + """, t AS (SELECT count(*) AS n FROM found)
      SELECT 'findings' AS "table", n AS n_rows, "check", CAST(0 AS BIGINT) AS n_violations FROM t,
      (VALUES ('project_id is null'), ('id is null'), ('rule_id is null'), ('severity is null'),
        ('file_path is null'), ('severity not in list'), ('lines out of order')) v("check")""",
}


def _two_scans() -> str:
    """CTEs ``found`` (before) and ``later`` (after the sizes grew by one)."""
    first = findings_sql(FILES)
    second = findings_sql("", "later").removeprefix(", ")
    second = second.replace("FROM c WHERE", "FROM c2 WHERE")
    grown = CT.keys_sql("part").replace("p_size AS s", "p_size + 1 AS s")
    c2 = (
        f", keys2 AS ({grown}), c2 AS (SELECT *, {CT.PY_PROJECT} AS project_id, "
        f"{CT.PY_MAIN} AS file_path, {CT.PY_DIR} AS dir FROM keys2)"
    )
    return f"{first}{c2}, {second}"


_COUNTS = """, counts AS (SELECT project_id, id, CAST(sum(b) AS BIGINT) AS n_before,
  CAST(sum(a) AS BIGINT) AS n_after FROM (SELECT project_id, id, 1 AS b, 0 AS a FROM found
  UNION ALL SELECT project_id, id, 0, 1 FROM later) q GROUP BY 1, 2)"""

ORACLES["findings_diff"] = _two_scans() + _COUNTS + """ SELECT *, CASE
  WHEN n_before < n_after THEN 'new' WHEN n_before > n_after THEN 'fixed' ELSE 'unchanged' END
  AS status FROM counts"""
ORACLES["new_findings"] = _two_scans() + """ SELECT project_id, id FROM later
  EXCEPT ALL SELECT project_id, id FROM found"""

_EXTRA_AFTER = " UNION ALL ".join(
    f"SELECT dir || {path} AS project_id FROM c2 WHERE {when}"
    for kind, when, path, _ in CT.PY_EXTRAS if kind in ("data", "broken")
)


def _scores(found: str, files: str) -> str:
    return (
        f"SELECT p.project_id, CAST(greatest(0, least(100, 100 - coalesce(sum({_WEIGHT}), 0))) "
        f"AS INTEGER) AS score FROM ({files}) p LEFT JOIN {found} f ON f.file_path = p.project_id "
        "GROUP BY 1"
    )


ORACLES["posture_diff"] = (
    _two_scans()
    + ", b AS ("
    + _scores("found", "SELECT file_path AS project_id FROM files WHERE kind <> 'ui'")
    + "), a AS ("
    + _scores("later", f"SELECT file_path AS project_id FROM c2 UNION ALL {_EXTRA_AFTER}")
    + """) SELECT project_id, b.score AS score_before, a.score AS score_after,
  a.score - b.score AS change, coalesce(a.score < b.score, false) AS regressed
  FROM b FULL JOIN a USING (project_id)"""
)

# TypeScript ---------------------------------------------------------------------

_TS = CT.TS_LINES
T = (
    f"WITH keys AS ({CT.keys_sql('part')}), c AS (SELECT *, {CT.TS_PROJECT} AS project_id, "
    f"{CT.TS_MAIN} AS file_path, {CT.TS_DIR} AS dir FROM keys)"
)


def tl(tag: str) -> str:
    return line_sql(_TS, tag)


def _here(kind: str, name: str) -> str:
    return cid(kind, "file_path", name)


def _in(key: str, kind: str, name: str) -> str:
    return cid(kind, path_of(key, "ts"), name)


_C, _I, _G, _H = (f"('{x}' || {st('k')})" for x in "CIgh")
_TS_ENTRIES = [
    ("file", f"('m' || {st('k')} || '.ts')", "1", f"CAST({count_sql(_TS)} AS INTEGER)", "false", "true"),
    ("interface", _I, tl("iface"), f"{tl('iface')} + 3", "true", "true"),
    ("type-alias", f"('T' || {st('k')})", tl("alias"), tl("alias"), "false", "k % 2 = 0"),
    ("enum", f"('E' || {st('k')})", tl("enum"), tl("enum"), "true", "k % 3 = 0"),
    ("class", _C, f"CASE WHEN k % 4 = 1 THEN {tl('class')} ELSE {tl('class_sub')} END",
     f"{tl('cls_close')} + 1", "true", "true"),
    ("function", _G, tl("fn"), f"{tl('fn_close')} + 1", "true", "true"),
    ("function", _H, tl("helper"), tl("helper"), "false", "true"),
]
ORACLES["ts_decl_facts"] = T + ", e AS (" + " UNION ALL ".join(
    f"SELECT project_id, {_here(kind, name)} AS id, {name} AS name, '{kind}' AS type, file_path, "
    f"{first} AS start_line, {last} AS end_line, {exported} AS is_exported FROM c WHERE {when}"
    for kind, name, first, last, exported, when in _TS_ENTRIES
) + ") SELECT *, end_line - start_line + 1 AS loc FROM e"
ORACLES["ts_members"] = T + f""" SELECT project_id, {_C} AS class_name, 'run' || {st('k')} AS name,
  'public' AS visibility, false AS is_static, true AS is_async, 'Promise<void>' AS return_type,
  'a,b' AS params, 'false,true' AS optional FROM c"""
ORACLES["ts_properties"] = T + f""" SELECT project_id, {_C} AS owner, 'id' AS name, 'string' AS type,
  'private' AS visibility, false AS is_static, true AS is_readonly FROM c
  UNION ALL SELECT project_id, {_I}, 'id', 'string', 'public', false, true FROM c
  UNION ALL SELECT project_id, {_I}, 'name', 'string', 'public', false, false FROM c"""


def _edges(rows: str) -> str:
    return (
        f"{T}, e AS ({rows}) SELECT project_id, {rid('source', 'target', 'type')} AS id, source, "
        "target, type, specifiers FROM e"
    )


_NONE = "CAST(NULL AS STRING) AS specifiers"
ORACLES["ts_import_edges"] = _edges(
    f"SELECT project_id, {file_id('k', 'ts')} AS source, {file_id('i', 'ts')} AS target, "
    f"'imports' AS type, 'C' || {st('i')} || ',I' || {st('i')} || ',g' || {st('i')} AS specifiers FROM c"
)
ORACLES["ts_inherit_edges"] = _edges(
    f"SELECT project_id, {_here('class', _C)} AS source, "
    + _in("i", "class", f"('C' || {st('i')})") + f" AS target, 'extends' AS type, {_NONE} "
    "FROM c WHERE k % 4 <> 1"
    f" UNION SELECT project_id, {_here('class', _C)}, {_here('interface', _I)}, 'implements', NULL FROM c"
    f" UNION SELECT project_id, {_here('class', _C)}, " + _in("i", "interface", f"('I' || {st('i')})")
    + ", 'implements', NULL FROM c WHERE k % 4 <> 1"
)
ORACLES["ts_call_edges"] = _edges(
    f"SELECT project_id, {_here('class', _C)} AS source, "
    + _in("i", "function", f"('g' || {st('i')})") + f" AS target, 'calls' AS type, {_NONE} FROM c"
    f" UNION ALL SELECT project_id, {_here('function', _G)}, {_here('function', _H)}, 'calls', NULL FROM c"
)
ORACLES["unsanitized_lines"] = T + f""", lines AS (
  SELECT project_id, file_path, {tl('sink6')} AS line_no,
    'db.execute(req.query.id); setTimeout("tick()", 5);' AS snippet FROM c WHERE k % 7 = 6
  UNION ALL SELECT project_id, dir || '/node_modules/lib/x' || {st('k')} || '.js', 1,
    'db.query(req.body.q)' FROM c WHERE s % 10 = 4)
  SELECT *, 'finding-unsanitized-' || CAST(line_no - 1 AS STRING) || '-' || substr(sha256(lower(
    'finding:' || file_path || ':unsanitized-' || CAST(line_no - 1 AS STRING))), 1, 8) AS id FROM lines"""

_ROUTE = f"CASE WHEN s % 3 = 0 THEN {tl('route_auth')} ELSE {tl('route')} END"
_TS_RULES = [
    ("sec-001", "unsanitized", "'high'", f"k % 7 = 0 AND {_TAINTED}", tl("sink0"), tl("sink0")),
    ("sec-001", "unsanitized", "'high'", "k % 7 = 6", tl("sink6"), tl("sink6")),
    ("sec-001", "unsanitized-html", "'high'", f"k % 7 = 2 AND {_TAINTED}", tl("sink2"), tl("sink2")),
    ("sec-002", "sql-injection", "'critical'", f"k % 7 = 0 AND {_TAINTED}", tl("sink0"), tl("sink0")),
    ("sec-002", "sql-concat", "'critical'", f"k % 7 = 1 AND {_TAINTED}", tl("sink1"), tl("sink1")),
    ("sec-003", "missing-auth", "'high'", "s % 3 <> 0", tl("route"), f"{tl('route_close')} + 1"),
    ("sec-004", "hardcoded-secret", "'critical'", "s % 7 = 0", tl("secret"), tl("secret")),
    ("sec-005", "unsafe-eval", f"CASE WHEN {_TAINTED} THEN 'critical' ELSE 'high' END", "k % 7 = 3",
     tl("sink3"), tl("sink3")),
    ("sec-005", "unsafe-eval", "'info'", "k % 7 = 6", tl("sink6"), tl("sink6")),
    ("sec-005", "unsafe-html", f"CASE WHEN {_TAINTED} THEN 'high' ELSE 'medium' END", "k % 7 = 2",
     tl("sink2"), tl("sink2")),
    ("sec-006", "cmd-injection", "'critical'", f"k % 7 = 4 AND {_TAINTED}", tl("sink4"), tl("sink4")),
    ("sec-007", "path-traversal", "'high'", f"k % 7 = 5 AND s % 2 <> 0 AND {_TAINTED}",
     tl("sink5"), tl("sink5")),
]
TS_FOUND = T + ", found_rows AS (" + " UNION ALL ".join(
    f"SELECT project_id, file_path, '{rule}' AS rule_id, {severity} AS severity, "
    f"{first} AS start_line, {last} AS end_line, '{slug}' AS slug FROM c WHERE {when}"
    for rule, slug, severity, when, first, last in _TS_RULES
) + """), found AS (SELECT *, 'finding-' || slug || '-' || CAST(start_line AS STRING) || '-' ||
  substr(sha256(lower('finding:' || file_path || ':' || slug || '-' ||
  CAST(start_line AS STRING))), 1, 8) AS id FROM found_rows)"""
for _name, _id in {
    "unsanitized_input": "sec-001", "sql_injection_scan": "sec-002", "missing_auth": "sec-003",
    "hardcoded_secrets": "sec-004", "unsafe_eval_scan": "sec-005",
    "command_injection_scan": "sec-006", "path_traversal_scan": "sec-007",
}.items():
    ORACLES[_name] = TS_FOUND + f" SELECT {_HIT} FROM found WHERE rule_id = '{_id}'"
ORACLES["ts_findings"] = TS_FOUND + f" SELECT {_HIT} FROM found"
ORACLES["ts_taint_paths"] = T + f""", vars AS (SELECT *, unnest(range(0, k % 3 + 1)) AS j FROM c
    WHERE {_TAINTED}), rows AS (SELECT project_id, file_path, 'v' || {st('j')} AS var,
  'req.body -> v0' || CASE WHEN j >= 1 THEN ' -> v1' ELSE '' END ||
  CASE WHEN j = 2 THEN ' -> v2' ELSE '' END AS path FROM vars
  UNION ALL SELECT project_id, file_path, 'safe', 'req.body -> v0' ||
    CASE WHEN k % 3 >= 1 THEN ' -> v1' ELSE '' END || CASE WHEN k % 3 = 2 THEN ' -> v2' ELSE '' END
    || ' -> safe' FROM c WHERE k % 7 = 5 AND s % 2 = 0 AND {_TAINTED}
  UNION ALL SELECT project_id, file_path, 'sql', 'req.body -> v0' ||
    CASE WHEN k % 3 >= 1 THEN ' -> v1' ELSE '' END || CASE WHEN k % 3 = 2 THEN ' -> v2' ELSE '' END
    || ' -> sql' FROM c WHERE k % 7 = 1 AND {_TAINTED}
  UNION ALL SELECT project_id, file_path, 'el.innerHTML', 'req.body -> v0' ||
    CASE WHEN k % 3 >= 1 THEN ' -> v1' ELSE '' END || CASE WHEN k % 3 = 2 THEN ' -> v2' ELSE '' END
    || ' -> el.innerHTML' FROM c WHERE k % 7 = 2 AND {_TAINTED}) SELECT * FROM rows"""
ORACLES["ts_posture"] = posture_sql(
    TS_FOUND, "(SELECT file_path AS project_id FROM c)", "file_path"
).replace("all Python rules", "all rules") + " SELECT project_id, score, grade, summary FROM posture"

# Streams ------------------------------------------------------------------------

ORACLES["stream_scan"] = ORACLES["secret_lines"]
ORACLES["stream_gate"] = C + """ SELECT project_id, count(*) AS n_blocking, 2 AS exit_code FROM c
  WHERE s % 7 = 0 GROUP BY 1"""
ORACLES["growth_windows"] = """SELECT CAST(CAST(ts AS DATE) AS STRING) AS window_start,
  event_type AS type, count(*) AS n FROM events GROUP BY ALL"""

# All dependencies between modules -------------------------------------------------

ORACLES["module_cycles"] = C.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
last AS (SELECT project_id, arg_max(k, file_path) AS z FROM c GROUP BY 1),
dep AS (SELECT k AS a, i AS z FROM c UNION SELECT k, b FROM c UNION SELECT k, c FROM c
  UNION SELECT k, b2 FROM c WHERE s % 4 = 0 UNION SELECT c.k, last.z FROM c JOIN last USING (project_id)),
closure AS (SELECT a, z FROM dep UNION SELECT closure.a, dep.z FROM closure
  JOIN dep ON dep.a = closure.z),
member AS (SELECT x.a AS k, min({path_of('y.a')}) AS scc
  FROM closure x JOIN closure y ON y.a = x.z AND y.z = x.a GROUP BY 1)
SELECT 'proj' || {st('k % 4')} AS project_id, {path_of('k')} AS id, scc,
  count(*) OVER (PARTITION BY scc) AS size FROM member"""

ORACLES["cycle_witness"] = GRAPH_REACH + f""",
member AS (SELECT x.a AS k, min({path_of('y.a')}) AS scc FROM closure x JOIN closure y
  ON y.a = x.z AND y.z = x.a GROUP BY 1),
walk AS (SELECT k AS head, k AS node, 0 AS pos FROM member WHERE scc = {path_of('k')}
  UNION ALL SELECT w.head, c.i, w.pos + 1 FROM walk w JOIN c ON c.k = w.node WHERE w.pos = 0 OR w.node <> w.head),
steps AS (SELECT *, max(pos) OVER (PARTITION BY head) AS length FROM walk)
SELECT 'proj' || {st('head % 4')} AS project_id, {path_of('head')} AS scc, CAST(length AS BIGINT) AS size,
  CAST(length AS INTEGER) AS length, CASE WHEN length <= 2 THEN 'high' ELSE 'medium' END AS severity,
  CAST(pos AS INTEGER) AS pos, {path_of('node')} AS id FROM steps"""

ORACLES["edge_key_check"] = f"""WITH rel AS ({ORACLES['all_relationships']}),
ends AS (SELECT project_id, source AS id FROM rel UNION SELECT project_id, target FROM rel)
SELECT project_id, count(*) AS n_edges, any_value(n_touched) AS n_touched, CAST(0 AS BIGINT) AS n_unknown
FROM rel JOIN (SELECT project_id, count(*) AS n_touched FROM ends GROUP BY 1) e USING (project_id) GROUP BY 1"""

ORACLES["snapshot_log"] = ORACLES["growth_delta"]

ORACLES["folder_rollup"] = COMPS + f""", levels AS (
  SELECT project_id, unnest(['/corpus', '/corpus/' || project_id, dir]) AS folder, 1 AS n, 0 AS i, 0 AS c FROM components
  UNION ALL SELECT project_id, unnest(['/corpus', '/corpus/' || project_id]), 0, 1, 0 FROM c
  UNION ALL SELECT project_id, dir, 0, 1, 0 FROM c WHERE k % 20 = i % 20
  UNION ALL SELECT project_id, unnest([dir, '/corpus/' || project_id || '/pkg' || {st('i % 20')}]), 0, 0, 1 FROM c WHERE k % 20 <> i % 20)
SELECT project_id, folder, CAST(sum(n) AS BIGINT) AS n_nodes, CAST(sum(i) AS BIGINT) AS n_inner, CAST(sum(c) AS BIGINT) AS n_cross
FROM levels GROUP BY 1, 2"""

ORACLES["findings_project_config"] = FOUND + f""", conf AS (SELECT * REPLACE (CASE WHEN project_id = 'proj2' AND rule_id = 'py-004'
    THEN 'critical' ELSE severity END AS severity) FROM found WHERE rule_id <> 'py-003')
  SELECT {_HIT} FROM conf WHERE CASE project_id WHEN 'proj0' THEN severity IN ('critical', 'high')
    WHEN 'proj1' THEN rule_id <> 'py-006' WHEN 'proj2' THEN severity = 'critical' ELSE true END"""

ORACLES["findings_rescan"] = ORACLES["findings_diff"]


def _no_violations(counts: str, *tables: tuple[str, tuple[str, ...]]) -> str:
    rows = ", ".join(f"('{table}', '{check}')" for table, checks in tables for check in checks)
    return f"""{counts} SELECT v."table", n AS n_rows, v."check", CAST(0 AS BIGINT) AS n_violations
  FROM (VALUES {rows}) v("table", "check") JOIN counts USING ("table")"""


_EDGE_NULLS = tuple(f"{c} is null" for c in ("project_id", "id", "source", "target", "type"))
ORACLES["contract_check_relationships"] = _no_violations(
    RELS + ", counts AS (SELECT 'relationships' AS \"table\", count(*) AS n FROM rels)",
    ("relationships", (*_EDGE_NULLS, "type not in list")),
)
ORACLES["contract_check_graph"] = _no_violations(
    RELS + ", counts AS (SELECT 'nodes' AS \"table\", count(*) AS n FROM components UNION ALL SELECT 'edges', count(*) FROM rels)",
    ("nodes", (*(f"{c} is null" for c in ("project_id", "id", "label", "type", "group")), "type not in list", "size below 1")),
    ("edges", (*_EDGE_NULLS, "weight is null", "type not in list", "weight below 1")),
)
ORACLES["contract_check_posture"] = _no_violations(
    posture_sql(FOUND, _PROJECTS) + ", counts AS (SELECT 'posture' AS \"table\", count(*) AS n FROM posture)",
    ("posture", ("project_id is null", "score is null", "grade is null", "grade not in list", "score out of range")),
)
