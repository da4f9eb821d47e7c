"""Source files derived from the ``part`` table, one module (and more) per row.

The supplied tables hold no source code, so each part becomes a Python module and
a TypeScript module whose lines depend on its key and size.  The line templates
are SQL expressions over ``k`` (key), ``s`` (size), ``n`` (number of parts) and
derived keys; every engine that has ``concat_ws``, ``chr`` and ``repeat``
evaluates them alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from srcweave.session import spread


@dataclass(frozen=True)
class Line:
    """A line (or block) of a template: present when ``when`` holds."""

    tag: str
    text: str
    when: str | None = None
    n_lines: int = 1


def st(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


#: Derived keys; each lies in the project of ``k``.
KEYS = {
    "i": "(5 * k + 4) % n",
    "b": "(9 * k + 4) % n",
    "b2": "(17 * k + 12) % n",
    "c": "(13 * k + 8) % n",
}
VAR = f"'v' || {st('k % 3')}"

PY_LINES = [
    Line("libs", "'import os, pickle, yaml'"),
    Line("imp_rel", f"'from ..pkg' || {st('i % 20')} || '.m' || {st('i')} || ' import C' || {st('i')}",
         "k % 3 = 0"),
    Line("imp_abs", f"'from m' || {st('i')} || ' import C' || {st('i')}", "k % 3 <> 0"),
    Line("secret", f"'password = \"pw-' || {st('k')} || '\"'", "s % 7 = 0"),
    Line("placeholder", "'token = \"<fill-me>\"'", "k % 5 = 0"),
    Line("other_name", f"'db_password = \"prod-' || {st('k')} || '\"'", "k % 11 = 0"),
    Line("setup", "'def setup(n):' || chr(10) || '    return n'", None, 2),
    Line("private", f"'def _h' || {st('k')} || '(x):' || chr(10) || '    return x'", "k % 2 = 0", 2),
    Line("class2", f"'class C' || {st('k')} || '(C' || {st('b')} || ', C' || {st('b2')} || ', metaclass=Meta):'",
         "s % 4 = 0"),
    Line("class1", f"'class C' || {st('k')} || '(C' || {st('b')} || '):'", "s % 4 <> 0"),
    Line("prop_kind", "'    kind: str = \"part\"'"),
    Line("prop_size", f"'    _size = ' || {st('s')}"),
    Line("init", "'    def __init__(self, n):'"),
    Line("init_n", "'        self.n = n'"),
    Line("init_cache", "'        self._cache = setup(n)'"),
    Line("run", "'    def run(self, n: int = 0, *rest) -> int:'"),
    Line("run_call", f"'        return f' || {st('c')} || '(n)'"),
    Line("make", "'    @staticmethod' || chr(10) || '    def make(x):'", None, 2),
    Line("make_call", f"'        return C' || {st('k')} || '(x)'"),
    Line("poll", "'    async def _poll(self):' || chr(10) || '        return None'", "k % 2 = 1", 2),
    *[
        Line(f"step{j}", f"'    def step{j}(self): pass'", "s % 25 = 0") for j in range(8)
    ],
    Line("health", f"'@app.route(\"/health/' || {st('k')} || '\")'", "k % 10 = 3"),
    Line("route", f"'@app.route(\"/r' || {st('k')} || '\")'", "k % 10 <> 3"),
    Line("auth", "'@login_required'", "s % 3 = 0"),
    Line("def5", f"'def f' || {st('k')} || '(request, a, b, c, d):'", "k % 17 = 0"),
    Line("def1", f"'def f' || {st('k')} || '(request):'", "k % 17 <> 0"),
    Line("v0_clean", "'    v0 = int(request.args[\"q\"])'", "k % 13 = 0"),
    Line("v0", "'    v0 = request.args[\"q\"]'", "k % 13 <> 0"),
    Line("v1", "'    v1 = v0'", "k % 3 >= 1"),
    Line("v2", "'    v2 = f\"x{v1}\"'", "k % 3 = 2"),
    Line("check", f"'    os.path.abspath(' || {VAR} || ')'", "s % 5 = 2 AND k % 7 = 0"),
    Line("sink0", f"'    db.execute(f\"SELECT * FROM t WHERE id = {{' || {VAR} || '}}\")'", "s % 5 = 0"),
    Line("sink1", f"'    os.system(\"ls \" + ' || {VAR} || ')'", "s % 5 = 1"),
    Line("sink2", f"'    open(' || {VAR} || ')'", "s % 5 = 2"),
    Line("sink3", f"'    pickle.loads(' || {VAR} || ')'", "s % 5 = 3 AND k % 2 = 0"),
    Line("sink3_safe", f"'    yaml.load(' || {VAR} || ', Loader=yaml.SafeLoader)'",
         "s % 5 = 3 AND k % 2 = 1"),
    Line("sink4", f"'    db.execute(\"SELECT * FROM t WHERE id = ?\", (' || {VAR} || ',))'", "s % 5 = 4"),
    Line("ret", "'    return setup(v0)'"),
    Line("pad", "repeat('# pad' || chr(10), 299) || '# pad'", "s = 50", 300),
    Line("end", "''"),
]

#: Files next to the module: (kind, condition, path, content).
PY_EXTRAS = [
    ("data", "s % 10 = 0", f"'/data' || {st('k')} || '.py'", f"'VALUE = ' || {st('k')}"),
    ("broken", "s % 10 = 5", f"'/broken' || {st('k')} || '.py'", "'def (:' || chr(10)"),
    ("vendored", "s % 10 = 3", f"'/node_modules/x' || {st('k')} || '.py'", "'x = 1'"),
    ("ui", "s % 10 = 7", f"'/ui' || {st('k')} || '.ts'", "'export const ui = 1;'"),
]

PY_DIR = f"'/corpus/proj' || {st('k % 4')} || '/pkg' || {st('k % 20')}"
PY_MAIN = f"{PY_DIR} || '/m' || {st('k')} || '.py'"
PY_PROJECT = f"'proj' || {st('k % 4')}"

TS_DIR = f"'/tscorpus/web' || {st('k % 4')} || '/src/d' || {st('k % 20')}"
TS_MAIN = f"{TS_DIR} || '/m' || {st('k')} || '.ts'"
TS_PROJECT = f"'web' || {st('k % 4')}"

TS_LINES = [
    Line("imp", f"'import {{ C' || {st('i')} || ', I' || {st('i')} || ', g' || {st('i')} || ' }} from \"../d' || {st('i % 20')} || '/m' || {st('i')} || '.js\";'"),
    Line("imp_lib", "'import fs, { readFileSync } from \"fs\";'"),
    Line("secret", f"'const password = \"pw-' || {st('k')} || '\";'", "s % 7 = 0"),
    Line("placeholder", "'const token = \"<fill-me>\";'", "k % 5 = 0"),
    Line("iface", f"'export interface I' || {st('k')} || ' {{' || chr(10) || '  readonly id: string;' || chr(10) || '  name?: string;' || chr(10) || '}}'",
         None, 4),
    Line("alias", f"'type T' || {st('k')} || ' = string | number;'", "k % 2 = 0"),
    Line("enum", f"'export enum E' || {st('k')} || ' {{ A, B }}'", "k % 3 = 0"),
    Line("class_sub", f"'export class C' || {st('k')} || ' extends C' || {st('i')} || ' implements I' || {st('k')} || ', I' || {st('i')} || ' {{'",
         "k % 4 <> 1"),
    Line("class", f"'export default class C' || {st('k')} || ' implements I' || {st('k')} || ' {{'",
         "k % 4 = 1"),
    Line("cls_prop", "'  private readonly id: string = \"x\";'"),
    Line("cls_run", f"'  public async run' || {st('k')} || '(a: number, b?: string): Promise<void> {{'"),
    Line("cls_call", f"'    g' || {st('i')} || '(a);'"),
    Line("cls_close", "'  }' || chr(10) || '}'", None, 2),
    Line("fn", f"'export function g' || {st('k')} || '(x: number): number {{'"),
    Line("fn_call", f"'  h' || {st('k')} || '(x);'"),
    Line("fn_close", "'  return x;' || chr(10) || '}'", None, 2),
    Line("helper", f"'function h' || {st('k')} || '(x: number) {{ return x; }}'"),
    Line("route_auth", f"'app.post(\"/r' || {st('k')} || '\", requireAuth, (req, res) => {{'", "s % 3 = 0"),
    Line("route", f"'app.post(\"/r' || {st('k')} || '\", (req, res) => {{'", "s % 3 <> 0"),
    Line("v0_const", "'  const v0 = config.value;'", "k % 13 = 0"),
    Line("v0", "'  const v0 = req.body.q;'", "k % 13 <> 0"),
    Line("v1", "'  const v1 = v0;'", "k % 3 >= 1"),
    Line("v2", "'  const v2 = `x$' || '{v1}`;'", "k % 3 = 2"),
    Line("check", f"'  const safe = path.resolve(\"/srv\", ' || {VAR} || ');'", "k % 7 = 5 AND s % 2 = 0"),
    Line("sink0", f"'  db.query(`SELECT * FROM t WHERE id = $' || '{{' || {VAR} || '}}`);'", "k % 7 = 0"),
    Line("sink1", f"'  const sql = \"SELECT \" + ' || {VAR} || ';'", "k % 7 = 1"),
    Line("sink2", f"'  el.innerHTML = ' || {VAR} || ';'", "k % 7 = 2"),
    Line("sink3", f"'  eval(' || {VAR} || ');'", "k % 7 = 3"),
    Line("sink4", f"'  execSync(\"ls \" + ' || {VAR} || ');'", "k % 7 = 4"),
    Line("sink5", f"'  fs.readFileSync(' || {VAR} || ');'", "k % 7 = 5"),
    Line("sink6", "'  db.execute(req.query.id); setTimeout(\"tick()\", 5);'", "k % 7 = 6"),
    Line("route_close", "'  res.json({ ok: true });' || chr(10) || '});'", None, 2),
    Line("end", "''"),
]

TS_EXTRAS = [
    ("typing", "s % 10 = 2", f"'/t' || {st('k')} || '.d.ts'", "'export declare const a: number;'"),
    ("vendored", "s % 10 = 4", f"'/node_modules/lib/x' || {st('k')} || '.js'",
     "'db.query(req.body.q)'"),
]
# ``$`` and ``{`` are joined at run time: side by side they would be a SQL variable.


def content_sql(lines: list[Line]) -> str:
    parts = [
        f"CASE WHEN {ln.when} THEN {ln.text} END" if ln.when else ln.text for ln in lines
    ]
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


def count_sql(lines: list[Line]) -> str:
    """Number of lines of the rendered template."""
    return " + ".join(
        f"(CASE WHEN {ln.when} THEN {ln.n_lines} ELSE 0 END)" if ln.when else str(ln.n_lines)
        for ln in lines
    ) or "0"


def line_sql(lines: list[Line], tag: str) -> str:
    """Line number at which a tagged line stands when it is present."""
    before = lines[: [ln.tag for ln in lines].index(tag)]
    return f"CAST(1 + {count_sql(before)} AS INTEGER)"


def keys_sql(table: str) -> str:
    """Select list of the key columns over the part table."""
    derived = ", ".join(f"{expr} AS {name}" for name, expr in KEYS.items())
    return (
        f"SELECT k, s, n, {derived} FROM (SELECT p_partkey AS k, p_size AS s, "
        f"(SELECT count(*) FROM {table}) AS n FROM {table}) q"
    )


def _keyed(spark: SparkSession, part: DataFrame) -> DataFrame:
    return spread(spark.sql(keys_sql("{part}"), part=part))


def _raw_files(project: str, folder: str, main: str, lines: list[Line], extras: list) -> tuple[str, str]:
    """Expressions over the keys that give the project and, one row each, the files of a part."""
    entries = [f"struct({main} AS file_path, {content_sql(lines)} AS content)"]
    entries += [
        f"CASE WHEN {when} THEN struct({folder} || {path} AS file_path, {text} AS content) END"
        for _, when, path, text in extras
    ]
    return f"{project} AS project_id", f"inline(array_compact(array({', '.join(entries)})))"


def arriving_files(parts: DataFrame, n_parts: int) -> DataFrame:
    """All files of the Python corpus from a stream of parts; the number of parts is known beforehand."""
    keyed = parts.selectExpr("p_partkey AS k", "p_size AS s", f"CAST({n_parts} AS BIGINT) AS n")
    keyed = keyed.selectExpr("k", "s", "n", *[f"{expr} AS {name}" for name, expr in KEYS.items()])
    return keyed.selectExpr(*_raw_files(PY_PROJECT, PY_DIR, PY_MAIN, PY_LINES, PY_EXTRAS))


def python_files(spark: SparkSession, part: DataFrame) -> DataFrame:
    """``(project_id, file_path, content)`` of the Python corpus."""
    return _keyed(spark, part).selectExpr(*_raw_files(PY_PROJECT, PY_DIR, PY_MAIN, PY_LINES, PY_EXTRAS))


def script_files(spark: SparkSession, part: DataFrame) -> DataFrame:
    """``(project_id, file_path, content)`` of the TypeScript corpus."""
    return _keyed(spark, part).selectExpr(*_raw_files(TS_PROJECT, TS_DIR, TS_MAIN, TS_LINES, TS_EXTRAS))
