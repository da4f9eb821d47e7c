import pytest
from pyspark.sql import functions as F

from srcweave.operators import components as CO
from srcweave.operators import findings as FN
from srcweave.operators import script_resolve as SS
from srcweave.operators import taint as TN
from srcweave.operators.rules import RuleOptions
from srcweave.session import write_once
from srcweave.sources.corpus import as_source_files, explode_lines, without_vendored
from srcweave.sources.script_facts import script_facts

STORE = '''
import type { Item, Named } from './model/item.js';
import base, { Kind as K } from "./model";
import * as path from 'path';

export abstract class Store<T> extends base implements Named {
  private readonly items: Map<string, Item> = new Map();
  static count = 0;
  protected label?: string;
  constructor(private db: any) { super(); }
  public async add(item: Item, note?: string, times = 1): Promise<{ ok: boolean }> {
    item.touch();
    return save(this.items.get("a"));
  }
  private static make(): Store<any> { return new Store(1); }
}

export default function save(x: Item): { id: string } {
  const text = "call(me)"; // call(again)
  return helper(x);
}
function helper(x) { return x; }
export enum Level { Low, High }
export type Pair = { a: string; b: number };
interface Shape { readonly id: string; size?: number; area(): number; }
'''


DECORATED = (
    "@Injectable()\n@log.Trace({ a: 1 })\nexport class A {}\n"
    "export default class extends A { run() { return 1; } }\n"
)
UNNAMED = "export default function (a, b) {\n  return a;\n}\nconst x = class {};\n"
TAINT = (
    "function f(req) {\n  const { a, b: c } = req.body;\n  const [d] = a;\n  let e;\n"
    "  e = d;\n  const g = e;\n  const h = 'x' + a;\n  const valid = other;\n}\n"
)
#: Lines without semicolons, literals that look like code, bytes that are no characters, values over several lines.
LOOSE = """// ünï {
import thing from './thing'
const re = /[/"'`{]+/g, other = req.body.x
const text = 'é{(' + "}" + `ü${ other.map(x => `<${x}>`).join('') }{`
export const run = async (a, b) => {
  const q = `SELECT ${a}`
    + b
  await db.query(q)
  return list
    .filter(x => x < 1)
    .map((y) => { return call(y) })
}
if (re.test(text)) { run(1) } else { stop() }
label({ a: 1, b: [2, 3], c() { return inner() } })
interface Api { get(id: string): { ok: boolean }; list: Array<Map<string, number>> }
export async function* stream<T>(src: Iter<T, U>, ...rest: string[]): AsyncGenerator<T> { yield* src }
"""
NESTED = "function outer(req) {\n  function inner() {\n    const q = req.body;\n  }\n  inner();\n  const z = q;\n  [1].forEach(() => { deep(q); });\n}\n"
SOURCES = {"store": STORE, "decorated": DECORATED, "unnamed": UNNAMED, "taint": TAINT, "loose": LOOSE, "nested": NESTED, "empty": "", "null": None,
           "comment": "/* only { */", "open": "function f( { const a = 'x\n if (", "strings": "const s = '" + "a" * 20_000 + "';\n" + "call('x' + y);\n" * 300}


@pytest.fixture(scope="module")
def parsed(spark):
    """Facts of all sources and cases, once."""
    rows = [("w", f"/w/{name}.ts", text) for name, text in SOURCES.items()]
    rows += [("w", f"/w/case{i:02}.ts", t) for i, (_, t, _) in enumerate(CASES)]
    rows += [("w", f"/w/eval-{name}.ts", t) for name, t in EVALS.items()]
    rows += [("w", "/w/options.ts", "v1.get('/x', (r) => { const d = ev.data; db.$raw(`x ${d}`); sh.go(d); });\n"),
             ("w", "/w/module.ts", "db.query(req.body.q);\n")]
    files = as_source_files(spark.createDataFrame(rows, "project_id string, file_path string, content string"))
    return write_once(script_facts(files))


@pytest.fixture(scope="module")
def facts(parsed):
    return {r.file_path[3:-3]: r.asDict(True) for r in parsed.collect()}


def of(parsed, *names):
    return parsed.where(F.col("file_path").isin([f"/w/{n}.ts" for n in names]))


def test_declarations(facts):
    facts = facts["store"]
    kinds = {d["name"]: d["kind"] for d in facts["decls"]}
    assert kinds == {"Store": "class", "save": "function", "helper": "function", "Level": "enum",
                     "Pair": "type-alias", "Shape": "interface"}
    store, save = facts["decls"][0], facts["decls"][1]
    assert (store["start_line"], store["end_line"]) == (6, 16)
    assert (store["bases"], store["ifaces"]) == (["base"], ["Named"])
    assert [(p["name"], p["modifiers"]) for p in store["properties"]] == [
        ("items", ["private", "readonly"]), ("count", ["static"]), ("label", ["protected"])]
    assert [m["name"] for m in store["methods"]] == ["add", "make"]
    add = store["methods"][0]
    assert add["is_async"] and add["return_type"] == "Promise<{ ok: boolean }>"
    assert [(p["name"], p["is_optional"]) for p in add["params"]] == [
        ("item", False), ("note", True), ("times", True)]
    assert save["is_exported"] and save["is_default"] and save["end_line"] == 21
    assert [(p["name"], p["modifiers"]) for p in facts["decls"][-1]["properties"]] == [
        ("id", ["readonly"]), ("size", [])]


def test_unnamed_and_decorated_declarations(facts):
    got = [(d["kind"], d["name"], d["start_line"], d["decorators"], d["bases"], d["is_default"])
           for d in facts["decorated"]["decls"]]
    assert got == [("class", "A", 1, ["Injectable", "Trace"], [], False),
                   ("class", "AnonymousClass", 4, [], ["A"], True)]
    assert [(d["kind"], d["name"], d["end_line"], len(d["params"])) for d in facts["unnamed"]["decls"]] == [
        ("function", "anonymous", 3, 2)]


def test_imports_and_calls_ignore_comments_and_strings(facts):
    facts = facts["store"]
    assert [(i["module"], i["names"], i["default_name"]) for i in facts["imports"]] == [
        ("./model/item.js", ["Item", "Named"], None), ("./model", ["Kind"], "base"),
        ("path", [], None)]
    assert [(c["callee"], c["caller"]) for c in facts["calls"]] == [
        ("item.touch", "Store"), ("save", "Store"), ("this.items.get", "Store"), ("helper", "save")]


def test_loose_code(facts):
    loose = facts["loose"]
    assert [(i["module"], i["default_name"], i["line"]) for i in loose["imports"]] == [("./thing", "thing", 2)]
    steps = {a["target"]: (a["value"], a["value_kind"], a["line"]) for a in loose["assigns"]}
    assert steps["re"] == ("""/[/"'`{]+/g""", "other", 3) and steps["other"] == ("req.body.x", "other", 3)
    assert steps["text"][1:] == ("binary", 4) and steps["q"] == ("`SELECT ${a}`\n    + b", "binary", 6)
    calls = {c["callee"]: c for c in loose["calls"]}
    assert set(calls) >= {"db.query", "call", "re.test", "run", "stop", "label", "inner"} and "if" not in calls
    assert calls["db.query"]["args"][0]["kind"] == "name" and calls["db.query"]["line"] == 8
    assert calls["label"]["args"][0]["text"].startswith("{ a: 1") and len(calls["label"]["args"]) == 1
    assert next(e for e in loose["exprs"] if e["text"].startswith("`SELECT"))["atoms"][-1] in ("a", "b")
    decls = {d["name"]: d for d in loose["decls"]}
    assert set(decls) == {"Api", "stream"} and decls["stream"]["is_exported"]
    assert [(p["name"], p["type"], p["is_optional"]) for p in decls["stream"]["params"]] == [
        ("src", "Iter<T, U>", False), ("rest", "string[]", True)]
    assert decls["stream"]["return_type"] == "AsyncGenerator<T>"
    assert [(p["name"], p["type"]) for p in decls["Api"]["properties"]] == [("list", "Array<Map<string, number>>")]
    names = next(a["names"] for a in loose["assigns"] if a["target"] == "text")
    assert "other" in names and "é" not in "".join(names)


def test_functions_hold_what_their_inner_ones_assign(facts):
    nested = facts["nested"]
    held = [(s["name"], [a["target"] for a in nested["assigns"][s["first_step"] :][: s["n_steps"]]]) for s in nested["scopes"]]
    assert held == [("outer", ["q", "z"]), ("inner", ["q"]), ("", [])]
    assert [s["n_calls"] for s in nested["scopes"]] == [3, 0, 1]
    by_callee = {c["callee"]: (c["scope_id"].split(":")[0], c["caller"]) for c in nested["calls"]}
    assert by_callee == {"inner": ("outer", "outer"), "[1].forEach": ("outer", "outer"), "deep": ("", "outer")}


def test_odd_files(facts):
    assert facts["null"]["error"] == "no content" and facts["null"]["n_lines"] == 1
    for name in ("empty", "comment", "null"):
        assert not any(facts[name][k] for k in ("decls", "imports", "calls", "assigns", "scopes", "exprs"))
    assert facts["open"]["error"] is None
    long = facts["strings"]
    assert len(long["calls"]) == 300 and long["assigns"][0]["value_kind"] == "string" and len(long["assigns"][0]["value"]) == 20_002
    assert [e["kind"] for e in long["exprs"]] == ["binary"] * 300


def test_relationships(files):
    parsed = script_facts(files({
        "/w/src/store.ts": STORE,
        "/w/src/model/item.ts": "export class Item { touch() { return 1; } }\n"
                                "export interface Named { name: string }\n",
        "/w/src/model/index.ts": "export default class base {}\nexport enum Kind { A }\n",
    }))
    comps = CO.components(parsed, "typescript")
    names = {r.id: r.name for r in comps.collect()}
    rows = SS.script_relationships(parsed, comps).collect()
    assert {(names[r.source], r.type, names[r.target]): r.import_specifiers for r in rows} == {
        ("store.ts", "imports", "item.ts"): ["Item", "Named"],
        ("store.ts", "imports", "index.ts"): ["Kind", "base"],
        ("Store", "extends", "base"): None,
        ("Store", "implements", "Named"): None,
        ("Store", "calls", "Item"): None,
        ("Store", "calls", "save"): None,
        ("save", "calls", "helper"): None,
    }


def test_vendored_and_declaration_files_are_left_out(files):
    kept = without_vendored(files({
        "/w/a.ts": "", "/w/a.d.ts": "", "/w/node_modules/x/b.js": "", "/w/my_node_modules2/c.ts": "",
    }))
    assert [r.file_path for r in kept.collect()] == ["/w/a.ts"]


def route(*lines, path="/x", guard=""):
    inside = "".join(f"  {line}\n" for line in lines)
    return f"app.get('{path}', {guard}(req, res) => {{\n{inside}}});\n"


CASES = [
    ("sec-001", "const q = req.body.q;\n", 0),
    ("sec-001", route("const q = req.body.q;", "db.query(q);"), 1),
    ("sec-001", route("db.query('x', req.query.id);"), 1),
    ("sec-001", route("const q = cfg.q;", "db.query(q);"), 0),
    ("sec-001", route("el.innerHTML = req.body.html;"), 1),
    ("sec-002", route("const { id } = req.params;", "const t = `SELECT * FROM u WHERE i=${id}`;"), 1),
    ("sec-002", route("const id = 3;", "const t = `SELECT * FROM u WHERE i=${id}`;"), 0),
    ("sec-002", route("const id = req.params.id;", "const sql = 'SELECT ' + id;"), 1),
    ("sec-002", route("const id = req.params.id;", "const defaultQuery = 'x ' + id;"), 0),
    ("sec-002", route("const id = req.params.id;", "log(`user ${id}`);"), 0),
    ("sec-002", route("const id = req.params.id;", "exec(`ls ${id}`);"), 1),
    ("sec-003", route("res.send(1);"), 1),
    ("sec-003", route("res.send(1);", guard="requireAuth, "), 0),
    ("sec-003", route("check(req.session);"), 0),
    ("sec-003", "cache.get('/x', () => 1);\n", 0),
    ("sec-003", "app.get('name', () => 1);\n", 0),
    ("sec-003", "this.router.POST('/x', h);\n", 1),
    ("sec-004", 'const password = "hunter22";\n', 1),
    ("sec-004", 'const password = "<secret>";\n', 0),
    ("sec-004", "const password = process.env.PW;\n", 0),
    ("sec-005", "function f(x) { eval(x); }\n", 1),
    ("sec-005", "setTimeout(() => tick(), 5);\n", 0),
    ("sec-005", "setTimeout('tick()', 5);\n", 1),
    ("sec-005", "document.write(x);\n", 1),
    ("sec-005", "const a = new Function('x');\n", 0),
    ("sec-005", "el.innerHTML = x;\n", 1),
    ("sec-006", route("const c = req.body.c;", "cp.execSync(c);"), 1),
    ("sec-006", route("const c = req.body.c;", "exec('ls');"), 0),
    ("sec-006", route("const c = req.body.c;", "spawn(c);"), 0),
    ("sec-007", route("const p = req.query.p;", "fs.readFile(p);"), 1),
    ("sec-007", route("const p = req.query.p;", "const q = path.resolve(p);", "fs.readFile(p);"), 0),
    ("sec-007", route("fs.readFile(join('a', req.query.p));"), 0),
]


EVALS = {
    "a": route("eval(req.body.x);"), "b": "function f(x) { eval(x); }\n", "c": "function f() { eval('1'); }\n",
}


def test_rules_fire_and_stay_quiet(parsed):
    parsed = parsed.where("file_path LIKE '/w/case%'")
    assert [r.error for r in parsed.where("error is not null").collect()] == []
    found = FN.findings(parsed, "typescript").collect()
    got = [
        sum(r.file_path == f"/w/case{i:02}.ts" and r.rule_id == rule for r in found)
        for i, (rule, _, _) in enumerate(CASES)
    ]
    assert got == [n for _, _, n in CASES]


def test_eval_severity_depends_on_its_argument(parsed):
    parsed = of(parsed, "eval-a", "eval-b", "eval-c")
    rows = FN.findings(parsed, "typescript", only=("sec-005",)).collect()
    assert {r.file_path[-4]: r.severity for r in rows} == {"a": "critical", "b": "high", "c": "info"}


def test_options(parsed):
    parsed = of(parsed, "options")
    plain = FN.findings(parsed, "typescript").collect()
    assert plain == []
    options = RuleOptions(custom_sources=("ev.data",), router_names=("v1",),
                          custom_sinks={"sql": ("$raw",), "command": ("go",)})
    rules = sorted(r.rule_id for r in FN.findings(parsed, "typescript", options).collect())
    assert rules == ["sec-002", "sec-003", "sec-006"]
    trusted = RuleOptions(router_names=("v1",), trusted_middleware=("sh.go",))
    assert FN.findings(parsed, "typescript", trusted).collect() == []


def test_taint(parsed):
    rows = TN.taint_closure(of(parsed, "taint"), "typescript").collect()
    got = {r.var: r.path for r in rows}
    assert got["a"] == ["req.body", "a"] and got["b"] == ["req.body", "b"]
    assert got["d"] == ["req.body", "a", "d"] and got["h"] == ["req.body", "a", "h"]
    assert got["e"] == ["req.body", "a", "d", "e"]  # re-assignments come after declarations
    assert "g" not in got and "valid" not in got and "c" not in got


def test_line_form(files):
    lines = explode_lines(files({"/w/a.js": "x\n  db.query(req.body.q);\nreq.body\n.query(\n"}))
    rows = FN.unsanitized_lines(lines).collect()
    assert [(r.line_no, r.snippet) for r in rows] == [(2, "db.query(req.body.q);")]


def test_module_level_taint_is_not_looked_up_without_functions(parsed):
    found = FN.findings(of(parsed, "module"), "typescript")
    assert found.where(F.col("rule_id") == "sec-001").count() == 0
