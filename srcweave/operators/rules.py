"""The rule table and, for each rule, a predicate over one row of facts.

A fact row has ``kind`` (``call``, ``assign``, ``decl``, ``expr``) and the
struct of that kind in ``call``, ``assign``, ``decl`` or ``expr``, next to
``vars`` (taint in scope, null at module level), ``validated``, ``scope_line``
and ``marks`` (lines that check paths).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcweave.functions.text import any_of, ends_with_member, is_secret_value, secret_name
from srcweave.operators import taint as TN
from srcweave.schemas import RULES

# Fixed values ---------------------------------------------------------------
#: rule id: (name, severity, CWE, OWASP category)
RULE_TABLE = {
    "sec-001": ("Unsanitized Input", "high", "CWE-79", "A03:2021-Injection"),
    "sec-002": ("SQL Injection", "critical", "CWE-89", "A03:2021-Injection"),
    "sec-003": ("Missing Authentication", "high", "CWE-306",
                "A07:2021-Identification and Authentication Failures"),
    "sec-004": ("Hardcoded Secrets", "critical", "CWE-798",
                "A07:2021-Identification and Authentication Failures"),
    "sec-005": ("Unsafe Eval/Code Execution", "high", "CWE-95", "A03:2021-Injection"),
    "sec-006": ("Command Injection", "critical", "CWE-78", "A03:2021-Injection"),
    "sec-007": ("Path Traversal", "high", "CWE-22", "A01:2021-Broken Access Control"),
    "py-001": ("SQL Injection", "high", "CWE-89", "A03:2021-Injection"),
    "py-002": ("Command Injection", "critical", "CWE-78", "A03:2021-Injection"),
    "py-003": ("Path Traversal", "high", "CWE-22", "A01:2021-Broken Access Control"),
    "py-004": ("Hardcoded Secrets", "medium", "CWE-798",
               "A07:2021-Identification and Authentication Failures"),
    "py-005": ("Unsafe Deserialization", "critical", "CWE-502",
               "A08:2021-Software and Data Integrity Failures"),
    "py-006": ("Missing Authentication", "medium", "CWE-862", "A01:2021-Broken Access Control"),
}
PY_SQL_SINKS = ("execute", "executemany", "raw", "rawQuery", "executescript")
PY_SQL_START = r"(?i)^\s*(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|TRUNCATE)\b"
PY_SQL_MARKS = ("{", "%s", "%d")
PY_COMMAND_SINKS = (
    "os.system", "os.popen", "subprocess.call", "subprocess.run", "subprocess.Popen",
    "subprocess.check_output", "subprocess.check_call", "eval", "exec", "compile",
)
PY_PATH_SINKS = ("open", "os.path.join", "pathlib.Path")
PY_DESERIALIZERS = (
    "pickle.loads", "pickle.load", "yaml.load", "marshal.loads", "marshal.load", "shelve.open",
)
PY_ROUTE_MARKS = (".route(", ".get(", ".post(", ".put(", ".delete(", ".patch(")
PY_ROUTE_PATH = r"""\(['"]([^'"]*)['"]"""
PY_AUTH_DECORATORS = (
    "login_required", "permission_required", "user_passes_test", "auth_required",
    "jwt_required", "requires_auth", "authenticated",
)
PY_PUBLIC_ROUTES = (
    "/health", "/ping", "/status", "/login", "/register", "/signup", "/public", "/static",
    "/favicon",
)
SQL_STATEMENT = (
    r"(?i)^\s*`?\s*(SELECT|INSERT\s+INTO|UPDATE\s+\w+\s+SET|DELETE\s+FROM|DROP|CREATE|ALTER"
    r"|TRUNCATE)\b"
)
SQL_SINKS = ("query", "execute", "raw", "rawQuery", "exec", "prepare", "run")
SQL_VARIABLE = r"(?i)\b(sql|query|stmt|statement|command)\b"
INPUT_WORDS = (
    "req.body", "req.query", "req.params", "request.body", "request.query", "request.params",
)
SINK_WORDS = (
    "innerHTML", "outerHTML", "document.write", "insertAdjacentHTML", ".query(", ".execute(",
    ".raw(",
)
INPUT_SINKS = ("query", "execute", "raw", "insertAdjacentHTML")
HTTP_METHODS = ("get", "post", "put", "patch", "delete")
ROUTER_NAMES = ("app", "router", "server", "route", "api", "express", "fastify")
AUTH_WORDS = (
    "auth", "authenticate", "authorize", "isAuthenticated", "requireAuth", "protect", "guard",
    "jwt", "token", "session", "passport", "middleware", "verify", "checkAuth",
)
CODE_RUNNERS = ("eval", "Function", "setTimeout", "setInterval")
TIMERS = ("setTimeout", "setInterval")
MARKUP_WRITERS = ("document.write", "document.writeln")
MARKUP_PROPERTIES = ("innerHTML", "outerHTML")
EXEC_FUNCTIONS = ("exec", "execSync", "execFile", "execFileSync")
FS_FUNCTIONS = (
    "readFile", "readFileSync", "writeFile", "writeFileSync", "readdir", "readdirSync",
    "unlink", "unlinkSync", "stat", "statSync", "access", "accessSync", "createReadStream",
    "createWriteStream",
)
PATH_CHECKS = (
    "path.resolve", "path.normalize", "path.join", "realpath", "realpathSync", ".startsWith(",
    ".includes('..')", '.includes("..")',
)
# ---------------------------------------------------------------------------

#: What each rule looks for, and what to do about it, in our own words.
DESCRIPTIONS = {
    "sec-001": "Request data reaches a query or markup sink without being cleaned",
    "sec-002": "A SQL text is put together from request data",
    "sec-003": "An HTTP route has nothing that looks like authentication",
    "sec-004": "A password, key or token is a literal in the code",
    "sec-005": "Text is run as code or written as markup",
    "sec-006": "Request data becomes part of a shell command",
    "sec-007": "Request data becomes part of a file path",
    "py-001": "A SQL text with interpolated, possibly tainted parts is executed",
    "py-002": "Possibly tainted text is run as a command or as code",
    "py-003": "A possibly tainted path is opened without validation",
    "py-004": "A password, key or token is a literal in the code",
    "py-005": "Bytes are turned into objects by a loader that can run code",
    "py-006": "A route handler has no authentication decorator",
}
ADVICE = {
    "sec-001": "Clean the value, or use parameters and text-only properties.",
    "sec-002": "Bind the values as query parameters.",
    "sec-003": "Put authentication middleware on the route or state that it is public.",
    "sec-004": "Read the secret from the environment or a secret store.",
    "sec-005": "Parse data instead of running it; set text instead of markup.",
    "sec-006": "Pass an argument list to a function that starts no shell.",
    "sec-007": "Resolve the path and check that it stays inside the allowed folder.",
    "py-001": "Bind the values as query parameters.",
    "py-002": "Pass an argument list and no shell; do not evaluate text.",
    "py-003": "Normalise the path and check that it stays inside the allowed folder.",
    "py-004": "Read the secret from the environment or a secret store.",
    "py-005": "Use a data-only format or a safe loader.",
    "py-006": "Add an authentication decorator to the handler.",
}

PYTHON_RULES = tuple(r for r in RULE_TABLE if r.startswith("py-"))
SCRIPT_RULES = tuple(r for r in RULE_TABLE if r.startswith("sec-"))


@dataclass(frozen=True)
class RuleOptions:
    """Everything a user may set; the defaults reproduce the plain rules."""

    min_severity: str | None = None
    disabled: frozenset[str] = frozenset()
    severity: dict[str, str] = field(default_factory=dict)
    custom_sources: tuple[str, ...] = ()
    custom_sinks: dict[str, tuple[str, ...]] = field(default_factory=dict)
    router_names: tuple[str, ...] = ()
    trusted_middleware: tuple[str, ...] = ()
    false_positives: tuple[str, ...] = ()
    substring: bool = False


@dataclass(frozen=True)
class Rule:
    """One form of a rule: which facts it reads, when it fires, what it reports.

    ``gate`` looks at the fact alone: facts that pass no gate are dropped while
    still nested, before taint is put beside them.  ``fires`` decides on the rest.
    """

    rule_id: str
    slug: str
    reads: str
    gate: Callable[[Column, RuleOptions], Column]
    fires: Callable[[Column, RuleOptions], Column]
    title: Callable[[Column], Column]
    severity: Callable[[Column, RuleOptions], Column] | None = None
    cwe: str | None = None
    detail: Callable[[Column, RuleOptions], Column] | None = None
    snippet: Callable[[Column], Column] | None = None
    start: Callable[[Column], Column] | None = None


def rules_table(spark: SparkSession, language: str | None = None) -> DataFrame:
    """The rule dimension: all rules of a language, disabled or not."""
    chosen = {"python": PYTHON_RULES, "typescript": SCRIPT_RULES}.get(
        language, tuple(RULE_TABLE)
    )
    rows = [
        (r, RULE_TABLE[r][0], DESCRIPTIONS[r], *RULE_TABLE[r][1:]) for r in chosen
    ]
    return spark.createDataFrame(rows, RULES)


def _arg(call: Column, position: int = 0) -> Column:
    return F.get(call["args"], F.lit(position))


def scope_vars() -> Column:
    return F.col("vars")


# Python ---------------------------------------------------------------------


def _untainted_ok(arg: Column, options: RuleOptions) -> Column:
    """Tainted in its function; outside any function there is nothing to prove."""
    pattern = TN.python_source_pattern(options.custom_sources)
    return scope_vars().isNull() | TN.python_arg_tainted(
        arg, scope_vars(), pattern, options.substring
    )


def py_sql_gate(c: Column, options: RuleOptions) -> Column:
    return c["is_member"] & c["callee_name"].isin(*PY_SQL_SINKS)


def called(*names: str):
    """Gate: the callee is written exactly like one of the names."""
    return lambda c, options: c["callee"].isin(*names)


def member_called(names: Sequence[str], custom: str | None = None, bare: bool = True):
    """Gate: the callee is one of the names or a member of that name."""
    return lambda c, options: ends_with_member(
        c["callee"], (*names, *options.custom_sinks.get(custom, ())), bare
    )


def py_sql_injection(c: Column, options: RuleOptions) -> Column:
    arg = _arg(c)
    bound = F.coalesce(_arg(c, 1)["kind"].isin("tuple", "list"), F.lit(False))
    looks = any_of(arg["text"], PY_SQL_MARKS) | F.rlike(arg["text"], F.lit(PY_SQL_START))
    return arg.isNotNull() & ~bound & looks & _untainted_ok(arg, options)


def _plain_string(arg: Column) -> Column:
    return (arg["kind"].isin("string", "fstring")) & ~F.startswith(arg["text"], F.lit("f"))


def py_command_injection(c: Column, options: RuleOptions) -> Column:
    arg = _arg(c)
    shell = F.coalesce(F.try_element_at(c["kwargs"], F.lit("shell")) == "True", F.lit(False))
    harmless = (
        F.startswith(c["callee"], F.lit("subprocess.")) & ~shell
        & (c["callee"] != "subprocess.call")
    )
    return arg.isNotNull() & ~harmless & ~_plain_string(arg) & _untainted_ok(arg, options)


def py_path_traversal(c: Column, options: RuleOptions) -> Column:
    arg = _arg(c)
    checked = F.coalesce(F.col("validated"), F.lit(False))
    return arg.isNotNull() & ~_plain_string(arg) & ~checked & _untainted_ok(arg, options)


def secret_gate(*kinds: str):
    """Gate: a literal of one of the kinds is assigned to a secret's name."""
    return lambda a, options: (
        ~a["is_augmented"] & a["value_kind"].isin(*kinds) & secret_name(a["target"])
    )


def hardcoded_secret(a: Column, options: RuleOptions) -> Column:
    fires = is_secret_value(a["value"])
    for pattern in options.false_positives:
        fires = fires & ~F.rlike(a["target"], F.lit(pattern))
    return fires


def py_unsafe_deserialization(c: Column, options: RuleOptions) -> Column:
    loader = F.coalesce(F.try_element_at(c["kwargs"], F.lit("Loader")), F.lit(""))
    safe = (c["callee"] == "yaml.load") & F.contains(loader, F.lit("SafeLoader"))
    return ~safe


def route_path(decorators: Column) -> Column:
    """Path given to the last route decorator that names one."""
    routes = F.filter(decorators, lambda d: any_of(d, PY_ROUTE_MARKS))
    given = F.filter(
        F.transform(routes, lambda d: F.regexp_extract(d, PY_ROUTE_PATH, 1)), lambda p: p != ""
    )
    return F.coalesce(F.get(given, F.size(given) - 1), F.lit(""))


def py_route_gate(d: Column, options: RuleOptions) -> Column:
    return (d["kind"] == "function") & F.exists(
        d["decorators"], lambda t: any_of(t, PY_ROUTE_MARKS)
    )


def py_missing_auth(d: Column, options: RuleOptions) -> Column:
    names = (*PY_AUTH_DECORATORS, *options.trusted_middleware)

    def authenticates(text: Column) -> Column:
        test = text.isin(*names)
        for name in names:
            test = test | F.startswith(text, F.lit(name + "("))
        return test

    return ~F.exists(d["decorators"], authenticates) & ~any_of(
        route_path(d["decorators"]), PY_PUBLIC_ROUTES
    )


# TypeScript -----------------------------------------------------------------

_LITERALS = ("string", "number", "plain_template")


def _pattern(options: RuleOptions) -> str:
    return TN.script_source_pattern(options.custom_sources)


def arg_source(arg: Column, options: RuleOptions) -> Column:
    return TN.atoms_source(arg["atoms"], scope_vars(), _pattern(options))


def args_source(c: Column, options: RuleOptions) -> Column:
    """Source of the first tainted argument, or null."""
    found = F.transform(c["args"], lambda a: arg_source(a, options))
    return F.get(F.filter(found, lambda s: s.isNotNull()), F.lit(0))


def expr_source(e: Column, options: RuleOptions) -> Column:
    return TN.atoms_source(e["atoms"], scope_vars(), _pattern(options))


def of_kind(kind: str):
    """Gate: an expression of this kind."""
    return lambda e, options: e["kind"] == kind


def tainted_args(c: Column, options: RuleOptions) -> Column:
    return args_source(c, options).isNotNull()


def tainted_value(e: Column, options: RuleOptions) -> Column:
    return expr_source(e, options).isNotNull()


def always(fact: Column, options: RuleOptions) -> Column:
    return F.lit(True)


def unsanitized_line(line: Column) -> Column:
    """Line form: an input word and a sink word on one line."""
    return any_of(line, INPUT_WORDS) & any_of(line, SINK_WORDS)


def _sql_place(e: Column, options: RuleOptions) -> Column:
    sinks = (*SQL_SINKS, *options.custom_sinks.get("sql", ()))
    in_sink = F.coalesce(ends_with_member(e["parent_callee"], sinks), F.lit(False))
    declared = F.coalesce(F.rlike(e["decl_target"], F.lit(SQL_VARIABLE)), F.lit(False))
    return F.rlike(e["text"], F.lit(SQL_STATEMENT)) | in_sink | declared


def sql_template(e: Column, options: RuleOptions) -> Column:
    assigned = F.coalesce(F.rlike(e["assigned_to"], F.lit(SQL_VARIABLE)), F.lit(False))
    return (_sql_place(e, options) | assigned) & expr_source(e, options).isNotNull()


def sql_concat(e: Column, options: RuleOptions) -> Column:
    return (
        F.contains(e["text"], F.lit("+")) & _sql_place(e, options)
        & expr_source(e, options).isNotNull()
    )


def http_gate(c: Column, options: RuleOptions) -> Column:
    return c["is_member"] & F.lower(c["callee_name"]).isin(*HTTP_METHODS)


def missing_auth(c: Column, options: RuleOptions) -> Column:
    receiver = F.regexp_extract(c["callee"], r"([^.]*)\.[^.]*$", 1)
    routers = F.array(*[F.lit(n.lower()) for n in (*ROUTER_NAMES, *options.router_names)])
    first = _arg(c)
    path = F.regexp_replace(first["text"], "['\"` ]", "")
    words = [w.lower() for w in (*AUTH_WORDS, *options.trusted_middleware)]
    return (
        F.array_contains(routers, F.lower(receiver)) & (F.size(c["args"]) >= 2)
        & F.coalesce(first["kind"].isin("string", "plain_template"), F.lit(False))
        & F.startswith(path, F.lit("/")) & ~any_of(F.lower(c["text"]), words)
    )


def unsafe_run(c: Column, options: RuleOptions) -> Column:
    literal = F.coalesce(_arg(c)["kind"] == "string", F.lit(False))
    return ~c["callee"].isin(*TIMERS) | literal


def unsafe_run_severity(c: Column, options: RuleOptions) -> Column:
    """A literal is harmless, an untainted value one step below a tainted one."""
    is_eval = c["callee"] == "eval"
    full = F.when(is_eval, "critical").otherwise("high")
    lower = F.when(is_eval, "high").otherwise("medium")
    arg = _arg(c)
    return (
        F.when(arg.isNull(), full)
        .when(arg["kind"] == "string", "info")
        .when(arg_source(arg, options).isNull(), lower)
        .otherwise(full)
    )


def markup_gate(c: Column, options: RuleOptions) -> Column:
    return any_of(c["callee"], MARKUP_WRITERS)


def unsafe_markup_severity(e: Column, options: RuleOptions) -> Column:
    return F.when(expr_source(e, options).isNotNull(), "high").otherwise("medium")


def command_injection(c: Column, options: RuleOptions) -> Column:
    arg = _arg(c)
    return (
        arg.isNotNull() & ~arg["kind"].isin("string", "plain_template")
        & arg_source(arg, options).isNotNull()
    )


def path_traversal(c: Column, options: RuleOptions) -> Column:
    """Tainted file access with no path check on an earlier line of its function."""
    checked = F.exists(
        F.col("marks"), lambda line: (line >= F.col("scope_line")) & (line < c["line"])
    )
    return args_source(c, options).isNotNull() & ~F.coalesce(checked, F.lit(False))


# Registry -------------------------------------------------------------------


def _fixed(text: str):
    return lambda fact: F.lit(text)


def _about(template: str, part):
    return lambda fact: F.format_string(template, part(fact))


# Slugs that go into finding ids, and titles ---------------------
REGISTRY: tuple[Rule, ...] = (
    Rule("py-001", "py-sql-injection", "call", py_sql_gate, py_sql_injection,
         _fixed("SQL injection via string interpolation")),
    Rule("py-002", "py-cmd-injection", "call", called(*PY_COMMAND_SINKS), py_command_injection,
         _about("Command injection via %s()", lambda c: c["callee"])),
    Rule("py-003", "py-path-traversal", "call", called(*PY_PATH_SINKS), py_path_traversal,
         _about("Path traversal via %s()", lambda c: c["callee"])),
    Rule("py-004", "py-hardcoded-secret", "assign", secret_gate("string", "fstring"),
         hardcoded_secret, _fixed("Hardcoded secret detected")),
    Rule("py-005", "py-unsafe-deser", "call", called(*PY_DESERIALIZERS),
         py_unsafe_deserialization,
         _about("Unsafe deserialization via %s()", lambda c: c["callee"])),
    Rule("py-006", "py-missing-auth", "decl", py_route_gate, py_missing_auth,
         _about('Route handler "%s" missing authentication', lambda d: d["name"])),
    Rule("sec-001", "unsanitized", "call", member_called(INPUT_SINKS, bare=False), tainted_args,
         _fixed("Unsanitized user input in dangerous sink"), detail=args_source),
    Rule("sec-001", "unsanitized-html", "expr", of_kind("markup"), tainted_value,
         _fixed("Unsanitized user input assigned to innerHTML"), detail=expr_source),
    Rule("sec-002", "sql-injection", "expr", of_kind("template"), sql_template,
         _fixed("SQL injection via tainted template literal"), detail=expr_source),
    Rule("sec-002", "sql-concat", "expr", of_kind("binary"), sql_concat,
         _fixed("SQL injection via tainted string concatenation"), detail=expr_source),
    Rule("sec-003", "missing-auth", "call", http_gate, missing_auth,
         _fixed("Route handler without authentication")),
    Rule("sec-004", "hardcoded-secret", "assign", secret_gate("string", "plain_template"),
         hardcoded_secret, _fixed("Hardcoded secret detected")),
    Rule("sec-005", "unsafe-eval", "call", called(*CODE_RUNNERS), unsafe_run,
         _about("Unsafe use of %s()", lambda c: c["callee"]), severity=unsafe_run_severity),
    Rule("sec-005", "unsafe-docwrite", "call", markup_gate, always,
         _about("Unsafe use of %s", lambda c: c["callee"])),
    Rule("sec-005", "unsafe-html", "expr", of_kind("markup"), always,
         _about("Unsafe assignment to %s", lambda e: e["prop"]),
         severity=unsafe_markup_severity, cwe="CWE-79"),
    Rule("sec-006", "cmd-injection", "call", member_called(EXEC_FUNCTIONS, "command"),
         command_injection, _fixed("Command injection via tainted input"),
         detail=lambda c, o: arg_source(_arg(c), o)),
    Rule("sec-007", "path-traversal", "call", member_called(FS_FUNCTIONS), path_traversal,
         _fixed("Path traversal via tainted input"), detail=args_source),
)
# ---------------------------------------------------------------------------


def enabled_rules(language: str, options: RuleOptions) -> Sequence[Rule]:
    """Rules worth evaluating: disabled ones are never put into the plan."""
    prefix = "py-" if language == "python" else "sec-"
    return [
        r for r in REGISTRY if r.rule_id.startswith(prefix) and r.rule_id not in options.disabled
    ]
