"""Taint inside one function: a fold over its assignments in document order.

The steps of a function arrive as one array in the file's row, so the fold is a
column expression (``aggregate``) evaluated where the row is: no shuffle, no
iteration, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcweave.functions.text import matched_source, source_pattern
from srcweave.schemas import TAINT_ENTRY

# Fixed values ---------------------------------------------------------------
PYTHON_SOURCES = (
    "request.form", "request.args", "request.json", "request.data", "request.files",
    "request.values", "request.get_json()", "request.POST", "request.GET", "request.body",
    "request.FILES", "input()", "sys.stdin.read()", "sys.stdin.readline()",
)
PYTHON_SANITIZERS = (
    "int", "float", "bool", "bleach.clean", "markupsafe.escape", "html.escape", "escape",
    "sanitize", "clean",
)
PYTHON_SANITIZER_ENDINGS = (".escape", ".clean")
PYTHON_PATH_VALIDATORS = (
    "os.path.abspath", "os.path.realpath", "os.path.normpath", "pathlib.Path.resolve",
)
PYTHON_PATH_VALIDATOR_ENDING = ".resolve"
PYTHON_SOURCE_OPENERS = ".[("
SCRIPT_SOURCES = (
    "req.body", "req.query", "req.params", "req.headers", "request.body", "request.query",
    "request.params", "request.headers", "ctx.request.body", "ctx.query", "ctx.params",
    "event.body", "event.queryStringParameters",
)
SCRIPT_SOURCE_OPENERS = ".["
# ---------------------------------------------------------------------------

_EMPTY = f"array<{TAINT_ENTRY}>"


def python_source_pattern(custom: Sequence[str] = ()) -> str:
    return source_pattern((*PYTHON_SOURCES, *custom), PYTHON_SOURCE_OPENERS)


def script_source_pattern(custom: Sequence[str] = ()) -> str:
    return source_pattern((*SCRIPT_SOURCES, *custom), SCRIPT_SOURCE_OPENERS)


def _entry_of(state: Column, name: Column) -> Column:
    return F.get(F.filter(state, lambda s: s["var"] == name), F.lit(0))


def _hit(source: Column, path: Column) -> Column:
    return F.struct(source.alias("source"), path.alias("path"))


def _put(state: Column, var: Column, hit: Column) -> Column:
    """Set a variable's entry: in place when it has one, else at the end."""
    entry = F.struct(
        var.alias("var"),
        hit["source"].alias("source"),
        F.concat(hit["path"], F.array(var)).alias("path"),
    )
    return F.when(
        F.exists(state, lambda s: s["var"] == var),
        F.transform(state, lambda s: F.when(s["var"] == var, entry).otherwise(s)),
    ).otherwise(F.concat(state, F.array(entry)))


def _mentions(step: Column, var: Column, substring: bool) -> Column:
    if substring:
        return F.contains(step["value"], var) & (step["value"] != var)
    return F.array_contains(step["names"], var)


def _first_hit(state: Column, step: Column, pattern: str, rest: list[str], substring: bool):
    """Where a step's value gets its taint from: a source, a variable, or null."""

    def through(use: Column) -> Column:
        source = matched_source(use["text"], pattern)
        known = _entry_of(state, use["name"])
        return F.when(
            source.isNotNull(), _hit(source, F.concat(F.array(source), use["via"]))
        ).when(known.isNotNull(), _hit(known["source"], F.concat(known["path"], use["via"])))

    direct = F.filter(F.transform(step["uses"], through), lambda h: h.isNotNull())
    mentioned = F.get(F.filter(state, lambda s: _mentions(step, s["var"], substring)), F.lit(0))
    label = F.array(*[F.lit(w) for w in rest]).cast("array<string>")
    loose = F.when(
        mentioned.isNotNull(),
        _hit(mentioned["source"], F.concat(mentioned["path"], label)),
    )
    return F.coalesce(F.get(direct, F.lit(0)), loose)


def _fold(steps: Column, advance) -> Column:
    return F.aggregate(steps, F.array().cast(_EMPTY), advance)


def _spread(state: Column, targets: Column, hit: Column) -> Column:
    """Apply a hit (or nothing when it is null) to every target."""
    hits = F.filter(F.array(hit), lambda h: h.isNotNull())
    return F.aggregate(
        hits, state, lambda st, h: F.aggregate(targets, st, lambda s2, t: _put(s2, t, h))
    )


def python_taint(
    steps: Column,
    pattern: str,
    sanitizers: Sequence[str] = PYTHON_SANITIZERS,
    substring: bool = False,
) -> Column:
    """Tainted variables at the end of a Python function body."""

    def sanitized(step: Column) -> Column:
        name = F.coalesce(step["call_name"], F.lit(""))
        test = name.isin(*sanitizers)
        for ending in PYTHON_SANITIZER_ENDINGS:
            test = test | F.endswith(name, F.lit(ending))
        return test & ~step["is_augmented"]

    def advance(state: Column, step: Column) -> Column:
        from_source = matched_source(step["value"], pattern).isNotNull()
        plain = (step["target_kind"] == "name") | step["is_augmented"]
        unpacked = (step["target_kind"] == "tuple") & from_source
        targets = F.when(plain | unpacked, step["targets"]).otherwise(
            F.array().cast("array<string>")
        )
        cleaned = F.when(
            step["target_kind"] == "name",
            F.filter(state, lambda s: s["var"] != step["target"]),
        ).otherwise(state)
        hit = _first_hit(state, step, pattern, ["expression"], substring)
        return F.when(sanitized(step), cleaned).otherwise(_spread(state, targets, hit))

    return _fold(steps, advance)


def script_taint(steps: Column, pattern: str, substring: bool = False) -> Column:
    """Tainted variables of a TypeScript function: declarations first, then re-assignments."""

    def advance(state: Column, step: Column) -> Column:
        source = matched_source(step["value"], pattern)
        known = _entry_of(state, F.trim(step["value"]))
        exact = F.when(
            source.isNotNull(), _hit(source, F.array(source))
        ).when(known.isNotNull(), _hit(known["source"], known["path"]))
        mentioned = F.get(
            F.filter(state, lambda s: _mentions(step, s["var"], substring)), F.lit(0)
        )
        loose = F.when(
            step["is_decl"] & (step["target_kind"] == "name") & mentioned.isNotNull(),
            _hit(mentioned["source"], mentioned["path"]),
        )
        return _spread(state, step["targets"], F.coalesce(exact, loose))

    ordered = F.concat(
        F.filter(steps, lambda s: s["is_decl"]), F.filter(steps, lambda s: ~s["is_decl"])
    )
    return _fold(ordered, advance)


def scope_taint(
    parsed: DataFrame,
    language: str = "python",
    custom_sources: Sequence[str] = (),
    substring: bool = False,
) -> DataFrame:
    """Add ``taint``: an array with one entry per function of the file."""
    if language == "python":
        pattern = python_source_pattern(custom_sources)
        fold = lambda steps: python_taint(steps, pattern, substring=substring)
    else:
        pattern = script_source_pattern(custom_sources)
        fold = lambda steps: script_taint(steps, pattern, substring=substring)
    def steps(s: Column) -> Column:
        return F.slice("assigns", s["first_step"] + 1, s["n_steps"])

    def callees(s: Column) -> Column:
        return F.transform(F.slice("calls", s["first_call"] + 1, s["n_calls"]), lambda c: c["callee"])

    per_scope = F.transform(
        "scopes",
        lambda s: F.struct(
            s["scope_id"].alias("scope_id"), s["name"].alias("name"), s["line"].alias("line"),
            has_path_validator(callees(s)).alias("validated"),
            fold(steps(s)).alias("vars"),
        ),
    )
    return parsed.withColumn("taint", per_scope)


def has_path_validator(callees: Column) -> Column:
    known = F.array(*[F.lit(v) for v in PYTHON_PATH_VALIDATORS])
    return F.arrays_overlap(callees, known) | F.exists(
        callees, lambda c: F.endswith(c, F.lit(PYTHON_PATH_VALIDATOR_ENDING))
    )


def taint_closure(
    parsed: DataFrame,
    language: str = "python",
    custom_sources: Sequence[str] = (),
    substring: bool = False,
) -> DataFrame:
    """One row per tainted variable of each function."""
    rows = scope_taint(parsed, language, custom_sources, substring).select(
        "project_id", "file_path", F.inline("taint")
    )
    return rows.select(
        "project_id", "file_path", F.col("scope_id").alias("func_id"),
        F.col("name").alias("func_name"), F.inline("vars"),
    )


# Tests on expressions -------------------------------------------------------


def python_arg_tainted(arg: Column, state: Column, pattern: str, substring: bool) -> Column:
    """An argument is fed from a source or from a tainted variable of its function."""
    text = F.trim(arg["text"])
    quoted = F.rlike(text, F.lit("""(?s)^'.*'$|^".*"$"""))
    number = F.rlike(text, F.lit(r"^\d+(\.\d+)?$"))

    def touches(entry: Column) -> Column:
        var = entry["var"]
        if substring:
            return F.contains(text, var)
        return (
            F.array_contains(arg["names"], var) | (text == var)
            | F.startswith(text, F.concat(var, F.lit(".")))
            | F.startswith(text, F.concat(var, F.lit("[")))
        )

    return (
        ~quoted & ~number
        & (matched_source(text, pattern).isNotNull() | F.exists(state, touches))
    )


def atoms_source(atoms: Column, state: Column, pattern: str) -> Column:
    """The source the first tainted one of some expression texts goes back to, or null."""

    def origin(atom: Column) -> Column:
        def same(entry: Column) -> Column:
            var = entry["var"]
            return (
                (atom == var)
                | F.startswith(atom, F.concat(var, F.lit(".")))
                | F.startswith(atom, F.concat(var, F.lit("[")))
            )

        return F.coalesce(
            matched_source(atom, pattern), F.get(F.filter(state, same), F.lit(0))["source"]
        )

    found = F.get(F.filter(F.transform(atoms, origin), lambda s: s.isNotNull()), F.lit(0))
    return F.when(state.isNotNull(), found)
