"""Facts of Python files: one nested row per file, from the standard ``ast`` module.

The per-file helper only lists what is written in the file.  What counts as a
source, a sink, a component or a finding is decided later by column expressions.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from srcweave.schemas import PARSED

_SNIPPET = 200
_BATCH = 128
_FUNCS = (ast.FunctionDef, ast.AsyncFunctionDef)
_READ = frozenset({ast.Call, ast.Assign, ast.AnnAssign, ast.AugAssign, *_FUNCS})
_MARKS = frozenset(
    kind for base in (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop) for kind in base.__subclasses__()
)
#: Nodes with nothing below them.
_LEAVES = _MARKS | {ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.alias, ast.Global, ast.Nonlocal}
_ONE_STRING = re.compile(
    r"""^[A-Za-z]{0,2}(?:'''(?:\\.|[^\\])*?'''|\"\"\"(?:\\.|[^\\])*?\"\"\""""
    r"""|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*")$""",
    re.S,
)


def _children(node: ast.AST) -> list[ast.AST]:
    """The nodes right below one, in order, without marks that say nothing (contexts, operators)."""
    found = []
    for name in node._fields:
        value = getattr(node, name, None)
        if isinstance(value, list):
            found += [part for part in value if isinstance(part, ast.AST)]
        elif isinstance(value, ast.AST) and type(value) not in _MARKS:
            found.append(value)
    return found


class _Source:
    """Text of nodes by byte offsets: one pass over the file, cheap slices."""

    def __init__(self, text: str):
        self.raw = text.encode("utf-8", "surrogatepass")
        self.starts = [0] + [m.end() for m in re.finditer(rb"\r\n|\r|\n", self.raw)]

    def text(self, node: ast.AST) -> str:
        begin = self.starts[node.lineno - 1] + node.col_offset
        return self.between(begin, node)

    def between(self, begin: int, node: ast.AST) -> str:
        end = self.starts[node.end_lineno - 1] + node.end_col_offset
        return self.raw[begin:end].decode("utf-8", "replace")


def _kind(node: ast.AST, text: str) -> str:
    if isinstance(node, ast.JoinedStr) or (
        isinstance(node, ast.Constant) and isinstance(node.value, (str, bytes))
    ):
        if not _ONE_STRING.match(text):
            return "joined_strings"
        return "fstring" if isinstance(node, ast.JoinedStr) else "string"
    if isinstance(node, ast.Constant):
        return "number" if isinstance(node.value, (int, float)) else "constant"
    return {
        ast.Name: "name", ast.Tuple: "tuple", ast.List: "list", ast.Call: "call",
        ast.Attribute: "attribute", ast.Subscript: "subscript", ast.BinOp: "binary",
    }.get(type(node), "other")


def _walk(node: ast.AST) -> Iterator[ast.AST]:
    """A node and all below it, level by level as in ``ast.walk``; without marks."""
    level = [node]
    while level:
        yield from level
        level = [part for n in level if type(n) not in _LEAVES for part in _children(n)]


def _names(node: ast.AST) -> list[str]:
    """Distinct variable names, in order of appearance."""
    if type(node) is ast.Name:
        return [node.id]
    return list(dict.fromkeys(n.id for n in _walk(node) if type(n) is ast.Name))


def _uses(src: _Source, node: ast.AST, via: list[str]) -> list[dict]:
    """Sub-expressions through which a value may become tainted, outermost first.

    Of a chain of operators the whole and its operands are listed, not every prefix: what is
    found in a prefix is found in the whole or in an operand.
    """
    found, waiting = [], [(node, via, True)]
    while waiting:
        node, via, whole = waiting.pop()
        if isinstance(node, ast.BinOp):
            if whole:
                found.append({"text": src.text(node), "name": None, "via": via})
            waiting += [(node.right, via, False), (node.left, via, False)]
            continue
        text = src.text(node)
        found.append({"text": text, "name": node.id if isinstance(node, ast.Name) else None, "via": via})
        if isinstance(node, (ast.Attribute, ast.Subscript)):
            found.append({"text": text, "name": src.text(node.value), "via": [text, *via]})
        elif isinstance(node, ast.JoinedStr):
            parts = [p.value for p in node.values if isinstance(p, ast.FormattedValue)]
            waiting += [(p, ["f-string", *via], True) for p in reversed(parts)]
        elif isinstance(node, ast.Call) and getattr(node.func, "attr", "") == "format":
            waiting += [(arg, [".format()", *via], True) for arg in reversed(node.args)]
    return found


def _params(src: _Source, args: ast.arguments) -> list[dict]:
    plain = [*args.posonlyargs, *args.args]
    first_default = len(plain) - len(args.defaults)
    listed = [(a, "", i >= first_default) for i, a in enumerate(plain)]
    if args.vararg:
        listed.append((args.vararg, "*", True))
    listed += [(a, "", d is not None) for a, d in zip(args.kwonlyargs, args.kw_defaults)]
    if args.kwarg:
        listed.append((args.kwarg, "**", True))
    return [
        {
            "name": mark + a.arg,
            "type": src.text(a.annotation) if a.annotation else "unknown",
            "is_optional": optional,
        }
        for a, mark, optional in listed
    ]


def _decorators(src: _Source, node: ast.AST) -> list[str]:
    return [src.text(d).strip() for d in node.decorator_list]


def _class_members(src: _Source, cls: ast.ClassDef) -> tuple[list[dict], list[dict]]:
    methods, properties = [], []
    for item in cls.body:
        if isinstance(item, _FUNCS):
            methods.append({
                "name": item.name,
                "params": _params(src, item.args),
                "return_type": src.text(item.returns) if item.returns else None,
                "decorators": _decorators(src, item),
                "is_async": isinstance(item, ast.AsyncFunctionDef),
                "modifiers": [],
            })
            if item.name == "__init__":
                properties += [
                    {"name": t.attr, "type": "unknown", "modifiers": []}
                    for stmt in item.body for n in _walk(stmt)
                    if isinstance(n, (ast.Assign, ast.AnnAssign))
                    for t in (n.targets if isinstance(n, ast.Assign) else [n.target])
                    if isinstance(t, ast.Attribute)
                    and isinstance(t.value, ast.Name) and t.value.id == "self"
                ]
        elif isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name):
            properties.append(
                {"name": item.target.id, "type": src.text(item.annotation), "modifiers": []}
            )
        elif isinstance(item, ast.Assign):
            properties += [
                {"name": t.id, "type": "unknown", "modifiers": []}
                for t in item.targets if isinstance(t, ast.Name)
            ]
    return methods, properties


class _Walker:
    """Collects calls, assignments and function scopes in document order.

    What is still to be read waits on a list, so no nesting is too deep.
    """

    def __init__(self, src: _Source):
        self.src = src
        self.calls: list[dict] = []
        self.assigns: list[dict] = []
        self.scopes: list[dict] = []
        self.open: list[dict] = []
        self.owner: tuple[str, str] | None = None
        self.waiting: list = []

    def visit(self, node: ast.AST) -> None:
        """Read a node and everything in it."""
        waiting = self.waiting
        waiting.append(node)
        while waiting:
            item = waiting.pop()
            kind = type(item)
            if kind in _LEAVES:
                continue
            if kind in _READ:
                if kind is ast.Call:
                    self._call(item)
                elif kind is ast.Assign:
                    for target in item.targets:
                        self._assign(item, target, item.value)
                elif kind is ast.AnnAssign:
                    if item.value is not None:
                        self._assign(item, item.target, item.value)
                elif kind is ast.AugAssign:
                    self._assign(item, item.target, item.value, augmented=True)
                else:
                    self._function(item)
                    continue
            elif not isinstance(item, ast.AST):
                item()
                continue
            waiting += _children(item)[::-1]

    def _next(self, parts) -> None:
        self.waiting += reversed(list(parts))

    def _function(self, node):
        owner = self.owner
        scope = {
            "scope_id": f"{node.name}:{node.lineno}:{node.col_offset}",
            "name": node.name, "line": node.lineno, "end_line": node.end_lineno,
        }

        def enter():
            self.owner = owner
            self.scopes.append(scope)
            self.open.append(scope)
            scope["first_step"], scope["first_call"] = len(self.assigns), len(self.calls)

        def leave():
            self.open.pop()
            scope["n_steps"] = len(self.assigns) - scope["first_step"]
            scope["n_calls"] = len(self.calls) - scope["first_call"]

        if not self.open:
            self.owner = None
        body = [part for part in (node.args, node.returns, *node.body) if part is not None]
        self._next([*node.decorator_list, enter, *body, leave])

    def _call(self, node):
        callee = self.src.text(node.func)
        is_member = isinstance(node.func, ast.Attribute)
        name = node.func.attr if is_member else getattr(node.func, "id", None)
        args = []
        for value in node.args:
            text = self.src.text(value)
            args.append({"text": text, "kind": _kind(value, text), "names": _names(value),
                         "atoms": [text]})
        kwargs = [(k.arg, self.src.text(k.value)) for k in node.keywords if k.arg]
        if not args and kwargs:
            text = "=".join(kwargs[0])
            args.append({"text": text, "kind": "keyword",
                         "names": _names(node.keywords[0].value), "atoms": [text]})
        owner, owner_kind = self.owner or (None, None)
        self.calls.append({
            "ord": len(self.calls),
            "scope_id": self.open[-1]["scope_id"] if self.open else None,
            "caller": owner, "caller_kind": owner_kind, "callee": callee, "callee_name": name,
            "is_member": is_member, "args": args, "kwargs": kwargs, "line": node.lineno,
            "end_line": node.end_lineno, "text": self.src.text(node)[:_SNIPPET],
        })

    def _assign(self, node, target, value, augmented=False):
        text = self.src.text(value)
        parts = target.elts if isinstance(target, (ast.Tuple, ast.List)) else [target]
        kind = "tuple" if parts != [target] else (
            "name" if isinstance(target, ast.Name) else "other")
        label = self.src.text(target)
        step = {
            "ord": len(self.assigns), "target": label,
            "targets": [p.id for p in parts if isinstance(p, ast.Name)] if kind == "tuple"
            else [label],
            "target_kind": kind, "value": text, "value_kind": _kind(value, text),
            "call_name": self.src.text(value.func) if isinstance(value, ast.Call) else None,
            "is_augmented": augmented, "is_decl": False, "uses": _uses(self.src, value, []),
            "names": _names(value), "line": node.lineno, "end_line": node.end_lineno,
        }
        self.assigns.append(step)


def _decl(src: _Source, node: ast.AST, position: int) -> dict:
    first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    is_class = isinstance(node, ast.ClassDef)
    methods, properties = _class_members(src, node) if is_class else ([], [])
    return {
        "kind": "class" if is_class else "function", "name": node.name, "ord": position,
        "start_line": node.lineno, "end_line": node.end_lineno, "block_line": first,
        "snippet": src.between(src.starts[first - 1], node).lstrip()[:_SNIPPET],
        "decorators": _decorators(src, node),
        "bases": [src.text(b) for b in node.bases] if is_class else [], "ifaces": [],
        "params": [] if is_class else _params(src, node.args),
        "return_type": src.text(node.returns) if not is_class and node.returns else None,
        "is_exported": None, "is_default": False, "methods": methods, "properties": properties,
    }


def _imports(tree: ast.Module) -> list[dict]:
    found: list[dict] = []
    for node in tree.body:
        if isinstance(node, ast.Import):
            listed = [(a.name, 0, []) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            listed = [(node.module or "", node.level, [a.name for a in node.names])]
        else:
            continue
        for module, level, names in listed:
            found.append({"module": module, "level": level, "names": names,
                          "default_name": None, "line": node.lineno, "ord": len(found)})
    return found


def parse_python(content: str) -> dict:
    """Facts of one file; one that cannot be parsed yields its line count and the error.

    A file without content (null) has no lines; its error says so.
    """
    facts = {"n_lines": 0 if content is None else content.count("\n") + 1, "error": None, "decls": [], "imports": [],
             "calls": [], "assigns": [], "scopes": [], "exprs": []}
    if content is None:
        return facts | {"error": "no content"}
    try:
        tree = ast.parse(content)
        src = _Source(content)
        walker = _Walker(src)
        for node in tree.body:
            if isinstance(node, _FUNCS):
                walker.owner = (node.name, "function")
                walker.visit(node)
            elif isinstance(node, ast.ClassDef):
                for part in ast.iter_child_nodes(node):
                    walker.owner = (node.name, "class") if isinstance(part, _FUNCS) else None
                    walker.visit(part)
            else:
                walker.visit(node)
            walker.owner = None
        facts |= {
            "decls": [_decl(src, n, i) for i, n in enumerate(tree.body)
                      if isinstance(n, (*_FUNCS, ast.ClassDef))],
            "imports": _imports(tree), "calls": walker.calls, "assigns": walker.assigns,
            "scopes": walker.scopes,
        }
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        facts["error"] = f"{type(problem).__name__}: {problem}"
    return facts


def parse_batches(parse, language: str):
    """A ``mapInArrow`` function that runs ``parse`` on each file of each batch."""
    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, _BATCH):
                rows = batch.slice(begin, _BATCH).to_pylist()
                yield pa.RecordBatch.from_pylist(
                    [
                        {"project_id": r["project_id"], "file_path": r["file_path"],
                         "language": language, "marks": r.get("marks"),
                         **parse(r["content"])}
                        for r in rows
                    ],
                    schema=schema,
                )

    return run


def python_facts(files: DataFrame) -> DataFrame:
    """Parse Python files; narrow, one output row per input file."""
    needed = files.where("language = 'python'").select("project_id", "file_path", "content")
    return needed.mapInArrow(parse_batches(parse_python, "python"), PARSED)
