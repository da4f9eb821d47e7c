"""Facts of TypeScript and JavaScript files, one nested row per file, as Spark expressions and windows.

One regular expression cuts a text into tokens: comments, literals, words, brackets, marks.  Tokens become rows; running
sums over a file give each its place, line and bracket depth.  Tokens of one depth, with everything deeper left out, are cut
into units: statements, members, arguments.  A unit is a short array, and what it is - a declaration, an import, an
assignment, a call's argument - is read off its flat text by column expressions.  Calls find their arguments, classes
their members, and everything its function by equi-joins and windows on the places of brackets.

There is no type checker here: names are resolved later by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from srcweave.functions.text import any_of
from srcweave.operators.rules import MARKUP_PROPERTIES, PATH_CHECKS
from srcweave.schemas import ASSIGN, CALL, DECL, EXPR, IMPORT, METHOD_FACT, PARAM, PARSED, PROPERTY_FACT, SCOPE
from srcweave.session import Grown, Scratch, write_once
from srcweave.sources.script_units import UNIT, unit_batches

_KEY = ["project_id", "file_path"]
#: Bytes of texts worked on at once.
_SLICE_BYTES = 1 << 30
_IDENT = r"[A-Za-z_$][\w$]*"
_INSIDE = r"\$\{(?:[^{}`]|`[^`]*+`|\{[^{}]*+\})*+\}"
#: Token by token; together they are the whole text.  Type arguments and decorators are one token each.  Words and blanks, which
#: begin like nothing else, come first; what looks back does so only where its first character stands.
_TOKEN = "|".join([
    r"#?[A-Za-z_$][\w$]*+", r"[^\S\n]++", r"\n", r"\d[\w.]*+",
    r"//[^\n]*+", r"/\*(?:[^*]|\*(?!/))*+\*/", r"'(?:\\.|[^'\\\n])*+'", r'"(?:\\.|[^"\\\n])*+"',
    rf"`(?:\\[\s\S]|{_INSIDE}|[^`\\])*+`",
    r"(?=/)(?<=[=(,:\[!&|?;{}\n][ \t]{0,9}|return[ \t]{1,9})/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/[a-z]*+",
    r"@[\w$.]++(?:\([^()]*+\))?+",
    r"(?=<)(?<=[\w$])<(?:[^<>()=;+*/%!&|?\"'`{}]|\|(?!\|)|&(?!&)|\{[^{}]*+\}|<(?:[^<>()=;]|<[^<>()=;]*+>)*+>|\"[^\"\n]*+\"|'[^'\n]*+')*+>",
    r"=>|\.\.\.|\?\.(?!\d)|\+\+|--|[!=]==?|<=|>=|\|\||&&|\?\?|[-+*/%&|^]=", r"[\s\S]",
])
#: What stands before a brace that holds an object, a pattern or a list of names, not statements.
_BEFORE_OBJECT = (
    "=", "(", ",", ":", "[", "?", "return", "&&", "||", "??", "...", "import", "export", "const", "let", "var", "type", "from", "default", "in", "of",
)
#: Operators that make a value of several, and marks after or before which a line goes on.
_OPERATORS = ("||", "&&", "??", "!=", "==", "!==", "===", "<=", ">=", "+", "-", "*", "/", "%", "<", ">")
_GOES_ON_AFTER = (*_OPERATORS, "=", "=>", ",", "?", ":", ".", "?.", "&", "|", "+=", "extends", "implements", "new", "return", "typeof", "await")
_GOES_ON_BEFORE = (
    *_OPERATORS, "=", "=>", ",", "?", ":", ".", "?.", "&", "|", ")", "]", "}", "(", "[", ";", "extends", "implements", "else", "catch",
    "finally", "from", "as", "in", "of", "instanceof", "{",
)
_NOT_CALLS = (
    "if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "constructor", "import", "do", "else", "in",
    "of", "throw", "case", "void", "delete", "yield", "with", "async", "new",
)
_MODIFIERS = "public|private|protected|static|readonly|abstract|async|override|declare|get|set"
_LEADS = r"^(?:@\S+ ?)*((?:(?:export|default|abstract|declare|async) )*)(?:const (?=enum\b))?"
_HEAD = _LEADS + rf"(?:(class|function|interface|type|enum)(?: ?\* ?| )(?!extends\b|implements\b)({_IDENT})|(class|function)\b)"
_MEMBER = rf"^(?:@\S+ ?)*((?:(?:{_MODIFIERS})(?! ?[(:?=;!]) )*)\*? ?(#?{_IDENT}) ?([?!]?) ?(?:<.*?> ?)?(\(?)"
_TARGET = rf"({_IDENT}(?:\??\.#?{_IDENT}|\[\])*)!? ?(?::.*)?$"
_MARKUP = rf"({_IDENT}(?:\??\.{_IDENT}|\[\]|\(\))*)\.({'|'.join(MARKUP_PROPERTIES)}) ?(?:=(?![>=])|\+=|[!=]==?|\+|\|\||&&|\?\?)"
# Names of declarations that have none.
_UNNAMED = {"class": "AnonymousClass", "function": "anonymous"}
# ---------------------------------------------------------------------------


# Tokens -----------------------------------------------------------------------------


def _masked(t: Column) -> Column:
    """The token as code: literals and comments blanked, byte for byte."""
    first, size = F.substring(t, 1, 1), F.octet_length(t)
    return (
        F.when(~first.isin("/", "'", '"', "`") | (size == 1) | (t == "/="), t)
        .when(first != "/", F.concat(first, F.repeat(F.lit(" "), size - 2), first))
        .when(F.rlike(t, F.lit(r"^/[/*]")), F.repeat(F.lit(" "), size)).otherwise(F.concat(F.lit("/"), F.repeat(F.lit(" "), size - 2), F.lit("/")))
    )


def _flat_piece(t: Column, kind: Column) -> Column:
    """The token as it stands in a unit's flat text."""
    quotes = F.concat(F.substring(t, 1, 1), F.substring(t, 1, 1))
    return (
        F.when(kind == "s", quotes).when(kind == "t", F.when(F.rlike(t, F.lit(r"\$\{")), "`$`").otherwise("``"))
        .when(kind == "r", "//").when(kind == "d", F.regexp_extract(t, r"^@[\w$.]+", 0)).otherwise(t)
    )


def _units(files: DataFrame) -> DataFrame:
    """A row for each unit, with its tokens in order: ``toks``.

    ``inside`` is the place of the bracket around it (-1: none) and ``around`` its kind: ``(``, ``[``, ``o`` an object
    or pattern, ``b`` a block, ``t`` the top.  Files that share a path are read token by token in turn.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    texts = files.groupBy(*_KEY).agg(F.collect_list("text").alias("texts"))
    lists = F.transform("texts", lambda text: F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)))
    places = F.sequence(F.lit(0), F.array_max(F.transform("lists", lambda t: F.size(t))) - 1)
    turn = F.flatten(F.transform(places, lambda k: F.transform(
        F.filter("lists", lambda t: F.size(t) > k), lambda t: F.struct(k.alias("i"), F.get(t, k).alias("t"))
    )))
    alone = F.size("texts") == 1
    several = ~alone & (F.array_max(F.transform("lists", lambda t: F.size(t))) > 0)
    tokens = texts.withColumn("lists", lists).select(
        *_KEY, F.when(alone, F.get("lists", F.lit(0))).when(several, turn["t"]).alias("tokens"), F.when(several, turn["i"]).alias("places")
    )
    marks = {"before_object": _BEFORE_OBJECT, "goes_on_before": _GOES_ON_BEFORE, "goes_on_after": _GOES_ON_AFTER}
    return tokens.mapInArrow(unit_batches(to_arrow_schema(StructType.fromDDL(UNIT)), marks), UNIT)


def _flat(toks: Column) -> Column:
    """Text of some tokens of a unit: literals empty, brackets empty, blanks and lines as one space."""
    return F.trim(F.array_join(F.transform(toks, lambda x: F.concat(F.when(x["gap"] & ~x["t"].isin(")", "]", "}"), " ").otherwise(""), _flat_piece(x["t"], x["kind"]))), ""))


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _mark(toks: Column, *marks: str) -> Column:
    """The first of some marks among tokens, or null."""
    return _first(F.filter(toks, lambda x: x["t"].isin(*marks) & (x["kind"] == "p")))


def _after(toks: Column, i: Column) -> Column:
    return F.filter(toks, lambda x: x["i"] > i)


# Values: what a span of tokens says, as places -----------------------------------------

VALUE = "struct<begin:bigint,fin:bigint,flat:string,cuts:array<struct<pos:bigint,fin:bigint>>,line:int,end_line:int,kind:string>"


def _value(toks: Column, flat: Column | None = None) -> Column:
    """The span of some tokens of a unit, its flat text (given for a whole unit), the operators that cut it and its kind."""
    first = _first(toks)
    cuts = F.filter(toks, lambda x: x["t"].isin(*_OPERATORS) & (x["kind"] == "p") & (x["i"] > first["i"]))
    value = F.struct(
        first["pos"].alias("begin"), F.element_at(toks, -1)["fin"].alias("fin"), (_flat(toks) if flat is None else flat).alias("flat"),
        F.transform(cuts, lambda x: F.struct(x["pos"].alias("pos"), x["fin"].alias("fin"))).alias("cuts"),
        first["line"].alias("line"), F.element_at(toks, -1)["end_line"].alias("end_line"),
    )
    kept = ("begin", "fin", "flat", "cuts", "line", "end_line")
    kinds = F.transform(F.array(value), lambda v: F.struct(*[v[n].alias(n) for n in kept], value_kind(v["flat"], v["cuts"]).alias("kind")))
    return _first(kinds).cast(VALUE)


def value_kind(flat: Column, cuts: Column) -> Column:
    def like(pattern: str) -> Column:
        return F.rlike(flat, F.lit(pattern))

    asks = F.contains(F.replace(F.replace(flat, F.lit("??"), F.lit("")), F.lit("?."), F.lit("")), F.lit("?"))
    return (
        F.when(flat == "", "empty").when(like(r"=>|^(async )?function\b"), "function").when(like(r"^\d[\w.]*$"), "number")
        .when(like("^(''|\"\")$"), "string").when(flat == "``", "plain_template").when(flat == "`$`", "template")
        .when(asks, "other").when(F.size(cuts) > 0, "binary").when(like(rf"^{_IDENT}$"), "name").otherwise("other")
    )


def _sub(data: str, begin: Column, fin: Column) -> Column:
    """Bytes of the file's ``content`` or ``masked`` text."""
    return F.decode(F.substring(F.col(data), (begin + 1).cast("int"), (fin - begin).cast("int")), "UTF-8")


def _raw(v: Column) -> Column:
    return F.trim(_sub("content", v["begin"], v["fin"]))


def _embedded(text: Column) -> Column:
    """Expressions inside templates."""
    return F.transform(F.regexp_extract_all(text, F.lit(_INSIDE), F.lit(0)), lambda e: F.trim(F.substring(e, F.lit(3), F.length(e) - 3)))


def _inner_atoms(text: Column) -> Column:
    """Each expression inside a template, and what operators make it of."""
    parts = lambda e: F.filter(
        F.transform(F.split(e, r"\|\||&&|\?\?|[!=]==?|<=|>=|[-+*/%]"), lambda p: F.trim(p)), lambda p: (p != "") & (p != e) & ~F.rlike(p, F.lit(r"^['\"\d]"))
    )
    return F.flatten(F.transform(_embedded(text), lambda e: F.concat(F.array(e), parts(e))))


def names_in(v: Column) -> Column:
    """Identifiers that are no members, also those inside templates."""
    code = _sub("masked", v["begin"], v["fin"])
    word = F.lit(rf"(?<![\w$.]){_IDENT}")
    inside = F.when(F.contains(code, F.lit("`")), F.array_join(_embedded(_raw(v)), " ; ")).otherwise("")
    return F.array_distinct(F.concat(F.regexp_extract_all(code, word, F.lit(0)), F.regexp_extract_all(inside, word, F.lit(0))))


def atoms_of(v: Column) -> Column:
    """Texts of the expressions a value is made of, the whole one first."""
    text, kind = _raw(v), v["kind"]
    starts = F.concat(F.array(v["begin"]), F.transform(v["cuts"], lambda c: c["fin"]))
    ends = F.concat(F.transform(v["cuts"], lambda c: c["pos"]), F.array(v["fin"]))
    operands = F.transform(F.arrays_zip(starts.alias("b"), ends.alias("e")), lambda s: F.trim(_sub("content", s["b"], s["e"])))
    literal = lambda o: F.rlike(o, F.lit(r"""^(?:\d[\w.]*|'(?:\\.|[^'\\])*+'|"(?:\\.|[^"\\])*+"|`[^`$]*+`|)$"""))
    quoted = lambda o: F.startswith(o, F.lit("`"))
    none = F.array().cast("array<string>")
    of_operand = lambda o: F.when(literal(o), none).when(quoted(o), F.concat(F.array(o), _inner_atoms(o))).otherwise(F.array(o))
    return (
        F.when(kind.isin("string", "number", "plain_template", "empty"), none)
        .when(kind == "template", F.concat(F.array(text), _inner_atoms(text)))
        .when(kind == "binary", F.concat(F.array(text), F.flatten(F.transform(operands, of_operand))))
        .otherwise(F.array(text))
    )


# What units are ------------------------------------------------------------------------


def _bodies(units: DataFrame) -> DataFrame:
    """Braces that hold members or the statements of a function: place, end, kind, name, and where its head begins."""
    flat, toks = F.col("flat"), F.col("toks")
    braces = F.filter(toks, lambda x: x["t"] == "{")
    last = F.element_at(toks, -2)  # the brace before the closing one, if the unit ends with it
    ends_open = (F.size(toks) >= 2) & (last["t"] == "{")
    head = F.regexp_extract(flat, rf"(?:^|[^\w$.])(class|interface) (?!extends\b)({_IDENT})", 2)
    members = F.rlike(flat, F.lit(_LEADS + r"(?:class|interface)\b")) & (F.size(braces) > 0)
    member_kind = F.when(F.rlike(flat, F.lit(_LEADS + "interface")), "interface").otherwise("class")
    function = F.rlike(flat, F.lit(r"(?:^|[^\w$.])function\b")) & ~members & ends_open
    statement = F.rlike(flat, F.lit(_LEADS + rf"function ?\*? ?{_IDENT}"))
    word = _first(F.filter(toks, lambda x: (x["t"] == "function")))
    method = F.col("around").isin("b") & F.rlike(flat, F.lit(_MEMBER)) & (F.regexp_extract(flat, _MEMBER, 4) == "(") & ends_open
    method = method & ~function & ~members & ~F.regexp_extract(flat, _MEMBER, 2).isin(*_NOT_CALLS[:3], "switch", "catch", "function", "with")
    method = method & (F.coalesce(F.get(toks, F.size(toks) - 3)["t"], F.lit("")) != ":") & _mark(toks, "=", "=>").isNull()
    arrows = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(toks) - 1, F.lit(1))),
        lambda k: (F.get(toks, k)["t"] == "{") & (F.get(toks, k - 1)["t"] == "=>"),
    )

    def body(kind, name, brace, first) -> Column:
        return F.struct(
            kind.alias("kind"), name.alias("name"), brace["pos"].alias("open"), _first(_after(toks, brace["i"]))["pos"].alias("close"),
            first["pos"].alias("head"), first["line"].alias("head_line"), _first(_after(toks, brace["i"]))["end_line"].alias("close_line"),
        )

    start = _first(toks)
    function_name = F.regexp_extract(flat, rf"function ?\*? ?({_IDENT})?", 1)
    found = F.array_compact(F.array(
        F.when(members, body(member_kind, head, _first(braces), start)),
        F.when(function, body(F.when(statement, "function").otherwise("inner"), function_name, last, word)),
        F.when(method, body(F.lit("method"), F.regexp_extract(flat, _MEMBER, 2), last, start)),
    ))
    of_arrows = F.transform(arrows, lambda k: body(F.lit("inner"), F.lit(""), F.get(toks, k), F.get(toks, k - 1)))
    holding = units.where(F.contains("flat", F.lit("{")))
    return holding.select(*_KEY, "inside", F.inline(F.concat(found, of_arrows))).where("close IS NOT NULL")


def _around(units: DataFrame, functions: DataFrame) -> DataFrame:
    """For each bracket units stand in: the innermost function around, the innermost declared one, and the innermost method.

    Bodies enter and leave; how many are entered says which one holds a place: the last entered so deep.
    """
    named = F.col("kind") == "function"
    method = (F.col("kind") == "method") & (F.col("name") != "constructor")
    facts = {
        "scope_id": (F.lit(True), _scope_id()),
        "in_function": (named, F.struct(F.col("name").alias("name"), F.lit("function").alias("kind"))),
        "in_class": (method, F.struct(F.col("owner").alias("name"), F.lit("class").alias("kind"))),
    }
    enter = functions.select(*_KEY, F.col("open").alias("inside"), F.lit(1).alias("way"), *[
        F.when(test, value).alias(name) for name, (test, value) in facts.items()
    ], *[test.cast("int").alias(f"is_{name}") for name, (test, _) in facts.items()])
    leave = functions.select(*_KEY, F.col("close").alias("inside"), F.lit(-1).alias("way"), *[(-test.cast("int")).alias(f"is_{name}") for name, (test, _) in facts.items()])
    places = units.select(*_KEY, "inside").distinct().withColumn("way", F.lit(0))
    events = enter.unionByName(leave, True).unionByName(places, True)
    order = Window.partitionBy(*_KEY).orderBy("inside", F.desc("way")).rowsBetween(Window.unboundedPreceding, 0)
    for name in facts:
        events = events.withColumn(f"deep_{name}", F.sum(F.coalesce(f"is_{name}", F.lit(0))).over(order))
    for name in facts:
        level = Window.partitionBy(*_KEY, f"deep_{name}").orderBy("inside", F.desc("way")).rowsBetween(Window.unboundedPreceding, 0)
        events = events.withColumn(f"held_{name}", F.when(F.col(f"deep_{name}") > 0, F.last(name, True).over(level)))
    return events.where("way = 0").select(
        *_KEY, "inside", F.col("held_scope_id").alias("scope_id"), F.coalesce("held_in_function", "held_in_class").alias("owner")
    )


def _scope_id() -> Column:
    return F.concat_ws(":", "name", F.col("head_line").cast("string"), F.col("head").cast("string"))


def _calls(units: DataFrame) -> DataFrame:
    """Call expressions: places of the callee, of the bracket and of the end."""
    toks = F.col("toks")
    at = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda k: (F.get(toks, k)["t"] == "(") & (k > 0) & F.get(toks, k + 1).isNotNull())
    with_places = units.where(F.contains("flat", F.lit("("))).select(*_KEY, "inside", "flat", "toks", at.alias("at"))

    def call(k) -> Column:
        here, before = F.get(toks, k), F.get(toks, k - 1)
        word = F.when(before["kind"] == "g", F.get(toks, k - 2)).otherwise(before)
        return F.struct(
            here["chain"].alias("begin"), here["pos"].alias("open"), F.get(toks, k + 1)["fin"].alias("fin"), word["t"].alias("word"),
            word["kind"].alias("word_kind"), here["before_chain"].alias("before"), here["chain_line"].alias("line"),
            F.get(toks, k + 1)["end_line"].alias("end_line"), (k == F.get("at", F.lit(0))).alias("is_first"),
            F.when(word["kind"] != before["kind"], before["pos"]).otherwise(here["pos"]).alias("callee_end"),
        )

    rows = with_places.select(*_KEY, "inside", "flat", F.inline(F.transform("at", call)))
    named = (F.col("word_kind") == "w") & ~(F.col("word").isin(*_NOT_CALLS) & (F.col("begin") >= F.col("open") - F.length("word") - 1))
    return rows.where(named & ~F.col("before").isin("new", "function", "class", "*") & ~F.col("word").isin("super", "constructor"))


def _params_of(heads: DataFrame, units: DataFrame, name: str) -> DataFrame:
    """Heads (with ``open``, the place of a parameter list) with the parameters, places still."""
    toks = F.col("toks")
    equal = _mark(toks, "=")
    head = F.when(equal.isNull(), toks).otherwise(F.filter(toks, lambda x: x["i"] < equal["i"]))
    colon = _mark(head, ":")
    named = F.when(colon.isNull(), head).otherwise(F.filter(head, lambda x: x["i"] < colon["i"]))
    text = F.regexp_replace(_flat(named), r"^(?:@\S+ ?)*(?:(?:public|private|protected|readonly|override) )+", "")
    param = F.struct(
        F.regexp_replace(text, r"^\.\.\.|\?$| ", "").alias("name"), colon["fin"].alias("begin"), F.element_at(head, -1)["fin"].alias("fin"),
        (F.endswith(text, F.lit("?")) | equal.isNotNull() | F.startswith(text, F.lit("..."))).alias("is_optional"),
    )
    rows = units.where("around = '('").select(*_KEY, F.col("inside").alias("open"), F.struct("begin", param.alias("p")).alias("p"))
    rows = rows.join(heads.select(*_KEY, "open").distinct(), [*_KEY, "open"], "left_semi")
    listed = rows.groupBy(*_KEY, "open").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    listed = listed.select(*_KEY, "open", F.transform("ps", lambda p: p["p"]).alias(name))
    return heads.join(listed, [*_KEY, "open"], "left")


def _params_fact(params: Column) -> Column:
    """The parameters as facts, with the texts of their types."""
    return F.transform(F.coalesce(params, F.array().cast(params_type())), lambda p: F.struct(
        p["name"].alias("name"), F.coalesce(F.nullif(F.trim(_sub("content", p["begin"], p["fin"])), F.lit("")), F.lit("any")).alias("type"),
        p["is_optional"].alias("is_optional"),
    )).cast(f"array<{PARAM}>")


def params_type() -> str:
    return "array<struct<name:string,begin:bigint,fin:bigint,is_optional:boolean>>"


def _signature(toks: Column) -> tuple[Column, Column, Column]:
    """Place of the parameter list, and the span between it and the body: the return type."""
    left = _mark(toks, "(")
    right = _first(_after(toks, left["i"]))
    brace, colon = F.element_at(toks, -2), F.get(toks, F.size(toks) - 3)
    has_body = (F.size(toks) >= 3) & (brace["t"] == "{") & (colon["t"] != ":")
    end = F.when(has_body, brace["pos"]).otherwise(F.element_at(toks, -1)["fin"])
    return left["pos"], right["fin"], end


def _type_text(begin: Column, fin: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(_sub("content", begin, fin), r"^\s*:|\s*[;,]?\s*$", "")), F.lit(""))


def _members(units: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Methods and properties by the place of the brace around them."""
    holders = bodies.where("kind IN ('class', 'interface')").select(*_KEY, F.col("open").alias("inside"))
    inside = units.join(holders, [*_KEY, "inside"], "left_semi").where(F.rlike("flat", F.lit(_MEMBER)))
    flat, toks = F.col("flat"), F.col("toks")
    words = F.filter(F.split(F.trim(F.regexp_extract(flat, _MEMBER, 1)), " "), lambda w: w != "")
    rows = inside.select(
        *_KEY, "inside", "begin", "fin", "toks", words.alias("modifiers"), F.regexp_extract(flat, _MEMBER, 2).alias("name"),
        (F.regexp_extract(flat, _MEMBER, 4) == "(").alias("is_method"),
    )
    left, right, end = _signature(toks)
    heads = rows.where("is_method AND name <> 'constructor'").select(
        *_KEY, "inside", "begin", "modifiers", "name", left.alias("open"), right.alias("type_begin"), end.alias("type_fin")
    )
    methods = _params_of(heads, units, "params")
    method = F.struct("name", "params", "type_begin", "type_fin", "modifiers")
    colon, equal = _mark(toks, ":"), _mark(toks, "=")
    typed = colon.isNotNull() & (equal.isNull() | (colon["i"] < equal["i"]))
    prop = F.struct(
        "name", F.when(typed, colon["fin"]).alias("type_begin"),
        F.when(typed, F.coalesce(equal["pos"], F.col("fin"))).alias("type_fin"), "modifiers",
    )
    properties = rows.where("NOT is_method")
    by_place = lambda found, item, name: found.groupBy(*_KEY, F.col("inside").alias("open")).agg(
        F.sort_array(F.collect_list(F.struct("begin", item.alias("m")))).alias("ms")
    ).select(*_KEY, F.col("open").alias("brace"), F.transform("ms", lambda m: m["m"]).alias(name))
    return by_place(methods, method, "methods"), by_place(properties, prop, "properties")


def _decls(units: DataFrame, bodies: DataFrame) -> DataFrame:
    """Top-level declarations, places still."""
    flat, toks = F.col("flat"), F.col("toks")
    word = F.coalesce(F.nullif(F.regexp_extract(flat, _HEAD, 2), F.lit("")), F.regexp_extract(flat, _HEAD, 4))
    name = F.nullif(F.regexp_extract(flat, _HEAD, 3), F.lit(""))
    leads = F.regexp_extract(flat, _HEAD, 1)
    unnamed = reduce(lambda c, kv: c.when(word == kv[0], kv[1]), _UNNAMED.items(), F.when(F.lit(False), ""))
    whole = (word != "type") | F.rlike(flat, F.lit(rf"\btype {_IDENT} ?(?:<.*?> ?)?="))
    rows = units.where((F.col("depth") == 0) & F.rlike(flat, F.lit(_HEAD))).where(
        whole & (name.isNotNull() | F.contains(leads, F.lit("default"))) & (word.isin("function", "type") | F.exists(toks, lambda x: x["t"] == "{"))
    )
    left, right, end = _signature(toks)
    is_class, is_function = word == "class", word == "function"
    marks = F.transform(F.filter(toks, lambda x: x["kind"] == "d"), lambda x: F.regexp_extract(x["t"], r"([\w$]+)(?:\(|$)", 1))
    base = F.regexp_extract(flat, rf"\bextends ({_IDENT}(?:\.{_IDENT})*(?:<[^{{}}]*?>+)?)", 1)
    listed = F.regexp_extract(flat, r"\bimplements (.*?) ?\{\}", 1)
    none = F.array().cast("array<string>")
    heads = rows.select(
        *_KEY, "begin", "fin", "line", "end_line", word.alias("word"), F.coalesce(name, unnamed).alias("name"),
        F.when(is_class, marks).otherwise(none).alias("decorators"),
        F.when(is_class & (base != ""), F.array(base)).otherwise(none).alias("bases"),
        F.when(is_class & (listed != ""), F.transform(F.split(listed, ","), lambda n: F.trim(n))).otherwise(none).alias("ifaces"),
        F.contains(leads, F.lit("export")).alias("is_exported"), F.contains(leads, F.lit("default")).alias("is_default"),
        F.when(is_function, left).otherwise(-2 - F.col("begin")).alias("open"),
        F.when(is_function, right).alias("type_begin"), F.when(is_function, end).alias("type_fin"),
        _first(F.filter(toks, lambda x: x["t"] == "{"))["pos"].alias("brace"),
    )
    methods, properties = _members(units, bodies)
    found = _params_of(heads, units, "params").join(methods, [*_KEY, "brace"], "left").join(properties, [*_KEY, "brace"], "left")
    return found


def _imports(units: DataFrame) -> DataFrame:
    rows = units.where((F.col("depth") == 0) & F.rlike("flat", F.lit(r"^import\b(?! ?\()")) & F.rlike("flat", F.lit("''$|\"\"$")))
    return rows.select(*_KEY, "begin", "fin", "line")


def _declarators(toks: Column) -> Column:
    """The tokens of each declared name of a ``const``, ``let`` or ``var`` unit; of another unit all."""
    commas = F.filter(toks, lambda x: (x["t"] == ",") & (x["kind"] == "p"))
    lead = _first(F.filter(toks, lambda x: x["t"].isin("const", "let", "var") & (x["kind"] == "w")))
    bounds = F.concat(F.array(lead["i"]), F.transform(commas, lambda x: x["i"]))
    ends = F.concat(F.transform(commas, lambda x: x["i"]), F.array(F.element_at(toks, -1)["i"] + 1))
    parts = F.transform(F.arrays_zip(bounds.alias("a"), ends.alias("z")), lambda s: F.filter(toks, lambda x: (x["i"] > s["a"]) & (x["i"] < s["z"])))
    return F.when(lead.isNotNull(), parts).otherwise(F.array(toks))


def _steps(units: DataFrame) -> DataFrame:
    """Declarations with a value and re-assignments, places still."""
    is_decl = F.rlike("flat", F.lit(r"^(?:export )?(?:declare )?(?:const|let|var)\b"))
    candidates = units.where(F.contains("flat", F.lit("="))).where(F.exists("toks", lambda x: (x["t"] == "=") & (x["kind"] == "p"))).select(
        *_KEY, "depth", is_decl.alias("is_decl"), "flat", F.explode(_declarators(F.col("toks"))).alias("toks")
    )
    toks = F.col("toks")
    equal = _mark(toks, "=")
    rows = candidates.withColumns({"equal": equal["i"]}).where("equal IS NOT NULL").withColumns({
        "left": F.filter(toks, lambda x: x["i"] < F.col("equal")), "right": F.filter(toks, lambda x: x["i"] > F.col("equal")),
    }).where((F.size("right") > 0) & (F.size("left") > 0) & ~F.rlike("flat", F.lit(_LEADS + r"(?:type|enum|interface|class|function|import)\b")))
    first = _first(F.col("left"))
    pattern = first["t"].isin("{", "[") & F.col("is_decl")
    target = F.regexp_extract(_flat(F.col("left")), _TARGET, 1)
    rows = rows.select(
        *_KEY, "is_decl", pattern.alias("is_pattern"), F.when(pattern, first["pos"]).alias("open"), first["pos"].alias("begin"),
        F.when(pattern, F.element_at("left", -1)["fin"]).alias("target_fin"), target.alias("target"), first["line"].alias("line"),
        _value(F.col("right")).alias("value"),
    )
    return rows.where("is_pattern OR target <> ''")


def _with_patterns(steps: DataFrame, units: DataFrame) -> DataFrame:
    """Steps with the names a pattern binds."""
    binding = F.regexp_extract("flat", rf"^(?:\.\.\.)?({_IDENT})?", 1)
    bound = units.where("around IN ('o', '[', 'b')").join(
        steps.where("is_pattern").select(*_KEY, F.col("open").alias("inside")).distinct(), [*_KEY, "inside"], "left_semi"
    )
    names = bound.groupBy(*_KEY, F.col("inside").alias("open")).agg(F.sort_array(F.collect_list(F.struct("begin", binding.alias("n")))).alias("ns"))
    names = names.select(*_KEY, "open", F.transform("ns", lambda n: n["n"]).alias("bound"))
    return steps.join(names, [*_KEY, "open"], "left")


# Facts ---------------------------------------------------------------------------------


#: The places each column of facts is made of.
_PLACES = {
    "decls": ("p_decls",), "imports": ("p_imports",), "calls": ("p_calls",), "assigns": ("p_steps",),
    "scopes": ("p_scopes", "p_steps", "p_calls"), "exprs": ("p_templates", "p_markup", "p_steps", "p_calls"), "marks": (),
}


def _placed_facts(files: DataFrame, wanted: set[str], write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row for each file with arrays of the wanted kinds of facts, in order, with places instead of texts."""
    units = _units(files)
    if wanted != {"p_imports"}:
        units = write(units)  # read many times
        bodies = write(_bodies(units))
        holders = bodies.where("kind IN ('class', 'interface')").select(*_KEY, F.col("open").alias("inside"), F.col("kind").alias("holder"), F.col("name").alias("owner"))
    if wanted - {"p_imports", "p_decls", "p_steps"}:
        bodies = write(bodies.join(holders, [*_KEY, "inside"], "left").where("kind <> 'method' OR holder = 'class'"))
        functions = bodies.where("kind IN ('function', 'inner', 'method')")
    if wanted & {"p_calls", "p_templates", "p_markup"}:
        around = write(_around(units, functions))

    def scoped(rows: DataFrame) -> DataFrame:
        return rows.join(around, [*_KEY, "inside"], "left")

    def calls() -> DataFrame:
        found = _calls(units).join(holders.select(*_KEY, "inside", F.lit(True).alias("in_body")), [*_KEY, "inside"], "left")
        is_head = F.col("in_body") & F.col("is_first") & F.rlike("flat", F.lit(_MEMBER)) & (F.regexp_extract("flat", _MEMBER, 4) == "(")
        found = found.where(~F.coalesce(is_head, F.lit(False))).drop("flat", "is_first", "in_body", "before", "word_kind")
        args = units.where("around = '('").select(*_KEY, F.col("inside").alias("open"), "begin", _value(F.col("toks"), F.col("flat")).alias("value"))
        of_call = args.groupBy(*_KEY, "open").agg(F.sort_array(F.collect_list(F.struct("begin", "value"))).alias("vs")).select(
            *_KEY, "open", F.transform("vs", lambda v: v["value"]).alias("args")
        )
        return scoped(found.join(of_call, [*_KEY, "open"], "left"))

    def templates() -> DataFrame:
        found = units.where(F.contains("flat", F.lit("`$`"))).select(*_KEY, "inside", F.explode(F.filter("toks", lambda x: (x["kind"] == "t") & F.rlike(x["t"], F.lit(r"\$\{")))).alias("x"))
        return scoped(found.select(
            *_KEY, "inside", F.col("x.pos").alias("begin"), F.col("x.fin").alias("fin"), F.col("x.line").alias("line"), F.col("x.end_line").alias("end_line")
        ))

    def markup() -> DataFrame:
        written = _first(F.filter("toks", lambda x: x["t"].isin(*MARKUP_PROPERTIES)))
        return scoped(units.where(F.rlike("flat", F.lit(_MARKUP))).select(
            *_KEY, "inside", "begin", "fin", "line", "end_line", F.regexp_extract("flat", _MARKUP, 2).alias("prop"),
            _value(_after(F.col("toks"), _first(_after(F.col("toks"), written["i"]))["i"])).alias("value"),
        ))

    def scopes() -> DataFrame:
        return functions.select(*_KEY, "name", "open", "close", F.col("head_line").alias("line"), F.col("close_line").alias("end_line"), _scope_id().alias("scope_id"))

    places = {
        "p_calls": (calls, "begin"), "p_steps": (lambda: _with_patterns(_steps(units), units), "begin"), "p_templates": (templates, "begin"),
        "p_markup": (markup, "begin"), "p_decls": (lambda: _decls(units, bodies), "begin"), "p_scopes": (scopes, "open"),
        "p_imports": (lambda: _imports(units), "begin"),
    }
    names = [name for name in places if name in wanted]

    def tagged(name: str) -> DataFrame:
        make, order = places[name]
        rows = make()
        own = [c for c in rows.columns if c not in _KEY]
        return rows.select(*_KEY, F.struct(F.col(order).alias("at"), F.struct(*own).alias("item")).alias(name))

    every = reduce(lambda a, b: a.unionByName(b, True), [tagged(name) for name in names])
    gathered = every.groupBy(*_KEY).agg(*[F.sort_array(F.collect_list(name)).alias(name) for name in names])
    return gathered.select(*_KEY, *[F.transform(name, lambda x: x["item"]).alias(name) for name in names])


def _import_fact(i: Column, ord_: Column) -> Column:
    text = _sub("content", i["begin"], i["fin"])
    default = F.regexp_extract(text, rf"^import\s+(?:type\s+(?!from\b))?({_IDENT})\s*(?:,|from\b)", 1)
    listed = F.regexp_extract(text, r"\{([^}]*)\}", 1)
    names = F.filter(F.transform(F.split(listed, ","), lambda n: F.regexp_replace(F.trim(F.regexp_extract(n, r"^([\s\S]*?)(?:\s+as\s[\s\S]*)?$", 1)), r"^type\s+", "")), lambda n: n != "")
    return F.struct(
        F.regexp_extract(text, r"['\"]([^'\"]*)['\"]\s*$", 1).alias("module"), F.lit(0).alias("level"), names.alias("names"),
        F.nullif(default, F.lit("")).alias("default_name"), i["line"].alias("line"), ord_.alias("ord"),
    )


def _decl_fact(d: Column, ord_: Column) -> Column:
    is_class, has_members = d["word"] == "class", d["word"].isin("class", "interface")
    none = F.array().cast("array<string>")
    methods = F.transform(F.when(is_class, d["methods"]), lambda m: F.struct(
        m["name"].alias("name"), _params_fact(m["params"]).alias("params"), _type_text(m["type_begin"], m["type_fin"]).alias("return_type"),
        none.alias("decorators"), F.array_contains(m["modifiers"], "async").alias("is_async"), m["modifiers"].alias("modifiers"),
    ))
    properties = F.transform(F.when(has_members, d["properties"]), lambda p: F.struct(
        p["name"].alias("name"), F.coalesce(_type_text(p["type_begin"], p["type_fin"]), F.lit("any")).alias("type"), p["modifiers"].alias("modifiers"),
    ))
    return F.struct(
        F.when(d["word"] == "type", "type-alias").otherwise(d["word"]).alias("kind"), d["name"].alias("name"), ord_.alias("ord"),
        d["line"].alias("start_line"), d["end_line"].alias("end_line"), d["line"].alias("block_line"),
        F.substring(_sub("content", d["begin"], d["fin"]), 1, 200).alias("snippet"), d["decorators"].alias("decorators"), d["bases"].alias("bases"),
        d["ifaces"].alias("ifaces"), _params_fact(d["params"]).alias("params"), _type_text(d["type_begin"], d["type_fin"]).alias("return_type"),
        d["is_exported"].alias("is_exported"), d["is_default"].alias("is_default"),
        F.coalesce(methods, F.array().cast(f"array<{METHOD_FACT}>")).alias("methods"),
        F.coalesce(properties, F.array().cast(f"array<{PROPERTY_FACT}>")).alias("properties"),
    )


def _call_fact(c: Column, ord_: Column) -> Column:
    callee = F.regexp_replace(_sub("content", c["begin"], c["callee_end"]), r"\s*\n\s*|\s+$", "")
    args = F.transform(F.coalesce(c["args"], F.array().cast(f"array<{VALUE}>")), lambda v: F.struct(
        _raw(v).alias("text"), v["kind"].alias("kind"), names_in(v).alias("names"), atoms_of(v).alias("atoms"),
    ))
    return F.struct(
        ord_.alias("ord"), c["scope_id"].alias("scope_id"), c["owner"]["name"].alias("caller"), c["owner"]["kind"].alias("caller_kind"),
        callee.alias("callee"), c["word"].alias("callee_name"), F.contains(callee, F.lit(".")).alias("is_member"), args.alias("args"),
        F.create_map().cast("map<string,string>").alias("kwargs"), c["line"].alias("line"), c["end_line"].alias("end_line"),
        _sub("content", c["begin"], c["fin"]).alias("text"),
    )


def _step_fact(s: Column, ord_: Column) -> Column:
    v = s["value"]
    pattern = s["is_pattern"]
    target = F.when(pattern, _sub("content", s["begin"], s["target_fin"])).otherwise(s["target"])
    return F.struct(
        ord_.alias("ord"), target.alias("target"), F.when(pattern, F.coalesce(s["bound"], F.array().cast("array<string>"))).otherwise(F.array(s["target"])).alias("targets"),
        F.when(pattern, "tuple").when(s["is_decl"], "name").otherwise("other").alias("target_kind"), _raw(v).alias("value"),
        v["kind"].alias("value_kind"), F.lit(None).cast("string").alias("call_name"), F.lit(False).alias("is_augmented"),
        s["is_decl"].alias("is_decl"), F.array().cast("array<struct<text:string,name:string,via:array<string>>>").alias("uses"),
        names_in(v).alias("names"), s["line"].alias("line"), v["end_line"].alias("end_line"),
    )


def _expr_fact(kind: str, text: Column, scope: Column, atoms: Column, line: Column, end_line: Column, place: Column,
               callee: Column | None = None, assigned: Column | None = None, declared: Column | None = None, prop: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    some = lambda c: none if c is None else c.cast("string")
    return F.struct(
        place.cast("int").alias("ord"), F.lit(kind).alias("kind"), text.alias("text"), scope.alias("scope_id"), some(callee).alias("parent_callee"),
        some(assigned).alias("assigned_to"), some(declared).alias("decl_target"), atoms.alias("atoms"), some(prop).alias("prop"),
        line.alias("line"), end_line.alias("end_line"),
    ).cast(EXPR)


def _exprs(calls: Column, steps: Column) -> Column:
    """Templates, values made by operators, and markup that is written, with where they go to.

    ``calls`` and ``steps`` are places; a value stands alone as an argument or as what is assigned.
    """
    arguments = F.flatten(F.transform(calls, lambda c: F.transform(
        F.coalesce(c["args"], F.array().cast(f"array<{VALUE}>")),
        lambda v: F.struct(v.alias("v"), c["scope_id"].alias("scope"), F.regexp_replace(_sub("content", c["begin"], c["callee_end"]), r"\s*\n\s*|\s+$", "").alias("callee"),
                           F.lit(None).cast("string").alias("assigned"), F.lit(None).cast("string").alias("declared")),
    )))
    values = F.transform(steps, lambda s: F.struct(
        s["value"].alias("v"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("callee"),
        F.when(s["is_pattern"], _sub("content", s["begin"], s["target_fin"])).otherwise(s["target"]).alias("assigned"),
        F.when(s["is_decl"], F.when(s["is_pattern"], _sub("content", s["begin"], s["target_fin"])).otherwise(s["target"])).alias("declared"),
    ))
    placed = F.concat(arguments, values)
    binaries = F.transform(F.filter(placed, lambda p: p["v"]["kind"] == "binary"), lambda p: _expr_fact(
        "binary", _raw(p["v"]), p["scope"], atoms_of(p["v"]), p["v"]["line"], p["v"]["end_line"], p["v"]["begin"], p["callee"], p["assigned"], p["declared"]
    ))
    alone = F.filter(placed, lambda p: p["v"]["flat"] == "`$`")
    templates = F.transform("p_templates", lambda t: _template_fact(t, _first(F.filter(alone, lambda p: p["v"]["begin"] == t["begin"]))))
    markup = F.transform("p_markup", lambda m: _expr_fact(
        "markup", _sub("content", m["begin"], m["fin"]), m["scope_id"], atoms_of(m["value"]), m["line"], m["end_line"], m["begin"], prop=m["prop"]
    ))
    return F.concat(*[F.coalesce(a, F.array().cast(f"array<{EXPR}>")) for a in (templates, binaries, markup)])


def _template_fact(t: Column, place: Column) -> Column:
    text = _sub("content", t["begin"], t["fin"])
    return _expr_fact("template", text, t["scope_id"], _inner_atoms(text), t["line"], t["end_line"], t["begin"], place["callee"], place["assigned"], place["declared"])


def script_facts(files: DataFrame, only: Sequence[str] | None = None, stored: bool = False) -> DataFrame:
    """Facts of TypeScript and JavaScript files; one output row per file.

    ``marks`` are the lines that check paths.  A null text is one with an error.  ``only`` names the columns of facts that will
    be read (none: all).  Units and what is shuffled take several times the disk of the texts; so many texts are worked on a
    slice after another, and only facts stay.  They are then a written table, as they are when ``stored``.
    """
    columns = list(_PLACES if only is None else only)
    texts = files.where("language = 'typescript'").select(*_KEY, "content")
    n_bytes = texts.agg(F.sum(F.octet_length("content"))).head()[0] or 0
    n_slices = -(-n_bytes // _SLICE_BYTES)
    if n_slices < 2:
        facts = _facts(texts, columns, write_once)
        return write_once(facts) if stored else facts
    # Files that share a path share a slice.
    dealt = Scratch(files.sparkSession)
    texts = dealt.write(texts.withColumn("slice", F.pmod(F.xxhash64(*_KEY), F.lit(n_slices)).cast("int")), "slice")
    table = None
    for k in range(n_slices):
        scratch = Scratch(files.sparkSession)
        facts = _facts(texts.where(F.col("slice") == k).drop("slice"), columns, scratch.write)
        table = table or Grown(files.sparkSession, facts.schema)
        table.add(facts)
        scratch.drop_all()
    dealt.drop_all()
    return table.table


def _facts(texts: DataFrame, columns: list[str], write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    marked = F.filter(
        F.transform(F.split("content", "\n"), lambda text, i: F.when(any_of(text, PATH_CHECKS), i + 1)), lambda n: n.isNotNull()
    )
    text = F.coalesce("content", F.lit(""))
    needed = texts.select(
        *_KEY, marked.alias("marks"), F.col("content").isNull().alias("missing"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
        text.alias("text"),
    )
    wanted = {place for name in columns for place in _PLACES[name]}
    rows = needed.join(_placed_facts(needed.select(*_KEY, "text"), wanted, write), _KEY, "left") if wanted else needed
    # after the join: what is made of a text is not shuffled with it
    tokens = F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))
    rows = rows.withColumns({
        "content": F.encode("text", "UTF-8"), "masked": F.encode(F.array_join(F.transform(tokens, _masked), ""), "UTF-8"),
    })

    def facts(name: str, fact, kind: str) -> Column:
        return F.coalesce(F.transform(name, lambda x, i: fact(x, i.cast("int"))), F.array().cast(f"array<{kind}>")).cast(f"array<{kind}>")

    def interval(places: str, s: Column) -> list[Column]:
        """How many of some places in order lie before a body, and how many in it."""
        at = F.coalesce(F.transform(places, lambda p: p["begin"]), F.array().cast("array<bigint>"))
        before, until = F.size(F.filter(at, lambda a: a <= s["open"])), F.size(F.filter(at, lambda a: a < s["close"]))
        return [before, until - before]

    def scopes() -> Column:
        found = F.transform("p_scopes", lambda s: F.struct(
            s["scope_id"].alias("scope_id"), s["name"].alias("name"), s["line"].alias("line"), s["end_line"].alias("end_line"),
            *[c.alias(n) for c, n in zip(interval("p_steps", s) + interval("p_calls", s), ("first_step", "n_steps", "first_call", "n_calls"))],
        ))
        return F.coalesce(found, F.array().cast(f"array<{SCOPE}>")).cast(f"array<{SCOPE}>")

    made = {
        "decls": lambda: facts("p_decls", _decl_fact, DECL), "imports": lambda: facts("p_imports", _import_fact, IMPORT),
        "calls": lambda: facts("p_calls", _call_fact, CALL), "assigns": lambda: facts("p_steps", _step_fact, ASSIGN), "scopes": scopes,
        "exprs": lambda: _exprs(F.coalesce("p_calls", F.array()), F.coalesce("p_steps", F.array())), "marks": lambda: F.col("marks"),
    }
    schema = _schema()
    return rows.select(
        *_KEY, F.lit("typescript").alias("language"), F.col("n_lines").cast("int").alias("n_lines"), F.when(F.col("missing"), "no content").alias("error"),
        *[made[name]().alias(name) for name in made if name in columns],
    ).to(StructType([field for field in schema if field.name not in made or field.name in columns]))


def _schema() -> StructType:
    return StructType.fromDDL(PARSED)
