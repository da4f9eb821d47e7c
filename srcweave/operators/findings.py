"""Findings: every enabled rule over every fact row in one pass, and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcweave.functions import ids
from srcweave.functions import severity as S
from srcweave.functions.paths import dir_name
from srcweave.functions.text import is_secret_value, secret_name
from srcweave.operators import rules as R
from srcweave.operators.rules import Rule, RuleOptions
from srcweave.operators.taint import scope_taint
from srcweave.schemas import ASSIGN, CALL, DECL, EXPR, FINDINGS, TAINT_ENTRY
from srcweave.session import as_lookup, broadcast_if_small, write_once

_KINDS = {"call": CALL, "assign": ASSIGN, "decl": DECL, "expr": EXPR}
_ARRAYS = {"call": "calls", "assign": "assigns", "decl": "decls", "expr": "exprs"}
_SCOPE_TAINT = f"struct<scope_id:string,name:string,line:int,validated:boolean,vars:array<{TAINT_ENTRY}>>"
_SNIPPET_CHARS = 200
_SECRET_CHARS = 20


def fact_rows(
    parsed: DataFrame, language: str, options: RuleOptions, gates: dict
) -> DataFrame:
    """One row per fact with the taint of its function beside it; no shuffle.

    ``gates`` holds, for each kind of fact, a predicate on the fact alone.  Facts
    that fail it are dropped while nested.  The function of a fact is looked up while nested too, so
    a row carries the taint of that function alone; in TypeScript any function of the file counts.
    """
    in_scope = {"call", "expr"}
    whole = language != "python"

    def tagged(kind: str) -> Column:
        def row(f: Column) -> Column:
            scope = F.lit(None)
            if kind in in_scope:
                scope = F.get(F.filter("taint", lambda t: t["scope_id"] == f["scope_id"]), F.lit(0))
            return F.struct(
                F.lit(kind).alias("kind"),
                *[(f if k == kind else F.lit(None).cast(t)).alias(k) for k, t in _KINDS.items()],
                scope.cast(_SCOPE_TAINT).alias("scope"),
            )

        return F.transform(F.filter(_ARRAYS[kind], gates[kind]), row)

    facts = F.concat(*[tagged(k) for k in gates])
    tainted = scope_taint(parsed, language, options.custom_sources, options.substring)
    every = F.when(F.size("taint") > 0, F.flatten(F.transform("taint", lambda t: t["vars"])))
    rows = tainted.select(
        "project_id", "file_path", "marks", *([every.alias("every")] if whole else []), F.explode(facts).alias("f")
    )
    return rows.select(
        "project_id", "file_path", "f.kind", *[f"f.{k}" for k in _KINDS], "marks",
        F.col("every" if whole else "f.scope.vars").alias("vars"), F.col("f.scope.validated").alias("validated"),
        F.col("f.scope.line").alias("scope_line"),
    )


def _any_gate(rules: list[Rule], options: RuleOptions):
    """The fact passes the gate of one of the rules."""

    def test(fact: Column) -> Column:
        passed = F.lit(False)
        for rule in rules:
            passed = passed | rule.gate(fact, options)
        return passed

    return test


def _location(rule: Rule, fact: Column) -> tuple[Column, Column, Column]:
    """First line, last line and snippet of a hit."""
    if rule.reads == "decl":
        return fact["block_line"], fact["end_line"], fact["snippet"]
    if rule.reads == "assign":
        shown = F.concat(
            fact["target"], F.lit(" = "), F.substring(fact["value"], 1, _SECRET_CHARS),
            F.lit("..."),
        )
        return fact["line"], fact["end_line"], shown
    return fact["line"], fact["end_line"], fact["text"]


def _hit(rule: Rule, options: RuleOptions) -> Column:
    name, severity, cwe, owasp = R.RULE_TABLE[rule.rule_id]
    fact = F.col(rule.reads)
    first, last, text = _location(rule, fact)
    level = F.lit(severity) if rule.severity is None else rule.severity(fact, options)
    if rule.rule_id in options.severity:
        level = F.lit(options.severity[rule.rule_id])
    where = F.concat(F.lit(f"{R.DESCRIPTIONS[rule.rule_id]} (line "), first.cast("string"))
    if rule.detail is not None:
        where = F.concat(where, F.lit(", from "), rule.detail(fact, options))
    return F.when(
        (F.col("kind") == rule.reads) & rule.gate(fact, options) & rule.fires(fact, options),
        F.struct(
            F.lit(rule.slug).alias("slug"),
            fact["ord"].alias("hit_no"),
            F.lit(rule.rule_id).alias("rule_id"),
            level.alias("severity"),
            rule.title(fact).alias("title"),
            F.concat(where, F.lit(")")).alias("description"),
            first.alias("start_line"),
            last.alias("end_line"),
            F.substring(text, 1, _SNIPPET_CHARS).alias("snippet"),
            F.lit(R.ADVICE[rule.rule_id]).alias("recommendation"),
            F.lit(rule.cwe or cwe).alias("cwe_id"),
            F.lit(owasp).alias("owasp_category"),
        ),
    )


def findings(
    parsed: DataFrame,
    language: str = "python",
    options: RuleOptions = RuleOptions(),
    only: tuple[str, ...] | None = None,
) -> DataFrame:
    """Findings of the enabled rules (or of ``only`` some), as a bag.

    One scan of the facts; a rule that is disabled is not in the plan.  ``hit_no``
    (place of the fact in its file) keeps rows apart that share an id.
    """
    active = [
        r for r in R.enabled_rules(language, options) if only is None or r.rule_id in only
    ]
    if not active:
        return parsed.sparkSession.createDataFrame([], FINDINGS)
    gates = {r.reads: _any_gate([g for g in active if g.reads == r.reads], options) for r in active}
    rows = fact_rows(parsed, language, options, gates)
    hits = F.array_compact(F.array(*[_hit(r, options) for r in active]))
    found = rows.select("project_id", "file_path", F.inline(hits))
    found = found.select(
        "project_id",
        ids.finding_id(F.col("file_path"), F.col("slug"), F.col("start_line")).alias("id"),
        "hit_no", "rule_id", "severity", "title", "description", "file_path", "start_line",
        "end_line", "snippet", "recommendation", "cwe_id", "owasp_category",
    )
    if options.min_severity:
        found = min_severity(found, options.min_severity)
    return found


# Pure text forms ------------------------------------------------------------

#: Fixed value: an assignment of a quoted literal on one line.
ASSIGNED_LITERAL = r"""^\s*([A-Za-z_][\w.\[\]'"]*)\s*(?::[^=]*)?=\s*('[^'\n]*'|"[^"\n]*")\s*$"""


def secret_lines(lines: DataFrame, false_positives: tuple[str, ...] = ()) -> DataFrame:
    """Hard-coded secrets by line: works on any table of text lines."""
    name = F.regexp_extract("line", ASSIGNED_LITERAL, 1)
    value = F.regexp_extract("line", ASSIGNED_LITERAL, 2)
    found = lines.where(F.contains("line", F.lit("="))).select(
        "project_id", "file_path", "line_no", name.alias("name"), value.alias("value")
    )
    found = found.where((F.col("name") != "") & secret_name(F.col("name")))
    found = found.where(is_secret_value(F.col("value")))
    for pattern in false_positives:
        found = found.where(~F.rlike("name", F.lit(pattern)))
    return found


#: Fixed value: a secret's name and its quoted value anywhere in running text.
SECRET_IN_TEXT = (
    r"""(?i)\b(?:password|passwd|secret|api_key|apikey|token|auth_token|private_key"""
    r"""|access_key|secret_key)\b\s*[:=]\s*(?:"[^"\n]*"|'[^'\n]*')"""
)


def secret_scan(texts: DataFrame, column: str) -> DataFrame:
    """Every secret in a text column, whole texts, with the other columns kept."""
    kept = [c for c in texts.columns if c != column]
    hits = texts.select(
        *kept, F.explode(F.regexp_extract_all(column, F.lit(SECRET_IN_TEXT), F.lit(0))).alias("hit")
    )
    named = hits.select(
        *kept,
        F.regexp_extract("hit", r"^(\w+)", 1).alias("name"),
        F.regexp_extract("hit", r"""[:=]\s*(.*)$""", 1).alias("value"),
    )
    return named.where(is_secret_value(F.col("value")))


def unsanitized_lines(lines: DataFrame) -> DataFrame:
    """Lines that hold both an input word and a sink word."""
    hit = lines.where(R.unsanitized_line(F.col("line")))
    return hit.select(
        "project_id", "file_path", "line_no",
        ids.finding_id(F.col("file_path"), "unsanitized", F.col("line_no") - 1).alias("id"),
        F.trim("line").alias("snippet"),
    )


# After evaluation -----------------------------------------------------------


def min_severity(found: DataFrame, minimum: str) -> DataFrame:
    return found.where(S.at_least(F.col("severity"), minimum))


def apply_rule_config(found: DataFrame, config: DataFrame) -> DataFrame:
    """Drop findings of disabled rules and replace severities that are overridden.

    ``config`` has ``rule_id, enabled, severity`` and, when it differs by
    project, ``project_id``.
    """
    keys = [k for k in ("project_id", "rule_id") if k in config.columns]
    small = broadcast_if_small(
        config.select(*keys, "enabled", F.col("severity").alias("override"))
    )
    joined = found.join(small, keys, "left").where("coalesce(enabled, true)")
    return joined.withColumn("severity", F.coalesce("override", "severity")).select(
        *found.columns
    )


def apply_project_config(found: DataFrame, config: DataFrame) -> DataFrame:
    """Findings under the configuration of their project (see :func:`srcweave.sources.config.project_config`)."""
    small = broadcast_if_small(config.select("project_id", "rules", "min_severity"))
    joined = found.join(small, "project_id", "left")
    setting = F.try_element_at("rules", F.col("rule_id"))
    kept = joined.where(F.coalesce(setting["enabled"], F.lit(True))).withColumn(
        "severity", F.coalesce(setting["severity"], "severity")
    )
    least = S.severity_rank(F.col("min_severity"))
    return kept.where(F.col("min_severity").isNull() | (S.severity_rank(F.col("severity")) >= least)).select(*found.columns)


def ranked(found: DataFrame) -> DataFrame:
    """Findings, worst first.

    They are written first: a sort by ranges reads its rows twice, once to find the ranges, and would parse every file twice.
    """
    return write_once(found).withColumn("rank", S.severity_rank(F.col("severity"))).orderBy(
        F.desc("rank"), "project_id", "file_path", "start_line", "rule_id", "hit_no"
    )


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("project_id", "rule_id").agg(
        F.count("*").alias("n"), F.max_by("severity", S.severity_rank(F.col("severity"))).alias("severity")
    )


def severity_counts(found: DataFrame) -> DataFrame:
    names = list(S.SEVERITY_RANK)
    return found.groupBy("project_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in names],
    )


def category_share(found: DataFrame) -> DataFrame:
    """Share of each rule in its project's findings, of the counts only."""
    counts = found.groupBy("project_id", "rule_id").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("project_id"))
    return counts.select("project_id", "rule_id", "n", (F.col("n") / total).alias("share"))


def action_list(found: DataFrame, systemic_share: float = 0.5) -> DataFrame:
    """Findings in the order to fix them: critical, then systemic, then the rest."""
    share = category_share(found).select("project_id", "rule_id", "share")
    joined = found.join(as_lookup(share), ["project_id", "rule_id"])
    priority = (
        F.when(F.col("severity") == "critical", 1)
        .when(F.col("share") >= systemic_share, 2)
        .otherwise(3)
    )
    return joined.withColumn("priority", priority).orderBy(
        "priority", F.desc(S.severity_rank(F.col("severity"))), "project_id", "file_path",
        "start_line", "rule_id", "hit_no",
    )


def rules_without_findings(rules: DataFrame, found: DataFrame, projects: DataFrame) -> DataFrame:
    """Rules that found nothing, per project."""
    every = projects.select("project_id").withColumn(
        "rule_id", F.explode(F.array(*[F.lit(r) for r in R.RULE_TABLE]))
    ).join(F.broadcast(rules.select("rule_id", "name")), "rule_id")
    seen = found.select("project_id", "rule_id").distinct()
    return every.join(seen, ["project_id", "rule_id"], "left_anti")


def clean_clusters(clusters: DataFrame, found: DataFrame) -> DataFrame:
    """Folders without a finding."""
    dirty = found.select("project_id", dir_name(F.col("file_path")).alias("dir")).distinct()
    return clusters.join(dirty, ["project_id", "dir"], "left_anti")


def findings_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """New, fixed and unchanged findings by id; ids repeat, so counts are compared."""
    tagged = before.select("project_id", "id", F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select("project_id", "id", F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    counts = tagged.groupBy("project_id", "id").agg(
        F.sum("b").alias("n_before"), F.sum("a").alias("n_after")
    )
    status = (
        F.when(F.col("n_before") < F.col("n_after"), "new")
        .when(F.col("n_before") > F.col("n_after"), "fixed")
        .otherwise("unchanged")
    )
    return counts.withColumn("status", status)


def new_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Bag difference of the id columns."""
    return after.select("project_id", "id").exceptAll(before.select("project_id", "id"))
