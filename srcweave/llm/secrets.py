"""Secrets in texts, with weak parts of credentials linked when they stand together.

Native: regular expressions, array functions and windows only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcweave.session import write_once

#: Code points between parts of one credential, at most.
REACH = 200


@dataclass(frozen=True)
class Kind:
    """A pattern, what part of a credential its matches are, and whether they stand alone."""

    name: str
    pattern: str
    role: str
    base: bool


#: Names, patterns and order of the kinds.
KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", True),
    Kind("access", r"AKIA[A-Z0-9]{12,}", "identifier", True),
    Kind("hex", r"[0-9a-f]{32,}", "secret", True),
    Kind("ident", r"""(?i:(?:client|account|key)_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", "identifier", False),
    Kind("value", r"[A-Za-z0-9+/_=-]{20,}", "secret", False),
    Kind("endpoint", r"https?://[A-Za-z0-9./:_-]{4,}", "endpoint", False),
)
ROLES = ("identifier", "secret", "endpoint")


def _kept(kind: Kind, match: Column) -> Column:
    """Whether a match of the pattern counts."""
    if kind.name == "assign":
        return F.length(F.regexp_extract(match, kind.pattern, 2)) >= 8
    if kind.name == "value":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def matches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``row``, ``doc_id``, and for each kind the gaps before its matches, their lengths and whether they count.

    The pieces between the matches are what splitting by the same pattern leaves, and
    texts without a match are not split.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), content.alias("text"))
    found = rows.select("*", *[F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias(f"m_{k.name}") for k in KINDS])

    def measured(kind: Kind) -> Column:
        m = F.col(f"m_{kind.name}")
        pairs = F.zip_with(
            F.slice(F.split("text", kind.pattern, -1), F.lit(1), F.size(m)), m,
            lambda piece, match: F.struct(
                F.length(piece).alias("gap"), F.length(match).alias("len"), _kept(kind, match).alias("kept")
            ),
        )
        return F.when(F.size(m) > 0, pairs).alias(kind.name)

    return found.select("row", "doc_id", *[measured(k) for k in KINDS])


def parts(found: DataFrame) -> DataFrame:
    """``row``, ``no`` (of the kind), ``start`` and ``end`` in code points of the matches that count."""
    every = None
    for no, kind in enumerate(KINDS):
        one = found.where(F.col(kind.name).isNotNull()).select(
            "row", F.lit(no).alias("no"), F.posexplode(kind.name).alias("at", "m")
        )
        every = one if every is None else every.unionByName(one)
    upto = Window.partitionBy("row", "no").orderBy("at")
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(upto)
    return every.select("row", "no", "m.kept", (end - F.col("m.len")).alias("start"), end.alias("end")).where("kept").drop("kept")


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The parts to report: base ones, and weak ones with their complement in reach.

    A weak identifier needs a secret within ``reach`` code points of the same text, a weak secret an
    identifier, an endpoint one of each.  A weak part that overlaps a base one says nothing
    new.  The interval join is a sweep: sorted by start, the nearest end before and the
    nearest start after of each role decide, so no pairs are made.
    """
    base = F.array_contains(F.lit([i for i, k in enumerate(KINDS) if k.base]), F.col("no"))

    def is_role(role: str) -> Column:
        return F.array_contains(F.lit([i for i, k in enumerate(KINDS) if k.role == role]), F.col("no"))

    order = [F.col("start"), F.col("no"), F.col("end")]
    past = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    next_ = Window.partitionBy("row").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    marks = {r: is_role(r) for r in ROLES} | {"base": base}
    near = found.withColumns({
        **{f"{r}_end": F.max(F.when(c, F.col("end"))).over(past) for r, c in marks.items()},
        **{f"{r}_start": F.min(F.when(c, F.col("start"))).over(next_) for r, c in marks.items()},
    })

    def close(role: str) -> Column:
        return F.coalesce(F.col("start") - F.col(f"{role}_end") <= reach, F.lit(False)) | F.coalesce(
            F.col(f"{role}_start") - F.col("end") <= reach, F.lit(False)
        )

    covered = F.coalesce(F.col("base_end") > F.col("start"), F.lit(False)) | F.coalesce(
        F.col("base_start") < F.col("end"), F.lit(False)
    )
    complete = (
        (is_role("identifier") & close("secret")) | (is_role("secret") & close("identifier"))
        | (is_role("endpoint") & close("secret") & close("identifier"))
    )
    return near.where(base | (complete & ~covered)).select("row", "no", "start", "end", base.alias("base"))


def scan_secrets(docs: DataFrame, reach: int = REACH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans`` of each row.

    A span is ``kind:start:end`` in code points, end exclusive; spans go by start, then kind,
    joined by commas.  ``base_sha256`` is the SHA-256 of the base spans alone.  Null and
    empty texts have no spans; repeated rows get a row each; an empty table gives no rows;
    other columns are not read.

    Each row is written with the lengths of its matches before positions are summed up, so
    the numbers given to rows stay.  From then on only rows with matches are shuffled.
    """
    found = write_once(matches(docs, key, text))
    reported = linked(parts(found), reach)
    label = F.concat_ws(":", F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("no") + 1), F.col("start"), F.col("end"))
    item = F.struct("start", "no", label.alias("label"))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(items), lambda s: s["label"]), ",")

    by_row = reported.groupBy("row").agg(
        *[F.count_if(F.col("no") == i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base],
        F.collect_list(F.when(F.col("base"), item)).alias("base_items"), F.collect_list(item).alias("items"),
    ).select(
        "row", "n_assign", "n_access", "n_hex",
        joined(F.col("base_items")).alias("base_spans"), joined(F.col("items")).alias("spans"),
    )
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return found.select("row", "doc_id").join(by_row, "row", "left").select(
        "doc_id", *counts, F.sha2(F.coalesce("base_spans", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


#: The same rows in DuckDB, with patterns, roles and reach written out.
SECRETS_SQL = r"""
WITH k(no, name, pattern) AS (VALUES
  (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 'AKIA[A-Z0-9]{12,}'),
  (2, 'hex', '[0-9a-f]{32,}'),
  (3, 'ident', '([cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][oO][uU][nN][tT]_?[iI][dD]|[kK][eE][yY]_?[iI][dD]|[uU][sS][eE][rR]_?[nN][aA][mM][eE]|[lL][oO][gG][iI][nN])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.@-]{3,}'),
  (4, 'value', '[A-Za-z0-9+/_=-]{20,}'),
  (5, 'endpoint', 'https?://[A-Za-z0-9./:_-]{4,}')
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), f AS (
  SELECT r, 0 AS no, regexp_extract_all(text, (SELECT pattern FROM k WHERE no = 0)) AS m, string_split_regex(text, (SELECT pattern FROM k WHERE no = 0)) AS p FROM d
  UNION ALL SELECT r, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]{12,}'), string_split_regex(text, 'AKIA[A-Z0-9]{12,}') FROM d
  UNION ALL SELECT r, 2, regexp_extract_all(text, '[0-9a-f]{32,}'), string_split_regex(text, '[0-9a-f]{32,}') FROM d
  UNION ALL SELECT r, 3, regexp_extract_all(text, (SELECT pattern FROM k WHERE no = 3)), string_split_regex(text, (SELECT pattern FROM k WHERE no = 3)) FROM d
  UNION ALL SELECT r, 4, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), string_split_regex(text, '[A-Za-z0-9+/_=-]{20,}') FROM d
  UNION ALL SELECT r, 5, regexp_extract_all(text, 'https?://[A-Za-z0-9./:_-]{4,}'), string_split_regex(text, 'https?://[A-Za-z0-9./:_-]{4,}') FROM d
), e AS (
  SELECT r, no, i, m[i] AS match, length(p[i]) AS gap, length(m[i]) AS len FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)
), s AS (
  SELECT r, no, match, sum(gap + len) OVER (PARTITION BY r, no ORDER BY i)::BIGINT AS "end", len FROM e
), x AS (
  SELECT r, no, "end" - len AS start, "end", no < 3 AS base, CASE WHEN no IN (1, 3) THEN 'i' WHEN no = 5 THEN 'e' ELSE 's' END AS role FROM s
  WHERE CASE WHEN no = 0 THEN length(regexp_extract(match, (SELECT pattern FROM k WHERE no = 0), 2)) >= 8
             WHEN no = 4 THEN regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]') ELSE true END
), y AS (
  SELECT a.* FROM x a WHERE a.base OR (
    NOT EXISTS (SELECT 1 FROM x b WHERE b.r = a.r AND b.base AND b.start < a."end" AND b."end" > a.start)
    AND CASE a.role
      WHEN 'i' THEN EXISTS (SELECT 1 FROM x b WHERE b.r = a.r AND b.role = 's' AND b.start - a."end" <= 200 AND a.start - b."end" <= 200)
      WHEN 's' THEN EXISTS (SELECT 1 FROM x b WHERE b.r = a.r AND b.role = 'i' AND b.start - a."end" <= 200 AND a.start - b."end" <= 200)
      ELSE EXISTS (SELECT 1 FROM x b WHERE b.r = a.r AND b.role = 's' AND b.start - a."end" <= 200 AND a.start - b."end" <= 200)
       AND EXISTS (SELECT 1 FROM x b WHERE b.r = a.r AND b.role = 'i' AND b.start - a."end" <= 200 AND a.start - b."end" <= 200) END)
), g AS (
  SELECT r, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
    string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, no) FILTER (base) AS base_spans,
    string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, no) AS spans
  FROM y JOIN k USING (no) GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
