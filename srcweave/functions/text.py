"""Text predicates shared by the rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(column: Column, words: Sequence[str]) -> Column:
    """The text contains one of a fixed list of words."""
    if not words:
        return F.lit(False)
    expr = F.contains(column, F.lit(words[0]))
    for word in words[1:]:
        expr = expr | F.contains(column, F.lit(word))
    return expr


def source_pattern(sources: Sequence[str], openers: str) -> str:
    """Regex whose group 1 is the first listed source that starts a text.

    A source counts when the text ends there or goes on with one of ``openers``.
    """
    names = "|".join(re.escape(s) for s in sources)
    follow = "".join("\\" + c for c in openers)
    return rf"^({names})(?=$|[{follow}])"


def matched_source(text: Column, pattern: str) -> Column:
    """The taint source a text starts with, or null."""
    return F.nullif(F.regexp_extract(F.trim(text), pattern, 1), F.lit(""))


def ends_with_member(text: Column, names: Sequence[str], bare: bool = True) -> Column:
    """A callee text is one of the names, or a member access ending in one."""
    expr = F.lit(False)
    for name in names:
        expr = expr | F.endswith(text, F.lit("." + name))
    return expr | text.isin(*names) if bare else expr


def secret_name(name: Column) -> Column:
    return F.rlike(name, F.lit(SECRET_NAME))


# Fixed values ---------------------------------------------------------------
SECRET_NAME = (
    r"(?i)\b(password|passwd|secret|api_key|apikey|token|auth_token"
    r"|private_key|access_key|secret_key)\b"
)
SECRET_PLACEHOLDER = r"""^['"](<.*?>|\*+|x+|\.\.\.|\$\{.*?\})['"]$"""
SECRET_MIN_CHARS = 5
ENV_LOOKUPS = ("os.environ", "os.getenv")
# ---------------------------------------------------------------------------


def is_secret_value(value: Column) -> Column:
    """A quoted literal long enough and no placeholder or environment lookup."""
    return (
        (F.length(value) >= SECRET_MIN_CHARS)
        & ~any_of(value, ENV_LOOKUPS)
        & ~F.rlike(value, F.lit(SECRET_PLACEHOLDER))
    )
