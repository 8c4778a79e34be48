"""Path-string cleaning, all as native Column expressions (codegen, no Python UDF).

A clickstream path looks like ``->step one//level->step two->...``; the
cleaning keeps the first non-empty step, turns level separators into ``|``,
keeps the last ``|``-pair and strips leading non-letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns and separators must equal the reference's for
# identical results.
STEP_SEPARATOR = "->"
SEPARATOR_REWRITES = (("//", "|"), ("/", "|"), ("| |", "|"), ("||", "|"))
LAST_PIPE_PAIR = r"([\s\p{P}\w<>=+]*\|?[\s\p{P}\w<>=+]+$)"
PAGE_NAME_TAIL = r"([\s\p{P}\w<>=]*\|?[\s\p{P}\w]+$)"
LEADING_NON_LETTERS = r"^[^a-zA-Z]*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_path_step(c: Column | str) -> Column:
    """First non-empty ``->`` step, ``""`` when there is none; null stays null."""
    c = _col(c)
    steps = F.filter(F.split(c, STEP_SEPARATOR), lambda s: s != F.lit(""))
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(F.get(steps, 0), F.lit("")))


def normalize_separators(c: Column | str) -> Column:
    """Single left-to-right passes: ``//``, ``/``, ``| |``, ``||`` each become ``|``."""
    out = _col(c)
    for search, repl in SEPARATOR_REWRITES:
        out = F.replace(out, F.lit(search), F.lit(repl))
    return out


# Character classes of the two patterns above (head part, tail part).
_PAIR_HEAD = _PAIR_TAIL = r"[\s\p{P}\w<>=+]"
_PAGE_HEAD, _PAGE_TAIL = r"[\s\p{P}\w<>=]", r"[\s\p{P}\w]"
# Line terminators outside both classes; Java's ``$`` also matches before one of them at the end.
_FINAL_TERMINATOR = "[\u0085\u2028\u2029]\\z"


def _trailing_match(c: Column, head: str, tail: str) -> Column:
    """Same result as ``regexp_extract(c, '(head*\\|?tail+$)', 1)``, in linear time.

    That pattern is searched from every start position with backtracking
    (super-linear in the string length).  Its match always runs to the end,
    so it is the longest suffix of the form ``head* |? tail+``: reversed, the
    longest prefix ``tail+ |? head*``, which an anchored greedy match finds in
    one pass.
    """
    core = F.regexp_replace(c, _FINAL_TERMINATOR, "")
    return F.reverse(F.regexp_extract(F.reverse(core), f"^({tail}+\\|?{head}*)", 1))


def last_pipe_pair(c: Column | str) -> Column:
    """Trailing ``a|b`` pair (``a|b|c|d`` -> ``c|d``); ``""`` when nothing matches.

    Equal to ``regexp_extract(c, LAST_PIPE_PAIR, 1)``.
    """
    return _trailing_match(_col(c), _PAIR_HEAD, _PAIR_TAIL)


def page_name_tail(c: Column | str) -> Column:
    """The landing-page variant of :func:`last_pipe_pair` (narrower classes).

    Equal to ``regexp_extract(c, PAGE_NAME_TAIL, 1)``.
    """
    return _trailing_match(_col(c), _PAGE_HEAD, _PAGE_TAIL)


def strip_leading_non_letters(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), LEADING_NON_LETTERS, "")


def clean_path(c: Column | str) -> Column:
    """First step, normalised, last pipe pair, leading non-letters removed."""
    return strip_leading_non_letters(last_pipe_pair(normalize_separators(first_path_step(c))))


def to_double(c: Column | str) -> Column:
    """Null on a bad value instead of an error, as casts behaved before ANSI mode."""
    return _col(c).try_cast("double")
