"""Regular expressions that mean the same on every engine and for every script."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An ASCII word boundary: Java's own looks at letters of all scripts, so that an accented neighbour would count as part of the word.
BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_words(pattern: str) -> str:
    return pattern.replace(r"\b", BOUNDARY)


def found(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """True where the pattern occurs, false elsewhere, null texts included."""
    return F.coalesce(text.rlike(("(?i)" if ignore_case else "") + ascii_words(pattern)), F.lit(False))


def either(*patterns: str) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def first_label(text: Column, rules: list[tuple[str, str]], otherwise: str | None) -> Column:
    """The label of the first rule whose pattern occurs."""
    return reduce(lambda chain, rule: chain.when(found(text, rule[0]), rule[1]), rules[1:], F.when(found(text, rules[0][0]), rules[0][1])).otherwise(F.lit(otherwise))


def sql_found(text: str, pattern: str) -> str:
    """The same test in SQL, whose boundaries are ASCII already."""
    return f"regexp_matches(coalesce({text}, ''), '{pattern.replace(chr(39), chr(39) * 2)}', 'i')"


def sql_first_label(text: str, rules: list[tuple[str, str]], otherwise: str | None) -> str:
    whens = " ".join(f"WHEN {sql_found(text, p)} THEN '{label}'" for p, label in rules)
    return f"CASE {whens} ELSE {'NULL' if otherwise is None else repr(otherwise)} END"
