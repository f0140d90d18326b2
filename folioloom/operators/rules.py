"""Rule tables over normalised text: each table becomes Columns, or the SQL that says the same.

A text is matched as its words, bars and question marks in lower case between single
spaces, so a term hits whole words only, and a term of several words hits a phrase.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Holds if one of `any` and all of `all` hit, one of `required` too if there are some, and none of `blocked`."""

    name: str
    any: tuple[str, ...] = ()
    all: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    blocked: tuple[str, ...] = ()
    adds: tuple[str, ...] = ()
    weight: float = 0.0


def spaced(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([|?])", " $1 "), r"[^\p{L}\p{N}|?]+", " ")), F.lit(" "))


def spaced_sql(text: str) -> str:
    return rf"(' ' || trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '([|?])', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}|?]+', ' ', 'g')) || ' ')"


def _one(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(f" {t} ")) for t in terms))


def _each(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.contains(text, F.lit(f" {t} ")) for t in terms))


def holds(rule: Rule, text: Column) -> Column:
    tests = [_one(text, rule.any)] if rule.any else []
    tests += [_each(text, rule.all)] if rule.all else []
    tests += [_one(text, rule.required)] if rule.required else []
    tests += [~_one(text, rule.blocked)] if rule.blocked else []
    return reduce(lambda a, b: a & b, tests)


def holds_sql(rule: Rule, text: str) -> str:
    def joined(terms: tuple[str, ...], word: str) -> str:
        return "(" + f" {word} ".join(f"contains({text}, ' {t} ')" for t in terms) + ")"

    tests = [joined(rule.any, "OR")] if rule.any else []
    tests += [joined(rule.all, "AND")] if rule.all else []
    tests += [joined(rule.required, "OR")] if rule.required else []
    tests += ["NOT " + joined(rule.blocked, "OR")] if rule.blocked else []
    return "(" + " AND ".join(tests) + ")"


def first(rules: list[Rule], text: Column, other: str | None = None) -> Column:
    """The name of the first rule that holds."""
    found = [F.when(holds(r, text), F.lit(r.name)) for r in rules]
    return F.coalesce(*found, *([F.lit(other)] if other is not None else []))


def first_sql(rules: list[Rule], text: str, other: str | None = None) -> str:
    return "CASE " + " ".join(f"WHEN {holds_sql(r, text)} THEN '{r.name}'" for r in rules) + (f" ELSE '{other}'" if other is not None else "") + " END"


def added(rules: list[Rule], text: Column) -> Column:
    """What the rules that hold add, in rule order, each once."""
    lists = (F.when(holds(r, text), F.array(*(F.lit(x) for x in r.adds))).otherwise(F.array().cast("array<string>")) for r in rules)
    return F.array_distinct(F.concat(*lists))


def added_sql(rules: list[Rule], text: str) -> str:
    """The same list with repeats; `kept` drops them."""
    parts = [f"CASE WHEN {holds_sql(r, text)} THEN [" + ", ".join(f"'{x}'" for x in r.adds) + "] ELSE [] END" for r in rules]
    return "list_concat(" * (len(parts) - 1) + parts[0] + "".join(f", {p})" for p in parts[1:])


def scored(deltas: list[tuple[str, Column, Column]]) -> tuple[Column, Column]:
    """From (name, condition, change) in order: the sum of changes that apply, and their names."""
    total = reduce(lambda a, b: a + b, (F.when(c, v).otherwise(F.lit(0.0)) for _, c, v in deltas))
    return total, F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c, _ in deltas)))


def scored_sql(deltas: list[tuple[str, str, str]]) -> tuple[str, str]:
    total = " + ".join(f"CASE WHEN {c} THEN ({v})::DOUBLE ELSE 0::DOUBLE END" for _, c, v in deltas)
    return f"({total})", "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in deltas) + "], lambda x: x IS NOT NULL)"


# Ordered decisions: rows of (condition, outcome, reason), the first that holds wins. Conditions are SQL on columns
# of the row; matches(column, 'pattern') is put in each engine's own way.


#: Java takes a repeated group that may give back one call deeper each time, which on a long text ends the thread's stack and, as that is
#: fatal, the executor. Here is the same said for it without giving back: what it would give back can't match otherwise.
FOR_JAVA = {"^([A-Z][^ ]*( |$))+$": r"^(?:[A-Z][^ ]*+(?: |\z))++\z"}


def in_spark(condition: str) -> str:
    return re.sub(r"matches\((\w+), '([^']*)'\)", lambda m: f"regexp_like({m[1]}, r'{FOR_JAVA.get(m[2], m[2])}')", condition)


def in_duckdb(condition: str) -> str:
    return re.sub(r"matches\((\w+), '([^']*)'\)", r"regexp_matches(\1, '\2')", condition)


def flag(condition: str) -> Column:
    """The condition, false where unknown."""
    return F.coalesce(F.expr(in_spark(condition)), F.lit(False))


def flag_sql(condition: str) -> str:
    return f"coalesce({in_duckdb(condition)}, false)"


def decided(rows: list[tuple[str, str, str]], other: tuple[str, str], outcome: str = "bucket", reason: str = "reason") -> Column:
    """A struct of outcome and reason."""
    made = lambda a, b: F.struct(F.lit(a).alias(outcome), F.lit(b).alias(reason))
    return F.coalesce(*(F.when(flag(c), made(a, b)) for c, a, b in rows), made(*other))


def decided_sql(rows: list[tuple[str, str, str]], other: tuple[str, str], part: int) -> str:
    """The outcome (0) or the reason (1)."""
    return "CASE " + " ".join(f"WHEN {flag_sql(c)} THEN '{(a, b)[part]}'" for c, a, b in rows) + f" ELSE '{other[part]}' END"


def named(rows: list[tuple[str, str]]) -> Column:
    """The names of all conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(flag(c), F.lit(n)) for n, c in rows)))


def named_sql(rows: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {flag_sql(c)} THEN '{n}' END" for n, c in rows) + "], lambda x: x IS NOT NULL)"
