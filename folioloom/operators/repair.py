"""Repair of nested steps by rules that log what they change, applied until nothing changes.

A rule rewrites one slot of every step, or of the service itself. It is written once, as
an expression over slots in braces that both Spark and the SQL the tests compare with
can read; `Dialect` renders what the two say differently. A service's steps stay one
array, so a pass shuffles nothing. Services that a pass has not changed are done; only
the others go through the next one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.operators.step_rows import HEADER_CRUMBS, ROLE, UNIT
from folioloom.sources.shared import ensure_checkpoints

SLOTS = ("client", "agency", "fee", "time", "person")
LOG = "array<struct<rule: string, slot: string, step: int, before: string, after: string>>"


class Dialect:
    """How Spark says it."""

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{to}')"

    def group(self, x: str, pattern: str, n: int) -> str:
        return f"regexp_extract({x}, r'{pattern}', {n})"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE r'{pattern}')"


class Duck(Dialect):
    """How the SQL of the tests says it."""

    def replace(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{re.sub(r'[$]([0-9])', lambda m: chr(92) + m[1], to)}', 'g')"

    def group(self, x: str, pattern: str, n: int) -> str:
        return f"regexp_extract({x}, '{pattern}', {n})"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"


_SPAN = rf"[0-9]+(?:\.[0-9]+)?(?:\s*-\s*[0-9]+)?\s*{UNIT}"
_MIXED = rf"(?i)^({_SPAN})\s+([A-Za-z][A-Za-z0-9_/]*(?:\s+[A-Za-z][A-Za-z0-9_/]*){{0,5}})$"
_INSIDE = rf"(?i)({_SPAN})"
PAGE = r"(?i)^(?:page\s*[0-9]{1,4}|[0-9]{1,3})$"


def crumbless(x: str, d: Dialect) -> str:
    """Without words of the table's header; spaces are doubled so that neighbours share none."""
    bare = d.replace(f"(' ' || replace({x}, ' ', '  ') || ' ')", f"(?i)\\s(?:{'|'.join(HEADER_CRUMBS)})\\s", " ")
    return f"trim({d.replace(d.replace(bare, r'\s+', ' '), r'^[\s/|:–—-]+|[\s|:–—-]+$', '')})"


def _with_head(d: Dialect) -> str:
    head = d.group("{time}", _MIXED, 2)
    goes_on = d.like("{person}", f"(?i)^(?:{ROLE})\\b")
    return f"CASE WHEN NOT {d.like('{time}', _MIXED)} OR {d.like(head, f'(?i)^{UNIT}$')} OR contains(lower({{person}}), lower({head})) THEN {{person}} WHEN {{person}} = '' THEN {head} WHEN {goes_on} THEN {head} || ' ' || {{person}} ELSE {head} || '/' || {{person}} END"


@dataclass(frozen=True)
class Rule:
    """What the slot becomes; `body` makes the expression for a dialect. A rule that looks on may read {next}, the person of the next step."""

    name: str
    slot: str
    body: Callable[[Dialect], str]
    looks_on: bool = False

    def sql(self, d: Dialect, names: dict[str, str]) -> str:
        return re.sub(r"\{([a-z]+)\}", lambda m: names[m[1]], self.body(d))


#: In this order, each on what those before it have left; rules that look on come last.
STEP_RULES = [
    Rule("header_words", "fee", lambda d: crumbless("{fee}", d)),
    Rule("header_words", "time", lambda d: crumbless("{time}", d)),
    Rule("header_words", "person", lambda d: crumbless("{person}", d)),
    Rule("page_number", "fee", lambda d: f"CASE WHEN {d.like('{fee}', PAGE)} THEN '' ELSE {{fee}} END"),
    Rule("free", "fee", lambda d: "CASE WHEN lower({fee}) IN ('n/a', 'na', 'n / a', 'none', 'free', 'nil', 'no fee', 'no fees', '-') THEN 'None' ELSE {fee} END"),
    Rule("title_in_time", "person", _with_head),
    Rule("title_in_time", "time", lambda d: f"CASE WHEN {d.like('{time}', _MIXED)} AND NOT {d.like(d.group('{time}', _MIXED, 2), f'(?i)^{UNIT}$')} THEN {d.group('{time}', _MIXED, 1)} ELSE {{time}} END"),
    Rule("time_in_person", "time", lambda d: f"CASE WHEN {{time}} = '' THEN {d.group('{person}', _INSIDE, 1)} ELSE {{time}} END"),
    Rule("time_in_person", "person", lambda d: f"CASE WHEN {d.group('{person}', _INSIDE, 1)} <> '' AND {d.group('{person}', _INSIDE, 1)} = {{time}} THEN trim({d.replace('{person}', _INSIDE, ' ')}) ELSE {{person}} END"),
    Rule("slashes", "person", lambda d: d.replace(d.replace("{person}", r"\s*/\s*", "/"), "/{2,}", "/")),
    Rule("step_number", "client", lambda d: d.replace("{client}", r"^[0-9]{1,3}[.)]\s+", "")),
    Rule("cut_person", "person", lambda d: "CASE WHEN {person} LIKE '%/' AND {next} <> '' AND {next} NOT LIKE '%/' THEN CASE WHEN contains(lower({person}), lower({next})) THEN left({person}, length({person}) - 1) WHEN left(lower({next}), length({person})) = lower({person}) THEN {next} ELSE {person} || {next} END ELSE {person} END", looks_on=True),
]


def complete(s: str) -> str:
    """Every slot of the step is filled, and the person is not cut off."""
    return f"({' AND '.join(f'{s}{x} <> {chr(39) * 2}' for x in SLOTS)} AND {s}person NOT LIKE '%/')"


def one_pass(services: DataFrame) -> DataFrame:
    """Adds `changes`, the log of one pass, and rewrites steps (array of structs of SLOTS), total_time and total_fee.

    Logged are first the changes of each step by itself, step by step, then what steps take from the next one, then the totals.
    While rules are applied each slot is an array of its own, so a rule makes strings of one slot and copies no step.
    """
    at = {x: f"_{x}" for x in SLOTS}
    out = services.withColumns({c: F.col(f"steps.{x}") for x, c in at.items()})
    logs = []
    for rules in ([r for r in STEP_RULES if not r.looks_on], [r for r in STEP_RULES if r.looks_on]):
        entries, person = [], at["person"]
        for rule in rules:
            before, after = at[rule.slot], f"_{len(out.columns)}_{rule.slot}"
            names = {x: f"get({c}, i)" for x, c in at.items()} | {rule.slot: "x", "next": f"coalesce(get({person}, i + 1), '')"}
            out = out.withColumn(after, F.expr(f"transform({before}, (x, i) -> {rule.sql(Dialect(), names)})"))
            entries.append(f"if(get({before}, i) <> get({after}, i), named_struct('rule', '{rule.name}', 'slot', '{rule.slot}', 'step', i, 'before', get({before}, i), 'after', get({after}, i)), null)")
            at[rule.slot] = after
        logs.append(f"cast(flatten(transform(_client, (x, i) -> array_compact(array({', '.join(entries)})))) as {LOG})")
    steps = ", ".join(f"'{x}', get({c}, i)" for x, c in at.items())
    out = out.withColumns({"changes": F.expr(f"concat({', '.join(logs)})"), "steps": F.expr(f"transform(_client, (x, i) -> named_struct({steps}))")}).select(*services.columns, "changes")
    minutes = F.expr("transform(steps, s -> try_cast(regexp_extract(s.time, r'(?i)^([0-9]+) *(?:minutes?|mins?)$', 1) as long))")
    summed = F.expr("aggregate(minutes, 0L, (a, x) -> a + x)")
    out = out.withColumn("minutes", minutes).withColumn("got", F.when((F.col("total_time") == "") & (F.size("steps") > 0) & (summed > 0), F.concat(summed.cast("string"), F.when(summed == 1, F.lit(" minute")).otherwise(F.lit(" minutes")))).otherwise(F.col("total_time")))
    out = out.withColumn("free", F.when((F.col("total_fee") == "") & (F.size("steps") > 0) & F.forall("steps", lambda s: s["fee"] == "None"), F.lit("None")).otherwise(F.col("total_fee")))
    for slot, new in (("total_time", "got"), ("total_fee", "free")):
        entry = F.array(F.struct(F.lit("total_of_steps").alias("rule"), F.lit(slot).alias("slot"), F.lit(None).cast("int").alias("step"), F.col(slot).alias("before"), F.col(new).alias("after")))
        out = out.withColumn("changes", F.concat("changes", F.when(F.col(slot) != F.col(new), entry).otherwise(F.array()).cast(LOG))).withColumn(slot, F.col(new))
    return out.drop("got", "free", "minutes")


def repaired(services: DataFrame, most: int = 20) -> DataFrame:
    """services: any columns besides steps, total_time and total_fee. Adds `log`, all changes in order, and `passes`, how many passes changed something.

    Passes are written to the checkpoint folder two by two, since they decide who goes
    on: the first changes nearly all, so by itself it would be written for nothing. Rules
    only shorten, move or fill slots, so the passes come to an end; if `most` of them
    don't, that is an error in the rules.
    """
    ensure_checkpoints(services.sparkSession)
    todo, done = services.withColumn("log", F.array().cast(LOG)).withColumn("passes", F.lit(0)), None
    for turn in range(0, most, 2):
        for last in ((False, True) if turn + 1 < most else (True,)):
            after = one_pass(todo)
            after = after.checkpoint() if last else after
            settled = after.where("size(changes) = 0").drop("changes") if last else None
            todo = after.where("size(changes) > 0") if last else after
            todo = todo.select(*(c for c in services.columns), F.concat("log", "changes").alias("log"), (F.col("passes") + F.when(F.size("changes") > 0, 1).otherwise(0)).alias("passes"))
        done = settled if done is None else done.unionByName(settled)
        if todo.isEmpty():
            return done
    raise ValueError(f"rules still change something after {most} passes")
