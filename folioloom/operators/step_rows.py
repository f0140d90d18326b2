"""Logical rows of five-column service tables (client step, agency action, fee, time, person) from visual rows.

Whether a visual row begins a step depends on what the step before it has become, so
a table's rows pass in order through a chain of passes, each of which holds one row.
A pass is an ordered list of rules: the first whose condition holds for the held row
and the one that comes says what becomes of it. Spark deals tables out, sorts and
numbers their rows; a task reads them as one stream, in which number 1 begins a table,
and its state is a few rows, however long a table is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.operators import layout

CLIENT, AGENCY, FEE, TIME, PERSON = range(5)
REVIEW = "Needs Review"
KEPT = 4096  # cells whose answers a task remembers, for each question

# What ends an open cell, what titles and header words are.
OPEN_WORDS = "the of and or for to by with a an from into"
OPEN_CLIENT = "certificate"
OPEN_VERBS = "validated filled accomplished signed completed issued required submitted accepted rendered evaluated"
TITLES = "Director Chairperson Chair Dean Associate Associate_Dean Program Program_Head Program_Chair Program_Chairperson Staff Registrar Cashier Librarian Counselor Officer Secretary Records"
HEADER_CELLS = {
    "be", "time", "responsible", "paid", "fees", "processing", "client step", "client steps", "agency action", "agency actions", "person responsible",
    "checklist of requirements", "where to secure", "processing time", "fees to be paid",
}
HEADER_CRUMBS = [
    r"fees?\s+to\s+be\s+paid", r"fees?\s+to\s+be", r"fees?\s+to", r"to\s+be\s+paid", r"be\s+paid", r"processing\s+time", "processing", r"person\s+responsible", r"responsible\s+personnel", "responsible",
    r"client\s+steps?", r"agency\s+actions?", "fees?", "time", "person", "be", "paid",
]
FREE = {"none", "n/a", "na", "nil", "free", "no fee", "no fees", "-", "—", "–"}
UNIT = r"(?:minutes?|mins?|hours?|hrs?|days?|seconds?)"
TIME_ATOM = rf"(?:\d+\s+and\s+(?:1/2|½)|\d+(?:\.\d+)?(?:\s*[-–—]\s*\d+(?:\.\d+)?)?)\s*{UNIT}(?:\s+and\s+\d+(?:\.\d+)?\s*{UNIT})?"
ROLE = "officer|staff|director|chairperson|dean|head|faculty"

_title = "|".join(sorted((t.replace("_", r"\s+") for t in TITLES.split()), key=len, reverse=True))
_TITLES = re.compile(rf"(?:{_title})(?:[\s/,]*(?:{_title}))*", re.I)
_MARKER = re.compile(r"\d{1,3}[.)]\s+\S|[•●▪◦‣]\s*\S|[-–—]\s+\S")
_NUMBER = re.compile(r"\d{1,3}[.)]\s+")
_DANGLING = re.compile(rf"\b(?:{'|'.join(OPEN_WORDS.split())})$", re.I)
_OPEN_CLIENT = re.compile(rf"\b(?:{'|'.join([*OPEN_WORDS.split(), OPEN_CLIENT, *OPEN_VERBS.split()])}|filled\s+out)$", re.I)
_NOUN = re.compile(r"[A-Za-z][\w'-]{0,24}\.?")
_NOISE = re.compile(r"(?:clientele|clients?)", re.I)
_PAGE = re.compile(r"page\s*\d{1,4}|\d{1,3}", re.I)
_CRUMBS = [re.compile(rf"(?:^|\s){p}(?=\s|$)", re.I) for p in HEADER_CRUMBS]
_CRUMB = re.compile(rf"(?:^|\s)(?:{'|'.join(HEADER_CRUMBS)})(?=\s|$)", re.I)
_ATOM = re.compile(TIME_ATOM, re.I)
_SPAN = rf"\d+(?:\.\d+)?\s*{UNIT}"
_PERSON_TIME = re.compile(rf"([A-Za-z][\w/]*(?:\s+[A-Za-z][\w/]*){{0,2}})\s+({_SPAN})", re.I)
_TIME_PERSON = re.compile(rf"({_SPAN})\s+([A-Za-z][\w/]*(?:\s+[A-Za-z][\w/]*){{0,3}})", re.I)
_UNIT = re.compile(UNIT, re.I)
_ROLE = re.compile(rf"(?:{ROLE})\b", re.I)


def spaced(text: str | None) -> str:
    return " ".join(text.split()) if text else ""


@lru_cache(KEPT)
def marked(text: str) -> bool:
    """Begins with a step number or a bullet."""
    return bool(_MARKER.match(text))


def noise(text: str) -> bool:
    return 6 <= len(text) <= 9 and bool(_NOISE.fullmatch(text))


@lru_cache(KEPT)
def titles(text: str) -> bool:
    """Nothing but titles of personnel."""
    return bool(_TITLES.fullmatch(text.rstrip("/").strip()))


@lru_cache(KEPT)
def page_number(text: str) -> bool:
    return bool(_PAGE.fullmatch(text))


def short_noun(text: str, before: str) -> bool:
    """One word that ends an unfinished cell, such as `ID.`"""
    return bool(text and before) and not before.endswith(".") and not marked(text) and len(text.split()) == 1 and (text[0].islower() or bool(_NOUN.fullmatch(text)))


def wraps(text: str, before: str) -> bool:
    """Goes on with the cell before it instead of beginning a step."""
    if not text or not before or marked(text):
        return not text
    return text[0].islower() or before.endswith(("-", ",")) or bool(_DANGLING.search(before)) or short_noun(text, before)


@lru_cache(KEPT)
def unfinished(client: str) -> bool:
    if client.endswith("."):
        return False
    return not client or client.endswith(("-", ",", "/")) or bool(_OPEN_CLIENT.search(client)) or len(client.split()) <= 2


@lru_cache(KEPT)
def with_person(before: str, more: str) -> str:
    """Titles joined by a slash, without noise and without saying one twice."""
    a, b = (re.sub("/{2,}", "/", re.sub(r"(?i)(?:^|/)\s*clientele\s*(?=/|$)", "/", spaced(x).strip("/ ")).strip("/ ")) for x in (before, more))
    a, b = ("" if noise(x) else x for x in (a, b))
    return a if not b or b.casefold() in a.casefold() else f"{a}/{b}" if a else b


def header_row(cells: list[str]) -> bool:
    """Holds nothing but words of the header."""
    for c in cells:
        if c and c.casefold() not in HEADER_CELLS:
            return False
    return True


class Row:
    """The cells of a row, five at least; they are changed by `put` only, since which are filled is asked by most rules."""

    __slots__ = ("_filled", "cells")

    def __init__(self, cells: list[str | None]):
        self.cells = [spaced(c) for c in cells]
        if len(cells) < 5:
            self.cells += [""] * (5 - len(cells))
        self._filled = None

    def __getitem__(self, at: int) -> str:
        return self.cells[at]

    def put(self, at: int, text: str) -> None:
        self.cells[at], self._filled = text, None

    @property
    def filled(self) -> list[int]:
        if self._filled is None:
            self._filled = [i for i, c in enumerate(self.cells) if c]
        return self._filled

    @property
    def told(self) -> bool:
        """Has a fee, time or person that is not a page number."""
        for c in self.cells[FEE:]:
            if c and not page_number(c):
                return True
        return False

    @property
    def whole(self) -> bool:
        return bool(self[AGENCY]) and self.told

    def only(self, at: int) -> bool:
        return self.filled == [at]

    def append(self, at: int, more: str) -> None:
        if more:
            self.put(at, with_person(self[at], more) if at == PERSON else f"{self[at]} {more}".strip())

    def fill(self, at: int, more: str) -> None:
        if more and not self[at]:
            self.put(at, more)


Rule = tuple[Callable[[Row, Row], bool], Callable[[Row, Row], object]]


def _all_appended(held: Row, row: Row) -> None:
    """Cell by cell; a page number gives way to a real fee, time or person."""
    held.cells += [""] * (len(row.cells) - len(held.cells))
    for at in row.filled:
        if at >= FEE and page_number(held[at]):
            held.put(at, row[at])
        else:
            held.put(at, f"{held[at]} {row[at]}".strip())


def _client_goes_on(held: Row, row: Row) -> None:
    held.append(CLIENT, row[CLIENT])
    held.append(AGENCY, row[AGENCY])
    held.fill(FEE, row[FEE])
    held.fill(TIME, row[TIME])
    held.append(PERSON, row[PERSON])


def _one_cell_goes_on(held: Row, row: Row) -> None:
    at = row.filled[0]
    if at == TIME and _ATOM.search(row[at]):
        held.put(at, row[at])
    else:
        held.append(at, row[at])


def _crumb(row: Row) -> str:
    return next((c for c in row.cells[:5] if c and titles(c)), "")


def _attached(client: str, held: Row) -> bool:
    return wraps(client, held[CLIENT]) or unfinished(held[CLIENT])


def _drop(held: Row, row: Row) -> None:
    pass


#: Crumbs of single columns join the step before by their column.
BY_COLUMN: list[Rule] = [
    (lambda h, r: len(r.filled) <= 2 and bool(_crumb(r)) and (not r[CLIENT] or titles(r[CLIENT])), lambda h, r: h.append(PERSON, _crumb(r))),
    (lambda h, r: r.only(CLIENT) and (not h[AGENCY] or _attached(r[CLIENT], h)), lambda h, r: h.append(CLIENT, r[CLIENT])),
    (lambda h, r: len(r.filled) == 1 and not r[CLIENT] and r.filled[0] <= PERSON, _one_cell_goes_on),
    (lambda h, r: bool(r[CLIENT]) and not marked(r[CLIENT]) and (unfinished(h[CLIENT]) or not h[AGENCY] and wraps(r[CLIENT], h[CLIENT])), _client_goes_on),
    (lambda h, r: bool(h[CLIENT] and r[AGENCY]) and not h[AGENCY] and wraps(r[CLIENT], h[CLIENT]), _client_goes_on),
]
#: A step begins at a marker, or with several columns while the step before has fee, time or person, and is no continuation.
WRAPPED: list[Rule] = [
    (lambda h, r: bool(r[CLIENT]) and not r[AGENCY] and not r.told and titles(r[CLIENT]) and (not h[PERSON] or h[PERSON].endswith("/") or h.whole), lambda h, r: h.append(PERSON, r[CLIENT])),
    (lambda h, r: unfinished(h[CLIENT]) and not h.whole and not marked(r[CLIENT]), _all_appended),
    (lambda h, r: not (marked(r[CLIENT]) and h[CLIENT]) and not (_fresh(h, r) and h.told and not wraps(r[CLIENT], h[CLIENT])), _all_appended),
]
#: What is left of one column joins the step before if that is not complete.
FRAGMENTS: list[Rule] = [
    (lambda h, r: r.only(CLIENT) and noise(r[CLIENT]), _drop),
    (lambda h, r: r.only(CLIENT) and titles(r[CLIENT]), lambda h, r: h.append(PERSON, r[CLIENT])),
    (lambda h, r: r.only(CLIENT) and (not h.whole or _attached(r[CLIENT], h)), lambda h, r: h.append(CLIENT, r[CLIENT])),
    (lambda h, r: not r[CLIENT] and bool(r[AGENCY]) and not h[AGENCY], lambda h, r: [h.fill(at, r[at]) for at in (AGENCY, FEE, TIME, PERSON)]),
    (lambda h, r: r.only(PERSON) and (not h[PERSON] or h[PERSON].endswith("/")), lambda h, r: h.append(PERSON, r[PERSON])),
]


def _fresh(held: Row, row: Row) -> bool:
    beside = held.told and bool(held[AGENCY])
    return bool(row[CLIENT]) and (bool(row[AGENCY]) and (row.told or beside) or row.told and beside or beside)


@dataclass
class Merge:
    """One pass: a row joins the one held by the first rule that holds, or takes its place."""

    rules: list[Rule]
    held: Row | None = None

    def push(self, row: Row) -> Row | None:
        """The row that is done, if the new one takes its place."""
        held = self.held
        if held is not None:
            for test, act in self.rules:
                if test(held, row):
                    act(held, row)
                    return None
        self.held = row
        return held


def quiet(row: Row) -> Row | None:
    """Without noise in the outer columns; None if nothing else is there."""
    if all(noise(row[at]) for at in row.filled):
        return None
    for at in (CLIENT, PERSON):
        if noise(row[at]):
            row.put(at, "")
    return row


@lru_cache(KEPT)
def without_crumbs(text: str) -> str:
    """A cell without words of the header."""
    text = spaced(text)
    while _CRUMB.search(text):
        for crumb in _CRUMBS:
            text = crumb.sub(" ", text)
        text = spaced(text)
    return text.strip(" /|-–—:")


@lru_cache(KEPT)
def fee(text: str) -> str:
    text = without_crumbs(text)
    if text.casefold() in FREE or re.search(r"(?i)\b(none|n\s*/?\s*a|nil|free)\b", text) and not re.search(r"(?i)\b(?:php|p\s*\d|\d+[.,]\d+)", text):
        return "None"
    return "" if page_number(text) else text


@lru_cache(KEPT)
def time_and_person(time: str, person: str) -> tuple[str, str]:
    """Parts a title that ran into the time cell, and puts it before the person."""
    before, behind = _PERSON_TIME.fullmatch(time), _TIME_PERSON.fullmatch(time)
    if before and not _UNIT.fullmatch(before[1]):
        head, time, glue = before[1], before[2], " "
    elif behind and not _ATOM.fullmatch(time) and not _UNIT.fullmatch(behind[2]):
        time, head = behind[1], behind[2]
        goes_on = person[:1].islower() or _ROLE.match(person)
        glue = "/" if "/" in head and "/" not in person or not goes_on else " "
    else:
        return time, person
    if not person:
        return time, head
    return time, person if head.casefold() in person.casefold() else f"{head.rstrip('/')}{glue}{person.lstrip('/')}"


@dataclass
class Step:
    """A finished step; or, with a reason, cells that became none."""

    cells: list[str]
    reason: str | None = None
    page_fee: bool = False


@dataclass
class Finish:
    """Makes steps of logical rows; holds the last step, which later crumbs may still join."""

    held: Step | None = None
    out: list[Step] = field(default_factory=list)

    def next(self, row: Row) -> None:
        client, agency, charge, time, person = row.cells[:5]
        last = self.held.cells if self.held else None
        if header_row(row.cells):
            if row.filled:
                self.out.append(Step(row.cells[:5], "header"))
        elif not client and not agency:
            if person and last:
                last[PERSON] = with_person(last[PERSON], person)
        elif noise(client) and not agency:
            pass
        elif row.only(CLIENT):
            if last and titles(client):
                last[PERSON] = with_person(last[PERSON], client)
            elif last and _attached(client, Row(list(last))):
                last[CLIENT] = f"{last[CLIENT]} {client}"
            elif not last or unfinished(client):
                self.put(Step([client, "", "", "", ""]))
            else:
                self.out.append(Step(row.cells[:5], "client only"))
        else:
            counted = page_number(charge)
            time, person = time_and_person(time, person)
            person = without_crumbs(person)
            cells = [_NUMBER.sub("", client), agency, "" if counted else fee(charge), without_crumbs(time), re.sub("/{2,}", "/", re.sub(r"\s*/\s*", "/", with_person("", person)))]
            if last and cells[CLIENT] and short_noun(cells[CLIENT], last[CLIENT]):
                joined = Row(list(last))
                joined.append(CLIENT, cells[CLIENT])
                for at in (AGENCY, FEE, TIME):
                    joined.fill(at, cells[at])
                if not joined[PERSON] or joined[PERSON].endswith("/"):
                    joined.append(PERSON, cells[PERSON])
                self.held.cells = joined.cells
            else:
                self.put(Step(cells, page_fee=counted))

    def put(self, step: Step) -> None:
        if self.held:
            self.out.append(self.held)
        self.held = step


class Steps:
    """The passes one after another, for visual rows that come one at a time."""

    def __init__(self) -> None:
        self.passes = [Merge(BY_COLUMN), Merge(WRAPPED), Merge(FRAGMENTS), Merge(BY_COLUMN)]
        self.finish = Finish()

    def _on(self, row: Row | None, at: int) -> None:
        while row is not None and at < len(self.passes):
            if self.passes[at].rules is BY_COLUMN:
                row = quiet(row)
            row = self.passes[at].push(row) if row is not None else None
            at += 1
        if row is not None:
            self.finish.next(row)

    def push(self, cells: list[str | None]) -> list[Step]:
        """What is finished by now, in order; what became no step stands among the steps with its reason."""
        row = Row(cells[:5])
        if not header_row(row.cells):
            self._on(row, 0)
        elif row.filled:
            self.finish.out.append(Step(row.cells, "header"))
        return self._told()

    def end(self) -> list[Step]:
        for at, one in enumerate(self.passes):
            self._on(one.held, at + 1)
        if self.finish.held:
            self.finish.out.append(self.finish.held)
        return self._told()

    def _told(self) -> list[Step]:
        out, self.finish.out = self.finish.out, []
        return out


def steps(rows: Iterable[list[str | None]]) -> list[Step]:
    """Steps of one table's visual rows. Blank cells of steps need a review."""
    machine = Steps()
    return [s for row in rows for s in machine.push(row)] + machine.end()


class WrappedRows:
    """Logical rows of one block's cells, given in order of line, by the rule of wrapped rows alone."""

    schema = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))])

    def __init__(self, block: int | None):
        self.block, self.n, self.rows = block, 0, Merge(WRAPPED)

    def push(self, cells):
        done = self.rows.push(Row(cells or []))
        if done is not None:
            yield self.block, self.n, done.cells
            self.n += 1

    def end(self):
        if self.rows.held is not None:
            yield self.block, self.n, self.rows.held.cells


class ServiceSteps:
    """Steps of one block's cells, given in order of row; rows that became no step have a reason and no number."""

    schema = pa.schema([("block", pa.int64()), ("step", pa.int64()), *((x, pa.string()) for x in ("client_step", "agency_action", "fee", "processing_time", "person")), ("page_fee", pa.bool_()), ("reason", pa.string())])

    def __init__(self, block: int | None):
        self.block, self.n, self.machine = block, 0, Steps()

    def told(self, done):
        for s in done:
            yield self.block, None if s.reason else self.n, *(c or (None if s.reason else REVIEW) for c in s.cells), s.page_fee, s.reason
            self.n += not s.reason

    def push(self, cells):
        return self.told(self.machine.push(cells or []))

    def end(self):
        return self.told(self.machine.end())


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def in_turn(machine: type, given: Iterator[tuple[list, list, list]]) -> Iterator[pa.RecordBatch]:
    """What the machines of all blocks make of (blocks, numbers, items), block after block; the item with number 1 begins a block."""
    now = None
    for blocks, numbers, items in given:
        out = []
        for block, at, item in zip(blocks, numbers, items, strict=True):
            if at == 1:
                if now is not None:
                    out.extend(now.end())
                now = machine(block)
            out.extend(now.push(item))
        yield _table(out, machine.schema)
    if now is not None:
        yield _table(list(now.end()), machine.schema)


def _streamed(df: DataFrame, order: str, item: str, machine: type) -> DataFrame:
    """Rows of a block in one task, in order, without a shuffle if they are dealt by block already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_turn(machine, ([batch.column(c).to_pylist() for c in ("block", "at", item)] for batch in batches))

    numbered = df.select("block", F.row_number().over(Window.partitionBy("block").orderBy(order)).alias("at"), item)
    return numbered.mapInArrow(run, _spark(machine))


def _spark(machine: type) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names.get(f.type, 'array<string>')}" for f in machine.schema)


def wrapped(table: DataFrame) -> DataFrame:
    """table: block (long), line, cells array<string>. Logical rows of each block: block, row, cells."""
    return _streamed(table, "line", "cells", WrappedRows)


def service_steps(table: DataFrame) -> DataFrame:
    """table: block (long), row, cells array<string> (five columns). Steps of each block, and what was put aside."""
    return _streamed(table, "row", "cells", ServiceSteps)


def bundled_steps(bundles: DataFrame) -> DataFrame:
    """bundles: page (long), at, y, height, and of each box, as arrays, its text, x0 and dy. The steps of boxes that come bundled, at y + dy.

    A page's bundles lie in one task, one after another, and number 1 is the first of
    them. Their boxes are taken apart and sorted in the task, since a sort of single
    boxes costs Spark more than reading them. Boxes without text are none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_turn(ServiceSteps, layout.page_cells(layout.unbundled(batches), 5))

    return bundles.select("page", "at", "y", "height", "text", "x0", "dy").mapInArrow(run, _spark(ServiceSteps))


def page_steps(boxes: DataFrame) -> DataFrame:
    """boxes: page (long), word (long), text, x0, cy, height. Steps of each page, its boxes read as rows of five voted columns.

    Rows, columns and steps of a page are made in the task that has its boxes: boxes are
    many times what they hold, so they are not dealt out again between the three.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_turn(ServiceSteps, layout.page_cells(batches, 5))

    at = F.row_number().over(Window.partitionBy("page").orderBy("cy", "x0", "word"))
    return boxes.select("page", at.alias("at"), "word", "text", "x0", "cy", "height").mapInArrow(run, _spark(ServiceSteps))


# Fixed values of step lines: words of headers as letters only, fees, times, and what ends a title.
HEADER_TOKENS = "BE TIME RESPONSIBLE PAID ACTIONS STEPS PERSON PROCESSING FEES CLIENT AGENCY TO TOBE TOBEPAID FEESTOBE FEESTOBEPAID CLIENTSTEPS AGENCYACTIONS PROCESSINGTIME PERSONRESPONSIBLE RESPONSIBLEPERSON RESPONSIBLEPERSONNEL"
HEADER_PARTS = "CLIENTSTEPS AGENCYACTIONS ACTIONSPAID FEESTOBEPAID FEESTOBE PROCESSINGTIME RESPONSIBLEPERSON RESPONSIBLEPERSONNEL PERSONRESPONSIBLE CHECKLISTOFREQUIREMENTS WHERETOSECURE TYPEOFTRANSACTION WHOMAYAVAIL OFFICEORDIVISION"
LINE_TIME = r"\b(?:(?:\d+\s*(?:-\s*\d+)?|\d+\s+and\s+1/2|and\s+1/2)\s*)?(?:minutes?|mins?|hours?|hrs?|days?)\b"
LINE_FEE = r"\b(?:N\s*/\s*A|None|Free|Php\s*[\d,.]+|P\s*[\d,.]+)(?![\w,.])"
TITLE_ENDS = "staff personnel counselor officer coordinator director head assistant adviser advisers"

_LINE_TIME, _LINE_FEE = re.compile(LINE_TIME, re.I), re.compile(LINE_FEE, re.I)
_LINE_NUMBER, _TOTAL = re.compile(r"\d{1,2}[.)]\s+(?=\S)"), re.compile(r"total\b", re.I)
_EDGES = " |,:-"
_HEADER_TOKENS, _HEADER_PARTS = frozenset(HEADER_TOKENS.split()), re.compile("|".join(HEADER_PARTS.split()))
_NO_LETTERS, _DIGITS, _SOME_DIGIT = re.compile("[^A-Z0-9]+"), re.compile("[0-9]+"), re.compile(r"\d")
_TITLE_ENDS = frozenset(TITLE_ENDS.split())


@lru_cache(KEPT)
def header_words(text: str) -> bool:
    """A crumb of the table's header, or a line that holds one of its names."""
    letters = _NO_LETTERS.sub("", text.upper())
    return letters in _HEADER_TOKENS or bool(_HEADER_PARTS.search(_DIGITS.sub("", letters)))


def begins_row(line: str) -> bool:
    """A number begins a row; else it takes a bar, two cells, and a first cell that begins with no small letter."""
    if _LINE_NUMBER.match(line):
        return True
    cells = [c.strip() for c in line.split("|") if c.strip()]
    return "|" in line and len(cells) >= 2 and not cells[0][0].islower() and not header_words(cells[0])


def joined_line(row: str, line: str) -> str:
    """A continuation: cell by cell, or to the second cell if it has no bar."""
    if "|" not in row:
        return f"{row} {line}".strip()
    cells = [c.strip() for c in row.split("|")]
    for at, more in enumerate([c.strip() for c in line.split("|")] if "|" in line else ["", line]):
        if more and not header_words(more):
            if at < len(cells):
                cells[at] = f"{cells[at]} {more}".strip()
            else:
                cells.append(more)
    return " | ".join(cells)


def _cut(pattern: re.Pattern, text: str) -> tuple[str, str]:
    """What the pattern finds first, and the text without it."""
    m = pattern.search(text)
    return (m[0].strip(), " ".join(x for x in (text[: m.start()].strip(_EDGES), text[m.end() :].strip(_EDGES)) if x)) if m else ("", text)


def _title_first(text: str) -> tuple[str, str]:
    """The capitalised words in front, up to one that ends a title, and the rest."""
    words, n = text.split(), 0
    for word in words:
        ends = re.sub("[^a-z]", "", word.lower()) in _TITLE_ENDS
        if not ends and not word[0].isupper():
            break
        n += 1
        if ends:
            break
    return " ".join(words[:n]), " ".join(words[n:])


def line_step(row: str) -> list[str] | None:
    """The five cells of a row of text; None if it is no step."""
    cells = [_LINE_NUMBER.sub("", spaced(c).strip(_EDGES)).strip(_EDGES) for c in row.split("|")]
    cells = [c for c in cells if c and not header_words(c)]
    if "|" not in row:
        return [cells[0], "", "", "", ""] if cells and _LINE_NUMBER.match(row) and len(cells[0]) >= 8 else None
    if len(cells) < 2:
        return None
    charge, agency = _cut(_LINE_FEE, cells[1]) if len(cells) > 2 else ("", cells[1])
    rest = " ".join(cells[3:])
    if len(cells) >= 5:
        charge = cells[2]
    elif len(cells) > 2:
        own = _cut(_LINE_FEE, cells[2])[0]
        charge, rest = own or charge, rest if own or len(cells) == 4 else cells[2]
    time, person = _cut(_LINE_TIME, rest)
    leading = _LINE_TIME.match(agency)
    if leading and agency[leading.end() :].strip():
        title, agency = _title_first(agency[leading.end() :].strip(_EDGES))
        time, person = time or leading[0].strip(), person or title
    if not time or not _SOME_DIGIT.search(time):
        numbered = next((m[0].strip() for m in _LINE_TIME.finditer(" ".join(cells)) if _SOME_DIGIT.search(m[0]) and m[0].lower().endswith(time.lower())), "")
        time = numbered or time
    for known in (charge, time, person):
        if known and not (agency.isascii() and known.isascii() and known.lower() not in agency.lower()):
            agency = re.sub(re.escape(known), " ", agency, flags=re.I)
    return [cells[0], spaced(agency).strip(_EDGES), charge, time, person]


class StepLines:
    """Steps of a block's lines that come one at a time; holds one row and one step."""

    def __init__(self) -> None:
        self.row, self.step, self.over = "", None, False

    def _finish(self) -> list[list[str]]:
        row, self.row, done = self.row, "", []
        made = line_step(row) if row else None
        if made:
            done, self.step = ([self.step] if self.step else []), made
        elif row and self.step and "|" not in row and not _LINE_NUMBER.match(row):
            self.step[AGENCY] = f"{self.step[AGENCY]} {row}".strip()
        return done

    def push(self, line: str) -> list[list[str]]:
        line = spaced(line)
        if self.over or not line or header_words(line):
            return []
        if _TOTAL.match(line):
            self.over = True
            return self._finish()
        if begins_row(line):
            done, self.row = self._finish(), line
            return done
        self.row = joined_line(self.row, line)
        return []

    def end(self) -> list[list[str]]:
        return self._finish() + ([self.step] if self.step else [])


class LineSteps:
    """Steps of one block's lines, given in order."""

    schema = pa.schema([*ServiceSteps.schema][:7])

    def __init__(self, block: int | None):
        self.block, self.n, self.lines = block, 0, StepLines()

    def told(self, done):
        for cells in done:
            yield self.block, self.n, *(c or REVIEW for c in cells)
            self.n += 1

    def push(self, text):
        return self.told(self.lines.push(text))

    def end(self):
        return self.told(self.lines.end())


def line_steps(lines: DataFrame) -> DataFrame:
    """lines: block (long), line, text. Steps of each block up to its total."""
    return _streamed(lines, "line", "text", LineSteps)
