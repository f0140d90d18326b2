"""Tickets as state: each update is taken or refused by the state it meets, and what it changes is told field by field.

An update asks for a status, a priority or both, in a role. It is refused as a whole if
its role may not move the ticket so, or may not set priorities.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where an office may move a ticket; a student may only close what is resolved, an admin may do all.
MOVES = {"Open": ("In Progress",), "In Progress": ("Resolved", "Closed"), "Resolved": ("Closed", "In Progress"), "Closed": ()}
START = ("Open", "Medium", None, None)
STATE = "status string, priority string, resolved_at timestamp, closed_at timestamp"
OUT = f"ticket_id long, seq long, ts timestamp, accepted boolean, old_status string, old_priority string, {STATE}"


def allowed(now: str, wanted: str, role: str) -> bool:
    if now == wanted or role == "admin":
        return True
    if role == "student":
        return (now, wanted) == ("Resolved", "Closed")
    return role == "office" and wanted in MOVES.get(now, ())


def step(state: tuple, ts, wanted: str | None, priority: str | None, role: str) -> tuple | None:
    """The state after an update, or None if it is refused. Reopening clears what it undoes."""
    status, old, resolved, closed = state
    after = wanted or status
    if (wanted and not allowed(status, wanted, role)) or (priority and role not in ("admin", "office")):
        return None
    if after == "Resolved" and resolved is None:
        resolved = ts
    if after == "Closed" and closed is None:
        closed = ts
    if after == "In Progress" and status in ("Resolved", "Closed"):
        resolved, closed = None, None if status == "Closed" else closed
    return after, priority or old, resolved, closed


def _walk(ticket: int, frame: pd.DataFrame, state: tuple) -> tuple[list[tuple], tuple]:
    """Rows of OUT for the updates of one ticket in their order, and the state after them."""
    rows = []
    for seq, ts, wanted, priority, role in frame[["seq", "ts", "wanted", "priority", "role"]].itertuples(index=False):
        after = step(state, ts, wanted, priority, role)
        rows.append((ticket, seq, ts, after is not None, state[0], state[1], *(after or state)))
        state = after or state
    return rows, state


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
    return out.assign(**{c: pd.to_datetime(out[c]) for c in ("ts", "resolved_at", "closed_at")})


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Missing strings as None."""
    return frame.assign(**{c: frame[c].astype(object).where(frame[c].notna(), None) for c in ("wanted", "priority", "role")})


def batch(updates: DataFrame) -> DataFrame:
    """updates: ticket_id, seq (unique in a ticket), ts, wanted, priority, role (null: none). One row of OUT for each.

    A task reads its tickets in order, a few rows and one state at a time, however many
    updates a ticket has. Updates with a null ticket are dropped.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ticket, state = None, START
        for pdf in frames:
            rows: list[tuple] = []
            pdf = _plain(pdf)
            for _, group in pdf.groupby(pdf["ticket_id"].ne(pdf["ticket_id"].shift()).cumsum(), sort=False):
                now = int(group["ticket_id"].iloc[0])
                if now != ticket:
                    ticket, state = now, START
                more, state = _walk(now, group, state)
                rows += more
            if rows:
                yield _frame(rows)

    columns = ("ticket_id", "ts", "seq")
    sorted_ = updates.where("ticket_id IS NOT NULL").select(*columns, "wanted", "priority", "role").repartition("ticket_id").sortWithinPartitions(*columns)
    return sorted_.mapInPandas(run, OUT)


class _Tickets(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ticket", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _plain(pd.concat(list(rows))).sort_values(["ts", "seq"])
        kept = self.state.get() if self.state.exists() else START
        out, after = _walk(int(key[0]), pdf, tuple(kept))
        self.state.update(tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in after))
        yield _frame(out)

    def close(self) -> None:
        pass


def stream(updates: DataFrame) -> DataFrame:
    """The same over a stream whose micro-batches come in order; a ticket's updates of one micro-batch are held together."""
    columns = ("ticket_id", "ts", "seq", "wanted", "priority", "role")
    return updates.where("ticket_id IS NOT NULL").select(*columns).groupBy("ticket_id").transformWithStateInPandas(_Tickets(), OUT, "Append", "None")


def audit(steps: DataFrame) -> DataFrame:
    """One row for each field that an accepted update changed."""
    change = lambda f: F.struct(F.lit(f).alias("field_name"), F.col(f"old_{f}").alias("old_value"), F.col(f).alias("new_value"))
    rows = steps.where("accepted").select("ticket_id", "seq", "ts", F.inline(F.array(change("status"), change("priority"))))
    return rows.where("old_value <> new_value")


def latest(steps: DataFrame) -> DataFrame:
    """Each ticket's state after its last update, and how many updates were taken and refused."""
    last = F.max_by(F.struct("status", "priority", "resolved_at", "closed_at"), F.struct("ts", "seq"))
    return steps.groupBy("ticket_id").agg(last.alias("x"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused")).select("ticket_id", "x.*", "accepted", "refused")
