"""Snapshots as conditions over version rows (xmin, xmax, cid)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: No transaction, the frozen one, and the first that can begin.
INVALID, FROZEN, FIRST = 0, 2, 3
COMMITTED, ABORTED, RUNNING = "committed", "aborted", "in_progress"
#: Outcomes that return a row.
RETURNED = ("visible", "inserted_by_self")


@dataclass(frozen=True)
class Snapshot:
    """Own id, the bounds below which all and from which on none have ended, those that ran in
    between, and the current command."""

    xid: int
    xmin: int
    xmax: int
    running: tuple[int, ...] = ()
    command: int = 0


@dataclass
class Transactions:
    """Hands out ids and snapshots on the driver; its states are a small table."""

    next_id: int = FIRST
    states: dict[int, str] = field(default_factory=dict)
    commands: dict[int, int] = field(default_factory=dict)
    live: dict[int, list[Snapshot]] = field(default_factory=dict)
    trace: Callable[[str, int], None] = lambda event, xid: None

    def begin(self) -> int:
        xid = self.next_id
        self.next_id += 1
        self.states[xid], self.commands[xid], self.live[xid] = RUNNING, 0, []
        self.trace("begin", xid)
        return xid

    def _end(self, xid: int, state: str) -> None:
        if self.states.get(xid) != RUNNING:
            raise ValueError(f"transaction {xid} is not running")
        self.states[xid] = state
        del self.commands[xid], self.live[xid]
        self.trace(state, xid)

    def commit(self, xid: int) -> None:
        self._end(xid, COMMITTED)

    def abort(self, xid: int) -> None:
        self._end(xid, ABORTED)

    def advance(self, xid: int) -> int:
        """Ends a command: what it wrote is visible to the transaction from now on."""
        if xid not in self.commands:
            raise ValueError(f"transaction {xid} is not running")
        self.commands[xid] += 1
        return self.commands[xid]

    def snapshot(self, xid: int) -> Snapshot:
        running = tuple(sorted(x for x, s in self.states.items() if s == RUNNING))
        found = Snapshot(xid, min(running, default=self.next_id), self.next_id, running, self.commands.get(xid, 0))
        if xid in self.live:
            self.live[xid].append(found)
        self.trace("snapshot", xid)
        return found

    def horizon(self) -> int:
        """Below it no live snapshot can see a deleted version: the least lower bound of the
        snapshots taken, and of those yet to be."""
        running = [x for x, s in self.states.items() if s == RUNNING]
        return min([self.next_id, *running, *(s.xmin for own in self.live.values() for s in own)])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.states.items()), "xid long, state string")


def with_states(versions: DataFrame, states: DataFrame) -> DataFrame:
    """`versions` with state_min and state_max of (xid, state): 0 aborted, 2 committed, unknown ids
    running. The table of states may be large, so adaptive execution chooses how to join it. Rows
    without a transaction, or with a frozen one, match no state; in a shuffle they are spread out
    by their own hash, since most rows of a table are such."""

    def state(xid: str, of: Column) -> Column:
        return F.when(F.col(xid) == INVALID, ABORTED).when(F.col(xid) == FROZEN, COMMITTED).otherwise(F.coalesce(of, F.lit(RUNNING)))

    a = states.select(F.col("xid").alias("__a"), F.col("state").alias("__sa"))
    b = states.select(F.col("xid").alias("__b"), F.col("state").alias("__sb"))
    apart = -1 - F.pmod(F.xxhash64(*versions.columns), F.lit(1 << 20))
    key = lambda xid: F.when(F.col(xid) >= FIRST, F.col(xid)).otherwise(apart)
    joined = versions.join(a, key("xmin") == F.col("__a"), "left").join(b, key("xmax") == F.col("__b"), "left")
    return joined.withColumns({"state_min": state("xmin", F.col("__sa")), "state_max": state("xmax", F.col("__sb"))}).drop("__a", "__b", "__sa", "__sb")


def in_snapshot(xid: Column, s: Snapshot) -> Column:
    """Whether the snapshot counts this id as ended, or as its own."""
    ended = xid < s.xmax
    if s.running:
        ended = ended & ((xid < s.xmin) | ~xid.isin(*s.running))
    return (xid != INVALID) & ((xid == FROZEN) | (xid == s.xid) | ended)


def outcome(s: Snapshot) -> Column:
    """What the snapshot makes of a version with states: one of six outcomes."""
    xmin, xmax, cid, state_min, state_max = (F.col(c) for c in ("xmin", "xmax", "cid", "state_min", "state_max"))
    born = (xmin != INVALID) & ((xmin == FROZEN) | ((state_min == COMMITTED) & in_snapshot(xmin, s)) | ((state_min == RUNNING) & (xmin == s.xid)))
    own = xmin == s.xid
    return (
        F.when(~born, "invisible").when(own & (cid >= s.command), "invisible").when(own & (xmax == INVALID), "inserted_by_self").when(own & (xmax == s.xid), "deleted_by_self")
        .when(xmax == INVALID, "visible").when(xmax == s.xid, "being_deleted").when((state_max == COMMITTED) & in_snapshot(xmax, s), "deleted").otherwise("visible")
    )


def visible(s: Snapshot) -> Column:
    return outcome(s).isin(*RETURNED)


def visible_dirty() -> Column:
    """Uncommitted rows too: inserted by any that didn't abort, not deleted by one that didn't."""
    return (F.col("state_min") != ABORTED) & ((F.col("xmax") == INVALID) | (F.col("state_max") == ABORTED))


def visible_now() -> Column:
    """What is committed this moment."""
    return (F.col("state_min") == COMMITTED) & ((F.col("xmax") == INVALID) | (F.col("state_max") != COMMITTED))


def scan(versions: DataFrame, states: DataFrame, s: Snapshot) -> DataFrame:
    return with_states(versions, states).where(visible(s)).drop("state_min", "state_max")
