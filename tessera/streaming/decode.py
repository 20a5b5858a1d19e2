"""Change decoding as a stream: changes wait in state until their transaction ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "xid long, commit_lsn long, lsn long, op string, seq long"
ENDS = ("COMMIT", "ABORT")


class Buffer(StatefulProcessor):
    """One transaction id's open changes, in log order: a COMMIT emits them, an ABORT drops them.
    Batches must come in log order; within a batch rows are put in order here."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "lsn long, op string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        new = sorted((r["lsn"], r["op"]) for r in rows)
        ends = [k for k, (_, op) in enumerate(new) if op in ENDS]
        if not ends:  # what is open already is neither read nor written again
            self.open.appendList(new)
            return
        held = [tuple(x) for x in self.open.get()] if new[ends[0]][1] == "COMMIT" else []
        for lsn, op in new:
            if op in ENDS:
                if op == "COMMIT":
                    for n, (at, change) in enumerate(held, 1):
                        yield Row(xid=key[0], commit_lsn=lsn, lsn=at, op=change, seq=n)
                held = []
            else:
                held.append((lsn, op))
        if held:
            self.open.put(held)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def decoded(log: DataFrame) -> DataFrame:
    """A streaming log (xid, lsn, op) to committed changes. The state is one list an open
    transaction; with the RocksDB store it needs no memory of its own."""
    return log.select("xid", "lsn", "op").groupBy("xid").transformWithState(Buffer(), OUTPUT, "append", "none")


def delivered(log: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs the stream over what has come, and calls `handler` with each batch of committed changes,
    ordered by commit and place in it, and the batch's number. A batch that failed comes again with
    the same number."""
    ordered = lambda batch, number: handler(batch.orderBy("commit_lsn", "seq"), number)
    return decoded(log).writeStream.foreachBatch(ordered).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
