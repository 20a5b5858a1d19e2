"""Snapshots, isolation, versioned writes and vacuum."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.operators import mvcc, versioned


@pytest.fixture
def db(spark):
    return mvcc.Transactions(), versioned.VersionedTable.create(spark, "v string")


def insert(table, xid, *values, command=0):
    table.insert(table.spark.createDataFrame([(v,) for v in values], "v string").coalesce(1), xid, command)


def seen(db, snapshot):
    txns, table = db
    return sorted(r.v for r in table.scan(txns, snapshot).collect())


def committed(db, *values):
    xid = db[0].begin()
    insert(db[1], xid, *values)
    db[0].commit(xid)


def fresh(db):
    return db[0].snapshot(db[0].begin())


def test_read_your_own_writes(db):
    txns, table = db
    a, b = txns.begin(), txns.begin()
    old = txns.snapshot(b)
    insert(table, a, "mine")
    assert seen(db, txns.snapshot(a)) == []
    txns.advance(a)
    assert seen(db, txns.snapshot(a)) == ["mine"] and seen(db, txns.snapshot(b)) == seen(db, old) == []


def test_no_dirty_read_and_snapshot_stays(db):
    txns, table = db
    committed(db, "baseline")
    reader, writer = txns.begin(), txns.begin()
    old = txns.snapshot(reader)
    insert(table, writer, "new-row")
    assert seen(db, txns.snapshot(reader)) == ["baseline"]
    txns.commit(writer)
    assert seen(db, old) == ["baseline"] and seen(db, fresh(db)) == ["baseline", "new-row"]


def test_delete_isolation(db):
    txns, table = db
    committed(db, "row-A", "row-B")
    old, writer = fresh(db), txns.begin()
    table.delete(table.scan(txns, txns.snapshot(writer)).where("v = 'row-A'"), writer)
    assert seen(db, txns.snapshot(writer)) == ["row-B"] and seen(db, fresh(db)) == ["row-A", "row-B"]
    txns.commit(writer)
    assert seen(db, old) == ["row-A", "row-B"] and seen(db, fresh(db)) == ["row-B"]


def test_aborted_insert_and_delete(db):
    txns, table = db
    committed(db, "committed")
    xid = txns.begin()
    insert(table, xid, "lost")
    table.delete(table.scan(txns, txns.snapshot(xid)).where("v = 'committed'"), xid)
    txns.abort(xid)
    assert seen(db, fresh(db)) == ["committed"]


def test_interleaved_writers(db):
    txns, table = db
    a, b = txns.begin(), txns.begin()
    insert(table, a, "from-a")
    insert(table, b, "from-b")
    txns.advance(a), txns.advance(b)
    assert seen(db, txns.snapshot(a)) == ["from-a"] and seen(db, txns.snapshot(b)) == ["from-b"]
    txns.commit(a), txns.commit(b)
    assert seen(db, fresh(db)) == ["from-a", "from-b"]


def test_update_chain(db):
    txns, table = db
    committed(db, "v1")
    old, xid = fresh(db), txns.begin()
    table.update(table.scan(txns, txns.snapshot(xid)).withColumn("v", F.lit("v2")), xid)
    txns.commit(xid)
    assert seen(db, old) == ["v1"] and seen(db, fresh(db)) == ["v2"]
    row = table.scan(txns, fresh(db)).first()
    assert row.version == 2 and table.fetch(txns, fresh(db), [row.rid]).count() == 1
    assert versioned.latest(table.versions()).first().v == "v2"


def test_command_counter(db):
    txns, table = db
    xid = txns.begin()
    insert(table, xid, "row-A", command=0)
    txns.advance(xid)
    insert(table, xid, "row-B", command=1)
    assert seen(db, txns.snapshot(xid)) == ["row-A"]
    txns.advance(xid)
    assert seen(db, txns.snapshot(xid)) == ["row-A", "row-B"]


def test_last_delete_counts(db):
    txns, table = db
    committed(db, "x")
    a, b = txns.begin(), txns.begin()
    row = table.scan(txns, txns.snapshot(a))
    table.delete(row, a)
    table.delete(row, b)
    txns.commit(a)
    assert table.versions().first().xmax == b and seen(db, fresh(db)) == ["x"]


def test_errors_and_trace():
    events = []
    txns = mvcc.Transactions(trace=lambda e, x: events.append((e, x)))
    xid = txns.begin()
    txns.snapshot(xid)
    txns.commit(xid)
    assert xid == 3 and events == [("begin", 3), ("snapshot", 3), ("committed", 3)]
    for call in (txns.commit, txns.abort, txns.advance):
        with pytest.raises(ValueError, match="not running"):
            call(xid)


def test_vacuum(db):
    txns, table = db
    committed(db, *(f"r{k:02}" for k in range(100)))
    xid = txns.begin()
    table.delete(table.scan(txns, txns.snapshot(xid)).where("v < 'r50'"), xid)
    txns.commit(xid)
    removed, _, remaining = table.autovacuum(txns)
    assert removed == remaining == table.versions().count() == 50
    assert len(seen(db, fresh(db))) == 50 and table.autovacuum(txns) is None


def test_vacuum_waits_for_snapshots(db):
    txns, table = db
    committed(db, "kept")
    t5, t6 = txns.begin(), txns.begin()
    old = txns.snapshot(t6)
    table.delete(table.scan(txns, txns.snapshot(t5)), t5)
    txns.commit(t5)
    assert table.vacuum(txns)[0] == 0 and seen(db, old) == ["kept"] and seen(db, fresh(db)) == []
    txns.commit(t6)
    for x in [x for x, s in txns.states.items() if s == mvcc.RUNNING]:
        txns.commit(x)
    assert table.vacuum(txns)[0] == 1


def test_vacuum_freezes_and_keeps_aborted(db):
    txns, table = db
    committed(db, *"abcdefghij" * 2)
    xid = txns.begin()
    insert(table, xid, "lost")
    txns.abort(xid)
    for _ in range(100):
        txns.commit(txns.begin())
    removed, frozen, remaining = table.vacuum(txns, freeze_age=10, files=1)
    assert (removed, frozen, remaining) == (0, 20, 21) and len(seen(db, fresh(db))) == 20
    assert {r.xmin for r in table.versions().collect()} == {2, xid}
    assert table.vacuum(txns, reclaim_aborted=True)[0] == 1


def expected(s, xmin, xmax, cid, state):
    """The rule of visibility, step by step."""
    status = lambda x: "aborted" if x == 0 else "committed" if x == 2 else state.get(x, "in_progress")
    sees = lambda x: x != 0 and (x in (2, s.xid) or x < s.xmax and (x < s.xmin or x not in s.running))
    if xmin == 0 or xmin != 2 and not (status(xmin) == "committed" and sees(xmin)) and not (status(xmin) == "in_progress" and xmin == s.xid):
        return "invisible"
    if xmin == s.xid:
        if cid >= s.command:
            return "invisible"
        if xmax in (0, s.xid):
            return "deleted_by_self" if xmax else "inserted_by_self"
    if xmax == s.xid:
        return "being_deleted"
    return "deleted" if xmax and status(xmax) == "committed" and sees(xmax) else "visible"


@pytest.mark.parametrize("snapshot", [mvcc.Snapshot(9, 5, 12, (5, 7, 9), 1), mvcc.Snapshot(20, 20, 20, (), 0), mvcc.Snapshot(4, 4, 9, (4, 6), 2)])
def test_visibility_matrix(spark, snapshot):
    ids = [0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 20]
    state = {3: "committed", 4: "in_progress", 5: "committed", 6: "aborted", 7: "in_progress", 8: "committed", 9: "in_progress", 11: "committed", 12: "committed", 20: "in_progress"}
    rows = list(itertools.product(ids, ids, range(3)))
    df = mvcc.with_states(spark.createDataFrame(rows, "xmin long, xmax long, cid long"), spark.createDataFrame(list(state.items()), "xid long, state string"))
    got = {(r.xmin, r.xmax, r.cid): r.o for r in df.select("xmin", "xmax", "cid", mvcc.outcome(snapshot).alias("o")).collect()}
    assert got == {r: expected(snapshot, *r, state) for r in rows}
