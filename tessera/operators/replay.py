"""From log records to row changes, transactions, and recovered rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lsn import SEGMENT
from tessera.operators import blocks, mvcc

#: Resource managers by number.
MANAGERS = "XLOG Transaction Storage CLOG Database Tablespace MultiXact RelMap Standby Heap2 Heap Btree Hash Gin Gist Sequence SPGist BRIN CommitTimestamp LogicalMessage".split()
XLOG, XACT, HEAP2, HEAP, BTREE = 0, 1, 9, 10, 11
#: Managers whose records are applied; records of others are skipped.
APPLIED = (XLOG, XACT, HEAP2, HEAP, BTREE)
#: Operations by the bits of info that name them.
OPERATIONS = {
    XLOG: (0xF0, {0x00: "CHECKPOINT_SHUTDOWN", 0x10: "CHECKPOINT_ONLINE", 0x20: "NOOP", 0x30: "NEXTOID", 0x40: "SWITCH", 0x50: "BACKUP_END", 0x60: "PARAMETER_CHANGE", 0x70: "RESTORE_POINT", 0x80: "FPW", 0x90: "END_OF_RECOVERY", 0xA0: "FPW_CHANGE", 0xB0: "OVERWRITE"}),
    XACT: (0xF0, {0x00: "COMMIT", 0x10: "PREPARE", 0x20: "ABORT", 0x30: "COMMIT_PREPARED", 0x40: "ABORT_PREPARED", 0x50: "ASSIGNMENT", 0x60: "INVALIDATIONS"}),
    HEAP2: (0x70, {0x00: "REWRITE", 0x10: "PRUNE", 0x20: "VACUUM", 0x30: "FREEZE_PAGE", 0x40: "VISIBLE", 0x50: "MULTI_INSERT", 0x60: "LOCK_UPDATED", 0x70: "NEW_CID"}),
    HEAP: (0x70, {0x00: "INSERT", 0x10: "DELETE", 0x20: "UPDATE", 0x40: "HOT_UPDATE"}),
    BTREE: (0xF0, dict(zip(range(0, 0x100, 0x10), "INSERT_LEAF INSERT_UPPER INSERT_META SPLIT_L SPLIT_R SPLIT_L_ROOT SPLIT_R_ROOT VACUUM DELETE MARK_HALF_DEAD UNLINK_PAGE UNLINK_PAGE_META NEWROOT REUSE_PAGE META_CLEANUP INSERT_POST".split(), strict=True))),
}
TUPLE_HEADER, MULTI_HEADER = 24, 7


@dataclass(frozen=True)
class Manager:
    """A resource manager: its name, the bits of info that name an operation and these names, what its
    records do to a block (nothing if only images count), and whether they are applied at all."""

    name: str
    mask: int = 0xF0
    operations: dict[int, str] = field(default_factory=dict)
    redo: blocks.Redo | None = None
    applied: bool = True


def _images_only(page: object, record: dict) -> None:
    """Records that change a block by their images alone."""


_REDO = {HEAP2: blocks.heap2, HEAP: blocks.heap, BTREE: blocks.btree}
#: The managers by number; `registered` gives such a table with further ones.
REGISTRY = {k: Manager(name, *OPERATIONS.get(k, (0xF0, {})), _REDO.get(k), k in APPLIED) for k, name in enumerate(MANAGERS)}


def registered(number: int, manager: Manager, registry: dict[int, Manager] = REGISTRY) -> dict[int, Manager]:
    """The registry with one more manager. A number is given once."""
    if not 0 <= number <= 255 or (number in registry and registry[number].applied):
        raise ValueError(f"manager {number} is taken or out of range")
    return registry | {number: manager}


def manager_name(rmgr_id: Column, registry: dict[int, Manager] = REGISTRY) -> Column:
    out = F.format_string("Rmgr(%d)", rmgr_id)
    for number, manager in registry.items():
        out = F.when(rmgr_id == number, manager.name).otherwise(out)
    return out


def operation(rmgr_id: Column, info: Column, registry: dict[int, Manager] = REGISTRY) -> Column:
    """The operation's name, op=0x.. if it has none."""
    out = F.format_string("op=0x%02X", info.bitwiseAND(F.lit(0xF0)))
    for number, manager in registry.items():
        for code, name in manager.operations.items():
            out = F.when((rmgr_id == number) & (info.bitwiseAND(F.lit(manager.mask)) == code), name).otherwise(out)
    return out


def described(records: DataFrame, registry: dict[int, Manager] = REGISTRY) -> DataFrame:
    known = F.col("rmgr_id").isin([k for k, m in registry.items() if m.applied])
    reason = F.when(~F.col("rmgr_id").isin(list(registry)), "unknown").when(~known, "not applied")
    return records.withColumns({"rmgr": manager_name(F.col("rmgr_id"), registry), "op": operation(F.col("rmgr_id"), F.col("info"), registry), "applied": known, "skip_reason": reason})


def summary(records: DataFrame, registry: dict[int, Manager] = REGISTRY) -> DataFrame:
    """Records, skipped ones and bytes by manager."""
    return described(records, registry).groupBy("rmgr").agg(F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("skipped"), F.sum("tot_len").alias("bytes"))


def _u16(data: Column, at: Column | int) -> Column:
    low, high = (F.conv(F.hex(F.substring(data, F.lit(at) + k if isinstance(at, int) else at + k, F.lit(1))), 16, 10).cast("int") for k in (1, 2))
    return low + high * 256


def changes(records: DataFrame) -> DataFrame:
    """Row changes: xid, lsn, seq (order in a record), op, rel, block, offnum, tuple. Records whose
    first block is an image to apply hold no row change; a delete holds no tuple; one change a row
    of a multiple insert."""
    rows = described(records).where(F.col("rmgr_id").isin(HEAP, HEAP2) & (F.size("block_refs") > 0)).withColumn("b", F.col("block_refs")[0])
    rows = rows.where(~(F.col("b.image").isNotNull() & (F.col("b.image_flags").bitwiseAND(F.lit(4)) != 0)))
    base = ["xid", "lsn"]
    kind = F.when(F.col("op") == "HOT_UPDATE", "UPDATE").otherwise(F.col("op"))
    place = F.when(F.col("op") == "INSERT", _u16(F.col("main_data"), 0)).otherwise(_u16(F.col("main_data"), 4))
    single = rows.where((F.col("rmgr_id") == HEAP) & F.col("op").isin("INSERT", "DELETE", "UPDATE", "HOT_UPDATE"))
    one = single.select(*base, F.lit(0).alias("seq"), kind.alias("op"), F.col("b.rel").alias("rel"), F.col("b.block").alias("block"), place.alias("offnum"), F.when(F.col("op") != "DELETE", F.col("b.data")).alias("tuple"))
    many = rows.where((F.col("rmgr_id") == HEAP2) & (F.col("op") == "MULTI_INSERT"))
    parsed = many.select(*base, "b.rel", "b.block", F.posexplode(_multi(F.col("b.data"), _u16(F.col("main_data"), 2))).alias("seq", "data"))
    header = F.rpad(F.hex("xid"), 2 * TUPLE_HEADER, "0")  # stands for the header that such a tuple lacks
    return one.unionByName(parsed.select(*base, "seq", F.lit("INSERT").alias("op"), "rel", "block", (F.col("seq") + 1).alias("offnum"), F.concat(F.unhex(header), "data").alias("tuple")))


def payload(tuple_bytes: Column) -> Column:
    """A tuple without its header."""
    return F.substring(tuple_bytes, TUPLE_HEADER + 1, 1 << 30)


def _multi(data: Column, count: Column) -> Column:
    """The tuples of a multiple insert, each at an even offset behind a header that begins with its
    length."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<binary>").alias("out"))

    def step(a: Column, _: Column) -> Column:
        at = a["at"] + a["at"] % 2
        size = _u16(data, at)
        return F.struct((at + MULTI_HEADER + size).alias("at"), F.concat(a["out"], F.array(F.substring(data, at + MULTI_HEADER + 1, size))).alias("out"))

    return F.when(count > 0, F.aggregate(F.sequence(F.lit(1), count), start, step, lambda a: a["out"])).otherwise(F.array().cast("array<binary>"))


def endings(records: DataFrame) -> DataFrame:
    """xid, lsn, op (COMMIT or ABORT) of each transaction's end."""
    ends = described(records).where((F.col("rmgr_id") == XACT) & F.col("op").isin("COMMIT", "COMMIT_PREPARED", "ABORT", "ABORT_PREPARED"))
    return ends.select("xid", "lsn", F.when(F.col("op").startswith("COMMIT"), "COMMIT").otherwise("ABORT").alias("op"))


def with_ends(log: DataFrame, stretch: int = SEGMENT) -> DataFrame:
    """A log (xid, lsn, op, ...) with end_lsn and end_op, the next COMMIT or ABORT of its xid. An id
    may come again after its end. A transaction's rows are ordered by stretches of the log, so a long
    one is many tasks; what ends a stretch's last rows comes from the later stretches' first ends."""
    end = F.when(F.col("op").isin("COMMIT", "ABORT"), F.struct(F.col("lsn").alias("end_lsn"), F.col("op").alias("end_op")))
    rows = log.withColumn("__at", F.floor(F.col("lsn") / stretch).cast("long"))
    firsts = rows.groupBy("xid", "__at").agg(F.min(end).alias("__first"))  # a row for each stretch of a transaction
    later = Window.partitionBy("xid").orderBy("__at").rowsBetween(1, Window.unboundedFollowing)
    after = firsts.withColumn("__later", F.first("__first", ignorenulls=True).over(later)).select("xid", "__at", "__later")
    inside = Window.partitionBy("xid", "__at").orderBy("lsn").rowsBetween(1, Window.unboundedFollowing)
    known = rows.withColumn("__end", F.first(end, ignorenulls=True).over(inside)).join(after, ["xid", "__at"])
    found = F.coalesce("__end", "__later")
    return known.select(*log.columns, found["end_lsn"].alias("end_lsn"), found["end_op"].alias("end_op"))


def decoded(log: DataFrame, stretch: int = SEGMENT) -> DataFrame:
    """Changes of committed transactions: xid, commit_lsn, lsn, op, and seq, their order within it.
    They are numbered by stretches of the log, each from the number of changes before it."""
    kept = with_ends(log, stretch).where(F.col("op").isin("INSERT", "UPDATE", "DELETE") & (F.col("end_op") == "COMMIT")).drop("end_op").withColumnRenamed("end_lsn", "commit_lsn")
    order = [c for c in ("lsn", "seq") if c in log.columns]
    rows = kept.withColumn("__at", F.floor(F.col("lsn") / stretch).cast("long"))
    group = ["xid", "commit_lsn"]
    counts = rows.groupBy(*group, "__at").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__at")) - F.col("__n")
    number = F.row_number().over(Window.partitionBy(*group, "__at").orderBy(*order))
    joined = rows.withColumn("__k", number).join(counts.withColumn("__before", before).drop("__n"), [*group, "__at"])
    return joined.withColumn("seq", (F.col("__k") + F.col("__before")).cast("long")).drop("__k", "__before", "__at")


def pending(log: DataFrame) -> DataFrame:
    """Open transactions and their number of changes."""
    opened = with_ends(log).where(F.col("op").isin("INSERT", "UPDATE", "DELETE") & F.col("end_lsn").isNull())
    return opened.groupBy("xid").agg(F.count("*").alias("n_changes"))


def log_of(records: DataFrame) -> DataFrame:
    """Changes and endings as one log."""
    return changes(records).unionByName(endings(records), allowMissingColumns=True)


def states(records: DataFrame) -> DataFrame:
    """(xid, state) by the last ending of each id."""
    return endings(records).groupBy("xid").agg(F.max_by(F.when(F.col("op") == "COMMIT", mvcc.COMMITTED).otherwise(mvcc.ABORTED), "lsn").alias("state"))


def redo_pages(records: DataFrame, registry: dict[int, Manager] = REGISTRY) -> DataFrame:
    """Each block after replay (`blocks.PAGES`). Each record applies once however often it comes; a
    page image takes the place of all that its block held before. Records of managers that aren't
    applied or are unknown are skipped."""
    return blocks.redone(records, {k: m.redo or _images_only for k, m in registry.items() if m.applied})


def redo(records: DataFrame, registry: dict[int, Manager] = REGISTRY) -> DataFrame:
    """Row versions after replay: rel, fork, block, offnum, xmin, xmax, cid, tuple, lsn.

    The last insert at a place wins; a delete, or an update for its old place, sets xmax there, which
    counts once it commits. Rows of a page image have the transactions that their headers name.
    Places that pruning or vacuum freed hold no row.
    """
    return blocks.rows_of(redo_pages(records, registry))


def recovered(records: DataFrame, snapshot: mvcc.Snapshot | None = None) -> DataFrame:
    """Rows that are there after a crash: what committed, seen by a snapshot after all of it."""
    rows = mvcc.with_states(redo(records), states(records))
    return rows.where(mvcc.visible_now() if snapshot is None else mvcc.visible(snapshot)).drop("state_min", "state_max")
