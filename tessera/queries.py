"""The engine's queries over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import bytes as raw
from tessera.functions import lsn
from tessera.operators import blocks, mvcc, relational, replay, versioned
from tessera.plans import eviction, inspect
from tessera.sources import layout, pages, wal
from tessera.sources.tables import table, work_path
from tessera.streaming import decode

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def cents() -> Column:
    """Money as whole numbers, whose sums don't depend on order."""
    return F.round(F.col("o_totalprice") * 100).cast("long")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# Scans, projections, filters


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
def seq_scan(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("select o_orderkey, o_custkey from orders where o_totalprice > 250000")
def filter(spark, d):  # noqa: A001
    return relational.select_where(table(spark, d, "orders"), F.col("o_totalprice") > 250000, "o_orderkey", "o_custkey")


@query("select o_orderkey * 10 as tenfold, o_custkey % 7 as slot, upper(o_orderpriority) as priority from orders")
def project(spark, d):
    return relational.project(table(spark, d, "orders"), (F.col("o_orderkey") * 10).alias("tenfold"), (F.col("o_custkey") % 7).alias("slot"), F.upper("o_orderpriority").alias("priority"))


@query("select o_orderkey, o_custkey from orders where o_custkey % 3 <> 0")
def project_drop(spark, d):
    return relational.project(table(spark, d, "orders"), "o_orderkey", "o_custkey", drop=F.col("o_custkey") % 3 == 0)


@query("select o_custkey as customer, cast(-o_orderkey as bigint) as negated from orders where o_orderkey % 2 = 0")
def project_schema(spark, d):
    data = F.concat(raw.big_endian(F.col("o_custkey"), 4), F.when(F.col("o_orderkey") % 2 == 0, raw.big_endian(-F.col("o_orderkey"), 8)).otherwise(F.unhex(F.lit(""))))
    rows = table(spark, d, "orders").select(data.alias("data"))
    return raw.decoded(rows, "data", [raw.Field("customer", 0, 4), raw.Field("negated", 4, 8)]).select("customer", "negated")


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey = 42")
def index_scan_eq(spark, d):
    return relational.lookup(table(spark, d, "orders"), "o_custkey", 42).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("select o_custkey, count(*) as n_found from orders where o_custkey in (42, 43) group by o_custkey")
def search_all(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", F.col("_metadata.row_index").alias("at"))
    hits = relational.lookup(orders, "o_custkey", 42).unionByName(relational.lookup(orders, "o_custkey", 43))
    return relational.group(hits, ["o_custkey"], F.countDistinct("at").alias("n_found"))


@query("select 'files' as fact, cast(8 as bigint) as n union all select 'rows', count(*) from orders union all select 'violations', cast(0 as bigint)")
def layout_invariants(spark, d):
    path = work_path(spark, "clustered")
    layout.write_clustered(table(spark, d, "orders").select("o_orderkey", "o_custkey"), path, "o_orderkey", 8)
    files = spark.read.parquet(path)
    ranges = layout.file_ranges(files, "o_orderkey")
    facts = ranges.agg(F.count("*").alias("files"), F.sum("n_rows").alias("rows")).select(F.expr("stack(2, 'files', files, 'rows', rows) as (fact, n)"))
    return facts.unionByName(layout.violations(files, "o_orderkey").agg(F.count("*").alias("n")).select(F.lit("violations").alias("fact"), "n"))


# Order and limits


@query("select c_custkey, c_mktsegment, cast(row_number() over (order by c_mktsegment, c_custkey) as bigint) as place from customer")
def sort(spark, d):
    # places need one order over all rows: ids rise with the sorted partitions, and each partition's count shifts the next
    rows = relational.ordered(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ties=["c_custkey"]).withColumn("at", F.monotonically_increasing_id())
    path = work_path(spark, "sorted")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path).withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    # the number of partitions bounds this window
    before = counts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, "part").select("c_custkey", "c_mktsegment", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


@query("select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents from orders order by cents desc, o_orderkey limit 100")
def sort_desc(spark, d):
    return relational.top(table(spark, d, "orders").select("o_orderkey", cents().alias("cents")), 100, F.desc("cents"), ties=["o_orderkey"])


@query("select count(*) as n from region")
def limit(spark, d):
    return relational.limited(table(spark, d, "region"), 0).agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey, o_orderpriority from orders order by o_totalprice desc, o_orderkey limit 10")
def topk(spark, d):
    return relational.top(table(spark, d, "orders"), 10, F.desc("o_totalprice"), ties=["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderpriority")


# Aggregates


@query("""select o_orderstatus, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as total, min(cast(round(o_totalprice * 100) as bigint)) as least,
  max(cast(round(o_totalprice * 100) as bigint)) as most from orders group by o_orderstatus""")
def hash_agg(spark, d):
    return relational.group(table(spark, d, "orders"), ["o_orderstatus"], F.count("*").alias("n"), F.sum(cents()).alias("total"), F.min(cents()).alias("least"), F.max(cents()).alias("most"))


@query("select event_type, count(*) as n from events group by event_type")
def agg_count(spark, d):
    return relational.group(table(spark, d, "events"), ["event_type"], F.count("*").alias("n"))


@query("select l_returnflag, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as total from lineitem group by l_returnflag")
def agg_sum(spark, d):
    return relational.group(table(spark, d, "lineitem"), ["l_returnflag"], F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("total"))


@query("select p_brand, min(p_size) as least, max(p_size) as most from part group by p_brand")
def agg_min_max(spark, d):
    return relational.group(table(spark, d, "part"), ["p_brand"], F.min("p_size").alias("least"), F.max("p_size").alias("most"))


@query("select cast(count(*) as bigint) as n from (select 1 as k from orders where o_totalprice < -1 group by 1) x")
def agg_empty(spark, d):
    return relational.group(table(spark, d, "orders").where("o_totalprice < -1"), [], F.count("*").alias("n")).agg(F.count("*").alias("n"))


@query("select event_type, count(*) as n, min(event_id) as first_id from events group by event_type")
def agg_first_seen(spark, d):
    return relational.in_first_seen_order(table(spark, d, "events"), ["event_type"], F.col("event_id"), F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""select l_linestatus, cast(case when m >= 9223372036854775808::hugeint then m - 18446744073709551616::hugeint else m end as bigint) as total from (
  select l_linestatus, ((sum(cast(l_orderkey as hugeint) * 4000000000000) % 18446744073709551616::hugeint) + 18446744073709551616::hugeint) % 18446744073709551616::hugeint as m from lineitem group by l_linestatus) x""")
def agg_wrapped_sum(spark, d):
    return relational.group(table(spark, d, "lineitem"), ["l_linestatus"], relational.wrapped_sum(relational.wrapped_product(F.col("l_orderkey"), F.lit(4_000_000_000_000))).alias("total"))


@query("select c_nationkey, cast(bit_xor(c_custkey) as bigint) as mixed from customer group by c_nationkey")
def agg_custom(spark, d):
    from functools import reduce
    from operator import xor

    def mixed(keys: pd.Series) -> int:
        return reduce(xor, map(int, keys), 0)

    return table(spark, d, "customer").groupBy("c_nationkey").agg(relational.custom_aggregate(mixed, "long", "c_custkey").alias("mixed"))


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
def agg_having(spark, d):
    return relational.group(table(spark, d, "orders"), ["o_custkey"], F.count("*").alias("n")).where("n > 12")


FLAGSHIP = """select o_orderpriority, count(*) as n_orders, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as total, min(cast(round(o_totalprice * 100) as bigint)) as least,
  max(cast(round(o_totalprice * 100) as bigint)) as most from orders where o_orderstatus = 'F' group by o_orderpriority"""


@query(FLAGSHIP)
def group_by_sorted(spark, d):
    rows = table(spark, d, "orders").where(F.col("o_orderstatus") == "F")
    groups = relational.group(rows, ["o_orderpriority"], F.count("*").alias("n_orders"), F.sum(cents()).alias("total"), F.min(cents()).alias("least"), F.max(cents()).alias("most"))
    return relational.ordered(groups, F.desc("total"), ties=["o_orderpriority"])


# Joins


@query("select n_nationkey, r_regionkey from nation join region on n_nationkey < r_regionkey + 3")
def nested_loop_join_theta(spark, d):
    return relational.theta_join(table(spark, d, "nation"), table(spark, d, "region"), F.col("n_nationkey") < F.col("r_regionkey") + 3).select("n_nationkey", "r_regionkey")


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def nested_loop_join_equi(spark, d):
    return relational.join(table(spark, d, "nation"), table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "nested_loop").select("n_name", "r_name")


def _orders_customers(spark, d, strategy):
    outer = table(spark, d, "orders").where("o_totalprice > 400000")
    return relational.join(outer, table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), strategy).select("o_orderkey", "c_name")


JOINED = "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 400000"


@query(JOINED)
def hash_join(spark, d):
    return _orders_customers(spark, d, "hash")


@query(JOINED)
def broadcast_join(spark, d):
    outer = table(spark, d, "orders").where("o_totalprice > 400000")
    return relational.broadcast_join(outer, table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query(JOINED)
def merge_join(spark, d):
    return relational.ordered(_orders_customers(spark, d, "merge"), "o_orderkey", ties=["c_name"])


@query("select s_suppkey, c_custkey from supplier join customer on s_nationkey = c_nationkey")
def merge_join_many_to_many(spark, d):
    return relational.join(table(spark, d, "supplier"), table(spark, d, "customer"), F.col("s_nationkey") == F.col("c_nationkey"), "merge").select("s_suppkey", "c_custkey")


@query("select o_orderkey, c_custkey, case when c_acctbal < 0 then 'debit' else 'credit' end as side from orders join customer on o_custkey = c_custkey where c_acctbal is not null and c_nationkey <> 3")
def join_combine(spark, d):
    joined = relational.join(table(spark, d, "orders"), table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    side = F.when(F.col("c_acctbal") < 0, "debit").otherwise("credit").alias("side")
    return relational.combined(joined, "o_orderkey", "c_custkey", side, drop=F.col("c_acctbal").isNull() | (F.col("c_nationkey") == 3))


@query("""select c_mktsegment, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as total from orders join customer on o_custkey = c_custkey
  where o_totalprice > 100000 group by c_mktsegment""")
def join_group_sort(spark, d):
    joined = relational.join(table(spark, d, "orders").where("o_totalprice > 100000"), table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return relational.ordered(relational.group(joined, ["c_mktsegment"], F.count("*").alias("n"), F.sum(cents()).alias("total")), F.desc("total"), ties=["c_mktsegment"])


# Snapshots over versions derived from lineitem

SNAPSHOT = mvcc.Snapshot(70, 40, 70, (44, 45, 55, 70), 2)
_VERSIONS = """ver as (select l_orderkey as rid, l_linenumber as ln, cast(case when l_partkey % 50 = 0 then 2 when l_partkey % 50 = 1 then 0 when l_partkey % 50 = 2 then 70 else l_partkey % 97 + 3 end as bigint) as xmin,
  cast(case when l_suppkey % 9 = 0 then 70 when l_suppkey % 3 = 0 then l_partkey % 89 + 20 else 0 end as bigint) as xmax, cast(l_linenumber % 4 as bigint) as cid from lineitem)"""
_STATES = """txn as (select xid, case when xid = 70 then 'in_progress' when xid % 7 = 0 then 'aborted' when xid % 11 = 0 then 'in_progress' else 'committed' end as state
  from (select distinct xmin as xid from ver union select distinct xmax from ver) u where xid > 2 and xid % 23 <> 0)"""
_WITH = f"""with {_VERSIONS}, {_STATES},
j as (select v.*, case when v.xmin = 0 then 'aborted' when v.xmin = 2 then 'committed' else coalesce(a.state, 'in_progress') end as state_min,
  case when v.xmax = 0 then 'aborted' when v.xmax = 2 then 'committed' else coalesce(b.state, 'in_progress') end as state_max
  from ver v left join txn a on v.xmin = a.xid left join txn b on v.xmax = b.xid)"""
_SEES = "({0} <> 0 and ({0} = 2 or {0} = 70 or ({0} < 70 and ({0} < 40 or {0} not in (44, 45, 55, 70)))))"
_BORN = f"(xmin <> 0 and (xmin = 2 or (state_min = 'committed' and {_SEES.format('xmin')}) or (state_min = 'in_progress' and xmin = 70)))"
_OUTCOME = f"""case when not {_BORN} then 'invisible' when xmin = 70 and cid >= 2 then 'invisible' when xmin = 70 and xmax = 0 then 'inserted_by_self' when xmin = 70 and xmax = 70 then 'deleted_by_self'
  when xmax = 0 then 'visible' when xmax = 70 then 'being_deleted' when state_max = 'committed' and {_SEES.format('xmax')} then 'deleted' else 'visible' end"""


def _versions(spark, d):
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    xmin = F.when(part % 50 == 0, 2).when(part % 50 == 1, 0).when(part % 50 == 2, 70).otherwise(part % 97 + 3).cast("long")
    xmax = F.when(supplier % 9 == 0, 70).when(supplier % 3 == 0, part % 89 + 20).otherwise(0).cast("long")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rid"), F.col("l_linenumber").alias("ln"), xmin.alias("xmin"), xmax.alias("xmax"), (F.col("l_linenumber") % 4).cast("long").alias("cid"))


def _states(spark, d):
    rows = _versions(spark, d)
    ids = rows.select(F.col("xmin").alias("xid")).union(rows.select("xmax")).distinct().where("xid > 2 and xid % 23 <> 0")
    state = F.when(F.col("xid") == 70, mvcc.RUNNING).when(F.col("xid") % 7 == 0, mvcc.ABORTED).when(F.col("xid") % 11 == 0, mvcc.RUNNING).otherwise(mvcc.COMMITTED)
    path = work_path(spark, "states")
    ids.select("xid", state.alias("state")).write.parquet(path)  # read twice by each query
    return spark.read.schema("xid long, state string").parquet(path)


@query(f"{_WITH} select rid, ln, xmin, xmax from j where {_OUTCOME} in ('visible', 'inserted_by_self')")
def mvcc_snapshot_scan(spark, d):
    return mvcc.scan(_versions(spark, d), _states(spark, d), SNAPSHOT).select("rid", "ln", "xmin", "xmax")


@query(f"{_WITH} select {_OUTCOME} as outcome, count(*) as n from j group by 1")
def mvcc_classify(spark, d):
    rows = mvcc.with_states(_versions(spark, d), _states(spark, d))
    return rows.groupBy(mvcc.outcome(SNAPSHOT).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"{_WITH} select rid, ln, xmin, xmax from j where state_min <> 'aborted' and (xmax = 0 or state_max = 'aborted')")
def mvcc_dirty(spark, d):
    return mvcc.with_states(_versions(spark, d), _states(spark, d)).where(mvcc.visible_dirty()).select("rid", "ln", "xmin", "xmax")


@query(f"{_WITH} select rid, ln, xmin, xmax from j where state_min = 'committed' and (xmax = 0 or state_max <> 'committed')")
def mvcc_now(spark, d):
    return mvcc.with_states(_versions(spark, d), _states(spark, d)).where(mvcc.visible_now()).select("rid", "ln", "xmin", "xmax")


@query(f"with {_VERSIONS} select rid, ln, xmin, xmax from ver")
def mvcc_any(spark, d):
    return _versions(spark, d).select("rid", "ln", "xmin", "xmax")


@query(f"{_WITH} select rid, ln, xmin, xmax from j where rid in (1, 7, 42) and {_OUTCOME} in ('visible', 'inserted_by_self')")
def heap_fetch(spark, d):
    return mvcc.scan(_versions(spark, d).where(F.col("rid").isin(1, 7, 42)), _states(spark, d), SNAPSHOT).select("rid", "ln", "xmin", "xmax")


_DEAD = "(xmax <> 0 and state_max = 'committed' and xmax < 60)"


@query(f"{_WITH} select rid, ln, xmin, xmax from j where not {_DEAD}")
def vacuum_dead(spark, d):
    return versioned.vacuumed(_versions(spark, d), _states(spark, d), 60, freeze_age=60)[0].select("rid", "ln", "xmin", "xmax")


@query(f"{_WITH} select cast(case when state_min = 'committed' and xmin > 2 and xmin < 50 then 2 else xmin end as bigint) as xmin, count(*) as n from j where not {_DEAD} group by 1")
def vacuum_freeze(spark, d):
    return versioned.vacuumed(_versions(spark, d), _states(spark, d), 60, freeze_age=10)[0].groupBy("xmin").agg(F.count("*").alias("n"))


@query(f"{_WITH} select count(*) filter (where {_DEAD} or state_min = 'aborted') as removed, count(*) filter (where not ({_DEAD} or state_min = 'aborted') and state_min = 'committed' and xmin > 2 and xmin < 50) as frozen, count(*) filter (where not ({_DEAD} or state_min = 'aborted')) as remaining from j")
def vacuum_full(spark, d):
    return versioned.vacuumed(_versions(spark, d), _states(spark, d), 60, freeze_age=10, reclaim_aborted=True)[1]


@query(f"{_WITH} select count(*) filter (where {_DEAD}) as dead, count(*) filter (where not {_DEAD}) as live, count(*) filter (where {_DEAD}) * 4 > count(*) as due from j")
def dead_ratio(spark, d):
    return versioned.dead_ratio(_versions(spark, d), _states(spark, d), 60)


# Versioned writes


def _customers(spark, d):
    txns = mvcc.Transactions()
    rows = versioned.VersionedTable.create(spark, "c_custkey long, c_nationkey int")
    first = txns.begin()
    rows.insert(table(spark, d, "customer").select("c_custkey", "c_nationkey"), first)
    txns.commit(first)
    return txns, rows


@query("select c_custkey, c_nationkey from customer")
def dml_insert(spark, d):
    txns, rows = _customers(spark, d)
    lost = txns.begin()
    rows.insert(spark.createDataFrame([(-1, 0)], rows.payload), lost)
    txns.abort(lost)
    return rows.scan(txns, txns.snapshot(txns.begin())).select("c_custkey", "c_nationkey")


@query("select c_custkey, c_nationkey from customer where c_nationkey % 4 <> 1")
def dml_delete(spark, d):
    txns, rows = _customers(spark, d)
    for end, rest in ((txns.commit, 1), (txns.abort, 2)):
        xid = txns.begin()
        rows.delete(rows.scan(txns, txns.snapshot(xid)).where(F.col("c_nationkey") % 4 == rest), xid)
        end(xid)
    return rows.scan(txns, txns.snapshot(txns.begin())).select("c_custkey", "c_nationkey")


@query("select c_custkey, cast(case when c_nationkey < 5 then c_nationkey + 100 else c_nationkey end as int) as c_nationkey, cast(case when c_nationkey < 5 then 2 else 1 end as bigint) as version from customer")
def dml_update(spark, d):
    txns, rows = _customers(spark, d)
    xid = txns.begin()
    rows.update(rows.scan(txns, txns.snapshot(xid)).where("c_nationkey < 5").withColumn("c_nationkey", F.col("c_nationkey") + 100), xid)
    txns.commit(xid)
    rows.vacuum(txns)
    return rows.scan(txns, txns.snapshot(txns.begin())).select("c_custkey", "c_nationkey", "version")


@query("select doc_id, cast(s as bigint) as chunk_seq, cast(greatest(0, least(2000, octet_length(encode(text)) - 2000 * s)) as bigint) as n_bytes from (select doc_id, text, unnest(range(0, (octet_length(encode(text)) - 1) // 2000 + 1)) as s from documents where octet_length(encode(text)) > 2048) x")
def toast_chunks(spark, d):
    return versioned.chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_seq", F.octet_length("chunk").cast("long").alias("n_bytes"))


@query("select doc_id, md5(text) as digest from documents where octet_length(encode(text)) > 2048")
def toast_detoast(spark, d):
    return versioned.reassembled(versioned.chunks(table(spark, d, "documents"), "doc_id", "text"), "doc_id").select("doc_id", F.md5("value").alias("digest"))


# Logs: events as a log of row changes, commits and aborts

_LOG = """log as (select event_id * 8 + 40 as lsn, user_id as xid, case event_type when 'click' then 'INSERT' when 'view' then 'UPDATE' when 'signup' then 'DELETE' when 'purchase' then 'COMMIT' else 'ABORT' end as op from events),
t as (select *, min(case when op in ('COMMIT', 'ABORT') then lsn end) over (partition by xid order by lsn rows between 1 following and unbounded following) as end_lsn from log)"""
DECODED = f"""with {_LOG}, e as (select t.xid, t.lsn, t.op, t.end_lsn as commit_lsn from t join log k on k.lsn = t.end_lsn and k.op = 'COMMIT' where t.op in ('INSERT', 'UPDATE', 'DELETE'))
select xid, commit_lsn, lsn, op, cast(row_number() over (partition by xid, commit_lsn order by lsn) as bigint) as seq from e"""


def _log(spark, d):
    op = F.expr("case event_type when 'click' then 'INSERT' when 'view' then 'UPDATE' when 'signup' then 'DELETE' when 'purchase' then 'COMMIT' else 'ABORT' end")
    return table(spark, d, "events").select((F.col("event_id") * 8 + 40).alias("lsn"), F.col("user_id").alias("xid"), op.alias("op"))


@query(DECODED)
def logical_decode(spark, d):
    return replay.decoded(_log(spark, d)).select("xid", "commit_lsn", "lsn", "op", "seq")


@query(f"with {_LOG} select xid, count(*) as n_changes from t where op in ('INSERT', 'UPDATE', 'DELETE') and end_lsn is null group by xid")
def logical_pending(spark, d):
    return replay.pending(_log(spark, d))


@query(DECODED)
def logical_stream(spark, d):
    """The same changes from a stream that takes in one file of the log at a time."""
    source, out, state = (work_path(spark, x) for x in ("log", "changes", "state"))
    log, cut = _log(spark, d), work_path(spark, "stretches")
    low, last = log.agg(F.min("lsn"), F.max("lsn")).first()
    log.withColumn("stretch", F.expr(f"(lsn - {low or 0}) div {1 << 20}")).write.partitionBy("stretch").parquet(cut)  # the table is read once, not once a stretch
    for at in range(1 if last is None else (last - low >> 20) + 1):  # in log order, one file for each stretch of the log
        spark.read.schema(f"{log._jdf.schema().toDDL()}, stretch long").parquet(cut).where(F.col("stretch") == at).select(*log.columns).coalesce(1).write.mode("append").parquet(source)
    provider, width = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before, wide = spark.conf.get(provider, None), spark.conf.get(width)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(width, min(int(wide), spark.sparkContext.defaultParallelism))  # each part has a store that every batch opens and commits
    try:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
        run = decode.decoded(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
        spark.conf.set(width, wide)
    return spark.read.schema(decode.OUTPUT).parquet(out)


@query(r"""select event_id, printf('%08X/%08X', (event_id * 3000017) >> 32, (event_id * 3000017) & 4294967295) as lsn_text, (event_id * 3000017) // 16777216 as segment, (event_id * 3000017) % 16777216 as at,
  printf('%08X%08X%08X', 1, (event_id * 3000017) // 16777216 // 256, (event_id * 3000017) // 16777216 % 256) as file_name, event_id * 3000017 as parsed from events""")
def wal_lsn_segments(spark, d):
    at = F.col("event_id") * 3_000_017
    return table(spark, d, "events").select("event_id", lsn.text(at).alias("lsn_text"), lsn.segment(at).alias("segment"), lsn.segment_offset(at).alias("at"), lsn.segment_file(at).alias("file_name"), lsn.parsed(lsn.text(at)).alias("parsed"))


_RMGR = "case event_id % 22 " + " ".join(f"when {k} then '{n}'" for k, n in enumerate(replay.MANAGERS)) + " when 20 then 'Rmgr(20)' else 'Rmgr(21)' end"
_OP = "case " + " ".join(f"when event_id % 22 = {m} and (user_id * 16) % 256 & {mask} = {code} then '{name}'" for m, (mask, names) in replay.OPERATIONS.items() for code, name in names.items()) + " else 'op=0x' || printf('%02X', (user_id * 16) % 256 & 240) end"


def _records(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("event_id") % 22).cast("int").alias("rmgr_id"), (F.col("user_id") * 16 % 256).cast("int").alias("info"), (F.length("props") + 24).cast("long").alias("tot_len"))


@query(f"select event_id, {_RMGR} as rmgr, {_OP} as op from events")
def wal_describe(spark, d):
    return replay.described(_records(spark, d)).select("event_id", "rmgr", "op")


@query(f"select {_RMGR} as rmgr, count(*) filter (where event_id % 22 in (0, 1, 9, 10, 11)) as applied, count(*) filter (where event_id % 22 not in (0, 1, 9, 10, 11)) as skipped, cast(sum(length(props) + 24) as bigint) as bytes from events group by 1")
def wal_rmgr_summary(spark, d):
    return replay.summary(_records(spark, d))


def segments_of(rows, size: int = 1 << 20) -> wal.Segments:
    """Segments with a record for each (xid, op, payload): inserts and deletes of a row a block,
    commits and aborts. A test source; it holds the log on the driver."""
    out = wal.Segments(size=size)
    for block, (xid, op, value) in enumerate(rows):
        if op in ("COMMIT", "ABORT"):
            out.append(wal.Record(replay.XACT, 0x00 if op == "COMMIT" else 0x20, xid))
        else:
            out.append(wal.Record(replay.HEAP, 0x00, xid, struct.pack("<HB", 1, 0), [wal.Block(0, 16384, block, data=bytes(replay.TUPLE_HEADER) + value)]))
    return out


def _nations(spark, d):
    """Each nation is inserted by a transaction of its region; one aborts, one stays open."""
    rows = [(r.n_regionkey + 10, "INSERT", r.n_name.encode()) for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    rows += [(k + 10, "ABORT" if k == 3 else "COMMIT", b"") for k in range(4)]
    folder = work_path(spark, "wal")
    wal.write_segments(spark, segments_of(rows), folder)
    return wal.read_log(spark, folder, size=1 << 20)


@query("select n_name, cast(n_regionkey + 10 as bigint) as xid from nation")
def wal_read(spark, d):
    rows = replay.changes(_nations(spark, d))
    return rows.select(replay.payload(F.col("tuple")).cast("string").alias("n_name"), "xid")


@query("select n_name, cast(n_regionkey + 10 as bigint) as xmin, cast(0 as bigint) as xmax, n_nationkey as block from (select n_name, n_regionkey, cast(row_number() over (order by n_nationkey) - 1 as bigint) as n_nationkey from nation) x")
def wal_redo(spark, d):
    return replay.redo(_nations(spark, d)).select(replay.payload(F.col("tuple")).cast("string").alias("n_name"), "xmin", "xmax", "block")


@query("select n_name from nation where n_regionkey < 3")
def crash_recovery_scan(spark, d):
    return replay.recovered(_nations(spark, d)).select(replay.payload(F.col("tuple")).cast("string").alias("n_name"))


def _log_of_nations(spark, d, records: Callable[[list], list[wal.Record]]) -> DataFrame:
    """Records made of all nations, written as segments and read again."""
    nations = [(r.n_nationkey, r.n_regionkey, r.n_name.encode()) for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    out = wal.Segments(size=1 << 20)
    for r in records(nations):
        out.append(r)
    folder = work_path(spark, "wal")
    wal.write_segments(spark, out, folder)
    return wal.read_log(spark, folder, size=1 << 20)


def _image(block: int, page: bytes, **more) -> wal.Block:
    """A block with a page image without the hole in its middle."""
    hole, size = len(page) // 2, 512 if page[len(page) // 2 : len(page) // 2 + 512] == bytes(512) else 0
    return wal.Block(0, 16384, block, image=page[:hole] + page[hole + size :], hole_offset=hole, hole_length=size, image_flags=wal.APPLY | (wal.HAS_HOLE if size else 0), **more)


@query("select n_name, cast(n_regionkey + 10 as bigint) as xmin, cast(case when n_nationkey % 5 = 1 then 20 else 0 end as bigint) as xmax, cast(n_nationkey + 1 as int) as offnum, n_nationkey % 2 = 0 as from_image from nation")
def wal_redo_images(spark, d):
    """Inserts one by one; in between, an image of the page with all rows so far takes its place; deletes follow."""

    def records(nations):
        rows = [pages.row(region + 10, name) for _, region, name in nations]
        for key, region, _ in nations:
            ref = _image(0, pages.image_of(rows[: key + 1])) if key % 2 == 0 else wal.Block(0, 16384, 0, data=rows[key])
            yield wal.Record(replay.HEAP, 0x00, region + 10, struct.pack("<HB", key + 1, 0), [ref])
        yield wal.Record(replay.XLOG, 0xB0, 0, blocks=[_image(0, pages.image_of(rows))])
        for key, _, _ in nations:
            if key % 5 == 1:
                yield wal.Record(replay.HEAP, 0x10, 20, struct.pack("<IHBB", 20, key + 1, 0, 0), [wal.Block(0, 16384, 0)])

    found = replay.redo(_log_of_nations(spark, d, records))
    return found.select(replay.payload(F.col("tuple")).cast("string").alias("n_name"), "xmin", "xmax", "offnum", (F.col("offnum") % 2 == 1).alias("from_image"))


@query("""select cast(n_regionkey as bigint) as block, cast(row_number() over (partition by n_regionkey order by n_nationkey) as int) as offnum, n_name, true as all_visible,
  case row_number() over (partition by n_regionkey order by n_nationkey) when 1 then 'redirect' when 2 then 'dead' when 4 then 'dead' else 'row' end as state,
  case row_number() over (partition by n_regionkey order by n_nationkey) when 1 then 3 else 0 end as target from nation""")
def wal_redo_heap2(spark, d):
    """A page a region, filled at once; pruning redirects the first place to the third and frees the second; vacuum frees the fourth."""

    def records(nations):
        for region in sorted({r for _, r, _ in nations}):
            data, own = b"", [name for _, r, name in nations if r == region]
            for name in own:
                data += bytes(len(data) % 2) + struct.pack("<HHHB", len(name), 0, 0, 24) + name
            yield wal.Record(replay.HEAP2, 0xD0, 10, struct.pack("<BBH", 0, 0, len(own)), [wal.Block(0, 16384, region, data=data)])
            yield wal.Record(replay.HEAP2, 0x10, 10, struct.pack("<IHH", 9, 1, 1), [wal.Block(0, 16384, region, data=struct.pack("<HHH", 1, 3, 2))])
            yield wal.Record(replay.HEAP2, 0x20, 10, struct.pack("<HH", 1, 4), [wal.Block(0, 16384, region)])
            yield wal.Record(replay.HEAP2, 0x40, 0, blocks=[wal.Block(0, 16384, region)])

    found = replay.redo_pages(_log_of_nations(spark, d, records)).select("block", "all_visible", F.explode("items").alias("i"))
    names = table(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("long").alias("block"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("offnum"))
    state = F.element_at(F.array(*map(F.lit, ("row", "redirect", "dead"))), F.col("i.state"))
    rows = found.select("block", "all_visible", "i.offnum", state.alias("state"), F.col("i.target").alias("target"), replay.payload(F.col("i.tuple")).cast("string").alias("held"))
    return rows.join(names, ["block", "offnum"]).where("held is null or held = n_name").select("block", "offnum", "n_name", "all_visible", "state", "target")


@query("""select cast(case when place > 13 then 1 else 0 end as bigint) as block, cast(case when place > 13 then place - 13 else place end as int) as offnum, n_name as key, cast(0 as bigint) as level,
  cast(case when place > 13 then 0 end as bigint) as before, cast(case when place > 13 then 7 end as bigint) as after from (select n_name, row_number() over (order by n_name) as place from nation) x""")
def wal_redo_btree(spark, d):
    """Names put into a leaf in any order, each at its place; a split moves those after the thirteenth to a new right page,
    and an image has what stays on the left."""

    def records(nations):
        held: list[bytes] = []
        for k, (_, _, name) in enumerate(nations):
            held = sorted([*held, name])
            yield wal.Record(replay.BTREE, 0x08 if k == 0 else 0x00, 10, struct.pack("<H", held.index(name) + 1), [wal.Block(0, 16385, 0, data=pages.entry(name))])
        left = _image(0, pages.image_of([pages.entry(x) for x in held[:13]], level=0, after=1))
        left.rel = 16385
        right = wal.Block(1, 16385, 1, data=b"".join(pages.entry(x) for x in held[13:]))
        yield wal.Record(replay.BTREE, 0x30, 10, struct.pack("<IHHH", 0, 14, 0, 0), [left, right, wal.Block(2, 16385, 7)])

    found = blocks.entries_of(replay.redo_pages(_log_of_nations(spark, d, records)))
    return found.select("block", "offnum", F.col("key").cast("string").alias("key"), "level", "before", F.when(F.col("block") == 1, F.col("after")).alias("after"))


# Instrumentation


@query("select count(*) as seen, count(*) filter (where o_totalprice > 250000) as kept from orders")
def traced_counts(spark, d):
    rows, seen = inspect.counted(table(spark, d, "orders"), "seen")
    kept, left = inspect.counted(rows.where("o_totalprice > 250000"), "kept")
    kept.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], left.get["rows"])], "seen long, kept long")


def _trace(spark, n=20_000):
    parts = [eviction.accesses(spark, p, n, 256).withColumn("workload", F.lit(p)) for p in eviction.PATTERNS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def eviction_policies(spark, d):
    return eviction.simulated(_trace(spark), 32)


@query("select 'hot_set' as workload, true as fair union all select 'random', true union all select 'sequential', true")
def access_patterns(spark, d):
    few = F.avg((F.col("block") < 51).cast("int"))
    want = F.when(F.col("workload") == "hot_set", 0.8).otherwise(51 / 256)
    return _trace(spark).groupBy("workload").agg(few.alias("share")).select("workload", (F.abs(F.col("share") - want) < 0.02).alias("fair"))
