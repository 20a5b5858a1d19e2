"""Operators over generated rows with closed-form results, plans, and agreement of strategies."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import bytes as raw
from tessera.functions import lsn
from tessera.operators import relational as R
from tessera.operators import versioned
from tessera.plans import eviction, inspect
from tessera.sources import layout
from tessera.sources.tables import work_path

SF = "/root/testdata/sf0.01"


def fixture(spark, n, **columns):
    return spark.range(n).select(*(F.expr(x).cast("long").alias(k) for k, x in columns.items()))


@pytest.fixture(scope="module")
def sales(spark):
    return fixture(spark, 100, region="id % 4", category="id % 5", revenue="(id % 5 + 1) * (id + 1) * 10")


@pytest.fixture(scope="module")
def orders(spark):
    return lambda n: fixture(spark, n, order_id="id", customer_id="id % 10", amount="(id + 1) * 97")


@pytest.fixture(scope="module")
def customers(spark):
    return fixture(spark, 10, customer_id="id", tier="id % 3")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_group_by(sales):
    groups = R.group(sales.where("region = 1"), ["category"], F.count("*").alias("n"), F.sum("revenue").alias("s"), F.min("revenue"), F.max("revenue"))
    assert rows(R.ordered(groups, F.desc("s"), ties=["category"])) == [(4, 5, 12500, 500, 4500), (3, 5, 10800, 560, 3760), (2, 5, 8700, 540, 2940), (1, 5, 4200, 40, 1640), (0, 5, 2300, 60, 860)]


def test_aggregates(spark):
    agg = fixture(spark, 10, category="id % 5", score="3 * id", id="id")
    assert dict(rows(R.group(agg, ["category"], F.sum("score")))) == {c: (2 * c + 5) * 3 for c in range(5)}
    assert rows(R.group(agg.where("category < 2"), ["category"], F.min("score"), F.max("score")).orderBy("category")) == [(0, 0, 15), (1, 3, 18)]
    assert rows(R.group(agg.where("false"), [], F.count("*"))) == []
    assert [r[0] for r in rows(R.in_first_seen_order(agg.orderBy(F.desc("id")), ["category"], -F.col("id"), F.count("*")))] == [4, 3, 2, 1, 0]

    def spread(x: pd.Series) -> int:
        return int(x.max() - x.min())

    assert rows(agg.groupBy().agg(R.custom_aggregate(spread, "long", "score"))) == [(27,)]


def test_sum_overflow(spark):
    big = spark.createDataFrame([(2**63 - 1,), (1,), (1,)], "x long")
    assert rows(big.agg(R.wrapped_sum(F.col("x")))) == [(-(2**63) + 1,)]
    with pytest.raises(Exception, match="overflow"):
        big.agg(F.sum("x")).collect()


def test_product_overflow(spark, tmp_path):
    """Products beyond 64 bits wrap as well, at the ends of the range and in the query over large keys."""
    ends = [-(2**63), -(2**63) + 1, -3, -1, 0, 1, 7, 2**32, 2**63 - 1]
    pairs = spark.createDataFrame([(a, b) for a in ends for b in ends], "a long, b long")
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    assert {tuple(r) for r in pairs.select("a", "b", R.wrapped_product(F.col("a"), F.col("b"))).collect()} == {(a, b, wrap(a * b)) for a in ends for b in ends}
    keys = [9_000_000, 2_305_843, 2_305_844, -9_000_000, 5, 2**62]
    spark.createDataFrame([(k, "OF"[k % 2]) for k in keys], "l_orderkey long, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(s, wrap(sum(k * 4_000_000_000_000 for k in keys if "OF"[k % 2] == s))) for s in "OF"}
    assert {tuple(r) for r in queries.agg_wrapped_sum(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize(("strategy", "node"), [("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin"), ("nested_loop", "CartesianProduct"), ("auto", None)])
def test_join_strategies(spark, orders, customers, strategy, node):
    joined = R.join(orders(90), customers, "customer_id", strategy)
    if node:
        assert inspect.joins(joined) == [node]
    groups = R.group(joined, ["tier"], F.count("*").alias("n"), F.sum("amount").alias("s"))
    assert rows(R.ordered(groups, F.desc("s"), ties=["tier"])) == [(0, 36, 158886), (2, 27, 120474), (1, 27, 117855)]
    assert R.join(orders(60).where("amount > 500"), customers, "customer_id", strategy).count() == 55
    assert R.join(orders(50), customers, "customer_id", strategy).count() == 50


@pytest.mark.parametrize("strategy", ["hash", "merge", "nested_loop"])
def test_merge_fixtures(spark, strategy):
    employees, departments = fixture(spark, 20, emp_id="id", dept_id="id % 5", salary="(id + 1) * 1000"), fixture(spark, 5, dept_id="id", budget="(id + 1) * 10000")
    joined = R.join(employees, departments, "dept_id", strategy)
    assert {r[1] for r in rows(joined.groupBy("dept_id").count())} == {4} and joined.count() == 20
    assert joined.where("budget >= 30000").count() == 12
    three, four = fixture(spark, 3, k="7", a="id"), fixture(spark, 4, k="7", b="id")
    assert R.join(three, four, "k", strategy).count() == 12
    assert R.join(fixture(spark, 3, k="2 * id + 1"), fixture(spark, 5, k="id + 1"), "k", strategy).count() == 3


def test_theta_and_placement(spark, orders, customers):
    some = R.theta_join(fixture(spark, 6, a="id"), fixture(spark, 6, b="id"), F.col("a") < F.col("b"))
    assert some.count() == 15
    before = R.join(orders(60).where("amount > 500"), customers, "customer_id")
    after = R.join(orders(60), customers, "customer_id").where("amount > 500")
    assert sorted(rows(before)) == sorted(rows(after))


def test_broadcast_is_bounded(spark, orders, customers):
    assert inspect.joins(R.broadcast_join(orders(50), customers, "customer_id")) == ["BroadcastHashJoin"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in inspect.joins(R.broadcast_join(orders(50), customers, "customer_id", limit=1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_limits_and_order(spark):
    pipeline = fixture(spark, 100, id="id", score="7 * id", category="id % 5")
    assert [r[0] for r in rows(R.limited(pipeline.where("category = 2").orderBy("id"), 5))] == [2, 7, 12, 17, 22]
    assert R.limited(pipeline, 0).count() == R.limited(pipeline, -3).count() == 100 and R.limited(pipeline, 7).count() == 7
    top = R.top(pipeline, 3, F.desc("score"), ties=["id"])
    assert [r[0] for r in rows(top)] == [99, 98, 97] and "TakeOrderedAndProject" in inspect.physical(top)
    assert R.project(pipeline, "id", drop=F.when(F.col("id") > 50, F.col("id") % 2 == 0)).count() == 51 + 25
    assert pipeline.where("score = 1000000").count() == 0


def test_pushdown(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    hit = R.lookup(orders, "o_custkey", 42).select("o_orderkey", "o_custkey")
    assert "EqualTo(o_custkey,42)" in inspect.pushed_filters(hit)[0] and "o_totalprice" not in inspect.read_columns(hit)[0]
    groups = R.group(orders, ["o_orderstatus"], F.count("*"))
    assert inspect.exchanges(groups) == 1 and "partial_count" in inspect.physical(groups)


def test_bytes(spark):
    df = spark.createDataFrame([(5, -7), (2**32 - 1, 2**63 - 1), (0, -(2**63))], "a long, b long")
    data = df.select(F.concat(raw.big_endian(F.col("a"), 4), raw.big_endian(F.col("b"), 8)).alias("data")).union(spark.createDataFrame([(bytearray(b"short"),)], "data binary"))
    fields = [raw.Field("a", 0, 4), raw.Field("b", 4, 8)]
    assert sorted(rows(raw.decoded(data, "data", fields).select("a", "b"))) == sorted(rows(df))


def test_lsn(spark):
    df = spark.createDataFrame([(0x1_0000_002A,), (0,), (300 * lsn.SEGMENT + 5,)], "x long")
    got = rows(df.select(lsn.text(F.col("x")), lsn.parsed(lsn.text(F.col("x"))), lsn.segment(F.col("x")), lsn.segment_file(F.col("x")), lsn.aligned(F.col("x"))))
    assert got[0] == ("00000001/0000002A", 0x1_0000_002A, 256, "000000010000000100000000", 0x1_0000_0030)
    assert got[2][2:4] == (300, lsn.segment_name(300)) and lsn.segment_name(300) == "00000001000000010000002C"


def test_layout(spark):
    path = work_path(spark, "layout")
    rows_in = fixture(spark, 1000, k="(id * 7919) % 1000", v="id")
    layout.write_clustered(rows_in, path, "k", 4)
    files = spark.read.parquet(path)
    assert layout.file_ranges(files, "k").count() == 4 and layout.violations(files, "k").count() == 0
    rows_in.repartition(3).write.mode("overwrite").parquet(path)
    assert {r.kind for r in layout.violations(spark.read.parquet(path), "k").collect()} == {"overlap", "order"}


def test_bucketed_joins_do_not_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("bucketed_a", "bucketed_b"):
            layout.write_bucketed(fixture(spark, 100, k="id", v="id"), name, "k", 4)
        joined = spark.table("bucketed_a").join(spark.table("bucketed_b"), "k")
        assert joined.count() == 100 and inspect.exchanges(joined) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucketed_a", "bucketed_b"):
            spark.sql(f"drop table if exists {name}")


def test_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 2048), (2, "é" * 3000), (3, "ab" * 2000)], "k long, v string")
    pieces = versioned.chunks(df, "k", "v")
    assert sorted((r.k, r.chunk_seq, len(r.chunk)) for r in pieces.collect()) == [(2, 0, 2000), (2, 1, 2000), (2, 2, 2000), (3, 0, 2000), (3, 1, 2000)]
    assert {r.k: bytes(r.value).decode() for r in versioned.reassembled(pieces, "k").collect()} == {2: "é" * 3000, 3: "ab" * 2000}


def test_eviction(spark):
    trace = spark.createDataFrame([("w", i, b, b == 1) for i, b in enumerate([1, 2, 3, 1, 4, 1, 2])], "workload string, at long, block long, dirty boolean")
    got = {r.policy: (r.hits, r.misses, r.evictions) for r in eviction.simulated(trace, 3).collect()}
    assert got["lru"] == (2, 5, 2) and all(h + m == 7 for h, m, _ in got.values())
    many = eviction.accesses(spark, "hot_set", 20_000, 256).withColumn("workload", F.lit("hot")).unionByName(eviction.accesses(spark, "sequential", 5_000, 256).withColumn("workload", F.lit("seq")))
    ratio = {(r.workload, r.policy): r.hits / (r.hits + r.misses) for r in eviction.simulated(many, 32).collect()}
    assert all(ratio["seq", p] == 0 for p in eviction.POLICIES)
    assert 0.33 < ratio["hot", "lru"] < 0.43 and ratio["hot", "arc"] > ratio["hot", "lru"] + 0.04


def test_observed_counts(spark):
    df, seen = inspect.counted(spark.range(10), "all_rows")
    df.where("id > 3").collect()
    assert seen.get["rows"] == 10
