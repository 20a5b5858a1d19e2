"""Mixing sources to target weights: fixed-length blocks drawn per shard through index permutations."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_BYTES, arrow_schema, mapped, written

#: Words in a block, output shards, rounds of the permutation, parts of a source's word count.
BLOCK, SHARDS, ROUNDS, PARTS = 64, 64, 16, 1024
WEIGHTS, PERCENT, MOST = (5, 2, 1), 150, 2
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights=WEIGHTS, percent: int = PERCENT, most: int = MOST) -> list[float]:
    """Shares of percent % of all sizes by weight; a share above most times its size stops there
    and the rest goes to the others by weight, until none is above."""
    share = [Fraction(0)] * len(sizes)
    left, free = Fraction(percent * sum(sizes), 100), list(range(len(sizes)))
    while free:
        unit = left / sum(weights[i % len(weights)] for i in free)
        over = [i for i in free if unit * weights[i % len(weights)] > most * sizes[i]]
        for i in over or free:
            share[i] = Fraction(most * sizes[i]) if over else unit * weights[i % len(weights)]
        if not over:
            break
        left -= sum(share[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return [float(x) for x in share]


def drawn(quota: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """Slots by shard and source. Each shard's counts are a multinomial draw by what the quotas still
    hold, so shards differ by chance, and all of them together hold each quota."""
    rng, left = np.random.default_rng(seed), np.array(quota, np.int64)
    out = np.zeros((shards, len(quota)), np.int64)
    for shard in range(shards):
        want = int(left.sum()) // (shards - shard)
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[shard] += got
            left -= got
            want -= int(got.sum())
    return out


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix in which each bit of the result depends on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for any n: in each round an index and its mirror image
    about a keyed point change places, or both stay, by a hash of the pair."""
    x = index.astype(np.int64)
    for r in range(ROUNDS):
        salt = mixed_bits(np.array([key * 64 + r + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        mirror = (int(salt[0]) % n - x) % n
        swap = mixed_bits(np.maximum(x, mirror).astype(np.uint64) + salt) & np.uint64(1) == 1
        x = np.where(swap, mirror, x)
    return x


def sized(docs: DataFrame) -> DataFrame:
    """A key of each row (hash of its doc_id, source and text), doc_id, source and size in words."""
    return docs.select(F.xxhash64("doc_id", "source", "text").alias("key"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def placed(rows: DataFrame) -> DataFrame:
    """`rows` with start, the place of its first word in its source's stream of words. A source is
    summed in PARTS parts by hash of the row and the parts one after another, so that no task has
    to hold a large source."""
    cut = rows.withColumn("part", F.pmod("key", F.lit(PARTS)))
    sums = cut.groupBy("source", "part").agg(F.sum("size").alias("total"))
    offset = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.sum("total").over(Window.partitionBy("source").orderBy("part")) - F.col("total")).alias("offset"))
    inside = F.sum("size").over(Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    found = cut.withColumn("inside", inside)
    joined = found.join(offset, found["source"].eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return joined.select("key", "doc_id", "source", "size", (F.col("offset") + F.col("inside")).alias("start"))


def tabled(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's rows by way of Arrow: from a list of rows Spark starts Python workers of another kind, which stay."""
    target = arrow_schema(spark, schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target))


def slots(spark, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(idx, block, shards): the shards that each drawn block goes to, at most MOST. plan: source, its
    blocks, shard, first slot and slots. Slot k of a source is block permutation(k mod n) of pass k div n."""
    piece, tasks = 1 << 16, int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = tabled(spark, plan, "idx int, n long, shard int, start long, count long")
    ranges = ranges.select("idx", "n", "shard", F.explode(F.expr(f"transform(sequence(0L, (count - 1) div {piece}), i -> struct(start + i * {piece} as a, start + least(count, (i + 1) * {piece}) as b))")).alias("r")).select("idx", "n", "shard", "r.a", "r.b").repartition(tasks, "idx", "a")
    schema = pa.schema([("idx", pa.int32()), ("block", pa.int64()), ("shard", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for idx, n, shard, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = np.arange(a, b)
                block = np.empty(len(k), np.int64)
                for turn in range(a // n, (b - 1) // n + 1):
                    now = k // n == turn
                    block[now] = permuted(k[now] % n, n, idx * 4 + turn)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), idx, np.int32)), pa.array(block), pa.array(np.full(len(k), shard, np.int32))], schema=schema)

    return ranges.mapInArrow(run, "idx int, block long, shard int").groupBy("idx", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))


def mixture(docs: DataFrame, weights=WEIGHTS, percent: int = PERCENT, shards: int = SHARDS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows (key, doc_id, source, size, start, idx, source_size, target) and drawn parts of them
    (idx, start, first, last, shards): words first to last (exclusive) of the row that starts there,
    and the output shards that they go to.

    Null sources are a source, the last one; null texts have no words; sources without words have
    the target 0. Rows that are equal in all columns have places of their own; columns other than
    doc_id, source and text don't matter; an empty table gives nothing. Only one row for
    each source comes to the driver.
    """
    spark = docs.sparkSession
    rows = written(sized(docs), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("total")).collect()
    order = sorted(((r.source is None, r.source or "", r.total) for r in sums))
    sizes = [x[2] for x in order]
    goal = targets(sizes, weights, percent)
    blocks = [-(-s // BLOCK) for s in sizes]
    quota = [min(MOST * b, round(g * b / s)) if s else 0 for g, b, s in zip(goal, blocks, sizes, strict=True)]
    counts = drawn(quota, shards, zlib.crc32(repr((sizes, seed)).encode()))
    first = np.cumsum(counts, 0) - counts
    plan = [(int(i), blocks[i], int(j), int(first[j, i]), int(counts[j, i])) for j, i in zip(*counts.nonzero(), strict=True)]
    table = tabled(spark, [(i, None if null else s, n, g) for i, ((null, s, n), g) in enumerate(zip(order, goal, strict=True))], "idx int, s string, source_size long, target double")
    if sum(len(x[1]) + 32 for x in order) <= BROADCAST_BYTES:  # a row a source
        table = F.broadcast(table)
    whole = written(placed(rows).join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "places")
    cut = whole.where("size > 0").select("idx", "start", "size", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")).alias("block"))
    cut = cut.join(slots(spark, plan).hint("merge"), ["idx", "block"])  # a row a block: Spark takes its size for that of the plan, and would broadcast it
    low, high = F.greatest("start", F.col("block") * BLOCK), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return whole, cut.select("idx", "start", (low - F.col("start")).alias("first"), (high - F.col("start")).alias("last"), "shards")


def taken(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (the output shards that hold words of it, in
    order) of every row. The cases of `mixture` apply; an empty table gives no rows."""
    whole, parts = mixture(docs, seed=seed)
    shards = F.array_union(F.collect_set(F.get("shards", F.lit(0))), F.collect_set(F.get("shards", F.lit(1))))  # no more than there are shards
    words = parts.groupBy("idx", "start").agg(F.sum((F.col("last") - F.col("first")) * F.size("shards")).alias("taken"), F.sort_array(shards).alias("shards"))
    some = whole.where("size > 0").join(words, ["idx", "start"], "left")
    out = some.unionByName(whole.where("size = 0"), allowMissingColumns=True)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def sharded(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix by output shard: shard, doc_id, source, first, last: words first to last (exclusive) of
    the row go to the shard. Rows with the same id keep apart by their own columns key and start."""
    whole, parts = mixture(docs, seed=seed)
    rows = whole.where("size > 0").select("idx", "start", "key", "doc_id", "source")
    return parts.join(rows, ["idx", "start"]).select(F.explode("shards").alias("shard"), "doc_id", "source", "first", "last", "key", "start")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of `docs` of which the mix takes words, with the taken words as text (its n_chars
    follow, if there is such a column): a part taken twice comes a second time after all others."""
    whole, parts = mixture(docs)
    lists = parts.groupBy("idx", "start").agg(F.sort_array(F.collect_list(F.struct("first", "last", F.size("shards").alias("times")))).alias("__parts"))  # of one row's blocks
    same = Window.partitionBy("__key", "__of")
    chosen = whole.where("size > 0").join(lists, ["idx", "start"]).select(F.col("key").alias("__key"), F.col("doc_id").alias("__of"), F.row_number().over(Window.partitionBy("key", "doc_id").orderBy("start")).alias("__copy"), "__parts")
    rows = docs.withColumns({"__key": F.xxhash64("doc_id", "source", "text"), "__of": F.col("doc_id")}).withColumn("__copy", F.row_number().over(same.orderBy("__of")))
    named = chosen.withColumnsRenamed({"__key": "__k", "__of": "__o", "__copy": "__c"})
    joined = rows.join(named, (F.col("__key") == F.col("__k")) & F.col("__of").eqNullSafe(F.col("__o")) & (F.col("__copy") == F.col("__c")))
    names, at = docs.columns, docs.columns.index("text")

    def text_of(*values) -> tuple:
        words = re.findall(WORD, values[at] or "")
        spans = values[-1]
        out = [" ".join(words[p["first"] : p["last"]]) for k in range(max(p["times"] for p in spans)) for p in spans if p["times"] > k]
        text = " ".join(out)
        row = list(values[:-1])
        row[at] = text
        if "n_chars" in names:
            row[names.index("n_chars")] = len(text)
        return tuple(row)

    return mapped(joined.select(*names, "__parts"), text_of, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and the shards it goes to (comma-joined). Null, empty and
    very long texts, null sources, repeated rows, empty tables, further columns: see `mixture`."""
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("shards", F.array_join("shards", ","))
