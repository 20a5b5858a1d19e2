"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from functools import partial
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Children of a node, fewest rows meant for a leaf, leaves of the upper tree and of the whole tree at
#: most, rows that the upper tree and each lower one are fitted on at most.
BRANCH, LEAF_ROWS, UPPER, MOST_LEAVES, SAMPLE = 8, 16, 1024, 65_536, 20_000
#: Leaves a query visits before its k-th best score so far bounds what the others may add.
FIRST = 4
#: Rows of a block, queries of a block, queries that calibrate, the recall that they must reach.
BLOCK, QUERIES, CALIBRATION, RECALL = 4096, 512, 128, 0.96


class Tree:
    """Centres by node; a leaf has a number. Vectors get one more component that makes all equally
    long, so that the largest inner product is the smallest distance."""

    def __init__(self, sample: np.ndarray, leaves: int, longest: float, seed: int = 0):
        self.longest, self.rng = longest, np.random.default_rng(seed)
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        centres = [np.zeros(sample.shape[1] + 1)]
        points = self.lifted(sample)
        self.n_leaves = 0
        todo = [(-len(points), 0, np.arange(len(points)))]
        ends = 1
        while todo:  # the largest node is split first
            size, node, own = heapq.heappop(todo)
            parts = self._split(points[own]) if ends < leaves and -size >= 2 * BRANCH else None
            if parts is None:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
                continue
            near, middle = parts
            ends += len(middle) - 1
            for k, centre in enumerate(middle):
                self.children[node].append(len(self.children))
                heapq.heappush(todo, (-int((near == k).sum()), len(self.children), own[near == k]))
                self.children.append([])
                self.leaf.append(-1)
                centres.append(centre)
        self.centres = np.array(centres)

    def grafted(self, lower: dict[int, Tree]) -> None:
        """Leaves become the trees fitted on their rows."""
        for node in [k for k, leaf in enumerate(self.leaf) if leaf in lower]:
            tree, shift = lower[self.leaf[node]], len(self.children) - 1  # its root is the node
            self.children[node] = [k + shift for k in tree.children[0]]
            self.children += [[k + shift for k in own] for own in tree.children[1:]]
            self.leaf += tree.leaf[1:]
            self.centres = np.concatenate([self.centres, tree.centres[1:]])
        ends = [k for k, own in enumerate(self.children) if not own]
        self.leaf, self.n_leaves = [-1] * len(self.children), len(ends)
        for number, node in enumerate(ends):
            self.leaf[node] = number

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))])

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        c = np.unique(x[self.rng.permutation(len(x))[: 4 * BRANCH]], axis=0)
        c = c[self.rng.permutation(len(c))[:BRANCH]]
        if len(c) < 2:
            return None
        for _ in range(12):
            near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
            used = np.unique(near)
            c = np.array([x[near == k].mean(0) for k in used])
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        used, near = np.unique(near, return_inverse=True)
        return (near, c[used]) if len(used) > 1 else None

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector belongs to: the nearest child, from the root down."""
        points, out = self.lifted(x), np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if not self.children[node]:
                out[own] = self.leaf[node]
                continue
            c = self.centres[self.children[node]]
            near = ((c**2).sum(1) - 2 * points[own] @ c.T).argmin(1)
            todo += [(child, own[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves, best bin first: a queue gives the nearest node seen so far."""
        scale = self.longest / max(float(np.sqrt((query**2).sum())), 1e-300)
        q = np.append(query * scale, 0.0)
        queue, out = [(0.0, 0)], []
        distance = ((self.centres - q) ** 2).sum(1)
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf[node])
            for child in self.children[node]:
                heapq.heappush(queue, (float(distance[child]), child))
        return out


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, summed component by component so that equal vectors get equal products."""
    out = np.zeros((len(q), len(x)))
    for d in range(q.shape[1]):
        out += np.multiply.outer(q[:, d], x[:, d])
    return out


def best(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of x for each query, but none below its bound: query ids, ids, scores; ties go to
    the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, score = ids[order], products(q, x[order])
    score[qid[:, None] == ids[None, :]] = -np.inf
    top = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(ids))]
    value = np.take_along_axis(score, top, 1)
    own = (value > -np.inf) & (value >= (-np.inf if bound is None else bound[:, None]))
    return np.repeat(qid, top.shape[1]).reshape(top.shape)[own], ids[top][own], value[own]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part, repeated ones once."""
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null").where(fits).dropDuplicates(["vec_id", "embedding"])
    size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (size.n if size else 0)).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def exact(rows: DataFrame, qid: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Brute force for a bounded number of queries, in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in best(qid, q, part.column("vec_id").to_numpy(), matrix(part.column("v")), k)], schema=FOUND)

    return ranked(rows.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def calibrated(tree: Tree, rows: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
    """Leaves that queries must visit: visits widen until the calibrating queries find `recall` of
    what brute force over all rows finds."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).collect()
    if not some:
        return 1
    qid, q = np.array([r.vec_id for r in some]), np.array([r.v for r in some])
    truth = exact(rows, qid, q, k).join(rows.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()  # k * CALIBRATION rows
    places = {i: {leaf: n for n, leaf in enumerate(tree.visits(x, tree.n_leaves))} for i, x in zip(qid.tolist(), q, strict=True)}
    seen = np.sort([places[r.query_id][r.leaf] for r in truth])
    return int(seen[min(len(seen) - 1, int(np.ceil(recall * len(seen))) - 1)]) + 1 if len(seen) else 1


def packed(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """Blocks of at most `size` rows with equal key: ids and vectors as bytes."""
    target = pa.schema([*((n, pa.int32()) for n in key), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, xs = None, [], []

        def block() -> pa.RecordBatch:
            values = [*at, np.concatenate(ids).tobytes(), np.concatenate(xs).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, target, strict=True)], schema=target)

        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in key], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            own, x = batch.column("vec_id").to_numpy(), matrix(batch.column("v"))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and at is not None and at != keys[a].tolist():
                    yield block()
                    ids, xs = [], []
                for c in range(a, b, size):
                    at = keys[a].tolist()
                    d = min(b, c + size)
                    if sum(map(len, ids)) + d - c > size and ids:
                        yield block()
                        ids, xs = [], []
                    ids.append(own[c:d])
                    xs.append(x[c:d])
        if ids:
            yield block()

    schema = ", ".join([*(f"{n} int" for n in key), "ids binary, vectors binary"])
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def leaves_for(n: int) -> int:
    """The square root of the number of rows, so that neither leaves nor rows in a leaf are many."""
    return max(1, min(MOST_LEAVES, isqrt(n), n // LEAF_ROWS))


def fitted(source: DataFrame, n: int, longest: float) -> Tree:
    """The tree: an upper one of UPPER leaves at most, fitted on SAMPLE rows taken by hash. Beyond that
    many leaves, each leaf gets a tree of its own, fitted on at most SAMPLE of its rows."""
    mark = F.xxhash64("vec_id", "v")
    sample = np.array([r.v for r in source.orderBy(mark, "vec_id").limit(SAMPLE).collect()])
    leaves = leaves_for(n)
    tree = Tree(sample, min(leaves, UPPER), longest)
    each = -(-leaves // tree.n_leaves)
    if each > 1:
        shared = source.sparkSession.sparkContext.broadcast(tree)  # bounded by UPPER
        rows = source.mapInArrow(_assigned(shared), ASSIGNED)
        first = Window.partitionBy("leaf").orderBy(mark, "vec_id")
        some = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE).select("leaf", "v")

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, own = None, []

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pickle.dumps(Tree(np.concatenate(own), each, longest))], pa.binary())], names=["leaf", "tree"])

            for batch in batches:
                leaf, x = batch.column("leaf").to_numpy(), matrix(batch.column("v"))
                cuts = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(leaf)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a < b and now is not None and leaf[a] != now:
                        yield done()
                        own = []
                    if a < b:
                        now = int(leaf[a])
                        own.append(x[a:b])
            if own:
                yield done()

        made = some.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(fit, "leaf int, tree binary").collect()  # MOST_LEAVES centres
        tree.grafted({r.leaf: pickle.loads(r.tree) for r in made})
    return tree


ASSIGNED = "vec_id long, v array<double>, leaf int"


def _assigned(shared) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.leaf_of(matrix(batch.column("v"))))], names=["vec_id", "v", "leaf"])

    return assign


class Found(NamedTuple):
    """Neighbours, the leaves of the tree, and how many of them each query visited."""

    rows: DataFrame
    leaves: int
    visits: int


def searched(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> Found:
    """For each row whose vec_id is divisible by `every` the k nearest of the other rows by inner
    product: query_id, rank, vec_id, score.

    Rows with a null id or a vector that is null, zero, of an unusual length or holds null or
    non-finite components take no part; rows that repeat id and vector count once; equal scores
    go to the smaller id; an empty table gives no rows; other columns don't matter. The tree is
    fitted on bounded samples and holds every row. A leaf is dealt out in blocks, so a leaf with
    very many rows is many tasks.
    """
    spark = vectors.sparkSession
    source = written(usable(vectors), "vectors")
    facts = source.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).first()
    if not facts.n:
        return Found(spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), 0, 0)
    tree = fitted(source, facts.n, float(np.sqrt(facts.longest)))
    shared = spark.sparkContext.broadcast(tree)  # bounded by MOST_LEAVES
    rows = written(source.mapInArrow(_assigned(shared), ASSIGNED), "leaves")
    queries = rows.where(F.col("vec_id") % every == 0)
    most = calibrated(tree, rows, queries, k, recall)
    parts = written(rows.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "parts")
    parts = F.broadcast(parts)  # MOST_LEAVES rows
    salted = rows.join(parts, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("salt"), "vec_id", "v")
    blocks = written(packed(salted, ["leaf", "salt"], BLOCK), "blocks")
    search = partial(_search, k=k)

    def visited(asking: DataFrame, first: int, last: int) -> DataFrame:
        """What queries (vec_id, v with the bound as last component) find in these of their leaves."""

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = [shared.value.visits(x[:-1], last)[first:] for x in matrix(batch.column("v"))]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(lists, pa.list_(pa.int32()))], names=["vec_id", "v", "leaves"])

        routed = asking.repartition(F.col("vec_id")).mapInArrow(route, "vec_id long, v array<double>, leaves array<int>").select("vec_id", "v", F.explode("leaves").alias("leaf"))
        asked = packed(routed.withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.lit(8)).cast("int")), ["leaf", "turn"], QUERIES)
        asked = asked.join(parts, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("ids").alias("qids"), F.col("vectors").alias("qs"))
        return asked.join(blocks, ["leaf", "salt"]).select("qids", "qs", "ids", "vectors").mapInArrow(search, "query_id long, vec_id long, score double")

    with_bound = lambda bound: F.concat("v", F.array(bound))
    near = written(ranked(visited(queries.select("vec_id", with_bound(F.lit(float("-inf"))).alias("v")), 0, min(FIRST, most)), k), "near")
    if most > FIRST:
        bounds = near.where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("bound"))
        asking = queries.join(bounds, F.col("vec_id") == F.col("q"), "left").select("vec_id", with_bound(F.coalesce("bound", F.lit(float("-inf")))).alias("v"))
        near = ranked(near.drop("rank").unionByName(visited(asking, FIRST, most)), k)
    return Found(near, tree.n_leaves, most)


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """The rows that `searched` finds."""
    return searched(vectors, every, k, recall).rows


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            qid, q, ids, x = (np.frombuffer(c.as_buffer(), t) for c, t in zip(row, (np.int64, np.float64) * 2, strict=True))
            q = q.reshape(len(qid), -1)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in best(qid, q[:, :-1], ids, x.reshape(len(ids), -1), k, q[:, -1])], schema=FOUND)


def op10_ann(spark, sf_dir: str) -> DataFrame:
    """The neighbours of every twentieth vector. Null, zero, very long and odd vectors, ties, repeated
    rows, empty tables, further columns: see `searched`."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
