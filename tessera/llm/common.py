"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Largest serialized side (bytes) that an operator may broadcast after measuring it.
BROADCAST_BYTES = 8 << 20
#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: the lineage ends there, so a lost executor
    costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table made by `written` that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small_enough(df: DataFrame, width: Column, limit: int = BROADCAST_BYTES) -> bool:
    """True if the measured bytes of `df` allow a broadcast."""
    return (df.agg(F.sum(width)).first()[0] or 0) <= limit


def mapped(df: DataFrame, row: Callable, schema: str, *, flat: bool = False) -> DataFrame:
    """Applies `row` to the values of each row, batch by batch through Arrow. `row` returns a
    tuple, or an iterable of tuples if `flat`. Only SLICE rows at a time are Python objects."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                values = zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True)
                out = [y for x in values for y in row(*x)] if flat else [row(*x) for x in values]
                yield from batches_of(out, target)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def batches_of(rows: list[tuple], target: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), most):
        columns = zip(*rows[k : k + most], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the graph with the edges (a, b), as (node, root); root is the smallest node.

    Alternates large-star and small-star steps. Minima come from partial aggregation and go back
    by a join that adaptive execution can split, so a hub with very many neighbours needs no
    large task. Each step is written to the shared folder. Nodes without an edge aren't listed;
    null ends and loops are ignored.
    """
    current = written(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every edge now points from the larger to the smaller end; the small star joins a node's smaller neighbours to the least of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = written(small.where("a <> b").distinct(), "edges")
        reached = _mark(after)
        removed(current)
        current = after
        if reached == mark:
            break
        mark = reached
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("b", "a"))).first())
