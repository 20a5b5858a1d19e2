"""Tables of versions: appended inserts and deletes, snapshot reads, vacuum by rewrite."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import mvcc
from tessera.sources.tables import work_path

SYSTEM = "rid string, version long, xmin long, cid long"
DELETES = "rid string, version long, xmax long, seq long"


def with_deletes(versions: DataFrame, deletes: DataFrame) -> DataFrame:
    """Version rows with xmax: of several deletes of a version the last written counts."""
    last = deletes.groupBy("rid", "version").agg(F.max_by("xmax", "seq").alias("xmax"))
    return versions.join(last, ["rid", "version"], "left").withColumn("xmax", F.coalesce("xmax", F.lit(mvcc.INVALID).cast("long")))


def dead(horizon: int) -> Column:
    """Deleted for good: no live snapshot can see the version."""
    return (F.col("xmax") != mvcc.INVALID) & (F.col("state_max") == mvcc.COMMITTED) & (F.col("xmax") < horizon)


def aborted_insert() -> Column:
    return F.col("state_min") == mvcc.ABORTED


def freezable(limit: int) -> Column:
    return (F.col("state_min") == mvcc.COMMITTED) & (F.col("xmin") > mvcc.FROZEN) & (F.col("xmin") < limit)


def vacuumed(versions: DataFrame, states: DataFrame, horizon: int, freeze_age: int = 0, reclaim_aborted: bool = False) -> tuple[DataFrame, DataFrame]:
    """The versions that stay, and one row of counts. Inserts older than the horizon by freeze_age
    or more become frozen; versions of aborted inserts stay unless asked otherwise."""
    limit = horizon - freeze_age if horizon > freeze_age + mvcc.FIRST else 0
    rows = mvcc.with_states(versions, states)
    gone = dead(horizon) | aborted_insert() if reclaim_aborted else dead(horizon)
    kept = rows.where(~gone).withColumn("xmin", F.when(freezable(limit), F.lit(mvcc.FROZEN).cast("long")).otherwise(F.col("xmin")))
    counts = rows.groupBy(F.lit(0).alias("all")).agg(F.count_if(gone).alias("removed"), F.count_if(~gone & freezable(limit)).alias("frozen"), F.count_if(~gone).alias("remaining")).drop("all")
    return kept.drop("state_min", "state_max"), counts


def dead_ratio(versions: DataFrame, states: DataFrame, horizon: int) -> DataFrame:
    """dead, live, and whether over a quarter of the versions is dead."""
    rows = mvcc.with_states(versions, states)
    counts = rows.groupBy(F.lit(0).alias("all")).agg(F.count_if(dead(horizon)).alias("dead"), F.count_if(~dead(horizon)).alias("live")).drop("all")
    return counts.withColumn("due", F.col("dead") * 4 > F.col("dead") + F.col("live"))


@dataclass
class VersionedTable:
    """Two folders of Parquet files, versions and deletes; both only grow until a vacuum writes a
    new generation. One writer at a time."""

    spark: SparkSession
    path: str
    payload: StructType
    generation: int = 0
    written: int = 0

    @classmethod
    def create(cls, spark: SparkSession, payload: StructType | str, path: str | None = None) -> VersionedTable:
        schema = payload if isinstance(payload, StructType) else spark.createDataFrame([], payload).schema
        out = cls(spark, path or work_path(spark, "versions"), schema)
        out._append(spark.createDataFrame([], out._versions_schema()), "versions", "overwrite")
        out._append(spark.createDataFrame([], DELETES), "deletes", "overwrite")
        return out

    def _versions_schema(self) -> StructType:
        return StructType([*self.spark.createDataFrame([], SYSTEM).schema.fields, *self.payload.fields])

    def _folder(self, kind: str) -> str:
        return f"{self.path}/g{self.generation}/{kind}"

    def _append(self, df: DataFrame, kind: str, mode: str = "append") -> None:
        df.write.mode(mode).parquet(self._folder(kind))

    def versions(self) -> DataFrame:
        rows = self.spark.read.schema(self._versions_schema()).parquet(self._folder("versions"))
        return with_deletes(rows, self.spark.read.schema(DELETES).parquet(self._folder("deletes")))

    def scan(self, txns: mvcc.Transactions, snapshot: mvcc.Snapshot) -> DataFrame:
        """The rows that the snapshot sees, with rid and version."""
        return mvcc.scan(self.versions(), txns.table(self.spark), snapshot).select("rid", "version", *self.payload.names)

    def fetch(self, txns: mvcc.Transactions, snapshot: mvcc.Snapshot, rids: list[str]) -> DataFrame:
        """One visible version at most of each row id."""
        return self.scan(txns, snapshot).where(F.col("rid").isin(*rids))

    def insert(self, rows: DataFrame, xid: int, command: int = 0) -> None:
        self.written += 1
        rid = F.concat_ws("-", F.lit(str(xid)), F.lit(str(self.written)), F.monotonically_increasing_id().cast("string"))
        system = [rid.alias("rid"), F.lit(1).cast("long").alias("version"), F.lit(xid).cast("long").alias("xmin"), F.lit(command).cast("long").alias("cid")]
        self._append(rows.select(*system, *self.payload.names), "versions")

    def delete(self, chosen: DataFrame, xid: int) -> None:
        """chosen: rid and version, from a scan."""
        self.written += 1
        self._append(chosen.select("rid", "version", F.lit(xid).cast("long").alias("xmax"), F.lit(self.written).cast("long").alias("seq")), "deletes")

    def update(self, changed: DataFrame, xid: int, command: int = 0) -> None:
        """changed: rid, version and new payload, from a scan. The row id stays, so an old key finds
        no changed row and a row comes once."""
        rows = changed.select("rid", F.col("version") + 1, F.lit(xid).cast("long"), F.lit(command).cast("long"), *self.payload.names).toDF("rid", "version", "xmin", "cid", *self.payload.names)
        kept = work_path(self.spark, "update")  # the old state is read once, before either folder grows
        rows.write.parquet(kept)
        rows = self.spark.read.schema(self._versions_schema()).parquet(kept)
        self.delete(rows.select("rid", (F.col("version") - 1).alias("version")), xid)
        self._append(rows, "versions")

    def vacuum(self, txns: mvcc.Transactions, freeze_age: int = 0, reclaim_aborted: bool = False, files: int | None = None) -> tuple:
        """Writes a generation without dead versions and returns (removed, frozen, remaining); with
        `files`, a full vacuum, it has that many files."""
        kept, counts = vacuumed(self.versions(), txns.table(self.spark), txns.horizon(), freeze_age, reclaim_aborted)
        stats = counts.first() or (0, 0, 0)
        rows, deletes = kept.drop("xmax"), kept.where(F.col("xmax") != mvcc.INVALID).select("rid", "version", "xmax", F.lit(0).cast("long").alias("seq"))
        target = self.generation + 1
        for df, kind in ((rows.select(*self._versions_schema().names), "versions"), (deletes, "deletes")):
            (df.coalesce(files) if files else df).write.mode("overwrite").parquet(f"{self.path}/g{target}/{kind}")
        self.generation = target
        return tuple(stats)

    def autovacuum(self, txns: mvcc.Transactions, **options) -> tuple | None:
        """Vacuums if over a quarter of the versions is dead."""
        ratio = dead_ratio(self.versions(), txns.table(self.spark), txns.horizon()).first()
        return self.vacuum(txns, **options) if ratio and ratio.due else None


def chunks(df: DataFrame, key: str, value: str, size: int = 2000, least: int = 2048) -> DataFrame:
    """Values over `least` bytes in numbered pieces: key, chunk_seq, chunk."""
    long = df.where(F.octet_length(value) > least)
    count = F.expr(f"cast((octet_length({value}) - 1) div {size} as int)")
    pieces = long.select(F.col(key), F.col(value).cast("binary").alias("__v"), F.explode(F.sequence(F.lit(0), count)).alias("chunk_seq"))
    return pieces.select(key, F.col("chunk_seq").cast("long").alias("chunk_seq"), F.substring("__v", F.col("chunk_seq") * size + 1, F.lit(size)).alias("chunk"))


def reassembled(pieces: DataFrame, key: str) -> DataFrame:
    """key and the whole value; pieces of one value must fit a task."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_seq", F.hex("chunk").alias("x"))))
    return pieces.groupBy(key).agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["x"]), "")).alias("value"))


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each row."""
    order = Window.partitionBy("rid").orderBy(F.desc("version"))
    return versions.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
