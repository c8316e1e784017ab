"""The change log: committed changes of every table, and SUBSCRIBE over it.

A transaction's changes are files of one folder, written aside and moved in
place at once, so a reader sees all of a transaction or nothing, however many
tasks wrote it. Order is by commit and then by change; the resume token is
the commit. Each row has fifteen text columns; KEYS has no row images, FULL
has them as hexadecimal JSON.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillon.sources import storage

COLUMNS = ("operation", "database_id", "table_id", "table", "tenant", "old_tenant", "primary_key", "old_primary_key", "transaction_id", "change_lsn", "commit_lsn", "resume_token", "lag_lsn", "before_image", "after_image")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
OPERATIONS = ("INSERT", "UPDATE", "DELETE")


def key(columns: list[Column]) -> Column:
    """A composite key as hexadecimal text."""
    return F.lower(F.hex(F.concat_ws("\0", *(c.cast("string") for c in columns))))


def image(columns: list[str], prefix: str = "") -> Column:
    return F.lower(F.hex(F.to_json(F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in columns)), {"ignoreNullFields": "false"})))


@dataclass
class Log:
    spark: SparkSession
    uri: str = ""
    lsn: int = 0
    oldest: int = 0  # commits up to this one are no longer held
    latest: dict[str, int] = field(default_factory=dict)
    numbers: dict[str, int] = field(default_factory=dict)

    def last(self, table: str) -> int:
        return self.latest.get(table, 0)

    def commit(self, table: str, operation: str, before: DataFrame | None, after: DataFrame | None, pk: tuple[str, ...], images: str) -> None:
        """Append one transaction. For an UPDATE both sides have the same rows in the same order of keys."""
        self.uri = self.uri or storage.fresh(self.spark, "changes")
        side = after if after is not None else before
        columns = side.columns
        number = self.numbers.setdefault(table, len(self.numbers) + 1)
        if operation == "UPDATE":
            on = [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in pk]
            joined = before.select(*(F.col(c).alias(c) for c in columns)).alias("b").join(after.alias("a"), on, "full")
            rows = joined.select(*(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in pk), F.when(F.col(f"b.{pk[0]}").isNotNull(), image(columns, "b.")).alias("_before"), F.when(F.col(f"a.{pk[0]}").isNotNull(), image(columns, "a.")).alias("_after"))
        else:
            full = image(columns)
            none = F.lit(None).cast("string")
            rows = side.select(*pk, (full if operation == "DELETE" else none).alias("_before"), (none if operation == "DELETE" else full).alias("_after"))
        rows = rows.withColumn("_at", F.monotonically_increasing_id())
        aside, start = f"{self.uri}/_aside-{self.lsn}", self.lsn
        count = rows.count()
        if not count:
            return
        self.lsn += count + 1
        own = key([F.col(c) for c in pk])
        text = lambda v: F.lit(str(v))
        shown = lambda c: F.col(c) if images == "FULL" else F.lit(None).cast("string")
        order = F.row_number().over(Window.orderBy("_at")) if count <= 100_000 else F.col("_at")  # numbers may have gaps in a large one
        values = {
            "operation": text(operation), "database_id": text(1), "table_id": text(number), "table": text(table), "tenant": text(""), "old_tenant": text(""), "primary_key": own,
            "old_primary_key": own if operation != "INSERT" else F.lit(None).cast("string"), "transaction_id": text(self.lsn), "change_lsn": (F.lit(start) + order).cast("string"),
            "commit_lsn": text(self.lsn), "resume_token": text(self.lsn), "lag_lsn": text(0), "before_image": shown("_before"), "after_image": shown("_after"),
        }
        rows.select(*(values[c].alias(c) for c in COLUMNS)).write.parquet(aside)
        storage.rename(self.spark, aside, f"{self.uri}/commit={self.lsn:020d}")
        self.latest[table] = self.lsn

    def expire(self, upto: int) -> None:
        """Forget transactions up to a commit; older tokens then are errors."""
        make = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if self.uri:
            fs = make(self.uri).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for s in fs.listStatus(make(self.uri)):
                name = s.getPath().getName()
                if name.startswith("commit=") and int(name[7:]) <= upto:
                    fs.delete(s.getPath(), True)
        self.oldest = max(self.oldest, upto)

    def _open(self, table: str, operation: str | None, after: int | None) -> None:
        if operation is not None and operation not in OPERATIONS:
            raise ValueError("operation is INSERT, UPDATE or DELETE")
        if after is not None and after < self.oldest:
            raise ValueError("change history expired")
        self.uri = self.uri or storage.fresh(self.spark, "changes")
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.uri)
        fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(fs_path)

    def subscribe(self, table: str, operation: str | None = None, after: int | None = None, transactions: int | None = None) -> DataFrame:
        """A stream of a table's changes strictly after a commit; ``transactions`` bounds the files of a batch."""
        self._open(table, operation, after)
        reader = self.spark.readStream.schema(SCHEMA)
        if transactions:
            reader = reader.option("maxFilesPerTrigger", transactions)
        return self._chosen(reader.parquet(f"{self.uri}/commit=*"), table, operation, after)

    def held(self, table: str, operation: str | None = None, after: int | None = None) -> DataFrame:
        """The same changes up to now, as rows in order."""
        self._open(table, operation, after)
        if not self.lsn or self.lsn <= self.oldest:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.uri}/commit=*")
        return self._chosen(rows, table, operation, after).orderBy(F.col("commit_lsn").cast("long"), F.col("change_lsn").cast("long"))

    def _chosen(self, rows: DataFrame, table: str, operation: str | None, after: int | None) -> DataFrame:
        rows = rows.select(*COLUMNS).filter(F.col("table") == table)
        rows = rows if operation is None else rows.filter(F.col("operation") == operation)
        return rows if after is None else rows.filter(F.col("commit_lsn").cast("long") > after)


def drain(changes: DataFrame, checkpoint: str, sink: Callable[[DataFrame], None]) -> None:
    """Read all there is, hand each batch over in commit order, remember the place."""

    def batch(df: DataFrame, _: int) -> None:
        sink(df.orderBy(F.col("commit_lsn").cast("long"), F.col("change_lsn").cast("long")))

    changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
