"""A current table in buckets, where a batch touches only the buckets it changes.

Batch N writes every bucket it changes anew, whole, as ``<table>/batch=N/bucket=B``, and with
it the list of the newest version of all buckets, ``versions/batch=N``: at most one row per
table and bucket. Batch N + 1 reads that one list and the versions of its own buckets by their
paths. So a batch costs what its buckets hold, however many batches came before, and a batch
that is run again reads what it read the first time and overwrites what it wrote.

Earlier versions are not needed once no reader holds them; `old_versions` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "table string, bucket int, batch long"


class Versions:
    """Tables under ``path``, each cut into ``buckets`` by a hash of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 256):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that ``rows`` fall into: a list of at most ``buckets`` numbers."""
        return sorted(r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def before(self, batch: int) -> dict[tuple[str, int], int]:
        """The newest version of each bucket when ``batch`` begins."""
        if batch == 0:
            return {}
        return self._listed(batch - 1)

    def _listed(self, batch: int) -> dict[tuple[str, int], int]:
        rows = self.spark.read.schema(VERSION).parquet(f"{self.path}/versions/batch={batch}").collect()
        return {(r.table, r.bucket): r.batch for r in rows}

    def newest(self) -> dict[tuple[str, int], int]:
        """The newest version of each bucket, for readers."""
        last = self.spark.read.parquet(f"{self.path}/versions").agg(F.max("batch")).first()[0]
        return {} if last is None else self._listed(last)

    def rows(self, table: str, schema: str, versions: dict[tuple[str, int], int], buckets: list[int] | None = None) -> DataFrame:
        """What the given buckets (all, when not given) hold in these versions."""
        wanted = [(b, n) for (t, b), n in sorted(versions.items()) if t == table and (buckets is None or b in buckets)]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{table}/batch={n}/bucket={b}" for b, n in wanted]
        return self.spark.read.schema(schema).parquet(*paths)

    def write(self, table: str, rows: DataFrame, batch: int) -> DataFrame:
        """Write whole buckets as versions of ``batch``; gives them back as they are stored."""
        path = f"{self.path}/{table}/batch={batch}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, tables: dict[str, DataFrame], touched: list[int], batch: int) -> None:
        """List what ``batch`` wrote beside the versions it left alone; a bucket left empty has none.

        This comes last: until then readers see the versions of the batch before.
        """
        listed = self.before(batch)
        for table, rows in tables.items():
            filled = set(self.touched(rows))
            for bucket in touched:
                listed.pop((table, bucket), None)
                if bucket in filled:
                    listed[table, bucket] = batch
        made = self.spark.createDataFrame([(t, b, n) for (t, b), n in listed.items()], VERSION)
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/batch={batch}")

    def old_versions(self, table: str) -> list[str]:
        """Folders of ``table`` that the newest list does not name."""
        kept = {f"batch={n}/bucket={b}" for (t, b), n in self.newest().items() if t == table}
        folder = f"{self.path}/{table}"
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        found = files.select(F.regexp_extract("path", "(batch=[0-9]+/bucket=[0-9]+)/[^/]+$", 1).alias("at")).distinct()
        return sorted(f"{folder}/{r['at']}" for r in found.filter("at <> ''").collect() if r["at"] not in kept)
