"""Stored tables: Parquet by default, JDBC as an option."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotweave.schemas import schema

BOOK_KEYED = {"chapter", "book_character", "book_event", "event_relationship_edge", "event_character_stat",
              "character_pov_summary", "chapter_relationship_edge"}


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One stored table with its declared schema."""
    return spark.read.schema(schema(table)).parquet(f"{root}/{table}")


def write_table(df: DataFrame, root: str, table: str, mode: str = "append") -> None:
    """Write rows in the declared column order.

    Book-keyed tables are range-partitioned on their book, so a reader of one book
    touches few files and a hot book spreads over several.
    """
    out = df.select(*schema(table).names)
    if table in BOOK_KEYED:
        keys = ["book_id"] + [c for c in ("chapter_idx", "idx", "id", "from_id") if c in out.columns]
        out = out.repartitionByRange(*keys)
    out.write.mode(mode).parquet(f"{root}/{table}")


def read_jdbc(
    spark: SparkSession, url: str, table: str, low: int, high: int, parts: int, properties: dict | None = None
) -> DataFrame:
    """A table of the transactional store, read in parallel ranges of its book or row id."""
    column = "book_id" if table in BOOK_KEYED else "id"
    return spark.read.jdbc(
        url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties or {}
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table and whether it is filled, as a post-migration check."""
    from functools import reduce

    from pyspark.sql import functions as F

    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("filled", F.col("row_count") > 0)
