"""Declared tables in the session's catalog.

Master and state are stored in buckets of ``STATION_ID``, sorted by it. A join of the two by
that key (D1, D2, D7) reads both sides where they lie: no shuffle, however large they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.status import KEY
from ..schemas import MASTER, STAGING, STATE

BUCKETS = 64
TABLES: dict[str, StructType] = {"staging": STAGING, "stations": MASTER, "current_state": STATE}
#: Tables that are joined by station.
BUCKETED = ("stations", "current_state")


def create_tables(spark: SparkSession, schema: str, location: str | None = None, buckets: int = BUCKETS) -> list[str]:
    """The schema and its three tables, empty, unless they are there; returns their names."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}{where}")
    for name, fields in TABLES.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        layout = f" CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS" if name in BUCKETED else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {schema}.{name} ({columns}) USING parquet{layout}")
    return [f"{schema}.{name}" for name in TABLES]


def replace_table(df: DataFrame, table: str) -> DataFrame:
    """Replace the rows of a declared table (CREATE OR REPLACE ... AS SELECT keeps its types and
    buckets so); returns the table. Columns are taken by name, those that are missing are NULL.

    Rows are dealt out by the key first, so that a bucket is one file; a station
    that holds many rows shares that file with no other bucket.
    """
    spark, name = df.sparkSession, table.split(".")[-1]
    fields = TABLES[name].fields
    missing = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else missing(f) for f in fields])
    if name in BUCKETED:
        layout = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
        rows = rows.repartition(int(layout["data_type"]), KEY)
    rows.write.mode("overwrite").insertInto(table)
    return spark.table(table)
