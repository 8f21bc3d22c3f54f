"""Readers (A1-A3, A6, A9, A10, A15).

Feeds are JSON arrays (one object per station, one file per poll) or JSON
lines; either way an explicit schema with string leaves is applied -- never
inference -- and the typed projection below does the casts. Arrays, which is
what the feed and our own snapshots are, need ``multi_line`` (the default): a file is
read as one text, parsed as an array and split by ``inline``, one file per task. For JSON
lines pass ``multi_line=False``, and they split.
A file or line that isn't JSON gives no rows; ``reject_counts`` says how many there
are, and how often each field had a text that its type can't hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import columns as C
from ..schemas import BROKEN_DOCKS, ENVELOPE_JSON, MASTER_JSON, STATUS_JSON

STATUS_PATTERN = "stations*"


def _glob(path: str | list[str], pattern: str | None) -> str | list[str]:
    return f"{path.rstrip('/')}/{pattern}" if pattern else path


def plain_path(path: Column) -> Column:
    """A local file's path as every reader gives it: a listed one is written with one slash after the scheme, a reader's with three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


CORRUPT = "_corrupt_record"
#: Where a raw object came from.
FILE = "_source_file"


def _status_columns() -> list[Column]:
    return [
        C.to_number("station_id").alias("STATION_ID"),
        C.to_number("num_bikes_available").alias("NUM_BIKES_AVAILABLE"),
        C.to_number("num_bikes_available_types.mechanical").alias("NUM_BIKES_AVAILABLE_MECHANICAL"),
        C.to_number("num_bikes_available_types.ebike").alias("NUM_BIKES_AVAILABLE_EBIKE"),
        C.to_number("num_docks_available").alias("NUM_DOCKS_AVAILABLE"),
        C.to_number("last_reported").alias("LAST_REPORTED"),
        C.to_boolean("is_charging_station").alias("IS_CHARGING_STATION"),
        F.col("status").alias("STATUS"),
        C.to_number("is_installed").alias("IS_INSTALLED"),
        C.to_number("is_renting").alias("IS_RENTING"),
        C.to_number("is_returning").alias("IS_RETURNING"),
        F.col("traffic").alias("TRAFFIC"),
        C.ingest_stamp().alias("TST_REC"),
    ]


def status_projection(raw: DataFrame, with_source_file: bool = False) -> DataFrame:
    """Raw feed objects -> the 13 staging columns (A1 projection, B1, B2, B4)."""
    cols = _status_columns()
    if with_source_file:
        cols.append(F.col(FILE).alias("SOURCE_FILE"))
    return raw.select(*cols)


def _master_columns() -> list[Column]:
    return [
        C.to_number("station_id").alias("STATION_ID"),
        F.col("name").alias("STATION_NAME"),
        F.col("physical_configuration").alias("PHYSICAL_CONFIGURATION"),
        C.to_fixed("lat", 12, 7).alias("LAT"),
        C.to_fixed("lon", 12, 7).alias("LON"),
        C.to_number_scaled("altitude", 12, 2).alias("ALTITUDE"),
        F.col("address").alias("ADDRESS"),
        F.col("post_code").alias("POST_CODE"),
        C.to_number("capacity").alias("CAPACITY"),
        C.to_boolean("is_charging_station").alias("IS_CHARGING_STATION"),
        C.to_number_scaled("nearby_distance", 8, 2).alias("NEARBY_DISTANCE"),
        C.to_boolean("_ride_code_support").alias("_RIDE_CODE_SUPPORT"),
        F.col("rental_uris").alias("RENTAL_URIS"),
        C.ingest_stamp().alias("TST_REC"),
    ]


def master_projection(raw: DataFrame, with_source_file: bool = False) -> DataFrame:
    """Raw master objects -> the 14 master columns."""
    file = [F.col(FILE).alias("SOURCE_FILE")] if with_source_file else []
    return raw.select(*_master_columns(), *file)


def _parsed(reader, schema: StructType, multi_line: bool, path: str) -> DataFrame:  # noqa: ANN001
    """One row a file (``multi_line``) or line that isn't blank: its path and the array of its
    objects, NULL if it isn't JSON. A file that holds one object is an array of it."""
    raw = reader.text(path, wholetext=multi_line)
    texts = raw.where(F.trim(F.translate("value", "\t\r\n", "   ")) != "")
    return texts.select(F.col("_metadata.file_path").alias(FILE), F.from_json("value", ArrayType(schema)).alias("_objects"))


def _json(reader, schema: StructType, multi_line: bool, path: str) -> DataFrame:  # noqa: ANN001
    """Feed objects with their file; what isn't JSON is left out."""
    return _parsed(reader, schema, multi_line, path).select(FILE, F.inline("_objects"))


def read_status_json(
    spark: SparkSession,
    path: str | list[str],
    pattern: str | None = STATUS_PATTERN,
    multi_line: bool = True,
    with_source_file: bool = False,
) -> DataFrame:
    """Status feed files under ``path`` matching ``pattern`` (files or folders) (A1); without a
    pattern ``path`` may be a list of files."""
    return status_projection(_json(spark.read, STATUS_JSON, multi_line, _glob(path, pattern)), with_source_file)


def read_master_json(
    spark: SparkSession, path: str, pattern: str | None = STATUS_PATTERN, multi_line: bool = True, with_source_file: bool = True
) -> DataFrame:
    """Station master files (A2); ``SOURCE_FILE`` tells snapshots apart (see ``status.latest_master``)."""
    return master_projection(_json(spark.read, MASTER_JSON, multi_line, _glob(path, pattern)), with_source_file)


def read_status_variant(spark: SparkSession, path: str, pattern: str | None = STATUS_PATTERN, multi_line: bool = True) -> DataFrame:
    """Status feed files without a schema for their objects (B1): the staging columns and
    ``RAW``, the whole object as a VARIANT, so that fields which no schema names stay.

    A file or line that isn't JSON gives no rows; neither does one in which a field stands twice.
    """
    texts = spark.read.text(_glob(path, pattern), wholetext=multi_line)
    parsed = texts.select(F.col("_metadata.file_path").alias(FILE), F.try_parse_json("value").alias("_v")).where("_v is not null")
    several = F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), F.array("_v"))
    return variant_projection(parsed.select(FILE, F.explode(several).alias("RAW")))


def variant_projection(raw: DataFrame) -> DataFrame:
    """Rows with a VARIANT ``RAW`` -> the staging columns, read from it as text, and ``RAW``."""

    def field(name: str, kind: StringType | StructType, at: str) -> Column:
        if isinstance(kind, StructType):
            return F.struct(*[field(f.name, f.dataType, f"{at}.{f.name}") for f in kind.fields]).alias(name)
        return F.try_variant_get("RAW", at, "string").alias(name)

    fields = raw.select("*", *[field(f.name, f.dataType, f"$.{f.name}") for f in STATUS_JSON.fields])
    return fields.select(*_status_columns(), "RAW")


def variant_field(raw: str, path: str, kind: str = "string") -> Column:
    """A field of a VARIANT as ``kind``; NULL where it isn't there or is something else (B1)."""
    return F.try_variant_get(raw, path, kind)


def reject_counts(spark: SparkSession, path: str, pattern: str | None = STATUS_PATTERN, multi_line: bool = True, master: bool = False) -> DataFrame:
    """One row: ``ROWS``, ``CORRUPT`` (files or lines that aren't JSON) and, per typed
    column, the values that were there and that its type couldn't hold (B2)."""
    schema, columns = (MASTER_JSON, _master_columns()) if master else (STATUS_JSON, _status_columns())
    parsed = _parsed(spark.read, schema, multi_line, _glob(path, pattern))
    raw = parsed.select(F.col("_objects").isNull().alias(CORRUPT), F.explode_outer("_objects").alias("_object"))
    raw = raw.select(CORRUPT, F.col("_object").isNotNull().alias("_row"), "_object.*")
    typed = raw.select(*columns).schema.names
    source = {"NUM_BIKES_AVAILABLE_MECHANICAL": "num_bikes_available_types.mechanical", "NUM_BIKES_AVAILABLE_EBIKE": "num_bikes_available_types.ebike", "STATION_NAME": "name"}
    found = {n: c for n, c in zip(typed, columns, strict=True) if n != "TST_REC"}
    bad = [F.count(F.when(F.col(source.get(n, n.lower())).isNotNull() & c.isNull(), 1)).alias(n) for n, c in found.items()]
    return raw.agg(F.count(F.when(F.col("_row"), 1)).alias("ROWS"), F.count(F.when(F.col(CORRUPT), 1)).alias("CORRUPT"), *bad)


def stream_status_json(
    spark: SparkSession,
    path: str,
    pattern: str | None = STATUS_PATTERN,
    multi_line: bool = True,
    max_files_per_trigger: int | None = None,
    clean_source: str | None = None,
    archive_dir: str | None = None,
    with_source_file: bool = True,
) -> DataFrame:
    """Continuous ingest of new feed files.

    Each file is taken once: the source's file log lives in the query's
    checkpoint. ``clean_source="archive"`` (with ``archive_dir``) or ``"delete"``
    expires consumed files from the landing folder -- the per-file, coordinated
    form of the reference's daily purge. ``SOURCE_FILE`` (on by default) breaks
    ties between polls of one station that report the same time inside one
    micro-batch.
    """
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if clean_source:
        r = r.option("cleanSource", clean_source)
        if clean_source == "archive":
            if not archive_dir:
                raise ValueError("archive_dir is required with clean_source='archive'")
            r = r.option("sourceArchiveDir", archive_dir)
    return status_projection(_json(r, STATUS_JSON, multi_line, _glob(path, pattern)), with_source_file)


def read_envelope(spark: SparkSession, path: str, pattern: str | None = None, multi_line: bool = True) -> DataFrame:
    """Saved API payloads {"data": {"stations": [...]}} -> staging rows.

    Each payload is one record whose array is split by ``inline``; a payload
    holds one poll, so no row grows with the history. With ``multi_line`` a file is one payload
    or an array of them.
    """
    payloads = _json(spark.read, ENVELOPE_JSON, multi_line, _glob(path, pattern))
    return status_projection(payloads.select(F.inline("data.stations")))


def file_inventory(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Path, name, size, time and rows of every file under ``path``, those without rows too.

    The files come from the directory listing (the metadata of Spark's binary
    reader; contents aren't read), the rows from the format's reader.
    """
    listing = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("FILE_SIZE"), F.col("modificationTime").alias("MODIFIED"))
    listing = listing.select(F.col("path").alias("FILE_PATH"), F.element_at(F.split("path", "/"), -1).alias("FILE_NAME"), "FILE_SIZE", "MODIFIED")
    rows = spark.read.format(fmt).options(**options).load(path)
    rows = rows.groupBy(plain_path(F.col("_metadata.file_path")).alias("_file")).agg(F.count(F.lit(1)).alias("N_ROWS"))
    joined = listing.withColumn("_file", plain_path(F.col("FILE_PATH"))).join(rows, "_file", "left")
    return joined.select("FILE_PATH", "FILE_NAME", "FILE_SIZE", "MODIFIED", F.coalesce("N_ROWS", F.lit(0)).alias("N_ROWS"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Full scan of a stored table (A10); Catalyst prunes columns at the reader."""
    return spark.read.parquet(path)


def read_broken_docks_csv(spark: SparkSession, path: str) -> DataFrame:
    """A broken-docks result written as CSV with a header."""
    return spark.read.schema(BROKEN_DOCKS).option("header", True).option("encoding", "UTF-8").csv(path)
