"""A batch load that takes each file once (A4, A5): staging rows with their load history.

What there is to load is the listing minus the history: a file is known by its path, size
and modification time, so a changed file is told apart from a new one. The rows of a load
and the files that they came from are written side by side and published together by one
commit; a load that breaks leaves neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STAGING
from ..streaming.commits import CommitLog
from .readers import STATUS_PATTERN, _glob, plain_path, read_status_json

HISTORY = "FILE_PATH string, FILE_SIZE long, MODIFIED timestamp, STATUS string, N_ROWS long, LOAD_ID long"
#: After so many loads the next one's history holds all earlier ones' too.
FOLD = 50


class LoadedTable:
    """Staging rows under ``root``, loaded file by file."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, CommitLog(spark, root)

    def rows(self) -> DataFrame:
        """All loaded rows, with ``SOURCE_FILE`` and ``LOAD_ID``."""
        paths = [f"{self.log.root}/{e['path']}/rows" for _, e in self.log.entries()]
        if not paths:
            return self.spark.createDataFrame([], STAGING).withColumns({"SOURCE_FILE": F.lit("").cast("string"), "LOAD_ID": F.lit(0).cast("long")})
        return self.spark.read.parquet(*paths)

    def history(self) -> DataFrame:
        """One row a file and load: path, size, time, ``STATUS`` (new or changed), rows and the load."""
        entries = self.log.entries()
        since = max((n for n, e in entries if e["folded"]), default=0)
        paths = [f"{self.log.root}/{e['path']}/files" for n, e in entries if n >= since]
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], HISTORY)

    def pending(self, path: str, pattern: str | None = STATUS_PATTERN) -> DataFrame:
        """The listing with ``STATUS``: new, changed (known by its path, of another size or time) or loaded."""
        listing = self.spark.read.format("binaryFile").load(_glob(path, pattern))
        files = listing.select(plain_path(F.col("path")).alias("FILE_PATH"), F.col("length").alias("FILE_SIZE"), F.col("modificationTime").alias("MODIFIED"))
        last = self.history().groupBy("FILE_PATH").agg(F.max(F.struct("LOAD_ID", "FILE_SIZE", "MODIFIED")).alias("last"))
        same = (F.col("last.FILE_SIZE") == F.col("FILE_SIZE")) & (F.col("last.MODIFIED") == F.col("MODIFIED"))
        status = F.when(F.col("last").isNull(), "new").when(same, "loaded").otherwise("changed")
        return files.join(last, "FILE_PATH", "left").select("FILE_PATH", "FILE_SIZE", "MODIFIED", status.alias("STATUS"))

    def load(self, path: str, pattern: str | None = STATUS_PATTERN, changed: str = "append", multi_line: bool = True) -> int:
        """Append the rows of files that aren't loaded; returns how many files that were.

        ``changed="append"`` loads a changed file anew beside its earlier rows (``LOAD_ID`` tells them
        apart), ``"skip"`` leaves it, ``"error"`` raises. Without files there is no load. The names of the files to load go
        through the driver, as every listing of Spark does; contents don't.
        """
        if changed not in ("append", "skip", "error"):
            raise ValueError("changed must be 'append', 'skip' or 'error'")
        files = [r for r in self.pending(path, pattern).where("STATUS <> 'loaded'").collect() if changed != "skip" or r["STATUS"] == "new"]
        if changed == "error" and any(r["STATUS"] == "changed" for r in files):
            raise ValueError("changed files: " + ", ".join(r["FILE_PATH"] for r in files if r["STATUS"] == "changed"))
        if not files:
            return 0
        sequence, folder = self.log.attempt()
        rows = read_status_json(self.spark, [r["FILE_PATH"] for r in files], None, multi_line, with_source_file=True)
        rows = rows.withColumn("SOURCE_FILE", plain_path(F.col("SOURCE_FILE"))).withColumn("LOAD_ID", F.lit(sequence).cast("long"))
        rows.write.parquet(f"{self.log.root}/{folder}/rows")
        counts = self.spark.read.parquet(f"{self.log.root}/{folder}/rows").groupBy(F.col("SOURCE_FILE").alias("FILE_PATH")).agg(F.count(F.lit(1)).alias("N_ROWS"))
        taken = self.spark.createDataFrame(files, "FILE_PATH string, FILE_SIZE long, MODIFIED timestamp, STATUS string")
        history = taken.join(counts, "FILE_PATH", "left").select(
            "FILE_PATH", "FILE_SIZE", "MODIFIED", "STATUS", F.coalesce("N_ROWS", F.lit(0).cast("long")).alias("N_ROWS"), F.lit(sequence).cast("long").alias("LOAD_ID")
        )
        folded = sequence % FOLD == FOLD - 1
        (self.history().unionByName(history) if folded else history).write.parquet(f"{self.log.root}/{folder}/files")
        self.log.publish(sequence, {"path": folder, "files": len(files), "folded": folded})
        return len(files)
