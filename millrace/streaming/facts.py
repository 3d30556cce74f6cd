"""Facts of a source tree that grows: new files are parsed as they arrive and their facts appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.csharp import frontend


def arriving(spark: SparkSession, path: str, glob: str = "*.cs", files_per_trigger: int = 1000) -> DataFrame:
    """(file, text) of files as they appear below ``path``."""
    reader = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def append_facts(spark: SparkSession, path: str, out: str, checkpoint: str, compat: bool = True) -> StreamingQuery:
    """Parse what arrives and append one row per file with all its facts to the parquet table ``out``; runs until all present files are done."""
    parsed = frontend.parse(arriving(spark, path), compat)
    return parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def call_rates(calls: DataFrame, at: str = "scanned_at", late: str = "14 days", width: str = "1 day") -> DataFrame:
    """(window, caller_class, sites): distinct call sites per class and window of event time, each site once.

    ``calls`` may be a stream or a table; as a stream, sites that come again within ``late`` count once and windows
    close when the watermark has passed them.
    """
    from ..functions.names import simple_name

    rows = calls.select(F.col(at).cast("timestamp").alias("at"), "site_id", simple_name(F.col("caller_class")).alias("caller_class"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["site_id"])
    else:
        rows = rows.dropDuplicates(["site_id"])
    return rows.groupBy(F.window("at", width).alias("window"), "caller_class").agg(F.count("*").alias("sites"))
