"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What local runs use; a cluster's own settings win where they are set.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("millrace")
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"} | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Intermediate tables and checkpoints this process wrote.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset on a single machine (``local[...]``, as in tests) a temporary folder is made and remembered
    in the session; a cluster must name its folder, a machine's own would not be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"millrace-{uuid.uuid4().hex}")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for an intermediate table in the shared folder."""
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables and checkpoints this process wrote; results that still read them must have been saved."""
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    plan = kept._jdf.queryExecution().logical()
    if hasattr(plan, "rdd"):
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            _WRITTEN.append(file.get())
    return kept


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written once as parquet in the shared folder and read back: a stable, columnar intermediate table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that ``stored`` gave ``df`` for; nothing may read it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once; they may not have it on their path."""
    if spark.conf.get("millrace.shipped", None) == spark.sparkContext.applicationId:
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    spark.conf.set("millrace.shipped", spark.sparkContext.applicationId)
