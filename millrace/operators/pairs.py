"""Joins that list every pair of a common key, spread evenly over the tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one side in a list; a task makes the pairs of two lists at a time.
LIST_ROWS = 2_000
#: Tasks that make the pairs, for each shuffle partition.
SPREAD = 4


def _lists(rows: DataFrame, key: str, name: str, size: int) -> DataFrame:
    """(key, name_no, name): the other columns of the rows of each key in lists; one shuffle, the same lists when a task runs again."""
    rest = [c for c in rows.columns if c != key]
    number = F.row_number().over(Window.partitionBy(key).orderBy(*rest)) - 1
    listed = rows.select(key, F.floor(number / size).cast("int").alias(f"{name}_no"), F.struct(*rest).alias("row"))
    return listed.groupBy(key, f"{name}_no").agg(F.collect_list("row").alias(name))


def paired(left: DataFrame, right: DataFrame, key: str, how: str = "inner", size: int = LIST_ROWS) -> DataFrame:
    """``left`` joined to ``right`` by ``key``, 'inner' or 'left', for keys that many rows of both sides share.

    Both sides are shuffled once as lists of at most ``size`` rows, then pairs of lists are dealt to the tasks, and rows
    appear only where they are read: nothing is shuffled or stored that has a row per pair, and a common key is no one
    task's load. The sides share no other column.
    """
    spark = left.sparkSession
    pairs = _lists(left, key, "left_rows", size).join(_lists(right, key, "right_rows", size), key, how)
    tasks = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(tasks, key, "left_rows_no", "right_rows_no").select(key, F.inline("left_rows"), "right_rows")
    names = [c for c in dealt.columns if c != "right_rows"]
    return dealt.select(*names, (F.inline if how == "inner" else F.inline_outer)("right_rows"))
