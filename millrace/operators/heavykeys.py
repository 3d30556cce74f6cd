"""Per-key results where a few keys hold most of the records: exact offset chunking.

The rows are written once, range-partitioned and sorted by key and order, so that a heavy key spreads over many files.
Keys are counted per file (the input partitions); prefix sums over the files turn the counts into exact offsets, and
with a row's place in its file every row of a heavy key gets its number within the key, in order, without any task
seeing the whole key. The number divided by the chunk size names the chunk: all chunks of a key but its last hold
exactly ``chunk_rows`` rows, whatever the skew. Chunks are processed apart, in order; each leaves small states with its
boundaries (first, last, count), and the states of a key are merged in their order, so that what lies between the last
row of one chunk and the first of the next is not lost. Files and places in them stay the same when a task is run again,
so a lost executor cannot change a number.

A key is heavy when it has more rows than one chunk, so N rows have at most N / chunk_rows heavy keys; the offsets of
other keys are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import simple_name
from ..session import new_path, stored

#: Offsets are broadcast up to this many rows (each a file, a key and two numbers); beyond, they are joined.
BROADCAST_OFFSETS = 50_000
#: Chunks an average key of all rows would have, and rows of a chunk at least.
CHUNKS, LEAST_CHUNK = 256, 1000


def chunked(rows: DataFrame, key: str, order: list[str] | None = None, chunk_rows: int | None = None, distinct: bool = False) -> DataFrame:
    """``rows`` with ``row_no`` LONG (from 0 within the key, by ``order``; null for keys of one chunk), ``chunk`` and ``place`` LONG.

    A null key is a key like any other; repeated rows are numbered apart unless ``distinct``, for which ``order`` must name
    all other columns (equal rows meet in one range, so that needs no shuffle of its own); ties come in any order. ``chunk_rows`` defaults to a 256th of the rows, at least 1,000. ``place`` is the row's place among all rows: neighbours in it are
    neighbours in key and order within a file. Empty input gives no rows. The column names ``_file``, ``_k``, ``_f``,
    ``row_no``, ``chunk`` and ``place`` are taken by the operator and must not be in ``rows``.
    """
    spark = rows.sparkSession
    path = new_path(spark, "chunked")
    sort = [key, *(order or [])]
    ranged = rows.repartitionByRange(*sort)
    (ranged.dropDuplicates(sort) if distinct else ranged).sortWithinPartitions(*sort).write.parquet(path)
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    placed = spark.read.schema(rows.schema).parquet(path).select("*", number.alias("_file"), F.col("_metadata.row_index").alias("place"))
    counts = stored(placed.groupBy("_file", F.col(key).alias("_k")).agg(F.count("*").alias("n")), "counts")
    totals = counts.groupBy("_k").agg(F.sum("n").alias("n_key"))
    if chunk_rows is None:
        chunk_rows = max(LEAST_CHUNK, (counts.agg(F.sum("n")).first()[0] or 0) // CHUNKS)
    heavy = totals.where(F.col("n_key") > chunk_rows)
    files = Window.partitionBy("_k").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    keys = Window.partitionBy("_file").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(keys), F.lit(0)))
    offsets = starts.join(heavy.withColumnRenamed("_k", "_h"), F.col("_k").eqNullSafe(F.col("_h")))
    offsets = offsets.withColumn("shift", F.coalesce(F.sum("n").over(files), F.lit(0)) - F.col("start"))
    offsets = stored(offsets.select(F.col("_file").alias("_f"), "_k", "shift"), "offsets")
    small = offsets.count() <= BROADCAST_OFFSETS
    joined = placed.join(F.broadcast(offsets) if small else offsets, (F.col("_file") == F.col("_f")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    if not small:
        joined = joined.sortWithinPartitions("_file", "place")
    row_no = F.col("place") + F.col("shift")
    return joined.select(
        *rows.columns, row_no.alias("row_no"), F.coalesce(F.floor(row_no / F.lit(chunk_rows)), F.lit(0)).cast("long").alias("chunk"), (F.shiftleft("_file", 40) + F.col("place")).alias("place")
    )


def callee_chunks(calls: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """The distinct call sites, numbered and chunked by simple calling class, by callee and site: (caller_class, site_id, callee, row_no, chunk, place).

    A site that came several times counts once. The empty class (top-level code) is a class, and so is the null of
    sites without a caller; rows without a ``site_id`` are left out. A null callee stays (its site counts).
    """
    sites = calls.select("site_id", simple_name(F.col("caller_class")).alias("caller_class"), "callee").where(F.col("site_id").isNotNull())
    return chunked(sites, "caller_class", ["callee", "site_id"], chunk_rows, distinct=True)


def key_sizes(chunks: DataFrame, key: str) -> DataFrame:
    """(key, n_rows, n_chunks, share): each chunk leaves its count, the key's states are merged."""
    states = chunks.groupBy(key, "chunk").agg(F.count("*").alias("n"))
    sizes = stored(states.groupBy(key).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_chunks")), "sizes")
    total = sizes.agg(F.sum("n_rows")).first()[0] or 0
    return sizes.select(key, "n_rows", "n_chunks", (F.col("n_rows") / F.lit(float(max(total, 1)))).alias("share"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per run of neighbouring rows of a class, chunk and callee: (class, chunk, callee, n, first, last, longest gap)."""
    for b in batches:
        if not b.num_rows:
            continue
        cls, chunk, callee, site, place = b.columns
        new = np.ones(b.num_rows, bool)
        differs = lambda c: np.asarray(pc.not_equal(c[1:], c[:-1]))
        sites, places = np.asarray(site), np.asarray(place)
        new[1:] = differs(cls) | differs(callee) | differs(chunk) | (np.diff(places) != 1)
        at = np.flatnonzero(new)
        ends = np.append(at[1:], b.num_rows) - 1
        gaps = np.zeros(b.num_rows, np.int64)
        gaps[1:] = np.where(new[1:], 0, np.diff(sites))
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [cls.take(take), chunk.take(take), callee.take(take), pa.array(ends - at + 1), pa.array(sites[at]), pa.array(sites[ends]), pa.array(np.maximum.reduceat(gaps, at))],
            ["caller_class", "chunk", "callee", "n", "first", "last", "gap"],
        )


def callee_sets(chunks: DataFrame) -> DataFrame:
    """class_callees as rows (caller_class, callee, n_sites, first_site, last_site, longest_gap): one per class and callee.

    ``longest_gap`` is the largest difference between two neighbouring site ids of the callee in the class, null for a
    single site. Every chunk leaves a state per run of a callee; the states of a callee are merged in order, and the gap
    between the last site of one and the first of the next counts as well. Not even the set of a class has to fit one
    task. Null callees are in no set, and the null class has none.
    """
    rows = chunks.where(F.col("callee").isNotNull() & F.col("caller_class").isNotNull()).select("caller_class", "chunk", "callee", "site_id", "place")
    states = rows.mapInArrow(_runs, "caller_class string, chunk bigint, callee string, n bigint, first bigint, last bigint, gap bigint")
    before = F.lag("last").over(Window.partitionBy("caller_class", "callee").orderBy("chunk", "first"))
    merged = states.withColumn("gap", F.greatest(F.col("gap"), F.coalesce(F.col("first") - before, F.lit(0))))
    return merged.groupBy("caller_class", "callee").agg(
        F.sum("n").alias("n_sites"), F.min("first").alias("first_site"), F.max("last").alias("last_site"), F.when(F.sum("n") > 1, F.max("gap")).alias("longest_gap")
    )


def heavy_keys(chunks: DataFrame, key: str, share: float) -> DataFrame:
    """Keys with at least ``share`` of all rows, by ``key_sizes``."""
    return key_sizes(chunks, key).where(F.col("share") >= share)
