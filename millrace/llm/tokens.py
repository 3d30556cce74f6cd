"""Encoding a corpus with a public tokenizer, as Arrow batches through ``bpe.Encoder``."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

#: Folder of the vocabulary files; a parameter of every operator here, this is its default.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
#: Bytes of text encoded at a time within a batch.
SLICE_BYTES = 1 << 21

_ENCODERS: dict[str, bpe.Encoder] = {}


def vocabulary(df: DataFrame, name: str, folder: str = TOKENIZERS) -> Broadcast:
    """The vocabulary file ``name`` of ``folder`` as a broadcast: 50,000 merges or so, three numbers each."""
    return df.sparkSession.sparkContext.broadcast(bpe.load_vocabulary(os.path.join(folder, name)))


def _encoder(shared: Broadcast, path: str) -> bpe.Encoder:
    """This worker's encoder; it lives as long as the worker, so later tasks find the words of earlier ones."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = bpe.Encoder(shared.value)
    return _ENCODERS[path]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about ``limit`` bytes, without copying strings; null is empty."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    if texts.null_count:
        size = np.diff(offsets)
        if size[np.asarray(texts.is_null())].any():  # bytes below a null are not text
            yield from slices(pa.compute.fill_null(texts, ""), limit)
            return
    view = memoryview(buffers[2]) if n and buffers[2] is not None else memoryview(b"")
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end, bytes(view[offsets[at] : offsets[end]]), offsets[at : end + 1] - offsets[at]
        at = end


def encode(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids ARRAY<INT>): every row's text as ids, without special tokens.

    A null and an empty text give an empty list. Keys may repeat or be null; each row is encoded on its own. Very long
    texts are processed whole. Other columns are not read.
    """
    shared, path = vocabulary(df, name, folder), os.path.join(folder, name)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, path)
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                ids, counts = encoder.encode(data, offsets)
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], ["key", "ids"])

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.select(F.col("key").alias(key), "ids")


def count(df: DataFrame, text: str, into: str = "tokens", name: str = "byte_bpe_50k.json", folder: str = TOKENIZERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of every row with the number of ids of its text in ``into`` LONG; 0 for null and empty texts."""
    shared, path = vocabulary(df, name, folder), os.path.join(folder, name)
    fields = ", ".join(f"c{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, path)
        for batch in batches:
            counts = [encoder.count(data, offsets) for _, _, data, offsets in slices(batch.column(len(keep)))]
            total = pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), total], [*(f"c{i}" for i in range(len(keep))), "n"])

    cols = [F.col(k).alias(f"c{i}") for i, k in enumerate(keep)]
    out = df.select(*cols, F.col(text).alias("text")).mapInArrow(run, f"{fields}{', ' if keep else ''}n bigint")
    return out.select(*(F.col(f"c{i}").alias(k) for i, k in enumerate(keep)), F.col("n").alias(into))
