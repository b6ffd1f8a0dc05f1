"""What the corpus operators share: text views, lineage cuts and size-checked joins."""

from __future__ import annotations

import pickle
import string
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.lineage import cut as cut

#: Most keys a broadcast side may have: 16 MB of longs.
BROADCAST_KEYS = 2_000_000
#: Bytes of text that the vectorised scorers hold at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Most rows of a batch that goes to a worker, in the pipeline.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends workers at most BATCH_ROWS rows at once: texts of 10,000 rows, Spark's
    own number, take tens of MB in the JVM and again in each worker. No result depends on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def share(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast that workers read with shared(). Spark's own pickling names classes by module; here
    they travel by value, so that workers need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(value: Broadcast) -> Any:
    """What share() was given, loaded once in each worker."""
    if not hasattr(value, "loaded"):
        value.loaded = pickle.loads(value.value)
    return value.loaded


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def semi(df: DataFrame, keys: DataFrame, on: list[str], how: str, n_keys: int) -> DataFrame:
    """left_semi or left_anti join; the key side is broadcast only when its counted size is small."""
    return df.join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys, on, how)


def hash_sample(df: DataFrame, key: str, most: int, total: int, seed: str) -> DataFrame:
    """About `most` rows of `total`, chosen by a hash of their key: the same rows on every run."""
    if total <= most:
        return df
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return df.where(u < most / total)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together take about `most` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to
