"""Exact duplicates by a Golomb-coded fingerprint exchange.

1. Every part of the input (some scan partitions) sorts its distinct fingerprints and sends each
   owner its range of them, Rice-coded as gaps. Coding is done where the fingerprints are, so none
   is shuffled plain.
2. An owner decodes what all parts sent and answers every part with a bitmap over that part's own
   list: 1 where the fingerprint came more than once, within one part or from several.
3. Bitmaps meet the lists that the parts have kept, and mark the suspect fingerprints. Only texts
   with a suspect fingerprint are shuffled, grouped by the text itself, so bytes decide; rare false
   suspects end as groups of one.

Fingerprints take log2(rows) + 12 bits, so about one row in 4,096 is suspected wrongly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import ascii_lower, cut, semi

EXTRA_BITS = 12
#: Fingerprints of an owner and of a part: a task holds about so many, 8 bytes each. Their ratio keeps
#: messages at hundreds of fingerprints, however large the input.
ROWS_PER_OWNER, ROWS_PER_PART = 4_000_000, 2_000_000
LEAST_OWNERS = 16


def rice_encode(gaps: np.ndarray, k: int) -> bytes:
    """Golomb-Rice code of non-negative gaps: all quotients in unary, then all k-bit remainders."""
    gaps = gaps.astype(np.int64)
    unary = np.zeros(int((gaps >> k).sum()) + len(gaps), np.uint8)
    unary[np.cumsum((gaps >> k) + 1) - 1] = 1
    low = (gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1
    return np.packbits(unary).tobytes() + np.packbits(low.astype(np.uint8)).tobytes()


def rice_decode(blob: bytes, n: int, k: int) -> np.ndarray:
    """The n gaps that rice_encode() wrote."""
    low_bytes = -(-n * k // 8)
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, len(blob) - low_bytes))
    high = np.diff(np.flatnonzero(unary)[:n], prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(blob, np.uint8, low_bytes, len(blob) - low_bytes), count=n * k).reshape(n, k)
    return (high << k) + low.astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))


def rice_parameter(n: int, span: int) -> int:
    """Bits kept plain when n gaps share a span: log2 of the mean gap."""
    return max(0, int(math.log2(max(1, span // max(1, n)))))


def exchange(prints: DataFrame, rows: int, bits: int) -> DataFrame:
    """Suspect fingerprints (column f) of the `rows` rows of `prints` (f), f in [0, 2**bits)."""
    owners = max(LEAST_OWNERS, math.ceil(rows / ROWS_PER_OWNER))
    span = -(-(1 << bits) // owners)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = np.unique(np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy(zero_copy_only=False) for b in batches)]), return_counts=True)
        part, out = TaskContext.get().partitionId(), []
        cuts = np.searchsorted(own, np.arange(owners + 1) * span)
        for o in np.flatnonzero(np.diff(cuts)).tolist():
            mine, k = own[cuts[o] : cuts[o + 1]] - o * span, rice_parameter(int(cuts[o + 1] - cuts[o]), span)
            out.append((part, o, len(mine), k, rice_encode(np.diff(mine, prepend=0), k), np.packbits(seen[cuts[o] : cuts[o + 1]] > 1).tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["part", "owner", "n", "k", "code", "twice"])

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [np.cumsum(rice_decode(c, n, k)).astype(np.int64) for c, n, k in zip(pdf["code"], pdf["n"], pdf["k"], strict=True)]
        twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=n).astype(bool) for t, n in zip(pdf["twice"], pdf["n"], strict=True)]
        every, place, seen = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        more = seen > 1
        more[place[np.concatenate(twice)]] = True
        marks = np.split(more[place], np.cumsum([len(x) for x in lists])[:-1])
        return pd.DataFrame({"part": pdf["part"], "owner": pdf["owner"], "bitmap": [np.packbits(m).tobytes() for m in marks]})

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [np.zeros(0, np.int64)]
            for owner, n, k, code, bitmap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = owner * span + np.cumsum(rice_decode(code, n, k)).astype(np.int64)
                hits.append(mine[np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hits))], ["f"])

    parts = max(LEAST_OWNERS, math.ceil(rows / ROWS_PER_PART))
    sent = cut(prints.select("f").coalesce(parts).mapInArrow(send, "part int, owner long, n int, k int, code binary, twice binary"))
    replies = sent.groupBy("owner").applyInPandas(own, "part int, owner long, bitmap binary")
    answered = sent.join(replies, ["part", "owner"]).select("owner", "n", "k", "code", "bitmap")
    return answered.mapInArrow(receive, "f long").distinct()


def _shift(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def _suspects(docs: DataFrame, text: str, keep: list[Column]) -> tuple[DataFrame, DataFrame, int, int]:
    """(narrow rows, suspect fingerprints, their count, fingerprint bits)."""
    norm = ascii_lower(F.col(text))
    narrow = cut(docs.select(*keep, F.xxhash64(norm).alias("h"), F.sha2(norm.cast("binary"), 256).alias("sha")))
    rows = narrow.count()
    bits = min(62, max(1, rows.bit_length()) + EXTRA_BITS)
    found = cut(exchange(narrow.select(_shift(F.col("h"), bits).alias("f")), rows, bits))
    return narrow, found, found.count(), bits


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty
    texts are one group. The row with the largest doc_id stays (a null id is smaller than any);
    rows that repeat the id that stays are all marked kept. An empty table gives no rows. Other
    columns are not read.
    """
    narrow, found, n, bits = _suspects(docs, text, [F.col(doc_id).alias("doc_id")])
    norm = ascii_lower(F.col(text))
    texts = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm")).withColumn("f", _shift(F.xxhash64("norm"), bits))
    # grouping by the text compares bytes; partial aggregation leaves one row a text and task to shuffle
    groups = semi(texts, found, ["f"], "left_semi", n).groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    verified = groups.where("group_size > 1").select(F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep_id", "group_size")
    joined = narrow.select("doc_id", "sha").join(verified, "sha", "left")
    single = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without exact copies: of equal texts one row stays, that
    with the largest doc_id (of rows repeating that id, any one). Nulls as in exact_groups()."""
    _, found, n, bits = _suspects(docs, text, [])
    names = docs.columns
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(doc_id).alias("id"), ascii_lower(F.col(text)).alias("norm")).withColumn("f", _shift(F.xxhash64("norm"), bits))
    alone = semi(keyed, found, ["f"], "left_anti", n).select("row.*")
    same = semi(keyed, found, ["f"], "left_semi", n).groupBy("norm").agg(F.max_by("row", F.struct(F.col("id").isNotNull(), "id")).alias("row")).select("row.*")
    return alone.unionByName(same)
