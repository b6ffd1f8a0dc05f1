"""Labels and recordings in JSON."""

from __future__ import annotations

import glob
import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

from seamline.schemas import RECORDING, TASK_LABEL


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled tasks of one fixture: a JSON array with a fixed schema."""
    return spark.read.json(path, schema=TASK_LABEL, multiLine=True)


def list_fixtures(directory: str, left_out: tuple[str, ...] = ("fixtures.lock.json", "labels.freeze.json")) -> list[str]:
    """Names of the fixtures whose labels lie in a directory."""
    return sorted(os.path.basename(p).removesuffix(".json") for p in glob.glob(os.path.join(directory, "*.json")) if os.path.basename(p) not in left_out)


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=RECORDING, multiLine=True)


def checksum(files: dict[str, bytes]) -> str:
    """SHA-256 over name, length and bytes of files in name order."""
    h = hashlib.sha256()
    for name in sorted(files):
        h.update(f"{name}\0{len(files[name])}\0".encode())
        h.update(files[name])
    return h.hexdigest()


def assert_frozen(files: dict[str, bytes], expected: str) -> None:
    if checksum(files) != expected:
        raise ValueError("the labels have changed since they were frozen")
