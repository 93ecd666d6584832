"""Sinks: JSON lines in canonical key order, small pretty JSON, whole files on any file system, an event log."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One JSON object a line, keys sorted, nulls kept; the whole target is replaced."""
    rows = df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"), *[F.col(c).alias(f"_{c}") for c in order or []])
    if order:
        rows = rows.sortWithinPartitions(*[f"_{c}" for c in order])
    rows.select("value").write.mode("overwrite").text(path)


class Files:
    """Small files by their paths, on whatever file system Hadoop finds there."""

    def __init__(self, spark: SparkSession | None = None):
        spark = spark or SparkSession.active()
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, path: str | Path):
        where = self.hadoop.Path(str(path))
        return where, where.getFileSystem(self.conf)

    def read(self, path: str | Path) -> str | None:
        where, fs = self.at(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str | Path, text: str) -> None:
        """Readers find the whole text, what was there before, or (for a moment, where renaming can't replace) nothing."""
        where, fs = self.at(path)
        beside = self.hadoop.Path(where.getParent(), f"_{uuid.uuid4().hex}")
        stream = fs.create(beside)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if fs.exists(where):
            fs.delete(where, False)
        if not fs.rename(beside, where):
            raise OSError(f"could not rename to {path}")


def write_json(path: str | Path, value: object, files: Files | None = None) -> None:
    (files or Files()).write(path, json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2) + "\n")


class EventLog:
    """Events as JSON lines. Each is a file of its own, named by time, since not every file system can append."""

    def __init__(self, folder: str | Path, files: Files | None = None):
        self.folder, self.files = folder, files or Files()

    def log(self, event: str, **fields: object) -> None:
        now = datetime.now(UTC)
        line = json.dumps({**fields, "event": event, "time": now.isoformat()}, sort_keys=True, ensure_ascii=False)
        self.files.write(f"{self.folder}/{now.strftime('%Y%m%dT%H%M%S%f')}-{uuid.uuid4().hex[:8]}.jsonl", line + "\n")
