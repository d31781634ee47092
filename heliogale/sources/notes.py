"""Notes beside stored tables: what a table was made with and from, and whether that still holds.

A note names the parameters and, for every input, the input's *mark*. The mark of a stored table covers its
own note, hence the marks of its inputs and so on up to the first sources; the mark of a source covers the
name, size and time of every file. The notes of a run are thus the graph of its stages, kept where the tables are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    system, location = _files(spark, path)
    return bool(system.exists(location))


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written and committed."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def _place(path: str) -> str:
    return f"{path.rstrip('/')}_made_with"


def plain(value) -> object:
    """``value`` as it reads back from JSON."""
    return json.loads(json.dumps(value, default=str, sort_keys=True))


def read(spark: SparkSession, path: str) -> dict | None:
    """The note of a finished table; None if there is none or the table was not finished."""
    system, location = _files(spark, _place(path))
    if not system.exists(location) or not finished(spark, path):
        return None
    stream = system.open(location)
    try:
        note = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return None if note.get("building") else note


def write(spark: SparkSession, path: str, note: dict) -> None:
    system, location = _files(spark, _place(path))
    stream = system.create(location, True)
    try:
        stream.write(bytearray(json.dumps(note, sort_keys=True, default=str).encode()))
    finally:
        stream.close()


def begin(spark: SparkSession, path: str) -> None:
    """From now on the table at ``path`` answers nothing, until its new note is written."""
    write(spark, path, {"building": True})


def _digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def source_mark(spark: SparkSession, path: str) -> str:
    """Mark of files that no note describes, from their names, sizes and times; Spark lists them, nothing is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    row = listed.select(F.xxhash64("path", "length", "modificationTime").alias("h"), "length").agg(
        F.count("*"), F.sum("length"), F.sum(F.col("h").cast("decimal(20,0)"))).first()
    return _digest("files", *row)


def content_mark(table: DataFrame) -> str:
    """Mark of the rows of a table that is handed in, whatever their order."""
    row = table.select(F.xxhash64(*table.columns).alias("h")).agg(
        F.count("*"), F.sum(F.col("h").cast("decimal(20,0)"))).first()
    return _digest("rows", sorted(table.columns), *row)


class Marks:
    """Marks as they are now; each path is looked at once."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.notes: dict[str, dict | None] = {}
        self.marks: dict[str, str] = {}
        self.reasons: dict[str, str | None] = {}

    def note(self, path: str) -> dict | None:
        if path not in self.notes:
            self.notes[path] = read(self.spark, path)
        return self.notes[path]

    def of(self, path: str) -> str:
        if path not in self.marks:
            note = self.note(path)
            if note is None:
                self.marks[path] = source_mark(self.spark, path)
            else:
                system, done = _files(self.spark, f"{path.rstrip('/')}/_SUCCESS")
                self.marks[path] = _digest(note, system.getFileStatus(done).getModificationTime())
        return self.marks[path]

    def of_all(self, paths: Iterable[str]) -> dict[str, str]:
        return {p: self.of(p) for p in paths}

    def outdated(self, path: str) -> str | None:
        """Why a stored table no longer follows from what it was made from; None if it does, or is a source."""
        if path not in self.reasons:
            note = self.note(path)
            self.reasons[path] = f"{path} was not finished" if note is None and path_exists(self.spark, _place(path)) else None
            for source, mark in (note or {}).get("inputs", {}).items():
                why = self.outdated(source) if path_exists(self.spark, source) else f"{source} is gone"
                if why is None and self.of(source) != mark:
                    why = f"{source} has changed since {path} was made"
                if why:
                    self.reasons[path] = why
                    break
        return self.reasons[path]
