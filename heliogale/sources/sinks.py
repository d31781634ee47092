"""Writers: per-tile tables, reports, tables computed once, and resumable tile jobs."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogale.functions import columns as fn
from heliogale.plans.session import pinned
from heliogale.sources import notes
from heliogale.sources.notes import path_exists

log = logging.getLogger(__name__)
TILE = ["tile_lon", "tile_lat"]
FILE_BYTES = 128 << 20  # a file of stored tables is about this large
TASK_FILES = 32  # tiles of one file each that a task writes, about


def pieces(rows: int, row_bytes: int, file_bytes: int = FILE_BYTES) -> int:
    """How many files of ``file_bytes`` a table of ``rows`` makes."""
    return max(1, -(-rows * row_bytes // file_bytes))


# Bytes of a value as stored, before compression; other types count as 16.
_BYTES = {"double": 8, "bigint": 8, "timestamp": 8, "timestamp_ntz": 8, "float": 4, "int": 4, "date": 4, "smallint": 2, "tinyint": 1, "boolean": 1}
#: Columns that say where a row lies, the square they lie in, and its side.
_PLACES = {("lon_i", "lat_i"): ((0.0, 0.0), float(1 << 20)), ("longitude", "latitude"): ((-180.0, -180.0), 540.0)}


def _z_order(df: DataFrame) -> Column:
    """Where a row lies along the Z-order curve, or 0 if it has no place."""
    for (x, y), (low, span) in _PLACES.items():
        if x in df.columns and y in df.columns:
            return F.coalesce(fn.morton(F.col(x).cast("double"), F.col(y).cast("double"), low, span), F.lit(-1))
    return F.lit(0)


def write_tiles(df: DataFrame, path: str, tile: list[str] | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Partitioned by tile, in files of about ``file_bytes``; a rerun replaces only the tiles it holds.

    The rows of every tile are counted. A tile that fits one file is one file; a larger one is cut along the
    Z-order of its places (rows at one place by their content), so each of its files covers a compact part of
    it. Files are sorted by place, so a box filter skips tiles by their names, and files and row groups by
    their ranges. Whole tiles are dealt out to as many tasks as their rows and their number ask for, since a file costs
    time however few rows it has; cut ones are packed into tasks by value ranges. Neither a crowded tile nor many
    nearly empty ones make an uneven task.
    """
    tile = tile or TILE
    rows = pinned(df)
    rest = [c for c in df.columns if c not in tile]
    per_file = max(1, file_bytes // max(1, sum(_BYTES.get(t, 16) for c, t in df.dtypes if c in rest)))
    counts = rows.groupBy(*[F.col(t).alias(f"_{t}") for t in tile]).agg(F.count("*").alias("_n"))
    cut = F.col("_n") > per_file
    one, many = counts.agg(
        F.struct(F.count_if(~cut).alias("tiles"), F.sum(F.when(~cut, F.col("_n"))).alias("rows")),
        F.struct(F.count_if(cut).alias("tiles"), F.sum(F.when(cut, F.col("_n"))).alias("rows"))).first()
    same = [F.col(t).eqNullSafe(F.col(f"_{t}")) for t in tile]
    placed = rows.join(counts, same).withColumns({"_z": _z_order(df), "_row": F.xxhash64(*rest) if rest else F.lit(0)})
    dealt = placed.filter(~cut).repartition(max(1, -(-(one["rows"] or 0) // per_file), -(-one["tiles"] // TASK_FILES)), *tile)
    if many["tiles"]:
        dealt = dealt.unionByName(placed.filter(cut).repartitionByRange(-(-many["rows"] // per_file), *tile, "_z", "_row"))
    ordered = dealt.sortWithinPartitions(*tile, "_z").select(*df.columns)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*tile).parquet(path)


def write_report(df: DataFrame, path: str, order: list, n: int | None = None, digits: int = 2) -> None:
    """Sorted CSV with rounded numbers: one file of the first ``n`` rows, or without ``n`` all rows, in files
    that follow each other in order."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    ordered = df.orderBy(*order)
    ordered = ordered if n is None else ordered.limit(n).coalesce(1)
    fn.round_cols(ordered, digits, *doubles).write.mode("overwrite").csv(path, header=True)


class OtherParameters(ValueError):
    """A stored table was made with other parameters than are asked for now."""


class OutdatedInput(RuntimeError):
    """A table that is to be read no longer follows from what it was made from."""


def _answer(spark: SparkSession, path: str, parameters: dict | None, inputs: Iterable[str]) -> tuple[dict | None, dict[str, str]]:
    """The note of a table that answers this request, or None if it must be built; and the marks of its inputs.

    ``parameters=None`` takes the table as it is, if it still follows from its inputs.
    """
    marks = notes.Marks(spark)
    inputs = list(inputs)
    for source in inputs:
        why = marks.outdated(source)
        if why:
            raise OutdatedInput(f"{path} reads {source}, which is to be made again: {why}")
    note = marks.note(path)
    now = marks.of_all(inputs)
    if note is None:
        return None, now
    if parameters is None:
        why = marks.outdated(path)
        if why:
            raise OutdatedInput(f"{path} is to be made again: {why}")
        return note, now
    wanted = notes.plain(parameters)
    if note["parameters"] != wanted:
        raise OtherParameters(f"{path} was made with {note['parameters']}, not with {wanted}; use another place")
    if note["inputs"] != now:
        log.info("%s is made again: its inputs have changed", path)
        return None, now
    return note, now


def computed_once(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], parameters: dict | None = None,
    inputs: Iterable[str] = (),
) -> DataFrame:
    """Read the table when it answers the request, else build and write it first.

    A table made with other ``parameters`` is an error, never an answer. One made from ``inputs`` (paths of
    sources or stored tables) that have changed since is built again; an input that itself should be is an error.
    """
    note, marks = _answer(spark, path, parameters, inputs)
    if note is None:
        made = build()
        notes.begin(spark, path)
        made.write.mode("overwrite").parquet(path)
        notes.write(spark, path, {"parameters": notes.plain(parameters or {}), "inputs": marks})
    return spark.read.parquet(path)


def bucketed_once(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], keys: list[str],
    buckets: int | None = None, sort: list[str] | None = None, parameters: dict | None = None,
    inputs: Iterable[str] = (), placed: bool = False,
) -> DataFrame:
    """Like :func:`computed_once`, stored in ``buckets`` buckets of ``keys``, sorted by ``sort``.

    Later group-bys, windows and joins on these keys (or on more columns) read the buckets
    in place and shuffle nothing. One task writes one bucket, so there are ``buckets``
    files. The catalog entry is made anew in a session that has none; the bucket count is
    noted beside the table for that. ``placed`` says that ``build`` already deals its rows out by ``keys`` to
    that many partitions, so that they are not dealt out again.
    """
    name = "bucketed_" + hashlib.sha256(path.encode()).hexdigest()[:24]
    sort = sort or keys
    note, marks = _answer(spark, path, parameters, inputs)
    if note is None:
        made = build()
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        notes.begin(spark, path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        dealt = made if placed else made.repartition(n, *[F.col(k) for k in keys])
        dealt.write.mode("overwrite").option("path", path).option(
            "compression", "zstd").bucketBy(n, *keys).sortBy(*sort).saveAsTable(name)
        notes.write(spark, path, {"parameters": notes.plain(parameters or {}), "inputs": marks, "buckets": n, "sort": sort})
    elif not spark.catalog.tableExists(name):
        columns = spark.read.parquet(path).schema.toDDL()
        quoted = lambda names: ", ".join(f"`{k}`" for k in names)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}') "
            f"CLUSTERED BY ({quoted(keys)}) SORTED BY ({quoted(note['sort'])}) INTO {note['buckets']} BUCKETS")
    return spark.table(name)


# ---- resumable tile jobs ----------------------------------------------------
def pending(spark: SparkSession, tiles: DataFrame, manifest: str, tile: list[str] | None = None) -> DataFrame:
    """Tiles the manifest does not list as done."""
    if not path_exists(spark, manifest):
        return tiles
    done = spark.read.parquet(manifest).select(*(tile or TILE)).distinct()
    return tiles.join(done, tile or TILE, "left_anti")


def run_tiles(
    spark: SparkSession, tiles: DataFrame, build: Callable[[DataFrame], DataFrame],
    path: str, manifest: str, tile: list[str] | None = None,
) -> list[tuple]:
    """Build and write every tile not yet done; return the tiles that failed.

    All open tiles run as one job. If it fails, its tiles are halved and each half runs again, so ``k`` bad ones
    of ``n`` are told apart in about ``k * log2(n)`` jobs. What succeeds enters the manifest after Spark's
    committer has written it; a stopped run resumes from there. A plan that is wrong for every tile and a
    session that is lost are errors, not failed tiles.
    """
    tile = tile or TILE
    todo = pending(spark, tiles, manifest, tile).select(*tile).distinct()
    schema = todo.schema
    # The list of tiles is small, and must not change while the manifest grows below.
    names = sorted((tuple(r) for r in todo.toLocalIterator()), key=str)
    failed: list[tuple] = []
    waiting = [names] if names else []
    while waiting:
        some = waiting.pop()
        listed = spark.createDataFrame(some, schema)
        try:
            write_tiles(build(tiles.join(listed, tile)), path, tile)
            listed.write.mode("append").parquet(manifest)
        except AnalysisException:
            raise
        except Exception:  # noqa: BLE001 - halve until the tiles that fail are alone
            if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
                raise
            if len(some) == 1:
                log.exception("tile %s failed", some[0])
                failed += some
            else:
                log.warning("a job of %d tiles failed; trying its halves", len(some))
                half = len(some) // 2
                waiting += [some[half:], some[:half]]
    return failed
