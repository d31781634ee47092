"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A text's hash is a point on a ring of ``CELLS`` cells, so equal texts meet. Every shard owns virtual
nodes on the ring, and a point belongs to the next node clockwise. A shard is full at ``1 + slack``
times the mean load; what reaches a full shard goes on clockwise to the next node of an open one. Loads
are bytes, so shards come out near equal, and another shard moves little: its own share and what the
lower limit pushes on.

The walk is done on the loads of the cells, a table whose size is fixed by ``CELLS`` and not by the
data; documents only look up their cell. Rows with the same id, size and crc at a cell are counted before they are
placed, and such a stack is cut into chunks of at most ``1 / PARTS`` of a shard. A cell heavier than that is cut
into parts of about that weight, at most ``shards * PARTS`` more rows, and chunks are dealt out to its parts. So
loads stay near equal whatever the ids: null, repeated or all the same.

Defined results: a null text has size 1, no crc and its own point; repeated rows are rows of their own, each with
a slot; a null id is a value of its own; an empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heliogale.llm.store import stored

CELLS = 1 << 16
PARTS = 64
ROWS_PER_CHUNK = 10_000  # equal rows that are written out from one row
VIRTUAL_NODES = 1024
SLACK = 0.001


def ring(spark, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """cell, shard of every virtual node; two nodes never share a cell, the lower hash wins."""
    nodes = spark.range(shards * virtual_nodes).select(
        (F.col("id") / virtual_nodes).cast("int").alias("shard"), (F.col("id") % virtual_nodes).alias("node"))
    point = F.xxhash64(F.lit("node"), "shard", "node")
    return nodes.groupBy(F.pmod(point, F.lit(CELLS)).cast("int").alias("cell")).agg(F.min_by("shard", point).alias("shard"))


def next_node(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """``cells`` with ``shard``: that of the first node at or clockwise of the cell."""
    backwards = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    owner = (
        cells.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(nodes, "cell", "left")
        .select("cell", F.coalesce(F.last("shard", True).over(backwards), F.last("shard", True).over(around)).alias("shard"))
    )
    return cells.join(F.broadcast(owner), "cell")


def place(cells: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> DataFrame:
    """Shard of every (cell, part) with its ``load``; the input is bounded by ``CELLS`` and ``PARTS``.

    Each round walks the open shards' ring: a shard takes the arrivals, heavy ones first, until it is full.
    A round that leaves cells over has filled at least one more shard, so there are at most ``shards``.
    """
    spark = cells.sparkSession
    total = cells.agg(F.sum("load")).first()[0] or 0
    limit = total / shards * (1 + slack)
    loads = dict.fromkeys(range(shards), 0)
    nodes = stored(ring(spark, shards, virtual_nodes))
    left, done = cells, None
    for _ in range(shards):
        open_shards = [s for s, load in loads.items() if load < limit or limit == 0]
        used = F.create_map(*[F.lit(x) for s in open_shards for x in (s, float(loads[s]))])[F.col("shard")]
        before = Window.partitionBy("shard").orderBy(F.col("load").desc(), "cell", "part").rowsBetween(Window.unboundedPreceding, -1)
        walked = stored(
            next_node(left, nodes.filter(F.col("shard").isin(open_shards)))
            .withColumn("ahead", used + F.coalesce(F.sum("load").over(before), F.lit(0)))
            .withColumn("taken", (F.col("ahead") < limit) | F.lit(limit == 0))
            .drop("ahead")
        )
        taken = walked.filter("taken").drop("taken")
        done = taken if done is None else done.unionByName(taken)
        left = walked.filter("not taken").drop("taken", "shard")
        for row in taken.groupBy("shard").agg(F.sum("load").alias("load")).collect():
            loads[row["shard"]] += row["load"]
        if left.isEmpty():
            break
    return done


def shard(docs: DataFrame, shards: int = 16, virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = stored(
        docs.select(
            "doc_id", size.alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
            F.pmod(F.xxhash64("text"), F.lit(CELLS)).cast("int").alias("cell"))
        .groupBy("doc_id", "size", "text_crc32", "cell").agg(F.count("*").alias("copies"))
    )
    weights = stored(rows.groupBy("cell").agg(F.sum(F.col("size") * F.col("copies")).alias("load")))
    total = weights.agg(F.sum("load")).first()[0] or 0
    units = lambda load: F.ceil(load * (shards * PARTS) / max(1, total))  # noqa: E731  of 1 / PARTS of a shard
    # One row per cell: at most CELLS of two ints, so the lookup may be broadcast.
    parts = weights.select("cell", F.greatest(F.lit(1), units(F.col("load"))).cast("int").alias("parts"))
    chunks = F.greatest(F.ceil(F.col("copies") / ROWS_PER_CHUNK), F.least("copies", units(F.col("size") * F.col("copies"))))
    chunked = (
        rows.withColumn("chunks", chunks.cast("long"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .withColumn("m", F.expr("copies * (chunk + 1) div chunks - copies * chunk div chunks"))
        .join(F.broadcast(parts), "cell")
        .withColumn("part", F.pmod(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts")) + F.col("chunk"), F.col("parts")).cast("int"))
    )
    cells = stored(chunked.groupBy("cell", "part").agg(F.sum(F.col("size") * F.col("m")).alias("load"), F.sum("m").alias("n")))
    placed = place(cells, shards, virtual_nodes, slack)
    earlier = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    lookup = placed.select("cell", "part", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # At most CELLS + shards * PARTS rows, as above. A part is numbered alone, so no task gets a whole shard.
    inside = Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunked.join(F.broadcast(lookup), ["cell", "part"])
        .withColumn("first", F.col("before") + F.coalesce(F.sum("m").over(inside), F.lit(0)))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                F.explode(F.sequence(F.col("first"), F.col("first") + F.col("m") - 1)).alias("slot"),
                F.lit(None).cast("int").alias("grown_shard"))
    )
