"""A Merkle manifest of a table: a tree of digests per source and one over the sources.

Every row is a leaf. Per source, leaves ascend by id, and while several nodes remain, every ``FAN``
consecutive ones become the digest of their joined digests. The last node is the source's subroot, and the
subroots, by source, form one more such tree up to the root.

Only every ``KEPT``-th level is stored. A stored node and its descendants in the stored level below form an
aligned subtree of ``FAN ** KEPT`` nodes, small enough to be one row with an array. Proofs are extracted from
the top down: each subtree regenerates its missing levels from its stored nodes, hands every node its
siblings, in front of those of the subtree's own root, and drops the levels again. The work is in proportion
to the nodes whatever the size of a source, since the unit is the subtree, never the source.

Defined results: a null column enters a leaf as ``-``; ids that are null come first, repeated ids follow
their digest, and identical rows are leaves of their own; null is a source of its own, the first; an empty
table has no leaves and no root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogale.llm.ordered import numbered
from heliogale.llm.store import stored

FAN = 3
KEPT = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _counted(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(**replaced: Column) -> Column:
    """Digest of a row's :data:`COLUMNS`; ``replaced`` gives other values for some of them."""
    return digest(*[_counted(replaced.get(c, F.col(c))) for c in COLUMNS])


@dataclass(frozen=True)
class Tree:
    """Stored levels, from the leaves to one node per tree: tree, pos, digest, n (nodes of the tree in that level)
    and, with the leaves, their own columns."""

    levels: list[DataFrame]
    carried: list[str]
    fan: int
    kept: int


def _runs(nodes: Column, fan: int) -> Column:
    """Digests of every ``fan`` consecutive elements of an array."""
    joined = lambda k: F.sha2(F.array_join(F.slice(nodes, k * fan + 1, F.lit(fan)), ""), 256)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fan).cast("int")), joined)


def _subtrees(level: DataFrame, carried: list[str], fan: int, kept: int) -> DataFrame:
    """One row per aligned subtree: tree, pos (of its root in the next stored level), n, members (pos, digest and
    the carried columns, in order), and its regenerated levels ``up0`` (the members) to ``up{kept}`` (the root)."""
    members = F.sort_array(F.collect_list(F.struct("pos", "digest", *carried)))
    out = (
        level.groupBy("tree", F.floor(F.col("pos") / fan**kept).alias("block"))
        .agg(F.first("n").alias("n"), members.alias("members"))
        .withColumnRenamed("block", "pos")
        .withColumn("up0", F.col("members.digest"))
    )
    for k in range(kept):
        # A tree ends where one node remains; below that even a single last node is digested.
        below = F.col(f"up{k}")
        out = out.withColumn(f"up{k + 1}", F.when(F.col("n") > fan**k, _runs(below, fan)).otherwise(below))
    return out


def build(leaves: DataFrame, carried: list[str], fan: int = FAN, kept: int = KEPT) -> Tree:
    """Stored levels over ``leaves`` (tree, pos, n, digest and the carried columns).

    As many rounds as the largest tree has stored levels; each reads the level below once.
    """
    levels = [stored(leaves.select("tree", "pos", "n", "digest", *carried))]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        own = carried if len(levels) == 1 else []
        roots = _subtrees(levels[-1], own, fan, kept).select(
            "tree", "pos", F.ceil(F.col("n") / fan**kept).alias("n"), F.col(f"up{kept}")[0].alias("digest"))
        levels.append(stored(roots))
        most = -(-most // fan**kept)
    return Tree(levels, carried, fan, kept)


def proofs(tree: Tree, above: DataFrame) -> DataFrame:
    """Each leaf with ``steps``: the joined digests left and right of it and of each of its ancestors, upwards.

    ``above`` gives each tree the steps from its root on: tree, steps and columns that all its leaves take.
    """
    taken = [c for c in above.columns if c not in ("tree", "steps")]
    known = tree.levels[-1].join(above, "tree").select("tree", "pos", "steps", *taken)
    if len(tree.levels) == 1:
        return tree.levels[0].join(known, ["tree", "pos"])
    for k in range(len(tree.levels) - 2, -1, -1):
        own = tree.carried if k == 0 else []
        # The steps go with the subtree's root, so they are joined once per subtree.
        rows = _subtrees(tree.levels[k], own, tree.fan, tree.kept).join(known, ["tree", "pos"])

        def with_steps(member: Column, at: Column) -> Column:
            here = []
            for level in range(tree.kept):
                nodes, place = F.col(f"up{level}"), F.floor(at / tree.fan**level).cast("int")
                start = F.floor(place / tree.fan).cast("int") * tree.fan
                beside = F.struct(
                    F.array_join(F.slice(nodes, start + 1, place - start), "").alias("left"),
                    F.array_join(F.slice(nodes, place + 2, start + tree.fan - 1 - place), "").alias("right"))
                here.append(F.when(F.col("n") > tree.fan**level, beside))
            steps = F.concat(F.array_compact(F.array(*here)), F.col("steps"))
            return F.struct(member["pos"].alias("pos"), member["digest"].alias("digest"),
                            *[member[c].alias(c) for c in own], steps.alias("steps"))

        every = rows.select("tree", *taken, F.explode(F.transform("members", with_steps)).alias("leaf"))
        known = every.select("tree", "leaf.*", *taken)
        if k:
            known = stored(known)
    return known


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf digest and its steps lead to."""
    return F.aggregate(steps, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def manifest(docs: DataFrame, carried: dict[str, Column] | None = None, fan: int = FAN, kept: int = KEPT) -> DataFrame:
    """Every row's doc_id, leaf, subroot, root and steps, and the ``carried`` columns computed from the row."""
    carried = carried or {}
    # A key that is never null and sorts as sources do: null first, then bytewise.
    key = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    rows = stored(docs.select(key.alias("tree"), "doc_id", leaf_digest().alias("digest"), *[c.alias(k) for k, c in carried.items()]))
    leaves = numbered(rows, ["tree"], [F.col("doc_id"), F.col("digest"), *[F.col(k) for k in carried]])
    sources = build(leaves, ["doc_id", *carried], fan, kept)
    subroots = sources.levels[-1].select("tree", F.col("digest").alias("subroot"))
    top = numbered(subroots, [], [F.col("tree")]).select(
        F.lit("").alias("tree"), "pos", "n", F.col("subroot").alias("digest"), F.col("tree").alias("source_key"))
    whole = build(top, ["source_key"], fan, kept)
    root = whole.levels[-1].select(
        "tree", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("steps"))
    above = proofs(whole, root).select(F.col("source_key").alias("tree"), F.col("digest").alias("subroot"), "root", "steps")
    return proofs(sources, stored(above)).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "steps", *carried)


def tamper_check(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: all proofs, tried on texts of which every
    second one (2 divides the crc32 of the decimal id; a null id is left alone) lost its newlines."""
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    changed = F.when(hit, leaf_digest(text=F.replace("text", F.lit("\n"), F.lit(""))))
    rows = manifest(docs, {"changed_leaf": changed})
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.coalesce("changed_leaf", "leaf"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
