"""A Merkle tree over a dataset, with a proof for every row.

Each row is a leaf: the SHA-256 of its columns, each ``-`` if null, else its
UTF-8 byte count, ``:`` and the value.  The leaves of a group (a language)
ascend by id; every two consecutive nodes become the SHA-256 of their digests
(as hex text), a last one alone becomes the digest of itself alone, until one
is left: the group's subroot.  Subroots, ordered by group with null first,
make the root in the same way.

Method: a node's rank among its group is written as binary digits.  The
lowest ``LEVELS`` digits lie within a *block* of at most 2^LEVELS nodes; the
rest number the block.  Rows are put together by (group, block) once; then
one digit after the other is grouped away, each grouping nesting the structs
of its children, which needs no further exchange.  The blocks' tops are the
nodes of the next tier, 1/2^LEVELS as many.  On the way down a block's nested
struct and the path from its top to the root meet in one grouping by their
common key, and a ``transform`` through the nested structs with an
``explode`` emits the path of each child.  No row holds more than a block.

Ranks come from a range partitioning by (group, id, leaf): the place within
the partition plus the sizes of the group's shares in earlier partitions, so
a group with most of all rows is spread like the others.

Null ids come first; rows with equal ids are ordered by leaf.  An empty table
gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import id_bucket, written

#: Binary digits grouped away within a block: a block has at most 2^LEVELS nodes.
LEVELS = 8
#: One step of a proof: the sibling's digest (null where a node stood alone) and whether it stands to the left.
STEP = "array<struct<hash: string, left: boolean>>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
INFO = "struct<subroot: string, root: string>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**instead: Column) -> Column:
    """The digest of a row; ``instead`` replaces columns."""
    return F.sha2(F.concat(*[_field(instead.get(c, F.col(c))) for c in COLUMNS]), 256)


def ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` with ``rank`` (from 0, by ``order`` within ``grp``) and ``n`` (nodes of the group)."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
    at = F.monotonically_increasing_id()
    placed = written(placed.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND((1 << 33) - 1)}), name)
    shares = placed.groupBy("_part", "grp").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    group, earlier = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("_part", "grp", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"), "_first", F.sum("_size").over(group).alias("n"))
    out = placed.join(shares, ["_part", "grp"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before"))
    return out.drop("_part", "_at", "_first", "_before", "_size")


def _digit(level: int) -> Column:
    return F.shiftright("rank", level).bitwiseAND(1)


def blocks(nodes: DataFrame, tier: int) -> DataFrame:
    """(grp, n, block, top): the nodes of each block nested under its top.

    ``nodes`` has grp, n, rank and ``node``, a struct with the field ``hash``.
    Levels above a group's own height leave its one node as it is.
    """
    digits = {f"d{j}": _digit(j) for j in range(LEVELS)}
    out = nodes.select("grp", "n", F.shiftright("rank", LEVELS).alias("block"), *[c.alias(d) for d, c in digits.items()], "node")
    out = out.repartition("grp", "block")
    for j in range(LEVELS):
        above = [f"d{i}" for i in range(j + 1, LEVELS)]
        child = F.struct(F.col(f"d{j}").alias("digit"), F.col("node").alias("node"))
        out = out.groupBy("grp", "n", "block", *above).agg(F.sort_array(F.collect_list(child)).alias("kids"))
        grown = F.col("n") > F.lit(1 << (tier * LEVELS + j))  # several nodes were left in the group at this level
        joined = F.sha2(F.concat_ws("", F.transform("kids", lambda k: k["node"]["hash"])), 256)
        hash_ = F.when(grown, joined).otherwise(F.col("kids")[0]["node"]["hash"])
        out = out.select("grp", "n", "block", *above, F.struct(hash_.alias("hash"), grown.alias("grown"), F.col("kids").alias("kids")).alias("node"))
    return out.withColumnRenamed("node", "top")


def _step(kids: Column, kid: Column, grown: Column) -> Column:
    """The path's next step from ``kid`` up to the parent of ``kids``."""
    other = F.when(F.size(kids) > 1, kids[F.lit(1) - kid["digit"].cast("int")]["node"]["hash"])
    step = F.array(F.struct(other.alias("hash"), (F.size(kids).__gt__(1) & (kid["digit"] == 1)).alias("left")))
    return F.when(grown, step).otherwise(F.array().cast(STEP))


def _paths(node: Column, path: Column, levels: int) -> Column:
    """All nodes ``levels`` below ``node`` with their paths: array of (node, path)."""
    if levels == 0:
        return F.array(F.struct(node.alias("node"), path.alias("path")))
    kids = node["kids"]
    return F.flatten(F.transform(kids, lambda kid: _paths(kid["node"], F.concat(_step(kids, kid, node["grown"]), path), levels - 1)))


def descend(tops: DataFrame, paths: DataFrame) -> DataFrame:
    """(grp, node, path, info) of the nodes one tier below.

    ``tops``: blocks; ``paths``: (grp, block, path, info) from each block's
    top to the root.  Both meet by grouping their union, not by a join.
    """
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = tops.select("grp", "block", "top", no(STEP, "path"), no(INFO, "info")).unionByName(
        paths.select("grp", "block", no(tops.schema["top"].dataType, "top"), "path", "info")
    )
    met = both.groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("top", "path", "info")])
    below = met.select("grp", "info", F.explode(_paths(F.col("top"), F.col("path"), LEVELS)).alias("x"))
    return below.select("grp", "x.node", "x.path", "info")


def grow(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks by tier, and (grp, subroot) of every group.

    ``nodes`` has grp, n, rank, node; the number of tiers follows the largest group.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers, tier = [], 0
    while True:
        tops = written(blocks(nodes, tier), f"{name}-{tier}")
        tiers.append(tops)
        tier += 1
        if most <= 1 << (LEVELS * tier):
            return tiers, tops.select("grp", F.col("top.hash").alias("subroot"))
        rank = F.col("block").alias("rank")
        nodes = tops.select("grp", "n", rank, F.struct(F.col("top.hash").alias("hash"), rank).alias("node"))


def proofs(tiers: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Nodes of the lowest tier with whole paths; ``paths``: (grp, path, info) from each group's subroot on."""
    paths = paths.select("grp", F.lit(0).cast("long").alias("block"), "path", "info")
    for tops in reversed(tiers[1:]):
        below = descend(tops, paths)  # a node of this tier is a block of the next lower one
        paths = below.select("grp", F.col("node.rank").alias("block"), "path", "info")
    return descend(tiers[0], paths)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to along ``path``."""

    def up(at, step):
        return F.sha2(F.when(step["hash"].isNull(), at).when(step["left"], F.concat(step["hash"], at)).otherwise(F.concat(at, step["hash"])), 256)

    return F.aggregate(path, leaf, up)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, seen, path, info) of every row.

    ``seen`` is the leaf of the row as a tampering reader finds it: where 7
    divides the CRC-32 of the id (null: of the empty text), ``n_chars`` is one
    larger unless null.
    """
    kept = docs.select(*COLUMNS)
    tampered = F.when(id_bucket("doc_id", 7) == 0, leaf_hash(n_chars=F.col("n_chars") + 1))
    group = F.coalesce(F.concat(F.lit("v"), F.col("lang").cast("string")), F.lit(""))  # null first, then by bytes
    leaves = kept.select("doc_id", group.alias("grp"), leaf_hash().alias("leaf"), tampered.alias("seen"))
    leaves = ranked(written(leaves, "merkle-leaves"), ["doc_id", "leaf"], "merkle-order")
    node = F.struct(F.col("leaf").alias("hash"), "doc_id", F.coalesce("seen", "leaf").alias("seen"))
    tiers, subroots = grow(leaves.select("grp", "n", "rank", node.alias("node")), "merkle-tier")

    heads = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "subroot")
    heads = ranked(heads, ["key"], "merkle-groups")
    node = F.struct(F.col("subroot").alias("hash"), "key")
    above, roots = grow(heads.select("grp", "n", "rank", node.alias("node")), "merkle-group-tier")
    to_root = roots.select("grp", F.array().cast(STEP).alias("path"), F.struct(F.lit(None).cast("string").alias("subroot"), F.col("subroot").alias("root")).alias("info"))
    to_root = proofs(above, to_root).select(F.col("node.key").alias("grp"), "path", F.struct(F.col("node.hash").alias("subroot"), "info.root").alias("info"))
    return proofs(tiers, to_root).select("node.doc_id", F.col("node.hash").alias("leaf"), "node.seen", "path", "info")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    out = manifest(docs).select(
        "doc_id",
        "leaf",
        "info.subroot",
        "info.root",
        F.sha2(F.concat_ws("", F.transform("path", lambda s: s["hash"])), 256).alias("proof_sha256"),
        fold(F.col("seen"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
