"""Merkle manifest of a dataset with checkpoint-and-recompute proofs (operator 12).

Rows are leaves of one tree per group; the trees' roots are the leaves of one more tree, whose root stands for the whole
dataset.  Every ``FAN`` consecutive nodes become one node of the next level.  Only every ``EVERY``-th level is stored, as
blocks: a block holds the up to ``FAN ** EVERY`` stored nodes below one node of the next stored level.  A proof is
extracted from the top down: each block's missing interior nodes are computed again from its stored nodes, their siblings
are emitted for every stored node in it, and nothing of it is kept.

Positions come from a range partitioning by (group, order) and one row per partition and group, so that a group with any
share of all rows is spread over many tasks.  All work is done by DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.common import through_table

#: Nodes to a parent, and levels from one stored level to the next.
FAN, EVERY = 8, 2
#: Offsets of partitions are broadcast up to this many rows (some 100 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Type of a proof: from the leaf to the root, the joined digests left and right of the node in its run.
PATH = "array<struct<left:string,right:string>>"
#: ``monotonically_increasing_id`` holds the row's place in its partition in these low bits.
_ROW_BITS = 33


def field_text(value: Column) -> Column:
    """A field as leaf input: ``-`` if null, else its length in UTF-8 bytes, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)).cast("binary"), 256)


def _node(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, "").cast("binary"), 256)


def _parents(level: Column) -> Column:
    """The level above an array of nodes that starts at a run's start."""
    last = F.floor((F.size(level) - 1) / FAN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda run: _node(F.slice(level, run * FAN + 1, F.lit(FAN))))


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves: the least h with ``FAN ** h >= n``, in whole numbers."""
    powers = [FAN**j for j in range(63) if FAN**j < 2**63]
    return reduce(lambda a, p: a + (n > F.lit(p)).cast("int"), powers, F.lit(0))


def _rise(n: Column, level: int) -> Column:
    """Levels that a block stored at ``level`` covers: ``EVERY``, or what is left of the tree."""
    return F.greatest(F.lit(0), F.least(F.lit(EVERY), _height(n) - level))


def _with_interior(blocks: DataFrame, level: int) -> DataFrame:
    """Blocks with the levels recomputed above their stored ``nodes`` (``up1`` ...) and ``rise``."""
    below = "nodes"
    for k in range(1, EVERY + 1):
        blocks = blocks.withColumn(f"up{k}", _parents(F.col(below)))
        below = f"up{k}"
    return blocks.withColumn("rise", _rise(F.col("n"), level))


def _levels() -> list[str]:
    return ["nodes", *(f"up{k}" for k in range(1, EVERY + 1))]


def _siblings(at: Column) -> Column:
    """For the stored node at place ``at`` of a block: its siblings, level by level up to the block's root."""
    steps = []
    for k, level in enumerate(_levels()[:-1]):
        place = F.floor(at / FAN**k).cast("int")
        inside = place % FAN
        steps.append(F.struct(
            F.array_join(F.slice(level, place - inside + 1, inside), "").alias("left"),
            F.array_join(F.slice(level, place + 2, FAN - 1 - inside), "").alias("right")))
    return F.slice(F.array(*steps), F.lit(1), F.col("rise"))


def _blocked(rows: DataFrame, payload: bool) -> DataFrame:
    """Rows (tree, n, i, digest[, payload]) as blocks of up to ``FAN ** EVERY`` nodes in order."""
    member = F.struct("i", "digest", *(["payload"] if payload else []))
    size = FAN**EVERY
    return (rows.groupBy("tree", "n", F.floor(F.col("i") / size).cast("long").alias("block"))
            .agg(F.sort_array(F.collect_list(member)).alias("m"))
            .select("tree", "n", "block", F.col("m.digest").alias("nodes"), *([F.col("m.payload").alias("payloads")] if payload else [])))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows (tree, digest, payload, order columns) with ``n``, their tree's leaf count, and ``i``, their place in it."""
    keys = ["tree", *order, "digest", "salt"]
    # the salt only parts rows that are equal in all else, so that a range can end between them
    stored = through_table(rows.withColumn("salt", F.monotonically_increasing_id()), "merkle_leaves")
    ranged = through_table(
        stored.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .select("tree", "digest", "payload", F.monotonically_increasing_id().alias("at")), "merkle_order")
    part = F.shiftright("at", _ROW_BITS)
    runs = ranged.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("tree")
    offsets = runs.select(
        "tree", "part", F.sum("rows").over(whole).alias("n"),
        (F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         - F.col("first")).alias("shift"))
    offsets = through_table(offsets, "merkle_offsets")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return (ranged.withColumn("part", part).join(offsets, ["tree", "part"])
            .select("tree", "n", (F.col("at") + F.col("shift")).alias("i"), "digest", "payload"))


@dataclass
class Trees:
    """Trees over groups of leaves: ``stored[k]`` has the blocks of level ``k * EVERY``, ``roots`` (tree, n, digest) one row
    a tree."""

    stored: list[DataFrame]
    roots: DataFrame

    @classmethod
    def grow(cls, rows: DataFrame, order: list[str]) -> Trees:
        """From rows with ``tree``, ``digest``, ``payload`` and order columns, all without nulls in ``tree``."""
        level, stored, roots = 0, [], []
        blocks = through_table(_blocked(_placed(rows, order), payload=True), "merkle_level")
        most = blocks.agg(F.max("n")).first()[0] or 0
        while True:
            stored.append(blocks)
            inner = _with_interior(blocks.select("tree", "n", "block", "nodes"), level)
            tops = F.array(*(F.col(name)[0] for name in _levels()))
            above = inner.select("tree", "n", F.col("block").alias("i"), F.element_at(tops, F.col("rise") + 1).alias("digest"))
            level += EVERY
            done = _height(F.col("n")) <= level
            nodes = through_table(above, "merkle_nodes")
            roots.append(nodes.filter(done).select("tree", "n", "digest"))
            if most <= FAN**level:
                break
            blocks = through_table(_blocked(nodes.filter(~done), payload=False), "merkle_level")
        return cls(stored, reduce(DataFrame.unionByName, roots))

    def paths(self, tops: DataFrame) -> DataFrame:
        """Every leaf's ``payload``, ``digest`` and ``path``, with the other columns of its tree's row in ``tops`` (tree,
        path, ...), whose ``path`` is that of the tree's root."""
        extra = [c for c in tops.columns if c not in ("tree", "path")]
        above = None
        for k in reversed(range(len(self.stored))):
            level, blocks = k * EVERY, self.stored[k]
            # trees that end between this stored level and the next one start here, the others come from above
            height = _height(F.col("n"))
            here = (height <= level + EVERY) & ((height > level) if level else F.lit(True))
            heads = blocks.filter(here).select("tree", "block").join(tops, "tree")
            above = heads if above is None else heads.unionByName(above)
            inner = _with_interior(blocks, level).join(above, ["tree", "block"])
            # one narrow record a stored node: the block's own arrays don't go through the explode
            kept = [] if k else ["payloads"]
            members = F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), lambda at: F.struct(
                at.alias("at"), F.get("nodes", at).alias("digest"), _siblings(at).alias("siblings"),
                *(F.get(c, at).alias("payload") for c in kept)))  # noqa: B023
            members = inner.select("tree", "block", "path", *extra, F.explode(members).alias("m"))
            path = F.concat("m.siblings", "path").alias("path")
            if k:
                above = members.select("tree", (F.col("block") * FAN**EVERY + F.col("m.at")).alias("block"), path, *extra)
            else:
                return members.select("m.payload", "m.digest", path, *extra)
        raise AssertionError("trees without a level")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def path_digest(path: Column) -> Column:
    """Digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


@dataclass
class Manifest:
    """Trees of the groups, the tree over their roots, and the dataset's root (None for an empty table)."""

    groups: Trees
    top: Trees
    root: str | None

    def proofs(self) -> DataFrame:
        """One row a leaf: ``payload``, ``digest``, ``path`` up to the dataset's root, and ``subroot``."""
        start = self.top.roots.select("tree", F.lit(None).cast(PATH).alias("path"))
        start = start.withColumn("path", F.coalesce("path", F.array().cast(PATH)))
        groups = self.top.paths(start).select(
            F.col("payload.group").alias("tree"), F.col("digest").alias("subroot"), "path")
        return self.groups.paths(groups)


def manifest(rows: DataFrame, group: Column, order: list[str], digest: Column, payload: Column) -> Manifest:
    """Manifest of ``rows``.

    ``group`` names a row's tree; a null is a tree of its own and the first one, the others follow bytewise.  Within a
    tree leaves ascend by ``order`` (nulls first), rows alike in it by their digest; rows with equal digests are leaves of
    their own.  ``payload`` is a struct carried to the leaf's proof.  An empty table has no leaf and no root.
    """
    name = F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group.cast("string")))
    by = [F.col(f"`{c}`").alias(f"order{k}") for k, c in enumerate(order)]
    leaves = rows.select(name.alias("tree"), *by, digest.alias("digest"), payload.alias("payload"))
    groups = Trees.grow(leaves, [f"order{k}" for k in range(len(by))])
    heads = groups.roots.select(F.lit("").alias("tree"), F.col("tree").alias("order0"), "digest", F.struct(F.col("tree").alias("group")).alias("payload"))
    top = Trees.grow(heads, ["order0"])
    first = top.roots.first()
    return Manifest(groups, top, first["digest"] if first else None)


def lower_ascii(text: Column) -> Column:
    """Text with A-Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def verify(spark: SparkSession, docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
           id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """Build the manifest of ``docs`` and check every row against it: ``doc_id, leaf, subroot, root, proof_sha256, path,
    claimed, folded_root, verified``.

    Where ``tampered`` holds, the row is checked with its text's A-Z in lower case (``claimed`` is that row's digest), else
    as it is.  Null values in any field have their own encoding (``field_text``), null ids come first in their tree, rows
    that repeat are leaves of their own, an empty table gives no rows, and columns outside ``fields`` are not part of a leaf.
    """
    column = {c: F.col(f"`{c}`") for c in fields}
    changed = [lower_ascii(v) if c == text_col else v for c, v in column.items()]
    leaf = leaf_digest(*column.values())
    claimed = leaf if tampered is None else F.when(tampered, leaf_digest(*changed)).otherwise(leaf)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("group"), leaf.alias("leaf"), claimed.alias("claimed"))
    whole = manifest(rows, F.col("group"), ["id"], F.col("leaf"), F.struct("id", "claimed"))
    root = F.lit(whole.root).cast("string")
    return (whole.proofs().withColumns({"claimed": F.col("payload.claimed"), "root": root})
            .withColumn("folded_root", fold(F.col("claimed"), F.col("path")))
            .select(F.col("payload.id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
                    path_digest(F.col("path")).alias("proof_sha256"), "path", "claimed", "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))
