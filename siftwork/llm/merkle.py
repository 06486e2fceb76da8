"""Operator 12: a Merkle manifest of a table, with a witness for every row.

Leaves are appended, in order, to a tree whose complete subtrees stay open until
their sibling is complete.  A leaf's witness begins empty; whenever the subtree
it lies in is joined with another, the other's digest is attached to the witness
of all its leaves.  A node that stays alone on its level is raised by hashing it.

Spark deals the leaves into aligned blocks of ``2**levels``: a block is appended
in one task, and its root is then one leaf of the tree above, where it is
appended in the same way; what that attaches to the block's root holds for every
leaf of the block and is stored once a block.  Groups are trees of their own, and
their roots are the leaves of a last one, so a group of any size, and any number
of groups, is only ever held as one block a task.

Digests are lower-case hex SHA-256 of their inputs' text laid together.  Nulls
are a value of their own in every field, group (first) and order (first).  Rows
equal in order and leaf are interchangeable; each is a leaf.  Long texts are
hashed where they are read and go no further.  Other columns pass through under
their names if kept (a clash gets an underscore).  An empty table has no rows
and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordinal import ordinal
from .common import cut, fresh, ship

BLOCK_LEVELS = 10
LEFT, RIGHT, ALONE = b"L", b"R", b"-"       # a step of a witness: where the sibling stands


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value with its length before it, so that no two rows read the same."""
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


class WitnessTree:
    """Nodes appended one by one; ``witness[i]`` is what has been attached to node i so far."""

    def __init__(self):
        self.open: list[tuple[str, int, int] | None] = []      # per level: digest, first node, end
        self.witness: list[list[bytes]] = []

    def append(self, node: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        new, level = (node, at, at + 1), 0
        while level < len(self.open) and self.open[level]:
            left, self.open[level] = self.open[level], None
            new, level = self._join(left, new), level + 1
        if level == len(self.open):
            self.open.append(None)
        self.open[level] = new

    def _attach(self, node, step: bytes) -> None:
        for i in range(node[1], node[2]):
            self.witness[i].append(step)

    def _join(self, left, right):
        self._attach(left, RIGHT + bytes.fromhex(right[0]))
        self._attach(right, LEFT + bytes.fromhex(left[0]))
        return digest(left[0] + right[0]), left[1], right[2]

    def close(self, levels: int | None = None) -> str | None:
        """The root: ``levels`` above the nodes, or as soon as one node remains."""
        if not self.witness:
            return None
        level, last = 0, None
        while True:
            here = self.open[level] if level < len(self.open) else None
            if here and last:
                last = self._join(here, last)
            elif node := here or last:
                if level == levels or (levels is None and not any(self.open[level + 1:])):
                    return node[0]
                self._attach(node, ALONE)
                last = (digest(node[0]), *node[1:])
            level += 1


def steps(witness: bytes):
    """(side, sibling's hex digest) of each step; the sibling of ALONE is empty."""
    at = 0
    while at < len(witness):
        side = witness[at:at + 1]
        size = 0 if side == ALONE else 32
        yield side, witness[at + 1:at + 1 + size].hex()
        at += 1 + size


def fold(node: str, witness: bytes) -> str:
    """The root that ``node`` leads to."""
    for side, other in steps(witness):
        node = digest(other + node if side == LEFT else node + other)
    return node


def _block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (group, idx, digest, more) with block, witness inside the block
    and, on the first row of a block, its root; written to the shared folder."""
    ship(nodes.sparkSession)
    size = 1 << levels

    def append(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        tree = WitnessTree()
        for d in block.column("digest").to_pylist():
            tree.append(d)
        first = block.column("idx")[0].as_py()
        # a part of a block ends its group: it is raised to the level of the blocks before it
        root = tree.close(None if first == 0 and len(block) < size else levels)
        block = block.append_column("witness", pa.array([b"".join(w) for w in tree.witness], pa.binary()))
        return block.append_column("root", pa.array([root] + [None] * (len(block) - 1), pa.string()))

    dealt = nodes.withColumn("block", F.shiftright("idx", levels))
    schema = T.StructType([*dealt.schema.fields, T.StructField("witness", T.BinaryType()), T.StructField("root", T.StringType())])
    return cut(dealt.groupBy("group", "block").applyInArrow(append, schema))


def _above(lower: DataFrame, levels: int) -> DataFrame:
    """For each block of ``lower``: (group, block, above, top), the witness of its
    root in the tree above, and the digest at the top of its group."""
    roots = lower.where("root is not null").select("group", F.col("block").alias("idx"), F.col("root").alias("digest"))
    if roots.where("idx > 0").isEmpty():
        return roots.select("group", F.col("idx").alias("block"), F.lit(b"").alias("above"), F.col("digest").alias("top"))
    upper = _block_roots(roots, levels)
    higher = _above(upper, levels).select(F.col("group").alias("g"), F.col("block").alias("b"), F.col("above").alias("rest"), "top")
    return (upper.join(higher, upper["group"].eqNullSafe(higher["g"]) & (upper["block"] == higher["b"]))
            .select("group", F.col("idx").alias("block"), F.concat("witness", "rest").alias("above"), "top"))


def _tree(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    lower = _block_roots(nodes, levels)
    return lower, _above(lower, levels)


def manifest(df: DataFrame, digest_of: Column, group: str, order: str, claim: Column | None = None,
             keep: Sequence[str] = (), levels: int = BLOCK_LEVELS) -> DataFrame:
    """``keep`` and, for every row: leaf, subroot (of its group), root, witness
    (steps from leaf to root), proof_sha256 (of all siblings, leaf to root),
    folded_root (from ``claim``, or the leaf where it is null, by the witness) and
    verified (whether that is the root)."""
    spark = df.sparkSession
    ship(spark)
    names = [f"k{i}" for i in range(len(keep))]
    rows = df.select(F.col(group).alias("group"), F.col(order).alias("order"), digest_of.alias("digest"),
                     (F.lit(None).cast("string") if claim is None else claim).alias("claim"),
                     *[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)])
    placed = ordinal(rows, ["group"], [F.col("order").asc_nulls_first(), F.col("digest")], "idx")
    lower, above = _tree(placed.drop("order").withColumn("idx", F.col("idx") - 1), levels)

    tops = above.where("block = 0").select(F.lit(0).alias("group"), F.col("group").alias("of"), F.col("top").alias("digest"))
    ranked = ordinal(tops, ["group"], [F.col("of").asc_nulls_first()], "idx").withColumn("idx", F.col("idx") - 1)
    last, over = _tree(ranked, levels)
    root = over.select("top").first()
    over = over.select(F.col("block").alias("b"), F.col("above").alias("rest"))
    by_group = last.join(over, last["block"] == over["b"]).select(F.col("of").alias("g"), F.concat("witness", "rest").alias("last"))
    above = above.join(by_group, above["group"].eqNullSafe(by_group["g"])).select(
        F.col("group").alias("g"), F.col("block").alias("b"), F.concat("above", "last").alias("rest"), F.col("top").alias("subroot"))
    out = lower.join(above, lower["group"].eqNullSafe(above["g"]) & (lower["block"] == above["b"])).select(
        *names, F.col("digest").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"),
        "claim", F.concat("witness", "rest").alias("witness"))

    def prove(batches):
        for batch in batches:
            proofs, folded = [], []
            for node, claimed, w in zip(*(batch.column(c).to_pylist() for c in ("leaf", "claim", "witness")), strict=True):
                proofs.append(digest("".join(d for _, d in steps(w))))
                folded.append(fold(claimed or node, w))
            yield batch.append_column("proof_sha256", pa.array(proofs, pa.string())).append_column("folded_root", pa.array(folded, pa.string()))

    text = T.StringType()
    out = out.mapInArrow(prove, T.StructType([*out.schema.fields, T.StructField("proof_sha256", text), T.StructField("folded_root", text)]))
    own = ["leaf", "subroot", "root", "witness", "proof_sha256", "folded_root"]
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep, strict=True)], *[F.col(c).alias(fresh(keep, c)) for c in own],
                      (F.col("folded_root") == F.col("root")).alias(fresh(keep, "verified")))
