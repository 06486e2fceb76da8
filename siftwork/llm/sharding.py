"""Operator 7: shards of equal bytes by a histogram sort, DataFrame functions only.

Documents are ordered by (hash of the text, id), so equal texts stand together.
The borders between shards are found by counting: each round splits the stretch
of keys in which a border lies into equal steps, sums the exact bytes below
each step over all partitions (a few hundred sums, whatever the input), and
keeps the step that holds the border's target.  A border is done when the bytes
below it are within ``tolerance`` of a shard of its target, or when its stretch
is one key.  Hashes are refined first; if a single text's copies outweigh the
tolerance, the border moves inside them by id.  So a shard border splits a
group of equal texts only if the group is larger than the tolerance.

With the borders known, every row knows its shard and goes through one
exchange by (shard, hash, id), which also splits a large group of equal texts;
a row's slot is its place in its task plus the rows of the shard before it.

Null text weighs 1 byte and has the checksum of the empty text; rows that are
equal in text and id are neighbours and keep their own slots; a null id stands
before all others; a very long text weighs what it weighs and is not split; an
empty table has no rows.  Extra columns pass through; a
clashing name gets an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinal import ordinal
from .common import cut, fresh

SHARDS = 8
BITS = 12                 # a round looks at so many more bits of the key
TOLERANCE = 0.001
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def refine(keys: DataFrame, key: str, targets: list[int], tolerance: float) -> list[tuple[int, int, int]]:
    """For each target (border, bytes below it, bytes below the next number or
    -1): the border is near enough to the target, or, if the last is not -1, it
    is the one number whose rows hold the target.

    A round counts the bytes under every step of the stretches (numbers that
    share their first bits) in which a border still lies."""
    done: dict[int, tuple[int, int, int]] = {}
    stretch = {k: (0, 0) for k in range(len(targets))}       # target -> first bits, bytes below
    used = 0
    while len(done) < len(targets):
        now = min(used + BITS, 64)
        rows = keys
        if used:
            first = sorted({stretch[k][0] for k in stretch if k not in done})
            rows = keys.where(F.shiftright(key, 64 - used).isin(first))
        counted = sorted((r["step"], r["bytes"]) for r in rows.groupBy(
            (F.shiftright(key, 64 - now) if now < 64 else F.col(key)).alias("step")).agg(F.sum("size").alias("bytes")).collect())
        for k, target in enumerate(targets):
            if k in done:
                continue
            bits, below = stretch[k]
            for step, size in counted:
                if used and step >> (now - used) != bits:
                    continue
                if below + size > target or target == below:
                    break
                below += size
            else:                                  # nothing beyond the target
                done[k] = (HIGH, below, -1)
                continue
            start = step << (64 - now)
            if target - below <= tolerance:
                done[k] = (start, below, -1)
            elif now == 64:
                done[k] = (start, below, below + size)
            elif below + size - target <= tolerance and step + 1 < 1 << (now - 1):
                done[k] = ((step + 1) << (64 - now), below + size, -1)
            else:
                stretch[k] = (step, below)
        used = now
    return [done[k] for k in range(len(targets))]


def borders(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The (hash, id) at which each shard but the first begins."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = [total * k // shards for k in range(1, shards)]
    near = tolerance * total / shards
    out = []
    for target, (h, below, above) in zip(targets, refine(keys, "h", targets, near), strict=True):
        if target - below <= near or above < 0:
            out.append((h, LOW))
        elif above - target <= near:
            out.append((h + 1, LOW) if h < HIGH else (h, HIGH))
        else:                                      # inside the copies of one text
            same = keys.where(F.col("h") == h)
            out.append((h, refine(same, "id", [target - below], near)[0][0]))
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None,
          shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``keep`` columns (default: all) with size, text_crc32, shard and slot."""
    keep = docs.columns if keep is None else keep
    t = F.coalesce(F.col(text), F.lit(""))
    keys = cut(docs.select(
        F.struct(*[docs[c] for c in keep]).alias("kept"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("id"),
        F.xxhash64(t).alias("h"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc")))
    number = F.lit(0)
    for h, i in borders(keys, shards, tolerance):
        number = number + F.when((F.col("h") > h) | ((F.col("h") == h) & (F.col("id") >= i)), 1).otherwise(0)
    placed = ordinal(keys.withColumn("shard", number), ["shard"], ["h", "id"], name="slot")
    names = []
    for c in ("size", "text_crc32", "shard", "slot"):
        names.append(fresh([*keep, *names], c))
    return placed.select(*[F.col("kept")[c].alias(c) for c in keep], F.col("size").alias(names[0]),
                         F.col("crc").alias(names[1]), F.col("shard").alias(names[2]),
                         (F.col("slot") - 1).alias(names[3]))
