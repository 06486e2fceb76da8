"""Operator 3: SimHash near-duplicates by a binary-trie self-join.

Fingerprints (one 64-bit number a document) are first made distinct, so copies
cost one entry.  The join walks a binary trie over them with itself: a pair of
nodes carries the bits in which its prefixes differ and is dropped beyond
``max_bits``.  The top of the walk is done by Spark: every fingerprint joins
the node pairs that its prefix can be in (its own node and those of prefixes
that differ in at most ``max_bits`` bits); a pair with too many rows goes down
more levels, again and again, so a dense part of the trie is dealt to many
tasks however skewed the fingerprints are.  Inside a pair the walk goes on over
sorted arrays.  A fingerprint has at most 2,080 others within two bits, so
links grow in proportion to the input, and each task passes on a spanning
forest of its links.  Components come from rounds of hooking and pointer
jumping over tables, cut by checkpoints.

Null text is empty; a text without words has fingerprint zero and links like
any other.  Repeated rows and repeated ids stay as they are.  A row without id
gets the component's smallest id; null if the component has none.  A very long
text is hashed in runs of shingles.  Of other columns those asked for pass
through.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_BYTES, cut, fresh, ship, shuffle_parts

SHINGLE = 3
MAX_BITS = 2
SEED = 42
LEAF_ROWS = 16_384        # rows of a node pair that one task walks
CHUNK = 1 << 16           # hashes counted at once
SALTS = 32


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is set if over half the shingle hashes have it."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return h(b" ".join(words), seed)
    if size == 3:
        hashes = [h(b"%b %b %b" % w, seed) for w in zip(words, words[1:], words[2:])]
    else:
        hashes = [h(b" ".join(words[i:i + size]), seed) for i in range(len(words) - size + 1)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = np.array(hashes[k:k + CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    kept = [f for c in keep for f in docs.schema.fields if f.name == c]
    name, at = fresh(keep, "fp"), fresh([*keep, "fp"], "_text")

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(fps)], names=[*keep, name])

    return docs.select(*[docs[c] for c in keep], docs[text].alias(at)).mapInArrow(
        run, T.StructType([*kept, T.StructField(name, T.LongType())]))


def _halves(sorted_fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where each node's rows with ``bit`` set begin."""
    above = np.uint64((0xFFFFFFFFFFFFFFFF << (bit + 1)) & 0xFFFFFFFFFFFFFFFF)
    first = (sorted_fps[lo] & above) | np.uint64(1 << bit)
    return np.clip(np.searchsorted(sorted_fps, first), lo, hi)


def walk(a: np.ndarray, b: np.ndarray | None, depth: int, errors: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sorted distinct fingerprints within ``max_bits``, one of ``a``
    and one of ``b`` (None: two of ``a``), whose first ``depth`` bits differ in
    ``errors``."""
    own, b = b is None, a if b is None else b
    left, right = [], []
    alo, ahi = np.array([0]), np.array([len(a)])
    blo, bhi, err = alo, np.array([len(b)]), np.array([errors], np.int8)
    for bit in range(63 - depth, -1, -1):
        if not len(alo):
            break
        # nodes of one row each: what is left of the walk is their difference
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            x, y = alo[single], blo[single]
            near = np.bitwise_count(a[x] ^ b[y]) <= max_bits
            if own:
                near &= x < y
            left.append(a[x[near]])
            right.append(b[y[near]])
            alo, ahi, blo, bhi, err = (v[~single] for v in (alo, ahi, blo, bhi, err))
        am, bm = _halves(a, alo, ahi, bit), _halves(b, blo, bhi, bit)
        kids = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1)]
        # a node with itself: the two mixed pairs are one and the same
        other = (am, ahi, blo, bm, err + 1)
        kids.append(tuple(v[alo != blo] for v in other) if own else other)
        alo, ahi, blo, bhi, err = (np.concatenate(v) for v in zip(*kids, strict=True))
        on = (ahi > alo) & (bhi > blo) & (err <= max_bits)
        if own:
            on &= ~((alo == blo) & (ahi - alo == 1) & (bhi - blo == 1))
        alo, ahi, blo, bhi, err = (v[on] for v in (alo, ahi, blo, bhi, err))
    if len(alo):                                   # all bits walked: one row each
        left.append(a[alo])
        right.append(b[blo])
    none = np.array([], np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    u, v = at[: len(x)], at[len(x):]
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        np.minimum.at(low, root[u], root[v])
        np.minimum.at(low, root[v], root[u])
        low = low[low[root]]
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up
        if (low == root).all():
            break
        root = low
    # a heap-shaped tree over each component: no node has more than three links
    order = np.lexsort((nodes, root))
    first = np.searchsorted(root[order], root[order])
    place = np.arange(len(nodes)) - first
    child = place > 0
    return nodes[order[child]], nodes[order[first[child] + (place[child] - 1) // 2]]


def _masks(bits: int, errors: int) -> list[int]:
    """Numbers of ``bits`` bits with at most ``errors`` set."""
    out = [0]
    for _ in range(errors):
        out += [m | 1 << k for m in out for k in range(bits) if not m >> k & 1]
    return sorted(set(out))


def links(fps: DataFrame, max_bits: int = MAX_BITS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Forest (a, b) of the links among the distinct values of column ``fp``."""
    spark = fps.sparkSession
    n = fps.count()
    depth = min(40, max(0, (max(n, 1) // leaf_rows).bit_length()))

    def prefix(d: int):
        return F.shiftrightunsigned("fp", 64 - d) if d else F.lit(0).cast("long")

    def pairs(rows: DataFrame, masks) -> DataFrame:
        rows = rows.select("*", F.explode(masks).alias("m"))
        other = F.col("p").bitwiseXOR(F.col("m"))
        return rows.select(F.least("p", other).alias("a"), F.greatest("p", other).alias("b"), "fp")

    flat = F.array(*[F.lit(m).cast("long") for m in _masks(depth, max_bits)])
    level = pairs(fps.select("fp", prefix(depth).alias("p")), flat)
    done = []
    while True:
        if depth >= 63:
            done.append(level.withColumn("depth", F.lit(depth)))
            break
        big = cut(level.groupBy("a", "b").count().where(F.col("count") > 2 * leaf_rows).select("a", "b"))
        if big.isEmpty():
            done.append(level.withColumn("depth", F.lit(depth)))
            break
        done.append(level.join(big, ["a", "b"], "left_anti").withColumn("depth", F.lit(depth)))
        more = min(6, 64 - depth)
        if depth + more > 63:
            more = 63 - depth
        depth += more
        inside = level.join(big, ["a", "b"], "left_semi")
        # the node's own side goes to children of either node of the pair
        spent = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        choice = F.lit(None).cast("array<long>")
        for e in range(max_bits, -1, -1):
            choice = F.when(spent == max_bits - e, F.array(*[F.lit(m).cast("long") for m in _masks(more, e)])).otherwise(choice)
        child = inside.select("fp", prefix(depth).alias("p"), F.explode(choice).alias("low"),
                              F.shiftleft(F.col("a").bitwiseXOR(F.col("b")), more).alias("high"))
        other = F.col("p").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))
        level = child.select(F.least("p", other).alias("a"), F.greatest("p", other).alias("b"), "fp")
    rows = done[0]
    for more_rows in done[1:]:
        rows = rows.unionByName(more_rows)
    ship(spark)

    def join(table: pa.Table) -> pa.Table:
        first, second, depth_ = (table.column(c)[0].as_py() for c in ("a", "b", "depth"))
        fp = np.unique(table.column("fp").to_numpy().view(np.uint64))
        if first == second:
            x, y = walk(fp, None, depth_, 0, max_bits)
        else:
            side = (fp >> np.uint64(64 - depth_)) == np.uint64(first)
            x, y = walk(fp[side], fp[~side], depth_, (first ^ second).bit_count(), max_bits) if side.any() and not side.all() else (fp[:0], fp[:0])
        x, y = forest(x, y)
        return pa.table({"a": x.view(np.int64), "b": y.view(np.int64)})

    return rows.groupBy("depth", "a", "b").applyInArrow(join, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node.

    Each round: a root takes the least root that a neighbour of its nodes has,
    then that one's own root, and its nodes follow.  Edges join by nodes of few
    links; the nodes of one root, maybe a third of all, join in ``SALTS`` parts."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        hooks = cut(roots.join(near, roots["node"] == near["a"]).groupBy("root").agg(
            F.least(F.min("near"), F.col("root")).alias("next")))
        if hooks.where("next <> root").isEmpty():
            return roots
        label = roots.select("node", F.col("root").alias("label"))
        jumps = hooks.join(label, hooks["next"] == label["node"]).select("root", F.least("next", "label").alias("to"))
        own = roots.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        roots = cut(own.join(jumps.withColumn("salt", salts), ["root", "salt"]).select("node", F.col("to").alias("root")))


def near_duplicates(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text",
                    size: int = SHINGLE, max_bits: int = MAX_BITS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``keep`` columns, then fingerprint (hex), component_id (smallest id of the
    component) and component (hex of its smallest fingerprint); a name that
    clashes gets an underscore.  The kept columns are written once between
    the steps, so keep narrow ones."""
    fp, own = "_fp", "_id"
    new = []
    for c in ("fingerprint", "component_id", "component"):
        new.append(fresh([*keep, *new], c))
    narrow = docs.select(F.struct(*[docs[c] for c in keep]).alias("_kept"), docs[id_col].alias(own), docs[text].alias("_text"))
    rows = cut(fingerprints(narrow, ["_kept", own], "_text", size).withColumnRenamed("fp", fp))
    distinct = cut(rows.groupBy(fp).agg(F.min(own).alias("least")))
    found = components(cut(links(distinct.select(F.col(fp).alias("fp")), max_bits, leaf_rows)))
    classes = distinct.join(found, distinct[fp] == found["node"], "left").select(
        fp, "least", F.coalesce("root", fp).alias("class"))
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    to_class = classes.join(least, "class").select(fp, "class", "component_id")

    def hexed(c):
        return F.lpad(F.lower(F.hex(c)), 16, "0")

    return rows.join(to_class, fp).select(
        *[F.col("_kept")[c].alias(c) for c in keep], hexed(fp).alias(new[0]),
        F.col("component_id").alias(new[1]), hexed("class").alias(new[2]))


def survivors(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each component, whole: that with the smallest id (then the
    smallest hash of the text); rows that are equal in both count once."""
    h, flag, number, none = (fresh(docs.columns, c) for c in ("_hash", "_first", "_number", "_none"))
    # keys without nulls: the join's exchange of the texts then serves the last step, too
    marked = docs.withColumn(h, F.xxhash64(text)).withColumn(none, F.isnull(id_col)) \
        .withColumn(number, F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    narrow = marked.select(F.col(id_col).alias("id"), F.col(h).alias("hash"), F.col(text).alias("text"))
    found = near_duplicates(narrow, ["id", "hash"], "id", "text", **how)
    best = found.groupBy("component").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "hash")).alias(flag))
    best = best.select(F.col(flag)["none"].alias(none), F.coalesce(F.col(flag)["id"].cast("long"), F.lit(0)).alias(number), F.col(flag)["hash"].alias(h)).distinct()
    keys = [number, none, h]
    return marked.join(best, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
