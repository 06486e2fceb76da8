r"""Operator 6: repeated passages removed, by fixed-block anchors.

A passage of ``window`` words that two documents share holds a whole block of
``(window + 1) // 2`` words that starts at a multiple of that size in the first
of them.  So only those non-overlapping blocks are indexed, and every rolling
window of block size probes them.  A block is live if it is some document's
reference block and stands in two documents or more.  Around live places the
whole windows are read out and matched exactly (by 96 bits of hash) against the
smallest document that has them; the union of matched windows is the maximal
exact repeat, and its words go.

Documents are dealt to batches by their id.  A batch sends each distinct hash
once to the hash's owner, with two flags instead of its documents, and gets back
the live ones: a passage in a third of all documents costs one entry a batch,
and no pairs of documents are made.  Entries travel packed, five bytes each.

Null text has no words.  A row without id removes nothing and loses nothing;
rows with one id are one document's and do not remove each other.  Texts
shorter than a window stay whole.  A very long text is windowed in its row.
Extra columns pass through.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ship, shuffle_parts

WINDOW = 13
BATCH_TEXT = 6 << 20      # characters of text a batch
MOST_OWNERS = 1 << 18
MEMORY = 400_000
MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Hashes(dict):
    """Word to 64-bit hash, remembered within bounds."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


class Batch:
    """The words of a batch's texts as one array of hashes."""

    def __init__(self, texts, ids):
        counts, arrays = [], []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").split()
            counts.append(len(words))
            arrays.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
        self.counts = np.array(counts, np.int64)
        self.words = np.concatenate([np.array([], np.uint64), *arrays])
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.doc = np.repeat(np.arange(len(counts)), self.counts)
        self.has_id = np.array([i is not None for i in ids], bool)

    def whole(self, size: int) -> np.ndarray:
        """Where a window of ``size`` words of one document with an id begins."""
        at = np.arange(len(self.words))
        return at[(at + size <= self.ends[self.doc]) & self.has_id[self.doc]]

    def rolling(self, size: int, which: int = 0) -> np.ndarray:
        """Hash of the window at every place (those across documents as well)."""
        n = max(0, len(self.words) - size + 1)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = (h ^ (h >> np.uint64(29))) * MULTIPLY[which] + self.words[k:k + n]
        h = (h ^ (h >> np.uint64(32))) * MULTIPLY[1 - which]
        return h ^ (h >> np.uint64(29))


def _groups(sorted_: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """First place of each run of equal rows."""
    new = np.ones(len(sorted_), bool)
    if len(sorted_):
        new[1:] = sorted_[1:] != sorted_[:-1]
        for m in more:
            new[1:] |= m[1:] != m[:-1]
    return np.flatnonzero(new)


def _owner(h: np.ndarray, owners: int) -> np.ndarray:
    return ((h & np.uint64(MOST_OWNERS - 1)) * np.uint64(owners)) >> np.uint64(18)


def _pack(x: np.ndarray) -> bytes:
    """Ascending 48-bit numbers: how many have each first byte, then the other
    five bytes of each."""
    first = np.bincount((x >> np.uint64(40)).astype(np.int64), minlength=256).astype("<u4")
    return first.tobytes() + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, "<u4", 256)
    out = np.zeros((int(first.sum()), 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8, offset=1024).reshape(-1, 5)
    return out.view("<u8").ravel() | np.repeat(np.arange(256, dtype=np.uint64) << np.uint64(40), first)


def _planes(rows: np.ndarray) -> bytes:
    """Records byte by byte: all first bytes, all second ones...; the bytes that
    ids hardly use lie together and compress to nothing."""
    return np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T).tobytes()


def _rows(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _dealt(owner: np.ndarray, pack, **columns) -> pa.Table:
    """One row for each owner: its part of the entries, packed."""
    order = np.argsort(owner, kind="stable")
    at = _groups(owner[order])
    ends = np.append(at[1:], len(order))
    rows = [pack(order[a:b]) for a, b in zip(at, ends, strict=True)]
    names = pa.array(owner[order][at].astype(np.int64))
    return names, pa.array(rows, pa.binary())


SENT = T.StructType([T.StructField("owner", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("data", T.BinaryType())])
ENTRY = np.dtype([("h", "<u8"), ("g", "<u4"), ("least", "<i8"), ("many", "u1")])
ANSWER = np.dtype([("h", "<u8"), ("g", "<u4"), ("least", "<i8")])


def _table(owner, batch, data) -> pa.Table:
    return pa.table({"owner": owner, "batch": batch, "data": data},
                    schema=pa.schema([("owner", pa.int64()), ("batch", pa.int64()), ("data", pa.binary())]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None,
                   window: int = WINDOW, batch_text: int = BATCH_TEXT, kept_text: bool = False) -> DataFrame:
    """``keep`` columns (default: all but the text) with n_words, n_removed,
    kept_sha256, removed (first and last word of each run that went) and, if
    asked, kept_text: the words that stay, joined by a space."""
    spark = docs.sparkSession
    ship(spark)
    block = (window + 1) // 2
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    names = []
    for c in ("n_words", "n_removed", "kept_sha256", "removed", *["kept_text"] * kept_text):
        names.append(fresh([*keep, *names], c))
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    batches = shuffle_parts(spark, -(-size // batch_text))
    owners = min(batches, MOST_OWNERS)
    dealt = docs.select(F.struct(*[docs[c] for c in keep]).alias("kept"), docs[id_col].cast("long").alias("id"),
                        docs[text].alias("text"), F.pmod(F.xxhash64(docs[id_col]), F.lit(batches)).cast("long").alias("batch"))

    def of(table: pa.Table) -> Batch:
        return Batch((t.as_py() for t in table.column("text")), table.column("id").to_pylist())

    def one(table: pa.Table, column: str) -> int:
        return table.column(column)[0].as_py()

    def ask_blocks(table: pa.Table) -> pa.Table:
        b = of(table)
        at = b.whole(block)
        h = b.rolling(block)[at]
        order = np.argsort(h, kind="stable")
        h, doc = h[order], b.doc[at][order]
        ref = ((at - b.starts[b.doc[at]]) % block == 0)[order]
        run = _groups(h)
        if not len(run):
            return _table([], [], [])
        many = np.maximum.reduceat(doc, run) != np.minimum.reduceat(doc, run)
        flags = np.maximum.reduceat(ref.astype(np.uint64), run) * np.uint64(2) + many.astype(np.uint64)
        h = h[run]
        owner, data = _dealt(_owner(h, owners), lambda i: _pack((h[i] >> np.uint64(18)) << np.uint64(2) | flags[i]))
        return _table(owner, pa.array([one(table, "batch")] * len(owner), pa.int64()), data)

    def live_blocks(table: pa.Table) -> pa.Table:
        parts = [_unpack(d.as_py()) for d in table.column("data")]
        of_batch = np.repeat(table.column("batch").to_numpy(), [len(p) for p in parts])
        x = np.concatenate(parts)
        order = np.argsort(x >> np.uint64(2), kind="stable")
        x, of_batch = x[order], of_batch[order]
        run = _groups(x >> np.uint64(2))
        flags = np.bitwise_or.reduceat(x & np.uint64(3), run)
        n = np.diff(np.append(run, len(x)))
        live = np.repeat((flags >= 2) & ((n > 1) | (flags == 3)), n)
        x, of_batch = x[live] >> np.uint64(2), of_batch[live]
        if not len(x):
            return _table([], [], [])
        batch, data = _dealt(of_batch, lambda i: _pack(x[i]))
        return _table(pa.array([one(table, "owner")] * len(batch), pa.int64()), batch, data)

    def candidates(b: Batch, live: pa.Table) -> np.ndarray:
        """Places of whole windows that hold a live block."""
        at = b.whole(block)
        found = [_unpack(d) << np.uint64(18) | np.uint64(o) for o, d in
                 zip(live.column("owner").to_pylist(), live.column("data").to_pylist(), strict=True)]
        if not found or not len(at):
            return at[:0]
        found = np.sort(np.concatenate(found))
        h = b.rolling(block)[at]
        key = (h >> np.uint64(18)) << np.uint64(18) | _owner(h, owners)
        hit = found[np.minimum(np.searchsorted(found, key), len(found) - 1)] == key
        sums = np.zeros(len(b.words) + window + 1, np.int64)
        sums[at[hit] + 1] = 1
        sums = np.cumsum(sums)
        whole = b.whole(window)
        return whole[sums[whole + window - block + 1] > sums[whole]]

    def keys(b: Batch, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return np.array([], np.uint64), np.array([], np.uint32)
        return b.rolling(window, 0)[at], (b.rolling(window, 1)[at] >> np.uint64(32)).astype(np.uint32)

    def ask_windows(table: pa.Table, live: pa.Table) -> pa.Table:
        if not table.num_rows or not live.num_rows:
            return _table([], [], [])
        b = of(table)
        at = candidates(b, live)
        if not len(at):
            return _table([], [], [])
        h, g = keys(b, at)
        ids = b.ids[b.doc[at]]
        order = np.lexsort((g, h))
        h, g, ids = h[order], g[order], ids[order]
        run = _groups(h, g)
        entry = np.zeros(len(run), ENTRY)
        entry["h"], entry["g"] = h[run], g[run]
        entry["least"] = np.minimum.reduceat(ids, run)
        entry["many"] = np.maximum.reduceat(ids, run) != entry["least"]
        owner, data = _dealt(_owner(entry["h"], owners), lambda i: _planes(entry[i]))
        return _table(owner, pa.array([one(table, "batch")] * len(owner), pa.int64()), data)

    def least_documents(table: pa.Table) -> pa.Table:
        parts = [_rows(d.as_py(), ENTRY) for d in table.column("data")]
        of_batch = np.repeat(table.column("batch").to_numpy(), [len(p) for p in parts])
        x = np.concatenate(parts)
        order = np.lexsort((x["g"], x["h"]))
        x, of_batch = x[order], of_batch[order]
        run = _groups(x["h"], x["g"])
        least = np.repeat(np.minimum.reduceat(x["least"], run), np.diff(np.append(run, len(x))))
        need = (x["many"] > 0) | (x["least"] > least)
        out = np.zeros(int(need.sum()), ANSWER)
        out["h"], out["g"], out["least"], of_batch = x["h"][need], x["g"][need], least[need], of_batch[need]
        if not len(out):
            return _table([], [], [])
        batch, data = _dealt(of_batch, lambda i: _planes(out[i]))
        return _table(pa.array([one(table, "owner")] * len(batch), pa.int64()), batch, data)

    kept_type = [f for f in dealt.schema.fields if f.name == "kept"][0]
    runs = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    kinds = [T.LongType(), T.LongType(), T.StringType(), runs, *[T.StringType()] * kept_text]
    schema = T.StructType([kept_type, *[T.StructField(f"_{k}", t) for k, t in enumerate(kinds)]])

    def cut_out(table: pa.Table, answers: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        b = of(table)
        gone = np.zeros(len(b.words) + 1, np.int64)
        parts = [_rows(d, ANSWER) for d in answers.column("data").to_pylist()]
        known = np.concatenate(parts) if parts else np.zeros(0, ANSWER)
        if len(known):
            known = known[np.lexsort((known["g"], known["h"]))]
            at = b.whole(window)
            h = b.rolling(window, 0)[at]
            first = np.searchsorted(known["h"], h)
            maybe = known["h"][np.minimum(first, len(known) - 1)] == h
            at, first = at[maybe], first[maybe]
            h, g = keys(b, at)
            ids = b.ids[b.doc[at]]
            done = np.zeros(len(at), bool)
            while not done.all():                  # next entry of the same first hash, if any
                same = ~done & (first < len(known))
                same[same] = known["h"][first[same]] == h[same]
                done |= ~same
                match = same.copy()
                match[same] = known["g"][first[same]] == g[same]
                over = match.copy()
                over[match] = known["least"][first[match]] < ids[match]
                np.add.at(gone, at[over], 1)
                np.add.at(gone, at[over] + window, -1)
                done |= match
                first = first + 1
        gone = np.cumsum(gone)[:-1] > 0
        cols = [[] for _ in kinds]
        for k, t in enumerate(table.column("text")):
            out = gone[b.starts[k]:b.ends[k]]
            n = int(out.sum())
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
            edges = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]]))).tolist() if n else []
            if n:
                words = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
            stays = b" ".join(words)
            row = (len(out), n, hashlib.sha256(stays).hexdigest(),
                   [{"first": i, "last": j - 1} for i, j in zip(edges[::2], edges[1::2], strict=True)])
            for c, v in zip(cols, (*row, *[stays.decode("utf-8", "surrogatepass")] * kept_text), strict=True):
                c.append(v)
        arrow = to_arrow_schema(schema)
        return pa.table([table.column("kept"), *[pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:], strict=True)]],
                        names=[f.name for f in schema.fields])

    asked = dealt.groupBy("batch").applyInArrow(ask_blocks, SENT)
    live = asked.groupBy("owner").applyInArrow(live_blocks, SENT)
    wanted = dealt.groupBy("batch").cogroup(live.groupBy("batch")).applyInArrow(ask_windows, SENT)
    answers = wanted.groupBy("owner").applyInArrow(least_documents, SENT)
    out = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(cut_out, schema)
    return out.select(*[F.col("kept")[c].alias(c) for c in keep], *[F.col(f"_{k}").alias(n) for k, n in enumerate(names)])
