"""Operator 11: cost-balanced packing of token ids into sequences.

A document of n tokens costs ``n + n * n / (6 * WIDTH)``: work that grows with the
tokens, and attention, which grows with their square (``WIDTH`` is the model's
width).  Documents are encoded once; what fills whole sequences becomes such
sequences, and what remains is packed, in descending order of cost, each piece
into the sequence of lowest cost that has room for it.  A piece that no sequence
has room for is cut: the roomiest sequence takes what it can.

Rows are dealt to blocks evenly, whatever their id or text, and a block is packed
in one task: at most some ``BLOCK_SEQUENCES`` sequences of remains.  Its sequences
hold exactly its tokens: whole ones, and one of each power of two that the rest is
the sum of, so that nothing is padded.  Blocks are random parts of the rows, so
that their costs agree too.

Null text is empty; an empty text is its end id alone; repeated rows, rows of one
id and rows without id are each a document; equal costs go by id, then row.  A
very long text is many whole sequences, encoded in one task.  Other columns are
not kept.  An empty table has no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .pieces import encoder

WIDTH = 1024              # of the model whose cost is estimated
BLOCK_SEQUENCES = 1024
BLOCK_ROWS = 50_000
TEXTS = 512               # texts encoded together
NUMBERS = 32              # bits of a sequence's number inside its block


def cost(n):
    """In units of one token's work without attention; exact for whole numbers."""
    return 6 * WIDTH * n + n * n


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def capacities(tokens: int, length: int) -> np.ndarray:
    """Room of sequences that hold ``tokens`` exactly: whole ones, then powers of two."""
    rest = tokens % length
    parts = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return np.array([length] * (tokens // length) + parts, np.int64)


def assign(sizes: list[int], length: int) -> list[tuple[int, int, int, int]]:
    """(piece, taken before, taken, sequence), in the order of assignment, for
    pieces in descending order of cost."""
    room = capacities(sum(sizes), length)
    load = np.zeros(len(room), np.int64)
    never = np.iinfo(np.int64).max
    out = []
    for i, size in enumerate(sizes):
        done = 0
        while done < size:
            left = size - done
            open_for = np.where(room >= left, load, never)
            s = int(open_for.argmin())
            if open_for[s] == never:
                s = int(np.where(room == room.max(), load, never).argmin())
            n = min(left, int(room[s]))
            room[s] -= n
            load[s] += cost(n)
            out.append((i, done, n, s))
            done += n
    return out


def encoded(docs: DataFrame, tokenizer_file: str, id_col: str, text: str, end: int, length: int, ids: bool) -> DataFrame:
    """Per row: doc_id, row, n_tokens, checksums of its whole sequences (and, if
    asked, their packed ids), and the packed ids that remain; written to the shared
    folder, so that texts are encoded once and ``row`` stays."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def encode(batches):
        enc = encoder(spec.value)
        for batch in batches:
            for k in range(0, len(batch), TEXTS):
                part = batch.slice(k, TEXTS)
                n, whole, bodies, rest = [], [], [], []
                for packed in enc.encode_some(part.column("text").to_pylist(), end):
                    own = np.frombuffer(packed, enc.width)
                    full = len(own) // length * length
                    parts = [own[a:a + length] for a in range(0, full, length)]
                    n.append(len(own))
                    whole.append(list(map(crc, parts)))
                    bodies.append([x.tobytes() for x in parts] if ids else None)
                    rest.append(own[full:].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(whole, pa.list_(pa.int64())), pa.array(bodies, pa.list_(pa.binary())),
                     pa.array(rest, pa.binary()), pa.array([int(enc.width[2:])] * len(n), pa.int64())],
                    names=["doc_id", "n_tokens", "whole", "bodies", "rest", "width"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = cut(d.mapInArrow(encode, "doc_id long, n_tokens long, whole array<long>, bodies array<binary>, rest binary, width long"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text: str = "text", end: int = 0,
         length: int = 1024, block_sequences: int = BLOCK_SEQUENCES, ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, if asked, ids."""
    rows = encoded(docs, tokenizer_file, id_col, text, end, length, ids)
    n, tokens = rows.agg(F.count(F.lit(1)), F.sum(F.col("n_tokens") % length)).first()
    blocks = max(1, -(-(tokens or 0) // (block_sequences * length)), -(-n // BLOCK_ROWS))

    def place(block: pa.Table) -> pa.Table:
        block = block.append_column("size", pa.array([n % length for n in block.column("n_tokens").to_pylist()], pa.int64()))
        block = block.sort_by([("size", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
        doc, total, size, whole = (block.column(c).to_pylist() for c in ("doc_id", "n_tokens", "size", "whole"))
        rest, bodies, width = block.column("rest"), block.column("bodies"), f"<u{block.column('width')[0].as_py()}"
        first = block.column("block")[0].as_py() << NUMBERS
        out = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}

        def put(i, start, n, checksum, sequence, offset, own):
            for c, v in zip(out, (doc[i], start, n, checksum, total[i], first + sequence, offset, own), strict=True):
                out[c].append(v)

        filled: dict[int, int] = {}
        pieces = assign(size, length)
        for i, done, n, s in pieces:
            own = np.frombuffer(rest[i].as_py(), width)[done:done + n]
            put(i, total[i] - size[i] + done, n, crc(own), s, filled.get(s, 0), own.astype(np.int32) if ids else None)
            filled[s] = filled.get(s, 0) + n
        s = len(filled)
        for i, checksums in enumerate(whole):
            own = bodies[i].as_py() if ids else None
            for k, checksum in enumerate(checksums):
                put(i, k * length, length, checksum, s, 0, np.frombuffer(own[k], width).astype(np.int32) if ids else None)
                s += 1
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long, ids array<int>")
    # by row, not by id: any number of rows may share an id
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    out = dealt.groupBy("block").applyInArrow(place, schema)
    return out if ids else out.drop("ids")
