"""Operator 2: token ids as length-delimited binary records.

A record is a little-endian frame: length of the payload (8 bytes), masked
checksum of those 8 bytes (4), payload, masked checksum of the payload (4), and
a closing byte.  The payload is the document's number (8 bytes) and its ids,
two bytes each if the vocabulary fits, else four.  The checksum is CRC-32,
turned right by 15 bits plus a constant, so that a checksum stored among data
is not mistaken for one of it.

Spark's writer commits the files (one a task, records in ascending number), so
lost tasks leave none.  The index stands apart: file, place, length, number,
tokens, and tokens before it in the file.  ``read`` takes files back in, checks
every frame, and ``lookup`` reads chosen records by their place.

Null text is empty; an empty text is a record of the end id alone.  Repeated
numbers are each a record.  Rows without number stand first, as number
-2**63; they, and rows of one number, spread over files in table order.  A very
long text is one record.  Columns other than number and text are not written.
An empty table gives files without records.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship
from .pieces import encoder

# Fixed values of the frame.
MASK = 0xA282EAD8
CLOSE = b"\n"
HEAD, TAIL = 12, 4        # bytes before and after the payload
NO_ID = -(1 << 63)

FILE_TEXT = 12 << 20      # characters of text a file, so that a file fits a task
TEXTS = 512               # texts encoded together


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload)), CLOSE])


def frames(data: bytes, name: str = "file"):
    """(place, payload) of every record; raises if one is damaged."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if at + HEAD > len(data):
            raise ValueError(f"{name}: cut off at {at}")
        length, crc = struct.unpack_from("<QI", view, at)
        if masked_crc(bytes(view[at:at + 8])) != crc:
            raise ValueError(f"{name}: damaged length at {at}")
        start = at + HEAD
        payload = bytes(view[start:start + length])
        if len(payload) < length or start + length + 5 > len(data):
            raise ValueError(f"{name}: cut off at {at}")
        if struct.unpack_from("<I", view, start + length)[0] != masked_crc(payload):
            raise ValueError(f"{name}: damaged record at {at}")
        yield at, payload
        at = start + length + TAIL + len(CLOSE)


def write(docs: DataFrame, folder: str, tokenizer_file: str, id_col: str = "doc_id", text: str = "text",
          end: int | None = 0, file_text: int = FILE_TEXT) -> None:
    """Encode every text and write the records, ascending by id over the files."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def encode(batches):
        enc = encoder(spec.value)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for k in range(0, len(ids), TEXTS):
                some = enc.encode_some(batch.column("text").slice(k, TEXTS).to_pylist(), end)
                # the writer closes each row with a line end, so the record goes without its own
                rows = [frame(struct.pack("<q", i) + x)[:-len(CLOSE)] for i, x in zip(ids[k:k + TEXTS], some, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])

    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    size = d.agg(F.sum(F.length("text"))).first()[0] or 0
    # texts are dealt before they are encoded: a range exchange reads its input twice;
    # by row number too, so that rows without id, or of one id, go to many files
    (d.withColumn("row", F.monotonically_increasing_id())
     .repartitionByRange(max(1, -(-size // file_text)), "id", "row").sortWithinPartitions("id", "row")
     .mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", CLOSE.decode()).text(f"{folder}/records"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/records").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def write_index(spark: SparkSession, folder: str, wide: bool = False) -> DataFrame:
    """Read the files once and write the index beside them; returns it."""
    ship(spark)
    width = 4 if wide else 2

    def scan(batches):
        for batch in batches:
            for f, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                places, ids, lengths, tokens = [], [], [], []
                for at, payload in frames(content.as_py(), f):
                    places.append(at)
                    lengths.append(len(payload) + HEAD + TAIL + len(CLOSE))
                    ids.append(struct.unpack_from("<q", payload)[0])
                    tokens.append((len(payload) - 8) // width)
                n = np.array(tokens, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * len(ids), pa.string()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array(ids, pa.int64()), pa.array(n), pa.array(np.cumsum(n) - n)],
                    names=["file", "place", "length", "doc_id", "n_tokens", "before"])

    schema = "file string, place long, length long, doc_id long, n_tokens long, before long"
    _files(spark, folder).mapInArrow(scan, schema).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def file_starts(index: DataFrame) -> DataFrame:
    """(file, first): ids in the files before; one row a file."""
    from pyspark.sql import Window

    sums = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # by part number: as names, those of more than five digits would come in between
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def read(spark: SparkSession, folder: str, wide: bool = False, ids: bool = True) -> DataFrame:
    """Every record of the files, frames checked: doc_id, start (ids of all
    documents before), n_tokens, ids_crc32 (of the ids as little-endian 32-bit
    numbers) and, if asked, ids."""
    ship(spark)
    width = "<u4" if wide else "<u2"

    def scan(batches):
        for batch in batches:
            for f, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                docs, n, crc, lists = [], [], [], []
                for _, payload in frames(content.as_py(), f):
                    tokens = np.frombuffer(payload, width, offset=8)
                    docs.append(struct.unpack_from("<q", payload)[0])
                    n.append(len(tokens))
                    crc.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    if ids:
                        lists.append(tokens.astype(np.int32))
                size = np.array(n, np.int64)
                cols = [pa.array([f] * len(n), pa.string()), pa.array(docs, pa.int64()), pa.array(size),
                        pa.array(np.cumsum(size) - size), pa.array(crc, pa.int64())]
                names = ["file", "doc_id", "n_tokens", "before", "ids_crc32"]
                if ids:
                    cols.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *["ids"] * ids])

    schema = "file string, doc_id long, n_tokens long, before long, ids_crc32 long" + ", ids array<int>" * ids
    rows = _files(spark, folder).mapInArrow(scan, schema)
    starts = file_starts(spark.read.parquet(f"{folder}/index"))
    out = rows.join(starts, "file").select(
        F.when(F.col("doc_id") == NO_ID, None).otherwise(F.col("doc_id")).alias("doc_id"),
        (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
    return out


def lookup(spark: SparkSession, folder: str, wanted: DataFrame, wide: bool = False) -> DataFrame:
    """(doc_id, ids) of the records that ``wanted`` index rows point at, in any
    order: only the bytes at their places are decoded."""
    ship(spark)
    width = "<u4" if wide else "<u2"

    def pick(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                _, payload = next(frames(row["part"], row["file"]))
                out.append({"doc_id": struct.unpack_from("<q", payload)[0], "ids": np.frombuffer(payload, width, offset=8).astype(np.int32)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    parts = _files(spark, folder).join(wanted.select("file", "place", "length"), "file").select(
        "file", F.expr("substring(content, cast(place + 1 as int), cast(length as int))").alias("part"))
    return parts.mapInArrow(pick, "doc_id long, ids array<int>")
