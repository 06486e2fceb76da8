"""Incremental ingestion of landed result files (an evidence base that gets
new search exports over time).

A Structured Streaming file source picks up new files; each micro-batch is
deduplicated on the key and appended only where the key is new, so a
restarted query (or a re-landed file) never duplicates rows; null keys are
equal to each other.  The checkpoint lies in the folder that
``spark.checkpoint.dir`` names, under the target's hash, where another
application finds it again, unless one is given.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordinal import top_k
from ..operators.registry import whole_row
from ..session import shared_folder
from ..sources.sinks import not_stored, stored


def ingest_new_keys(spark: SparkSession, source_dir: str, schema: T.StructType, target: str,
                    keys: Sequence[str], fmt: str = "parquet", order_col: str | None = None,
                    checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Stream ``source_dir`` into the Parquet table ``target``, new keys only."""
    # one checkpoint for each full target path
    name = "ingest-" + hashlib.sha256(target.rstrip("/").encode()).hexdigest()
    ckpt = checkpoint or os.path.join(shared_folder(spark), name)
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        order = [F.col(order_col).asc()] if order_col else []
        order.append(whole_row(batch).asc())
        first = top_k(batch, keys, order, 1, name="_rn").drop("_rn")
        first = not_stored(first, stored(batch.sparkSession, target), keys)
        first.write.mode("append").parquet(target)

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()
