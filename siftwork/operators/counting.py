"""Ranks of chosen documents by counting, without ranking all the others.

A document's rank is one more than the number of documents that stand before it.
The chosen documents' scores are sent to the tasks; every task scores its documents
and finds, by binary search, how many chosen ones each of them stands before.
What is shuffled are counts, a row for each chosen document and task at most; no
pair of a query and another document is written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored_once, written_once
from .retrieval import BLOCK_BYTES, CELLS_PER_FRAME, QueryMatrix, _unit_rows
from .scan import Placed


def count_ranks(matrix: QueryMatrix, space: DataFrame, wanted: DataFrame, vec_col: str = "embedding",
                id_col: str = "original_id", decimals: int = 9, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_q, id, cosine_similarity, rank) of the ``wanted`` (_q, id): the place of a
    document of the query's space by similarity (rounded, descending), then id.
    ``space`` holds an id once.  Wanted ids that have no usable vector are left out.

    Scores of wanted documents are sent in blocks of at most ``block_bytes``, with
    the vectors of their queries; more of them mean more passes over the space."""
    space_col, spark = matrix.space_col, space.sparkSession
    chosen = space.join(wanted.select(F.col(id_col)).distinct(), id_col, "left_semi")
    scored = matrix.pairs(chosen, [id_col], vec_col).select("_q", id_col, F.round("cosine_similarity", decimals).alias("cosine_similarity"))
    marks = stored_once(scored.join(wanted.select("_q", id_col).distinct(), ["_q", id_col]))
    width = marks.agg(F.sum(F.octet_length(id_col) + 80 + 8 * matrix.dim)).first()[0] or 0
    blocks = max(1, -(-width // block_bytes))
    schema = T.StructType([T.StructField("_q", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_n", T.LongType())])
    # a query's marks get their place among all of them, so that blocks of marks are counted apart
    placed = Placed(marks, ["_q"], [F.col("cosine_similarity").asc(), F.col(id_col).desc()]).running_sum(F.lit(1), "_at")
    placed = stored_once(placed.rows())
    docs = space.select(space_col, id_col, vec_col)
    counts = None
    for k in range(blocks):
        part = placed.where(F.pmod(F.xxhash64("_q", id_col), F.lit(blocks)) == k)
        here = part.join(matrix.queries.select("_q", space_col, F.col(matrix.vec_col).alias("_v")), "_q").toPandas()
        per_space = {}
        for sp, own in here.groupby(space_col):
            queries = []
            for q, m in own.sort_values("_at").groupby("_q"):
                queries.append((int(q), m["_v"].iloc[0], m["cosine_similarity"].to_numpy(), m[id_col].to_numpy(), m["_at"].to_numpy(np.int64)))
            unit, keep = _unit_rows([x[1] for x in queries], matrix.dim)
            per_space[sp] = (unit, [queries[i] for i in keep], set(own[id_col]))
        sent = spark.sparkContext.broadcast(per_space)
        got = docs.mapInPandas(_counter(sent, space_col, id_col, vec_col, matrix.dim, decimals), schema)
        if blocks > 1:                      # one block at a time is held
            got = written_once(got)
            sent.unpersist()
        counts = got if counts is None else counts.unionByName(got)
    # a count at a mark holds for all marks of its block at or below it: blocks are told apart by their marks
    block = F.pmod(F.xxhash64("_q", id_col), F.lit(blocks)).alias("_block")
    summed = counts.groupBy("_q", "_at").agg(F.sum("_n").alias("_n")) if counts is not None else None
    all_marks = placed.select("_q", id_col, "cosine_similarity", "_at", block).join(summed, ["_q", "_at"], "left")
    before = Placed(all_marks, ["_q", "_block"], [F.col("_at").desc()]).running_sum(F.coalesce("_n", F.lit(0)), "_before").rows()
    return before.select("_q", id_col, "cosine_similarity", (F.col("_before") + 1).alias("rank"))


def _counter(sent, space_col: str, id_col: str, vec_col: str, dim: int, decimals: int):
    def run(batches):
        totals: dict[int, np.ndarray] = {}
        marks = sent.value
        for pdf in batches:
            for sp, sub in pdf.groupby(space_col, sort=False):
                if sp not in marks:
                    continue
                unit, queries, marked = marks[sp]
                dmat, keep = _unit_rows(sub[vec_col].tolist(), dim)
                if not len(keep) or not queries:
                    continue
                ids = sub[id_col].to_numpy()[keep]
                step = max(1, CELLS_PER_FRAME // len(queries))
                for s in range(0, len(keep), step):
                    sim = np.round(np.clip(dmat[s:s + step] @ unit.T, -1.0, 1.0), decimals)
                    some = ids[s:s + step]
                    own = [i for i, x in enumerate(some) if x in marked]
                    for c, (q, _, score, names, _) in enumerate(queries):
                        n = totals.setdefault(q, np.zeros(len(score), np.int64))
                        _count(n, sim[:, c], some, score, names, own)
        place = {q: at for _, queries, _ in marks.values() for q, _, _, _, at in queries}
        for q, n in totals.items():
            some = np.flatnonzero(n)
            if len(some):
                yield pd.DataFrame({"_q": q, "_at": place[q][some], "_n": n[some]})

    return run


def _count(n: np.ndarray, sim: np.ndarray, ids: np.ndarray, score: np.ndarray, names: np.ndarray, own: list[int]) -> None:
    """Adds to ``n[j]`` the documents whose last beaten mark is j; marks ascend by
    score and, where equal, descend by id.  ``own`` are documents that are marks
    (of some query): one that is a mark here stands where the mark stands."""
    below = np.searchsorted(score, sim, side="left")
    upto = np.searchsorted(score, sim, side="right")
    for i in np.flatnonzero(upto > below):                        # equal scores: the lesser id stands before
        while below[i] < upto[i] and ids[i] < names[below[i]]:
            below[i] += 1
    if own:
        at = {x: j for j, x in enumerate(names)}
        for i in own:
            below[i] = at.get(ids[i], below[i])
    n += np.bincount(below, minlength=len(n) + 1)[1:]
