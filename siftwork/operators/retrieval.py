"""Exact vector retrieval: encode, choose query vectors, score, rank, fuse.

Scale notes
-----------
* Scoring is exact (no index), like the evaluated workflow.  The documents
  stream through ``mapInPandas`` in Arrow batches, one NumPy matrix product per
  batch and search space.  The query vectors are written once and sent in
  blocks of at most ``BLOCK_BYTES``: more queries mean more blocks, never
  another algorithm.
* The length of a vector is declared (``EMBEDDING_DIM``), not inferred.  Vectors
  of another length are not scored; ``quality.embedding_coverage`` reports them.
* Ranking per query and the fused ranking use the distributed ordinal
  (``operators.ordinal``), so no group needs one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RRF_K
from ..session import stored_once, written_once
from .ordinal import ordinal, top_k

# declared length of a vector, and bytes of query vectors sent in one block
EMBEDDING_DIM = 64
BLOCK_BYTES = 64 << 20
# output cells (docs x queries) produced per pandas frame inside a task
CELLS_PER_FRAME = 2_000_000


# ---------------------------------------------------------------- encoding --

def hashing_encoder(dim: int = EMBEDDING_DIM) -> Callable[[pd.Series], list]:
    """Deterministic signed feature-hashing encoder (the default plug-in).

    Lower-cased word tokens of the whole text, hashed with md5 into ``dim``
    buckets with a sign bit, L2-normalised.  A transformer encoder can be
    plugged in with the same signature.
    """
    token = re.compile(r"\w+", re.UNICODE)

    def encode(texts: pd.Series) -> list:
        out = []
        for t in texts:
            if t is None or (isinstance(t, float) and np.isnan(t)):
                out.append(None)
                continue
            v = np.zeros(dim, dtype=np.float64)
            for w in token.findall(t.lower()):
                h = int.from_bytes(hashlib.md5(w.encode("utf-8")).digest()[:8], "little")
                v[h % dim] += 1.0 if (h >> 63) & 1 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n > 0 else v.tolist())
        return out

    return encode


def embed(df: DataFrame, text_col: str, encoder_factory: Callable[[], Callable] | None = None,
          out_col: str = "embedding") -> DataFrame:
    """Add an ``array<double>`` embedding of ``text_col`` (Arrow batches; the
    encoder is built once per task, never per row)."""
    factory = encoder_factory or (lambda: hashing_encoder())
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(batches):
        enc = factory()
        for pdf in batches:
            pdf[out_col] = enc(pdf[text_col])
            yield pdf

    return df.mapInPandas(run, schema)


def hash_counts(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, counts): the default encoder's signed bucket counts of each text,
    before they are scaled to length one, in JVM expressions.

    A word goes to the bucket of the first byte of its md5, and counts up or
    down by the top bit of the eighth.  Words are summed map-side, so one row a
    text is shuffled."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    each = df.select(key, F.explode_outer(words).alias("_w")).withColumn("_h", F.md5("_w"))
    bucket = F.conv(F.substring("_h", 1, 2), 16, 10).cast("int") % EMBEDDING_DIM
    sign = F.when(F.substring("_h", 15, 1) >= "8", 1).otherwise(-1)
    each = each.select(key, bucket.alias("_b"), sign.alias("_s"))
    sums = [F.sum(F.when(F.col("_b") == i, F.col("_s")).otherwise(0)) for i in range(EMBEDDING_DIM)]
    return each.groupBy(key).agg(F.array(*sums).alias("counts"))


def hash_embed(df: DataFrame, key: str, text_col: str, out_col: str = "embedding") -> DataFrame:
    """(key, embedding): the default encoder in JVM expressions, ``hash_counts`` scaled
    to length one; a text without words, or null, has the zero vector.  Rows of one
    key are one text."""
    counts = hash_counts(df, key, text_col)
    norm = F.sqrt(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x * x).cast("double"))
    return counts.withColumn("_norm", norm).select(
        key, F.transform("counts", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(0.0)).alias(out_col))


# ---------------------------------------------------------- query vectors --

def topic_vectors(vectors: DataFrame, by: str = "review_id", vec_col: str = "embedding",
                  dim: int = EMBEDDING_DIM) -> DataFrame:
    """Mean vector per review: one aggregate with a mean per element; vectors of
    another length take no part."""
    means = [F.avg(F.get(vec_col, F.lit(i)).cast("double")) for i in range(dim)]
    return vectors.where(F.size(vec_col) == dim).groupBy(by).agg(F.array(*means).alias(vec_col))


def pick_one(df: DataFrame, by: Sequence[str], id_col: str) -> DataFrame:
    """One row per group: the smallest md5 of the id text (ties by id).
    ``min_by`` is a partial aggregate, so a hot group is reduced map-side."""
    key = F.struct(F.md5(F.col(id_col).cast("string")), F.col(id_col))
    others = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*others), key).alias("_p"))
    return picked.select(*by, "_p.*")


def select_queries(gold: DataFrame, topics: DataFrame | None, scope: str, shot: str,
                   review_col: str = "review_id", id_col: str = "ground_truth_article_id",
                   vec_col: str = "embedding") -> DataFrame:
    """Query vectors of one scenario -> (scope, shot, review_id, query_id,
    query_kind, embedding).

    | scope \\ shot | zero | one | few |
    | topic   | its topic vector | its min-md5 gold article | its gold articles |
    | overall | every topic vector | one min-md5 article per review | all gold |
    """
    if shot == "zero-shot":
        if topics is None:
            raise ValueError("zero-shot needs topic vectors")
        q = topics.select(review_col, F.concat(F.lit("topic:"), F.col(review_col).cast("string"))
                          .alias("query_id"), F.lit("topic").alias("query_kind"), vec_col)
    else:
        g = gold.select(review_col, id_col, vec_col)
        if shot == "one-shot":
            g = pick_one(g, [review_col], id_col)
        elif shot != "few-shot":
            raise ValueError(f"unknown shot {shot!r}")
        q = g.select(review_col, F.col(id_col).cast("string").alias("query_id"),
                     F.lit("article").alias("query_kind"), vec_col)
    if scope == "overall":
        q = q.withColumn(review_col, F.lit("overall"))
    elif scope != "topic":
        raise ValueError(f"unknown scope {scope!r}")
    return q.select(F.lit(scope).alias("scope"), F.lit(shot).alias("shot"),
                    F.col(review_col).cast("string").alias("review_id"),
                    "query_id", "query_kind", vec_col)


def all_scenarios(gold: DataFrame, topics: DataFrame | None, scopes: Sequence[str],
                  shots: Sequence[str], **kw) -> DataFrame:
    """Every (scope, shot) query set in one DataFrame (one plan, no loop over
    strategies at run time)."""
    parts = [select_queries(gold, topics, sc, sh, **kw) for sc in scopes for sh in shots]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def on_spaces(queries: DataFrame, spaces: Sequence[str], space_col: str = "database") -> DataFrame:
    """Fan the query set out to each search space (literal list: narrow)."""
    return queries.withColumn(space_col, F.explode(F.array(*[F.lit(s) for s in spaces])))


# ---------------------------------------------------------------- scoring --

def _unit_rows(vectors, dim: int | None):
    """Stack vectors, dropping null, wrong-length, NaN and zero-norm ones."""
    keep, rows = [], []
    for i, v in enumerate(vectors):
        if v is None:
            continue
        a = np.asarray(v, dtype=np.float64)
        if a.ndim != 1 or (dim is not None and a.shape[0] != dim):
            continue
        rows.append(a)
        keep.append(i)
    if not rows:
        return np.zeros((0, dim or 0)), np.array([], dtype=np.int64)
    m = np.vstack(rows)
    n = np.linalg.norm(m, axis=1)
    ok = n > 0          # NaN norms compare False as well
    return m[ok] / n[ok, None], np.asarray(keep, dtype=np.int64)[ok]


def valid_vector(col: str, dim: int):
    """Spark twin of the scorer's filter: the vectors that get scored."""
    c = F.col(col)
    return (c.isNotNull() & (F.size(c) == dim)
            & F.exists(c, lambda x: x != 0)
            & ~F.exists(c, lambda x: x.isNull() | F.isnan(x)))


def _first(sim: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``top`` greatest of every column, equals by least id."""
    if len(sim) <= top:
        return np.repeat(np.arange(len(sim)), sim.shape[1]), np.tile(np.arange(sim.shape[1]), len(sim))
    least = np.partition(sim, len(sim) - top, axis=0)[len(sim) - top]
    rows, cols = [], []
    for c in range(sim.shape[1]):
        near = np.flatnonzero(sim[:, c] >= least[c])               # those that equal the last one, too
        order = sorted(near, key=lambda i: (-sim[i, c], ids[i]))[:top] if len(near) > top else near
        rows.append(np.asarray(order, np.int64))
        cols.append(np.full(len(order), c))
    return np.concatenate(rows), np.concatenate(cols)


class QueryMatrix:
    """The query vectors, written once and sent to the tasks block by block.

    Scored pairs are narrow: a query row's number ``_q`` and its strategy's
    number ``_s`` (the least query number of its keys) stand for the strings,
    which are joined back when pairs have been ranked or fused."""

    def __init__(self, queries: DataFrame, strategies: DataFrame, blocks: int, dim: int, space_col: str,
                 query_cols: Sequence[str], vec_col: str):
        self.queries, self.strategies, self.blocks, self.dim, self.vec_col = queries, strategies, blocks, dim, vec_col
        self.space_col, self.query_cols = space_col, list(query_cols)

    @classmethod
    def collect(cls, queries: DataFrame, space_col: str, query_cols: Sequence[str],
                vec_col: str = "embedding", dim: int = EMBEDDING_DIM,
                extra_cols: Sequence[str] = (), block_bytes: int = BLOCK_BYTES) -> "QueryMatrix":
        keys = [*query_cols, space_col]
        q = queries.select(*keys, "query_id", *extra_cols, vec_col).where(valid_vector(vec_col, dim))
        q = stored_once(q.withColumn("_q", F.monotonically_increasing_id()))
        strategies = q.groupBy(*keys).agg(F.min("_q").alias("_s")).select(
            "_s", *[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
        q = stored_once(q.join(strategies, same).select(*q.columns, "_s"))
        size = q.agg(F.sum(F.octet_length(F.coalesce(F.col(space_col).cast("string"), F.lit(""))) + dim * 8 + 64)).first()[0] or 0
        return cls(q, q.select(*keys, "_s").distinct(), max(1, -(-size // block_bytes)), dim, space_col, query_cols, vec_col)

    def rows(self) -> DataFrame:
        """The scorable query rows, without their vectors."""
        return self.queries.drop(self.vec_col, "_q", "_s")

    def split(self) -> tuple["QueryMatrix", "QueryMatrix"]:
        """The strategies that have one query, and those that have more."""
        counts = self.queries.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
        parts = []
        for one in (True, False):
            mine = counts.where((F.col("_n") == 1) == one).select("_s")
            parts.append(QueryMatrix(stored_once(self.queries.join(mine, "_s", "left_semi")), self.strategies.join(mine, "_s", "left_semi"),
                                     self.blocks, self.dim, self.space_col, self.query_cols, self.vec_col))
        return parts[0], parts[1]

    def block(self, k: int) -> DataFrame:
        """Query rows of one block, with their vectors; at most ``BLOCK_BYTES``."""
        return self.queries.where(F.pmod(F.xxhash64("_q"), F.lit(self.blocks)) == k).select(self.space_col, "_s", "_q", self.vec_col)

    def pairs(self, space: DataFrame, doc_cols: Sequence[str] = ("article_id", "original_id"),
              vec_col: str = "embedding", top: int | None = None, id_col: str = "original_id", decimals: int = 9) -> DataFrame:
        """(_s, _q, doc_cols, cosine_similarity): documents stream through
        ``mapInPandas``; each Arrow batch is one matrix product per search
        space present in it.  With ``top``, a batch gives only the first ``top``
        documents of each query (by rounded similarity, then ``id_col``): whatever
        is among the first of all is among the first of its batch."""
        spark, space_col, doc_cols = space.sparkSession, self.space_col, list(doc_cols)
        schema = T.StructType(
            [T.StructField("_s", T.LongType()), T.StructField("_q", T.LongType())] + [space.schema[c] for c in doc_cols]
            + [T.StructField("cosine_similarity", T.DoubleType())])
        docs_in = space.select(space_col, *doc_cols, vec_col)
        out = None
        for k in range(self.blocks):
            meta = self.block(k).toPandas()
            mat, keep = _unit_rows(meta[self.vec_col].tolist(), self.dim)
            meta = meta.drop(columns=[self.vec_col]).iloc[keep].reset_index(drop=True)
            groups = {g: np.asarray(v) for g, v in meta.groupby(space_col).indices.items()} if len(meta) else {}
            sent = spark.sparkContext.broadcast((meta["_s"].to_numpy(np.int64), meta["_q"].to_numpy(np.int64), mat, groups))
            part = docs_in.mapInPandas(self._scorer(sent, doc_cols, vec_col, schema.names, top, id_col, decimals), schema)
            if self.blocks > 1:             # one block at a time is held, by the driver and by tasks
                part = written_once(part)
                sent.unpersist()
            out = part if out is None else out.unionByName(part)
        return out

    def _scorer(self, sent, doc_cols, vec_col, names, top, id_col, decimals):
        space_col, dim = self.space_col, self.dim

        def run(batches):
            strategy, query, mat, groups = sent.value
            for pdf in batches:
                for sp, sub in pdf.groupby(space_col, sort=False):
                    qi = groups.get(sp)
                    if qi is None or len(qi) == 0:
                        continue
                    dmat, dkeep = _unit_rows(sub[vec_col].tolist(), dim)
                    if len(dkeep) == 0:
                        continue
                    docs, qm = sub.iloc[dkeep], mat[qi]
                    step = max(1, CELLS_PER_FRAME // len(qi))
                    for s in range(0, len(dkeep), step):
                        sim = np.clip(dmat[s:s + step] @ qm.T, -1.0, 1.0)            # (docs, queries)
                        if top is None:
                            d, q = np.repeat(np.arange(len(sim)), len(qi)), np.tile(np.arange(len(qi)), len(sim))
                        else:
                            d, q = _first(np.round(sim, decimals), docs[id_col].to_numpy()[s:s + step], top)
                        frame = {"_s": strategy[qi][q], "_q": query[qi][q]}
                        for c in doc_cols:
                            frame[c] = docs[c].to_numpy()[s:s + step][d]
                        frame["cosine_similarity"] = sim[d, q]
                        yield pd.DataFrame(frame)[names]

        return run

    def with_query(self, pairs: DataFrame) -> DataFrame:
        """Pairs with their query's strings instead of its numbers."""
        names = self.queries.select("_q", *self.query_cols, self.space_col, "query_id")
        rest = [c for c in pairs.columns if c not in ("_s", "_q")]
        return pairs.join(names, "_q").select(*self.query_cols, self.space_col, "query_id", *rest)

    def with_strategy(self, fused: DataFrame) -> DataFrame:
        """Fused rows with their strategy's keys instead of its number."""
        rest = [c for c in fused.columns if c != "_s"]
        return fused.join(self.strategies, "_s").select(*self.query_cols, self.space_col, *rest)

    def score(self, space: DataFrame, doc_cols: Sequence[str] = ("article_id", "original_id"),
              vec_col: str = "embedding") -> DataFrame:
        return self.with_query(self.pairs(space, doc_cols, vec_col))


def cosine_scores(queries: DataFrame, space: DataFrame, space_col: str = "database",
                  query_cols: Sequence[str] = ("scope", "shot", "review_id"),
                  doc_cols: Sequence[str] = ("article_id", "original_id"),
                  vec_col: str = "embedding", dim: int = EMBEDDING_DIM,
                  matrix: QueryMatrix | None = None) -> DataFrame:
    """Cosine similarity of every query with every document of its space.

    Null, NaN, zero and wrong-length vectors are dropped on both sides.
    Output: query_cols + space + query_id + doc_cols + cosine_similarity.
    """
    qm = matrix or QueryMatrix.collect(queries, space_col, query_cols, vec_col, dim)
    return qm.score(space, doc_cols, vec_col)


def dedupe_space(space: DataFrame, space_col: str = "database", id_col: str = "original_id",
                 order_col: str = "article_id") -> DataFrame:
    """Search space: one row per (space, original id), lowest article id.
    ``min_by`` aggregates partially, so a repeated id is reduced map-side."""
    others = [c for c in space.columns if c not in (space_col, id_col)]
    agg = space.groupBy(space_col, id_col).agg(
        F.min_by(F.struct(*others), F.col(order_col)).alias("_r"))
    return agg.select(space_col, id_col, "_r.*")


def space_sizes(space: DataFrame, strategies: DataFrame, dim: int, space_col: str = "database",
                vec_col: str = "embedding") -> DataFrame:
    """Ranked documents per strategy without touching the scored pairs: the
    scorable documents of its space, for each strategy (strategies that
    have a scorable query; e.g. ``QueryMatrix.rows``)."""
    docs = space.where(valid_vector(vec_col, dim)).groupBy(space_col) \
        .agg(F.count(F.lit(1)).alias("_n"))
    return strategies.join(docs, space_col, "inner")


# ------------------------------------------------------------ rank + fuse --

def _rank_queries(scored, by, method, decimals):
    scored = scored.withColumn("cosine_similarity", F.round("cosine_similarity", decimals))
    return ordinal(scored, by, [F.col("cosine_similarity").desc(), F.col("original_id").asc()],
                   name="rank", method=method)


def _fuse(ranked, keys, k, decimals, method):
    fused = ranked.groupBy(*keys, "original_id").agg(
        F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), decimals).alias("rrf_score"),
        F.avg("cosine_similarity").alias("cosine_similarity"),
        F.min("article_id").alias("article_id"),
        F.count(F.lit(1)).alias("n_queries"))
    return ordinal(fused, keys, [F.col("rrf_score").desc(), F.col("original_id").asc()],
                   name="combined_rank", method=method)


def rank_and_fuse(queries: DataFrame, space: DataFrame, space_col: str = "database",
                  query_cols: Sequence[str] = ("scope", "shot", "review_id"),
                  k: int = RRF_K, method: str = "range", cos_decimals: int = 9,
                  rrf_decimals: int = 12, dim: int = EMBEDDING_DIM,
                  matrix: QueryMatrix | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Per-query cosine ranking and its reciprocal-rank fusion.

    One physical form at every size, the distributed ordinal (``range``);
    ``window`` is its twin for tests.  Returns (ranked, fused, method)."""
    qm = matrix or QueryMatrix.collect(queries, space_col, query_cols, dim=dim)
    ranked = _rank_queries(qm.pairs(space), ["_q"], method, cos_decimals)
    fused = _fuse(ranked, ["_s"], k, rrf_decimals, method)
    return qm.with_query(ranked), qm.with_strategy(fused), method


def cosine_rank(queries: DataFrame, space: DataFrame, space_col: str = "database",
                query_cols: Sequence[str] = ("scope", "shot", "review_id"),
                decimals: int = 9, method: str = "range", dim: int = EMBEDDING_DIM) -> DataFrame:
    """Rank documents per query: cosine desc (rounded to ``decimals`` so ties
    are decided the same everywhere), then original_id."""
    return rank_and_fuse(queries, space, space_col, query_cols, method=method,
                         cos_decimals=decimals, dim=dim)[0]


def top_search(queries: DataFrame, space: DataFrame, k: int, space_col: str = "database",
               query_cols: Sequence[str] = ("scope", "shot", "review_id"), decimals: int = 9,
               dim: int = EMBEDDING_DIM, matrix: QueryMatrix | None = None) -> DataFrame:
    """The first ``k`` documents of each query, as ``cosine_rank`` ranks them, without
    ranking the rest: tasks keep ``k`` a query and batch, and the window that
    merges them keeps ``k`` a query and task before the shuffle."""
    qm = matrix or QueryMatrix.collect(queries, space_col, query_cols, dim=dim)
    near = qm.pairs(space, top=k, decimals=decimals).withColumn("cosine_similarity", F.round("cosine_similarity", decimals))
    order = [F.col("cosine_similarity").desc(), F.col("original_id").asc()]
    return qm.with_query(top_k(near, ["_q"], order, k))


def rrf_fuse(ranked: DataFrame, k: int = RRF_K, space_col: str = "database",
             query_cols: Sequence[str] = ("scope", "shot", "review_id"),
             decimals: int = 12, method: str = "range") -> DataFrame:
    """Reciprocal-rank fusion over the queries of a strategy.

    Per document: rrf_score = sum 1/(k + rank), cosine_similarity = mean;
    combined_rank orders by the rounded score desc, then original_id.
    """
    return _fuse(ranked, [*query_cols, space_col], k, decimals, method)
