"""Operator 13: phrase collocations by weighted acyclic automata.

A text gives one window a word: the word and up to four behind it in its piece,
as far as every one of them is frequent enough to stand in a candidate.  The
sorted, distinct windows of a shard of texts are a tree-shaped automaton that is
built by one pass over them: what a window shares with the one before is there
already, the rest are new states.  The weight of a state is the number of windows
that pass through it, which is the number of occurrences of its phrase.

Shards send their automata cut at borders of a common order of windows.  Each
range of prefixes unites what it gets, summing weights, and reports its states;
those on a border are summed once more over ranges, so that a frequent prefix may
lie over any number of them.  The counts of a candidate's parts are found by
composing the candidates' parts, sorted, with the sorted phrases and their counts.

What is sent to tasks is bounded: a bitmap of fixed size that no frequent word
fails (others that pass only cost time), and at most ``MOST_RANGES`` borders.
Counts come from all texts; the borders alone from a sample.

Null text is empty and null language ``und``; repeated rows all count.  A very
long text is one shard.  An empty table has no phrases.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, cut, ship, shuffle_parts

# The contract's separators of pieces and words, and its name for no language.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
NO_LANG = "und"

SHARD_CHARS = 12_000_000
FILTER_BITS = 25
CHUNK_BITS = 16
RANGE_WINDOWS = 3_000_000     # windows a range, before shards have summed equal ones
MOST_RANGES = 1 << 18
SAMPLE_A_RANGE = 40
SALTS = 8
MANY = 255                    # a weight from here on is sent apart, as eight bytes

END = b"\xff"                 # stands between pieces; no UTF-8 text holds it
_TO_END = bytearray(LOWER_BYTES)
for _c in PIECE_ENDS:
    _TO_END[_c] = END[0]
_TO_END[0x09] = 0x20
_TO_END = bytes(_TO_END)


def words_of(texts: list[str]) -> pa.DictionaryArray:
    """All words in order, with ``END`` between pieces."""
    data = END.join([b"", *(t.encode() for t in texts), b""]).translate(_TO_END).replace(END, b" \xff ")[1:-1]
    whole = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data))
    return pc.ascii_split_whitespace(whole).values.cast(pa.large_binary()).dictionary_encode()


def shards(batches, chars: int):
    """{language: texts} of some ``chars`` characters each."""
    texts, held = defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            texts[lang].append(text)
            held += len(text)
            if held >= chars:
                yield texts
                texts, held = defaultdict(list), 0
    if texts:
        yield texts


def word_bit(lang: str, word: bytes) -> int:
    """As ``pmod(xxhash64(lang, word), 2**FILTER_BITS)`` does."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang, 42)) & ((1 << FILTER_BITS) - 1)


def _keys(windows: np.ndarray, top: int) -> list[np.ndarray]:
    """Sort keys of rows of word numbers up to ``top``, the first key first."""
    bits = max(1, int(top).bit_length())
    each = 63 // bits
    keys = []
    for at in range(0, windows.shape[1], each):
        key = np.zeros(len(windows), np.uint64)
        for j in range(at, min(at + each, windows.shape[1])):
            key = (key << np.uint64(bits)) | windows[:, j].astype(np.uint64)
        keys.append(key)
    return keys


class CountAutomaton:
    """Sorted distinct rows of word numbers, 0 behind their end, and how often
    each occurs.  ``words[i - 1]`` is the word of number i, in ascending order."""

    def __init__(self, words: list[bytes], rows: np.ndarray, weight: np.ndarray):
        self.words, self.rows, self.weight = words, rows, weight

    @classmethod
    def of(cls, words: list[bytes], rows: np.ndarray, weight: np.ndarray) -> CountAutomaton:
        """Rows in any order, repeated ones summed."""
        if not len(rows):
            return cls(words, rows, weight)
        keys = _keys(rows, len(words))
        order = np.lexsort(keys[::-1])
        new = np.ones(len(rows), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        first = np.flatnonzero(new)
        return cls(words, rows[order[first]], np.add.reduceat(weight[order], first))

    def shared(self) -> np.ndarray:
        """How many words each row shares with the one before."""
        same = np.zeros((len(self.rows), self.rows.shape[1]), bool)
        same[1:] = (self.rows[1:] == self.rows[:-1]) & (self.rows[1:] > 0)
        return np.logical_and.accumulate(same, axis=1).sum(axis=1).astype(np.uint8)

    def states(self):
        """(rows, depth, weight) of each depth: a row stands for its prefix of that length."""
        shared = self.shared()
        for depth in range(1, self.rows.shape[1] + 1):
            first = np.flatnonzero(shared < depth)
            weight = np.add.reduceat(self.weight, first) if len(first) else self.weight
            real = self.rows[first, depth - 1] > 0
            yield first[real], depth, weight[real]

    def pack(self, a: int, b: int) -> dict:
        """Rows a to b as new states only, with the words that they name, compressed."""
        part = CountAutomaton(self.words, self.rows[a:b], self.weight[a:b])
        shared = part.shared()
        new = (np.arange(part.rows.shape[1]) >= shared[:, None]) & (part.rows > 0)
        used, which, often = np.unique(part.rows[new], return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")             # frequent words get small numbers
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        few = np.minimum(part.weight, MANY).astype(np.uint8)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return {"words": squeeze(b" ".join([self.words[i - 1] for i in used[order].tolist()])),
                "labels": squeeze(rank[which].view(np.uint8).reshape(-1, 4).T.tobytes()),       # byte by byte: most high ones are 0
                "shared": squeeze(shared.tobytes()), "length": squeeze((part.rows > 0).sum(axis=1).astype(np.uint8).tobytes()),
                "weight": squeeze(few.tobytes()), "more": squeeze(part.weight[few == MANY].astype("<u8").tobytes())}

    @classmethod
    def union(cls, packed: list[dict], width: int) -> CountAutomaton:
        """One automaton of all, weights summed."""
        loose = zstandard.ZstdDecompressor().decompress
        packed = [{c: loose(p[c]) for c in _PARTS} for p in packed]
        spelled = [p["words"].split(b" ") for p in packed]
        words = sorted(set().union(*spelled))
        number = {w: i for i, w in enumerate(words, 1)}
        rows, weights = [], []
        for p, used in zip(packed, spelled, strict=True):
            shared, length = np.frombuffer(p["shared"], np.uint8), np.frombuffer(p["length"], np.uint8)
            column = np.arange(width)
            new = (column >= shared[:, None]) & (column < length[:, None])
            own = np.array([number[w] for w in used], np.uint32)
            part = np.zeros(new.shape, np.uint32)
            part[new] = own[np.frombuffer(p["labels"], np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()]
            # a shared word stands in the last row that has made a state there
            made = np.maximum.accumulate(np.where(new, np.arange(len(new))[:, None], 0), axis=0)
            part = np.where(column < length[:, None], part[made, column], 0)
            rows.append(part)
            weight = np.frombuffer(p["weight"], np.uint8).astype(np.int64)
            weight[weight == MANY] = np.frombuffer(p["more"], "<u8")
            weights.append(weight)
        return cls.of(words, np.vstack(rows).astype(np.uint32), np.concatenate(weights))

    def phrase(self, row: int, depth: int) -> str:
        return b" ".join([self.words[i - 1] for i in self.rows[row, :depth].tolist()]).decode()

    @classmethod
    def from_phrases(cls, phrases: list[str], weight: list[int], width: int) -> CountAutomaton:
        split = [p.encode().split(b" ") for p in phrases]
        words = sorted({w for p in split for w in p})
        number = {w: i for i, w in enumerate(words, 1)}
        rows = np.zeros((len(split), width), np.uint32)
        for r, p in zip(rows, split, strict=True):
            r[:len(p)] = [number[w] for w in p]
        return cls.of(words, rows, np.array(weight, np.int64))

    def compose(self, phrases: list[str]) -> list[int]:
        """The weight of the row that is exactly each phrase; 0 if none is.  Both
        are sorted, so one walk over the two together finds all."""
        number = {w: i for i, w in enumerate(self.words, 1)}
        asked = np.zeros((len(phrases), self.rows.shape[1]), np.uint32)
        known = np.ones(len(phrases), bool)
        for i, p in enumerate(phrases):
            ids = [number.get(w, 0) for w in p.encode().split(b" ")]
            known[i] = 0 not in ids and len(ids) <= asked.shape[1]
            if known[i]:
                asked[i, :len(ids)] = ids
        both = np.vstack([self.rows, asked])
        order = np.lexsort(_keys(both, len(self.words))[::-1])         # stable: a row stands before its questions
        mine = order < len(self.rows)
        at = np.maximum.accumulate(np.where(mine, np.arange(len(order)), -1))
        out = np.zeros(len(both), np.int64)
        found = (at >= 0) & (both[order] == both[order[at]]).all(axis=1) & mine[at]
        out[order[found]] = self.weight[order[at[found]]]
        return np.where(known, out[len(self.rows):], 0).tolist()


def shard_automaton(lang: str, texts: list[str], bitmap: np.ndarray, width: int) -> CountAutomaton:
    """The windows of two words and more of some texts."""
    coded = words_of(texts)
    spelled = coded.dictionary.to_pylist()
    passes = [w for w in spelled if w != END and bitmap[(b := word_bit(lang, w)) >> 3] >> (b & 7) & 1]
    words = sorted(passes)
    number = {w: i for i, w in enumerate(words, 1)}
    ids = np.array([number.get(w, 0) for w in spelled], np.uint32)[coded.indices.to_numpy()]
    ids = np.concatenate([ids, np.zeros(width, np.uint32)])
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    rows = np.empty((len(at), width), np.uint32)
    alive = np.ones(len(at), bool)
    for j in range(width):
        rows[:, j] = np.where(alive, ids[at + j], 0)
        alive &= rows[:, j] > 0
    return CountAutomaton.of(words, rows, np.ones(len(at), np.int64))


def _plain(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, f) of words that occur ``least`` times; word null: of all words."""
    def count(batches):
        for texts in shards(batches, SHARD_CHARS):
            for lang, some in texts.items():
                coded = words_of(some)
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                real = np.array([w != END for w in coded.dictionary.to_pylist()], bool)
                words = coded.dictionary.filter(pa.array(real)).cast(pa.large_string()).cast(pa.string())
                words = pa.concat_arrays([words, pa.array([None], pa.string())])
                counts = np.append(n[real], n[real].sum())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(counts, pa.int64())], names=["lang", "word", "f"])

    sums = docs.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return cut(sums.where((F.col("f") >= least) | F.col("word").isNull()))


def filter_bitmap(words: DataFrame) -> np.ndarray:
    """One bit for each hash of (lang, word); 4 MB whatever the number of words."""
    def fill(chunk: pa.Table) -> pa.Table:
        bits = np.zeros(1 << CHUNK_BITS, np.uint8)
        bits[chunk.column("bit").to_numpy() & ((1 << CHUNK_BITS) - 1)] = 1
        return pa.table({"chunk": chunk.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    bits = words.select(F.pmod(F.xxhash64("lang", "word"), F.lit(1 << FILTER_BITS)).alias("bit")).distinct()
    chunks = bits.withColumn("chunk", F.shiftright("bit", CHUNK_BITS)).groupBy("chunk").applyInArrow(fill, "chunk long, bits binary")
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = 1 << (CHUNK_BITS - 3)
    for row in chunks.toLocalIterator():
        out[row["chunk"] * size:(row["chunk"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _borders(docs: DataFrame, bitmap, ranges: int, windows: int, width: int) -> list[tuple]:
    """At most ``ranges - 1`` windows, (lang, word, ...), that part a sample evenly."""
    share = min(1.0, max(50 * SAMPLE_A_RANGE * ranges, 200_000) / max(windows, 1))

    def some(batches):
        for texts in shards(batches, SHARD_CHARS):
            for lang, own in texts.items():
                a = shard_automaton(lang, own, bitmap.value, width)
                pick = np.repeat(np.arange(len(a.rows)), a.weight)[25::50]
                rows = [[a.words[i - 1] for i in r if i] for r in a.rows[pick].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(rows, pa.list_(pa.binary()))], names=["lang", "words"])

    sample = docs.sample(share, seed=7).mapInArrow(some, "lang string, words array<binary>")
    found = sorted((r["lang"].encode(), *map(bytes, r["words"])) for r in sample.toLocalIterator())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def phrase_counts(docs: DataFrame, words: DataFrame, least: int, width: int) -> DataFrame:
    """(lang, phrase, f) of phrases of two words and more that occur ``least`` times."""
    spark = docs.sparkSession
    frequent = words.where("word is not null")
    bitmap = spark.sparkContext.broadcast(filter_bitmap(frequent))
    windows = frequent.agg(F.sum("f")).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, -(-windows // RANGE_WINDOWS)))
    if ranges > 1:
        ranges = max(ranges, shuffle_parts(spark))
    borders = spark.sparkContext.broadcast(_borders(docs, bitmap, ranges, windows, width) if ranges > 1 else [])

    def send(batches):
        for texts in shards(batches, SHARD_CHARS):
            for lang, some in texts.items():
                a = shard_automaton(lang, some, bitmap.value, width)
                # the borders inside this language; each ends a range
                first, last = (bisect.bisect_left(borders.value, (x,)) for x in (lang.encode(), lang.encode() + b"\0"))
                at = [0, *(_place(a, b[1:]) for b in borders.value[first:last]), len(a.rows)]
                out = [{"range": first + k, "lang": lang, **a.pack(x, y)} for k, (x, y) in enumerate(zip(at, at[1:], strict=False)) if y > x]
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema(_PACKED))

    def unite(table: pa.Table) -> pa.Table:
        langs, phrases, counts = [], [], []
        for lang in table.column("lang").unique().to_pylist():
            a = CountAutomaton.union(table.filter(pc.equal(table.column("lang"), lang)).to_pylist(), width)
            end = len(a.rows) - 1
            tail = a.shared()
            for first, depth, weight in a.states():
                if depth == 1:
                    continue
                # a phrase on either end of the range may go on in the next one
                edge = (first == 0) | (first == _state_row(tail, end, depth))
                keep = np.flatnonzero((weight >= least) | edge)
                phrases += [a.phrase(r, depth) for r in first[keep].tolist()]
                counts += weight[keep].tolist()
            langs += [lang] * (len(phrases) - len(langs))
        return pa.table({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.string()), "f": pa.array(counts, pa.int64())})

    sent = docs.mapInArrow(send, "range long, lang string, " + ", ".join(f"{c} binary" for c in _PARTS))
    parts = sent.groupBy("range").applyInArrow(unite, "lang string, phrase string, f long")
    return parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


_PARTS = ["words", "labels", "shared", "length", "weight", "more"]
_PACKED = [("range", pa.int64()), ("lang", pa.string()), *((c, pa.binary()) for c in _PARTS)]


def _place(a: CountAutomaton, border: tuple[bytes, ...]) -> int:
    """How many rows stand before ``border``."""
    low, high = 0, len(a.rows)
    for j in range(a.rows.shape[1]):
        column = a.rows[low:high, j]
        if j == len(border):
            return low                                 # rows of the border's words, ended, stand first
        k = bisect.bisect_left(a.words, border[j])
        there = k < len(a.words) and a.words[k] == border[j]
        start = low + int(np.searchsorted(column, k + 1))
        if not there:
            return start
        low, high = start, low + int(np.searchsorted(column, k + 2))
        if low == high:
            return low
    return low


def _state_row(shared: np.ndarray, row: int, depth: int) -> int:
    """The row that made the state of ``depth`` which ``row`` passes."""
    while row and shared[row] >= depth:
        row -= 1
    return row


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language
    whose least likely cut scores highest."""
    spark = docs.sparkSession
    ship(spark)
    docs = _plain(docs, text, lang)
    words = word_counts(docs, least)
    totals = words.where("word is null").select("lang", F.col("f").alias("n"))
    phrases = cut(phrase_counts(docs, words, least, longest))
    counts = phrases.unionByName(words.where("word is not null").select("lang", F.col("word").alias("phrase"), "f"))

    split = phrases.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = split.select("lang", "phrase", "a", F.size("w").alias("m"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("first"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part")),
        F.struct(F.lit(False).alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("part")))).alias("x"))
    asked = asked.select("lang", "phrase", "a", "k", "x.*")
    # a part of many candidates is asked for in several places
    bucket = F.pmod(F.xxhash64("lang", "part"), F.lit(shuffle_parts(spark)))
    asked = asked.withColumn("bucket", bucket).withColumn("salt", F.pmod(F.xxhash64("phrase", "k"), F.lit(SALTS)).cast("int"))
    told = counts.withColumnRenamed("phrase", "part").withColumn("bucket", bucket).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))

    def compose(told: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        for one in asked.column("lang").unique().to_pylist():
            mine, theirs = told.filter(pc.equal(told.column("lang"), one)), asked.filter(pc.equal(asked.column("lang"), one))
            a = CountAutomaton.from_phrases(mine.column("part").to_pylist(), mine.column("f").to_pylist(), longest)
            f = pa.array(a.compose(theirs.column("part").to_pylist()), pa.int64())
            out.append(theirs.select(["lang", "phrase", "a", "k", "first"]).append_column("f", f))
        return pa.concat_tables(out) if out else asked.select(["lang", "phrase", "a", "k", "first"]).append_column("f", pa.array([], pa.int64()))

    schema = "lang string, phrase string, a long, k int, first boolean, f long"
    parts = told.groupBy("bucket", "salt").cogroup(asked.groupBy("bucket", "salt")).applyInArrow(compose, schema)
    sides = parts.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"),
                                                          F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    wide = {f"_{c}": F.col(c).cast("decimal(38,0)") for c in "nlr"}
    scored = sides.join(totals, "lang").withColumns({"_a": F.col("a").cast("decimal(20,0)") * F.lit(1000), **wide})
    best = scored.withColumn("score", F.expr("(_a * _n) div (_l * _r)")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")

    # whatever a longer candidate takes whole, one that is longer by a word does
    inner = split.where(F.size("w") > 2).select("lang", "a", F.explode(F.array(
        F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))).alias("phrase")).distinct()
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (best.join(inner, ["lang", "phrase", "a"], "left_anti").withColumn("rank", F.row_number().over(order).cast("long"))
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
