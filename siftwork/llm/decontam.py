r"""Operator 4: benchmark passages in documents, by one Aho-Corasick automaton.

Both sides are normalised alike: A-Z lower-cased, words are runs of ASCII
letters, digits and characters beyond ASCII, joined by one space.  Every window
of ``window`` item words (an item with fewer: all of them) becomes a pattern of
whole words.  A text is scanned once; the space before a word numbers the word,
and the word's place in the original text gives the offsets.

The patterns travel to the workers in blocks of at most ``block_bytes``, one at a
time: more patterns mean more passes over the texts, each stored before the next
block is built, so neither the driver nor a task holds more than one block.

Null and empty texts have no words and no hits.  Repeated rows are judged each
on its own.  An empty benchmark hits nothing.  An item without an id marks
words but is in no list.  A very long text is scanned in its row, in one go.
Columns of the input that are asked for pass through; a clashing name gets an
underscore.  An empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_BYTES, cut, fresh, ship

WINDOW = 10
BLOCK_BYTES = 16 << 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"       # fixed value, after lower-casing
_LOWER = {a: b for a, b in enumerate(LOWER_BYTES) if a != b}
_GAP = re.compile(NOT_WORD)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normalise(text: str | None) -> str:
    """Words between single spaces, one before the first and one after the last."""
    inner = _GAP.sub(" ", (text or "").translate(_LOWER)).strip(" ")
    return f" {inner} " if inner else ""


def windows(bench: DataFrame, text: str = "text", item: str = "item_id", size: int = WINDOW) -> DataFrame:
    """(pattern, item) rows of the benchmark, each pair once."""
    low = F.translate(F.coalesce(bench[text], F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, NOT_WORD), lambda w: w != "")
    d = bench.select(bench[item].cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    d = d.select("item", "words", F.explode(starts).alias("at"))
    return d.select(F.array_join(F.slice("words", F.col("at") + 1, size), " ").alias("pattern"), "item").distinct()


def _blocks(bench: DataFrame, text: str, item: str, size: int, block_bytes: int):
    """Lists of (pattern, items), each within the bound, one after the other."""
    pairs = cut(windows(bench, text, item, size))
    total = pairs.agg(F.sum(F.octet_length("pattern") + F.octet_length(F.coalesce("item", F.lit(""))) + 32)).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        of_block = pairs.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(n)) == k) if n > 1 else pairs
        found: dict[str, list[str]] = {}
        for r in of_block.toLocalIterator():
            found.setdefault(r["pattern"], []).extend([r["item"]] if r["item"] is not None else [])
        yield found


_AUTOMATA: dict = {}


def _automaton(sent):
    import ahocorasick

    if sent.id not in _AUTOMATA:
        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for pattern, items in sent.value.items():
            made.add_word(f" {pattern} ", (pattern.count(" ") + 1, tuple(items)))
        made.make_automaton()
        _AUTOMATA[sent.id] = made
    return _AUTOMATA[sent.id]


class _Sent:
    """A broadcast with an id that workers can remember it by."""

    def __init__(self, spark, value):
        import uuid

        self.id, self.var = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.var.value


def scan(docs: DataFrame, bench: DataFrame, keep: list[str] | None = None, text: str = "text",
         bench_text: str = "text", item: str = "item_id", window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns (default: all) and a struct column ``hits`` (renamed if
    it clashes) of n_words, n_hit, items (sorted) and spans: start and end of
    each run of hit words in the original text, in code points."""
    spark = docs.sparkSession
    ship(spark)
    keep = docs.columns if keep is None else keep
    name = fresh(keep, "hits")
    at = fresh([*keep, name], "_text")
    so_far = fresh([*keep, name, at], "_so_far")
    kept = [f for c in keep for f in docs.schema.fields if f.name == c]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    runs = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    hits = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                         T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))])
    partial = T.StructType([T.StructField("runs", runs), T.StructField("items", T.ArrayType(T.StringType()))])
    arrow = {t: _arrow_type(t) for t in (hits, partial)}

    def find(norm: str, sent) -> tuple[list, set]:
        found, items = [], set()
        if norm:
            seen_to, spaces = 0, 0
            for end, (n, of) in _automaton(sent).iter(norm):
                spaces += norm.count(" ", seen_to, end + 1)
                seen_to = end + 1
                last = spaces - 2                  # the word before the closing space
                found.append((last - n + 1, last))
                items.update(of)
        return found, items

    def merged(found: list) -> list:
        out: list = []
        for a, b in sorted(found):
            if out and a <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    def one_pass(sent):
        def run(batches):
            for batch in batches:
                col = []
                for t, before in zip(batch.column(at), batch.column(so_far), strict=True):
                    before = before.as_py()
                    found, items = find(normalise(t.as_py()), sent) if sent else ([], set())
                    found += [(r["first"], r["last"]) for r in before["runs"]]
                    col.append({"runs": [{"first": a, "last": b} for a, b in merged(found)],
                                "items": sorted(items.union(before["items"]))})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in [*keep, at]] + [pa.array(col, arrow[partial])], names=[*keep, at, so_far])
        return run

    def last_pass(sent):
        def run(batches):
            for batch in batches:
                col = []
                for t, before in zip(batch.column(at), batch.column(so_far), strict=True):
                    t, before = t.as_py(), before.as_py()
                    norm = normalise(t)
                    found, items = find(norm, sent) if sent else ([], set())
                    found += [(r["first"], r["last"]) for r in before["runs"]]
                    whole = merged(found)
                    spans = []
                    if whole:
                        places = [m.span() for m in _WORD.finditer(t.translate(_LOWER))]
                        spans = [{"start": places[a][0], "end": places[b][1]} for a, b in whole]
                    col.append({"n_words": max(norm.count(" ") - 1, 0), "n_hit": sum(b - a + 1 for a, b in whole),
                                "items": sorted(items.union(before["items"])), "spans": spans})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + [pa.array(col, arrow[hits])], names=[*keep, name])
        return run

    none = F.struct(F.array().cast(runs).alias("runs"), F.array().cast("array<string>").alias("items"))
    sent = docs.select(*[docs[c] for c in keep], docs[text].alias(at), none.alias(so_far))
    field = T.StructField(at, T.StringType())
    block = None
    for patterns in _blocks(bench, bench_text, item, window, block_bytes):
        if block is not None:
            # the pass before is done and stored, and its block gone, before the next one is sent
            sent = cut(sent.mapInArrow(one_pass(block), T.StructType([*kept, field, T.StructField(so_far, partial)])))
            block.var.unpersist()
        block = _Sent(spark, patterns)
    return sent.mapInArrow(last_pass(block), T.StructType([*kept, T.StructField(name, hits)]))


def _arrow_type(t):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def contaminated(hits: Column) -> Column:
    return hits["n_hit"] > 0
