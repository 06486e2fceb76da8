r"""Operator 10: secrets found through a trigram index, in DataFrame functions only.

For every rule a Boolean query over trigrams is derived from its pattern: the
strings that every match holds, cut into trigrams (in lower case), as
alternatives that each ask for all of theirs.  One pass writes the inverted
index of the trigrams that some query names: (trigram, document) postings.
Intersecting the postings of each alternative gives the candidates of a rule,
and only there its pattern runs.  A rule without mandatory trigrams (``hex``)
is matched in every text.

Places come from splitting the text at the matches: the parts and the matches
add up to the offsets, in code points.

Null and empty texts have no secrets.  Repeated rows and rows that share an id
are judged each on its own text.  A very long text is scanned in its row; the
work grows with its matches and its length.  Extra columns pass through; a
clashing name gets an underscore.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, firm, fresh

# Fixed values.  kind -> (pattern, group whose length counts, its least length);
# the first three are the base kinds, in the order of ties.
RULES = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "private_key": (r"-----BEGIN [A-Z0-9 ]{0,24}PRIVATE KEY-----", 0, 0),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "google": (r"AIza[A-Za-z0-9_-]{35,}", 0, 0),
    "stripe": (r"sk_(live|test)_[A-Za-z0-9]{16,}", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
}
BASE = ("assign", "access", "hex")
RUN = 256                 # matches taken together, see _before
BLOCK = 4096              # characters of a block of text, see mask
MOST_STRINGS = 64
MOST_CLASS = 6

Query = set[frozenset[str]]          # any of these sets of trigrams, each in full


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _tidy(q: Iterable[frozenset[str]]) -> Query:
    """Without alternatives that ask for more than another one."""
    q = set(q)
    return {a for a in q if not any(b < a for b in q)}


def _and(p: Query, q: Query) -> Query:
    return _tidy(a | b for a in p for b in q)


class _Reading:
    """What a pattern's matches must hold, read from left to right: ``ends``
    are all strings the match so far may end in (since the last gap)."""

    def __init__(self):
        self.ends, self.query = {""}, {frozenset()}

    def gap(self) -> None:
        self.query = _and(self.query, _tidy(map(_trigrams, self.ends)))
        self.ends = {""}

    def add(self, strings: set[str] | None) -> None:
        if strings is None or len(strings) * len(self.ends) > MOST_STRINGS:
            self.gap()
        else:
            self.ends = {a + b for a in self.ends for b in strings}

    def read(self, parts) -> None:
        for op, arg in parts:
            kind = str(op)
            if kind == "LITERAL":
                self.add({chr(arg).lower()})
            elif kind == "IN":
                self.add(_class(arg))
            elif kind == "SUBPATTERN":
                self.read(arg[-1])
            elif kind == "BRANCH":
                each = [_exact(b) for b in arg[1]]
                if None not in each:
                    self.add(set().union(*each))
                else:
                    self.gap()
                    self.query = _and(self.query, _tidy(a for b in arg[1] for a in _query(b)))
            elif kind == "MAX_REPEAT" and tuple(arg[:2]) == (0, 1) and _exact(arg[2]) is not None:
                self.add({""} | _exact(arg[2]))
            elif kind == "MAX_REPEAT" and arg[0] >= 1:
                self.gap()
                self.query = _and(self.query, _query(arg[2]))
            else:
                self.gap()


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < MOST_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def _exact(parts) -> set[str] | None:
    """All strings that ``parts`` match, in lower case, if they are few."""
    r = _Reading()
    r.read(parts)
    return r.ends if r.query == {frozenset()} and not _has_gap(parts) else None


def _has_gap(parts) -> bool:
    for op, arg in parts:
        kind = str(op)
        if kind == "LITERAL" or kind == "IN" and _class(arg) is not None:
            continue
        if kind == "SUBPATTERN" and not _has_gap(arg[-1]):
            continue
        if kind == "BRANCH" and not any(map(_has_gap, arg[1])):
            continue
        if kind == "MAX_REPEAT" and tuple(arg[:2]) == (0, 1) and not _has_gap(arg[2]):
            continue
        return True
    return False


def _query(parts) -> Query:
    r = _Reading()
    r.read(parts)
    r.gap()
    return r.query


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams that every match of ``pattern`` holds in lower
    case; one empty alternative if there is nothing to ask for."""
    return _query(re._parser.parse(pattern))


def postings(docs: DataFrame, key: list[str], text: str, grams: list[str]) -> DataFrame:
    """(gram, key...) rows: which documents hold which of ``grams``."""
    low = fresh(docs.columns, "_low")
    d = docs.select(*key, ascii_lower(F.col(text)).alias(low))
    held = F.array_compact(F.array(*[F.when(F.col(low).contains(g), F.lit(g)) for g in grams]))
    return d.select(F.explode(held).alias("gram"), *key)


def candidates(index: DataFrame, key: list[str], queries: dict[str, Query]) -> DataFrame:
    """(key..., rules): the rules for which a document is in all postings of an
    alternative.  A document has at most as many postings as there are grams."""
    held = index.groupBy(*key).agg(F.collect_set("gram").alias("_held"))
    rules = []
    for rule, query in queries.items():
        hit = F.lit(False)
        for alternative in sorted(query, key=sorted):
            need = F.array(*map(F.lit, sorted(alternative)))
            hit = hit | (F.size(F.array_except(need, "_held")) == 0)
        rules.append(F.when(hit, F.lit(rule)))
    found = held.select(*key, F.array_compact(F.array(*rules)).alias("_rules"))
    return found.where(F.size("_rules") > 0)


def _places(text: Column, kind: str, order: int, names: tuple[str, str, str]) -> tuple[list, Column]:
    """Steps (column name, expression) to the matches and parts, and the spans."""
    pattern, group, least = RULES[kind]
    whole, part, value = names
    steps = [(whole, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))]
    some = F.size(whole) > 0
    steps.append((part, F.when(some, F.split(text, pattern, -1))))
    if group:
        steps.append((value, F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))))
    counted = F.col(value) if group else F.col(whole)
    both = F.zip_with(whole, F.slice(part, 1, F.size(whole)),
                      lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("n")))
    both = F.zip_with(both, counted, lambda b, v: F.struct(b["gap"].alias("gap"), b["n"].alias("n"), (F.length(v) >= least).alias("on")))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    before = _before(both, lambda x: x["gap"] + x["n"], lambda a, b: a + b)

    def span(x, at):
        start = at + x["gap"]
        return F.when(x["on"], F.struct(start.alias("start"), F.lit(order).alias("order"), (start + x["n"]).alias("end"), F.lit(kind).alias("kind")))

    return steps, F.when(some, F.array_compact(F.zip_with(both, before, span))).otherwise(none)


def _before(array: Column, value, combine) -> Column:
    """For each element, what ``combine`` makes of 0 and the values of all before
    it.  Growing an array copies it, so elements are taken in runs of ``RUN``, and
    each run begins with what the runs before it come to."""
    def scan(items, first, of):
        grown = F.aggregate(items, F.array(first), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), of(x)))))
        return F.slice(grown, 1, F.size(items))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / RUN).cast("int")), lambda k: F.slice(array, k * RUN + 1, F.lit(RUN)))
    whole = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda acc, x: combine(acc, value(x))))
    firsts = scan(whole, F.lit(0), lambda x: x)
    return F.flatten(F.zip_with(runs, firsts, lambda run, first: scan(run, first, value)))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) and ``secrets``: an array of (start,
    order, end, kind) by start, then kind as listed in RULES."""
    keep = docs.columns if keep is None else keep
    queries = {k: trigram_query(p) for k, (p, _, _) in RULES.items()}
    indexed = {k: q for k, q in queries.items() if frozenset() not in q}
    grams = sorted(set().union(*(a for q in indexed.values() for a in q)))
    h, rules, out = (fresh(docs.columns, c) for c in ("_hash", "_rules", "secrets"))
    rows = docs.select(*[docs[c].alias(c) for c in dict.fromkeys([*keep, id_col, text])]).withColumn(h, F.xxhash64(text))
    index = postings(rows.select(F.col(id_col).alias("k1"), F.col(h).alias("k2"), F.col(text).alias("t")), ["k1", "k2"], "t", grams)
    found = cut(candidates(index, ["k1", "k2"], indexed)).withColumnRenamed("_rules", "_found")
    d = rows.join(found, rows[id_col].eqNullSafe(found["k1"]) & (rows[h] == found["k2"]), "left")
    d = d.withColumn(rules, F.col("_found"))
    spans = []
    for n, kind in enumerate(RULES):
        names = tuple(fresh(d.columns, f"_{kind}_{x}") for x in ("whole", "part", "value"))
        t = F.coalesce(F.col(text), F.lit(""))
        if kind in indexed:
            t = F.when(F.array_contains(rules, kind), t).otherwise("")
        at = fresh(d.columns, f"_{kind}_text")
        d = d.withColumn(at, t)
        steps, places = _places(F.col(at), kind, n, names)
        for name, e in steps:
            d = d.withColumn(name, firm(e))
        spans.append(places)
    return d.select(*[d[c] for c in keep], firm(F.sort_array(F.concat(*spans))).alias(out))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def mask(df: DataFrame, text: str, spans: str, with_: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``text`` replaced, overlapping ones as one.  Parts of
    the text are taken from blocks of it, as a part of a long string is only found
    by reading the string up to it."""
    blocks, ends, cut_at = (fresh(df.columns, c) for c in ("_blocks", "_ends", "_cut"))
    some = F.size(spans) > 0
    d = df.withColumn(blocks, firm(F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))))
    d = d.withColumn(ends, firm(F.when(some, _before(F.col(spans), lambda x: x["end"], F.greatest))))

    def part(start, end):
        first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start - first * BLOCK + 1, F.greatest(end - start, F.lit(0)))

    pieces = F.zip_with(spans, ends, lambda x, before: F.when(x["start"] >= before, F.concat(part(before, x["start"]), F.lit(with_))).otherwise(""))
    last = F.array_max(F.transform(spans, lambda x: x["end"]))
    d = d.withColumn(cut_at, firm(F.when(some, F.concat(F.array_join(pieces, ""), part(last, F.length(text))))))
    return d.withColumn(text, F.when(some, F.col(cut_at)).otherwise(F.col(text))).drop(blocks, ends, cut_at)


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """All rows and columns, secrets masked; ``length`` names a column of text lengths to renew."""
    found = scan(docs, id_col, text)
    spans = found.columns[-1]
    out = mask(found, text, spans)
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.size(spans) == 0, F.col(length)).otherwise(F.length(text)).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)
