"""Many Boolean queries over one table in one scan.

``keyword.compile_query`` searches every text once for each term of each query.
Here texts are cut into words once; those that are, or begin with, a word of any
query are a row's postings (place, word, what stands before it).  A phrase is found
where the places of its words, less their number in it, agree.  A row's terms then
decide all queries.  Postings stay in their row, so that nothing is shuffled.

Words are runs of word characters, and what stands between two words is kept: a
phrase ``poly-cystic ovar*`` asks for a hyphen and for white space, as the
compiled pattern does, so both ways give the same rows.  Terms that begin or end
with other characters are searched by their pattern in the same scan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyword import WORD, And, MeshTerm, Not, Or, Term, compile_query

_PYTHON_WORD = re.compile(r"\w+", re.UNICODE)


def _leaves(node) -> list:
    if isinstance(node, (Term, MeshTerm)):
        return [node]
    return [x for i in ([node.item] if isinstance(node, Not) else node.items) for x in _leaves(i)]


def _steps(term: Term) -> list[tuple[str, bool, str | None]] | None:
    """(word, is a prefix, what stands before it) of a term; None if its words do
    not begin and end with word characters."""
    out = []
    for n, word in enumerate(term.text.strip().lower().split()):
        prefix, bare = word.endswith("*"), word.removesuffix("*")
        found = list(_PYTHON_WORD.finditer(bare))
        if not found or found[0].start() or found[-1].end() != len(bare):
            return None
        for k, m in enumerate(found):
            gap = (None if n == 0 else " ") if k == 0 else bare[found[k - 1].end():m.start()]
            if gap and gap != " " and gap.isspace():
                return None
            out.append((m[0], prefix and k == len(found) - 1, gap))
    return out


def _decide(node, has) -> Column:
    if isinstance(node, (Term, MeshTerm)):
        return has(node)
    if isinstance(node, Not):
        return ~_decide(node.item, has)
    return reduce(Column.__and__ if isinstance(node, And) else Column.__or__, [_decide(i, has) for i in node.items])


def evaluate(docs: DataFrame, key: str, queries: Mapping[str, And | Or | Not | Term | MeshTerm]) -> DataFrame:
    """(query, key) of every row that a query finds; ``key`` tells rows apart
    (null is a key).  Null texts hold no term, so ``Not`` finds their rows."""
    terms: dict[tuple, int] = {}                 # (field, steps) -> number
    plain: dict[object, str] = {}                # leaves that are searched where they stand -> column
    for leaf in (x for q in queries.values() for x in _leaves(q)):
        steps = _steps(leaf) if isinstance(leaf, Term) else None
        if steps is None:
            plain.setdefault(leaf, f"_p{len(plain)}")
        else:
            for f in leaf.fields:
                terms.setdefault((f, tuple(steps)), len(terms))
    fields = sorted({f for f, _ in terms})
    rows = docs.select(F.col(key).alias("_key"), *[compile_query(x).alias(c) for x, c in plain.items()],
                       *[_postings(F.lower(F.col(f)), [step for g, steps in terms for step in steps if g == f]).alias(f"_f{k}")
                         for k, f in enumerate(fields)])
    held = [F.when(_stands(F.col(f"_f{fields.index(f)}"), steps), n) for (f, steps), n in terms.items()]
    rows = rows.select("_key", *plain.values(), (F.array_compact(F.array(*held)) if held else F.array().cast("array<int>")).alias("_held"))

    def has(leaf) -> Column:
        if leaf in plain:
            return F.col(plain[leaf])
        numbers = [terms[f, tuple(_steps(leaf))] for f in leaf.fields]
        return reduce(Column.__or__, [F.array_contains("_held", n) for n in numbers])

    hits = F.array_compact(F.array(*[F.when(_decide(q, has), F.lit(name)) for name, q in queries.items()]))
    return rows.select(F.explode(hits).alias("query"), F.col("_key").alias(key))


def _postings(text: Column, steps: list[tuple]) -> Column:
    """(place, word, gap) of the words of a text that ``steps`` ask for; white space
    before a word is one space."""
    words = F.arrays_zip(F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0)).alias("w"), F.split(text, f"{WORD}+").alias("gap"))
    placed = F.transform(words, lambda x, i: F.struct(i.alias("place"), x["w"].alias("w"), x["gap"].alias("gap")))
    whole, begins = (sorted({w for w, prefix, _ in steps if prefix == p}) for p in (False, True))

    def asked(x) -> Column:
        return reduce(Column.__or__, [x["w"].startswith(w) for w in begins], x["w"].isin(*whole) if whole else F.lit(False))

    one = lambda gap: F.when(gap.rlike(r"^[ \t\n\x0B\f\r]+$"), " ").otherwise(gap)
    return F.transform(F.filter(placed, asked), lambda x: F.struct(x["place"].alias("place"), x["w"].alias("w"), one(x["gap"]).alias("gap")))


def _stands(postings: Column, steps: tuple) -> Column:
    """Whether the words of a term stand one behind the other; a null text has none."""
    def meets(step):
        word, prefix, gap = step

        def of(x) -> Column:
            same = x["w"].startswith(word) if prefix else x["w"] == word
            return same if gap is None else same & (x["gap"] == gap)
        return of

    if len(steps) == 1:
        return F.exists(postings, meets(steps[0]))
    def before(i):                               # a second parameter would be the element's number
        return lambda x: x["place"] - i

    starts = [F.transform(F.filter(postings, meets(step)), before(i)) for i, step in enumerate(steps)]
    return F.size(reduce(F.array_intersect, starts)) > 0
