"""Boolean keyword queries compiled to one Spark predicate.

A search strategy is an expression tree,

    Or(Term("insulin resist*"), And(Term("metformin"), Not(Term("mice"))))

or the text that panels write, which ``read_query`` turns into one:

    "insulin resist*"[tiab] OR (metformin AND Animals[mh] NOT mice)

`Term` matches a word or phrase at a word boundary, case-insensitively
(text is lower-cased, terms are lower-case); a trailing `*` is a prefix
wildcard.  Word characters are Unicode letters, digits and `_`, spelled
out as classes so the pattern means the same in every regex engine.  `fields` chooses the searched columns
(title + abstract by default, the `[tiab]` tag); `MeshTerm` tests exact
membership in an array column (the `[mh]` tag).  ``operators.postings`` evaluates
many queries in one scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"


@dataclass(frozen=True)
class Term:
    text: str
    fields: tuple[str, ...] = ("title", "abstract")

    def pattern(self) -> str:
        """Java regex: boundaries as look-arounds (no alternation to try at
        every position), same meaning as ``(^|[^w])term([^w]|$)``."""
        words = self.text.strip().lower().split()
        parts = [re.escape(w[:-1]) + WORD + "*" if w.endswith("*") else re.escape(w) for w in words]
        tail = "" if words[-1].endswith("*") else "(?!" + WORD + ")"
        return "(?<!" + WORD + ")" + r"\s+".join(parts) + tail


@dataclass(frozen=True)
class MeshTerm:
    heading: str
    field: str = "mesh"


@dataclass(frozen=True)
class And:
    items: tuple

    def __init__(self, *items):
        object.__setattr__(self, "items", tuple(items))


@dataclass(frozen=True)
class Or:
    items: tuple

    def __init__(self, *items):
        object.__setattr__(self, "items", tuple(items))


@dataclass(frozen=True)
class Not:
    item: object


def any_of(*phrases: str, fields=("title", "abstract")) -> Or:
    """The plain OR of quoted terms used for broad keyword searches."""
    return Or(*[Term(p, tuple(fields)) for p in phrases])


def compile_query(node) -> Column:
    """Expression tree -> boolean Column, never null: null text matches no term,
    so ``Not`` of a term is true for it."""
    if isinstance(node, Term):
        pat = node.pattern()
        hits = [F.coalesce(F.lower(F.col(f)).rlike(pat), F.lit(False)) for f in node.fields]
        return reduce(lambda a, b: a | b, hits)
    if isinstance(node, MeshTerm):
        return F.coalesce(
            F.exists(F.col(node.field), lambda h: F.lower(h) == node.heading.lower()),
            F.lit(False))
    if isinstance(node, And):
        return reduce(lambda a, b: a & b, [compile_query(i) for i in node.items])
    if isinstance(node, Or):
        return reduce(lambda a, b: a | b, [compile_query(i) for i in node.items])
    if isinstance(node, Not):
        return ~compile_query(node.item)
    raise TypeError(f"unknown query node {node!r}")


# The tags of a query text and the columns that they search.
TAGS = {"tiab": ("title", "abstract"), "ti": ("title",), "ab": ("abstract",), "mh": None}
_TOKEN = re.compile(r'\s*(?:"(?P<quoted>[^"]*)"|\[(?P<tag>[^\]\s]*)\]|(?P<mark>[()"\[\]])|(?P<word>[^\s()\[\]"]+))')


class QueryTextError(ValueError):
    """A query text that cannot be read; ``at`` is the place of the fault."""

    def __init__(self, what: str, at: int):
        super().__init__(f"{what} at {at}")
        self.at = at


def read_query(text: str, fields: tuple[str, ...] = ("title", "abstract")):
    """The expression tree of a query text.

    AND and NOT (``a NOT b``: a without b) bind tighter than OR and go from left to
    right; operators are upper case.  Words in a row are one phrase, as is what
    stands in quotes; a tag holds for the word or phrase before it, ``fields``
    where there is none."""
    text = text.rstrip()
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        start = m.end() - len(m[0].lstrip())
        if m.lastgroup == "mark" and m["mark"] not in "()":
            raise QueryTextError(f"unclosed {m['mark']}", start)
        tokens.append((m.lastgroup, m[m.lastgroup], start))
        at = m.end()
    tokens.append(("end", "", len(text)))
    place = 0

    def here():
        return tokens[place]

    def is_operator(*names):
        return here()[0] == "word" and here()[1] in names

    def phrase():
        """Words up to an operator, or a quoted phrase, and the tag behind."""
        nonlocal place
        kind, value, start = here()
        words = [value]
        place += 1
        while kind == "word" and here()[0] == "word" and not is_operator("AND", "OR", "NOT"):
            words.append(here()[1])
            place += 1
        said = " ".join(words).strip().lower()
        if not said.strip("* "):
            raise QueryTextError("empty term", start)
        searched = fields
        if here()[0] == "tag":
            if here()[1].lower() not in TAGS:
                raise QueryTextError(f"unknown tag {here()[1]}", here()[2])
            searched = TAGS[here()[1].lower()]
            place += 1
        return MeshTerm(said) if searched is None else Term(said, searched)

    def item():
        nonlocal place
        kind, value, start = here()
        if kind == "mark" and value == "(":
            place += 1
            inner = either()
            if here()[:2] != ("mark", ")"):
                raise QueryTextError("unclosed (", start)
            place += 1
            return inner
        if is_operator("NOT"):
            place += 1
            return Not(item())
        if kind in ("quoted", "word") and not is_operator("AND", "OR"):
            return phrase()
        raise QueryTextError("term expected", start)

    def both():
        nonlocal place
        left = item()
        while is_operator("AND", "NOT"):
            negative = here()[1] == "NOT"
            place += 1
            right = item()
            left = And(left, Not(right) if negative else right)
        return left

    def either():
        nonlocal place
        parts = [both()]
        while is_operator("OR"):
            place += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Or(*parts)

    tree = either()
    if here()[0] != "end":
        raise QueryTextError("operator expected", here()[2])
    return tree
