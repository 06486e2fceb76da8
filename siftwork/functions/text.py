"""Text expressions: HTML clean-up, inverted-index abstracts, embed text."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# every named character reference of HTML 5, from the standard library, by first letter
_NAMED: dict[str, dict[str, str]] = {}
for _name, _value in html5.items():
    _NAMED.setdefault(_name[0], {})[_name] = _value
# those that need no semicolon, the longest first
_OPEN = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"</?[A-Za-z][^<>]*>|<[!?][^<>]*>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _windows(code: int) -> str:
    """What numbers 128 to 159 stand for: Windows-1252 where it has a character."""
    return bytes([code]).decode("cp1252", "ignore") or chr(code)


def _names(names: dict[str, str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, names.values())))


def _numbered(ref: Column) -> Column:
    """The character of a reference by number, with any number of digits: none for
    what is no character, U+FFFD for what no text may hold."""
    hexed = F.regexp_extract(ref, r"^&#[xX]0*([0-9a-fA-F]*)", 1)
    digits = F.regexp_extract(ref, r"^&#0*([0-9]*)", 1)
    beyond = F.lit(0x110000).cast("long")
    point = F.when(ref.rlike("^&#[xX]"), F.when(F.length(hexed) > 6, beyond).otherwise(F.conv(F.concat(F.lit("0"), hexed), 16, 10).cast("long"))) \
        .otherwise(F.when(F.length(digits) > 7, beyond).otherwise(F.concat(F.lit("0"), digits).cast("long")))
    none = (point.between(1, 8) | (point == 0x0B) | point.between(0x0E, 0x1F) | (point == 0x7F)
            | point.between(0xFDD0, 0xFDEF) | (point.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    return (F.when((point == 0) | point.between(0xD800, 0xDFFF) | (point >= 0x110000), F.lit("\ufffd"))
            .when(point.between(0x80, 0x9F), F.try_element_at(F.array(*[F.lit(_windows(c)) for c in range(0x80, 0xA0)]), (point - 0x7F).cast("int")))
            .when(none, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")))


def _named(ref: Column) -> Column:
    """The characters of a reference by name: the whole name, or the longest one
    that needs no semicolon with what follows it, or the text as it stands."""
    name = F.substring(ref, 2, 40)
    first, whole = F.substring(ref, 2, 1), F.lit(None).cast("string")
    for letter, names in sorted(_NAMED.items()):
        whole = F.when(first == letter, F.try_element_at(_names(names), name)).otherwise(whole)
    start = F.regexp_extract(name, f"^({_OPEN})", 1)
    part = F.try_element_at(_names({n: html5[n] for n in _OPEN.split("|")}), start)
    return F.coalesce(whole, F.concat(part, F.substr(name, F.length(start) + 1)), ref)


def _decode(ref: Column) -> Column:
    """One reference with its ``&``."""
    return F.when(ref.startswith("&#"), _numbered(ref)).otherwise(_named(ref))


def unescape_entities(col) -> Column:
    """HTML character references decoded as ``html.unescape`` does, in one pass
    over the text: parts and references are taken apart, decoded and laid together
    again.  A text without ``&`` is left alone."""
    c = _c(col)
    refs = F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0))
    parts = F.split(c, _REFERENCE, -1)
    pairs = F.zip_with(parts, refs, lambda p, r: F.concat(p, F.coalesce(_decode(r), F.lit(""))))
    return F.when(c.contains("&"), F.array_join(pairs, "")).otherwise(c)


def strip_tags(col) -> Column:
    """Replace comments and tags by a space, collapse whitespace, trim.  A tag
    begins with a letter, a slash and a letter, ``!`` or ``?``, so a "less than"
    in the text stays with what follows it."""
    out = F.regexp_replace(_c(col), _COMMENT, " ")
    out = F.regexp_replace(out, _TAG, " ")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.regexp_replace(out, r"^ | $", "")


def clean_html(col, unescape: bool = True) -> Column:
    """Title/abstract clean-up: character references decoded first, then tags
    stripped, so an escaped tag (`&lt;b&gt;`) is removed as a tag."""
    c = _c(col)
    if unescape:
        c = unescape_entities(c)
    return strip_tags(c)


def decode_inverted_index(col) -> Column:
    """`{word: [positions]}` -> words joined by spaces in position order.

    Every position of a word is used (a repeated word appears each time).
    """
    pairs = F.flatten(F.transform(
        F.map_entries(_c(col)),
        lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word"))),
    ))
    ordered = F.sort_array(pairs)                # array_sort would call a lambda for every comparison
    return F.array_join(F.transform(ordered, lambda t: t["word"]), " ")


def embedding_text(title, abstract, sep: str = " ", fill_nulls: bool = True) -> Column:
    """Text handed to an encoder: title + sep + abstract.

    The search-space variant fills nulls with '' first; the gold-set variant
    lets a null propagate (``fill_nulls=False``).
    """
    t, a = _c(title), _c(abstract)
    if fill_nulls:
        t, a = F.coalesce(t, F.lit("")), F.coalesce(a, F.lit(""))
    return F.concat(t, F.lit(sep), a)


def with_inverted_index(df: DataFrame, text_col: str, out_col: str = "abstract_inverted_index") -> DataFrame:
    """Add ``map<word, array<position>>`` of a text (whitespace tokens,
    positions from 0), built inside the row: (word, position) pairs sorted,
    runs of equal words cut at their start offsets and sliced into position
    lists.  No shuffle; O(n log n) per text.

    The sorted words and positions are real columns before the lambdas read
    them: an expression referenced inside a lambda would be re-evaluated
    for every element.
    """
    words = F.split(F.trim(F.regexp_replace(F.col(text_col), r"\s+", " ")), " ")
    pairs = F.sort_array(F.arrays_zip(words.alias("w"),
                                      F.sequence(F.lit(0), F.size(words) - 1).alias("p")))
    t = df.withColumn("_pairs", pairs)
    t = t.withColumn("_sw", F.col("_pairs.w")).withColumn("_sp", F.col("_pairs.p")) \
        .withColumn("_n", F.size("_sw"))
    sw, n = F.col("_sw"), F.col("_n")
    t = t.withColumn("_starts", F.filter(F.sequence(F.lit(0), n - 1),
                                         lambda i: (i == 0) | (F.element_at(sw, i + 1) != F.element_at(sw, i))))
    starts = F.col("_starts")
    keys = F.transform(starts, lambda i: F.element_at(sw, i + 1))
    vals = F.transform(starts, lambda s, k: F.slice(
        F.col("_sp"), s + 1, F.coalesce(F.try_element_at(starts, k + 2), n) - s))
    return t.withColumn(out_col, F.map_from_arrays(keys, vals)) \
        .drop("_pairs", "_sw", "_sp", "_n", "_starts")
