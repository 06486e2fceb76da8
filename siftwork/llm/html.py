"""Operator 5: main text of web pages, by markup and nearest-URL differencing.

A page is cut into text lines (blocks), each with the regions it stands in:
whether the markup says it is no content (head, menus, footers, forms, adverts
and the like by element, role, class or id; inside or around an article by a
class or id that names such a part as a whole only) and whether it is inside an
article or main element.  An article in a form or box that is no content counts
if there is no other; a marked part of a line is left out of the line.

Differencing then compares a page with the nearest differing pages before and
after it in URL order within the host: its unmarked lines and all lines of the
other are aligned by longest common subsequence, and shared lines go.  A page is
no differing one if one of the two has no unmarked line of its own (a copy or a
part); the search then goes on.  Where shared lines hold over half of a page's
unmarked text, it may be an edited copy: then only those go that a third
differing page within reach has too, if there is one.  If a page has an article
or main element with text, its text is those lines, less the shared ones that frame
it: articles share passages and headings, and an advert may quote one, so it is
compared with what the two nearest differing pages on either side hold outside their
articles, and lines go that all four have there, before the first or behind the last
line that they have not all.  An article that would lose all stays whole.  Else the
text is all lines that are neither marked as no content nor shared.

Pages are numbered within their host by URL path with range exchanges, which
split a host with a third of all pages; adjacent pages with the same unmarked
lines count as one.  Blocks of consecutive numbers (with ``REACH`` neighbours on
either side) are compared task by task.
Only line hashes and lengths travel for that, not pages.  Alignment is
bit-parallel.

Null html gives an empty text and zero characters; a null URL counts as an
empty host and path.  Repeated rows are each extracted, alike.  Unclosed
elements end where an element around them ends; those without text (images,
frames, choices) that are not closed end at their own tag.  A very long page is
read in its row.  Extra columns pass through; a clashing name gets an underscore.
An empty table gives no rows.
"""

from __future__ import annotations

import html
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordinal import ordinal
from .common import ascii_lower, fresh, shared_path, ship

BLOCK = 64                # pages compared by one call
REACH = 16                # differing runs of pages looked through on either side
COPY_SHARE = 0.5

# What markup says of its content.
NO_TEXT = "script style noscript template svg math canvas iframe object select textarea title"
FRAME = "head nav footer aside form button dialog menu fieldset"
MAIN = "article main"
HOLDERS = "html body div section header ul ol dl table figure details center span p"
BLOCKS = ("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
          "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table "
          "tbody tfoot thead title tr ul")
SPACES = "br td th img option"
MARKED = ("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
          "newsletter subscribe subscription signup popup modal overlay sidebar widget menu nav navbar navigation "
          "breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing social related recommended "
          "recommendations comment comments disqus login search pagination pager skip")
ROLES = "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form"

# of a compound class or id inside an article: what it is about, and what may follow
ABOUT = ("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter "
         "subscribe subscription signup popup modal sidebar nav navbar navigation breadcrumb breadcrumbs share sharing social related "
         "recommended recommendations comment comments disqus login pagination pager toolbar")
PARTS = ("list slot box item items notice bar banner button buttons container wrapper wrap section block form area unit widget icons links "
         "thread body text content author reply replies meta count counter popup modal overlay signup row inner outer panel posts "
         "articles stories message dialog prompt title heading link tools")

NO_TEXT_, FRAME_, MAIN_, HOLDERS_, BLOCKS_, SPACES_, MARKED_, ROLES_, ABOUT_, PARTS_ = (
    frozenset(x.split()) for x in (NO_TEXT, FRAME, MAIN, HOLDERS, BLOCKS, SPACES, MARKED, ROLES, ABOUT, PARTS))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"[a-z0-9]+")
STATE_ = frozenset("has with without no".split())      # such a class tells of what is beside the text
CLOSED = re.compile(r"""(?:^|[\s"'])/\s*\Z""")


def _compound(whole: str) -> bool:
    """Whether a class or id names a part of what is no content: ``comment-list``,
    ``ad-slot``, ``comment-12``; not ``article-header`` or ``related-work``."""
    first, *rest = NAME.findall(whole) or [""]
    return first in ABOUT_ and bool(rest) and all(w in PARTS_ or w in ABOUT_ or w.isdigit() for w in rest)


def _marked(name: str, attributes: str, in_main: bool) -> int:
    """Whether an element's markup says that it holds no content: 2 by its
    element, role, or a class or id that names such a part, 1 by a word of a class
    or id, which does not count inside or around an article."""
    if name in FRAME_ or name == "header" and not in_main:
        return 2
    if "=" not in attributes or name in ("html", "body"):
        return 0
    weak = 0
    for key, value in ATTRIBUTE.findall(attributes):
        for whole in value.lower().strip("\"'").split():
            if name in MAIN_:
                if whole in ("comment", "comments") or whole.startswith("comment") and _compound(whole):
                    return 2
            elif key.lower() == "role":
                if whole in ROLES_:
                    return 2
            elif whole in MARKED_:
                if whole != "header" or not in_main:
                    return 2
            elif in_main:
                if _compound(whole):
                    return 2
            else:
                words = NAME.findall(whole)
                weak |= not STATE_.intersection(words) and any(w in MARKED_ for w in words)
    return int(weak)


def _ends(page: str, name: str) -> dict[int, int]:
    """Where each element ``name`` that is closed ends, by where it begins."""
    ends, opened = {}, []
    for m in re.finditer(rf"<(/?){name}(?![a-zA-Z0-9:-])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?", page, re.I):
        if not m[1]:
            if not CLOSED.search(m[2]):
                opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


def lines(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, marked as no content, inside article or main) of each block."""
    out: list[tuple[str, bool, tuple[int, ...], bool, bool]] = []
    text: list[str] = []
    # open elements: name and what holds inside: marked, those marked by a word only,
    # main, held (1: an article in a marked holder, 2: a marked part of one)
    around: list[tuple[str, tuple[bool, tuple[int, ...], bool, int]]] = []
    nothing = (False, (), False, 0)
    marked, weak, main, held = nothing
    holders: set[int] = set()                        # marked by a word, but an article is inside
    ends: dict[str, dict[int, int]] = {}
    at, page = 0, page or ""

    def close_block() -> None:
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            out.append((line, marked, weak, main, held == 1))

    while m := TOKEN.search(page, at):
        if m.start() > at:
            text.append(html.unescape(page[at:m.start()]))
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in NO_TEXT_ and not m[1]:
            if CLOSED.search(m[3]):
                continue
            if name in ("script", "style"):          # code, to the end of the page if need be
                end = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at)
                at = end.end()
            else:
                if name not in ends:
                    ends[name] = _ends(page, name)
                at = max(at, ends[name].get(m.start(), at))
            continue
        if name in SPACES_:
            text.append(" ")
            continue
        if name in BLOCKS_:
            close_block()
        if m[1]:
            for k in range(len(around) - 1, -1, -1):
                if around[k][0] == name:
                    close_block()
                    del around[k:]
                    marked, weak, main, held = around[-1][1] if around else nothing
                    break
            continue
        if m[3].rstrip().endswith("/"):
            continue
        now = _marked(name, m[3], main or held == 1)
        if name == "span" and now == 2:              # inside a line: left out of it
            if name not in ends:
                ends[name] = _ends(page, name)
            until = ends[name].get(m.start())
            while until is None:                     # not closed: up to the next block
                after = TOKEN.search(page, at)
                until = len(page) if after is None else after.start() if (after[2] or "").lower() in BLOCKS_ else None
                at = after.end() if until is None else at
            text.append(" ")
            at = until
            continue
        if name == "p" or name == "span":            # may stay open: only kept if marked
            if not now:
                continue
        elif name not in HOLDERS_ and name not in FRAME_ and name not in MAIN_ and not now:
            continue
        close_block()
        if name in MAIN_ and marked and now != 2 and not held:
            held = 1
        elif now == 2 and held:
            held = 2
        marked = marked or now == 2
        if now == 1:
            weak = (*weak, m.start())
        if name in MAIN_ and not marked:
            main = True
            holders.update(weak)
        around.append((name, (marked, weak, main, held)))
    if at < len(page):
        text.append(html.unescape(page[at:]))
    close_block()
    found = [(line, strong or not holders.issuperset(words), inside, kept) for line, strong, words, inside, kept in out]
    # an article wins over the form or box around it, if there is no other one
    alone = not any(inside and not strong for _, strong, inside, _ in found)
    return [(line, strong and not (alone and kept), inside or alone and kept) for line, strong, inside, kept in found]


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b``: one big
    integer a line of ``a`` holds a whole row of the alignment table."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        met = row & places.get(x, 0)
        row = ((row + met) | (row - met)) & full
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                out.append(i)
                j -= 1
    return out[::-1]


class _Page:
    """Line hashes of a page; ``own``, ``sizes`` and ``article`` (which of them stand in
    an article) are those of its unmarked lines."""

    def __init__(self, number: int, hashes: list[int], sizes: list[int]):
        self.number, self.hashes = number, hashes
        self.own = [h for h, n in zip(hashes, sizes, strict=True) if n]
        self.sizes = [abs(n) for n in sizes if n]
        self.article = [k for k, n in enumerate(n for n in sizes if n) if n < 0]
        self.kinds, self.all = frozenset(self.own), frozenset(hashes)
        # what surely is no article: marked lines, and those around an article
        self.frame = [h for h, n in zip(hashes, sizes, strict=True) if not n or n > 0 and self.article]

    def differs(self, other: _Page) -> bool:
        """Whether both have unmarked lines that the other has not."""
        return not (self.kinds <= other.kinds or other.kinds <= self.kinds)


def _frame_of(pages: list[_Page], i: int) -> set[int]:
    """Unmarked lines of page ``i`` that it shares with the nearest differing pages."""
    page = pages[i]
    around = [k for k in range(len(pages)) if abs(pages[k].number - page.number) <= REACH]
    # the differing ones before it and behind it, the nearest first
    sides = [(k for k in side if page.differs(pages[k])) for side in ([k for k in around if k < i][::-1], [k for k in around if k > i])]
    if page.article:
        near = [k for side in sides for k in itertools.islice(side, 2)]
        # most articles begin and end with lines of their own
        if len(near) < 4 or not any(all(page.own[x] in pages[k].frame for k in near) for x in (page.article[0], page.article[-1])):
            return set()
        framed = set.intersection(*[set(shared(page.own, pages[k].frame)) for k in near])
        own = [x for x in page.article if x not in framed]
        return {x for x in page.article if x < own[0] or x > own[-1]} if own else set()
    gone: set[int] = set()
    for k in (k for side in sides for k in itertools.islice(side, 1)):
        other = pages[k]
        found = shared(page.own, other.hashes)
        if sum(page.sizes[x] for x in found) > COPY_SHARE * sum(page.sizes):
            third = [pages[x].all for x in around if x != k and page.differs(pages[x]) and other.differs(pages[x])]
            found = [x for x in found if not third or any(page.own[x] in t for t in third)]
        gone.update(found)
    return gone


def _hash(line: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def shared_lines(pages: DataFrame, url: str, page: str, block: int = BLOCK) -> DataFrame:
    """(k1, k2, gone): by hashes of page and URL, the numbers (among its unmarked
    lines) of the lines that a page shares with the nearest differing pages before
    and after it; of a page with an article, those that frame the article."""
    def narrow(batches):
        for batch in batches:
            hashes, sizes, content = [], [], []
            for p in batch.column("page"):
                found = lines(p.as_py())
                hashes.append([_hash(x[0]) for x in found])
                # none of a marked line, less than none of a line in an article
                sizes.append([0 if x[1] else -len(x[0]) if x[2] else len(x[0]) for x in found])
                own = [f"{h}{'a' * (n < 0)}" for h, n in zip(hashes[-1], sizes[-1], strict=True) if n]
                content.append(_hash(" ".join(own)) if own else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("k1", "k2", "host", "path")] +
                [pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(content, pa.int64())],
                names=["k1", "k2", "host", "path", "hashes", "sizes", "content"])

    rest = F.when(F.instr("u", "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise("")
    rows = pages.select(F.xxhash64(page).alias("k1"), F.xxhash64(url).alias("k2"), F.coalesce(url, F.lit("")).alias("u"), F.col(page).alias("page"))
    rows = rows.select("k1", "k2", ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)).alias("host"),
                       F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"), "page")
    rows = rows.mapInArrow(narrow, "k1 long, k2 long, host string, path string, hashes array<long>, sizes array<int>, content long")
    # pages without unmarked lines have nothing to lose and nothing that differs
    rows = rows.where("content is not null").dropDuplicates(["k1", "k2"])
    placed = ordinal(rows, ["host"], ["path", "k2", "k1"], name="n").drop("path")
    # adjacent pages of equal content: their number less that among all of the content is the same
    placed = ordinal(placed, ["host", "content"], ["n"], name="r").withColumn("run", F.col("n") - F.col("r"))
    runs = placed.groupBy("host", "content", "run").agg(
        F.min("n").alias("n"), F.min_by(F.struct("hashes", "sizes"), "n").alias("l"))
    runs = ordinal(runs, ["host"], ["n"], name="m").select(
        "host", "content", "run", (F.col("m") - 1).alias("m"), F.col("l")["hashes"].alias("hashes"), F.col("l")["sizes"].alias("sizes"))
    # a run near the edge of a block is also a neighbour of the next blocks' runs
    near = [F.floor((F.col("m") + x) / block) for x in (-REACH, REACH)]
    dealt = runs.select("*", F.explode(F.sequence(*near)).alias("block"))

    def compare(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["m"])
        runs, out = [_Page(r["m"], r["hashes"], r["sizes"]) for r in rows], []
        for i, r in enumerate(rows):
            if r["m"] // block == r["block"] and (gone := _frame_of(runs, i)):
                out.append({k: r[k] for k in ("host", "content", "run")} | {"gone": sorted(gone)})
        return pa.Table.from_pylist(out, pa.schema([
            ("host", pa.string()), ("content", pa.int64()), ("run", pa.int64()), ("gone", pa.list_(pa.int32()))]))

    gone = dealt.groupBy("host", "block").applyInArrow(compare, "host string, content long, run long, gone array<int>")
    return placed.select("k1", "k2", "host", "content", "run").join(
        gone, ["host", "content", "run"]).select("k1", "k2", "gone")


def main_text(page: str | None, gone) -> str:
    """Lines of the article, or of the whole page if there is none, less marked ones
    and those that differencing has found (``gone``, numbers of unmarked lines)."""
    own = [(text, inside) for text, marked, inside in lines(page) if not marked]
    article = any(inside for _, inside in own)
    gone = set(gone or ())
    return "\n\n".join(text for k, (text, inside) in enumerate(own) if (inside or not article) and k not in gone)


def extract(pages: DataFrame, url: str = "url", page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the html) with text and n_chars."""
    spark = pages.sparkSession
    ship(spark)
    keep = [c for c in pages.columns if c != page] if keep is None else keep
    names = []
    for c in ("text", "n_chars"):
        names.append(fresh([*keep, *names], c))
    at = shared_path(spark, "shared-lines")
    shared_lines(pages, url, page).write.parquet(at)
    gone = spark.read.parquet(at)
    rows = pages.select(F.struct(*[pages[c] for c in keep]).alias("kept"), F.xxhash64(page).alias("_k1"),
                        F.xxhash64(url).alias("_k2"), F.col(page).alias("page"))
    rows = rows.join(gone, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left").select("kept", "page", "gone")

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py(), g.as_py()) for p, g in zip(batch.column("page"), batch.column("gone"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["kept", "text", "n_chars"])

    schema = T.StructType([f for f in rows.schema.fields if f.name == "kept"] + [
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("kept")[c].alias(c) for c in keep], F.col("text").alias(names[0]), F.col("n_chars").alias(names[1]))
