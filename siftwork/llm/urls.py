r"""Operator 9: URL verdicts by rules and, where none fits, by two character
models, in DataFrame functions only.

Rules are (host, path prefix, verdict); the longest that fits decides.  The URLs
that a rule decides teach two variable-order Markov models, one of accepted and
one of rejected URLs: counts of every character after every context of up to
``ORDER`` characters, over all of them.  A context's estimate is mixed with that
of the next shorter one by Witten-Bell weights, down to a uniform one, so that
any string has a likelihood.  A URL's score is the difference of the two
log-likelihoods divided by its length; the border is set on a fifth of the
labelled URLs which the models have not seen: the score at which accepted and
rejected ones are told apart best.

Hosts and paths are modelled as strings of their own, each distinct one once,
and per-gram results are joined back, so a host with a third of all rows costs
one string.  All counts are tables; only the border's histogram, of a fixed
number of bins, comes to the driver.

A null URL, or one without "://", has an empty host and path, no rule and score
zero, and is allowed if the border is not above zero; without labelled URLs of
both kinds the border is zero and scores are zero.  Repeated rows are judged
each on its own; extra columns pass through, a clashing name gets an underscore.
A very long URL is one string with as many grams.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fresh

# Host, start of the path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
ORDER = 4
ALPHABET = 256
BINS = 400
SPAN = 4.0                # scores beyond +-SPAN count as SPAN in the border's histogram
HELD_OUT = 5


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_u, instr(_u, '://') + 3)")).otherwise("")
    return (ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(RULES, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grams(strings: DataFrame, key: str, order: int = ORDER) -> DataFrame:
    """(key..., gram): each character with the ``order`` before it, the string
    opened by as many marks and closed by one."""
    open_, close = "\x02" * order, "\x03"
    padded = F.concat(F.lit(open_), F.col(key), F.lit(close))
    at = F.explode(F.sequence(F.lit(1), F.length(key) + 1))
    return strings.select("*", at.alias("_at"), padded.alias("_p")).withColumn(
        "gram", F.expr(f"substring(_p, _at, {order + 1})")).drop("_at", "_p")


def model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, llr): log-likelihood of the gram's last character after the rest,
    accepted minus rejected.  ``counts`` holds (gram, allow, block): how often
    each gram of full order was seen in either kind, zeros included."""
    known = counts.select("gram", "allow", "block")
    lp = known.select("gram", F.lit(1.0 / ALPHABET).alias("pa"), F.lit(1.0 / ALPHABET).alias("pb"))
    for k in range(order + 1):
        tail = F.expr(f"right(gram, {k + 1})")
        ctx = F.expr(f"left(right(gram, {k + 1}), {k})")
        seen = known.groupBy(tail.alias("t"), ctx.alias("c")).agg(F.sum("allow").alias("a"), F.sum("block").alias("b"))
        of_ctx = seen.groupBy("c").agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"),
            F.sum((F.col("a") > 0).cast("long")).alias("ka"), F.sum((F.col("b") > 0).cast("long")).alias("kb"))
        each = seen.join(of_ctx, "c").select("t", "a", "b", "na", "nb", "ka", "kb")
        mixed = lp.withColumn("t", tail).join(each, "t")

        def step(n, total, kinds, below):
            return F.when(F.col(total) + F.col(kinds) > 0,
                          (F.col(n) + F.col(kinds) * F.col(below)) / (F.col(total) + F.col(kinds))).otherwise(F.col(below))

        lp = mixed.select("gram", step("a", "na", "ka", "pa").alias("pa"), step("b", "nb", "kb", "pb").alias("pb"))
    return lp.select("gram", (F.log("pa") - F.log("pb")).alias("llr"))


def _border(scored: DataFrame) -> float:
    """The score that tells held-out accepted from rejected URLs best."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN))).cast("int")))
    rows = scored.groupBy(bin_.alias("bin"), "verdict").count().collect()
    allow, block = [0] * BINS, [0] * BINS
    for r in rows:
        (allow if r["verdict"] == "allow" else block)[r["bin"]] += r["count"]
    na, nb = sum(allow), sum(block)
    if not na or not nb:
        return 0.0
    best, at, lost, stopped = -1.0, [], 0, 0
    for k in range(BINS + 1):                      # border below bin k: balanced accuracy
        good = (na - lost) / na + stopped / nb
        if good > best + 1e-12:
            best, at = good, [k]
        elif abs(good - best) <= 1e-12:
            at.append(k)
        if k < BINS:
            lost, stopped = lost + allow[k], stopped + block[k]
    return at[len(at) // 2] * (2 * SPAN / BINS) - SPAN


def judge(pages: DataFrame, url: str = "url", keep: list[str] | None = None, order: int = ORDER) -> DataFrame:
    """``keep`` columns (default: all) with host, path, rule, verdict and score."""
    keep = pages.columns if keep is None else keep
    u = pages.select(F.struct(*[pages[c] for c in keep]).alias("kept"), pages[url].alias("_u"))
    host, path = parts(F.col("_u"))
    rows = u.select("kept", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    rows = cut(rows.withColumn("rule", rule).withColumn("by_rule", verdict))
    held = F.pmod(F.xxhash64("host", "path"), F.lit(HELD_OUT)) == 0
    taught = F.col("by_rule").isNotNull() & ~held
    # each distinct string once, with how often either kind taught it
    one = rows.select(F.col("by_rule"), taught.alias("taught"), F.explode(F.array(
        F.struct(F.lit("h").alias("of"), F.col("host").alias("s")), F.struct(F.lit("p").alias("of"), F.col("path").alias("s")))).alias("x"))
    strings = cut(one.groupBy(F.concat(F.col("x")["of"], F.col("x")["s"]).alias("s")).agg(
        F.count(F.when(F.col("taught") & (F.col("by_rule") == "allow"), 1)).alias("allow"),
        F.count(F.when(F.col("taught") & (F.col("by_rule") == "block"), 1)).alias("block")))
    cells = cut(grams(strings, "s", order).groupBy("s", "gram").agg(
        F.count(F.lit(1)).alias("n"), F.first("allow").alias("a"), F.first("block").alias("b")))
    counts = cells.groupBy("gram").agg(F.sum(F.col("n") * F.col("a")).alias("allow"), F.sum(F.col("n") * F.col("b")).alias("block"))
    llr = cut(model(cut(counts), order))
    sums = cut(cells.join(llr, "gram").groupBy("s").agg(F.sum(F.round("llr", 9).cast("decimal(28,9)") * F.col("n")).cast("double").alias("sum")))
    by_host = sums.where(F.col("s").startswith("h")).select(F.expr("substring(s, 2)").alias("host"), F.col("sum").alias("hs"))
    by_path = sums.where(F.col("s").startswith("p")).select(F.expr("substring(s, 2)").alias("path"), F.col("sum").alias("ps"))
    n = F.length("host") + F.length("path")
    score = F.when(n > 0, (F.col("hs") + F.col("ps")) / (n + 2)).otherwise(F.lit(0.0))
    scored = cut(rows.join(by_host, "host").join(by_path, "path").select(
        "kept", "host", "path", "rule", "by_rule", score.alias("score")))
    border = _border(scored.where(F.col("by_rule").isNotNull() & held).select("score", F.col("by_rule").alias("verdict")))
    names = []
    for c in ("host", "path", "rule", "verdict", "score"):
        names.append(fresh([*keep, *names], c))
    own = F.coalesce("by_rule", F.when(F.col("score") >= border, "allow").otherwise("block"))
    return scored.select(*[F.col("kept")[c].alias(c) for c in keep], F.col("host").alias(names[0]), F.col("path").alias(names[1]),
                         F.col("rule").alias(names[2]), own.alias(names[3]), F.col("score").alias(names[4]))
