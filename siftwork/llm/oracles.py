r"""DuckDB twins of the queries that SQL can express: 4, 6, 8, 10, 12 and 13.

The others are held against brute force in tests/llm: merging by an automaton,
record files, packing by cost, components, page alignment, byte-exact borders between hashes and
smoothed models are beyond one SQL statement."""

from __future__ import annotations

from . import quality, secrets
from .common import LOWER, SPACE_CLASS, UPPER
from .decontam import NOT_WORD, WINDOW
from .substring import WINDOW as PASSAGE


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(text: str, gap: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {_q(gap)}), lambda x: x <> '')"


_GAP = f"[{SPACE_CLASS}]+"


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


_OP4 = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(_low('text'), NOT_WORD)} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS k, least(len(w), {WINDOW}) AS n
        FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS s FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_words(_low('text'), NOT_WORD)} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes)),
m AS (SELECT doc_id, s, dw.n, item FROM dw JOIN win USING (k, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM m WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

_OP6 = rf"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')", _GAP)} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + {PASSAGE - 1}], ' ') AS k
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {PASSAGE - 1})) AS s FROM d)),
first AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (
  SELECT doc_id, unnest(generate_series(s, s + {PASSAGE - 1})) AS p FROM win JOIN first USING (k) WHERE least < doc_id)),
word AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM d),
stay AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN stay USING (doc_id)"""

_LINE_WORDS = _words("x", _GAP)
_BARE = f"regexp_replace(x, {_q(_GAP)}, '', 'g')"
_MARKS = quality.MARKS.replace("\\\\", "\\")
_BAD = rf"""(NOT regexp_matches(x, '[\p{{L}}\p{{N}}]')
  OR trim(regexp_replace(' ' || regexp_replace(lower(x), {_q(quality.GAP)}, '  ', 'g') || ' ', {_q(quality.MENU_ITEM)}, '', 'g')) = ''
  OR length({_BARE}) - length(translate({_BARE}, {_q(_MARKS)}, '')) > length({_BARE}) * {quality.SYMBOL_SHARE}
  OR (len({_LINE_WORDS}) >= 4 AND len(list_filter({_LINE_WORDS}, lambda y: regexp_matches(y, '[!?.,*#%$&]{{2,}}$'))) * 2 > len({_LINE_WORDS}))
  OR (len({_LINE_WORDS}) >= 4 AND len(list_filter({_LINE_WORDS}, lambda y: regexp_matches(y, '^[|»›·•>/-]+$'))) * 4 > len({_LINE_WORDS}))
  OR contains(x, '{quality.SIGN}') OR regexp_matches(lower(x), {_q(quality.PHRASES)}))"""

_OP8 = rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, {_words("coalesce(text, '')", _GAP)} AS w FROM documents),
d AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE_CLASS}]')) AS l FROM a),
bad AS (SELECT doc_id, sum(length({_BARE})) AS lost FROM (SELECT doc_id, unnest(l) AS x FROM d) WHERE {_BAD} GROUP BY doc_id),
g AS (SELECT doc_id, s, w[s:s + 2] AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS s FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_rep FROM (
  SELECT doc_id, unnest([s, s + 1, s + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
n AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, {_q(quality.SYMBOLS)}, '')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN bad USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed FROM n)
SELECT *, NOT base_failed AND NOT (lost_chars > word_chars * {quality.MAX_LOST}) AS kept FROM b"""


def _kind(order: int, kind: str) -> str:
    pattern, group, least = secrets.RULES[kind]
    p = _q(pattern.replace(r"\x20", " "))
    return rf"""
SELECT doc_id, {order} AS o, {_q(kind)} AS kind, len0 + gap AS a, len0 + gap + length(m[i]) AS e, v[i] AS v FROM (
  SELECT doc_id, m, v, i, coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0) AS gap,
         coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS len0
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v, regexp_split_to_array(t, {p}) AS parts FROM d)))
WHERE length(v[i]) >= {least}"""


_OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_kind(n, k) for n, k in enumerate(secrets.RULES))}),
p AS (SELECT doc_id, o, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM s),
j AS (SELECT doc_id, string_agg(span, ',' ORDER BY a, o) AS spans, string_agg(span, ',' ORDER BY a, o) FILTER (o < 3) AS base,
             {', '.join(f"count(*) FILTER (o = {n}) AS n_{k}" for n, k in enumerate(secrets.BASE))} FROM p GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)"""

def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(strlen(CAST({value} AS VARCHAR)), ':', {value}) END"


def _leaf(n_chars: str) -> str:
    return f"sha256(concat({', '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))}))"


def _tree(name: str, leaves: str) -> str:
    """Every node of the trees over ``leaves`` (g, idx, h), and each tree's top."""
    return f"""
{name} AS (SELECT g, 0 AS level, idx, h FROM {leaves}
           UNION ALL
           SELECT g, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx))
           FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}) WHERE c > 1 GROUP BY g, level, idx // 2),
{name}_top AS (SELECT g, max(level) AS depth, arg_max(h, level) AS top FROM {name} GROUP BY g)"""


def _steps(leaves: str, tree: str) -> str:
    """(g, idx, level, sibling, step) of every leaf on every level below the top."""
    return f"""SELECT v.g, v.idx, v.level, s.h AS sibling,
       CASE WHEN s.h IS NULL THEN '-' WHEN (v.idx >> v.level) & 1 = 1 THEN concat('L', s.h) ELSE concat('R', s.h) END AS step
FROM (SELECT x.g, x.idx, unnest(range(t.depth)) AS level FROM {leaves} x JOIN {tree}_top t USING (g)) v
LEFT JOIN {tree} s ON s.g = v.g AND s.level = v.level AND s.idx = xor(v.idx >> v.level, 1::BIGINT)"""


# crc32 of the digits: a byte is mixed in (a number from 0 on), then eight shifts (-1)
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""

_OP12 = f"""
WITH RECURSIVE langs AS (SELECT lang AS of_lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
d AS (SELECT g, doc_id, {_leaf('n_chars')} AS h, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS claim
      FROM documents JOIN langs ON lang IS NOT DISTINCT FROM of_lang),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM d),
{_tree('node', 'leaves')},
tops AS (SELECT 0 AS g, g AS idx, top AS h FROM node_top),
{_tree('upper', 'tops')},
steps AS ({_steps('leaves', 'node')}
          UNION ALL
          SELECT l.g, l.idx, 100 + u.level, u.sibling, u.step FROM leaves l JOIN ({_steps('tops', 'upper')}) u ON u.idx = l.g),
ways AS (SELECT g, idx, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256, list(step ORDER BY level) AS way
         FROM steps GROUP BY g, idx),
folded AS (SELECT doc_id, h AS leaf, g, coalesce(proof_sha256, sha256('')) AS proof_sha256,
             list_reduce(list_prepend(coalesce(claim, h), coalesce(way, [])), lambda x, s:
               CASE s[1] WHEN 'L' THEN sha256(concat(s[2:], x)) WHEN 'R' THEN sha256(concat(x, s[2:])) ELSE sha256(x) END) AS folded_root
           FROM leaves LEFT JOIN ways USING (g, idx))
SELECT doc_id, leaf, node_top.top AS subroot, upper_top.top AS root, proof_sha256, folded_root, folded_root = upper_top.top AS verified
FROM folded JOIN node_top USING (g), upper_top
"""

_OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_low('text')}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
t AS (SELECT lang, {_words('piece', r'[\x20\x09]+')} AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM t GROUP BY lang),
f AS (SELECT lang, w[s:s + m - 1] AS w, m, count(*) AS f
      FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM t, (SELECT unnest([1, 2, 3, 4, 5]) AS m))
      GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, w, m, f, unnest(generate_series(1, m - 1)) AS k FROM f WHERE m > 1),
scored AS (SELECT c.lang, c.w, c.f AS a, c.k, x.f AS l, y.f AS r, n,
                  CAST((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.w = c.w[1:c.k] JOIN f y ON y.lang = c.lang AND y.w = c.w[c.k + 1:]
           JOIN total ON total.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
inner_phrases AS (SELECT lang, w[1:m - 1] AS w, f FROM f WHERE m > 2 UNION SELECT lang, w[2:], f FROM f WHERE m > 2),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_phrases i WHERE i.lang = b.lang AND i.w = b.w AND 100 * i.f >= 100 * b.a)),
named AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {"op4_decontaminate": _OP4, "op6_substring": _OP6, "op8_quality": _OP8, "op10_secrets": _OP10,
                           "op12_merkle": _OP12, "op13_collocations": _OP13}
