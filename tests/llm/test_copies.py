"""Operators 3, 4 and 6 against brute force."""
import collections
import hashlib
import random
import re

import numpy as np
import pytest

from siftwork.llm import decontam, simhash, substring

LOW = {c: c + 32 for c in range(65, 91)}


def _fp(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def _family(rng, n, copies):
    base = _words(rng, n)
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(n)] = "edit"
        yield " ".join(w)


def _check_components(rows, got):
    fps = [_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                links += fps[a] != fps[b]
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = collections.Counter((i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows))
    assert collections.Counter(got) == want
    return links


@pytest.mark.parametrize("leaf", [16_384, 2])
def test_simhash_components(spark, docs, leaf):
    rng = random.Random(5)
    rows = [(k, t) for k, t in enumerate([t for _ in range(6) for t in _family(rng, 400, 12)])]
    rows += [(900, None), (901, ""), (902, " \t"), (902, " \t"), (None, "one two"), (903, "One  TWO"), (None, "alone here now yes")]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in
           simhash.near_duplicates(docs(rows, extra=True), ["doc_id"], leaf_rows=leaf).collect()]
    assert _check_components(rows, got) > 0
    assert simhash.near_duplicates(docs([]), ["doc_id"]).count() == 0


def test_walk_equals_all_pairs():
    rng = np.random.default_rng(3)
    for errors in range(4):
        base = rng.integers(0, 1 << 63, 40, np.uint64)
        near = base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64))
        v = np.unique(np.concatenate([base, near, [0, 1, 3, 7]]).astype(np.uint64))
        x, y = simhash.walk(v, None, 0, 0, errors)
        want = {(a, b) for k, a in enumerate(v.tolist()) for b in v.tolist()[k + 1:] if (a ^ b).bit_count() <= errors}
        assert len(x) == len(want) and {(min(p), max(p)) for p in zip(x.tolist(), y.tolist())} == want


def test_survivors_keep_one_of_each_group(spark, docs):
    rng = random.Random(6)
    group = list(_family(rng, 400, 8))
    rows = [(k, t) for k, t in enumerate(group)] + [(50, group[0]), (50, group[0]), (60, "clean text here"), (None, group[1])]
    out = simhash.survivors(docs(rows, extra=True)).collect()
    comps = {c for *_, c in [(r["doc_id"], r["component"]) for r in simhash.near_duplicates(docs(rows), ["doc_id"]).collect()]}
    assert len(out) == len(comps) and 60 in {r["doc_id"] for r in out}
    assert "fp" in out[0].asDict() and 50 not in {r["doc_id"] for r in out}


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark, docs):
    rng = random.Random(7)
    items = [(1, " ".join(_words(rng, 30))), (2, "Short ITEM of five words"), (3, None), (4, "..."), (10, " ".join(_words(rng, 12))), (None, "no id item here")]
    items.append((11, items[0][1]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    inside = items[0][1].split()
    rows = [(0, "x, y! " + ", ".join(inside[3:16]) + " é z"), (1, " ".join(inside[:9])), (2, "a SHORT item-of five WORDS."), (3, None), (4, ""),
            (5, items[4][1] + " " + items[4][1]), (6, "no  id item here"), (2, "a SHORT item-of five WORDS."), (7, " ".join(_words(rng, 5000)) + " " + " ".join(inside))]
    win = collections.defaultdict(set)
    for i, t in items:
        w = WORDS.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 9)) if w else []:
            win[tuple(w[k:k + 10])] |= {str(i)} if i is not None else set()
    for block in (decontam.BLOCK_BYTES, 400):
        got = decontam.scan(docs(rows, extra=True), bench, block_bytes=block).collect()
        assert len(got) == len(rows)
        for r in got:
            t = (r["text"] or "").translate(LOW)
            places = [m.span() for m in WORDS.finditer(t)]
            w = [t[a:b] for a, b in places]
            hit, of = set(), set()
            for n in {len(k) for k in win}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k:k + n]) in win:
                        hit |= set(range(k, k + n))
                        of |= win[tuple(w[k:k + n])]
            h = r["hits_"]
            assert (h["n_words"], h["n_hit"], h["items"]) == (len(w), len(hit), sorted(of))
            covered = {k for k, (a, b) in enumerate(places) for s in h["spans"] if s["start"] <= a and b <= s["end"]}
            assert covered == hit
    assert decontam.scan(docs(rows), bench.limit(0)).where("hits.n_hit > 0").count() == 0
    assert decontam.scan(docs([]), bench).count() == 0


@pytest.mark.parametrize("batch", [substring.BATCH_TEXT, 400])
def test_repeated_passages(spark, docs, batch):
    rng = random.Random(8)
    passage = _words(rng, 60)
    rows = []
    for k in range(40):
        w = _words(rng, rng.randrange(0, 90))
        at = rng.randrange(len(w) + 1)
        a, n = rng.randrange(40), rng.randrange(5, 21)
        rows.append((k, " ".join(w[:at] + passage[a:a + n] + w[at:]).replace(" ", rng.choice([" ", "\n", "  "]))))
    rows += [(50, rows[3][1]), (50, rows[3][1]), (51, None), (52, ""), (None, rows[3][1]), (None, rows[3][1]), (53, "a " * 40), (54, "a " * 13)]
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    got = substring.remove_repeats(docs(rows, extra=True), batch_text=batch, kept_text=True)
    want = collections.Counter()
    for i, t in rows:
        w = (t or "").split()
        gone = set() if i is None else {x for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for x in range(k, k + 13)}
        stays = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(stays.encode()).hexdigest(), stays] += 1
    assert collections.Counter((r["doc_id"], r["n_words_"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in got.collect()) == want
    assert any(k[2] for k in want)
    assert substring.remove_repeats(docs([])).count() == 0
