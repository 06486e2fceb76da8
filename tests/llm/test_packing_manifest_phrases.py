"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, long texts and empty tables."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwork.llm import collocation, merkle, packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- packing --

def naive_assign(sizes, length):
    """The rule as it reads, sequence by sequence."""
    total = sum(sizes)
    rooms = [length] * (total // length) + [1 << k for k in range(20, -1, -1) if total % length >> k & 1]
    loads, out = [0] * len(rooms), []
    for i, size in enumerate(sizes):
        done = 0
        while done < size:
            fits = [s for s, room in enumerate(rooms) if room >= size - done]
            if not fits:
                fits = [s for s, room in enumerate(rooms) if room == max(rooms)]
            s = min(fits, key=lambda s: (loads[s], s))
            n = min(size - done, rooms[s])
            out.append((i, done, n, s))
            rooms[s] -= n
            loads[s] += 6 * packing.WIDTH * n + n * n
            done += n
    return out


def test_assignment_equals_the_rule():
    r = random.Random(5)
    for _ in range(60):
        sizes = sorted((r.choice([1, 1, 7, r.randrange(1, 64)]) for _ in range(r.randrange(0, 60))), reverse=True)
        assert packing.assign(sizes, 64) == naive_assign(sizes, 64)


def test_costs_are_balanced():
    """Sequences of one length differ in cost by less than the dearest piece costs beyond its tokens."""
    r = random.Random(1)
    sizes = sorted((r.randrange(1, 700) for _ in range(3000)), reverse=True)
    load = collections.Counter()
    for _, _, n, s in packing.assign(sizes, 1024):
        load[s] += packing.cost(n)
    whole = [load[s] for s in range(sum(sizes) // 1024)]
    assert max(whole) - min(whole) < 700 * 700


def check_pieces(rows, texts, end=0, length=1024):
    lib = Tokenizer.from_file(BYTE)
    lib.no_padding()
    lib.no_truncation()
    want = collections.Counter((i, tuple(lib.encode(t or "", add_special_tokens=False).ids + [end])) for i, t in texts)
    sequences = collections.defaultdict(list)
    by_doc = collections.defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        sequences[r["sequence_id"]].append(r)
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        n = sum(r["length"] for r in own)
        assert n <= length and n & (n - 1) == 0               # nothing is padded: 1024, or a power of two
    found = collections.Counter()
    for (doc, n), own in by_doc.items():                       # repeated documents share id and length here
        times = sum(c for (i, ids), c in want.items() if i == doc and len(ids) == n)
        own.sort(key=lambda r: r["start"])
        for _ in range(times):
            ids, at = [], 0
            while at < n:
                r = next(r for r in own if r["start"] == at)
                own.remove(r)
                ids += r["ids"]
                at += r["length"]
            found[doc, tuple(ids)] += 1
        assert not own
    assert found == want


@pytest.mark.parametrize("block_sequences", [1024, 3])
def test_packing_keeps_every_id_once(spark, docs, block_sequences):
    r = random.Random(2)
    texts = [(i, " ".join(r.choice(["tree", "Haus", "été", "x1"]) for _ in range(r.randrange(900)))) for i in range(40)]
    texts += [(100, None), (101, ""), (None, "no id"), (None, "none either, longer"), (102, "word " * 5000)]
    rows = packing.pack(docs(texts, extra=True), BYTE, block_sequences=block_sequences).collect()
    check_pieces(rows, texts)


def test_packing_of_repeated_rows_and_no_rows(spark, docs):
    same = [(7, "same text " * 30)] * 25
    check_pieces(packing.pack(docs(same), BYTE).collect(), same)
    assert packing.pack(docs([]), BYTE).count() == 0
    assert packing.pack(docs([(1, "a")]), BYTE, ids=False).columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


# --------------------------------------------------------------- manifest --

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def naive_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 2])) for i in range(0, len(levels[-1]), 2)])
    proofs = []
    for i in range(len(leaves)):
        proofs.append([level[(i >> k) ^ 1] for k, level in enumerate(levels[:-1]) if (i >> k) ^ 1 < len(level)])
    return levels[-1][0], proofs


def test_witnesses_equal_the_whole_tree():
    for n in range(1, 70):
        leaves = [sha(str(i)) for i in range(n)]
        tree = merkle.WitnessTree()
        for x in leaves:
            tree.append(x)
        root, proofs = naive_tree(leaves)
        assert tree.close() == root
        for x, w, p in zip(leaves, tree.witness, proofs, strict=True):
            w = b"".join(w)
            assert merkle.fold(x, w) == root and [d for _, d in merkle.steps(w) if d] == p
    assert merkle.WitnessTree().close() is None


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest_equals_the_whole_tree(spark, levels):
    rows = [(g, i) for g, n in ((None, 1), ("a", 5), ("b", 17), ("é", 16), ("c", 9), ("d", 2)) for i in range(n)]
    rows += [("b", 3), ("b", None), ("b", None)]                            # a tie, and rows without id
    df = spark.createDataFrame(rows, "lang string, doc_id long").withColumn("leaf", F.lit("x"))
    claim = F.when(F.col("doc_id") == 4, F.lit(sha("other")))
    got = merkle.manifest(df, merkle.leaf([F.col("doc_id"), F.col("lang")]), "lang", "doc_id", claim, ["doc_id", "leaf"], levels).collect()

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    groups = collections.defaultdict(list)
    for g, i in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0)):
        groups[g].append(sha(field(i) + field(g)))
    trees = {g: naive_tree(x) for g, x in groups.items()}
    root, tops = naive_tree([t[0] for t in trees.values()])
    want = [(x, trees[g][0], root, sha("".join(p + top))) for (g, own), top in zip(groups.items(), tops, strict=True)
            for x, p in zip(own, trees[g][1], strict=True)]
    assert sorted((r["leaf_"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == sorted(want)
    for r in got:
        assert r["verified"] == (r["doc_id"] != 4) == (r["folded_root"] == root) and r["leaf"] == "x"


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([("a", 1)], "lang string, doc_id long")
    leaf = merkle.leaf([F.col("doc_id")])
    r = merkle.manifest(df, leaf, "lang", "doc_id").first()
    assert r["leaf"] == r["subroot"] == r["root"] == sha("1:1") and r["verified"] and r["proof_sha256"] == sha("")
    assert merkle.manifest(df.limit(0), leaf, "lang", "doc_id").count() == 0


# ---------------------------------------------------------------- phrases --

def naive_phrases(rows, least, longest, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            inside = (q for q in candidates if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))))
            if not any(100 * candidates[q] >= 100 * a for q in inside):
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def prose(spark):
    r = random.Random(3)
    words = ["the", "of", "A", "b", "é", "x1", "New", "york", "city", "--", " q", "n\x1cl\x00"]
    gaps = [" ", "  ", "\t", ". ", ", ", "\n", " ", " ", " "]
    rows = [("".join(r.choice(words) + r.choice(gaps) for _ in range(r.randrange(60))) if i % 17 else None,
             r.choice(["en", "en", "en", None, "de", "und", "en\x00"])) for i in range(400)]
    rows += [("new york city hall " * 40, "en")] * 3 + [("", "fr"), (None, None)]
    return rows, spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit(1)).repartition(7)


@pytest.mark.parametrize("range_windows, shard_chars", [(10 ** 9, 10 ** 9), (40, 2000), (300, 1)])
def test_phrases_equal_brute_force(prose, monkeypatch, range_windows, shard_chars):
    rows, df = prose
    monkeypatch.setattr(collocation, "RANGE_WINDOWS", range_windows)
    monkeypatch.setattr(collocation, "SHARD_CHARS", shard_chars)
    got = collocation.mine(df, least=8, top=50).collect()
    assert sorted(map(tuple, got)) == naive_phrases(rows, 8, 5, 50)


def test_a_filter_that_passes_all_changes_nothing(prose, monkeypatch):
    rows, df = prose
    monkeypatch.setattr(collocation, "filter_bitmap", lambda words: np.full(1 << (collocation.FILTER_BITS - 3), 255, np.uint8))
    assert sorted(map(tuple, collocation.mine(df, least=8, top=50).collect())) == naive_phrases(rows, 8, 5, 50)


def test_one_very_long_text(spark):
    rows = [("Deep sea. the deep sea, " * 200_000, "en")]                  # 5 MB
    df = spark.createDataFrame(rows, "text string, lang string")
    got = [tuple(r) for r in collocation.mine(df).collect()]
    assert got == [("en", 1, "deep sea", 400_000, 400_000, 400_000, 1_000_000, 2500),
                   ("en", 2, "the deep sea", 200_000, 200_000, 400_000, 1_000_000, 2500)]
    assert collocation.mine(df.limit(0)).count() == 0


def test_automata_unite_and_compose():
    r = random.Random(4)
    phrases = [" ".join(r.choice("abcd") for _ in range(r.randrange(1, 5))) for _ in range(300)]
    want = collections.Counter(phrases)
    parts = [collocation.CountAutomaton.from_phrases(phrases[k::3], [1] * len(phrases[k::3]), 4) for k in range(3)]
    packed = [a.pack(x, y) for a in parts for x, y in ((0, 11), (11, len(a.rows)))]
    whole = collocation.CountAutomaton.union(packed, 4)
    asked = [*want, "a b c d a", "e", "a e", "a"]
    assert whole.compose(asked) == [want[p] for p in asked]
    prefixes = collections.Counter(" ".join(p.split(" ")[:k]) for p in phrases for k in range(1, 5) if len(p.split(" ")) >= k)
    assert {whole.phrase(i, depth): w for first, depth, weight in whole.states() for i, w in zip(first, weight, strict=True)} == prefixes
