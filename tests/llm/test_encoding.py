"""Operators 1 and 2: against the tokenizers library, and round trips."""
import functools
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwork.llm import bpe, pieces, records

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "  ", "Hello, World's  tests don't 123 ½", "ŁÓDŹ straße Æon ÿİx", "a<|endoftext|>B <|startoftext|> c",
         "日本語 テキスト 😀 é ẞ", "x" * 3000, "aaaa" * 200, "tab\tline\n\nend ", "nbsp  x\x1c\x85y", "ab cd\nef.\nGh"]


@functools.cache
def _library(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


@functools.cache
def _encoder(kind, path):
    with open(path, encoding="utf-8") as f:
        return kind(f.read())


def test_automaton_equals_library():
    lib, encoder = _library(WORD), _encoder(bpe.WordEncoder, WORD)
    for t in TEXTS:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert encoder.encode(t) == want
        assert encoder.decode(want) == (lib.decode(want, skip_special_tokens=False) if want else "")


def test_every_latin_letter_equals_library():
    """Also those whose lower case lies beyond U+024F; the shorter way is left for those only."""
    lib, encoder = _library(WORD), _encoder(bpe.WordEncoder, WORD)
    beyond = "ƁƆƉƊƏƐƓƔƖƗƜƝƟƦƩƮƱƲƷȺȾɄɅ"
    assert [chr(c) for c in range(0xA1, 0x250) if not bpe.LATIN.fullmatch(chr(c))] == list(beyond)
    for t in ["President Əliyev", *(f"a{chr(c)}b x{chr(c)}" for c in range(0x250))]:
        want = lib.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t) == want
        assert encoder.decode(want) == lib.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_automaton_equals_library_on_any_text(text):
    assert _encoder(bpe.WordEncoder, WORD).encode(text) == _library(WORD).encode(text, add_special_tokens=False).ids


def test_arcs_are_exactly_the_greedy_pairs():
    """Brute force: a small merge list; all words of its alphabet."""
    import itertools

    merges = [("a", "b"), ("ab", "a"), ("b", "b"), ("a", "a"), ("aa", "b"), ("bb", "ab")]
    vocab = {s: i for i, s in enumerate(["a", "b", *(x + y for x, y in merges)])}
    auto = bpe.TokenAutomaton(vocab, merges)

    def greedy(word):
        parts = list(word)
        for x, y in merges:
            k = 0
            while k + 1 < len(parts):
                if parts[k] == x and parts[k + 1] == y:
                    parts[k:k + 2] = [x + y]
                k += 1
        return [vocab[p] for p in parts]

    for n in range(1, 9):
        for word in itertools.product("ab", repeat=n):
            assert auto.encode("".join(word), "") == greedy("".join(word))


def test_encode_decode_rows(spark, docs):
    lib = _library(WORD)
    df = docs([(i, t) for i, t in enumerate(TEXTS)] + [(0, ""), (None, "a b")], extra=True)
    rows = bpe.encode_decode(df, WORD).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens_"]) == (ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        text = lib.decode(ids, skip_special_tokens=False) if ids else ""
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(docs([]), WORD).count() == 0


def test_pieces_equal_library():
    enc, lib = _encoder(pieces.PieceEncoder, BYTE), _library(BYTE)
    for t in TEXTS:
        want = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(enc.encode(t, 0), enc.width).tolist() == want


def test_pieces_of_many_texts_equal_library():
    """Texts cut together, also when the worker forgets in between."""
    import itertools

    enc, lib = _encoder(pieces.PieceEncoder, BYTE), _library(BYTE)
    texts = ["".join(t) for n in range(5) for t in itertools.product("s' \n1é", repeat=n)] + TEXTS
    got = enc.encode_some(texts, None)
    enc.known, enc.older = {}, {}
    assert enc.encode_some(texts[:50], None) + enc.encode_some(texts[50:], None) == got
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, enc.width).tolist() == lib.encode(t or "", add_special_tokens=False).ids
    period = "it's re-read,  twice\n"
    assert enc.encode(period * 250_000, None) == enc.encode(period, None) * 250_000      # 5 MB


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sé \n\t \x1c1.<|endoftext|>"), max_size=40))
def test_pieces_equal_library_on_any_text(text):
    got = _encoder(pieces.PieceEncoder, BYTE).encode(text, None)
    assert np.frombuffer(got, "<u2").tolist() == _library(BYTE).encode(text, add_special_tokens=False).ids


def test_files_round_trip(spark, docs, tmp_dir):
    lib = _library(BYTE)
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(6, "again"), (None, "no id")]
    records.write(docs(rows), tmp_dir, BYTE, file_text=500)
    index = records.write_index(spark, tmp_dir)
    got = records.read(spark, tmp_dir).orderBy("start").collect()
    want = [lib.encode(t or "", add_special_tokens=False).ids + [0] for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] != TEXTS[2]))]
    assert sorted(map(tuple, (r["ids"] for r in got))) == sorted(map(tuple, want))
    assert [r["doc_id"] for r in got] == [None, *sorted(i for i, _ in rows if i is not None)]
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    few = records.lookup(spark, tmp_dir, index.where("doc_id in (9, 12)")).collect()
    assert {r["doc_id"]: r["ids"] for r in few} == {r["doc_id"]: r["ids"] for r in got if r["doc_id"] in (9, 12)}


def test_no_rows_no_records(spark, docs, tmp_dir):
    records.write(docs([]), tmp_dir, BYTE)
    records.write_index(spark, tmp_dir)
    assert records.read(spark, tmp_dir).count() == 0


def test_damage_is_found():
    good = records.frame(b"12345678ab") + records.frame(b"x" * 9)
    assert [p for _, p in records.frames(good)] == [b"12345678ab", b"x" * 9]
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        if k not in (26, len(good) - 1):           # the closing bytes carry nothing
            with pytest.raises(ValueError):
                list(records.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(records.frames(good[:-7]))
    assert struct.unpack("<Q", good[:8])[0] == 10


def test_file_starts_go_by_part_number(spark):
    numbers = [0, 9, 10000, 10001, 99999, 100000, 100001, 1000000]
    index = spark.createDataFrame([(f"part-{n:05d}-0a1b-c000", 1) for n in numbers], "file string, n_tokens long")
    first = {r["file"]: r["first"] for r in records.file_starts(index).collect()}
    assert [first[f"part-{n:05d}-0a1b-c000"] for n in numbers] == list(range(len(numbers)))
