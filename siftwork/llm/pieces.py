"""Whole texts to ids by the tokenizers library, each distinct piece once.

A Latin text without special tokens is cut into the pieces that the file's own
byte-level splitter would make, many texts at a time over arrays of character
classes; the library encodes each piece that a worker does not remember.  Any
other text, and any text for another splitter, is encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from .bpe import LATIN

MEMORY = 350_000          # pieces remembered by a worker, and as many older ones
LONG_PIECE = 80
TOGETHER = 50             # new pieces encoded as one text
CALL = 500                # texts encoded by one call: their results are large
CHARS = 2_000_000         # characters cut at once, but always whole texts

BETWEEN = "\0"            # stands between texts; no Latin text holds it
OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")    # fixed value


def _class(c: str) -> int:
    return EDGE if c == BETWEEN else SPACE if c.isspace() else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


CLASS = np.array([_class(chr(c)) for c in range(0x250)], np.uint8)


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Where the pieces begin in texts given as code points below U+0250, each
    followed by ``BETWEEN`` (a piece of its own).

    Runs of one class are pieces; a space before a run belongs to it; of other
    white space before a run the last character stands alone; a contraction at
    the begin of a run is cut off."""
    kind = CLASS[points]
    start = np.empty(len(kind), bool)
    start[:1] = True
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == EDGE)
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != EDGE))
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points == ord("'")) & start)
    after = np.concatenate([points, np.zeros(3, points.dtype)])
    for c in CONTRACTIONS:
        here = quote[np.all([after[quote + k] == ord(x) for k, x in enumerate(c)], axis=0)]
        start[here + 1] = False
        end = here + len(c)
        start[end[kind[end] == LETTER]] = True
    return np.flatnonzero(start)


class PieceEncoder:
    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # the task has one core
        from tokenizers import Tokenizer

        conf = json.loads(spec)
        self.lib = self._plain(Tokenizer.from_str(spec))
        self.width = "<u2" if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.kind = "H" if self.width == "<u2" else "I"
        before = conf.get("pre_tokenizer") or {}
        self.cut = (conf.get("normalizer") is None and before.get("type") == "ByteLevel"
                    and before.get("use_regex", True) and not before.get("add_prefix_space"))
        self.special = [t["content"] for t in conf.get("added_tokens", [])]
        # the same model over pieces, one a line: nothing is left to split
        conf["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.lines = self._plain(Tokenizer.from_str(json.dumps(conf)))
        # bytes that each token stands for; byte-level letters are one each
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for label, i in vocab.items():
            self.bytes_of[i] = len(label)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _plain(lib):
        lib.no_padding()
        lib.no_truncation()
        return lib

    def _ids(self, texts: list[str], lib=None) -> list[bytes]:
        out = []
        for k in range(0, len(texts), CALL):
            found = (lib or self.lib).encode_batch_fast(texts[k:k + CALL], add_special_tokens=False)
            out += [array(self.kind, f.ids).tobytes() for f in found]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Afterwards ``known`` holds all of ``pieces``, none of which it held."""
        if len(self.known) >= MEMORY:
            self.older, self.known = self.known, {}
        new = []
        for p in pieces:
            if p in self.older:
                self.known[p] = self.older[p]
            else:
                new.append(p)
        alone = [p for p in new if "\n" in p]
        self.known.update(zip(alone, self._ids(alone), strict=True))
        lines = [p for p in new if "\n" not in p]
        groups = [lines[k:k + TOGETHER] for k in range(0, len(lines), TOGETHER)]
        for group, packed in zip(groups, self._ids(["\n".join(g) for g in groups], self.lines), strict=True):
            self.known.update(zip(group, self._apart(group, packed), strict=True))

    def _apart(self, pieces: list[str], packed: bytes) -> list[bytes]:
        """The ids of each piece, out of those of all: the bytes that tokens stand for say where a piece ends."""
        ids = np.frombuffer(packed, self.width)
        ends = np.cumsum(self.bytes_of[ids])
        stop = np.cumsum([len(p.encode()) for p in pieces])
        last = np.searchsorted(ends, stop) + 1
        if last[-1] != len(ids) or not np.array_equal(ends[last - 1], stop):
            return self._ids(pieces)
        at = (last * ids.itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *at], at, strict=False)]

    def _latin(self, texts: list[str], end: int | None) -> list[bytes]:
        joined = BETWEEN.join(texts) + BETWEEN
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        starts = piece_starts(points)
        edges = np.flatnonzero(points[starts] == 0)
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80), out=at[1:])               # Latin: at most two bytes
        offsets = np.append(at[starts], at[-1])
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(joined.encode())).dictionary_encode()
        pieces, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        packed = list(map(self.known.get, pieces))
        missing = [p for p, x in zip(pieces, packed, strict=True) if x is None and p != BETWEEN]
        if missing:
            self._learn(missing)
        known, size = self.known, np.dtype(self.width).itemsize
        last = b"" if end is None else np.array([end], self.width).tobytes()
        packed = [last if p == BETWEEN else x or known[p] for p, x in zip(pieces, packed, strict=True)]
        for p in missing:
            if len(p) > LONG_PIECE:
                del known[p]
        pool = np.frombuffer(b"".join(packed), self.width)
        n = np.fromiter(map(len, packed), np.int64, len(packed)) // size
        count = n[which]
        done = np.cumsum(count)
        ids = pool[np.repeat((np.cumsum(n) - n)[which] - (done - count), count) + np.arange(done[-1])].tobytes()
        stop = (done[edges] * size).tolist()
        return [ids[a:b] for a, b in zip([0, *stop], stop, strict=False)]

    def encode_some(self, texts: Iterable[str | None], end: int | None) -> list[bytes]:
        """The ids of each text, packed, with ``end`` behind them."""
        texts = [t or "" for t in texts]
        out: list[bytes] = [b""] * len(texts)
        latin = [k for k, t in enumerate(texts) if self.cut and LATIN.fullmatch(t) and not any(s in t for s in self.special)]
        first, chars = 0, 0
        for i, k in enumerate(latin):
            chars += len(texts[k])
            if chars >= CHARS or i + 1 == len(latin):
                some = latin[first:i + 1]
                for j, x in zip(some, self._latin([texts[j] for j in some], end), strict=True):
                    out[j] = x
                first, chars = i + 1, 0
        whole = sorted(set(range(len(texts))).difference(latin))
        last = b"" if end is None else np.array([end], self.width).tobytes()
        for j, x in zip(whole, self._ids([texts[j] for j in whole]), strict=True):
            out[j] = x + last
        return out

    def encode(self, text: str | None, end: int | None) -> bytes:
        return self.encode_some([text], end)[0]


_ENCODERS: dict[int, PieceEncoder] = {}


def encoder(spec: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file's text; it keeps what it has learnt."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(spec)
    return _ENCODERS[key]
