"""Operator 1: byte-pair encoding by a compiled token automaton.

The merge list is compiled into a deterministic automaton over *tokens*.  It
starts as one state that loops on every base symbol.  Each merge ``u v -> w``
adds one gadget: every arc labelled ``u`` is sent to a copy of its old target
that has lost the ``v`` arc, and wherever ``u v`` could be read an arc ``w``
leads to where ``v`` led.  After all merges the automaton accepts exactly the
token sequences that greedy merging produces, one per string.

All ``u`` arcs always share one target, so the target is stored per token; a
state is a token and the number of its gadgets when the state was made, and an
arc is refused if a gadget on the way up removed it.  Answers are kept in a
transition table, filled as words need them.

A pre-split word is encoded by following arcs over its symbols: a token that
begins where the path stands continues it exactly if the automaton has that
arc.  Each prefix has one accepted reading, so no position is entered twice.
Decoding emits the labels of the arcs.

Null text is empty; an empty text has no tokens and decodes to the empty
string; repeated rows are encoded each on its own; a very long text is encoded
word by word in its row; other columns pass through under their names (a clash
gets an underscore).  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, ship

# words remembered by a worker (and as many older ones), and the longest of them
MEMORY = 300_000
LONG_WORD = 80


# Fixed value: the splitter's pattern, for which the shorter way below is right.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def letters(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


def stays(c: str) -> bool:
    """Whether the lower case of ``c`` has no letter beyond those of LATIN_WORDS."""
    return not any(x.isalpha() and ord(x) >= 0x250 for x in c.lower())


# Latin text, all of it in composed form and in lower case too: the pattern over these letters
LATIN = re.compile("[" + "".join(re.escape(c) for c in map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)]) if stays(c)) + "]*")
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters('L')}]+|[{letters('N')}]|[^\\s{letters('L')}{letters('N')}]+")


def _byte_letters() -> list[str]:
    """The letter for each byte: itself if visible in Latin-1, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


BYTE_LETTERS = _byte_letters()


def byte_level(word: str) -> str:
    return word if word.isascii() and word.isprintable() else "".join([BYTE_LETTERS[b] for b in word.encode()])


class TokenAutomaton:
    """Arcs over tokens, built from base symbols and an ordered merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        n = max(vocab.values()) + 1
        self.label = [""] * n
        for s, i in vocab.items():
            self.label[i] = s
        self.left = [-1] * n                  # u of the merge that made the token
        self.made = [0] * n                   # when that was, 0 for base symbols
        self.above = [(-1, 0)] * n            # state that the token's own first state copies
        self.removed: list[dict[int, int] | None] = [None] * n   # v -> position of its gadget
        self.born: list[list[int] | None] = [None] * n           # time of each gadget
        self.dead: set[int] = set()           # merges whose parts never meet
        for k, (a, b) in enumerate(merges, 1):
            self._gadget(vocab[a], vocab[b], vocab[a + b], k)
        # spelling -> token, -1 for what only begins one
        self.step = {s[:k]: -1 for s in vocab for k in range(1, len(s))}
        self.step.update((s, i) for s, i in vocab.items() if i not in self.dead)
        self.table: dict[int, bool] = {}
        self.size = n

    def _gadget(self, u: int, v: int, w: int, k: int) -> None:
        if self.removed[u] is None:
            self.removed[u], self.born[u] = {}, []
        if w in self.dead or not self._arc(u, len(self.born[u]), v):
            self.dead.add(w)                   # ``u v`` is never read, so no arc is
            return
        # w leads where v leads now; later gadgets on v give v a new target, not w
        self.left[w], self.made[w] = u, k
        self.above[w] = (v, len(self.born[v] or ()))
        self.removed[u].setdefault(v, len(self.born[u]))
        self.born[u].append(k)

    def arc(self, last: int, token: int) -> bool:
        """Whether the state after ``last`` has an arc ``token``."""
        key = last * self.size + token
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 4 * MEMORY:
                self.table.clear()
            known = self.table[key] = self._arc(last, len(self.born[last] or ()), token)
        return known

    def _arc(self, state: int, gadgets: int, token: int) -> bool:
        """The state is ``state`` with its first ``gadgets`` gadgets.  With none
        it is the state that the token's merge ended in.  An arc that came
        after the state was made is there if that of its first part is; an
        older one if no gadget since has removed it."""
        while state >= 0:
            if not gadgets:
                state, gadgets = self.above[state]
                continue
            born, time = self.born[state], self.made[token]
            if time >= born[gadgets - 1]:
                token = self.left[token]
                continue
            at = self.removed[state].get(token)
            if at is not None and at < gadgets:
                return False
            gadgets = bisect_right(born, time, 0, gadgets)
        return True

    def _tokens_at(self, symbols: str, i: int, end: str) -> list[tuple[int, int]]:
        """Tokens that begin at ``i`` and where they end, shortest first."""
        found, n, step = [], len(symbols), self.step
        for j in range(i + 1, n):
            token = step.get(symbols[i:j])
            if token is None:
                return found
            if token >= 0:
                found.append((j, token))
        token = step.get(symbols[i:] + end, -1)
        if token >= 0:
            found.append((n, token))
        return found

    def encode(self, symbols: str, end: str) -> list[int]:
        """Tokens of one pre-split word; ``end`` marks its last symbol.

        Follows arcs from the start, longest label first.  A prefix has only
        one accepted reading, so a position is entered once at most."""
        n, arc, out, entered = len(symbols), self.arc, [], {0}
        open_at = [self._tokens_at(symbols, 0, end)]
        while open_at:
            if not open_at[-1]:
                open_at.pop()
                if out:
                    out.pop()
                continue
            j, token = open_at[-1].pop()
            if j in entered or (out and not arc(out[-1], token)):
                continue
            out.append(token)
            if j == n:
                return out
            entered.add(j)
            open_at.append(self._tokens_at(symbols, j, end))
        return out


class WordEncoder:
    """Texts to ids and back for a word-end BPE file of the tokenizers library
    (its normaliser and splitter are used as they are; merging is ours)."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        conf = json.loads(spec)
        model = conf["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        lib = Tokenizer.from_str(spec)
        self.normal, self.split = lib.normalizer, lib.pre_tokenizer
        self.end = model.get("end_of_word_suffix") or ""
        self.automaton = TokenAutomaton(vocab, pairs)
        self.special = {t["content"]: t["id"] for t in conf.get("added_tokens", [])}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.label = [""] * top
        for s, i in [*vocab.items(), *self.special.items()]:
            self.label[i] = s
        self.decimal = [str(i) for i in range(top)]
        self.latin = self._latin_is_enough(conf)
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _latin_is_enough(conf: dict) -> bool:
        """Whether the file has the normaliser and pattern that LATIN_WORDS is for."""
        kinds = [n.get("type") for n in (conf.get("normalizer") or {}).get("normalizers", [])]
        parts = (conf.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (kinds == ["NFC", "Replace", "Lowercase"] and len(parts) == 2
                and parts[0].get("pattern", {}).get("Regex") == WORD_PATTERN
                and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space"))

    def _unseen(self, word: str, spelling: str | None) -> tuple[int, ...]:
        """Remembers what it encodes: words of late, and those before them."""
        ids = self.older.get(word)
        if ids is None:
            ids = tuple(self.automaton.encode(spelling or byte_level(word), self.end))
        if len(word) <= LONG_WORD:
            if len(self.words) >= MEMORY:
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        """A text without special tokens."""
        out: list[int] = []
        if self.latin and LATIN.fullmatch(text):
            for word in LATIN_WORDS.findall(text.lower()):
                out += self.words.get(word) or self._unseen(word, None)
            return out
        text = self.normal.normalize_str(text) if self.normal is not None else text
        for spelling, (a, b) in self.split.pre_tokenize_str(text):
            out += self.words.get(text[a:b]) or self._unseen(text[a:b], spelling)
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.special_at or "<|" not in text:
            return self._plain(text)
        out: list[int] = []
        for part in self.special_at.split(text):
            out += [self.special[part]] if part in self.special else self._plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Arc labels, joined by a space as the file's decoder-less library does."""
        label = self.label
        return " ".join([label[i] for i in ids])


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(spec: str) -> WordEncoder:
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(spec)
    return _ENCODERS[key]


def encode_decode(docs: DataFrame, tokenizer_file: str, text: str = "text",
                  keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """``keep`` columns (default: all) with ``n_tokens``, ``ids_sha256`` (of the
    decimal ids joined by a space), ``decoded_sha256`` and, if asked, ``ids``.

    The tokenizer file is read on the driver and sent once (a vocabulary does
    not grow with the data); each worker compiles the automaton once."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    keep = docs.columns if keep is None else keep
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
           T.StructField("decoded_sha256", T.StringType())]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    taken = list(keep)
    for f in new:
        f.name = fresh(taken, f.name)
        taken.append(f.name)
    kept = [f for c in keep for f in docs.schema.fields if f.name == c]
    at = fresh(keep, "_text")

    def run(batches):
        enc = _encoder(spec.value)
        dec = enc.decimal
        for batch in batches:
            n, h, g, lists = [], [], [], []
            for t in batch.column(at):
                i = enc.encode(t.as_py())
                n.append(len(i))
                h.append(hashlib.sha256(" ".join([dec[k] for k in i]).encode()).hexdigest())
                g.append(hashlib.sha256(enc.decode(i).encode()).hexdigest())
                if ids:
                    lists.append(pa.array(i, pa.int32()))
            cols = [batch.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(g, pa.string())]
            if ids:
                offsets = [0]
                for x in n:
                    offsets.append(offsets[-1] + x)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(lists) if lists else pa.array([], pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=taken)

    sent = docs.select(*[docs[c] for c in keep], docs[text].alias(at))
    return sent.mapInArrow(run, T.StructType(kept + new))
