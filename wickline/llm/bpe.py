"""Byte-level BPE through a tokenization automaton.

Compiling: the automaton is deterministic and reads *tokens*. It starts as one state with an arc for every
byte, each leading back to it. Every merge ``u v -> w``, in rank order, adds one gadget (``Automaton.merge``):

* the target of the arcs ``u`` is split: they now lead to a copy of it that lacks the arc ``v``, so that the two no
  longer stand side by side;
* every state with the arc ``u`` gets the arc ``w``, which leads to where ``v`` led.

All arcs of one token lead to one state, so that a transition is a lookup of two tables: a bit per
kind of token and state (whether the state has the arc), and ``target``, a state per token. Each merge adds at most one
state. A merge whose halves never meet adds nothing. At the end the automaton accepts just the token
sequences that the merges produce.

Encoding: a pre-split word is read from the first state on, along arcs whose labels are its next bytes, longest labels first. The
accepted sequence that reaches a byte position is unique, so that a position from which no arc led on is never entered
again and the cost is linear in the word's length; nothing is merged and no priority queue is kept. Decoding emits the byte labels
of the arcs.

The tables are compiled once on the driver and broadcast (bounded: one vocabulary); a worker drops them, and its words, at the
end of a task.

Defined results: null text is encoded as the empty text (no ids, decoded to ''); texts of any length are encoded whole (words
over ``LONG_WORD`` characters are not remembered, nothing else differs); the special
tokens' strings in a text become their ids, as the vocabulary file asks; repeated rows give
repeated results, ids play no part; empty tables give empty results; other columns pass through,
and one with the made column's name is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wickline.llm.common import pieces

#: Pre-splitting of byte-level BPE (fixed values).
SPLIT = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 1 << 17  # of each of two generations
NEAR = 5  # bytes of a label that bound how long it can be
LONG_WORD = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_tables(path: str) -> dict:
    """Vocabulary, merges and special tokens from a tokenizer file (read by the driver)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
    alphabet = byte_alphabet()
    ids = model["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    label = {i: bytes(alphabet[c] for c in s) for s, i in ids.items() if s not in special}
    merges = []
    for m in model["merges"]:
        u, v = m.split(" ") if isinstance(m, str) else m
        merges.append((ids[u], ids[v], ids[u + v]))
    return {"label": label, "merges": merges, "special": special}


class Automaton:
    """States, arcs and targets of one vocabulary, compiled from its merges."""

    def __init__(self, tables: dict):
        label, merges = tables["label"], tables["merges"]
        single = [t for t, b in label.items() if len(b) == 1]
        tokens = 1 + max(label, default=0)
        #: a row of bits per token: which states have its arc
        self.arcs = np.zeros((tokens, 16), np.uint8)
        self.target = np.full(tokens, -1, np.int32)
        self.states = 1
        self.arcs[single, 0] = 1
        self.target[single] = 0
        self._users = [len(single) + 1]  # tokens that lead to a state; the start counts as one
        self._top = 1 + max(single, default=-1)  # no later token has an arc yet
        for u, v, w in merges:
            self.merge(u, v, w)

    def has(self, state: int, token: int) -> bool:
        """Whether the state has the arc."""
        return bool(self.arcs[token, state >> 3] >> (state & 7) & 1)

    def merge(self, u: int, v: int, w: int) -> None:
        """Add the gadget of one merge."""
        if self.target[w] >= 0:
            raise ValueError("a token is the product of two merges")
        if self.target[u] < 0 or self.target[v] < 0 or not self.has(behind := int(self.target[u]), v):
            return  # the halves never meet
        onward = int(self.target[v])  # before u is cut
        if self._users[behind] > 1 or onward == behind:  # split the target: a copy for u alone
            new = self.states
            self.states += 1
            if new >> 3 >= self.arcs.shape[1]:
                self.arcs = np.pad(self.arcs, ((0, 0), (0, self.arcs.shape[1] // 2)))
            column = self.arcs[: self._top, behind >> 3] >> (behind & 7) & 1
            self.arcs[: self._top, new >> 3] |= column << (new & 7)
            self._users[behind] -= 1
            self._users.append(1)
            self.target[u] = new
        cut = int(self.target[u])
        self.arcs[v, cut >> 3] &= ~(1 << (cut & 7)) & 255
        self.arcs[w] = self.arcs[u]  # every state that has the arc u gets the arc w
        self.target[w] = onward
        self._users[onward] += 1
        self._top = max(self._top, w + 1)

    def table(self) -> dict:
        """The transition table: the kind of each token, the bits of each kind of token, row after row of ``width`` bytes, and the targets.

        Tokens with arcs from the same states are one kind.
        """
        width = (self.states + 7) // 8
        rows = np.ascontiguousarray(self.arcs[:, :width]).view(f"V{width}").ravel()
        kinds, kind = np.unique(rows, return_inverse=True)
        return {"kinds": kinds.tobytes(), "kind": kind.tolist(), "width": width, "target": self.target.tolist()}


_COMPILED: dict[str, dict] = {}


def compiled(path: str) -> dict:
    """The compiled tables of a vocabulary file; the last one is kept on the driver."""
    if path not in _COMPILED:
        tables = load_tables(path)
        automaton = Automaton(tables)
        _COMPILED.clear()
        _COMPILED[path] = automaton.table() | {"label": tables["label"], "special": tables["special"]}
    return _COMPILED[path]


class Codec:
    """Encodes and decodes texts with compiled tables."""

    def __init__(self, tables: dict):
        self.kinds, self.width, self.target = tables["kinds"], tables["width"], tables["target"]
        self.special: dict[str, int] = tables["special"]
        #: of each label: its token and where its row of the transition table begins
        self.token = {b: (t, tables["kind"][t] * self.width) for t, b in tables["label"].items() if self.target[t] >= 0}
        self.reach: dict[bytes, int] = {}  # length of the longest label by its first ``NEAR`` bytes
        for label in self.token:
            if len(label) > self.reach.get(label[:NEAR], NEAR - 1):
                self.reach[label[:NEAR]] = len(label)
        self.label = labels(tables)
        self.words, self.older = {}, {}
        self.find = regex.compile(SPLIT).findall
        special = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, special))) if special else None

    def walk(self, word: bytes) -> list[int]:
        """The accepted token sequence of one pre-split word."""
        kinds, target, token, reach, n = self.kinds, self.target, self.token, self.reach, len(word)
        out: list[int] = []
        ends, states = [0], [0]
        dead: set[int] = set()
        stop = min(n, reach.get(word[:NEAR], NEAR - 1))
        while ends[-1] < n:
            at, state = ends[-1], states[-1]
            byte, bit = state >> 3, state & 7
            while stop > at:
                found = token.get(word[at:stop])
                if found is not None and kinds[found[1] + byte] >> bit & 1 and stop not in dead:
                    t = found[0]
                    out.append(t)
                    ends.append(stop)
                    states.append(target[t])
                    stop = min(n, stop + reach.get(word[stop : stop + NEAR], NEAR - 1))
                    break
                stop -= 1
            else:
                if not out:
                    raise ValueError("a byte is missing from the vocabulary")
                dead.add(at)
                out.pop()
                states.pop()
                stop = ends.pop() - 1
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word that the younger generation of remembered words lacks."""
        ids = self.older.get(word) or tuple(self.walk(word.encode("utf-8")))
        if len(word) <= LONG_WORD:
            if len(self.words) >= CACHE_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.find(text):
            out += self.words.get(word) or self._word(word)
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.marks is None or not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        return emit(self.label, ids)


def labels(tables: dict) -> dict[int, bytes]:
    """The bytes that each arc emits."""
    return tables["label"] | {i: s.encode() for s, i in tables["special"].items()}


def emit(label: dict[int, bytes], ids: list[int]) -> str:
    """The text of the arcs' labels; bytes that are no UTF-8 become replacement marks."""
    return b"".join(map(label.__getitem__, ids)).decode("utf-8", "replace")


def _lists(parts: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(list(chain.from_iterable(parts)), pa.int32()))


_IDS = T.ArrayType(T.IntegerType())


def _pass(df: DataFrame, column: str, shared, make, added: dict[str, T.DataType], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``added``, which ``make`` gives from ``column`` piece by piece, and without ``drop``."""
    df = df.drop(*added)
    at = df.columns.index(column)
    keep = [i for i, c in enumerate(df.columns) if c not in drop]
    names = [df.columns[i] for i in keep] + list(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make(shared.value)
        try:
            for b in batches:
                ranges = pieces(b.column(at)) if pa.types.is_string(b.column(at).type) else ((i, min(512, b.num_rows - i)) for i in range(0, b.num_rows, 512))
                for first, n in ranges:
                    part = b.slice(first, n)
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *apply(part.column(at))], names=names)
        finally:
            shared.__dict__.pop("_value", None)  # workers outlive tasks; the tables need not

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in keep), *(T.StructField(n, k) for n, k in added.items())]))


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text_col`` as ``array<int>``; ``vocabulary`` is a path on the driver."""

    def make(tables: dict):
        codec = Codec(tables)
        return lambda col: [_lists([codec.encode(t) for t in col.to_pylist()])]

    return _pass(df, text_col, df.sparkSession.sparkContext.broadcast(compiled(vocabulary)), make, {out: _IDS})


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that ``ids_col`` stands for; null ids decode to ''."""

    def make(label: dict):
        def apply(col: pa.Array) -> list[pa.Array]:
            flat, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_pylist()
            rows = ((a, b if ok else a) for a, b, ok in zip(ends, ends[1:], col.is_valid().to_pylist()))
            return [pa.array([emit(label, flat[a:b].tolist()) for a, b in rows], pa.string())]

        return apply

    tables = compiled(vocabulary)
    return _pass(df, ids_col, df.sparkSession.sparkContext.broadcast(labels(tables)), make, {out: T.StringType()})


def code(df: DataFrame, vocabulary: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded", drop_text: bool = False) -> DataFrame:
    """``df`` with the ids of ``text_col`` and the text that they decode to, in one pass."""

    def make(tables: dict):
        codec = Codec(tables)

        def apply(col: pa.Array) -> list[pa.Array]:
            found = [codec.encode(t) for t in col.to_pylist()]
            return [_lists(found), pa.array([codec.decode(x) for x in found], pa.string())]

        return apply

    shared = df.sparkSession.sparkContext.broadcast(compiled(vocabulary))
    return _pass(df, text_col, shared, make, {ids: _IDS, decoded: T.StringType()}, (text_col,) if drop_text else ())
