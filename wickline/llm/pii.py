"""Personal data: exact patterns, and a linear-chain conditional random field that adds spans.

The patterns find e-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone
numbers. The random field adds spans of forms that no plain pattern has (phone numbers without
``+``, spelled-out addresses, tokens and keys behind words such as ``token =``). Its features are word shapes at
five offsets and the gap before a word; it is trained by gradient ascent on the exact
log-likelihood (forward-backward) over a small labelled table made from fixed templates,
and decoded by Viterbi over padded numpy batches.

One factor of the field is fixed, in training and decoding alike: a token more than ``REACH`` tokens away from every
token that is not a plain word, full stop or comma has the tag O. As a tag that is fixed makes what is before
it and what is behind it independent, a line's best tags are those of its stretches around such tokens, each decoded by
itself between the O's beside it; lines of plain words only are O. Nothing is cut: a stretch is as long as it is, and its tags equal
those of the whole line decoded at once. Added spans never overlap a span of the patterns.

Defined results: null text counts as empty and has no span; a text or line of any length is decoded whole; offsets are code
points with an exclusive end; repeated rows have equal spans, ids play no part; an empty table gives an empty result; other columns pass through,
one named like the made column is replaced.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickline.llm.common import pieces

KINDS = ("email", "ip", "card", "phone", "secret")
RESCALE = 1024
BATCH_TOKENS = 1 << 15

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by kind as listed and start."""
    out: list[tuple[str, int, int]] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---------------------------------------------------------------- word shapes

TAGS = ("O", "B-email", "I-email", "B-phone", "I-phone", "B-secret", "I-secret")
MARKS = "@.,()-+=\"':/|#"
KEYWORDS = frozenset(("token", "key", "secret", "password", "passwd", "apikey"))
SHAPES = ("edge", "lower", "capital", "upper", "d1", "d2", "d3", "d4", "d5", "d9", "mixed", "code", "word-at", "word-dot", "word-key", "other", *MARKS)
SHAPE_ID = {s: i for i, s in enumerate(SHAPES)}
REACH = 8
OFFSETS = (-2, -1, 0, 1, 2)
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: Shapes of plain words, full stops and commas.
PLAIN = tuple(SHAPE_ID[s] for s in ("edge", "lower", "capital", "upper", ".", ",", "word-at", "word-dot", "word-key"))
#: Every token of another shape has such a character: a mark, a digit or another number sign (or any sign from U+09F4 on).
_SPECIAL = re.compile(r"[^\w\s.,]|[\d_\u00b2\u00b3\u00b9\u00bc-\u00be]|[\u09f4-\U0010ffff]")


def shape(token: str) -> int:
    if len(token) == 1 and token in MARKS:
        return SHAPE_ID[token]
    if token.isalpha():
        low = token.lower()
        name = "word-key" if low in KEYWORDS else "word-at" if low == "at" else "word-dot" if low == "dot" else "lower" if token.islower() else "upper" if token.isupper() else "capital"
    elif token.isdecimal():
        n = len(token)
        name = f"d{n}" if n < 5 else "d5" if n < 9 else "d9"
    elif token.isalnum():
        name = "code" if len(token) >= 16 else "mixed"
    else:
        name = "other"
    return SHAPE_ID[name]


class _Shapes(dict):
    def __missing__(self, token: str) -> int:
        s = shape(token)
        if len(token) <= 24:
            if len(self) >= 1 << 16:
                self.clear()
            self[token] = s
        return s


def training_table(n: int = 240, seed: int = 7) -> list[list[tuple[str, str]]]:
    """The labelled table: lines as (text piece, kind or '') from fixed templates."""
    r = random.Random(seed)
    stems = "the of and er en de la ie un ou re st ge ver ción que pa thon her lich au ment tion el los ne".split()
    word = lambda: "".join(r.choice(stems) for _ in range(r.randint(1, 3)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    code = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((20, 32, 40)))) + "a1"

    def prose() -> str:
        out = [word() + r.choice(("", "", "", ",", ".", "!!", " |", " at", " dot", " key", " token")) for _ in range(r.randint(1, 6))]
        out[0] = out[0].capitalize()
        return " ".join(out) + " "

    forms = {
        "email": lambda: r.choice((f"{word()}.{digits(2)}@{word()}.example.com", f"{word()} (at) {word()} (dot) com", f"{word()}@{word()}.org")),
        "phone": lambda: r.choice((f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}")),
        "secret": code,
    }
    harmless = (
        lambda: digits(16), lambda: f"{digits(2)}.{digits(3)}.{digits(2)}.{digits(3)}", lambda: digits(4), lambda: f"{digits(1)}.{digits(1)}",
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"({digits(4)})", lambda: f"{word()} = {digits(3)}", lambda: f'"{word()} {word()}"', lambda: f"{word()} | {word()} | {word()}",
        lambda: f"{word()}### {word()}%%% {word()}&&& {word()}***", lambda: f"{digits(3)}-{digits(2)}", lambda: f"({word()}) {word()}", lambda: f"{digits(16)} {digits(16)}", lambda: f"({digits(2)}) {word()}",
        lambda: f"token {word()}", lambda: f"{word()} at {word()} dot {word()}", lambda: f"{word()}, {digits(2)}%", lambda: f"{word()}: {word()}; {word()}", lambda: f"https://www.{word()}.com/{word()}/{digits(3)}",
    )
    rows = []
    for i in range(n):
        row = [(prose(), "")] if i % 4 else []  # spans may open a line
        for _ in range(r.randint(0 if i % 4 else 1, 3)):
            kind = r.choice(("email", "phone", "secret", "", ""))
            if kind == "secret":
                row += [(r.choice(('token = "', 'key: "', "password=", 'secret = "')), ""), (code(), kind), (r.choice(('"', '" ', '",', '"###', ' ')), "")]
            elif kind:
                row += [(forms[kind](), kind), (r.choice((" ", ", ", ". ", " | ")), "")]
            else:
                row += [(r.choice(harmless)(), ""), (" ", "")]
            row.append((prose() if r.random() < 0.85 else "", ""))  # and close it
        rows.append(row)
    return rows


def _tokens(line: str) -> tuple[list[str], list[int], list[int]]:
    found = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(line)]
    return [t for t, _, _ in found], [a for _, a, _ in found], [b for _, _, b in found]


class Field:
    """Weights of the random field: shapes at offsets, the gap before a token, transitions."""

    def __init__(self, shapes: np.ndarray, gaps: np.ndarray, trans: np.ndarray):
        self.shapes, self.gaps, self.trans = shapes, gaps, trans

    def emissions(self, ids: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """(lines, length, tags) scores; ``ids`` may hold the two tokens around each stretch, else edges are put there."""
        n, length = gaps.shape
        wide = ids
        if ids.shape[1] == length:
            wide = np.zeros((n, length + 4), ids.dtype)
            wide[:, 2:-2] = ids
        out = self.gaps[gaps]
        for k, o in enumerate(OFFSETS):
            out = out + self.shapes[k][wide[:, 2 + o : 2 + o + length]]
        return out

    def viterbi(self, ids: np.ndarray, gaps: np.ndarray, lengths: np.ndarray, after: np.ndarray | None = None, before: np.ndarray | None = None) -> np.ndarray:
        """Best tags of a padded batch of stretches; ``after`` and ``before`` mark those that follow and precede an O of their line."""
        e = self.emissions(ids, gaps)
        n, length, tags = e.shape
        start = np.where([t.startswith("I-") for t in TAGS], -1e9, 0.0)[None]
        start = np.where(after[:, None], self.trans[:1], start) if after is not None else start
        back = np.zeros((n, length, tags), np.int8)
        best = e[:, 0] + start
        rows = np.arange(n)
        for i in range(1, length):
            step = best[:, :, None] + self.trans[None]
            back[:, i] = step.argmax(axis=1)
            new = step.max(axis=1) + e[:, i]
            best = np.where((i < lengths)[:, None], new, best)
            if i % RESCALE == 0:  # only differences between tags matter; keeps long lines exact
                best = best - best.max(axis=1, keepdims=True)
        if before is not None:
            best = best + np.where(before[:, None], self.trans[:, 0][None], 0.0)
        out = np.zeros((n, length), np.int8)
        tag = best.argmax(axis=1).astype(np.int8)
        for i in range(length - 1, -1, -1):
            inside = i < lengths
            out[:, i] = np.where(inside, tag, 0)
            tag = np.where(inside & (i > 0), back[rows, i, tag], tag)
        return out


def stretches(special: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Ranges of the ``n`` tokens of a line that are ``REACH`` tokens or fewer away from one at the positions ``special``."""
    if not len(special):
        return []
    cuts = np.flatnonzero(np.diff(special) > 2 * REACH + 1)
    first, last = special[np.concatenate([[0], cuts + 1])], special[np.concatenate([cuts, [len(special) - 1]])]
    return list(zip(np.maximum(first - REACH, 0).tolist(), np.minimum(last + REACH + 1, n).tolist()))


def _follows() -> np.ndarray:
    """Forbidden transitions: I-x follows B-x or I-x only."""
    return np.array([[-1e4 if b.startswith("I-") and a[2:] != b[2:] else 0.0 for b in TAGS] for a in TAGS])


def train(rows: list[list[tuple[str, str]]], rounds: int = 120, rate: float = 0.15, ridge: float = 0.002) -> Field:
    """Maximum likelihood by Adam on forward-backward gradients over the whole table."""
    lines = []
    for row in rows:
        text, spans, at = "", [], 0
        for piece, kind in row:
            if kind:
                spans.append((at, at + len(piece), kind))
            text += piece
            at += len(piece)
        toks, starts, ends = _tokens(text)
        tags = []
        for a, b in zip(starts, ends):
            hit = next((s for s in spans if a >= s[0] and b <= s[1]), None)
            tags.append(TAGS.index(("B-" if a == hit[0] else "I-") + hit[2]) if hit else 0)
        if toks:
            gaps = [0] + [int(starts[i] > ends[i - 1]) for i in range(1, len(toks))]
            lines.append(([shape(t) for t in toks], gaps, tags))
    n, length = len(lines), max(len(x[0]) for x in lines)
    ids, gaps, tags, lens = np.zeros((n, length), int), np.zeros((n, length), int), np.zeros((n, length), int), np.array([len(x[0]) for x in lines])
    for i, (a, g, t) in enumerate(lines):
        ids[i, : len(a)], gaps[i, : len(a)], tags[i, : len(a)] = a, g, t
    mask = np.arange(length)[None] < lens[:, None]
    wide = np.zeros((n, length + 4), int)
    wide[:, 2:-2] = ids
    outside = np.ones((n, length), bool)  # the fixed factor: O far from every token that is not plain
    for i in range(n):
        for lo, hi in stretches(np.flatnonzero(~np.isin(ids[i, : lens[i]], PLAIN)), lens[i]):
            outside[i, lo:hi] = False
    far = np.where(outside[:, :, None] & (np.arange(len(TAGS)) > 0), -1e4, 0.0)
    k, s, tn = len(OFFSETS), len(SHAPES), len(TAGS)
    w = [np.zeros((k, s, tn)), np.zeros((2, tn)), np.zeros((tn, tn))]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    gold = np.eye(tn)[tags] * mask[:, :, None]
    block = _follows()
    pairs = mask[:, 1:]
    gold_trans = np.einsum("nla,nlb->ab", gold[:, :-1] * pairs[:, :, None], gold[:, 1:])
    first = np.array([-1e4 if t.startswith("I-") else 0.0 for t in TAGS])
    for step in range(1, rounds + 1):
        field = Field(w[0], w[1], w[2] + block)
        e = field.emissions(ids, gaps) + far
        near = np.exp(e - e.max(axis=2, keepdims=True))
        step_on = np.exp(field.trans - field.trans.max())
        alpha, beta = np.empty((n, length, tn)), np.ones((n, length, tn))  # each scaled to sum to one
        now = near[:, 0] * np.exp(first)
        alpha[:, 0] = now / now.sum(axis=1, keepdims=True)
        for i in range(1, length):
            now = (alpha[:, i - 1] @ step_on) * near[:, i]
            alpha[:, i] = np.where(mask[:, i, None], now / now.sum(axis=1, keepdims=True), alpha[:, i - 1])
        for i in range(length - 2, -1, -1):
            now = (near[:, i + 1] * beta[:, i + 1]) @ step_on.T
            beta[:, i] = np.where(mask[:, i + 1, None], now / now.sum(axis=1, keepdims=True), 1.0)
        marg = alpha * beta
        marg *= mask[:, :, None] / marg.sum(axis=2, keepdims=True)
        ahead = near[:, 1:] * beta[:, 1:]
        ahead *= pairs[:, :, None] / ((alpha[:, :-1] @ step_on) * ahead).sum(axis=2, keepdims=True)
        both = step_on * (alpha[:, :-1].reshape(-1, tn).T @ ahead.reshape(-1, tn))
        diff = gold - marg
        grad = [np.zeros_like(w[0]), np.zeros_like(w[1]), gold_trans - both]
        for j, o in enumerate(OFFSETS):
            np.add.at(grad[0][j], wide[:, 2 + o : 2 + o + length].ravel(), diff.reshape(-1, tn))
        np.add.at(grad[1], gaps.ravel(), diff.reshape(-1, tn))
        for j in range(3):
            g = grad[j] / n - ridge * w[j]
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.99 * v[j] + 0.01 * g * g
            w[j] = w[j] + rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-6)
    return Field(w[0].astype(np.float32), w[1].astype(np.float32), (w[2] + block).astype(np.float32))


@cache
def default_field() -> Field:
    """The field of the default labelled table, trained once per driver."""
    return train(training_table())


class Finder:
    """Spans of texts with one trained field."""

    def __init__(self, field: Field):
        self.field = field
        self.shapes = _Shapes()
        self.plain = np.isin(np.arange(len(SHAPES)), PLAIN)

    def added(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Spans that the field finds in each text."""
        lines = []
        shapes = self.shapes.__getitem__
        for d, text in enumerate(texts):
            if not _SPECIAL.search(text):
                continue
            at = 0
            for line in text.split("\n"):
                if _SPECIAL.search(line):
                    toks, starts, ends = _tokens(line)
                    n = len(toks)
                    ids = np.zeros(n + 4, np.int16)
                    ids[2:-2] = list(map(shapes, toks))
                    for lo, hi in stretches(np.flatnonzero(~self.plain[ids[2:-2]]), n):
                        lines.append((d, at, ids[lo : hi + 4], starts[lo:hi], ends[max(lo - 1, 0) : hi], lo > 0, hi < n))
                at += len(line) + 1
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        lines.sort(key=lambda x: len(x[3]))
        at = 0
        while at < len(lines):
            stop = at + 1
            while stop < len(lines) and (stop + 1 - at) * len(lines[stop][3]) <= BATCH_TOKENS:
                stop += 1
            self._decode(lines[at:stop], out)
            at = stop
        return out

    def _decode(self, lines: list, out: list) -> None:
        lens = np.array([len(x[3]) for x in lines])
        ids, gaps = np.zeros((len(lines), lens[-1] + 4), np.int16), np.zeros((len(lines), lens[-1]), np.int8)
        for i, (_, _, own, starts, ends, after, _) in enumerate(lines):
            ids[i, : len(own)] = own
            first = 0 if after else 1  # a line's first token has no gap before it
            gaps[i, first : len(starts)] = np.array(starts[first:]) > np.array(ends[:-1])
        tags = self.field.viterbi(ids, gaps, lens, np.array([x[5] for x in lines]), np.array([x[6] for x in lines]))
        for i in np.flatnonzero(tags.any(axis=1)).tolist():
            d, at, _, starts, ends, after, _ = lines[i]
            ends = ends[1:] if after else ends
            kind, start, end = "", 0, 0
            for t, a, b in zip([*tags[i, : lens[i]].tolist(), 0], [*starts, 0], [*ends, 0]):
                name = TAGS[t]
                if kind and name != f"I-{kind}":
                    out[d].append((kind, at + start, at + end))
                    kind = ""
                if name.startswith("B-"):
                    kind, start = name[2:], a
                end = b

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
        """All spans (kind, start, end, whether of a pattern), by kind as listed and start."""
        rank = {k: i for i, k in enumerate(KINDS)}
        result = []
        for text, more in zip(texts, self.added(texts)):
            base = base_spans(text)
            taken = sorted((a, b) for _, a, b in base)
            firsts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
            free = lambda a, b: not (at := bisect_left(firsts, b)) or reach[at - 1] <= a  # noqa: B023, E731
            kept = [(*s, True) for s in base] + [(*s, False) for s in more if free(s[1], s[2])]
            result.append(sorted(kept, key=lambda s: (rank[s[0]], s[1], s[2])))
        return result


_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _pass(df: DataFrame, text_col: str, field: Field | None, names: list[str], schema: T.StructType, make) -> DataFrame:
    """``df`` with the columns that ``make`` gives for texts and their spans, piece by piece."""
    held = df.sparkSession.sparkContext.broadcast(field or default_field())  # a few thousand weights
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(held.value)
        for b in batches:
            for first, n in pieces(b.column(at), 256):
                part = b.slice(first, n)
                texts = part.column(at).to_pylist()
                yield pa.RecordBatch.from_arrays(make(part, texts, finder.spans([t or "" for t in texts])), names=names)

    return df.mapInArrow(run, schema)


def find(df: DataFrame, text_col: str = "text", out: str = "pii", field: Field | None = None) -> DataFrame:
    """``df`` with the array ``out`` of (kind, start, end, base)."""
    df = df.drop(out)
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))

    def make(part: pa.RecordBatch, texts: list, found: list) -> list:
        return [*part.columns, pa.array([[{"kind": k, "start": s, "end": e, "base": p} for k, s, e, p in x] for x in found], _KIND)]

    return _pass(df, text_col, field, [*df.columns, out], T.StructType([*df.schema.fields, T.StructField(out, kind)]), make)


def span_string(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))


def masked(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    """``text`` with every span replaced by its kind in angle brackets; of overlapping spans the first to start names them all."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in spans):
        if start >= at:
            out += (text[at:start], f"<{kind}>")
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(df: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``df`` with the spans of ``text_col`` masked; texts without spans, and null texts, stay."""
    at = df.columns.index(text_col)

    def make(part: pa.RecordBatch, texts: list, found: list) -> list:
        clean = pa.array([masked(t, x) for t, x in zip(texts, found)], part.schema.field(at).type)
        return [*part.columns[:at], clean, *part.columns[at + 1 :]]

    return _pass(df, text_col, field, df.columns, df.schema, make)
