"""Removal of repeated text units (paragraphs or lines) and passages by hashing.

Every unit is normalised (lower case, single spaces, no outer marks) and hashed to 128 bits. Digests are
grouped globally: a pre-aggregated minimum finds the earliest occurrence (smallest id, then smallest
offset) of each digest that occurs more than once, and is joined back to the occurrences; all but the
earliest are removed. Offsets are code points of the original text. No digest's occurrences ever meet in
one list, so that a unit that is everywhere is no hot group; the join back can be split. A paragraph is a run of lines with
something on them. Units without any word are no repetition and stay; ``min_words`` may ask for more words (default: one).

A repeated passage that starts or ends inside a unit is no unit of its own. Passages are
therefore also found by their own words, wherever they start: hashes of ``GRAM`` words are winnowed (the smallest
of every ``SPREAD`` in a row is taken), so that any two texts that share ``GRAM + SPREAD - 1`` = 50 words share a taken hash (of shorter
runs, from ``GRAM`` words on, those are found that happen to hold one). Taken
hashes are grouped globally like units; a text's first occurrence is set against the earliest one of all, a later one against that
before it in the same text; overlapping finds of one alignment are joined to one run, and the run is extended word by
word, up to ``SPREAD`` words at both ends. ``occurrences`` of a run inside one text are those in that text.
Rows of units and of passages may overlap.

Rows are told apart by id and text together. Defined results: null and empty texts have no unit; a row whose id is null is
ranked last; of rows with equal id and text, one counts and all are cut alike; rows that share an id but not the text are separate
occurrences, ranked by id and then by a hash of the text; texts of any length are read whole, in time linear in their length; an empty table
gives an empty result; other columns are ignored by ``repeats`` and pass through ``remove``,
one named ``removed`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickline.llm.common import fresh_path, pieces, unused

MIN_WORDS = 1
GRAM, SPREAD = 26, 25
FLUSH_WORDS = 100_000
UNITS = ("paragraph", "line")
_WORD = re.compile(r"\S+")
OUTER = " \t.,;:!?\"'()[]{}<>|-*#$%&"


def _spans(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines with something on them, or of their runs."""
    at, first, last = 0, None, 0
    for line in text.split("\n"):
        full = bool(line) and not line.isspace()
        if unit == "line":
            if full:
                yield at, at + len(line)
        elif full:
            first, last = at if first is None else first, at + len(line)
        elif first is not None:
            yield first, last
            first = None
        at += len(line) + 1
    if first is not None:
        yield first, last


def units(text: str, unit: str = "paragraph", min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit with enough words."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    out = []
    for start, end in _spans(text, unit):
        words = text[start:end].lower().split()
        bare = " ".join(words).strip(OUTER)
        if bare and len(words) >= min_words:
            out.append((start, end, xxhash.xxh3_128_digest(bare.encode("utf-8", "surrogatepass"))))
    return out


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``key`` (of id and text) and text ``t`` of every row."""
    return df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("t"))


def unit_table(rows: DataFrame, unit: str = "paragraph", min_words: int = MIN_WORDS) -> DataFrame:
    """``id``, ``key``, ``start``, ``end`` and the digest ``h1``, ``h2`` of every unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in pieces(b.column(2)):
                part = b.slice(first, n)
                found = [units(t or "", unit, min_words) for t in part.column(2).to_pylist()]
                flat = [u for x in found for u in x]
                own = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                h = np.frombuffer(b"".join(u[2] for u in flat), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(own), part.column(1).take(own), pa.array([u[0] for u in flat], pa.int32()), pa.array([u[1] for u in flat], pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
                    names=["id", "key", "start", "end", "h1", "h2"],
                )

    fields = [rows.schema["id"], rows.schema["key"], *(T.StructField(n, T.IntegerType()) for n in ("start", "end")), *(T.StructField(n, T.LongType()) for n in ("h1", "h2"))]
    return rows.mapInArrow(run, T.StructType(fields))


def _rank() -> Column:
    """The order of occurrences: by id, null ids last."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "key")


class _Words(dict):
    """64-bit hashes of words without case and outer marks; 0 for bare marks."""

    def __missing__(self, token: str) -> int:
        bare = token.lower().strip(OUTER)
        h = xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) | 1 if bare else 0
        if len(token) <= 24:
            if len(self) >= 1 << 18:
                self.clear()
            self[token] = h
        return h


def _grams(h: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of the ``GRAM`` words from each place on."""
    done, size, out, n = h, 1, None, 0
    for bit in bin(GRAM)[:1:-1]:
        if bit == "1":
            out = done if out is None else out[: len(h) - n - size + 1] * np.uint64(pow(base, size, 1 << 64)) + done[n : len(h) - size + 1]
            n += size
        if n < GRAM:
            done = done[:-size] * np.uint64(pow(base, size, 1 << 64)) + done[size:]
            size *= 2
    return out


def _slide(x: np.ndarray, best: np.ufunc) -> np.ndarray:
    """Best of every ``SPREAD`` values in a row."""
    size = 1
    while size * 2 <= SPREAD:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (SPREAD - size)], x[SPREAD - size :])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def winnow(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, h1, h2) of the taken hashes of texts that are given as hashes of their words, each of 50 words at least."""
    flat = np.concatenate(texts)
    lens = np.array([len(t) for t in texts])
    first = np.cumsum(lens) - lens
    h = _mix(_grams(flat, 0x9E3779B97F4A7C15))
    low = _slide(h, np.minimum)
    own = np.repeat(np.arange(len(texts)), lens)
    whole = own[: len(low)] == own[len(flat) - len(low) :]  # hash places of one text only
    low = np.where(whole, low, np.uint64(0))
    edge = np.zeros(SPREAD - 1, np.uint64)
    taken = np.flatnonzero((_slide(np.concatenate([edge, low, edge]), np.maximum) == h) & (h > 0))
    h2 = _mix(_grams(flat ^ (flat >> np.uint64(29)), 0xD1B54A32D192ED03)[taken])
    return own[taken], taken - first[own[taken]], h[taken].view(np.int64), h2.view(np.int64)


def _own_runs(text: str, h: np.ndarray, pos: np.ndarray, before: np.ndarray, n: np.ndarray, known: _Words) -> list[tuple[int, int, int, int]]:
    """(start, end, first_start, occurrences) of what repeats inside one text, from taken places and the places of the same hash before."""
    order = np.lexsort((pos, pos - before))
    pos, shift, n = pos[order], (pos - before)[order], n[order]
    cuts = np.flatnonzero((np.diff(shift) != 0) | (np.diff(pos) > GRAM)) + 1
    at = [(m.start(), m.end()) for m in _WORD.finditer(text) if known[m.group()]]
    out = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pos)]):
        lo, hi, s = int(pos[a]), int(pos[b - 1]) + GRAM, int(shift[a])
        least, most = max(lo - SPREAD, s), min(hi + SPREAD, len(h))
        while lo > least and h[lo - 1] == h[lo - 1 - s]:
            lo -= 1
        while hi < most and h[hi] == h[hi - s]:
            hi += 1
        out.append((at[lo][0], at[hi - 1][1], at[lo - s][0], int(n[a:b].min())))
    return out


def seed_table(df: DataFrame) -> DataFrame:
    """Of a table of ``id``, ``key`` and text ``t``: the first place ``pos`` of every taken hash ``h1``, ``h2`` in its text with its number ``n`` there,
    and, with null ``pos``, the runs ``start``, ``end``, ``first_start`` that repeat inside one text.

    A text that repeats itself over and over has one run this way, whatever the number of repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        names = ["id", "key", "pos", "h1", "h2", "n", "start", "end", "first_start"]

        def flush(b: pa.RecordBatch, rows: list[int], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            own, pos, h1, h2 = winnow(texts)
            if not len(own):
                return
            order = np.lexsort((pos, h2, h1, own))
            again = np.zeros(len(own), bool)
            again[1:] = (np.diff(own[order]) == 0) & (np.diff(h1[order]) == 0) & (np.diff(h2[order]) == 0)
            group = np.cumsum(~again) - 1
            n = np.bincount(group)[group]
            at = order[~again]
            ids = pa.array(np.array(rows)[own[at]])
            none = pa.nulls(len(at), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(ids), b.column(1).take(ids), pa.array(pos[at].astype(np.int32)), pa.array(h1[at]), pa.array(h2[at]), pa.array(n[~again].astype(np.int64)), none, none, none], names=names
            )
            late = np.flatnonzero(again)
            of, place, before, n = own[order[late]], pos[order[late]], pos[order[late - 1]], n[late]
            for i in np.unique(of).tolist():
                mine = of == i
                runs = _own_runs(b.column(2)[rows[i]].as_py(), texts[i], place[mine], before[mine], n[mine], known)
                ids = pa.array([rows[i]] * len(runs), pa.int64())
                none = pa.nulls(len(runs), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(ids), b.column(1).take(ids), none.cast(pa.int32()), none, none, pa.array([r[3] for r in runs], pa.int64()), *(pa.array([r[k] for r in runs], pa.int32()) for k in range(3))], names=names
                )

        for b in batches:
            rows, texts, n = [], [], 0
            for i, t in enumerate(b.column(2)):
                w = (t.as_py() or "").split()
                if len(w) < GRAM + SPREAD - 1:
                    continue
                h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
                h = h[h > 0]
                if len(h) >= GRAM + SPREAD - 1:
                    rows.append(i)
                    texts.append(h)
                    n += len(h)
                    if n >= FLUSH_WORDS:
                        yield from flush(b, rows, texts)
                        rows, texts, n = [], [], 0
            if rows:
                yield from flush(b, rows, texts)

    ints, longs = T.IntegerType(), T.LongType()
    kinds = [("pos", ints), ("h1", longs), ("h2", longs), ("n", longs), ("start", ints), ("end", ints), ("first_start", ints)]
    return df.mapInArrow(run, T.StructType([*(df.schema[n] for n in ("id", "key")), *(T.StructField(n, k) for n, k in kinds)]))


def _surroundings(df: DataFrame) -> DataFrame:
    """Where every wanted range of words ``lo`` to ``hi`` is in its text, and the text of ``SPREAD`` words on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        names = ["key", "lo", "hi", "start", "end", "left", "right"]
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                at = [(m.start(), m.end()) for m in _WORD.finditer(text) if known[m.group()]]
                wanted = [(w["lo"], w["hi"]) for w in b.column(2)[i].as_py()]
                here = [(at[lo][0], at[hi - 1][1]) for lo, hi in wanted]
                left = [text[at[max(lo - SPREAD, 0)][0] : s] for (lo, _), (s, _) in zip(wanted, here)]
                right = [text[e : at[min(hi + SPREAD, len(at)) - 1][1]] for (_, hi), (_, e) in zip(wanted, here)]
                row = pa.array([i] * len(wanted), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), *(pa.array([x[k] for x in both], pa.int32()) for both in (wanted, here) for k in (0, 1)), pa.array(left, pa.string()), pa.array(right, pa.string())],
                    names=names,
                )

    kinds = [*((n, T.IntegerType()) for n in ("lo", "hi", "start", "end")), ("left", T.StringType()), ("right", T.StringType())]
    return df.mapInArrow(run, T.StructType([df.schema["key"], *(T.StructField(n, k) for n, k in kinds)]))


def _reach(mine: str, other: str, back: bool) -> tuple[int, int]:
    """Characters of ``mine`` and of ``other`` that equal words take up from the inner edge on."""
    known = lambda s: [m for m in _WORD.finditer(s) if m.group().strip(OUTER)]
    a, b = known(mine), known(other)
    if back:
        a, b = a[::-1], b[::-1]
    n = 0
    while n < min(len(a), len(b)) and a[n].group().lower().strip(OUTER) == b[n].group().lower().strip(OUTER):
        n += 1
    if not n:
        return 0, 0
    return (len(mine) - a[n - 1].start(), len(other) - b[n - 1].start()) if back else (a[n - 1].end(), b[n - 1].end())


def _extend(df: DataFrame) -> DataFrame:
    """``start``, ``end`` and ``first_start`` moved out as far as the words around both places are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(n).to_pylist() for n in ("start", "end", "first_start", "left", "right", "first_left", "first_right")}
            before = [_reach(x, y, True) for x, y in zip(col["left"], col["first_left"])]
            after = [_reach(x, y, False) for x, y in zip(col["right"], col["first_right"])]
            moved = {
                "start": [s - x for s, (x, _) in zip(col["start"], before)],
                "end": [e + x for e, (x, _) in zip(col["end"], after)],
                "first_start": [s - x for s, (_, x) in zip(col["first_start"], before)],
            }
            yield pa.RecordBatch.from_arrays([pa.array(moved[n], pa.int32()) if n in moved else b.column(n) for n in names], names=names)

    names = ["id", "key", "start", "end", "first_id", "first_start", "occurrences"]
    return df.mapInArrow(run, T.StructType([df.schema[n] for n in names]))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _passages(rows: DataFrame) -> DataFrame:
    """``id``, ``key``, ``start``, ``end``, ``first_id``, ``first_start`` and ``occurrences`` of passages, wherever they start and end."""
    table = _written(seed_table(rows), "seeds")
    seeds = table.filter("pos is not null").select("id", "key", "pos", "h1", "h2", "n")
    first = seeds.groupBy("h1", "h2").agg(F.min(F.struct(_rank().alias("rank"), "pos")).alias("first"), F.sum("n").alias("occurrences"), F.count("*").alias("places")).filter("places > 1")
    first = first.select("h1", "h2", F.col("first.rank.id").alias("first_id"), F.col("first.rank.key").alias("first_key"), F.col("first.pos").alias("first_pos"), "occurrences")
    rest = seeds.drop("n").join(first, ["h1", "h2"]).filter("key <> first_key")
    rest = rest.select("id", "key", "pos", "first_id", "first_key", (F.col("pos") - F.col("first_pos")).alias("shift"), "occurrences")
    alike = ["key", "first_key", "shift"]
    line = Window.partitionBy(*alike).orderBy("pos")  # one text's finds of one alignment
    new = F.coalesce(F.col("pos") - F.lag("pos").over(line) > GRAM, F.lit(True)).cast("int")
    marked = rest.withColumn("__new", new).withColumn("__run", F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.first("id").alias("id"), F.first("first_id").alias("first_id"), F.min("pos").alias("lo"), (F.max("pos") + GRAM).alias("hi"), F.min("occurrences").alias("occurrences")]
    runs = _written(marked.groupBy(*alike, "__run").agg(*ends).drop("__run"), "runs")
    back = [(F.col(c) - F.col("shift")).alias(c) for c in ("lo", "hi")]
    ranges = runs.select("key", "lo", "hi").union(runs.select("first_key", *back))
    wanted = ranges.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("wanted"))
    once = rows.join(wanted, "key").dropDuplicates(["key"]).select("key", "t", "wanted")
    places = _written(_surroundings(once), "places")
    p, q = (places.select(*[F.col(c).alias(f"{side}{c}") for c in places.columns]) for side in ("p_", "q_"))
    own = (F.col("key") == F.col("p_key")) & (F.col("lo") == F.col("p_lo")) & (F.col("hi") == F.col("p_hi"))
    other = (F.col("first_key") == F.col("q_key")) & (F.col("lo") - F.col("shift") == F.col("q_lo")) & (F.col("hi") - F.col("shift") == F.col("q_hi"))
    both = runs.join(p, own).join(q, other).select(
        "id", "key", F.col("p_start").alias("start"), F.col("p_end").alias("end"), "first_id", F.col("q_start").alias("first_start"), "occurrences",
        F.col("p_left").alias("left"), F.col("p_right").alias("right"), F.col("q_left").alias("first_left"), F.col("q_right").alias("first_right"),
    )
    inside = table.filter("pos is null").select("id", "key", "start", "end", F.col("id").alias("first_id"), "first_start", F.col("n").alias("occurrences")).distinct()
    return _extend(both).unionByName(inside)


def _found(rows: DataFrame, unit: str, min_words: int) -> DataFrame:
    """Removed units and passages, with the key of their row."""
    table = _written(unit_table(rows, unit, min_words), "units")
    first = table.groupBy("h1", "h2").agg(F.min(F.struct(_rank().alias("rank"), "start")).alias("first"), F.count("*").alias("occurrences")).filter("occurrences > 1")
    first = first.select("h1", "h2", F.col("first.rank.id").alias("first_id"), F.col("first.rank.key").alias("first_key"), F.col("first.start").alias("first_start"), "occurrences")
    rest = table.join(first, ["h1", "h2"]).filter("key <> first_key or start <> first_start")
    return rest.select("id", "key", "start", "end", "first_id", "first_start", "occurrences").unionByName(_passages(rows))


def _named(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(F.col("id").alias(id_col), "start", "end", F.col("first_id").alias(f"first_{id_col}"), "first_start", "occurrences")


def passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``repeats`` for passages, wherever they start and end."""
    return _named(_passages(_rows(df, id_col, text_col)), id_col)


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "paragraph", min_words: int = MIN_WORDS) -> DataFrame:
    """``id_col``, ``start``, ``end`` of every removed unit and passage, with the place that is kept and the number of occurrences."""
    return _named(_found(_rows(df, id_col, text_col), unit, min_words), id_col)


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "paragraph", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with repeated units and passages cut out, and ``removed``: their original (start, end)."""
    df = df.drop("removed")
    own, found = unused(df, "own", "key")
    spans = _found(_rows(df, id_col, text_col), unit, min_words).groupBy(F.col("key").alias(found)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("removed"))
    keyed = df.withColumn(own, F.xxhash64(F.col(id_col), F.col(text_col).cast("string")))
    both = keyed.join(spans, F.col(own) == F.col(found), "left").drop(found, own)
    both = both.withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")))
    at, last = both.columns.index(text_col), both.columns.index("removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in pieces(b.column(at)):
                part = b.slice(first, n)
                left = []
                for text, cuts in zip(part.column(at).to_pylist(), part.column(last).to_pylist()):
                    kept, done = [], 0
                    for c in cuts:
                        kept.append(text[done : max(c["start"], done)])
                        done = max(done, c["end"])
                    left.append("".join([*kept, text[done:]]) if cuts else text)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(left, part.schema.field(at).type), *part.columns[at + 1 :]], names=part.schema.names)

    return both.mapInArrow(run, both.schema)
