"""SimHash near-duplicates found through tables of distances to reference fingerprints.

A fingerprint's distances to a fixed set of reference fingerprints (pivots) are computed
once per distinct fingerprint. By the triangle inequality two fingerprints within ``k`` bits
differ by at most ``k`` in every coordinate of that table, so a pair is discarded by its
largest coordinate difference and only the survivors are verified by an exact bit count.

How the pairs meet, without a cross join:

1. Equal fingerprints are one class (a pre-aggregated ``groupBy``); only classes go on.
2. Five bit blocks: three differing bits leave two blocks untouched, so that every linked pair
   shares one of ten two-block keys. Rows are dealt by that key and sorted by
   (key, distance to the first pivot): a sweep compares a row with its followers only while key
   and first coordinate allow it, then the other coordinates discard, then bits verify.
   Only links that join two parts are put out, at most one per row.
3. A key with more than ``bucket_cap`` fingerprints (near copies without end) is refined:
   six sub-blocks of its remaining bits, of which three are untouched (twenty sub-keys), are
   treated as in 2. What is still too large is linked exactly through wildcard groups: blanking
   each choice of three of the bits left free, equal remainders are within three bits, and
   a star to the group's minimum links them. Nothing is capped or sampled.

Components are computed over classes on the cluster.

Defined results: null text counts as empty; no word gives fingerprint 0, which links like any
other; a text of any length is read whole; equal rows fall into one class, null ids are linked like others but name a
component only if it has no other id; an empty table gives an empty result; other columns
are ignored by ``near_duplicates`` and pass through ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickline.llm.common import connected_components, cut, row_key, unused

MAX_BITS = 3
SHINGLE = 3
SEED = 42
BLOCKS = 5
SUB_BLOCKS = 6
BUCKET_CAP = 8192
FILES = 8  # of the lists of crowded keys: at most one key in ``BUCKET_CAP`` rows
N_PIVOTS = 16
MASK64 = (1 << 64) - 1


def _pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints: well-spread 64-bit words by a fixed rule."""
    return [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=SEED) for i in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ranges(bits: list[int], parts: int) -> list[list[int]]:
    """Bit positions split into ``parts`` runs of nearly equal length."""
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[cuts[i] : cuts[i + 1]] for i in range(parts)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _keys(bits: list[int], parts: int, spare: int = MAX_BITS) -> list[tuple[int, list[int]]]:
    """(mask of blocks that agree, positions left free) for each choice of agreeing blocks."""
    blocks = _ranges(bits, parts)
    out = []
    for chosen in combinations(range(parts), parts - spare):
        same = [b for i in chosen for b in blocks[i]]
        out.append((_mask(same), [b for b in bits if b not in same]))
    return out


LEVEL1 = _keys(list(range(64)), BLOCKS)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """SimHash of one text over its k-word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; white space \x20 \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        h = np.array([digest(line, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded scratch space for texts of any length
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``fp`` (the 64 bits as a signed long) in place of its text, for every row."""
    rest = [f for f in df.schema.fields if f.name not in (text_col, "fp")]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(len(names))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], names=[*names, "fp"])

    return df.select(*names, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, T.StructType([*rest, T.StructField("fp", T.LongType())]))


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fp`` with its distances to all pivots, eight to a long: ``t0``, ``t1``."""
    dist = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("long") for p in _pivots()]
    packed = []
    for at in (0, 8):
        word = dist[at]
        for i in range(1, 8):
            word = word.bitwiseOR(F.shiftleft(dist[at + i], 8 * i))
        packed.append(word)
    return fps.select("fp", packed[0].alias("t0"), packed[1].alias("t1"))


def _sweep(key: np.ndarray, fp: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among rows sorted by (key, first coordinate); at most one per row."""
    n = len(fp)
    parent = np.arange(n)

    def roots(x: np.ndarray) -> np.ndarray:
        up = parent[x]
        while True:
            more = parent[up]
            if (more == up).all():
                return up
            up = more

    out_a, out_b = [], []
    active = np.arange(n)
    step = 0
    first = table[:, 0]
    while len(active):
        step += 1
        active = active[active + step < n]
        j = active + step
        keep = (key[active] == key[j]) & (first[j] - first[active] <= max_bits)
        active = active[keep]
        i, j = active, active + step
        for c in range(1, table.shape[1]):  # largest coordinate difference
            if not len(i):
                break
            ok = np.abs(table[i, c] - table[j, c]) <= max_bits
            i, j = i[ok], j[ok]
        if not len(i):
            continue
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits  # survivors, verified
        i, j = i[ok], j[ok]
        apart = roots(i) != roots(j)
        for a, b in zip(i[apart].tolist(), j[apart].tolist()):
            x, y = a, b
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                out_a.append(a)
                out_b.append(b)
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def _link_buckets(rows: DataFrame, max_bits: int) -> DataFrame:
    """Links inside each key of ``rows`` (key, fp, t0, t1); a key holds a bounded number."""

    def emit(key, fp, t) -> pa.RecordBatch:
        i, j = _sweep(key, fp, t, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(b.column(c)) for c in range(4)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            tail = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on in the next batch
            held = [c[tail:] for c in cols]
            if tail:
                yield emit(*_unpack([c[:tail] for c in cols]))
        if held is not None:
            yield emit(*_unpack(held))

    dealt = rows.repartition(F.col("key")).sortWithinPartitions("key", F.col("t0").bitwiseAND(F.lit(255)))
    return dealt.mapInArrow(run, "a long, b long")


def _unpack(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, fp, t0, t1 = (np.ascontiguousarray(c) for c in cols)
    table = np.concatenate([t.view(np.uint8).reshape(len(t), 8) for t in (t0, t1)], axis=1).astype(np.int16)
    return key, fp.view(np.uint64), table


def _with_keys(classes: DataFrame) -> DataFrame:
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, (m, _) in enumerate(LEVEL1)]
    return classes.select("fp", "t0", "t1", F.posexplode(F.array(*keys)).alias("combo", "key"))


def _wildcards(rows: DataFrame, level2: list[list[list[int]]], max_bits: int) -> DataFrame:
    """Exact links of fingerprints that agree on all but a few known free bits, without pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.ascontiguousarray(np.asarray(b.column("fp"))).view(np.uint64)
            combo, sub = np.asarray(b.column("combo")), np.asarray(b.column("sub"))
            for c, s in sorted(set(zip(combo.tolist(), sub.tolist()))):
                own = fp[(combo == c) & (sub == s)]
                for chosen in combinations(level2[c][s], max_bits):
                    m = _mask(list(chosen))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), _signed(m), np.int64)), pa.array((own & np.uint64(MASK64 ^ m)).view(np.int64)), pa.array(own.view(np.int64))],
                        names=["mask", "rest", "fp"],
                    )

    spread = rows.select("fp", "combo", "sub").mapInArrow(run, "mask long, rest long, fp long")
    low = spread.groupBy("mask", "rest").agg(F.min("fp").alias("low"), F.count("*").alias("n")).filter("n > 1")
    return spread.join(low, ["mask", "rest"]).filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints whose transitive closure is that of all
    pairs within ``max_bits`` (at most three) bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    classes = cut(pivot_table(fps.select("fp").distinct()))
    rows = _with_keys(classes)
    big = cut(rows.groupBy("key").count().filter(F.col("count") > bucket_cap).select("key"), FILES)
    if big.isEmpty():
        return _link_buckets(rows.select("key", "fp", "t0", "t1"), max_bits)
    plain = rows.join(big, "key", "left_anti")
    links = _link_buckets(plain.select("key", "fp", "t0", "t1"), max_bits)
    level2 = [_keys(free, SUB_BLOCKS) for _, free in LEVEL1]
    subs = F.lit(None).cast("array<long>")
    for c, keys in enumerate(level2):
        subs = F.when(F.col("combo") == c, F.array(*[F.xxhash64("key", F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, (m, _) in enumerate(keys)])).otherwise(subs)
    finer = rows.join(big, "key", "left_semi").select("fp", "t0", "t1", "combo", F.posexplode(subs).alias("sub", "key"))
    still = cut(finer.groupBy("key").count().filter(F.col("count") > bucket_cap).select("key"), FILES)
    links = links.union(_link_buckets(finer.join(still, "key", "left_anti").select("key", "fp", "t0", "t1"), max_bits))
    if not still.isEmpty():
        links = links.union(_wildcards(finer.join(still, "key", "left_semi"), [[free for _, free in keys] for keys in level2], max_bits))
    return links


def _roots(fps: DataFrame, max_bits: int, bucket_cap: int) -> DataFrame:
    """``fp`` and ``root`` (the smallest fingerprint of its component) of every fingerprint."""
    classes = fps.select("fp").distinct()
    roots = connected_components(link_fingerprints(fps, max_bits, bucket_cap))
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """``id_col``, ``fp``, ``component_id`` (smallest id in the row's component) for every row."""
    fps = cut(fingerprints(df.select(id_col, text_col), text_col))
    named = fps.groupBy("fp").agg(F.min(id_col).alias("low")).join(_roots(fps, max_bits, bucket_cap), "fp")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = cut(named.join(lows, "root").select("fp", "component_id"))
    return fps.join(by_class, "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row with the smallest id.

    Rows without an id come last; of rows that share the id the one with the smallest key (of id and text) stays, of equal
    rows one. A row is dropped only if a row of its component stays, whatever ids it shares.
    """
    own, held, n = unused(df, "key", "stay", "n")
    keyed = df.withColumn(own, row_key(id_col, text_col))
    fps = cut(fingerprints(keyed.select(F.col(id_col).alias("id"), F.col(own).alias("key"), F.col(text_col).alias("text"))))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    per = fps.groupBy("fp").agg(F.min(order).alias("low"), F.count("*").alias("n"))
    chosen = per.join(_roots(fps, max_bits, bucket_cap), "fp").groupBy("root").agg(F.min("low").alias("low")).select("low.key")
    repeated = fps.groupBy("key").agg(F.count("*").alias("n"))  # equal rows
    stay = cut(chosen.join(repeated, "key").select(F.col("key").alias(held), F.col("n").alias(n)))
    marked = keyed.join(stay, F.col(own) == F.col(held)).drop(held)
    once = marked.filter(F.col(n) == 1).drop(n, own)
    more = marked.filter(F.col(n) > 1).dropDuplicates([own]).drop(n, own)
    return once.unionByName(more)
