"""Toxicity by two class-conditional Kneser-Ney models over words.

Each class has an interpolated model of its own. With ``k(w)`` the distinct left neighbours of a word in the
class's labelled texts, ``c(h, w)`` the distinct left neighbours of a word pair (so that copies of a text add
nothing) and ``d`` the discounts,

* ``P(w | h) = (c(h, w) - d(h, w)) / c(h) + gamma(h) * P(w)``, ``gamma(h)`` the discounted share of ``c(h)``,
* ``P(w) = (k(w) - d(w)) / t + lambda * S(w)``, ``lambda`` the discounted share of ``t``,
* ``S(w) = (n(w) + 1) / (N + V + 1)``: shared backoff counts, the occurrences of every word in the whole corpus,
  with one place for all unseen words. It is the same distribution for both classes.

A history that a class lacks hands everything to ``P(w)``. All three distributions sum to one. The discount is ``DISCOUNT``
(at most the count) where the classes differ beyond chance (likelihood ratio of ``MIN_G2`` or more, and a
factor of ``MIN_RATIO``), and the whole count elsewhere: such expressions, the rare ones above all, are smoothed through
the shared counts. (With one discount for all, chance differences of thousands of words drown the few that matter.)

Both log-likelihoods are taken relative to ``S`` (the factor that they share, so that words without counts of their own
need no lookup), divided by the number of words and subtracted; a logistic curve fitted on
labelled rows that were not counted turns the difference into a score.

Labels are used from rows with crc32(id) mod 3 other than 1: remainder 0 for counts, 2 for the
curve, and at most ``MAX_DOCS`` documents of each class and remainder (smallest hashes of the id).
The shared counts, and the scores, cover all documents and whole texts.

Defined results: null and empty texts and texts without words have difference 0 and get the curve's
value there; a text of any length is scored whole; repeated rows get equal scores, and of rows that share a
labelled id one counts (the smallest hash of its text); documents labelled both ways count as toxic; labels and documents with null ids are never paired; without labels
of both classes every score is the labelled share of toxic rows (0 without labels); an empty table gives an empty
result; other columns pass through ``score``, one named like the score is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickline.llm.common import cut, fresh_path, unused

MAX_DOCS = 4000
DISCOUNT = 0.75
MIN_G2 = 16.0
MIN_RATIO = 2.0
THRESHOLD = 0.7
START = "\n"
FLUSH = 1 << 17
FILES = 4  # of frames that the labelled sample bounds

_find = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> list[str]:
    return _find((text or "").lower())


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3 (null for a null id)."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_docs: int) -> tuple[DataFrame, dict]:
    """Labelled texts ``y``, ``fold``, ``text`` (bounded) and the number of labels by (fold, y)."""
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).filter("id is not null and y in (0, 1)")
    known = known.select("id", "y", fold(F.col("id")).cast("int").alias("fold")).filter("fold <> 1")
    totals = {(r["fold"], r["y"]): r["n"] for r in known.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for f, y in sorted(totals):
        part = known.filter((F.col("fold") == f) & (F.col("y") == y)).orderBy(F.xxhash64("id"), "id").limit(max_docs)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        chosen = known.limit(0)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    once = texts.join(F.broadcast(chosen), "id").groupBy("id", "y", "fold").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return cut(once.select("y", "fold", "x.text"), FILES), totals  # at most 4 * max_docs rows


def _trigrams(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = [START, START, *words(t)]
                yield pa.RecordBatch.from_arrays([pa.array([y] * (len(w) - 2), pa.int32()), pa.array(w[:-2], pa.string()), pa.array(w[1:-1], pa.string()), pa.array(w[2:], pa.string())], names=["y", "g", "h", "w"])

    return sample.select("y", "text").mapInArrow(run, "y int, g string, h string, w string").distinct()


def _g2(k1: Column, k0: Column, share: Column) -> Column:
    """Likelihood ratio of counts whose expected toxic share is ``share``."""
    n = k1 + k0
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
    return 2 * (part(k1, n * share) + part(k0, n * (1 - share)))


def shared_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``w`` and ``n``: the occurrences of every word of the corpus, as a written table that grows with it."""

    def out(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(words(t.as_py()))
                if len(seen) >= FLUSH:
                    yield out(seen)
                    seen.clear()
        yield out(seen)

    found = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "w string, n long")
    path = fresh_path(docs.sparkSession, "word-counts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found.groupBy("w").agg(F.sum("n").alias("n")).coalesce(max(4, parts // 4)).write.parquet(path)  # a vocabulary is a small part of a corpus
    return docs.sparkSession.read.schema("w string, n long").parquet(path)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS) -> dict:
    """The model. For class y (index 0: toxic, 1: ordinary): ``lam``, the share handed to the shared counts; ``one[w]``, what ``P(w)``
    has beyond ``lam * S(w)``; ``gam[h]``; ``two[h, w]``, what ``P(w | h)`` has beyond ``gam[h] * P(w)``; ``S`` of the words
    that occur there; the curve ``a``, ``b``.

    What comes to the driver is bounded by the labelled sample: expressions whose classes differ, and the shared
    counts of their words.
    """
    sample, totals = _sample(docs, labels, id_col, text_col, label_col, max_docs)
    n1, n0 = (sum(n for (_, y), n in totals.items() if y == k) for k in (1, 0))
    flat = {"lam": (1.0, 1.0), "one": {}, "gam": {}, "two": {}, "S": {}, "a": None, "b": 0.0, "rate": n1 / (n1 + n0) if n1 + n0 else 0.0}
    if not (n1 and n0):
        return flat
    tri = _trigrams(sample.filter("fold = 0"))
    both = lambda: [F.sum(F.when(F.col("y") == k, 1).otherwise(0)).cast("double").alias(f"k{k}") for k in (1, 0)]
    pairs = cut(tri.groupBy("h", "w").agg(*both()), FILES)
    one = pairs.groupBy("w").agg(*[F.sum((F.col(f"k{k}") > 0).cast("double")).alias(f"k{k}") for k in (1, 0)])
    sums = one.agg(*[F.sum(f"k{k}").alias(f"t{k}") for k in (1, 0)]).first()
    if not (sums["t1"] and sums["t0"]):
        return flat
    total = (sums["t1"], sums["t0"])
    share = total[0] / (total[0] + total[1])
    k1, k0 = F.col("k1"), F.col("k0")
    odds = ((k1 + 0.5) / (total[0] + 0.5)) / ((k0 + 0.5) / (total[1] + 0.5))
    strong = (odds >= MIN_RATIO) | (odds <= 1 / MIN_RATIO)
    own = {r["w"]: (r["k1"], r["k0"]) for r in one.filter((_g2(k1, k0, F.lit(share)) >= MIN_G2) & strong).collect()}
    beyond = {w: tuple(max(k[i] - DISCOUNT, 0.0) / total[i] for i in (0, 1)) for w, k in own.items()}
    lam = tuple(1.0 - sum(p[i] for p in beyond.values()) for i in (0, 1))
    # word pairs that differ from what their word already says
    spark = docs.sparkSession
    corpus = shared_counts(docs, text_col)
    size = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("types")).first()
    listed = lambda found: F.broadcast(spark.createDataFrame([(w,) for w in found], "w string"))
    shared = {r["w"]: r["n"] for r in corpus.join(listed(beyond), "w").collect()}
    back = lambda w: (shared.get(w, 0) + 1) / (size["n"] + size["types"] + 1)
    low = {w: tuple(p[i] + lam[i] * back(w) for i in (0, 1)) for w, p in beyond.items()}
    says = spark.createDataFrame([(w, float(p[0]), float(p[1])) for w, p in low.items()], "w string, p1 double, p0 double")
    known = pairs.join(F.broadcast(says), "w", "left")  # bounded by the labelled sample
    expected = F.coalesce(F.col("p1") * total[0] / (F.col("p1") * total[0] + F.col("p0") * total[1]), F.lit(share))
    ratio = ((k1 + 0.5) / (k0 + 0.5)) / (expected / (1 - expected))
    mine = known.filter((_g2(k1, k0, expected) >= MIN_G2) & ((ratio >= MIN_RATIO) | (ratio <= 1 / MIN_RATIO)))
    by_h = pairs.groupBy("h").agg(F.sum("k1").alias("c1"), F.sum("k0").alias("c0"))
    two, gam = {}, {}
    for r in mine.join(by_h, "h").select("h", "w", "k1", "k0", "c1", "c0").collect():
        p = tuple(max(k - DISCOUNT, 0.0) / c if c else 0.0 for k, c in ((r["k1"], r["c1"]), (r["k0"], r["c0"])))
        two[r["h"], r["w"]] = p
        g = gam.get(r["h"], (1.0, 1.0))
        gam[r["h"]] = (g[0] - p[0], g[1] - p[1])
    shared |= {r["w"]: r["n"] for r in corpus.join(listed({w for _, w in two} - set(shared)), "w").collect()}
    model = flat | {"lam": lam, "one": beyond, "gam": gam, "two": two, "S": {w: back(w) for w in {*beyond, *(w for _, w in two)}}}
    # the curve, on labelled rows that were not counted
    if not (totals.get((2, 1)) and totals.get((2, 0))):
        return flat
    seen = _values(sample.filter("fold = 2").select("y", "text"), model, "text", "value").select("y", "value").collect()  # at most 2 * max_docs
    y = np.array([r["y"] for r in seen], float)
    x = np.array([r["value"] for r in seen])
    weight = np.where(y == 1, totals[2, 1] / max((y == 1).sum(), 1), totals[2, 0] / max((y == 0).sum(), 1))
    a, b = _curve(x, y, weight)
    return model | {"a": a, "b": b}


def relative(model: dict, h: str, w: str) -> tuple[float, float]:
    """``P(w | h) / S(w)`` of both classes."""
    s = model["S"].get(w)
    low, gam, own = model["one"].get(w), model["gam"].get(h), model["two"].get((h, w))
    p = [(low[i] / s if low else 0.0) + model["lam"][i] for i in (0, 1)]
    if gam:
        p = [gam[i] * p[i] + (own[i] / s if own else 0.0) for i in (0, 1)]
    return p[0], p[1]


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression in one variable by damped Newton steps; the slope is not negative."""
    scale = float(np.abs(x).mean()) or 1.0
    X = np.c_[np.ones(len(x)), x / scale]
    beta = np.zeros(2)
    ridge = np.diag([1e-6, 1e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        step = np.linalg.solve((X * (weight * p * (1 - p))[:, None]).T @ X + ridge + 1e-9 * np.eye(2), X.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), max(float(beta[1]), 0.0) / scale


def log_likelihoods(model: dict, found: list[str], known: dict) -> tuple[float, float]:
    """Both log-likelihoods of a text's words, relative to the shared counts. ``known`` keeps what was looked up."""
    plain = known.get(None)
    if plain is None:
        plain = known[None] = tuple(map(math.log, model["lam"]))
        known["watch"] = frozenset(model["one"]) | {w for _, w in model["two"]}
    watch, gam = known["watch"], model["gam"]
    toxic = ordinary = 0.0
    n = len(found)
    if not (watch.isdisjoint(found) and gam.keys().isdisjoint(found) and START not in gam):
        h = START
        for w in found:
            if w in watch or h in gam:
                p = known.get((h if h in gam else None, w))
                if p is None:
                    if len(known) >= FLUSH:
                        known.clear()
                        known[None], known["watch"] = plain, watch
                    p = known[h if h in gam else None, w] = tuple(map(math.log, relative(model, h, w)))
                toxic += p[0]
                ordinary += p[1]
                n -= 1
            h = w
    return toxic + n * plain[0], ordinary + n * plain[1]


def _values(df: DataFrame, model: dict, text_col: str, name: str) -> DataFrame:
    """``df`` with ``name``: the difference of the log-likelihoods per word."""
    held = df.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, known = held.value, {}
        for b in batches:
            out = []
            for t in b.column(at):
                w = words(t.as_py())
                toxic, ordinary = log_likelihoods(mine, w, known)
                out.append((toxic - ordinary) / len(w) if w else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score from 0 to 1."""
    docs = docs.drop(out)
    if model["a"] is None:
        return docs.withColumn(out, F.lit(float(model["rate"])))
    (value,) = unused(docs, "value")
    z = F.lit(model["a"]) + F.lit(model["b"]) * F.col(value)
    return _values(docs, model, text_col, value).withColumn(out, 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).drop(value)
