"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Texts become sets of five-word shingles (lower-cased words without outer punctuation). An item of
``n`` shingles is contained in a document if the document has at least ``threshold * n`` of them.

* Items are partitioned by size (powers of two). An item's MinHash sketch is made of its smallest
  shingle hashes: as many as ``n - ceil(threshold * n) + 1``. A document that lacks all of these lacks
  too many shingles to contain the item, so that the sketch loses no pair, at any ratio of sizes
  (a sketch of the long document instead would nearly always miss a short item).
* A partition's bar is the largest hash in its items' sketches. A document's sketch for the partition
  is made of its hashes up to that bar (a fixed share of them, whatever its length), and only
  partitions whose smallest item could fit into it are asked.
* Sketch hashes that meet give candidate pairs; only a candidate's shingles are then counted against all
  shingles of its item.

Everything is DataFrame code. The index of sketches grows with the benchmark only; it is broadcast
behind a check of its size and joined by a shuffle beyond that, and so are the candidates' keys.

Rows are judged one by one, told apart by id and text together. Defined results: texts of fewer than five words, empty and null ones have no
shingle and neither contain nor are contained; a text of any length is read whole; items with equal texts are each reported; equal rows, and rows
that share an id (null ids too), are reported once per item, with the largest count; empty tables give empty results; other columns are ignored by
``matches`` and pass through ``remove``, which drops just the rows that contain an item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickline.llm.common import cut, row_key, unused

SHINGLE = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 100_000
FILES = 8  # of the benchmark's index
#: Words are runs of letters, marks and digits.
BETWEEN = "[^\\p{L}\\p{M}\\p{N}]+"


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, k: int = SHINGLE) -> Column:
    """Hashes of all k-word windows of an array of word hashes."""
    window = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), window))


def sketches(benchmark: DataFrame, item_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """A row per item: shingles ``hs``, ``n``, the ``need``, the size partition and the ``sketch``."""
    words = benchmark.select(F.col(item_col).alias("item"), word_hashes(F.col(text_col)).alias("w"))
    sets = words.select("item", F.sort_array(F.array_distinct(shingle_hashes(F.col("w"), k))).alias("hs")).filter("size(hs) > 0")
    need = F.greatest(F.ceil(F.lit(threshold) * F.size("hs") - 1e-9).cast("int"), F.lit(1))
    sized = sets.select("item", "hs", F.size("hs").alias("n"), need.alias("need"))
    return sized.select("*", F.floor(F.log2("n")).cast("int").alias("part"), F.slice("hs", F.lit(1), F.col("n") - F.col("need") + 1).alias("sketch"))


def _matches(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, k: int, threshold: float, broadcast_rows: int) -> DataFrame:
    """``id``, ``key``, ``item``, ``n`` and ``shared`` of all contained items; ``docs`` has ``id``, ``key`` and its text."""
    index = cut(sketches(benchmark, item_col, item_text_col, k, threshold), FILES)
    parts = index.groupBy("part").agg(F.max(F.element_at("sketch", -1)).alias("bar"), F.min("need").alias("least"), F.sum("n").alias("rows"))
    parts = parts.orderBy("least").collect()  # a row per power of two
    hint = F.broadcast if sum(p["rows"] for p in parts) <= broadcast_rows else (lambda df: df)
    own = docs.select("id", "key", F.col(text_col).alias("t"))

    shingled = lambda df: df.select("id", "key", word_hashes(F.col("t")).alias("w")).select("id", "key", F.size("w").alias("size"), shingle_hashes(F.col("w"), k).alias("hs"))
    # explode_outer: behind explode, a filter on the array's size would be pushed below the projections
    # and evaluate the words anew for every shingle; the joins drop the nulls
    bar = F.lit(None).cast("bigint")  # the highest bar among partitions with items that could fit
    for i, p in enumerate(parts):
        bar = F.when(F.col("size") - (k - 1) >= p["least"], F.lit(max(x["bar"] for x in parts[: i + 1]))).otherwise(bar)
    probes = shingled(own).select("id", "key", bar.alias("bar"), "hs").select("id", "key", F.explode_outer(F.filter("hs", lambda h: h <= F.col("bar"))).alias("h"))
    met = probes.join(hint(index.select("item", F.explode("sketch").alias("h"))), "h")
    pairs = cut(met.select("id", "key", "item").distinct())  # candidates

    whom = pairs.select("key").distinct()
    few = F.broadcast if pairs.count() <= broadcast_rows else (lambda df: df)
    exact = shingled(own.join(few(whom), "key", "left_semi")).select("key", F.explode_outer("hs").alias("h")).distinct()
    wanted = pairs.join(hint(index.select("item", "n", "need", F.explode("hs").alias("h"))), "item")
    shared = exact.join(wanted, ["key", "h"]).groupBy("id", "key", "item", "n", "need").agg(F.count("*").alias("shared"))
    return shared.filter("shared >= need").drop("need")


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    k: int = SHINGLE, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``id_col``, ``item_col``, ``shared``, ``n_shingles``, ``containment`` of all contained items."""
    keyed = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col))
    found = _matches(keyed, benchmark, text_col, item_col, item_text_col, k, threshold, broadcast_rows)
    best = found.groupBy("id", "item").agg(F.max("shared").alias("shared"), F.max("n").alias("n"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "shared", F.col("n").cast("long").alias("n_shingles"), (F.col("shared") / F.col("n")).alias("containment"))


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, whatever their ids."""
    own, gone = unused(docs, "key", "bad")
    keyed = docs.withColumn(own, row_key(id_col, text_col))
    found = _matches(keyed.select(F.col(id_col).alias("id"), F.col(own).alias("key"), F.col(text_col)), benchmark, text_col, item_col, item_text_col, k, threshold, broadcast_rows)
    bad = cut(found.select(F.col("key").alias(gone)).distinct())
    few = F.broadcast if bad.count() <= broadcast_rows else (lambda df: df)
    return keyed.join(few(bad), F.col(own) == F.col(gone), "left_anti").drop(own)
