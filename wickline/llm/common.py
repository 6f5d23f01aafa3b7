"""Shared helpers: table access, the shared checkpoint folder, hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


LINKS_PER_FILE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A corpus table, pruned to ``columns`` when any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session leaves it unset, a temporary folder is made and set if everything runs on
    this machine (tests); on a cluster that is an error, as executors could not reach such a folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="wickline-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, files: int = 0) -> DataFrame:
    """Cut lineage through reliable storage, so that a lost executor costs no recomputation.

    ``files`` bounds the files of a frame whose size is bounded; others have a file per partition.
    """
    shared_dir(df.sparkSession)
    return (df.coalesce(files) if files else df).checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that ``fresh_path`` named, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names made of ``names`` that ``df`` does not have."""
    out = []
    for name in names:
        name = f"__{name}"
        while name in df.columns:
            name = f"_{name}"
        out.append(name)
    return out


def row_key(id_col: str, text_col: str) -> Column:
    """A key of the row itself: its id together with 128 bits of its text.

    Rows share a key only if id and text are equal, so that null or repeated ids never
    join rows of different texts.
    """
    text = F.col(text_col).cast("string")
    return F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(7), text)))


def pieces(column: pa.Array, rows: int = 512, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges (first, number) of the rows of a string column that hold at most ``rows`` rows
    and, unless it is a single row, ``size`` bytes: bounded scratch space whatever the texts."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0]
    at = 0
    while at < len(column):
        stop = min(at + rows, len(column))
        stop = max(at + 1, min(stop, int(np.searchsorted(ends, ends[at] + size, "right")) - 1))
        yield at, stop - at
        at = stop


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
    ).select("e.u", "e.v")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges``: columns ``a`` and ``b`` (any one ordered type). Returns ``node`` and
    ``root`` (the smallest node that is reachable) for each node that has a link to another
    node. Every step is a grouped minimum joined back to the edges (never a window or a list
    per node), so that a hub of any degree is pre-aggregated and its join can be split.
    Links stay on the cluster; the driver sees one count and one checksum per round.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    files = e.count() // LINKS_PER_FILE + 1  # links only become fewer
    for _ in range(max_rounds):
        both = _both_ways(e)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = cut(small.filter("a <> b").distinct(), files)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
