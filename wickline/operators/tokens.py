"""Token operators: binary spherical quantisation, bit packing, logits filters, entropy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def l2_normalise(v: Column) -> Column:
    """Unit vector; the norm is evaluated once."""
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x / n)), 1)


def quantise(v: Column, dim: int) -> Column:
    """Sign of each entry over the root of the dimension (0 counts as negative)."""
    scale = 1 / math.sqrt(dim)
    return F.transform(v, lambda x: F.when(x > 0, F.lit(scale)).otherwise(F.lit(-scale)))


def bits_to_index(v: Column) -> Column:
    """Bit i is set where entry i is not negative; the first entry is the lowest bit (at most 63 bits)."""
    bits = F.transform(v, lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def index_to_vector(index: Column, bits: int, dim: int | None = None) -> Column:
    """The signs of an index of ``bits`` bits over the root of ``dim`` (default: the bits)."""
    scale = 1 / math.sqrt(dim or bits)
    at = lambda i: F.call_function("shiftright", index.cast("long"), i).bitwiseAND(F.lit(1).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(at(i) == 1, F.lit(scale)).otherwise(F.lit(-scale)))


def half_indexes(v: Column, low_bits: int, dim: int) -> tuple[Column, Column]:
    """Indexes of the first ``low_bits`` entries and of the rest of a quantised vector."""
    return bits_to_index(F.slice(v, F.lit(1), F.lit(low_bits))), bits_to_index(F.slice(v, F.lit(low_bits + 1), F.lit(dim - low_bits)))


def halves_to_vector(first: Column, rest: Column, low_bits: int, dim: int) -> Column:
    """The quantised vector of two half indexes."""
    return F.concat(index_to_vector(first, low_bits, dim), index_to_vector(rest, dim - low_bits, dim))


def codes_to_index(codes: Column, width: int) -> Column:
    """One index of the codes of equal groups of ``width`` bits, the first group highest."""
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: F.call_function("shiftleft", a, F.lit(width)).bitwiseOR(x.cast("long")))


def index_to_codes(index: Column, groups: int, width: int) -> Column:
    """The codes of equal groups of an index, the first group highest."""
    mask = F.lit((1 << width) - 1).cast("long")
    return F.transform(F.sequence(F.lit(groups - 1), F.lit(0), F.lit(-1)), lambda g: F.call_function("shiftright", index.cast("long"), g * width).bitwiseAND(mask))


def sinusoid(position: Column, dim: int, base: float = 10000.0) -> Column:
    """Fixed time embedding: sine at even, cosine at odd places, of falling frequency."""
    rate = lambda i: F.exp((i - i % 2).cast("double") * F.lit(-math.log(base) / dim)) * position
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i % 2 == 0, F.sin(rate(i))).otherwise(F.cos(rate(i))))


def add_vectors(*vectors: Column) -> Column:
    """Entry by entry sum of arrays of one length."""
    total = vectors[0]
    for v in vectors[1:]:
        total = F.zip_with(total, v, lambda a, b: a + b)
    return total


def split_token(token: Column, low_bits: int) -> tuple[Column, Column]:
    """(high part, low part) of a composite token."""
    return F.shiftright(token, low_bits), token.bitwiseAND(F.lit((1 << low_bits) - 1).cast("long"))


def codebook(df: DataFrame, code: str, size: int) -> DataFrame:
    """Used codes, entropy and its share of the maximum."""
    g = df.groupBy(code).agg(F.count("*").alias("n"))
    p = g.crossJoin(g.agg(F.sum("n").alias("total"))).withColumn("p", F.col("n") / F.col("total"))  # against one row
    return p.agg(F.count("*").alias("used_codes"), F.max("total").alias("total"), (-F.sum(F.col("p") * F.log(F.col("p") + 1e-8))).alias("entropy")).withColumn("share", F.col("entropy") / math.log(size))


def soft_entropy(df: DataFrame, v: str, dim: int, groups: int, inverse_temperature: float = 1.0) -> DataFrame:
    """One row: entropy per sample, of the average distribution, and the difference that training rewards, summed over groups.

    A unit vector's entry gives its bit the probability sigmoid(4 x / (root of dim) * inverse temperature); bits are independent given the vector, a
    group's average distribution is over its 2 ** (dim / groups) codes.
    """
    width = dim // groups
    p = F.transform(F.col(v), lambda x: 1 / (1 + F.exp(-4 * inverse_temperature / math.sqrt(dim) * x)))
    rows = df.select(F.monotonically_increasing_id().alias("__row"), p.alias("p"))
    own = F.aggregate("p", F.lit(0.0), lambda a, x: a - x * F.log(x + 1e-8) - (1 - x) * F.log(1 - x + 1e-8))
    sample = rows.agg(F.avg(own).alias("sample_entropy"))
    each = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("code", F.explode(F.sequence(F.lit(0), F.lit((1 << width) - 1))))
    part = F.slice("p", F.col("g") * width + 1, F.lit(width))
    mass = F.aggregate(F.zip_with(part, F.sequence(F.lit(0), F.lit(width - 1)), lambda x, i: F.when(F.call_function("shiftright", F.col("code"), i) % 2 == 1, x).otherwise(1 - x)), F.lit(1.0), lambda a, x: a * x)
    mean = each.select("g", "code", mass.alias("m")).groupBy("g", "code").agg(F.avg("m").alias("m"))
    book = mean.agg((-F.sum(F.col("m") * F.log(F.col("m") + 1e-8))).alias("codebook_entropy"))
    return sample.crossJoin(book).withColumn("gain", F.col("sample_entropy") - F.col("codebook_entropy"))  # single rows


def softmax(df: DataFrame, key: str, logit: str, temperature: float = 1.0) -> DataFrame:
    w = Window.partitionBy(key)
    e = F.exp((F.col(logit) - F.max(logit).over(w)) / temperature)
    return df.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def top_k(df: DataFrame, key: str, logit: str, k: int) -> DataFrame:
    """Entries not below the k-th; ties stay."""
    return df.withColumn("__r", F.rank().over(Window.partitionBy(key).orderBy(F.desc(logit)))).filter(F.col("__r") <= k).drop("__r")


def top_p(df: DataFrame, key: str, logit: str, p: float, tie: str) -> DataFrame:
    """Nucleus: entries while the mass before them is within ``p``; the first always stays."""
    before = Window.partitionBy(key).orderBy(F.desc(logit), tie).rowsBetween(Window.unboundedPreceding, -1)
    s = softmax(df, key, logit).withColumn("mass_before", F.coalesce(F.sum("p").over(before), F.lit(0.0)))
    return s.filter(F.col("mass_before") <= p)


def draw(df: DataFrame, key: str, tie: str, u: Column) -> DataFrame:
    """The entry of each key whose cumulated probability first passes the uniform number ``u``."""
    order = Window.partitionBy(key).orderBy(tie).rowsBetween(Window.unboundedPreceding, 0)
    c = df.withColumn("cdf", F.sum("p").over(order)).withColumn("u", u)
    last = Window.partitionBy(key)
    hit = F.when((F.col("cdf") > F.col("u")) | (F.col(tie) == F.max(tie).over(last)), F.col(tie))
    return c.withColumn("hit", hit).groupBy(key).agg(F.min("hit").alias("token"))


def seed_of(seed: int, text: Column) -> Column:
    """First four bytes of the SHA-256 of ``seed:text``."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text), 256), 1, 8), 16, 10).cast("long")
