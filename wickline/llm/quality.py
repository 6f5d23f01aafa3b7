"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores what was measured together with one
integer whose bits say which rules failed. A policy is a version and a mask over those bits:
``apply_policies`` and ``ablations`` work from the ledger alone, by bit operations, and never
read a text again. Everything is one projection over the documents (no shuffle, no Python); only
the ablation counts are aggregated.

Defined results: null and empty texts have no words: all counts are 0 and the rule ``few_words``
fails; a text of any length is measured whole; repeated rows are judged alike; other columns
pass through ``ledger``, those named like a measurement are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts")

#: name -> failing condition over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 40 * n_lines",
    "short_words": "10 * word_chars < 25 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "shouting": "100 * n_shouts > 30 * n_words",
    "many_words": "n_words > 1000000",
}
BASE = ("few_words", "repeated_windows")


def mask_of(*names: str) -> int:
    rules = list(RULES)
    return sum(1 << rules.index(n) for n in names)


#: version -> mask of the rules that reject a document.
POLICIES: dict[str, int] = {
    "v1": mask_of(*BASE),
    "v2": mask_of(*BASE, "symbols"),
    "v3": mask_of(*RULES),
}
CURRENT = "v3"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column) -> Column:
    """Words that windows of three words with these sorted starts cover."""
    gap = lambda x, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - x, F.lit(3)))
    return F.aggregate(F.transform(starts, gap), F.lit(0), lambda acc, x: acc + x)


def _repeat_words(words: Column) -> Column:
    """Number of words in three-word windows that occur twice or more."""
    index = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(index, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def starts(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j).h == x.h, F.lit(False))
        twice = _let(ordered, lambda s: F.filter(s, lambda x, j: (j > 0) & same(s, x, F.greatest(j - 1, F.lit(0))) | same(s, x, j + 1)))
        return F.sort_array(F.transform(twice, lambda x: x.i))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(starts(h), _covered))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(windows, count))


def ledger(df: DataFrame, text_col: str = "text", version: str = CURRENT) -> DataFrame:
    """``df`` with the measurements, ``failed`` (bits of the rules that fail) and ``ledger_version``."""
    df = df.drop(*MEASURES, "failed", "ledger_version")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    made = df.withColumns({"__text": text, "__words": words, "__lines": lines})
    made = made.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("__words")).cast("long"),
            "n_shouts": F.regexp_count("__text", F.lit("!!")).cast("long"),
        }
    ).drop("__text", "__words", "__lines")
    failed = F.lit(0).cast("long")
    for bit, rule in enumerate(RULES.values()):
        failed = failed + F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0))
    return made.withColumn("failed", failed).withColumn("ledger_version", F.lit(version))


def passes(failed: Column, mask: int) -> Column:
    """Whether none of the rules of ``mask`` failed."""
    return failed.bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policies(book: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """``book`` with one boolean ``kept_<version>`` per policy."""
    chosen = POLICIES if policies is None else policies
    return book.withColumns({f"kept_{v}": passes(F.col("failed"), m) for v, m in chosen.items()})


def ablations(book: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that fail no other rule of the policy
    (``only``), and that the policy would keep without the rule (``kept_without``).

    Failure masks are counted first, so that the further work grows with the number of distinct
    masks (at most two to the number of rules) and not with the documents.
    """
    chosen = POLICIES if policies is None else policies
    masks = book.groupBy("failed").agg(F.count("*").alias("n"))
    rows = [F.struct(F.lit(v).alias("version"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for v, m in chosen.items() for b, r in enumerate(RULES) if m >> b & 1]
    if not rows:
        rows = [F.lit(None).cast("struct<version:string,mask:bigint,rule:string,bit:bigint>")]
    each = masks.select("failed", "n", F.explode(F.array(*rows)).alias("p")).select("failed", "n", "p.*").filter("version is not null")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    some = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return each.groupBy("version", "rule").agg(
        some(hit.bitwiseAND(F.col("bit")) != 0).alias("fails"),
        some(hit == F.col("bit")).alias("only"),
        some(hit.bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    )
