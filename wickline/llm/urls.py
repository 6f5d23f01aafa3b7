"""URL filter: rules first, then a ratio of two character language models.

Hosts and paths are judged by host and path-prefix rules (longest wins). Addresses that a rule judges are the
labelled rows of two smoothed variable-order Markov models over the characters of host and path: one
of accepted, one of rejected addresses. All of them are counted, each distinct address once. Each order is discounted absolutely and interpolated with
the next lower one; a position is scored at the longest order that the labelled rows hold. The difference
of the log-likelihoods per character is compared with a threshold that keeps a given share
of all accepted addresses, each scored by models that left its fold out (``FOLDS``), as addresses without a rule were not counted either.

Everything is DataFrame code. The difference at the longest order telescopes into a sum over all
stored n-grams that end at a position. A position is a window of at most ``ORDER`` characters, so n-grams are counted and valued once per
distinct window. Up to ``BROADCAST_ROWS`` windows (some 60 bytes each: 12 MB) meet their positions by a broadcast; of more, only those that make up over one in
``BROADCAST_ROWS`` positions (hence fewer than that), and all others by a shuffle in which no key is frequent. The threshold is found exactly by counting in ever finer bins.
Addresses are scored once each, however often they occur.

Defined results: null addresses and those without ``://`` have empty host and path and no rule, and the model
scores the empty address 0; without accepted or rejected rows all others are allowed;
repeated rows get equal verdicts, null ids are no matter; an address of any length is judged whole, in time linear in its length; an empty table gives an empty result; other columns pass through, those
named like a made column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickline.llm.common import cut

ORDER = 5
DISCOUNT = 0.75
FOLDS = 4
ALL = -1  # in left_out: the models of all labelled rows
KEEP = 0.95
MIN_COUNT = 1
CHARS = 256
BROADCAST_ROWS = 200_000
BINS = 1024
ROWS_PER_FILE = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (nulls without one)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # longer rules end up outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _windows(df: DataFrame, order: int) -> DataFrame:
    """A row per character of the column ``s``, keeping the other columns: it and those before it, ``order`` at most, as ``window``."""
    rest = [c for c in df.columns if c != "s"]
    out = df.select(*rest, "s", F.when(F.length("s") > 0, F.split("s", "")).alias("__c"))
    first = F.transform(F.slice("__c", 1, order - 1), lambda c, i: F.substring(F.col("s"), F.lit(1), i + 1))
    whole = F.slice("__c", F.lit(1), F.greatest(F.size("__c") - (order - 1), F.lit(0)))
    others = F.transform(whole, lambda c, i: F.concat(c, *[F.get(F.col("__c"), i + k) for k in range(1, order)]))
    return out.select(*rest, F.explode(F.concat(first, others)).alias("window"))


def _suffixes(df: DataFrame) -> DataFrame:
    """All n-grams that end a ``window``, keeping the columns."""
    return df.withColumn("gram", F.explode(F.expr("transform(sequence(1, length(window)), k -> substring(window, -k, k))")))


def _cut(df: DataFrame, rows: int) -> DataFrame:
    """``cut`` into files by a bound on the rows."""
    return cut(df, rows // ROWS_PER_FILE + 1)


def train(labelled: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, folds: int = 0) -> DataFrame:
    """``left_out``, ``gram`` and ``delta`` from rows with the column ``s`` and the flag ``ok``.

    ``left_out`` is ``ALL``; with ``folds`` there are also the models without the rows of each ``fold`` from 0 on.
    """
    fold = F.col("fold") if folds else F.lit(0)
    cells = {f"c{y}_{f}": ((F.col("ok") == bool(y)) & (fold == f)).cast("long") for y in (1, 0) for f in range(folds or 1)}
    seen = _windows(labelled.select("s", *[c.alias(name) for name, c in cells.items()]), order).groupBy("window").agg(*[F.sum(name).alias(name) for name in cells])
    grams = _suffixes(seen).groupBy("gram").agg(*[F.sum(name).alias(name) for name in cells])
    of = lambda y, out: sum((F.col(f"c{y}_{f}") for f in range(folds or 1) if f != out), F.lit(0)).cast("double").alias(f"c{y}")
    each = F.explode(F.array(*[F.struct(F.lit(out).alias("left_out"), of(1, out), of(0, out)) for out in (ALL, *range(folds))]))
    counts = grams.select("gram", F.length("gram").alias("k"), each.alias("m")).select("gram", "k", "m.*")
    chars = labelled.agg(F.sum(F.length("s"))).first()[0] or 0
    counts = _cut(counts.filter(F.col("c1") + F.col("c0") >= F.when(F.col("k") == 1, 1).otherwise(min_count)), chars * order)
    rows = counts.count()
    low = None
    done = None
    for k in range(1, order + 1):
        now = counts.filter(F.col("k") == k).withColumn("ctx", F.expr("substring(gram, 1, k - 1)")).withColumn("tail", F.expr("substring(gram, 2, k - 1)"))
        sums = now.groupBy("left_out", "ctx").agg(*[F.sum(f"c{y}").alias(f"n{y}") for y in (1, 0)], *[F.sum((F.col(f"c{y}") > 0).cast("int")).alias(f"t{y}") for y in (1, 0)])
        joined = now.join(sums, ["left_out", "ctx"])
        if low is None:
            joined = joined.withColumns({"p1": F.lit(1 / CHARS), "p0": F.lit(1 / CHARS), "below": F.lit(0.0)})
        else:
            joined = joined.join(low, ["left_out", "tail"])
        new = {f"q{y}": F.when(F.col(f"n{y}") > 0, (F.greatest(F.col(f"c{y}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"t{y}") * F.col(f"p{y}")) / F.col(f"n{y}")).otherwise(F.col(f"p{y}")) for y in (1, 0)}
        scored = joined.withColumns(new).withColumn("here", F.log(F.col("q1") / F.col("q0")))
        scored = _cut(scored.select("left_out", "gram", "q1", "q0", "here", (F.col("here") - F.col("below")).alias("delta")), rows)
        found = scored.select("left_out", "gram", "delta")
        done = found if done is None else done.union(found)
        low = scored.select("left_out", F.col("gram").alias("tail"), F.col("q1").alias("p1"), F.col("q0").alias("p0"), F.col("here").alias("below"))
    return done


def differences(addresses: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``host``, ``path`` and ``value`` (difference per character) of distinct addresses, a frame whose rows keep their places.

    A column ``left_out`` names the model of each; without it that of all rows is taken.
    """
    numbered = addresses.select("host", "path", F.col("left_out") if "left_out" in addresses.columns else F.lit(ALL).alias("left_out"), F.monotonically_increasing_id().alias("__at"))
    keys = ["left_out", "window"]
    ends = _windows(numbered.select("__at", "left_out", F.concat("host", "path").alias("s")), order)
    model = F.broadcast(model) if model.count() <= BROADCAST_ROWS else model
    found = _suffixes(ends.groupBy(*keys).agg(F.count("*").alias("n"))).join(model, ["left_out", "gram"]).groupBy(*keys).agg(F.sum("delta").alias("here"), F.first("n").alias("n"))
    found = _cut(found, numbered.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0)
    size = found.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    if size["rows"] <= BROADCAST_ROWS:
        met = ends.join(F.broadcast(found.drop("n")), keys).select("__at", "here")
    else:
        often = F.col("n") > (size["n"] // BROADCAST_ROWS + 1)
        tried = ends.join(F.broadcast(found.filter(often).drop("n")), keys, "left")
        met = tried.filter("here is not null").select("__at", "here")
        met = met.union(tried.filter("here is null").drop("here").join(found.filter(~often).drop("n"), keys).select("__at", "here"))
    size = F.length("host") + F.length("path")
    total = met.groupBy("__at").agg(F.sum("here").alias("total"))
    return numbered.join(total, "__at", "left").select("host", "path", (F.coalesce("total", F.lit(0.0)) / F.greatest(size, F.lit(1))).alias("value"))


def threshold(values: DataFrame, keep: float = KEEP) -> float:
    """The highest ``value`` of the rows that at least the share ``keep`` of them reaches, exactly; the driver sees ``BINS`` + 1 rows at a time."""
    n, lo, hi = values.agg(F.count("value"), F.min("value"), F.max("value")).first()
    rank = int((n - 1) * (1 - keep))
    while n and lo < hi:  # the lowest and the highest value never share a bin
        bin_ = F.floor((F.col("value") - lo) / (hi - lo) * BINS)
        inside = values.filter(F.col("value").between(lo, hi)).groupBy(bin_.alias("bin"))
        for r in sorted(inside.agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()):
            if rank < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            rank -= r["n"]
    return lo


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", keep: float = KEEP, rules=RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``value`` (null where a rule decides)."""
    url = F.col(url_col).cast("string")
    parsed = pages.drop("host", "path", "rule", "verdict", "value").withColumns({"host": host_of(url), "path": path_of(url)})
    rule, verdict = judge(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumns({"rule": rule, "verdict": verdict})
    addresses = cut(judged.select("host", "path", "rule", "verdict").distinct())
    labelled = addresses.filter("rule is not null").withColumn("fold", F.pmod(F.xxhash64(F.lit("held"), "host", "path"), F.lit(FOLDS)).cast("int"))
    n = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    if not (n.get("allow") and n.get("block")):
        return judged.withColumn("value", F.lit(None).cast("double")).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    model = train(labelled.select(F.concat("host", "path").alias("s"), (F.col("verdict") == "allow").alias("ok"), "fold"), folds=FOLDS)
    accepted = labelled.filter("verdict = 'allow'").withColumnRenamed("fold", "left_out")
    bar = threshold(_cut(differences(accepted, model.filter(F.col("left_out") != ALL)).select("value"), n["allow"]), keep)
    values = differences(addresses.filter("rule is null"), model.filter(F.col("left_out") == ALL))
    free = judged.filter("rule is null").join(values, ["host", "path"], "left")
    free = free.withColumn("verdict", F.when(F.coalesce("value", F.lit(0.0)) >= bar, F.lit("allow")).otherwise(F.lit("block")))
    fixed = judged.filter("rule is not null").withColumn("value", F.lit(None).cast("double"))
    return fixed.unionByName(free.select(*fixed.columns))
