"""Command line: ``python -m wickline list | run NAME --data DIR --out DIR | evaluate --data DIR --out DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wickline.config import EvaluationConfig
from wickline.operators import evaluation as ev
from wickline.plans import analytics, evaluation, models, portfolio, registry  # noqa: F401  they register their queries
from wickline.session import reach_workers
from wickline.sources import candles, sinks


def evaluate(spark: SparkSession, data: str, out: str, config: EvaluationConfig) -> None:
    """Bars to metrics, written as one run: tables and manifest first, the marker last."""
    bars = candles.week6(spark, data)
    cohorts = ev.monthly_cohorts(ev.canonical_calendar(bars, config.threshold), config.horizon)
    wins = ev.windows(ev.history(bars, config.lookback), cohorts, config.lookback)
    fact = ev.prediction_fact(ev.baselines(wins, config.horizon), ev.targets(wins, bars))
    metrics = ev.window_metrics(fact)
    tables = {
        "predictions": (fact, [*ev.KEYS, "method", "horizon_step"]),
        "window_metrics": (metrics, [*ev.KEYS, "method"]),
        "symbol_metrics": (ev.summary(metrics.withColumn("name", F.col("symbol")), "name", "method"), ["name", "method"]),
        "skips": (ev.window_skips(bars, cohorts, config.lookback), ["symbol", "candidate_month"]),
    }
    sinks.write_run(spark, tables, {"config_fingerprint": config.fingerprint()}, out)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="wickline")
    p.add_argument("action", choices=("list", "run", "evaluate"))
    p.add_argument("name", nargs="?")
    p.add_argument("--data")
    p.add_argument("--out")
    a = p.parse_args(args)
    if a.action == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return
    if not a.data or not a.out or a.action == "run" and a.name not in registry.QUERIES:
        p.error("run needs a known query; run and evaluate need --data and --out")
    spark = SparkSession.builder.appName("wickline").getOrCreate()
    reach_workers(spark)
    if a.action == "run":
        registry.QUERIES[a.name](spark, a.data).write.mode("overwrite").parquet(a.out)
    else:
        evaluate(spark, a.data, a.out, EvaluationConfig())


if __name__ == "__main__":
    main()
