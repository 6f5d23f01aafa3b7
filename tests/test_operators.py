"""Single operators on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickline.config import EvaluationConfig
from wickline.functions import numeric
from wickline.operators import adjust, evaluation, features, indicators, predictor, quality, tokens
from wickline.sources import files, provider, sinks

DAY = dt.date(2023, 1, 2)
BAR = "symbol string, ts date, open double, high double, low double, close double, volume double"


def series(spark, closes, symbol="A", start=DAY):
    return spark.createDataFrame([(symbol, start + dt.timedelta(i), c - 0.2, c + 0.5, c - 0.5, c, 1000.0 + i) for i, c in enumerate(map(float, closes))], BAR)


def test_repair_low_and_high(spark):
    df = spark.createDataFrame([("A", DAY, 2.506153, 2.506153, 2.506153, 2.504615, 1.0), ("B", DAY, 0.541301, 0.541301, 0.541301, 0.554344, 1.0), ("C", DAY, None, 1.0, 2.0, 1.0, 1.0)], BAR)
    fixed = quality.repair_envelope(df)
    got = {r.symbol: (r.high, r.low) for r in fixed.collect()}
    assert got["A"] == (2.506153, 2.504615) and got["B"] == (0.554344, 0.541301) and got["C"] == (1.0, 2.0)
    assert {(r.symbol, r.column) for r in quality.repair_audit(fixed).collect()} == {("A", "low"), ("B", "high")}


def test_violations_in_order(spark):
    df = spark.createDataFrame([("A", DAY, 1.0, 0.5, 0.4, 1.0, 1.0), ("B", DAY, 1.0, 2.0, 0.5, 1.0, -1.0), ("C", DAY, 1.0, 2.0, 0.5, 1.0, 1.0), ("C", DAY, 1.0, 2.0, 0.5, 1.0, 1.0), ("D", DAY, 0.0, 0.0, 0.0, 0.0, 0.0), ("E", DAY, 1.0, float("nan"), 1.0, 1.0, 1.0)], BAR)
    assert sorted((r.symbol, r.violation) for r in quality.violations(df).collect()) == [("A", "high"), ("B", "negative_volume"), ("C", "duplicate"), ("C", "duplicate"), ("E", "non_numeric")]


def test_typical_amount(spark):
    assert spark.range(1).select(quality.typical_amount(F.lit(12.0), F.lit(9.0), F.lit(11.0), F.lit(100.0)).alias("a")).first().a == pytest.approx(32 / 3 * 100)


def test_as_of_universe(spark):
    u = spark.createDataFrame([("A", dt.date(2026, 7, 1), dt.date(2026, 9, 30)), ("B", dt.date(2026, 10, 1), None)], "symbol string, valid_from date, valid_to date")
    assert [r.symbol for r in quality.as_of(u, F.lit("2026-08-02").cast("date")).collect()] == ["A"]


def test_calendar_needs_coverage(spark):
    rows = [("X", 2), ("X", 5), ("X", 6), ("Y", 2), ("Y", 5), ("Z", 2), ("Z", 6)]
    df = spark.createDataFrame([(s, dt.date(2026, 1, d)) for s, d in rows], "symbol string, ts date")
    assert [r.ts.day for r in evaluation.canonical_calendar(df, 0.67).collect()] == [2]


def test_cohorts(spark):
    days = [d for d in (dt.date(2026, 1, 1) + dt.timedelta(i) for i in range(45)) if d.weekday() < 5][:30]
    cal = spark.createDataFrame([(d,) for d in days], "ts date")
    first = evaluation.monthly_cohorts(cal, 5).orderBy("candidate_month").first()
    assert first.forecast_origin == days[0] and first.targets == days[1:6] and first.complete
    short = spark.createDataFrame([(dt.date(2026, 1, 30),), (dt.date(2026, 2, 2),), (dt.date(2026, 2, 3),)], "ts date")
    assert [r.complete for r in evaluation.monthly_cohorts(short, 5).collect()] == [False, False]


def windowed(spark, closes, lookback=20, horizon=5):
    df = series(spark, closes)
    origin = DAY + dt.timedelta(len(closes) - 1)
    cohort = spark.createDataFrame([("2023-01", origin, [origin + dt.timedelta(i) for i in range(1, horizon + 1)], True)], "candidate_month string, forecast_origin date, targets array<date>, complete boolean")
    return evaluation.windows(evaluation.history(df, lookback), cohort, lookback), cohort, df


def test_baselines_of_a_line(spark):
    wins, _, _ = windowed(spark, range(1, 21))
    got = {(r.method, r.horizon_step): r.predicted_close for r in evaluation.baselines(wins, 5).collect()}
    assert got["last_close", 5] == 20 and got["trend_20", 1] == pytest.approx(21)
    assert got["momentum_20", 1] == pytest.approx(20 * (1 + (20 ** (1 / 19) - 1)))


def test_trend_agrees_with_numpy(spark):
    closes = 100 + np.random.default_rng(3).normal(size=20).cumsum()
    wins, _, _ = windowed(spark, closes)
    line = np.polyfit(np.arange(20), closes, 1)
    got = {r.horizon_step: r.predicted_close for r in evaluation.baselines(wins, 5).filter("method = 'trend_20'").collect()}
    assert [got[h] for h in range(1, 6)] == pytest.approx([np.polyval(line, 19 + h) for h in range(1, 6)])


def test_invalid_method_is_marked_whole(spark):
    wins, _, _ = windowed(spark, [50 - 2.45 * i for i in range(20)])
    bad = evaluation.baselines(wins, 5).filter("not valid").select("method").distinct().collect()
    assert [r.method for r in bad] == ["trend_20"]


def test_windows_do_not_depend_on_the_future(spark):
    wins, cohort, df = windowed(spark, range(1, 21))
    later = df.union(series(spark, [999.0] * 5, start=DAY + dt.timedelta(20)))
    again = evaluation.windows(evaluation.history(later, 20), cohort, 20)
    pick = lambda w: sorted(map(tuple, evaluation.baselines(w, 5).select("method", "horizon_step", "predicted_close").collect()))
    assert pick(wins) == pick(again)


def test_decisions_and_single_cluster(spark):
    rows = [("c", "AB"[i % 2], f"2026-0{i + 1}", DAY, -0.1 * (i + 1)) for i in range(4)]
    pairs = spark.createDataFrame(rows, "comparison_id string, symbol string, candidate_month string, forecast_origin date, difference double")
    both = evaluation.bootstrap(pairs, {"candidate_month": 7, "symbol": 8}, 200)
    assert evaluation.decisions(both).first().decision == "robustly_better"
    one = evaluation.bootstrap(pairs.filter("symbol = 'A'"), {"symbol": 7}, 50).first()
    assert not one.available and one.lower is None
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, evaluation.bootstrap(pairs, {"candidate_month": 7, "symbol": 8}, 200).collect()))


def test_rebase_keeps_origin_and_ignores_a_common_multiplier(spark):
    def run(k):
        df = series(spark, [10, 11, 12]).withColumn("adj_close", F.col("close") * k * F.when(F.col("close") < 12, 0.5).otherwise(1.0))
        origin = spark.createDataFrame([("A", DAY + dt.timedelta(2))], "origin_symbol string, origin date")
        return [x for r in adjust.rebase(adjust.with_factor(df), origin).orderBy("ts").collect() for x in (r.close, r.volume)]

    assert run(1.0) == pytest.approx(run(4.0)) and run(1.0)[-2] == 12


def test_price_limits(spark):
    df = series(spark, [9, 10, 12]).withColumn("low", F.when(F.col("close") < 12, F.col("low")))
    last = spark.createDataFrame([("A", 10.0)], "symbol string, last_close double")
    got = [(round(r.open, 4), round(r.high, 4), r.low, round(r.close, 4)) for r in indicators.price_limits(df, last, 0.1).orderBy("ts").collect()]
    assert got == [(9.0, 9.5, 9.0, 9.0), (9.8, 9.9, 9.5, 9.9), (10.89, 10.89, None, 10.89)]


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(numeric.safe_corr(F.col("a"), F.col("b")).alias("c")).first().c is None


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1,234.5",), ("--",), ("",), ("abc",), (None,), ("NaN",)], "x string")
    assert [r.x for r in quality.numbers_from_text(df, "x").collect()] == [1234.5, None, None, None, None, None]


def test_shards(spark):
    df = spark.createDataFrame([(i, f"S{i}") for i in range(100)], "ord int, symbol string")
    got = features.contiguous_shards(df, "ord", 10).filter("shard_index = 3").orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(30, 40))


def test_factor_change_inside_the_target(spark):
    rows = [("A", i, 10.0, 12.0, 9.0, 11.0, 5.0, 0.5 if i < 8 else 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, ts int, open double, high double, low double, close double, volume double, factor double")
    got = {r.ts: (r.context_changed, r.target_changed, r.exposure_bucket) for r in adjust.window_exposure(df, 3, 2).collect()}
    assert got[5] == (False, False, "no_material_change") and got[6] == got[7] == (False, True, "material_factor_change")
    assert got[8] == got[9] == (True, False, "material_factor_change") and set(got) == set(range(10))
    t = {(r.origin, r.horizon_step): (r.open, r.high, r.low, r.close, r.volume) for r in adjust.target_rows(df, 2).collect()}
    assert t[6, 1] == (10.0, 12.0, 9.0, 11.0, 5.0) and t[6, 2] == (20.0, 24.0, 18.0, 22.0, 5.0) and len(t) == 20


def test_shards_in_range_partitions(spark):
    df = spark.range(1003).selectExpr("cast(1002 - id as int) as ord").repartition(5)
    out = features.contiguous_shards(df, "ord", 7)
    assert "SinglePartition" not in out._jdf.queryExecution().sparkPlan().toString() and "ntile" not in out._jdf.queryExecution().toString()
    got = {r.ord: r.shard_index for r in out.collect()}
    sizes = [144, 144, 143, 143, 143, 143, 143]
    assert got == dict(enumerate(i for i, n in enumerate(sizes) for _ in range(n)))
    few = features.contiguous_shards(df.filter("ord < 3"), "ord", 7).collect()
    assert sorted((r.ord, r.shard_index) for r in few) == [(0, 0), (1, 1), (2, 2)]


def test_token_round_trip(spark):
    df = spark.createDataFrame([([1.0, -2.0, 0.0, 3.0],)], "v array<double>")
    q = df.select(tokens.quantise(tokens.l2_normalise(F.col("v")), 4).alias("q")).withColumn("t", tokens.bits_to_index(F.col("q")))
    r = q.withColumn("b", tokens.index_to_vector(F.col("t"), 4)).first()
    assert r.t == 0b1001 and r.b == r.q


def test_predictor_failures(spark):
    _, cohort, df = windowed(spark, range(1, 21))
    wins = predictor.contexts(df, cohort, 20)
    good = predictor.predict(wins, predictor.last_close_stub, 5).collect()
    assert [r.predicted_close for r in good] == [20.0] * 5
    assert predictor.predict(wins, lambda c, h: {s: -np.ones(h) for s in c}, 5).first().reason_code == "invalid_model_output"
    assert predictor.predict(wins, lambda c, h: {}, 5).first().reason_code == "invalid_model_schema"


def test_universe_file(spark, tmp_path):
    good = tmp_path / "u.csv"
    good.write_text("﻿symbol,name,valid_from,valid_to\n b ,B co,2026-01-01,\nA,A co,2026-01-01,2026-06-30\n", encoding="utf-8")
    assert [(r.symbol, r.valid_to is None) for r in files.universe(spark, str(good)).orderBy("ord").collect()] == [("B", True), ("A", False)]
    bad = tmp_path / "v.csv"
    bad.write_text("symbol,name,valid_from,valid_to\nA,x,2026-01-01,\nA,y,2026-01-01,\n")
    with pytest.raises(ValueError):
        files.universe(spark, str(bad))


def test_fallback_and_names(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("日期,开盘,最高,最低,收盘,成交量\n2024-01-02,1,2,0.5,x,10\n", encoding="utf-8")

    def fails():
        raise OSError("offline")

    df = files.first_available([fails, lambda: files.raw_candles(spark, str(tmp_path))])
    r = df.first()
    assert r.symbol == "AAA" and r.open == 1.0 and r.close is None


def test_provider_retries(spark):
    spark.dataSource.register(provider.provider_source(lambda s, a, b: [(dt.date(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 1.5, 10.0)]))
    df = spark.read.format("candle_provider").option("symbols", "a, b a").option("start", "2024-01-01").option("end", "2024-02-01").load()
    assert sorted(r.symbol for r in df.collect()) == ["A", "B"]


def test_run_marker(spark, tmp_path):
    path = str(tmp_path / "run")
    df = series(spark, [1, 2])
    sinks.write_run(spark, {"candles": (df, ["symbol", "ts"])}, {"config": EvaluationConfig().fingerprint()}, path)
    assert sinks.read_run(spark, path, "candles").count() == 2
    with pytest.raises(ValueError):
        sinks.write_run(spark, {"candles": (df.union(df), ["symbol", "ts"])}, {}, path)
    assert sinks.read_run(spark, path, "candles").count() == 2  # the finished run stays
    sinks.write_run(spark, {"candles": (df.limit(1), ["symbol", "ts"])}, {}, path)
    assert sinks.read_run(spark, path, "candles").count() == 1 and len([p for p in (tmp_path / "run").iterdir() if p.name.startswith("run-")]) == 1
    with pytest.raises(FileNotFoundError):
        sinks.read_run(spark, str(tmp_path / "none"), "candles")


def test_config():
    assert EvaluationConfig().fingerprint() != EvaluationConfig(seed=1).fingerprint()
    assert EvaluationConfig().fingerprint(("seed",)) == EvaluationConfig(seed=1).fingerprint(("seed",))
    with pytest.raises(ValueError):
        EvaluationConfig(threshold=0)


def test_json_rows(spark):
    assert '"close":null' in sinks.to_json_rows(spark.createDataFrame([(float("nan"),)], "close double")).first().value
