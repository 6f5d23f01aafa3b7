"""Gates, shards, sinks and strategies against values worked out by hand."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_operators import BAR, DAY, series
from wickline.operators import adjust, evaluation, features, indicators, parsing, portfolio, predictor, tokens
from wickline.operators import quality as ql
from wickline.sources import files, provider, shards, sinks

RAW = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume double"


def raw(spark, rows):
    return spark.createDataFrame([("A", dt.datetime(2024, 1, 1 + i), *r) for i, r in enumerate(rows)], RAW)


def test_strict_raw_gates(spark):
    good = (1.0, 2.0, 0.5, 1.5, 1.5, 10.0)
    assert files.strict_raw(raw(spark, [good, good])).count() == 2
    for row, said in (((1.0, 2.0, 0.0, 1.5, 1.5, 1.0), "positive"), ((1.0, float("inf"), 0.5, 1.5, 1.5, 1.0), "non-finite"), ((1.0, 2.0, 0.5, None, 1.5, 1.0), "non-finite"), ((1.0, 2.0, 0.5, 1.5, float("nan"), 1.0), "non-finite"), ((1.0, 2.0, 0.5, 1.5, 1.5, -1.0), "negative")):
        with pytest.raises(ValueError, match=said):
            files.strict_raw(raw(spark, [good, row]))
    with pytest.raises(ValueError, match="duplicate"):
        files.strict_raw(raw(spark, [good]).union(raw(spark, [good])))
    with pytest.raises(ValueError, match="adj_close"):
        files.strict_raw(raw(spark, [good]).drop("adj_close"))


def test_strict_model_gates(spark):
    df = series(spark, [1, 2]).withColumn("amount", F.lit(3.0))
    assert files.strict_model(df).count() == 2
    with pytest.raises(ValueError, match="amount"):
        files.strict_model(df.drop("amount"))
    with pytest.raises(ValueError, match="non-finite"):
        files.strict_model(df.withColumn("amount", F.lit(float("inf"))))
    with pytest.raises(ValueError, match="duplicate"):
        files.strict_model(df.union(df))


def test_discovery_and_restriction(spark, tmp_path):
    for n in ("AAA", "BBB", "CCC"):
        (tmp_path / f"{n}.csv").write_text("timestamps,open,high,low,close,volume\n2024-01-02,1,2,0.5,1,10\n")
    (tmp_path / "AAA.txt").write_text("x")
    wanted = spark.createDataFrame([("AAA",), ("CCC",), ("ZZZ",)], "symbol string")
    assert sorted(r.symbol for r in files.discover(spark, str(tmp_path), wanted).collect()) == ["AAA", "CCC"]
    candles = files.raw_candles(spark, str(tmp_path) + "/*.csv")
    assert sorted(r.symbol for r in files.restricted(candles, wanted).collect()) == ["AAA", "CCC"]
    (tmp_path / "DDD.csv").write_text("timestamps,open,high,low,close,volume\n" + "2024-01-02,1,2,0.5,1,10\n" * 2)
    assert files.coverage(spark, str(tmp_path) + "/*.csv").count() == 5
    with pytest.raises(ValueError, match="duplicate"):
        files.coverage(spark, str(tmp_path) + "/*.csv", strict=True)


def test_provider_frames(spark):
    df = spark.createDataFrame([("2024-01-02 00:00:00+03:00", "1", "2", "0.5", "1.5", None, "10"), ("2024-01-03", "1", "", "0.5", "1.5", "1.4", "10")], "`Date` string, `Open|X` string, `High|X` string, `Low|X` string, `Close|X` string, `Adj Close|X` string, `Volume|X` string")
    (r,) = files.normalised(df).collect()
    assert (r.timestamps, r.open, r.adj_close) == (dt.datetime(2024, 1, 2), 1.0, 1.5)
    local = spark.createDataFrame([("2024-01-02", "10", "11", "9", "10", "1,000", "5"), ("2024-01-03", "10", "13", "9", "12", "--", "5"), ("2024-01-04", "10", "12", "10", "11", "7", "5")], "`日期` string, `开盘` string, `最高` string, `最低` string, `收盘` string, `成交量` string, `成交额` string")
    got = [(r.ts.day, r.volume, r.change, r.amplitude) for r in files.provider_daily(local).orderBy("ts").collect()]
    assert got == [(2, 1000.0, None, None), (4, 7.0, 1.0, 20.0)]


def test_provider_retries_until_it_answers(spark, tmp_path):
    tries = tmp_path / "tries"

    def flaky(symbol, start, end, at=str(tries)):
        with open(at, "a") as f:
            f.write("x")
        if len(open(at).read()) < 3:
            raise OSError("busy")
        return [(dt.date(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 1.5, 10.0)]

    spark.dataSource.register(provider.provider_source(flaky, retries=3))
    df = spark.read.format("candle_provider").option("symbols", "a").option("start", "2024-01-01").option("end", "2024-02-01").load()
    assert df.count() == 1 and len(tries.read_text()) == 3


def test_shard_runs(spark, tmp_path):
    df = series(spark, [1, 2])
    common = {c: "f" for c in shards.SAME} | {"shard_count": 2}
    for i, symbols in enumerate((["A"], ["B"])):
        sinks.write_run(spark, {"candles": (df.withColumn("symbol", F.lit(symbols[0])), ["symbol", "ts"])}, {**common, "shard_index": i}, str(tmp_path / "root" / f"s{i}"))
    found = shards.manifests(spark, str(tmp_path / "root"))
    assert [m["shard_index"] for m, _ in found] == [0, 1]
    shards.check([m for m, _ in found], 2)
    both = shards.union(spark, found, "candles", ["symbol", "ts"])
    assert sorted((r.symbol, r.shard_index) for r in both.collect()) == [("A", 0), ("A", 0), ("B", 1), ("B", 1)]
    with pytest.raises(ValueError, match="duplicate keys"):
        shards.union(spark, [found[0], found[0]], "candles", ["symbol", "ts"])
    (tmp_path / "root" / "s2").mkdir()
    with pytest.raises(ValueError, match="not completed"):
        shards.manifests(spark, str(tmp_path / "root"))


def test_manifest_rules():
    row = lambda i, **more: {"shard_index": i, "symbols": [f"S{i}"], **{c: "f" for c in (*shards.SAME, *shards.SHARED)}, **more}
    shards.check([row(0), row(1)], 2)
    for rows, said in (([row(0)], "missing"), ([row(0), row(0)], "duplicate"), ([row(0), row(1, model_revision="g")], "model_revision"), ([row(0), row(1, symbols=["S0"])], "overlapping")):
        with pytest.raises(ValueError, match=said):
            shards.check(rows, 2)
    mini = [row(i, mode="mini-pair", experiment_arms=["raw", "adjusted"]) for i in (0, 1)]
    small = [row(i, mode="small", experiment_arms=["small"], model_revision="other") for i in (0, 1)]
    families = lambda a, b: {"mini-pair": (a, {"raw", "adjusted"}), "small": (b, {"small"})}
    shards.check_families(families(mini, small), 2)
    for change, said in (({"mode": "x"}, "mode"), ({"experiment_arms": ["raw"]}, "arms"), ({"factor_fingerprint": "g"}, "factor_fingerprint"), ({"symbols": ["S9"]}, "different symbols"), ({"model_revision": "h"}, "revision")):
        with pytest.raises(ValueError, match=said):
            shards.check_families(families(mini, [small[0], small[1] | change]), 2)
    assert shards.compare({"a": 1, "f": True, "t": 1e-6}, {"a": 1, "f": False, "t": 2e-6}, ("a",), ("f",), {"t": 1e-9}) == ["f", "t"]


def test_symbol_folders_and_manifest(spark, tmp_path):
    bars = spark.createDataFrame([("A", DAY, 2.0, 2.0, 2.0, 3.0, 1.0), ("B", DAY, 2.0, 2.5, 1.0, 2.0, 1.0), ("B", DAY + dt.timedelta(1), 2.0, 1.0, 1.5, 2.0, 1.0)], BAR)
    fails = spark.createDataFrame([("C", "OSError", "offline")], "symbol string, error_type string, error string")
    sinks.write_symbols(bars, ql.repair_envelope(bars), fails, {"start": "2023-01-01"}, str(tmp_path / "out"))
    rows = {r.symbol: r for r in spark.read.json(str(tmp_path / "out/manifest")).collect()}
    assert (rows["A"].bars, rows["A"].repairs, rows["B"].bars, rows["B"].repairs, rows["C"].error_type) == (1, 1, 2, 1, "OSError")
    said = json.loads(spark.read.text(str(tmp_path / "out/summary")).first()[0])
    assert said == {"start": "2023-01-01", "requested": 3, "succeeded": 2, "failed": 1, "repairs": 2}
    assert spark.read.option("header", True).csv(str(tmp_path / "out/model")).filter("symbol = 'A'").first().high == "3.0"


def test_report_has_every_row(spark):
    assert sinks.markdown(spark.range(450), "t").count("\n|") == 452


def test_business_days_are_never_short(spark):
    start = spark.createDataFrame([(dt.date(2024, 1, 5),)], "d date")
    off = spark.createDataFrame([(dt.date(2024, 1, 6) + dt.timedelta(i),) for i in range(400)], "holiday date")
    got = [r.day for r in features.business_days(start, "d", 3, off).orderBy("day").collect()]
    assert got == [dt.date(2025, 2, 10), dt.date(2025, 2, 11), dt.date(2025, 2, 12)]
    assert features.business_days(start, "d", 300).count() == 300


def test_bad_factors_are_an_error(spark):
    df = series(spark, [10, 11]).withColumn("adj_close", F.when(F.col("close") < 11, F.col("close")).otherwise(F.lit(-1.0)))
    with pytest.raises(PySparkException, match="strictly positive"):
        adjust.with_factor(df).collect()
    assert adjust.with_factor(df, strict=False).count() == 1


def test_pairs_must_agree(spark):
    row = lambda s, m, actual, e: (s, "2024-01", DAY, m, e, 10.0, actual)
    kind = "symbol string, candidate_month string, forecast_origin date, method string, log_return_abs_error double, history_last_close double, actual_final_close double"
    good = [row("A", "c", 5.0, 0.1), row("A", "r", 5.0, 0.3), row("B", "c", 7.0, 0.2)]
    (p,) = evaluation.paired(spark.createDataFrame(good, kind), [("x", "c", "r")], strict=True).collect()
    assert (p.symbol, round(p.difference, 6), p.winner) == ("A", -0.2, "challenger")
    bad = spark.createDataFrame([*good, row("B", "r", 999.0, 0.1)], kind)
    assert sorted((r.symbol, r.mismatch) for r in evaluation.paired(bad, [("x", "c", "r")]).collect()) == [("A", None), ("B", "actual_final_close")]
    with pytest.raises(PySparkException, match="actual_final_close"):
        evaluation.paired(bad, [("x", "c", "r")], strict=True).collect()
    with pytest.raises(PySparkException, match="twice"):
        evaluation.paired(spark.createDataFrame([*good, row("A", "r", 5.0, 0.1)], kind), [("x", "c", "r")]).collect()


def test_threshold_strategy_by_hand(spark):
    rows = [("A", i, p, a) for i, (p, a) in enumerate([(10.2, 10.0), (10.5, 10.0), (9.0, 12.0), (11.0, 12.0), (99.0, 200.0)])]
    df = spark.createDataFrame(rows, "symbol string, ts int, predicted double, actual double")
    got = [(r.action, r.position, r.value) for r in indicators.threshold_strategy(df, 0.03, 105.0).orderBy("ts").collect()]
    assert got == [(None, 0, 105.0), ("BUY", 10, 105.0), ("SELL", 0, 125.0), (None, 0, 125.0), (None, 0, 125.0)]


def test_backtest_and_its_metrics_by_hand(spark):
    rows = [("A", i, c, s) for i, (c, s) in enumerate([(10.0, 1), (10.0, 1), (12.0, 1), (15.0, 0), (15.0, 1), (12.0, 0), (12.0, 0)])]
    df = spark.createDataFrame(rows, "symbol string, ts int, close double, sg int")
    back = portfolio.signal_backtest(df, "sg", 105.0)
    got = [(r.action, r.position, r.value) for r in back.orderBy("ts").collect()]
    assert got == [(None, 0, 105.0), ("BUY", 10, 105.0), (None, 10, 125.0), ("SELL", 0, 155.0), ("BUY", 10, 155.0), ("SELL", 0, 125.0), (None, 0, 125.0)]
    m = indicators.performance(back, 105.0).first()
    r = np.array([0, 0, 125 / 105 - 1, 155 / 125 - 1, 0, 125 / 155 - 1, 0])
    assert (m.final_value, m.trades, m.win_rate) == (125.0, 4, 0.5) and m.mean_trade_return == pytest.approx((0.5 - 0.2) / 2)
    assert m.volatility == pytest.approx(r.std(ddof=1) * 252**0.5) and m.max_drawdown == pytest.approx(125 / 155 - 1)
    assert m.annual_return == pytest.approx((125 / 105) ** (252 / 7) - 1) and m.sharpe == pytest.approx((m.annual_return - 0.03) / m.volatility)
    lost = portfolio.signal_backtest(df, "sg", 105.0, keep_cash=False).orderBy("ts").collect()
    assert [r.value for r in lost][3:] == [150.0, 150.0, 120.0, 120.0]


def test_accuracy_counts_the_first_bar_as_a_miss(spark):
    df = spark.createDataFrame([("A", 1, 10.0, 10.0), ("A", 2, 12.0, 11.0), ("A", 3, 9.0, 12.0)], "symbol string, ts int, predicted double, actual double")
    r = indicators.accuracy(df).first()
    assert r.direction == pytest.approx(1 / 3) and r.hit_rate == pytest.approx(1 / 3) and r.mape == pytest.approx((0 + 1 / 11 + 3 / 12) / 3)
    assert r.correlation == pytest.approx(np.corrcoef([10, 12, 9], [10, 11, 12])[0, 1])


def test_smoothing_by_pandas(spark):
    import pandas as pd

    for n, width in ((6, 3), (20, 4), (33, 6), (60, 7)):
        closes = 50 + np.random.default_rng(n).normal(size=n).cumsum()
        trend = spark.createDataFrame([("A", 0.05)], "symbol string, trend double")
        got = [r.close for r in indicators.smoothed(series(spark, closes), trend).orderBy("ts").collect()]
        assert got == pytest.approx((pd.Series(closes).rolling(width, center=True, min_periods=1).mean() * 1.015).tolist())


def test_outliers_scale_their_distance(spark):
    df = spark.createDataFrame([("A", 1, 10.0, 14.0, 6.5, 12.0, 10.0)], "symbol string, ts int, open double, high double, low double, close double, current double")
    r = portfolio.tame_outliers(df, F.lit(0.9)).first()
    assert (r.open, round(r.high, 6), round(r.low, 6), r.close) == (10.0, 13.6, 6.85, 12.0)


def test_axis_steps_are_strict(spark):
    spans = [(-1.0, 1.0), (0.0, 1.0), (0.5, 0.1), (1.0, 0.5), (5.0, 1.0), (19.9, 2.0), (20.0, 5.0), (500.0, 100.0)]
    df = spark.createDataFrame(spans, "span double, want double")
    assert all(r.step == r.want for r in df.withColumn("step", parsing.axis_step(F.col("span"))).collect())


def test_request_bounds():
    assert parsing.check_request(" 600580 ", "x", "365", 1) == ("600580", "x", 365, 1)
    for args in (("", "x", 1, 1), ("a", " ", 1, 1), ("a", "x", 0, 1), ("a", "x", 366, 1), ("a", "x", 1, 11), ("a", "x", "1.5", 1), ("a", "x", None, 1)):
        with pytest.raises(ValueError):
            parsing.check_request(*args)


def test_wide_indexes_are_exact(spark):
    v = [1.0 if i in (0, 53, 54, 62) else -1.0 for i in range(63)]
    q = spark.createDataFrame([(v,)], "v array<double>").select("v", tokens.bits_to_index(F.col("v")).alias("t"))
    r = q.select("t", "v", F.transform(tokens.index_to_vector(F.col("t"), 63), lambda x: F.signum(x)).alias("back")).first()
    assert r.t == 1 + (1 << 53) + (1 << 54) + (1 << 62) and r.back == r.v


def test_sampling_filters():
    rng = np.random.default_rng(1)
    x = np.array([[2.0, 1.0, 0.0, -1.0]])
    assert predictor.sample_from(x, rng, greedy=True).tolist() == [0]
    drawn = lambda **o: set(predictor.sample_from(np.repeat(x, 4000, axis=0), rng, **o).tolist())
    assert drawn() == {0, 1, 2, 3} and drawn(top_k=2) == {0, 1} and drawn(top_p=0.5) == {0} and drawn(top_p=0.7) == {0, 1} and drawn(temperature=0.05) == {0}
    with pytest.raises(ValueError):
        predictor.sample_from(x, rng, temperature=0)


@pytest.mark.parametrize("n", [3, 8, 20])
def test_ring_buffer_equals_a_growing_list(n):
    """The windows that a model sees are the last ``max_context`` tokens, whatever the lengths."""
    seen = []

    class Model(predictor.TokenModel):
        def encode(self, values):
            return np.arange(values.shape[1])[None].repeat(len(values), 0), 100 + np.arange(values.shape[1])[None].repeat(len(values), 0)

        def first(self, pre, post):
            seen.append((pre[0].tolist(), post[0].tolist()))
            return np.eye(64)[(pre[:, -1] + 1) % 64] * 99

        def second(self, pre, post, token):
            return np.eye(200)[(token + 100) % 200] * 99

        def decode(self, pre, post):
            return pre.astype(float)

    out = predictor.autoregressive(Model(), np.zeros((2, n)), horizon=6, max_context=8, greedy=True)
    line = list(range(n))
    for window in seen:
        assert window == (line[-8:], [100 + t for t in line[-8:]])
        line.append(line[-1] + 1)
    assert out.shape == (2, 6) and out[0].tolist() == pytest.approx([x * 1e-5 for x in range(n, n + 6)])
    with pytest.raises(ValueError, match="same length"):
        predictor.token_predictor(Model())({"a": np.ones(3), "b": np.ones(4)}, 2)


def test_topk_dropout_by_hand(spark):
    """Three names, one held: bought on the day after its score, dropped when another is better, with costs."""
    score = {"A": [3, 1, 1, 1], "B": [1, 3, 3, 3], "C": [0, 0, 0, 0]}
    rows = [(n, d, 10.0, 10.0, float(s)) for n, x in score.items() for d, s in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts int, open double, close double, score double")
    got = portfolio.topk_dropout(df, topk=1, n_drop=1, hold=1, account=1000.0, min_cost=1.0).orderBy("ts").collect()
    shares = int(950 / (10 * 1.001))
    assert (got[0].names, got[0].value, got[1].names, got[1].turnover) == (0, 1000.0, 1, shares * 10.0) and got[1].value == pytest.approx(999.0)
    assert got[2].names == 1 and got[2].turnover > shares * 10 and got[2].cost == pytest.approx(940 * 0.0015 + 1.0) and got[3].turnover == 0
    kept = portfolio.topk_dropout(df, topk=1, n_drop=1, hold=5, account=1000.0, min_cost=1.0).orderBy("ts").collect()
    assert [r.turnover > 0 for r in kept] == [False, True, False, False]


def test_epoch_samples_are_uniform(spark):
    lengths = spark.createDataFrame([("A", 14), ("B", 4), ("C", 24)], "symbol string, n_rows long")
    rows = features.sample_pairs(lengths, 1, 3, 3000, 5).collect()
    assert len(rows) == 3000 and {r.symbol for r in rows} == {"A", "C"}
    assert all(0 <= r.start_index < {"A": 10, "C": 20}[r.symbol] for r in rows) and 800 < sum(r.symbol == "A" for r in rows) < 1200
    assert rows == features.sample_pairs(lengths, 1, 3, 3000, 5).collect() != features.sample_pairs(lengths, 2, 3, 3000, 5).collect()


def test_symbol_selection(spark, tmp_path):
    at = tmp_path / "u.csv"
    at.write_text("symbol,name,valid_from,valid_to\n" + "".join(f"S{i},n,2026-01-01,\n" for i in range(9)))
    u = files.universe(spark, str(at))
    assert [r.symbol for r in u.orderBy("ord").collect()] == [f"S{i}" for i in range(9)]
    assert [r.symbol for r in files.select_symbols(u, "s3, S1 s3").orderBy("ord").collect()] == ["S3", "S1"]
    assert sorted(r.symbol for r in files.select_symbols(u, shard=(1, 4)).collect()) == ["S3", "S4"]
    for args, said in ((("S1 X9 Y8", None), "X9, Y8"), (("S1", (0, 2)), "exclude"), ((" , ", None), "no symbols"), ((None, (4, 4)), "range")):
        with pytest.raises(ValueError, match=said):
            files.select_symbols(u, *args)
    at.write_text("symbol,name,valid_from,valid_to\nA,x,2026-01-01,\nB,y,2026-13-01,\n")
    with pytest.raises(ValueError, match="row 3"):
        files.universe(spark, str(at))


def test_feather_and_fingerprint(spark, tmp_path):
    import hashlib

    import pyarrow as pa
    from pyarrow import feather

    for i in range(2):
        feather.write_feather(pa.table({"open": [1.0 + i, 2.0], "close": [1.5, 2.5 + i]}), str(tmp_path / f"f{i}.feather"))
    df = files.feather(spark, str(tmp_path) + "/*.feather")
    assert sorted(map(tuple, df.collect())) == [(1.0, 1.5), (2.0, 2.5), (2.0, 1.5), (2.0, 3.5)] or df.count() == 4 and df.columns == ["open", "close"]
    digests = [f"f{i}.feather=" + hashlib.sha256((tmp_path / f"f{i}.feather").read_bytes()).hexdigest() for i in range(2)]
    r = files.data_fingerprint(spark, str(tmp_path) + "/*.feather").first()
    assert (r.fingerprint, r.names) == (hashlib.sha256("~".join(digests).encode()).hexdigest(), 2)


def test_validation_rejects_in_order(spark):
    good = series(spark, [3, 1, 2])
    assert [r.close for r in ql.validate(good).collect()] == [3.0, 1.0, 2.0]
    with pytest.raises(ValueError, match="missing columns: volume"):
        ql.validate(good.drop("volume"))
    with pytest.raises(ValueError, match="no candles"):
        ql.validate(good.limit(0))
    with pytest.raises(ValueError, match="duplicate: 2"):
        ql.validate(good.union(good.limit(1)).withColumn("volume", -F.col("volume")))
    with pytest.raises(ValueError, match="negative_volume"):
        ql.validate(good.withColumn("volume", F.when(F.col("close") < 2, -1.0).otherwise(1.0)))


def test_open_that_is_no_number(spark):
    df = series(spark, [3, 4]).withColumn("open", F.when(F.col("close") < 4, F.lit(float("nan"))).otherwise(F.lit(0.0)))
    assert [r.open for r in ql.fix_open(df).orderBy("ts").collect()] == [3.0, 3.0]


def test_forecast_stamps_are_checked(spark):
    wins = spark.createDataFrame([("A", "2024-01", DAY, [1.0, 2.0], [DAY + dt.timedelta(1), DAY + dt.timedelta(2)])], "symbol string, candidate_month string, forecast_origin date, context array<double>, targets array<date>")
    ahead = lambda k: lambda c, h: {s: (np.ones(h), [DAY + dt.timedelta(k + i) for i in range(h)]) for s in c}
    assert [r.reason_code for r in predictor.predict(wins, ahead(1), 2).collect()] == [None, None]
    assert [r.reason_code for r in predictor.predict(wins, ahead(2), 2).collect()] == ["invalid_model_timestamps"]


def test_layered_settings(tmp_path):
    from wickline import config

    (tmp_path / "a.json").write_text('{"data": {"window": 90, "clip": 5}, "model_paths": {"exp_name": "e1", "base_path": "/m", "save": "", "log": "x/{exp_name}"}}')
    (tmp_path / "b.json").write_text('{"data": {"clip": 3}}')
    got = config.load(str(tmp_path / "a.json"), str(tmp_path / "b.json"), templates={"save": "{base_path}/{exp_name}"})
    assert got["data"] == {"window": 90, "clip": 3} and (got["model_paths"]["save"], got["model_paths"]["log"]) == ("/m/e1", "x/e1")
    assert config.lookup(got, "data.clip") == 3 and config.lookup(got, "data.none.x", 7) == 7


def test_prediction_files(spark, tmp_path):
    from wickline import api

    df = series(spark, range(1, 31)).withColumn("ts", F.col("ts").cast("timestamp"))
    result = api.forecast(df, 10, 3)
    sinks.write_predictions(df, result, api.continuity(result), str(tmp_path / "p"))
    said = json.loads(spark.read.text(str(tmp_path / "p")).first()[0])
    assert said["input"]["price_range"]["high"] == {"min": 1.5, "max": 30.5} and said["input"]["rows"] == 30 and said["input"]["last_values"]["close"] == 30.0 and [p["predicted_close"] for p in said["predictions"]] == [10.0] * 3
    assert said["continuity"]["close_gap"] == 1.0
    sinks.write_splits(features.split_by_ratio(df, 0.5, 0.3), str(tmp_path / "s"))
    assert {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "s").glob("split=*")} == {"split=train": 15, "split=validation": 9, "split=test": 6}


def test_holiday_tables(spark):
    from wickline.functions import calendars

    start = spark.createDataFrame([(dt.date(2025, 9, 30),)], "d date")
    for days, want in ((calendars.HOLIDAYS_2025, dt.date(2025, 10, 8)), (calendars.OCTOBER_2025, dt.date(2025, 10, 9))):
        assert features.business_days(start, "d", 1, calendars.holidays(spark, days)).first().day == want


def test_predictor_registry():
    from wickline import api

    p = api.Predictors({"twice": lambda c, h: {}})
    assert p.available() == ["last_close", "twice"] and p.status() == {"available": True, "loaded": False, "predictor": None}
    p.load("twice")
    assert p.status()["predictor"] == "twice"
    with pytest.raises(ValueError):
        p.load("none")
