"""Service functions and the command line."""

import datetime as dt
import os

import pytest

from wickline import __main__ as cli
from wickline import api
from wickline.sources import sinks


def test_load_and_forecast(spark, tmp_path):
    rows = "\n".join(f"{dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)},{i + 1},{i + 2},{i + 0.5},{i + 1.5},10" for i in range(30))
    (tmp_path / "a.csv").write_text(f"Date,Open,High,Low,Close,Volume\n{rows}\nbad,1,1,1,1,1\n")
    df, profile = api.load_data(spark, str(tmp_path / "a.csv"))
    p = profile.first()
    assert df.count() == 30 and p.label == "hours" and p.n_rows == 30
    head = {r.horizon_step: (r.predicted_close, r.actual_close) for r in api.forecast(df, 10, 5).collect()}
    assert head == {h: (10.5, 10.5 + h) for h in range(1, 6)}
    tail = api.forecast(df, 10, 5, anchor="tail").collect()
    assert {r.predicted_close for r in tail} == {30.5} and all(r.actual_close is None for r in tail)
    assert api.continuity(api.forecast(df, 10, 5)).first().close_gap == 1.0
    assert api.forecast(df, 31, 5).count() == 0
    with pytest.raises(ValueError):
        api.forecast(df, 10, 5, anchor="middle")
    assert [r["size"] for r in api.data_files(spark, str(tmp_path)).collect()][0].endswith("KB")


def test_made_stamps(spark, tmp_path):
    (tmp_path / "b.csv").write_text("open,high,low,close\n1,2,0.5,1.5\n2,3,1.5,2.5\n")
    df, _ = api.load_data(spark, str(tmp_path / "b.csv"))
    assert [r.ts for r in df.orderBy("ts").collect()] == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 1)]
    (tmp_path / "c.csv").write_text("open,close\n1,2\n")
    with pytest.raises(ValueError):
        api.load_data(spark, str(tmp_path / "c.csv"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_command_line(spark, tmp_path, capsys):
    cli.main(["list"])
    assert "window_metrics" in capsys.readouterr().out
    cli.main(["evaluate", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "run")])
    assert sinks.read_run(spark, str(tmp_path / "run"), "symbol_metrics").count() > 0
