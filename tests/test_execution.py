import pytest
from conftest import weekdays
from pyspark.sql import functions as F

from tallyfold.operators import execution as E
from tallyfold.operators import performance as P


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [("A", d, *(float(c[i]) for c in columns.values())) for i, d in enumerate(weekdays(n))]
    return spark.createDataFrame(rows, "symbol string, session date, " + ", ".join(f"{c} double" for c in columns))


def values(df, c):
    return [r[c] for r in df.orderBy("session").select(c).collect()]


def test_open_close_cost(spark):
    d = frame(spark, w=[1, 1, 0], r=[0.01] * 3, f=[0] * 3).withColumn("net", E.open_close_net(F.col("w"), F.col("r"), F.col("f"), 2.0))
    assert values(d, "net") == pytest.approx([0.0096, 0.0096, 0.0])


def test_close_close_cost_charges_both_ends(spark):
    d = E.close_close_net(frame(spark, w=[1, 1, 1], r=[0.01] * 3, carry=[0] * 3), "w", "r", "carry", 2.0)
    assert values(d, "net") == pytest.approx([0.0098, 0.01, 0.0098])


@pytest.mark.parametrize(("mu", "want"), [([3e-4, -1e-4], [1, 1]), ([3e-4, -3e-4], [1, -1]), ([1e-4, 1e-4], [0, 0])])
def test_one_step_rule(spark, mu, want):
    d = E.one_step_positions(frame(spark, mu=mu, carry=[0, 0]), "mu", "carry", 2.0, borrow_bps=0.0)
    assert values(d, "position") == want


def test_one_step_rule_takes_no_margin(spark):
    with pytest.raises(ValueError):
        E.one_step_positions(frame(spark, mu=[0], carry=[0]), "mu", "carry", 2.0, delta=0.1)


def test_borrow_over_a_weekend(spark):
    d = frame(spark, w=[0, 0, 0, 0, -1, -1], r=[0] * 6, carry=[0] * 6)  # the fifth weekday is a Friday
    net = values(E.close_close_net(d, "w", "r", "carry", 0.0, borrow_bps=365.0), "net")
    assert net[4] == pytest.approx(-3 * 1e-4) and net[5] == pytest.approx(-1e-4)


def test_band(spark):
    c = 2 * 2e-4
    d = frame(spark, mu=[c + 1e-5, c + 3e-5, -c - 3e-5], f=[2e-5] * 3)
    assert values(d.withColumn("w", E.threshold_positions(F.col("mu"), E.no_trade_band(2.0, F.col("f")))), "w") == [0, 1, -1]


def test_cash_accrues_once_and_late(spark):
    d = frame(spark, dgs3mo=[0, 3.65, 0, 0, 0]).withColumn("rf", E.cash_accrual())
    assert values(d, "rf") == pytest.approx([0, 0, 0.0365 / 365, 0, 0])


def test_specs():
    assert E.get_spec("close_to_close", borrow_bps=10.0).borrow_bps == 10.0
    for bad in (("nothing", {}), ("open_to_close", {"borrow_bps": 1.0})):
        with pytest.raises(ValueError):
            E.get_spec(bad[0], **bad[1])


def test_identities(spark):
    d = frame(spark, w=[1, -1, 0, 1, -1, 0, 1], r=[0.01, 0.02, -0.01, 0.03, -0.02, 0.01, -0.01], f=[1e-4] * 7)
    row = d.agg(
        *P.decomposition(F.col("w"), F.col("r"), F.col("f"), 2.0),
        F.avg(E.open_close_net(F.col("w"), F.col("r"), F.col("f"), 2.0) - E.open_close_net(F.lit(1.0), F.col("r"), F.col("f"), 2.0)).alias("gap"),
        P.breakeven_bps(F.col("w"), F.col("r"), F.col("f")).alias("c")
    ).first()
    assert row["ann_net_excess_vs_always_long"] == pytest.approx(252 * row["gap"])
    assert d.agg(F.avg(E.open_close_net(F.col("w"), F.col("r"), F.col("f"), row["c"]))).first()[0] == pytest.approx(0, abs=1e-12)


def test_performance_of_cash_has_no_sharpe(spark):
    d = frame(spark, excess=[0] * 5, total=[0.001] * 5, weight=[0] * 5)
    row = P.performance(d, ["symbol"]).first()
    assert row["sharpe_excess"] is None and row["calmar"] is None and row["participation_rate"] == 0 and row["terminal_wealth"] == pytest.approx(1.001**5)
