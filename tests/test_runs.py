import numpy as np
from pyspark.sql import functions as F

from tallyfold.operators import inference as I
from tallyfold.operators import runs as R

SCHEMA = "run string, spec string, session int, model string, weight double, net double, own double, cash double"


def made(spark):
    rng = np.random.default_rng(4)
    own = rng.normal(0.0, 0.01, 400)
    rows = []
    for run, spec, first, w in (("P1", "o", 0, 1.0), ("E10", "o", 0, -1.0), ("E2", "o", 300, 0.5), ("E3", "c", 0, 1.0), ("E5", "o", 0, 0.0)):
        noise = rng.normal(0.002 if run == "P1" else 0.0, 0.004, 400) if w else np.zeros(400)
        rows += [(run, spec, i, "ab"[i % 2], w, float(w * own[i] + noise[i]), float(own[i]), None if i == 7 else 0.0001) for i in range(first, 400)]
    return spark.createDataFrame(rows, SCHEMA)


def test_runs_come_in_order_and_are_paired_on_shared_sessions(spark):
    runs = made(spark)
    got = {r["run"]: r for r in R.comparison(runs, "P1", 250, 200).collect()}
    assert sorted(got, key=lambda k: got[k]["place"]) == ["P1", "E2", "E3", "E5", "E10"]
    assert got["E2"]["n_shared"] == 100 and got["E2"]["diff"] is None and got["E2"]["diff_lo"] is None  # too few to compare
    assert got["E3"]["n_shared"] is None and got["P1"]["n_shared"] is None  # another specification; the base itself
    assert got["E10"]["n_shared"] == 400 and got["E10"]["diff_lo"] < got["E10"]["diff"] < got["E10"]["diff_hi"]
    assert got["E5"]["diff"] is None and got["E5"]["n_active"] == 0 and got["P1"]["models_selected"] == 2
    pdf = runs.toPandas()
    for run, r in got.items():
        own = pdf[pdf["run"] == run]
        assert abs(r["terminal_wealth"] - (1 + own["net"] + own["cash"].fillna(0)).prod()) < 1e-9 and r["oos_sessions"] == len(own)


def test_paired_draws_equal_drawn_rows(spark):
    rows = R.shared_rows(made(spark), "P1")
    drawn = R.paired_draws(rows, {"d": I.moment_sharpe("x") - I.moment_sharpe("y")}, 0, 20).toPandas().set_index(["run", "rep"])["d"]
    pdf = rows.toPandas().sort_values("session")
    for run, n in (("E10", 400), ("E2", 100)):
        own, cuts = pdf[pdf["run"] == run], I.segments(spark, n, 20).toPandas()
        for rep, part in cuts.groupby("rep"):
            at = np.concatenate([(s + np.arange(k)) % n for s, k in zip(part["start"], part["length"])])
            x, y = own["x"].to_numpy()[at], own["y"].to_numpy()[at]
            want = (x.mean() / x.std(ddof=1) - y.mean() / y.std(ddof=1)) * np.sqrt(252)
            assert abs(drawn[run, rep] - want) < 1e-8
    assert R.paired_draws(rows, {"d": I.moment_mean("x")}, 1000, 20).count() == 0


def test_the_verdict(spark):
    got = {r["run"]: r for r in R.evaluation(made(spark), 200).collect()}
    assert got["E5"]["verdict"] == R.NO_POSITION and got["P1"]["verdict"] == R.SUPPORTED and got["E10"]["verdict"] == R.UNSUPPORTED
    assert R.evaluation(made(spark).limit(0), 10).count() == 0
    d = spark.createDataFrame([(0.5, 0.1, None), (0.5, -0.1, 0.1), (0.0, None, None)], "p double, a double, b double")
    told = [r["v"] for r in d.select(R.verdict(F.col("p"), F.col("a"), F.col("b")).alias("v")).collect()]
    assert told == [R.UNSUPPORTED, R.UNSUPPORTED, R.NO_POSITION]
