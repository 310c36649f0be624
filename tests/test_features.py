import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import features as X
from tallyfold.sources.files import synthetic_snapshot


@pytest.fixture(scope="module")
def snap(spark):
    return synthetic_snapshot(spark, 320).persist()


@pytest.fixture(scope="module")
def built(snap):
    return X.build(snap).orderBy("session").toPandas().set_index("session")


def test_registry_has_all_features(built):
    assert len(X.REGISTRY.features) == 81 and len(X.REGISTRY.groups) == 13
    assert [len(X.REGISTRY.names(g)) for g in X.REGISTRY.groups] == [5, 4, 2, 4, 2, 25, 8, 3, 4, 3, 4, 2, 15]
    assert list(built.columns[1:]) == X.REGISTRY.names()
    with pytest.raises(ValueError):
        X.REGISTRY.add("log_ret", "x", "", lambda: F.lit(1))
    with pytest.raises(ValueError):
        X.REGISTRY.without(["nothing"])


def test_only_the_past_is_seen(snap):
    row = X.look_ahead(snap, dt.date(2015, 9, 1), X.REGISTRY.without(["calendar"])).first()
    assert row["n_rows"] > 150 and row["n_different"] == 0


def test_scale_free_features_stay_and_others_move(snap, built):
    prices = ["open", "high", "low", "close", "qqq_close", "iwm_close", "dia_close"]
    scaled = X.build(
        snap.select(*((F.col(c) * 1.37).alias(c) if c in prices else F.col(c) for c in snap.columns))
    ).orderBy("session").toPandas().set_index("session")
    for f in X.REGISTRY.features:
        a, b = built[f.name].astype(float), scaled[f.name].astype(float)
        close = ((a - b).abs() <= 1e-9 * a.abs() + 1e-9) | (a.isna() & b.isna())
        assert close.all() == f.scale_free, f.name


def test_spread_is_one_session_late(spark):
    days = [dt.date(2015, 1, 5) + dt.timedelta(i) for i in range(60)]
    rows = [("A", d, 1.0, 4.0 if i == 40 else 3.0) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "symbol string, session date, dgs2 double, dgs10 double")
    r = X.Registry([f for f in X.REGISTRY.features if f.name == "YC_2Y10Y_change_1"])
    moved = [row["session"] for row in X.build(df, r).where("YC_2Y10Y_change_1 != 0").orderBy("session").collect()]
    assert moved == [days[41], days[42]]


def test_flags_and_warm_up(built):
    for c in ("vix_regime_high", "vix_regime_low", "is_monday", "is_month_end"):
        assert set(built[c]) <= {0, 1}
    assert built["Volatility_60"].isna().sum() == 60 and built["log_ret"].isna().sum() == 1
    assert (built["vix_regime_high"].iloc[:59] == 0).all()


def test_intraday_return_is_the_target_a_session_before(snap):
    both = X.build(
        snap, X.Registry([f for f in X.REGISTRY.features if f.name == "intraday_ret"])
    ).join(X.target_open_close(snap), ["symbol", "session"]).orderBy("session").toPandas()
    import numpy as np

    assert np.allclose(np.exp(both["intraday_ret"].iloc[1:]) - 1, both["target"].iloc[:-1])
    assert X.target_close_close(snap).where("target IS NULL").count() == 1
