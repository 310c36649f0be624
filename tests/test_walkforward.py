import datetime as dt
import json
import threading

import numpy as np
import plain_screen as P
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import features as X
from tallyfold.operators import learners as N
from tallyfold.operators import models as M
from tallyfold.operators import screening as S
from tallyfold.operators import slices
from tallyfold.operators import walkforward as V

FEATURES = ["a", "a2", "b", "c", "still"]
GROUPS = ["g1", "g1", "g1", "g2", "g2"]
SETTINGS = V.Settings(
    initial=300, step=20, retune_every=3, folds=(2, 50, 1), nested=(3, 60, 1, 40), least_calibration=(100, 10),
    replicates=200, per_group=2, window=30
)
CANDIDATES = M.candidates({"logistic": {"C": [0.1, 1.0]}, "forest": {"trees": [5], "depth": [2]}}, [0.0, 0.5])


def series(symbol, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 1] = x[:, 0] + 0.05 * x[:, 1]
    target = 0.01 * x[:, 0] + 0.004 * rng.normal(size=n)
    return [
        (symbol, dt.date(2000, 1, 3) + dt.timedelta(i), i, float(t), float(np.log1p(t) / 0.01), 1e-5, *map(float, v), 1.0) for i,
        (t, v) in enumerate(zip(target, x))
    ]


SCHEMA = "symbol string, session date, pos bigint, target double, z double, carry double, " + ", ".join(f"{f} double" for f in FEATURES)


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(series("A", 395, 1) + series("B", 340, 2) + series("short", 200, 3), SCHEMA)


@pytest.fixture(scope="module")
def walk(spark, raw, tmp_path_factory):
    rows = V.prepared(raw, FEATURES, SETTINGS.window).persist()
    path = str(tmp_path_factory.mktemp("walk"))
    return rows, V.run(rows, FEATURES, GROUPS, CANDIDATES, SETTINGS, path)


def test_schedule(spark, walk):
    rows, _ = walk
    steps = {(r["symbol"], r["step"]): r for r in V.schedule(rows, SETTINGS).collect()}
    assert sorted(steps) == [("A", k) for k in range(5)] + [("B", k) for k in range(2)]
    assert steps["A", 4]["train_hi"] == 380 and steps["A", 4]["test_hi"] == 395 and steps["A", 4]["retune"] == 3 and steps["A", 4]["train_lo"] == 0
    rolling = V.schedule(rows, V.Settings(initial=300, step=20, rolling=120)).where("symbol = 'A'").orderBy("step").collect()
    assert [(r["train_lo"], r["train_hi"]) for r in rolling][:2] == [(180, 300), (200, 320)]
    folds = V.inner_folds(V.schedule(rows, SETTINGS), SETTINGS).where("symbol = 'A' AND step = 3").orderBy("fold").collect()
    assert [tuple(r)[3:] for r in folds] == [(0, 259, 260, 310), (0, 309, 310, 360)]
    assert V.schedule(rows, V.Settings(initial=300, step=20, max_steps=2)).where("symbol = 'A'").count() == 2


def test_tables_of_a_walk(walk):
    _, out = walk
    diag = out["candidate_diagnostics"].collect()
    assert len(diag) == len(CANDIDATES) * 3 and {(r["symbol"], r["step"]) for r in diag} == {("A", 0), ("A", 3), ("B", 0)}
    assert all(r["standard_error"] > 0 and r["train_minus_oos_score"] == pytest.approx(r["in_sample_score"] - r["score"]) for r in diag if not r["degenerate"])
    log = out["selection_log"].collect()
    assert all(r["n_candidates"] == len(CANDIDATES) and r["chosen_score"] >= r["best_score"] - r["se_best"] and not r["baseline_selected"] for r in log)
    p = out["oos_predictions"].collect()
    assert len(p) == 95 + 40 and all(
        abs(r["p_short"] + r["p_flat"] + r["p_long"] - 1) < 1e-9 and abs(r["raw_short"] + r["raw_flat"] + r["raw_long"] - 1) < 1e-9 for r in p
    )
    assert any(abs(r["p_long"] - r["raw_long"]) > 1e-3 for r in p) and not any(r["calibration_skipped"] for r in p)
    assert all(len(set(r["features"]) & {"a", "a2"}) == 1 and "still" not in r["features"] for r in p)  # twins are one cluster, what does not vary goes
    assert np.mean([r["label"] * r["mu"] > 0 for r in p if r["label"]]) > 0.9
    stable = {(r["symbol"], r["feature"]): r["steps_selected"] for r in out["feature_stability"].collect()}
    assert [stable.get((s, "a"), 0) + stable.get((s, "a2"), 0) for s in "AB"] == [5, 2]
    cal = out["calibration_diagnostics"].collect()
    assert len(cal) == 3 * 2 * 3 and {r["family"] for r in cal} == {"logistic", "forest"} and all(
        r["n_oof"] in (120, 180) and r["brier_skill"] > 0 for r in cal
    )


def test_stability_needs_no_model(walk):
    rows, out = walk
    got = V.stability(V.screens(rows, FEATURES, GROUPS, SETTINGS))
    assert got.exceptAll(out["feature_stability"].select(*got.columns)).count() == 0


def test_screens_of_slices_are_those_of_each_alone(spark, walk):
    """Against the screen on arrays: expanding, rolling and overlapping slices, one shorter than a window, one of a still feature's first change."""
    rows, _ = walk
    ranges = spark.createDataFrame(
        [("A", k, lo, hi) for k, (lo, hi) in enumerate([(0, 300), (0, 320), (17, 80), (100, 395), (50, 71), (0, 1), (200, 233)])] + [("B", 0, 5, 340)],
        "symbol string, slice int, train_lo bigint, train_hi bigint"
    )
    got = {}
    for r in slices.screens(rows, ranges, FEATURES, GROUPS, SETTINGS.window, 2, SETTINGS.cut, SETTINGS.cap).orderBy("rank").collect():
        got.setdefault((r["symbol"], r["slice"]), []).append((FEATURES.index(r["feature"]), r["ic"]))
    for r in ranges.collect():
        d = rows.where(f"symbol = '{r['symbol']}' AND pos >= {r['train_lo']} AND pos < {r['train_hi']}").orderBy("pos").toPandas()
        x = np.array(d["x"].tolist())
        rho = np.array([v if v is not None else [np.nan] * len(FEATURES) for v in d["rho"]], float)
        rho[: SETTINGS.window - 1] = np.nan
        chosen, ic = P.screen(x, rho, GROUPS, 2, SETTINGS.cut, SETTINGS.cap)
        assert got.get((r["symbol"], r["slice"]), []) == [(c, pytest.approx(ic[c], abs=1e-12)) for c in chosen]


def test_later_rows_change_nothing(spark, raw, walk):
    rows, out = walk
    cut = raw.where("symbol = 'A' AND pos < 340").withColumn(
        "target", F.when(F.col("pos") >= 320, -F.col("target")).otherwise(F.col("target"))
    ).withColumn("z", F.when(F.col("pos") >= 320, -F.col("z")).otherwise(F.col("z")))
    chosen = out["selection_log"]
    again = V.predictions(V.prepared(cut, FEATURES, SETTINGS.window), chosen, FEATURES, GROUPS, CANDIDATES, SETTINGS).where("step = 0")
    columns = ["session", *V.RAW, *V.CALIBRATED, "mu", "position"]
    assert again.select(*columns).exceptAll(out["oos_predictions"].where("symbol = 'A' AND step = 0").select(*columns)).count() == 0


def test_a_slice_too_small_is_not_calibrated(walk):
    rows, _ = walk
    pdf = rows.where("symbol = 'B'").toPandas()
    assert V.Slice(pdf, SETTINGS, 1).fit("logistic", {}).curves is not None
    few = V.Slice(pdf, V.Settings(nested=(3, 60, 1, 40), least_calibration=(200, 10), window=30), 1).fit("logistic", {})
    assert few.curves is None and few.log()["calibration_skipped"] and few.log()["n_oof"] == 180
    each = V.Slice(pdf, V.Settings(nested=(3, 60, 1, 40), least_calibration=(100, 90), window=30), 1).fit("logistic", {})
    assert each.curves is None
    with pytest.raises(ValueError):
        V.checked(CANDIDATES, V.Settings(spec="close_to_close"))


def test_the_choice(spark):
    c = M.candidates({"logistic": {"C": [0.1]}, "forest": {"depth": [3]}}, [0.0, 0.5])
    names = V.table_of(spark, c)
    rows = [
        ("near", k, s, 0.2, False) for k, s in enumerate((0.1, 0.45, 0.45, 0.6, 0.5))
    ] + [("far", k, s, 0.01, False) for k, s in enumerate((0.1, 0.45, 0.45, 0.6, 0.6))] + [("none", k, 0.3, None, True) for k in range(5)]
    d = spark.createDataFrame(
        [(g, 0, k, s, e, x) for g, k, s, e, x in rows],
        "symbol string, step int, candidate int, score double, standard_error double, degenerate boolean"
    ).join(names, "candidate")
    got = {r["symbol"]: r for r in V.selection(d).collect()}
    assert c[got["near"]["candidate"]] == M.Candidate("logistic", (("C", 0.1),), 0.5)  # of equal ones the larger margin
    assert c[got["far"]["candidate"]].family == "forest" and c[got["far"]["candidate"]].delta == 0.5 and got["far"]["n_eligible"] == 2
    assert got["none"]["candidate"] == 0 and got["none"]["reason"] == "all candidates degenerate" and got["none"]["n_degenerate"] == 5


def test_batch_skips_and_goes_on(spark, raw, tmp_path):
    registry = X.Registry([X.Feature(f, g, "", lambda: None) for f, g in zip(FEATURES, GROUPS)])
    base = {
        "settings": {"initial": 300, "step": 20, "retune_every": 6, "folds": [2, 50, 1], "replicates": 50, "window": 30, "calibrator": None},
        "models": {"logistic": {"C": [0.1]}}
    }
    overlays = {"plain": {}, "smoke": {"mode": "smoke"}, "rolling": {"settings": {"rolling": 250}}, "bad": {"exclude_groups": ["nothing"]}}
    rows_of = lambda features, s: V.prepared(raw, features, s.window).persist()
    told = V.run_batch(rows_of, registry, base, overlays, str(tmp_path), workers=2)
    assert told["plain"] == told["smoke"] == told["rolling"] == "done" and told["bad"].startswith("ValueError")
    assert json.loads((tmp_path / "rolling" / "run_manifest.json").read_text())["config"]["settings"]["rolling"] == 250
    assert spark.read.parquet(str(tmp_path / "smoke" / "oos_predictions")).select("step").distinct().count() == 3
    again = V.run_batch(rows_of, registry, base, {"plain": {}}, str(tmp_path))
    assert again == {"plain": "skipped"}


def test_overlays_run_side_by_side(spark, raw, tmp_path, monkeypatch):
    """Two overlays wait for each other inside their runs, which only ends if both run at one time; the third fails alone."""
    registry = X.Registry([X.Feature(f, g, "", lambda: None) for f, g in zip(FEATURES, GROUPS)])
    both, pools = threading.Barrier(2, timeout=120), {}

    def run(rows, features, groups, candidates, s, path):
        both.wait()
        pools[path.rsplit("/", 1)[1]] = (spark.sparkContext.getLocalProperty("spark.scheduler.pool"), rows.count())

    monkeypatch.setattr(V, "run", run)
    base = {"models": {"logistic": {"C": [0.1]}}}
    told = V.run_batch(lambda f, s: raw, registry, base, {"bad": {"exclude_groups": ["nothing"]}, "a": {}, "b": {}}, str(tmp_path), workers=2)
    assert told["a"] == told["b"] == "done" and told["bad"].startswith("ValueError") and list(told) == ["bad", "a", "b"]
    assert pools == {"a": ("a", raw.count()), "b": ("b", raw.count())}
    assert json.loads((tmp_path / "batch.json").read_text()) == told and V.run_batch(None, registry, base, {}, str(tmp_path / "none")) == {}


# ---------------------------------------------------------------- on arrays


def test_learners():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.5, 2, np.where(x[:, 0] < -0.5, 0, 1))
    for e, least in (
        (N.Logistic(1.0), 0.85), (N.Logistic(1.0, True), 0.8), (N.Forest(30, 5, 5), 0.85),
        (N.Boosted(40, 0.1, leaves=7, leaf=10), 0.9), (N.Boosted(40, 0.1, depth=3, leaf=1), 0.9)
    ):
        p = e.fit(x[:400], y[:400], np.random.default_rng(1)).predict(x[400:])
        assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y[400:]).mean() > least
        two = e.fit(x[:400], np.where(y[:400] == 1, 0, y[:400]), np.random.default_rng(1)).predict(x[400:])
        assert (two[:, 1] < 1e-9).all()
    assert np.allclose(N.Prior().fit(x, y, None).predict(x[:2]), np.bincount(y) / 600)
    with pytest.raises(ValueError):
        N.estimator("nothing", {})


def test_logistic_is_at_its_minimum():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 3)), rng.integers(0, 3, 200)
    m = N.Logistic(0.5).fit(x, y, None)
    x1 = np.hstack([(x - m.mean) / m.sd, np.ones((200, 1))])
    loss = lambda b: -0.5 * np.log(N.softmax(x1 @ b.T)[np.arange(200), y]).sum() + 0.5 * (b[:, :-1] ** 2).sum()
    assert all(loss(m.b) <= loss(m.b + 0.01 * rng.normal(size=m.b.shape)) for _ in range(50))


def test_curves():
    rng = np.random.default_rng(3)
    p = rng.dirichlet([1, 1, 1], 500)
    y = np.array([rng.choice(3, p=q) for q in p])
    for name in N.CURVES:
        out = N.curves(name).fit(p, y).transform(p)
        assert np.allclose(out.sum(1), 1) and N.brier(out, y) < N.brier(p, y) + 0.01
    xs, values = N.IsotonicCurves().fit(p, y).curves[0]
    assert (np.diff(values) >= -1e-12).all() and len(xs) == len(values)
    assert np.allclose(N.SigmoidCurves().fit(p, np.zeros(500, int)).transform(p), p)
    with pytest.raises(ValueError):
        N.curves("nothing")


def test_ranks_and_rolling_correlations():
    rng = np.random.default_rng(4)
    x, z = rng.integers(0, 4, 90).astype(float), rng.normal(size=90)
    brute = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    got = P.rolling_rank_correlation(x, z, 20, chunk=7)
    assert np.isnan(got[:19]).all()
    for end in range(19, 90):
        assert got[end] == pytest.approx(np.corrcoef(brute(x[end - 19 : end + 1]), brute(z[end - 19 : end + 1]))[0, 1], abs=1e-12)
    assert np.isnan(P.rolling_rank_correlation(np.ones(40), z[:40], 20)).all() and len(P.rolling_rank_correlation(x[:5], z[:5], 20)) == 5


def brute_linkage(d, cut):
    clusters = [[i] for i in range(len(d))]
    while len(clusters) > 1:
        best, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if best > cut:
            break
        clusters[i] += clusters.pop(j)
    return {frozenset(c) for c in clusters}


def test_linkage():
    rng = np.random.default_rng(5)
    for n in (1, 2, 12, 30):
        d = rng.random((n, n))
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        of = S.average_linkage(d, 0.4)
        assert {frozenset(np.flatnonzero(np.array(of) == k).tolist()) for k in set(of)} == brute_linkage(d, 0.4)
    assert S.average_linkage(np.zeros((0, 0)), 0.2) == []


def test_screen_of_a_series(spark, raw):
    got = S.screen(raw.where("symbol = 'A'"), FEATURES, dict(zip(FEATURES, GROUPS)), window=30, per_group=2).orderBy("rank").collect()
    rows = raw.where("symbol = 'A'").orderBy("pos").toPandas()
    ic = {f: abs(np.nanmean(P.rolling_rank_correlation(rows[f].to_numpy(), rows["z"].to_numpy(), 30))) for f in FEATURES[:4]}
    first, second = sorted(["a", "a2"], key=lambda f: -ic[f])
    # the two best of g1 are twins, of which the better one stays; g2 has one that varies
    assert [r["feature"] for r in got] == [first, "c"] and got[0]["ic"] == pytest.approx(ic[first])


def test_bootstrap_error():
    x = np.random.default_rng(6).normal(0.05, 1.0, 2000)
    assert N.bootstrap_error(x, 500, 5.0, 1) == pytest.approx(np.sqrt(252 / 2000), rel=0.15)
    assert np.isnan(N.sharpe(np.ones(5))) and N.sharpe(np.array([1.0, 2.0, 3.0])) == pytest.approx(2 * np.sqrt(252))
