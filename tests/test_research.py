import json
import math

import numpy as np
import pandas as pd
import pytest
from conftest import DATA, weekdays
from pyspark.sql import functions as F

from tallyfold.functions import scan
from tallyfold.functions.quantiles import expanding_quantiles
from tallyfold.functions.smoothing import smooth
from tallyfold.operators import audit as A
from tallyfold.operators import calibration as K
from tallyfold.operators import inference as I
from tallyfold.operators import labels as L
from tallyfold.operators import models as M
from tallyfold.operators import screening as S
from tallyfold.operators import text as T
from tallyfold.plans import research_queries as R
from tallyfold.plans.catalog import QUERIES
from tallyfold.sources import files


def test_fold_geometry():
    folds = list(L.time_series_split(1000, 5, 100, 1))
    assert [f[1] for f in folds] == [499, 599, 699, 799, 899] and all(f[1] < f[2] for f in folds)
    with pytest.raises(ValueError):
        list(L.time_series_split(100, 5, 20))
    steps = L.outer_steps(1030, 1000, 21, 12)
    assert [s["test_hi"] for s in steps] == [1021, 1030] and [s["retune"] for s in steps] == [1, 0]


def test_labels_and_ties(spark):
    d = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, None)], "z double")
    assert [r[0] for r in d.select(L.label(F.col("z"), F.lit(-1.0), F.lit(1.0))).collect()] == [-1, 0, 1, None]
    assert d.select(L.label(F.col("z"), F.lit(0.0), F.lit(0.0))).collect()[1][0] == 1


def test_thresholds_of_a_step_ignore_later_rows(spark):
    rows = [("A", i, float(i)) for i in range(60)]
    t = {r["step"]: r for r in L.step_thresholds(spark.createDataFrame(rows, "symbol string, pos bigint, z double"), 20, 10).collect()}
    assert sorted(t) == [0, 1, 2, 3] and t[0]["n_train"] == 20 and t[2]["q_hi"] == pytest.approx(0.75 * 39)


def test_rolling_spearman_against_ranks(spark):
    rng = np.random.default_rng(3)
    x, z = rng.integers(0, 5, 100).astype(float), rng.normal(size=100)
    long = spark.createDataFrame(
        [("A", "f", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, z))],
        "symbol string, feature string, pos bigint, x double, z double"
    )
    got = {r["pos"]: r["rho"] for r in S.rolling_spearman(long, 30).collect()}

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert sorted(got) == list(range(29, 100))
    for end in (29, 60, 99):
        assert got[end] == pytest.approx(np.corrcoef(ranks(x[end - 29 : end + 1]), ranks(z[end - 29 : end + 1]))[0, 1], abs=1e-12)


def test_ranges_of_a_series(spark):
    rng = np.random.default_rng(8)
    series = {("A", "f"): 100, ("A", "g"): 29, ("B", "f"): 61}
    data = {k: (rng.integers(0, 4, n).astype(float), rng.normal(size=n)) for k, n in series.items()}
    data["B", "g"] = (np.ones(70), rng.normal(size=70))
    rows = [(*k, i, float(a), float(b)) for k, (x, z) in data.items() for i, (a, b) in enumerate(zip(x, z))]
    long = spark.createDataFrame(rows, "symbol string, feature string, pos bigint, x double, z double").repartition(6)
    for block in (1, 7, 64, 1000):
        got = {(r["symbol"], r["feature"], r["pos"]): r["rho"] for r in S.rolling_spearman(long, 30, block=block).collect()}
        assert len(got) == 71 + 32 + 41
        for (s, f), (x, z) in data.items():
            want = pd.Series([pd.Series(x[e - 29 : e + 1]).rank().corr(pd.Series(z[e - 29 : e + 1]).rank()) for e in range(29, len(x))])
            for e, v in zip(range(29, len(x)), want):
                assert (got[s, f, e] is None) == (v != v) and (v != v or got[s, f, e] == pytest.approx(v, abs=1e-12))


def test_co_moments_merge(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 4)) * [1, 1e-3, 5, 0] + [1e6, 0, -3, 7]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 2] += 0.5 * np.nan_to_num(x[:, 1]) * 1e3
    rows = [("A" if i % 3 else "B", *(None if v != v else float(v) for v in r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, a double, b double, c double, d double").repartition(5)
    got = {(r["symbol"], r["a"], r["b"]): r["corr"] for r in S.correlation_pairs(df, list("abcd")).collect()}
    assert len(got) == 12
    for s in "AB":
        want = pd.DataFrame([r[1:] for r in rows if r[0] == s], columns=list("abcd"), dtype=float).corr()
        for i, j in ((0, 1), (0, 2), (1, 2)):
            assert got[s, "abcd"[i], "abcd"[j]] == pytest.approx(want.iloc[i, j], abs=1e-7)
        assert got[s, "a", "d"] is None


def test_smoothing_matches_the_recursion(spark):
    rows = [("A", d, v) for d, v in zip(weekdays(30), (np.arange(30.0) ** 1.5).tolist())]
    out = smooth(spark.createDataFrame(rows, "symbol string, session date, x double"), {"y": ("x", 0.3, 3)}).orderBy("session").collect()
    y = rows[0][2]
    for i, r in enumerate(out):
        y = y if i == 0 else 0.7 * y + 0.3 * rows[i][2]
        assert (r["y"] is None or math.isnan(r["y"])) if i < 2 else r["y"] == pytest.approx(y)


def test_paired_bootstrap_is_tighter(spark):
    rng = np.random.default_rng(1)
    common = rng.normal(size=300)
    d = spark.createDataFrame(
        [(i, float(c), float(c + e)) for i, (c, e) in enumerate(zip(common, rng.normal(scale=0.1, size=300)))],
        "idx bigint, x double, y double"
    )
    mean = {"d": I.moment_mean("x") - I.moment_mean("y"), "x": I.moment_mean("x")}
    r = I.draws(d, 300, I.moments("x", "y"), mean, 60)
    assert I.interval(r, "d").first()["se"] < I.interval(r, "x").first()["se"]
    parts = I.segments(spark, 50, 20)
    assert parts.agg(F.sum("length")).first()[0] == 1000 and parts.where("start < 0 OR start >= 50 OR length < 1").count() == 0


def test_replicates_by_their_places(spark):
    rng = np.random.default_rng(2)
    n, reps = 300, 25
    x, y = rng.normal(size=n), rng.normal(size=n)
    x[7] = np.nan
    d = spark.createDataFrame([(i, None if a != a else float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "idx bigint, x double, y double")
    stats = {"sharpe": I.moment_sharpe("y"), "slope": I.moment_slope("x", "y"), "mean": I.moment_mean("x", 252.0)}
    got = {r["rep"]: r for r in I.draws(d, n, I.moments("x", "y"), stats, reps, 8.0).collect()}
    places = {}
    for r in I.segments(spark, n, reps, 8.0).orderBy("rep", "at").collect():
        places.setdefault(r["rep"], []).extend((r["start"] + k) % n for k in range(r["length"]))
    assert sorted(got) == sorted(places) == list(range(reps))
    for rep, at in places.items():
        assert len(at) == n
        a, b = x[at], y[at]
        known = ~np.isnan(a)
        assert got[rep]["sharpe"] == pytest.approx(b.mean() / b.std(ddof=1) * np.sqrt(252))
        assert got[rep]["mean"] == pytest.approx(252 * a[known].mean())
        assert got[rep]["slope"] == pytest.approx(np.cov(a[known], b[known])[0, 1] / b[known].var(ddof=1))


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_scans_of_blocks(spark, monkeypatch, levels):
    monkeypatch.setattr(scan, "BLOCK", 4)
    rng = np.random.default_rng(4)
    maps = {s: rng.integers(0, 3, (n, 3)) for s, n in (("a", 1), ("b", 50), ("c", 33))}
    rows = [(s, i, "x", tuple(map(int, m))) for s, ms in maps.items() for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "k string, at bigint, other string, m struct<u: int, v: int, w: int>").repartition(5)
    pick = lambda m, s: f"CASE {s} WHEN 0 THEN {m}.u WHEN 1 THEN {m}.v ELSE {m}.w END"
    compose = lambda f, g: "struct(" + ", ".join(f"{pick(g, f'{f}.{k}')} AS {k}" for k in "uvw") + ")"
    got = {(r["k"], r["at"]): r["state"] for r in scan.scan(df, ["k"], "at", "1", compose, pick, levels=levels).collect()}
    for s, ms in maps.items():
        state = 1
        for i, m in enumerate(ms):
            state = int(m[state])
            assert got[s, i] == state
    assert len(got) == 84


def test_smoothing_of_gaps_and_of_means(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 8)
    rng = np.random.default_rng(9)
    x = pd.Series(np.where(rng.random(90) < 0.3, np.nan, rng.normal(size=90)))
    rows = [("A", d, None if v != v else float(v)) for d, v in zip(weekdays(90), x)]
    out = smooth(spark.createDataFrame(rows, "symbol string, session date, x double"), {"a": ("x", 0.3, 1), "b": ("x", 0.1, 5), "c": ("a - b", 0.5, 2)})
    got = out.orderBy("session").toPandas()
    a, b = (x.ewm(alpha=q, min_periods=k, adjust=False).mean() for q, k in ((0.3, 1), (0.1, 5)))
    for name, want in (("a", a), ("b", b), ("c", (a - b).ewm(alpha=0.5, min_periods=2, adjust=False).mean())):
        assert np.allclose(got[name].to_numpy(float), want.to_numpy(float), equal_nan=True), name


def test_parametric_helpers():
    assert I.expected_max_sharpe(1, 0.1) == 0 and 0.2 < I.expected_max_sharpe(100, 0.1) < 0.3


def plain_block_length(x):
    x = np.asarray(x, float)
    n = len(x)
    if n < 8 or not np.var(x):
        return 1.0
    d = x - x.mean()
    k_n, m_max = max(5, math.ceil(math.log10(n))), math.ceil(math.sqrt(n)) + max(5, math.ceil(math.log10(n)))
    cov = np.array([(d[: n - k] * d[k:]).sum() / n for k in range(min(m_max + k_n, n - 1) + 1)])
    small = np.abs(cov[1:] / cov[0]) < 2 * math.sqrt(math.log10(n) / n)
    m = next((i for i in range(len(small) - k_n + 1) if small[i : i + k_n].all()), None)
    if m is None:
        big = np.flatnonzero(~small)
        m = int(big[-1]) + 1 if len(big) else 1
    top = min(2 * max(m, 1), m_max, len(cov) - 1)
    k = np.arange(1, top + 1)
    window = np.clip(2 * (1 - k / top), 0, 1)
    g = 2 * (window * k * cov[1 : top + 1]).sum()
    spectrum = cov[0] + 2 * (window * cov[1 : top + 1]).sum()
    if spectrum == 0:
        return 1.0
    best = (2 * g * g / (2 * spectrum * spectrum)) ** (1 / 3) * n ** (1 / 3)
    return float(min(max(best, 1.0), math.ceil(min(3 * math.sqrt(n), n / 3))))


def test_block_lengths_of_many_series(spark):
    rng = np.random.default_rng(0)
    kinds = {"one": np.ones(50), "short": rng.normal(size=7), "white": rng.normal(size=500), "eight": rng.normal(size=8), "ar": np.zeros(500), "slow": np.zeros(2000)}
    for name, k in (("ar", 0.8), ("slow", 0.97)):
        for i in range(1, len(kinds[name])):
            kinds[name][i] = k * kinds[name][i - 1] + rng.normal()
    rows = [(s, i, float(v)) for s, x in kinds.items() for i, v in enumerate(x)] + [("white", 1000, None), ("none", 0, None)]
    d = spark.createDataFrame(rows, "symbol string, session int, x double")
    got = {r["symbol"]: r["block"] for r in I.block_lengths(d, "x", ["symbol"]).collect()}
    want = {s: plain_block_length(x) for s, x in kinds.items()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * want[s] for s in want), (got, want)
    assert got["one"] == got["short"] == 1.0 and got["ar"] > got["white"]
    assert I.block_lengths(d.limit(0), "x", ["symbol"]).count() == 0


def test_expanding_quantiles_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    long = np.concatenate([rng.normal(size=900), np.sort(rng.normal(size=700)), -np.sort(rng.normal(size=700)), np.repeat(0.25, 300)])
    kinds = {"long": long, "ties": rng.integers(0, 4, 700).astype(float), "one": np.array([2.0]), "gone": np.array([np.nan] * 3)}
    kinds["long"][rng.random(len(long)) < 0.1] = np.nan
    rows = [(s, i, None if v != v and i % 2 else float(v)) for s, x in kinds.items() for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "symbol string, session int, x double").repartition(7)
    spec = {"low": ("x", 0.0, 1), "some": ("x", 0.3, 60), "most": ("x", 0.97, 5), "high": ("x", 1.0, 1)}
    got = expanding_quantiles(d, spec).toPandas().sort_values("session")
    assert len(got) == len(rows)
    for s, x in kinds.items():
        own = got[got["symbol"] == s]
        for name, (_, q, least) in spec.items():
            want = pd.Series(x).expanding(min_periods=least).quantile(q).to_numpy()
            assert np.allclose(own[name].to_numpy(float), want, rtol=0, atol=1e-12, equal_nan=True), (s, name)
    assert expanding_quantiles(d.limit(0), spec).count() == 0


def test_step_thresholds_of_long_series(spark):
    z = {"a": np.random.default_rng(1).normal(size=1500), "b": np.random.default_rng(2).normal(size=210), "c": np.zeros(150)}
    d = spark.createDataFrame([(s, i, float(v)) for s, x in z.items() for i, v in enumerate(x)], "symbol string, pos long, z double")
    got = {(r["symbol"], r["step"]): (r["q_lo"], r["q_hi"], r["n_train"]) for r in L.step_thresholds(d, 200, 21).collect()}
    want = {(s, k): (*np.quantile(x[:n], [0.25, 0.75]), n) for s, x in z.items() for k, n in enumerate(range(200, len(x), 21))}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def probabilities(spark, n=400):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([1, 1, 1], n)
    y = [int(rng.choice([-1, 0, 1], p=q)) for q in p]
    return spark.createDataFrame(
        [(i, *map(float, q), c) for i, (q, c) in enumerate(zip(p, y))],
        "id int, p_short double, p_flat double, p_long double, label int"
    )


@pytest.mark.parametrize("kind", ["sigmoid", "isotonic"])
def test_calibrated_probabilities_sum_to_one(spark, kind):
    d = probabilities(spark)
    assert K.viable(d, "label")
    out = K.calibrator(kind).fit(d, "label").transform(d)
    assert out.count() == 400 and out.where("abs(p_short + p_flat + p_long - 1) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        K.calibrator("nothing")


def test_scores(spark):
    d = spark.createDataFrame([(1.0, 0.0, 0.0, -1), (0.0, 0.0, 1.0, -1)], "p_short double, p_flat double, p_long double, label int")
    assert d.agg(F.avg(K.brier("label"))).first()[0] == pytest.approx(1.0)
    curve = K.reliability(spark, d, "label", {"raw": K.P})
    assert curve.count() == 30 and curve.agg(F.sum("n")).first()[0] == 6
    assert d.agg(K.brier_skill("label", (F.lit(1.0), F.lit(0.0), F.lit(0.0)))).first()[0] is None


def test_candidates():
    c = M.candidates({"logistic": {"C": [0.1, 1.0]}, "forest": {"depth": [3]}}, [0.0, 0.5])
    assert [(x.family, x.delta) for x in c] == [
        ("baseline", 0.0), ("logistic", 0.5), ("logistic", 0.0), ("logistic", 0.5), ("logistic", 0.0), ("forest", 0.5),
        ("forest", 0.0)
    ]
    with pytest.raises(ValueError):
        M.candidates({"nothing": {}}, [0.0])


def test_text(spark, tmp_path):
    p = tmp_path / "lexicon.csv"
    p.write_text("Word,Negative,Positive\nBAD,2009,0\nGOOD,0,2009\n")
    lex = T.load_lexicon(spark, str(p), ("negative", "positive"))
    assert lex == {"negative": ["bad"], "positive": ["good"]}
    with pytest.raises(ValueError):
        T.load_lexicon(spark, str(p), ("negative",), sha256="0")
    d = spark.createDataFrame([(weekdays(1)[0], "Good good BAD don't tariff"), (weekdays(1)[0], "nan"), (weekdays(1)[0], None)], "session date, text string")
    assert d.where(T.is_empty(F.col("text"))).count() == 2
    s = T.score(d.where(~T.is_empty(F.col("text"))), lex, {"trade": ("tariff",)})
    spine = spark.createDataFrame([(x,) for x in weekdays(2)], "session date")
    f = T.with_empty_counts(T.session_features(s, spine, lex, {"trade": ("tariff",)}), d, "empties").orderBy("session").collect()
    assert f[0]["tone"] == pytest.approx(1 / 3) and f[0]["topic_trade_rate"] == pytest.approx(0.2) and f[0]["empties"] == 2 and f[1]["doc_count"] == 0


def test_audit(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, x double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (4, 1.0)], "k int, x double")
    r = A.run_diff(a, b, ["k"], ["x"]).first()
    assert (r["n_one_sided"], r["n_both"], r["n_different"], r["max_abs"]) == (2, 2, 1, 0.5)
    assert sorted(x[0] for x in A.expand_ids(spark.createDataFrame([("E1-E3, E9",)], "i string"), "i").collect()) == ["E1", "E2", "E3", "E9"]
    assert A.hash_states({"a": "1", "b": "2"}, {"a": "1", "c": "3"}) == {"a": "unchanged", "b": "missing", "c": "new"}
    assert A.text_equal(a.withColumn("t", F.lit("x")), a.withColumn("t", F.lit("x")), ["k"], ["t"]).first()["t"]


def test_sources(spark, tmp_path):
    assert files.deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    (tmp_path / "base.json").write_text(json.dumps({"x": 1}))
    (tmp_path / "over.json").write_text(json.dumps({"y": 2}))
    assert files.load_config(str(tmp_path / "base.json"), str(tmp_path / "over.json")) == {"x": 1, "y": 2}
    snap = files.synthetic_snapshot(spark, 30)
    snap.coalesce(1).toPandas().to_csv(tmp_path / "market_inputs_2.csv", index=False)
    df, manifest = files.read_snapshot(spark, str(tmp_path))
    assert df.count() == 30 and manifest == {} and df.where("dgs2 IS NULL").count() >= 1
    with pytest.raises(FileNotFoundError):
        files.read_snapshot(spark, str(tmp_path), "none_*.csv")
    (tmp_path / "rates.csv").write_text("a\nb\nc\nd\ne\n2024-01-02,5.1,ND\nbad,1,2\n")
    rows = files.read_rates(spark, str(tmp_path / "rates.csv"), {"x": "tcm3m", "y": "tcm2y"}).collect()
    assert len(rows) == 1 and rows[0]["tcm3m"] == 5.1 and rows[0]["tcm2y"] is None
    page = spark.createDataFrame(
        [("<title>T</title><a href='/x'>go</a><script>no</script> on",), (None,)], "html string"
    ).select(files.parse_page("html").alias("p")).select("p.*").collect()
    assert (page[0]["title"], page[0]["n_links"], page[0]["body"]) == ("T", 1, "go on") and page[1]["n_links"] == 0


def test_elements_and_cached_aggregates(spark, tmp_path):
    html = "<div class='post a' id='7'>one <div>in</div> <a href='/s/7'>x</a></div><div class='b'>two</div><div class='post'>open"
    found = spark.createDataFrame([(html,), (None,)], "html string").select(files.select_elements("html", "div", "post").alias("e")).collect()
    assert [tuple(x) for x in found[0]["e"]] == [("one in x", "7", "/s/7"), ("open", None, None)] and found[1]["e"] == []
    spine = spark.createDataFrame([(d,) for d in weekdays(3)], "session date")
    spark.createDataFrame([(weekdays(1)[0], 4)], "session date, n long").write.parquet(str(tmp_path / "agg"))
    out = files.read_or_aggregate(spark, str(tmp_path / "docs"), str(tmp_path / "agg"), None, spine).orderBy("session").collect()
    assert [r["n"] for r in out] == [4, 0, 0]
    spark.createDataFrame([(weekdays(1)[0], "x")], "session date, text string").write.parquet(str(tmp_path / "docs"))
    assert files.read_or_aggregate(spark, str(tmp_path / "docs"), str(tmp_path / "agg"), lambda d: d.groupBy("session").count(), spine).count() == 1


def test_stream_gives_the_batch_rows(spark, tmp_path):
    from conftest import DATA

    from tallyfold.plans.base import grid
    from tallyfold.plans.catalog import QUERIES
    from tallyfold.streaming import buckets

    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{DATA}/events.parquet").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    buckets.run_to_table(buckets.session_totals(stream, grid(spark)), "totals", str(tmp_path / "ck"))
    got = {r["session"]: (r["n_events"], round(r["total"], 4)) for r in spark.table("totals").collect()}
    want = {r["session"]: (r["n_events"], r["total"]) for r in QUERIES["session_event_totals"](spark, DATA).where("n_events > 0").collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(v[1] == pytest.approx(want[k][1], abs=1e-3) for k, v in got.items())


@pytest.mark.parametrize("name", ["screened_features", "jobson_korkie_p", "logistic_baseline_oos"])
def test_all_symbols_take_part(spark, name):
    data = DATA.replace("0.001", "0.01") if name == "screened_features" else DATA  # complete rows need long series
    want = {r["symbol"] for r in R.zrows(spark, data).select("symbol").distinct().collect()}
    assert {r["symbol"] for r in QUERIES[name](spark, data).collect()} == want and len(want) > 1
