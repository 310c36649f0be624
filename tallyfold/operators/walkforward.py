"""Nested walk-forward: fit a slice, score candidates out of fold, choose by the one-standard-error rule, emit.

The plan is relational: a schedule of steps for each symbol, joined with the rows of each slice; a slice and fold
(or a slice alone, once its candidate is chosen) is one group and one task, which fits on arrays (learners.py).
Positions, net returns, the choice and all tables around them are DataFrame operations, so nothing is looped over or
held on the driver, and symbols, steps and folds run side by side.

Rows: symbol, session, pos (from 0), target (simple return of the next session), z (its volatility-adjusted log),
carry, x (features) and rho (their rolling rank correlations with z), see `prepared`.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import core as C
from . import labels as L
from . import learners as N
from . import models as M
from . import screening as S
from . import slices
from .execution import get_spec
from .screening import CAP, CUT, PER_GROUP, WINDOW

LEAST_ACTIVE = 30


@dataclass(frozen=True)
class Settings:
    """The lengths of a run; all in rows. `rolling` bounds a training slice, which else begins at the first row."""

    initial: int = 1000
    step: int = 21
    retune_every: int = 12
    rolling: int | None = None
    folds: tuple[int, int, int] = (5, 100, 1)
    nested: tuple[int, int, int, int] = (3, 100, 1, 180)
    calibrator: str | None = "sigmoid"
    least_calibration: tuple[int, int] = (200, 30)
    spec: str = "open_to_close"
    cost_bps: float = 2.0
    replicates: int = 1000
    block: float = 20.0
    seed: int = 20260823
    max_steps: int | None = None
    window: int = WINDOW
    per_group: int = PER_GROUP
    cut: float = CUT
    cap: int = CAP


def prepared(df: DataFrame, features: list[str], window: int = WINDOW) -> DataFrame:
    """df(symbol, session, pos, target, z, carry, features) with the features as x and their rolling rank correlations
    as rho; rows with a missing value raise no error but must not be there.
    """
    rows = df.select("symbol", "session", "pos", "target", "z", "carry", F.array(*(F.col(f).cast("double") for f in features)).alias("x"))
    long = rows.select("symbol", "pos", "z", F.posexplode("x").alias("i", "x"))
    rho = S.rolling_spearman(long, window, ("symbol", "i")).groupBy("symbol", "pos").agg(F.array_sort(F.collect_list(F.struct("i", "rho"))).alias("__r"))
    return rows.join(rho.select("symbol", "pos", F.col("__r.rho").alias("rho")), ["symbol", "pos"], "left").select(*rows.columns, "rho")


def schedule(rows: DataFrame, s: Settings) -> DataFrame:
    """symbol, step, train_lo, train_hi, test_hi, retune (the step that chose its candidate): the steps of each symbol; too short a series has none."""
    n = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.initial)
    last = F.ceil((F.col("n") - s.initial) / s.step) - 1
    if s.max_steps is not None:
        last = F.least(last, F.lit(s.max_steps - 1))
    steps = n.select("symbol", "n", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("step"))
    hi = (F.lit(s.initial) + F.col("step") * s.step).cast("long")
    lo = F.lit(0).cast("long") if s.rolling is None else F.greatest(F.lit(0), hi - s.rolling).cast("long")
    return steps.select(
        "symbol", "step", lo.alias("train_lo"), hi.alias("train_hi"), F.least(hi + s.step, F.col("n")).alias("test_hi"),
        (F.col("step") - F.col("step") % s.retune_every).alias("retune")
    )


def inner_folds(steps: DataFrame, s: Settings) -> DataFrame:
    """The retuning steps, a row for each inner fold, with the ranges of the fold; too short a slice has none."""
    folds, size, gap = s.folds
    start = F.col("train_hi") - folds * size + F.col("fold") * size
    tuned = steps.where("step = retune").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    tuned = tuned.where(F.col("train_hi") - F.col("train_lo") - folds * size - gap > 0)
    return tuned.select("symbol", "step", "fold", "train_lo", (start - gap).alias("train_hi"), start.alias("test_lo"), (start + size).alias("test_hi"))


def sliced(rows: DataFrame, ranges: DataFrame, kept: DataFrame) -> DataFrame:
    """rows copied to each of the ranges (symbol, ..., train_lo, train_hi, test_lo, test_hi) that has them, with the features that its screen
    kept(symbol, ..., rank, position) in the order of rank, their positions as `chosen`, and whether they are `train` rows.
    """
    key = [c for c in slices.key_of(ranges) if c in kept.columns]
    chosen = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "position"))).alias("__c")).select(*key, F.col("__c.position").alias("chosen"))
    d = rows.drop("rho").join(ranges.join(chosen, key), "symbol").where(
        (F.col("pos") >= F.col("train_lo")) & ((F.col("pos") < F.col("train_hi")) | (F.col("pos") >= F.col("test_lo")) & (F.col("pos") < F.col("test_hi")))
    )
    return d.withColumn("train", F.col("pos") < F.col("train_hi")).withColumn("x", F.expr("transform(chosen, p -> x[p - 1])")).drop(*slices.RANGE)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df dealt by key over several tasks a core: slices are small but long to fit, so their partitions must not be merged by size."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *key)


class Slice:
    """What is learned from one training slice and its screened features: thresholds, labels, class means; then a model and its calibrator for each candidate."""

    def __init__(self, train: pd.DataFrame, s: Settings, seed: int):
        self.s, self.seed = s, seed
        z, r = train["z"].to_numpy(), train["target"].to_numpy()
        self.q = np.quantile(z, [L.LOW, L.HIGH])
        self.y = self.label(z)
        self.x, self.means = np.array(train["x"].tolist()), np.array([r[self.y == c].mean() if (self.y == c).any() else 0.0 for c in range(N.CLASSES)])
        self.rates = np.bincount(self.y, minlength=N.CLASSES) / max(len(z), 1)

    def label(self, z: np.ndarray) -> np.ndarray:
        """Class numbers 0, 1, 2 for short, flat, long."""
        return np.where(z >= self.q[1], 2, np.where(z <= self.q[0], 0, 1))

    def fit(self, family: str, params: dict):
        rng = lambda k: np.random.default_rng([self.seed, k])
        folds, size, gap, least = self.s.nested
        n, p, y = len(self.y), [], []
        if self.s.calibrator and family != "baseline":
            for k in range(folds):
                a = n - (folds - k) * size
                if a - gap >= least:
                    p.append(N.estimator(family, params).fit(self.x[: a - gap], self.y[: a - gap], rng(k)).predict(self.x[a : a + size]))
                    y.append(self.y[a : a + size])
        self.oof, self.oof_y = (np.concatenate(p), np.concatenate(y)) if p else (np.zeros((0, N.CLASSES)), np.zeros(0, int))
        total, each = self.s.least_calibration
        viable = len(self.oof_y) >= total and np.bincount(self.oof_y, minlength=N.CLASSES).min() >= each
        self.curves = N.curves(self.s.calibrator).fit(self.oof, self.oof_y) if viable else None
        self.model = N.estimator(family, params).fit(self.x, self.y, rng(folds))
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw and calibrated probabilities and the expected return."""
        raw = self.model.predict(x)
        p = self.curves.transform(raw) if self.curves else raw
        return raw, p, p @ self.means

    def log(self) -> dict:
        """Scores on the out-of-fold rows; those after calibration are on the rows that the calibrator was fitted on."""
        if not len(self.oof_y):
            return {}
        before, after = N.brier(self.oof, self.oof_y), N.brier(self.curves.transform(self.oof) if self.curves else self.oof, self.oof_y)
        base = N.brier(np.tile(self.rates, (len(self.oof_y), 1)), self.oof_y)
        return {
            "n_oof": len(self.oof_y), "calibration_skipped": self.curves is None, "brier_before": before,
            "brier_after_in_sample": after, "brier_skill": 1 - before / base if base else None
        } | dict(zip(("rate_short", "rate_flat", "rate_long"), self.rates.tolist()))


FOLD = "symbol string, step int, fold int, model int, part string, session date, target double, carry double, mu double, n_oof int, calibration_skipped boolean, brier_before double, brier_after_in_sample double, brier_skill double, rate_short double, rate_flat double, rate_long double"
COLUMNS = [c.split()[0] for c in FOLD.split(", ")]


def configurations(candidates: list[M.Candidate]) -> list[tuple[str, tuple]]:
    """Families and parameters without repeats: what is fitted; margins (delta) share a fit."""
    return list(dict.fromkeys((c.family, c.params) for c in candidates))


def fold_results(rows: DataFrame, features: list[str], groups: list[str], candidates: list[M.Candidate], s: Settings) -> DataFrame:
    """FOLD: of each symbol, retuning step, inner fold and fitted model the expected returns of its `train` and `test` rows, and a `log` row of its calibration.

    A slice in which no feature varies has none.
    """
    fitted = configurations(candidates)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        train, x, out = pdf[pdf["train"]], np.array(pdf["x"].tolist()), []
        one = Slice(train, s, s.seed + int(key[1]))
        for k, (family, params) in enumerate(fitted):
            _, _, mu = one.fit(family, dict(params)).predict(x)
            part = np.where(pdf["train"], "train", "test")
            out.append(pdf[["symbol", "step", "fold", "session", "target", "carry"]].assign(model=k, part=part, mu=mu))
            if log := one.log():
                out.append(pd.DataFrame([{"symbol": key[0], "step": key[1], "fold": key[2], "model": k, "part": "log"} | log]))
        return pd.concat(out).reindex(columns=COLUMNS)

    ranges = inner_folds(schedule(rows, s), s)
    kept = slices.screens(rows, ranges, features, groups, s.window, s.per_group, s.cut, s.cap)
    data = sliced(rows, ranges, kept).select("symbol", "step", "fold", "session", "pos", "target", "carry", "z", "x", "train")
    return spread(data, "symbol", "step", "fold").groupBy("symbol", "step", "fold").applyInPandas(run, FOLD)


def table_of(spark, candidates: list[M.Candidate]) -> DataFrame:
    """candidate (number), model, id, family, params, delta and the ranks; one row a candidate."""
    fitted = {c: k for k, c in enumerate(configurations(candidates))}
    rows = [
        (i, fitted[c.family, c.params], c.key, c.family, repr(dict(c.params)), float(c.delta), c.complexity_rank, c.within_rank) for i,
        c in enumerate(candidates)
    ]
    return spark.createDataFrame(rows, "candidate int, model int, id string, family string, params string, delta double, complexity_rank int, within_rank int")


def _series(rows: DataFrame, key: list[str], add) -> DataFrame:
    """add(rows), where each key is a series of its own to the functions that know series by symbol."""
    named = rows.withColumn("__symbol", F.col("symbol")).withColumn("symbol", F.concat_ws("\x1f", *(F.col(k).cast("string") for k in key)))
    return add(named).withColumn("symbol", F.col("__symbol")).drop("__symbol")


def positioned(rows: DataFrame, key: list[str], s: Settings) -> DataFrame:
    """position of rows(key, session, mu, delta, carry). One specification serves scoring and emission."""
    spec = get_spec(s.spec)
    delta = F.col("delta") if s.spec == "open_to_close" else 0.0
    return _series(rows, key, lambda d: spec.positions(d, "mu", "carry", s.cost_bps, delta))


def netted(rows: DataFrame, key: list[str], s: Settings) -> DataFrame:
    """net of rows(key, session, position, target, carry)."""
    return _series(rows, key, lambda d: get_spec(s.spec).net(d, "position", "target", "carry", s.cost_bps))


def checked(candidates: list[M.Candidate], s: Settings) -> list[M.Candidate]:
    if s.spec != "open_to_close" and any(c.delta for c in candidates):
        raise ValueError(f"{s.spec} takes no margin")
    return candidates


SCORE = "symbol string, step int, candidate int, score double, active_positions int, turnover_per_year double, in_sample_score double, standard_error double"


def diagnostics(folds: DataFrame, candidates: list[M.Candidate], s: Settings) -> DataFrame:
    """Of each symbol, retuning step and candidate: the Sharpe ratio of its inner test rows put together, with a bootstrap standard error; active positions, turnover, mean Sharpe ratio on the folds' own training rows and the gap to it.

    degenerate: fewer than LEAST_ACTIVE active positions, or no ratio.
    """
    names = table_of(folds.sparkSession, checked(candidates, s))
    long = folds.where("part != 'log'").select(
        "symbol", "step", "fold", "model", "part", "session", "target", "carry", "mu"
    ).join(names.select("model", "candidate", "delta"), "model")
    long = long.withColumn("series", F.when(F.col("part") == "train", F.col("fold")).otherwise(-1))
    key = ["symbol", "step", "candidate", "series"]
    long = netted(positioned(long, key, s), key, s)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        test = pdf[pdf["series"] < 0].sort_values("session")
        net, w = test["net"].to_numpy(), test["position"].to_numpy()
        score, active = N.sharpe(net), int((w != 0).sum())
        inside = [N.sharpe(d.sort_values("session")["net"].to_numpy()) for _, d in pdf[pdf["series"] >= 0].groupby("series")]
        inside = [v for v in inside if v == v]
        sound = active >= LEAST_ACTIVE and score == score
        se = N.bootstrap_error(net, s.replicates, s.block, s.seed + int(key[1]) + 101) if sound else None
        turnover = float(np.abs(np.diff(w)).sum() / len(w) * C.TRADING_DAYS) if len(w) else 0.0
        return pd.DataFrame(
            [(*key, score if score == score else None, active, turnover, float(np.mean(inside)) if inside else None, se)],
            columns=[c.split()[0] for c in SCORE.split(", ")]
        )

    scored = long.select(*key, "session", "position", "net").groupBy("symbol", "step", "candidate").applyInPandas(run, SCORE)
    scored = scored.withColumns({c: C.no_nan(F.col(c)) for c in ("score", "in_sample_score", "standard_error")})
    scored = scored.withColumn("train_minus_oos_score", F.col("in_sample_score") - F.col("score")).withColumn(
        "degenerate", (F.col("active_positions") < LEAST_ACTIVE) | F.col("score").isNull()
    )
    return scored.join(names.drop("model"), "candidate")


def selection(scored: DataFrame) -> DataFrame:
    """The choice of each symbol and step: of the candidates within one standard error of the best one the simplest; of equal ones the larger margin.

    The error is the best one's own. If all are degenerate, the first candidate.
    """
    live = ~F.col("degenerate")
    of = Window.partitionBy("symbol", "step")
    best = F.max(F.when(live, F.struct("score", (-F.col("candidate")).alias("first"), "standard_error", "id"))).over(of)
    d = scored.withColumn("best", best).withColumn("eligible", live & (F.col("score") >= F.col("best.score") - F.coalesce("best.standard_error", F.lit(0.0))))
    # without any live one, the first of all
    order = of.orderBy(
        F.desc("eligible"), *(F.when(F.col("eligible"), F.col(c)) for c in ("complexity_rank", "within_rank")),
        F.when(F.col("eligible"), -F.col("delta")), "candidate"
    )
    d = d.withColumns({"eligible": F.coalesce("eligible", F.lit(False))})
    d = d.withColumns(
        {
            "n_candidates": F.count(F.lit(1)).over(of), "n_eligible": F.sum(F.col("eligible").cast("int")).over(of),
            "n_degenerate": F.sum(F.col("degenerate").cast("int")).over(of), "__first": F.row_number().over(order)
        }
    )
    d = d.where("__first = 1")
    reason = F.when(F.col("n_eligible") > 0, "one-standard-error rule").otherwise("all candidates degenerate")
    return d.select(
        "symbol", "step", "candidate", F.col("id").alias("chosen_id"), F.col("score").alias("chosen_score"),
        (F.col("family") == "baseline").alias("baseline_selected"), "n_candidates", "n_eligible", "n_degenerate",
        F.col("best.id").alias("best_id"), F.col("best.score").alias("best_score"),
        F.col("best.standard_error").alias("se_best"), reason.alias("reason")
    )


RAW, CALIBRATED = ("raw_short", "raw_flat", "raw_long"), ("p_short", "p_flat", "p_long")
OUT = "symbol string, step int, session date, candidate int, target double, carry double, label int, " + ", ".join(
    f"{c} double" for c in (*RAW, *CALIBRATED)
) + ", mu double, calibration_skipped boolean, features array<string>"


def predictions(rows: DataFrame, chosen: DataFrame, features: list[str], groups: list[str], candidates: list[M.Candidate], s: Settings) -> DataFrame:
    """Out-of-sample rows of all steps: the step's candidate, refitted on the whole training slice; label by the
    slice's thresholds, raw and calibrated probabilities, expected return, position, net, the screened features.
    """
    names = table_of(rows.sparkSession, checked(candidates, s)).select("candidate", F.col("id").alias("model"), "delta")
    steps = schedule(rows, s).join(chosen.select("symbol", F.col("step").alias("retune"), "candidate"), ["symbol", "retune"])
    ranges = steps.select("symbol", "step", "candidate", "train_lo", "train_hi", F.col("train_hi").alias("test_lo"), "test_hi")
    columns = [c.split()[0] for c in OUT.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, c = pdf.sort_values("pos"), candidates[int(pdf["candidate"].iloc[0])]
        one, test = Slice(pdf[pdf["train"]], s, s.seed + int(key[1])), pdf[~pdf["train"]]
        raw, p, mu = one.fit(c.family, dict(c.params)).predict(np.array(test["x"].tolist()))
        out = test[["symbol", "step", "session", "candidate", "target", "carry"]].assign(
            label=one.label(test["z"].to_numpy()) - 1, mu=mu, calibration_skipped=one.curves is None
        )
        for k in range(N.CLASSES):
            out[RAW[k]], out[CALIBRATED[k]] = raw[:, k], p[:, k]
        return out.assign(features=[[features[p - 1] for p in pdf["chosen"].iloc[0]]] * len(out))[columns]

    kept = screens(rows, features, groups, s)
    data = sliced(rows, ranges, kept).select("symbol", "step", "candidate", "session", "pos", "target", "carry", "z", "x", "chosen", "train")
    out = spread(data, "symbol", "step").groupBy("symbol", "step").applyInPandas(run, OUT).join(names, "candidate")
    return netted(positioned(out, ["symbol", "step"], s), ["symbol"], s).drop("candidate")


def screens(rows: DataFrame, features: list[str], groups: list[str], s: Settings) -> DataFrame:
    """symbol, step, rank (from 1), feature, position, ic: what each step's training slice keeps; no model is fitted."""
    ranges = schedule(rows, s).select("symbol", "step", "train_lo", "train_hi")
    return slices.screens(rows, ranges, features, groups, s.window, s.per_group, s.cut, s.cap)


def stability(kept: DataFrame) -> DataFrame:
    """Of kept(symbol, step, feature): the steps whose screen each feature passed."""
    return kept.groupBy("symbol", "feature").agg(F.count_distinct("step").alias("steps_selected"))


def calibration_log(folds: DataFrame, candidates: list[M.Candidate]) -> DataFrame:
    """A row for each symbol, retuning step, inner fold and model that was cross-fitted: its scores before and after calibration, and its slice's class shares.

    Scores before calibration are out of sample; those after it are on the calibrator's own rows.
    """
    names = table_of(folds.sparkSession, candidates).select("model", "family", "params").distinct()
    return folds.where("part = 'log'").join(names, "model").select("symbol", "step", "fold", "family", "params", *COLUMNS[COLUMNS.index("n_oof") :])


def run(rows: DataFrame, features: list[str], groups: list[str], candidates: list[M.Candidate], s: Settings, path: str) -> dict[str, DataFrame]:
    """The whole walk, each table written below path as soon as it is known and read back by the next one."""
    spark = rows.sparkSession

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    out = {"folds": kept("folds", fold_results(rows, features, groups, checked(candidates, s), s))}
    out["candidate_diagnostics"] = kept("candidate_diagnostics", diagnostics(out["folds"], candidates, s))
    out["selection_log"] = kept("selection_log", selection(out["candidate_diagnostics"]))
    out["calibration_diagnostics"] = kept("calibration_diagnostics", calibration_log(out["folds"], candidates))
    out["oos_predictions"] = kept("oos_predictions", predictions(rows, out["selection_log"], features, groups, candidates, s))
    out["feature_stability"] = kept("feature_stability", stability(out["oos_predictions"].select("symbol", "step", F.explode("features").alias("feature"))))
    return out


def configured(config: dict, registry) -> tuple[list[str], list[M.Candidate], Settings]:
    """Features, candidates and settings of a configuration: settings (fields of Settings), models (grids), only,
    deltas, exclude_groups, mode (`smoke`: three steps, the last two retuned together).
    """
    known = registry.without(config.get("exclude_groups") or [])
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in (config.get("settings") or {}).items()}
    if config.get("mode") == "smoke":
        values |= {"max_steps": 3, "retune_every": 2}
    return known.names(), M.candidates(config.get("models") or {}, config.get("deltas") or [0.0], config.get("only")), Settings(**values)


def run_batch(rows_of, registry, base: dict, overlays: dict[str, dict], path: str, workers: int = 1) -> dict[str, str]:
    """A run for each overlay over the base configuration, below path/<name>; rows_of(features, settings) gives its rows.

    As many overlays as there are workers run side by side, each a driver thread with its own job group and scheduler pool
    (with `spark.scheduler.mode` FAIR the pools share the executors evenly). A run whose marker is there is skipped, and one
    that fails is noted and does not stop the others; path/batch.json is written after each. Returns `done`, `skipped` or
    the error for each name.
    """
    from ..sources import files

    spark = SparkSession.active()
    context = spark.sparkContext

    def one(name: str) -> str:
        marker = f"{path}/{name}/run_manifest.json"
        try:
            context.setJobGroup(f"overlay {name}", f"walk of overlay {name}", interruptOnCancel=True)
            context.setLocalProperty("spark.scheduler.pool", name)
            if files.exists(marker):
                return "skipped"
            config = files.deep_merge(base, overlays[name])
            features, candidates, s = configured(config, registry)
            groups = {f.name: f.group for f in registry.features}
            run(rows_of(features, s), features, [groups[f] for f in features], candidates, s, f"{path}/{name}")
            files.write_json(marker, {"name": name, "config": config, "n_candidates": len(candidates), "n_features": len(features)})
            return "done"
        except Exception as e:  # noqa: BLE001  (one overlay's failure is its own)
            return f"{type(e).__name__}: {e}"

    told: dict[str, str] = {}
    with ThreadPoolExecutor(max(workers, 1)) as pool:
        waiting = {pool.submit(inheritable_thread_target(spark)(one), name): name for name in overlays}
        for finished in as_completed(waiting):
            told[waiting[finished]] = finished.result()
            files.write_json(f"{path}/batch.json", {name: told[name] for name in overlays if name in told})
    return {name: told[name] for name in overlays}
