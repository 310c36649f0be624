"""Models, calibration and walk-forward; SQL has none of them, so only rows and invariants are checked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions.lineage import cut
from ..operators import calibration as K
from ..operators import features as X
from ..operators import labels as L
from ..operators import models as M
from ..operators import walkforward as V
from .base import PANEL, query, rounded, segment_bars, snapshot, symbols
from .execution_queries import frame
from .research_queries import INIT, NAMES, STEP, complete_rows

FEATURES = ["log_ret", "SMA_gap_5", "Volatility_20", "intraday_ret", "close_location_value"]


def study(spark, sf, symbol: str):
    """One symbol's rows in order: features, target, z, carry, pos; NULL-free. A study of one series is as long as its sessions."""
    s = snapshot(spark, sf).where(F.col("symbol") == symbol)
    f = X.build(s, X.Registry([x for x in X.REGISTRY.features if x.name in FEATURES]))
    t = frame(spark, sf).where(F.col("symbol") == symbol).select("symbol", "session", F.col("o2c"), "financing")
    d = f.join(t, ["symbol", "session"])
    d = d.select("symbol", "session", *FEATURES, C.lag("o2c", -1).alias("target"), C.lag("financing", -1).alias("carry"))
    d = d.withColumn("z", L.vol_adjusted(F.col("target"), F.col("Volatility_20"))).dropna()
    return L.positions_in_order(d)


def each(spark, sf, study_of) -> DataFrame:
    """The rows that study_of(symbol) gives for each of the panel's symbols."""
    return reduce(DataFrame.unionByName, map(study_of, symbols(spark, sf)))


def split(spark, sf, symbol: str):
    d = study(spark, sf, symbol).persist()
    n = d.count()
    cut = n * 3 // 4
    q = d.where(F.col("pos") < cut).agg(*L.thresholds()).first()
    d = d.withColumn("label", L.label(F.col("z"), F.lit(q["q_lo"]), F.lit(q["q_hi"])))
    return d.where(F.col("pos") < cut), d.where(F.col("pos") >= cut), cut


def _out_of_sample(name: str, candidate: M.Candidate):
    @query(name)
    def run(spark, sf):
        def one(symbol):
            train, test, _ = split(spark, sf, symbol)
            return rounded(M.fit(train, candidate, FEATURES).predict(test).select("symbol", "session", "label", *K.P), 9)

        return each(spark, sf, one)


_out_of_sample("logistic_baseline_oos", M.Candidate("logistic", (("C", 0.1),)))
_out_of_sample("logistic_balanced_oos", M.Candidate("logistic", (("C", 0.1), ("class_weight", "balanced"))))
_out_of_sample("forest_oos", M.Candidate("forest", (("trees", 30), ("depth", 3), ("leaf", 10))))
_out_of_sample("gbt_oos", M.Candidate("boosted", (("trees", 5), ("depth", 3))))
_out_of_sample("gbt_shallow_oos", M.Candidate("boosted_shallow", (("trees", 5), ("depth", 2))))


def _calibrated(name: str, kind: str):
    @query(name)
    def run(spark, sf):
        def one(symbol):
            train, test, cut = split(spark, sf, symbol)
            c = M.Candidate("logistic", (("C", 0.1),))
            oof = M.cross_fit(train, cut, c, FEATURES).persist()
            model = M.fit(train, c, FEATURES)
            rows = model.predict(test).select("symbol", "session", "label", *K.P)
            if not K.viable(oof, "label"):
                return rounded(rows.withColumn("calibration_skipped", F.lit(True)), 9)
            return rounded(K.calibrator(kind).fit(oof, "label").transform(rows).withColumn("calibration_skipped", F.lit(False)), 9)

        return each(spark, sf, one)


_calibrated("platt_calibrated", "sigmoid")
_calibrated("isotonic_calibrated", "isotonic")


# ---------------------------------------------------------------- walk-forward

def walk_rows(spark, sf, market: bool = False) -> DataFrame:
    """All complete rows of all symbols (or of the market as a whole) with all features, as the walk takes them."""
    return cut(V.prepared(cut(complete_rows(spark, sf, market)), NAMES))


GROUPS = [f.group for f in X.REGISTRY.features]
#: The tables have fewer sessions than a study, so the first slice has 600; forests and boosters have fewer trees than their own 300.
SETTINGS = V.Settings(initial=600, retune_every=12)
GRID = {
    "logistic": {"C": [0.01, 0.1, 1.0], "class_weight": [None, "balanced"]}, "forest": {"trees": [15], "depth": [3, 5], "leaf": [50, 20]},
    "boosted": {
        "trees": [10], "leaves": [7, 15], "rate": [0.03, 0.1], "leaf": [60, 30]
    }, "boosted_shallow": {"trees": [10], "depth": [2, 3], "rate": [0.03, 0.1]},
}
CANDIDATES = M.candidates(GRID, [0.0])


def walk_folds(spark, sf, market: bool = False) -> tuple[DataFrame, DataFrame]:
    rows = walk_rows(spark, sf, market)
    return rows, V.fold_results(rows, NAMES, GROUPS, CANDIDATES, SETTINGS)


def walk_predictions(spark, sf, market: bool = False) -> DataFrame:
    rows, folds = walk_folds(spark, sf, market)
    return V.predictions(rows, V.selection(V.diagnostics(folds, CANDIDATES, SETTINGS)), NAMES, GROUPS, CANDIDATES, SETTINGS)


@query("walkforward_diagnostics")
def walkforward_diagnostics(spark, sf):
    return rounded(V.diagnostics(walk_folds(spark, sf)[1], CANDIDATES, SETTINGS), 9)


@query("walkforward_selection")
def walkforward_selection(spark, sf):
    return rounded(V.selection(V.diagnostics(walk_folds(spark, sf)[1], CANDIDATES, SETTINGS)), 9)


@query("walkforward_calibration_log")
def walkforward_calibration_log(spark, sf):
    return rounded(V.calibration_log(walk_folds(spark, sf)[1], CANDIDATES), 9)


@query("walkforward_predictions")
def walkforward_predictions(spark, sf):
    return rounded(walk_predictions(spark, sf), 9)


@query("walkforward_reliability")
def walkforward_reliability(spark, sf):
    """Out of sample, before and after calibration."""
    d = walk_predictions(spark, sf).select("label", *V.RAW, *V.CALIBRATED)
    return rounded(K.reliability(spark, d, "label", {"raw": V.RAW, "calibrated": V.CALIBRATED}))


@query("feature_stability")
def feature_stability(spark, sf):
    return V.stability(V.screens(walk_rows(spark, sf), NAMES, GROUPS, SETTINGS))


@query(
    "candidate_grid",
    f"""WITH {PANEL}, n AS (SELECT symbol, count(*) AS n_rows FROM panel GROUP BY 1)
SELECT symbol, family, complexity_rank, n_candidates, n_rows, n_candidates * greatest(0, CAST(ceil((n_rows - {INIT}) / {STEP}.0) AS BIGINT)) AS n_fits
FROM n, (VALUES ('baseline', 0, 1), ('logistic', 1, 12), ('forest', 2, 4)) AS t(family, complexity_rank, n_candidates)""",
)
def candidate_grid(spark, sf):
    """What a walk over the panel fits: candidates of each family, simplest first, times the steps of each symbol."""
    c = M.candidates({"logistic": {"C": [0.01, 0.1, 1.0], "class_weight": [None, "balanced"]}, "forest": {"depth": [3, 5], "leaf": [20]}}, [0.0, 0.5])
    grid = spark.createDataFrame([(x.family, x.complexity_rank) for x in c], "family string, complexity_rank int")
    grid = grid.groupBy("family", "complexity_rank").agg(F.count(F.lit(1)).cast("int").alias("n_candidates"))
    steps = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("n_rows") - INIT) / STEP))
    rows = segment_bars(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.crossJoin(F.broadcast(grid)).withColumn("n_fits", F.col("n_candidates") * steps)  # three rows a symbol
