"""Newton boosting with hierarchical losses, validation, tuning and recursion.

Features are binned once.  The state of a run is one narrow table (fold, key, date, y, bins, raw),
written each round in the shared folder, which cuts the lineage and survives lost executors; the one before the last is deleted.
A round takes gradient and hessian of the current predictions as DataFrame
aggregations and grows a tree leaf by leaf (``trees``); a leaf takes the regularised Newton step
of its own sums.  The folds of a validation are one run: they share bins, jobs and hierarchical sums, and
each has trees of its own.  A model is small arrays: any number of trees is one vectorised function, and a table when saved.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from enum import Enum

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import calendar_parts, clipped, lag_number, window_number
from ..sources.tables import complete_at, cut_lineage, discard, write_csv, written
from . import loss
from .reconcile import METHODS, bottom_up, reconcile_all
from .trees import Binner, Limits, Tree, binned, fit_binner, grow, matrix


class Objective(Enum):
    L2 = "l2"
    TWEEDIE = "tweedie"
    HIERARCHICAL = "hierarchical"
    RANDOM = "random"


class Metric(Enum):
    L2 = "l2"
    TWEEDIE = "tweedie"
    HIERARCHICAL = "hierarchical"


@dataclass(frozen=True)
class Params:
    objective: Objective = Objective.L2
    metric: Metric = Metric.L2
    rounds: int = 100
    rate: float = 0.1
    leaves: int = 31
    depth: int = 16
    min_rows: int = 5
    bins: int = 64
    row_share: float = 1.0
    feature_share: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    bagging_freq: int = 1
    power: float = 1.5
    max_levels: int = 10
    max_categories: int = 100
    hier_freq: int = 1
    patience: int = 100
    seed: int = 0


TREE_SCHEMA = "tree int, node int, feature int, left_bins binary, left int, right int, value double"


@dataclass
class Booster:
    """A fitted model: a start value and trees over the columns ``features``; ``t_train`` is the seconds it took."""

    params: Params
    features: list[str]
    start: float
    binner: Binner
    trees: list[Tree] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    t_train: float = 0.0

    def values(self, x: np.ndarray, rounds: int | None = None) -> np.ndarray:
        """Predictions of rows of features; missing ones have a bin of their own."""
        bins = self.binner.bins(x)
        raw = np.full(len(x), self.start)
        for tree in self.trees[:rounds]:
            raw += self.params.rate * tree.predict(bins)
        return np.exp(raw) if self.params.objective is Objective.TWEEDIE else raw

    def predict(self, rows: DataFrame, name: str = "yhat", rounds: int | None = None) -> DataFrame:
        """``rows`` with predictions."""

        @F.pandas_udf("double")
        def run(x: pd.DataFrame) -> pd.Series:
            return pd.Series(self.values(x.to_numpy(dtype=float), rounds))

        return rows.withColumn(name, run(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features])))

    def save(self, spark: SparkSession, path: str) -> None:
        """As a table of tree nodes and one of the rest, which is written last."""
        rows = [
            (t, n, int(x.feature[n]), np.packbits(x.left_bins[n]).tobytes(), int(x.left[n]), int(x.right[n]), float(x.value[n])) for t, x in enumerate(self.trees) for n in range(len(x.value))
        ]
        spark.createDataFrame(rows, TREE_SCHEMA).write.mode("overwrite").parquet(f"{path}/trees")
        params = asdict(self.params) | {"objective": self.params.objective.value, "metric": self.params.metric.value}
        bins = {"cuts": [c.tolist() for c in self.binner.cuts], "categorical": self.binner.categorical}
        about = {"params": params, "features": self.features, "start": self.start, "bins": bins, "scores": self.scores, "t_train": self.t_train}
        spark.createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Booster:
        about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
        params = params_of(about["params"])
        trees: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/trees").orderBy("tree", "node").collect():
            trees.setdefault(r["tree"], []).append((r["feature"], np.unpackbits(np.frombuffer(r["left_bins"], dtype=np.uint8)).astype(bool), r["left"], r["right"], r["value"]))
        arrays = [Tree(*(np.array(c) for c in zip(*rows, strict=True))) for rows in trees.values()]
        binner = Binner([np.array(c) for c in about["bins"]["cuts"]], about["bins"]["categorical"])
        return cls(params, about["features"], about["start"], binner, arrays, about["scores"], about["t_train"])


def params_of(told: dict) -> Params:
    return Params(**told | {"objective": Objective(told["objective"]), "metric": Metric(told["metric"])})


def fit_or_load(spark: SparkSession, path: str | None, make) -> Booster:
    """The model saved at ``path``, with the time its training took then; made and saved first if there is none, or none to its end."""
    if path is not None and complete_at(spark, f"{path}/about"):
        return Booster.load(spark, path)
    model = make()
    if path is not None:
        model.save(spark, path)
    return model


#: Days that tell the folds' dates apart in one number.
FOLD_DAYS = 1_000_000


def fit(
    rows: DataFrame,
    features: list[str],
    params: Params,
    sc: DataFrame | None = None,
    st: DataFrame | None = None,
    key: str = "member",
    date: str = "date",
    target: str = "y",
    valid: DataFrame | None = None,
    categories: tuple[str, ...] = (),
) -> Booster:
    """Boost on ``rows`` (one per key and date).  With ``valid``, stop after ``patience`` rounds without gain.

    Hierarchical objectives take memberships of members (``sc``) and dates (``st``);
    they use all features in every round.  ``categories`` names the features whose numbers are codes without an order.
    """
    columns = list(dict.fromkeys([key, date, target, *features]))
    marked = rows.select(*columns).withColumns({"_fold": F.lit(0), "_train": F.lit(True)})
    if valid is not None:
        marked = marked.unionByName(valid.select(*columns).withColumns({"_fold": F.lit(0), "_train": F.lit(False)}))
    return fit_folds(marked, [0], features, params, sc, st, key, date, target, categories, valid is not None)[0]


def fit_folds(
    rows: DataFrame,
    folds: list[int],
    features: list[str],
    params: Params,
    sc: DataFrame | None = None,
    st: DataFrame | None = None,
    key: str = "member",
    date: str = "date",
    target: str = "y",
    categories: tuple[str, ...] = (),
    validate: bool = True,
) -> dict[int, Booster]:
    """A model for each of ``folds``, boosted in lockstep on ``rows`` with ``_fold`` and ``_train`` (false: rows that only scores are taken of).

    A fold ends on its own when it has not gained for ``patience`` rounds.
    """
    if params.objective is Objective.HIERARCHICAL and sc is None and st is None:
        raise ValueError("the hierarchical objective needs sc or st")
    if params.objective in (Objective.HIERARCHICAL, Objective.RANDOM):
        params = replace(params, feature_share=1.0)
    began, spark = time.perf_counter(), rows.sparkSession
    at = F.col("_fold") * F.lit(FOLD_DAYS) + F.unix_date(F.col(date).cast("date"))
    named = rows.withColumns({"_key": F.col(key), "_at": at, "_y": F.col(target).cast("double")})
    binner = fit_binner(named.where("_train"), features, categories, params.bins)
    n_bins = max([2, *(len(c) + 2 for c in binner.cuts)])
    means = {r[0]: r[1] for r in named.where("_train").groupBy("_fold").agg(F.avg("_y")).collect()}  # a row for each fold
    starts = {f: float(np.log(max(means.get(f) or 0.0, 1e-6))) if params.objective is Objective.TWEEDIE else float(means.get(f) or 0.0) for f in folds}
    models = {f: Booster(params, features, starts[f], binner) for f in folds}
    start = F.element_at(F.create_map(*[x for f in folds for x in (F.lit(f), F.lit(starts[f]))]), F.col("_fold"))
    narrow = binned(named, features, binner, ["_fold", "_train", "_key", "_at", "_y"])
    data = written(narrow.withColumn("raw", start).select("_fold", "_train", "_key", "_at", F.col("_y").alias("y"), "bins", "raw"), "boost")
    sc = None if sc is None else cut_lineage(loss.weighted(sc.withColumnRenamed(key, "_key") if key in sc.columns else sc, "_key"))
    train_st, valid_st = (None if st is None else _within(st, data.where(F.col("_train") == own), date) for own in (True, False))
    fixed = cut_lineage(loss.hessian(data.where("_train"), sc, train_st, "_key", "_at")) if params.objective is Objective.HIERARCHICAL else None
    rng, active, best, since = np.random.default_rng(params.seed), list(folds), dict.fromkeys(folds, math.inf), dict.fromkeys(folds, 0)
    limits = Limits(params.leaves, params.depth, params.min_rows, params.l1, params.l2)
    for number in range(params.rounds):
        step, made = _gradients(data.where(F.col("_train") & F.col("_fold").isin(active)), params, sc, train_st, fixed, number)
        used = sorted(rng.choice(len(features), max(1, round(params.feature_share * len(features))), replace=False).tolist())
        if params.row_share < 1:
            turn = number // max(1, params.bagging_freq)
            kept = F.pmod(F.xxhash64(F.lit(params.seed), F.lit(turn), "_key", "_at"), F.lit(1 << 20)) < int(params.row_share * (1 << 20))
            step = step.where(kept)
        trees = grow(step.withColumnRenamed("_fold", "fold"), active, binner.categorical, used, limits, n_bins)
        for f in active:
            models[f].trees.append(trees[f])
        before, data = data, written(_advanced(data.where(F.col("_fold").isin(active)), trees, params.rate, len(features)), "boost")
        for old in (before, made):
            if old is not None:
                discard(spark, old)
        if validate:
            found = scores(data.where(~F.col("_train")), active, params, sc, valid_st)
            for f in list(active):
                models[f].scores.append(found[f])
                since[f] = 0 if found[f] < best[f] else since[f] + 1
                best[f] = min(best[f], found[f])
                if since[f] >= params.patience:
                    active.remove(f)
            if not active:
                break
    for model in models.values():
        model.t_train = time.perf_counter() - began
    return models


def _gradients(data: DataFrame, params: Params, sc: DataFrame | None, st: DataFrame | None, fixed: DataFrame | None, number: int) -> tuple[DataFrame, DataFrame | None]:
    """``(_fold, _key, _at, bins, grad, hess)``, and the table that was written for it, if any."""
    errors = data.select("_key", "_at", (F.col("raw") - F.col("y")).alias("e"))
    columns = ["_fold", "_key", "_at", "bins", "grad", "hess"]
    if params.objective is Objective.TWEEDIE:
        return loss.tweedie(data, params.power).select(*columns), None
    if params.objective is Objective.L2:
        return data.withColumns({"grad": F.col("raw") - F.col("y"), "hess": F.lit(1.0)}).select(*columns), None
    if params.objective is Objective.HIERARCHICAL:
        moved = data.join(loss.gradient(errors, sc, st, "_key", "_at"), ["_key", "_at"]).join(fixed, ["_key", "_at"])
    else:
        drawn = loss.random_gradient(errors, params.max_levels, params.max_categories, params.hier_freq, params.seed, number, "_key", "_at")
        moved = data.join(drawn, ["_key", "_at"])
    made = written(moved.select(*columns), "gradients")  # read by every job of the tree
    return made, made


def _within(st: DataFrame, data: DataFrame, date: str) -> DataFrame:
    """A temporal membership over the dates of ``data``, in each fold one of its own, with the weights that its nodes have there."""
    times = data.select("_fold", "_at").distinct().withColumn("t", F.date_from_unix_date((F.col("_at") - F.col("_fold") * FOLD_DAYS).cast("int")))
    own = st.withColumnRenamed(date, "t") if date in st.columns else st
    rows = own.withColumn("t", F.col("t").cast("date")).join(times, "t")
    return cut_lineage(loss.weighted(rows.select("level_id", "aggregation", F.concat_ws("\u0001", "_fold", "value").alias("value"), "_at"), "_at"))


def _advanced(data: DataFrame, trees: dict[int, Tree], rate: float, width: int) -> DataFrame:
    """``data`` with ``raw`` moved by the fold's new tree."""
    at = data.columns.index("bins")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, bins, raw = batch.column(0).to_numpy(), matrix(batch.column(at), width), batch.column(at + 1).to_numpy().copy()
            for fold in np.unique(folds):
                rows = folds == fold
                raw[rows] += rate * trees[int(fold)].predict(bins[rows])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw)], schema=batch.schema)

    return data.mapInArrow(run, data.schema)


def scores(rows: DataFrame, folds: list[int], params: Params, sc: DataFrame | None, st: DataFrame | None) -> dict[int, float]:
    """The metric of each fold's rows; one job."""
    each = [score(rows.where(F.col("_fold") == f), params, sc, st).select(F.lit(f).alias("fold"), "score") for f in folds]
    out = each[0]
    for one in each[1:]:
        out = out.unionByName(one)
    return {r["fold"]: r["score"] for r in out.collect()}  # a row for each fold


def score(rows: DataFrame, params: Params, sc: DataFrame | None, st: DataFrame | None) -> DataFrame:
    """One row ``score``, the metric of ``rows`` (_key, _at, y, raw); lower is better."""
    yhat = F.exp("raw") if params.objective is Objective.TWEEDIE else F.col("raw")
    if params.metric is Metric.HIERARCHICAL:
        return loss.metric(rows.select("_key", "_at", (yhat - F.col("y")).alias("e")), sc, st, "_key", "_at").select(F.col("hmse").alias("score"))
    if params.metric is Metric.TWEEDIE:
        x, p = F.log(F.greatest(yhat, F.lit(1e-9))), params.power
        return rows.agg(F.avg(F.exp((2 - p) * x) / (2 - p) - F.col("y") * F.exp((1 - p) * x) / (1 - p)).alias("score"))
    return rows.agg(F.avg(F.pow(yhat - F.col("y"), 2)).alias("score"))


def folds(dates: DataFrame, n_splits: int = 6, n_days: int = 28, n_years: int = 3, date: str = "date") -> DataFrame:
    """``(fold, train_start, train_end, test_start, test_end)``: rolling origins, the latest first."""
    last = dates.agg(F.max(date).alias("last")).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    end = F.date_sub("last", F.col("fold") * n_days)
    return last.select("fold", F.date_sub(end, 366 * n_years).alias("train_start"), end.alias("train_end"), F.date_add(end, 1).alias("test_start"), F.date_add(end, n_days).alias("test_end"))


def within(rows: DataFrame, first, last, date: str = "date") -> DataFrame:
    return rows.where(F.col(date).between(F.lit(first), F.lit(last)))


#: Fixed values, the search space: name, least, greatest, whether whole, whether by logarithm.
SPACE = [
    ("l1", 1e-8, 10.0, False, True),
    ("l2", 1e-8, 10.0, False, True),
    ("leaves", 8, 1024, True, False),
    ("feature_share", 0.4, 1.0, False, False),
    ("row_share", 0.4, 1.0, False, False),
    ("bagging_freq", 1, 7, True, False),
    ("min_rows", 5, 5000, True, True),
]
TWEEDIE_SPACE = [("power", 1.1, 1.9, False, False)]
RANDOM_SPACE = [("max_levels", 2, 10, True, False), ("max_categories", 2, 1000, True, False), ("hier_freq", 1, 7, True, False)]
#: Trials that are drawn at random first; candidates that a later trial is chosen from.
STARTERS, CANDIDATES = 10, 24


def space_of(objective: Objective) -> list[tuple]:
    return SPACE + (TWEEDIE_SPACE if objective is Objective.TWEEDIE else []) + (RANDOM_SPACE if objective is Objective.RANDOM else [])


def suggestion(base: Params, done: list[tuple[Params, float]], number: int) -> Params:
    """The parameters of trial ``number``, given finished trials and their scores: a tree-structured Parzen estimator.

    Trials are cut at their best quarter (25 at most); of ``CANDIDATES`` drawn around the good ones, each parameter on its own, the
    one is taken whose density among the good over that among the others is largest.
    The first ``STARTERS`` are drawn evenly.  A trial depends on ``seed``, its number and the trials before it only.
    """
    rng = np.random.default_rng([base.seed, number])
    drawn = {}
    order = sorted(range(len(done)), key=lambda i: (done[i][1], i))
    good = set(order[: min(25, math.ceil(0.25 * len(order)))])
    for name, low, high, whole, logs in space_of(base.objective):
        a, b = (math.log(low), math.log(high)) if logs else (float(low), float(high))
        if len(done) < STARTERS:
            x = float(rng.uniform(a, b))
        else:
            known = np.array([math.log(getattr(p, name)) if logs else float(getattr(p, name)) for p, _ in done])
            best, rest = (np.array([v for i, v in enumerate(known) if (i in good) == side]) for side in (True, False))
            centres = np.append(best, (a + b) / 2)
            widths = np.append(np.full(len(best), max((b - a) / 20, (b - a) / (1 + len(best)))), b - a)
            pick = rng.integers(0, len(centres), CANDIDATES)
            tries = np.clip(rng.normal(centres[pick], widths[pick]), a, b)
            x = float(tries[np.argmax(_density(tries, best, a, b) - _density(tries, rest, a, b))])
        value = math.exp(x) if logs else x
        drawn[name] = int(min(high, max(low, round(value)))) if whole else min(high, max(low, value))
    return replace(base, **drawn)


def _density(x: np.ndarray, points: np.ndarray, a: float, b: float) -> np.ndarray:
    """Logarithm of a mixture of normal kernels at ``points``, and a wide one over the range."""
    centres = np.append(points, (a + b) / 2)
    widths = np.append(np.full(len(points), max((b - a) / 20, (b - a) / (1 + len(points)))), b - a)
    return np.log(np.mean(np.exp(-0.5 * ((x[:, None] - centres) / widths) ** 2) / widths, axis=1) + 1e-300)


def over_folds(rows: DataFrame, fold_rows: list, date: str = "date") -> DataFrame:
    """``rows`` once for each fold that has them, with ``_fold`` and ``_train``."""
    spans = [F.struct(F.lit(f["fold"]).alias("fold"), *[F.lit(f[c]).alias(c) for c in ("train_start", "train_end", "test_start", "test_end")]) for f in fold_rows]
    spread = rows.withColumn("_span", F.explode(F.array(*spans)))
    train = F.col(date).between(F.col("_span.train_start"), F.col("_span.train_end"))
    test = F.col(date).between(F.col("_span.test_start"), F.col("_span.test_end"))
    return spread.where(train | test).withColumns({"_fold": F.col("_span.fold").cast("int"), "_train": train}).drop("_span")


def trial_score(rows: DataFrame, features: list[str], params: Params, fold_rows: list, sc=None, st=None, key: str = "member", date: str = "date", categories: tuple[str, ...] = ()) -> tuple[float, int]:
    """Mean best score and mean best round over the folds, which are boosted in lockstep."""
    folds = [int(f["fold"]) for f in fold_rows]
    models = fit_folds(over_folds(rows, fold_rows, date), folds, features, params, sc, st, key, date, categories=categories)
    return float(np.mean([min(m.scores) for m in models.values()])), int(np.mean([int(np.argmin(m.scores)) + 1 for m in models.values()]))


TRIAL_SCHEMA = "number int, params string, score double, best_round int"


def study(
    rows: DataFrame, features: list[str], base: Params, n_trials: int, fold_rows: list, sc=None, st=None, key: str = "member", date: str = "date",
    path: str | None = None, categories: tuple[str, ...] = (),
) -> list[tuple[Params, float, int]]:
    """``(params, mean score, best round)`` of each trial, best first.

    Trials come one after the other, each suggested by those before.  With ``path`` each is
    written there as it ends (a row of a few numbers), and a study that was broken off goes on after its last whole trial.
    """
    spark, done = rows.sparkSession, []
    rows = cut_lineage(rows)
    for number in range(n_trials):
        place = None if path is None else f"{path}/trial={number}"
        if place is not None and complete_at(spark, place):
            r = spark.read.schema(TRIAL_SCHEMA).parquet(place).first()
            done.append((params_of(json.loads(r["params"])), r["score"], r["best_round"]))
            continue
        params = suggestion(base, [(p, s) for p, s, _ in done], number)
        found = (params, *trial_score(rows, features, params, fold_rows, sc, st, key, date, categories))
        done.append(found)
        if place is not None:
            told = json.dumps(asdict(params) | {"objective": params.objective.value, "metric": params.metric.value})
            spark.createDataFrame([(number, told, found[1], found[2])], TRIAL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(place)
    return sorted(done, key=lambda x: x[1])


def tuned(trials: list[tuple[Params, float, int]], base: Params) -> Params:
    """``base`` with the best trial's parameters, and its best round as the number of rounds; ``base`` itself without trials."""
    return replace(trials[0][0], rounds=max(1, trials[0][2]), seed=base.seed) if trials else base


def tune(rows: DataFrame, features: list[str], trials: list[Params], fold_rows: list, sc=None, st=None, key: str = "member", date: str = "date", categories: tuple[str, ...] = ()) -> list[tuple[Params, float, int]]:
    """``(params, mean score, mean best round)`` of each of given trials over the folds, best first."""
    rows = cut_lineage(rows)
    return sorted(((p, *trial_score(rows, features, p, fold_rows, sc, st, key, date, categories)) for p in trials), key=lambda x: x[1])


def recursive_predict(
    model: Booster,
    history: DataFrame,
    known: DataFrame | None,
    days: list,
    keys: list[str],
    target: str = "y",
    date: str = "date",
    clip: bool = True,
    means: str = "recursive",
) -> DataFrame:
    """``(*keys, date, yhat)`` day by day, each day's lags taken from actuals and earlier predictions.

    ``known`` has covariates of future days.  Lags are looked up by rows back in time,
    at any horizon.  Rolling means follow ``m - m / w + y / w`` with
    ``means="recursive"``, or are true means of the window with ``"window"``.
    A series' past and its covariates are one row, and the days are worked out in
    one pass over batches of series, so the horizon costs no further jobs.
    """
    lags = {f: lag_number(f) for f in model.features if lag_number(f)}
    wides = {f: window_number(f) for f in model.features if window_number(f)}
    deep = max([*lags.values(), *wides.values(), 1])
    future = history.sparkSession.createDataFrame([(i, d) for i, d in enumerate(days)], f"_day int, {date} date")
    parts = calendar_parts(F.col(date))
    given = [f for f in model.features if f not in lags and f not in wides]
    missing = [f for f in given if f not in parts and f not in keys]
    rows = history.select(*keys).distinct().join(F.broadcast(future))  # every series on the days asked for
    if missing:
        rows = rows.join(known.select(*keys, date, *missing), [*keys, date], "left")
    rows = rows.withColumns({f: parts[f] for f in given if f in parts})
    ahead = F.array([F.col(f).cast("double") for f in given]) if given else F.array().cast("array<double>")
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_day", ahead.alias("x")))).alias("ahead"))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(date)))
    past = history.withColumn("_n", back).where(F.col("_n") <= deep)
    past = past.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(target).cast("double").alias("v")))), lambda x: x["v"]).alias("past"))
    state = past.join(rows, keys).select(*keys, "past", F.transform("ahead", lambda a: a["x"]).alias("ahead"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            # newest value first; missing ones are unknown
            seen = np.full((len(batch), deep), np.nan)
            for i, p in enumerate(batch["past"]):
                seen[i, : len(p)] = [np.nan if v is None else v for v in p]
            mean = {f: np.nanmean(seen[:, :n], axis=1) for f, n in wides.items()}
            covariates = np.array([[[np.nan if v is None else v for v in x] for x in a] for a in batch["ahead"]], dtype=float).reshape(len(batch), len(days), len(given))
            for d in range(len(days)):
                x = np.empty((len(batch), len(model.features)))
                for j, f in enumerate(model.features):
                    x[:, j] = seen[:, lags[f] - 1] if f in lags else mean[f] if f in wides else covariates[:, d, given.index(f)]
                y = model.values(x)
                if clip:
                    y = np.clip(y, 0.0, 1e9)
                for f, n in wides.items():
                    mean[f] = mean[f] + (y - mean[f]) / n if means == "recursive" else np.nanmean(np.column_stack([y, seen[:, : n - 1]]), axis=1)
                seen = np.column_stack([y, seen[:, :-1]])
                yield batch[keys].assign(_day=np.int32(d), yhat=y)

    kinds = ", ".join(f"`{k}` {state.schema[k].dataType.simpleString()}" for k in keys)
    out = state.mapInPandas(run, f"{kinds}, _day int, yhat double")
    return out.join(F.broadcast(future), "_day").select(*keys, date, "yhat")


#: Fixed values, the experiments: setting (1: one model for all levels, 2: one per level, 3: bottom level and sums), objective, metric, hierarchy of the loss.
EXPERIMENTS = {
    "globalall_objse_evalmse": (1, Objective.L2, Metric.L2, ()),
    "sepagg_objse_evalmse": (2, Objective.L2, Metric.L2, ()),
    "bu_objmse_evalmse": (3, Objective.L2, Metric.L2, ()),
    "bu_objmse_evalhmse": (3, Objective.L2, Metric.HIERARCHICAL, ("cs",)),
    "bu_objtweedie_evalmse": (3, Objective.TWEEDIE, Metric.L2, ()),
    "bu_objtweedie_evalhmse": (3, Objective.TWEEDIE, Metric.HIERARCHICAL, ("cs",)),
    "bu_objtweedie_evaltweedie": (3, Objective.TWEEDIE, Metric.TWEEDIE, ()),
    "bu_objhse_evalhmse": (3, Objective.HIERARCHICAL, Metric.HIERARCHICAL, ("cs",)),
    "bu_objhse_evalmse": (3, Objective.HIERARCHICAL, Metric.L2, ("cs",)),
    "bu_objrhse_evalhmse": (3, Objective.RANDOM, Metric.HIERARCHICAL, ("cs",)),
    "bu_objhse_evalhmse_withtemp": (3, Objective.HIERARCHICAL, Metric.HIERARCHICAL, ("cs", "t")),
    "bu_objhse_evalhmse_withtemponly": (3, Objective.HIERARCHICAL, Metric.HIERARCHICAL, ("t",)),
    "bu_objhse_evalhmse_random": (3, Objective.HIERARCHICAL, Metric.HIERARCHICAL, ("random",)),
}


def experiment_grid(seeds: range = range(10)) -> list[tuple[str, int]]:
    """All experiments times seeds; each is a job of its own."""
    return [(name, seed) for name in EXPERIMENTS for seed in seeds]


def training_window(rows: DataFrame, end, n_years: int = 3, date: str = "date") -> DataFrame:
    """The rows of the ``n_years`` years of 366 days up to ``end``, both ends included."""
    return rows.where(F.col(date).between(F.date_sub(F.lit(end), 366 * n_years), F.lit(end)))


def experiment(name: str, base: Params) -> tuple[int, Params, tuple[str, ...]]:
    """Setting, parameters and sides of the loss's hierarchy of a named experiment."""
    if name not in EXPERIMENTS:
        raise ValueError(f"unknown experiment {name}")
    setting, objective, metric, sides = EXPERIMENTS[name]
    return setting, replace(base, objective=objective, metric=metric), sides


def run_experiment(
    name: str,
    rows: DataFrame,
    features: list[str],
    base: Params,
    sc: DataFrame,
    st: DataFrame,
    end_train,
    days: list,
    n_years: int = 3,
    fold_rows: list | None = None,
    models: str | None = None,
    n_trials: int = 0,
    categories: tuple[str, ...] = (),
    level: str = "aggregation",
    key: str = "value",
    date: str = "date",
    bottom: str = "bottom",
) -> tuple[DataFrame, dict[str, float]]:
    """``(method, seed, aggregation, value, date, yhat, in_sample, rounds, score)`` of one experiment, and the seconds of its steps.

    ``rows`` is the forecast set of all levels (``level``, ``key``, ``date``, ``y`` and ``features``).  Setting 1 fits one model
    to all of them, setting 2 one to each level; both predict the past from its features
    and the ``days`` ahead recursively.  Setting 3 fits the bottom level, predicts the days ahead
    and sums up.  With ``fold_rows`` (of ``folds``) the number of rounds is where the experiment's metric
    is best on average over the folds, and ``score`` is that metric; with ``n_trials`` a study over the folds comes first,
    and its best trial's parameters are used.  ``models`` is a folder of saved models and trials; found ones are used, with the
    time they took.  ``sc`` names members as ``member``, ``st`` dates as ``t``.
    """
    setting, params, sides = experiment(name, base)
    window = rows.where(F.col(date) <= F.lit(end_train))
    if setting == 3:
        window = window.where(F.col(level) == bottom)
    # a bottom member is named by its value, any other node by level and value
    window = window.withColumn("member", F.col(key) if setting == 3 else F.concat_ws("\u0001", level, key))
    own_sc = sc if "cs" in sides else loss.random_membership(window, params.max_levels, params.max_categories, params.seed) if "random" in sides else None
    own_st = st if "t" in sides else None
    groups = [None] if setting != 2 else [r[0] for r in rows.select(level).distinct().orderBy(level).collect()]  # a row for each level
    began, trained, parts = time.perf_counter(), 0.0, []
    for group in groups:
        own = window if group is None else window.where(F.col(level) == group)

        place = None if models is None else f"{models}/{name}/seed={params.seed}/{group or 'all'}"

        def make(own: DataFrame = own, place: str | None = place) -> Booster:
            chosen, score = params, []
            if fold_rows and n_trials:
                trials = study(own, features, params, n_trials, fold_rows, own_sc, own_st, "member", date, None if place is None else f"{place}/trials", categories)
                chosen, score = tuned(trials, params), [trials[0][1]]
            elif fold_rows:
                _, best, rounds = tune(own, features, [params], fold_rows, own_sc, own_st, "member", date, categories)[0]
                chosen, score = replace(params, rounds=max(1, rounds)), [best]
            made = fit(training_window(own, end_train, n_years, date), features, chosen, own_sc, own_st, "member", date, categories=categories)
            made.scores = score
            return made

        model = fit_or_load(rows.sparkSession, place, make)
        trained += model.t_train
        ahead = recursive_predict(model, own, rows, days, [level, key], "y", date).withColumn("in_sample", F.lit(False))
        if setting != 3:
            back = model.predict(own).withColumn("yhat", clipped(F.col("yhat"))).select(level, key, date, "yhat", F.lit(True).alias("in_sample"))
            ahead = ahead.unionByName(back)
        told = {"rounds": F.lit(len(model.trees)), "score": F.lit(model.scores[-1] if model.scores else None).cast("double")}
        parts.append(ahead.withColumns(told))
    tuned = time.perf_counter() - began - trained
    began = time.perf_counter()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if setting == 3:
        sums = bottom_up(out.select(F.col(key).alias("member"), date, "yhat"), sc, [date])
        out = sums.select(F.col("aggregation").alias(level), F.col("value").alias(key), date, "yhat", F.lit(False).alias("in_sample")).withColumns(told)
    out = cut_lineage(out.select(F.lit(name).alias("method"), F.lit(params.seed).alias("seed"), level, key, date, "yhat", "in_sample", "rounds", "score"))
    return out, {"t_tune": max(0.0, tuned), "t_train": trained, "t_predict": time.perf_counter() - began}


def reconciled(
    out: DataFrame,
    times: dict[str, float],
    actuals: DataFrame,
    sc: DataFrame,
    methods: tuple[str, ...] = METHODS,
    positive: bool = True,
    level: str = "aggregation",
    key: str = "value",
    date: str = "date",
    member: str = "member",
) -> tuple[DataFrame, dict[str, float]]:
    """An experiment's days ahead as they are (``base``) and by each method: ``run_experiment``'s columns but for ``in_sample``, and ``reconciliation``.

    Residuals are ``actuals`` (``level``, ``key``, ``date``, ``y``) less the experiment's own in-sample predictions.  An
    experiment without these (setting 3) sums up to a coherent whole, so only ``base`` is returned.  The seconds of each method join ``times``.
    """
    node = [F.col(level).alias("aggregation"), F.col(key).alias("value")]
    told = out.where("not in_sample").select("method", "seed", "rounds", "score", *node, date)
    training = out.where("in_sample").select(*node, date, "yhat").join(actuals.select(*node, date, "y"), ["aggregation", "value", date])
    training = written(training, "training")
    ahead = written(out.where("not in_sample").select(*node, date, "yhat"), "ahead")
    found, seconds = reconcile_all(out.sparkSession, ahead, sc, training, () if training.isEmpty() else methods, positive, member, date)
    found = found.withColumnRenamed("method", "reconciliation").join(told, ["aggregation", "value", date])
    found = found.select("method", "seed", "reconciliation", F.col("aggregation").alias(level), F.col("value").alias(key), date, "yhat", "rounds", "score")
    return found, times | seconds


def timings_table(spark: SparkSession, path: str) -> DataFrame:
    """``(scenario, seed, t_tune, t_train, t_predict, ...)`` of a grid's runs, a column for each reconciliation method, null where a scenario has none."""
    found = spark.read.option("mergeSchema", True).parquet(f"{path}/timings")
    return found.select("scenario", "seed", *[c for c in found.columns if c not in ("scenario", "seed")])


def run_grid(names: list[str], seeds: range, run: Callable, path: str, spark: SparkSession, parallel: int = 4) -> DataFrame:
    """Run experiments ``run(name, seed)`` for every name and seed, ``parallel`` at a time; forecasts and times are written below ``path``.

    Each run is independent, in a scheduler pool of its own (fair where the session schedules so), and its times, which are written last,
    are its mark: what a scenario and seed has written to its end is not run again.  The first error is raised when the runs that
    had begun are through.  When all are through, ``timings_csv`` gets a file for each scenario with a row for each seed.  Returns the forecasts.
    """

    def one(name: str, seed: int) -> None:
        place = f"scenario={name}/seed={seed}"
        if complete_at(spark, f"{path}/timings/{place}"):
            return
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{name}-{seed}")
        out, times = run(name, seed)
        out.drop("seed").write.mode("overwrite").parquet(f"{path}/forecasts/{place}")
        spark.createDataFrame([tuple(map(float, times.values()))], ", ".join(f"{k} double" for k in times)).write.mode("overwrite").parquet(f"{path}/timings/{place}")

    with ThreadPoolExecutor(parallel) as pool:
        waiting = [pool.submit(one, name, seed) for name in names for seed in seeds]
        try:
            for each in waiting:
                each.result()
        except BaseException:
            for each in waiting:
                each.cancel()
            raise
    write_csv(timings_table(spark, path).repartition("scenario").sortWithinPartitions("scenario", "seed"), f"{path}/timings_csv", "scenario")
    return spark.read.option("mergeSchema", True).parquet(f"{path}/forecasts")
