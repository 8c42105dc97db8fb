"""Identities and small exact cases."""

import datetime as dt
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacast.functions import scalars
from stratacast.operators import baselines, boost, features, hierarchy, loss, prepare, ranking, reconcile, trees
from stratacast.sources import tables

LEVELS = hierarchy.Hierarchy.of([["g"]], ["g", "i"])


@pytest.fixture(scope="module")
def small(spark):
    """Six series of two groups over eight times, errors, and dense matrices of both hierarchies."""
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], i, t, float(rng.normal())) for i in range(6) for t in range(8)]
    df = spark.createDataFrame(rows, "g string, i int, t int, e double").withColumn("member", F.concat_ws("-", "g", "i"))
    sc = hierarchy.membership(df, LEVELS)
    times = spark.createDataFrame([(t, t // 4) for t in range(8)], "t int, half int")
    st = hierarchy.membership(times, hierarchy.Hierarchy((("half",),), ("t",), "step"), "t").withColumn("t", F.col("t").cast("int"))
    e = np.array([[x[3] for x in rows if x[1] == i] for i in range(6)])
    s = np.vstack([np.ones(6), [i % 2 == 0 for i in range(6)], [i % 2 == 1 for i in range(6)], np.eye(6)]).astype(float)
    u = np.vstack([np.ones(8), [t < 4 for t in range(8)], [t >= 4 for t in range(8)], np.eye(8)]).astype(float)
    return df, sc, st, e, s, u


def _grid(df, name):
    pdf = df.toPandas()
    pdf["i"] = pdf["member"].str.split("-").str[1].astype(int)
    return pdf.pivot(index="i", columns="t", values=name).to_numpy()


@pytest.mark.parametrize("sides", ["c", "t", "ct"])
def test_gradient_hessian_metric_match_matrices(small, sides):
    df, sc, st, e, s, u = small
    dc = np.diag(1 / (3 * s.sum(axis=1))) if "c" in sides else None
    du = np.diag(1 / (3 * u.sum(axis=1))) if "t" in sides else None
    left = s.T @ dc @ s if "c" in sides else np.eye(6)
    right = u.T @ du @ u if "t" in sides else np.eye(8)
    args = (sc if "c" in sides else None, st if "t" in sides else None)
    assert np.allclose(_grid(loss.gradient(df, *args), "grad"), left @ e @ right)
    h_c = (s.T @ np.diag(dc)) if "c" in sides else np.ones(6)
    h_t = (u.T @ np.diag(du)) if "t" in sides else np.ones(8)
    assert np.allclose(_grid(loss.hessian(df, *args), "hess"), np.outer(h_c, h_t))
    assert np.isclose(loss.metric(df, *args).first()[0], 0.5 * (e * (left @ e @ right)).sum() / 48)


def test_gradient_is_the_derivative_of_the_sum(small):
    _, _, _, e, s, u = small
    dc, du = 1 / (3 * s.sum(axis=1)), 1 / (3 * u.sum(axis=1))

    def value(x):
        return 0.5 * ((s @ x @ u.T) ** 2 * np.outer(dc, du)).sum()

    grad = s.T @ np.diag(dc) @ s @ e @ u.T @ np.diag(du) @ u
    step = np.zeros_like(e)
    step[2, 3] = 1e-5
    assert np.isclose((value(e + step) - value(e - step)) / 2e-5, grad[2, 3])


def test_zero_error_gives_zero_gradient(small):
    df, sc, *_ = small
    assert loss.gradient(df.withColumn("e", F.lit(0.0)), sc).where("grad <> 0").isEmpty()
    with pytest.raises(ValueError):
        loss.gradient(df)


def test_both_aggregations_agree(small):
    df, sc, *_ = small
    a = hierarchy.aggregate_levels(df, LEVELS, ["t"], "e")
    b = hierarchy.aggregate_by_sets(df, LEVELS, ["t"], "e")
    c = hierarchy.aggregate_members(df, sc, ["t"], "e")
    rows = [sorted((r["aggregation"], r["value"], r["t"], round(r["e"], 9)) for r in x.collect()) for x in (a, b, c)]
    assert rows[0] == rows[1] == rows[2]


def plain_covariance(r):
    """Covariance of residuals (times by nodes) shrunk to its diagonal, pair by pair."""
    t, n = r.shape
    x = r - r.mean(axis=0)
    cov = x.T @ x / t
    z = x / np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr, top, low = z.T @ z / t, 0.0, 0.0
    for i in range(n):
        for j in range(n):
            if i != j:
                top += ((z[:, i] * z[:, j] - corr[i, j]) ** 2).sum() / (t * (t - 1))
                low += corr[i, j] ** 2
    share = min(1.0, max(0.0, top / low))
    return share * np.diag(np.diag(cov)) + (1 - share) * cov + 1e-9 * np.eye(n)


def plain_projection(s, method, y, fitted):
    """Members by nodes, by dense algebra."""
    if method == "erm":
        return y[:, len(s) - s.shape[1] :].T @ np.linalg.pinv(fitted, rcond=1e-5).T
    e = y - fitted
    w = {"ols": np.eye(len(s)), "wls_struct": np.diag(s.sum(axis=1)), "wls_var": np.diag(np.maximum((e**2).mean(axis=0), 1e-9)), "mint_shrink": plain_covariance(e)}[method]
    inverse = np.linalg.inv(w)
    return np.linalg.solve(s.T @ inverse @ s, s.T @ inverse)


@pytest.fixture(scope="module")
def incoherent(spark):
    """Crossing levels over eight members, forecasts of all nodes that do not add up, in sample and ahead."""
    rng = np.random.default_rng(3)
    levels = hierarchy.Hierarchy.of([["a"], ["b"]], ["a", "b"])
    members = spark.createDataFrame([(a, b) for a in "pq" for b in range(4)], "a string, b int")
    sc = hierarchy.membership(members, levels).cache()
    pairs = sc.collect()
    nodes = sorted({(r.level_id, r.aggregation, r.value) for r in pairs})
    names = [n[2] for n in nodes if n[1] == "bottom"]
    s = np.array([[any(r.member == m and (r.aggregation, r.value) == n[1:] for r in pairs) for m in names] for n in nodes]).astype(float)
    n_times, n_dates = 30, 5
    y = np.round(rng.gamma(2, 4, (n_times, len(names))), 3) @ s.T
    hat = y + rng.normal(size=y.shape) * rng.gamma(2, 1, len(nodes)) + rng.normal(size=(n_times, 1))
    ahead = np.round(rng.gamma(2, 4, (n_dates, len(names))), 3) @ s.T + rng.normal(size=(n_dates, len(nodes))) * 4 - 3
    start = dt.date(2020, 1, 1)
    training = [(n[1], n[2], start + dt.timedelta(t), float(y[t, j]), float(hat[t, j])) for t in range(n_times) for j, n in enumerate(nodes)]
    forecasts = [(n[1], n[2], start + dt.timedelta(40 + t), float(ahead[t, j])) for t in range(n_dates) for j, n in enumerate(nodes)]
    training = spark.createDataFrame(training, "aggregation string, value string, date date, y double, yhat double")
    forecasts = spark.createDataFrame(forecasts, "aggregation string, value string, date date, yhat double")
    return sc, nodes, s, y, hat, ahead, training, forecasts


@pytest.mark.parametrize("positive", [False, True])
@pytest.mark.parametrize("method", reconcile.METHODS)
def test_reconciled_forecasts_equal_dense_algebra(spark, incoherent, method, positive):
    sc, nodes, s, y, hat, ahead, training, forecasts = incoherent
    out = reconcile.reconcile(spark, forecasts, sc, method, training, positive).toPandas()
    found = out.assign(node=list(zip(out["aggregation"], out["value"], strict=True))).pivot(index="date", columns="node", values="yhat")
    bottom = plain_projection(s, method, y, hat) @ ahead.T
    want = s @ (np.maximum(bottom, 0) if positive else bottom)
    assert np.allclose(found[[n[1:] for n in nodes]].to_numpy(), want.T, rtol=1e-6, atol=1e-6)
    assert not positive or (bottom < 0).any()


def test_all_methods_side_by_side(spark, incoherent):
    sc, _, _, _, _, _, training, forecasts = incoherent
    out, seconds = reconcile.reconcile_all(spark, forecasts, sc, training, ("ols", "erm"))
    assert {r["method"]: r["count"] for r in out.groupBy("method").count().collect()} == {"base": 75, "ols": 75, "erm": 75}
    assert list(seconds) == ["ols", "erm"] and min(seconds.values()) > 0
    with pytest.raises(ValueError):
        reconcile.reconcile(spark, forecasts, sc, "mint_shrink")
    with pytest.raises(ValueError):
        reconcile.reconcile(spark, forecasts, sc, "other")


def test_experiments_are_reconciled_with_their_own_residuals(spark, incoherent, tmp_path):
    """In-sample predictions and days ahead of one frame, as an experiment returns them; the grid's times get a column a method."""
    sc, nodes, s, y, hat, ahead, training, forecasts = incoherent
    rows = training.withColumn("in_sample", F.lit(True)).unionByName(forecasts.withColumn("in_sample", F.lit(False)), True)
    told = {"method": F.lit("global"), "seed": F.lit(3), "rounds": F.lit(7), "score": F.lit(0.5)}
    run = rows.drop("y").withColumns(told)
    actuals = training.select("aggregation", "value", "date", "y")
    times = {"t_tune": 0.0, "t_train": 1.0, "t_predict": 2.0}
    methods = ("wls_var", "mint_shrink", "erm")
    out, seconds = boost.reconciled(run, times, actuals, sc, methods)
    out = out.toPandas()
    assert set(out["reconciliation"]) == {"base", *methods} and len(out) == 4 * 75
    assert set(out["rounds"]) == {7} and set(out["seed"]) == {3} and set(out["method"]) == {"global"}
    for method in methods:
        own = out[out["reconciliation"] == method]
        found = own.assign(node=list(zip(own["aggregation"], own["value"], strict=True))).pivot(index="date", columns="node", values="yhat")
        want = s @ np.maximum(plain_projection(s, method, y, hat) @ ahead.T, 0)
        assert np.allclose(found[[n[1:] for n in nodes]].to_numpy(), want.T, rtol=1e-6, atol=1e-6)
    alone, same_times = boost.reconciled(run.where("not in_sample"), times, actuals, sc, methods)  # setting 3: nothing in sample
    assert {r[0] for r in alone.select("reconciliation").distinct().collect()} == {"base"} and same_times == times

    def grid(name, seed):
        frame = spark.createDataFrame([(name, seed, 1.5)], "method string, seed int, yhat double")
        return (frame.withColumn("reconciliation", F.lit("erm")), seconds) if name == "a" else (frame, times)

    found = boost.run_grid(["a", "b"], range(2), grid, f"file://{tmp_path}/grid", spark)
    assert {(r.scenario, r.reconciliation) for r in found.collect()} == {("a", "erm"), ("b", None)}
    held = {f.parent.name: f.read_text().splitlines() for f in (tmp_path / "grid/timings_csv").glob("scenario=*/part-*.csv")}
    assert set(held) == {"scenario=a", "scenario=b"} and all(len(lines) == 3 for lines in held.values())
    assert held["scenario=a"][0].split(",") == ["seed", "t_tune", "t_train", "t_predict", *methods]
    assert held["scenario=b"][1].startswith("0,0.0,1.0,2.0")


def test_keys_of_several_parts_are_different_for_different_parts(spark):
    rows = [("a-b", "c"), ("a", "b-c"), ("a", None), ("a", "\\N"), (None, "a"), ("a\\", "b"), ("x", "y")]
    df = spark.createDataFrame(rows, "g string, h string")
    levels = hierarchy.Hierarchy.of([["g"]], ["g", "h"])
    keys = {(r.g, r.h): r.k for r in df.select("g", "h", levels.key().alias("k")).collect()}
    assert len(set(keys.values())) == len(rows) and keys["x", "y"] == "x-y"
    sc = hierarchy.membership(df, levels).toPandas()
    assert len(sc) == 3 * len(rows) and set(sc[sc["aggregation"] == "g"]["value"]) == {"a-b", "a", "\\N", "a\\", "x"}


def test_thousands_of_members_without_a_matrix(spark):
    """30,000 members under three levels: a dense matrix would have 900 million cells."""
    members = spark.range(30_000).select((F.col("id") % 10).cast("int").alias("a"), (F.col("id") % 300).cast("int").alias("b"), F.col("id").alias("c"))
    levels = hierarchy.Hierarchy.of([["a"], ["b"]], ["a", "b", "c"])
    sc = tables.written(hierarchy.membership(members, levels), "memberships")
    bottom = members.select(levels.key().alias("member"), F.explode(F.array(F.lit(dt.date(2020, 1, 1)), F.lit(dt.date(2020, 1, 2)))).alias("date"), (F.col("c") % 7).cast("double").alias("y"))
    nodes = hierarchy.aggregate_members(bottom, sc, ["date"], "y").withColumn("yhat", F.col("y") * (1 + F.col("level_id") / 100))
    out = reconcile.reconcile(spark, nodes, sc, "wls_struct").groupBy("aggregation", "date").agg(F.sum("yhat").alias("s")).toPandas()
    assert np.allclose(out.groupby("date")["s"].transform("max"), out["s"]) and len(out) == 8


def test_tree_form_equals_the_solve():
    s = np.vstack([np.ones(3), np.eye(3)])
    w = np.array([4.0, 1.0, 2.0, 3.0])
    right = np.linalg.solve(np.diag(w), s)
    p = np.linalg.solve(s.T @ right, right.T)
    hat = np.array([10.0, 1.0, 2.0, 3.0])
    assert np.allclose(p @ hat, hat[1:] + w[1:] * (hat[0] - hat[1:].sum()) / w.sum())


def test_random_hierarchy_does_not_depend_on_partitions(small):
    df, *_ = small
    a = loss.random_membership(df, 4, 5, seed=2)
    b = loss.random_membership(df.repartition(7), 4, 5, seed=2)
    assert sorted(a.collect()) == sorted(b.collect())
    sizes = hierarchy.node_sizes(a).collect()
    assert all(r["n_members"] > 0 for r in sizes)


def test_fills_and_lags(spark):
    rows = [("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, 7.0), ("b", 2, None)]
    df = spark.createDataFrame(rows, "s string, d int, y double")
    both = df.withColumn("f", features.filled_both_ways("y", ("s",), "d")).orderBy("s", "d").collect()
    assert [r["f"] for r in both] == [5, 5, 5, 7, 7]
    across = features.backfilled(df, "y", ["s"], ["d"], across=True).orderBy("s", "d").collect()
    assert [r["y"] for r in across] == [5, 5, 7, 7, None]
    own = features.backfilled(df, "y", ["s"], ["d"]).orderBy("s", "d").collect()
    assert [r["y"] for r in own] == [5, 5, None, 7, None]
    shifted = features.add_lags(df, lags=(1,), forecast_day=1, series=("s",), date="d").orderBy("s", "d").collect()
    assert [r["y_lag1"] for r in shifted] == [None, None, None, None, None]
    with pytest.raises(ValueError):
        features.add_rolling_means(df)


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.clipped(F.lit(-2.0)).alias("a"), scalars.clipped(F.lit(None).cast("double")).alias("b"), scalars.price_change(F.lit(2.0), F.lit(0.0)).alias("c")
    ).first()
    assert (row.a, row.b, row.c) == (0.0, None, None)
    assert (scalars.lag_number("y_lag28"), scalars.lag_number("y_lag1_mavg7"), scalars.window_number("y_lag1_mavg7")) == (28, None, 7)


def test_classical_models_fall_back_and_repeat_a_season():
    y = np.tile([1.0, 2, 3, 4, 5, 6, 7], 8)
    for name in ("ets", "theta", "arima"):
        _, ahead = baselines.MODELS[name](y, 7)
        assert np.abs(ahead - y[:7]).max() < 1.0, name
    assert np.allclose(baselines.croston(np.zeros(5), 3)[1], 0)


def test_families_find_the_process_they_are_made_for():
    rng = np.random.default_rng(2)
    t = np.arange(210)
    growing = (20 + 0.5 * t) * np.tile([0.5, 0.8, 1.0, 1.0, 1.1, 1.2, 1.4], 30)
    assert np.abs(baselines.ets(growing, 7)[1] / ((20 + 0.5 * (210 + np.arange(7))) * np.array([0.5, 0.8, 1.0, 1.0, 1.1, 1.2, 1.4])) - 1).max() < 0.1
    shocks = rng.normal(size=600)
    moving = 10 + shocks[1:] + 0.8 * shocks[:-1]
    fitted, ahead = baselines.arima(moving, 5)
    assert ((fitted[20:] - moving[20:]) ** 2).mean() < 1.2 < moving.var() and np.abs(ahead[1:] - 10).max() < 1.0


def test_random_gradient_matches_matrices(small):
    df, _, _, e, *_ = small
    drawn = loss.random_membership(df, 4, 5, seed=2, draw=3).toPandas()
    nodes = drawn.groupby(["level_id", "value"])["member"].apply(set)
    s = np.array([[any(m.endswith(f"-{i}") for m in members) for i in range(6)] for members in nodes]).astype(float)
    d = 1 / (drawn["level_id"].nunique() * s.sum(axis=1))
    out = loss.random_gradient(df, 4, 5, 1, seed=2, draw=3)
    assert np.allclose(_grid(out, "grad"), s.T @ np.diag(d) @ s @ e)
    assert np.allclose(_grid(out, "hess"), np.outer(s.T @ d, np.ones(8)))


def test_a_leaf_is_the_regularised_newton_step(spark):
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(t), float(t >= 5), 3.0 if t >= 5 else -1.0) for t in range(8)]
    df = spark.createDataFrame(rows, "member string, date date, x double, y double")
    model = boost.fit(df, ["x"], boost.Params(rounds=1, rate=1.0, depth=1, min_rows=1, l1=0.5, l2=2.0))
    # the mean is 0.5; sums of gradients 7.5 over 5 rows and -7.5 over 3
    got = {r["x"]: r["yhat"] for r in model.predict(df).collect()}
    assert np.isclose(got[0.0], 0.5 - 7.0 / 7.0) and np.isclose(got[1.0], 0.5 + 7.0 / 5.0)


def test_trees_as_arrays_predict_what_was_trained(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(str(i), dt.date(2020, 1, 1) + dt.timedelta(t), *map(float, rng.normal(size=3))) for i in range(6) for t in range(40)]
    df = spark.createDataFrame(rows, "member string, date date, x double, z double, y double")
    params = boost.Params(rounds=4, rate=0.5, depth=3, min_rows=1, feature_share=0.5, row_share=0.8, bagging_freq=2, l2=1.0)
    model = boost.fit(df, ["x", "z"], params, valid=df)
    found = model.predict(df).toPandas()
    assert np.isclose(((found["yhat"] - found["y"]) ** 2).mean(), model.scores[-1])
    model.save(spark, f"file://{tmp_path}/m")
    calls = []
    again = boost.fit_or_load(spark, f"file://{tmp_path}/m", lambda: calls.append(1))
    assert not calls and again.params == params and again.t_train == model.t_train > 0
    assert np.allclose(again.predict(df).toPandas()["yhat"], found["yhat"])


def _experiment_panel(spark):
    rng = np.random.default_rng(7)
    rows = [("ab"[i % 2], str(i), dt.date(2020, 1, 1) + dt.timedelta(t), float(rng.poisson(3 + 2 * (t % 7 == 0) + i))) for i in range(4) for t in range(80)]
    facts = spark.createDataFrame(rows, "g string, i string, date date, y double")
    panel = hierarchy.aggregate_levels(facts, LEVELS, ["date"], "y")
    panel = features.add_calendar(features.add_lags(panel, lags=(1, 7))).na.drop("any")
    members = facts.withColumn("member", F.concat_ws("-", "g", "i"))
    return panel, hierarchy.membership(members, LEVELS), [dt.date(2020, 3, 14) + dt.timedelta(i) for i in range(5)]


def test_experiments_differ_by_level_metric_and_hierarchy(spark, tmp_path):
    panel, sc, days = _experiment_panel(spark)
    times = panel.select("date").distinct().withColumn("week", F.weekofyear("date"))
    st = hierarchy.membership(times, hierarchy.Hierarchy((("week",),), ("date",), "day"), "t").withColumn("t", F.col("t").cast("date"))
    end, names = days[0] - dt.timedelta(days=1), ["y_lag1", "y_lag7", "dayofweek"]
    base = boost.Params(rounds=3, rate=0.5, depth=2, min_rows=2)
    out = {}
    for name in ("globalall_objse_evalmse", "sepagg_objse_evalmse", "bu_objmse_evalmse", "bu_objtweedie_evalmse", "bu_objhse_evalhmse", "bu_objhse_evalhmse_withtemp", "bu_objhse_evalhmse_withtemponly", "bu_objrhse_evalhmse", "bu_objhse_evalhmse_random"):
        found, times_taken = boost.run_experiment(name, panel, names, base, sc, st, end, days)
        found = found.toPandas()
        ahead = found[~found["in_sample"]].set_index(["aggregation", "value", "date"])["yhat"].sort_index()
        assert len(ahead) == 7 * 5 and found["in_sample"].any() == (not name.startswith("bu_"))
        assert times_taken["t_train"] > 0
        if name.startswith("bu_"):  # coherent
            sums = ahead.groupby(level=["aggregation", "date"]).sum().unstack("aggregation")
            assert np.allclose(sums["Total"], sums["bottom"]) and np.allclose(sums["g"], sums["bottom"])
        out[name] = ahead
    results = list(out.values())
    assert all(not np.allclose(a, b) for i, a in enumerate(results) for b in results[:i])
    # the metric decides what validation scores are, and with them the number of rounds
    bottom = panel.where("aggregation = 'bottom'").withColumn("member", F.col("value"))
    held = bottom.where(F.col("date") >= F.lit(days[0]))
    scores = {}
    for metric in (boost.Metric.L2, boost.Metric.HIERARCHICAL):
        params = boost.Params(metric=metric, rounds=2, rate=0.5, depth=2, min_rows=2)
        scores[metric] = boost.fit(bottom.where(F.col("date") < F.lit(days[0])), names, params, sc, valid=held).scores
    assert not np.allclose(*scores.values())


def test_the_grid_runs_each_seed_once(spark, tmp_path):
    calls = []

    def run(name, seed):
        calls.append((name, seed))
        return spark.createDataFrame([(name, seed, "Total", 1.5)], "method string, seed int, aggregation string, yhat double"), {"t_train": 1.0}

    for _ in range(2):
        out = boost.run_grid(["a", "b"], range(2), run, f"file://{tmp_path}/grid", spark)
    assert len(calls) == 4 and sorted((r.scenario, r.seed) for r in out.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_boosting_learns_and_stops(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i), dt.date(2020, 1, 1) + dt.timedelta(t), float(x := rng.integers(0, 5)), float(3 * x + 1)) for i in range(4) for t in range(30)]
    df = spark.createDataFrame(rows, "member string, date date, x double, y double")
    model = boost.fit(df, ["x"], boost.Params(rounds=6, rate=0.7, depth=3, patience=2), valid=df)
    assert model.scores[-1] < 0.1 * model.scores[0] + 1e-6
    wrong = model.predict(df).where("abs(yhat - y) > 0.5").count()
    assert wrong == 0
    assert len(boost.experiment_grid()) == 130
    with pytest.raises(ValueError):
        boost.experiment("unknown", boost.Params())
    with pytest.raises(ValueError):
        boost.fit(df, ["x"], boost.Params(objective=boost.Objective.HIERARCHICAL))


def test_recursion_uses_its_own_predictions(spark):
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(t), float(t % 2)) for t in range(20)]
    df = features.add_lags(spark.createDataFrame(rows, "member string, date date, y double"), lags=(1, 2), series=("member",)).na.drop("any")
    model = boost.fit(df, ["y_lag1", "y_lag2"], boost.Params(rounds=1, rate=1.0, depth=2, min_rows=1))
    days = [dt.date(2020, 1, 21) + dt.timedelta(t) for t in range(4)]
    out = boost.recursive_predict(model, df.select("member", "date", "y"), None, days, ["member"]).orderBy("date").collect()
    assert [round(r["yhat"], 6) for r in out] == [0.0, 1.0, 0.0, 1.0]


def test_sinks_and_memo(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, "m", "Total", "Total", dt.date(2020, 1, 1), 2.0)], tables.FORECAST_SCHEMA)
    path = f"file://{tmp_path}/forecasts"
    tables.write_partitioned(df, path, "scenario", "method")
    assert tables.read_forecasts(spark, path, "s").count() == 1
    assert tables.read_forecasts(spark, path, "other").count() == 0
    calls = []

    def make():
        calls.append(1)
        return df

    for _ in range(2):
        tables.memoised(spark, f"file://{tmp_path}/memo", make)
    assert len(calls) == 1
    with pytest.raises(ValueError):
        tables.complete(df.withColumn("yhat", F.lit(None)), "yhat")
    tables.write_csv(df, f"file://{tmp_path}/csv")
    assert tables.read_csv(spark, f"file://{tmp_path}/csv", tables.FORECAST_SCHEMA).first()["yhat"] == 2.0


def test_product_table(spark):
    calendar = [(f"2020-01-0{i + 1}", f"d_{i + 1}", i // 2, None, "Sport" if i == 1 else None, None, None, int(i == 0), 0, 1) for i in range(6)]
    calendar = spark.createDataFrame(calendar, "date string, d string, wm_yr_wk int, event_name_1 string, event_type_1 string, event_name_2 string, event_type_2 string, snap_CA int, snap_TX int, snap_WI int")
    sales = spark.createDataFrame([("b_s", "b", "D", "C", "s", "X", 1, 2, 3, 4), ("a_s", "a", "D", "C", "s", "X", 0, 0, 5, 6)], "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string, d_1 int, d_2 int, d_3 int, d_4 int")
    prices = spark.createDataFrame([("s", "a", 1, 2.5), ("s", "a", 2, 3.0), ("s", "b", 1, 7.0)], "store_id string, item_id string, wm_yr_wk int, sell_price double")
    out = prepare.product_table(calendar, sales, prices, horizon=2)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in tables.PRODUCT_SCHEMA]
    got = {(r.id, str(r.date)[-1]): (r.sales, r.sell_price, r.weeks_on_sale) for r in out.collect()}
    assert len(got) == 12
    assert [got["a_s", str(i)] for i in range(1, 7)] == [(0, 2.5, 0), (0, 2.5, 0), (5, 2.5, 1), (6, 2.5, 1), (0, 3.0, 2), (0, 3.0, 2)]
    # the last product has no later price
    assert [got["b_s", str(i)] for i in range(1, 7)] == [(1, 7.0, 0), (2, 7.0, 0), (3, 7.0, 1), (4, 7.0, 1), (0, None, 0), (0, None, 0)]
    first = out.where("id = 'b_s' and date = '2020-01-02'").first()
    assert (first.id_enc, first.item_id_enc, first.snap_CA, first.snap_WI, first.event_type_1_enc, first.event_type_2_enc) == (1, 1, 0, 1, 0, 0)


def test_product_reader_pushes_filters(spark, tmp_path):
    row = (1.0, dt.date(2020, 1, 2), "x", 0, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 1.5, 2)
    spark.createDataFrame([row], tables.PRODUCT_SCHEMA).write.parquet(f"file://{tmp_path}/p")
    found = tables.read_products(spark, f"file://{tmp_path}/p", "2020-01-01", "2020-12-31", store_id=3, columns=["sales", "date"])
    assert found.count() == 1
    assert "PushedFilters: [IsNotNull" in found._jdf.queryExecution().toString()


def test_streaming_counts_equal_batch(spark, tmp_path):
    from stratacast.streaming.counts import daily_counts

    rows = [(dt.datetime(2024, 1, 1, 5), "a"), (dt.datetime(2024, 1, 1, 23), "a"), (dt.datetime(2024, 1, 2, 1), "b")]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"file://{tmp_path}/in")
    q = daily_counts(stream, "event_type").writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.date), r.event_type, r.y) for r in spark.sql("select * from daily").collect()) == [("2024-01-01", "a", 2), ("2024-01-02", "b", 1)]


def plain_tree(bins, g, h, leaves, min_rows, l2):
    """Best-first growth by brute force on whole rows; the sums of squared steps of its leaves' rows."""
    def worth(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + l2)

    def best(rows):
        found = None
        for j in range(bins.shape[1]):
            for t in np.unique(bins[rows, j])[:-1]:
                left, right = rows[bins[rows, j] <= t], rows[bins[rows, j] > t]
                if min(len(left), len(right)) >= min_rows:
                    gain = worth(left) + worth(right) - worth(rows)
                    if gain > 1e-9 and (found is None or gain > found[0] + 1e-12):
                        found = (gain, left, right)
        return found

    parts = [np.arange(len(bins))]
    splits = [best(parts[0])]
    while len(parts) < leaves and any(s is not None for s in splits):
        at = max((i for i, s in enumerate(splits) if s is not None), key=lambda i: splits[i][0])
        _, left, right = splits[at]
        parts[at], splits[at] = left, best(left)
        parts.append(right)
        splits.append(best(right))
    out = np.zeros(len(bins))
    for rows in parts:
        out[rows] = -g[rows].sum() / (h[rows].sum() + l2)
    return out, len(parts)


@pytest.mark.parametrize("leaves", [2, 5, 12])
def test_trees_grow_best_first(spark, leaves):
    rng = np.random.default_rng(leaves)
    bins = rng.integers(1, 8, (300, 3)).astype(np.uint8)
    g, h = rng.normal(size=300) + (bins[:, 0] > 4) - 2.0 * (bins[:, 1] * bins[:, 2] > 20), rng.uniform(0.5, 2, 300)
    rows = [(i % 2, bytes(b), float(x), float(y)) for i, (b, x, y) in enumerate(zip(bins, g, h, strict=True))]
    step = spark.createDataFrame(rows, "fold int, bins binary, grad double, hess double").repartition(3)
    made = trees.grow(step, [0, 1], [False] * 3, [0, 1, 2], trees.Limits(leaves, 16, 5, 0.0, 1.0), 10)
    for fold in (0, 1):
        own = slice(fold, None, 2)
        want, n = plain_tree(bins[own], g[own], h[own], leaves, 5, 1.0)
        assert np.allclose(made[fold].predict(bins[own]), want) and (made[fold].feature < 0).sum() == n


def test_categories_split_by_their_steps_not_by_their_order(spark):
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(t), float(t % 6), 10.0 if t % 6 in (0, 3, 5) else 0.0) for t in range(120)]
    df = spark.createDataFrame(rows, "member string, date date, code double, y double")
    params = boost.Params(rounds=1, rate=1.0, leaves=2, min_rows=1)
    found = boost.fit(df, ["code"], params, categories=("code",)).predict(df).toPandas()
    assert np.allclose(found["yhat"], found["y"])
    assert not np.allclose(*(boost.fit(df, ["code"], params).predict(df).toPandas()[c] for c in ("yhat", "y")))


def test_folds_in_lockstep_equal_fits_of_their_own(spark):
    rng = np.random.default_rng(6)
    rows = [("uvw"[i], dt.date(2020, 1, 1) + dt.timedelta(t), float(rng.integers(0, 5)), float(rng.normal() + i)) for i in range(3) for t in range(40)]
    df = spark.createDataFrame(rows, "member string, date date, x double, y double")
    sc = hierarchy.membership(df.withColumn("g", F.col("member") != "u"), hierarchy.Hierarchy.of([["g"]], ["g", "member"]), "name").withColumn("member", F.substring_index("name", "-", -1)).drop("name")
    spans = [{"fold": f, "train_start": dt.date(2020, 1, 1), "train_end": dt.date(2020, 1, 20 + f), "test_start": dt.date(2020, 1, 21 + f), "test_end": dt.date(2020, 1, 25 + f)} for f in (1, 2)]
    params = boost.Params(objective=boost.Objective.HIERARCHICAL, metric=boost.Metric.HIERARCHICAL, rounds=3, rate=0.5, leaves=4, min_rows=2)
    both = boost.fit_folds(boost.over_folds(df, spans), [1, 2], ["x"], params, sc, key="member", categories=("x",))
    for s in spans:
        train, test = (boost.within(df, s[f"{k}_start"], s[f"{k}_end"]) for k in ("train", "test"))
        own = boost.fit(train, ["x"], params, sc, key="member", valid=test, categories=("x",))
        assert np.allclose(own.scores, both[s["fold"]].scores) and np.isclose(own.start, both[s["fold"]].start)


def test_a_study_goes_on_where_it_was_broken_off(monkeypatch, spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(t), float(x := rng.integers(0, 9)), float(x % 3 + 0.1 * rng.normal())) for t in range(60)]
    df = spark.createDataFrame(rows, "member string, date date, x double, y double")
    spans = [{"fold": 1, "train_start": dt.date(2020, 1, 1), "train_end": dt.date(2020, 2, 10), "test_start": dt.date(2020, 2, 11), "test_end": dt.date(2020, 2, 25)}]
    base, calls = boost.Params(rounds=2, rate=0.5, patience=1, seed=3), []
    real = boost.trial_score
    monkeypatch.setattr(boost, "trial_score", lambda *a, **k: calls.append(1) or real(*a, **k))
    path = f"file://{tmp_path}/study"
    boost.study(df, ["x"], base, 2, spans, path=path)
    whole = boost.study(df, ["x"], base, 3, spans, path=path)
    assert len(calls) == 3 and len(whole) == 3 and whole[0][1] == min(s for _, s, _ in whole)
    best = boost.tuned(whole, base)
    assert best.rounds == whole[0][2] and best.leaves == whole[0][0].leaves and best.seed == 3


def test_later_trials_gather_near_good_ones():
    """A score that is least at few leaves and a large l2: the suggestions move there."""
    base, done = boost.Params(seed=1), []
    for number in range(60):
        p = boost.suggestion(base, done, number)
        assert 8 <= p.leaves <= 1024 and 1e-8 <= p.l1 <= 10 and 0.4 <= p.row_share <= 1 and 5 <= p.min_rows <= 5000
        done.append((p, abs(np.log(p.leaves / 100)) + abs(np.log10(p.l2) + 3)))
    first, last = (np.mean([s for _, s in part]) for part in (done[:10], done[-15:]))
    assert last < 0.7 * first
    assert boost.suggestion(base, done[:20], 20) == boost.suggestion(base, done[:20], 20)


def test_the_grid_runs_side_by_side_and_mends_what_is_half_written(spark, tmp_path):
    barrier, path = threading.Barrier(2, timeout=60), f"file://{tmp_path}/grid"

    def run(name, seed):
        barrier.wait()  # only met if two runs are under way at once
        return spark.createDataFrame([(name, seed, 1.5)], "method string, seed int, yhat double"), {"t_train": 1.0}

    boost.run_grid(["a", "b"], range(1), run, path, spark, parallel=2)
    (tmp_path / "grid/timings/scenario=a/seed=0/_SUCCESS").unlink()
    calls = []

    def again(name, seed):
        calls.append(name)
        return spark.createDataFrame([(name, seed, 2.5)], "method string, seed int, yhat double"), {"t_train": 1.0}

    assert {r["scenario"]: r["yhat"] for r in boost.run_grid(["a", "b"], range(1), again, path, spark).collect()} == {"a": 2.5, "b": 1.5} and calls == ["a"]
    with pytest.raises(ZeroDivisionError):
        boost.run_grid(["c"], range(1), lambda n, s: 1 / 0, path, spark)


def test_places_in_an_order_and_memo_of_half_written_tables(spark, tmp_path):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i // 4, "x") for i in range(200)], "g int, v int, g0 string").repartition(5)
    got = ranking.numbered(df, ["v"], ["g"]).toPandas()
    for _, own in got.groupby("g", dropna=False):
        own = own.sort_values("number")
        assert own["number"].tolist() == list(range(len(own))) and own["v"].is_monotonic_increasing
    assert sorted(r[0] for r in ranking.numbered(df, ["v"]).select("number").collect()) == list(range(200))
    place = f"file://{tmp_path}/memo"
    tables.memoised(spark, place, lambda: df)
    (tmp_path / "memo/_SUCCESS").unlink()
    assert tables.memoised(spark, place, lambda: df.limit(3)).count() == 3
