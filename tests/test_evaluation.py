import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import evaluate


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def brute_ap(y, s):
    total, last, out = y.sum(), 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        up = s >= t
        recall = y[up].sum() / total
        out += (recall - last) * y[up].mean()
        last = recall
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(9)
    y = (rng.random(300) < 0.3).astype(int)
    s = np.clip(np.round(0.3 * y + rng.random(300) * 0.7, 2), 0, 1)
    return pd.DataFrame({"label": y, "score": s})


def test_probability_metrics_brute_force(spark, data):
    row = evaluate.probability_metrics(spark.createDataFrame(data)).collect()[0]
    y, s = data.label.to_numpy(), data.score.to_numpy()
    p = np.clip(s, 2.220446049250313e-16, 1 - 2.220446049250313e-16)
    assert row.roc_auc == pytest.approx(brute_auc(y, s)) and row.average_precision == pytest.approx(brute_ap(y, s))
    assert row.brier_score == pytest.approx(np.mean((s - y) ** 2))
    assert row.log_loss == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def test_metrics_do_not_depend_on_partitioning_or_grouping(spark, data):
    df = spark.createDataFrame(data)
    both = df.withColumn("model_id", F.lit("a")).unionByName(df.withColumn("model_id", F.lit("b")).repartition(7))
    rows = evaluate.probability_metrics(both, ["model_id"]).collect()
    assert rows[0].roc_auc == pytest.approx(rows[1].roc_auc) and rows[0].average_precision == pytest.approx(rows[1].average_precision)


def test_one_class_gives_null_auc(spark):
    row = evaluate.probability_metrics(spark.createDataFrame([(0, 0.2), (0, 0.4)], "label int, score double")).collect()[0]
    assert row.roc_auc is None and row.average_precision == 0.0


def test_published_confusion_arithmetic(spark):
    cells = {"tp": 140, "fp": 84, "fn": 141, "tn": 692}
    df = spark.createDataFrame([tuple(cells.values())], "tp int, fp int, fn int, tn int")
    row = df.select(*[v.alias(k) for k, v in evaluate.confusion_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]).items()]).collect()[0]
    shown = [round(100 * row[c], 2) for c in ("precision", "recall", "f1", "f2", "balanced_accuracy")]
    assert shown == [62.5, 49.82, 55.45, 51.93, 69.5]


def test_sweep_matches_direct_thresholds(spark, data):
    df = spark.createDataFrame(data)
    sweep = {r.threshold: r for r in evaluate.threshold_sweep(df).collect()}
    points = sorted({0.0, 0.5, 1.0, *data.score})
    assert sorted(sweep) == points
    for r in evaluate.threshold_metrics(df, points).collect():
        assert sweep[r.threshold].asDict() == r.asDict()


def test_scenarios_and_fallback(spark, data):
    df = spark.createDataFrame(data)
    sweep = evaluate.threshold_sweep(df)
    rows = [r.asDict() for r in sweep.collect()]
    got = {r.scenario_id: r for r in evaluate.threshold_scenarios(sweep, recall_targets=(0.8, 1.5)).collect()}
    best = max(rows, key=lambda r: (r["f2"], r["precision"], r["recall"], r["threshold"]))
    assert got["maximum_f2"].threshold == best["threshold"]
    ok = [r for r in rows if r["recall"] >= 0.8]
    best = max(ok, key=lambda r: (r["precision"], r["f2"], r["threshold"]))
    assert got["minimum_recall_0_80"].threshold == best["threshold"] and got["minimum_recall_0_80"].target_satisfied
    lost = got["minimum_recall_1_50"]
    assert lost.target_satisfied is False
    first = max(sorted(rows, key=lambda r: r["threshold"]), key=lambda r: (r["recall"], r["precision"]))
    assert lost.threshold == first["threshold"]


def test_curves_end_points(spark, data):
    df = spark.createDataFrame(data)
    pr = evaluate.pr_curve(df).collect()
    assert len(pr) == data.score.nunique() + 1
    assert [(r.precision, r.recall) for r in pr if r.threshold is None] == [(1.0, 0.0)]
    roc = evaluate.roc_curve(df).collect()
    assert (1.0, 1.0) in {(r.fpr, r.tpr) for r in roc} and (0.0, 0.0) in {(r.fpr, r.tpr) for r in roc}


@pytest.mark.parametrize("strategy", ["uniform", "quantile"])
def test_calibration_matches_numpy(spark, data, strategy):
    got = evaluate.calibration_curve(spark.createDataFrame(data), strategy=strategy).orderBy("bin").collect()
    edges = np.linspace(0, 1, 11) if strategy == "uniform" else np.percentile(data.score, np.linspace(0, 100, 11))
    bins = np.searchsorted(edges[1:-1], data.score)
    want = data.groupby(bins).agg(n=("score", "size"), m=("score", "mean"), p=("label", "mean"))
    assert [r.n for r in got] == want.n.tolist()
    assert [r.mean_score for r in got] == pytest.approx(want.m.tolist())
    assert [r.positive_share for r in got] == pytest.approx(want.p.tolist())
    with pytest.raises(ValueError):
        evaluate.calibration_curve(spark.createDataFrame(data), strategy="other")


def test_final_evaluation_happens_once(spark, data, tmp_path):
    df, path = spark.createDataFrame(data), str(tmp_path / "scores")
    done = evaluate.evaluate_final(df, path, [0.5], {"roc_auc": 0.5})
    auc = evaluate.probability_metrics(df).collect()[0].roc_auc
    assert done.deltas.collect()[0].delta == pytest.approx(auc - 0.5)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        evaluate.evaluate_final(df, path, [0.5])


def test_calibration_and_curves_leave_out_bad_rows(spark):
    good = [(g, label, score) for g in ("a", "b") for label, score in ((0, 0.05), (1, 0.95), (1, 0.55), (0, 0.45))]
    bad = [("a", 1, None), ("a", None, 0.5), ("a", 2, 3.0), ("a", 1, float("nan")), ("c", 2, 0.5), ("c", 1, -0.1)]
    schema = "g string, label int, score double"
    clean, dirty = (spark.createDataFrame(x, schema) for x in (good, good + bad))
    for strategy in ("uniform", "quantile"):
        for groups in ([], ["g"]):
            want, found = (sorted(map(tuple, evaluate.calibration_curve(d, groups, bins=4, strategy=strategy).collect())) for d in (clean, dirty))
            assert found == want and all(0 <= r[-1] <= 1 and 0 <= r[-2] <= 1 for r in found)
    for curve in (evaluate.pr_curve, evaluate.roc_curve):
        want, found = (sorted(map(str, curve(d, ["g"]).collect())) for d in (clean, dirty))
        assert found == want


def test_quantile_calibration_of_many_groups(spark):
    df = spark.range(60_000).selectExpr("id % 20000 as g", "cast(id % 3 = 0 as int) as label", "(id % 7) / 7D as score")
    found = evaluate.calibration_curve(df, ["g"], bins=2, strategy="quantile")
    assert found.groupBy().agg(F.sum("n"), F.count_distinct("g")).first()[:] == (60_000, 20_000)
