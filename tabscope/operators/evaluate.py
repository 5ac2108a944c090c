"""Exact classifier metrics on a scored table (label 0/1, score, optional groups).

Everything order-dependent is read from running totals over *distinct scores*;
no metric sorts or gathers the scored rows in one task.  ``groups`` (model, fold)
are declared names, and all groups are evaluated in the same pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import f_beta, ratio, ratio_or_zero
from .checks import assert_checks, checks_from
from .effects import bin_of
from .scale import exact_quantiles, ordered_totals

# Fixed value: smallest distance of a probability from 0 and 1 in the log loss.
EPSILON = 2.220446049250313e-16


def _usable(label: str, score: str) -> Column:
    """Label 0 or 1, score a number from 0 to 1."""
    good = F.col(label).isin(0, 1) & ~F.isnan(F.col(score).cast("double")) & F.col(score).between(0, 1)
    return F.coalesce(good, F.lit(False))


def score_checks(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Check rows on a scored table; the metrics leave out the rows they count."""
    number = F.col(score).cast("double")
    bad = {
        "score_not_null": number.isNull(), "score_not_nan": F.isnan(number),
        "score_in_range": ~F.isnan(number) & ~number.between(0, 1), "label_not_null": F.col(label).isNull(), "label_zero_or_one": ~F.col(label).isin(0, 1),
    }
    summary = scored.agg(*[F.count_if(c).alias(n) for n, c in bad.items()])
    return checks_from(summary, [(n, "scored", score if n.startswith("score") else label, F.col(n)) for n in bad])


def excluded_rows(scored: DataFrame, groups: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """(groups, rows, excluded): rows that no metric counts."""
    return scored.groupBy(*groups).agg(F.count("*").alias("rows"), F.count_if(~_usable(label, score)).alias("excluded"))


def score_counts(scored: DataFrame, groups: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """(groups, score, n, pos), one row per distinct score of usable rows."""
    return scored.where(_usable(label, score)).groupBy(*groups, F.col(score).alias("score")).agg(
        F.count("*").alias("n"), F.sum(label).cast("bigint").alias("pos")
    )


def _descending(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    return ordered_totals(counts, "score", ["n", "pos"], groups, descending=True)


def probability_metrics(
    scored: DataFrame, groups: Sequence[str] = (), label: str = "label", score: str = "score"
) -> DataFrame:
    """Average precision, ROC-AUC, log loss and Brier score per group."""
    c = _descending(score_counts(scored, groups, label, score), groups)
    pos, n = F.col("pos").cast("double"), F.col("n").cast("double")
    neg = n - pos
    above = F.col("cum_pos") - pos / 2  # positives ranked above, ties count half
    p = F.least(F.greatest(F.col("score"), F.lit(EPSILON)), F.lit(1 - EPSILON))
    sums = c.groupBy(*groups).agg(
        F.max("total_n").alias("n"),
        F.max("total_pos").alias("positives"),
        F.sum(pos * F.col("cum_pos") / F.col("cum_n")).alias("_ap"),
        F.sum(neg * above).alias("_auc"),
        F.sum(pos * F.ln(p) + neg * F.ln(1 - p)).alias("_ll"),
        F.sum(pos * F.pow(1 - F.col("score"), 2) + neg * F.pow(F.col("score"), 2)).alias("_b"),
    )
    n, pos = F.col("n").cast("double"), F.col("positives").cast("double")
    return sums.select(
        *groups,
        "n",
        "positives",
        ratio_or_zero(F.col("_ap"), pos).alias("average_precision"),
        F.try_divide(F.col("_auc"), pos * (n - pos)).alias("roc_auc"),
        (-F.try_divide(F.col("_ll"), n)).alias("log_loss"),
        F.try_divide(F.col("_b"), n).alias("brier_score"),
    )


def confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Rates of a confusion table; a zero denominator gives 0."""
    precision, recall = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    hit, miss = ratio(tp, tp + fn), ratio(tn, tn + fp)
    balanced = F.coalesce((hit + miss) / 2, hit, miss)
    total = tp + fp + fn + tn
    return {
        "precision": precision,
        "recall": recall,
        "f1": f_beta(precision, recall, 1.0),
        "f2": f_beta(precision, recall, 2.0),
        "balanced_accuracy": balanced,
        "accuracy": ratio_or_zero(tp + tn, total),
        "true_positives": tp,
        "false_positives": fp,
        "true_negatives": tn,
        "false_negatives": fn,
        "predicted_positive_count": tp + fp,
        "predicted_positive_rate": ratio_or_zero(tp + fp, total),
    }


def threshold_metrics(
    scored: DataFrame,
    thresholds: Sequence[float],
    groups: Sequence[str] = (),
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """Confusion counts and rates at fixed thresholds, one conditional aggregate."""
    y = F.col(label) == 1
    parts = [F.count("*").alias("n"), F.count_if(y).alias("p")]
    entries = []
    for i, t in enumerate(thresholds):
        up = F.col(score) >= F.lit(float(t))
        parts += [F.count_if(up & y).alias(f"tp{i}"), F.count_if(up).alias(f"up{i}")]
        tp, fp = F.col(f"tp{i}"), F.col(f"up{i}") - F.col(f"tp{i}")
        fn = F.col("p") - tp
        tn = F.col("n") - F.col("p") - fp
        named = confusion_metrics(tp, fp, fn, tn)
        entries.append(F.struct(F.lit(float(t)).alias("threshold"), *[v.alias(k) for k, v in named.items()]))
    return scored.where(_usable(label, score)).groupBy(*groups).agg(*parts).select(*groups, F.inline(F.array(*entries)))


def threshold_sweep(
    scored: DataFrame,
    groups: Sequence[str] = (),
    label: str = "label",
    score: str = "score",
    extra: Sequence[float] = (0.0, 0.5, 1.0),
) -> DataFrame:
    """Metrics at every distinct score and at the extra thresholds."""
    counts = score_counts(scored, groups, label, score)
    zero = F.lit(0).cast("bigint")
    fixed = F.explode(F.array(*[F.lit(float(t)) for t in extra])).alias("score")
    # One row per group and extra threshold, with no rows behind it.
    present = counts.groupBy(*groups).agg(F.count("*").alias("_k")).select(*groups, fixed, zero.alias("n"), zero.alias("pos"))
    merged = counts.unionByName(present).groupBy(*groups, "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    c = _descending(merged, groups)
    tp, fp = F.col("cum_pos"), F.col("cum_n") - F.col("cum_pos")
    fn = F.col("total_pos") - tp
    tn = F.col("total_n") - F.col("total_pos") - fp
    named = confusion_metrics(tp, fp, fn, tn)
    return c.select(*groups, F.col("score").alias("threshold"), *[v.alias(k) for k, v in named.items()])


def threshold_scenarios(
    sweep: DataFrame, groups: Sequence[str] = (), recall_targets: Sequence[float] = (0.70, 0.80, 0.90)
) -> DataFrame:
    """Default, best-F and minimum-recall operating points of a sweep.

    Every choice is a maximum of an ordered struct, so all scenarios come from
    one aggregation with map-side combine.
    """
    row = F.struct(*[F.col(c) for c in sweep.columns if c not in groups])

    def best(*order: Column | str, where: Column | None = None) -> Column:
        key = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
        value = F.struct(key.alias("k"), row.alias("r"))
        return F.max(F.when(where, value) if where is not None else value)

    tail = ("precision", "recall", "threshold")
    picks: list[tuple[str, Column, float | None]] = [
        ("default_0_50", best("threshold", where=F.col("threshold") == 0.5), None),
        ("maximum_f1", best("f1", *tail), None),
        ("maximum_f2", best("f2", *tail), None),
    ]
    fallback = best("recall", "precision", (-F.col("threshold")).alias("low"))
    for t in recall_targets:
        name = f"minimum_recall_{t:.2f}".replace(".", "_")
        picks.append((name, best("precision", "f2", "threshold", where=F.col("recall") >= t), float(t)))
    aggs = [v.alias(f"s{i}") for i, (_, v, _) in enumerate(picks)]
    chosen = sweep.groupBy(*groups).agg(*aggs, fallback.alias("s_fallback"))
    entries = []
    for i, (name, _, t) in enumerate(picks):
        met = F.col(f"s{i}").isNotNull()
        pick = F.coalesce(F.col(f"s{i}.r"), F.col("s_fallback.r")) if t is not None else F.col(f"s{i}.r")
        entries.append(
            F.struct(
                F.lit(name).alias("scenario_id"),
                F.lit(t).cast("double").alias("recall_target"),
                (met if t is not None else F.lit(None).cast("boolean")).alias("target_satisfied"),
                pick.alias("row"),
            )
        )
    flat = chosen.select(*groups, F.inline(F.array(*entries)))
    return flat.select(*groups, "scenario_id", "recall_target", "target_satisfied", "row.*")


def pr_curve(scored: DataFrame, groups: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Precision and recall at every distinct score, plus the end point (1, 0)."""
    c = _descending(score_counts(scored, groups, label, score), groups)
    points = c.select(
        *groups,
        F.col("score").alias("threshold"),
        ratio(F.col("cum_pos"), F.col("cum_n")).alias("precision"),
        F.coalesce(ratio(F.col("cum_pos"), F.col("total_pos")), F.lit(1.0)).alias("recall"),
    )
    end = scored.where(_usable(label, score)).groupBy(*groups).agg(F.count("*").alias("_n")).select(
        *groups, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def roc_curve(scored: DataFrame, groups: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """FPR and TPR at every distinct score, plus (0, 0) at an infinite threshold.

    All points are kept; collinear ones do not change the curve.
    """
    c = _descending(score_counts(scored, groups, label, score), groups)
    points = c.select(
        *groups,
        F.col("score").alias("threshold"),
        ratio(F.col("cum_n") - F.col("cum_pos"), F.col("total_n") - F.col("total_pos")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
    )
    start = scored.where(_usable(label, score)).groupBy(*groups).agg(F.count("*").alias("_n")).select(
        *groups, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def calibration_curve(
    scored: DataFrame,
    groups: Sequence[str] = (),
    *,
    bins: int = 10,
    strategy: str = "uniform",
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """Mean score and positive share per score bin of usable rows; empty bins are absent.

    Quantile edges come from each group's own scores and are joined by group, so groups
    are not bounded in number.
    """
    s, scored = F.col(score), scored.where(_usable(label, score))
    if strategy == "uniform":
        index = F.lit(1)
        for i in range(1, bins):
            index = index + (F.lit(i * (1.0 / bins)) < s).cast("int")
        placed = scored.withColumn("bin", index)
    elif strategy == "quantile":
        names = {f"e{i}": i / bins for i in range(bins + 1)}
        if groups:
            tagged = scored.withColumn("_g", F.to_json(F.struct(*groups)))
            edges = exact_quantiles(tagged, score, names, ["_g"]).select("_g", F.array(*names).alias("_edges"))
            placed = tagged.join(edges, "_g")
        else:
            edges = exact_quantiles(scored, score, names).select(F.array(*names).alias("_edges"))
            placed = scored.withColumn("_edges", edges.scalar())
        placed = placed.withColumn("bin", bin_of(f"`{score}`", "_edges", bins))
    else:
        raise ValueError("strategy must be 'uniform' or 'quantile'")
    return placed.groupBy(*groups, "bin").agg(
        F.count("*").alias("n"),
        F.avg(s).alias("mean_score"),
        F.avg(F.col(label).cast("double")).alias("positive_share"),
    )


def long_metrics(table: DataFrame, metrics: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    entries = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return table.select(*keep, F.inline(F.array(*entries)))


def metric_deltas(first: DataFrame, second: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """second - first per metric, from two long metric tables."""
    a = first.select(*keep, "metric", F.col("value").alias("first_value"))
    b = second.select(*keep, "metric", F.col("value").alias("second_value"))
    return a.join(b, [*keep, "metric"]).withColumn("delta", F.col("second_value") - F.col("first_value"))


def evaluate_models(
    scored: DataFrame,
    model: str = "model_id",
    threshold: float = 0.5,
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """Threshold-free and fixed-threshold metrics of every model in one table."""
    free = probability_metrics(scored, [model], label, score)
    fixed = threshold_metrics(scored, [threshold], [model], label, score)
    return free.join(fixed, model)


@dataclass(frozen=True)
class FinalEvaluation:
    """Everything derived from one stored score column."""

    scored: DataFrame
    probability: DataFrame
    fixed: DataFrame
    pr: DataFrame
    roc: DataFrame
    calibration: DataFrame
    deltas: DataFrame | None


def evaluate_final(
    scored: DataFrame,
    path: str,
    thresholds: Sequence[float],
    reference: Mapping[str, float] | None = None,
    gate: DataFrame | None = None,
) -> FinalEvaluation:
    """Score once into ``path``, derive everything from the stored scores.

    ``gate`` is a check table that must pass first.  An existing path is refused,
    so a second evaluation of the same test split cannot happen by accident.
    ``reference`` holds earlier metric values for the deltas.
    """
    if gate is not None:
        assert_checks(gate)
    scored.write.mode("errorifexists").parquet(path)
    kept = scored.sparkSession.read.schema(scored.schema).parquet(path)
    assert_checks(score_checks(kept))
    probability = probability_metrics(kept)
    deltas = None
    if reference:
        names = list(reference)
        old = F.create_map(*[x for m in names for x in (F.lit(m), F.lit(float(reference[m])))])
        deltas = long_metrics(probability, names).select(
            "metric",
            old[F.col("metric")].alias("first_value"),
            F.col("value").alias("second_value"),
            (F.col("value") - old[F.col("metric")]).alias("delta"),
        )
    return FinalEvaluation(
        kept,
        probability,
        threshold_metrics(kept, thresholds),
        pr_curve(kept),
        roc_curve(kept),
        calibration_curve(kept, strategy="quantile"),
        deltas,
    )
