"""Exact classifier metrics on a fixed score of the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators.checks import checks_from
from ..operators.model import prior_baseline
from .catalog import NUDGE, SCORED, TWO_MODELS, Tables, query, r, rounded, scored_lines, two_models

_EPS = "2.220446049250313e-16"


def _probability_sql(source: str, by: str = "") -> str:
    g, pb = (f"{by}, ", f"partition by {by} ") if by else ("", "")
    grp = f"group by {by}" if by else ""
    return f"""(with c as (select {g}score, count(*) as n, sum(label) as pos from {source} group by {g}score),
      w as (select *, sum(n) over ({pb}order by score desc) as cn, sum(pos) over ({pb}order by score desc) as cp from c)
      select {g}sum(n)::bigint as n, sum(pos)::bigint as positives, {r('sum(pos * (cp / cn)) / sum(pos)')} as average_precision,
        {r('sum((n - pos) * (cp - pos / 2.0::double)) / (sum(pos)::double * (sum(n) - sum(pos)))')} as roc_auc,
        {r(f'-sum(pos * ln(greatest(score, {_EPS})) + (n - pos) * ln(1 - least(score, 1 - {_EPS}))) / sum(n)')} as log_loss,
        {r('sum(pos * (1 - score) * (1 - score) + (n - pos) * score * score) / sum(n)')} as brier_score from w {grp})"""


@query("probability_metrics", f"with {SCORED} select * from {_probability_sql('scored')}")
def _(t: Tables):
    return rounded(evaluate.probability_metrics(scored_lines(t)))


_RATES = f"""{r('coalesce(tp / nullif(tp + fp, 0), 0)')} as precision, {r('coalesce(tp / nullif(tp + fn, 0), 0)')} as recall,
    {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} as f1, {r('coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0)')} as f2,
    {r('(tp / (tp + fn) + tn / (tn + fp)) / 2')} as balanced_accuracy, {r('(tp + tn) / (tp + fp + fn + tn)')} as accuracy,
    tp as true_positives, fp as false_positives, tn as true_negatives, fn as false_negatives, tp + fp as predicted_positive_count,
    {r('(tp + fp) / (tp + fp + fn + tn)')} as predicted_positive_rate"""


def _confusion(source: str, thresholds: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""(select {g}t as threshold, count(*) filter (score >= t and label = 1) as tp, count(*) filter (score >= t and label = 0) as fp,
      count(*) filter (score < t and label = 1) as fn, count(*) filter (score < t and label = 0) as tn
      from {source}, (select unnest([{thresholds}]::double[]) as t) group by {g}t)"""


@query("threshold_metrics", f"with {SCORED} select threshold, {_RATES} from {_confusion('scored', '0.2577809673219062, 0.5, 0.999999')}")
def _(t: Tables):
    out = evaluate.threshold_metrics(scored_lines(t), [0.2577809673219062, 0.5, 0.999999])
    return rounded(out, threshold=16)


def _sweep_sql(source: str) -> str:
    return f"""(with c as (select score, count(*) as n, sum(label) as pos from (select score, label, 1 as k from {source}) group by score
        union all select t, 0, 0 from (select unnest([0.0, 0.5, 1.0]::double[]) as t)),
      d as (select score, sum(n) as n, sum(pos) as pos from c group by score),
      w as (select score, sum(n) over (order by score desc) as cn, sum(pos) over (order by score desc) as cp, sum(n) over () as tn_, sum(pos) over () as tp_ from d)
      select score as threshold, cp::bigint as tp, (cn - cp)::bigint as fp, (tp_ - cp)::bigint as fn, (tn_ - tp_ - (cn - cp))::bigint as tn from w)"""


@query("threshold_sweep", f"with {SCORED}, s as (select * from {_sweep_sql('scored')}) select threshold, {_RATES} from s")
def _(t: Tables):
    return rounded(evaluate.threshold_sweep(scored_lines(t)))


_RAW = """tp / nullif(tp + fp, 0) as p0, tp / (tp + fn) as rc, coalesce(tp / nullif(tp + fp, 0), 0) as pr,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1_, coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0) as f2_"""


@query(
    "threshold_scenarios",
    f"""with {SCORED}, s as (select *, {_RAW} from {_sweep_sql('scored')}),
        a as (select 'default_0_50' as scenario_id, null::double as recall_target, null::boolean as target_satisfied, * from s where threshold = 0.5
          union all select * from (select 'maximum_f1', null::double, null::boolean, * from s order by f1_ desc, pr desc, rc desc, threshold desc limit 1)
          union all select * from (select 'maximum_f2', null::double, null::boolean, * from s order by f2_ desc, pr desc, rc desc, threshold desc limit 1)
          union all select * from (select 'minimum_recall_0_70', 0.7, true, * from s where rc >= 0.7 order by pr desc, f2_ desc, threshold desc limit 1)
          union all select * from (select 'minimum_recall_0_80', 0.8, true, * from s where rc >= 0.8 order by pr desc, f2_ desc, threshold desc limit 1)
          union all select * from (select 'minimum_recall_0_90', 0.9, true, * from s where rc >= 0.9 order by pr desc, f2_ desc, threshold desc limit 1))
        select scenario_id, recall_target, target_satisfied, threshold, {_RATES} from a""",
)
def _(t: Tables):
    sweep = evaluate.threshold_sweep(scored_lines(t))
    return rounded(evaluate.threshold_scenarios(sweep))


_CURVE = """c as (select score, count(*) as n, sum(label) as pos from scored group by score),
  w as (select score, sum(n) over (order by score desc) as cn, sum(pos) over (order by score desc) as cp, sum(n) over () as tn, sum(pos) over () as tp from c)"""


@query(
    "pr_curve",
    f"""with {SCORED}, {_CURVE} select score as threshold, {r('cp / cn')} as precision, {r('cp / tp')} as recall from w
        union all select null, 1.0::double, 0.0::double""",
)
def _(t: Tables):
    return rounded(evaluate.pr_curve(scored_lines(t)))


@query(
    "roc_curve",
    f"""with {SCORED}, {_CURVE} select score as threshold, {r('(cn - cp) / (tn - tp)')} as fpr, {r('cp / tp')} as tpr from w
        union all select 2.0::double, 0.0::double, 0.0::double""",
)
def _(t: Tables):
    out = evaluate.roc_curve(scored_lines(t))
    return rounded(out.withColumn("threshold", F.least("threshold", F.lit(2.0))))


@query(
    "calibration_uniform",
    f"""with {SCORED}, b as (select label, score, 1 + (0.1 < score)::integer + (0.2 < score)::integer + (0.30000000000000004 < score)::integer + (0.4 < score)::integer
          + (0.5 < score)::integer + (0.6000000000000001 < score)::integer + (0.7000000000000001 < score)::integer + (0.8 < score)::integer + (0.9 < score)::integer as bin from scored)
        select bin, count(*) as n, {r('avg(score)')} as mean_score, {r('avg(label)')} as positive_share from b group by bin""",
)
def _(t: Tables):
    return rounded(evaluate.calibration_curve(scored_lines(t)))


@query(
    "calibration_quantile",
    f"""with {SCORED}, e as (select quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from scored),
        b as (select label, score, (1 + len(list_filter(q, lambda z: z < score)))::integer as bin from scored, e)
        select bin, count(*) as n, {r('avg(score)')} as mean_score, {r('avg(label)')} as positive_share from b group by bin""",
)
def _(t: Tables):
    return rounded(evaluate.calibration_curve(scored_lines(t), strategy="quantile"))


@query(
    "evaluate_models",
    f"""with {TWO_MODELS} select p.*, c.* exclude (model_id) from {_probability_sql('models', 'model_id')} p
        join (select model_id, threshold, {_RATES} from {_confusion('models', '0.5', 'model_id')}) c on p.model_id = c.model_id""",
)
def _(t: Tables):
    return rounded(evaluate.evaluate_models(two_models(t)))


@query(
    "metric_deltas",
    f"""with {TWO_MODELS}, p as (select * from {_probability_sql('models', 'model_id')}),
        l as (unpivot p on average_precision, roc_auc, log_loss, brier_score into name metric value value)
        select a.metric, {r('a.value', 4)} as first_value, {r('b.value', 4)} as second_value, {r('b.value - a.value', 4)} as delta
        from l a join l b on a.metric = b.metric and a.model_id = 'm1' and b.model_id = 'm2'""",
)
def _(t: Tables):
    metrics = ["average_precision", "roc_auc", "log_loss", "brier_score"]
    table = evaluate.long_metrics(evaluate.probability_metrics(two_models(t), ["model_id"]), metrics, ["model_id"])
    first, second = (table.where(F.col("model_id") == m).drop("model_id") for m in ("m1", "m2"))
    return rounded(evaluate.metric_deltas(first, second), 4)


@query(
    "prior_baseline",
    f"""with {SCORED}, m as (select avg(label) as p from scored where l_orderkey % 5 <> 0)
        select l_orderkey, l_linenumber, label, {r('p')} as score from scored, m where l_orderkey % 5 = 0""",
)
def _(t: Tables):
    rows = scored_lines(t).drop("score")
    return rounded(prior_baseline(rows.where("l_orderkey % 5 <> 0"), rows.where("l_orderkey % 5 = 0")))


def _fixed_sql(threshold: str) -> str:
    rows = " union all ".join(f"select '{m}@{threshold}' as metric, {m} as value, 'fixed' as part from x" for m in ("precision", "recall", "f1", "f2"))
    return f"(with x as (select threshold, {_RATES} from {_confusion('scored', threshold)}) {rows})"


@query(
    "final_evaluation",
    f"""with {SCORED}, p as (select * from {_probability_sql('scored')}),
        l as (unpivot (select average_precision, roc_auc, log_loss, brier_score from p) on average_precision, roc_auc, log_loss, brier_score into name metric value value),
        e as (select quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from scored),
        b as (select label, 1 + len(list_filter(q, lambda z: z < score)) as bin from scored, e),
        k as (select count(distinct score) + 1 as points from scored)
        select metric, value, 'probability' as part from l
        union all select * from {_fixed_sql('0.5')} union all select * from {_fixed_sql('0.2577809673219062')}
        union all select 'bin ' || bin, {r('avg(label)')}, 'calibration' from b group by bin
        union all select 'pr points', points::double, 'curve' from k union all select 'roc points', points::double, 'curve' from k
        union all select metric, {r("value - case metric when 'roc_auc' then 0.5 else 0.33 end", 4)}, 'delta' from l where metric in ('average_precision', 'roc_auc')""",
)
def _(t: Tables):
    gate = checks_from(
        t.lineitem.agg(F.count_if(F.col("l_returnflag").isNull()).alias("n")), [("labels_present", "test", "l_returnflag", F.col("n"))]
    )
    earlier = {"average_precision": 0.33, "roc_auc": 0.5}
    done = evaluate.evaluate_final(scored_lines(t), t.scratch(), [0.5, 0.2577809673219062], earlier, gate)
    free = evaluate.long_metrics(done.probability, ["average_precision", "roc_auc", "log_loss", "brier_score"])
    fixed = evaluate.long_metrics(done.fixed, ["precision", "recall", "f1", "f2"], ["threshold"])
    parts = [
        free.withColumn("part", F.lit("probability")),
        fixed.withColumn("metric", F.concat_ws("@", "metric", F.col("threshold").cast("string"))).drop("threshold").withColumn("part", F.lit("fixed")),
        done.calibration.select(F.concat(F.lit("bin "), "bin").alias("metric"), F.col("positive_share").alias("value"), F.lit("calibration").alias("part")),
        done.pr.agg(F.count("*").cast("double").alias("value")).select(F.lit("pr points").alias("metric"), "value", F.lit("curve").alias("part")),
        done.roc.agg(F.count("*").cast("double").alias("value")).select(F.lit("roc points").alias("metric"), "value", F.lit("curve").alias("part")),
        done.deltas.select("metric", F.expr(f"round(delta + {NUDGE}D, 4) + 0.0D").alias("value"), F.lit("delta").alias("part")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


_SCORED_DIRTY = f"""{SCORED}, spoilt as (select case when l_orderkey % 11 = 0 then null when l_orderkey % 13 = 0 then 2 else label end as label,
    case when l_orderkey % 7 = 0 then null when l_orderkey % 17 = 0 then score + 1.5 else score end as score from scored)"""


def _spoilt(t: Tables):
    return scored_lines(t).selectExpr(
        "case when l_orderkey % 11 = 0 then null when l_orderkey % 13 = 0 then 2 else label end as label",
        "case when l_orderkey % 7 = 0 then null when l_orderkey % 17 = 0 then score + 1.5 else score end as score",
    )


@query(
    "score_checks",
    f"""with {_SCORED_DIRTY}, c as (select count(*) filter (score is null) as a, count(*) filter (score < 0 or score > 1) as b, count(*) filter (label is null) as d,
        count(*) filter (label not in (0, 1)) as e from spoilt),
        u as (select unnest(['score_not_null', 'score_not_nan', 'score_in_range', 'label_not_null', 'label_zero_or_one']) as "check",
          unnest(['score', 'score', 'score', 'label', 'label']) as item, unnest([a, 0, b, d, e]) as n from c)
        select "check", 'scored' as scope, item, n::bigint as n_violations, n = 0 as passed from u""",
)
def _(t: Tables):
    return evaluate.score_checks(_spoilt(t))


@query(
    "probability_metrics_spoilt",
    f"""with {_SCORED_DIRTY}, good as (select * from spoilt where label in (0, 1) and score between 0 and 1)
        select p.*, (select count(*) from spoilt) - p.n as excluded from {_probability_sql('good')} p""",
)
def _(t: Tables):
    excluded = evaluate.excluded_rows(_spoilt(t)).select("excluded").scalar()
    return rounded(evaluate.probability_metrics(_spoilt(t)).withColumn("excluded", excluded))
