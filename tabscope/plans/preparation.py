"""Cleaning, preservation, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare
from ..operators.numeric import BlankRule
from .catalog import DIRTY, NUMBER, SPLIT_ORDERS, Tables, dirty_orders, query, r, rounded, split_orders

RULE = BlankRule("total_text", "units", 0, 0.0)

_FILLED = f"""{DIRTY}, p as (select *, coalesce(trim(total_text) = '' and units = 0, false) as filled, coalesce(trim(total_text) = '' and units <> 0, false) as failed,
    case when trim(total_text) = '' and units = 0 then 0.0 else {NUMBER.format('total_text')} end as number from dirty)"""


@query(
    "conditional_fill",
    f"with {_FILLED} select o_orderkey, o_custkey, number as total_text, units, status, label from p",
)
def _(t: Tables):
    return prepare.conditional_fill(dirty_orders(t), RULE)


@query(
    "conditional_fill_checks",
    f"""with {_FILLED}, c as (select count(*) filter (total_text is null) as a, count(*) filter (failed) as b,
          count(*) filter (total_text is not null and trim(total_text) <> '' and number is null) as c from p),
        u as (select unnest(['no_nulls', 'blank_condition_holds', 'values_convertible']) as "check", unnest([a, b, c]) as n from c)
        select "check", 'conditional_fill' as scope, 'total_text' as item, n as n_violations, n = 0 as passed from u""",
)
def _(t: Tables):
    return prepare.fill_checks(dirty_orders(t), RULE)


@query(
    "conditional_fill_counts",
    f"with {_FILLED} select 'total_text' as \"column\", count(*) filter (filled) as materialized from p",
)
def _(t: Tables):
    return prepare.fill_counts(dirty_orders(t), [RULE])


_AFTER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "preservation_check",
    """with c as (select count(*) filter (o_orderkey % 53 = 0 and lower(o_orderstatus) <> o_orderstatus) as s, count(*) filter (o_orderkey % 1000 = 0) as lost from orders),
       k as (select s - (select count(*) from orders where o_orderkey % 53 = 0 and o_orderkey % 1000 = 0 and lower(o_orderstatus) <> o_orderstatus) as s, lost from c),
       u as (select 'rows_kept' as "check", '*' as item, lost as n from k union all select 'rows_not_added', '*', 0 from k union all select 'column_order_kept', '*', 0 from k
         union all select 'column_unchanged', 'o_orderstatus', s from k union all select 'column_unchanged', unnest(['o_custkey', 'o_orderdate', 'o_orderpriority']), 0 from k
         union all select 'key_unique', unnest(['before', 'after']), 0 from k)
       select "check", 'preservation' as scope, item, n as n_violations, n = 0 as passed from u""",
)
def _(t: Tables):
    after = t.orders.where("o_orderkey % 1000 <> 0").selectExpr(
        "o_orderkey",
        "o_custkey",
        "case when o_orderkey % 53 = 0 then lower(o_orderstatus) else o_orderstatus end as o_orderstatus",
        "case when o_orderkey % 97 = 0 then 0 else o_totalprice end as o_totalprice",
        "o_orderdate",
        "o_orderpriority",
    )
    return prepare.preservation_check(t.orders.select(*_AFTER), after, ["o_orderkey"], ["o_totalprice"])


@query(
    "membership_key",
    """select '[' || l_orderkey || ',' || l_linenumber || ',"' || l_returnflag || '"]' as membership_key, count(*) as n from lineitem group by all""",
)
def _(t: Tables):
    df = t.lineitem
    key = prepare.membership_key(df, ["l_orderkey", "l_linenumber", "l_returnflag"])
    return df.groupBy(key.alias("membership_key")).agg(F.count("*").alias("n"))


CLASSES = ["Yes", "No"]


def _target_orders(t: Tables):
    return t.orders.selectExpr("o_orderkey", "case when o_orderstatus = 'F' then 'Yes' else 'No' end as label")


_RANKED = """ranked as (select o_orderkey, case when o_orderstatus = 'F' then 'Yes' else 'No' end as label,
    row_number() over (partition by o_orderstatus = 'F' order by md5('42|[' || o_orderkey || ']'), o_orderkey) as k from orders),
  sizes as (select label, count(*) as n from ranked group by all), tot as (select sum(n)::bigint as n, ceil((0.15::double + 0.15::double) * sum(n))::bigint as held from sizes),
  tot2 as (select *, ceil((0.15::double / (0.15::double + 0.15::double)) * held)::bigint as test from tot),
  q1 as (select s.label, s.n, (t.n - t.held)::double * s.n / t.n as x, t.n as total, t.held, t.test from sizes s, tot2 t),
  q2 as (select *, floor(x) + (row_number() over (order by x - floor(x) desc, label) <= (total - held) - sum(floor(x)) over ())::integer as n_train from q1),
  q3 as (select *, n - n_train as rest, (held - test)::double * (n - n_train) / held as y from q2),
  quotas as (select label, n, n_train::bigint as n_train, (floor(y) + (row_number() over (order by y - floor(y) desc, label) <= (held - test) - sum(floor(y)) over ())::integer)::bigint as n_validation from q3),
  cut as (select o_orderkey, label, case when k <= n_train then 'train' when k <= n_train + n_validation then 'validation' else 'test' end as split from ranked join quotas using (label))"""


@query("stratified_split", f"with {_RANKED} select o_orderkey, label, split from cut")
def _(t: Tables):
    return prepare.stratified_split(_target_orders(t), ["o_orderkey"], "label", CLASSES)


@query(
    "stratified_split_sizes",
    f"with {_RANKED} select label as class, n, n_train, n_validation, n - n_train - n_validation as n_test from quotas",
)
def _(t: Tables):
    counts = _target_orders(t).groupBy(F.col("label").alias("_c")).agg(F.count("*").alias("n"))
    return prepare.split_quotas(counts, (0.70, 0.15, 0.15)).withColumnRenamed("_c", "class")


@query(
    "stratified_split_lineitem",
    """with r as (select l_returnflag as label, row_number() over (partition by l_returnflag order by md5('7|[' || l_orderkey || ',' || l_linenumber || ']'), l_orderkey, l_linenumber) as k from
         (select distinct l_orderkey, l_linenumber, l_returnflag from lineitem)),
       n as (select label, count(*) as n from r group by all)
       select label, n.n from n""",
)
def _(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("label")).distinct()
    out = prepare.stratified_split(lines, ["l_orderkey", "l_linenumber", "label"], "label", ["A", "N", "R"], (0.6, 0.2, 0.2), 7)
    return out.where(F.col("split").isNotNull()).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "split_profile",
    f"""with {SPLIT_ORDERS}, c as (select split, o_orderstatus as class, count(*) as n from parts group by all)
        select split, class, n, cast(sum(n) over (partition by split) as bigint) as rows, {r('n / sum(n) over (partition by split)')} as share from c""",
)
def _(t: Tables):
    return rounded(prepare.split_profile(split_orders(t), "split", "o_orderstatus"))


def _split_checks_sql(source: str, parts: str, extra: str) -> str:
    return f"""with {extra}, s as (select unnest(['train', 'validation', 'test']) as split), k as (select unnest(['Yes', 'No']) as class),
      b as (select s.split, k.class, (select count(*) from {parts} p where p.split = s.split and p.label = k.class) as n,
        (select count(*) from {parts} p where p.split = s.split) as rows, (select count(*) from {source} o where o.label = k.class) / (select count(*) from {source}) as whole from s, k),
      g as (select o_orderkey, count(*) as n, count(distinct split) as d from {parts} where split is not null group by all),
      u as (select 'split_not_empty' as "check", split as item, max((rows = 0)::integer) as n from b group by split
        union all select 'class_present', split || '/' || class, (n = 0)::integer from b
        union all select 'prevalence_within_tolerance', split || '/' || class, (abs(n / rows - whole) > 0.02)::integer from b
        union all select 'row_count_preserved', '*', ((select count(*) from {parts}) <> (select count(*) from {source}))::integer
        union all select 'source_keys_unique', '*', (select count(*) from (select o_orderkey from {source} group by all having count(*) > 1))
        union all select 'split_keys_unique', '*', (select count(*) from g where n > 1 and d = 1)
        union all select 'splits_disjoint', '*', (select count(*) from g where d > 1)
        union all select 'coverage_missing', '*', (select count(*) from {source} where o_orderkey not in (select o_orderkey from g))
        union all select 'coverage_extra', '*', (select count(*) from g where o_orderkey not in (select o_orderkey from {source})))
      select "check", 'split' as scope, item, n::bigint as n_violations, n = 0 as passed from u"""


@query(
    "split_checks",
    _split_checks_sql("ranked", "cut", _RANKED),
)
def _(t: Tables):
    source = _target_orders(t)
    parts = prepare.stratified_split(source, ["o_orderkey"], "label", CLASSES)
    return prepare.split_checks(source, parts, ["o_orderkey"], "label", CLASSES)


_BROKEN = """src as (select o_orderkey, case when o_orderstatus = 'F' then 'Yes' else 'No' end as label from orders),
  broken as (select o_orderkey, label, case when o_orderkey % 10 < 7 then 'train' when o_orderkey % 10 = 7 then 'validation' else 'test' end as split from src where o_orderkey % 31 <> 0
    union all select o_orderkey, label, 'test' from src where o_orderkey % 50 = 1
    union all select -o_orderkey, label, 'test' from src where o_orderkey % 500 = 3)"""


@query("split_checks_failing", _split_checks_sql("src", "broken", _BROKEN))
def _(t: Tables):
    source = _target_orders(t)
    cut = source.where("o_orderkey % 31 <> 0").selectExpr(
        "*", "case when o_orderkey % 10 < 7 then 'train' when o_orderkey % 10 = 7 then 'validation' else 'test' end as split"
    )
    again = source.where("o_orderkey % 50 = 1").withColumn("split", F.lit("test"))
    foreign = source.where("o_orderkey % 500 = 3").selectExpr("-o_orderkey as o_orderkey", "label", "'test' as split")
    return prepare.split_checks(source, cut.unionByName(again).unionByName(foreign), ["o_orderkey"], "label", CLASSES)


_FOLDS = """r as (select o_orderkey, case when o_orderstatus = 'F' then 'Yes' else 'No' end as label, md5('42|[' || o_orderkey || ']') as h from orders),
  f as (select o_orderkey, label, ((row_number() over (order by label, h, o_orderkey) - 1) % 5)::integer as fold from r)"""


@query("stratified_folds", f"with {_FOLDS} select o_orderkey, label, fold from f")
def _(t: Tables):
    return prepare.stratified_folds(_target_orders(t), ["o_orderkey"], "label", CLASSES, 5)


@query(
    "fold_classes",
    f"""with {_FOLDS}, c as (select fold, label as class, count(*) as validation_rows from f group by all)
        select *, cast(sum(validation_rows) over (partition by class) - validation_rows as bigint) as train_rows from c""",
)
def _(t: Tables):
    return prepare.fold_classes(prepare.stratified_folds(_target_orders(t), ["o_orderkey"], "label", CLASSES, 5), "label")


_PART_DECLARED = """open_orders as (select o_orderkey, case when o_orderkey % 9 = 0 then null when o_orderstatus = 'P' then 'Other' when o_orderstatus = 'F' then 'Yes' else 'No' end as label from orders),
  h as (select *, md5('42|[' || o_orderkey || ']') as h from open_orders),
  f as (select o_orderkey, label, ((row_number() over (order by label, h, o_orderkey) - 1) % 5)::integer as fold from h where label in ('Yes', 'No')
    union all select o_orderkey, label, null from h where label is null or label not in ('Yes', 'No'))"""


def _open_orders(t: Tables):
    label = "case when o_orderkey % 9 = 0 then null when o_orderstatus = 'P' then 'Other' when o_orderstatus = 'F' then 'Yes' else 'No' end as label"
    return t.orders.selectExpr("o_orderkey", label)


@query("stratified_folds_undeclared", f"with {_PART_DECLARED} select o_orderkey, label, fold from f")
def _(t: Tables):
    return prepare.stratified_folds(_open_orders(t), ["o_orderkey"], "label", CLASSES, 5)


@query(
    "fold_checks",
    f"""with {_PART_DECLARED}, c as (select count(*) filter (fold is null) as n from f)
        select 'folds_assigned' as "check", 'fold' as scope, '*' as item, n as n_violations, n = 0 as passed from c""",
)
def _(t: Tables):
    return prepare.fold_checks(prepare.stratified_folds(_open_orders(t), ["o_orderkey"], "label", CLASSES, 5))


@query(
    "split_profile_undeclared",
    f"""with {_PART_DECLARED}, s as (select label, case when fold is null then null when fold < 4 then 'train' else 'test' end as split from f)
        select split, label as class, count(*) as n, (sum(count(*)) over (partition by split))::bigint as rows,
          {r('count(*) / sum(count(*)) over (partition by split)')} as share from s group by split, label""",
)
def _(t: Tables):
    folded = prepare.stratified_folds(_open_orders(t), ["o_orderkey"], "label", CLASSES, 5)
    cut = folded.selectExpr("label", "case when fold is null then null when fold < 4 then 'train' else 'test' end as split")
    return rounded(prepare.split_profile(cut, "split", "label"))
