"""Numerical and categorical profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import category, numeric
from ..operators.numeric import BlankRule
from .catalog import DIRTY, NUMBER, Tables, dirty_orders, query, r, rounded

BLANK_RULES = {"total_text": BlankRule("total_text", "units", 0, 0.0)}

_PROJECTED = f"""{DIRTY}, p as (select *, trim(total_text) = '' and units = 0 as filled,
    coalesce(trim(total_text) = '' and units <> 0, false) as failed,
    case when trim(total_text) = '' and units = 0 then 0.0 else {NUMBER.format('total_text')} end as number from dirty)"""


@query(
    "numeric_projection",
    f"""with {_PROJECTED} select o_orderkey, number as total_text, coalesce(filled, false) as total_text_materialized,
        failed as total_text_condition_failure,
        total_text is not null and trim(total_text) <> '' and number is null as total_text_non_numeric from p""",
)
def _(t: Tables):
    return numeric.numeric_projection(dirty_orders(t), ["total_text"], BLANK_RULES, ["o_orderkey"])


def _stats_sql(feature: str, value: str, source: str, extra: str) -> str:
    q1, q3 = f"quantile_cont({value}, 0.25)", f"quantile_cont({value}, 0.75)"
    n = f"count({value})"
    return f"""(with q as (select {q1} as q1, {q3} as q3 from {source}),
      f as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)
      select '{feature}' as feature, count(*) as rows, {n} as valid, {extra},
        count(distinct {value}) as unique_values, count(*) filter ({value} = 0) as zero, count(*) filter ({value} < 0) as negative,
        {r(f'min({value})', 4)} as minimum, {r(q1, 4)} as q1, {r(f'median({value})', 4)} as median, {r(f'avg({value})', 4)} as mean,
        {r(q3, 4)} as q3, {r(f'max({value})', 4)} as maximum, {r(f'max({value}) - min({value})', 4)} as range,
        {r(f'stddev_samp({value})', 4)} as std, {r(f'var_samp({value})', 1)} as variance, {r(f'{q3} - {q1}', 4)} as iqr,
        {r(f'case when {n} >= 3 and min({value}) < max({value}) then skewness({value}) end')} as skewness,
        {r('(select lo from f)', 4)} as lower_fence, {r('(select hi from f)', 4)} as upper_fence,
        count(*) filter ({value} < (select lo from f)) as lower_outliers,
        count(*) filter ({value} > (select hi from f)) as upper_outliers,
        count(*) filter ({value} < (select lo from f) or {value} > (select hi from f)) as outliers,
        {r(f'count(*) filter ({value} < (select lo from f) or {value} > (select hi from f)) / {n}')} as outlier_share
      from {source})"""


_NONE = "0::bigint as missing, 0::bigint as blank, 0::bigint as materialized, 0::bigint as non_numeric"
_STATUS = "case when non_numeric > 0 then 'Review required' else 'Analyzed' end as status"
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PLACES = {"variance": 1, "skewness": 6, "outlier_share": 6}


@query(
    "numeric_stats",
    f"select *, {_STATUS} from (" + " union all ".join(_stats_sql(c, c, "lineitem", _NONE) for c in LINE_NUMBERS) + ")",
)
def _(t: Tables):
    return rounded(numeric.numeric_stats(t.lineitem, LINE_NUMBERS), 4, **_PLACES)


@query(
    "numeric_stats_long_tail",
    f"select *, {_STATUS} from ({_stats_sql('n_chars', 'n_chars::double', 'documents', _NONE)})",
)
def _(t: Tables):
    return rounded(numeric.numeric_stats(t.documents, ["n_chars"]), 4, **_PLACES)


_DIRTY_EXTRA = """count(*) filter (total_text is null) as missing, count(*) filter (trim(total_text) = '') as blank,
    count(*) filter (filled) as materialized,
    count(*) filter (failed or (total_text is not null and trim(total_text) <> '' and number is null)) as non_numeric"""


@query(
    "numeric_stats_text_numbers",
    f"with {_PROJECTED} select *, {_STATUS} from ({_stats_sql('total_text', 'number', 'p', _DIRTY_EXTRA)})",
)
def _(t: Tables):
    return rounded(numeric.numeric_stats(dirty_orders(t), ["total_text"], BLANK_RULES), 4, **_PLACES)


def _fences(feature: str, value: str, source: str) -> str:
    return f"""select '{feature}' as feature, {value} as value, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi
      from {source}, (select quantile_cont({value}, 0.25) as q1, quantile_cont({value}, 0.75) as q3 from {source})"""


@query(
    "iqr_outlier_summary",
    "with f as (" + " union all ".join(
        [_fences("o_totalprice", "o_totalprice", "orders"), _fences("o_custkey", "o_custkey::double", "orders")]
    ) + f""") select feature, {r('max(lo)', 4)} as lower_fence, {r('max(hi)', 4)} as upper_fence,
        count(*) filter (value < lo) as lower_outliers, count(*) filter (value > hi) as upper_outliers,
        count(*) filter (value < lo or value > hi) as outliers, {r('count(*) filter (value < lo or value > hi) / count(*)')} as outlier_share,
        case when count(*) filter (value < lo or value > hi) > 0 then 'Candidate outliers require contextual review'
          else 'No IQR outlier candidates' end as interpretation from f group by feature""",
)
def _(t: Tables):
    return rounded(numeric.iqr_outlier_summary(t.orders, ["o_totalprice", "o_custkey"]), 4, outlier_share=6)


@query(
    "iqr_outlier_summary_large_offset",
    "with f as (" + " union all ".join(
        [_fences("far_key", "(o_orderkey + 1000000000000)::double", "orders")]
    ) + f""") select feature, {r('max(lo)', 4)} as lower_fence, {r('max(hi)', 4)} as upper_fence,
        count(*) filter (value < lo) as lower_outliers, count(*) filter (value > hi) as upper_outliers,
        count(*) filter (value < lo or value > hi) as outliers, {r('count(*) filter (value < lo or value > hi) / count(*)')} as outlier_share,
        case when count(*) filter (value < lo or value > hi) > 0 then 'Candidate outliers require contextual review'
          else 'No IQR outlier candidates' end as interpretation from f group by feature""",
)
def _(t: Tables):
    far = t.orders.selectExpr("o_orderkey + 1000000000000L as far_key")
    return rounded(numeric.iqr_outlier_summary(far, ["far_key"]), 4, outlier_share=6)


_DOC_FENCES = """f as (select doc_id, n_chars::double as value, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from documents,
    (select quantile_cont(n_chars::double, 0.25) as q1, quantile_cont(n_chars::double, 0.75) as q3 from documents))"""


@query(
    "iqr_outliers",
    f"""with {_DOC_FENCES} select doc_id, 'n_chars' as feature, {r('value', 4)} as value, {r('lo', 4)} as lower_fence, {r('hi', 4)} as upper_fence,
        case when value < lo then 'Lower' else 'Upper' end as direction from f where value < lo or value > hi""",
)
def _(t: Tables):
    return rounded(numeric.iqr_outliers(t.documents, ["n_chars"], ["doc_id"]), 4)


@query(
    "iqr_outliers_first",
    f"""with {_DOC_FENCES} select doc_id, 'n_chars' as feature, {r('value', 4)} as value, {r('lo', 4)} as lower_fence, {r('hi', 4)} as upper_fence,
        case when value < lo then 'Lower' else 'Upper' end as direction,
        cast(row_number() over (order by doc_id) as integer) as position from f where value < lo or value > hi qualify position <= 10""",
)
def _(t: Tables):
    return rounded(numeric.iqr_outliers(t.documents, ["n_chars"], ["doc_id"], top=10), 4)


_CONVERSION = f"""{_PROJECTED}, i as (select o_orderkey, total_text as raw_value,
    case when failed then 'Materialization condition not satisfied' else 'Non-numeric value' end as issue from p
    where failed or (total_text is not null and trim(total_text) <> '' and number is null))"""


@query(
    "conversion_issues",
    f"with {_CONVERSION} select 'total_text' as feature, issue, count(*) as n from i group by all",
)
def _(t: Tables):
    return numeric.conversion_issues(dirty_orders(t), ["total_text"], BLANK_RULES)


@query(
    "conversion_issue_samples",
    f"""with {_CONVERSION} select 'total_text' as feature, issue, raw_value, o_orderkey,
        cast(row_number() over (partition by issue order by o_orderkey) as integer) as position from i qualify position <= 10""",
)
def _(t: Tables):
    return numeric.conversion_issue_samples(dirty_orders(t), ["total_text"], ["o_orderkey"], BLANK_RULES)


@query(
    "numeric_summary",
    f"""with {_PROJECTED}, q as (select number, units::double as units, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi,
          u1 - 1.5 * (u3 - u1) as ulo, u3 + 1.5 * (u3 - u1) as uhi, total_text, filled, failed from p,
          (select quantile_cont(number, 0.25) as q1, quantile_cont(number, 0.75) as q3,
             quantile_cont(units::double, 0.25) as u1, quantile_cont(units::double, 0.75) as u3 from p)),
        a as (select (count(*) filter (total_text is null) > 0)::bigint as m, (count(*) filter (trim(total_text) = '') > 0)::bigint as b,
          count(*) filter (filled) as f, (count(*) filter (failed or (total_text is not null and trim(total_text) <> '' and number is null)) > 0)::bigint as c,
          (count(*) filter (number < lo or number > hi) > 0)::bigint + (count(*) filter (units < ulo or units > uhi) > 0)::bigint as o from q)
        select 'Requested numerical features' as metric, 3::bigint as value from a union all select 'Available numerical features', 2 from a
        union all select 'Missing numerical features', 1 from a union all select 'Features with missing values', m from a
        union all select 'Features with blank values', b from a union all select 'Materialized projection values', f from a
        union all select 'Features with conversion issues', c from a union all select 'Features with outlier candidates', o from a""",
)
def _(t: Tables):
    return numeric.numeric_summary(dirty_orders(t), ["total_text", "units", "absent"], BLANK_RULES)


# --------------------------------------------------------------------------
# categories

ORDER_CATS = ["status", "label", "units"]

_CATS = f"""{DIRTY}, long as (select 'status' as feature, status as category, lower(trim(status)) as normalized from dirty
    union all select 'label', label, lower(trim(label)) from dirty union all select 'units', cast(units as varchar), cast(units as varchar) from dirty),
  counts as (select feature, category, normalized, count(*) as n from long where category is not null and trim(category) <> '' group by all),
  shares as (select *, sum(n) over (partition by feature) as valid, n / sum(n) over (partition by feature) as share from counts),
  flagged as (select *, concat_ws(', ', case when n < 50 then 'count' end, case when share < 0.01 then 'share' end) as trig from shares)"""


@query(
    "category_frequencies",
    f"""with {_CATS} select feature, category, n, {r('share')} as share, rank() over (partition by feature order by n desc) as rank,
          case when feature = 'status' then normalized in ('f', 'o', 'z') else true end as expected, trig <> '' as rare, trig as rare_trigger,
          rank() over (partition by feature order by n desc) = 1 as dominant, normalized from flagged""",
)
def _(t: Tables):
    return rounded(category.category_frequencies(dirty_orders(t), ORDER_CATS, {"status": ["F", "O", "Z"]}))


# Labels that differ by more than ASCII case: final sigma, a ligature, sharp s.
_GREEK = """case c_custkey % 7 when 0 then 'ΟΔΟΣ' when 1 then ' οδος' when 2 then 'οδοσ' when 3 then 'oﬃce' when 4 then 'OFFICE' when 5 then 'Straße' else 'STRASSE' end"""
_GREEK_FOLDED = "replace(replace(replace(lower(trim({0})), 'ς', 'σ'), 'ﬃ', 'ffi'), 'ß', 'ss')"


@query(
    "label_variants_unicode",
    f"""with l as (select {_GREEK} as place, c_mktsegment from customer), c as (select place as category, count(*) as n from l group by all),
          k as (select *, {_GREEK_FOLDED.format('category')} as normalized from c)
        select 'place' as feature, normalized, category, n, count(*) over (partition by normalized) as variants,
          cast(sum(n) over (partition by normalized) as bigint) as rows from k""",
)
def _(t: Tables):
    places = t.customer.select(F.expr(_GREEK).alias("place"), "c_mktsegment")
    found = category.label_variants(places, ["place", "c_mktsegment"])
    return found.select("feature", "normalized", "category", "n", "variants", "rows")


@query(
    "category_frequencies_high_cardinality",
    f"""with c as (select 'p_name' as feature, p_name as category, count(*) as n from part group by all
          union all select 'p_brand', p_brand, count(*) from part group by all union all select 'p_type', p_type, count(*) from part group by all
          union all select 'p_partkey', cast(p_partkey as varchar), count(*) from part group by all),
        s as (select *, n / sum(n) over (partition by feature) as share, rank() over (partition by feature order by n desc) as rank,
          concat_ws(', ', case when n < 50 then 'count' end, case when n / sum(n) over (partition by feature) < 0.01 then 'share' end) as trig from c)
        select feature, category, n, {r('share')} as share, rank, true as expected, trig <> '' as rare, trig as rare_trigger, rank = 1 as dominant,
          case when feature = 'p_partkey' then category else lower(trim(category)) end as normalized from s""",
)
def _(t: Tables):
    return rounded(category.category_frequencies(t.part, ["p_name", "p_brand", "p_type", "p_partkey"]))


@query(
    "rare_categories",
    f"with {_CATS} select feature, category, n, {r('share')} as share, trig as trigger from flagged where trig <> ''",
)
def _(t: Tables):
    return rounded(category.rare_categories(dirty_orders(t), ORDER_CATS))


@query(
    "label_variants",
    f"""with {_CATS} select feature, normalized, category, n, count(*) over (partition by feature, normalized) as variants,
          cast(sum(n) over (partition by feature, normalized) as bigint) as rows from counts where feature <> 'units' qualify variants > 1""",
)
def _(t: Tables):
    return category.label_variants(dirty_orders(t), ORDER_CATS)


@query(
    "domain_violations",
    f"""with {_CATS}, d as (select 'status' as feature, unnest(['F', 'O', 'Z']) as v union all select 'label', unnest(['Yes', 'No', 'Maybe']))
        select feature, 'Unexpected categories' as issue, category, n from counts
          where (feature = 'status' and normalized not in ('f', 'o', 'z')) or (feature = 'label' and normalized not in ('yes', 'no', 'maybe'))
        union all select feature, 'Missing expected categories', v, 0 from d where (feature, lower(v)) not in (select (feature, normalized) from counts)""",
)
def _(t: Tables):
    return category.domain_violations(dirty_orders(t), {"status": ["F", "O", "Z"], "label": ["Yes", "No", "Maybe"]})


STATUS_GROUPS = {"closed": ["F"], "open": ["O", "P"], "other": ["Q"], "twice": ["P"]}

_GROUPED = f"""{_CATS}, g(grp, v) as (values ('closed', 'f'), ('open', 'o'), ('open', 'p'), ('other', 'q'), ('twice', 'p')),
   u as (select v, count(*) as k, min(grp) as grp from g group by v)"""


@query(
    "category_grouping",
    f"""with {_GROUPED}, a as (select coalesce(u.grp, 'Unassigned') as grp, c.n from counts c left join u on u.v = c.normalized and u.k = 1 where c.feature = 'status'),
        s as (select grp, sum(n) as n from (select * from a union all select distinct grp, 0 from g) group by grp)
        select 'status' as feature, grp as "group", cast(n as bigint) as n, {r('n / (select sum(n) from a)')} as share,
          case when grp = 'Unassigned' then 'Requires review' else 'Defined' end as coverage from s""",
)
def _(t: Tables):
    return rounded(category.category_grouping(dirty_orders(t), "status", STATUS_GROUPS))


@query(
    "grouping_issues",
    f"""with {_GROUPED}, k as (select normalized, min(category) as category from counts where feature = 'status' group by normalized),
        names(v, shown) as (values ('f', 'F'), ('o', 'O'), ('p', 'P'), ('q', 'Q'))
        select 'status' as feature, 'Unknown grouping categories' as issue, shown as category from names where v not in (select normalized from k)
        union all select 'status', 'Categories assigned to multiple groups', coalesce(k.category, shown) from u join names using (v) left join k on k.normalized = u.v where u.k > 1
        union all select 'status', 'Ungrouped categories', category from k where normalized not in (select v from u)""",
)
def _(t: Tables):
    return category.grouping_issues(dirty_orders(t), "status", STATUS_GROUPS)


_SUMMARY = f"""{_CATS}, tot(feature, rows, missing, blank) as (
    select 'status', count(*), count(*) filter (status is null), count(*) filter (trim(status) = '') from dirty
    union all select 'label', count(*), count(*) filter (label is null), count(*) filter (trim(label) = '') from dirty
    union all select 'units', count(*), count(*) filter (units is null), 0 from dirty),
  k as (select feature, normalized, count(*) as labels from counts group by all),
  m as (select feature, max(n) as top from counts group by all),
  s as (select feature, count(*) as cardinality, cast(sum(n) as bigint) as valid, count(*) filter (trig <> '') as rare_categories,
      cast(coalesce(sum(n) filter (trig <> ''), 0) as bigint) as rare_rows,
      count(*) filter (feature = 'status' and normalized not in ('f', 'o', 'z')) as unexpected_categories from flagged group by all),
  summ as (select t.feature, rows, valid, missing, blank, cardinality, cast(case when t.feature = 'status' then 3 end as integer) as expected_cardinality,
      (select min(category) from counts c join m using (feature) where c.feature = t.feature and c.n = m.top) as mode,
      (select count(*) from counts c join m using (feature) where c.feature = t.feature and c.n = m.top) as mode_ties,
      m.top as mode_count, m.top / valid as mode_share, rare_categories, rare_rows, unexpected_categories,
      case when t.feature = 'status' then 3 - (select count(*) from k where k.feature = 'status' and normalized in ('f', 'o', 'z')) else 0 end as missing_expected_categories,
      (select count(*) from k where k.feature = t.feature and labels > 1 and t.feature <> 'units') as inconsistent_labels,
      cardinality > 5 as high_cardinality
    from tot t join s using (feature) join m using (feature))"""


@query(
    "category_summary",
    f"""with {_SUMMARY} select * replace ({r('mode_share')} as mode_share), 0::bigint as grouping_issues,
          concat_ws(', ', case when missing > 0 then 'Missing values' end, case when blank > 0 then 'Blank values' end,
            case when unexpected_categories > 0 then 'Unexpected categories' end, case when missing_expected_categories > 0 then 'Missing expected categories' end,
            case when inconsistent_labels > 0 then 'Inconsistent labels' end, case when rare_categories > 0 then 'Rare categories' end,
            case when high_cardinality then 'High cardinality' end,
            case when missing + blank + unexpected_categories + missing_expected_categories + inconsistent_labels + rare_categories = 0 and not high_cardinality then 'Analyzed' end) as status
        from summ""",
)
def _(t: Tables):
    out = category.category_summary(dirty_orders(t), ORDER_CATS, {"status": ["F", "O", "Z"]}, high_cardinality=5)
    return rounded(out)


@query(
    "categorical_study_summary",
    f"""with {_SUMMARY}, a as (select count(*) filter (missing > 0) as c1, count(*) filter (blank > 0) as c2, count(*) filter (rare_categories > 0) as c3,
          count(*) filter (inconsistent_labels > 0) as c4, count(*) filter (unexpected_categories > 0) as c5,
          count(*) filter (missing_expected_categories > 0) as c6, count(*) filter (high_cardinality) as c7 from summ),
        g(v) as (values ('f'), ('o'), ('z')),
        i as (select 2::bigint as n from a)
        select 'Requested categorical features' as metric, 4::bigint as value from a union all select 'Available categorical features', 3 from a
        union all select 'Missing categorical features', 1 from a union all select 'Features with missing values', c1 from a
        union all select 'Features with blank values', c2 from a union all select 'Features with rare categories', c3 from a
        union all select 'Features with inconsistent labels', c4 from a union all select 'Features with unexpected categories', c5 from a
        union all select 'Features missing expected categories', c6 from a union all select 'High-cardinality features', c7 from a
        union all select 'Candidate grouping issues', n from i""",
)
def _(t: Tables):
    return category.categorical_study_summary(
        dirty_orders(t),
        [*ORDER_CATS, "absent"],
        {"status": ["F", "O", "Z"]},
        groupings={"status": {"closed": ["F"], "open": ["O", "P"]}},
        high_cardinality=5,
    )
