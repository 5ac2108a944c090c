"""Feature-to-feature and feature-to-target associations, leakage."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import effects, leakage, relations
from ..operators.effects import BinaryTarget
from .catalog import LABELLED, SPLIT_ORDERS, Tables, labelled_documents, query, r, rounded, split_orders

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pearson_sql(a: str, b: str, x: str, y: str, source: str) -> str:
    n = f"count(*) filter ({x} is not null and {y} is not null)"
    c = f"case when stddev_samp({x}) filter ({y} is not null) > 0 and stddev_samp({y}) filter ({x} is not null) > 0 then corr({x}, {y}) end"
    return f"""select '{a}' as feature_a, '{b}' as feature_b, {n} as valid_rows, count(*) - {n} as missing_rows,
      {r(c)} as pearson, {r(f'abs({c})')} as abs_pearson from {source}"""


@query(
    "pearson_pairs",
    " union all ".join(_pearson_sql(a, b, a, b, "lineitem") for a, b in combinations(NUMBERS, 2)),
)
def _(t: Tables):
    return rounded(relations.pearson_pairs(t.lineitem, NUMBERS))


_SPARSE = """sparse as (select l_quantity, l_extendedprice, case when l_orderkey % 3 <> 0 then l_discount end as l_discount, 1.0::double as one from lineitem)"""


def _sparse(t: Tables):
    return t.lineitem.selectExpr(
        "l_quantity", "l_extendedprice", "case when l_orderkey % 3 <> 0 then l_discount end as l_discount", "cast(1.0 as double) as one"
    )


_SPARSE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "one"]


@query(
    "pearson_pairs_missing_and_constant",
    f"with {_SPARSE} " + " union all ".join(_pearson_sql(a, b, a, b, "sparse") for a, b in combinations(_SPARSE_COLS, 2)),
)
def _(t: Tables):
    return rounded(relations.pearson_pairs(_sparse(t), _SPARSE_COLS))


# more columns than one aggregate takes
_WIDE = {
    **{c: c for c in NUMBERS},
    "line": "cast(l_linenumber as double)",
    "part": "cast(l_partkey as double)",
    "supplier": "cast(l_suppkey as double)",
    "net": "l_extendedprice * (1 - l_discount)",
    "unit": "l_extendedprice / l_quantity",
    "some_tax": "case when l_orderkey % 3 <> 0 then l_tax end",
    "one": "cast(1.0 as double)",
}
_WIDE_SELECT = ", ".join(f"{e} as {c}" for c, e in _WIDE.items())


@query(
    "pearson_pairs_wide",
    f"with wide as (select {_WIDE_SELECT} from lineitem) "
    + " union all ".join(_pearson_sql(a, b, a, b, "wide") for a, b in combinations(_WIDE, 2)),
)
def _(t: Tables):
    return rounded(relations.pearson_pairs(t.lineitem.selectExpr(*[f"{e} as {c}" for c, e in _WIDE.items()]), list(_WIDE)))


def _rank_sql(a: str, b: str, source: str) -> str:
    return f"""(with p as (select {a} as x, {b} as y from {source} where {a} is not null and {b} is not null),
      k as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx,
                   rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from p)
      select '{a}' as feature_a, '{b}' as feature_b, count(*) as valid_rows,
        {r('case when stddev_samp(rx) > 0 and stddev_samp(ry) > 0 then corr(rx, ry) end')} as rank_r,
        {r('case when stddev_samp(rx) > 0 and stddev_samp(ry) > 0 then abs(corr(rx, ry)) end')} as abs_rank_r from k)"""


@query(
    "rank_pairs",
    f"with {_SPARSE} " + " union all ".join("select * from " + _rank_sql(a, b, "sparse") for a, b in combinations(_SPARSE_COLS, 2)),
)
def _(t: Tables):
    return rounded(relations.rank_pairs(_sparse(t), _SPARSE_COLS))


_NUM_PAIRS = f"""{_SPARSE}, pr as ({' union all '.join(_pearson_sql(a, b, a, b, 'sparse') for a, b in combinations(_SPARSE_COLS[:3], 2))}),
  rk as ({' union all '.join('select * from ' + _rank_sql(a, b, 'sparse') for a, b in combinations(_SPARSE_COLS[:3], 2))}),
  np as (select pr.*, rank_r, abs_rank_r, greatest(coalesce(abs_pearson, 0), coalesce(abs_rank_r, 0)) as top from pr left join rk using (feature_a, feature_b))"""


@query(
    "numeric_pairs",
    f"""with {_NUM_PAIRS} select * exclude (top, valid_rows), valid_rows, top >= 0.8 as strong, coalesce(abs_pearson >= 0.9, false) as redundant,
        case when pearson is null then 'Insufficient variation for correlation'
          when top >= 0.8 and pearson >= 0 then 'Strong positive numerical association' when top >= 0.8 then 'Strong negative numerical association'
          when top >= 0.4 then 'Moderate numerical association' else 'Limited numerical association' end as interpretation from np""",
)
def _(t: Tables):
    return rounded(relations.numeric_pairs(_sparse(t), _SPARSE_COLS[:3]))


# --------------------------------------------------------------------------
# categorical pairs

_GEO = """geo as (select c_custkey, c_mktsegment, n_name, r_name, case when c_custkey % 2 = 0 then 'even' else 'odd' end as parity,
    case when c_custkey % 10 = 0 then null else ' ' || n_name end as home, 'x' as same
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
GEO_CATS = ["c_mktsegment", "n_name", "r_name", "parity", "home", "same"]


def _geo(t: Tables):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey",
        "c_acctbal",
        "c_mktsegment",
        "n_name",
        "r_name",
        "case when c_custkey % 2 = 0 then 'even' else 'odd' end as parity",
        "case when c_custkey % 10 = 0 then null else concat(' ', n_name) end as home",
        "'x' as same",
    )


def _cat_pair_sql(a: str, b: str, source: str) -> str:
    return f"""(with p as (select {a} as a, {b} as b from {source} where {a} is not null and {b} is not null),
      c as (select a, b, count(*)::double as n from p group by all), ra as (select a, sum(n) as n from c group by a), rb as (select b, sum(n) as n from c group by b),
      t as (select sum(n) as n, count(*) as k from c),
      s as (select (select count(*) from ra) as ca, (select count(*) from rb) as cb, (select n from t) as n,
        (select sum(c.n * c.n / (ra.n * rb.n)) from c join ra using (a) join rb using (b)) as phi,
        (select -sum(ra.n / t.n * ln(ra.n / t.n)) from ra, t) as ha, (select -sum(rb.n / t.n * ln(rb.n / t.n)) from rb, t) as hb,
        (select -sum(c.n / t.n * ln(c.n / t.n)) from c, t) as hab)
      select '{a}' as feature_a, '{b}' as feature_b, coalesce(n, 0)::bigint as valid_rows, (select count(*) from {source}) - coalesce(n, 0)::bigint as missing_rows,
        ca as cardinality_a, cb as cardinality_b,
        case when ca > 1 and cb > 1 then least(sqrt(greatest(phi - 1, 0) / (least(ca, cb) - 1)), 1.0) end as v,
        case when ca > 1 and cb > 1 then least(greatest((ha + hb - hab) / ha, 0), 1.0) end as uab,
        case when ca > 1 and cb > 1 then least(greatest((ha + hb - hab) / hb, 0), 1.0) end as uba from s)"""


def _cat_pairs_sql(pairs, source: str) -> str:
    return " union all ".join("select * from " + _cat_pair_sql(a, b, source) for a, b in pairs)


_CAT_COLUMNS = f"""feature_a, feature_b, valid_rows, missing_rows, cardinality_a, cardinality_b, {r('v')} as cramers_v, {r('uab')} as u_a_given_b,
    {r('uba')} as u_b_given_a, {r('greatest(uab, uba)')} as max_directional, coalesce(greatest(uab, uba) >= 0.99, false) as structural,
    coalesce(v >= 0.9 and least(uab, uba) >= 0.99, false) as redundant"""
_CAT_CLASS = """case when v is null then 'Insufficient variation for categorical association'
    when v >= 0.9 and least(uab, uba) >= 0.99 then 'Near-bidirectional categorical redundancy candidate'
    when greatest(uab, uba) >= 0.99 then 'Strong directional structural dependency'
    when v >= 0.7 then 'Strong categorical association' when v >= 0.35 then 'Moderate categorical association'
    else 'Limited categorical association' end as interpretation"""


@query(
    "cramers_v_pairs",
    f"with {_GEO}, c as ({_cat_pairs_sql(list(combinations(GEO_CATS, 2)), 'geo')}) select feature_a, feature_b, {r('v')} as cramers_v from c",
)
def _(t: Tables):
    return rounded(relations.categorical_pairs(_geo(t), GEO_CATS).select("feature_a", "feature_b", "cramers_v"))


@query(
    "uncertainty_pairs",
    f"with {_GEO}, c as ({_cat_pairs_sql(list(combinations(GEO_CATS, 2)), 'geo')}) select feature_a, feature_b, {r('uab')} as u_a_given_b, {r('uba')} as u_b_given_a from c",
)
def _(t: Tables):
    return rounded(relations.categorical_pairs(_geo(t), GEO_CATS).select("feature_a", "feature_b", "u_a_given_b", "u_b_given_a"))


@query(
    "structural_dependency",
    f"with {_GEO}, c as ({_cat_pairs_sql(list(combinations(GEO_CATS, 2)), 'geo')}) select {_CAT_COLUMNS}, {_CAT_CLASS} from c",
)
def _(t: Tables):
    return rounded(relations.categorical_pairs(_geo(t), GEO_CATS))


@query(
    "categorical_pairs_lineitem",
    f"with c as ({_cat_pairs_sql([('l_returnflag', 'l_linestatus'), ('l_returnflag', 'l_linenumber'), ('l_linestatus', 'l_linenumber')], 'lineitem')}) "
    f"select {_CAT_COLUMNS}, {_CAT_CLASS} from c",
)
def _(t: Tables):
    return rounded(relations.categorical_pairs(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"]))


def _eta_sql(c: str, m: str, source: str) -> str:
    return f"""(with p as (select {c} as c, {m}::double as m from {source} where {c} is not null and {m} is not null),
      g as (select c, count(*) as n, avg(m) as a from p group by c), t as (select avg(m) as a, var_pop(m) * count(*) as ss, count(*) as n, min(m) as lo, max(m) as hi from p)
      select '{c}' as categorical, '{m}' as numerical, t.n as valid_rows, (select count(*) from {source}) - t.n as missing_rows,
        (select count(*) from g) as categories,
        case when (select count(*) from g) > 1 and lo < hi then least(greatest((select sum(g.n * (g.a - t.a) * (g.a - t.a)) from g) / ss, 0), 1.0) end as eta from t)"""


_ETA_CLASS = """case when eta is null then 'Insufficient variation for mixed association' when eta >= 0.25 then 'Strong categorical-to-numerical association'
    when eta >= 0.125 then 'Moderate categorical-to-numerical association' else 'Limited categorical-to-numerical association' end"""
_PART_CATS, _PART_NUMS = ["p_type", "p_brand"], ["p_retailprice", "p_size"]


def _etas(cats, nums, source):
    return " union all ".join("select * from " + _eta_sql(c, m, source) for c in cats for m in nums)


@query(
    "eta_squared_pairs",
    f"""with e as ({_etas(_PART_CATS, _PART_NUMS, 'part')}) select * exclude (eta), {r('eta')} as eta_squared, coalesce(eta >= 0.25, false) as strong,
        {_ETA_CLASS} as interpretation from e""",
)
def _(t: Tables):
    return rounded(relations.eta_squared_pairs(t.part, _PART_CATS, _PART_NUMS))


@query(
    "eta_squared_pairs_lineitem",
    f"""with e as ({_etas(['l_returnflag', 'l_linestatus'], NUMBERS, 'lineitem')}) select * exclude (eta), {r('eta')} as eta_squared, coalesce(eta >= 0.25, false) as strong,
        {_ETA_CLASS} as interpretation from e""",
)
def _(t: Tables):
    return rounded(relations.eta_squared_pairs(t.lineitem, ["l_returnflag", "l_linestatus"], NUMBERS))


_INTERACTION = f"""p as (select l_quantity * l_discount as x, l_extendedprice as y from lineitem), g as (select x, y, abs(x - y) as gap, abs(x - y) / nullif(abs(y), 0) as rel from p),
  k as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from p),
  i as (select count(*) as n, corr(x, y) as pearson, (select corr(rx, ry) from k) as rank_r, avg(gap) as mad, median(gap) as med, avg(rel) as rel from g)"""


@query(
    "interaction",
    f"""with {_INTERACTION} select 'quantity_times_discount' as interaction, n as valid_rows, 0::bigint as missing_rows, {r('pearson')} as pearson, {r('rank_r')} as rank_r,
        {r('mad', 4)} as mean_abs_difference, {r('med', 4)} as median_abs_difference, {r('rel')} as mean_relative_difference,
        greatest(abs(pearson), abs(rank_r)) >= 0.8 as strong, abs(pearson) >= 0.9 as redundant,
        case when abs(pearson) >= 0.9 then 'Strong derived-feature redundancy candidate' when greatest(abs(pearson), abs(rank_r)) >= 0.8 then 'Strong interaction relationship'
          else 'Limited interaction relationship' end as interpretation from i""",
)
def _(t: Tables):
    out = relations.interaction(t.lineitem, "quantity_times_discount", "l_quantity", "l_discount", "l_extendedprice")
    return rounded(out, mean_abs_difference=4, median_abs_difference=4)


@query(
    "pearson_matrix",
    f"with m as ({' union all '.join(_pearson_sql(a, b, a, b, 'lineitem') for a, b in combinations(NUMBERS, 2))}), s as (select feature_a, feature_b, pearson from m union all select feature_b, feature_a, pearson from m) "
    "select feature_a as feature, "
    + ", ".join(f"case when feature_a = '{c}' then 1.0::double else max(pearson) filter (feature_b = '{c}') end as {c}" for c in NUMBERS)
    + " from s group by feature_a",
)
def _(t: Tables):
    return rounded(relations.association_matrix(relations.pearson_pairs(t.lineitem, NUMBERS), "pearson", NUMBERS))


@query(
    "cramers_v_matrix",
    f"with {_GEO}, m as ({_cat_pairs_sql(list(combinations(GEO_CATS[:4], 2)), 'geo')}), s as (select feature_a, feature_b, {r('v')} as v from m union all select feature_b, feature_a, {r('v')} from m) "
    "select feature_a as feature, "
    + ", ".join(f"case when feature_a = '{c}' then 1.0::double else max(v) filter (feature_b = '{c}') end as {c}" for c in GEO_CATS[:4])
    + " from s group by feature_a",
)
def _(t: Tables):
    return rounded(relations.association_matrix(relations.categorical_pairs(_geo(t), GEO_CATS[:4]), "cramers_v", GEO_CATS[:4]))


@query(
    "rank_matrix",
    f"with {_SPARSE}, m as ({' union all '.join('select * from ' + _rank_sql(a, b, 'sparse') for a, b in combinations(_SPARSE_COLS[:3], 2))}), s as (select feature_a, feature_b, rank_r from m union all select feature_b, feature_a, rank_r from m) "
    "select feature_a as feature, "
    + ", ".join(f"case when feature_a = '{c}' then 1.0::double else max(rank_r) filter (feature_b = '{c}') end as {c}" for c in _SPARSE_COLS[:3])
    + " from s group by feature_a",
)
def _(t: Tables):
    pairs = relations.rank_pairs(_sparse(t), _SPARSE_COLS[:3])
    return rounded(relations.association_matrix(pairs, "rank_r", _SPARSE_COLS[:3]))


@query(
    "eta_squared_matrix",
    f"with e as ({_etas(_PART_CATS, _PART_NUMS, 'part')}) select categorical as feature, "
    + ", ".join(f"{r(f'''max(eta) filter (numerical = '{m}')''')} as {m}" for m in _PART_NUMS)
    + " from e group by categorical",
)
def _(t: Tables):
    return rounded(relations.mixed_matrix(relations.eta_squared_pairs(t.part, _PART_CATS, _PART_NUMS), _PART_NUMS))


_REL_NUM, _REL_CAT = ["c_acctbal", "c_custkey"], GEO_CATS[:4]
_GEO_ALL = _GEO.replace("select c_custkey, c_mktsegment", "select c_custkey, c_acctbal, c_mktsegment")


@query(
    "relationship_summary",
    f"""with {_GEO_ALL}, pr as ({_pearson_sql('c_acctbal', 'c_custkey', 'c_acctbal', 'c_custkey', 'geo')}), rk as (select * from {_rank_sql('c_acctbal', 'c_custkey', 'geo')}),
        np as (select greatest(abs_pearson, abs_rank_r) >= 0.8 as strong, abs_pearson >= 0.9 as red from pr, rk),
        c as ({_cat_pairs_sql(list(combinations(_REL_CAT, 2)), 'geo')}), e as ({_etas(_REL_CAT, _REL_NUM, 'geo')}),
        i as (select abs(corr(c_acctbal * c_custkey, c_acctbal)) >= 0.9 as red from geo),
        a as (select (select count(*) filter (strong) from np) as ns, (select count(*) filter (red) from np) as nr, (select count(*) filter (v >= 0.7) from c) as cs,
          (select count(*) filter (greatest(uab, uba) >= 0.99) from c) as ct, (select count(*) filter (v >= 0.9 and least(uab, uba) >= 0.99) from c) as cr,
          (select count(*) filter (eta >= 0.25) from e) as ms, (select count(*) filter (red) from i) as ir)
        select unnest(['Requested numerical features', 'Available numerical features', 'Missing numerical features', 'Requested categorical features',
          'Available categorical features', 'Missing categorical features', 'Numerical relationships', 'Categorical relationships',
          'Categorical-numerical relationships', 'Interaction candidates', 'Strong numerical relationships', 'Strong categorical relationships',
          'Strong mixed relationships', 'Structural categorical dependencies', 'Redundancy review candidates']) as metric,
          unnest([3::bigint, 2, 1, 4, 4, 0, 1, 6, 8, 1, ns, cs, ms, ct, nr + cr + ir]) as value from a""",
)
def _(t: Tables):
    spec = {"name": "acctbal_times_key", "left": "c_acctbal", "right": "c_custkey", "compare_to": "c_acctbal"}
    return relations.relationship_summary(_geo(t), [*_REL_NUM, "absent"], _REL_CAT, [spec])


# --------------------------------------------------------------------------
# feature to target

RETURNED = BinaryTarget("returned", "Yes", "No")


def _returned(t: Tables):
    return t.lineitem.selectExpr("*", "case when l_returnflag = 'R' then 'Yes' else 'No' end as returned")


def _class_sql(m: str) -> str:
    return f"""select '{m}' as feature, case when l_returnflag = 'R' then 'Yes' else 'No' end as target_class, count(*) as rows, count({m}) as valid,
      {r(f'avg({m})', 4)} as mean, {r(f'median({m})', 4)} as median, {r(f'stddev_samp({m})', 4)} as std, {r(f'min({m})', 4)} as minimum, {r(f'max({m})', 4)} as maximum,
      {r(f'quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25)', 4)} as iqr from lineitem group by 1, 2"""


@query("numeric_by_class", " union all ".join(_class_sql(m) for m in NUMBERS))
def _(t: Tables):
    return rounded(effects.numeric_by_class(_returned(t), NUMBERS, RETURNED), 4)


def _bins_sql(m: str, source: str, hit: str, bins: int = 10) -> str:
    points = ", ".join(f"{i}.0 / {bins}" for i in range(bins + 1))
    return f"""(with v as (select {m}::double as x, {hit} as y from {source} where {hit} is not null), d as (select least({bins}, count(distinct x)) as q from v where x is not null),
      e as (select list_sort(list_distinct(quantile_cont(x, [{points}]))) as edges from v),
      p as (select 1 + len(list_filter(edges[2:len(edges) - 1], lambda z: z < x)) as bin, y from v, e where x is not null),
      c as (select bin, count(*) as n, sum(y)::bigint as pos from p group by bin),
      g as (select unnest(range(1, len(edges))) as bin, edges from e)
      select '{m}' as feature, g.bin::integer as bin, edges[g.bin] as lo, edges[g.bin + 1] as hi, coalesce(n, 0) as n, coalesce(pos, 0) as pos,
        (select avg(y) from v) as overall from g left join c on g.bin = c.bin)"""


_BIN_COLS = f"""feature, bin, {r('lo', 4)} as lower_bound, {r('hi', 4)} as upper_bound, n, pos as positives, n - pos as negatives,
    {r('pos / nullif(n, 0)')} as rate, {r('overall')} as overall_rate, {r('pos / nullif(n, 0) - overall')} as rate_difference,
    {r('pos / nullif(n, 0) / overall')} as lift, n < 50 as low_support"""
_HIT = "(l_returnflag = 'R')::integer"


def _all_bins(features=NUMBERS, source="lineitem", hit=_HIT):
    return " union all ".join("select * from " + _bins_sql(m, source, hit) for m in features)


@query("quantile_bin_rates", f"with b as ({_all_bins()}) select {_BIN_COLS} from b")
def _(t: Tables):
    return rounded(effects.quantile_bin_rates(_returned(t), NUMBERS, RETURNED), lower_bound=4, upper_bound=4)


QUALITY = BinaryTarget("quality", "good", "bad")
_QUALITY_HIT = "case when quality = 'good' then 1 when quality = 'bad' then 0 end"


@query(
    "quantile_bin_rates_documents",
    f"with {LABELLED}, b as ({_all_bins(['n_chars'], 'labelled', _QUALITY_HIT)}) select {_BIN_COLS} from b",
)
def _(t: Tables):
    return rounded(effects.quantile_bin_rates(labelled_documents(t), ["n_chars"], QUALITY), lower_bound=4, upper_bound=4)


@query(
    "quantile_bin_rates_few_values",
    f"""with few as (select l_linenumber, l_returnflag from lineitem), b as ({_bins_sql('l_linenumber', 'few', _HIT, 7).replace('least(7,', 'least(10,')}) select {_BIN_COLS} from b""",
)
def _(t: Tables):
    return rounded(effects.quantile_bin_rates(_returned(t), ["l_linenumber"], RETURNED), lower_bound=4, upper_bound=4)


def _effect_sql(m: str) -> str:
    return f"""(with v as (select {m} as x, {_HIT} as y from lineitem),
      s as (select count(*) as rows, count(x) as n, count(x) filter (y = 1) as n1, count(x) filter (y = 0) as n0, avg(x) filter (y = 1) as m1, avg(x) filter (y = 0) as m0,
        median(x) filter (y = 1) as d1, median(x) filter (y = 0) as d0, var_samp(x) filter (y = 1) as v1, var_samp(x) filter (y = 0) as v0, corr(x, y) as rpb from v)
      select '{m}' as feature, *, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) as d,
        (select max(pos / n) - min(pos / n) from b where b.feature = '{m}' and n > 0) as spread from s)"""


_EFFECTS = f"b as ({_all_bins()}), e as ({' union all '.join('select * from ' + _effect_sql(m) for m in NUMBERS)})"


@query(
    "numeric_effect",
    f"""with {_EFFECTS} select feature, n as valid_rows, rows - n as missing_rows, n1 as positive_count, n0 as negative_count, {r('m1', 4)} as positive_mean, {r('m0', 4)} as negative_mean,
        {r('m1 - m0', 4)} as mean_difference, {r('d1', 4)} as positive_median, {r('d0', 4)} as negative_median, {r('d1 - d0', 4)} as median_difference,
        {r('rpb')} as point_biserial, {r('d')} as cohens_d, {r('abs(d)')} as abs_cohens_d, {r('rpb * rpb')} as eta_squared, {r('spread')} as rate_spread,
        abs(d) >= 0.5 or spread >= 0.1 as review,
        case when (abs(d) >= 0.5 or spread >= 0.1) and d > 0 then 'Positive class is associated with higher values; review for modeling'
          when abs(d) >= 0.5 or spread >= 0.1 then 'Positive class is associated with lower values; review for modeling'
          when abs(d) >= 0.25 then 'Limited-to-moderate numerical target separation' else 'Limited numerical target separation' end as interpretation from e""",
)
def _(t: Tables):
    four = ["positive_mean", "negative_mean", "mean_difference", "positive_median", "negative_median", "median_difference"]
    return rounded(effects.numeric_effect(_returned(t), NUMBERS, RETURNED), **{c: 4 for c in four})


FULFILLED = BinaryTarget("o_orderstatus_f", "Yes", "No")
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]


def _fulfilled(t: Tables):
    return t.orders.selectExpr(
        "o_orderpriority",
        "concat(' ', cast(o_custkey % 4 as string), '  ') as bucket",
        "case when o_orderstatus = 'F' then 'Yes' else 'No' end as o_orderstatus_f",
    )


_Z = "1.959963984540054"
_RATES = f"""long as (select 'o_orderpriority' as feature, o_orderpriority as category, (o_orderstatus = 'F')::integer as y from orders
    union all select 'bucket', cast(o_custkey % 4 as varchar), (o_orderstatus = 'F')::integer from orders),
  c as (select feature, category, count(*) as n, sum(y)::bigint as pos from long group by all),
  d(category, o) as (values ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 4), ('5-LOW', 5), ('6-NONE', 6)),
  m as (select coalesce(c.feature, 'o_orderpriority') as feature, coalesce(c.category, d.category) as category, coalesce(n, 0) as n, coalesce(pos, 0) as pos, d.o
    from c full join d on c.feature = 'o_orderpriority' and c.category = d.category),
  w as (select *, n - pos as neg, sum(pos) over (partition by feature) - pos as rpos, sum(n - pos) over (partition by feature) - (n - pos) as rneg,
    (select avg((o_orderstatus = 'F')::integer) from orders) as overall, pos / nullif(n, 0) as rate from m),
  x as (select *, case when pos = 0 or neg = 0 or rpos = 0 or rneg = 0 then 0.5 else 0 end as k,
    (rate + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) as ctr,
    {_Z} * sqrt(rate * (1 - rate) / n + {_Z} * {_Z} / (4.0 * n * n)) / (1 + {_Z} * {_Z} / n) as mg from w where n > 0
    union all select *, 0, null, null from w where n = 0)"""


@query(
    "category_rates",
    f"""with {_RATES} select feature, category, o::integer as expected_order, n, pos as positives, neg as negatives, {r('rate')} as rate, {r('overall')} as overall_rate,
        {r('rate - overall')} as rate_difference, {r('rate / overall')} as lift,
        {r('case when n > 0 then (pos + k) * (rneg + k) / ((neg + k) * (rpos + k)) else (pos + 0.5) * (rneg + 0.5) / ((neg + 0.5) * (rpos + 0.5)) end')} as odds_ratio,
        {r('greatest(0.0, ctr - mg)')} as wilson_lower, {r('least(1.0, ctr + mg)')} as wilson_upper, n < 50 as low_support, o is not null as expected from x""".replace(
        r("greatest(0.0, ctr - mg)"), r("case when n > 0 then greatest(0.0, ctr - mg) end")
    ).replace(r("least(1.0, ctr + mg)"), r("case when n > 0 then least(1.0, ctr + mg) end")),
)
def _(t: Tables):
    out = effects.category_rates(_fulfilled(t), ["o_orderpriority", "bucket"], FULFILLED, {"o_orderpriority": PRIORITIES})
    return rounded(out)


def _cat_effect_sql(c: str, source: str, hit: str) -> str:
    return f"""(with p as (select {c} as a, {hit} as y from {source} where {hit} is not null), q as (select * from p where a is not null),
      g as (select a, count(*)::double as n, sum(y)::double as pos, avg(y) as rate from q group by a), t as (select count(*)::double as n, sum(y)::double as pos from q),
      o as (select avg(y) as overall, count(*) as rows from p)
      select '{c}' as feature, t.n::bigint as valid_rows, o.rows - t.n::bigint as missing_rows, (select count(*) from g) as categories,
        sqrt(greatest((select sum(pos * pos / g.n) from g) / t.pos + (select sum((g.n - g.pos) * (g.n - g.pos) / g.n) from g) / (t.n - t.pos) - 1, 0)) as v,
        least(greatest(1 - (select sum(case when pos > 0 then -pos * ln(pos / g.n) else 0 end + case when g.n > pos then -(g.n - pos) * ln((g.n - pos) / g.n) else 0 end) from g)
          / (-t.pos * ln(t.pos / t.n) - (t.n - t.pos) * ln((t.n - t.pos) / t.n)), 0), 1) as u,
        (select min(rate) from g) as lo, (select max(rate) from g) as hi, (select sum(g.n * abs(rate - o.overall)) from g) / t.n as w,
        (select count(*) from g where g.n < 50) as low from t, o)"""


_EFFECT_CATS = ["lang", "source"]
_CAT_EFFECTS = f"{LABELLED}, e as ({' union all '.join('select * from ' + _cat_effect_sql(c, 'labelled', _QUALITY_HIT) for c in _EFFECT_CATS)})"


@query(
    "categorical_effect",
    f"""with {_CAT_EFFECTS} select feature, valid_rows, missing_rows, categories, {r('v')} as cramers_v, {r('u')} as u_target_given_feature, {r('lo')} as min_rate, {r('hi')} as max_rate,
        {r('hi - lo')} as rate_spread, {r('w')} as weighted_abs_difference, low as low_support_categories, v >= 0.2 or hi - lo >= 0.1 as review,
        case when v >= 0.2 or hi - lo >= 0.1 then 'Category rates merit modeling review' when v >= 0.1 then 'Limited-to-moderate categorical target association'
          else 'Limited categorical target association' end as interpretation from e""",
)
def _(t: Tables):
    return rounded(effects.categorical_effect(labelled_documents(t), _EFFECT_CATS, QUALITY))


@query(
    "odds_ratio_by_flag",
    f"""with c as (select l_linestatus as category, count(*) as n, sum({_HIT})::bigint as pos from lineitem group by all),
        t as (select sum(n) as n, sum(pos) as pos from c)
        select category, {r('c.pos * ((t.n - c.n) - (t.pos - c.pos)) / ((c.n - c.pos) * (t.pos - c.pos))')} as odds_ratio from c, t""",
)
def _(t: Tables):
    return rounded(effects.category_rates(_returned(t), ["l_linestatus"], RETURNED).select("category", "odds_ratio"))


@query(
    "wilson_intervals",
    f"""with c as (select event_type as category, count(*)::double as n, count(*) filter (value > 50)::double as k from events group by all),
        p as (select *, k / n as p from c)
        select category, {r(f'greatest(0, (p + {_Z}*{_Z}/(2*n) - {_Z}*sqrt(p*(1-p)/n + {_Z}*{_Z}/(4*n*n))) / (1 + {_Z}*{_Z}/n))')} as wilson_lower,
          {r(f'least(1, (p + {_Z}*{_Z}/(2*n) + {_Z}*sqrt(p*(1-p)/n + {_Z}*{_Z}/(4*n*n))) / (1 + {_Z}*{_Z}/n))')} as wilson_upper from p""",
)
def _(t: Tables):
    df = t.events.selectExpr("event_type", "case when value > 50 then 'Yes' else 'No' end as high")
    out = effects.category_rates(df, ["event_type"], BinaryTarget("high", "Yes", "No"))
    return rounded(out.select("category", "wilson_lower", "wilson_upper"))


_FLAG_CATS = ["l_linestatus", "l_linenumber"]
_FLAGS = f"""{_EFFECTS}, ce as ({' union all '.join('select * from ' + _cat_effect_sql(c, 'lineitem', _HIT) for c in _FLAG_CATS)}),
  f as (select feature, 'numerical' as kind, abs(d) as effect, spread, abs(d) >= 0.5 or spread >= 0.1 as review from e
    union all select feature, 'categorical', v, hi - lo, v >= 0.2 or hi - lo >= 0.1 from ce)"""


@query(
    "review_flags",
    f"with {_FLAGS} select feature, kind, {r('effect')} as effect, {r('spread')} as rate_spread, review from f",
)
def _(t: Tables):
    return rounded(effects.review_flags(_returned(t), NUMBERS, _FLAG_CATS, RETURNED))


@query(
    "association_ranking",
    f"""with {_FLAGS} select kind, feature, {r('effect')} as effect,
        cast(row_number() over (partition by kind order by effect desc, feature) as integer) as position from f""",
)
def _(t: Tables):
    return rounded(effects.association_ranking(_returned(t), NUMBERS, _FLAG_CATS, RETURNED))


@query(
    "target_study_summary",
    f"""with {_FLAGS}, low as (select (select count(*) filter (n < 50) from b) + (select sum(low) from ce)::bigint as n)
        select unnest(['Total rows', 'Requested numerical features', 'Available numerical features', 'Requested categorical features', 'Available categorical features',
          'Missing target values', 'Observed target classes', 'Numerical review candidates', 'Categorical review candidates', 'Low-support groups']) as metric,
          unnest([(select count(*) from lineitem), 5, 4, 2, 2, 0, 2, count(*) filter (kind = 'numerical' and review), count(*) filter (kind = 'categorical' and review),
          (select n from low)]) as value from f""",
)
def _(t: Tables):
    return effects.target_study_summary(_returned(t), [*NUMBERS, "absent"], _FLAG_CATS, RETURNED)


# --------------------------------------------------------------------------
# leakage

_LEAK = """leak as (select o_orderkey, case when o_orderstatus = 'F' then 'Yes' else 'No' end as target, case when o_orderstatus = 'F' then 'Yes' else 'No' end as exact_copy,
    case when o_orderstatus = 'F' then ' YES ' else 'no' end as folded_copy, case when o_orderstatus = 'F' then 1 else 0 end as code,
    o_orderstatus as status, o_orderpriority as priority, case when o_orderstatus = 'F' then 'closed' else 'open' end as state, o_orderkey % 7 as noise from orders)"""
LEAK_COLS = ["exact_copy", "folded_copy", "code", "status", "priority", "state", "noise", "o_orderkey"]


def _leak(t: Tables):
    return t.orders.selectExpr(
        "o_orderkey",
        "case when o_orderstatus = 'F' then 'Yes' else 'No' end as target",
        "case when o_orderstatus = 'F' then 'Yes' else 'No' end as exact_copy",
        "case when o_orderstatus = 'F' then ' YES ' else 'no' end as folded_copy",
        "case when o_orderstatus = 'F' then 1 else 0 end as code",
        "o_orderstatus as status",
        "o_orderpriority as priority",
        "case when o_orderstatus = 'F' then 'closed' else 'open' end as state",
        "o_orderkey % 7 as noise",
    )


def _copy_sql(c: str) -> str:
    is_text = c not in ("code", "noise", "o_orderkey")
    e = f"count(*) filter ({c} = target)" if is_text else "0::bigint"
    f = f"count(*) filter (lower(trim({c})) = lower(trim(target)))" if is_text else "0::bigint"
    return f"""select '{c}' as feature, count(*) filter ({c} is not null) as paired_rows, {e} as exact_matches, {f} as normalized_matches,
      {r(f'{e} / count(*)')} as exact_rate, {r(f'{f} / count(*)')} as normalized_rate from leak"""


@query("target_copy_rate", f"with {_LEAK} " + " union all ".join(_copy_sql(c) for c in LEAK_COLS))
def _(t: Tables):
    return rounded(leakage.target_copy_rate(_leak(t), LEAK_COLS, "target"))


def _map_sql(c: str) -> str:
    return f"""(with p as (select lower(trim(cast({c} as varchar))) as a, lower(trim(target)) as b from leak), f as (select a, count(distinct b) as k from p group by a),
      g as (select b, count(distinct a) as k from p group by b)
      select '{c}' as feature, (select count(*) from p) as paired_rows, (select count(*) from f) as feature_values, (select count(*) from g) as target_values,
        (select max(k) from f) as max_targets_per_value, (select max(k) from g) as max_values_per_target, (select max(k) from f) = 1 as deterministic,
        (select max(k) from f) = 1 and (select max(k) from g) = 1 as bidirectional, (select bool_and(a in ('0', '1', 'true', 'false')) from f) as binary_values)"""


_MAPS = " union all ".join("select * from " + _map_sql(c) for c in LEAK_COLS)


@query("mapping_determinism", f"with {_LEAK} {_MAPS}")
def _(t: Tables):
    return leakage.mapping_determinism(_leak(t), LEAK_COLS, "target")


@query(
    "proxy_class",
    f"""with {_LEAK}, c as ({' union all '.join(_copy_sql(c) for c in LEAK_COLS)}), m as ({_MAPS}), j as (select *, case
          when c.exact_matches = c.paired_rows then 'Exact target copy' when c.normalized_matches = c.paired_rows then 'Normalized target copy'
          when bidirectional and feature_values = target_values and binary_values then 'Binary target encoding'
          when bidirectional and feature_values = target_values then 'Bidirectional target mapping'
          when deterministic and feature_values <= greatest(10, 5 * target_values) and feature_values / c.paired_rows <= 0.5 and feature <> 'o_orderkey' then 'Deterministic target mapping' end as method
          from c join (select * exclude (paired_rows) from m) using (feature))
        select feature, method, paired_rows, exact_rate, normalized_rate, deterministic, bidirectional,
          case when method in ('Exact target copy', 'Normalized target copy') then 'Critical' else 'High' end as severity from j where method is not null""",
)
def _(t: Tables):
    return rounded(leakage.proxy_class(_leak(t), LEAK_COLS, "target", ["o_orderkey"]))


@query(
    "proxy_class_geography",
    f"""with {_GEO}, p as (select 'n_name' as feature, lower(n_name) as a, lower(r_name) as b from geo union all select 'c_mktsegment', lower(c_mktsegment), lower(r_name) from geo),
        f as (select feature, a, count(distinct b) as k, count(*) as n from p group by all),
        s as (select feature, max(k) as k, count(*) as values, sum(n)::bigint as n from f group by all)
        select feature, 'Deterministic target mapping' as method, n as paired_rows, 0.0::double as exact_rate, 0.0::double as normalized_rate, true as deterministic,
          false as bidirectional, 'High' as severity from s where k = 1 and values <= 25""",
)
def _(t: Tables):
    return rounded(leakage.proxy_class(_geo(t), ["n_name", "c_mktsegment"], "r_name"))


@query(
    "near_determinism",
    f"""with {_GEO}, c as ({_cat_pairs_sql([(c, 'r_name') for c in ('n_name', 'c_mktsegment', 'parity')], 'geo')})
        select feature_a as feature, {r('uba')} as u_target_given_feature, {r('uab')} as u_feature_given_target, coalesce(greatest(uab, uba) >= 0.99, false) as near_deterministic from c""",
)
def _(t: Tables):
    return rounded(leakage.near_determinism(_geo(t), ["n_name", "c_mktsegment", "parity"], "r_name"))


@query(
    "split_leakage",
    f"""with {SPLIT_ORDERS} select o_custkey, min(split) as first_split, max(split) as last_split, count(*) as rows from parts group by all having min(split) <> max(split)""",
)
def _(t: Tables):
    return leakage.split_leakage(split_orders(t), ["o_custkey"], "split")
