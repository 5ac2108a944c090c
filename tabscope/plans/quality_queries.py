"""Predicates, keys, value rules, contracts, duplicates, target checks, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks, duplicates, prepare, quality, registry, relations, scale, target
from ..operators.quality import TableContract, ValueRule
from .catalog import DIRTY, LABELLED, NUMBER, SPLIT_ORDERS, Tables, dirty_orders, labelled_documents, query, r, rounded, split_orders

# --------------------------------------------------------------------------
# projections, encodings, masks


@query(
    "separate_roles",
    "select o_orderkey, o_orderpriority, o_totalprice, o_orderstatus from orders",
)
def _(t: Tables):
    return prepare.separate_roles(t.orders, ["o_orderkey"], ["o_orderpriority", "o_totalprice"], "o_orderstatus")


@query(
    "encode_target",
    """select o_orderstatus, case o_orderstatus when 'O' then 0 when 'F' then 1 end as label, count(*) as n
       from orders group by all""",
)
def _(t: Tables):
    encoded = prepare.encode_target(t.orders, "o_orderstatus", {"O": 0, "F": 1})
    return encoded.groupBy("o_orderstatus", "label").agg(F.count("*").alias("n"))


@query(
    "target_encoding_checks",
    """with c as (select count(*) filter (o_orderstatus is null) as a,
                         count(*) filter (o_orderstatus not in ('O', 'F')) as b from orders)
       select 'labels_present' as "check", 'target' as scope, 'o_orderstatus' as item, a as n_violations, a = 0 as passed from c
       union all select 'labels_mapped', 'target', 'o_orderstatus', b, b = 0 from c""",
)
def _(t: Tables):
    encoded = prepare.encode_target(t.orders, "o_orderstatus", {"O": 0, "F": 1})
    return prepare.target_encoding_checks(encoded, "o_orderstatus")


@query(
    "value_masks",
    f"""with {DIRTY} select o_orderkey, total_text is null as missing,
        total_text is not null and trim(total_text) = '' as blank,
        total_text is not null and trim(total_text) <> '' as candidate from dirty""",
)
def _(t: Tables):
    df = dirty_orders(t)
    col, dtype = F.col("total_text"), df.schema["total_text"].dataType
    return df.select(
        "o_orderkey",
        text.missing(col, dtype).alias("missing"),
        text.blank(col, dtype).alias("blank"),
        text.present(col, dtype).alias("candidate"),
    )


@query(
    "domain_membership",
    f"""with {DIRTY} select o_orderkey, status in ('F', 'O', 'P') as exact,
        lower(trim(status)) in ('f', 'o', 'p') as normalized from dirty""",
)
def _(t: Tables):
    col, domain = F.col("status"), ["F", "O", "P"]
    return dirty_orders(t).select(
        "o_orderkey",
        quality.in_domain(col, domain).alias("exact"),
        quality.in_domain_normalized(col, domain, strip_strings=True, case_sensitive=False).alias("normalized"),
    )


@query(
    "numeric_parse",
    f"""with {DIRTY}, p as (select o_orderkey, {NUMBER.format('total_text')} as number from dirty)
        select o_orderkey, number, abs(number - floor(number)) > 1e-12 as fractional,
        number < 1000 as below_minimum, number > 100000 as above_maximum from p""",
)
def _(t: Tables):
    df = dirty_orders(t)
    number = text.to_number(F.col("total_text"), df.schema["total_text"].dataType)
    parsed = df.select("o_orderkey", number.alias("number"))
    return parsed.select(
        "o_orderkey",
        "number",
        (F.abs(F.pmod("number", F.lit(1.0))) > 1e-12).alias("fractional"),
        (F.col("number") < 1000).alias("below_minimum"),
        (F.col("number") > 100000).alias("above_maximum"),
    )


@query(
    "unpivot_value_counts",
    """select feature, value, count(*) as n from (
         select 'l_quantity' as feature, l_quantity as value from lineitem
         union all select 'l_discount', l_discount from lineitem
         union all select 'l_tax', l_tax from lineitem
         union all select 'l_linenumber', cast(l_linenumber as double) from lineitem) group by all""",
)
def _(t: Tables):
    df = t.lineitem
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    long = scale.unpivot(df, {c: F.col(c).cast("double") for c in names})
    return long.groupBy("feature", "value").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------
# keys and value rules


@query(
    "key_profile",
    """with k as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by all)
       select cast(sum(n) as bigint) as rows, cast(sum(n) as bigint) as non_null, count(*) as unique_values,
       cast(0 as bigint) as missing, count(*) filter (n > 1) as duplicated_values,
       cast(coalesce(sum(n) filter (n > 1), 0) as bigint) as duplicated_rows from k""",
)
def _(t: Tables):
    return quality.key_profile(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "key_profile_nullable",
    f"""with {DIRTY}, k as (select total_text, count(*) as n from dirty group by all)
       select cast(sum(n) as bigint) as rows,
       cast(sum(n) filter (total_text is not null) as bigint) as non_null,
       count(*) filter (total_text is not null) as unique_values,
       cast(coalesce(sum(n) filter (total_text is null), 0) as bigint) as missing,
       count(*) filter (n > 1 and total_text is not null) as duplicated_values,
       cast(coalesce(sum(n) filter (n > 1 and total_text is not null), 0) as bigint) as duplicated_rows from k""",
)
def _(t: Tables):
    return quality.key_profile(dirty_orders(t), ["total_text"])


@query(
    "duplicated_rows",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem
       where (l_orderkey, l_linenumber) in
         (select (l_orderkey, l_linenumber) from lineitem group by l_orderkey, l_linenumber having count(*) > 1)""",
)
def _(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return quality.duplicated_rows(lines, ["l_orderkey", "l_linenumber"])


RULES = {
    "total_text": ValueRule(required=True, numeric=True, minimum=1000, maximum=400000),
    "units": ValueRule(required=True, integer=True, minimum=1, maximum=6),
    "status": ValueRule(required=True, allowed=("F", "O", "P"), strip_strings=True, case_sensitive=False),
    "label": ValueRule(required=True, allowed=("No", "Yes")),
    "absent_column": ValueRule(required=True),
}

_FAILS = f"""{DIRTY}, p as (
  select *, {NUMBER.format('total_text')} as number,
    total_text is not null and trim(total_text) = '' as blank_total,
    status in ('F', 'O', 'P') as ok, lower(trim(status)) in ('f', 'o', 'p') as near from dirty)"""


@query(
    "value_quality",
    f"""with {_FAILS}, c as (select count(*) as rows,
          count(*) filter (total_text is null) as t_missing, count(*) filter (blank_total) as t_blank,
          count(*) filter (total_text is not null and not blank_total and number is null) as t_text,
          count(*) filter (number < 1000) as t_low, count(*) filter (number > 400000) as t_high,
          count(*) filter (units < 1) as u_low, count(*) filter (units > 6) as u_high,
          count(*) filter (not ok and near) as s_near, count(*) filter (not ok and not near) as s_bad from p),
        f as (
          select 'total_text' as "column", rows, t_missing as missing, t_blank as blank, 0 as inconsistent,
            t_missing + t_blank + t_text + t_low + t_high as invalid,
            t_missing + t_blank + t_text + t_low + t_high as affected,
            concat_ws(', ', case when t_missing > 0 then 'Missing value' end, case when t_blank > 0 then 'Blank value' end,
              case when t_text > 0 then 'Non-numeric value' end, case when t_low > 0 then 'Below minimum' end,
              case when t_high > 0 then 'Above maximum' end) as issue_types, null as fixed from c
          union all select 'units', rows, 0, 0, 0, u_low + u_high, u_low + u_high,
            concat_ws(', ', case when u_low > 0 then 'Below minimum' end, case when u_high > 0 then 'Above maximum' end), null from c
          union all select 'status', rows, 0, 0, s_near, s_bad, s_near + s_bad,
            concat_ws(', ', case when s_near > 0 then 'Inconsistent text' end, case when s_bad > 0 then 'Unexpected value' end), null from c
          union all select 'label', rows, 0, 0, 0, 0, 0, '', null from c
          union all select 'o_orderkey', rows, 0, 0, 0, 0, 0, '', 'Not assessed' from c
          union all select 'o_custkey', rows, 0, 0, 0, 0, 0, '', 'Not assessed' from c
          union all select 'absent_column', 0, 0, 0, 0, 0, 0, '', 'Missing column' from c)
        select "column", cast(rows as bigint) as rows, cast(missing as bigint) as missing, cast(blank as bigint) as blank,
          cast(inconsistent as bigint) as inconsistent, cast(invalid as bigint) as invalid, cast(affected as bigint) as affected,
          case when rows = 0 then 0.0 else round(affected * 100.0::double / rows, 4) end as affected_percent, issue_types,
          coalesce(fixed, case when affected > 0 then 'Review required' else 'Valid' end) as status from f""",
)
def _(t: Tables):
    return quality.value_quality(dirty_orders(t), RULES)


@query(
    "value_issue_samples",
    f"""with {_FAILS}, f as (
          select 'total_text' as "column", 'Missing value' as issue, '<missing>' as raw_value from p where total_text is null
          union all select 'total_text', 'Blank value', total_text from p where blank_total
          union all select 'total_text', 'Non-numeric value', total_text from p where total_text is not null and not blank_total and number is null
          union all select 'total_text', 'Below minimum', total_text from p where number < 1000
          union all select 'total_text', 'Above maximum', total_text from p where number > 400000
          union all select 'units', 'Below minimum', cast(units as varchar) from p where units < 1
          union all select 'units', 'Above maximum', cast(units as varchar) from p where units > 6
          union all select 'status', 'Inconsistent text', status from p where not ok and near
          union all select 'status', 'Unexpected value', status from p where not ok and not near),
        g as (select "column", issue, raw_value, count(*) as n from f group by all)
        select *, cast(row_number() over (partition by "column", issue order by n desc, raw_value) as integer) as position
        from g qualify position <= 5""",
)
def _(t: Tables):
    return quality.value_issue_samples(dirty_orders(t), RULES, k=5)


# --------------------------------------------------------------------------
# contracts


@query(
    "contract_coverage",
    """with o as (
         select 'o_orderkey' as "column", count(o_orderkey) as present, 'integer' as type from orders
         union all select 'o_orderstatus', count(o_orderstatus), 'string' from orders
         union all select 'o_totalprice', count(o_totalprice), 'floating' from orders
         union all select 'o_custkey', count(o_custkey), 'integer' from orders
         union all select 'o_orderdate', count(o_orderdate), 'datetime' from orders
         union all select 'o_orderpriority', count(o_orderpriority), 'string' from orders),
       d as (select * from (values ('o_orderkey', 'integer'), ('o_totalprice', 'integer'), ('o_comment', 'string')) v("column", type))
       select coalesce(o."column", d."column") as "column", o.type as observed_type, d.type as expected_type,
         case when o.type is null then 'Missing column' when d.type is null then 'Not declared'
              when o.type = d.type then 'Match' else 'Mismatch' end as status, coalesce(o.present, 0) as present
       from o full join d on o."column" = d."column" """,
)
def _(t: Tables):
    df = t.orders
    types = {f.name: quality.type_family(f.dataType) for f in df.schema.fields}
    kind = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    present = scale.unpivot(df, {c: F.col(c).isNotNull().cast("bigint") for c in df.columns}, name="column")
    observed = present.groupBy("column").agg(F.sum("value").alias("present")).withColumn("type", kind[F.col("column")])
    declared = df.sparkSession.sql(
        "select * from values ('o_orderkey', 'integer'), ('o_totalprice', 'integer'), ('o_comment', 'string') as v(column, type)"
    )
    out = quality.contract_coverage(observed, declared)
    return out.join(observed.select("column", "present"), "column", "left").withColumn(
        "present", F.coalesce("present", F.lit(0))
    )


_EXPECTED_TYPES = {"l_orderkey": "integer", "l_quantity": "numeric", "l_discount": "string", "l_shipdate": "datetime", "l_note": "string"}


@query(
    "schema_check",
    """with c(name, expected, observed, status) as (values
         ('l_orderkey', 'integer', 'integer', 'Match'), ('l_quantity', 'numeric', 'floating', 'Match'),
         ('l_discount', 'string', 'floating', 'Mismatch'), ('l_shipdate', 'datetime', 'datetime', 'Match'),
         ('l_note', 'string', '', 'Missing column'), ('l_partkey', '', 'integer', 'Not declared'),
         ('l_suppkey', '', 'integer', 'Not declared'), ('l_linenumber', '', 'integer', 'Not declared'),
         ('l_extendedprice', '', 'floating', 'Not declared'), ('l_tax', '', 'floating', 'Not declared'),
         ('l_returnflag', '', 'string', 'Not declared'), ('l_linestatus', '', 'string', 'Not declared')),
       n as (select 'l_orderkey' as name, count(l_orderkey) as k from lineitem union all select 'l_quantity', count(l_quantity) from lineitem
         union all select 'l_discount', count(l_discount) from lineitem union all select 'l_shipdate', count(l_shipdate) from lineitem
         union all select 'l_partkey', count(l_partkey) from lineitem union all select 'l_suppkey', count(l_suppkey) from lineitem
         union all select 'l_linenumber', count(l_linenumber) from lineitem union all select 'l_extendedprice', count(l_extendedprice) from lineitem
         union all select 'l_tax', count(l_tax) from lineitem union all select 'l_returnflag', count(l_returnflag) from lineitem
         union all select 'l_linestatus', count(l_linestatus) from lineitem)
       select c.name as "column", expected as expected_type, observed as observed_type, status, n.k as non_null
       from c left join n on c.name = n.name""",
)
def _(t: Tables):
    df = t.lineitem
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    long = scale.unpivot(counts, {c: F.col(c) for c in df.columns}, name="column", value="non_null")
    return quality.schema_check(df, _EXPECTED_TYPES).join(long, "column", "left")


@query(
    "numeric_text_columns",
    f"""with {DIRTY}, q as (select total_text, cast(units as varchar) as units_text, status from dirty)
        select 'total_text' as "column", count(*) filter (trim(total_text) <> '') as non_blank,
          count(*) filter (trim(total_text) <> '' and {NUMBER.format('total_text')} is null) as non_numeric,
          count(*) filter (trim(total_text) <> '' and {NUMBER.format('total_text')} is null) = 0 as numeric_text from q
        union all select 'units_text', count(*), count(*) filter ({NUMBER.format('units_text')} is null),
          count(*) filter ({NUMBER.format('units_text')} is null) = 0 from q
        union all select 'status', count(*) filter (trim(status) <> ''), count(*) filter ({NUMBER.format('status')} is null),
          count(*) filter ({NUMBER.format('status')} is null) = 0 from q""",
)
def _(t: Tables):
    df = dirty_orders(t).withColumn("units_text", F.col("units").cast("string"))
    return quality.numeric_text_columns(df, ["total_text", "units_text", "status"])


CONTRACT = TableContract(
    columns=("o_orderkey", "o_custkey", "total_text", "units", "status", "label"),
    types={"o_orderkey": "integer", "total_text": "numeric", "units": "integer", "status": "string", "label": "string"},
    identifiers=("o_orderkey",),
    target="label",
    classes=("No", "Yes"),
    categories={"status": ("F", "O", "P", "Z")},
    numeric_text=("total_text",),
)

_CONTRACT_SQL = f"""with {DIRTY}, m as (select
    count(*) filter (o_orderkey is null) as k0, count(*) filter (label not in ('No', 'Yes')) as k1,
    cast((count(*) filter (label = 'No') = 0) as integer) + cast((count(*) filter (label = 'Yes') = 0) as integer) as k2,
    count(*) filter (status is null) as k3, count(*) filter (status not in ('F', 'O', 'P', 'Z')) as k4,
    cast((count(*) filter (status = 'F') = 0) as integer) + cast((count(*) filter (status = 'O') = 0) as integer)
      + cast((count(*) filter (status = 'P') = 0) as integer) + cast((count(*) filter (status = 'Z') = 0) as integer) as k5,
    count(*) filter (trim(total_text) <> '' and {NUMBER.format('total_text')} is null) as k6,
    count(*) - count(distinct o_orderkey) as k7 from dirty),
  c as (
    select 'required_columns_present' as "check", unnest(['o_orderkey', 'o_custkey', 'total_text', 'units', 'status', 'label']) as item, 0 as n
    union all select 'column_order_valid', '*', 0
    union all select 'types_valid', unnest(['o_orderkey', 'total_text', 'units', 'status', 'label']), 0
    union all select 'identifiers_complete', 'o_orderkey', k0 from m
    union all select 'identifiers_not_blank', 'o_orderkey', 0 from m
    union all select 'target_valid', 'label: missing', 0 from m
    union all select 'target_valid', 'label: unexpected', k1 from m
    union all select 'target_valid', 'label: absent', k2 from m
    union all select 'categories_valid', 'status: missing', k3 from m
    union all select 'categories_valid', 'status: unexpected', k4 from m
    union all select 'categories_valid', 'status: absent', k5 from m
    union all select 'types_valid', 'total_text: non-numeric text', k6 from m
    union all select 'identifiers_unique', 'o_orderkey', k7 from m)"""


@query(
    "raw_contract",
    _CONTRACT_SQL + """ select "check", 'contract' as scope, item, cast(n as bigint) as n_violations, n = 0 as passed from c""",
)
def _(t: Tables):
    return quality.raw_contract(dirty_orders(t), CONTRACT)


@query(
    "readiness_rollup",
    _CONTRACT_SQL
    + """ select "check", count(*) as n_checks, count(*) filter (n <> 0) as n_failed, bool_and(n = 0) as all_passed,
          bool_or(n = 0) as any_passed from c group by "check" """,
)
def _(t: Tables):
    return checks.readiness(quality.raw_contract(dirty_orders(t), CONTRACT), "check")


@query(
    "status_summary",
    f"""with {SPLIT_ORDERS}, d(i, s) as (values (1, 'train'), (2, 'validation'), (3, 'test'), (4, 'holdout'))
        select cast(i as integer) as status_order, s as status, count(p.split) as n from d left join parts p on p.split = d.s group by all""",
)
def _(t: Tables):
    return checks.status_summary(split_orders(t), "split", ["train", "validation", "test", "holdout"])


# --------------------------------------------------------------------------
# duplicates


@query(
    "exact_duplicates",
    """select l_returnflag, l_linestatus, l_quantity, count(*) as group_size from lineitem
       group by all having count(*) > 1""",
)
def _(t: Tables):
    return duplicates.exact_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity"))


@query(
    "exact_duplicates_all_columns",
    "select *, count(*) as group_size from lineitem group by all having count(*) > 1",
)
def _(t: Tables):
    return duplicates.exact_duplicates(t.lineitem)


@query(
    "exact_duplicate_rows",
    """with d as (select lang, source, sha256(concat(length(text), ':', text)) as h from documents),
       w as (select lang, source, h, sha256(concat(length(h), ':', h, length(lang), ':', lang, length(source), ':', source)) as group_id from d)
       select lang, source, h as text_digest, group_id, count(*) over (partition by group_id) as group_size
       from w qualify group_size > 1""",
)
def _(t: Tables):
    df = t.documents.select(duplicates.row_digest(["text"]).alias("text_digest"), "lang", "source")
    return duplicates.exact_duplicate_rows(df)


@query(
    "identifier_conflicts",
    """select l_orderkey, l_linenumber, count(*) as group_size,
         count(distinct (l_partkey, l_suppkey, l_quantity)) as distinct_records,
         case when count(distinct (l_partkey, l_suppkey, l_quantity)) = 1 then 'Repeated identical record'
              else 'Conflicting records' end as classification
       from lineitem group by l_orderkey, l_linenumber having count(*) > 1""",
)
def _(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return duplicates.identifier_conflicts(lines, ["l_orderkey", "l_linenumber"])


_PROFILES = """labelled as (select d.doc_id, d.text, l.quality from documents d left join labels l on d.doc_id = l.doc_id),
  profiles as (select sha256(concat(length(text), ':', text)) as profile_id, count(*) as group_size,
     count(distinct doc_id) as distinct_identifiers,
     count(distinct coalesce('=' || cast(quality as varchar), '~')) as target_values
     from labelled group by text having count(distinct doc_id) > 1)"""


def _labelled_texts(t: Tables):
    return t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query(
    "repeated_profiles",
    f"with {_PROFILES} select profile_id, group_size, distinct_identifiers from profiles",
)
def _(t: Tables):
    return duplicates.repeated_profiles(t.documents, ["text"], ["doc_id"])


@query(
    "profile_target_conflicts",
    f"""with {_PROFILES} select *, case when target_values = 1 then 'Same target' else 'Target disagreement' end as classification
        from profiles""",
)
def _(t: Tables):
    return duplicates.repeated_profiles(_labelled_texts(t), ["text"], ["doc_id"], "quality")


@query(
    "profile_target_values",
    f"""with {_PROFILES} select sha256(concat(length(text), ':', text)) as profile_id,
          coalesce(cast(quality as varchar), '<missing>') as target_value, count(*) as n
        from labelled where sha256(concat(length(text), ':', text)) in (select profile_id from profiles)
        group by all""",
)
def _(t: Tables):
    return duplicates.profile_target_values(_labelled_texts(t), ["text"], ["doc_id"], "quality")


@query(
    "duplicate_summary",
    """with e2 as (select count(*) as n from lineitem group by l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag having count(*) > 1),
       i as (select count(*) as n, count(distinct (l_quantity, l_discount, l_returnflag)) as d from lineitem group by l_orderkey, l_linenumber having count(*) > 1),
       p as (select count(*) as n, count(distinct l_returnflag) as c from lineitem group by l_quantity, l_discount
             having count(distinct (l_orderkey, l_linenumber)) > 1)
       select 'Exact duplicate records' as metric, count(*) as group_count, cast(coalesce(sum(n), 0) as bigint) as row_count from e2
       union all select 'Duplicate identifiers', count(*), cast(coalesce(sum(n), 0) as bigint) from i
       union all select 'Conflicting duplicate identifiers', count(*), cast(coalesce(sum(n), 0) as bigint) from i where d > 1
       union all select 'Repeated feature profiles', count(*), cast(coalesce(sum(n), 0) as bigint) from p
       union all select 'Repeated profiles with the same target', count(*), cast(coalesce(sum(n), 0) as bigint) from p where c = 1
       union all select 'Repeated profiles with target disagreement', count(*), cast(coalesce(sum(n), 0) as bigint) from p where c > 1""",
)
def _(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    return duplicates.duplicate_summary(df, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"], "l_returnflag")


@query(
    "sample_duplicate_groups",
    """with g as (select l_orderkey, l_linenumber, count(*) as group_size from lineitem group by all
                  having count(*) > 1 order by 1, 2 limit 20)
       select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity, g.group_size from lineitem l
       join g on l.l_orderkey = g.l_orderkey and l.l_linenumber = g.l_linenumber""",
)
def _(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return duplicates.sample_groups(lines, ["l_orderkey", "l_linenumber"], 20)


# --------------------------------------------------------------------------
# target


_CLASSES = f"""{LABELLED}, c as (
    select x.class, coalesce(n, 0) as n, expected_order from
      (select unnest(['good', 'bad', 'unsure']) as class, unnest([1, 2, 3]) as expected_order
       union all select quality, null from labelled where quality is not null and quality not in ('good', 'bad', 'unsure') group by quality) x
    left join (select quality as class, count(*) as n from labelled where quality is not null group by quality) o on x.class = o.class)"""


@query(
    "class_distribution",
    f"""with {_CLASSES}, s as (select sum(n) as total, max(n) as top, min(n) filter (n > 0) as low from c),
        k as (select count(*) filter (n = top and n > 0) as tops, count(*) filter (n = low) as lows from c, s)
        select class, cast(n as bigint) as n, {r('n / total')} as share, expected_order is not null as expected,
          cast(expected_order as integer) as expected_order,
          case when n = 0 then 'Absent expected' when n = top and tops > 1 then 'Tied' when n = top then 'Majority'
            when n = low and lows > 1 then 'Tied minority' when n = low then 'Minority' else 'Intermediate' end
          || case when class = 'good' then ' / Positive' else ' / Negative' end as role
        from c, s, k""",
)
def _(t: Tables):
    return rounded(target.class_distribution(labelled_documents(t), "quality", ["good", "bad", "unsure"], "good"))


@query(
    "class_roles_order_status",
    f"""with c as (select o_orderstatus as class, count(*) as n from orders group by all)
        select class, n, {r('n / (select sum(n) from c)')} as share, true as expected, cast(null as integer) as expected_order,
          case when n = (select max(n) from c) then case when (select count(*) from c where n = (select max(n) from c)) > 1 then 'Tied' else 'Majority' end
               when n = (select min(n) from c) then case when (select count(*) from c where n = (select min(n) from c)) > 1 then 'Tied minority' else 'Minority' end
               else 'Intermediate' end as role from c""",
)
def _(t: Tables):
    return rounded(target.class_distribution(t.orders, "o_orderstatus"))


@query(
    "imbalance_summary",
    f"""with {LABELLED}, c as (select quality as class, count(*) as n from labelled where quality is not null group by all),
        s as (select cast(sum(n) as bigint) as non_missing, max(n) as majority_count, min(n) as minority_count,
              cast(sum(n) filter (class = 'good') as bigint) as positive_count from c)
        select *, {r('majority_count / non_missing')} as majority_share, {r('minority_count / non_missing')} as minority_share,
          {r('majority_count / minority_count')} as imbalance_ratio, {r('positive_count / non_missing')} as positive_share,
          {r('majority_count / non_missing')} as majority_baseline_accuracy from s""",
)
def _(t: Tables):
    return rounded(target.imbalance_summary(labelled_documents(t), "quality", "good"))


@query(
    "target_issues",
    f"""with {LABELLED}, c as (select quality as class, count(*) as n from labelled group by all)
        select 'Missing target values' as issue, '<missing>' as class, n from c where class is null
        union all select 'Unexpected classes', class, n from c where class not in ('good', 'unsure')
        union all select 'Missing expected classes', 'unsure', 0 where 'unsure' not in (select class from c where class is not null)""",
)
def _(t: Tables):
    return target.target_issues(labelled_documents(t), "quality", ["good", "unsure"])


# --------------------------------------------------------------------------
# joins, set operations, registries


@query(
    "aligned_projections",
    """with l as (select l_orderkey as k, count(*) as n from lineitem group by all), o as (select o_orderkey as k, count(*) as n from orders group by all),
       j as (select coalesce(l.n, 0) as l, coalesce(o.n, 0) as r from l full join o on l.k = o.k)
       select cast(sum(l) as bigint) as left_rows, cast(sum(r) as bigint) as right_rows,
         count(*) filter (l = 1 and r = 1) as matched_keys, count(*) filter (r = 0) as left_only_keys,
         count(*) filter (l = 0) as right_only_keys, count(*) filter (l > 1 or r > 1) as repeated_keys,
         count(*) filter (r = 0) = 0 and count(*) filter (l = 0) = 0 and count(*) filter (l > 1 or r > 1) = 0 as aligned from j""",
)
def _(t: Tables):
    left = t.lineitem.select(F.col("l_orderkey").alias("k"))
    return relations.aligned(left, t.orders.select(F.col("o_orderkey").alias("k")), ["k"])


@query(
    "semi_membership",
    "select o_orderkey, o_orderstatus from orders where o_orderkey in (select l_orderkey from lineitem)",
)
def _(t: Tables):
    return registry.semi(t.orders.select("o_orderkey", "o_orderstatus"), t.lineitem, {"o_orderkey": "l_orderkey"})


@query(
    "anti_membership",
    "select o_orderkey, o_orderstatus from orders where o_orderkey not in (select l_orderkey from lineitem where l_orderkey is not null)",
)
def _(t: Tables):
    return registry.anti(t.orders.select("o_orderkey", "o_orderstatus"), t.lineitem, {"o_orderkey": "l_orderkey"})


@query(
    "split_overlap",
    f"""with {SPLIT_ORDERS} select o_custkey from parts where split = 'train' intersect select o_custkey from parts where split = 'test'""",
)
def _(t: Tables):
    parts = split_orders(t)
    return registry.overlap(parts.where("split = 'train'"), parts.where("split = 'test'"), ["o_custkey"])


@query(
    "coverage_difference",
    """with d as (select k, sum(s) as d from (select o_custkey as k, 1 as s from orders union all select c_custkey, -1 from customer) group by k having sum(s) <> 0)
       select k as custkey, case when d > 0 then 'missing' else 'extra' end as side, cast(abs(d) as bigint) as n from d""",
)
def _(t: Tables):
    left = t.orders.select(F.col("o_custkey").alias("custkey"))
    right = t.customer.select(F.col("c_custkey").alias("custkey"))
    return registry.coverage_difference(left, right, ["custkey"])


@query(
    "union_partitions",
    f"""with {SPLIT_ORDERS} select o_orderkey, o_orderstatus, split from parts where split in ('train', 'validation')""",
)
def _(t: Tables):
    parts = split_orders(t).select("o_orderkey", "o_orderstatus", "split")
    return registry.union_all(parts.where("split = 'train'"), parts.where("split = 'validation'"))


@query(
    "domain_outer_join",
    """with d(v, o) as (values ('1-URGENT', 1), ('2-HIGH', 2), ('9-NONE', 3))
       select coalesce(d.v, c.v) as priority, coalesce(n, 0) as n, cast(o as integer) as expected_order from d
       full join (select o_orderpriority as v, count(*) as n from orders group by all) c on d.v = c.v""",
)
def _(t: Tables):
    counts = t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return target.with_domain(counts, "priority", ["1-URGENT", "2-HIGH", "9-NONE"], ["n"])


@query(
    "duplicate_ids",
    "select l_orderkey, count(*) as n from lineitem where l_orderkey is not null group by all having count(*) > 1",
)
def _(t: Tables):
    return registry.duplicate_ids(t.lineitem, "l_orderkey")


@query(
    "vocabulary_check",
    f"""with {DIRTY} select 'status' as "column", coalesce(status, '<missing>') as value, count(*) as n from dirty
          where status is null or status not in ('F', 'O', 'P') group by all
        union all select 'total_text', coalesce(total_text, '<missing>'), count(*) from dirty
          where total_text is null or total_text not in ('n/a', '   ') group by all""",
)
def _(t: Tables):
    return registry.vocabulary_check(dirty_orders(t), {"status": ["F", "O", "P"], "total_text": ["n/a", "   "]})


@query(
    "reference_check",
    """select l_orderkey as reference, count(*) as n from lineitem
       where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P') group by all""",
)
def _(t: Tables):
    return registry.reference_check(t.lineitem, "l_orderkey", t.orders.where("o_orderstatus <> 'P'"), "o_orderkey")


@query(
    "reference_check_array",
    """with c as (select unnest([l_partkey, l_suppkey]) as reference from lineitem)
       select reference, count(*) as n from c where reference is not null
       and reference not in (select s_suppkey from supplier) group by all""",
)
def _(t: Tables):
    child = t.lineitem.select(F.array("l_partkey", "l_suppkey").alias("refs"))
    return registry.reference_check(child, "refs", t.supplier, "s_suppkey")


@query(
    "coverage_check",
    """select item_id from benchmark b where not exists (select 1 from documents d where d.text = b.text)""",
)
def _(t: Tables):
    parents = t.benchmark.select("item_id", duplicates.row_digest(["text"]).alias("digest"))
    child = t.documents.select(duplicates.row_digest(["text"]).alias("digest"))
    return registry.coverage_check(parents, "digest", child, "digest").select("item_id")


@query(
    "link_counts",
    """select d.doc_id, count(l.doc_id) as links from documents d left join labels l on d.doc_id = l.doc_id group by all""",
)
def _(t: Tables):
    return registry.link_counts(t.documents, "doc_id", t.labels, "doc_id")


_LEVELS = {"o_orderstatus": ["P", "O"], "o_orderpriority": ["1-URGENT", "3-MEDIUM", "5-LOW"]}


@query(
    "order_by_priority",
    """select o_orderkey, o_orderstatus, o_orderpriority,
         cast(case o_orderstatus when 'P' then 1 when 'O' then 2 else 3 end as integer) as o_orderstatus_priority,
         cast(case o_orderpriority when '1-URGENT' then 1 when '3-MEDIUM' then 2 when '5-LOW' then 3 else 4 end as integer) as o_orderpriority_priority
       from orders order by 4, 5, 1""",
)
def _(t: Tables):
    return registry.order_by_priority(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), _LEVELS, "o_orderkey")


@query(
    "blockers",
    """select o.o_orderkey, o.o_orderpriority, l.l_linenumber as linked from
       (select * from orders where o_orderstatus = 'P') o left join lineitem l on l.l_orderkey = o.o_orderkey""",
)
def _(t: Tables):
    return registry.blockers(
        t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus"),
        "o_orderkey",
        t.lineitem,
        "l_orderkey",
        "l_linenumber",
        F.col("o_orderstatus") == "P",
    ).drop("o_orderstatus")


@query(
    "required_fields",
    f"""with {DIRTY} select 'total_text' as "column", count(*) filter (total_text is null) as missing,
          count(*) filter (trim(total_text) = '') as blank from dirty
        union all select 'status', count(*) filter (status is null), count(*) filter (trim(status) = '') from dirty
        union all select 'units', count(*) filter (units is null), 0 from dirty""",
)
def _(t: Tables):
    return registry.required_fields(dirty_orders(t), ["total_text", "status", "units"])


@query(
    "unknown_categories",
    f"""with {SPLIT_ORDERS}, a as (select 'o_orderstatus' as feature, o_orderstatus as category, split from parts
          union all select 'o_custkey', cast(o_custkey as varchar), split from parts)
        select feature, category, count(*) as n from a where split = 'test'
          and (feature, category) not in (select (feature, category) from a where split = 'train') group by all""",
)
def _(t: Tables):
    parts = split_orders(t)
    return registry.unknown_categories(
        parts.where("split = 'train'"), parts.where("split = 'test'"), ["o_orderstatus", "o_custkey"]
    )
