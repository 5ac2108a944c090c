"""Reads, writes, inventories and content identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare
from ..sources import identity, inventory, store, tables
from .catalog import Tables, query
from .preparation import _RANKED, _split_checks_sql

ORDERS_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


@query(
    "read_table",
    "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders",
)
def _(t: Tables):
    return tables.read_table(t.spark, f"{t.folder}/orders.parquet", ORDERS_SCHEMA)


@query(
    "read_csv_table",
    "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders",
)
def _(t: Tables):
    path = t.scratch()
    columns = [c.split()[0] for c in ORDERS_SCHEMA.split(", ")]
    t.orders.select(*columns).write.options(header="true").csv(path)
    return tables.read_table(t.spark, path, ORDERS_SCHEMA, "csv")


_CELLS = {
    "l_orderkey": "cast(l_orderkey as varchar)",
    "l_linenumber": "cast(l_linenumber as varchar)",
    "l_quantity": "cast(cast(l_quantity as decimal(38,2)) as varchar)",
    "l_extendedprice": "cast(cast(l_extendedprice as decimal(38,2)) as varchar)",
    "l_discount": "cast(cast(l_discount as decimal(38,2)) as varchar)",
    "l_tax": "cast(cast(l_tax as decimal(38,2)) as varchar)",
    "l_returnflag": "l_returnflag",
    "l_linestatus": "l_linestatus",
    "l_shipdate": "cast(l_shipdate as varchar)",
}


def _fingerprint_sql(cells: dict[str, str], source: str) -> str:
    parts = ", ".join(f"coalesce(length({c}) || ':' || {c}, '~')" for c in cells.values())
    halves = [f"cast(sum(('0x' || substr(h, {at}, 16))::ubigint) as varchar)" for at in (1, 17)]
    return f"select count(*) as rows, {halves[0]} || '-' || {halves[1]} as digest from (select md5(concat({parts})) as h from {source}) hashed"


_ORDER_CELLS = {c: f"cast({c} as varchar)" for c in ("o_orderkey", "o_orderstatus", "cents")}


def _cut(t: Tables):
    return prepare.stratified_split(
        t.orders.select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("label")),
        ["o_orderkey"],
        "label",
        ["Yes", "No"],
    )


@query(
    "write_splits",
    """with n as (select count(*) as n, count(*) filter (o_orderstatus = 'F') as f from orders), h as (select n, ceil((0.15::double + 0.15::double) * n)::bigint as held from n)
       select 'train' as split, n - held as rows from h union all select 'validation', held - ceil(0.5 * held)::bigint from h union all select 'test', ceil(0.5 * held)::bigint from h""",
)
def _(t: Tables):
    path = t.scratch()
    tables.write_splits(_cut(t), path)
    return t.spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("rows"))


@query(
    "write_idempotent",
    """with o as (select o_orderkey, o_orderstatus, cast(round(o_totalprice * 100) as bigint) as cents from orders),
       a as (select 1::bigint as sequence, * from (_ALL_)), b as (select 2::bigint as sequence, * from (_SOME_))
       select *, 'created' as status from a union all select *, 'reused_equivalent' from a union all select *, 'overwritten' from b"""
    .replace("_ALL_", _fingerprint_sql(_ORDER_CELLS, "o")).replace("_SOME_", _fingerprint_sql(_ORDER_CELLS, "o where o_orderstatus <> 'P'")),
)
def _(t: Tables):
    path = t.scratch()
    data = t.orders.select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    out = [
        store.write_idempotent(data, path, method="portable"),
        store.write_idempotent(data.repartition(3), path, method="portable"),
        store.write_idempotent(data.where("o_orderstatus <> 'P'"), path, overwrite=True, method="portable"),
    ]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("sequence", "rows", "digest", "status")


@query(
    "file_inventory",
    """with f as (select 'status=' || o_orderstatus as path, string_agg(o_orderkey || chr(10), '' order by o_orderkey) as content from orders group by all)
       select path, cast(length(content) as bigint) as bytes, sha256(content) as sha256, 'available' as status from f
       union all select 'absent.txt', null, null, 'missing'""",
)
def _(t: Tables):
    """One text file of order keys per status."""
    path = t.scratch()
    keys = t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").cast("string").alias("value"), "o_orderkey")
    keys.repartition("status").sortWithinPartitions("status", "o_orderkey").drop("o_orderkey").write.partitionBy("status").text(path)
    # half of the sizes are streamed, half are read whole
    found = inventory.file_inventory(t.spark, path, ["absent.txt"], whole_bytes=100_000)
    return found.withColumn("path", F.regexp_replace("path", "/part-.*", ""))


@query("content_fingerprint", _fingerprint_sql(_CELLS, "lineitem"))
def _(t: Tables):
    return identity.content_fingerprint(t.lineitem, list(_CELLS), decimals=2)


@query(
    "content_fingerprint_text",
    _fingerprint_sql({c: f"cast({c} as varchar)" for c in ("doc_id", "text", "lang", "source", "n_chars")}, "documents"),
)
def _(t: Tables):
    return identity.content_fingerprint(t.documents, ["doc_id", "text", "lang", "source", "n_chars"])


@query(
    "source_identity",
    "with f as ("
    + _fingerprint_sql({c: f"cast({c} as varchar)" for c in ("doc_id", "text", "lang", "source", "n_chars")}, "documents")
    + """) select 'documents' as source, rows, 5::integer as columns, 'doc_id' as identifiers, 'lang' as target,
         md5('doc_id:bigint,text:string,lang:string,source:string,n_chars:bigint') as schema_digest, digest as content_digest from f""",
)
def _(t: Tables):
    return identity.source_identity(t.documents, "documents", ["doc_id"], "lang")


@query(
    "verify_handoff",
    _split_checks_sql("ranked", "cut", _RANKED)
    + """ union all select c, 'handoff', '*', 0::bigint, true
         from (select unnest(['stored_columns_present', 'stored_rows_match', 'stored_digest_matches']) as c)""",
)
def _(t: Tables):
    path, cut = t.scratch(), _cut(t)
    store.write_idempotent(cut, path, partition_by=["split"])
    return store.verify_handoff(t.spark, path, cut.drop("split"), ["o_orderkey"], "label", ["Yes", "No"])
