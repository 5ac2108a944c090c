"""Query registration, table access and shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Parquet tables of a folder, read on access."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self) -> str:
        """A fresh folder name on the storage the cluster names for checkpoints."""
        root = ensure_checkpoint_dir(self.spark).rstrip("/")
        name = self.spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
        return f"{root}/tables-{name}"


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is the SQL giving the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return register


# Added before rounding: two engines that compute an exact decimal tie (x.xxxxxx5)
# with different last bits would otherwise round it to different sides.
NUDGE = 1.3e-9


def rounded(df: DataFrame, places: int = 6, **other: int) -> DataFrame:
    """Round every double so that two engines agree; keyword = places per column."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            digits = other.get(f.name, places)
            if digits <= 7:
                col = F.expr(f"round(`{f.name}` + {NUDGE}D, {digits}) + 0.0D").alias(f.name)
        out.append(col)
    return df.select(*out)


def r(expression: str, places: int = 6) -> str:
    """SQL twin of :func:`rounded` for one expression."""
    return f"(round(({expression}) + {NUDGE}, {places}) + 0.0)"


# --------------------------------------------------------------------------
# shared inputs


def _dirty_columns(string: str) -> list[str]:
    return [
        "o_orderkey",
        "o_custkey",
        f"""case when o_orderkey % 97 = 0 then '   '
             when o_orderkey % 89 = 0 then null
             when o_orderkey % 83 = 0 then 'n/a'
             else concat(' ', cast(cast(o_totalprice as decimal(18,2)) as {string}), ' ') end as total_text""",
        "case when o_orderkey % 194 = 0 then 0 else cast(1 + o_orderkey % 7 as int) end as units",
        """case when o_orderkey % 53 = 0 then lower(o_orderstatus)
             when o_orderkey % 59 = 0 then concat(' ', o_orderstatus)
             when o_orderkey % 61 = 0 then 'X'
             else o_orderstatus end as status""",
        "case when o_orderstatus = 'F' then 'Yes' else 'No' end as label",
    ]


def dirty_orders(t: Tables) -> DataFrame:
    """Orders with blanks, nulls, bad numbers and label variants."""
    return t.orders.selectExpr(*_dirty_columns("string"))


DIRTY = "dirty as (select " + ", ".join(_dirty_columns("varchar")) + " from orders)"
DIRTY = DIRTY.replace("case when o_orderkey % 194 = 0 then 0 else cast(1 + o_orderkey % 7 as int) end", "cast(case when o_orderkey % 194 = 0 then 0 else 1 + o_orderkey % 7 end as integer)")

# Number parsing as in functions.text.to_number, for text without infinities.
NUMBER = r"case when regexp_full_match(trim({0}), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim({0}) as double) end"

_LABELLED = [
    "doc_id",
    "lang",
    "source",
    "n_chars",
    "case when quality = 1 then 'good' when quality = 0 then 'bad' end as quality",
]


def labelled_documents(t: Tables) -> DataFrame:
    """Documents with their quality label, null where not labelled."""
    return t.documents.drop("text").join(t.labels, "doc_id", "left").selectExpr(*_LABELLED)


LABELLED = (
    "labelled as (select d.doc_id, d.lang, d.source, d.n_chars, "
    "case when l.quality = 1 then 'good' when l.quality = 0 then 'bad' end as quality "
    "from documents d left join labels l on d.doc_id = l.doc_id)"
)

_SCORE = "round(1 / (1 + exp(-((l_quantity - 25.5) / 20 + (l_discount - 0.05) * 10 - l_extendedprice / 200000 - 1.0))), 6)"
_SCORE_B = "round(1 / (1 + exp(-((l_extendedprice - 50000) / 40000 - l_tax * 5 - 0.8))), 6)"


def scored_lines(t: Tables) -> DataFrame:
    """Line items with a fixed logistic score of their columns; label = returned."""
    return t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "cast(l_returnflag = 'R' as int) as label", f"{_SCORE} as score"
    )


SCORED = (
    "scored as (select l_orderkey, l_linenumber, cast(l_returnflag = 'R' as integer) as label, "
    f"{_SCORE} as score from lineitem)"
)


def two_models(t: Tables) -> DataFrame:
    """Two fixed scores of every line item, as models m1 and m2."""
    return t.lineitem.selectExpr(
        "cast(l_returnflag = 'R' as int) as label",
        f"inline(array(struct('m1' as model_id, {_SCORE} as score), struct('m2' as model_id, {_SCORE_B} as score)))",
    )


TWO_MODELS = (
    "models as (select cast(l_returnflag = 'R' as integer) as label, 'm1' as model_id, "
    f"{_SCORE} as score from lineitem union all select cast(l_returnflag = 'R' as integer), 'm2', {_SCORE_B} from lineitem)"
)

# A deterministic split of orders by key digest, used where a split is an input.
_SPLIT = (
    "case when substr(md5(cast(o_orderkey as {0})), 1, 1) in ('0', '1') then 'validation' "
    "when substr(md5(cast(o_orderkey as {0})), 1, 1) in ('2', '3') then 'test' else 'train' end as split"
)


def split_orders(t: Tables) -> DataFrame:
    return t.orders.selectExpr("*", _SPLIT.format("string"))


SPLIT_ORDERS = "parts as (select *, " + _SPLIT.format("varchar") + " from orders)"
