"""The numbered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import align
from .bpe import decode_ids, encode_texts
from .common import fold, table
from .ctw import code_lengths
from .decontaminate import contamination
from .embeddings import embedding_links
from .fingerprints import neighbour_fingerprints
from .html_extract import main_text
from .jaccard import jaccard_components
from .language import fit, identify
from .pii import KINDS, pseudonymise
from .ranked_search import ranked_search
from .token_counts import token_counts
from .toxicity import fit as fit_toxicity
from .toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Key of the pseudonyms unless the session sets ``spark.tabscope.pii.key``.
PII_KEY = "only for tests and checks"


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes decoded from them, as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode_ids(ids, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside ten-word windows of benchmark items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(coalesce(" + _LOWER + r", ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op4_decontamination"] = f"""
with d as (select doc_id, {_WORDS.format("text")} as w from documents),
i as (select item_id, {_WORDS.format("text")} as w from benchmark),
lengths as (select distinct least(len(w), 10) as n from i where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[p : p + n - 1], ' ') as g
       from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as p
             from (select item_id, w, least(len(w), 10) as n from i where len(w) > 0))),
dw as (select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as g
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p
             from d, lengths where len(w) >= n)),
hits as (select distinct doc_id, n, p from dw where (n, g) in (select n, g from iw)),
covered as (select doc_id, count(*) as n_hit
            from (select distinct doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id),
listed as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
           from (select distinct dw.doc_id, cast(iw.item_id as varchar) as item
                 from dw join iw on dw.n = iw.n and dw.g = iw.g) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join listed using (doc_id)
"""


@query
def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows outside fold 0 of five."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, *fit(docs, fold("doc_id", 5) != 0))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "mixture")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows outside fold 0 of five."""
    docs = table(spark, sf_dir, "documents")
    net = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity(docs, net).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk fingerprints of every document, of its edited text and their likeness."""
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


def pii_key(spark: SparkSession) -> bytes:
    return (spark.conf.get("spark.tabscope.pii.key", None) or PII_KEY).encode()


@query
def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in its text, and how many of each kind."""
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))
    counts = [F.coalesce(F.col("replaced")[k], F.lit(0)).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", "text", *counts)


@query
def op7_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from the rows outside fold 2 of seven."""
    return code_lengths(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 75 % common five-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document, by corpus-wide pair counts."""
    docs = table(spark, sf_dir, "documents")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every embedding at a cosine of 0.95 or more, and its component."""
    return embedding_links(table(spark, sf_dir, "embeddings"))


ORACLES["op12_embedding_links"] = """
with recursive e as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where isfinite(list_sum(cast(embedding as double[]))) and greatest(list_max(embedding), -list_min(embedding)) > 0),
links as (select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
          where list_cosine_similarity(a.v, b.v) >= 0.95),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
roots as (select a as vec_id, min(b) as component_id from reach group by a),
counts as (select a as vec_id, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from roots left join counts using (vec_id)
"""


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(coalesce(" + _LOWER + r", ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op11_ranked_search"] = f"""
with d as (select doc_id, {_TERMS.format("text")} as w from documents),
lengths as (select doc_id, cast(len(w) as bigint) as n from d where len(w) > 0),
totals as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from lengths),
tf as (select doc_id, t, count(*) as tf from (select doc_id, unnest(w) as t from d) group by doc_id, t),
w as (select t, cast(floor(1000 * ln(cast(2 * max(big_n) + 2 as double) / (2 * count(*) + 1))) as bigint) as w from tf, totals group by t),
i as (select distinct item_id, t from (select item_id, unnest({_TERMS.format("text")}) as t from benchmark)),
scored as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) as bigint) as score
           from i join w using (t) join tf using (t) join lengths using (doc_id), totals group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""
