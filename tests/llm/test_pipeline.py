"""The pipeline's stages, each against brute force on its own input."""

import public_tokenizers
import tiktoken
from test_overlap import brute_components, brute_hits

import __spark_entry__
import corpus_pipeline
from tabscope.llm.bpe import read_ranks
from tabscope.llm.common import stored
from tabscope.llm.pii import FIND, Pseudonyms

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    extra = [(1_000_001, None, "en", "s", None), (1_000_002, "12 -- 34 !", None, None, 1), (None, "The document without an id is kept here.", "en", None, 9), (5, "A second text of the same id, in English words and all of that.", "en", "s", 9)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stored(stage(spark, docs, SF))
        after = [tuple(r) for r in docs.collect()]
        kept[name] = before, after
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    before, after = kept["language_id"]
    gone = set(before) - set(after)
    assert {r[0] for r in gone} == {1_000_001, 1_000_002}
    before, after = kept["near_duplicates"]
    keys = list(range(len(before)))
    order = sorted(keys, key=lambda i: (before[i][0] is None, before[i][0] or 0))
    found = brute_components([(k, before[i][1]) for k, i in enumerate(order)])
    first = [before[order[int(k)]][:2] for k, _, c in found if k == c]
    assert sorted(map(str, first)) == sorted(str(r[:2]) for r in after) and len(after) < len(before)
    before, after = kept["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {k for k, _, hit, _ in brute_hits([(i, r[1]) for i, r in enumerate(before)], items) if not hit}
    assert sorted(str(before[int(k)][0]) for k in clean) == sorted(str(r[0]) for r in after) and len(after) < len(before)
    before, after = kept["personal_data"]
    own, texts = Pseudonyms(b"x"), {(r[0], r[4]): r[1] for r in after}
    assert len(before) == len(after) and all(r[4] == len(r[1]) for r in after)
    for r in before:
        for m in FIND.finditer(r[1]):
            assert own.known[m.lastgroup, m[0]] is None or not any(m[0] in t for (i, _), t in texts.items() if i == r[0])
    before, after = kept["byte_bpe"]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert sorted((str(r[0]), r[1]) for r in before) == sorted((str(r[0]), r[1]) for r in after)
    assert all(list(ids) == library.encode_ordinary(text) and n == len(ids) for _, text, ids, n in after)


def test_registered_and_empty(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        assert docs.count() == 0


def test_texts_of_one_of_several_like_languages_stay(spark):
    words = ["the cat sat on the mat", "a dog ran over the hill", "we walk home in the rain"]
    rows = [(i, f"{words[i % 3]} and {words[i // 3 % 3]}", f"l{i % 4}", "s", 1) for i in range(144)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.language_id(spark, docs, SF).count() == len(rows)
