"""Cross-tokenizer alignment against brute force over whole texts."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from tabscope.llm.align import align, byte_side, identity, piece_side
from tabscope.llm.common import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (-1, None), (-2, ""), (-3, " "), (-4, "  a  b "), (-5, "\n x\t y\r\n"), (-6, "a\u2581b c"), (-7, "<|endoftext|> <s> </s> <0x41> <unk>"),
    (-8, "\u65e5\u672c\u8a9e \u30c6 \U0001f600 \u00e9 \ufb01"), (None, "x y"), (-9, "x y"), (-9, "x y"), (-10, "a\x00b \x1f c d   e"),
    (-11, "aaaa   aaaa\n\n\n  bbb"), (-12, " lead and trail "), (-13, "whole a\u2581b"), (-14, "much said again, " * 9000), (-15, "x" * 3000),
]


def spans(ids, side):
    out, start = [], 0
    for i in ids:
        out.append((i, start, start + len(side.bytes[i])))
        start = out[-1][2]
    return out


def brute(rows):
    a, b = byte_side(A), piece_side(B)[0]
    counts, found = Counter(), []
    for key, text in rows:
        ids = [side.encode([text])[0] if text else [] for side in (a, b)]
        if any(b"".join(side.bytes[i] for i in own) != (" " + (text or "")).encode() for side, own in zip((a, b), ids)):
            ids = [[], []]
        of_a, of_b = spans(ids[0], a), spans(ids[1], b)
        links, j = [], 0
        for x, start, end in of_a:
            while j < len(of_b) and of_b[j][2] <= start:
                j += 1
            k = j
            while k < len(of_b) and of_b[k][1] < end:
                links.append((x, of_b[k][0]))
                k += 1
        shared, groups, at = {e for _, _, e in of_a} & {e for _, _, e in of_b}, [], [0, 0]
        for end in sorted(shared):
            own = []
            for side, ids_ in enumerate((of_a, of_b)):
                start = at[side]
                while at[side] < len(ids_) and ids_[at[side]][2] <= end:
                    at[side] += 1
                own.append(",".join(str(x) for x, _, _ in ids_[start : at[side]]))
            groups.append("|".join(own))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ids[0] else ""
        counts.update(links)
        found.append((key, len(of_a), len(of_b), len(groups), links, digest))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted((str(k), na, nb, g, len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), h) for k, na, nb, g, p, h in found)


@pytest.fixture(scope="module")
def docs(spark):
    own = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    return own.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).repartition(3)


@pytest.mark.parametrize("sizes", [{}, {"block_chars": 50_000}, {"block_chunks": 200}])
def test_alignment(spark, docs, sizes):
    rows = align(docs, A, B, **sizes).collect()
    found = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.groups_sha256 for r in rows if r.doc_id in (-1, -2, -6, -13)} == {""}


def test_empty_table_and_clashing_columns(spark, docs):
    assert align(docs.limit(0), A, B).count() == 0
    odd = spark.createDataFrame([("k", "a b", 1, "x")], "name string, text string, n_a int, block string")
    (row,) = align(odd, A, B, id_col="name").collect()
    assert row.name == "k" and (row.n_a, row.n_b, row.n_links, row.n_best) == (2, 2, 2, 2)


def test_identity_map():
    a, b = byte_side(A), piece_side(B)[0]
    same = identity(a, b)
    assert len(same) == 50257 and all(a.bytes[i] == b.bytes[j] for i, j in enumerate(same) if j >= 0) and (same >= 0).sum() > 10_000
