"""Token counts of whole texts, in Arrow functions that return lengths only.

The tokenizer library counts each distinct piece of a step in one batch call. Pieces are cut
where white space follows something else: no pre-token spans such a place (the split pattern
matches white space only at the start of a match), so counts add up exactly, however long the
text is. Special strings hold no white space, hence stay whole inside a piece.

Null texts count as empty (0 tokens). Rows are independent: ties, repeated rows and extra
columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, STEP_BYTES, steps, texts

#: White space at which a text may be cut; anything else that any library calls white
#: space sticks to the text before it.
PIECES = re.compile(r"\s*\S+(?:[^\S \n\r\t]\s*\S*)*|\s+")


def _counter(path: str, special_tokens_hold_space: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    known: dict[str, int] = {}

    def count(texts_: list[str]) -> list[int]:
        cut = [[t] if special_tokens_hold_space else PIECES.findall(t) for t in texts_]
        missing = list({p for pieces in cut for p in pieces if p not in known})
        if len(known) + len(missing) > MEMO_ENTRIES:
            known.clear()
            missing = list({p for pieces in cut for p in pieces})
        # one library call per 256 kB of pieces
        start, size = 0, 0
        for i, piece in enumerate(missing):
            size += len(piece)
            if size >= 1 << 18 or i + 1 == len(missing):
                part = missing[start : i + 1]
                for p, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    known[p] = len(e)
                start, size = i + 1, 0
        return [sum(map(known.__getitem__, pieces)) for pieces in cut]

    return count


def token_counts(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 1024, step_bytes: int = STEP_BYTES,
) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > ``limit``)."""
    from tokenizers import Tokenizer

    added = Tokenizer.from_file(tokenizer_path).get_added_tokens_decoder().values()
    spaced = any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in added)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path, spaced)
        for step in steps(batches, "text", step_bytes):
            tokens = pa.array(counter(texts(step, "text")), pa.int64())
            yield pa.RecordBatch.from_arrays([step.column(0), step.column(2), tokens], ["id", "n_bytes", "n_tokens"])

    source = df.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    kind = source.schema["id"].dataType.simpleString()
    counted = source.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
