"""Languages of a text as a mixture, fitted by expectation-maximisation.

Learning counts hashed byte n-grams of words per language over all training rows. A word's
likelihood in a language is the product of its n-gram probabilities (the geometric mean over
the orders). A document's words come from a mixture of languages: EM estimates the proportions,
first over all languages, then over the best one, the best two and so on. A larger set is taken
only while it raises the log-likelihood by more than the penalty: half the logarithm of the
number of words, plus ``margin``. The prediction is the language with the largest proportion
of the chosen set; the score is that proportion, for a set of one times the language's share of
the likelihood among all languages.

Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing
was learned. Rows with null language or text teach nothing. Ties go to the language first in
the alphabet. Rows are independent of each other; extra columns are ignored.

The model that is sent to tasks has ``buckets`` numbers for each language; more than
``max_languages`` are an error, so its size is bounded (256 languages: 128 MB).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, steps

ORDERS = (2, 3, 4)
UNKNOWN = "und"
#: ASCII letters in lower case and all bytes of other letters; the rest separates words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def gram_buckets(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of padded words: bucket, number of the word, weight by order."""
    text = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    out = []
    for order in ORDERS:
        n = len(text) - order + 1
        if n <= 0:
            continue
        acc = np.full(n, order, np.uint64)
        for i in range(order):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + text[i : i + n]
        acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        inside = word[:n] == word[order - 1 :]
        out.append(((acc >> np.uint64(40)).astype(np.int64)[inside] % buckets, word[:n][inside]))
    return np.concatenate([b for b, _ in out]), np.concatenate([w for _, w in out]), sizes - 2


def learn(df: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = 1 << 16) -> DataFrame:
    """n-gram counts over all rows: lang, bucket, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for step in steps(batches, "text"):
            words: dict[str, Counter] = {}
            for lang, text in zip(step.column(0).to_pylist(), raw_texts(step, "text")):
                words.setdefault(lang, Counter()).update(text.translate(LETTERS).split())
            for lang, counted in words.items():
                if counted:
                    bucket, word, _ = gram_buckets(list(counted), buckets)
                    weight = np.fromiter(counted.values(), np.float64, len(counted))[word]
                    totals[lang] = totals.get(lang, 0) + np.bincount(bucket, weight, buckets)
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used].astype(np.int64))],
                ["lang", "bucket", "n"],
            )

    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def model(counts: DataFrame, buckets: int = 1 << 16, max_languages: int = 256) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetic order and the log probability of each bucket in each of them."""
    langs = sorted(r.lang for r in counts.select("lang").distinct().limit(max_languages + 1).collect())
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages; the model would not be bounded")
    table = np.full((buckets, max(1, len(langs))), 0.5)
    at = {lang: i for i, lang in enumerate(langs)}
    packed = counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
    for r in packed.toLocalIterator():  # one row per language, `buckets` numbers at most
        table[np.array(r.b), at[r.lang]] += np.array(r.n)
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def _em(like: np.ndarray, count: np.ndarray, starts: np.ndarray, doc: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
    total = np.add.reduceat(count, starts)[:, None]
    for _ in range(rounds):
        part = like * share[doc]
        part *= (count / np.maximum(part.sum(1), 1e-30))[:, None]
        new = np.add.reduceat(part, starts, axis=0) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share


def mixtures(raw: list[bytes], langs: list[str], log_p: np.ndarray, margin: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and the score per text (all zero: no words)."""
    size, n_langs = len(raw), len(langs)
    share_out, score = np.zeros((size, n_langs)), np.zeros(size)
    code: dict[bytes, int] = {}
    per_doc = []
    for text in raw:
        words = text.translate(LETTERS).split()
        per_doc.append(np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words)))
    if not code or not n_langs:
        return share_out, score
    bucket, word, sizes = gram_buckets(list(code), len(log_p))
    order = np.argsort(word, kind="stable")
    firsts = np.searchsorted(word[order], np.arange(len(code)))
    per_word = np.add.reduceat(log_p[bucket[order]], firsts, axis=0).astype(np.float64) / len(ORDERS)
    doc_all = np.repeat(np.arange(size), [len(x) for x in per_doc])
    pairs, counts = np.unique(doc_all * len(code) + np.concatenate(per_doc), return_counts=True)
    docs_of, words_of = pairs // len(code), pairs % len(code)
    active, starts = np.unique(docs_of, return_index=True)
    ll = per_word[words_of]
    top = ll.max(1)
    like = np.exp(ll - top[:, None])
    count = counts.astype(np.float64)
    doc = np.searchsorted(active, docs_of)
    n_words = np.add.reduceat(count, starts)

    single = np.add.reduceat(ll * count[:, None], starts, axis=0)
    share = _em(like, count, starts, doc, np.full((len(active), n_langs), 1 / n_langs), rounds)
    first = single.argmax(1)
    ranked = share.copy()
    ranked[np.arange(len(active)), first] = 2
    order = np.argsort(-ranked, axis=1, kind="stable")
    best = np.zeros((len(active), n_langs))
    best[np.arange(len(active)), first] = 1
    best_ll = single.max(1)
    posterior = 1 / np.exp(np.minimum(single - best_ll[:, None], 0)).sum(1)
    base = np.add.reduceat(top * count, starts)
    open_ = np.arange(len(active))
    for m in range(2, n_langs + 1):
        chosen = np.zeros((len(active), n_langs))
        np.put_along_axis(chosen, order[:, :m], 1 / m, axis=1)
        rows = np.isin(doc, open_)
        sub_doc = np.searchsorted(open_, doc[rows])
        sub_starts = np.searchsorted(sub_doc, np.arange(len(open_)))
        fitted = _em(like[rows], count[rows], sub_starts, sub_doc, chosen[open_], rounds)
        mixed = (like[rows] * fitted[sub_doc]).sum(1)
        new_ll = np.add.reduceat(count[rows] * np.log(np.maximum(mixed, 1e-300)), sub_starts) + base[open_]
        better = new_ll - best_ll[open_] > 0.5 * np.log(n_words[open_]) + margin
        best[open_[better]], best_ll[open_[better]] = fitted[better], new_ll[better]
        open_ = open_[better]
        if not len(open_):
            break
    alone = (best > 0).sum(1) == 1
    share_out[active] = best
    score[active] = np.where(alone, best.max(1) * posterior, best.max(1))
    return share_out, score


#: Bytes of text whose words are weighed at a time: each distinct word of a text takes a number per language, several times.
IDENTIFY_BYTES = 1 << 20


def has_letter(text: bytes) -> bool:
    return text.translate(LETTERS, bytes(range(128, 256))).strip() != b"" or any(map(str.isalpha, text.decode()))


def identify(
    df: DataFrame, langs: list[str], log_p: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
    keep: list[str] | None = None, margin: float = 3.0, rounds: int = 20,
) -> DataFrame:
    """Per row: id, columns named in ``keep``, ``lang_pred``, ``score`` and ``mixture`` (language to proportion)."""
    shared = df.sparkSession.sparkContext.broadcast((langs, log_p))
    kept = [id_col, *(keep or [])]
    # the text goes to the workers once, also where it is kept
    names_of = ["text" if c == text_col else f"k{i}" for i, c in enumerate(kept)]
    sent = {"text": text_col, **dict(zip(names_of, kept))}
    rows = df.select(*[F.col(c).alias(n) for n, c in sent.items()])
    outgoing = [n for n in sent if n in names_of]
    fields = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in outgoing)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for step in steps(batches, "text", IDENTIFY_BYTES):
            raw = raw_texts(step, "text")
            share, score = mixtures(raw, names, table, margin, rounds)
            known = [bool(s.any()) and has_letter(t) for s, t in zip(share, raw)]
            best = share.argmax(1) if len(names) else np.zeros(len(raw), int)
            mixture = [[(names[j], float(s[j])) for j in np.flatnonzero(s)] if k else [] for s, k in zip(share, known)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[step.column(n) for n in outgoing],
                    pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                    pa.array(np.where(known, np.clip(score, 0, 1), 0.0)),
                    pa.array(mixture, pa.map_(pa.string(), pa.float64())),
                ],
                [*outgoing, "lang_pred", "score", "mixture"],
            )
        # the worker goes on to other stages
        pa.default_memory_pool().release_unused()

    found = rows.mapInArrow(predict, f"{fields}, lang_pred string, score double, mixture map<string, double>")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names_of, kept)], "lang_pred", "score", "mixture")


def fit(df: DataFrame, training: Column, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Model of the rows of ``df`` where ``training`` holds."""
    from .common import stored

    return model(stored(learn(df.where(training), lang_col, text_col)))
