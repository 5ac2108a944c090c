"""Toxicity by a small convolutional network over hashed word embeddings, trained in numpy.

A word's vector is the sum of three rows of a hashed table: of the word, of its first five
bytes and of its last five. Filters of several widths slide over the whole text, each keeps its
largest response, and a logistic unit weighs these. Texts of any length are scored whole, step
by step.

The network is fitted on a bounded sample of labelled rows (``sample_docs`` per class at most,
lowest hash of the id first, and ``sample_bytes`` of text per class; what does not fit is skipped,
and a class of which no text fits is an error). One fold of the sample is
left out of the fit; on it, one threshold per language is set where the rates of caught and of
wrongly flagged rows are furthest apart. The language is predicted from the words themselves
(frequencies in the sample), so neither scoring nor calibration needs a language column. Scores
are shifted by the threshold: 0.5 is the decision in every language.

Null texts count as empty; an empty text gets a score as any other. Rows with a null label or
null text aren't learned from. With no labelled rows, or of one class only, the score is the
share of that class (0 without any). Rows are independent; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, raw_texts, source, steps, stored
from .decontaminate import words_of

WIDTHS = (1, 2, 3)
#: Blanks after a text: a window that starts at the first of them holds blanks only.
PAD = max(WIDTHS)


@dataclass
class Network:
    table: np.ndarray
    filters: list[np.ndarray]  # per width: width x dimensions x filters
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    langs: list[str] = field(default_factory=list)
    lang_rows: np.ndarray | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None


def _feature(rows: int):
    def of(word: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_64_intdigest
        return h(b"w" + word) % rows, h(b"f" + word[:5]) % rows, h(b"l" + word[-5:]) % rows

    return of


class Coded:
    """Texts as numbers of distinct words, with ``PAD`` blanks (-1) after each text."""

    def __init__(self, raw: list[bytes], features: Memo) -> None:
        code: dict[bytes, int] = {}
        parts, blank = [], np.full(PAD, -1, np.int64)
        for text in raw:
            words = words_of(text)
            parts += [np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words)), blank]
        self.tokens = np.concatenate(parts) if parts else blank[:0]
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)[1::2]
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        self.features = np.array([features[w] for w in code], np.int64).reshape(len(code), 3)


def _responses(net: Network, x: np.ndarray, k: int) -> np.ndarray:
    """Filter responses at every start; the array ends in PAD blanks, so none is cut short."""
    width, n = WIDTHS[k], len(x) - WIDTHS[k] + 1
    out = x[:n] @ net.filters[k][0]
    for j in range(1, width):
        out += x[j : n + j] @ net.filters[k][j]
    return np.maximum(out + net.biases[k], 0)


def logits(net: Network, coded: Coded) -> np.ndarray:
    """Logit of each text; sums run in an order that does not depend on the other texts."""
    words = np.vstack([net.table[coded.features].sum(1), np.zeros((1, net.table.shape[1]), np.float32)])
    pooled = []
    for k, width in enumerate(WIDTHS):
        taps = [np.einsum("wd,df->wf", words, net.filters[k][j]) for j in range(width)]  # per distinct word
        n = len(coded.tokens) - width + 1
        out = taps[0][coded.tokens[:n]]
        for j in range(1, width):
            out += taps[j][coded.tokens[j : n + j]]
        # windows that would reach into the next text count as blank
        ends = np.append(coded.starts[1:], len(coded.tokens))
        for j in range(1, width):
            out[(ends - j)[ends - j < n]] = 0
        pooled.append(np.maximum(np.maximum.reduceat(out, coded.starts, axis=0) + net.biases[k], 0))
    return (np.hstack(pooled) * net.weights).sum(1) + net.bias


def languages(net: Network, coded: Coded) -> np.ndarray:
    """Number of the likeliest language of each text, by word frequencies of the sample."""
    words = np.vstack([net.lang_rows[coded.features[:, 0]], np.zeros((1, len(net.langs)), np.float32)])
    return np.add.reduceat(words[coded.tokens], coded.starts, axis=0).argmax(1)


def train(
    raw: list[bytes], labels: np.ndarray, langs: list[str | None], calibrate: np.ndarray,
    rows: int = 1 << 16, dimensions: int = 16, n_filters: int = 16, epochs: int = 6, least_steps: int = 600, batch: int = 32, rate: float = 0.08, seed: int = 7,
) -> Network:
    random = np.random.default_rng(seed)
    net = Network(
        random.normal(0, 0.1, (rows, dimensions)).astype(np.float32),
        [random.normal(0, 0.2, (w, dimensions, n_filters)).astype(np.float32) for w in WIDTHS],
        [np.zeros(n_filters, np.float32) for _ in WIDTHS],
        random.normal(0, 0.2, len(WIDTHS) * n_filters).astype(np.float32), 0.0,
    )
    if len(set(labels.tolist())) < 2:
        net.constant = float(labels[0]) if len(labels) else 0.0
        return net
    features = Memo(_feature(rows), 1 << 62)
    fitting = np.flatnonzero(~calibrate) if len(set(labels[~calibrate].tolist())) == 2 else np.arange(len(raw))
    seen = [np.full(a.shape, 1e-6, np.float32) for a in (net.table, *net.filters, *net.biases, net.weights, np.zeros(1))]

    def step(a: np.ndarray, g: np.ndarray, s: np.ndarray) -> None:
        s += g * g
        a -= (rate * g / np.sqrt(s)).astype(a.dtype)

    share = labels[fitting].mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(max(epochs, -(-least_steps * batch // len(fitting)))):
        random.shuffle(fitting)
        for at in range(0, len(fitting), batch):
            docs = fitting[at : at + batch]
            coded = Coded([raw[d] for d in docs], features)
            words = np.vstack([net.table[coded.features].sum(1), np.zeros((1, dimensions), np.float32)])
            x = words[coded.tokens]
            ends = np.append(coded.starts[1:], len(coded.tokens))
            pooled, where = [], []
            for k in range(len(WIDTHS)):
                r = _responses(net, x, k)
                best = np.array([a + r[a : b - WIDTHS[k] + 1].argmax(0) for a, b in zip(coded.starts, ends)])
                where.append(best)
                pooled.append(np.take_along_axis(r, best, 0))
            h = np.hstack(pooled)
            p = 1 / (1 + np.exp(-np.clip(h @ net.weights + net.bias, -30, 30)))
            dz = ((p - labels[docs]) * weight[docs] / len(docs)).astype(np.float32)
            dh = dz[:, None] * net.weights * (h > 0)
            g_words = np.zeros_like(words)
            for k, width in enumerate(WIDTHS):
                g = dh[:, k * n_filters : (k + 1) * n_filters]
                grad = np.empty_like(net.filters[k])
                for j in range(width):
                    there = where[k] + j
                    grad[j] = np.einsum("bf,bfe->ef", g, x[there])
                    np.add.at(g_words, coded.tokens[there], g[:, :, None] * net.filters[k][j].T[None])
                step(net.filters[k], grad, seen[1 + k])
                step(net.biases[k], g.sum(0), seen[1 + len(WIDTHS) + k])
            touched = np.flatnonzero(np.abs(g_words[:-1]).sum(1))
            if len(touched):
                ids = coded.features[touched].ravel()
                unique, inverse = np.unique(ids, return_inverse=True)
                g_table = np.zeros((len(unique), dimensions), np.float32)
                np.add.at(g_table, inverse, np.repeat(g_words[touched], 3, axis=0))
                own = seen[0][unique] + g_table * g_table
                seen[0][unique] = own
                net.table[unique] -= rate * g_table / np.sqrt(own)
            step(net.weights, h.T @ dz, seen[-2])
            seen[-1] += dz.sum() ** 2
            net.bias -= float(rate * dz.sum() / np.sqrt(seen[-1][0]))
    _calibrate(net, raw, labels, langs, calibrate, features)
    return net


def _calibrate(net: Network, raw, labels, langs, calibrate, features) -> None:
    net.langs = sorted({x for x in langs if x is not None}) or ["und"]
    counts = np.full((len(net.table), len(net.langs)), 0.1)
    z, predicted = np.empty(len(raw)), np.empty(len(raw), int)
    parts = [range(a, min(a + 256, len(raw))) for a in range(0, len(raw), 256)]
    coded = []
    for part in parts:
        coded.append(c := Coded([raw[i] for i in part], features))
        z[part.start : part.stop] = logits(net, c)
        ends = np.append(c.starts[1:], len(c.tokens)) - PAD
        for i, a, b in zip(part, c.starts, ends):
            if langs[i] is not None:
                np.add.at(counts[:, net.langs.index(langs[i])], c.features[c.tokens[a:b], 0], 1)
    net.lang_rows = np.log(counts / counts.sum(0)).astype(np.float32)
    for part, c in zip(parts, coded):
        predicted[part.start : part.stop] = languages(net, c)
    use = calibrate if len(set(labels[calibrate].tolist())) == 2 else np.ones(len(raw), bool)
    overall = _threshold(z[use], labels[use])
    for i, lang in enumerate(net.langs):
        own = use & (predicted == i)
        both = min((labels[own] == 1).sum(), (labels[own] == 0).sum())
        net.thresholds[lang] = _threshold(z[own], labels[own]) if both >= 5 else overall


def _threshold(z: np.ndarray, labels: np.ndarray) -> float:
    """Middle of the range where caught and wrongly flagged shares differ most."""
    order = np.argsort(z, kind="stable")
    z, labels = z[order], labels[order]
    caught = 1 - np.concatenate([[0], np.cumsum(labels == 1)]) / max(1, (labels == 1).sum())
    wrong = 1 - np.concatenate([[0], np.cumsum(labels == 0)]) / max(1, (labels == 0).sum())
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    gain = caught - wrong
    good = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((edges[good[0]] + edges[good[-1]]) / 2)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, training: Column, id_col: str, text_col: str, label_col: str, lang_col: str,
    sample_docs: int, sample_bytes: int,
) -> list:
    """Per class, at most ``sample_docs`` ids and ``sample_bytes`` of whole texts, in the order of a
    hash of the id. An id whose texts do not fit is skipped, and the next ones are tried."""
    marked = labels.where(training).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).distinct()
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = rows.select("id", F.octet_length("text").cast("long").alias("size")).groupBy("id").agg(F.sum("size").alias("size")).join(marked, "id")
    # read up to four times below, without the texts
    sizes = stored(sizes)
    chosen = []
    for y in (0, 1):
        own = sizes.where(F.col("y") == y)
        total, some = 0, False
        # bounded by the parameter
        for r in own.where(F.col("size") <= sample_bytes).orderBy(F.xxhash64("id"), "id").limit(sample_docs).collect():
            some = True
            if total + r.size <= sample_bytes:
                total += r.size
                chosen.append((r.id, r.y))
        if not some and own.limit(1).count():
            raise ValueError(f"each text of class {y} has more than sample_bytes = {sample_bytes} bytes")
    # the sample's size is bounded by the parameters
    picked = docs.sparkSession.createDataFrame(chosen, marked.schema)
    return rows.join(F.broadcast(picked), "id").orderBy(F.xxhash64("id"), "id", "text", "y").collect()


def fit(
    docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", lang_col: str = "lang", sample_docs: int = 2500, sample_bytes: int = 32 << 20,
) -> Network:
    """Network of a labelled sample; one row in five (by a hash of the id) only calibrates."""
    rows = labelled_sample(docs, labels, training, id_col, text_col, label_col, lang_col, sample_docs, sample_bytes)
    raw = [r.text.encode() for r in rows]
    y = np.array([r.y for r in rows], np.float32)
    aside = np.array([xxhash.xxh3_64_intdigest(repr(r.id).encode(), 5) % 5 == 0 for r in rows], bool)
    return train(raw, y, [r.lang for r in rows], aside)


def toxicity(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    rows, kind = source(df, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        features = Memo(_feature(len(own.table)))
        for step in steps(batches, "text"):
            if own.constant is not None:
                out = np.full(step.num_rows, own.constant)
            else:
                coded = Coded(raw_texts(step, "text"), features)
                shift = np.array([own.thresholds[lang] for lang in own.langs])[languages(own, coded)]
                out = 1 / (1 + np.exp(-np.clip(logits(own, coded) - shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(out.astype(np.float64))], ["id", "score"])

    return rows.mapInArrow(score, f"id {kind}, score double").withColumnRenamed("id", id_col)
