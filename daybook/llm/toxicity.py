"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling; trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import in_fold, portions, whole_text

#: Hash buckets of words; embedding size; filter widths and filters of each; labelled rows used at most.
BUCKETS, DIM, WIDTHS, FILTERS, FIT_ROWS = 1 << 21, 12, (1, 2, 3), 12, 6000
#: Bytes of a word's beginning that has an embedding too; toxic rows of a language that weigh as much as all languages together in its threshold.
STEM, SHRINK = 4, 20
#: ASCII letters and digits stay, in lower case; other ASCII is a separator; bytes beyond ASCII stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass
class Network:
    rows: np.ndarray  # bucket -> row of the embeddings; 0 for a bucket that training hasn't seen often enough
    embed: np.ndarray
    filters: dict[tuple[int, int], np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def buckets_of(text: bytes) -> np.ndarray:
    """Two rows: the bucket of each word, and that of its beginning, which forms of one stem share."""
    words = text.translate(WORD_BYTES).split()
    both = np.empty((2, len(words)), np.uint32)
    both[0] = np.fromiter(map(crc32, words), np.uint32, len(words))
    both[1] = np.fromiter((crc32(w[:STEM], 1) for w in words), np.uint32, len(words))
    return both & (BUCKETS - 1)


def _laid_out(parts: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of all texts in one array, blanks after each text so that no filter that begins in one reaches the next; of each text where
    filters begin first, and where no more. A text without words is one blank."""
    sizes = np.fromiter((max(1, p.shape[1]) for p in parts), np.int64, len(parts))
    starts = np.cumsum(sizes + max(WIDTHS) - 1) - sizes - max(WIDTHS) + 1
    ids = np.zeros((2, int(starts[-1] + sizes[-1]) + max(WIDTHS) - 1 if len(parts) else 0), np.int32)
    for s, p in zip(starts, parts, strict=True):
        ids[:, s : s + p.shape[1]] = rows[p]
    return ids, starts, starts + sizes


def _pooled(net: Network, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """Largest value of each filter over each text. tables: embeddings times the filter's slice, so that a word is one lookup."""
    n = ids.shape[1] - max(WIDTHS) + 1
    out = np.empty((len(starts), len(WIDTHS) * FILTERS), np.float32)
    bounds = np.stack([starts, ends], axis=1).ravel()[:-1]
    for k, width in enumerate(WIDTHS):
        h = tables[width, 0][ids[0, :n]]
        h += tables[width, 0][ids[1, :n]]
        for o in range(1, width):
            h += tables[width, o][ids[0, o : o + n]]
            h += tables[width, o][ids[1, o : o + n]]
        out[:, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(h, bounds)[::2]
    return np.maximum(out + net.bias, 0)


def _tables(net: Network) -> dict[tuple[int, int], np.ndarray]:
    return {k: net.embed @ w for k, w in net.filters.items()}


def _logits(net: Network, parts: list[np.ndarray], tables: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    ids, starts, ends = _laid_out(parts, net.rows)
    return _pooled(net, ids, starts, ends, tables) @ net.out[:-1] + net.out[-1]


def train(texts: list[bytes], labels: np.ndarray, langs: list[str], epochs: int = 10, seed: int = 7, rate: float = 0.1) -> Network:
    return fitted([buckets_of(t) for t in texts], labels, langs, epochs, seed, rate)


def fitted(parts: list[np.ndarray], labels: np.ndarray, langs: list[str], epochs: int = 10, seed: int = 7, rate: float = 0.1) -> Network:
    """Fitted on four fifths of the rows, given as buckets_of() their whole texts; the rest sets the shift that puts the best threshold at a score of one half, and each language's threshold."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    seen = np.bincount(np.concatenate([np.unique(p) for p in parts if p.size] or [np.zeros(0, np.int64)]).astype(np.int64), minlength=BUCKETS)
    often = np.flatnonzero(seen >= 3)
    rows = np.zeros(BUCKETS, np.int32)
    rows[often] = np.arange(1, len(often) + 1)
    embed = (rng.standard_normal((len(often) + 1, DIM)) * 0.1).astype(np.float32)
    embed[0] = 0
    net = Network(rows, embed, {(w, o): (rng.standard_normal((DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS for o in range(w)}, np.zeros(len(WIDTHS) * FILTERS, np.float32), (rng.standard_normal(len(WIDTHS) * FILTERS + 1) * 0.1).astype(np.float32))
    net.out[-1] = -1
    if not len(parts) or labels.min() == labels.max():
        net.out[:] = 0
        net.out[-1] = 4.0 if len(labels) and labels[0] else -4.0
        return net
    held = np.arange(len(parts)) % 5 == 4
    fit, check = np.flatnonzero(~held), np.flatnonzero(held)
    grown: dict[object, np.ndarray] = {}

    def step(key: object, value: np.ndarray, g: np.ndarray) -> None:
        a = grown.setdefault(key, np.full_like(value, 1e-4))
        a += g * g
        value -= rate * g / np.sqrt(a)

    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            ids, starts, ends = _laid_out([parts[i] for i in batch], net.rows)
            tables = {k: None for k in net.filters}
            n, x = ids.shape[1] - max(WIDTHS) + 1, net.embed[ids[0]] + net.embed[ids[1]]
            places = np.empty((len(batch), len(net.bias)), np.int64)
            top = np.empty((len(batch), len(net.bias)), np.float32)
            for k, width in enumerate(WIDTHS):
                h = x[:n] @ net.filters[width, 0]
                for o in range(1, width):
                    h += x[o : o + n] @ net.filters[width, o]
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                for r, (s, e) in enumerate(zip(starts, ends, strict=True)):
                    places[r, cols] = s + h[s:e].argmax(0)
                top[:, cols] = np.take_along_axis(h, places[:, cols], 0)
            pooled = np.maximum(top + net.bias, 0)
            p = 1 / (1 + np.exp(-(pooled @ net.out[:-1] + net.out[-1])))
            d = (p - labels[batch]) / len(batch)
            dh = d[:, None] * net.out[:-1] * (pooled > 0)
            step("out", net.out, np.append(pooled.T @ d, d.sum()).astype(np.float32))
            step("bias", net.bias, dh.sum(0))
            ge_ids, ge = [], []
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                for o in range(width):
                    at = places[:, cols] + o
                    g = dh[:, cols]
                    back = (g[:, :, None] * net.filters[width, o].T[None]).reshape(-1, DIM)
                    ge_ids += [ids[0][at].ravel(), ids[1][at].ravel()]
                    ge += [back, back]
                    tables[width, o] = np.einsum("bfd,bf->df", x[at], g)
            for key, g in tables.items():
                step(key, net.filters[key], g)
            touched, place = np.unique(np.concatenate(ge_ids), return_inverse=True)
            total = np.zeros((len(touched), DIM), np.float32)
            np.add.at(total, place, np.concatenate(ge))
            total[touched == 0] = 0
            a = grown.setdefault("embed", np.full_like(net.embed, 1e-4))
            a[touched] += total * total
            net.embed[touched] -= rate * total / np.sqrt(a[touched])
    # thresholds: of the rows that were not fitted; a language's own counts the more, the more toxic rows of it there are
    z = _logits(net, [parts[i] for i in check], _tables(net))
    net.shift = best_threshold(z, labels[check])
    own = np.array([langs[i] or "" for i in check])
    for lang in sorted(set(own)):
        mine = own == lang
        n = float(labels[check][mine].sum())
        apart = best_threshold(z[mine], labels[check][mine]) - net.shift if n else 0.0
        net.thresholds[lang] = float(1 / (1 + np.exp(-apart * n / (n + SHRINK))))
    return net


def best_threshold(z: np.ndarray, labels: np.ndarray) -> float:
    """The logit with the best F1, in the middle of the gap it may lie in."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(labels[order])
    if not len(z) or hits[-1] == 0:
        return float(z.max() + 1) if len(z) else 0.0
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + hits[-1])
    k = int(f1.argmax())
    return float((z[order[k]] + (z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1)) / 2)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fold: int = 0) -> DataFrame:
    """One row per row of docs with a doc_id: doc_id, held_out, score, predicted, threshold, flagged.

    The network learns from labelled rows (labels: doc_id, toxic) outside the held-out fold, the `fit_rows` of them with the smallest
    hash of doc_id: that bound is the only sample, and the network's size is fixed by it. Scores take the text alone. threshold is
    calibrated for the value of lang on rows kept out of the fit: it lies between the best one for the language and 0.5, the best one for all, and the nearer to its
    own the more toxic rows it has (0.5 for a language without any); flagged is score >= threshold, predicted is score >= 0.5.

    A null text counts as empty and is scored as such; a null lang is a language of its own. Null labels are ignored; a doc_id with both labels gives two rows to learn
    from, and of rows that repeat a doc_id the smallest text is learnt from; each is scored on its own. Texts are learnt from and scored whole, some hundred bytes a
    word; of the sample the driver gets eight bytes a word, made by the tasks that read it.
    Without labels of both kinds every score is the same. Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text"), lang.alias("lang"))
    sample = labels.select(F.col("doc_id").cast("long").alias("fit_id"), F.col("toxic").cast("int").alias("toxic")).filter("fit_id IS NOT NULL AND toxic IS NOT NULL").distinct()
    sample = sample.filter(~in_fold(F.col("fit_id"), fold)).orderBy(F.xxhash64("fit_id"), "fit_id", "toxic").limit(fit_rows)
    chosen = rows.join(F.broadcast(sample), rows.doc_id == F.col("fit_id")).groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("x"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [buckets_of(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), batch.column(3)], ["doc_id", "toxic", "ids", "lang"])

    fit = chosen.select("doc_id", "toxic", "x.*").mapInArrow(hashed, "doc_id long, toxic int, ids binary, lang string").toPandas()
    fit = fit.sort_values(["doc_id", "toxic"], kind="stable")
    parts = [np.frombuffer(ids, np.uint32).reshape(2, -1) for ids in fit["ids"]]
    net = spark.sparkContext.broadcast(fitted(parts, fit["toxic"].to_numpy(), list(fit["lang"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        tables = _tables(model)
        for batch in batches:
            for part in portions(batch, 1, 250_000):
                z = _logits(model, [buckets_of(t.as_py()) for t in part.column(1)], tables) - model.shift
                score = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -50, 50)))
                limit = np.array([model.thresholds.get(x or "", 0.5) for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(limit), pa.array(score >= limit)], ["doc_id", "score", "predicted", "threshold", "flagged"])

    found = rows.mapInArrow(run, "doc_id long, score double, predicted int, threshold double, flagged boolean")
    return found.select("doc_id", in_fold(F.col("doc_id"), fold).alias("held_out"), "score", "predicted", "threshold", "flagged")
