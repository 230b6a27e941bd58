"""Language identification with a byte convolutional network trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length. Each byte is embedded; filters of
several widths slide over a window, their responses pass a rectifier and max pooling over the
window, and a softmax layer gives language probabilities. A text's probabilities are the mean
over all its windows, weighted by the bytes they hold, so whole texts count.

The network is trained on the driver from a bounded sample of labelled rows (`TRAIN_ROWS`
documents and `LEAST_PER_LANGUAGE` of each language, `WINDOWS_PER_ROW` windows of each, spread over
the whole text and cut by the executors); nothing else about the corpus is gathered. Prediction is a narrow Arrow-batch map over every row, without a shuffle.

Defined cases: a null text, or one without a letter (Unicode category L), is `und` with score 0; of
languages with equal probabilities the first in order is taken; texts of any length are scored whole; null labels are never
learnt; rows that repeat a doc_id are predicted apart; an empty table, or one without a labelled
row, gives `und` everywhere; rows with a null doc_id are predicted, never learnt; other columns are dropped by `predict` unless named in `keep`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import map_batches
from lodegraph.runtime import broadcast_if_small, checkpoint

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 6
#: The bounded sample that the network is trained on: rows, and windows of each.
TRAIN_ROWS = 3000
WINDOWS_PER_ROW = 3
#: Rows of a language that are learnt, if it has them, whatever its share.
LEAST_PER_LANGUAGE = 50
EPOCHS = 12
UNKNOWN = "und"
PAD = 256



def has_letter(text: str) -> bool:
    """Whether a text holds a letter; digits, fractions and circled numbers aren't letters."""
    return any(map(str.isalpha, text))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """The fold of a row; fold 0 is held out of training."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def windows(data: bytes, length: int = WINDOW) -> np.ndarray:
    """All windows of a text as a matrix of byte values, the last one padded."""
    n = max(1, -(-len(data) // length))
    out = np.full(n * length, PAD, dtype=np.int16)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, length)


@dataclass
class ByteConvNet:
    """Weights: byte embedding, filters (padded to the widest), filter bias, output layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(languages: list[str], seed: int = 0) -> ByteConvNet:
        rng, widest, n = np.random.default_rng(seed), max(WIDTHS), len(WIDTHS) * FILTERS
        filters = rng.normal(0, 0.3, (widest * EMBEDDING, n)).astype(np.float32)
        embedding = rng.normal(0, 0.5, (PAD + 1, EMBEDDING)).astype(np.float32)
        embedding[PAD] = 0
        net = ByteConvNet(languages, embedding, filters, np.zeros(n, np.float32), rng.normal(0, 0.1, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
        net.filters *= net.mask()
        return net

    @staticmethod
    def mask() -> np.ndarray:
        """Ones where a filter of its width has weights."""
        widest = max(WIDTHS)
        return np.concatenate([np.repeat((np.arange(widest * EMBEDDING) < w * EMBEDDING)[:, None], FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)

    def patches(self, x: np.ndarray) -> np.ndarray:
        """Each position's bytes, embedded, up to the widest filter: (windows, positions, widest * EMBEDDING)."""
        widest = max(WIDTHS)
        e = self.embedding[x].reshape(len(x), -1)
        view = np.lib.stride_tricks.sliding_window_view(e, widest * EMBEDDING, axis=1)[:, ::EMBEDDING]
        return np.ascontiguousarray(view)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self.patches(x)
        r = (p.reshape(-1, p.shape[2]) @ self.filters).reshape(p.shape[0], p.shape[1], -1)
        at = r.argmax(1)
        return np.maximum(np.take_along_axis(r, at[:, None], 1)[:, 0] + self.bias, 0), at, p

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p = self.patches(x)
        r = (p.reshape(-1, p.shape[2]) @ self.filters).reshape(p.shape[0], p.shape[1], -1).max(1)
        z = np.maximum(r + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 4e-3, seed: int = 0) -> None:
        """Adam on the cross-entropy of windows."""
        rng, mask, step, widest = np.random.default_rng(seed), self.mask(), 0, max(WIDTHS)
        names = ("embedding", "filters", "bias", "out", "out_bias")
        first, second = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for low in range(0, len(x), batch):
                rows = order[low : low + batch]
                xb, n = x[rows], len(rows)
                h, at, p = self.pooled(xb)
                z = h @ self.out + self.out_bias
                z = np.exp(z - z.max(1, keepdims=True))
                dz = z / z.sum(1, keepdims=True)
                dz[np.arange(n), y[rows]] -= 1
                dz /= n
                dh = (dz @ self.out.T) * (h > 0)
                best = p[np.arange(n)[:, None], at]  # the patch each filter answered to
                grads = {"out": h.T @ dz, "out_bias": dz.sum(0), "bias": dh.sum(0), "filters": np.einsum("nf,nfk->kf", dh, best, optimize=True) * mask}
                dpatch = (dh[:, :, None] * self.filters.T[None]).reshape(-1, EMBEDDING)
                held = xb[np.arange(n)[:, None, None], at[:, :, None] + np.arange(widest)].reshape(-1)
                grads["embedding"] = np.zeros_like(self.embedding)
                np.add.at(grads["embedding"], held, dpatch)
                grads["embedding"][PAD] = 0
                step += 1
                for k in names:
                    g = grads[k]
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    getattr(self, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, seed: int = 0) -> ByteConvNet | None:
    """Fit on about `rows` labelled documents outside fold 0, at least `LEAST_PER_LANGUAGE` of each language that has them.

    Rows are drawn by a hash of the row against a rate per language, set by a count of its labelled
    rows; of those drawn, the first of each language by that hash stay. So a rare language is learnt
    however many rows others have, and tasks send a bounded number of texts per language.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0)).select("text", "lang", "doc_id")
    counts = checkpoint(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).head()[0] or 0
    some = known
    if total > rows:
        quota = F.greatest(F.lit(LEAST_PER_LANGUAGE), F.ceil(0.95 * rows / total * F.col("n")))
        quotas = counts.select(F.col("lang").alias("_lang"), quota.alias("quota"), (2 * quota / F.col("n") * (1 << 40)).alias("below"))
        drawn = known.withColumn("drawn", F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 40)))
        drawn = drawn.join(broadcast_if_small(quotas), F.col("lang") == F.col("_lang")).where("drawn < below")
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "doc_id", "text"))
        some = drawn.withColumn("rank", rank).where("rank <= quota")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, parts = [], []
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if has_letter(text):
                w = windows(text.encode("utf-8", "replace"))
                for k in np.unique(np.linspace(0, len(w) - 1, WINDOWS_PER_ROW).astype(int)):
                    langs.append(lang)
                    parts.append(w[k].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["lang", "part"])

    # At most WINDOWS_PER_ROW windows of `rows` and of LEAST_PER_LANGUAGE documents of each language.
    sample = sorted((r["lang"], bytes(r["part"])) for r in map_batches(some.select("text", "lang"), cut, "lang string, part binary").collect())
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    x, ys = np.frombuffer(b"".join(part for _, part in sample), dtype=np.int16).reshape(len(sample), WINDOW), [languages.index(lang) for lang, _ in sample]
    net = ByteConvNet.fresh(languages, seed)
    net.train(x, np.asarray(ys), seed=seed)
    return net


def predict(docs: DataFrame, net: ByteConvNet | None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rows (*keep, lang_pred, score) for every row of `docs`; only the text decides."""
    kept = [c for c in keep if c not in ("lang_pred", "score")]

    def guess(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        held = [(i, t.encode("utf-8", "replace")) for i, t in enumerate(texts) if net is not None and t is not None and has_letter(t)]
        sums, sizes = np.zeros((len(texts), len(net.languages) if net else 1)), np.zeros(len(texts))
        cut = [(i, windows(b)) for i, b in held]
        if cut:
            owner = np.repeat([i for i, _ in cut], [len(w) for _, w in cut])
            x = np.concatenate([w for _, w in cut])
            weight = (x != PAD).sum(1).astype(float)
            for low in range(0, len(x), 128):
                part = slice(low, low + 128)
                np.add.at(sums, owner[part], net.probabilities(x[part]) * weight[part, None])
            np.add.at(sizes, owner, weight)
        for i, _ in held:
            p = sums[i] / sizes[i]
            lang[i], score[i] = net.languages[int(p.argmax())], float(min(1.0, p.max()))
        columns = [batch.column(c) for c in kept] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "lang_pred string, score double"])
    return map_batches(docs.select(*dict.fromkeys([*kept, "text"])), guess, schema)


def identify(docs: DataFrame, rows: int = TRAIN_ROWS, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    return predict(docs, train(docs, rows), keep)
