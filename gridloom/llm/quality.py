"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte has a learned vector; learned
filters run over the chunk; each filter's largest activation in the chunk is kept (max pooling). The pooled
activations are averaged over a document's chunks and combined by a small dense layer into one probability, so a
document is judged by all of its chunks alike, however long it is. Learning draws documents of both classes at fixed
shares (a third of label 0), so a score is the probability at those shares.

Defined results: null and empty text are one chunk of padding and get the score learned for that. Repeated rows get
equal scores. op1's held_out is null for a null doc_id. Columns of the input that have an output's name are replaced; all others pass through. Without labels of
both classes, every score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import adam, grouped, labelled_texts, texts_of, tune

CHUNK, STRIDE = 512, 448
WIDTH, HOP, EMBED, FILTERS, HIDDEN = 8, 2, 4, 40, 16
PAD = 256
#: At most so many labelled documents are learned from, by all chunks of their whole texts.
SAMPLE = 3000
#: Chunks of a document that one step of learning reads, drawn anew in each step from all of its chunks.
DRAWN = 4


@dataclass
class QualityModel:
    prior: float
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.p:
            return np.full(len(texts), self.prior)
        out = [self._some(texts[a:b]) for a, b in grouped(texts, 1 << 18)]
        return np.concatenate(out) if out else np.zeros(0)

    def _some(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros((len(texts), FILTERS), np.float32)
        for i, t in enumerate(texts):
            if len(t) > 1 << 19:  # a very long text alone, in runs of chunks
                n, parts = 0, np.zeros(FILTERS, np.float64)
                for run in _runs(t):
                    pooled = _pool(self.p, run)
                    parts += pooled.sum(0)
                    n += len(pooled)
                total[i] = parts / n
        short = [i for i, t in enumerate(texts) if len(t) <= 1 << 19]
        if short:
            chunks = [_chunks(texts[i]) for i in short]
            counts = np.array([len(c) for c in chunks])
            pooled = _pool(self.p, np.concatenate(chunks))
            total[short] = np.add.reduceat(pooled, np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0) / counts[:, None]
        hidden = np.maximum(total @ self.p["w1"] + self.p["b1"], 0)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.p["w2"] + self.p["b2"])[:, 0].astype(np.float64), -30, 30)))


def _chunks(t: bytes) -> np.ndarray:
    """The overlapping chunks of a text, padded: one row each."""
    n = max(1, -(-(len(t) - CHUNK) // STRIDE) + 1)
    data = np.full((n - 1) * STRIDE + CHUNK, PAD, np.int16)
    data[: len(t)] = np.frombuffer(t, np.uint8)
    return np.lib.stride_tricks.as_strided(data, (n, CHUNK), (STRIDE * 2, 2))


def _runs(t: bytes) -> Iterator[np.ndarray]:
    step = STRIDE * 512
    for at in range(0, max(1, len(t) - (CHUNK - STRIDE)), step):
        yield _chunks(t[at : at + step + CHUNK - STRIDE])


def _patches(p: dict[str, np.ndarray], chunks: np.ndarray) -> np.ndarray:
    x = p["emb"][chunks]  # chunk, byte, EMBED
    n, steps = len(chunks), (CHUNK - WIDTH) // HOP + 1
    a, b, c = x.strides
    return np.lib.stride_tricks.as_strided(x, (n, steps, WIDTH * EMBED), (a, b * HOP, c)).reshape(n * steps, WIDTH * EMBED)


def _pool(p: dict[str, np.ndarray], chunks: np.ndarray) -> np.ndarray:
    z = _patches(p, chunks) @ p["conv"]
    return np.maximum(z.reshape(len(chunks), -1, FILTERS).max(axis=1) + p["cb"], 0)


def _cut(unit: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One chunk of a document, cut to a random length: short texts are learned too."""
    chunk = unit[rng.integers(len(unit))][None].copy()
    chunk[:, int(24 * (CHUNK / 24) ** rng.random()) :] = PAD
    return chunk


def _drawn(unit: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Some of a document's chunks, each as likely as any other."""
    return unit if len(unit) <= DRAWN else unit[rng.choice(len(unit), DRAWN, replace=False)]


def train(samples: list[tuple[int, bytes]], steps: int = 900, batch: int = 48, seed: int = 7) -> QualityModel:
    """Fit the network to (label, whole text) by Adam; the same samples give the same model."""
    y = np.array([s[0] for s in samples], np.float32)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    if len(set(y.tolist())) < 2:
        return QualityModel(prior)
    rng = np.random.default_rng(seed)
    units = [_chunks(text) for _, text in samples]
    p = {
        "emb": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
        "conv": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "cb": np.zeros(FILTERS, np.float32),
        "w1": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32),
        "b1": np.zeros(HIDDEN, np.float32),
        "w2": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)).astype(np.float32),
        "b2": np.zeros(1, np.float32),
    }
    p["emb"][PAD] = 0
    step, sides = adam(p, 0.01), [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    width = (CHUNK - WIDTH) // HOP + 1
    for k in range(steps):
        pick = np.concatenate([rng.choice(sides[0], batch // 3), rng.choice(sides[1], batch - batch // 3)])
        some = [_drawn(units[i], rng) if rng.random() < 0.6 else _cut(units[i], rng) for i in pick]
        counts = np.array([len(x) for x in some])
        chunks, owner = np.concatenate(some), np.repeat(np.arange(len(pick)), counts)
        cols = _patches(p, chunks)
        z = (cols @ p["conv"]).reshape(len(chunks), width, FILTERS)
        at = z.argmax(axis=1)
        top = np.take_along_axis(z, at[:, None, :], 1)[:, 0] + p["cb"]
        pooled = np.maximum(top, 0)
        doc = np.zeros((len(pick), FILTERS), np.float32)
        np.add.at(doc, owner, pooled)
        doc /= counts[:, None]
        h = np.maximum(doc @ p["w1"] + p["b1"], 0)
        prob = 1 / (1 + np.exp(-np.clip((h @ p["w2"] + p["b2"])[:, 0], -30, 30)))
        d = ((prob - y[pick]) / len(pick)).astype(np.float32)[:, None]
        g = {"w2": h.T @ d, "b2": d.sum(0)}
        dh = (d @ p["w2"].T) * (h > 0)
        g |= {"w1": doc.T @ dh, "b1": dh.sum(0)}
        dp = ((dh @ p["w1"].T) / counts[:, None])[owner] * (top > 0)
        g["cb"] = dp.sum(0)
        rows = (np.arange(len(chunks))[:, None] * width + at).ravel()  # the winning patch of each chunk and filter
        won = cols[rows].reshape(len(chunks), FILTERS, -1)
        g["conv"] = np.einsum("cf,cfk->kf", dp, won)
        back = (dp[:, :, None] * p["conv"].T[None]).reshape(-1, WIDTH, EMBED)
        bytes_at = np.repeat(np.arange(len(chunks)), FILTERS)[:, None], at.ravel()[:, None] * HOP + np.arange(WIDTH)
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], chunks[bytes_at], back)
        g["emb"][PAD] = 0
        step(g, 1.0 if k < steps * 0.6 else 0.3)
    return QualityModel(prior, p)


def fit_quality(docs: DataFrame, labels: DataFrame, keep: F.Column | None = None, limit: int = SAMPLE) -> QualityModel:
    """Learn from a bounded, documented sample: whole texts of at most limit labelled documents, and SAMPLE_BYTES of them."""
    return train(labelled_texts(docs, labels, "quality", F.lit(True) if keep is None else keep, limit))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of good quality of every whole text."""
    tune(docs.sparkSession)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(model.score(texts_of(column)), pa.float64())

    return docs.withColumn(out, score(F.col(text)))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit_quality(docs.select("doc_id", "text"), labels, fold != 1)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
