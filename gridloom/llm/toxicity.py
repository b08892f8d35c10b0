"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is a sequence of words (runs of ASCII letters and digits and of bytes from 128, with A-Z lowered). A word's input
is a learned vector of the word (one shared vector for words outside the learned vocabulary) beside the mean of learned
vectors of its character trigrams (of bytes, with the word's ends marked). Gated recurrent units read each window of
words in both directions, attention pools the states, and a logistic layer scores the window. Overlapping windows
cover the whole text, counted from its start; a text's score is that of its worst window. A text is read in pieces that
end between words, with the words that the next window needs carried over, so a score doesn't depend on the pieces. A run
of more than MOST_WORD bytes without an end is read as words of that length.

Learning draws documents of both classes at equal shares, so a score is the probability at those shares.

Defined results: null, empty and word-less texts are one empty window and get the score of that. Repeated rows get
equal scores. op8's held_out is null for a null doc_id. Columns of the input that have an output's name are replaced; all others pass through. Without labels of
both classes, every score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import _INV, _POW, PIECE_BYTES, adam, grouped, labelled_texts, lower_table, mix64, texts_of, tune

WINDOW, STEP = 32, 24
WORD_DIM, CHAR_DIM, STATE, ATTEND = 12, 8, 12, 8
TRIGRAMS = 1 << 13
#: At most so many labelled documents are learned from, by all windows of their whole texts. A word gets a vector of its own
#: when LEAST_DOCS of them have it; all others share one. SAMPLE and common.SAMPLE_BYTES bound the vocabulary.
SAMPLE, LEAST_DOCS = 4000, 2
#: Windows of a document that one step of learning goes back through: its worst ones of all, at that step; for documents of
#: more than MANY windows, at the epoch's first step with them.
WORST, MANY = 24, 512
#: Bytes that are read at once, and of the longest word.
PIECE, MOST_WORD = 1 << 17, 1 << 15

_VALUES = lower_table(bytes(b for b in range(128) if not chr(b).isalnum()), True)
_BYTES = _VALUES.astype(np.int64)  # 0 outside words


def read_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, words before each text, bytes' trigram buckets in word order, and the first of them of each word."""
    joined = b"  ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    inside = _BYTES[data] != 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    if len(first) and (last - first).max() > MOST_WORD:
        per = -(-(last - first) // MOST_WORD)
        owner = np.repeat(np.arange(len(first)), per)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        first, last = first[owner] + part * MOST_WORD, np.minimum(first[owner] + (part + 1) * MOST_WORD, last[owner])
    h = np.concatenate([_hashes(data[a:b], first[i:j] - a, last[i:j] - a) for a, b, i, j in _spans(first, last)]) if len(first) else np.zeros(0, np.uint64)
    starts = np.cumsum([0] + [len(t) + 2 for t in texts])
    before = np.searchsorted(first, starts)
    v = np.concatenate(([0], _BYTES[data], [0]))
    a, b, c = v[:-2], v[1:-1], v[2:]
    if len(first):  # a split word's parts end like words
        a, c = a.copy(), c.copy()
        a[first], c[last - 1] = 0, 0
    tri = ((a * 31 + b) * 127 + c) * 2654435761 >> 9 & (TRIGRAMS - 1)
    sizes = last - first
    return h, before, tri[inside], np.cumsum(sizes) - sizes


def _spans(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of bytes, and of the words in them, of PIECE_BYTES at most."""
    i = 0
    while i < len(first):
        j = int(np.searchsorted(last, first[i] + PIECE_BYTES, "right"))
        yield int(first[i]), int(last[j - 1]), i, j
        i = j


def _hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * _POW[: len(data)], dtype=np.uint64)))
    return mix64((total[last] - total[first]) * _INV[first] + (last - first).astype(np.uint64))


@dataclass
class ToxicityModel:
    prior: float
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.p:
            return np.full(len(texts), self.prior)
        out = []
        for a, b in grouped(texts, PIECE):
            if b - a == 1 and len(texts[a]) > 2 * PIECE:
                out.append(np.array([max(x.max() for x in self.logits(texts[a]))]))
            else:
                out.append(self._some(texts[a:b]))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30))) if out else np.zeros(0)

    def _some(self, texts: list[bytes]) -> np.ndarray:
        h, before, tri, first = read_words(texts)
        x = self.inputs(h, tri, first)[0]
        at, mask, owner = windows(before)
        logit = forward(self.p, x, at, mask)["logit"]
        edges = np.flatnonzero(np.concatenate(([True], np.diff(owner) > 0)))
        return np.maximum.reduceat(logit, edges).astype(np.float64)

    def logits(self, text: bytes) -> Iterator[np.ndarray]:
        """Logits of a text's windows in order, by pieces."""
        kept: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        none = True
        for piece, end in _pieces(text):
            h, _, tri, first = read_words([piece])
            h, tri, size = (np.concatenate(x) for x in zip(kept, (h, tri, np.diff(np.append(first, len(tri)))), strict=True))
            n = len(h)
            done = max(1, -(-(n - WINDOW) // STEP) + 1) if end else max(0, (n - WINDOW) // STEP + 1)  # whole windows, or all
            if end and not none and n <= WINDOW - STEP:
                return  # the last window had these words
            if done:
                first = np.cumsum(size) - size
                at = np.arange(done)[:, None] * STEP + np.arange(WINDOW)
                mask = at < n
                x = self.inputs(h, tri, first)[0]
                yield forward(self.p, x, np.where(mask, at, -1), mask)["logit"].astype(np.float64)
                none = False
            gone = min(n, done * STEP)
            kept = (h[gone:], tri[int(size[:gone].sum()) :], size[gone:])

    def inputs(self, h: np.ndarray, tri: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word inputs with a row of zeros at the end (padding), vocabulary rows and lengths of the words."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        word = np.where(self.vocabulary[at] == h, at + 1, 0) if len(self.vocabulary) else np.zeros(len(h), np.int64)
        sizes = np.diff(np.append(first, len(tri)))
        x = np.zeros((len(h) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if len(h):
            x[:-1, :WORD_DIM] = self.p["word"][word]
            x[:-1, WORD_DIM:] = np.add.reduceat(self.p["char"][tri], first, axis=0) / np.sqrt(sizes)[:, None]
        return x, word, sizes


def _pieces(t: bytes) -> Iterator[tuple[bytes, bool]]:
    """Pieces that end between words, or between parts of a split word, and whether a piece is the last."""
    at = 0
    while at < len(t):
        end = min(at + PIECE, len(t))
        if end < len(t):
            out = np.flatnonzero(_BYTES[np.frombuffer(t, np.uint8, end - at, at)] == 0)
            end = at + (int(out[-1]) + 1 if len(out) else PIECE // MOST_WORD * MOST_WORD)
        yield t[at:end], end == len(t)
        at = end


def windows(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word positions (-1: padding), mask and owning text of overlapping windows; each text has one at least."""
    n = np.diff(before)
    per = np.maximum(1, -(-(n - WINDOW) // STEP) + 1)
    owner = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    at = k[:, None] * STEP + np.arange(WINDOW)
    mask = at < n[owner][:, None]
    return np.where(mask, before[:-1][owner][:, None] + at, -1), mask, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def forward(p: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False) -> dict:
    """Logits of windows; with keep, all that the way back needs."""
    b, t = at.shape
    hs = np.zeros((2, t, b, STATE), np.float32)
    kept = []
    m = mask.T[:, :, None].astype(np.float32)
    for d in (0, 1):
        proj = x @ p["in"][d] + p["inb"][d]
        h = np.zeros((b, STATE), np.float32)
        for s in range(t) if d == 0 else range(t - 1, -1, -1):
            a = proj[at[:, s]]
            u = h @ p["rec"][d]
            zr = _sigmoid(a[:, : 2 * STATE] + u[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            n = np.tanh(a[:, 2 * STATE :] + r * u[:, 2 * STATE :])
            new = (n + z * (h - n)) * m[s]
            if keep:
                kept.append((d, s, h, u[:, 2 * STATE :], z, r, n))
            h = hs[d, s] = new
    both = np.concatenate((hs[0], hs[1]), axis=2)  # word, window, state
    e = np.tanh(both @ p["att"])
    w = np.where(mask.T, e @ p["query"], -1e9)
    w = np.exp(w - w.max(axis=0))
    w /= w.sum(axis=0)
    c = (w[:, :, None] * both).sum(axis=0) * mask[:, :1]
    return {"logit": c @ p["out"] + p["bias"][0], "both": both, "e": e, "w": w, "c": c, "kept": kept, "m": m}


def backward(p: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, mask: np.ndarray, f: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    g = {k: np.zeros_like(p[k]) for k in ("in", "inb", "rec", "att", "query")}
    g["out"], g["bias"] = f["c"].T @ dlogit, np.array([dlogit.sum()], np.float32)
    dc = dlogit[:, None] * p["out"] * mask[:, :1]
    both, e, w = f["both"], f["e"], f["w"]
    dw = np.einsum("bs,tbs->tb", dc, both)
    dboth = w[:, :, None] * dc
    de = w * (dw - (w * dw).sum(axis=0))
    g["query"] = np.einsum("tb,tba->a", de, e)
    dpre = de[:, :, None] * p["query"] * (1 - e * e)
    g["att"] = np.einsum("tbs,tba->sa", both, dpre)
    dboth = dboth + dpre @ p["att"].T
    dx = np.zeros_like(x)
    dproj = [np.zeros((len(x), 3 * STATE), np.float32) for _ in (0, 1)]
    carry = {0: 0.0, 1: 0.0}
    for d, s, h, un, z, r, n in reversed(f["kept"]):
        dh = (dboth[s, :, d * STATE : (d + 1) * STATE] + carry[d]) * f["m"][s]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        du = np.concatenate((dz, dr, dn * r), axis=1)
        g["rec"][d] += h.T @ du
        carry[d] = dh * z + du @ p["rec"][d].T
        np.add.at(dproj[d], at[:, s], np.concatenate((dz, dr, dn), axis=1))
    for d in (0, 1):
        dproj[d][-1] = 0
        g["in"][d] = x.T @ dproj[d]
        g["inb"][d] = dproj[d].sum(axis=0)
        dx += dproj[d] @ p["in"][d].T
    return g, dx


def train(samples: list[tuple[int, bytes]], epochs: int = 4, batch: int = 32, seed: int = 5) -> ToxicityModel:
    """Fit to (label, whole text). A document's logit is a soft maximum over its windows, so the labels find the windows."""
    y = np.array([s[0] for s in samples], np.float32)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    if len(set(y.tolist())) < 2:
        return ToxicityModel(prior)
    rng = np.random.default_rng(seed)
    read = [read_words([text]) for _, text in samples]
    seen, count = np.unique(np.concatenate([np.unique(r[0]) for r in read]), return_counts=True)
    vocabulary = seen[count >= LEAST_DOCS]
    dims, states = WORD_DIM + CHAR_DIM, 2 * STATE
    p = {
        "word": rng.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM)),
        "char": rng.normal(0, 0.1, (TRIGRAMS, CHAR_DIM)),
        "in": rng.normal(0, dims**-0.5, (2, dims, 3 * STATE)),
        "inb": np.zeros((2, 3 * STATE)),
        "rec": rng.normal(0, STATE**-0.5, (2, STATE, 3 * STATE)),
        "att": rng.normal(0, states**-0.5, (states, ATTEND)),
        "query": rng.normal(0, 1, ATTEND),
        "out": rng.normal(0, states**-0.5, states),
        "bias": np.full(1, -1.0),
    }
    model = ToxicityModel(prior, vocabulary, {k: v.astype(np.float32) for k, v in p.items()})
    p = model.p
    step = adam({k: v for k, v in p.items() if k not in ("word", "char")}, 0.01)
    sides = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    rounds = epochs * max(40, len(samples) // batch)
    long = [len(r[0]) > MANY * STEP for r in read]
    worst: dict[int, tuple[int, tuple]] = {}
    table = {k: np.full(len(p[k]), 1e-8, np.float32) for k in ("word", "char")}
    for k in range(rounds):
        rate = 1.0 if k < rounds * 0.7 else 0.3
        pick = np.concatenate([rng.choice(s, batch // 2) for s in sides])
        for i in pick:
            if long[i] and (i not in worst or worst[i][0] != k * epochs // rounds):  # very long ones once an epoch
                worst[i] = k * epochs // rounds, _worst(model, read[i])
        h, before, tri, first = _together([worst[i][1] if long[i] else _worst(model, read[i]) for i in pick])
        x, word, sizes = model.inputs(h, tri, first)
        at, mask, owner = windows(before)
        f = forward(p, x, at, mask, keep=True)
        logit = f["logit"]
        top = np.full(len(pick), -1e9)
        np.maximum.at(top, owner, logit)
        soft = np.exp(2 * (logit - top[owner]))
        soft /= np.bincount(owner, soft, len(pick))[owner]
        doc = np.bincount(owner, soft * logit, len(pick))
        d = (_sigmoid(doc) - y[pick]) / len(pick)
        g, dx = backward(p, x, at, mask, f, (d[owner] * soft).astype(np.float32))
        step(g, rate)
        dw, dc = dx[:-1, :WORD_DIM], (dx[:-1, WORD_DIM:] / np.sqrt(sizes)[:, None])
        for name, rows, grad in (("word", word, dw), ("char", tri, np.repeat(dc, sizes, axis=0))):
            used, inverse = np.unique(rows, return_inverse=True)
            total = np.stack([np.bincount(inverse, grad[:, j], len(used)) for j in range(grad.shape[1])], axis=1)
            table[name][used] += (total**2).mean(axis=1)
            p[name][used] -= (0.08 * rate * total / np.sqrt(table[name][used])[:, None]).astype(np.float32)
    return model


def _worst(model: ToxicityModel, read: tuple) -> tuple:
    """The words of the WORST worst of all a document's windows; a document of fewer whole."""
    h, before, tri, first = read
    at, mask, _ = windows(before)
    if len(at) <= WORST:
        return read
    x = model.inputs(h, tri, first)[0]
    logit = np.concatenate([forward(model.p, x, at[a : a + 512], mask[a : a + 512])["logit"] for a in range(0, len(at), 512)])
    chosen = np.sort(np.argpartition(-logit, WORST)[:WORST])
    words = np.unique(at[chosen][mask[chosen]])  # neighbours share words; windows are laid anew over these
    sizes = np.diff(np.append(first, len(tri)))[words]
    of = np.repeat(first[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return h[words], np.array([0, len(words)]), tri[of], np.cumsum(sizes) - sizes


def _together(read: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(r[2]) for r in read]
    shift = np.cumsum([0, *sizes[:-1]])
    return np.concatenate([r[0] for r in read]), np.cumsum([0] + [len(r[0]) for r in read]), np.concatenate([r[2] for r in read]), np.concatenate([r[3] + s for r, s in zip(read, shift, strict=True)])


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: F.Column | None = None, limit: int = SAMPLE) -> ToxicityModel:
    """Learn from a bounded, documented sample: whole texts of at most limit labelled documents, and SAMPLE_BYTES of them."""
    return train(labelled_texts(docs, labels, "toxic", F.lit(True) if keep is None else keep, limit))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability that a text is toxic, by its worst window."""
    tune(docs.sparkSession)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(model.score(texts_of(column)), pa.float64())

    return docs.withColumn(out, score(F.col(text)))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit_toxicity(docs.select("doc_id", "text"), labels, fold != 0)
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
