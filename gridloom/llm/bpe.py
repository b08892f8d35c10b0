"""BPE encoding and decoding by a segment tree over the ranks of adjacent pairs.

A pre-token's symbols are leaves of a tree whose nodes hold the lowest (rank, position) of their leaves, so the root is
the leftmost lowest-rank merge. A merge changes the left pair, its own and the right pair: three point updates of
logarithmic cost, until the root holds no pair. So a pre-token of n bytes costs O(n log n) whatever its merges.
Symbols that a merge takes away are unlinked, and their leaf is emptied, so positions stay in order. The trees of all
pre-tokens of one width that a batch of texts has new are rows of one array (`PairForest`), merged and updated level by
level together; a pre-token of more than TOGETHER bytes has a tree of its own (`PairTree`).

Reads the public tokenizer JSON layout of byte-level models: added tokens are cut out first, the rest is split by the
byte-level pattern, bytes become the layout's printable characters. Decoding is its inverse: bytes of all tokens, UTF-8
with malformed parts replaced.

Defined results: null and empty texts have no ids and decode to "". Repeated rows get equal ids. Other columns pass
through; those with an output's name are replaced. Unknown ids decode to nothing. A text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import PIECE_BYTES, tune
from gridloom.llm.words import WordCodes, byte_level, pieces

NONE = 1 << 62
#: Most bytes of a pre-token whose tree is merged together with others; most leaves of such trees at a time.
TOGETHER, LEAVES = 128, 1 << 20
# Fixed values of the byte-level layout: the splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The layout's character of each byte: itself when printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    later = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(later)) for b in range(256)]


class PairTree:
    """Lowest (rank, position) over adjacent pairs. A node is one integer: rank * size + position."""

    def __init__(self, ranks: list[int]) -> None:
        self.size = 1 << max(0, (len(ranks) - 1).bit_length())
        n = self.size
        self.nodes = [NONE] * (2 * n)
        for i, r in enumerate(ranks):
            if r >= 0:
                self.nodes[n + i] = r * n + i
        for i in range(n - 1, 0, -1):
            a, b = self.nodes[2 * i], self.nodes[2 * i + 1]
            self.nodes[i] = a if a < b else b

    def root(self) -> int:
        """Position of the leftmost lowest-rank pair, or -1."""
        return -1 if self.nodes[1] == NONE else self.nodes[1] % self.size

    def put(self, at: int, rank: int) -> None:
        nodes, i = self.nodes, self.size + at
        nodes[i] = NONE if rank < 0 else rank * self.size + at
        while i > 1:
            i >>= 1
            a, b = nodes[2 * i], nodes[2 * i + 1]
            low = a if a < b else b
            if nodes[i] == low:
                break
            nodes[i] = low


class PairForest:
    """Trees of equal width, one row each: ids are rows of symbols, -1 behind the last; ranks gives ranks of pairs."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, ranks) -> None:
        self.ids, self.lengths, self.ranks = ids, lengths, ranks
        rows, self.size = len(ids), ids.shape[1] - 1  # a power of two
        places = np.arange(self.size + 1)
        self.after = np.tile(places + 1, (rows, 1))
        self.before = np.tile(places - 1, (rows, 1))
        self.nodes = np.full((rows, 2 * self.size), NONE, np.int64)
        pair = np.flatnonzero(places[None, :-1] + 1 < lengths[:, None])
        row, at = np.divmod(pair, self.size)
        self.nodes[row, self.size + at] = self._leaf(ids[row, at], ids[row, at + 1], at)
        level = self.size
        while level > 1:
            level //= 2
            self.nodes[:, level : 2 * level] = np.minimum(self.nodes[:, 2 * level : 4 * level : 2], self.nodes[:, 2 * level + 1 : 4 * level : 2])

    def _leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank = self.ranks(a, b)
        return np.where(rank < 0, NONE, rank * self.size + at)

    def _put(self, row: np.ndarray, at: np.ndarray, leaf: np.ndarray) -> None:
        """Sets leaves (several of a row, in any order) and what is above them, level by level."""
        self.nodes[row, self.size + at] = leaf
        node = self.size + at
        for _ in range(self.size.bit_length() - 1):
            node = node >> 1
            self.nodes[row, node] = np.minimum(self.nodes[row, 2 * node], self.nodes[row, 2 * node + 1])

    def merge(self, merged: np.ndarray) -> list[np.ndarray]:
        """Ids of each row when no pair is left. merged: the id that each rank gives."""
        row = np.arange(len(self.ids))
        while len(row := row[self.nodes[row, 1] != NONE]):
            rank, i = np.divmod(self.nodes[row, 1], self.size)
            j = self.after[row, i]
            k = self.after[row, j]
            self.ids[row, i], self.ids[row, j] = merged[rank], -1
            self.after[row, i] = k
            more = k < self.lengths[row]
            self.before[row[more], k[more]] = i[more]
            h = self.before[row, i]
            leaves = [(row, i, np.where(more, self._leaf(self.ids[row, i], self.ids[row, np.minimum(k, self.size)], i), NONE))]
            gone = j < self.size
            leaves.append((row[gone], j[gone], np.full(int(gone.sum()), NONE)))
            left = h >= 0
            leaves.append((row[left], h[left], self._leaf(self.ids[row[left], h[left]], self.ids[row[left], i[left]], h[left])))
            self._put(*(np.concatenate(x) for x in zip(*leaves, strict=True)))
        kept = self.ids >= 0
        return np.split(self.ids[kept], np.cumsum(kept.sum(axis=1))[:-1])


class ByteBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        model = layout["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (k, self.vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        symbols = byte_symbols()
        self.of_byte = [self.vocab[s] for s in symbols]
        back = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in layout.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.split = regex.compile(PATTERN)
        codes = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(codes)
        self.codes, self.rank_of = codes[order], np.array([k for k, _ in self.merges.values()], np.int64)[order]
        self.merged = np.zeros(len(pairs), np.int64)
        self.merged[[k for k, _ in self.merges.values()]] = [i for _, i in self.merges.values()]
        self.symbols = np.array(self.of_byte, np.int64)
        self.words = WordCodes(byte_level, self._merged)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it has none."""
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.rank_of[at], -1) if len(self.codes) else np.full(len(code), -1)

    def merge_all(self, words: list[str]) -> list[Sequence[int]]:
        """Ids of some pre-tokens."""
        data = [w.encode() for w in words]
        sizes = np.array([len(x) for x in data], np.int64)
        out: list[Sequence[int]] = [[]] * len(words)
        width = 1
        while width // 2 < TOGETHER:
            some = np.flatnonzero((sizes <= width + 1) & (sizes > (width // 2 + 1 if width > 1 else 0)) & (sizes <= TOGETHER))
            for at in range(0, len(some), max(1, LEAVES // width)):
                part = some[at : at + max(1, LEAVES // width)]
                ids = np.full((len(part), width + 1), -1, np.int64)
                ids[np.arange(width + 1) < sizes[part][:, None]] = self.symbols[np.frombuffer(b"".join(data[i] for i in part), np.uint8)]
                for i, got in zip(part.tolist(), PairForest(ids, sizes[part], self.ranks).merge(self.merged), strict=True):
                    out[i] = got
            width *= 2
        for i in np.flatnonzero(sizes > TOGETHER):
            out[i] = self.merge(data[i])
        return out

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.of_byte[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        found = self.merges
        rank = lambda a, b: found.get((a, b), (-1, 0))[0]
        tree = PairTree([rank(ids[i], ids[i + 1]) for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (i := tree.root()) >= 0:
            j = after[i]
            ids[i] = found[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, -1)
            if k < n:
                before[k] = i
            tree.put(i, rank(ids[i], ids[k]) if k < n else -1)
            if (h := before[i]) >= 0:
                tree.put(h, rank(ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.merge_all(words)
        return np.concatenate([np.asarray(x, np.int64) for x in ids]), np.array([len(x) for x in ids], np.int64)

    def encode(self, text: str) -> list[int]:
        """Ids of one text, pre-token by pre-token."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                out.append(self.added[part])
            else:
                out += [x for word in self.split.findall(part) for x in self.merge(word.encode())]
        return out

    def _alone(self, text: str) -> list[int] | None:
        """Ids of texts with added tokens and of long ones without spaces between letters; None: to be encoded with others."""
        if self.cut and self.cut.search(text):
            return [x for part in self.cut.split(text) for x in ([self.added[part]] if part in self.added else next(self.encode_all([part])).tolist())]
        return self.encode(text) if len(text) > PIECE_BYTES // 2 and pieces(text, PIECE_BYTES // 2) is None else None

    def encode_all(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        return self.words.rows(texts, self._alone)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.get, ids, repeat(b""))).decode("utf-8", "replace")


def id_rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each row, as views of the column's own values; null is empty."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for i, known in enumerate(column.is_valid().to_pylist()):
        yield values[ends[i] : ends[i + 1]] if known else values[:0]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_texts(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the token ids (array<int>) of every whole text. path: a tokenizer file that all executors have."""
    tune(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = byte_bpe(path)
        for column in batches:
            ids = [x.astype(np.int32) for x in bpe.encode_all([t or "" for t in column.to_pylist()])]
            ends = np.cumsum([0] + [len(x) for x in ids])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))

    return docs.withColumn(out, encode(F.col(text)))


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text that an array of ids stands for."""
    tune(docs.sparkSession)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = byte_bpe(path)
        for column in batches:
            yield pa.array([bpe.decode(x.tolist()) for x in id_rows(column)], pa.string())

    return docs.withColumn(out, decode(F.col(ids)))


def ids_sha256(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()


def tokenized(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the columns of keep of documents. One worker of a task encodes and
    decodes, as encode_texts and decode_ids do one by one."""
    tune(docs.sparkSession)
    rows = docs.select("doc_id", "text", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            ids = list(bpe.encode_all([t or "" for t in batch.column(1).to_pylist()]))
            found = [pa.array([len(x) for x in ids], pa.int64()), pa.array([ids_sha256(x) for x in ids], pa.string()), pa.array([hashlib.sha256(bpe.decode(x.tolist()).encode()).hexdigest() for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found, *batch.columns[2:]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", `{c}` {kinds[c]}" for c in keep))


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
