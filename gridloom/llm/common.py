"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.shipping import ship

#: Rows of one Arrow batch: whole texts travel, so batches are kept short.
BATCH_ROWS = 512
#: Bytes of text that are hashed at once; bounds the arrays of a worker.
PIECE_BYTES = 1 << 20


def tune(spark: SparkSession) -> None:
    """Short Arrow batches, so a worker holds few whole texts at a time; and workers that find this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one that the cluster names in spark.checkpoint.dir.

    Without that setting, the checkpoint folder of the context is taken. Only a local master, whose tasks share the
    driver's disk, gets a folder of its own; elsewhere it is an error, as other machines would not see one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = "/tmp/gridloom-shared"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/gridloom-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    return _written(df, f"{shared_folder(df.sparkSession)}-{name}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Shuffle files go as soon as their query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one operator in the shared folder. On leaving, those of keep() are deleted, those of result() stay.

    While it is open, the shuffle files of each query are deleted when it ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.tables = spark, shared_folder(spark), 0
        self.paths: dict[DataFrame, str] = {}

    def __enter__(self) -> Scratch:
        self.before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        return self

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(CLEANUP)
        else:
            self.spark.conf.set(CLEANUP, self.before)
        self._delete(self.folder)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}-{name}"
        out = _written(df, path)
        self.paths[out] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of keep() that nothing reads any more; any other stays."""
        if path := self.paths.pop(df, None):
            self._delete(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self.folder}-{name}")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column (in any case) has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# --- vectorised word and shingle hashes -------------------------------------------------------------------------------

_P = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(PIECE_BYTES, _P)
_INV = _powers(PIECE_BYTES, pow(_P, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_table(separators: bytes, lower: bool) -> np.ndarray:
    """Value of each byte in a word's hash; 0 marks a separator."""
    out = np.arange(1, 257, dtype=np.uint64)
    if lower:
        out[65:91] = out[97:123]
    out[list(separators)] = 0
    return out


#: White space of the shingle contracts: space and 0x09 to 0x0D.
SPACES = b" \t\n\v\f\r"
WHITE = lower_table(SPACES, True)


def _hash_piece(data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and past-the-last position of each word of at most PIECE_BYTES bytes."""
    v = values[data]
    inside = v != 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v * _POW[: len(v)], dtype=np.uint64)))
    h = (total[last] - total[first]) * _INV[first]
    return mix64(h + (last - first).astype(np.uint64)), first, last


def word_hashes(texts: list[bytes], values: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the number of words before it (one more entry than texts).

    Long words are folded from pieces, so a text without any separator works too.
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            joined = b" ".join(texts[i] for i in group)
            h, first, _ = _hash_piece(np.frombuffer(joined, np.uint8), values)
            starts = np.cumsum([0] + [len(texts[i]) + 1 for i in group[:-1]])
            at = np.searchsorted(first, np.append(starts, len(joined) + 1))
            counts[np.array(group) + 1] = np.diff(at)
            hashes.append(h)
        group, size = [], 0

    for i, t in enumerate(texts):
        if size + len(t) + 1 > PIECE_BYTES:
            flush()
        if len(t) + 1 > PIECE_BYTES:
            h = _long_text(t, values)
            counts[i + 1] = len(h)
            hashes.append(h)
        else:
            group.append(i)
            size += len(t) + 1
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.cumsum(counts)


def _long_text(t: bytes, values: np.ndarray) -> np.ndarray:
    data, out, at = np.frombuffer(t, np.uint8), [], 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        if end < len(data):
            seps = np.flatnonzero(values[data[at:end]] == 0)
            if len(seps):
                end = at + int(seps[-1]) + 1
            else:  # one word longer than a piece
                rest = np.flatnonzero(values[data[end : end + (1 << 26)]] == 0)
                stop = end + int(rest[0]) if len(rest) else min(len(data), end + (1 << 26))
                whole = np.uint64(0)
                for k in range(at, stop, PIECE_BYTES):
                    part = _hash_piece(data[k : min(k + PIECE_BYTES, stop)], values)[0]
                    whole = mix64(np.array([whole], np.uint64) * np.uint64(_P) + part)[0]
                out.append(np.array([whole], np.uint64))
                at = stop
                continue
        out.append(_hash_piece(data[at:end], values)[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_K = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words; with fewer words, of the whole sequence; without words, none."""
    n = len(words)
    if n == 0:
        return words
    w = min(width, n)
    total = np.full(n - w + 1, w, dtype=np.uint64)
    for j in range(w):
        total = total + words[j : n - w + 1 + j] * _K[j % len(_K)] * np.uint64(2 * (j // len(_K)) + 1)
    return mix64(total)


# --- labelled samples -------------------------------------------------------------------------------------------------


#: Bytes of text that a sample holds at most, beside its bound on documents.
SAMPLE_BYTES = 64 << 20


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, keep: F.Column, limit: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, bytes]]:
    """(label, whole text) of at most limit documents, half of either class, chosen by a hash of their ids.

    keep: which rows of labels may be learned from. Repeated labels of a document count once, the larger label wins;
    other labels than 0 and 1 are left out. Only ids, labels and sizes are gathered first; the ids that are then looked
    for are at most limit, so they can be broadcast. The texts gathered hold most_bytes at most: in the hash's order, a text
    that would bring them beyond is left out. Of a document's several texts the least one is taken.
    """
    spark = docs.sparkSession
    known = labels.where(keep & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    half = limit // 2
    picked = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half).collect()]
    if not picked:
        return []
    ids = spark.createDataFrame([(k, int(r.doc_id), int(r.y)) for k, r in enumerate(picked)], "k int, doc_id long, y int")
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = docs.select("doc_id", F.octet_length(text).alias("size")).join(F.broadcast(ids), "doc_id").groupBy("k").agg(F.max("size").alias("size")).collect()
    size = {r.k: r["size"] for r in sizes}
    left, chosen = [most_bytes // 2] * 2, []
    for k, r in enumerate(picked):
        if k in size and size[k] <= left[int(r.y)]:
            left[int(r.y)] -= size[k]
            chosen.append((k, int(r.doc_id), int(r.y)))
    if not chosen:
        return []
    some = spark.createDataFrame(chosen, "k int, doc_id long, y int")
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(some), "doc_id").groupBy("k").agg(F.min(F.struct("y", "text")).alias("x")).orderBy("k").collect()
    return [(r.x.y, r.x.text.encode()) for r in rows]


def adam(params: dict[str, np.ndarray], rate: float):
    """A step function of the Adam optimiser over named float32 arrays."""
    m = {k: np.zeros_like(v) for k, v in params.items()}
    s = {k: np.zeros_like(v) for k, v in params.items()}
    t = 0

    def step(grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        nonlocal t
        t += 1
        for k, g in grads.items():
            m[k] += 0.1 * (g - m[k])
            s[k] += 0.001 * (g * g - s[k])
            params[k] -= rate * scale * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    return step


def grouped(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
