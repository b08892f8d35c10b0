"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the SIZE smallest distinct 64-bit hashes of a text's five-word shingles (words: `[^\\x20\\x09-\\x0D]+`, case
kept; with fewer words, the whole sequence is one shingle). Sketches of parts merge into the sketch of the union, and
two sketches estimate resemblance (Jaccard), containment and, one by one, the number of distinct shingles. While a set
has fewer than SIZE shingles, all estimates are exact.

Defined results: null and empty text, and text of white space alone, have the empty sketch, written "". Two empty
sketches have likeness 1, an empty and another one 0. with_next: null ids come last, of rows with one id the text decides,
a single row follows itself, an empty table gives no rows; of the input's columns it reads doc_id and text only.
fingerprint_documents keeps all columns but one named as its output.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import SPACES, lower_table, shingles, texts_of, tune, word_hashes

SIZE, WORDS = 256, 5
_VALUES = lower_table(SPACES, False)


def sketch(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The size smallest distinct hashes, ascending."""
    if len(hashes) > 4 * size:  # enough distinct ones are nearly always among these
        least = np.unique(np.partition(hashes, 2 * size)[: 2 * size])
        if len(least) >= size:
            return least[:size]
    return np.unique(hashes)[:size]


def sketches(texts: list[bytes], size: int = SIZE, words: int = WORDS) -> list[np.ndarray]:
    h, before = word_hashes(texts, _VALUES)
    return [sketch(shingles(h[a:b], words), size) for a, b in zip(before[:-1], before[1:], strict=True)]


def merge(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sketch of the union of the sets behind two sketches."""
    return np.unique(np.concatenate((a, b)))[:size]


def distinct(a: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < size else (size - 1) / ((float(a[size - 1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of common shingles among all of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    twice = both[1:] == both[:-1]
    first = np.flatnonzero(np.concatenate(([True], ~twice)))[:size]  # of the union's smallest
    return float(np.count_nonzero(np.append(twice, False)[first])) / len(first)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of the shingles of a that b has too."""
    if not len(a):
        return 1.0
    j, union = resemblance(a, b, size), distinct(merge(a, b, size), size)
    return min(1.0, j * union / distinct(a, size))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s or ""), "<u8").astype(np.uint64)


def fingerprint_documents(docs: DataFrame, text: str = "text", out: str = "fingerprint", size: int = SIZE) -> DataFrame:
    """docs with the sketch of every whole text, as base64 text."""
    tune(docs.sparkSession)

    @F.arrow_udf("string")
    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([to_text(s) for s in sketches(texts_of(column), size)], pa.string())

    return docs.withColumn(out, sketched(F.col(text)))


@F.arrow_udf(T.DoubleType())
def resemblance_of(a: pa.Array, b: pa.Array) -> pa.Array:
    """Column function: estimated resemblance of two fingerprint columns."""
    return pa.array([resemblance(from_text(x), from_text(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def containment_of(a: pa.Array, b: pa.Array) -> pa.Array:
    """Column function: estimated containment of the first fingerprint's text in the second's."""
    return pa.array([containment(from_text(x), from_text(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def distinct_of(a: pa.Array) -> pa.Array:
    """Column function: estimated number of distinct shingles behind a fingerprint."""
    return pa.array([distinct(from_text(x)) for x in a.to_pylist()], pa.float64())


def _turned(x: F.Column) -> F.Column:
    """16 hex digits with their bytes in the other order."""
    return F.concat(*[F.substring(x, at, 2) for at in range(15, 0, -2)])


def merge_fingerprints(parts: DataFrame, keys: list[str], fingerprint: str = "fingerprint", size: int = SIZE) -> DataFrame:
    """keys and one fingerprint per key from those of its parts, by DataFrame operations: a key's hashes are cut to the size
    smallest ones by a ranked window (which Spark applies before the shuffle too), so no group is gathered whole. Null and
    empty fingerprints add nothing; keys may be null."""
    from pyspark.sql import Window

    taken, names = {k.lower() for k in keys} | {fingerprint.lower()}, []
    for name in ("h", "r"):
        while name in taken:
            name = f"_{name}"
        names.append(name)
    h, r = names
    digits = F.hex(F.unbase64(F.coalesce(F.col(fingerprint), F.lit(""))))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.floor(F.length(digits) / 16).cast("int") - 1, F.lit(0))), lambda i: F.length(digits) >= 16)
    hashes = F.transform(places, lambda i: _turned(F.substr(digits, i * 16 + 1, F.lit(16))))
    one = parts.select(*keys, F.explode_outer(hashes).alias(h)).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(h).asc_nulls_last()))
    least = one.withColumn(r, rank).where(F.col(r) <= size)
    text = F.base64(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(h)), _turned), "")))
    return least.groupBy(*keys).agg(F.regexp_replace(text, "[\r\n]", "").alias(fingerprint))


# --- neighbours in descending order of the id -------------------------------------------------------------------------

#: Rows of a bucket of ids, and the most buckets whose first ids the driver holds; beyond, buckets have more rows.
BUCKET_ROWS, MOST_BUCKETS = 2048, 20_000


def with_next(docs: DataFrame, make, schema: str) -> DataFrame:
    """Rows that make(doc_ids, texts, next_texts) gives for all documents, each with its successor's text.

    Successor: the next row by descending id (null ids last, repeated ids by text), after the last the first. Ids are
    cut into ranges at quantiles; a text is dealt to the range of its id, and the first of each range once more to the
    range before it. So each text is shuffled once, and no range needs another's rows. The driver holds one id for each
    range, MOST_BUCKETS at most.
    """
    spark = docs.sparkSession
    tune(spark)
    least = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(least))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), key.alias("key"))
    n = docs.count()
    ranges = int(min(MOST_BUCKETS, max(1, n // BUCKET_ROWS)))
    cuts = []
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(docs.select(F.percentile_approx(key, at, F.lit(max(10_000, 4 * ranges))).alias("q")).first().q))
    splits = np.array(cuts, np.int64)

    @F.arrow_udf("int")
    def bucket_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(splits, ids.to_numpy(zero_copy_only=False), "right"), pa.int32())

    firsts = {r.b: r.k for r in docs.select(key.alias("k")).withColumn("b", bucket_of("k")).groupBy("b").agg(F.max("k").alias("k")).collect()}
    order = sorted(firsts, reverse=True)
    lends = {firsts[b]: order[i - 1] for i, b in enumerate(order)}  # the first range lends to the last

    @F.arrow_udf("array<int>")
    def dealt(ids: pa.Array) -> pa.Array:
        own = np.searchsorted(splits, ids.to_numpy(zero_copy_only=False), "right").tolist()
        return pa.array([[2 * b] if (to := lends.get(k)) is None else [2 * b, 2 * to + 1] for k, b in zip(ids.to_pylist(), own, strict=True)], pa.list_(pa.int32()))

    sent = rows.withColumn("at", F.explode(dealt("key"))).select((F.col("at").bitwiseAND(1) == 1).alias("lent"), F.shiftright("at", 1).alias("bucket"), "key", "doc_id", "text")
    placed = sent.repartition("bucket").sortWithinPartitions("bucket", "lent", F.col("key").desc(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a row that waits for its successor
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "lent", "doc_id", "text")]
            ready: list[tuple] = []
            for bucket, lent, doc_id, text in zip(*cols, strict=True):
                if held is not None and held[0] == bucket:
                    ready.append((held[1], held[2], text))
                    held = None
                if not lent:
                    held = (bucket, doc_id, text)
            if ready:
                yield make(*map(list, zip(*ready, strict=True)))

    return placed.mapInArrow(run, schema)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    def rows(ids: list[int], texts: list[str], following: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(texts, following, strict=True)]
        own, other, new = (sketches([x.encode() for x in xs]) for xs in (texts, following, edited))
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                "fingerprint": [to_text(x) for x in own],
                "edited_fingerprint": [to_text(x) for x in new],
                "near_edited": [resemblance(a, b) for a, b in zip(own, new, strict=True)],
                "near_next": [resemblance(a, b) for a, b in zip(own, other, strict=True)],
            }
        )

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_next(docs, rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
