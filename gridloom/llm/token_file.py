"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level k holds the kth chunk of all ids that have one, back to back,
and a bitmap that says which of them continue on level k + 1; a rank directory holds the set bits before every
RANK_BITS bits. So any token is read by one chunk and one rank for each level, without decoding a block around it. Each
file also has its documents' ids, first tokens and lengths.

Documents are written in ascending doc_id order (null first, repeated ids by text): ranges of ids are dealt to tasks, and
a file's header names its range and place. The ids before a file are summed from headers by range, then in a range.

Defined results: null and empty texts give the end id alone. Repeated rows are written each. Other columns are not
written. An empty table gives a folder without files.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import PIECE_BYTES, materialise, shared_folder, tune
from gridloom.llm.files import read_files, write_files
from gridloom.llm.words import WordCodes, pieces, word_level

MAGIC, CHUNK_BITS, RANK_BITS = b"DACTOKN1", 8, 512
#: Tokens after which a task closes a file, between documents.
FILE_TOKENS = 1 << 22
#: Last byte of each file.
END = 0x0A
_HEAD = "<8sqqqqq"  # magic, range, place in it, documents, tokens, levels


def pack_codes(ids: np.ndarray) -> list[bytes]:
    """Levels of ids: count, chunks, bitmap and rank directory of each."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(CHUNK_BITS)
        goes = more > 0
        bits = np.packbits(goes, bitorder="little")
        per = np.add.reduceat(goes, np.arange(0, len(goes), RANK_BITS), dtype=np.int64) if len(goes) else np.zeros(0, np.int64)
        ranks = np.concatenate(([0], np.cumsum(per))).astype("<u8")
        out.append(struct.pack("<q", len(rest)) + rest.astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not goes.any():
            return out
        rest = more[goes]


class TokenFile:
    """Random access to a file's image."""

    def __init__(self, image: bytes) -> None:
        magic, self.range, self.place, n, self.tokens, levels = struct.unpack_from(_HEAD, image)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(_HEAD)
        self.nulls = np.frombuffer(image, np.uint8, n, at)
        self.doc_ids = np.frombuffer(image, "<i8", n, at + n)
        self.starts = np.frombuffer(image, "<i8", n + 1, at + 9 * n)
        at += 9 * n + 8 * (n + 1)
        self.levels = []
        for _ in range(levels):
            (size,) = struct.unpack_from("<q", image, at)
            chunks = np.frombuffer(image, np.uint8, size, at + 8)
            bits = np.frombuffer(image, np.uint8, -(-size // 8), at + 8 + size)
            at += 8 + size + len(bits)
            ranks = np.frombuffer(image, "<u8", -(-size // RANK_BITS) + 1, at)
            at += 8 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def _rank(self, level: int, at: int) -> int:
        """Continuing chunks before a place."""
        _, bits, ranks = self.levels[level]
        block = at // RANK_BITS
        first = block * RANK_BITS // 8
        inside = np.unpackbits(bits[first : at // 8 + 1], bitorder="little")[: at - block * RANK_BITS]
        return int(ranks[block]) + int(inside.sum())

    def token(self, at: int) -> int:
        """One id, without decoding others."""
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[at]) << (CHUNK_BITS * level)
            if not bits[at >> 3] >> (at & 7) & 1:
                break
            at = self._rank(level, at)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop: the levels' matching ranges, found by ranks."""
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            first = start // 8
            goes = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            where = where[goes]
            if not len(where):
                break
            start = self._rank(level, start)
            stop = start + len(where)
        return out


def image_of(range_: int, place: int, ids: list[int | None], tokens: list[np.ndarray]) -> bytes:
    starts = np.cumsum([0] + [len(t) for t in tokens]).astype("<i8")
    levels = pack_codes(np.concatenate(tokens))
    head = struct.pack(_HEAD, MAGIC, range_, place, len(ids), int(starts[-1]), len(levels))
    return b"".join([head, bytes(i is None for i in ids), np.array([i or 0 for i in ids], "<i8").tobytes(), starts.tobytes(), *levels])


class LibraryCodes:
    """Ids of whole texts as the tokenizers library gives them, for its word-level layout: NFC, lower case, white space
    dropped, then letters, single numbers and others apart. Texts are normalised and split here; each different word goes
    through the library once, and so does a text as a whole that holds an added token or too few spaces to be cut."""

    #: Below it all code points are in NFC, and Python lowers each as the library does.
    PLAIN = 0x300
    # Fixed value: the mark of a word's last id. And words of one text that the library reads.
    WORD_END, JOINED = "</w>", 256

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closes[[i for t, i in vocabulary.items() if t.endswith(self.WORD_END)]] = True
        self.words = WordCodes(word_level, self.encode_words)
        self.whole: dict[str, list[int]] = {}
        self.beyond = re.compile(f"[{chr(self.PLAIN)}-{chr(0x10FFFF)}]")

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words one behind the other, and their number for each: of many words in one text, cut behind the ids
        that end a word; if there are not as many, one by one."""
        texts = [words[at : at + self.JOINED] for at in range(0, len(words), self.JOINED)]
        flat, sizes = [], []
        for some, found in zip(texts, self.library.encode_batch_fast([" ".join(x) for x in texts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                flat.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                alone = [x.ids for x in self.library.encode_batch_fast(some, add_special_tokens=False)]
                flat += [np.array(x, np.uint32) for x in alone]
                sizes.append(np.array([len(x) for x in alone], np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def plain(self, text: str) -> str:
        return text.lower() if text.isascii() or not self.beyond.search(text) else self.library.normalizer.normalize_str(text)

    def _alone(self, text: str) -> list[int] | None:
        return self.whole.get(text) if self.whole else None

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        ready, self.whole = [], {}
        for text in texts:
            plain = self.plain(text)
            if any(t in text for t in self.added) or (len(plain) > PIECE_BYTES // 2 and pieces(plain, PIECE_BYTES // 2) is None):
                plain = f"\0{text}"  # apart from any normalised text that is cut here
                self.whole[plain] = self.library.encode(text, add_special_tokens=False).ids
            ready.append(plain)
        return self.words.rows(ready, self._alone)


@lru_cache(maxsize=2)
def library_codes(path: str) -> LibraryCodes:
    return LibraryCodes(path)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Encode doc_id, text with the tokenizers library and write the ids below path."""
    tune(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place, size = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        # written as a string and a last byte, which the text sink adds
        image = lambda: pa.RecordBatch.from_pydict({"image": pa.array([image_of(own, place, ids, tokens)], pa.binary())})
        for batch in batches:
            found = library_codes(tokenizer).encode_all([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, got in zip(batch.column(0).to_pylist(), found, strict=True):
                ids.append(doc_id)
                tokens.append(np.append(got, np.uint32(end_id)))
                size += len(tokens[-1])
                if size >= FILE_TOKENS:
                    yield image()
                    ids, tokens, size, place = [], [], 0, place + 1
        if ids:
            yield image()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    write_files(rows.mapInArrow(pack, "image binary"), "image", END, path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of all documents below path."""
    tune(spark)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(batch.schema.get_field_index("content")):
                f = TokenFile(x.as_py())
                crc = [zlib.crc32(f.slice(a, b).astype("<u4").tobytes()) for a, b in zip(f.starts[:-1].tolist(), f.starts[1:].tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_pydict({
                    "range": pa.array([f.range] * n, pa.int64()), "place": pa.array([f.place] * n, pa.int64()),
                    "doc_id": pa.array([None if z else i for z, i in zip(f.nulls, f.doc_ids.tolist(), strict=True)], pa.int64()),
                    "at": pa.array(f.starts[:-1], pa.int64()), "n_tokens": pa.array(np.diff(f.starts), pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                })

    kinds = "range long, place long, doc_id long, at long, n_tokens long, ids_crc32 long"
    docs = materialise(read_files(spark, path).select("content").mapInArrow(unpack, kinds), "tokens")
    files = docs.groupBy("range", "place").agg(F.sum("n_tokens").alias("n"))
    in_range = F.sum("n").over(Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("before", F.coalesce(in_range, F.lit(0)))
    sums, total = [], 0  # one number for each of the write's tasks
    for r in sorted(files.groupBy("range").agg(F.sum("n").alias("n")).collect()):
        sums.append((r.range, total))
        total += r.n
    ranges = spark.createDataFrame(sums, "range long, first long")
    placed = docs.join(files.drop("n"), ["range", "place"]).join(F.broadcast(ranges), "range")
    return placed.select("doc_id", (F.col("first") + F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_file(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}-token-files"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2, path)
    return read_tokens(spark, path)
