"""N-gram Jaccard join: a size-aware heavy-light join of distinct shingle sets.

Two sets of sizes a and b link when 100 * intersection >= P * union, so when they share c(a, b) = ceil(P (a + b) / (100 +
P)) shingles, and so differ in at most D = a + b - 2 c. Equal sets are one node from the start.

Light sets (at most T shingles) enumerate their subsets of the fixed sizes c(a, b) of all light partners b; two that link
share one. Heavy sets are found through inverted lists. A list of a single shingle would hold all that share a passage, so
the lists are of parts: the hash space is cut into k > D parts, each differing shingle spoils one part at most, so linked
sets hold the same shingles in at least k - D parts, and meet on the lists of those parts' contents (pigeonhole). k follows
from the size class; linked sets are in one class or in neighbouring ones, and a set that can have partners in the next
class is listed there too. k exceeds D by so much that linked sets agree on three listed parts (`size_classes`), so a set
with fewer shared keys links with nothing and is left out. T is the cheapest boundary by the number of subsets and list
entries that the histogram of all sizes gives; pairs across the boundary meet on the heavy lists.

Lists are scanned in these steps, none of which gives all pairs of a list.
1. Keys alone: which keys have two different sets. Each task sends at most the least and the largest set of a key for every
   HELD entries, so a frequent key is aggregated before the only shuffle of all entries. That shuffle is the
   largest on disk; it can be done in several parts of the key space.
2. The sets with enough of those keys are read again, once for each different set. The lists with one first member are
   one group from here on, so a family that meets on many lists is scanned about once.
3. Every member is compared to its group's first one. Components come from large-star and small-star steps over tables.
4. Groups of three or more that still hold several components: members of different components are compared in place, by
   blocks of BLOCK members, on signatures: counts of shingles by bucket, whose sum of differences is at most the number of
   differing shingles, so a pair beyond D can't link. Only pairs within D leave the task, each once, from the first group
   that both are in. Groups of more than SPLIT members are first cut by the parts of a second, independent hash, on which
   linked sets agree as well.
Every candidate is checked on the whole sets. Shingles are 64-bit hashes, sets 128-bit ones; equality of hashes stands for
equality.

Defined results: null texts and texts without words are empty sets: size 0, linked with nothing, their own component. Rows
with one doc_id and several texts are one row each; their component takes in all rows whose set is linked. A null doc_id
counts as larger than all others for component_id, and a component of null ids alone has a null one. near_components
returns its three columns only; one_of_each returns all columns of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import ceil, comb, exp
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, free_name, mix64, shingles, texts_of, tune, word_hashes

#: Largest size that may be light; beyond it subsets are too many.
MOST_LIGHT = 40
#: Hashed entries that a worker holds before it hands them on.
HELD = 1 << 18
#: Parts of the key space whose entries one_of_each shuffles one after the other; the texts are read once for each. Sets of a
#: lower least similarity list more parts, and so need more disk for them.
PASSES = 2
#: The filter of shared keys that goes to all tasks: bits of a key and for each key, and most bits of all; with more keys it
#: lets more through, and a join decides.
KEY_BITS, ROOM, FILTER_BITS = 4, 32, 1 << 29
#: Buckets of a signature; members of a group that are compared with each other in one task.
BUCKETS, BLOCK = 256, 256
#: Groups of more members are split by a second hash.
SPLIT = 4096
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _times(k: np.ndarray | list[int]) -> np.ndarray:
    return np.asarray(k, np.uint64) * _SALT[1]


def shared_least(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(a: int, light: int, percent: int) -> list[int]:
    """Sizes of shared subsets of a set of size a with its light partners."""
    low, high = -(-percent * a // 100), min(light, 100 * a // percent)
    return sorted({c for b in range(low, high + 1) if (c := shared_least(a, b, percent)) <= min(a, b)})


class Classes(NamedTuple):
    """Size classes by their upper ends: number of parts, most empty parts that a set does not list, and least number of
    listed parts on which linked sets of that class agree."""

    ends: np.ndarray
    parts: np.ndarray
    empty: np.ndarray
    need: np.ndarray


def size_classes(percent: int, upto: int) -> Classes:
    """Linked sets are in one class or in neighbouring ones, which are a quarter apart at least.

    Linked sets of a class differ in at most `apart` shingles, so of apart + 1 + spare parts they agree on 1 + spare. A few
    parts of a set are empty by chance; spare is beyond their usual number, so that sets need not list empty parts, which
    many unrelated sets share, and linked sets still agree on several listed ones. Small sets have too few shingles for
    that; they have two spare parts.
    """
    ends = [1]
    while len(ends) < 2 or ends[-2] < upto:  # the last one that is used has a next one
        ends.append(max(ends[-1] + 1, 100 * (ends[-1] + 1) // percent, 5 * ends[-1] // 4))
    rows = []
    for i, end in enumerate(ends):
        apart = (100 - percent) * 2 * end // (100 + percent)
        low = max(1, percent * ((ends[i - 1] if i else 0) + 1) // 100)  # the smallest set that is listed here
        spare = 2
        for _ in range(4):
            parts = apart + 1 + spare
            chance = parts * exp(-low / parts)
            spare = max(2, min(ceil(chance + 2 * chance**0.5) + 2, low // 2 - apart - 1))
        rows.append((apart + 1 + spare, max(2, spare - 2), min(spare - 1, 3)))
    return Classes(np.array(ends, np.int64), *(np.array(x, np.int64) for x in zip(*rows, strict=True)))


def classes_of(n: np.ndarray, ends: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each size, and whether sets of that size can link with larger ones of the next class."""
    own = np.searchsorted(ends, n)
    return own, 100 * n >= percent * (ends[own] + 1)


def costs(a: int, light: int, percent: int) -> tuple[int, int]:
    """Entries of a set of size a when light, and when heavy."""
    few = sum(comb(a, c) for c in subset_sizes(a, light, percent) if c < a or a > 1)
    classes = size_classes(percent, a)
    own, more = classes_of(np.array([a]), classes.ends, percent)
    k = int(own[0])
    return few, int(classes.parts[k : k + 1 + int(more[0])].sum())


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The light sets' largest size, by least entries. sizes: number of sets of each size up to MOST_LIGHT + a link."""

    def total(light: int) -> int:
        least = -(-percent * (light + 1) // 100)  # may link with heavy sets
        return sum(n * ((costs(a, light, percent)[0] if a <= light else 0) + (costs(a, light, percent)[1] if a >= least else 0)) for a, n in sizes.items())

    return min(range(MOST_LIGHT + 1), key=lambda t: (total(t), t))


@lru_cache(maxsize=256)
def _left_out(n: int, gone: int) -> np.ndarray:
    return np.array(list(combinations(range(n), gone)), np.int64)


def subset_keys(h: np.ndarray, light: int, percent: int) -> list[np.ndarray]:
    """A key of each fixed-size subset of a light set."""
    m = mix64(h ^ _SALT[0])
    whole, out = m.sum(dtype=np.uint64), []
    for c in subset_sizes(len(h), light, percent):
        gone = len(h) - c
        if gone == 0:
            sums = np.array([whole], np.uint64)
        elif gone == 1:
            sums = whole - m
        else:
            sums = whole - m[_left_out(len(h), gone)].sum(axis=1, dtype=np.uint64)
        out.append(mix64(sums + _times([c])))
    return out


def part_keys(sets: list[np.ndarray], classes: Classes, percent: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the listed parts of non-empty sets, and the set (its place in the list) of each key."""
    sizes = np.array([len(s) for s in sets], np.int64)
    own, more = classes_of(sizes, classes.ends, percent)
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for up in (0, 1):
        chosen = np.arange(len(sets)) if up == 0 else np.flatnonzero(more)
        if not len(chosen):
            continue
        h, n = np.concatenate([sets[i] for i in chosen]), sizes[chosen]
        cls = own[chosen] + up
        parts = classes.parts[cls]
        before = np.cumsum(parts) - parts
        of = np.repeat(np.arange(len(chosen)), n)
        shift = _times(cls + 1 + 1_000_003 * salt)
        slot = before[of] + (mix64(h + shift[of]) % parts[of].astype(np.uint64)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        filled, first = np.unique(slot[order], return_index=True)
        sums = np.zeros(int(parts.sum()), np.uint64)
        sums[filled] = np.add.reduceat(mix64(h ^ _SALT[2])[order], first)
        full = np.zeros(len(sums), bool)
        full[filled] = True
        owner = np.repeat(np.arange(len(chosen)), parts)
        empty = parts - np.bincount(owner[filled], minlength=len(chosen))
        listed = full | (empty > classes.empty[cls])[owner]
        place = (np.arange(len(sums)) - before[owner]).astype(np.uint64)
        keys.append(mix64(mix64(sums + shift[owner]) + place * _SALT[0])[listed])
        owners.append(chosen[owner[listed]])
    return np.concatenate(keys), np.concatenate(owners)


def list_keys(sets: list[np.ndarray], light: int, classes: Classes, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys (of subsets and of parts) of non-empty sets, and the set of each key."""
    least = -(-percent * (light + 1) // 100)
    heavy = [i for i, s in enumerate(sets) if len(s) >= least]
    keys, owners = part_keys([sets[i] for i in heavy], classes, percent) if heavy else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found, of = [keys], [np.array(heavy, np.int64)[owners]]
    for i, s in enumerate(sets):
        if len(s) <= light:
            own = subset_keys(s, light, percent)
            found += own
            of.append(np.full(sum(map(len, own)), i, np.int64))
    return np.concatenate(found), np.concatenate(of)


def needed(sets: list[np.ndarray], light: int, classes: Classes, percent: int) -> np.ndarray:
    """How many of its keys each set shares with a set that it links to, at least."""
    n = np.array([len(s) for s in sets], np.int64)
    own, more = classes_of(n, classes.ends, percent)
    need = np.where(more, np.minimum(classes.need[own], classes.need[own + 1]), classes.need[own])
    return np.where(n <= light, 1, need)


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    words, at = word_hashes(texts)
    return [np.unique(shingles(words[a:b], width)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def node_of(h: np.ndarray) -> bytes | None:
    """128 bits that name a set; none for the empty one."""
    if not len(h):
        return None
    sums = [int(mix64(h ^ s).sum(dtype=np.uint64)) ^ len(h) for s in _SALT[1:]]
    return b"".join(x.to_bytes(8, "big") for x in sums)


def signature(h: np.ndarray) -> np.ndarray:
    """Counts of shingles by bucket, at most 255."""
    return np.minimum(np.bincount((mix64(h + _SALT[0]) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)


def set_rows(docs: DataFrame, width: int, key: str | None = None) -> DataFrame:
    """doc_id, n, node of every document, and its column key (long)."""
    own = [key] if key else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(texts_of(batch.column(1)), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.binary()), *batch.columns[2:]], names=["doc_id", "n", "node", *own])

    return docs.select("doc_id", "text", *own).mapInArrow(run, "doc_id long, n long, node binary" + "".join(f", `{c}` long" for c in own))


class Join:
    """One join of the texts of docs. work holds its tables; rows: of set_rows."""

    def __init__(self, docs: DataFrame, rows: DataFrame, width: int, percent: int, work: Scratch, passes: int = 1) -> None:
        self.texts, self.width, self.percent, self.work, self.passes = docs.select("text"), width, percent, work, passes
        limit = 100 * (MOST_LIGHT + 1) // percent
        known = rows.where("node is not null")
        few = known.where(F.col("n") <= limit).select("node", "n").distinct()
        self.light = boundary({r.n: r.c for r in few.groupBy("n").agg(F.count("*").alias("c")).collect()}, percent)
        self.classes = size_classes(percent, known.agg(F.max("n").alias("n")).first().n or 1)
        self._read()

    def _fresh(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
        """Names and sets of each batch's texts; of copies in a task one, as far as it remembers them."""
        seen: set[bytes] = set()
        for batch in batches:
            names, sets = [], []
            for s in _sets(texts_of(batch.column(0)), self.width):
                name = node_of(s)
                if name is not None and name not in seen:
                    if len(seen) < HELD:
                        seen.add(name)
                    names.append(name)
                    sets.append(s)
            if sets:
                yield names, sets

    def __getstate__(self) -> dict:  # what the tasks need
        return {k: self.__dict__[k] for k in ("width", "percent", "light", "classes")}

    def shared_keys(self, at: int = 0, passes: int = 1) -> DataFrame:
        """Keys with two different sets, of those that are `at` modulo passes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys: list[np.ndarray] = []
            names: list[np.ndarray] = []
            held = 0

            def handed() -> pa.RecordBatch:
                k, u = np.concatenate(keys).view(np.int64), np.concatenate(names)
                order = np.lexsort((u, k))
                k, u = k[order], u[order]
                new = np.concatenate(([True], k[1:] != k[:-1]))
                ends = new | np.concatenate((new[1:], [True]))  # a key's least and largest set
                return pa.RecordBatch.from_arrays([pa.array(k[ends]), pa.array(u[ends])], names=["key", "u"])

            for own, sets in self._fresh(batches):
                found, of = list_keys(sets, self.light, self.classes, self.percent)
                here = found % np.uint64(passes) == np.uint64(at)
                found, of = found[here], of[here]
                keys.append(found)
                names.append(np.array([int.from_bytes(x[:8], "big", signed=True) for x in own], np.int64)[of])
                held += len(found)
                if held >= HELD:
                    yield handed()
                    keys, names, held = [], [], 0
            if held:
                yield handed()

        entries = self.texts.mapInArrow(run, "key long, u long").repartition("key")
        return entries.groupBy("key").agg(F.min("u").alias("low"), F.max("u").alias("high")).where("low <> high").select("key")

    def listed(self, bits: int, words: np.ndarray) -> DataFrame:
        """id, node, n, need, sig, keys, s of the different sets that have as many keys in the filter as a link needs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for names, sets in self._fresh(batches):
                keys, of = list_keys(sets, self.light, self.classes, self.percent)
                hit = np.ones(len(keys), bool)
                for k in range(KEY_BITS):
                    at = (keys >> np.uint64(8 * k)) & np.uint64(bits - 1)
                    hit[hit] = (words[(at[hit] >> np.uint64(6)).astype(np.int64)] >> (at[hit] & np.uint64(63)) & np.uint64(1)).astype(bool)
                keys, of = keys[hit].view(np.int64), of[hit]
                order = np.argsort(of, kind="stable")
                keys, counts = keys[order], np.bincount(of, minlength=len(sets))
                ends = np.concatenate(([0], np.cumsum(counts)))
                need = needed(sets, self.light, self.classes, self.percent)
                some = np.flatnonzero(counts >= need)
                for a in range(0, len(some), 64):  # sets of a long text's size
                    part = some[a : a + 64]
                    yield pa.RecordBatch.from_pydict({
                        "node": pa.array([names[i] for i in part], pa.binary()), "n": pa.array([len(sets[i]) for i in part], pa.int64()),
                        "need": pa.array(need[part], pa.int64()), "sig": pa.array([signature(sets[i]).tobytes() for i in part], pa.binary()),
                        "keys": pa.array([keys[ends[i] : ends[i + 1]] for i in part], pa.list_(pa.int64())), "s": pa.array([sets[i].tobytes() for i in part], pa.binary()),
                    })

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            first = TaskContext.get().partitionId() << 40
            for batch in batches:
                new = []
                for x in batch.column(0).to_pylist():
                    new.append(x not in seen)
                    seen.add(x)
                kept = batch.filter(pa.array(new, pa.bool_()))
                ids = np.arange(first, first + kept.num_rows)
                first += kept.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *kept.columns], names=["id", *kept.schema.names])

        kinds = "node binary, n long, need long, sig binary, keys array<long>, s binary"
        return self.texts.mapInArrow(run, kinds).repartition("node").mapInArrow(once, f"id long, {kinds}")

    def _read(self) -> None:
        """info: the different sets that share keys. groups: key, id, c of the members of all lists with one first member."""
        keys = reduce(DataFrame.unionAll, [self.work.keep(self.shared_keys(at, self.passes), "keys") for at in range(self.passes)])
        n = keys.count()
        bits = min(FILTER_BITS, max(1 << 16, 1 << (ROOM * n - 1).bit_length()))
        at = F.array(*[F.shiftrightunsigned("key", 8 * k).bitwiseAND(F.lit(bits - 1)) for k in range(KEY_BITS)])
        one = F.expr("shiftleft(1L, cast(b & 63 as int))")
        set_bits = keys.select(F.explode(at).alias("b")).groupBy(F.shiftrightunsigned("b", 6).alias("w")).agg(F.bit_or(one).alias("x")).toArrow()  # at most bits / 64 words
        words = np.zeros(bits // 64, np.uint64)
        words[set_bits.column("w").to_numpy()] = set_bits.column("x").to_numpy().view(np.uint64)
        self.info = self.work.keep(self.listed(bits, words), "sets")
        entries = kept = self.work.keep(self.info.select("id", "need", F.explode("keys").alias("key")).join(keys, "key"), "entries")
        for _ in range(2):  # sets that are left with too few keys go, and the keys that are then left with one set
            shared = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
            entries = entries.join(shared, "key")
            enough = entries.groupBy("id").agg(F.count("*").alias("c"), F.min("need").alias("least")).where("c >= least").select("id")
            left = self.work.keep(entries.join(enough, "id"), "entries")
            self.work.drop(kept)
            entries = kept = left
        self.groups = self.grouped(entries)
        self.work.drop(entries)

    def grouped(self, lists: DataFrame) -> DataFrame:
        """key (a list's first member), id, c (members): lists of several members, those with one first member together."""
        first = lists.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("least")).where("c > 1").select("key", "least")
        groups = self.work.keep(lists.join(first, "key").select(F.col("least").alias("key"), "id").distinct(), "members")
        return self.work.keep(groups.join(groups.groupBy("key").agg(F.count("*").alias("c")), "key"), "groups")

    def checked(self, pairs: DataFrame, signed: bool = False) -> DataFrame:
        """The pairs (a, b) that link; signed: their signatures have been compared."""
        percent = self.percent

        def sides(column: str) -> tuple[DataFrame, DataFrame]:
            return tuple(self.info.select(F.col("id").alias(e), F.col("n").alias(f"n{e}"), F.col(column).alias(f"x{e}")) for e in "ab")

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    p, q = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for i in (4, 5))
                    apart = np.abs(p - q).sum(axis=1, dtype=np.int64)
                    both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                    yield batch.select([0, 1]).filter(pa.array((100 + percent) * apart <= (100 - percent) * both))

        def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(4), batch.column(5), strict=True):
                    p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        def kept(pairs: DataFrame, column: str, test) -> DataFrame:
            left, right = sides(column)
            both = pairs.join(right, "b").join(left, "a").where((F.least("na", "nb") * 100) >= F.greatest("na", "nb") * percent)
            return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(test, "a long, b long")

        if not signed:
            pairs = self.work.keep(kept(pairs, "sig", close), "close")
        return self.work.keep(kept(pairs, "s", linked), "links")

    def split(self, groups: DataFrame, salt: int) -> DataFrame:
        """key, id: lists of members of a group with the same part by another hash; linked ones meet on one."""
        percent, classes = self.percent, self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    keys, of = part_keys([np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()], classes, percent, salt)
                    old = batch.column(0).to_numpy().view(np.uint64)[of]
                    yield pa.RecordBatch.from_arrays([pa.array(mix64(old * _SALT[1] + keys).view(np.int64)), batch.column(1).take(pa.array(of))], names=["key", "id"])

        return groups.select("key", "id").join(self.info.select("id", "s"), "id").select("key", "id", "s").mapInArrow(run, "key long, id long")

    def compared(self, groups: DataFrame) -> DataFrame:
        """Pairs (a, b) of members of a group with different roots, whose signatures are close enough; each once, from the
        first group that both are in. groups: key, id, root, c."""
        percent = self.percent
        blocks = F.ceil(F.col("c") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
        on = groups.groupBy("id").agg(F.collect_list("key").alias("keys"))
        signed = groups.join(self.info.select("id", "n", "sig").join(on, "id"), "id").withColumn("blocks", blocks).withColumn("own", own)
        sent = signed.select("key", "id", "root", "n", "sig", "own", "keys", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        pair = sent.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "root", "n", "sig", "own", "keys")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list] = []
            now = None

            def found() -> Iterator[pa.RecordBatch]:
                (key, i, j), m = now, len(held)
                ids, roots, n, own = (np.array([x[k] for x in held], np.int64) for k in (0, 1, 2, 4))
                sig = np.frombuffer(b"".join(x[3] for x in held), np.uint8).reshape(m, BUCKETS).astype(np.int16)
                names, of, count = np.unique(roots, return_inverse=True, return_counts=True)
                if len(names) < 2:
                    return
                main = (count[of] == count.max()) & (count.max() * 2 > m)  # members of a component of more than half
                for x in np.flatnonzero(~main):
                    y = np.flatnonzero((roots != roots[x]) & ((ids > ids[x]) | main) & ((own != own[x]) if i != j else True))
                    y = y[(100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
                    if len(y):
                        apart = np.abs(sig[y] - sig[x]).sum(axis=1, dtype=np.int64)
                        y = y[(100 + percent) * apart <= (100 - percent) * (n[y] + n[x])]
                        y = y[[min(held[x][5] & held[k][5]) == key for k in y]] if len(y) else y
                        if len(y):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[y], ids[x])), pa.array(np.maximum(ids[y], ids[x]))], names=["a", "b"])

            for batch in batches:
                for key, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now != (key, i, j):
                        if held:
                            yield from found()
                        now, held = (key, i, j), []
                    rest[5] = frozenset(rest[5])
                    held.append(rest)
            if held:
                yield from found()

        ordered = pair.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return ordered.mapInArrow(scan, "a long, b long")

    def contested(self, groups: DataFrame, roots: DataFrame) -> DataFrame:
        """key, id, root, c of the groups in several components."""
        placed = groups.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "c", F.coalesce("root", "id").alias("root"))
        apart = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
        return self.work.keep(placed.join(apart, "key"), "contested")

    def cut_to_size(self, groups: DataFrame) -> DataFrame:
        """The groups, the larger ones cut by another hash."""
        large = groups.where(F.col("c") > SPLIT)
        if large.isEmpty():
            return groups
        finer = self.grouped(self.work.keep(self.split(large, 1), "finer"))
        finer = finer.join(large.select("id", "root").distinct(), "id").select("key", "id", "root", "c")
        return self.work.keep(groups.where(F.col("c") <= SPLIT).select("key", "id", "root", "c").unionAll(finer), "cut")

    def roots(self) -> DataFrame:
        """node, root: names of the sets that link, and of their components."""
        tried = self.groups.where("id <> key").select(F.col("key").alias("a"), F.col("id").alias("b"))
        links = self.checked(tried)
        roots = self.work.keep(components(links, self.work), "roots")
        left = self.contested(self.groups.where("c > 2"), roots)  # of two members both have been compared
        if not left.isEmpty():
            more = self.work.keep(self.compared(self.cut_to_size(left)).join(tried, ["a", "b"], "left_anti"), "more")
            found = self.checked(more, signed=True)
            if not found.isEmpty():
                roots = self.work.keep(components(links.unionAll(found), self.work), "roots")
        names = self.info.select("id", "node")
        named = roots.withColumnRenamed("node", "id").join(names, "id").select("node", "root")
        return named.join(names.select(F.col("id").alias("root"), F.col("node").alias("name")), "root").select("node", F.col("name").alias("root"))

    def links(self) -> DataFrame:
        """a, b: names of the two sets of every link."""
        groups = self.cut_to_size(self.groups.select("key", "id", F.col("id").alias("root"), "c"))
        links = self.checked(self.work.keep(self.compared(groups), "pairs"), signed=True)
        one, two = (self.info.select(F.col("id").alias(e), F.col("node").alias(f"n{e}")) for e in "ab")
        return links.join(one, "a").join(two, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """node, root: smallest node reachable, for all nodes of links (a, b), by large-star and small-star steps."""
    stars = work.keep(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "stars")
    mark = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    before = None
    while (now := mark(stars)) != before:
        before = now
        both = stars.select("u", "v").unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).where("u <> v").distinct()
        large = work.keep(large, "large")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("u <> v").distinct()
        stars = work.keep(small, "stars")
    roots = stars.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionAll(roots.select("root", "root").distinct().toDF("node", "root"))


def rooted(docs: DataFrame, width: int, percent: int, key: str | None = None, passes: int = 1) -> DataFrame:
    """doc_id, n, root (name of the component; none for empty sets) of every row, and its column key."""
    tune(docs.sparkSession)
    with Scratch(docs.sparkSession) as work:
        rows = work.keep(set_rows(docs, width, key), "rows")
        roots = Join(docs, rows, width, percent, work, passes).roots()
        own = [key] if key else []
        known = rows.where("node is not null").join(roots, "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("root"), *own)
        empty = rows.where("node is null").select("doc_id", "n", F.col("node").alias("root"), *own)
        return work.result(known.unionAll(empty), "named")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every document."""
    named = rooted(docs, width, percent)
    known = named.where("root is not null")
    least = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = known.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionAll(named.where("root is null").select("doc_id", "n", "doc_id"))


def near_links(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """a, b (a < b) of all links between distinct sets, named as set_rows names them: every pair of a list is compared, in one
    component or not. Near copies of one another give all their pairs, so this grows with the square of such a family."""
    tune(docs.sparkSession)
    with Scratch(docs.sparkSession) as work:
        rows = work.keep(set_rows(docs, width), "rows")
        return work.result(Join(docs, rows, width, percent, work).links(), "near")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, by rows: that with the smallest doc_id (null is the largest, of repeated ids any
    one row). Rows with empty sets stay. A row is known by its doc_id and a 64-bit hash of its text, of rows alike in both one
    stays, so no copy of docs is written; it is read several times and has to give the same rows each time."""
    key, id_, none, every, place = names = [free_name(docs, f"row_{c}") for c in ("key", "id", "none", "every", "place")]
    keyed = docs.withColumn(key, F.xxhash64("text"))
    named = rooted(keyed, width, percent, key, PASSES)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(key).alias("k")))
    kept = named.where("root is not null").groupBy("root").agg(first.alias("x")).select("x.doc_id", F.col("x.k").alias(key), F.lit(False).alias(every))
    kept = kept.unionAll(named.where("root is null").select("doc_id", key, F.lit(True)).distinct())
    on = [id_, none, key]  # no nulls, so one shuffle by them serves the join and the window
    row = {id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), none: F.col("doc_id").isNull()}
    rows = keyed.withColumns(row).join(kept.withColumns(row).drop("doc_id"), on)
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(*on).orderBy(F.lit(0))))
    return rows.where(F.col(every) | (F.col(place) == 1)).drop(*names)


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=90)
