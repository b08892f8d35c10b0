"""The shingle join on families of near copies, shared passages and small blocks, against brute force."""

import re

import duckdb
import numpy as np
import pytest

from gridloom.llm import jaccard

SF = "/root/testdata/sf0.001"


def shingle_sets(texts, width):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def brute(rows, width, percent):
    """n and the least id of the component of each row, over the pairs that share a shingle."""
    sets = shingle_sets([t for _, t in rows], width)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    seen = {}
    for i, s in enumerate(sets):
        for x in s:
            seen.setdefault(x, []).append(i)
    pairs = {(a, b) for at in seen.values() for a in at for b in at if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            label[root(b)] = root(a)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows)))


def corpus(seed=3):
    """Families with random edits around the threshold, and texts that share a passage or are little else."""
    rng, rows = np.random.default_rng(seed), []
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    passage = word(60)
    for size, copies, edits in [(120, 45, 4), (60, 30, 3), (200, 30, 9), (25, 30, 2), (8, 15, 1)]:
        base = word(size)
        for _ in range(copies):
            words = list(base)
            for at in rng.integers(0, size, rng.integers(0, edits + 1)):
                words[at] = word(1)[0]
            rows.append((len(rows), " ".join(words)))
    for k in range(60):
        rows.append((len(rows), " ".join(word(k % 40) + passage + word(k % 7))))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \t", rows[0][1], rows[0][1], "one", "ONE", "one two"])]
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("small", [False, True])
def test_components_equal_brute_force(spark, monkeypatch, width, percent, small):
    if small:  # many blocks, lists that are split, entries handed on often, a filter that lets most through
        for name, value in (("BLOCK", 12), ("SPLIT", 30), ("HELD", 512), ("FILTER_BITS", 1 << 6)):
            monkeypatch.setattr(jaccard, name, value)
    rows = corpus()
    got = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, width, percent)
    assert len({r.component_id for r in got}) < len(rows) - 60


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert sorted(tuple(r) for r in jaccard.op5_jaccard(spark, SF).collect()) == brute(rows, 3, 90)


def test_linked_sets_share_as_many_keys_as_needed():
    rng = np.random.default_rng(8)
    for percent in (80, 90):
        classes = jaccard.size_classes(percent, 3000)
        for n in [*range(1, 60), 75, 76, 100, 101, 160, 333, 1000, 3000]:
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            gone = n - -(-percent * n // 100)  # as many as a subset that links can lack
            least = jaccard.shared_least(n, n, percent)
            other = np.unique(np.concatenate((a[:least], rng.integers(0, 1 << 63, n - least).astype(np.uint64))))
            for b in (a[gone:], other):
                if not len(b) or len(b) == n and (a == b).all():
                    continue
                for light in (0, 12):
                    keys, of = jaccard.list_keys([a, b], light, classes, percent)
                    shared = len(set(keys[of == 0].tolist()) & set(keys[of == 1].tolist()))
                    assert shared >= 1
                    if n > light:
                        assert shared >= jaccard.needed([a, b], light, classes, percent).max()
                keys, of = jaccard.part_keys([a, b], classes, percent, 2)
                assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())


def test_input_columns_may_clash(spark):
    rows = [(1, "a b c d e f", 1, "x", 2), (2, "a b c d e f", 3, "y", 4), (3, None, 5, "z", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, root string, row_key int")
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
    assert jaccard.near_components(docs).columns == ["doc_id", "n_shingles", "component_id"]
