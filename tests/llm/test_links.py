"""All verified links of the shingle join, against brute force."""

import re

import numpy as np
import pytest

from gridloom.llm import jaccard


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_links_equal_brute_force(spark, width, percent):
    rng, rows = np.random.default_rng(5), []
    for size in [3, 9, 25, 45, 80, 300]:
        base = [f"w{x}" for x in rng.integers(0, 10**6, size)]
        for k in range(7):
            words = list(base)
            words[-1 - k % 3] = f"end{k}"
            rows.append((len(rows), " ".join(words)))
    rows += [(500, rows[-1][1]), (501, None), (502, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        words = re.findall(r"\S+", t or "")
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    want = {frozenset((frozenset(x), frozenset(y))) for x in sets.values() for y in sets.values() if x != y and x and y and 100 * len(x & y) >= percent * len(x | y)}
    named = {bytes(r.node): frozenset(sets[r.doc_id]) for r in jaccard.set_rows(docs, width).collect() if r.node}
    got = [frozenset((named[bytes(r.a)], named[bytes(r.b)])) for r in jaccard.near_links(docs, width, percent).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 21
