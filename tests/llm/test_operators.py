"""Edge cases and brute-force comparisons of the training-data operators."""

import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe, chat, fingerprint, jaccard, mixing, quality, token_file, topk, toxicity, warc

ODD = [(1, "a b c d e f"), (2, None), (3, ""), (4, " \t "), (5, "a b c d e f"), (5, "a b c d e f"), (None, "x"), (6, "w " * 30000), (7, "one"), (8, "ONE")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, score string")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return {rows[i][0]: (len(sets[i]), min(rows[j][0] for j in range(len(rows)) if label[j] == label[i])) for i in range(len(rows))}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, width, percent):
    rng = np.random.default_rng(1)
    rows = []
    for size in [1, 2, 5, 9, 12, 20, 25, 31, 45, 80, 300]:
        base = [f"w{x}" for x in rng.integers(0, 10**6, size)]
        for k in range(7):
            words = list(base)
            for at in rng.integers(0, size, k // 2):
                words[at] = "changed"
            rows.append((len(rows), " ".join(words[: max(1, size - k % 3)])))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A B c d"), (1004, "a b C D")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(docs(spark, rows), width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_join_of_odd_rows(spark):
    got = jaccard.near_components(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id == 5} == {1}
    assert jaccard.near_components(docs(spark, [])).count() == 0
    assert jaccard.one_of_each(docs(spark, [(1, "a"), (2, "a"), (3, None)])).count() == 2


def test_bpe_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, lib = bpe.ByteBpe(path), Tokenizer.from_file(path)
    for text in ["", "hello  world\n\n x", "a<|endoftext|>b", "x" * 20000, "é\U0001f600 'll 12٣", "\x1c \x85 z", "ab" * 9999]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False) == text


def test_bpe_of_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.tokenized(docs(spark, ODD), path).count() == len(ODD)
    assert bpe.tokenized(docs(spark, []), path).count() == 0


def test_codes_give_each_token():
    ids = np.random.default_rng(2).integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32) >> np.random.default_rng(3).integers(0, 32, 5000).astype(np.uint32)
    f = token_file.TokenFile(token_file.image_of(3, 1, [7, None], [ids[:1234], ids[1234:]]))
    assert [f.token(i) for i in range(len(ids))] == ids.tolist()
    assert (f.slice(1200, 4321) == ids[1200:4321]).all() and len(f.slice(5, 5)) == 0
    assert f.starts.tolist() == [0, 1234, 5000]


def test_token_files_of_odd_rows(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_file.write_tokens(docs(spark, ODD), path, 2, f"{tmp_path}/t")
    got = sorted(token_file.read_tokens(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    assert len(got) == len(ODD) and got[0].doc_id is None
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    token_file.write_tokens(docs(spark, []), path, 2, f"{tmp_path}/none")


def test_top_k_breaks_ties_by_id(spark):
    rows = [(i, [0.5, float(i % 3)]) for i in range(200)] + [(200, None), (201, [float("nan"), 1.0]), (202, [None, 1.0]), (203, []), (None, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), topk.F.col("id") % 50 == 0).collect()
    ints = {i: [int(256 * x) for x in v] for i, v in rows[:200]}
    want = {(q, n + 1, i, -s) for q in range(0, 200, 50) for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), topk.F.col("id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(few, topk.F.col("id") % 50 == 0).count() == 1


def test_mixing_stays_within_a_block(spark):
    rows = [(i, "t", "a" if i % 3 else None, "q") for i in range(400)] + [(None, None, "b", "q")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string")
    got = mixing.mix(df, {"a": 5, "b": 2}, block_rows=2).collect()
    assert len(got) == len(rows)
    weights, total = {"a": 5, "b": 2, None: 1}, 8
    blocks = {(r.source, r.block): r.slot for r in got}
    assert len(set(blocks.values())) == len(blocks)
    for (source, j), slot in blocks.items():
        w = weights[source]
        assert j * total // w <= slot < -(-(j + 1) * total // w)
    assert mixing.mix(df.where("false")).count() == 0


def test_chat_reads_back(spark):
    said = "\\### Assistant: </turn> <turn>x\\l\\n ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "us\ner", None), (2, 0, None, None), (None, 0, "assistant", "a")]
    got = chat.format_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = got.select("conv_id", "example", chat.read_turns(got["formatted"]).alias("t"), chat.loss_text(got).alias("loss")).collect()
    last = max((r for r in back if r.conv_id == 1), key=lambda r: r.example)
    assert [(x.role, x.text) for x in last.t] == [("user", said), ("assistant", said), ("us\ner", "")]
    assert [r.loss for r in back if r.conv_id == 1] == [said, ""]


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "u", "<p>"), (2, "u\n", "<p>"), (3, None, None), (4, "x", ""), (None, "y", "é" * 300000), (5, "z", "only")]
    warc.write_archive(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha int"), f"{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_archive(spark, f"{tmp_path}/w").collect()}
    assert len(got) == 6 and got[1].refers_to == 2 and got[3].refers_to == 4 and got[2].record_type == "response"
    assert got[None].payload_bytes == 600000


def test_fingerprints_of_odd_rows(spark):
    a, b = fingerprint.sketches([b"a b c d e f g", b""])
    assert fingerprint.resemblance(a, a) == 1 and fingerprint.resemblance(a, b) == 0 and fingerprint.resemblance(b, b) == 1


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_scores_of_odd_rows(spark, which):
    rng = np.random.default_rng(4)
    bad, good = ["zzz qqq kkk", "the fine day"]
    samples = [(int(k % 2), " ".join([good, bad][k % 2] if rng.random() < 0.5 else "some words" for _ in range(20)).encode()) for k in range(80)]
    module, score = (quality, quality.score_quality) if which == "quality" else (toxicity, toxicity.score_toxicity)
    got = score(docs(spark, ODD), module.train(samples)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert score(docs(spark, []), module.train([])).count() == 0
