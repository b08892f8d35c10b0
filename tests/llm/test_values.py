"""Queries against brute force on whole small tables, and results that must not depend on pieces, blocks or names."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import bpe, chat, fingerprint, mixing, quality, token_file, topk, toxicity, warc, words
from gridloom.llm.catalogue import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def rows_of(table, columns, sf=SF):
    return duckdb.sql(f"select {columns} from '{sf}/{table}.parquet'").fetchall()


def five_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def library(name):
    out = Tokenizer.from_file(public_tokenizers.path(name))
    out.no_truncation()
    out.no_padding()
    return out


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries()[name](spark, SF)
    order = sorted(got.columns)
    want = con.sql(oracle_sql()[name]).project(",".join(f'"{c}"' for c in order)).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*order).collect())


def test_fingerprint_query_equals_brute_force(spark):
    docs = sorted(rows_of("documents", "doc_id, coalesce(text, '')"), reverse=True)
    got = {r.doc_id: r for r in queries()["op2_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for k, (i, text) in enumerate(docs):
        other = docs[(k + 1) % len(docs)][1]
        edited = text[: len(text) - len(text) // 3] + other[: len(text) // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for found, s in ((r.near_edited, five_words(edited)), (r.near_next, five_words(other))):
            exact = likeness(five_words(text), s)
            few = len(five_words(text) | s) <= fingerprint.SIZE
            assert found == pytest.approx(exact) if few else abs(found - exact) < 0.15
        by_text.setdefault(text, set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len({x.pop() for x in by_text.values()}) > 100


def test_neighbours_of_odd_rows(spark):
    def made(ids, texts, following):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"i": pa.array(ids, pa.int64()), "a": pa.array(texts, pa.string()), "b": pa.array(following, pa.string())})

    run = lambda rows: sorted(map(str, fingerprint.with_next(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, key int"), made, "i long, a string, b string").collect()))
    assert run([]) == []
    assert run([(1, "x")]) == ["Row(i=1, a='x', b='x')"]
    got = run([(3, "c"), (1, "a"), (None, "n"), (3, "b"), (2, None)])
    assert got == sorted(["Row(i=3, a='b', b='c')", "Row(i=3, a='c', b='')", "Row(i=2, a='', b='a')", "Row(i=1, a='a', b='n')", "Row(i=None, a='n', b='b')"])


def test_neighbours_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 7)

    def made(ids, texts, following):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"i": pa.array(ids, pa.int64()), "b": pa.array(following, pa.string())})

    rows = [(i * 7 % 211, f"t{i * 7 % 211}") for i in range(211)]
    got = {r.i: r.b for r in fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string"), made, "i long, b string").collect()}
    assert got == {i: f"t{(i - 1) % 211}" for i in range(211)}


def test_fingerprints_merge(spark):
    rng = np.random.default_rng(2)
    parts = [[" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for n in sizes] for sizes in ([900, 700, 20], [3], [0, 40], [0])]
    rows = [(k if k else None, t, 1) for k, texts in enumerate(parts) for t in texts]
    docs = spark.createDataFrame(rows, "k long, text string, h int")
    got = {r.k: r.fingerprint for r in fingerprint.merge_fingerprints(fingerprint.fingerprint_documents(docs), ["k"]).collect()}
    for k, texts in enumerate(parts):
        want = np.zeros(0, np.uint64)
        for s in fingerprint.sketches([t.encode() for t in texts]):
            want = fingerprint.merge(want, s)
        assert got[k if k else None] == fingerprint.to_text(want)
        assert np.array_equal(fingerprint.from_text(got[k if k else None]), want)
    one = fingerprint.fingerprint_documents(docs)
    assert sorted(map(str, fingerprint.merge_fingerprints(one, ["text"]).collect())) == sorted(map(str, one.select("text", "fingerprint").distinct().collect()))


def test_estimates_are_near(spark):
    rng = np.random.default_rng(6)
    shared = [f"s{x}" for x in rng.integers(0, 10**8, 3000)]
    a, b = " ".join(shared), " ".join(shared[:1500] + [f"b{x}" for x in rng.integers(0, 10**8, 1500)])
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = fingerprint.fingerprint_documents(fingerprint.fingerprint_documents(df, "a", "fa"), "b", "fb")
    r = df.select(fingerprint.resemblance_of("fa", "fb").alias("r"), fingerprint.containment_of("fa", "fb").alias("c"), fingerprint.distinct_of("fa").alias("d")).first()
    assert abs(r.r - 1 / 3) < 0.12 and abs(r.c - 0.5) < 0.15 and abs(r.d / 2996 - 1) < 0.25


def test_bpe_query_equals_the_library(spark):
    lib = library("byte_bpe_50k.json")
    got = {r.doc_id: r for r in queries()["op6_bpe"](spark, SF).collect()}
    for i, text in rows_of("documents", "doc_id, coalesce(text, '')"):
        ids = lib.encode(text, add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), digest, hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert len(got) == len(rows_of("documents", "doc_id"))


EVERY = " ".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
ODD_TEXTS = ["", " ", "x  \n y", "a<|endoftext|>b <|startoftext|>", "x" * 20000, "we'll 'S 's's''s a'm", "x'", "'", "1234 a1b2", "Σ ΑΣ İI é", "a b " * 300000, "q" * 600000, " " * 530000, EVERY, EVERY.replace(" ", "")]


def test_word_splitting_equals_the_library():
    own, lib = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    assert [x.tolist() for x in own.encode_all(ODD_TEXTS)] == [x.ids for x in lib.encode_batch(ODD_TEXTS, add_special_tokens=False)]
    codes, lib = token_file.LibraryCodes(public_tokenizers.path("word_bpe_49k.json")), library("word_bpe_49k.json")
    assert [x.tolist() for x in codes.encode_all(ODD_TEXTS)] == [x.ids for x in lib.encode_batch(ODD_TEXTS, add_special_tokens=False)]


def test_trees_together_equal_trees_alone(monkeypatch):
    own = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    some = ["".join(rng.choice(list("abthein é\n"), n)) for n in [0, 1, 2, 3, 4, 5, 8, 9, 16, 17, 33, 64, 65, 127, 128, 129, 400] for _ in range(20)]
    want = [own.merge(w.encode()) for w in some]
    assert [list(map(int, x)) for x in own.merge_all(some)] == want
    monkeypatch.setattr(bpe, "LEAVES", 64)
    assert [list(map(int, x)) for x in own.merge_all(some)] == want
    monkeypatch.setattr(words, "MOST_WORDS", 3)  # a cache that forgets
    assert [x.tolist() for x in own.encode_all(some)] == [own.encode(t) for t in some]


def test_token_file_query_equals_the_library(spark):
    lib, start = library("word_bpe_49k.json"), 0
    got = {r.doc_id: tuple(r) for r in queries()["op7_token_file"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    docs = sorted(rows_of("documents", "doc_id, coalesce(text, '')"))
    for i, text in docs:
        ids = [*lib.encode(text, add_special_tokens=False).ids, 2]
        assert got[i] == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_empty_token_folder_reads_as_no_rows(spark, tmp_path):
    token_file.write_tokens(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), 2, f"{tmp_path}/none")
    assert token_file.read_tokens(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.97), ("op8_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries()[name](spark, sf).collect()}
    assert len(got) == len(rows_of("documents", "doc_id", sf)) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    fold = (3, 1) if label == "quality" else (5, 0)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % fold[0] == fold[1]) for i, r in got.items())
    known = [(i, y) for i, y in rows_of("labels", f"doc_id, {label}", sf) if got[i].held_out]
    assert len(known) > 50 and np.mean([got[i].predicted == y for i, y in known]) >= least
    assert np.mean([got[i].predicted for i, y in known if y == 0] or [0]) < 0.2


def small_model():
    rng = np.random.default_rng(4)
    bad, good = ["zzz qqq kkk", "the fine day"]
    return toxicity.train([(int(k % 2), " ".join([good, bad][k % 2] if rng.random() < 0.5 else "some words" for _ in range(20)).encode()) for k in range(80)], epochs=1)


@pytest.mark.parametrize("text", [b"zzz some day qqq " * 9000, b"one " + b"x" * 200000 + b" zzz qqq kkk " * 30, b"a " * 200000, b"\xc3\xa9" * 150000, b" " * 300000, b"fine " * 60000 + b"zzz"])
def test_toxicity_does_not_depend_on_pieces(monkeypatch, text):
    model = small_model()
    whole = model.logits(text)
    monkeypatch.setattr(toxicity, "PIECE", 1 << 22)
    want = model._some([text])[0]
    got = np.concatenate(list(model.logits(text)))
    assert got.max() == pytest.approx(want, abs=1e-4)
    monkeypatch.setattr(toxicity, "PIECE", 1 << 17)
    assert max(x.max() for x in whole) == pytest.approx(want, abs=1e-4)
    h, before, _, _ = toxicity.read_words([text])
    assert sum(len(x) for x in model.logits(text)) == len(toxicity.windows(before)[0])


def test_learning_sees_the_middle_of_long_texts():
    rng = np.random.default_rng(9)
    plain = lambda n: [f"w{x}" for x in rng.integers(0, 200, n)]
    long = [(1, " ".join(plain(1500) + ["zzz", "qqq", "kkk"] * 6 + plain(1500)).encode()) for _ in range(20)]
    clean = [(0, " ".join(plain(3000)).encode()) for _ in range(20)]
    model = toxicity.train(long + clean, epochs=3)
    scores = model.score([" ".join(plain(40) + ["zzz", "qqq", "kkk"] * 6).encode(), " ".join(plain(60)).encode()])
    assert scores[0] > 0.5 > scores[1]


def test_quality_of_long_texts_is_that_of_all_chunks():
    rng = np.random.default_rng(3)
    model = quality.train([(k % 2, bytes(rng.choice(list([b"abc de", b"!?#0 1"][k % 2]), 600).tolist())) for k in range(40)], steps=30)
    text = bytes(rng.integers(32, 127, (1 << 19) + 12345).astype(np.uint8))
    pooled = quality._pool(model.p, quality._chunks(text)).mean(axis=0)
    hidden = np.maximum(pooled @ model.p["w1"] + model.p["b1"], 0)
    assert model.score([text])[0] == pytest.approx(float(1 / (1 + np.exp(-(hidden @ model.p["w2"] + model.p["b2"])[0]))), abs=1e-4)


def brute_top(rows, k=5):
    held = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    ints = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows}
    return {(q, n + 1, i, -s) for q in ints if q % 50 == 0 for n, (s, i) in enumerate(sorted((-held(sum(a * b for a, b in zip(ints[q], v))), i) for i, v in ints.items() if i != q)[:k])}


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(120)] + [(120, [1e30, 1.0, 0.0, 0.0]), (150, [-1e30, 2.0, 0.5, 1e10]), (151, [3e6, 3e6, -3e6, 1.0]), (200, [1e14, 1e14, 1e14, 1e14])]
    rows += [(201, [float("inf"), 0.0, 0.0, 0.0]), (202, [1e308, 0.0, 0.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), topk.F.col("id") % 50 == 0).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute_top(rows[:-2])


def test_top_k_over_blocks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 9)
    monkeypatch.setattr(topk, "BINS", 32)
    rng = np.random.default_rng(7)
    rows = [(i * 10, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(120)]
    df = spark.createDataFrame([*rows, *rows[:6:5]], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.where("vec_id > 60 or vec_id < 0").unionByName(df.where("vec_id <= 60 and vec_id >= 0").distinct()), topk.F.col("id") % 50 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_top(rows)


def test_mixing_keeps_columns_named_as_its_own(spark):
    names = ["mix_hash", "mix_bucket", "mix_offset", "mix_source", "mix_place", "pf_s", "pf_w", "pf_at", "pf_source", "pf_weight", "mix_bucket_b", "pf_sw"]
    docs = spark.createDataFrame([(i, "t", "ab"[i % 2], *(f"{n}{i}" for n in names)) for i in range(30)], ["doc_id", "text", "source", *names])
    got = mixing.mix(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert sorted(map(tuple, got.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 10**9})


def test_archive_gives_any_record(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (1 + i * 400)) for i in range(60)]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    images = [r.content for r in warc.read_files(spark, f"{tmp_path}/w").collect()]
    found = {i: r for image in images for i in range(60) if (r := warc.BundleReader(image).find(f"urn:gridloom:page:{i}".encode()))}
    assert len(found) == 60 and any(len(warc.BundleReader(x).at) > 2 for x in images)
    for i, url, html in rows:
        r = warc.parse(found[i])
        assert r["warc-target-uri"] == url and r["block"].endswith(html.encode())
    assert warc.BundleReader(images[0]).find(b"none") is None


def test_archive_by_either_join(spark, tmp_path, monkeypatch):
    rows = [(i, "u", f"p{i % 3}") for i in range(30)]
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 0)
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_digest) for r in warc.read_archive(spark, f"{tmp_path}/w").collect()}
    sha = lambda i: base64.b32encode(hashlib.sha1(f"p{i % 3}".encode()).digest()).decode()
    assert got == {i: ("response", None, sha(i)) if i >= 27 else ("revisit", 27 + i % 3, sha(i)) for i in range(30)}


def test_empty_tables(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/e")
    assert warc.read_archive(spark, f"{tmp_path}/e").count() == 0
    assert chat.format_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert fingerprint.merge_fingerprints(spark.createDataFrame([], "k long, fingerprint string"), ["k"]).count() == 0


def test_stages_of_odd_documents(spark, tmp_path):
    """Each stage on nulls, empty and long texts, ties, repeated rows, no rows and clashing names."""
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kinds = "doc_id long, text string, source string, quality_score string, toxic_score int, row_key int, slot int, score double"
    own = ["a", 1, 2, 3, 0.5]
    rows = [(i, f"word{i} some text of document {i} here", "s", *own) for i in range(20)] + [(None, None, None, *own), (None, "", "s", *own), (3, "w " * 30000, "t", *own), (3, "x" * 70000, "t", *own), (4, "same", "s", *own), (4, "same", "s", *own)]
    for docs, n in ((spark.createDataFrame(rows, kinds), len(rows)), (spark.createDataFrame([], kinds), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, str(tmp_path))
            assert got.columns == docs.columns
            kept = got.count()
            assert kept <= n and (name != "mixing" or kept == n)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.count() == n


def test_stages_equal_brute_force(spark):
    """What each stage keeps of all that the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    text = dict(rows_of("documents", "doc_id, coalesce(text, '')"))

    good = quality.fit_quality(docs, labels)
    kept = corpus_pipeline.quality(spark, docs, SF).cache()
    assert ids(kept) == sorted(i for i, t in text.items() if good.score([t.encode()])[0] >= 0.5)
    bad = toxicity.fit_toxicity(kept, labels)
    clean = corpus_pipeline.toxicity(spark, kept, SF).cache()
    assert ids(clean) == [i for i in ids(kept) if bad.score([text[i].encode()])[0] < 0.5]
    sets = {i: {tuple(x.lower() for x in s) for s in five_words(text[i])} for i in ids(clean)}
    least = {i: i for i in sets}
    for _ in sets:  # labels spread along links
        before = dict(least)
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and likeness(sets[a], sets[b]) >= 0.8:
                    least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    alone = corpus_pipeline.near_copies(spark, clean, SF).cache()
    assert ids(alone) == sorted(i for i in sets if least[i] == i)
    mixed = corpus_pipeline.mixing(spark, alone, SF)
    assert ids(mixed) == ids(alone)
    lib = library("byte_bpe_50k.json")
    last = corpus_pipeline.tokens(spark, mixed, SF).collect()
    assert {r.doc_id: r.n_tokens for r in last} == {i: len(lib.encode(text[i], add_special_tokens=False).ids) for i in ids(alone)}
