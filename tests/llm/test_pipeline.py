"""What the stages of the pipeline hand on to its result."""

import corpus_pipeline
from gridloom.llm.jaccard import one_of_each
from gridloom.llm.mixing import BLOCK_ROWS, pfair_period, source_weights


def test_result_follows_the_schedule(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " + "word " * (i % 50), "hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    places = [(r.slot, r.source_rank) for r in got]
    assert places == sorted(places)
    source = {i: s for i, _, s in rows}
    weights = source_weights(docs)
    at = {(r.s, r.j): r["at"] for r in pfair_period(weights).collect()}
    w = {r.s: r.w for r in weights.collect()}
    for r in got:
        s, block = source[r.doc_id], r.source_rank // BLOCK_ROWS
        assert r.slot == block // w[s] * sum(w.values()) + at[s, block % w[s]]
    # up to the end of mixed slots each source is less than one block from its target
    slots = {r.slot: source[r.doc_id] for r in got if r.mixed}
    assert slots and any(not r.mixed for r in got)
    for end in range(1, max(slots) + 2):
        for s in w:
            assert abs(sum(slots[t] == s for t in range(end)) * sum(w.values()) - end * w[s]) < sum(w.values())


def test_one_row_of_each_group_stays(spark):
    a, b = "a b c d e f g h", "s t u v w x y z"
    rows = [(1, a), (5, a), (5, b), (None, a), (None, "p q r s t u"), (None, "p q r s t u"), (7, "k l m n o p"), (7, "k l m n o p"), (8, None), (8, None), (None, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row_key int")
    got = one_of_each(docs).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in [(1, a), (5, b), (None, "p q r s t u"), (7, "k l m n o p"), (8, None), (8, None), (None, "")])
    assert all(rows[r.row_key] == (r.doc_id, r.text) for r in got)


def test_mixing_keeps_columns_named_as_its_outputs(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "a", i * 2, "b", f"m{i}", i, "o") for i in range(40)], "doc_id long, text string, source string, Slot long, block string, mixed string, source_rank long, own_block string")
    got = corpus_pipeline.mixing(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))
