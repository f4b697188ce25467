"""How often texts are scanned and what is moved: one pass for words, nothing a posting at a time."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from proxsearch import queries
from proxsearch.functions import codec, text, wildcard
from proxsearch.operators import inverted
from proxsearch.operators.index import Index

SF = "/root/testdata/sf0.001"
ODD = [*'abCDz  \n.<>"<>', "א", "ת", "֑", "́", "é", "\U0001f600", "־", "ſ", "K", "<b>", "a" * 20, "\x00"]


def plan_of(spark, name):
    return queries.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("chunk", [1, 3, 20, 1 << 20])
def test_texts_scanned_as_arrays_give_the_words_of_the_pattern(chunk, monkeypatch):
    monkeypatch.setattr(text, "CHUNK", chunk)
    r, scan = random.Random(1), text.Scanner().scan
    for _ in range(500):
        texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 4))]
        w = text.scan_texts(texts)
        words, folded = w.words.to_pylist(), w.folded.to_pylist()
        want = [(i, k, *x) for i, t in enumerate(texts) for k, x in enumerate(scan(t))]
        assert list(zip(w.text.tolist(), w.position.tolist(), words, w.start.tolist(), w.size.tolist(), strict=True)) == want
        assert folded == [x.lower() for x in words]


def test_patterns_leave_out_no_word_that_matches(spark):
    words = ["the", "they", "th", "breathe", "of", "off", "t", "tree"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for p in ("the", "th*", "*he", "t?e*", "?", "*", "t*e"):
        hit = {r["w"] for r in df.where(wildcard.matches(df["w"], p)).collect()}
        assert hit <= {w for w, may in zip(words, wildcard.may_match(pa.array(words), [p]), strict=True) if may}


def test_lists_are_coded_as_by_columns():
    values, sizes = np.array([3, 9, 200, 5, 70000, 70001]), np.array([3, 1, 2])
    deltas = codec.encode_lists(values, sizes)
    assert deltas.tolist() == [3, 6, 191, 5, 70000, 1]
    assert codec.decode_lists(deltas, sizes).tolist() == values.tolist()
    assert codec.varint_sizes(np.array([-1, 0, 127, 128, 16384, 1 << 28])).tolist() == [5, 1, 1, 2, 3, 5]


@pytest.mark.parametrize("policy", inverted.MERGES)
def test_merged_documents_equal_merged_segments(spark, policy):
    rows = [(0, 1, "The cat the end"), (1, 1, "the cat"), (0, 2, "only here"), (1, 2, "1 2"), (0, 3, None), (1, 3, "new"), (2, 1, " "), (0, 4, "x" * 50)]
    docs = spark.createDataFrame(rows, "segment_id int, doc_id long, text string")
    parts = [inverted.build(docs.where(f"segment_id = {i}")).selectExpr("*", f"{i} AS segment_id") for i in range(3)]
    merge = {"replace": inverted.merge_replace, "term_last_wins": inverted.merge_last_wins}[policy]
    want = merge(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(map(str, inverted.build_merged(docs, policy).collect())) == sorted(map(str, want.collect()))


def test_merge_queries_move_texts_and_no_postings(spark):
    for name in ("reindex_replace", "merge_last_wins"):
        plan = plan_of(spark, name)
        assert plan.count("MapInArrow") == 1 and "Join" not in plan and plan.index("MapInArrow") < plan.index("Aggregate")


def test_join_form_scans_texts_once(spark):
    assert "MapInArrow" not in plan_of(spark, "near_join_form") and "documents.parquet" not in plan_of(spark, "near_join_form")
    assert "regexp" not in plan_of(spark, "near_join_form")


def test_codec_queries_move_no_rows_of_one_difference(spark):
    for name in ("delta_roundtrip", "delta_encode", "varint_size"):
        plan = plan_of(spark, name)
        assert not any(x in plan for x in ("Window", "Generate", "lambdafunction", "char_start"))


def test_vocabulary_queries_move_each_term_of_a_chunk_once(spark):
    for name in ("legacy_contains", "vocab_key_order", "legacy_suffix", "wild_prefix", "legacy_glob", "vocab_fold", "query_expansion"):
        plan = plan_of(spark, name)
        assert plan.count("Aggregate") == 1 and "regexp_extract_all" not in plan
    docs = spark.createDataFrame([(i, "the same Words the") for i in range(100)], "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, inverted.build(docs, rows=inverted.COUNTS).collect())) == [("Words", 100, 100), ("same", 100, 100), ("the", 100, 200)]


def test_searches_hand_over_their_words_alone_in_bounded_batches(spark):
    docs = spark.createDataFrame([(1, "in of The sea then")], "doc_id long, text string")
    assert sorted(r["term"] for r in inverted.build(docs, case="fold", terms=["the", "o*"]).collect()) == ["of", "the"]
    for name in ("near_repeated_term", "near2_a5", "late_offsets", "snippets_plain", "near3_a5", "or_expansion_docs"):
        for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
            spark.conf.unset(f"spark.sql.execution.arrow.{key}")
        plan_of(spark, name)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "500"


def test_late_offsets_move_texts_and_no_words(spark):
    plan = plan_of(spark, "late_offsets")
    assert plan.count("Join") == 1 and "regexp_extract_all" not in plan and "word" not in plan


def test_stored_postings_come_back_whatever_their_size(spark):
    far = "<" + "x" * 70_000 + ">ab ab <b>a</b>b " + "ab " * 300
    docs = spark.createDataFrame([(1, far), (2, "ab cd ab"), (3, "x" * 40 + "<" + "y" * 66_000 + ">z end")], "doc_id long, text string")
    packed = inverted.build(docs, rows=inverted.PACKED, by_term=True)
    got = packed.withColumn("postings", inverted.unpacked(packed["n"], packed["packed"])).select("term", "doc_id", "postings")
    assert sorted(map(str, got.collect())) == sorted(map(str, inverted.build(docs).collect()))
    assert [tuple(r) for r in packed.selectExpr("doc_id", "octet_length(packed) / n").where("term = 'ab'").collect()] == [(1, 12.0), (2, 6.0)]


def test_stored_index_counts_words_without_their_postings(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i", buckets=4)
    index.append(spark.createDataFrame([(i, "one two one") for i in range(20)], "doc_id long, text string"))
    stored = index._stored()
    assert stored.columns[:4] == ["term", "doc_id", "n", "packed"] and stored.agg({"n": "sum"}).first()[0] == 60
    state = json.loads((tmp_path / "i/manifests/000000000001.json").read_text())
    (tmp_path / "i/manifests/000000000002.json").write_text(json.dumps({k: v for k, v in state.items() if k != "format"}))
    with pytest.raises(ValueError, match="another format"):
        Index(spark, f"file://{tmp_path}/i")


def test_rows_of_an_index_come_in_runs_of_terms(spark):
    docs = spark.createDataFrame([(i, f"The cat Zoo the apple w{i}xx") for i in range(30)], "doc_id long, text string").coalesce(1)
    rows = [(r["term"], r["doc_id"]) for r in inverted.build(docs, by_term=True).collect()]
    assert rows == sorted(rows)
