import random
import re

import pytest
from pyspark.sql import functions as F

from proxsearch.operators import inverted
from proxsearch.operators.index import Index
from proxsearch.operators.proximity import chain_join, chain_rows, chains
from proxsearch.plans.query import Query, expansion, rarest_first, search
from proxsearch.schemas import POSTING
from proxsearch.sources import files
from proxsearch.streaming.ingest import index_stream


def docs_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def greedy(lists, adjacency):
    out = []
    for s in lists[0]:
        chain = [s]
        for later in lists[1:]:
            nxt = min((x for x in later if x > chain[-1]), default=None)
            if nxt is None or nxt - chain[-1] > adjacency + 1:
                break
            chain.append(nxt)
        if len(chain) == len(lists):
            out.append(tuple(chain))
    return out


GOLDEN = [
    ([[0], [1]], 0, [(0, 1)]), ([[0], [2]], 0, []), ([[0], [2]], 1, [(0, 2)]), ([[1], [0]], 5, []), ([[0, 1], [2]], 1, [(0, 2), (1, 2)]), ([[0], [1, 3], [5]], 2, []),
    ([[0, 4], [1, 3, 5], [5, 7]], 2, [(4, 5, 7)]), ([[0, 2, 4], [0, 2, 4]], 1, [(0, 2), (2, 4)]), ([[3, 9]], 0, [(3,), (9,)]),
]


def test_chains(spark):
    rng = random.Random(3)
    cases = GOLDEN + [([sorted(rng.sample(range(15), rng.randrange(1, 8))) for _ in range(n)], rng.randrange(4), None) for n in (1, 2, 3, 4) for _ in range(40)]
    for n in (1, 2, 3, 4):
        for adjacency in range(6):
            own = [(i, lists) for i, (lists, a, _) in enumerate(cases) if len(lists) == n and a == adjacency]
            if not own:
                continue
            rows = [(i, *[[(x, x, 1) for x in one] for one in lists]) for i, lists in own]
            posting = f"array<{POSTING.simpleString()}>"
            df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"l{k} {posting}" for k in range(n))).coalesce(1)
            got = {r["doc_id"]: [tuple(p["position"] for p in m) for m in r["m"]] for r in df.select("doc_id", chains([F.col(f"l{k}") for k in range(n)], adjacency).alias("m")).collect()}
            flat = [(k, i, x) for i, lists in own for k, one in enumerate(lists) for x in one]
            joined = sorted((r["doc_id"], *r["positions"]) for r in chain_join(spark.createDataFrame(flat, "term_no int, doc_id long, position int").coalesce(1), n, adjacency).collect())
            assert joined == sorted((i, *m) for i, ms in got.items() for m in ms)
            for i, lists in own:
                assert got[i] == (cases[i][2] if cases[i][2] is not None else greedy(lists, adjacency)), (lists, adjacency)


def test_search(spark):
    idx = inverted.build(docs_of(spark, {1: "tea in the pot", 5: "ten The pots", 7: "the tea the", 9: None, 10: " "}))
    ids = lambda q: [r["doc_id"] for r in search(idx, q).collect()]
    assert ids(Query("te*")) == [1, 5, 7] and ids(Query("tea zz")) == [] and ids(Query("")) == [] and ids(Query("   ")) == []
    assert ids(Query("the", 2)) == [1, 7]  # case counts across documents
    assert ids(Query("tea pot", 1)) == [] and ids(Query("tea pot", 2)) == [1] and ids(Query("tea pot", 1, keep_unmatched=True)) == [1]
    assert [len(r["matches"]) for r in search(idx, Query("the the", 1)).collect()] == [1]
    vocab = inverted.vocabulary(idx)
    assert {(r["term_no"], r["term"]) for r in expansion(vocab, Query("te? pot")).collect()} == {(0, "tea"), (0, "ten"), (1, "pot")}
    assert expansion(vocab, Query(" ")).count() == 0
    q = Query("the tea", 5)
    assert search(rarest_first(idx, vocab, q), q).collect() == search(idx, q).collect()
    with pytest.raises(ValueError):
        Query("a", -1)


def test_first_spelling(spark):
    idx = inverted.build(docs_of(spark, {1: "Hello, hello WORLD", 2: "hello"}))
    assert {(r["term"], r["doc_id"], tuple(p["position"] for p in r["postings"])) for r in idx.collect()} == {("Hello", 1, (0, 1)), ("WORLD", 1, (2,)), ("hello", 2, (0,))}
    assert [r["doc_id"] for r in search(idx, Query("hello")).collect()] == [2]
    fold = inverted.build(docs_of(spark, {1: "Hello, hello WORLD", 2: "hello"}), case="fold")
    assert [r["doc_id"] for r in search(fold, Query("HELLO", fold=True)).collect()] == [1, 2]


def terms(index, doc):
    return sorted(r["term"] for r in index.tokens().where(F.col("doc_id") == doc).collect())


@pytest.mark.parametrize("policy", ["replace", "term_last_wins"])
def test_stored_index(spark, tmp_path, policy):
    path = f"file://{tmp_path}/index"
    index = Index(spark, path, buckets=4, merge_policy=policy)
    assert index.tokens().count() == 0
    index.append(docs_of(spark, {1: "alpha beta alpha", 2: "beta gamma", 3: " "}))
    index.append(docs_of(spark, {2: "beta delta", 4: "alpha delta"}))
    assert terms(index, 2) == (["beta", "delta"] if policy == "replace" else ["beta", "delta", "gamma"])
    index.delete(spark.createDataFrame([(4,), (99,)], "doc_id long"))
    assert terms(index, 4) == []
    assert {r["term"]: (r["doc_freq"], r["coll_freq"]) for r in index.vocabulary().collect()}["beta"] == (2, 2)
    before = sorted(map(str, index.tokens().collect()))
    index.compact()
    again = Index(spark, path)  # settings come from the manifest
    assert again.state["merge_policy"] == policy and len(again.state["segments"]) == 1
    assert sorted(map(str, again.tokens().collect())) == before
    again.append(docs_of(spark, {4: "omega"}))
    assert terms(again, 4) == ["omega"]
    again.compact()
    found = again.search("alpha beta", 0)
    assert [r["doc_id"] for r in found.collect()] == [1]
    plan = again.tokens().where((F.col("bucket") == inverted.bucket(F.lit("alpha"), 4)) & (F.col("term") == "alpha"))._jdf.queryExecution().toString()
    assert "EqualTo(term,alpha)" in plan and "PythonUDF" not in plan
    shown = again.snippets(found, docs_of(spark, {1: "alpha beta alpha"})).first()
    assert shown["snippets"] == ["<mark>alpha</mark> <mark>beta</mark> alpha"]


def test_search_plan_prunes(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index", buckets=8, case="fold")
    index.append(docs_of(spark, {i: f"alpha beta {'gamma' * (i % 3)}" for i in range(50)}))
    plan = index.search("ALPHA beta")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "Python" not in plan and plan.count("Exchange hashpartitioning(doc_id") >= 1
    assert "alpha" in plan.split("PushedFilters")[1]
    assert index.search("ALPHA beta").count() == 50


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    docs_of(spark, {1: "alpha beta", 2: "gamma"}).write.parquet(str(source / "a"))
    index = Index(spark, f"file://{tmp_path}/index", buckets=4)
    stream = lambda: spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", True).parquet(str(source))
    index_stream(stream(), index, str(tmp_path / "cp")).awaitTermination()
    docs_of(spark, {2: "delta"}).write.parquet(str(source / "b"))
    index_stream(stream(), index, str(tmp_path / "cp")).awaitTermination()
    assert terms(index, 1) == ["alpha", "beta"] and terms(index, 2) == ["delta"]


def test_files_and_registry(spark, tmp_path):
    for name in ("z/b.txt", "z/a.TXT", "m/x/q.txt", "c.txt", "k.pdf", "n.bin"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"text of {name}")
    root = f"file:{tmp_path}"
    got = files.read_files(spark, str(tmp_path), [".txt", ".pdf"])
    rel = got.select(files.relative(F.regexp_replace("path", "^file:/+", "file:/"), root).alias("path"), "text")
    texts = {r["path"]: r["text"] for r in rel.collect()}
    assert set(texts) == {"z/b.txt", "z/a.TXT", "m/x/q.txt", "c.txt", "k.pdf"} and texts["k.pdf"] == "" and texts["z/b.txt"] == "text of z/b.txt"
    empty = spark.createDataFrame([], "doc_id long, path string, sort_key string")
    one = files.assign_ids(rel.where("path != 'c.txt'"), empty, directories=["z"], files=["k"])
    assert [r["path"] for r in one.orderBy("doc_id").collect()] == ["z/a.TXT", "z/b.txt", "m/x/q.txt", "k.pdf"]
    two = files.assign_ids(rel, one, directories=["z"])
    assert {r["path"]: r["doc_id"] for r in two.collect()} == {"z/a.TXT": 1, "z/b.txt": 2, "m/x/q.txt": 3, "k.pdf": 4, "c.txt": 5}
    asked = spark.createDataFrame([("/r/z/b.txt/",), ("/r/none",)], "path string")
    assert {r["path"]: r["doc_id"] for r in files.ids_of(asked, two, "/r").collect()} == {"/r/z/b.txt/": 2, "/r/none": -1}
    assert {r["doc_id"]: r["path"] for r in files.paths_of(spark.createDataFrame([(2,), (77,)], "doc_id long"), two, "/r").collect()} == {2: "/r/z/b.txt", 77: None}
    page = files.to_html(spark.createDataFrame([(2, "r/b.txt", ["<mark>x</mark>"])], "doc_id long, path string, snippets array<string>"))
    assert "<li><b>b.txt</b> Document id: 2<br><mark>x</mark></li>" in page


def test_files_as_they_are(spark, tmp_path):
    """Byte order marks, names with blanks and Hebrew letters, broken bytes."""
    texts = {
        "a b/one two.txt": "plain שלום".encode(), "ספר אחד/א%20ב.txt": "\ufeffwith a mark".encode(), "le.txt": b"\xff\xfe" + "שלום le".encode("utf-16-le"), "be.txt": b"\xfe\xff" + "שלום be".encode("utf-16-be"),
        "32.TXT": b"\xff\xfe\x00\x00" + "long".encode("utf-32-le"), "bad.txt": b"ok \xff\xfa ok", "odd.txt": b"\xff\xfea\x00b", "empty.txt": b"", "p.pdf": b"%PDF",
    }
    for name, raw in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = files.read_files(spark, str(tmp_path), [".txt", ".pdf"], errors=True)
    assert got.where("error IS NOT NULL").count() == 0
    rel = got.select(files.relative(F.regexp_replace("path", "^file:/+", "file:/"), f"file:{tmp_path}").alias("path"), "text")
    want = {"a b/one two.txt": "plain שלום", "ספר אחד/א%20ב.txt": "with a mark", "le.txt": "שלום le", "be.txt": "שלום be", "32.TXT": "long", "bad.txt": "ok \ufffd\ufffd ok", "odd.txt": "a\ufffd", "p.pdf": ""}
    assert {r["path"]: r["text"] for r in rel.collect()} == want
    empty = spark.createDataFrame([], "doc_id long, path string, sort_key string")
    order = [r["path"] for r in files.assign_ids(rel.where("path LIKE '%/%'"), empty, directories=["ספר אחד"], files=["one two"]).orderBy("doc_id").collect()]
    assert order == ["ספר אחד/א%20ב.txt", "a b/one two.txt"]


def test_rows_that_share_ids(spark):
    from proxsearch.functions import text

    docs = spark.createDataFrame([(1, "alpha beta"), (1, "delta epsilon"), (None, "zeta eta zeta"), (None, None), (3, "")], "doc_id long, text string")
    want = [("1", "alpha", 0, 0), ("1", "beta", 1, 6), ("1", "delta", 0, 0), ("1", "epsilon", 1, 6), ("None", "eta", 1, 5), ("None", "zeta", 0, 0), ("None", "zeta", 2, 9)]
    assert sorted((str(r["doc_id"]), r["word"], r["position"], r["char_start"]) for r in text.tokens(docs).collect()) == want
    assert "Exchange" not in inverted.build(docs)._jdf.queryExecution().executedPlan().toString()
    rows = inverted.build(docs).select("doc_id", "term", F.explode("postings").alias("p")).select("doc_id", "term", "p.*").collect()
    assert sorted((str(r["doc_id"]), r["term"], r["position"], r["char_start"]) for r in rows) == want


def test_build_equals_grouping(spark):
    from proxsearch.functions import text

    docs = docs_of(spark, {1: 'The the THE <b>thE</b> שָׁלוֹם "quo"ted and\n' * 50, 2: "a <i>b c", 4: "x" * 50 + " " + "y" * 44})
    for mode in ("clean", "swallow"):
        for case in inverted.CASES:
            show = lambda df: sorted((r["term"], r["doc_id"], [tuple(p) for p in r["postings"]]) for r in df.collect())
            assert show(inverted.build(docs, tag_mode=mode, case=case)) == show(inverted.group_tokens(text.tokens(docs, tag_mode=mode), case))


def test_chain_rows_equal_chains(spark):
    rng = random.Random(11)
    lists = [[sorted(rng.sample(range(30), rng.randrange(1, 12))) for _ in range(3)] for _ in range(80)]
    for n in (1, 2, 3):
        for adjacency in (0, 2, 5):
            rows = [(i, *[[(x, 7 * x, 2) for x in one] for one in own[:n]]) for i, own in enumerate(lists)]
            df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"l{k} array<{POSTING.simpleString()}>" for k in range(n))).coalesce(2)
            for keep in (False, True):
                got = {r["doc_id"]: [tuple(p["position"] for p in m) for m in r["matches"]] for r in chain_rows(df.withColumn("l0", F.reverse("l0")), n, adjacency, keep).collect()}
                want = {i: greedy(own[:n], adjacency) for i, own in enumerate(lists)}
                assert got == {i: w for i, w in want.items() if keep or w}


def test_several_segments(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = Index(spark, path, buckets=8, case="fold")
    batches = [{i: f"alpha beta w{'abcdefgh'[i % 8]}" for i in range(40)}, {i: "alpha xx beta" for i in range(0, 40, 3)}, {50: "beta alpha beta"}]
    for b in batches:
        index.append(docs_of(spark, b).withColumn("where", F.concat(F.lit("r/a "), "doc_id")), path_col="where", tasks=3 if len(b) < 40 else None)
    index.delete(docs_of(spark, {1: "", 3: "", 77: ""}).select("doc_id"))
    index.delete_paths(spark.createDataFrame([("r/a 4",), ("none",)], "path string"))
    want = [i for i in range(40) if i % 3 and i not in (1, 4)] + [50]
    assert [r["doc_id"] for r in index.search("alpha beta", 0).collect()] == want
    free = index.search("alpha beta", 0, ordered=False)
    assert sorted(r["doc_id"] for r in free.collect()) == want and "rangepartitioning" not in free._jdf.queryExecution().executedPlan().toString()
    plan = index.search("alpha beta", 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [Or(EqualTo(term,alpha),EqualTo(term,beta))]") >= 3 and plan.count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket", plan)) >= 3
    vocab = lambda x: {tuple(r) for r in x.vocabulary().collect()}
    assert vocab(index) == {tuple(r) for r in inverted.vocabulary(index.tokens()).collect()}
    assert sorted(r["doc_id"] for r in index.postings("alpha").collect()) == sorted({*range(40), 50} - {1, 3, 4})
    assert index.by_key("8ed3f6ad685b959ead7022518e1af76cd816f8e8ec7ccdda1ed4018e8f2223f8").count() == index.postings("alpha").count()
    found = index.find("alpha beta", docs_of(spark, {50: "beta alpha beta"}), adjacency=0).collect()
    assert (found[-1]["path"], found[-1]["snippets"]) == ("r/a 50", ["beta <mark>alpha</mark> <mark>beta</mark>"])
    before, old = vocab(index), index.search("alpha beta", 0)
    index.compact()
    assert vocab(index) == before and [r["doc_id"] for r in index.search("alpha beta", 0).collect()] == want
    assert [r["doc_id"] for r in old.collect()] == want  # its files are still there
    index.vacuum()
    assert Index(spark, path).state == index.state and vocab(Index(spark, path)) == before


def test_opening_checks_what_is_there(spark, tmp_path):
    import shutil

    with pytest.raises(FileNotFoundError):
        Index(spark, f"file://{tmp_path}/none", create=False)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("x")
    with pytest.raises(FileNotFoundError):
        Index(spark, f"file://{tmp_path}/other")
    path = f"file://{tmp_path}/index"
    one, two = Index(spark, path, buckets=2), Index(spark, path, buckets=2)
    one.append(docs_of(spark, {1: "alpha"}))
    with pytest.raises(RuntimeError):  # of two writers one fails, and nothing is lost
        two.append(docs_of(spark, {2: "beta"}))
    two = Index(spark, path)
    two.append(docs_of(spark, {2: "beta"}))
    # a crash before the manifest leaves the index as it was
    (tmp_path / "index" / "manifests" / ".half.tmp").write_text("{")
    assert sorted(r["term"] for r in Index(spark, path).vocabulary().collect()) == ["alpha", "beta"]
    shutil.rmtree(tmp_path / "index" / "tokens" / two.state["segments"][0])
    with pytest.raises(FileNotFoundError):
        Index(spark, path)


def test_a_batch_tried_again_is_indexed_once(spark, tmp_path):
    source = tmp_path / "in"
    docs_of(spark, {1: "alpha beta", 2: "gamma"}).write.parquet(str(source / "a"))
    stream = lambda: spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", True).parquet(str(source))
    index = Index(spark, f"file://{tmp_path}/index", buckets=4)
    index_stream(stream(), index, str(tmp_path / "cp1")).awaitTermination()
    # the stream's own record of the batch is lost: it comes again with the same number
    again = Index(spark, f"file://{tmp_path}/index")
    index_stream(stream(), again, str(tmp_path / "cp2")).awaitTermination()
    assert len(again.state["segments"]) == 1 and {r["term"]: r["coll_freq"] for r in again.vocabulary().collect()} == {"alpha": 1, "beta": 1, "gamma": 1}


def test_latest_search(spark):
    import threading
    import time

    from proxsearch.plans.query import LatestSearch

    latest, ended = LatestSearch(spark), []

    def slow():
        try:
            latest.run(lambda: spark.range(1 << 40).selectExpr("sum(id % 7)").collect())
        except Exception as e:  # noqa: BLE001
            ended.append(e)

    t = threading.Thread(target=slow)
    t.start()
    time.sleep(5)
    assert latest.run(lambda: spark.range(10).count()) == 10
    t.join(60)
    assert len(ended) == 1


def test_merge_queries_take_whole_documents(spark, tmp_path):
    from proxsearch import queries

    texts = {i: " ".join([f"first{'abc'[i % 3]}", *(f"w{'xyz'[k % 3]}{'pqrst'[k % 5]}" for k in range(400)), f"last{'de'[i % 2]}"]).translate(str.maketrans("0123456789", "abcdefghij")) for i in range(6)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("merge_last_wins", "reindex_replace"):
        got = {(r["term"], r["doc_id"]): r["positions"] for r in queries.queries()[name](spark, str(tmp_path)).collect()}
        want = {}
        for i, t in texts.items():
            old, new = t.split(" "), ["reindexed", *t.split(" ")[1:]]
            for words in (old, new) if name == "merge_last_wins" else (new,):
                want |= {(w, i): ",".join(str(k) for k, v in enumerate(words) if v == w) for w in words}
        assert got == want, name


def test_delta_roundtrip_takes_long_lists(spark, tmp_path):
    from proxsearch import queries

    spark.createDataFrame([(1, "the " * 5000 + "cat"), (2, "the cat the")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.queries()["delta_roundtrip"](spark, str(tmp_path)).collect())
    assert got == [("cat", 1, True), ("cat", 2, True), ("the", 1, True), ("the", 2, True)]


def test_lookups_ask_for_every_path_and_id(spark, tmp_path):
    from proxsearch import queries

    urls = [f"site/{c}.html" for c in "abcdefgh"]
    spark.createDataFrame(list(enumerate(urls, 1)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    paths = {r["path"]: r["doc_id"] for r in queries.queries()["path_lookup"](spark, str(tmp_path)).collect()}
    assert paths == {u: i for i, u in enumerate(urls, 1)} | {"no/such/path": -1}
    ids = {r["doc_id"]: r["path"] for r in queries.queries()["id_lookup"](spark, str(tmp_path)).collect()}
    assert ids == {i: "root/" + u for i, u in enumerate(urls, 1)} | {100000000: None}


def test_html_page_has_every_snippet(spark):
    page = files.to_html(spark.createDataFrame([(1, "r/a.txt", ["x"] * 1500)], "doc_id long, path string, snippets array<string>"))
    assert page.count("<li>") == 1500
