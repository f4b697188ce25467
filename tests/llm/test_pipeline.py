import random
from collections import Counter

import corpus_pipeline as cp
import pytest
from proxsearch.llm.minhash import near_dedup
from proxsearch.llm.mixing import mix
from proxsearch.llm.quality import score_quality

from .fixtures import AWKWARD, docs_of
from .test_minhash import brute, template
from .test_tokens import FILES, expected


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["the", "cat", "and", "dog", "were", "in", "house", "with", "all", "of", "their", "friends", "that", "day"]
    texts = [" ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(60)) for _ in range(40)]
    pairs = [*AWKWARD, *((100 + i, t) for i, t in enumerate(texts)), *((200 + i, texts[i]) for i in range(10)), *((300 + i, texts[i] + " more") for i in range(5, 15)), *((400 + i, "BUY!! NOW!! ### $$$ " * 20) for i in range(20))]
    docs = docs_of(spark, pairs)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(d < 400), 0) for d, _ in pairs if d is not None and d >= 100], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out, sizes = docs, []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, out, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
        sizes.append([r for r in out.collect()])
    quality, exact, near, mixed, packed = sizes
    assert not any(r["doc_id"] is not None and r["doc_id"] >= 400 for r in quality) and {100 + i for i in range(40)} <= {r["doc_id"] for r in quality}
    assert sorted(r["text"] or "" for r in exact) == sorted({r["text"] or "" for r in quality})
    assert {r["doc_id"] for r in exact} >= {200 + i for i in range(10)} and not {100 + i for i in range(10)} & {r["doc_id"] for r in exact}
    kept = {r["doc_id"] for r in near_dedup(docs_of(spark, [(r["doc_id"], r["text"]) for r in exact])).where("kept").collect()}
    assert {r["doc_id"] for r in near} == kept and not {300 + i for i in range(5, 15)} & kept
    ids = {r["doc_id"] for r in near}
    assert {r["doc_id"] for r in mixed} <= ids and max(sum(1 for r in mixed if r["doc_id"] == d) for d in ids) <= 3
    assert sum(1 for r in packed if r["start"] == 0) == len(mixed) and {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}
    assert cp.run(spark, str(tmp_path)).count() == len(packed)


def kept_rows(df):
    return sorted(((r[0], r[1]) for r in df.collect()), key=str)


def test_dedup_stages_go_by_id_and_text(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    a, b, c, d = (" ".join(w + x for w in words) for x in "abcd")
    docs = docs_of(spark, [(5, a), (5, b), (9, a), (None, a), (None, c), (None, c), (2, d), (7, d + " more"), (7, c + " x y z " * 40)])
    cp.exact(spark, docs, "").write.parquet(str(tmp_path / "exact"))
    exact = spark.read.parquet(str(tmp_path / "exact"))
    want = [(2, d), (5, b), (7, c + " x y z " * 40), (7, d + " more"), (9, a), (None, c)]
    assert kept_rows(exact) == sorted(want, key=str)
    near = cp.near(spark, exact, "")
    assert near.columns == docs.columns
    assert kept_rows(near) == sorted((w for w in want if w != (7, d + " more")), key=str)


@pytest.mark.parametrize("repeated", [False, True])
def test_near_parts_families_of_hundreds(spark, repeated):
    """Whether ids are unique or not; half of the family goes, being copies with one word changed."""
    texts = template(random.Random(3), 150)
    copies = [" ".join(w if j != 50 else f"z{i}" for j, w in enumerate(t.split())) for i, t in enumerate(texts)]
    rows = [*enumerate(texts), *((i if repeated and i == 149 else 150 + i, t) for i, t in enumerate(copies))]
    got = kept_rows(cp.near(spark, docs_of(spark, rows), ""))
    one_of = {t: i for i, t in enumerate(texts)} | {t: i for i, t in enumerate(copies)}
    assert sorted(one_of[t] for _, t in got) == list(range(150)) and [r for r in got if r[0] != 149] == sorted(((i, t) for i, t in enumerate(texts) if i != 149), key=str)


def test_no_document_is_lost(spark):
    rows = [(7, "A"), (7, "B"), (9, "A"), (None, "N1"), (None, "N2"), (20, "N1")]
    exact = cp.exact(spark, docs_of(spark, rows), "")
    assert kept_rows(exact) == sorted([(7, "B"), (9, "A"), (None, "N2"), (20, "N1")], key=str)
    assert kept_rows(cp.near(spark, docs_of(spark, kept_rows(exact)), "")) == kept_rows(exact)


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [*AWKWARD, *((i, ("the cat and the dog were in the house that day " if i % 2 else "## $$ !! ") * (1 + i % 4)) for i in range(40))]
    docs = docs_of(spark, rows).toDF("doc_id", "text", "_k", "source", "did", "row", "TEXT", "k", "sha")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            have = {tuple(r) for r in docs.collect()}
            got = [tuple(r) for r in out.collect()]
            assert got and set(got) <= have, name
        else:
            assert out.count() >= len(rows)
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.collect() == [] and empty.columns == out.columns


def test_stages_equal_plain_ones(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 50))) for _ in range(40)]
    pairs = [*AWKWARD, *((100 + i, t) for i, t in enumerate(texts)), *((200 + i, texts[i] + " and") for i in range(20)), *((None, t) for t in texts[:5]), *((300 + i % 3, "## $$ !!" * 9 + str(i)) for i in range(12))]
    docs_of(spark, pairs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(d < 300), 0) for d, _ in pairs if d is not None and d >= 100], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    docs, outs = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        outs.append(docs)
    # quality: those that the classifier predicts to be good (itself held against a plain one in test_models)
    numbered = [(i, t) for i, (_, t) in enumerate(pairs)]
    same = {t or "": 0 for _, t in pairs}
    for r in score_quality(docs_of(spark, pairs), labels).select("doc_id", "predicted").distinct().collect():
        same.update({t or "": r["predicted"] for d, t in pairs if d == r["doc_id"] and len({u for e, u in pairs if e == d}) == 1})
    good = kept_rows(outs[0])
    assert all((pairs[i][0], t) in good for i, t in numbered if same[t or ""] and pairs[i][0] is not None and pairs[i][0] < 100 or pairs[i][0] in range(100, 140))
    # exact: by dictionaries
    best = {}
    for d, t in good:
        k = t or ""
        best[k] = max(best.get(k, -1), -1 if d is None else d)
    assert sorted((-1 if d is None else d, t or "") for d, t in kept_rows(outs[1])) == sorted((d, t) for t, d in best.items())
    # near: by all pairs
    rows = sorted((r for r in kept_rows(outs[1]) if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    comps = {c for _, _, c, _ in brute([(i, t) for i, (_, t) in enumerate(rows)])}
    want = sorted([(False, rows[i][0]) for i in comps] + [(True, 0) for d, _ in kept_rows(outs[1]) if d is None])
    assert sorted((d is None, d or 0) for d, _ in kept_rows(outs[2])) == want
    # mixing: as often as mix says; packing: every id of what is left, once a time taken
    times = Counter()
    for r in mix(docs_of(spark, []).unionByName(outs[2])).collect():
        times[r["doc_id"], r["size"]] += r["taken"] // max(1, r["size"])
    mixed = Counter((d, len((t or "").split())) for d, t in kept_rows(outs[3]))
    assert mixed == +times
    pieces = Counter((r["doc_id"], r["doc_tokens"]) for r in outs[4].where("start = 0").collect())
    ids = Counter((d, len(i)) for d, i in expected(kept_rows(outs[3]), FILES[0], 2))
    assert pieces == ids and Counter(map(str, cp.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == Counter(map(str, outs[4].drop("sequence_id", "offset").collect()))
