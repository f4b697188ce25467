import hashlib
import json
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest

from proxsearch.llm import common
from proxsearch.llm.exact_dedup import ExactIndex, build_directory, exact_dedup, owners
from proxsearch.llm.line_dedup import line_digest, line_keys, line_marks, pack_bits, unpack_bits
from proxsearch.llm.minhash import near_dedup
from proxsearch.llm.substring_dedup import FingerprintIndex, minimizers, repeated_windows, substring_digest
from proxsearch.storage import put_numbered

from .fixtures import AWKWARD, docs_of


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_directory():
    rng = random.Random(1)
    counts = Counter(rng.randrange(1 << 8) for _ in range(3000)) + Counter({7: 900})
    depth, slots, loads = build_directory(counts, 100, 8)
    assert len(slots) == 1 << depth and sum(loads) == sum(counts.values())
    held = Counter()
    for prefix, n in counts.items():
        held[slots[prefix >> (8 - depth)]] += n
    assert [held[b] for b in range(len(loads))] == loads
    assert all(n <= 100 for b, n in enumerate(loads) if b != slots[7 >> (8 - depth)])
    assert slots == sorted(slots) and owners(loads, 4) == sorted(owners(loads, 4)) and set(owners(loads, 4)) <= set(range(4))
    assert build_directory({}, 10) == (0, [0], [0])


@pytest.mark.parametrize("capacity", [100_000, 3])
def test_exact(spark, capacity, tmp_path):
    pairs = [*AWKWARD, *((200 + i, f"text {i % 7}") for i in range(60))]
    path = f"file://{tmp_path}/index"
    got = exact_dedup(docs_of(spark, pairs), capacity=capacity, index_path=path).collect()
    groups = defaultdict(list)
    for d, t in pairs:
        groups[t or ""].append(d)
    want = []
    for d, t in pairs:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((d, keep, len(g), d == keep, sha(t or "")))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    index = ExactIndex(spark, path)
    assert index.entries().agg({"n": "sum"}).first()[0] == len(pairs) and index.entries().count() == len(groups)
    asked = docs_of(spark, [(900, "text 3"), (901, "unknown")])
    assert {r["doc_id"]: r["keep_id"] for r in index.lookup(asked).collect()} == {900: max(groups["text 3"]), 901: None}
    assert exact_dedup(docs_of(spark, [])).collect() == []


def test_equal_hashes_are_told_apart_by_bytes():
    import pyarrow as pa

    from proxsearch.llm.exact_dedup import _chain

    batch = pa.RecordBatch.from_pydict({"key": pa.array([1, 1, 1, 2], pa.int64()), "text": ["a", "b", "a", "c"], "keep_id": pa.array([1, 2, 9, 4], pa.int64()), "n": pa.array([2, 1, 1, 1], pa.int64())})
    rows = [r for b in _chain(iter([batch])) for r in b.to_pylist()]
    assert [(r["key"], r["sha"].hex(), r["keep_id"], r["n"], r["chain"]) for r in rows] == [(1, sha("a"), 9, 3, 0), (1, sha("b"), 2, 1, 1), (2, sha("c"), 4, 1, 0)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", "a", "b")], "doc_id long, text string, n string, N2 string").toDF("doc_id", "text", "Text", "text")
    assert common.pick(df, text="text", doc_id="DOC_ID").first().asDict() == {"text": "x", "doc_id": 1}
    with pytest.raises(ValueError):
        common.pick(df, none="none")


def test_hot_keys_join(spark):
    left = spark.range(3000).selectExpr("if(id < 1500, 0, id) AS k", "id")
    right = left.groupBy("k").count().withColumnRenamed("count", "w")
    got = common.join_unique(left, right, ["k"], "w", 3000)
    assert got.count() == 3000 and got.where("k = 0 AND w = 1500").count() == 1500


def brute_lines(pairs, least, keep="none"):
    lines = {(d, t): t.split("\n") for d, t in ((d, t or "") for d, t in pairs)}
    where = defaultdict(list)
    for k in sorted(lines, key=lambda k: (k[0] is not None, k[0] or 0)):
        for i, line in enumerate(lines[k]):
            key = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\x20\t\n\x0b\f\r"))
            if key:
                where[key].append((k, i))
    gone = set()
    for places in where.values():
        if len({k for k, _ in places}) >= least:
            gone |= set(places[1:] if keep == "first" else places)
    out = []
    for d, t in pairs:
        k = d, t or ""
        kept = [line for i, line in enumerate(lines[k]) if (k, i) not in gone]
        out.append((d, len(lines[k]), len(lines[k]) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def test_lines(spark):
    rng = random.Random(2)
    pairs = [*AWKWARD, *((300 + i, "\n".join(rng.choice(["One Line", " one line\t", "É", "é", "", f"own {i}", "x" * rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 9)))) for i in range(80))]
    got = line_digest(docs_of(spark, pairs), min_docs=10, min_chars=1).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(pairs, 10)
    assert line_digest(docs_of(spark, [])).collect() == []
    some = [p for p in pairs if p[0] is not None and p[0] >= 300]
    got = line_digest(docs_of(spark, some), min_docs=1, keep="first").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(some, 1, "first")
    with pytest.raises(ValueError):
        line_marks(docs_of(spark, some), keep="last")


def test_bits():
    assert unpack_bits(pack_bits(11, [0, 3, 10]), 11).tolist() == [i not in (0, 3, 10) for i in range(11)]
    assert line_keys(" Ab \n\né", 1) == [b"ab", None, "é".encode()] and line_keys("é\nab", 2) == [None, b"ab"]


def brute_windows(pairs, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in pairs]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(pairs, words, strict=True):
        gone = {i + k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def passages(n, seed):
    rng = random.Random(seed)
    shared = [[f"p{k}w{i}" for i in range(rng.randrange(5, 60))] for k in range(6)] + [["a"] * 40, ["a", "b"] * 20]
    out = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(0, 6)):
            if rng.random() < 0.5:
                p = rng.choice(shared)
                j = rng.randrange(len(p))
                text += p[j : j + rng.randrange(1, 60)]
            else:
                text += [f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))]
        out.append((1000 + i, " ".join(text)))
    return out


@pytest.mark.parametrize("window", [1, 7, 35])
def test_substrings(spark, window):
    pairs = [*AWKWARD, *passages(80, window)]
    got = substring_digest(docs_of(spark, pairs), window=window).collect()
    assert sorted(map(tuple, got), key=str) == brute_windows(pairs, window)


def test_substrings_in_batches(spark, monkeypatch):
    window, every = 7, passages(60, 3)
    path, fanout = common.shared_dir(spark), 3
    parts, want = [every[:20], every[20:40], every[40:]], brute_windows(every, window)
    history = []
    for k, part in enumerate(parts):
        index = FingerprintIndex(spark, path, window, fanout=fanout)  # opened again, with what is stored alone
        got = substring_digest(docs_of(spark, part), window=window, index=index)
        history = history + part
        ids = {d for d, _ in part}
        assert sorted(map(tuple, got.collect()), key=str) == [r for r in brute_windows(history, window) if r[0] in ids]
        assert len(index.state["runs"]) == (1, 2, 1)[k]
    assert sorted(map(tuple, got.collect()), key=str) == [r for r in want if r[0] in ids]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("run_", "new_"))]
    # a step that fails on the way leaves the index as it was
    before, index = dict(index.state), FingerprintIndex(spark, path, window)
    monkeypatch.setattr(FingerprintIndex, "_commit", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        substring_digest(docs_of(spark, parts[0]), window=window, index=index)
    monkeypatch.undo()
    again = FingerprintIndex(spark, path, window)
    assert again.state == before and again.hits().count() >= 0
    with pytest.raises(ValueError):
        FingerprintIndex(spark, path, 8)
    index.drop()
    assert substring_digest(docs_of(spark, []), window=window).collect() == []


def test_runs_merge_without_moving(spark):
    index, tables = FingerprintIndex(spark, common.shared_dir(spark), 7, buckets=4, fanout=9), []
    for part in (passages(20, 1), passages(20, 2)):
        index.add(docs_of(spark, part).selectExpr("doc_id AS did", "0L AS th", "text"))
    plan = index.merged(index.state["runs"], tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    for t in tables:
        spark.sql(f"DROP TABLE {t}")
    index.drop()


def test_words_are_read_only_where_variants_differ(spark):
    window, pairs = 7, passages(40, 5)
    index = FingerprintIndex(spark, common.shared_dir(spark), window)
    name = index.add(docs_of(spark, pairs).selectExpr("doc_id AS did", "0L AS th", "text"))
    rows = index.segments().collect()
    assert rows and all((r["s1"], r["s2"]) == struct.unpack("<qq", hashlib.sha256(r["body"].encode()).digest()[:16]) for r in rows)
    judged, used = repeated_windows(index.segments([name]).selectExpr("*", "true AS own"), window)
    assert all("body" not in t.columns for t in used) and judged.count()
    common.discard(*used)
    state = index.state
    put_numbered(spark, f"{index.path}/manifests", state["number"] + 1, json.dumps({k: v for k, v in state.items() if k != "layout"}))
    with pytest.raises(ValueError):
        FingerprintIndex(spark, index.path, window)
    index.drop()


def test_key_filter_is_read_in_place(spark):
    keys = [0, 1, -1, 63, 64, 32767, 32768, common.BITS - 1, common.BITS + 5, -(1 << 63), (1 << 63) - 1, *(x * 2654435761 for x in range(500))]
    filt = common.key_filter(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert filt.schema["_bits"].dataType.simpleString() == "array<bigint>"  # a binary value is copied for every row
    tried = sorted({(k + d) % (1 << 64) for k in keys for d in (-64, -8, -1, 0, 1, 7, 8, 56, 64, common.BITS)})
    tried = [(k - (1 << 64) if k >= 1 << 63 else k,) for k in tried]
    slots = {k % common.BITS for k in keys}
    for yes in (True, False):
        got = {r["k"] for r in common.may_pass(spark.createDataFrame(tried, "k long"), filt, "k", yes).collect()}
        assert got == {k for (k,) in tried if (k % common.BITS in slots) == yes}


def thue_morse(n, x, y):
    return "".join(x if bin(i).count("1") % 2 == 0 else y for i in range(n))


def test_words_that_polynomials_confuse(spark):
    common_words = [f"w{i}" for i in range(34)]
    pairs = [(1, " ".join([*common_words, thue_morse(4096, "a", "b")])), (2, " ".join([*common_words, thue_morse(4096, "b", "a")])), (3, " ".join([*common_words, "c" * 4095 + "d"])), (4, " ".join([*common_words, "c" * 4096]))]
    assert sorted(map(tuple, substring_digest(docs_of(spark, pairs), window=35).collect()), key=str) == brute_windows(pairs, 35)
    near = [(d, t.split(" ")[-1] + " x y z") for d, t in pairs]
    assert all(r["kept"] for r in near_dedup(docs_of(spark, near)).collect())


def test_minimizers_are_the_leftmost_least():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 4, 200, dtype=np.uint64)
    g, at = minimizers(h, 9)
    span = 9 - 3 + 1
    assert at.tolist() == [i + int(np.argmin(g[i : i + span])) for i in range(len(g) - span + 1)]
