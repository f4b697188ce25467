import numpy as np
import pytest

from proxsearch.llm import embedding_dedup as module
from proxsearch.llm.embedding_dedup import Forest, embedding_dedup


def brute(rows, least=0.93):
    n = len(rows)
    ok = [v is not None and lab is not None and i is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for i, v, lab in rows]
    links, label = [0] * n, {r[0]: r[0] for r in rows}
    linked = []
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    linked.append((rows[i][0], rows[j][0]))
                    links[i] += 1
                    links[j] += 1
    for _ in range(n):
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return sorted(((r[0], k, label[r[0]], label[r[0]] == r[0]) for r, k in zip(rows, links, strict=True)), key=str)


@pytest.mark.parametrize("leaf", [4096, 64])
def test_against_brute_force(spark, leaf):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    rows = [(int(i), (centres[i % 40] + rng.standard_normal(16) * rng.choice([0.01, 0.15, 0.3])).tolist(), int(i % 40 % 3)) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)] + [(1100, rows[0][1], 1), (1101, rows[0][1], None), (1102, None, 0), (1103, [0.0] * 16, 0), (1104, [float("nan")] * 16, 0), (1105, [None, 1.0], 0), (1106, [1.0, 2.0], 0), (1107, [2.0, 4.0], 0), (1108, [], 0), (None, rows[0][1], 0), (1109, [float("inf"), 1.0], 0), (5, rows[5][1], 2)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, codes string, node int")
    got = sorted((tuple(r) for r in embedding_dedup(df, leaf=leaf, trees=12).collect()), key=str)
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    if leaf == 4096:
        assert got == want
    assert embedding_dedup(df.limit(0)).collect() == []


def test_hot_group_of_distinct_near_copies(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64)
    x = np.concatenate((centre / np.linalg.norm(centre) + rng.standard_normal((2000, 64)) * 0.033, rng.standard_normal((4000, 64)))).astype(np.float32)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup(df, leaf=128).collect()}
    assert 200_000 < want.sum() < 2000 * 1999 and [got[i] for i in range(len(x))] == want.tolist()


@pytest.mark.parametrize(("rows", "levels"), [(1 << 20, 8), (1 << 24, 13)])
def test_forest_grows_with_its_depth(rows, levels):
    """Trees deeper than the sample can be split still hold nearly all pairs at the threshold, and their leaves stay small."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    forest = Forest.fit(x, rows, 8, 2048, 0.1, 64, 5, 0.93)
    assert forest.directions.shape[1] >= levels and forest.base <= 10
    (r, t, a), (q, s, b) = forest.route(x), forest.route(y)
    held = {k[0] for k in set(zip(r.tolist(), t.tolist(), a.tolist(), strict=True)) & set(zip(q.tolist(), s.tolist(), b.tolist(), strict=True))}
    assert len(held) >= 0.997 * len(x)
    fresh = rng.standard_normal((50_000, 64))  # not those it was fitted on
    _, t, a = forest.route(fresh / np.linalg.norm(fresh, axis=1, keepdims=True))
    leaves = np.unique(t << 40 | a, return_counts=True)[1]
    assert np.quantile(leaves, 0.99) * rows / len(fresh) < 16 * 2048


def test_large_and_small_components(spark):
    vectors = [[1e200, 0.0], [1e200, 1e190], [1e-200, 0.0], [5e-324, 0.0], [0.0, 1e300], [0.0, 0.0], [-1e-300, 1e-300], [-3.0, 3.0]]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 6)}


def test_large_leaves_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 16 * 64)
    monkeypatch.setattr(module, "TILE", 64)
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((60, 16))[np.arange(900) % 60] + rng.standard_normal((900, 16)) * 0.2).astype(np.float32)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup(df, leaf=2000).collect()}
    assert want.sum() > 1000 and [got[i] for i in range(len(x))] == want.tolist()
