import zlib

import numpy as np
import pyarrow as pa

from proxsearch.llm.language_id import HashTable, Model, byte_grams, identify
from proxsearch.llm import quality
from proxsearch.llm.quality import THRESHOLD, forward_backward, good_documents, line_features, score_quality, text_features

from .fixtures import AWKWARD, docs_of

ENGLISH = "the cat and the dog were in the house with all of their friends that day"
FRENCH = "le chat et le chien étaient dans la maison avec tous leurs amis ce jour-là"


def crc(d, n):
    return zlib.crc32(b"" if d is None else str(d).encode()) % n


def test_hash_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 60, 5000, dtype=np.uint64))
    t = HashTable(keys[::2])
    assert t.find(keys[::2]).tolist() == list(range(len(keys[::2]))) and (t.find(keys[1::2]) < 0).all()


def test_byte_grams():
    got = [(row, first.tolist(), grams.tolist()) for row, first, grams in byte_grams(pa.array(["ab", "", "c"]))]
    lf = 10 * (1 << 24 | 1 << 16 | 1 << 8)
    assert got == [(0, [0, 2, 2, 3], [10 << 32 | lf | 97, 10 << 32 | (10 << 24 | 10 << 16 | 97 << 8) | 98 | 10 << 24, 10 << 32 | lf | 99])]


def naive_bits(train, text, order=4):
    """Code length of ``text`` under frozen PPM counts, escape method C."""
    pad = b"\n" * order
    counts = {}
    for t in train:
        s = pad + t
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(s[i - k : i], {}).setdefault(s[i], 0)
                counts[s[i - k : i]][s[i]] += 1
    total, s = 0.0, pad + text
    for i in range(order, len(s)):
        p = 1.0
        for k in range(order, -1, -1):
            c = counts.get(s[i - k : i], {})
            n, d = sum(c.values()), len(c)
            if s[i] in c:
                p *= c[s[i]] / (n + d)
                break
            p *= d / (n + d) if n else 1
        else:
            p /= 256
        total -= np.log2(p)
    return total


def test_code_lengths_are_exact():
    train = {0: [ENGLISH.encode(), b"the end"], 1: [FRENCH.encode()]}
    grams = [(lang, g) for lang, ts in train.items() for t in ts for _, _, gs in byte_grams(pa.array([t.decode()])) for g in gs]
    lang, gram = np.array([x for x, _ in grams]), np.array([g for _, g in grams], np.uint64)
    m = Model.build(["en", "fr"], np.array([2, 1]), lang, gram, np.ones(len(gram), np.int64))
    for text in ("the house", "le chat", "zzz 漢", "éé the"):
        (_, _, gs), = byte_grams(pa.array([text]))
        assert np.allclose(m.code_lengths(gs).sum(0), [naive_bits(train[i], text.encode()) for i in (0, 1)], rtol=1e-4)


def test_identify(spark):
    rows = [(i, ENGLISH[i % 20 :], "en") if i % 2 else (i, FRENCH[i % 20 :], "fr") for i in range(200)] + [(900 + i, t, None) for i, (_, t) in enumerate(AWKWARD)] + [(None, None, "xx"), (990, "123 !?", "en"), (991, "", "fr")]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, held_out string")).collect()}
    assert len(got) == len(rows)
    assert all(got[d]["lang_pred"] == lang and got[d]["score"] > 0.9 for d, _, lang in rows[:200])
    assert all(r["held_out"] == (crc(d, 5) == 0) and 0 <= r["score"] <= 1 for d, r in got.items())
    assert all(got[d]["lang_pred"] == "und" for d in (None, 990, 991))
    none = identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert [tuple(r) for r in none] == [(1, False, "und", 0.0)]
    assert identify(docs_of(spark, [])).collect() == []


def test_forward_backward_against_all_labellings():
    import itertools

    rng = np.random.default_rng(1)
    first, score, moves = np.array([0, 4, 5, 8]), rng.standard_normal(8), rng.standard_normal((2, 2))
    p, pairs = forward_backward(first, score, moves)
    want_pairs = np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        total, marginal = 0.0, np.zeros(b - a)
        own = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(score[a:b] @ np.array(y) + sum(moves[i, j] for i, j in zip(y, y[1:], strict=False)))
            total += w
            marginal += w * np.array(y)
            for i, j in zip(y, y[1:], strict=False):
                own[i, j] += w
        assert np.allclose(p[a:b], marginal / total)
        want_pairs += own / total
    assert np.allclose(pairs, want_pairs)


def test_line_features():
    (row, first, size, x), = text_features(pa.array(["Ab 12\n\nab ab ab", "", "\n"]))
    assert row == 0 and first.tolist() == [0, 3, 4, 6] and size.tolist() == [5, 0, 8, 0, 0, 0]
    assert np.isclose(x[0, 0], 0.2) and np.isclose(x[0, 2], 0.4) and x[2, 18] == 1 and line_features


def test_quality(spark):
    good, bad = (ENGLISH + ". ") * 3, "BUY!! NOW!! ### $$$ BUY!! NOW!! "
    pairs = [(i, "\n".join([good[i % 9 :] if i % 3 else bad * 2] * (1 + i % 4) + [good] * (i % 2))) for i in range(240)]
    labels = spark.createDataFrame([(d, int(d % 3 > 0), "x") for d, _ in pairs[:200]] + [(1, None, "x"), (2, 7, "x"), (None, 1, "x")], "doc_id long, quality int, score string")
    every = [*pairs, *((1000 + (d or 0), t) for d, t in AWKWARD), (None, None)]
    rows = score_quality(docs_of(spark, every), labels).collect()
    assert len(rows) == len(every)
    got = {r["doc_id"]: r for r in rows}
    assert all(got[d]["predicted"] == int(d % 3 > 0) for d, _ in pairs)
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= THRESHOLD) for r in rows)
    docs = docs_of(spark, every)
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert {r["score"] for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert good_documents(docs, labels.limit(0)).count() == len(every)
    assert score_quality(docs_of(spark, []), labels).collect() == []


def test_long_chains_step_in_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = [1, 2, 3, 700, 4, 5, 9, 16, 17, 1300, 10]
    first = np.concatenate(([0], np.cumsum(sizes)))
    score, moves = rng.standard_normal(first[-1]) * 3, rng.standard_normal((2, 2)) * 2
    monkeypatch.setattr(quality, "LONG_CHAIN", 10**9)
    want = forward_backward(first, score, moves)
    for most in (1, 3, 512):
        monkeypatch.setattr(quality, "LONG_CHAIN", most)
        got = forward_backward(first, score, moves)
        assert all(np.allclose(g, w, rtol=1e-9, atol=1e-12) for g, w in zip(got, want, strict=True))


def plain_crf(chains, labels, rounds, texts):
    """Crf.fit and score with loops over paths' sums, one line at a time: scores of ``texts``."""
    lines = np.concatenate([x for x, _ in chains])
    mean, scale = lines.mean(0), lines.std(0) + 1e-6

    def rows(x):
        z, n = (x - mean) / scale, len(x)
        none = np.zeros(x.shape[1])
        return [np.concatenate((z[i], z[i - 1] if i else none, z[i + 1] if i < n - 1 else none, [1, i == 0, i == n - 1])) for i in range(n)]

    def marginals(f, w, m):
        e = [np.array([0.0, r @ w]) for r in f]
        a, b = [e[0]], [np.zeros(2)]
        for i in range(1, len(f)):
            a.append(np.array([np.logaddexp(a[-1][0] + m[0, j], a[-1][1] + m[1, j]) + e[i][j] for j in (0, 1)]))
        for i in range(len(f) - 2, -1, -1):
            b.insert(0, np.array([np.logaddexp(m[j, 0] + e[i + 1][0] + b[0][0], m[j, 1] + e[i + 1][1] + b[0][1]) for j in (0, 1)]))
        z = np.logaddexp(*a[-1])
        pairs = sum((np.exp(a[i - 1][:, None] + m + (e[i] + b[i])[None, :] - z) for i in range(1, len(f))), np.zeros((2, 2)))
        return [float(np.exp(a[i][1] + b[i][1] - z)) for i in range(len(f))], pairs

    fs = [rows(x) for x, _ in chains]
    params, m1, m2 = np.zeros(len(fs[0][0]) + 4), 0, 0
    for step in range(1, rounds + 1):
        w, m, g, gm = params[:-4], params[-4:].reshape(2, 2), 0, np.zeros((2, 2))
        for f, y in zip(fs, labels, strict=True):
            p, pairs = marginals(f, w, m)
            g = g + sum(r * (y - q) for r, q in zip(f, p, strict=True))
            gm -= pairs
            gm[y, y] += len(f) - 1
        grad = np.concatenate((g, gm.ravel())) / len(lines) - quality.DECAY * params
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        params = params + quality.RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)

    def raw(x, size):
        p, _ = marginals(rows(x), params[:-4], params[-4:].reshape(2, 2))
        return sum(q * (n + 1) for q, n in zip(p, size, strict=True)) / sum(n + 1 for n in size)

    known = sorted((raw(*c), y) for c, y in zip(chains, labels, strict=True))
    good = sum(y for _, y in known)
    cost = [sum(y for _, y in known[:k]) / good + sum(1 - y for _, y in known[k:]) / (len(known) - good) for k in range(len(known) + 1)]
    best = [k for k, c in enumerate(cost) if c <= min(cost) + 1e-9]
    edges = [0.0, *(r for r, _ in known), 1.0]
    k = best[len(best) // 2]
    cut = min(max((edges[k] + edges[k + 1]) / 2, 0.02), 0.98)
    logit = lambda v: np.log(v / (1 - v))
    return [1 / (1 + np.exp(-(logit(min(max(raw(*t), 1e-6), 1 - 1e-6)) - logit(cut) + logit(THRESHOLD)))) for t in texts]


def test_scores_equal_a_plain_crf(spark, monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 8)
    texts = {i: "\n".join([ENGLISH[k % 9 :] if i % 3 else "BUY!! $$$ NOW" * (k + 1) for k in range(1 + i % 5)] + (["ok then, yes"] if i % 7 == 0 else [])) for i in range(60)}
    docs = docs_of(spark, [*texts.items(), (100, None), (101, ""), (102, "x\n" * 20)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 60)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in score_quality(docs, labels).collect()}

    def chain(t):
        (_, first, size, x), = text_features(pa.array([t]))
        return x.astype(float), size.tolist()

    train = [i for i in texts if crc(i, 4) != 2]
    every = [*texts, 100, 101, 102]
    want = plain_crf([chain(texts[i]) for i in train], [int(i % 3 > 0) for i in train], 8, [chain(texts.get(i, {102: "x\n" * 20}.get(i, ""))) for i in every])
    assert np.allclose([got[i] for i in every], want, rtol=1e-6)


def test_lines_of_the_sample_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_LINES", 40)
    docs = docs_of(spark, [(i, ENGLISH if i % 2 else "## $$ !!\n" * 3) for i in range(60)] + [(100, "## $$ !!\n" * 1000)])
    seen = []
    fit = quality.Crf.fit
    monkeypatch.setattr(quality.Crf, "fit", staticmethod(lambda first, x, size, label: seen.append(first[-1]) or fit(first, x, size, label)))
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(60), 100]], "doc_id long, quality int")
    assert score_quality(docs, labels).count() == 61 and 30 <= seen[0] <= 40


def test_languages_equal_plain_ppm(spark):
    texts = {i: (ENGLISH if i % 2 else FRENCH)[i % 30 :] + (" déjà vu" if i % 5 == 0 else "") for i in range(40)}
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in texts.items()] + [(100, "the maison", None), (101, "zz 漢字", None), (102, "12", None), (103, None, "en")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    train = [r for r in rows if r[1] is not None and r[2] and crc(r[0], 5)]
    share = {lang: -np.log2(sum(r[2] == lang for r in train) / len(train)) for lang in ("en", "fr")}
    for d, t, _ in rows:
        if d in (102, 103):
            assert got[d] == ("und", 0.0)
            continue
        bits = {lang: share[lang] + naive_bits([r[1].encode() for r in train if r[2] == lang], t.encode()) for lang in share}
        best = min(bits, key=bits.get)
        assert got[d][0] == best and abs(got[d][1] - 1 / sum(2 ** (bits[best] - b) for b in bits.values())) < 1e-3
