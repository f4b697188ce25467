import random
import re

import numpy as np
import pyarrow as pa
import pytest

from proxsearch.llm import minhash
from proxsearch.llm import words as w
from proxsearch.llm.graph import components
from proxsearch.llm.minhash import Sketcher, near_dedup

from .fixtures import AWKWARD, docs_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_words_and_grams(monkeypatch):
    monkeypatch.setattr(w, "CHUNK", 200)
    rng, seen, i = random.Random(1), {}, 0
    texts = ["".join(rng.choice("ab AB\t\n\x0b é") for _ in range(rng.randrange(30))) for _ in range(1000)] + ["", "x" * 500]
    for c in w.words(pa.array(texts)):
        for k in range(len(c)):
            want, got = WORD.findall(texts[i]), c.of(k)
            assert [c.text(c.first[k] + j).decode() for j in range(len(want))] == want and len(got) == len(want)
            for n in (1, 2, 3, 5, 7):
                for j, h in enumerate(w.grams(got, n, 5).tolist()):
                    assert seen.setdefault((n, *want[j : j + n]), h) == h
            i += 1
    assert i == len(texts) and len(set(seen.values())) == len(seen)


def test_sketch_estimates_jaccard():
    rng, s = np.random.default_rng(1), Sketcher(192)
    for n, common in ((40, 30), (600, 300), (3, 3)):
        hits = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            hits.append((s(x[:n]) == s(x[n - common :])).mean())
        assert abs(np.mean(hits) - common / (2 * n - common)) < 0.03
        assert (s(x[:1]) < 1 << 53).all()


def brute(pairs, percent=85):
    sets, ids = [], []
    for d, t in pairs:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set())
        ids.append(d)
    label = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if ids[i] is not None and ids[j] is not None and a and b and label[ids[i]] != label[ids[j]] and 100 * len(a & b) >= percent * len(a | b):
                    low = min(label[ids[i]], label[ids[j]])
                    label[ids[i]] = label[ids[j]] = low
                    changed = True
    return sorted(((d, len(s), label[d], d == label[d] if d is not None else True) for d, s in zip(ids, sets, strict=True)), key=str)


def test_sets_that_do_not_fit_are_members(monkeypatch):
    """With room for few sets a group's members still part or link as with room for all."""
    texts = {i: " ".join(f"w{k}" if k % 9 or k // 9 % 7 != i % 7 else f"x{i}y{k}" for k in range(120)) for i in range(1, 9)}
    rows = [(1, s, texts[s], None) for s in (1, 2, 3, 4)] + [(1, None, texts[x], x) for x in range(2, 9)]
    batch = pa.RecordBatch.from_pydict({"c": pa.array([1] * len(rows), pa.int64()), "salt": pa.array([0] * len(rows), pa.int64()), "x": pa.array([x for *_, x in rows], pa.int64()), "s": pa.array([s for _, s, *_ in rows], pa.int64()), "text": [t for _, _, t, _ in rows]})
    for room, held in ((1 << 22, {1, 2, 3, 4}), (300, {1, 2}), (1, {1})):
        monkeypatch.setattr(minhash, "SET_ITEMS", room)
        got = [r for b in minhash._compare(3, 85)(iter([batch])) for r in b.to_pylist()]
        assert {r["x"] for r in got} == set(range(2, 9)) and {r["x"] for r in got if not r["near"]} == held - {1}
        for r in got:
            links = {s for s in held - {r["x"]} if jaccard(texts[s], texts[r["x"]]) >= 0.85}
            assert set(r["links"]) == links


@pytest.mark.parametrize("hits", [1 << 18, 50])
def test_inverted_lists_count_as_set_by_set(monkeypatch, hits):
    monkeypatch.setattr(minhash.Around, "HITS", hits)
    rng = np.random.default_rng(8)
    some = lambda: np.unique(rng.integers(0, 400, int(rng.integers(1, 200)), dtype=np.uint64))
    texts = [(s, some()) for s in sorted(rng.integers(0, 25, 40).tolist())]
    around = minhash.Around(texts)
    for _ in range(20):
        items = some()
        both, known = around.shared(items)
        assert both.tolist() == [len(np.intersect1d(one, items)) for _, one in texts]
        assert known.tolist() == [len({s for s, one in texts if v in one}) for v in items]


def test_joins_make_the_components_of_links_and_are_few():
    texts = {i: " ".join(f"w{k}" if k != i else f"x{i % 50}" for k in range(100 + 500 * (i % 2))) for i in range(100)}
    rows = [(s, None) for s in range(60)] + [(None, x) for x in range(1, 100)]
    batch = pa.RecordBatch.from_pydict({"c": pa.array([0] * len(rows), pa.int64()), "salt": pa.array([0] * len(rows), pa.int64()), "x": pa.array([x for _, x in rows], pa.int64()), "s": pa.array([s for s, _ in rows], pa.int64()), "text": [texts[s if x is None else x] for s, x in rows]})
    got = [r for b in minhash._compare(3, 85)(iter([batch])) for r in b.to_pylist()]

    def parts(name):
        label = {x: x for x in texts}
        for r in got:
            for s in r[name]:
                a, b = label[s], label[r["x"]]
                label = {x: min(a, b) if v in (a, b) else v for x, v in label.items()}
        return label

    assert parts("joins") == parts("links") == {x: x % 2 for x in texts}
    assert all(set(r["joins"]) <= set(r["links"]) for r in got)
    assert sum(len(r["links"]) for r in got) > 2500 > 200 > sum(len(r["joins"]) for r in got)


def jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_dedup(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(80)] for _ in range(6)]
    pairs, n = list(AWKWARD), 100
    for b in base:  # chains and stars around the threshold, within one bucket or not
        text = list(b)
        for _ in range(12):
            pairs.append((n, " ".join(text)))
            n += 1
            for _ in range(rng.choice((1, 1, 2, 4))):
                text[rng.randrange(80)] = f"w{rng.randrange(5000)}"
        pairs += [(n + k, " ".join(b)) for k in range(5)]
        n += 5
    rng.shuffle(pairs)
    got = sorted((tuple(r) for r in near_dedup(docs_of(spark, pairs)).collect()), key=str)
    assert got == brute(pairs)
    assert near_dedup(docs_of(spark, [])).collect() == []


def template(rng, n, size=100):
    """Documents of one template (Jaccard about 0.77, none linked): some words of it replaced by own ones."""
    base = [f"t{i}" for i in range(size)]
    at = sorted(rng.sample(range(size), size))[:: size // 4][:4]
    return [" ".join(f"own{k}x{i}" if i in at else w for i, w in enumerate(base)) for k in range(n)]


@pytest.mark.parametrize("n", [400, 2000])
def test_a_template_is_not_compared_pair_by_pair(spark, monkeypatch, n):
    texts, tested, verify = template(random.Random(3), n), [], minhash._verify
    a, b = ({tuple(t.split()[i : i + 3]) for i in range(98)} for t in texts[:2])
    assert 0.7 < len(a & b) / len(a | b) < 0.85

    def counted(docs, pairs, *rest):
        tested.append(pairs.count())
        return verify(docs, pairs, *rest)

    monkeypatch.setattr(minhash, "_verify", counted)
    got = near_dedup(docs_of(spark, list(enumerate(texts)))).collect()
    assert all(r["kept"] for r in got) and len(got) == n
    assert sum(tested) < 0.1 * n * (n - 1) / 2, tested


def test_a_group_of_hundreds_is_done_in_one_round(spark, monkeypatch):
    texts, rounds, verify = template(random.Random(3), 300), [], minhash._verify
    # members that link in the end: one own word in the middle of another's text
    texts += [" ".join(w if j != 50 else f"z{i}" for j, w in enumerate(t.split())) for i, t in enumerate(texts[:20])]
    monkeypatch.setattr(minhash, "_verify", lambda *a: rounds.append(a[-1]) or verify(*a))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(docs_of(spark, list(enumerate(texts)))).collect()}
    assert got == {i: i if i < 300 else i - 300 for i in range(320)} and len(rounds) <= 2, rounds


def edited(rng, n, size=80, most=25):
    """Near copies of one text, 1 to ``most`` words of each replaced, taken out or put in: about half are linked with it."""
    base, out = [f"t{i}" for i in range(size)], []
    for k in range(n):
        text = list(base)
        for j in range(1 + int(most * rng.random() ** 3)):
            at = rng.randrange(len(text))
            text[at : at + rng.choice((0, 1, 1))] = rng.choice(([], [f"own{k}x{j}"], [f"own{k}x{j}"], [f"few{rng.randrange(9)}"]))
        out.append(" ".join(text))
    return [" ".join(base), *out]


@pytest.mark.parametrize("sets", [2, 20, 512])
def test_buckets_meet(sets):
    """Whatever the reference, any two that are linked share a bucket, unless both are linked with the reference."""
    rng, tried, of = random.Random(sets), 0, {}
    texts = edited(rng, 90, 100, 40)
    copies = [" ".join(word if k != 50 else f"z{i}" for k, word in enumerate(t.split())) for i, t in enumerate(texts)]
    for t in texts + copies:
        items = np.unique(minhash.shingles(next(w.words(pa.array([t]))).of(0), 3))
        of[items.tobytes()] = items
    of = list(of.values())
    rng.shuffle(of)
    around = minhash.Around([(k, items) for k, items in enumerate(of[-sets:])])
    reference, met = of[-sets:][around.reference], []
    alike = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    for items in of:
        linked = alike(items, reference)
        met.append((items, linked, *(set(v.tolist()) for v in around.buckets(items, linked, 7, 85))))
    for i, (x, joined, near, far) in enumerate(met):
        for y, joined2, near2, far2 in met[:i]:
            if not (joined and joined2) and alike(x, y):
                tried += 1
                assert near & (near2 | far2) or near2 & (near | far)
    assert tried > 20
    # what the reference has isn't listed again for every text
    assert sets == 2 or len(around.text) < 0.6 * around.size.sum()


def test_near_copies_of_one_text_in_few_rounds(spark, monkeypatch):
    """With room for few sets the rest of a large family of near copies is found by buckets, not by ever new centres."""
    monkeypatch.setattr(minhash, "SETS", 8)
    monkeypatch.setattr(minhash, "MOST_SETS", 8)
    texts, tested, verify = edited(random.Random(2), 500), [], minhash._verify

    def counted(docs, pairs, *rest):
        tested.append(pairs.count())
        return verify(docs, pairs, *rest)

    monkeypatch.setattr(minhash, "_verify", counted)
    pairs = list(enumerate(texts))
    got = sorted((tuple(r) for r in near_dedup(docs_of(spark, pairs)).collect()), key=str)
    assert got == brute(pairs)
    assert sum(tested[1:]) < 8 * len(pairs) and len(tested) <= 8, tested


def test_prefixes_meet():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        common = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        x, y = (np.unique(np.concatenate((common, rng.integers(0, 1 << 62, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)))) for _ in range(2))
        if len(x) < len(y):
            x, y = y, x
        if 100 * len(np.intersect1d(x, y)) < 85 * len(np.union1d(x, y)):
            continue
        centre = np.concatenate((rng.choice(common, n // 2), rng.choice(x, len(x) // 3)))
        near, far = zip(*(minhash.prefixes(s, np.isin(s, centre), 7, 85) for s in (x, y)), strict=True)
        assert np.isin(near[1], np.concatenate((near[0], far[0]))).any()
    with pytest.raises(ValueError):
        Sketcher(257)


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(50)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    for most in (1 << 20, 10):  # on the driver, and in rounds
        got = components(spark.createDataFrame(edges, "a long, b long"), driver_links=most)
        assert {r["node"]: r["component"] for r in got.collect()} == label and got.count() == len(label)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
