import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from proxsearch.llm.packing import intervals, pack, shortest_pack_first
from proxsearch.llm.queries import tokenizer_path
from proxsearch.llm.token_files import (
    STEP, canonical_codes, code_lengths, decode_ids, decode_table, encode_ids, qualified, read_file, token_digest, token_table, write_token_files,
)
from proxsearch.llm.tokens import Encoder

from .fixtures import AWKWARD, docs_of

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_library(name):
    e, rng = Encoder(tokenizer_path(name)), random.Random(3)
    assert e.kind
    alphabet = "abcXYZ 's't'RE don't 12 ½² \t\n\r\xa0éàÇßıİſŉ…—“”€™!?#<|endoftext|>­’漢Σς\x1c é"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(3000)] + [t or "" for _, t in AWKWARD]
    assert [t for t in texts if e.encode(t) != e.by_library(t)] == []


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(1)
    for n in (2, 3, 17, 300):
        w = (rng.pareto(1, n) * 100 + 1).astype(np.int64)
        heap = sorted(w.tolist())
        cost = 0
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        free = code_lengths(w, 40)
        assert (free * w).sum() == cost
        least = max(1, (n - 1).bit_length())
        tight = code_lengths(w, least)
        assert tight.max() <= least and (0.5 ** tight.astype(float)).sum() <= 1
    assert code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0] and not code_lengths(np.zeros(4)).any()


def test_codes_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, STEP, STEP + 1, 5000):
        ids = rng.zipf(1.3, n) % 3000
        lengths = code_lengths(np.bincount(ids, minlength=3000))
        payload, offsets = encode_ids(ids, lengths, canonical_codes(lengths))
        assert decode_ids(payload, offsets, n, decode_table(lengths)).tolist() == ids.tolist()


def expected(pairs, name, end):
    e = Encoder(tokenizer_path(name))
    return [(d, np.append(np.frombuffer(e.by_library(t or ""), "<u4"), end).astype("<u4")) for d, t in pairs]


def test_token_files(spark):
    got = [tuple(r) for r in token_digest(spark, docs_of(spark, AWKWARD), tokenizer_path(FILES[1])).collect()]
    crcs = [r[3] for r in sorted(got, key=lambda r: r[1])]  # settles the order of rows alike in id and length
    docs = sorted(expected(AWKWARD, FILES[1], 0), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), crcs.index(zlib.crc32(x[1].tobytes()))))
    start, want = 0, []
    for d, ids in docs:
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_digest(spark, docs_of(spark, []), tokenizer_path(FILES[1])).collect() == []


def test_token_files_hold_the_ids(spark, tmp_path):
    pairs = [p for p in AWKWARD if p[0] is not None]
    table = token_table(docs_of(spark, pairs), tokenizer_path(FILES[1]), 0)
    files = sorted(write_token_files(table, f"file://{tmp_path}/ids", 50257).collect())
    read = [(d, ids.tolist()) for f in files for d, ids in read_file(f["file"])]
    assert sorted(read) == sorted((d, ids.tolist()) for d, ids in expected(pairs, FILES[1], 0))
    assert [d for d, _ in read] == sorted(d for d, _ in read)
    # many small files, without a scheme in the path; a file that was cut short is refused
    files = sorted(write_token_files(table, str(tmp_path / "small"), 50257, file_ids=50).collect())
    assert len(files) >= 5 and sum(f["n_docs"] for f in files) == len(pairs)
    assert [f["start"] for f in files] == [sum(f["n_tokens"] for f in files[:k]) for k in range(len(files))]
    assert [(d, ids.tolist()) for f in files for d, ids in read_file(f["file"])] == read
    name = files[0]["file"].removeprefix("file://")
    with open(name, "rb") as f:
        part = f.read()[:-3]
    with open(name, "wb") as f:
        f.write(part)
    with pytest.raises(ValueError):
        list(read_file(files[0]["file"]))


def test_qualified_paths(spark):
    assert qualified(spark, "/a/b") == qualified(spark, "file:///a/b") == "file:///a/b"


def naive_shortest_pack_first(lengths, size):
    packs = []
    for n in sorted(lengths, reverse=True):
        if packs and min(packs) + n <= size:
            packs[packs.index(min(packs))] += n
        else:
            packs.append(n)
    return sorted(packs)


def test_patterns_equal_packing_one_by_one():
    rng = random.Random(4)
    for _ in range(60):
        size = rng.choice((10, 64, 256))
        lengths = [min(size, max(1, int(rng.expovariate(4 / size)))) for _ in range(rng.randrange(1, 400))] + [size // 3] * rng.choice((0, 200))
        patterns = shortest_pack_first(dict(Counter(lengths)), size)
        assert sorted(p.fill for p in patterns for _ in range(p.count)) == naive_shortest_pack_first(lengths, size)
        assert len(patterns) <= 3 * size
        where = intervals(patterns, dict(Counter(lengths)))
        assert len(where["first"]) == len(set(where["first"].tolist()))
    assert shortest_pack_first({}, 10) == [] and len(intervals([], {})["first"]) == 0


def test_pack(spark):
    size, pairs = 64, [*AWKWARD, *((100 + i, f"short text {i % 5}") for i in range(40))]
    rows = pack(docs_of(spark, pairs), tokenizer_path(FILES[0]), 2, size).collect()
    docs = expected(pairs, FILES[0], 2)
    want = Counter((d, s, min(size, len(i) - s), zlib.crc32(i[s : s + size].tobytes()), len(i)) for d, i in docs for s in range(0, len(i), size))
    assert Counter(tuple(r)[:5] for r in rows) == want
    packed = defaultdict(list)
    for r in rows:
        packed[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(packed) == list(range(len(packed)))
    for parts in packed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert pack(docs_of(spark, []), tokenizer_path(FILES[0])).collect() == []
