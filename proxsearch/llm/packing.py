"""Packing into fixed-length sequences: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, pick
from .tokens import encoder


@dataclass
class Pattern:
    """``count`` sequences alike, each filled in turn by (length, times)."""

    count: int
    fill: int = 0
    parts: list[tuple[int, int]] = field(default_factory=list)

    def plus(self, count: int, length: int, times: int) -> Pattern:
        return Pattern(count, self.fill + length * times, [*self.parts, (length, times)])


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[Pattern]:
    """Packing patterns for ``histogram`` (length to number of pieces).

    Lengths are placed longest first, each piece in the shortest pack if it has room, else in a new
    one; all packs of a pattern move on together, so the work depends on the histogram alone: a
    length adds at most three patterns, so there are no more than 3 * ``size``.
    """
    if any(not 0 < n <= size for n in histogram):
        raise ValueError(f"lengths must be from 1 to {size}")
    heap: list[tuple[int, int, Pattern]] = []
    serial = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and heap and heap[0][0] + length <= size:
            _, _, p = heapq.heappop(heap)
            take = min(left, p.count)
            heapq.heappush(heap, (p.fill + length, serial := serial + 1, p.plus(take, length, 1)))
            if take < p.count:
                heapq.heappush(heap, (p.fill, serial := serial + 1, Pattern(p.count - take, p.fill, p.parts)))
            left -= take
        each = size // length
        for count, times in ((left // each, each), (min(1, left % each), left % each)):
            if count:
                heapq.heappush(heap, (length * times, serial := serial + 1, Pattern(count).plus(count, length, times)))
    return [p for _, _, p in sorted(heap, key=lambda x: x[1])]


def intervals(patterns: list[Pattern], histogram: dict[int, int]) -> dict[str, np.ndarray]:
    """Where pieces go, by rank in the order of lengths: from rank ``first`` on, piece i is in
    sequence ``base + (i - first) // times`` at ``offset + (i - first) % times * length``."""
    at, rank = {}, 0
    for length in sorted(histogram):
        at[length] = rank
        rank += histogram[length]
    rows, base = [], 0
    for p in patterns:
        offset = 0
        for length, times in p.parts:
            rows.append((at[length], base, offset, times, length))
            at[length] += p.count * times
            offset += length * times
        base += p.count
    rows.sort()
    return {k: np.array(c, np.int64) for k, c in zip(("first", "base", "offset", "times", "length"), zip(*rows, strict=True) if rows else [()] * 5, strict=True)}


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``size`` and a rest: one row per piece, without the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        enc = encoder(tokenizer)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                rows += [(doc, s, min(size, n - s), zlib.crc32(ids[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
            names = [c.split()[0] for c in _PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 5)], names=names)

    d = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(cut, _PIECE)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``docs`` with their places: _PIECE, sequence_id, offset.

    Only lengths and places move, never ids. The driver sees the histogram (at most ``size`` numbers)
    and makes patterns of it. Pieces sorted by length get ranks from their place in the sorted table,
    and a rank tells pattern, sequence and offset by one search in at most 3 * ``size`` patterns' parts.

    Nulls: a null text counts as empty, which is ``end_id`` alone; null doc_ids are kept. Repeated
    rows are packed each. Long texts are cut, at every ``size`` ids. Empty input gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    found = materialize(token_pieces(docs, tokenizer, end_id, size, id_col, text_col))
    order = ["length", "doc_id", "start", "ids_crc32", "doc_tokens"]
    ranged = found.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    # the place within a partition is written beside the row, so that it doesn't depend on how files are read again
    placed = materialize(ranged.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    histogram = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = dict(zip([p for p, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    where = intervals(shortest_pack_first(histogram, size), histogram)
    sent = spark.sparkContext.broadcast((before, where))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, w = sent.value
        for b in batches:
            m = b.column("_m").to_numpy()
            parts, inverse = np.unique(m >> 33, return_inverse=True)
            rank = np.array([before[p] for p in parts.tolist()], np.int64)[inverse] + (m & ((1 << 33) - 1))
            i = np.searchsorted(w["first"], rank, "right") - 1
            turn = rank - w["first"][i]
            seq = w["base"][i] + turn // w["times"][i]
            offset = w["offset"][i] + turn % w["times"][i] * w["length"][i]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], names=[*b.schema.names[:5], "sequence_id", "offset"])

    cols = [c.split()[0] for c in _PIECE.split(", ")]
    return placed.select(*cols, "_m").mapInArrow(place, f"{_PIECE}, sequence_id long, offset long")
