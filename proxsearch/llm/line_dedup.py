"""Line dedup over range-partitioned line hashes, returning a keep bitmap per document."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, key_filter, materialize, may_pass, partitions, pick

NO_ID = -(1 << 63)


def line_keys(text: str, min_chars: int = 1) -> list[bytes | None]:
    """Key of each line: without ASCII white space at its ends, A-Z lower-cased; None if under ``min_chars``."""
    keys = [line.strip() for line in text.encode().lower().split(b"\n")]
    return [k if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars) else None for k in keys]


def pack_bits(n: int, dropped: list[int]) -> bytes:
    """Compressed bitmap of ``n`` lines, 1 for those that stay."""
    keep = np.ones(n, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bits(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n).astype(bool)


_RUN = "h1 long, h2 long, n_docs long, n_lines long, first_did long, first_th long, first_pos int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted (h1, h2, did, th, pos); one row per hash met more than once, or at an end of the partition."""
    names = [c.split()[0] for c in _RUN.split(", ")]
    kinds = [pa.int32() if c.endswith("int") else pa.int64() for c in _RUN.split(", ")]
    open_, last, edge = None, None, True

    def emit(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, did, th, pos = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "did", "th", "pos"))

        def changed(x: np.ndarray, before: int | None) -> np.ndarray:
            return np.concatenate(([before is None or x[0] != before], x[1:] != x[:-1]))

        was = last or (None,) * 4
        group = changed(h1, was[0]) | changed(h2, was[1])
        doc = group | changed(did, was[2]) | changed(th, was[3])
        last = (h1[-1], h2[-1], did[-1], th[-1])
        starts = np.flatnonzero(group)
        head = int(starts[0]) if len(starts) else len(h1)
        if head:
            open_[2] += int(doc[:head].sum())
            open_[3] += head
        if not len(starts):
            continue
        rows = []
        if open_ is not None and (edge or open_[3] > 1):
            rows.append(open_)
        edge = open_ is None
        n_lines = np.diff(np.append(starts, len(h1)))
        n_docs = np.add.reduceat(doc.astype(np.int64), starts)
        closed = np.flatnonzero(n_lines[:-1] > 1).tolist()
        if edge and len(starts) > 1 and (not closed or closed[0] != 0):
            closed.insert(0, 0)
        pick_ = [*closed, len(starts) - 1]
        s = starts[pick_]
        new = [list(r) for r in zip(h1[s].tolist(), h2[s].tolist(), n_docs[pick_].tolist(), n_lines[pick_].tolist(), did[s].tolist(), th[s].tolist(), pos[s].tolist(), strict=True)]
        rows += new[:-1]
        edge = edge and len(starts) == 1
        open_ = new[-1]
        if rows:
            yield emit(rows)
    if open_ is not None:
        yield emit([open_])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        where = [sorted(set(x)) for x in b.column("dropped").to_pylist()]
        bits = [pack_bits(n, x) for n, x in zip(b.column("n_lines").to_pylist(), where, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("did"), b.column("th"), pa.array([len(x) for x in where], pa.int64()), pa.array(bits, pa.binary())], names=["did", "th", "n_dropped", "keep_bits"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and what names the row: did (doc_id, or a constant for null) and th (hash of the text)."""
    d = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumns({"did": F.coalesce("doc_id", F.lit(NO_ID)), "th": F.xxhash64("text")})


def line_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """(did, th, n_dropped, keep_bits) of each document that loses a line; keep_bits is pack_bits of its lines.

    Lines whose key is in ``min_docs`` documents go: all of them (keep="none"), or all but the first by
    doc_id and position (keep="first", where a key met twice in one document counts from min_docs = 1 on).
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep: {keep!r}")
    spark = docs.sparkSession
    d = _rows(docs, id_col, text_col)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for did, th, text in zip(*(b.column(c).to_pylist() for c in ("did", "th", "text")), strict=True):
                keys = line_keys(text, min_chars)
                on = [i for i, k in enumerate(keys) if k is not None]
                for c, v in zip(cols, ([did] * len(on), [th] * len(on), [len(keys)] * len(on), on, [xxhash.xxh3_128_digest(keys[i]) for i in on]), strict=True):
                    c += v
            h = np.frombuffer(b"".join(cols[4]), "<i8").reshape(-1, 2)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=False)), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["did", "th", "n_lines", "pos", "h1", "h2"])

    lines = materialize(d.select("did", "th", "text").mapInArrow(hashes, "did long, th long, n_lines int, pos int, h1 long, h2 long"))
    total = lines.count()
    order = ["h1", "h2", "did", "th"]
    ranged = lines.select(*order, "pos").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "pos")
    first = F.struct("first_did", "first_th", "first_pos")
    found = ranged.mapInArrow(_runs, _RUN).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_lines").alias("weight"), F.min(first).alias("first"))
    over = found.where((F.col("n_docs") >= min_docs) & ((F.col("weight") > 1) | F.lit(keep == "none")))
    over = materialize(over.select("h1", "h2", "weight", "first.*"))
    hit = join_unique(may_pass(lines, key_filter(over, "h1"), "h1"), over, ["h1", "h2"], "weight", total, "inner")
    if keep == "first":
        hit = hit.where(~((F.col("did") == F.col("first_did")) & (F.col("th") == F.col("first_th")) & (F.col("pos") == F.col("first_pos"))))
    per_doc = hit.groupBy("did", "th").agg(F.max("n_lines").alias("n_lines"), F.collect_list("pos").alias("dropped"))
    return materialize(per_doc.mapInArrow(_bitmaps, "did long, th long, n_dropped long, keep_bits binary"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, bits in zip(b.column("text").to_pylist(), b.column("keep_bits").to_pylist(), strict=True):
            if bits is not None:
                lines = text.split("\n")
                text = "\n".join([lines[i] for i in np.flatnonzero(unpack_bits(bits, len(lines)))])
            out.append(hashlib.sha256(text.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_lines", "n_dropped")), pa.array(out, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines (before dropping), n_dropped, kept_sha256.

    Nulls: a null text counts as empty, which is one empty line; a null doc_id is an id of its own.
    Empty lines (keys under min_chars) always stay. Rows that repeat both doc_id and text are one
    document when documents are counted, and all of them lose the lines. Empty input gives no rows.
    Other columns are ignored. Texts of documents that lose nothing aren't moved.
    """
    marks = line_marks(docs, id_col, text_col, **how)
    d = _rows(docs, id_col, text_col).withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long"))
    filt = key_filter(marks, "th")
    cut = may_pass(d, filt, "th").join(marks.hint("merge"), ["did", "th"], "left").withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0).cast("long")))
    cut = cut.select("doc_id", "n_lines", "n_dropped", "text", "keep_bits").mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    whole = may_pass(d, filt, "th", False).select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
    return cut.unionByName(whole)
