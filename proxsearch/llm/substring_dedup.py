"""Substring dedup with a log-structured index of window fingerprints.

A window is ``window`` consecutive words of one document. Of the q-grams in a window (q a third of it), the
one of least hash is its fingerprint, so equal windows have equal fingerprints at equal places, while
only about 2 / (window - q) of all positions are stored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import newest_text, put_numbered
from .common import delete, discard, join_unique, key_filter, materialize, may_pass, partitions, pick, shared_dir
from .words import Words, grams, words

NO_ID = -(1 << 63)


def gram_size(window: int) -> int:
    return max(1, window // 3, window - 48)  # a segment's windows, at most 49, fit one mask


def minimizers(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram hash at each position, and for each window the (leftmost) position of its least gram."""
    q = gram_size(window)
    g = grams(hashes, q, 21)
    span = window - q + 1
    if len(g) < span:
        return g, np.zeros(0, np.int64)
    # least of each run of `span` by doubling: (hash, position) pairs stay together, earlier positions win ties
    least, at, width = g, np.arange(len(g)), 1
    while width < span:
        step = min(width, span - width)
        a, b = least[: len(least) - step], least[step:]
        right = b < a
        least, at = np.where(right, b, a), np.where(right, at[step:], at[: len(at) - step])
        width += step
    return g, at


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and what names the row: did (doc_id, or a constant for null) and th (hash of the text)."""
    d = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumns({"did": F.coalesce("doc_id", F.lit(NO_ID)), "th": F.xxhash64("text")})


def _chunk_minimizers(chunk: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of a chunk, in order: start (word of the chunk), fingerprint, place of the fingerprint.

    All documents go through one pass; windows that cross from one into the next are left out.
    """
    g, at = minimizers(chunk.hashes, window)
    sizes = np.diff(chunk.first)
    doc = np.repeat(np.arange(len(chunk)), sizes)
    start = np.flatnonzero(doc[: len(at)] == doc[window - 1 :][: len(at)]) if len(at) else np.zeros(0, np.int64)
    at = at[start]
    return start, g[at], at


_BODY_BYTES = 16 << 20
_SEGMENT = "f long, did long, th long, start int, size int, s1 long, s2 long, body string"
#: Of a stored index; raised when what it stores changes.
_LAYOUT = 2


def segments(docs: DataFrame, window: int) -> DataFrame:
    """One row for each stretch of consecutive windows that share a fingerprint's place: the fingerprint, the
    first window's word, the number of windows, and all their words, joined by one space, after 128 bits of their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dids, ths = b.column("did").to_numpy(), b.column("th").to_numpy()
            for chunk in words(b.column("text")):
                start, f, at = _chunk_minimizers(chunk, window)
                if not len(start):
                    continue
                row = np.searchsorted(chunk.first, start, "right") - 1
                first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]))))
                ends = np.append(first[1:], len(start))
                r, lo = row[first], start[first]
                text, places = joined(chunk)
                i, j = places[lo], places[start[ends - 1] + window] - 1
                cols = [f[first].view(np.int64), dids[chunk.row + r], ths[chunk.row + r], (lo - chunk.first[r]).astype(np.int32), (ends - first).astype(np.int32)]
                part = np.cumsum(j - i) // _BODY_BYTES  # a very long text gives several batches
                for k in np.split(np.arange(len(i)), np.flatnonzero(np.diff(part)) + 1):
                    body = [text[x:y] for x, y in zip(i[k].tolist(), j[k].tolist(), strict=True)]
                    named = np.frombuffer(b"".join([hashlib.sha256(x).digest()[:16] for x in body]), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[k]) for c in cols), pa.array(named[:, 0]), pa.array(named[:, 1]), pa.array(body, pa.binary()).cast(pa.string())], names=[c.split()[0] for c in _SEGMENT.split(", ")])

    return docs.select("did", "th", "text").mapInArrow(run, _SEGMENT)


class FingerprintIndex:
    """Log-structured index under one folder of shared storage.

    ``add`` takes a batch: its segments are stored as they are, and its fingerprints, counted, become a new
    immutable run, bucketed and sorted. The new run is merge-joined with those before, bucket by bucket, nothing
    moves; fingerprints that thereby reach two places are the batch's hits. From ``fanout`` runs on they
    are compacted into one, by the same merge. So history's texts are never read again: its stored segments
    tell fingerprints and words. What counts is named in a manifest, numbered, of which the newest
    is valid; a failed or repeated step leaves the index as it was, and a new object on ``path`` finds all of it.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, window: int, buckets: int | None = None, fanout: int = 2):
        self.spark, self.path = spark, path.rstrip("/")
        text = newest_text(spark, f"{self.path}/manifests")
        self.state = json.loads(text) if text else {"window": window, "buckets": buckets or partitions(spark), "fanout": fanout, "layout": _LAYOUT, "number": 0, "runs": [], "batches": [], "hits": []}
        if self.state["window"] != window:
            raise ValueError(f"{path} is an index of windows of {self.state['window']} words")
        if self.state.get("layout") != _LAYOUT:
            raise ValueError(f"{path} is an index of another layout: build it again")

    def _commit(self, **new: object) -> None:
        state = self.state | new | {"number": self.state["number"] + 1}
        put_numbered(self.spark, f"{self.path}/manifests", state["number"], json.dumps(state))
        self.state = state

    def _table(self, name: str) -> str:
        """A session table over a run, whose buckets Spark then knows; it doesn't own the files."""
        table = f"run_{name}_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} (f BIGINT, n BIGINT) USING parquet CLUSTERED BY (f) SORTED BY (f) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/runs/{name}'")
        return table

    def _write_run(self, counts: DataFrame) -> str:
        name = uuid.uuid4().hex
        table, n = f"new_{name}", self.state["buckets"]
        try:
            counts.repartition(n, "f").write.bucketBy(n, "f").sortBy("f").option("path", f"{self.path}/runs/{name}").format("parquet").option("compression", "zstd").saveAsTable(table)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")  # the files stay
        return name

    def merged(self, runs: list[str], tables: list[str]) -> DataFrame:
        """(f, n, last): places of each fingerprint over ``runs``, and in the last of them, by merging the sorted runs."""
        out = None
        for name in runs:
            tables.append(self._table(name))
            own = self.spark.table(tables[-1])
            if out is None:
                out = own.select("f", "n", F.col("n").alias("last"))
            else:
                other = own.select("f", F.col("n").alias("m"))
                out = out.join(other.hint("merge"), "f", "full").select("f", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.coalesce("m", F.lit(0)).alias("last"))
        return out

    def add(self, docs: DataFrame) -> str:
        """A batch of documents (did, th, text), those of earlier batches excepted; returns its name."""
        name = uuid.uuid4().hex
        segments(docs, self.state["window"]).write.option("compression", "zstd").parquet(f"{self.path}/segments/{name}")
        runs, tables = [*self.state["runs"], self._write_run(self.segments([name]).groupBy("f").agg(F.count(F.lit(1)).alias("n")))], []
        try:
            self.merged(runs, tables).where("n > 1 AND last > 0").select("f").write.parquet(f"{self.path}/hits/{name}")
        finally:
            for t in tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self._commit(runs=runs, batches=[*self.state["batches"], name], hits=[*self.state["hits"], name])
        if len(self.state["runs"]) >= self.state["fanout"]:
            self.compact()
        return name

    def segments(self, batches: list[str] | None = None) -> DataFrame:
        names = self.state["batches"] if batches is None else batches
        paths = [f"{self.path}/segments/{b}" for b in names]
        return self.spark.read.schema(_SEGMENT).parquet(*paths) if paths else self.spark.createDataFrame([], _SEGMENT)

    def hits(self, batches: list[str] | None = None) -> DataFrame:
        """(f): fingerprints met twice or more, that ``batches`` (all, if not given) brought there or met again."""
        names = self.state["hits"] if batches is None else batches
        paths = [f"{self.path}/hits/{b}" for b in names]
        return self.spark.read.schema("f long").parquet(*paths) if paths else self.spark.createDataFrame([], "f long")

    def compact(self) -> None:
        """All runs as one; the old ones go once the manifest names the new one."""
        old, tables = self.state["runs"], []
        if len(old) < 2:
            return
        try:
            new = self._write_run(self.merged(old, tables).select("f", "n"))
        finally:
            for t in tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self._commit(runs=[new])
        for name in old:
            delete(self.spark, f"{self.path}/runs/{name}")

    def drop(self) -> None:
        delete(self.spark, self.path)


def _windows(window: int):
    """A variant's windows, one row each, named by 128 bits of a cryptographic hash of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, names, times = [], [], []
            for text, size in zip(b.column("body").to_pylist(), b.column("size").to_pylist(), strict=True):
                raw = text.encode()
                ends = np.flatnonzero(np.frombuffer(raw + b" ", np.uint8) == 0x20).tolist()
                starts = [0, *(e + 1 for e in ends)]
                names += [hashlib.blake2b(raw[starts[i] : ends[i + window - 1]], digest_size=16).digest() for i in range(size)]
                places += range(size)
                times.append(size)
            w = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            cols = [np.repeat(b.column(c).to_numpy(zero_copy_only=False), times) for c in ("f", "s1", "s2", "n")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(places, pa.int32())], names=["f", "s1", "s2", "n", "w1", "w2", "i"])

    return run


def repeated_windows(found: DataFrame, window: int) -> tuple[DataFrame, list[DataFrame]]:
    """(did, th, start, mask): bit i of mask says that the window at word start + i of the document is elsewhere too.

    ``found``: segments whose fingerprint may be repeated, of which those that are ``own`` are judged. Those of equal words (by SHA-256) are one variant of
    their fingerprint. A variant met twice decides for all its windows where it is its fingerprint's only
    one. Where there are several, the windows of one specimen each are counted against each other, by a
    hash of their words, each with its variant's number of copies. So every decision is about words, once a
    variant, not about fingerprints. Hot variants and hot windows meet in partial aggregates. Words are read only
    where there are several variants. Also returns the tables that the result reads.
    """
    key = ["f", "s1", "s2"]
    named = materialize(found.drop("body"))
    n_found = named.count()
    variants = materialize(named.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")))
    several = materialize(variants.groupBy("f").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("w")).where("v > 1"))
    filt = key_filter(several, "f")
    every = (F.call_function("shiftleft", F.lit(1).cast("long"), F.col("size")) - 1).alias("mask")
    # a fingerprint that the filter lets pass without need is only decided the longer way
    alone = may_pass(variants.where("n > 1"), filt, "f", False).select(*key, "n", every)
    bodies = may_pass(found, filt, "f").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("body").alias("body"))
    wide = materialize(bodies.mapInArrow(_windows(window), "f long, s1 long, s2 long, n long, w1 long, w2 long, i int"))
    same = ["f", "w1", "w2"]
    counts = materialize(wide.groupBy(*same).agg(F.sum("n").alias("all_"), F.count(F.lit(1)).alias("m")).where("all_ > 1").drop("all_"))
    hit = join_unique(wide, counts, same, "m", wide.count(), "inner")
    masks = hit.groupBy(*key).agg(F.max("n").alias("n"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))).alias("mask"))
    known = materialize(alone.unionByName(masks))
    discard(variants, several, wide, counts)
    out = join_unique(named.where("own").select(*key, "did", "th", "start"), known, key, "n", n_found, "inner").select("did", "th", "start", "mask")
    return out, [named, known]


def _cover(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column("marks").to_pylist()
            n, gone, sha = [], [], []
            for chunk in words(b.column("text")):
                for k in range(len(chunk)):
                    lo, hi = int(chunk.first[k]), int(chunk.first[k + 1])
                    depth = np.zeros(hi - lo + 1, np.int64)
                    for m in marks[chunk.row + k] or ():
                        mask, at = m["mask"], m["start"]
                        while mask:
                            i = (mask & -mask).bit_length() - 1
                            mask &= mask - 1
                            depth[at + i] += 1
                            depth[at + i + window] -= 1
                    keep = np.cumsum(depth[:-1]) == 0
                    n.append(hi - lo)
                    gone.append(int((~keep).sum()))
                    sha.append(hashlib.sha256(joined(chunk, lo + np.flatnonzero(keep))[0]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def joined(chunk: Words, kept: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """The words of a chunk, or ``kept`` of them, joined by one space; and where each begins, with the end and one more."""
    if kept is None:
        kept = np.arange(len(chunk.starts))
    if not len(kept):
        return b"", np.zeros(1, np.int64)
    s, e = chunk.starts[kept], chunk.ends[kept]
    size = e - s + 1
    to = np.cumsum(size)
    at = np.arange(to[-1]) + np.repeat(s - (to - size), size)
    at[to - 1] = 0
    out = chunk.raw[at]
    out[to - 1] = 0x20
    return out[:-1].tobytes(), np.concatenate(([0], to))


def substring_digest(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", index: FingerprintIndex | None = None, batches: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window covers it whose words, in order, also start anywhere else, in another document
    or the same; windows are judged on the input. With an ``index``, ``docs`` are its next batch and are judged
    against all earlier ones (whose own results don't change). Without, a temporary one takes ``docs`` in ``batches``,
    told apart by a hash of the row, merge-joins and compacts them, and all are judged against all.

    Nulls: a null text has no words; a null doc_id is an id of its own. Texts under ``window`` words lose
    nothing. Rows that repeat both doc_id and text are copies of each other. Long texts are whole. Empty
    input gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    d = _rows(docs, id_col, text_col)
    own = index is None
    if own:
        index = FingerprintIndex(spark, shared_dir(spark), window)
        names = [index.add(d.where(F.pmod(F.xxhash64("did", "th"), F.lit(batches)) == k)) for k in range(batches)]
    else:
        names = [index.add(d)]
    filt = materialize(key_filter(index.hits(names), "f"))
    earlier = [b for b in index.state["batches"] if b not in names]
    every = index.segments(names).withColumn("own", F.lit(True)).unionByName(index.segments(earlier).withColumn("own", F.lit(False)))
    judged, used = repeated_windows(may_pass(every, filt, "f"), window)
    marks = materialize(judged.groupBy("did", "th").agg(F.collect_set(F.struct("start", "mask")).alias("marks")))
    discard(filt, *used)
    if own:
        index.drop()
    touched = key_filter(marks, "th")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    cut = may_pass(d, touched, "th").join(marks.hint("merge"), ["did", "th"], "left").select("doc_id", "text", "marks")
    whole = may_pass(d, touched, "th", False).select("doc_id", "text", F.lit(None).cast(marks.schema["marks"].dataType).alias("marks"))
    return cut.mapInArrow(_cover(window), schema).unionByName(whole.mapInArrow(_cover(window), schema))
