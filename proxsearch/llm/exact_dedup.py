"""Exact dedup with an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, key_filter, materialize, may_pass, partitions, pick, shared_dir

#: Bits of the hash that the directory may use: it never has more than 2^16 slots, so it can be broadcast.
MAX_DEPTH = 16
COMBINE_BYTES = 32 << 20


def build_directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[int], list[int]]:
    """Global depth, bucket of each slot and load of each bucket of an extendible hash over ``counts``.

    ``counts`` maps the first ``max_depth`` bits of a hash to the number of entries there. A bucket
    that holds more than ``capacity`` splits by its next bit; if it already uses all bits of the
    directory, that doubles first. A bucket at ``max_depth`` stays overfull (its entries chain).
    """
    depth, slots, loads, local, prefix = 0, [0], [sum(counts.values())], [0], [0]
    sums = [dict(counts)]
    for d in range(max_depth):
        up: dict[int, int] = {}
        for p, n in sums[-1].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        sums.append(up)
    sums.reverse()  # sums[d]: entries by their first d bits
    todo = [0]
    while todo:
        b = todo.pop()
        if loads[b] <= capacity or local[b] == max_depth:
            continue
        if local[b] == depth:
            slots = [x for x in slots for _ in (0, 1)]
            depth += 1
        local[b] += 1
        low, high = prefix[b] * 2, prefix[b] * 2 + 1
        new = len(loads)
        prefix[b], loads[b] = low, sums[local[b]].get(low, 0)
        prefix.append(high)
        local.append(local[b])
        loads.append(sums[local[b]].get(high, 0))
        width = depth - local[b]
        for s in range(high << width, (high + 1) << width):
            slots[s] = new
        todo += [b, new]
    order = {b: i for i, b in enumerate(dict.fromkeys(slots))}  # buckets in order of their keys
    return depth, [order[b] for b in slots], [loads[b] for b in order]


def owners(loads: list[int], n: int) -> list[int]:
    """Contiguous ranges of buckets for ``n`` owner tasks, near equal in load."""
    total, seen, out = max(1, sum(loads)), 0, []
    for x in loads:
        out.append(min(n - 1, seen * n // total))
        seen += x
    return out


_COMBINED = "key long, text string, keep_id long, n long"
_ENTRY = "key long, sha binary, keep_id long, n long, chain int"


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies met in one task become one row, before anything is shuffled."""
    held: dict[tuple[int, str], list] = {}
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"key": pa.array([k for k, _ in held], pa.int64()), "text": pa.array([t for _, t in held], pa.string()), "keep_id": pa.array([v[0] for v in held.values()], pa.int64()), "n": pa.array([v[1] for v in held.values()], pa.int64())}
        )

    for b in batches:
        for key, text, doc in zip(*(b.column(c).to_pylist() for c in ("key", "text", "doc_id")), strict=True):
            if v := held.get((key, text)):
                v[0], v[1] = _larger(v[0], doc), v[1] + 1
            else:
                held[key, text] = [doc, 1]
                size += len(text) + 100
            if size > COMBINE_BYTES:
                yield out()
                held, size = {}, 0
    if held:
        yield out()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One owner's rows in order of key: texts of one key chain, told apart by their bytes."""
    key, chain = None, {}

    def entries(key: int, chain: dict) -> list[tuple]:
        return [(key, hashlib.sha256(t.encode()).digest(), v[0], v[1], i) for i, (t, v) in enumerate(sorted(chain.items()))]

    for b in batches:
        done = []
        for k, text, doc, n in zip(*(b.column(c).to_pylist() for c in ("key", "text", "keep_id", "n")), strict=True):
            if k != key:
                if chain:
                    done += entries(key, chain)
                key, chain = k, {}
            if v := chain.get(text):
                v[0], v[1] = _larger(v[0], doc), v[1] + n
            else:
                chain[text] = [doc, n]
        if done:
            yield _entries(done)
    if chain:
        yield _entries(entries(key, chain))


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "sha": pa.binary(), "keep_id": pa.int64(), "n": pa.int64(), "chain": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class ExactIndex:
    """Index on shared files: Parquet of (owner, bucket, key, chain, sha, keep_id, n), one owner a key range."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, keep_id) of each row of ``docs``; keep_id is null where the index lacks the text."""
        d = pick(docs, doc_id=id_col, text=text_col).select("doc_id", *_hashes(F.coalesce("text", F.lit(""))))
        return d.join(self.entries().select("key", "sha", "keep_id"), ["key", "sha"], "left").select("doc_id", "keep_id")


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("key"), F.unhex(F.sha2(text, 256)).alias("sha")]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000, index_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group; its largest doc_id stays. Key hashes are counted by prefix, and a
    directory over the prefixes doubles until no bucket exceeds ``capacity`` (or the average load of
    2^15 buckets, so that it stays under 2^16 slots). Rows whose key occurs once become entries as
    they are. The texts of the others, combined within each map task, go to the owner of their key
    range, which compares bytes. The entries, sorted by bucket, are the index at ``index_path``.

    Nulls: a null text counts as empty; a null doc_id is smaller than any other. Empty texts are
    equal to each other. Rows that repeat the doc_id that stays, with its text, all have kept true.
    Empty input gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    n_owners = partitions(spark)
    d = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialize(d.select("doc_id", *_hashes(F.col("text"))))
    keys = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"), F.max("sha").alias("sha")))
    slot = F.shiftrightunsigned("key", 64 - MAX_DEPTH)
    counts = {r["p"]: r["n"] for r in keys.groupBy(slot.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    depth, slots, loads = build_directory(counts, max(capacity, sum(counts.values()) >> 15))
    own = owners(loads, n_owners)
    directory = F.broadcast(spark.createDataFrame([(i, b, own[b]) for i, b in enumerate(slots)], "slot long, bucket int, owner int"))
    at = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")

    def to_owners(df: DataFrame, *order: str) -> DataFrame:
        return df.withColumn("slot", at).join(directory, "slot").drop("slot").repartitionById(n_owners, "owner").sortWithinPartitions(*order)

    again = may_pass(d.withColumn("key", F.xxhash64("text")), key_filter(keys.where("n > 1"), "key"), "key")
    combined = again.select("key", "text", "doc_id").mapInArrow(_combine, _COMBINED)
    chained = to_owners(combined, "key").select("key", "text", "keep_id", "n").mapInArrow(_chain, _ENTRY)
    several = chained.join(keys.where("n > 1").select("key"), "key", "left_semi")  # the filter also lets some other keys pass
    single = keys.where("n = 1").select("key", "sha", "keep_id", "n", F.lit(0).alias("chain"))
    path = index_path or shared_dir(spark)
    to_owners(several.unionByName(single), "bucket", "key", "chain").write.mode("overwrite").parquet(path)
    total = sum(counts.values())
    groups = ExactIndex(spark, path).entries().where("n > 1").select("key", "sha", F.col("keep_id").alias("keep"), "n")
    out = join_unique(rows, groups, ["key", "sha"], "n", total)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
