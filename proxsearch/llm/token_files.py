"""Token-id files: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints.

A file is  b"PXH2", blocks one after another as they come, the code lengths (zlib), a footer (JSON: vocabulary, limit, sizes
of the blocks and of the code lengths), u32 footer length, b"PXH2". So writing holds one block at a time. A block holds whole documents: u32 documents, u32 ids, u32 payload
bytes, a null flag (u8), id (i64) and number of ids (u32) of each document, the bit offset (u64) of
every STEP-th id, and the codes, most significant bit first. Blocks decode alone, and within one all
checkpoints decode side by side.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, pick, shared_dir
from .tokens import encoder

MAGIC, LIMIT, STEP, BLOCK_IDS = b"PXH2", 18, 128, 1 << 19
#: A file of so many ids (about 300 MB) is closed and the next one begun.
FILE_IDS = 1 << 28


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    leaf_sums, level = [], weights
    for _ in range(limit):
        # of the first m entries of a level, leaf_sums[m] are single ids and the rest packages
        leaf_sums.append(level)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        level = np.concatenate((weights, pairs))
        level = level[np.argsort(level, kind="stable")]
    lengths = np.zeros(len(used), np.int64)
    m = 2 * len(used) - 2
    for j in range(limit - 1, -1, -1):
        if j == 0:
            singles = m
        else:
            before = leaf_sums[j - 1]
            pairs = before[: len(before) // 2 * 2].reshape(-1, 2).sum(1)
            is_pair = np.concatenate((np.zeros(len(weights), bool), np.ones(len(pairs), bool)))
            is_pair = is_pair[np.argsort(np.concatenate((weights, pairs)), kind="stable")]
            singles = m - int(is_pair[:m].sum())
        lengths[:singles] += 1
        m = 2 * (m - singles)
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), the same wherever the lengths are known."""
    out = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    if len(used):
        used = used[np.lexsort((used, lengths[used]))]
        n = lengths[used].astype(np.int64)
        top = int(n[-1])
        starts = np.concatenate(([0], np.cumsum(np.int64(1) << (top - n))[:-1]))
        out[used] = starts >> (top - n)
    return out


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next ``limit`` bits: id and code length."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    times = np.int64(1) << (limit - lengths[used].astype(np.int64))
    ids, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    ids[: times.sum()], bits[: times.sum()] = np.repeat(used, times), np.repeat(lengths[used], times)
    return ids, bits


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload and the bit offset of every STEP-th id."""
    n = lengths[ids].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(n)))
    word, room = at[:-1] >> 5, 64 - (at[:-1] & 31) - n
    spread = codes[ids].astype(np.uint64) << room.astype(np.uint64)
    size = (int(at[-1]) + 31 >> 5) + 2
    # codes share no bits, so the sums in doubles are exact
    high = np.bincount(word, (spread >> np.uint64(32)).astype(np.float64), size)
    low = np.bincount(word + 1, (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    return (high + low).astype(np.uint64).astype(">u4").tobytes()[: int(at[-1]) + 7 >> 3], at[:-1:STEP].astype("<u8")


def decode_ids(payload: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """All checkpoints step through the table side by side."""
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, last = offsets.astype(np.int64), len(window) - 1
    ids, bits = table
    out = np.empty((STEP, len(at)), np.uint32)
    for k in range(STEP):
        w = window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32) >> np.uint32(32 - limit)
        out[k] = ids[w]
        at += bits[w]
    return out.T.ravel()[:n]


def write_block(docs: list[tuple[int | None, bytes]], dtype: str, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    sizes = np.array([len(b) for _, b in docs], np.int64) // np.dtype(dtype).itemsize
    payload, offsets = encode_ids(np.frombuffer(b"".join(b for _, b in docs), dtype).astype(np.int64), lengths, codes)
    names = [d for d, _ in docs]
    return b"".join((
        struct.pack("<III", len(docs), int(sizes.sum()), len(payload)),
        np.array([d is None for d in names], "u1").tobytes(), np.array([d or 0 for d in names], "<i8").tobytes(),
        sizes.astype("<u4").tobytes(), offsets.tobytes(), payload,
    ))


def read_block(block: bytes, table: tuple[np.ndarray, np.ndarray], limit: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a block."""
    n_docs, n_ids, n_bytes = struct.unpack_from("<III", block)
    at, cols = 12, []
    for kind, n in (("u1", n_docs), ("<i8", n_docs), ("<u4", n_docs), ("<u8", -(-n_ids // STEP))):
        cols.append(np.frombuffer(block, kind, n, at))
        at += n * np.dtype(kind).itemsize
    null, names, sizes, offsets = cols
    ids = decode_ids(block[at : at + n_bytes], offsets, n_ids, table, limit)
    ends = np.cumsum(sizes.astype(np.int64))
    for null_, name, size, end in zip(null.tolist(), names.tolist(), sizes.tolist(), ends.tolist(), strict=True):
        yield None if null_ else name, ids[end - size : end]


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark means by it (fs.defaultFS where there is none), as pyarrow spells it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    scheme, _, rest = full.partition(":")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return {"s3a": "s3", "s3n": "s3", "gs": "gs", "wasbs": "abfss"}.get(scheme, scheme) + ":" + rest


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path)


def write_file(path: str, blocks: Iterator[bytes], lengths: np.ndarray, limit: int) -> None:
    fs, name = _filesystem(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    sizes, table = [], zlib.compress(lengths.tobytes())
    with fs.open_output_stream(name) as f:
        f.write(MAGIC)
        for b in blocks:
            f.write(b)
            sizes.append(len(b))
        foot = json.dumps({"vocabulary": len(lengths), "limit": limit, "step": STEP, "table": len(table), "blocks": sizes}).encode()
        f.write(table + foot + struct.pack("<I", len(foot)) + MAGIC)


def read_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a file, block by block."""
    fs, name = _filesystem(path)
    with fs.open_input_file(name) as f:
        end = f.size() - 8
        f.seek(max(0, end))
        tail = f.read(8)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path}: not a whole token-id file")
        n_foot = struct.unpack("<I", tail[:4])[0]
        f.seek(end - n_foot)
        foot = json.loads(f.read(n_foot))
        f.seek(end - n_foot - foot["table"])
        table = decode_table(np.frombuffer(zlib.decompress(f.read(foot["table"])), np.uint8), foot["limit"])
        f.seek(len(MAGIC))
        for n in foot["blocks"]:
            yield from read_block(f.read(n), table, foot["limit"])


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2") -> DataFrame:
    """(doc_id, n_tokens, ids): each text's ids and ``end_id`` as bytes of ``dtype``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, width = encoder(tokenizer, dtype), np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        for b in batches:
            ids = [x + end for x in enc.encode_all(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    d = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def id_counts(table: DataFrame, vocabulary: int, dtype: str = "<u2") -> np.ndarray:
    """How often each id occurs, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in table.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_token_files(table: DataFrame, path: str, vocabulary: int, dtype: str = "<u2", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes ``table`` (of token_table) as files of about ``file_ids`` ids under ``path`` in ascending doc_id order.

    ``path`` is any that Spark and pyarrow both know; the number of tasks grows with the ids. Returns the list of files: number, turn, file, n_docs, n_tokens, start (ids of all documents before it).
    Each attempt of a task writes a file of its own name; the list, which Spark commits once, names
    those that count, so lost executors and second attempts do no harm.
    """
    spark = table.sparkSession
    counts = id_counts(table, vocabulary, dtype)
    lengths, root = code_lengths(counts), qualified(spark, path)
    n_tasks = max(partitions(spark), -(-int(counts.sum()) // file_ids))
    sent = spark.sparkContext.broadcast(lengths)
    order = ["doc_id", "n_tokens", "_hash"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lengths = sent.value
        codes, number = canonical_codes(lengths), TaskContext.get().partitionId()
        rows = ((d, i, k) for b in batches for d, i, k in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), b.column("n_tokens").to_pylist(), strict=True))
        row, turn = next(rows, None), 0

        def blocks(seen: list[int]) -> Iterator[bytes]:
            """Blocks of one file; what comes after it stays in ``row``."""
            nonlocal row
            while row is not None and seen[1] < file_ids:
                held, n = [], 0
                while row is not None and n < BLOCK_IDS:
                    held.append(row[:2])
                    n += row[2]
                    row = next(rows, None)
                seen[0] += len(held)
                seen[1] += n
                yield write_block(held, dtype, lengths, codes)

        while row is not None:
            name, seen = f"{root}/{number:06d}-{turn:04d}-{uuid.uuid4().hex}.pxh", [0, 0]
            write_file(name, blocks(seen), lengths, LIMIT)
            yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "turn": pa.array([turn], pa.int32()), "file": [name], "n_docs": pa.array([seen[0]], pa.int64()), "n_tokens": pa.array([seen[1]], pa.int64())})
            turn += 1

    ranged = table.withColumn("_hash", F.xxhash64("ids")).repartitionByRange(n_tasks, *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")
    files = materialize(ranged.mapInArrow(write, "number int, turn int, file string, n_docs long, n_tokens long"))
    start, rows = 0, []
    for r in sorted(files.collect()):
        rows.append((*r, start))
        start += r["n_tokens"]
    return spark.createDataFrame(rows, "number int, turn int, file string, n_docs long, n_tokens long, start long")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                rows = []
                for doc, ids in read_file(file):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) >= 10_000:
                        yield digest(rows)
                        rows = []
                if rows:
                    yield digest(rows)

    def digest(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.repartition(n, "number", "turn").select("file", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes ``docs``, writes the token-id files (to ``path``, a URI of shared storage) and digests what they hold.

    Nulls: a null text counts as empty, which is ``end_id`` alone; null doc_ids come first. Repeated
    ids are ordered by number of ids, then a hash of the ids. Empty input writes no documents and gives no
    rows. Long texts are whole in one block. Other columns are ignored.
    """
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    table = materialize(token_table(docs, tokenizer, end_id, id_col, text_col, dtype))
    return read_token_files(write_token_files(table, path or shared_dir(spark), vocabulary, dtype))
