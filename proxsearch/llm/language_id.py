"""Language identification by prediction by partial matching (PPM) over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Bytes of context at most.
ORDER = 4
#: Documents that a language is learnt from, about; chosen by a hash, read whole.
SAMPLE_DOCS = 3000
MAX_LANGUAGES = 500
UNKNOWN = "und"
CHUNK = 1 << 20
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


def byte_grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, first, grams): for chunks of texts, the gram (ORDER bytes of context, then the byte) at each byte.

    Contexts don't reach over the start of a text; it counts as preceded by line feeds.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + CHUNK, "right")) - 1)
        part, first = raw[offs[row] : offs[to]], offs[row : to + 1] - offs[row]
        starts = first[:-1][first[:-1] < first[1:]]
        out = part.astype(np.uint64)
        for k in range(1, ORDER + 1):
            before = np.full(len(part), 10, np.uint64)
            before[k:] = part[:-k]
            for j in range(k):
                at = starts + j
                before[at[at < len(part)]] = 10
            out |= before << _U(8 * k)
        yield row, first, out
        row = to


@dataclass
class Level:
    """Contexts of one length: code lengths of the grams met in any language, and costs of escaping."""

    grams: HashTable
    bits: np.ndarray  # gram, language
    contexts: HashTable
    escape: np.ndarray  # context, language


class HashTable:
    """Index of 64-bit keys by open addressing, probed for many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.shift = 64 - max(4, int(2 * len(keys)).bit_length())
        size = 1 << (64 - self.shift)
        self.keys, self.index = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.index[slot] < 0
            self.index[slot[free]] = left[free]  # of several, the last stays
            won = self.index[slot] == left
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> _U(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if it isn't there."""
        slot = self._slot(keys)
        out = self.index[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            found = self.index[slot]
            out[left] = found
            more = (found >= 0) & (self.keys[slot] != keys[left])
            left, slot = left[more], slot[more]
        return out


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    levels: list[Level]

    @staticmethod
    def build(languages: list[str], documents: np.ndarray, lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
        """Frozen statistics, escapes by method C: a context met n times with d different bytes gives a byte
        met c times c / (n + d) and escapes to the next shorter one with d / (n + d); after the
        empty context all bytes are alike."""
        size = len(languages)
        levels: list[Level] = []
        lower = None
        for k in range(ORDER + 1):
            keys, inverse = np.unique(gram & _U((1 << 8 * (k + 1)) - 1), return_inverse=True)
            c = np.zeros((len(keys), size))
            np.add.at(c, (inverse, lang), count)
            ctx, at = np.unique(keys >> _U(8), return_inverse=True)
            n, d = np.zeros((len(ctx), size)), np.zeros((len(ctx), size))
            np.add.at(n, at, c)
            np.add.at(d, at, c > 0)
            escape = np.where(n > 0, np.log2(np.maximum(n + d, 1) / np.maximum(d, 1)), 0.0)
            if lower is None:
                below = np.full((len(keys), size), 8.0)
            else:
                below = lower[1][np.searchsorted(lower[0], keys & _U((1 << 8 * k) - 1))]
            bits = np.where(c > 0, np.log2(np.maximum(n + d, 1)[at] / np.maximum(c, 1)), escape[at] + below)
            lower = keys, bits
            levels.append(Level(HashTable(keys), bits.astype(np.float32), HashTable(ctx), escape.astype(np.float32)))
        prior = -np.log2(np.maximum(documents, 1) / max(1, documents.sum()))
        return Model(languages, prior, levels)

    def code_lengths(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language."""
        out = np.zeros((len(grams), len(self.languages)), np.float32)
        at, keys = None, grams
        for k in range(ORDER, -1, -1):
            level = self.levels[k]
            found = level.grams.find(keys)
            hit = found >= 0
            if at is None:
                if hit.all():
                    return level.bits[found]
                out[hit] = level.bits[found[hit]]
                at = np.flatnonzero(~hit)
            else:
                out[at[hit]] += level.bits[found[hit]]
                at = at[~hit]
            if not len(at):
                return out
            keys = keys[~hit]
            ctx = level.contexts.find(keys >> _U(8))
            known = ctx >= 0
            out[at[known]] += level.escape[ctx[known]]
            keys = keys & _U((1 << 8 * k) - 1) if k else keys
        out[at] += 8
        return out


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo ``n``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def learn(train: DataFrame) -> Model | None:
    """A model from (doc_id, text, lang) without nulls; languages are counted over all rows."""
    counts = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    counts.sort(key=lambda r: r["lang"])
    names = [r["lang"] for r in counts]
    n = np.array([r["n"] for r in counts])
    spark = train.sparkSession
    shares = spark.createDataFrame([(r["lang"], i, int(1e9 * min(1.0, SAMPLE_DOCS / r["n"]))) for i, r in enumerate(counts)], "lang string, _i int, _share long")
    drawn = train.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10**9)) < F.col("_share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = b.column("_i").to_numpy()
            for row, first, grams in byte_grams(b.column("text")):
                of = np.repeat(lang[row : row + len(first) - 1], np.diff(first))
                for i in np.unique(of).tolist():
                    keys, c = np.unique(grams[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(c.astype(np.int64))], names=["i", "g", "c"])

    table = drawn.select("_i", "text").mapInArrow(count, "i int, g long, c long").groupBy("i", "g").agg(F.sum("c").alias("c")).toArrow()
    return Model.build(names, n, table["i"].to_numpy(), table["g"].to_numpy().view(np.uint64), table["c"].to_numpy())


def identify(docs: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Each language has a context tree of up to ORDER bytes, learnt from about SAMPLE_DOCS whole documents (a
    bound on the model, which is broadcast), never from those whose crc32 of doc_id modulo ``folds`` is
    ``held``. A text's code length in a language, with that of the language's own share, is the exact
    sum over all its bytes; the shortest wins, ties by name. score is its posterior probability.

    A null text, and one without letters (empty ones too), is "und" with score 0, as is all if nothing
    could be learnt. Null languages and null texts teach nothing. A null doc_id counts as an empty one in
    crc32. Repeated rows get equal results. Empty input gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    d = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    d = d.withColumn("held_out", bucket_of(F.col("doc_id"), folds) == held)
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = d.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.when(letters, F.col("text")).alias("text"))
    model = learn(d.where("NOT held_out AND text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang")))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            texts = b.column("text")
            known = texts.is_valid().to_numpy(zero_copy_only=False)
            bits = np.tile(model.prior, (len(texts), 1))
            for row, first, grams in byte_grams(texts.fill_null("")):
                some = np.flatnonzero(first[:-1] < first[1:])
                if len(some):
                    bits[row + some] += np.add.reduceat(model.code_lengths(grams), first[some], axis=0, dtype=np.float64)
            best = bits.argmin(1)
            score = 1 / np.exp2(np.minimum(0, bits[np.arange(len(best)), best][:, None] - bits)).sum(1)
            names = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predict, schema)
