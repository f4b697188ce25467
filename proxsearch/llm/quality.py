"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, pick
from .language_id import bucket_of
from .words import Words, words

#: Labelled documents of each label that the model is fitted on, about, and lines of all of them at most; chosen by a hash, read whole.
SAMPLE_DOCS, SAMPLE_LINES = 2000, 400_000
#: Chains longer than this are stepped through in blocks.
LONG_CHAIN = 512
ROUNDS, RATE, DECAY = 120, 0.15, 1e-3
THRESHOLD = 0.7

_CLASSES = np.zeros((6, 256), bool)
_CLASSES[0, 65:91] = True
_CLASSES[1, 97:123] = _CLASSES[1, 128:] = True
_CLASSES[2, 48:58] = True
_CLASSES[3, [ord(c) for c in "#$%&*@~^<>{}[]\\=_+/`"]] = True
_CLASSES[4, [ord(c) for c in "|!"]] = True
_CLASSES[5, [ord(c) for c in ".,;:'\"?-()"]] = True
N_FEATURES = 30


def line_features(chunk: Words, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line of each text, length of each line in bytes, features of each line)."""
    raw = chunk.raw
    breaks = np.flatnonzero(raw == 10)
    doc = np.concatenate((np.arange(len(chunk)), np.searchsorted(offs, breaks, "right") - 1))
    start = np.concatenate((offs[:-1], breaks + 1))
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    end = np.append(start[1:] - 1, len(raw))
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = offs[1:][doc[last]]
    size = end - start
    cols = []
    for kind in _CLASSES:
        total = np.concatenate(([0], np.cumsum(kind[raw], dtype=np.int64)))
        cols.append(total[end] - total[start])
    shares = np.stack(cols, 1) / np.maximum(size, 1)[:, None]
    lo, hi = np.searchsorted(chunk.starts, start), np.searchsorted(chunk.starts, end)
    n = hi - lo
    again = []
    h = chunk.hashes
    for lag in (1, 2, 3):
        same = np.zeros(len(h) + 1, np.int64)
        if len(h) > lag:
            same[lag + 1 :] = np.cumsum(h[lag:] == h[:-lag])
        inner = np.minimum(lo + lag, hi)
        again.append((same[hi] - same[inner]) / np.maximum(n - lag, 1))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(h)))
    key = sums[hi] - sums[lo] + n.astype(np.uint64)
    by = np.lexsort((key, doc))
    seen = np.zeros(len(key), bool)
    seen[by[1:]] = (doc[by[1:]] == doc[by[:-1]]) & (key[by[1:]] == key[by[:-1]]) & (n[by[1:]] > 0)
    mean = size / np.maximum(n, 1)
    x = np.concatenate(
        (shares, np.sqrt(shares), shares > 0.03, np.stack((*again, again[0] > 0.2, again[1] > 0.2, seen, np.log1p(size) / 8, np.log1p(n) / 6, mean / 10, mean > 12, mean < 3, n == 0), 1)), axis=1
    ).astype(np.float32)
    return np.searchsorted(doc, np.arange(len(chunk) + 1)), size, x


def text_features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for chunk in words(texts):
        part = texts.slice(chunk.row, len(chunk)).cast(pa.large_string())
        offs = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        yield chunk.row, *line_features(chunk, offs - offs[0])


def neighbours(first: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Features of each line, of the one before and of the one after, and 1s: a constant, no line before, none after."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    head, tail = np.zeros(len(x), bool), np.zeros(len(x), bool)
    head[first[:-1]] = True
    tail[first[1:] - 1] = True
    before[head] = 0
    after[tail] = 0
    return np.concatenate((x, before, after, np.stack((np.ones(len(x)), head, tail), 1)), axis=1)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices whose entries are logarithms."""
    return np.logaddexp(a[..., :, :1] + b[..., :1, :], a[..., :, 1:] + b[..., 1:, :])


def _long_chain(emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of one chain, in about 4 sqrt(n) steps: blocks side by side, then along their ends."""
    n = len(emit)
    size = int(np.ceil(np.sqrt(n)))
    n_blocks = -(-(n - 1) // size)
    one = np.array([[0.0, -np.inf], [-np.inf, 0.0]])
    # step t from line t to t + 1; identities fill the last block
    steps = np.tile(one, (n_blocks * size, 1, 1))
    steps[: n - 1] = moves + emit[1:, None, :]
    steps = steps.reshape(n_blocks, size, 2, 2)
    ahead, back = steps.copy(), steps.copy()
    for k in range(1, size):
        ahead[:, k] = _times(ahead[:, k - 1], steps[:, k])
        back[:, -k - 1] = _times(steps[:, -k - 1], back[:, -k])
    enter, leave = np.empty((n_blocks, 2)), np.empty((n_blocks, 2))
    at, end = emit[0], np.zeros(2)
    for b in range(n_blocks):
        enter[b] = at
        at = np.logaddexp(at[0] + ahead[b, -1, 0], at[1] + ahead[b, -1, 1])
        leave[-b - 1] = end
        end = np.logaddexp(back[-b - 1, 0, :, 0] + end[0], back[-b - 1, 0, :, 1] + end[1])
    alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
    alpha[0] = emit[0]
    alpha[1:] = np.logaddexp(enter[:, None, :1] + ahead[:, :, 0], enter[:, None, 1:] + ahead[:, :, 1]).reshape(-1, 2)[: n - 1]
    beta[: n - 1] = np.logaddexp(back[..., 0] + leave[:, None, :1], back[..., 1] + leave[:, None, 1:]).reshape(-1, 2)[: n - 1]
    return alpha, beta


def forward_backward(first: np.ndarray, score: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 of each line, and expected moves (from, to) over all chains.

    ``score``: log potential of label 1 against 0; ``moves``: log potentials. All chains step side by side, but for
    those beyond LONG_CHAIN lines, which are cut into blocks that do.
    """
    lengths = np.diff(first)
    short = np.flatnonzero(lengths <= LONG_CHAIN)
    n = lengths[short]
    order = np.argsort(-n, kind="stable")
    starts, n = first[:-1][short][order], n[order]
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), "left")  # chains with more than t lines
    emit = np.stack((np.zeros(len(score)), score), 1)
    alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    for t in range(longest):
        at = starts[: active[t]] + t
        alpha[at] = emit[at]
        if t:
            prev = alpha[at - 1][:, :, None] + moves
            alpha[at] += np.logaddexp(prev[:, 0], prev[:, 1])
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        nxt = (beta[at + 1] + emit[at + 1])[:, None, :] + moves
        beta[at] = np.logaddexp(nxt[:, :, 0], nxt[:, :, 1])
    for i in np.flatnonzero(lengths > LONG_CHAIN).tolist():
        at = slice(first[i], first[i + 1])
        alpha[at], beta[at] = _long_chain(emit[at], moves)
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.ones(len(score), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    pair = np.exp(alpha[at - 1][:, :, None] + moves + (emit[at] + beta[at])[:, None, :] - total[at][:, None, None])
    return np.exp(both[:, 1] - total), pair.sum(0)


@dataclass
class Crf:
    weights: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float = 0.5

    @staticmethod
    def fit(first: np.ndarray, x: np.ndarray, size: np.ndarray, label: np.ndarray) -> Crf:
        """Maximum likelihood of lines labelled as their documents, by gradient steps (Adam) from zero."""
        mean, scale = x.mean(0), x.std(0) + 1e-6
        f = neighbours(first, (x - mean) / scale)
        y = np.repeat(label, np.diff(first)).astype(float)
        weights, moves = np.zeros(f.shape[1]), np.zeros((2, 2))
        inner = np.ones(len(x), bool)
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
        params = np.zeros(len(weights) + 4)
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, ROUNDS + 1):
            weights, moves = params[:-4], params[-4:].reshape(2, 2)
            p, expected = forward_backward(first, f @ weights, moves)
            grad = np.concatenate((f.T @ (y - p), (seen - expected).ravel())) / len(x) - DECAY * params
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        out = Crf(params[:-4], params[-4:].reshape(2, 2), mean, scale)
        raw = out.raw(first, x, size)
        # the cut between the labels with the fewest errors of either kind, in the middle of where it may lie
        order = np.argsort(raw)
        s, good = raw[order], label[order].astype(bool)
        wrong = np.concatenate(([0], np.cumsum(good) / max(1, good.sum()))) + np.concatenate(([1], 1 - np.cumsum(~good) / max(1, (~good).sum())))
        best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
        k = best[len(best) // 2]
        edges = np.concatenate(([0.0], s, [1.0]))
        out.cut = float(np.clip((edges[k] + edges[k + 1]) / 2, 0.02, 0.98))
        return out

    def raw(self, first: np.ndarray, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mean of the lines' marginals of being good, each weighing its length (an empty line 1)."""
        p, _ = forward_backward(first, neighbours(first, (x - self.mean) / self.scale) @ self.weights, self.moves)
        w = size + 1.0
        return np.add.reduceat(p * w, first[:-1]) / np.add.reduceat(w, first[:-1])

    def score(self, first: np.ndarray, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """raw() on a scale where the cut is THRESHOLD."""
        r = np.clip(self.raw(first, x, size), 1e-6, 1 - 1e-6)
        logit = np.log(r / (1 - r)) - np.log(self.cut / (1 - self.cut)) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-logit))


def fit_labelled(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> Crf | None:
    """A model from documents (doc_id, text) and labels (doc_id, quality) outside fold ``held``; None without both labels."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(bucket_of(F.col("doc_id"), folds) != held).distinct()
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.create_map(*[F.lit(v) for q, n in counts.items() for v in (q, int(1e9 * min(1.0, SAMPLE_DOCS / n)))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(10**9)) < share[F.col("quality")])  # about 2 * SAMPLE_DOCS rows

    # in the order of the hash, documents are taken as long as their lines fit
    n_lines = F.size(F.split("text", "\n", -1))
    seen = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.sum(n_lines).alias("n")).collect()
    taken, left = [], SAMPLE_LINES
    for r in sorted(seen, key=lambda r: (zlib.crc32(b"9 %d" % r["doc_id"]), r["doc_id"], r["quality"])):
        if r["n"] <= left:
            taken.append((r["doc_id"], r["quality"]))
            left -= r["n"]
    if len({q for _, q in taken}) < 2:
        return None
    drawn = docs.sparkSession.createDataFrame(taken, "doc_id long, quality int")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, first, size, x in text_features(b.column("text")):
                own = b.slice(row, len(first) - 1)
                cuts = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("quality"), pa.array([size[i:j].astype(np.int64).tobytes() for i, j in cuts], pa.binary()), pa.array([x[i:j].tobytes() for i, j in cuts], pa.binary())], names=["doc_id", "quality", "size", "x"])

    rows = docs.join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", "text").mapInArrow(features, "doc_id long, quality int, size binary, x binary").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    label = rows["quality"].to_numpy()
    if len(set(label.tolist())) < 2:
        return None
    size = np.frombuffer(b"".join(rows["size"].to_pylist()), np.int64)
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)
    first = np.concatenate(([0], np.cumsum([len(s) // 8 for s in rows["size"].to_pylist()])))
    return Crf.fit(first, x, size, label)


def good_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score_quality would predict to be good; all, where nothing could be learnt.

    A null text counts as empty. Rows that repeat are judged alike. Long texts are whole. Other columns, whatever
    their names, stay as they are. Empty input gives no rows.
    """
    d = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = pick(labels, doc_id=id_col, quality=label_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    model = fit_labelled(d, own, folds, held)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        model = sent.value
        got = [model.score(first, x.astype(float), size) for _, first, size, x in text_features(pa.array(texts, pa.large_string()))]
        return pd.Series(np.concatenate(got) >= THRESHOLD if got else [], dtype=bool)

    placed, at = by_place(docs, text=text_col)
    return placed.where(good(F.coalesce(at["text"], F.lit("")))).toDF(*docs.columns)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= THRESHOLD).

    Every line is labelled good or bad by its own features and its neighbours'; the marginals of a document's
    lines, weighted by length, make its score. The model is fitted on about SAMPLE_DOCS documents of each
    label, of SAMPLE_LINES lines in all (bounds), none of those whose crc32 of doc_id modulo ``folds`` is ``held``; all are scored, whole.

    A null text counts as empty, which is one empty line. A null doc_id counts as an empty one in crc32.
    Labels other than 0 and 1 are ignored; without both, all scores are 0.5. Repeated rows get equal
    results. Empty input gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    d = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = pick(labels, doc_id=id_col, quality=label_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    model = fit_labelled(d, own, folds, held)
    out = d.withColumn("held_out", bucket_of(F.col("doc_id"), folds) == held)
    if model is None:
        return out.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            got = [model.score(first, x.astype(float), size) for _, first, size, x in text_features(b.column("text"))]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return out.select("doc_id", "held_out", "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
