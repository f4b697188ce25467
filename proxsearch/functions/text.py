"""Tokenizer as column expressions.

A word starts at a letter (A-Z, a-z, U+05D0-U+05EA) and goes on over letters, diacritics, double quotes and
whole tags; only its letters are kept, and it counts if 2 to 44 are. Offsets and lengths are in code points.
Patterns are possessive, so that long words and many tags need no stack.

Words alone are column expressions. Offsets are running sums along a text, for which there is no column
expression of linear time, so ``tokens`` scans each text once in Arrow batches, all texts of a chunk together as arrays.
Nothing is shuffled: a row's tokens depend on that row only, whatever other rows share its id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import bound_batches

LETTER = r"A-Za-z\x{05D0}-\x{05EA}"
MARKS = r"\x{0591}-\x{05BD}\x{05BF}-\x{05C7}\x{0300}-\x{036F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}"
SHORTEST, LONGEST = 2, 44

_TAG = {"clean": "<[^>]*+>?", "swallow": "<[^>]*+(?:>(?s:.)?)?"}
_UNICODE = r"[\p{L}\p{M}_]++(?:(?:<[^>]*+>|\")[\p{L}\p{M}_]++)*+"


def _check(tag_mode: str) -> str:
    if tag_mode not in _TAG:
        raise ValueError(f"tag_mode: {tag_mode!r}")
    return _TAG[tag_mode]


def word_pattern(tag_mode: str = "clean") -> str:
    inner = f'[{LETTER}{MARKS}"]*+'
    return f"[{LETTER}]{inner}(?:{_check(tag_mode)}{inner})*+"


def pieces(text: Column, tag_mode: str = "clean") -> Column:
    """The text cut into words, tags and what is between them; joined, they are the text again."""
    return F.regexp_extract_all(text, F.lit(f"{word_pattern(tag_mode)}|<[^>]*+>?|[^<{LETTER}]++"), F.lit(0))


def is_word(piece: Column) -> Column:
    return piece.rlike(f"^[{LETTER}]")


def letters_of(piece: Column, tag_mode: str = "clean") -> Column:
    """A word without its tags, diacritics and quotes."""
    return F.regexp_replace(piece, f'{_check(tag_mode)}|[{MARKS}"]', "")


def counts(word: Column) -> Column:
    return F.length(word).between(SHORTEST, LONGEST)


def words(text: Column, tag_mode: str = "clean") -> Column:
    """Array of the words that count; the place in it is the word's position."""
    return F.filter(F.transform(F.filter(pieces(text, tag_mode), is_word), lambda p: letters_of(p, tag_mode)), counts)


def unicode_words(text: Column) -> Column:
    """Words of any script: letters, marks and underscores, glued by one tag or double quote."""
    found = F.regexp_extract_all(text, F.lit(_UNICODE), F.lit(0))
    return F.filter(F.transform(found, lambda p: F.regexp_replace(p, r'<[^>]*+>|\p{M}|"', "")), counts)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<.*?>", "")


def strip_hebrew_marks(text: Column) -> Column:
    """Without U+0591-U+05CF, the maqaf among them (words keep no maqaf, but break there)."""
    return F.regexp_replace(text, r"[\x{0591}-\x{05CF}]", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def word_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag_mode: str = "clean") -> DataFrame:
    """(doc_id, word, position), one row per word that counts. Nothing is shuffled."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words(F.col(text_col), tag_mode)).alias("position", "word")).select("doc_id", "word", "position")


def _python(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{m[1]}", pattern)


class Scanner:
    """``scan(text)``: the words that count, where they start and how long they are, marks and tags included."""

    def __init__(self, tag_mode: str = "clean"):
        self.find = re.compile(_python(f"({word_pattern(tag_mode)})|<[^>]*+>?")).finditer
        self.drop = re.compile(_python(f'{_check(tag_mode)}|[{MARKS}"]')).sub

    def scan(self, text: str) -> Iterator[tuple[str, int, int]]:
        for m in self.find(text):
            raw = m[1]
            if raw is None:
                continue
            word = raw if raw.isalpha() else self.drop("", raw)
            if SHORTEST <= len(word) <= LONGEST:
                yield word, m.start(), len(raw)


#: Characters that are scanned together, about; a longer text comes in pieces of this size.
CHUNK = 1 << 20
_WIDE = 1 << 16


@cache
def _kinds() -> np.ndarray:
    """By code point: 1 for letters, 2 for what a word goes on over, 0 for all else; the last place is for those from 2^16 on."""
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, _WIDE)))
    kinds = np.zeros(_WIDE + 1, np.uint8)
    for kind, those in ((1, f"[{LETTER}]"), (2, f'[{MARKS}"]')):
        kinds[[m.start() for m in re.finditer(_python(those), every)]] = kind
    return kinds


class Words:
    """The words that count of several texts, one text after another.

    ``counts``: how many each text has; by word ``start`` and ``size``, marks and tags included, in code points of its text;
    ``chars`` and ``lengths``: the words' letters as code points, and how many of these each has.
    """

    def __init__(self, counts: np.ndarray, start: np.ndarray, size: np.ndarray, chars: np.ndarray, lengths: np.ndarray):
        self.counts, self.start, self.size, self.chars, self.lengths = counts, start, size, chars, lengths

    @cached_property
    def text(self) -> np.ndarray:
        """The place of each word's text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @cached_property
    def position(self) -> np.ndarray:
        return np.arange(len(self.start)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)

    @property
    def words(self) -> pa.Array:
        return _strings(self.chars, self.lengths)

    @property
    def folded(self) -> pa.Array:
        """The words in lower case; their letters are those of two scripts, of which only A-Z has cases."""
        return _strings(np.where((self.chars >= 65) & (self.chars <= 90), self.chars + 32, self.chars), self.lengths)


def _strings(chars: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(lengths)))
    if len(chars) and chars.max() >= 128:
        ends = np.concatenate(([0], np.cumsum(1 + (chars >= 128))))[ends]
        data = chars.astype("<u4").tobytes().decode("utf-32-le").encode()
    else:
        data = chars.astype(np.uint8)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def _scan_plain(texts: list[str]) -> Words:
    """Tags in "clean" mode: one begins at a < outside of tags and goes to the next > or the end of its text."""
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("ascii"), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), "<u4")
    begins = 1 + np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    kind = _kinds()[points if points.itemsize == 1 else np.minimum(points, _WIDE)]
    if "<" in joined:
        # inside or outside is what the last <, > or end of a text says
        said = np.sort(np.concatenate((np.flatnonzero(points == 60), np.flatnonzero(points == 62), begins - 1)))
        opens = np.flatnonzero(points[said] == 60)
        after = said[opens + 1]
        step = np.zeros(len(points) + 1, np.int8)
        step[said[opens]] += 1
        step[after + (points[after] == 62)] -= 1
        kind[np.cumsum(step[:-1], dtype=np.int8) > 0] = 2
    inside = kind > 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    letter = kind == 1
    if len(start) and (kind == 2).any():
        upto = np.cumsum(letter, dtype=np.int64)
        before, n = upto[start - 1], upto[end - 1] - upto[start - 1]
        some = n > 0
        start, end, n = np.flatnonzero(letter)[before[some]], end[some], n[some]
    else:
        n = end - start
    ok = (n >= SHORTEST) & (n <= LONGEST)
    chars = points[letter][np.repeat(ok, n)]
    start, end = start[ok], end[ok]
    counts = np.diff(np.searchsorted(start, begins))
    return Words(counts, start - np.repeat(begins[:-1], counts), end - start, chars, n[ok])


def _scan_each(texts: list[str], tag_mode: str) -> Words:
    scan = Scanner(tag_mode).scan
    found = [list(scan(t)) for t in texts]
    flat = [x for f in found for x in f]
    chars = np.frombuffer("".join(w for w, _, _ in flat).encode("utf-32-le"), "<u4")
    return Words(np.array([len(f) for f in found], np.int64), *(np.array([x[k] for x in flat], np.int64) for k in (1, 2)), chars, np.array([len(x[0]) for x in flat], np.int64))


@cache
def _run():
    return re.compile(_python(f'(?:[{LETTER}{MARKS}"]|<[^>]*+>?)*+')).match


def _pieces_of(text: str) -> Iterator[str]:
    """A long text cut where no word and no tag is."""
    at = 0
    while len(text) - at > CHUNK:
        to = at + CHUNK
        if text.rfind("<", at, to) > text.rfind(">", at, to):
            to = text.find(">", to) + 1 or len(text)
        to = _run()(text, to).end()
        yield text[at:to]
        at = to
    yield text[at:]


def scan_texts(texts: list[str], tag_mode: str = "clean") -> Words:
    """The words of ``texts``; in "clean" mode by arrays, in time and memory linear in the characters."""
    if tag_mode != "clean":
        return _scan_each(texts, tag_mode)
    if not any(len(t) > CHUNK for t in texts):
        return _scan_plain(texts)
    counts, starts, parts = [], [], []
    for text in texts:
        n = at = 0
        for piece in _pieces_of(text):
            parts.append(_scan_plain([piece]))
            starts.append(parts[-1].start + at)
            n += len(starts[-1])
            at += len(piece)
        counts.append(n)
    rest = (np.concatenate([getattr(p, c) for p in parts]) for c in ("size", "chars", "lengths"))
    return Words(np.array(counts), np.concatenate(starts), *rest)


def spans(column: pa.Array) -> Iterator[tuple[int, int]]:
    """The rows of a column of texts, or of lists of texts, from and to, about CHUNK bytes at a time; a longer row comes alone."""
    if pa.types.is_list(column.type):
        each = np.concatenate(([0], np.cumsum(pc.binary_length(column.flatten()).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))
        ends = each[np.cumsum(column.value_lengths().to_numpy())]
    else:
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        yield at, to
        at = to


def chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column as ``spans`` has them, with the first one's row."""
    for at, to in spans(column):
        yield at, column.slice(at, to - at).to_pylist()


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag_mode: str = "clean") -> DataFrame:
    """(doc_id, word, position, char_start, char_len); char_len spans the raw word, tags and marks included.

    A null or empty text has none. Rows that share an id, or have none, are each numbered from 0.
    """
    _check(tag_mode)
    bound_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    out = T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("word", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("position", "char_start", "char_len")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in chunks(b.column("text")):
                w = scan_texts(texts, tag_mode)
                if len(w.start):
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(w.text + at)), w.words, *(pa.array(c.astype(np.int32)) for c in (w.position, w.start, w.size))], names=out.names)

    return d.mapInArrow(run, out)
