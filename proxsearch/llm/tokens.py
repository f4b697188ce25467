"""Token ids of whole texts by the tokenizers library, each distinct pre-token encoded once a worker.

A text of plain Latin characters is cut by the tokenizer's own pre-token pattern here, and the ids of
each pre-token come from the library's model, through a bounded cache. Any other text goes through
the library as it is. Both give the same ids; tests/llm hold one against the other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np

#: Entries of a worker's cache; when full it starts anew.
CACHE_ENTRIES = 500_000

_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = " \t\n\r\xa0"
#: Characters on which Python and the library agree about class, case and normal form. U+0130 isn't one.
_ODD = re.compile("[^\t\n\r -~\xa0-įı-ɏ‐-‧‰-›€™]")
_TAIL = "'s|'t|'re|'ve|'m|'ll|'d"
_PATTERNS = {
    "byte": re.compile(f"{_TAIL}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
    "word": re.compile(f"{_TAIL}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"),
}
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_chars() -> dict[int, str]:
    """The printable characters by which byte-level models write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _kind(spec: dict) -> str | None:
    """Which of the two known designs the file has; None: any other, which gets no shortcut."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    model = spec["model"]
    if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    parts = pre.get("pretokenizers", [])
    steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    if [p.get("type") for p in parts] == ["Split", "ByteLevel"] and steps == ["NFC", "Replace", "Lowercase"]:
        split = parts[0]
        if split["pattern"] == {"Regex": _WORD_SPLIT} and split["behavior"] == "Removed" and split["invert"] and not parts[1].get("use_regex", True):
            return "word"
    return None


class _Cache(dict):
    """Pre-token to its ids as little-endian bytes."""

    def __init__(self, model: object, dtype: str):
        self.model, self.dtype, self.chars = model, dtype, _byte_chars()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin1").translate(self.chars))]
        self[piece] = out = np.array(ids, self.dtype).tobytes()
        return out


class Encoder:
    """``encode(text)``: the ids of a whole text as little-endian bytes of ``dtype``; special strings are ordinary text."""

    def __init__(self, path: str, dtype: str = "<u4"):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            self.kind = _kind(json.load(f))
        self.cache = _Cache(self.tokenizer.model, dtype)

    def by_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if self.kind is None or _ODD.search(text):
            return self.by_library(text)
        if self.kind == "word":
            text = text.lower()
        return b"".join(map(self.cache.__getitem__, _PATTERNS[self.kind].findall(text)))

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """This worker's encoder of ``path``; it and its cache live as long as the worker."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = Encoder(path, dtype)
    return _ENCODERS[path, dtype]
