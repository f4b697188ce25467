"""Term patterns: * and ? compiled to Java regular expressions.

? is one character, or an optional one in the wildcards that end the pattern. * is up to k characters; k
grows with the literal characters ("scaled": 2, 3, 5 for up to 1, 2, more) or is 5 ("fixed5"). Only the
last star is tried again when what follows doesn't match, hence the atomic groups.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

BUDGETS = ("scaled", "fixed5", "unbounded")


def is_pattern(term: str) -> bool:
    return "*" in term or "?" in term


def star_budget(pattern: str, budget: str = "scaled") -> int:
    if budget not in BUDGETS:
        raise ValueError(f"budget: {budget!r}")
    literal = sum(c not in "*?" for c in pattern)
    return 5 if budget == "fixed5" or literal > 2 else 3 if literal == 2 else 2


def _escape(s: str) -> str:
    return "".join(c if c.isalnum() or c in " _" or ord(c) > 127 else f"\\x{{{ord(c):X}}}" for c in s)


def to_regex(pattern: str, budget: str = "scaled") -> str:
    """Java regular expression for a bounded pattern; matches whole words only."""
    star = f".{{0,{star_budget(pattern, budget)}}}?"
    core = pattern.rstrip("*?")
    tail = pattern[len(core) :]
    parts = re.split(r"\*", "".join("\0" if c == "?" else c for c in core) + tail.replace("?", "\1"))
    done = ["".join("." if c == "\0" else ".?" if c == "\1" else _escape(c) for c in p) for p in parts]
    inner = "".join(f"(?>{star}{p})" for p in done[1:-1])
    last = star + done[-1] if len(done) > 1 else ""
    return f"(?s)^{done[0]}{inner}{last}\\z"


def matches(word: Column, pattern: str, budget: str = "scaled") -> Column:
    """Whether ``word`` matches; a pattern without wildcards is an equality, which a scan can use."""
    if not is_pattern(pattern):
        return word == F.lit(pattern)
    if budget == "unbounded":
        return legacy_matches(word, pattern)
    return word.rlike(to_regex(pattern, budget))


def may_match(folded: pa.Array, patterns: list[str]) -> np.ndarray:
    """Whether a word that has ``folded`` as its lower-case form may match any of ``patterns``: by what stands before the first and after the last wildcard."""
    found = np.zeros(len(folded), bool)
    for p in (p.lower() for p in patterns):
        if is_pattern(p):
            head, tail = re.match(r"[^*?]*", p)[0], re.search(r"[^*?]*\Z", p)[0]
            hit = pc.and_(pc.starts_with(folded, head), pc.ends_with(folded, tail))
        else:
            hit = pc.equal(folded, p)
        found |= hit.to_numpy(zero_copy_only=False)
    return found


def legacy_matches(word: Column, pattern: str) -> Column:
    """Unbounded matching of the lower-cased pattern: equal, starts with, ends with, contains, or any glob."""
    p = pattern.lower()
    body = p.strip("*")
    if "?" not in p and "*" not in body:
        if p == body:
            return word == F.lit(p)
        if not body:
            return F.lit(True)
        if p.startswith("*") and p.endswith("*"):
            return word.contains(body)
        return word.endswith(body) if p.startswith("*") else word.startswith(body)
    return word.rlike("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else _escape(c) for c in p) + "\\z")
