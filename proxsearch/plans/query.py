"""From a query string to a plan over an index (term, doc_id, postings)."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wildcard import is_pattern, matches
from ..operators.inverted import bucket
from ..operators.proximity import chain_rows

RESULT = "doc_id long, matches array<array<struct<position:int,char_start:int,char_len:int>>>"


@dataclass(frozen=True)
class Query:
    """Terms are what spaces separate; nothing is folded or tokenized, but by ``fold``."""

    text: str
    adjacency: int = 2
    budget: str = "scaled"
    keep_unmatched: bool = False
    fold: bool = False

    def __post_init__(self) -> None:
        if self.adjacency < 0:
            raise ValueError("adjacency must be 0 or more")

    @property
    def terms(self) -> list[str]:
        text = self.text.lower() if self.fold else self.text
        return [t for t in text.split(" ") if t]


def expansion(vocab: DataFrame, query: Query) -> DataFrame:
    """(term_no, pattern, term): the words of ``vocab`` that each term of the query stands for."""
    hits = [F.when(matches(F.col("term"), t, query.budget), F.struct(F.lit(i).alias("term_no"), F.lit(t).alias("pattern"))) for i, t in enumerate(query.terms)]
    if not hits:
        return vocab.sparkSession.createDataFrame([], "term_no int, pattern string, term string")
    return vocab.select("term", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.term_no", "h.pattern", "term")


def _wanted(query: Query, buckets: int | None) -> Column:
    """Rows that any term needs. Literal terms reach the scan as equalities, with their buckets if there are."""
    cond = None
    for t in dict.fromkeys(query.terms):
        c = matches(F.col("term"), t, query.budget)
        if buckets and not is_pattern(t):
            c = (F.col("bucket") == bucket(F.lit(t), buckets)) & c
        cond = c if cond is None else cond | c
    return cond


def grouped(index: DataFrame | Callable[[Column], DataFrame], query: Query, buckets: int | None = None) -> DataFrame:
    """(doc_id, l0, l1, ...): per document that has every term, the postings of each, in no order.

    One scan and one shuffle, whatever the number of terms: a term's postings are the union over the
    words it stands for; a repeated term is a list of its own. ``index``: rows, or what gives them for a condition.
    """
    cols = []
    for i, t in enumerate(query.terms):
        mine = F.when(matches(F.col("term"), t, query.budget), F.col("postings"))
        cols.append(F.flatten(F.collect_list(mine)).alias(f"l{i}"))
    wanted = _wanted(query, buckets)
    rows = (index(wanted) if callable(index) else index.where(wanted)).groupBy("doc_id").agg(*cols)
    for i in range(len(cols)):
        rows = rows.where(F.size(f"l{i}") > 0)
    return rows


def search(index: DataFrame | Callable[[Column], DataFrame], query: Query, buckets: int | None = None, ordered: bool = True) -> DataFrame:
    """(doc_id, matches) of the documents that match, in ascending order of doc_id; not ``ordered``, as they are found, without a sort.

    A document with all terms but no match is left out unless keep_unmatched. An empty query finds nothing.
    """
    if not query.terms:
        return SparkSession.active().createDataFrame([], RESULT)
    found = chain_rows(grouped(index, query, buckets), len(query.terms), query.adjacency, query.keep_unmatched)
    return found.orderBy("doc_id") if ordered else found


def rarest_first(index: DataFrame, vocab: DataFrame, query: Query) -> DataFrame:
    """``index`` without the documents that lack the query's rarest term, by the document counts of ``vocab``.

    Worth it where one term is rare and others are in most documents: a semi-join before the postings move.
    """
    if len(query.terms) < 2:
        return index
    counts = {r["term_no"]: r["n"] for r in expansion(vocab, query).join(vocab, "term").groupBy("term_no").agg(F.sum("doc_freq").alias("n")).collect()}
    least = min(range(len(query.terms)), key=lambda i: counts.get(i, 0))
    some = index.where(matches(F.col("term"), query.terms[least], query.budget)).select("doc_id").distinct()
    return index.join(some, "doc_id", "left_semi")


class LatestSearch:
    """Runs one action at a time: starting another cancels the jobs of the one before, started or not."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.lock = spark, "", threading.Lock()

    def cancel(self) -> None:
        with self.lock:
            if self.tag:
                self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(self.tag)
            self.tag = ""

    def run(self, action: Callable[[], Any]) -> Any:
        self.cancel()
        tag = f"search-{uuid.uuid4().hex}"
        with self.lock:
            self.tag = tag
        context = self.spark.sparkContext
        context.setJobGroup(tag, "search", interruptOnCancel=True)
        try:
            return action()
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
